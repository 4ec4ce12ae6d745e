"""Values that source text pins: constants that bound something, and assertions that fail on any other value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What is a number, a name of a bound, a constant, and the two shapes of an assertion on one value.
LITERAL = r"^(?:0[xX][0-9a-fA-F_]+|[-+]?\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][-+]?\d+)?)(?:[iuf](?:8|16|32|64|128|size)|[uU][lL]{0,2}|[lL]{1,2}[uU]?|[fF])?$"
BOUND_NAME = r"_(?:MAX|MIN|SIZE|LIMIT|LEN|CAP|CAPACITY|BUDGET|THRESHOLD|STEPS|WINDOW|COUNT|BYTES|WIDTH|DEPTH|TIMEOUT|INTERVAL|STRIDE|ALIGN|RATIO|DIM)$|^(?:MAX|MIN|DEFAULT)_"
RUST_CONST = r"^\s*(?:pub(?:\s*\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?([A-Z][A-Z0-9_]*)\s*:\s*([^=;]+?)\s*=\s*([^;]+);"
EQUALITY = r"^([A-Za-z_][A-Za-z0-9_]*(?:(?:::|\.)[A-Za-z_][A-Za-z0-9_]*)*)\s*==\s*(\S+)$"
DIVISIBILITY = r"^([A-Za-z_][A-Za-z0-9_]*(?:(?:::|\.)[A-Za-z_][A-Za-z0-9_]*)*)\s*%\s*(\S+)\s*==\s*0$"
#: A string in either kind of quotes, as it stands on one line.
QUOTED = r""""(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'"""


def number(literal: Column) -> Column:
    """The value of a literal, null for what is none as a whole: an expression is never read as its first number."""
    bare = F.regexp_replace(F.regexp_replace(literal, "_", ""), r"(?:(?<![0-9a-fA-FxX])|(?<=[0-9]))(?:[iuf](?:8|16|32|64|128|size)|[uUlL]+|(?<!^0[xX][0-9a-fA-F]{0,15})[fF])$", "")
    hexed = F.conv(F.substring(bare, 3, 16), 16, 10).cast("double")
    return F.when(~literal.rlike(LITERAL), None).when(bare.rlike("^0[xX]"), hexed).otherwise(bare.try_cast("double"))


def statements(rows: DataFrame, mark: str) -> DataFrame:
    """path, line and text of the logical lines of rows (path, line, text): lines that a bracket leaves open go on with the next. Comments from mark on are left out, not within quotes.

    The depth before each line is a running sum in a window a file; a statement is gathered by itself.
    """
    code = F.regexp_replace("text", rf"((?:{QUOTED}|(?!{mark})[^\"'])*)(?:{mark}.*)?", "$1")
    bare = F.regexp_replace("_c", QUOTED, "")
    opened = F.length(F.regexp_replace(bare, r"[^(\[{]", "")) - F.length(F.regexp_replace(bare, r"[^)\]}]", ""))
    here = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    deep = rows.withColumn("_c", F.trim(code)).withColumn("_d", opened).withColumn("_before", F.coalesce(F.sum("_d").over(here), F.lit(0)))
    # a bracket closed too often, or a block that stays open, does not join the rest: only what an opened line needs counts
    low = F.coalesce(F.min(F.col("_before") + F.col("_d")).over(here), F.lit(0))
    new = deep.withColumn("_new", (F.col("_before") <= F.least(low, F.lit(0))).cast("int"))
    runs = new.withColumn("_s", F.sum("_new").over(here.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.where("_c <> ''").groupBy("path", "_s").agg(F.min("line").alias("line"), F.array_sort(F.collect_list(F.struct("line", "_c"))).alias("_p"))
    return out.select("path", "line", F.trim(F.regexp_replace(F.array_join(F.transform("_p", lambda p: p["_c"]), " "), r"\s+", " ")).alias("text"))


def arguments(body: Column) -> Column:
    """The arguments between a text's first bracket, with which it begins, and the one that closes it: split at commas outside brackets and quotes. Null if it is not closed."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("quote"), F.lit(False).alias("skip"), F.lit(0).alias("at"), F.lit(0).alias("end"), F.array().cast("array<int>").alias("cuts"))

    def step(a: Column, c: Column) -> Column:
        at, inside, over = a["at"] + 1, a["quote"] != "", a["end"] > 0
        depth = F.when(inside | a["skip"] | over, a["depth"]).when(c.isin("(", "[", "{"), a["depth"] + 1).when(c.isin(")", "]", "}"), a["depth"] - 1).otherwise(a["depth"])
        quote = F.when(a["skip"] | over, a["quote"]).when(inside, F.when(c == a["quote"], "").otherwise(a["quote"])).when(c.isin('"', "'"), c).otherwise("")
        cut = ~inside & ~a["skip"] & ~over & (c == ",") & (a["depth"] == 1)
        end = F.when(over, a["end"]).when((depth == 0) & (a["depth"] == 1), at).otherwise(0)
        return F.struct(depth.alias("depth"), quote.alias("quote"), (inside & ~a["skip"] & (c == "\\")).alias("skip"), at.alias("at"), end.alias("end"), F.when(cut, F.concat(a["cuts"], F.array(at))).otherwise(a["cuts"]).alias("cuts"))

    fold = F.aggregate(F.split(body, ""), start, step)
    edges = F.concat(F.array(F.lit(1)), fold["cuts"], F.array(fold["end"]))
    parts = F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda i: F.trim(F.call_function("substring", body, F.element_at(edges, i) + 1, F.element_at(edges, i + 1) - F.element_at(edges, i) - 1)))
    return F.when(fold["end"] > 0, parts)


def _pinned(rows: DataFrame) -> DataFrame:
    """rows (path, line, args) of assertions as pins."""
    expr = F.trim(F.regexp_replace(F.regexp_replace(F.element_at("args", 1), r"\s+", " "), r"^\(([^()]*(?:\([^()]*\)[^()]*)*)\)$", "$1"))
    said = F.regexp_replace(F.coalesce(F.try_element_at("args", F.lit(2)), F.lit("")), r"""^["'](.*)["']$""", "$1")
    rows = rows.withColumn("_e", expr).withColumn("message", F.nullif(said, F.lit("")))
    divides = F.col("_e").rlike(DIVISIBILITY)
    get = lambda i: F.when(divides, F.regexp_extract("_e", DIVISIBILITY, i)).otherwise(F.regexp_extract("_e", EQUALITY, i))
    rows = rows.where(divides | F.col("_e").rlike(EQUALITY)).withColumn("literal", get(2)).withColumn("value", number(F.col("literal"))).where("value IS NOT NULL")
    name = F.element_at(F.split(get(1), r"::|\."), -1)
    return rows.select("path", "line", name.alias("name"), F.when(divides, "divisible_by").otherwise("pinned_to").alias("predicate"), "value", "literal", "message", F.lit("constraint").alias("kind"), F.lit(True).alias("binding"))


def pins(rows: DataFrame) -> DataFrame:
    """path, name, predicate, value, literal, message, kind, binding, line and also_at of what source lines (path, line, text, language) pin.

    rust: a const or static whose name is a bound's and whose value is one number is a state. c: a static_assert, and
    python: an assert with a message, of one name against one number is a constraint, whatever brackets and lines it is
    spread over. A disjunction pins nothing, nor does an expression. The same pin at several lines of a file is one.
    """
    t = F.regexp_replace("text", "//.*$", "")
    get = lambda i: F.regexp_extract(t, RUST_CONST, i)
    rust = rows.where("language = 'rust'").where(t.rlike(RUST_CONST)).select("path", "line", get(1).alias("name"), F.lit("set_to").alias("predicate"), number(F.trim(get(3))).alias("value"), F.trim(get(3)).alias("literal"), F.lit(None).cast("string").alias("message"), F.lit("state").alias("kind"), F.lit(False).alias("binding"))
    rust = rust.where(F.col("name").rlike(BOUND_NAME) & F.col("value").isNotNull())
    c = statements(rows.where("language = 'c'").where(~F.col("text").rlike(r"^\s*#")), "//")
    # an open block leaves its statements joined: each static_assert of a text is read by itself
    bodies = F.slice(F.split("text", r"\bstatic_assert\s*(?=\()"), 2, 1 << 20)
    c = c.where(F.contains("text", F.lit("static_assert"))).select("path", "line", F.posexplode(bodies).alias("i", "body"))
    return _told(rust.unionByName(_pinned(_c_lines(rows, c))).unionByName(_pinned(_python(rows))))


def _c_lines(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """args of the static_asserts of joined texts, each with the line it stands on: the i-th of the file's lines that have one, from the text's on."""
    at = rows.where("language = 'c'").where(F.regexp_replace("text", "//.*$", "").rlike(r"\bstatic_assert\s*\(|\bstatic_assert\s*$"))
    at = at.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("line"))).select("path", F.col("line").alias("_line"), "_n")
    order = F.row_number().over(Window.partitionBy("path").orderBy("line", "i"))
    each = joined.withColumn("_n", order).join(at, ["path", "_n"])
    return each.select("path", F.col("_line").alias("line"), arguments(F.col("body")).alias("args")).where("args IS NOT NULL")


def _python(rows: DataFrame) -> DataFrame:
    """args of the asserts with a message."""
    said = statements(rows.where("language = 'python'"), "#").where(F.col("text").rlike(r"^assert\b"))
    body = F.concat(F.lit("("), F.trim(F.regexp_replace("text", r"^assert\b", "")), F.lit(")"))
    return said.select("path", "line", arguments(body).alias("args")).where(F.size("args") >= 2)


def _told(found: DataFrame) -> DataFrame:
    own = ["path", "name", "predicate", "value", "kind", "binding"]
    one = found.groupBy(*own).agg(F.min_by(F.struct("line", "literal", "message"), "line").alias("r"), F.array_sort(F.collect_set("line")).alias("_all"))
    return one.select(*own, "r.*", F.slice("_all", 2, 1 << 20).alias("also_at"))
