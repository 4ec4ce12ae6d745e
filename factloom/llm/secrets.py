r"""Secret scans through a trigram inverted index. DataFrame operations only.

Each rule is a regular expression. From its syntax come strings that every match must hold: a conjunction of choices.
A text holds a string only if it holds all the string's trigrams, so each rule has a Boolean query over trigrams. The
index is inverted: of each trigram of the rules and each block of documents, the list of the documents whose lower-cased
text holds it. A block's lists meet, are intersected and united as the queries say, and what is left are each rule's
candidates, the only texts in which it is verified. Documents are dealt to blocks of bounded size by a hash, so no list
grows with the data. A rule without mandatory trigrams scans every text.

Matches are leftmost and do not overlap within a rule; those that fail a rule's least length are dropped afterwards.
Nulls: a null text is empty; a null id is an id. Repeated rows are each scanned. Spans count code points from 0. Very
long texts are scanned whole. An empty table has no results. The columns named spans and base_spans are replaced; all
others are carried through whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import counted, packed, table, unpacked, wide_key

_parser = re._parser

#: Strings that a part of a pattern may stand for before it counts as unknown.
_MOST_STRINGS = 64
#: Documents whose posting lists meet in one row, about: 16 bytes a document and trigram of the rules.
BLOCK_DOCS = 8192


@dataclass(frozen=True)
class Rule:
    """A match counts if it has least code points, or if group is set, that group has."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


def _fold(word: str) -> str:
    """A word in either case, for dialects that disagree on case beyond ASCII."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The base kinds, in their order, then further public formats of keys.
BASE = (
    Rule(
        "assign",
        "(" + "|".join([*map(_fold, ("password", "passwd", "secret", "token")), _fold("api") + "_?" + _fold("key")]) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        6,
        2,
    ),
    Rule("access", "AKIA[A-Z0-9]+", 20),
    # runs are maximal, so those of the least length are found as such
    Rule("hex", "[0-9a-f]{24,}", 24),
)
FURTHER = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", "[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
RULES = BASE + FURTHER


def _read(parsed) -> tuple[set[str] | None, list[set[str]]]:
    """The strings that a parsed pattern stands for, if they are few, else None; and sets of strings of which a match holds one each."""
    exact: set[str] | None = {""}
    held: list[set[str]] = []

    def cut() -> None:
        nonlocal exact
        if exact:
            held.append(exact)
        exact = {""}

    for op, arg in parsed:
        name, one, inner = str(op), None, []
        if name == "LITERAL":
            one = {chr(arg).lower()}
        elif name == "IN":
            one = set()
            for what, x in arg:
                if str(what) == "LITERAL":
                    one.add(chr(x).lower())
                elif str(what) == "RANGE" and x[1] - x[0] < 8:
                    one |= {chr(k).lower() for k in range(x[0], x[1] + 1)}
                else:
                    one = None
                    break
        elif name == "SUBPATTERN":
            one, inner = _read(arg[3])
        elif name == "BRANCH":
            parts = [_read(p) for p in arg[1]]
            one = set().union(*(e for e, _ in parts)) if all(e is not None for e, _ in parts) else None
            if one is None:
                best = [e if e is not None else max(h, key=lambda s: min(map(len, s)), default={""}) for e, h in parts]
                inner = [set().union(*best)]
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, what = arg
            e, h = _read(what)
            if e is not None and int(high) <= 1:
                one = e | ({""} if low == 0 else set())
            elif e is not None and low == high and low <= 8 and len(e) ** int(low) <= _MOST_STRINGS:
                one = {"".join(x) for x in product(e, repeat=int(low))}
            elif low > 0:
                inner = h if e is None else [e]
        if one is not None and len(exact) * len(one) <= _MOST_STRINGS:
            exact = {a + b for a in exact for b in one}
            continue
        cut()
        held += inner
        if one is not None:
            exact = one
            if len(one) > _MOST_STRINGS:
                exact = {""}
    if not held and len(exact) <= _MOST_STRINGS and all(str(op) in ("LITERAL", "IN", "SUBPATTERN", "BRANCH", "MAX_REPEAT") for op, _ in parsed) and not _unknown(parsed):
        return exact, []
    cut()
    return None, held


def _unknown(parsed) -> bool:
    return any(str(op) == "MAX_REPEAT" and int(arg[1]) > 1 and arg[0] != arg[1] for op, arg in parsed)


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Of a pattern: choices, one of each of which a match satisfies; each option is a set of trigrams, all present.

    Trigrams are those of lower-cased text. No choices: nothing is mandatory.
    """
    exact, held = _read(_parser.parse(pattern))
    out = []
    for strings in held if exact is None else [exact]:
        if min(map(len, strings)) < 3:
            continue
        least = {s for s in strings if not any(t != s and t in s for t in strings)}
        out.append(sorted({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in least}, key=sorted))
    return out


def postings(docs: DataFrame, text: str, key: Column, trigrams: Sequence[str], blocks: int = 1) -> DataFrame:
    """trigram (its place in trigrams), block and keys: the sorted posting list of each trigram in each block of documents. key: a struct with a hash h."""
    there = docs.select(key.alias("key"), F.lower(text).alias("_lower"))
    flags = F.array(*(F.when(F.contains(F.col("_lower"), F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)))
    each = there.select("key", F.explode(F.array_compact(flags)).alias("trigram"))
    block = F.pmod(F.col("key.h"), F.lit(blocks)).alias("block")
    return each.groupBy("trigram", block).agg(F.array_sort(F.collect_set("key")).alias("keys"))


def _paired(rule: int):
    return lambda key: F.struct(key.alias("key"), F.lit(rule).alias("rule"))


def candidates(docs: DataFrame, text: str, key: Column, rules: Sequence[Rule]) -> DataFrame:
    """key and rules, the places of the rules with mandatory trigrams whose query a document satisfies; other documents have no row."""
    asked = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern))}
    trigrams = sorted({t for q in asked.values() for choice in q for option in choice for t in option})
    blocks = max(1, -(-docs.count() // BLOCK_DOCS))
    lists = postings(docs, text, key, trigrams, blocks).groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("lists"))
    nothing = F.array().cast("array<struct<h:bigint,g:bigint>>")
    posting = lambda t: F.coalesce(F.try_element_at("lists", F.lit(trigrams.index(t))), nothing)
    hit = []
    for i, q in asked.items():
        choices = [reduce(F.array_union, [reduce(F.array_intersect, map(posting, sorted(option))) for option in choice]) for choice in q]
        hit.append(F.transform(reduce(F.array_intersect, choices), _paired(i)))
    found = lists.select(F.explode(F.concat(*hit)).alias("x")).select("x.key", "x.rule")
    return found.groupBy("key").agg(F.collect_set("rule").alias("rules"))


def spans(text: str, rules: Sequence[Rule], i: int) -> Column:
    """Spans of rule i in text: an array of start, kind (i) and end."""
    rule = rules[i]
    pattern = F.lit(rule.pattern)
    # the groups of a rule are counted with its own; matches and the gaps between them alternate
    value = F.regexp_extract_all(F.col(text), pattern, F.lit(rule.group))
    whole = F.regexp_extract_all(F.col(text), pattern, F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    steps = F.zip_with(
        F.zip_with(whole, gaps, lambda m, g: F.struct(m.alias("m"), F.char_length(g).alias("g"))),
        value,
        lambda x, v: F.struct(x["g"].alias("g"), F.char_length(x["m"]).alias("n"), (F.char_length(v) >= rule.least).alias("ok")),
    )
    steps = F.filter(steps, lambda x: x["n"].isNotNull())
    kind = "array<struct<start:int,kind:int,end:int>>"
    walked = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")),
        lambda a, x: F.struct(
            (a["at"] + x["g"] + x["n"]).alias("at"),
            F.when(x["ok"], F.concat(a["out"], F.array(F.struct((a["at"] + x["g"]).alias("start"), F.lit(i).alias("kind"), (a["at"] + x["g"] + x["n"]).alias("end")))))
            .otherwise(a["out"])
            .cast(kind)
            .alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.when(F.size(whole) > 0, walked).otherwise(F.array().cast(kind))


def scanned(docs: DataFrame, text: str = "text", keys: Sequence[str] = ("doc_id",), rules: Sequence[Rule] = RULES, base: int = len(BASE)) -> DataFrame:
    """docs with spans: all spans, and base_spans: those of the first base rules, each an array of start, kind and end in order."""
    own = [c for c in docs.columns if c not in ("spans", "base_spans")]
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text"), wide_key(*keys, text).alias("_key"), F.struct(*(F.col(f"`{c}`") for c in own)).alias("_row"))
    asked = candidates(docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text"), wide_key(*keys, text).alias("_key")), "_text", F.col("_key"), rules)
    rows = rows.join(asked.select(F.col("key").alias("_key"), F.col("rules").alias("_rules")), "_key", "left")
    parts = []
    for i, rule in enumerate(rules):
        found = spans("_text", rules, i)
        if trigram_query(rule.pattern):
            found = F.when(F.array_contains("_rules", i), found)
        parts.append(F.coalesce(found, F.array().cast("array<struct<start:int,kind:int,end:int>>")))
    rows = rows.withColumn("spans", F.array_sort(F.concat(*parts)))
    rows = rows.withColumn("base_spans", F.filter("spans", lambda s: s["kind"] < base))
    return rows.select(*(F.col("_row")[c].alias(c) for c in own), "spans", "base_spans")


def rendered(spans: str, rules: Sequence[Rule] = RULES) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: str, spans: str, by: str = "[SECRET]") -> Column:
    """The text with each span, or run of overlapping spans, replaced."""
    walked = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when((s["start"] >= a["at"]) & (s["end"] > a["at"]), F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, s["start"] - a["at"]), F.lit(by))).otherwise(a["out"]).alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, F.char_length(text))),
    )
    return F.when(F.size(spans) > 0, walked).otherwise(F.col(text))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of all documents."""
    out = scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda i: F.size(F.filter("base_spans", lambda s: s["kind"] == i)).cast("long")
    return out.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(rendered("base_spans"), 256).alias("base_sha256"),
        rendered("spans").alias("spans"),
    )


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    out = scanned(packed(docs, "doc_id", "text")).withColumn("text", redacted("text", "spans"))
    return out.select(*counted(docs, unpacked(docs.columns, "doc_id", "text")))


def _sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def oracle(source: str) -> str:
    """CTEs of DuckDB SQL that end in found(rid, kind, name, s, e), over a table with columns rid and text."""
    each = []
    for i, r in enumerate(RULES):
        p = _sql_text(r.pattern)
        each.append(
            f"SELECT rid, {i} AS kind, '{r.kind}' AS name, {r.least} AS least, regexp_extract_all(text, {p}) AS m, "
            f"regexp_extract_all(text, {p}, {r.group}) AS v, regexp_split_to_array(text, {p}) AS g FROM (SELECT rid, coalesce(text, '') AS text FROM {source})"
        )
    return f"""
parts AS ({" UNION ALL ".join(each)}),
steps AS (SELECT rid, kind, name, least, m, v, g, unnest(range(1, len(m) + 1)) AS k FROM parts WHERE len(m) > 0),
found AS (SELECT rid, kind, name, CAST(list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS s,
                 CAST(list_sum(list_transform(g[1:k], lambda x: length(x))) + list_sum(list_transform(m[1:k], lambda x: length(x))) AS BIGINT) AS e
          FROM steps WHERE length(v[k]) >= least)"""


ORACLE_OP9 = f"""
WITH rows_ AS (SELECT row_number() OVER () AS rid, * FROM documents), {oracle("rows_")}
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM rows_ LEFT JOIN (
  SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < 3) AS base,
         string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) AS spans
  FROM found GROUP BY rid) USING (rid)
"""
