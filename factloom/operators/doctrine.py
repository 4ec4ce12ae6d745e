"""Doctrine: imperative sentences of prose, what each is about, and whether anything enforces it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What makes a sentence a rule, the first that fits, and how strong; absolute before prohibition before obligation.
MARKERS = (
    (r"(?i)\bunder no circumstances\b", "absolute"),
    (r"(?i)\bno exceptions?\b", "absolute"),
    (r"(?i)\bnon-negotiable\b", "absolute"),
    (r"(?i)\bnever\b", "absolute"),
    (r"(?i)\bforbidden\b|\bforbid(s|den)?\b", "absolute"),
    (r"(?i)\bbanned\b|\bis a ban\b|\bban(s)? (this|that|it)\b", "absolute"),
    (r"(?i)\bprohibited\b", "absolute"),
    (r"(?i)\bmust not\b|\bmustn't\b|\bshall not\b|\bshan't\b", "absolute"),
    (r"(?i)\bmay not\b|\bcannot\b|\bcan not\b", "prohibition"),
    (r"(?i)\bdo not\b|\bdon't\b", "prohibition"),
    (r"\bNO\s+[A-Z][A-Z-]+", "prohibition"),
    (r"(?i)\*\*[^*]*\bor no\s+\w+[^*]*\*\*", "prohibition"),
    (r"(?i)\bmust\b|\brequired\b|\bmandatory\b", "obligation"),
    (r"(?i)\balways\b", "obligation"),
)
RANK = {"absolute": 0, "prohibition": 1, "obligation": 2}
#: Marks of a rule that was taken back, and of a sentence that tells of the past instead of ruling.
RETRACTED = r"(?i)(~~|\bRETRACTED\b|\bSUPERSEDED\b|\bsuperseded by\b|\bno longer\b|\bwas wrong\b|\bthis reverses\b|\breversed\b|\bcorrected in\b|\bwithdrawn\b|❌|⛔ ?RETRACT)"
DESCRIPTIVE = (
    r"(?i)\b(has|have|had|was|were|been|being)\s+(\w+\s+)?never\b",
    r"(?i)\bnever\s+(been|ran|run|reported|measured|deployed|existed|happened|worked|tested|shipped|landed|printed|scanned|merged|reproduced|observed|attempted|arrived|returned|fired)\b",
    r"(?i)\b(is|are|it|that|which|this)\s+never\s+(been|a|an|the)\b",
    r"(?i)\bnot always\b",
    r"(?i)\bmust\s+(have|be\s+(why|because|the reason))\b",
)
#: What counts for a sentence being doctrine, and how much.
FILE_SIGNAL = (("doctrine|rules?|protocol|polic|invariant|convention|standard|guideline|contributing|agents|discipline|access_rule", 3),)
HEADING_SIGNALS = ((r"(?i)doctrine|\brule", 2), (r"(?i)invariant|non-negotiable|must|never|ban|forbid|prohibit|discipline|hard\b|policy|regression", 2), (r"\bNO\s+[A-Z][A-Z]", 2))
SENTENCE_SIGNALS = (
    (r"`[^`]{2,60}`|(?<![\w-])--[A-Za-z][\w-]{2,40}|\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b|\b[A-Za-z]\w*\s*=\s*\d", 2),
    (r"(?i)\b(because|so that|which is why|the reason|for days|i\.e\.|e\.g\.|turns out)\b", -2),
)
#: Words that name no mechanism.
STOP = (
    "never always must should this that with from they them then than when what which will would could been being have does into every each only ever also more most less "
    "because before after above below here there thing things rule rules doctrine note notes make made take said says real same other work works used using like just even both "
    "under over without within whole still again banned forbidden prohibited mandatory required forever absolute absolutely exception exceptions violating negotiable regression invariant invariants policy"
).split()
#: Tokens of a sentence at most.
MOST_TOKENS = 8


def blocks(lines: DataFrame) -> DataFrame:
    """doc_id, heading, text and starts (place in the text, line) of the blocks of prose lines (doc_id, line, text: those with a word): paragraphs and list items unwrapped, and headings. Fenced code and tables are left out.

    Numbered gaps in a window a document; a block is gathered by itself.
    """
    here = Window.partitionBy("doc_id").orderBy("line")
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    t = F.trim("text")
    fence, title = t.rlike("^(```|~~~)"), F.regexp_extract(t, r"^#{1,6}\s+(.*)$", 1)
    rows = lines.withColumn("_fences", F.count_if(fence).over(upto)).where((F.col("_fences") % 2 == 0) & ~fence & ~t.startswith("|"))
    rows = rows.withColumn("_title", title).withColumn("heading", F.last(F.when(F.col("_title") != "", F.trim(F.regexp_replace("_title", "[*`]", ""))), ignorenulls=True).over(upto))
    apart = (F.col("line") != F.lag("line").over(here) + 1) | (F.col("_title") != "") | (F.lag("_title").over(here) != "") | F.col("text").rlike(r"^\s*(?:[-*+]\s|\d+[.)]\s)")
    rows = rows.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("_block", F.sum("_new").over(upto))
    piece = F.when(F.col("_title") != "", F.col("_title")).otherwise(t)
    each = rows.groupBy("doc_id", "_block").agg(F.first("heading").alias("heading"), F.array_sort(F.collect_list(F.struct("line", piece.alias("text")))).alias("_p"))
    # where each piece begins once they are joined by spaces
    starts = F.transform("_p", lambda p, i: F.struct((F.aggregate(F.slice("_p", 1, i), F.lit(0), lambda a, q: a + F.length(q["text"]) + 1)).alias("at"), p["line"].alias("line")))
    return each.select("doc_id", "heading", F.array_join(F.transform("_p", lambda p: p["text"]), " ").alias("text"), starts.alias("starts"))


#: A sentence ends at a full stop or mark, closing marks included, before a space and what can begin a sentence; not after an abbreviation.
_END = r"""(?<=[.!?][*`")”]{0,4})(?<!\b(?:e\.g|i\.e|vs|cf|etc|no|fig|approx|ca)\.)(?<![.!?] ) (?=[A-Z*`_'"(—‘“0-9])"""


def sentences(blocks_: DataFrame) -> DataFrame:
    """doc_id, heading, line and text of the sentences of blocks, each with the line it begins on; those of less than eight characters are left out."""
    parts = F.split("text", _END)
    at = F.aggregate(F.slice("_s", 1, F.col("i")), F.lit(0), lambda a, s: a + F.length(s) + 1)
    rows = blocks_.withColumn("_s", parts).select("doc_id", "heading", "starts", "_s", F.posexplode("_s").alias("i", "_t"))
    before = F.filter("starts", lambda x: x["at"] <= F.col("_at"))
    out = rows.withColumn("_at", at).select("doc_id", "heading", F.element_at(before, -1)["line"].alias("line"), F.trim("_t").alias("text"))
    return out.where(F.length("text") >= 8)


def tokens(text: str) -> Column:
    """The strings of a sentence that a config enforcing it would hold, in lower case: code spans, flags, constants, settings, paths, qualified names; shouted words if there are none."""
    every = lambda pattern, i=1: F.regexp_extract_all(text, F.lit(pattern), F.lit(i))
    spans = F.flatten(F.transform(every("`([^`]{2,60})`"), lambda s: F.split(s, r"""[\s,"']+""")))
    spans = F.filter(F.transform(spans, lambda s: F.regexp_replace(F.regexp_replace(s, "^-{0,2}", ""), "[.,;:)]+$", "")), lambda s: F.length(s) >= 3)
    setting = r"\b([A-Za-z]\w*)\s*=\s*(\d[\w.]*)"
    settings = F.flatten(F.transform(F.arrays_zip(every(setting, 1).alias("k"), every(setting, 2).alias("v")), lambda x: F.array(F.concat(x["k"], F.lit("="), x["v"]), x["k"])))
    strong = F.concat(spans, every(r"(?<![\w-])--?([A-Za-z][\w-]{2,40})"), every(r"\b([A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+)\b"), settings, every(r"\b([\w.-]+/[\w./-]+\.[A-Za-z]{1,5})\b"), every(r"\b(\w+::\w+)\b"))
    stop = F.array(*map(F.lit, STOP))
    clean = lambda xs: F.slice(F.array_distinct(F.filter(F.transform(xs, F.lower), lambda x: ~F.array_contains(stop, x))), 1, MOST_TOKENS)
    named = clean(strong)
    return F.when(F.size(named) > 0, named).otherwise(clean(every(r"\b([A-Z]{4,20})\b")))


def target(text: str, marker_at: Column, tokens_: str) -> Column:
    """The token nearest to a marker (its place from 1): one before it counts double its distance; of equal ones the first named."""
    lower = F.lower(text)
    cost = lambda at: F.when(at >= marker_at, at - marker_at).otherwise((marker_at - at) * 2)
    place = lambda x: F.call_function("locate", x, lower)
    near = F.transform(tokens_, lambda x, i: F.struct(F.when(place(x) > 0, cost(place(x))).otherwise(1 << 30).alias("cost"), i.alias("i"), x.alias("token")))
    return F.array_min(near)["token"]


def corpus(enforcers: DataFrame) -> DataFrame:
    """token of what binding rules (text, binding) say: names as written, and their parts, of three characters at least."""
    raw = F.filter(F.split(F.lower("text"), "[^a-z0-9_:=.+-]+"), lambda x: F.length(x) >= 3)
    parts = F.filter(F.flatten(F.transform(raw, lambda x: F.split(x, "[/:=.\\-_+]+"))), lambda x: F.length(x) >= 3)
    return enforcers.where("binding").select(F.explode(F.array_distinct(F.concat(raw, parts))).alias("token")).distinct()


def scan(sentences_: DataFrame, enforced: DataFrame) -> DataFrame:
    """The rules among sentences (doc_id, path, heading, line, text): statement, its first place, strength, marker, target, doctrinal score, repeats beyond the first, and whether enforced (token) has the target.

    A sentence under a retraction, one that tells of the past, and one that names nothing to look up are no rules. The
    same rule in several places, whatever its case and marks, is one.
    """
    first = F.coalesce(*(F.when(F.col("text").rlike(p), F.struct(F.lit(i).alias("i"), F.regexp_instr("text", F.lit(p)).alias("at"), F.trim(F.regexp_extract("text", f"({p})" if not p.startswith("(?i)") else f"(?i)({p[4:]})", 1)).alias("marker"))) for i, (p, _) in enumerate(MARKERS)))
    rows = sentences_.withColumn("_m", first).where(F.col("_m").isNotNull())
    back = F.col("text").rlike(RETRACTED) | F.coalesce(F.col("heading").rlike(RETRACTED), F.lit(False))
    told = F.lit(False)
    for p in DESCRIPTIVE:
        told = told | F.col("text").rlike(p)
    rows = rows.where(~back & ~told).withColumn("_t", tokens("text")).where(F.size("_t") > 0)
    strength = F.element_at(F.array(*(F.lit(s) for _, s in MARKERS)), F.col("_m.i") + 1)
    score = lambda c, signals: sum((F.when(F.coalesce(F.col(c).rlike(p), F.lit(False)), n).otherwise(0) for p, n in signals), F.lit(0))
    length = F.length("statement")
    rows = rows.withColumn("statement", F.when(F.length("text") > 400, F.concat(F.substring("text", 1, 397), F.lit("..."))).otherwise(F.col("text")))
    doctrinal = score("path", [(f"(?i){p}", n) for p, n in FILE_SIGNAL]) + score("heading", HEADING_SIGNALS) + score("text", SENTENCE_SIGNALS) + F.when(length <= 120, 2).when(length <= 200, 1).otherwise(0)
    rows = rows.select("doc_id", "line", "heading", "statement", strength.alias("strength"), F.col("_m.marker").alias("marker"), target("text", F.col("_m.at"), "_t").alias("target"), doctrinal.alias("doctrinal"))
    same = F.trim(F.regexp_replace(F.lower("statement"), "[^a-z0-9]+", " "))
    own = ["doc_id", "line", "heading", "statement", "strength", "marker", "target", "doctrinal"]
    one = rows.groupBy(same.alias("_same")).agg(F.min_by(F.struct(*own), F.struct("doc_id", "line")).alias("r"), (F.count(F.lit(1)) - 1).alias("also_at")).select("r.*", "also_at")
    hit = enforced.select(F.col("token").alias("target")).distinct().withColumn("enforced", F.lit(True))
    return one.join(hit, "target", "left").select(*own, "also_at", F.coalesce("enforced", F.lit(False)).alias("enforced"))


def findings(scanned: DataFrame) -> DataFrame:
    """The rules that nothing enforces: the most doctrinal first, then the strongest, the most repeated, by place."""
    rank = F.create_map(*(F.lit(x) for s, n in RANK.items() for x in (s, n)))
    return scanned.where("NOT enforced").orderBy(F.desc("doctrinal"), rank[F.col("strength")], F.desc("also_at"), "doc_id", "line")


def to_record(found: DataFrame, scope: str, first_id: int) -> DataFrame:
    """Findings as unverified assertions of kind untried, for the store: what is ruled, that nothing enforces it, and where it is said."""
    from .prose import clean

    n = F.row_number().over(Window.orderBy("doc_id", "line"))  # findings, not lines: few
    return found.select((n + first_id - 1).cast("long").alias("id"), F.lit(scope).alias("scope"), clean("target").alias("subject"), F.lit("unenforced_rule").alias("predicate"), F.col("doctrinal").cast("double").alias("value"), F.lit("untried").alias("kind"), F.lit("unverified").alias("confidence"), F.concat_ws(":", "doc_id", "line").alias("source"), F.concat(F.lit("nothing that fails mentions "), "target").alias("why"))
