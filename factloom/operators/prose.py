"""Prose: ranked line search, proposals drawn from patterns, rules that nothing enforces."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line (from 1) and text of every line with a word."""
    out = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r?\n")).alias("line", "text"))
    return out.where(F.trim("text") != "").withColumn("line", (F.col("line") + 1).cast("long"))


def _tokens(c):
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: t != "")


def bm25(rows: DataFrame, terms: Sequence[str], phrase: str | None = None) -> DataFrame:
    """doc_id, line and score of lines with a term, lines being the documents of BM25; with phrase, whether the line holds that in a row. Lines are tokenised once, and only terms travel."""
    n, average = rows.select(F.size(_tokens("text")).alias("n")).agg(F.count(F.lit(1)), F.avg("n")).first()
    counted = rows.select("doc_id", "line", _tokens("text").alias("t"))
    held = F.contains(F.concat(F.lit(" "), F.array_join("t", " "), F.lit(" ")), F.lit(f" {phrase} ")) if phrase else F.lit(False)
    tf = counted.select("doc_id", "line", held.alias("phrase"), F.size("t").alias("len"), F.explode(F.filter("t", lambda w: w.isin(list(terms)))).alias("term")).groupBy("doc_id", "line", "phrase", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.ln(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(average)))
    out = tf.join(F.broadcast(df), "term").groupBy("doc_id", "line", "phrase").agg(F.round(F.sum(part), 4).alias("score"))
    return out if phrase else out.drop("phrase")


def key_values(rows: DataFrame) -> DataFrame:
    """Lines of the form key: value, as proposals."""
    form = r"^\s*([A-Za-z][A-Za-z _-]{1,40})\s*[:=]\s*(\S.{0,60})$"
    return rows.where(F.col("text").rlike(form)).select("doc_id", "line", F.lower(F.regexp_extract("text", form, 1)).alias("predicate"), F.regexp_extract("text", form, 2).alias("object"))


def first_of_each(proposals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first proposal of each identity and how often it came."""
    return proposals.groupBy(*keys).agg(F.min(F.struct("doc_id", "line")).alias("f"), F.count(F.lit(1)).alias("n")).select(*keys, "f.doc_id", "f.line", "n")


def unenforced(doctrine: DataFrame, enforced: DataFrame) -> DataFrame:
    """Lines (doc_id, line, text) none of whose words is among enforced (token)."""
    words = doctrine.select("doc_id", "line", F.explode(F.array_distinct(_tokens("text"))).alias("token"))
    hit = words.join(enforced, "token", "left_semi").select("doc_id", "line").distinct()
    return doctrine.join(hit, ["doc_id", "line"], "left_anti")


#: Words that make a line no statement of fact, units of measurement.
DISQUALIFYING = ("retracted", "superseded", "fabricated", "obsolete", "deprecated", "no longer", "wrong", "never ran", "never verified", "not verified", "unverified", "unmeasured", "do not quote", "estimate", "estimated", "guess", "assume", "assumed", "phantom", "todo", "fixme")
UNITS = ("ms", "s", "min", "h", "days", "mm", "cm", "m", "kg", "g", "B", "KB", "MB", "GB", "tokens", "words", "rows", "files", "%")
NUMBER = r"-?[0-9][0-9,]*(?:\.[0-9]+)?"
_UNIT = "|".join(UNITS)
KV_LINE = rf"^([A-Za-z][A-Za-z0-9_.-]*(?: [A-Za-z0-9_.-]+){{0,4}}) *: *({NUMBER})(?: *({_UNIT}))? *$"
MEASURED = rf"(?:^|[.;!?]\s+)([A-Za-z_][A-Za-z0-9_./-]*(?:\s+[A-Za-z0-9_./-]+){{0,4}}?)\s+(?:is|are|was|were)\s+(?:now\s+|about\s+)?({NUMBER})\s*({_UNIT})(?:$|[^A-Za-z0-9_/-])"
DEFINED = r"^([A-Za-z_][A-Za-z0-9_./:-]{1,50})\s+(?:is|are)\s+(?:a|an|the)\s+([^.!?;:]{4,120})\.$"
#: A word that looks like a name: with a separator inside it, or an inner capital.
TERM = r"[A-Za-z0-9][_./:][A-Za-z0-9]|[a-z][A-Z]"
SELF_CONFIDENCE = {"key_value": 0.7, "measured": 0.6, "defined": 0.35}
#: Subjects that name nothing.
PRONOUNS = ("it", "this", "that", "these", "those", "they", "there", "he", "she", "we", "you", "i", "which", "what")


def name_tokens(c: str) -> Column:
    """The tokens of a line: words in lower case, and the parts of names in snake or camel case beside them."""
    chunks = F.filter(F.split(c, "[^A-Za-z0-9_]+"), lambda x: x != "")
    parts = lambda x: F.filter(F.transform(F.regexp_extract_all(x, F.lit("[A-Z]+(?![a-z])|[A-Z][a-z0-9]*|[a-z]+|[0-9]+"), F.lit(0)), F.lower), lambda p: p != F.lower(x))
    return F.flatten(F.transform(chunks, lambda x: F.concat(F.array(F.lower(x)), parts(x))))


def phrase_boosted(rows: DataFrame, query: str, limit: int = 10, boost: float = 2.0) -> DataFrame:
    """doc_id, line, score and phrase of the lines found by the words of query: bm25, lines that hold them in a row scored boost times. Best first, then by place."""
    words = [w for w in re.split("[^a-z0-9]+", query.lower()) if w]
    found = bm25(rows, tuple(dict.fromkeys(words)), " ".join(words))
    out = found.withColumn("score", F.round(F.col("score") * F.when(F.col("phrase"), boost).otherwise(1.0), 4))
    return out.orderBy(F.desc("score"), "doc_id", "line").limit(limit)


def with_context(hits: DataFrame, rows: DataFrame, around: int = 2) -> DataFrame:
    """hits with snippet: the lines up to around before and after each. Hits are few and meet lines by document."""
    near = hits.select("doc_id", F.col("line").alias("_hit"), F.explode(F.sequence(F.col("line") - around, F.col("line") + around)).alias("line")).join(rows, ["doc_id", "line"])
    text = near.groupBy("doc_id", F.col("_hit").alias("line")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", F.substring("text", 1, 300).alias("text")))), lambda x: x["text"]), "\n").alias("snippet"))
    return hits.join(text, ["doc_id", "line"])


def fallback(hits: DataFrame, rows: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """doc_id, line, score of prose, but only if the store found nothing."""
    found = phrase_boosted(rows, query, limit)
    return found if hits.isEmpty() else found.limit(0)


def statements(rows: DataFrame) -> DataFrame:
    """Lines that may state a fact: no front matter, fences or what is in them, headings, rules, quotes, tables, tags or indented code; with heading, the last one before.

    Fences open and close by their parity in the document, a running count in a window a document.
    """
    so_far = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    t = F.trim("text")
    fence, rule = t.startswith("```"), t.rlike("^(-{3,}|[*]{3,}|_{3,})$")
    out = rows.withColumn("_fences", F.count_if(fence).over(so_far)).withColumn("_rules", F.count_if(t == "---").over(so_far)).withColumn("_first", F.first("text").over(so_far) == "---")
    out = out.withColumn("heading", F.last(F.when(t.rlike("^#{1,6} "), F.regexp_replace(t, "^#+ *", "")), ignorenulls=True).over(so_far))
    front = F.col("_first") & (F.col("_rules") < 2)
    other = fence | rule | t.rlike("^(#{1,6} |>|[|]|<)") | F.col("text").rlike("^(    |\t)")
    return out.where((F.col("_fences") % 2 == 0) & ~front & ~other).select(*rows.columns, "heading")


def usable(subject: str) -> Column:
    """Whether a subject names something: not a pronoun, not a bare number, of 2 to 60 characters."""
    s = F.lower(F.trim(subject))
    return ~s.isin(*PRONOUNS) & ~F.split(s, " ")[0].isin(*PRONOUNS) & ~s.rlike("^[0-9.,]+$") & F.length(s).between(2, 60)


def clean(subject: str) -> Column:
    """A subject without article, as one lower-case name."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(subject)), "^(the|a|an) ", ""), r"\s+", "_")


def facts(rows: DataFrame) -> DataFrame:
    """Proposals of the three patterns (doc_id, line, family, subject, object, unit, self_confidence), of lines that hold no disqualifying word, nor does their heading. A line gives the first pattern that fits."""
    words = "|".join(DISQUALIFYING)
    fine = ~F.lower("text").rlike(words) & ~F.coalesce(F.lower("heading").rlike(words), F.lit(False))
    get = lambda pattern, i: F.regexp_extract("text", pattern, i)
    t = F.col("text")
    family = F.when(t.rlike(KV_LINE), "key_value").when(t.rlike(MEASURED), "measured").when(t.rlike(DEFINED) & get(DEFINED, 1).rlike(TERM), "defined")
    pick = lambda i: F.when(F.col("family") == "key_value", get(KV_LINE, i)).when(F.col("family") == "measured", get(MEASURED, i)).otherwise(get(DEFINED, min(i, 2)))
    sure = F.when(F.col("family") == "key_value", 0.7).when(F.col("family") == "measured", 0.6).otherwise(0.35)
    out = rows.where(fine).withColumn("family", family).where("family IS NOT NULL")
    out = out.select("doc_id", "line", "family", pick(1).alias("subject"), pick(2).alias("object"), F.when(F.col("family") == "defined", "").otherwise(pick(3)).alias("unit"), sure.alias("self_confidence"))
    return out.where(usable("subject")).withColumn("subject", clean("subject"))


def new_proposals(found: DataFrame, known: DataFrame, identity: Sequence[str]) -> DataFrame:
    """found, each identity once, its first line, less those that known has; with n, how often it came."""
    rest = [c for c in found.columns if c not in identity]
    first = found.groupBy(*identity).agg(F.min_by(F.struct(*rest), F.struct("doc_id", "line", *[c for c in rest if c not in ("doc_id", "line")])).alias("x"), F.count(F.lit(1)).alias("n")).select(*identity, "x.*", "n")
    return first.join(known.select(*identity).distinct(), list(identity), "left_anti")


def reviewed(proposals: DataFrame, reviews: DataFrame) -> DataFrame:
    """proposals with the status that the first valid review (id, verdict, reviewer, note, at) gives: a rejection needs a note; both need a reviewer. Later reviews change nothing."""
    fine = F.col("verdict").isin("accepted", "rejected") & (F.trim(F.coalesce("reviewer", F.lit(""))) != "") & ((F.col("verdict") == "accepted") | (F.trim(F.coalesce("note", F.lit(""))) != ""))
    first = reviews.where(fine).groupBy("id").agg(F.min_by(F.struct("verdict", "reviewer"), F.struct("at", "verdict", "reviewer")).alias("v"))
    return proposals.join(first, "id", "left").withColumn("status", F.coalesce("v.verdict", F.lit("pending"))).withColumn("reviewed_by", F.col("v.reviewer")).drop("v")


#: Words that make a line a rule, and how strong.
STRENGTH = (("must", 3), ("never", 3), ("always", 3), ("shall", 3), ("should", 2), ("required", 2), ("avoid", 1), ("prefer", 1))


def doctrine(rows: DataFrame, enforced: DataFrame) -> DataFrame:
    """Lines that lay down a rule, each text once: strength, repeats, its first place, and whether none of its names is among enforced (token). Unenforced and strong ones first."""
    words = _tokens("text")
    strength = F.coalesce(*(F.when(F.array_contains("_w", w), F.lit(n)) for w, n in STRENGTH))
    said = rows.withColumn("_w", words).withColumn("strength", strength).where("strength IS NOT NULL AND NOT array_contains(_w, 'retracted')")
    one = said.groupBy(F.array_join("_w", " ").alias("rule")).agg(F.max("strength").alias("strength"), F.count(F.lit(1)).alias("repeats"), F.min(F.struct("doc_id", "line")).alias("at"))
    hit = one.select("rule", F.explode(F.array_distinct(F.split("rule", " "))).alias("token")).join(enforced.select("token").distinct(), "token", "left_semi").select("rule").distinct().withColumn("enforced", F.lit(True))
    out = one.join(hit, "rule", "left").select("rule", "strength", "repeats", F.col("at.doc_id").alias("doc_id"), F.col("at.line").alias("line"), F.coalesce("enforced", F.lit(False)).alias("enforced"))
    return out.orderBy("enforced", F.desc("strength"), F.desc("repeats"), "doc_id", "line")


def merged_rules(candidates: DataFrame) -> DataFrame:
    """One rule a subject and predicate, a binding one before others and then the first locator, with also_at, the other locators. A locator names a line, or its rule goes."""
    fine = candidates.where(F.col("locator").rlike(r"^.+:[0-9]+$"))
    best = fine.groupBy("subject", "predicate").agg(F.min_by(F.struct("object", "binding", "locator"), F.struct(~F.col("binding"), "locator", "object")).alias("x"), F.array_sort(F.collect_set("locator")).alias("_all"))
    return best.select("subject", "predicate", "x.*", F.array_join(F.array_remove("_all", F.col("x.locator")), ",").alias("also_at"))


def conflicts(candidates: DataFrame) -> DataFrame:
    """subject and predicate that a batch gives several values: refused as a whole rather than the first taken."""
    return candidates.groupBy("subject", "predicate").agg(F.countDistinct("object").alias("values")).where("values > 1")


def ingestable(candidates: DataFrame) -> DataFrame:
    """Fact candidates with a verdict: refused without the commit's time or a line, or where the batch disagrees with itself; equal ones after the first are duplicates."""
    key = ["subject", "predicate"]
    out = candidates.join(conflicts(candidates).select(*key, F.lit(True).alias("_conflict")), key, "left")
    first = Window.partitionBy(*key, "object").orderBy("locator")
    verdict = F.when(F.col("committed_at").isNull(), "no_commit_time").when(~F.col("locator").rlike(r":[0-9]+$"), "no_line").when(F.col("_conflict"), "conflicting_value").when(F.row_number().over(first) > 1, "duplicate").otherwise("accepted")
    return out.withColumn("verdict", verdict).drop("_conflict")


PINNED = r"^\s*(?:pub\s+)?(?:const|static)\s+([A-Za-z_][A-Za-z0-9_]*)\s*:\s*[A-Za-z0-9_]+\s*=\s*(0x[0-9a-fA-F_]+|[0-9][0-9_]*)\s*;"
ASSERTED = r"^\s*(?:static_assert\s*\(|assert\s+)\s*([A-Za-z_][A-Za-z0-9_.]*)\s*(==|%)\s*([0-9]+)"


def pinned(rows: DataFrame) -> DataFrame:
    """Constants that source lines pin: doc_id, line, name, relation (= or divisible_by) and value. Underscores in numbers and hexadecimal are read."""
    t, g = F.col("text"), lambda p, i: F.regexp_extract("text", p, i)
    literal = F.replace(g(PINNED, 2), F.lit("_"), F.lit(""))
    value = F.when(literal.startswith("0x"), F.conv(F.substring(literal, 3, 16), 16, 10)).otherwise(literal)
    const = rows.where(t.rlike(PINNED)).select("doc_id", "line", g(PINNED, 1).alias("name"), F.lit("=").alias("relation"), value.cast("long").alias("value"))
    held = rows.where(t.rlike(ASSERTED)).select("doc_id", "line", g(ASSERTED, 1).alias("name"), F.when(g(ASSERTED, 2) == "==", "=").otherwise("divisible_by").alias("relation"), g(ASSERTED, 3).cast("long").alias("value"))
    return const.union(held)


def graded(answers: DataFrame) -> DataFrame:
    """Verdicts on answers (id, answer, expect, forbid: arrays of texts, abstain): wrong where a forbidden text is held, right where an expected one is, numbers being equal without separators."""
    normal = lambda c: F.concat(F.lit(" "), F.array_join(F.filter(F.split(F.regexp_replace(F.lower(c), "(?<=[0-9]),(?=[0-9])", ""), "[^a-z0-9.]+"), lambda w: w != ""), " "), F.lit(" "))
    held = lambda names: F.exists(names, lambda x: F.contains(F.col("_n"), normal(x)))
    silent = F.trim("_n") == ""
    verdict = F.when(F.coalesce(F.col("abstain"), F.lit(False)), F.when(silent, "right").otherwise("wrong")).when(silent, "abstained").when(held("forbid"), "wrong").when(held("expect"), "right").otherwise("missed")
    return answers.withColumn("_n", normal("answer")).withColumn("verdict", verdict).drop("_n")


def agreement(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Per question and item sets: true and false positives, false negatives, precision, recall and F1; empty sets agree."""
    key = ["question", "item"]
    both = expected.distinct().withColumn("_e", F.lit(1)).join(found.distinct().withColumn("_f", F.lit(1)), key, "full")
    out = both.groupBy("question").agg(F.count_if(F.col("_e").isNotNull() & F.col("_f").isNotNull()).alias("tp"), F.count_if(F.col("_e").isNull()).alias("fp"), F.count_if(F.col("_f").isNull()).alias("fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp = F.col("tp")
    return out.withColumns({"precision": ratio(tp, tp + F.col("fp")), "recall": ratio(tp, tp + F.col("fn")), "f1": ratio(2 * tp, 2 * tp + F.col("fp") + F.col("fn"))})


def scores(judged: DataFrame, stratum: str) -> DataFrame:
    """Of each stratum and of all (stratum null, overall true): questions, macro precision, recall and F1 (the means of the questions'), and micro ones (of the summed counts). One pass with grouping sets."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    out = judged.groupingSets([[stratum], []], stratum).agg(
        (F.grouping(stratum) == 1).alias("overall"), F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")),
        ratio(tp, tp + fp).alias("micro_precision"), ratio(tp, tp + fn).alias("micro_recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("micro_f1"),
    )
    return out
