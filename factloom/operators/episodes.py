"""Recorded conversations: statistics, resumption, weighted recall, tiered search, provenance labels."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import similar


def stats(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("session").alias("sessions"), F.count_if(F.col("role") == "human").alias("human"), F.count_if(F.col("role") == "agent").alias("agent"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"))


def sessions(rows: DataFrame) -> DataFrame:
    return rows.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") == "human").alias("human"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"))


def around(rows: DataFrame, session: int, seq: int, k: int) -> DataFrame:
    """The k turns of a session nearest to seq, earlier ones first among equals."""
    own = rows.where(F.col("session") == session)
    return own.orderBy(F.abs(F.col("seq") - seq), "seq").limit(k)


def open_questions(rows: DataFrame) -> DataFrame:
    """Human turns that end in a question mark and that no human turn of the session follows."""
    human = rows.where("role = 'human'")
    last = human.groupBy("session").agg(F.max_by(F.struct("id", "seq", "text"), "seq").alias("x")).select("session", "x.*")
    return last.where(F.endswith(F.rtrim("text"), F.lit("?")))


def open_turns(rows: DataFrame) -> DataFrame:
    """Sessions whose last turn is human: nobody answered."""
    last = rows.groupBy("session").agg(F.max_by(F.struct("id", "role", "seq"), "seq").alias("x")).select("session", "x.*")
    return last.where("role = 'human'").drop("role")


def tokens(text: str | Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\s.,:;!?()]+"), lambda t: t != "")


def term_weights(rows: DataFrame, terms: Sequence[str]) -> DataFrame:
    """term, df and idf = ln(n / df) + 1 of the terms that occur."""
    n = rows.count()
    found = rows.select("id", F.explode(F.array_distinct(tokens("text"))).alias("term")).where(F.col("term").isin(list(terms)))
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.round(F.ln(F.lit(float(n)) / F.col("df")) + 1, 3))


def recall(rows: DataFrame, terms: Sequence[str], since=None, until=None) -> DataFrame:
    """Turns with a term: sum of the idf of the terms found, over 1 + ln(1 + length / 240). The terms are few and broadcast."""
    weights = term_weights(rows, terms)
    if since is not None:
        rows = rows.where((F.col("occurred_at") >= since) & (F.col("occurred_at") < until))
    hits = rows.select("id", "session", "seq", F.length("text").alias("_n"), F.explode(F.array_distinct(tokens("text"))).alias("term")).join(F.broadcast(weights), "term")
    out = hits.groupBy("id", "session", "seq", "_n").agg(F.count(F.lit(1)).alias("matched"), F.sum("idf").alias("_s"))
    return out.select("id", "session", "seq", "matched", F.round(F.col("_s") / (1 + F.ln(1 + F.col("_n") / 240)), 4).alias("score"))


def tiered(rows: DataFrame, phrase: str) -> DataFrame:
    """id and tier: 1 if the text holds the phrase in either case, 2 if it has all the phrase's words, each row in its best tier."""
    words = [w for w in phrase.lower().split() if w]
    t = F.when(F.contains(F.lower("text"), F.lit(phrase.lower())), 1)
    t = t.when(F.size(F.array_except(F.array(*map(F.lit, words)), tokens("text"))) == 0, 2)
    return rows.select("id", "session", "seq", t.alias("tier")).where("tier IS NOT NULL")


def machine_lines(rows: DataFrame) -> DataFrame:
    """Of long texts the share of lines shaped as a machine writes them: tables and their rules, boxes, arrows, bold bullets, fences, headings."""
    lines = F.filter(F.transform(F.split("text", "\n"), F.trim), lambda x: x != "")
    # fixed values: the shapes of lines
    shaped = lambda x: x.rlike(r"^\|.*\|$") | x.rlike(r"^[+|][-+|\s]{6,}$") | x.rlike("^[┌├└│]") | (x.rlike("->|→|=>") & (F.length(x) < 200)) | x.rlike(r"^(?:[-*]|[0-9]+\.)\s+\*\*") | x.startswith("```") | x.rlike(r"^#{1,4}\s")
    return rows.where(F.length("text") >= 900).select("id", F.size(lines).cast("long").alias("n_lines"), F.size(F.filter(lines, shaped)).cast("long").alias("n_machine"))


def quoted(rows: DataFrame, n: int = 10, least: int = 4) -> DataFrame:
    """Human turns and the share of their n-word shingles that an earlier agent turn of the session holds, of turns with enough shingles.

    Each shingle's first agent turn is an aggregate; the human turns' shingles join it on session and shingle.
    """
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    # a column of its own: inside the lambda, the words would be cut anew for every shingle
    each = rows.where(F.col("role").isin("agent", "human")).select("id", "session", "seq", "role", words.alias("w")).where(F.size("w") >= n)
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.xxhash64(F.array_join(F.slice("w", i, n), " ")))
    each = each.select("id", "session", "seq", "role", F.explode(F.array_distinct(grams)).alias("g"))
    first = each.where("role = 'agent'").groupBy("session", "g").agg(F.min("seq").alias("first"))
    mine = each.where("role = 'human'").join(first, ["session", "g"], "left")
    out = mine.groupBy("id").agg(F.count(F.lit(1)).alias("shingles"), F.count_if(F.col("first") < F.col("seq")).alias("quoted"))
    return out.where(F.col("shingles") >= least)


def newest_within(rows: DataFrame, budget: int) -> DataFrame:
    """id and upto of the newest turns whose lengths sum to at most budget.

    Days are summed first, so only the days' totals, few, go through one window.
    """
    day = rows.withColumn("_day", F.to_date("occurred_at")).withColumn("_n", F.length("text"))
    later = Window.orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)
    starts = day.groupBy("_day").agg(F.sum("_n").alias("_d")).withColumn("_before", F.coalesce(F.sum("_d").over(later), F.lit(0))).select("_day", "_before")
    within = Window.partitionBy("_day").orderBy(F.desc("occurred_at"), F.desc("id"))
    out = day.withColumn("_w", F.sum("_n").over(within)).join(F.broadcast(starts), "_day")
    return out.select("id", (F.col("_before") + F.col("_w")).alias("upto")).where(F.col("upto") <= budget)


#: What a respelling of a term is worth beside the term itself.
DISCOUNT = {"exact": 1.0, "abbrev": 0.9, "numeric": 0.9, "stem": 0.7, "split": 0.5}
#: Words of a question that carry no topic, and names of months.
STOP = frozenset((
    "the", "a", "an", "and", "or", "but", "of", "to", "in", "on", "at", "for", "with", "by", "from", "as", "is", "are", "was", "were", "be", "been", "being", "it", "its", "this",
    "that", "these", "those", "he", "she", "they", "his", "her", "their", "what", "which", "who", "whom", "whose", "when", "where", "why", "how", "did", "does", "do", "done",
    "can", "could", "should", "would", "will", "shall", "may", "might", "must", "have", "has", "had", "not", "no", "yes", "only", "same", "other", "another", "two", "three",
    "there", "then", "than", "them", "you", "your", "i", "me", "my", "we", "us", "our", "give", "gave", "name", "named", "call", "called", "about", "into", "out", "up", "down",
    "just", "also", "both", "each", "any", "all", "some", "one", "if", "so", "such",
))
MONTHS = frozenset("jan january feb february mar march apr april may jun june jul july aug august sep sept september oct october nov november dec december".split())
#: Probes of a question at most, and turns of a window shown at most.
MOST_PROBES, WINDOW_CAP = 24, 60


def content_terms(question: str) -> list[str]:
    """The words of a question that may find something, each once: no stop words, months, days of a month or single letters."""
    words = re.findall(r"[a-z0-9_$/](?:[a-z0-9_.$/+-]*[a-z0-9_$/])?", question.lower())
    return list(dict.fromkeys(w for w in words if len(w) > 1 and w not in STOP | MONTHS and not re.fullmatch(r"\d{1,2}(?:st|nd|rd|th)?", w)))


#: Endings that are cut off, the longest that fits; a stem keeps three letters, and a vowel.
ENDINGS = ("izations", "ization", "ations", "ation", "ements", "ement", "ingly", "ments", "ment", "ings", "ing", "ies", "ied", "ed", "es", "s")


def stem_of(word: str) -> str:
    """A word of letters less an ending, or what a verb and a particle written as one begin with; a doubled consonant at its end once."""
    end = next((e for e in ENDINGS if word.endswith(e) and len(word) - len(e) >= 3 and re.search("[aeiouy]", word[: -len(e)])), "")
    stem = word if word.endswith(("ss", "us")) else word[: len(word) - len(end)]
    particle = next((p for p in ("out", "off", "in", "up") if stem.endswith(p) and len(stem) - len(p) >= 3 and stem[-len(p) - 1] not in "aeiou"), "")
    stem = stem[: len(stem) - len(particle)]
    return stem[:-1] if stem != word and len(stem) > 3 and stem[-1] == stem[-2] and stem[-1] not in "lsz" else stem


def variants(term: str) -> list[tuple[str, str]]:
    """(form, kind) of a term: itself, its stem, short and joined forms of a word with a number, other ways to write a number, the parts of a compound."""
    out = [(term, "exact")]
    if re.fullmatch("[a-z]{4,}", term):
        out.append((stem_of(term), "stem"))
    coded = re.fullmatch(r"([a-z]+)[-_=. ]?(\d+(?:\.\d+)?)", term)
    if coded:
        word, n = coded.groups()
        out += [(word + n, "abbrev"), (f"{word}-{n}", "abbrev")] + [(word[0] + n, "abbrev")] * (len(word) >= 4)
    number = re.fullmatch(r"(\d{1,3}(?:,\d{3})+|\d+)(\.\d+)?", term)
    if number:
        whole, part = number[1].replace(",", ""), number[2] or ""
        tails = dict.fromkeys((part, part + "0" if part else "", part.rstrip("0").rstrip(".")))
        out += [(head + tail, "numeric") for tail in tails for head in (whole, f"{int(whole):,}")]
    elif re.search("[-_/.=+]", term):
        out += [(p, "split") for p in re.split("[-_/.=+]+", term) if len(p) >= 3 and not p.isdigit()]
    best: dict[str, str] = {}
    for form, kind in out:
        best.setdefault(form, kind)
    return list(best.items())[:8]


def probes_of(terms: Sequence[str]) -> list[tuple[str, str, str]]:
    """(term, probe, via) of all spellings of terms, MOST_PROBES at most."""
    return [(t, form, kind) for t in terms for form, kind in variants(t)][:MOST_PROBES]


def holds(text: str, probe: Column) -> Column:
    return F.contains(F.lower(text), probe)


def weighed(rows: DataFrame, terms: Sequence[str]) -> DataFrame:
    """term, probe, via, df and idf of the spellings of terms that occur: (ln(n / df) + 1) times the spelling's discount.

    The probes, MOST_PROBES at most, are counted in one pass over the turns, each in its own column.
    """
    probes = probes_of(terms)
    if not probes:
        return rows.sparkSession.createDataFrame([], "term string, probe string, via string, df long, idf double")
    counts = rows.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(holds("text", F.lit(p))).alias(f"p{i}") for i, (_, p, _) in enumerate(probes)))
    each = F.array(*(F.struct(F.lit(t).alias("term"), F.lit(p).alias("probe"), F.lit(k).alias("via"), F.lit(DISCOUNT[k]).alias("_w"), F.col(f"p{i}").alias("df")) for i, (t, p, k) in enumerate(probes)))
    out = counts.select("n", F.explode(each).alias("x")).select("n", "x.*").where("df > 0")
    return out.select("term", "probe", "via", "df", F.round((F.ln(F.col("n") / F.col("df")) + 1) * F.col("_w"), 3).alias("idf"))


def scored(rows: DataFrame, plan: Sequence[tuple[str, float]], rare: float) -> DataFrame:
    """rows with matched (the probes found, in order), score and strong: two probes, or one that is rare. plan: (probe, idf), few."""
    found = F.array_compact(F.array(*(F.when(holds("text", F.lit(p)), F.struct(F.lit(p).alias("p"), F.lit(float(w)).alias("w"))) for p, w in plan))) if plan else F.array().cast("array<struct<p:string,w:double>>")
    total = F.aggregate("_found", F.lit(0.0), lambda a, x: a + x["w"])
    out = rows.withColumn("_found", found).withColumn("score", F.round(total / (1 + F.ln(1 + F.length("text") / 240)), 4))
    strong = (F.size("_found") >= 2) | F.exists("_found", lambda x: x["w"] >= rare)
    return out.withColumn("strong", strong).withColumn("matched", F.array_join(F.transform("_found", lambda x: x["p"]), ",")).drop("_found")


def recalled(rows: DataFrame, question: str, window: tuple | None = None, limit: int = 12) -> DataFrame:
    """The turns that answer a question best: id, session, seq, occurred_at, matched, score and tier.

    In the window (since, until: end exclusive), or everywhere if it holds no turn. Turns with a match come first, then
    by score, then the earlier one. If no turn of a window tells anything apart, the window itself is the answer: up to
    WINDOW_CAP of its turns in order of time.
    """
    limit = min(max(limit, 1), 100)
    plan = [(r["probe"], r["idf"]) for r in weighed(rows, content_terms(question)).orderBy(F.desc("idf"), "probe").collect()]  # MOST_PROBES at most
    n = rows.count()
    rare = math.log(max(n, 4) / 4) + 1
    inside = rows
    if window:
        within = (F.col("occurred_at") >= window[0]) & (F.col("occurred_at") < window[1])
        inside = rows.where(within)
        if inside.isEmpty():
            inside, window = rows, None
    hits = scored(inside, plan, rare)
    if window is None:
        hits = hits.where("matched <> ''")
    tier = F.when(F.col("strong"), "term+window" if window else "term").otherwise("window")
    keep = ["id", "session", "seq", "occurred_at", "matched", "score", tier.alias("tier")]
    top = hits.orderBy(F.desc(F.col("matched") != ""), F.desc("score"), "occurred_at", "id").limit(limit).select(*keep)
    if window and hits.where("strong").isEmpty():
        return hits.orderBy("occurred_at", "id").limit(WINDOW_CAP).select(*keep)
    return top


def bounds(rows: DataFrame) -> DataFrame:
    return rows.agg(F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"), F.count(F.lit(1)).alias("n"))


def tail(rows: DataFrame, session: int, k: int) -> DataFrame:
    """The newest k turns of a session, in order."""
    return rows.where(F.col("session") == session).orderBy(F.desc("seq")).limit(k).orderBy("seq")


def branches(rows: DataFrame) -> DataFrame:
    """Branches by their number of turns, then by name."""
    return rows.where("branch IS NOT NULL").groupBy("branch").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "branch")


def searched(rows: DataFrame, phrase: str, limit: int) -> DataFrame:
    """Tiers of a search one after another, each turn in its first one: the phrase, all its words, and only if both find nothing the texts that come near the phrase by trigrams; limit in all, best tier, nearest and newest first."""
    best = tiered(rows, phrase).join(rows.select("id", "occurred_at"), "id").withColumn("similarity", F.lit(1.0))
    if best.isEmpty():
        best = similar.similar(rows.select("id", "session", "seq", "occurred_at", "text"), phrase).select("id", "session", "seq", F.lit(3).alias("tier"), "occurred_at", "similarity")
    return best.orderBy("tier", F.desc("similarity"), F.desc("occurred_at"), F.desc("id")).limit(limit)


def resumed(rows: DataFrame, now: Column, stale_hours: float = 24.0, k: int = 12, session: int | None = None) -> DataFrame:
    """Where a thread was left, in one row: the session asked for or else the last one, its start, end, turns, human turns and branches (most used first), the last k turns in order, its open question, its age in hours, and what speaks against going on with it.

    drift: the newest turn of all is on another branch than the session mostly was; stale: it is older than stale_hours;
    single, no_human: there is no thread, or only an agent's. No row if there is no turn.
    """
    mine = rows if session is None else rows.where(F.col("session") == session)
    last = sessions(mine).orderBy(F.desc("last_at"), F.desc("session")).limit(1)
    own = rows.join(F.broadcast(last.select("session")), "session")  # one row
    used = own.where("branch IS NOT NULL").groupBy("branch").agg(F.count(F.lit(1)).alias("_n"))
    branches_ = used.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), "branch"))), lambda b: b["branch"]).alias("branches"))
    short = F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 240)
    top = own.orderBy(F.desc("seq")).limit(k)
    thread = top.agg(F.array_sort(F.collect_list(F.struct("seq", "id", "role", "occurred_at", short.alias("text"), "branch"))).alias("thread"))
    asked = open_questions(own).agg(F.collect_list(F.struct("id", "seq", "text")).alias("open_questions"))
    newest = rows.agg(F.max_by("branch", F.struct("occurred_at", "seq")).alias("_newest"))
    out = last.crossJoin(F.broadcast(branches_)).crossJoin(F.broadcast(thread)).crossJoin(F.broadcast(asked)).crossJoin(F.broadcast(newest))  # one row each
    age = F.round((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_at").cast("timestamp"))) / 3_600_000_000, 2)
    main = F.try_element_at("branches", F.lit(1))
    return out.select("session", "first_at", "last_at", "n", "human", "branches", "thread", "open_questions", age.alias("age_hours"), F.coalesce(main != F.col("_newest"), F.lit(False)).alias("drift"), (age > stale_hours).alias("stale"), (F.col("n") == 1).alias("single"), (F.col("human") == 0).alias("no_human"))


def filtered(rows: DataFrame, role: str | None = None, actor: int | None = None, since=None, until=None, limit: int = 50) -> DataFrame:
    """A search by filters alone, newest first; until is inclusive here."""
    for test in (role is not None and F.col("role") == role, actor is not None and F.col("actor") == actor, since is not None and F.col("occurred_at") >= since, until is not None and F.col("occurred_at") <= until):
        if test is not False:
            rows = rows.where(test)
    return rows.orderBy(F.desc("occurred_at"), F.desc("id")).limit(min(max(limit, 1), 500))


def needle(text: str) -> str:
    """A pattern for text as a whole word, in either case."""
    return rf"(?i)(^|[^A-Za-z0-9_]){re.escape(text)}($|[^A-Za-z0-9_])"


def mentions(rows: DataFrame, symbol: Sequence[str], path: Sequence[str], basename: Sequence[str], limit: int) -> DataFrame:
    """Turns that name code, by the surest way each: symbol, path, basename; then newest first. Needles are few."""
    any_of = lambda names: F.lit(False) if not names else F.col("text").rlike("|".join(map(needle, names)))
    why = F.when(any_of(symbol), "symbol").when(any_of(path), "path").when(any_of(basename), "basename")
    rank = F.when(F.col("why") == "symbol", 0).when(F.col("why") == "path", 1).otherwise(2)
    return rows.withColumn("why", why).where("why IS NOT NULL").orderBy(rank, F.desc("occurred_at"), F.desc("id")).limit(min(max(limit, 1), 200))


def echoes(rows: DataFrame, turns: int = 40, run: int = 12, chars: int = 4000) -> DataFrame:
    """Human turns that repeat a run of words of one of the session's last agent turns, each read up to chars: an echo is not the human's own word.

    Runs are hashed and joined on session and run; an agent turn counts if fewer than turns others lie between.
    """
    words = F.filter(F.split(F.lower(F.col("_t")), r"\s+"), lambda w: w != "")
    agents = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    each = rows.withColumn("_a", F.count_if(F.col("role") == "agent").over(agents)).withColumn("_t", F.when(F.col("role") == "agent", F.substring("text", 1, chars)).otherwise(F.col("text")))
    each = each.where(F.col("role").isin("agent", "human")).select("id", "session", "role", "_a", words.alias("w")).where(F.size("w") >= run)
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - (run - 1)), lambda i: F.xxhash64(F.array_join(F.slice("w", i, run), " ")))
    each = each.select("id", "session", "role", "_a", F.explode(F.array_distinct(grams)).alias("g"))
    said = each.where("role = 'agent'").select("session", "g", F.col("_a").alias("_said"))
    mine = each.where("role = 'human'").join(said, ["session", "g"]).where((F.col("_said") <= F.col("_a")) & (F.col("_said") > F.col("_a") - turns))
    return mine.groupBy("id").agg(F.countDistinct("g").alias("runs"))


def transcript(lines: DataFrame) -> DataFrame:
    """Utterances from the lines (path, line, value) of JSONL transcripts: path, line, seq, session, uuid, parent, role, at, branch and text.

    Malformed lines are passed over. Every other record of a session counts for seq, so seq has holes where records say
    nothing: meta records, summaries, records for display only, tool results, and texts that are one tag or a short note
    in brackets.
    """
    block = "array<struct<type:string,text:string>>"
    schema = "type string, timestamp string, sessionId string, uuid string, parentUuid string, gitBranch string, isMeta boolean, isCompactSummary boolean, isVisibleInTranscriptOnly boolean, message struct<role:string,content:variant>"
    r = F.col("r")
    rows = lines.select("path", "line", F.from_json("value", schema).alias("r")).where(r.isNotNull() & r["sessionId"].isNotNull())
    rows = rows.withColumn("seq", F.row_number().over(Window.partitionBy("path", "r.sessionId").orderBy("line")) - 1)
    content = r["message"]["content"]
    blocks = F.filter(F.try_variant_get(content, "$", block), lambda b: b["type"] == "text")
    text = F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string")).otherwise(F.nullif(F.array_join(F.transform(blocks, lambda b: b["text"]), "\n"), F.lit("")))
    role = F.when(r["message"]["role"] == "user", "human").when(r["message"]["role"] == "assistant", "agent")
    out = rows.select("path", "line", "seq", r["sessionId"].alias("session"), r["uuid"].alias("uuid"), r["parentUuid"].alias("parent"), role.alias("role"), F.try_to_timestamp(r["timestamp"]).alias("at"), r["gitBranch"].alias("branch"), F.trim(text).alias("text"), r["isMeta"].alias("m"), r["isCompactSummary"].alias("c"), r["isVisibleInTranscriptOnly"].alias("v"))
    fine = F.col("role").isNotNull() & F.col("at").isNotNull() & (F.coalesce("text", F.lit("")) != "") & ~F.coalesce("m", F.lit(False)) & ~F.coalesce("c", F.lit(False)) & ~F.coalesce("v", F.lit(False))
    return out.where(fine & ~F.col("text").startswith("<") & ~F.col("text").rlike(r"^\[[^\]]{1,58}\]$")).drop("m", "c", "v")


def threaded(rows: DataFrame) -> DataFrame:
    """rows of transcript() with answers, the seq of the record that each one answers, within its file."""
    parents = rows.select("path", F.col("uuid").alias("parent"), F.col("seq").alias("answers"))
    return rows.join(parents, ["path", "parent"], "left")


def read_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """path, line and value of the lines of all *.jsonl files below folder. A file is one partition, as lines are numbered in it."""
    files = spark.read.option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").option("wholetext", "true").text(folder)
    lines = files.select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    return lines.where(F.trim("value") != "")
