"""Why is this code as it is: what was said of a file or a symbol, and what is held true of it, as one row of citations.

Needles (a symbol's names, its path, its file's name) are few and go into the scans as patterns. The turns cited are the
best limit by the surest needle, then the newest; only those are cut to excerpts. Nothing is concluded and nothing is
written: note says what the answer lacks.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reads import live

#: Characters of an excerpt, of which those before the match; symbols that a note names; candidates that are told apart.
EXCERPT, LEAD, NAMED, CANDIDATES = 240, 72, 6, 200
_WORD = "[A-Za-z0-9_]"


def pattern(needles: Sequence[str]) -> str:
    """A pattern for any of the needles, in either case, each whole where it begins or ends as a word does."""
    edge = lambda c, p: p if re.fullmatch(_WORD, c) else ""
    return "(?i)(?:" + "|".join(edge(n[0], f"(?<!{_WORD})") + re.escape(n) + edge(n[-1], f"(?!{_WORD})") for n in needles) + ")"


def _any(c: Column, needles: Sequence[str]) -> Column:
    return F.coalesce(c.rlike(pattern(needles)), F.lit(False)) if needles else F.lit(False)


def excerpt(text: Column, needles: Sequence[str]) -> Column:
    """The text around the first match, spaces as one: LEAD characters before it, EXCERPT in all, cut between words where that keeps the match, with … where something is left out. A text that matches no more starts at its head."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    n = F.length(flat)
    at, hit = F.regexp_instr(flat, F.lit(pattern(needles))) - 1, F.length(F.regexp_substr(flat, F.lit(pattern(needles))))
    at, hit = F.greatest(at, F.lit(0)), F.coalesce(hit, F.lit(0))
    start = F.greatest(at - LEAD, F.lit(0))
    end = F.greatest(F.least(n, start + EXCERPT), F.least(n, at + hit))
    gap = F.locate(" ", F.substr(flat, start + 1))  # from start on, 1: at start
    begin = F.when((start > 0) & (gap > 0) & (start + gap - 1 < at), start + gap).otherwise(start)
    last = end + 1 - F.locate(" ", F.reverse(F.substr(flat, F.lit(1), end + 1)))  # the last space up to end
    stop = F.when((end < n) & (last <= end) & (last > at + hit), last).otherwise(end)
    return F.concat(F.when(begin > 0, "…").otherwise(""), F.trim(F.substr(flat, begin + 1, stop - begin)), F.when(stop < n, "…").otherwise(""))


def cited(turns: DataFrame, symbol: Sequence[str], path: Sequence[str], base: Sequence[str], limit: int) -> DataFrame:
    """Turns (id, session, seq, occurred_at, text) that name code, with why, by which needle, and an excerpt: symbols first, then paths, then names of files, the newest first."""
    text = F.col("text")
    rank = F.when(_any(text, symbol), 0).when(_any(text, path), 1).when(_any(text, base), 2)
    top = turns.withColumn("_rank", rank).where("_rank IS NOT NULL").orderBy("_rank", F.desc("occurred_at"), F.desc("id")).limit(limit)
    why = F.element_at(F.array(*map(F.lit, ("symbol", "path", "basename"))), F.col("_rank") + 1)
    return top.select("_rank", "id", "session", "seq", "occurred_at", why.alias("why"), excerpt(text, [*symbol, *path, *base]).alias("excerpt"))


def facts(ledger: DataFrame, scopes: Sequence[str], needles: Sequence[str], limit: int) -> DataFrame:
    """Live rows of the scopes whose subject or source names one of the needles, of the deepest scope first, then the newest."""
    named = _any(F.col("subject"), needles) | (_any(F.col("source"), needles) if "source" in ledger.columns else F.lit(False))
    rows = live(ledger).where(F.col("scope").isin(list(scopes))).where(named).withColumn("depth", F.size(F.split("scope", "/")))
    return rows.orderBy(F.desc("depth"), F.desc("asserted_at"), F.desc("id")).limit(limit).select("id", "confidence", "subject", "predicate", "depth", "asserted_at")


def candidates(symbols: DataFrame, indexes: DataFrame, symbol: str, scopes: Sequence[str], repo: str | None) -> DataFrame:
    """Symbols of that qualified name, or else of that name, in the newest completed index of each repository that the scopes see: those of a scope, or below the first."""
    seen = indexes.where("completed")
    seen = seen.where(F.col("repo") == repo) if repo else seen.where(F.col("scope").isin(list(scopes)) | F.startswith("scope", F.lit(scopes[0] + "/")))
    newest = seen.groupBy("repo").agg(F.max_by("index_id", F.struct("indexed_at", "index_id")).alias("index_id"))
    found = symbols.where((F.col("fqn") == symbol) | (F.col("name") == symbol)).join(newest, "index_id")
    return found.select("repo", "name", "fqn", "path", "line_start", F.coalesce(F.col("fqn") == symbol, F.lit(False)).alias("exact"))


def _base(path: str) -> list[str]:
    """The file's own name, where the path is more than that."""
    name = path.rsplit("/", 1)[-1]
    return [name] if name and name != path else []


def _answer(target: str, resolved: Column, mentions: DataFrame, held: DataFrame, said: list[str], base: list[str], silent: str) -> DataFrame:
    """One row of the parts; the limit bounds both lists."""
    turn = F.struct("_rank", (-F.unix_micros(F.col("occurred_at").cast("timestamp"))).alias("_t"), (-F.col("id")).alias("_i"), "id", "session", "seq", "occurred_at", "why", "excerpt")
    m = mentions.agg(F.array_sort(F.collect_list(turn)).alias("mentions"))
    fact = F.struct((-F.col("depth")).alias("_d"), (-F.col("asserted_at")).alias("_t"), (-F.col("id")).alias("_i"), "id", "confidence", "subject", "predicate")
    f = held.agg(F.array_sort(F.collect_list(fact)).alias("facts"))
    weak, n = F.size(F.filter("mentions", lambda x: x["why"] == "basename")), F.size("mentions")
    weakly = F.concat(weak.cast("string"), F.lit(" of "), n.cast("string"), F.lit(f" mentions have only the file's name {base[0]}, which other files may have too: read them before you rely on them.")) if base else F.lit(None).cast("string")
    last = F.when(n == 0, F.lit(silent)).when(weak > 0, weakly)
    out = m.crossJoin(F.broadcast(f))  # one row each
    fields = lambda c, names: F.transform(c, lambda x: F.struct(*(x[k].alias(k) for k in names)))
    return out.select(F.lit(target).alias("target"), resolved.alias("resolved"), fields("mentions", ("id", "session", "seq", "occurred_at", "why", "excerpt")).alias("mentions"), fields("facts", ("id", "confidence", "subject", "predicate")).alias("facts"), F.nullif(F.concat_ws(" ", *map(F.lit, said), last), F.lit("")).alias("note"))


def _resolved(kind: str | None = None, path: str | None = None, fqn: str | None = None, line: int | None = None) -> Column:
    whole = F.struct(F.lit(kind).alias("kind"), F.lit(path).alias("path"), F.lit(fqn).cast("string").alias("fqn"), F.lit(line).cast("long").alias("line_start"))
    return whole if kind else F.lit(None).cast("struct<kind:string,path:string,fqn:string,line_start:bigint>")


def _silence(scope: str, names: Sequence[str]) -> str:
    return f"No transcript that was taken in for {scope} mentions {' or '.join(names)}: a reason may exist, but it was not written down there."


def _checked(limit: int) -> int:
    if not 1 <= limit <= 200:
        raise ValueError("limit is from 1 to 200")
    return limit


def why_path(turns: DataFrame, ledger: DataFrame, path: str, scopes: Sequence[str], limit: int = 20) -> DataFrame:
    """target, resolved, mentions, facts and note on a file. scopes: the chain, the asking scope first. The path is its own resolution: it can be asked for after the file is gone."""
    limit, path = _checked(limit), re.sub(r"^\.?/+|/+$", "", path.strip())
    if not path:
        raise ValueError("path is empty")
    base = _base(path)
    return _answer(path, _resolved("path", path), cited(turns, [], [path], base, limit), facts(ledger, scopes, [path, *base], limit), [], base, _silence(scopes[0], [path, *base]))


def why_symbol(turns: DataFrame, ledger: DataFrame, symbols: DataFrame, indexes: DataFrame, symbol: str, scopes: Sequence[str], repo: str | None = None, limit: int = 20) -> DataFrame:
    """The same on a symbol. One that names several is left unresolved, with the places it may be; then, and where no index knows it, mentions match its name as text.

    symbols: index_id, name, fqn, path, line_start. indexes: index_id, repo, commit_sha, scope, indexed_at, completed.
    """
    limit, symbol = _checked(limit), symbol.strip()
    if not symbol:
        raise ValueError("symbol is empty")
    rows = candidates(symbols, indexes, symbol, scopes, repo)
    found = rows.orderBy(F.desc("exact"), "path", "line_start", "repo").limit(CANDIDATES + 1).collect()  # CANDIDATES + 1 at most
    found = [r for r in found if r["exact"]] or found
    one, said = found[0] if len(found) == 1 else None, []
    if len(found) > 1:
        n = str(len(found)) if len(found) <= CANDIDATES else f"over {CANDIDATES}"
        places = ", ".join(f"{r['path']}:{r['line_start']}" for r in found[:NAMED]) + (", …" if len(found) > NAMED else "")
        said.append(f"{symbol} is the name of {n} symbols ({places}) and is left unresolved: name the repository, the qualified name or the file.")
    elif not one:
        said.append(f"No completed index of {repo or scopes[0]} has {symbol}; mentions match the name as text only.")
    names = list(dict.fromkeys(n for n in (symbol, one and one["name"], one and one["fqn"]) if n))
    path = [one["path"]] if one and one["path"] else []
    base = _base(path[0]) if path else []
    resolved = _resolved("symbol", one["path"], one["fqn"], one["line_start"]) if one else _resolved()
    return _answer(symbol, resolved, cited(turns, names, path, base, limit), facts(ledger, scopes, [*names, *path, *base], limit), said, base, _silence(scopes[0], [symbol]))
