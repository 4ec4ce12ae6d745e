"""The code graph: reverse closure with the weakest link's confidence, resolution of names, search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANK = {"measured": 0, "derived": 1, "unverified": 2}


def _rank(c: str):
    return F.when(F.col(c) == "measured", 0).when(F.col(c) == "derived", 1).otherwise(2)


def impact(edges: DataFrame, target: int, depth: int = 4, kinds: Sequence[str] | None = None) -> DataFrame:
    """id, depth, confidence and via of every symbol that reaches target in at most depth edges.

    The frontier moves one level a step and keeps, of each symbol, its least depth and then its best confidence; symbols
    reached before do not come back. A path is as trustworthy as its weakest edge. A cycle returns the target itself.
    """
    e = edges.where(F.col("kind").isin(list(kinds))) if kinds else edges
    e = e.select("src", "dst", "kind", _rank("confidence").alias("_r"))
    best = lambda df: df.groupBy("id").agg(F.min(F.struct("depth", "rank", "via")).alias("x")).select("id", "x.*")
    front = best(e.where(F.col("dst") == target).select(F.col("src").alias("id"), F.lit(1).alias("depth"), F.col("_r").alias("rank"), F.col("kind").alias("via")))
    reached = front.checkpoint()
    front = reached
    for d in range(2, depth + 1):
        step = e.join(front.select(F.col("id").alias("dst"), F.col("rank").alias("_u")), "dst")
        new = best(step.select(F.col("src").alias("id"), F.lit(d).alias("depth"), F.greatest("_r", "_u").alias("rank"), F.col("kind").alias("via")))
        front = new.join(reached.select("id"), "id", "left_anti").checkpoint()
        if front.isEmpty():
            break
        reached = reached.union(front)
    name = F.when(F.col("rank") == 0, "measured").when(F.col("rank") == 1, "derived").otherwise("unverified")
    return reached.select("id", "depth", name.alias("confidence"), "via")


def resolve(lookups: DataFrame, symbols: DataFrame, ceiling: int = 8) -> DataFrame:
    """lookup, resolution and dst of names: one symbol is unique, up to ceiling are ambiguous, more or none are unresolved."""
    found = symbols.groupBy(F.col("name").alias("lookup")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("dst"))
    out = lookups.join(found, "lookup", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    kind = F.when(F.col("n") == 1, "unique").when(F.col("n").between(2, ceiling), "ambiguous").otherwise("unresolved")
    return out.select("lookup", kind.alias("resolution"), F.when(F.col("n") == 1, F.col("dst")).alias("dst"), "n")


def find(symbols: DataFrame, text: str, limit: int) -> DataFrame:
    """Symbols whose name is or holds text, exact ones first, then shorter names."""
    exact = (F.lower("name") == text.lower()).alias("exact")
    return symbols.where(F.contains(F.lower("name"), F.lit(text.lower()))).select("id", "name", "fqn", "path", exact).orderBy(F.desc("exact"), F.length("name"), "name", "path", "id").limit(limit)


def histogram(edges: DataFrame) -> DataFrame:
    return edges.groupBy("kind", "confidence").agg(F.count(F.lit(1)).alias("n"))


def weakest(edges: DataFrame, target: int, depth: int) -> DataFrame:
    """Of impact's symbols those whose path has a link weaker than the edge that reaches them."""
    own = edges.groupBy(F.col("src").alias("id")).agg(F.min(_rank("confidence")).alias("_own"))
    found = impact(edges, target, depth).withColumn("_path", _rank("confidence"))
    return found.join(own, "id").where(F.col("_path") > F.col("_own")).select("id", "depth", "confidence")


def trait_methods(edges: DataFrame, symbols: DataFrame, target: int) -> DataFrame:
    """What overrides a trait's method: the innermost trait that encloses target, the types that implement it, and their methods of target's name.

    A method is a type's if its qualified name says so, or, for a type without one, if it lies in the type's lines. The
    two ways are an equality join each.
    """
    me = symbols.where((F.col("id") == target) & F.col("kind").isin("method", "function")).select(F.col("name").alias("_name"), F.col("path").alias("_path"), F.col("line_start").alias("_line"))
    traits = symbols.where("kind = 'trait'").join(F.broadcast(me), F.col("path") == F.col("_path")).where(F.col("_line").between(F.col("line_start"), F.col("line_end")))
    inner = traits.orderBy(F.col("line_end") - F.col("line_start"), "id").limit(1).select(F.col("id").alias("dst"), "_name")
    types = edges.where("kind = 'implements'").join(F.broadcast(inner), "dst").select(F.col("src").alias("_type"), "confidence", "_name")
    types = types.join(symbols.select(F.col("id").alias("_type"), F.col("fqn").alias("_fqn"), F.col("path").alias("path"), F.col("line_start").alias("_from"), F.col("line_end").alias("_to")), "_type")
    own = symbols.where(F.col("kind").isin("method", "function"))
    named = types.where("_fqn IS NOT NULL").select(F.concat_ws("::", "_fqn", "_name").alias("fqn"), F.col("_name").alias("name"), "confidence").join(own, ["fqn", "name"])
    inside = types.where("_fqn IS NULL").select("path", F.col("_name").alias("name"), "_from", "_to", "confidence").join(own, ["path", "name"]).where(F.col("line_start").between(F.col("_from"), F.col("_to")))
    both = named.select("id", "confidence").union(inside.select("id", "confidence"))
    best = both.groupBy("id").agg(F.min(_rank("confidence")).alias("rank"))
    return best.select("id", F.lit(1).alias("depth"), F.element_at(F.array(*map(F.lit, RANK)), F.col("rank") + 1).alias("confidence"), F.lit("implements").alias("via"))


def report(edges: DataFrame, symbols: DataFrame, target: int, depth: int = 4, kinds: Sequence[str] | None = None) -> DataFrame:
    """What reaches target, by calls or as an implementation of its trait, once, nearest and surest first: with the symbol, and whether it is certain and a test. Order: depth, confidence, name."""
    if not 1 <= depth <= 8:
        raise ValueError("depth is from 1 to 8")
    found = impact(edges, target, depth, kinds)
    if not kinds or "implements" in kinds:
        found = found.unionByName(trait_methods(edges, symbols, target))
    rank = _rank("confidence")
    best = found.groupBy("id").agg(F.min(F.struct("depth", rank.alias("rank"), "via")).alias("x")).select("id", "x.*")
    names = F.element_at(F.array(*map(F.lit, RANK)), F.col("rank") + 1)
    out = best.join(symbols.select("id", "name", "fqn", F.col("kind").alias("symbol_kind"), "path"), "id")
    return out.select("id", "depth", names.alias("confidence"), "via", "name", "fqn", "path", (F.col("rank") < 2).alias("certain"), (F.col("symbol_kind") == "test").alias("is_test"))


def presented(hops: DataFrame) -> DataFrame:
    return hops.orderBy("depth", _rank("confidence"), "name", "id")


def target_of(symbols: DataFrame, text: str, most: int = 25) -> int:
    """The id of the symbol that text names: id:n, else a qualified name, else a name; several are refused, with their ids, as is none."""
    if text.startswith("id:"):
        tiers = [F.col("id") == int(text[3:])]
    else:
        tiers = [F.col("fqn") == text, F.col("name") == text]
    for tier in tiers:
        found = [r["id"] for r in symbols.where(tier).select("id").orderBy("id").limit(most).collect()]  # most at most
        if len(found) == 1:
            return found[0]
        if found:
            raise ValueError(f"{text} is ambiguous: {found}")
    raise ValueError(f"no symbol {text}")


def only_repo(indexes: DataFrame, by: str) -> DataFrame:
    """For each value of by, the repository that all its completed indexes are of, null if there are several, and how many there are: a question that names none is answered only if it is clear."""
    n = F.countDistinct("repo")
    return indexes.where("completed").groupBy(by).agg(F.min("repo").alias("_repo"), n.alias("repos")).select(by, F.when(F.col("repos") == 1, F.col("_repo")).alias("repo"), "repos")


def index_of(indexes: DataFrame, repo: str, commit: str | None = None) -> DataFrame:
    """The completed index of a repository: that of a commit, whole before prefix, else the newest."""
    rows = indexes.where((F.col("repo") == repo) & F.col("completed"))
    if commit:
        rows = rows.where(F.col("commit_sha").startswith(commit))
    return rows.orderBy(F.desc(F.col("commit_sha") == F.lit(commit or "")), F.desc("indexed_at"), F.desc("index_id")).limit(1)


def fan_out(raw: DataFrame, keys: DataFrame) -> DataFrame:
    """Edges by keys (src, dst, candidates, kind, resolution) as edges by ids: an ambiguous one is a row a candidate; unknown keys leave nulls for unknown()."""
    each = raw.withColumn("dst", F.explode(F.when(F.col("resolution") == "ambiguous-name", F.col("candidates")).otherwise(F.array("dst"))))
    id_of = lambda side: keys.select(F.col("key").alias(side), F.col("id").alias(f"{side}_id"))
    out = each.join(id_of("src"), "src", "left").join(id_of("dst"), "dst", "left")
    return out.withColumn("confidence", confidence_of("resolution"))


def unknown(fanned: DataFrame) -> DataFrame:
    """The keys that no symbol has, and in how many edges."""
    bad = fanned.select(F.explode(F.array_compact(F.array(F.when(F.col("src_id").isNull(), F.col("src")), F.when(F.col("dst_id").isNull() & F.col("dst").isNotNull(), F.col("dst"))))).alias("key"))
    return bad.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def confidence_of(resolution: str):
    """What a way of resolution is worth: a compiler's word is measured, a unique name derived, anything else unverified."""
    return F.when(F.col(resolution).isin("compiler", "language-server"), "measured").when(F.col(resolution) == "unique-name", "derived").otherwise("unverified")


def unique_keys(symbols: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """symbols with unique_key: key, and from the second row of a key on a suffix ~n. Each key's rows are numbered in a window of their own."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return symbols.withColumn("_n", n).withColumn("unique_key", F.when(F.col("_n") == 1, F.col(key)).otherwise(F.concat_ws("~", key, "_n"))).drop("_n")


def without_shadowed(symbols: DataFrame) -> DataFrame:
    """symbols less declarations whose family, kind and qualified name a definition has."""
    key = ["family", "kind", "fqn"]
    defined = symbols.where("NOT is_declaration").select(*key).distinct()
    return symbols.where("NOT is_declaration").unionByName(symbols.where("is_declaration").join(defined, key, "left_anti").select(*symbols.columns))


def resolve_by_suffix(lookups: DataFrame, symbols: DataFrame, ceiling: int = 8) -> DataFrame:
    """lookup, at, resolution, dst, n of lookups (lookup, family, keys: names to try in order).

    A name is a symbol's if it equals its qualified name or a suffix of it from a separator on, within the family. The
    first name with a hit decides; whole names go before suffixes. One symbol is unique, up to ceiling are ambiguous.
    """
    parts = F.split("fqn", "::")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "::").alias("k"), (i > 1).alias("s")))
    names = symbols.select("id", "family", F.explode(suffixes).alias("x")).groupBy("family", F.col("x.k").alias("key"), F.col("x.s").alias("suffix")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("dst"))
    asked = lookups.select("lookup", "family", F.posexplode("keys").alias("at", "key"))
    best = asked.join(names, ["family", "key"]).groupBy("lookup").agg(F.min(F.struct("at", "suffix", "n", "dst")).alias("x"))
    out = lookups.select("lookup").join(best, "lookup", "left").withColumn("n", F.coalesce("x.n", F.lit(0)))
    kind = F.when(F.col("n") == 1, "unique-name").when(F.col("n").between(2, ceiling), "ambiguous-name").otherwise("unresolved")
    return out.select("lookup", F.col("x.at").alias("at"), kind.alias("resolution"), F.when(F.col("n") == 1, F.col("x.dst")).alias("dst"), "n")


def retagged(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """edges, calls of a type being instantiations."""
    types = symbols.where("kind = 'type'").select(F.col("id").alias("dst"), F.lit(True).alias("_type"))
    return edges.join(types, "dst", "left").withColumn("kind", F.when((F.col("kind") == "calls") & F.col("_type"), "instantiates").otherwise(F.col("kind"))).drop("_type")


def resolutions(edges: DataFrame) -> DataFrame:
    """Per kind, how many edges have each resolution."""
    return edges.groupBy("kind").agg(*(F.count_if(F.col("resolution") == r).alias(r.replace("-", "_")) for r in ("compiler", "language-server", "unique-name", "ambiguous-name", "unresolved")))


def prune_tallies(indexes: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Of doomed indexes: the symbols and edges that go with each."""
    n = lambda df, name: df.groupBy("index_id").agg(F.count(F.lit(1)).alias(name))
    out = indexes.where("doomed").select("index_id").join(n(symbols, "symbols"), "index_id", "left").join(n(edges, "edges"), "index_id", "left")
    return out.select("index_id", F.coalesce("symbols", F.lit(0)).alias("symbols"), F.coalesce("edges", F.lit(0)).alias("edges"))


def silent(declared: DataFrame, symbols: DataFrame) -> DataFrame:
    """Languages that an index declares and that no symbol of it has."""
    return declared.join(symbols.select("index_id", "language").distinct(), ["index_id", "language"], "left_anti")


def default_scope(repo: str):
    """A repository's scope: its name, lower-cased, runs of other characters as one hyphen."""
    return F.concat(F.lit("org/"), F.btrim(F.regexp_replace(F.lower(repo), "[^a-z0-9]+", "-"), F.lit("-")))
