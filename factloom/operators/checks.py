"""What each table refuses: named conditions in order of precedence, the first of which that applies is a row's reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .disputes import number

SCOPE = "^[A-Za-z0-9_.-]+(/[A-Za-z0-9_.-]+)*$"
#: The vocabularies of the data model.
OPERATORS = (">=", "<=", ">", "<", "=", "!=")
STATES = ("proposed", "active", "closed", "abandoned")
SYMBOL_KINDS = ("module", "type", "trait", "function", "method", "const", "macro", "field", "test", "kernel")
EDGE_KINDS = ("calls", "imports", "tests", "implements", "uses", "extends", "instantiates")
ROLES = ("human", "agent", "system")
TIERS = {"personal": 1, "team": 2, "org": 3}


def blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(c) == "")


def not_in(c: str, values: Sequence[str]) -> Column:
    return F.col(c).isNull() | ~F.col(c).isin(*values)


def unlike(c: str, pattern: str) -> Column:
    return F.col(c).isNull() | ~F.col(c).rlike(pattern)


def uncheckable(gate: Column) -> Column:
    """A gate (subject, predicate, op, target, requires_confidence) that no machine can check. Order needs a number; equality takes any value."""
    text = lambda c: gate[c].isNull() | (F.trim(gate[c]) == "")
    ordered = gate["op"].isin(">=", "<=", ">", "<") & number(gate["target"]).isNull()
    return text("subject") | text("predicate") | gate["op"].isNull() | ~gate["op"].isin(*OPERATORS) | gate["target"].isNull() | text("requires_confidence") | ordered


def missions() -> list[tuple[str, Column]]:
    return [
        ("active_needs_a_gate", (F.col("state") == "active") & (F.coalesce(F.size("gates"), F.lit(0)) < 1)),
        ("gates_are_machine_checkable", F.coalesce(F.exists("gates", uncheckable), F.lit(False))),
        ("scope_shape", unlike("scope", SCOPE)),
        ("state_known", not_in("state", STATES)),
        ("statement_present", blank("statement")),
    ]


def symbols() -> list[tuple[str, Column]]:
    return [("kind_known", not_in("kind", SYMBOL_KINDS)), ("lines_ordered", F.col("line_end") < F.col("line_start")), ("name_present", blank("name"))]


def edges() -> list[tuple[str, Column]]:
    return [
        ("ambiguous_needs_candidates", (F.col("resolution") == "ambiguous-name") & (F.coalesce(F.size("candidates"), F.lit(0)) < 2)),
        ("kind_known", not_in("kind", EDGE_KINDS)),
        ("measured_resolves", (F.col("confidence") == "measured") & F.col("dst").isNull()),
    ]


def artifacts() -> list[tuple[str, Column]]:
    return [
        ("commit_shape", unlike("commit_sha", "^[0-9a-f]{7,40}$")),
        ("indexer_present", blank("indexer")),
        ("repo_present", blank("repo")),
        ("scope_shape", unlike("scope", SCOPE)),
        ("version_known", F.coalesce(F.col("version"), F.lit(0)) != 1),
    ]


def proposals() -> list[tuple[str, Column]]:
    return [
        ("accepted_names_an_assertion", (F.col("status") == "accepted") & F.col("promoted_to").isNull()),
        ("citation_required", blank("source")),
        ("reviewed_names_a_reviewer", F.col("status").isin("accepted", "rejected") & blank("reviewed_by")),
        ("status_known", not_in("status", ("pending", "accepted", "rejected"))),
    ]


def feedback() -> list[tuple[str, Column]]:
    return [("actor_present", blank("actor")), ("occasion_present", F.col("occasion").isNull()), ("scope_shape", unlike("scope", SCOPE)), ("signature_present", blank("signature"))]


def preferences() -> list[tuple[str, Column]]:
    tier = F.create_map(*(F.lit(x) for kv in TIERS.items() for x in kv))
    earned = F.least(F.col("humans"), F.lit(3)) == F.try_element_at(tier, F.col("tier"))
    return [("two_occasions", F.col("occasions") < 2), ("tier_matches_humans", ~F.coalesce(earned, F.lit(False)))]


def episodes() -> list[tuple[str, Column]]:
    return [("role_known", not_in("role", ROLES)), ("scope_shape", unlike("scope", SCOPE)), ("seq_not_negative", F.coalesce(F.col("seq"), F.lit(-1)) < 0), ("text_present", blank("text"))]


def claims() -> list[tuple[str, Column]]:
    return [("path_present", blank("path")), ("release_follows_claim", F.col("released_at") < F.col("claimed_at")), ("scope_shape", unlike("scope", SCOPE))]


def refused(rows: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """rows with reason, null where nothing refuses them."""
    return rows.withColumn("reason", F.coalesce(*(F.when(when, F.lit(name)) for name, when in rules)))


def permitted(granted: Column, needed: Sequence[str], root: Column, scope: Column) -> Column:
    """Whether granted permissions hold all needed ones, or admin, and the scope is in root's subtree."""
    enough = F.array_contains(granted, "admin") | (F.size(F.array_except(F.array(*map(F.lit, needed)), granted)) == 0)
    return enough & ((scope == root) | F.startswith(scope, F.concat(root, F.lit("/"))))
