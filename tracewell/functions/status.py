"""Status ladders: the first condition that holds names the status.

The operators rank the same words differently (an observed change outranks an
unknown in a process comparison, an unknown outranks a change in a function
comparison), so each ladder is a function of its own.  Conditions are boolean
columns; null counts as false.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def holds(condition: Column) -> Column:
    """A condition, false where it is null."""
    return F.coalesce(condition, F.lit(False))


def fails(condition: Column) -> Column:
    """That a condition does not hold: true where it is null."""
    return ~holds(condition)


def ladder(steps: list[tuple[Column, str]], rest: str) -> Column:
    first, *more = [(holds(c), s) for c, s in steps]
    return reduce(lambda c, s: c.when(s[0], s[1]), more, F.when(*first)).otherwise(rest)


def artifacts(incomplete: Column, contradiction: Column, covered: Column, unknown: Column, changes: Column) -> Column:
    return ladder([(incomplete, "truncated"), (contradiction, "contradiction"), (fails(covered) | holds(unknown), "unknown"), (fails(changes), "unchanged")], "changed")


def process(truncated: Column, changed: Column, unknown: Column) -> Column:
    return ladder([(truncated, "truncated"), (changed, "changed"), (unknown, "unknown")], "unchanged")


def function(truncated: Column, ambiguous: Column, unknown: Column, mismatched: Column, changed: Column) -> Column:
    return ladder([(truncated, "truncated"), (holds(ambiguous) | holds(unknown), "unknown"), (holds(mismatched) | holds(changed), "changed")], "unchanged")


def web_capture(changed: Column, unknown: Column) -> Column:
    return ladder([(changed, "changed"), (unknown, "unknown")], "unchanged")


def web_dimension(changed: Column, complete: Column) -> Column:
    return ladder([(changed, "changed"), (complete, "unchanged")], "unknown")


def scenario(changed: Column, unknown: Column, eligible: Column) -> Column:
    return ladder([(changed, "changed"), (holds(unknown) | fails(eligible), "unknown")], "unchanged")


def bundle(same_digest: Column, changes: Column, unresolved: Column) -> Column:
    return ladder([(same_digest & fails(changes), "unchanged"), (unresolved, "unknown")], "changed")


def correlation(truncated: Column, unresolved: Column, contradicted: Column) -> Column:
    return ladder([(truncated, "truncated"), (unresolved, "unknown"), (contradicted, "contradicted")], "correlated")


def changed_behavior(none: Column, truncated: Column, unknown: Column, changed: Column) -> Column:
    return ladder([(none, "unknown"), (truncated, "truncated"), (unknown, "unknown"), (changed, "changed")], "unchanged")


def claim(limited: Column, changed: Column, unknown: Column) -> Column:
    return ladder([(limited, "unknown"), (changed, "fail"), (unknown, "unknown")], "pass")


def specification(fail: Column, unknown: Column) -> Column:
    return ladder([(fail, "fail"), (unknown, "unknown")], "pass")


def closure(reasons: Column, hard: Column, soft: Column) -> Column:
    """reasons: how many; hard: one of the codes that fail at once; soft: one of those that leave it open."""
    return ladder([(reasons == 0, "ready"), (hard, "failed"), (soft, "unknown")], "partial")


def semantic_query(available: Column, cut: Column, candidates: Column, seeds: Column, unmet: Column) -> Column:
    """seeds: how many nodes the query starts from."""
    return ladder([(fails(available), "unsupported"), (cut, "truncated"), (candidates, "ambiguous"), (seeds == 0, "no-match"), (unmet, "partial"), (seeds > 1, "ambiguous")], "found")


def trace(left: Column, right: Column, same_order: Column) -> Column:
    """left, right: pass, fail or unknown."""
    return ladder([((left == "unknown") | (right == "unknown"), "unknown"), ((left == "pass") & (right == "pass"), "equivalent"), ((left != right) | fails(same_order), "different")], "nonconforming")


def trust_gate(mismatch: Column, truncated: Column, unknown: Column) -> Column:
    return ladder([(holds(mismatch) | holds(truncated), "fail"), (unknown, "unknown")], "pass")


def matched_item(differs: Column, complete: Column, dimension: Column) -> Column:
    return ladder([(holds(differs) | holds(complete & dimension), "changed"), (complete, "unchanged")], "unknown")


def one_sided_item(candidates: Column, complete: Column, side: str) -> Column:
    """side: added or removed; complete: of the opposite side."""
    return ladder([(candidates, "unknown"), (complete, side)], "unknown")


def source_mapping(evaluated: Column, exact: Column, top: Column, weak: Column, complete: Column) -> Column:
    """exact: candidates of equal content; top: candidates tied on the best path; weak: whether there are others."""
    return ladder(
        [(fails(evaluated), "unknown"), (exact == 1, "unchanged"), (exact > 1, "duplicated"), (top == 1, "unknown"), (top > 1, "split"), (weak, "unknown"), (complete, "removed")],
        "unknown",
    )


def call_path(capped: Column, found: Column, exhaustive: Column) -> Column:
    return ladder([(capped, "truncated"), (found, "found"), (exhaustive, "not_found")], "unknown")


def obligations(total: Column, failed: Column, unknown: Column, verified: Column, limited: Column) -> Column:
    """verified: whether all required ones are; a limitation makes anything but a failure unknown."""
    own = ladder([(total == 0, "unknown"), (failed, "failed"), (unknown, "unknown"), (verified, "ready")], "open")
    return F.when(holds(limited) & (own != "failed"), "unknown").otherwise(own)


def worst(status: Column, order: list[str]) -> Column:
    """Aggregate: the status that comes first in order; null without rows."""
    rank = reduce(lambda c, s: c.when(status == s[1], s[0]), list(enumerate(order))[1:], F.when(status == order[0], 0)).otherwise(len(order))
    return F.get(F.array(*[F.lit(s) for s in order]), F.min(rank))
