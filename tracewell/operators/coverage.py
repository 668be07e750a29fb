"""Comparison of two versions' members: items, what they rest on, and what pages and limits left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import status
from tracewell.operators import match


def paged(members: DataFrame, group: list[str], order: list[str], limit: Column) -> DataFrame:
    """members with position, from 1, of their group, and total; only the first `limit` of a group are on its page."""
    w = Window.partitionBy(*group)
    told = members.withColumns({"total": F.count("*").over(w), "position": F.row_number().over(w.orderBy(*order))})
    return told.where(F.col("position") <= limit)


def omissions(members: DataFrame, page: DataFrame, group: list[str]) -> DataFrame:
    """group, total, returned, omitted, complete: what a page leaves out of each group's members."""
    n = lambda df, out: df.groupBy(*group).agg(F.count("*").alias(out))
    told = n(members, "total").join(n(page, "__n"), group, "left").withColumn("returned", F.coalesce("__n", F.lit(0).cast("long")))
    return told.select(*group, "total", "returned", (F.col("total") - F.col("returned")).alias("omitted"), (F.col("total") == F.col("returned")).alias("complete"))


def items(left: DataFrame, right: DataFrame, member: str, group: list[str], tiers: list[tuple[str, Column]], content: str, sides: DataFrame) -> DataFrame:
    """group, left_id, right_id, basis, matching, status: one row for each matched pair and each other member of two pages.

    sides (group, left_complete, right_complete): whether a page holds all its
    members; a null counts as no.  A pair is changed if its content differs; a
    member without partner is added or removed only if the other side is
    complete; one of several candidates is unknown.
    """
    key = lambda k: F.concat_ws("\x1f", *[F.coalesce(F.col(g).cast("string"), F.lit("\x1e")) for g in group], k)
    own = [(name, F.when(k.isNotNull(), key(k))) for name, k in tiers]
    told = match.one_to_one(left, right, member, member, own)
    told = told.where("side = 'left' OR status <> 'matched'")  # a pair once
    is_left = F.col("side") == "left"
    told = told.select(
        F.when(is_left, F.col("id")).alias("left_id"), F.when(is_left, F.col("partner")).otherwise(F.col("id")).alias("right_id"), F.col("tier").alias("basis"), F.col("status").alias("matching"), "side"
    )
    of = lambda df, side: df.select(F.col(member).alias(f"{side}_id"), F.struct(*group).alias(f"__{side}"), F.col(content).alias(f"__{side}_content"))
    both = told.join(of(left, "left"), "left_id", "left").join(of(right, "right"), "right_id", "left")
    both = both.withColumn("__g", F.coalesce("__left", "__right")).select(*[F.col("__g")[g].alias(g) for g in group], "left_id", "right_id", "basis", "matching", "side", "__left_content", "__right_content")
    both = both.join(sides.select(*group, "left_complete", "right_complete"), group, "left")
    differs = ~F.col("__left_content").eqNullSafe(F.col("__right_content"))
    several = F.col("matching") == "ambiguous"
    one = F.when(F.col("side") == "left", status.one_sided_item(several, F.col("right_complete"), "removed")).otherwise(status.one_sided_item(several, F.col("left_complete"), "added"))
    own_status = F.when(F.col("matching") == "matched", status.matched_item(differs, F.lit(True), F.lit(False))).otherwise(one)
    return both.select(*group, "left_id", "right_id", "basis", "matching", own_status.alias("status"))


STATUSES, MATCHINGS = ["unchanged", "changed", "added", "removed", "unknown"], ["matched", "ambiguous", "unmatched"]


def summary(found: DataFrame, group: str, max_items: int, sides: DataFrame) -> DataFrame:
    """group, counts of the retained items by status and matching, omitted_items, omitted_members, left_status, right_status, coverage.

    found: `items`, of which the first max_items of a group, by left_id and then
    right_id, are retained.  sides: group, omitted (members that pages left
    out), left_complete, right_complete and known, whether both inputs know
    their extent.  coverage: partial where they don't, else truncated where
    anything was left out, else complete-within-inputs.
    """
    w = Window.partitionBy(group).orderBy(F.asc_nulls_last("left_id"), "right_id")
    n = found.withColumn("__kept", F.row_number().over(w) <= max_items)
    counts = [F.count_if(F.col("__kept") & (F.col("status") == s)).alias(s) for s in STATUSES] + [F.count_if(F.col("__kept") & (F.col("matching") == m)).alias(m) for m in MATCHINGS]
    told = n.groupBy(group).agg(*counts, F.count_if(~F.col("__kept")).alias("omitted_items"))
    every = sides.join(told, group, "left").fillna(0, [*STATUSES, *MATCHINGS, "omitted_items"])
    side = lambda c: F.when(status.holds(F.col("known")) & status.holds(F.col(c)), "complete").otherwise("partial")
    own = status.ladder([(status.fails(F.col("known")), "partial"), (F.col("omitted") + F.col("omitted_items") > 0, "truncated"), (F.col("left_complete") & F.col("right_complete"), "complete-within-inputs")], "partial")
    return every.select(group, *STATUSES, *MATCHINGS, "omitted_items", F.col("omitted").alias("omitted_members"), side("left_complete").alias("left_status"), side("right_complete").alias("right_status"), own.alias("coverage"))
