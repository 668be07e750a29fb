"""Keyed and set diffs with three-valued outcomes.

A key present on one side only counts as added or removed only if both sides'
inventories are complete; otherwise the outcome is unknown, never equality or
absence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyed_diff(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], left_complete: Column | bool = True, right_complete: Column | bool = True) -> DataFrame:
    """keys, left_/right_ values, status and changed (comma-joined names), by one full outer join."""
    complete = F.lit(left_complete) & F.lit(right_complete)
    a = left.select(*keys, *[F.col(v).alias(f"left_{v}") for v in values], F.lit(True).alias("__l"))
    b = right.select(*keys, *[F.col(v).alias(f"right_{v}") for v in values], F.lit(True).alias("__r"))
    differ = {v: ~F.col(f"left_{v}").eqNullSafe(F.col(f"right_{v}")) for v in values}
    both = F.col("__l").isNotNull() & F.col("__r").isNotNull()
    changed = F.concat_ws(",", *[F.when(both & d, F.lit(v)) for v, d in differ.items()])
    status = (
        F.when(F.col("__l").isNull(), F.when(complete, "added").otherwise("unknown"))
        .when(F.col("__r").isNull(), F.when(complete, "removed").otherwise("unknown"))
        .when(changed != "", "changed")
        .otherwise("unchanged")
    )
    joined = a.join(b, keys, "full_outer")
    return joined.withColumn("changed", changed).withColumn("status", status).drop("__l", "__r")


def status_summary(diff: DataFrame, by: list[str] | None = None) -> DataFrame:
    return diff.groupBy(*(by or []), "status").agg(F.count("*").alias("n"))


def membership(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys with side: both, left_only or right_only."""
    a, b = left.select(*keys).distinct().withColumn("__l", F.lit(1)), right.select(*keys).distinct().withColumn("__r", F.lit(1))
    side = F.when(F.col("__l").isNull(), "right_only").when(F.col("__r").isNull(), "left_only").otherwise("both")
    return a.join(b, keys, "full_outer").select(*keys, side.alias("side"))


def history_relation(left: DataFrame, right: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """unchanged, advanced (either history begins the other), diverged, added or removed, comparing two ordered histories of each key.

    Places are compared by a join, not in arrays, so a key's history may be of any length.
    """

    def told(df: DataFrame, side: str) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy(key).orderBy(seq))
        return df.select(key, nth.alias("__i"), F.struct(F.col(value)).alias(f"__{side}"))

    both = told(left, "l").join(told(right, "r"), [key, "__i"], "full_outer")
    l, r = F.col("__l").isNotNull(), F.col("__r").isNotNull()
    n = both.groupBy(key).agg(F.count("__l").alias("left_size"), F.count("__r").alias("right_size"), F.count_if(l & r & ~F.col("__l").eqNullSafe(F.col("__r"))).alias("__odd"))
    x, y = F.col("left_size"), F.col("right_size")
    relation = F.when(x == 0, "added").when(y == 0, "removed").when(F.col("__odd") > 0, "diverged").when(x == y, "unchanged").otherwise("advanced")
    return n.select(key, "left_size", "right_size", relation.alias("relation"))


def budgeted(changes: DataFrame, order: list[str], budget: int) -> DataFrame:
    """The first `budget` changes overall, and for each row whether it was kept.

    Ranks inside each value of the first order column are added to the counts
    of the values before it, so no task sorts all rows.
    """
    first = order[0]
    counts = changes.groupBy(first).agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.orderBy(first)) - F.col("__n")).drop("__n")  # one row for each value of the first column: dimensions, which are few
    rank = F.row_number().over(Window.partitionBy(first).orderBy(*order[1:]))
    return changes.withColumn("__rank", rank).join(before, first).withColumn("position", (F.col("__rank") + F.col("__before")).cast("long")).withColumn("kept", F.col("position") <= budget).drop("__rank", "__before")
