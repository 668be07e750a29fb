"""Checks of trace specifications: whether their order is acyclic and names every pair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.stages import cut


def ordered_pairs(rules: DataFrame, spec: str) -> DataFrame:
    """spec, before, after: the transitive closure of each specification's rules; paths double in each round."""
    pairs = cut(rules.select(spec, "before", "after").distinct())
    while True:
        on = pairs.select(spec, F.col("before").alias("after"), F.col("after").alias("then"))
        longer = pairs.join(on, [spec, "after"]).select(spec, "before", F.col("then").alias("after")).distinct()
        new = cut(longer.join(pairs, [spec, "before", "after"], "left_anti"))
        if new.isEmpty():
            return pairs
        pairs = cut(pairs.unionByName(new))


def violations(events: DataFrame, rules: DataFrame, unordered: DataFrame, spec: str) -> DataFrame:
    """spec, violation, a, b of specifications given as rows.

    events (spec, id), rules (spec, before, after) and unordered (spec, group, id):
    duplicate_event: an id declared twice; unknown_event: a rule or group names an
    id that is not declared; cycle: an event comes before itself; conflict: a pair
    is ordered and unordered; undeclared_pair: a pair is neither.  Pairs of a < b;
    pairs of a cyclic specification are not judged.
    """
    known = events.groupBy(spec, "id").agg(F.count("*").alias("n"))
    none = F.lit(None).cast(events.schema["id"].dataType)
    say = lambda df, what, a="id", b=none: df.select(spec, F.lit(what).alias("violation"), F.col(a).alias("a"), (b if b is none else F.col(b)).alias("b"))
    named = rules.select(spec, F.explode(F.array("before", "after")).alias("id")).unionByName(unordered.select(spec, "id")).distinct()
    closed = cut(ordered_pairs(rules, spec))
    cyclic = closed.where("before = after").select(spec, F.col("before").alias("id"))
    ids = known.select(spec, "id")
    pairs = ids.withColumnRenamed("id", "a").join(ids.withColumnRenamed("id", "b"), spec).where("a < b").join(cyclic.select(spec).distinct(), spec, "left_anti")  # a specification's events are few
    order = closed.select(spec, F.least("before", "after").alias("a"), F.greatest("before", "after").alias("b")).distinct().withColumn("ordered", F.lit(True))
    group = unordered.select(spec, "group", F.col("id").alias("a")).join(unordered.select(spec, "group", F.col("id").alias("b")), [spec, "group"]).where("a < b").select(spec, "a", "b").distinct().withColumn("free", F.lit(True))
    judged = pairs.join(order, [spec, "a", "b"], "left").join(group, [spec, "a", "b"], "left")
    found = [
        say(known.where("n > 1"), "duplicate_event"), say(named.join(ids, [spec, "id"], "left_anti"), "unknown_event"), say(cyclic, "cycle"),
        say(judged.where("ordered AND free"), "conflict", "a", "b"), say(judged.where("ordered IS NULL AND free IS NULL"), "undeclared_pair", "a", "b"),
    ]
    return reduce(DataFrame.unionByName, found)
