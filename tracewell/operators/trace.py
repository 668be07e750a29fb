"""Event-sequence checks: cardinality, order rules, first divergence, automata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cardinality(events: DataFrame, key: str, kind: str, spec: dict[str, tuple[int, int | None]]) -> DataFrame:
    """key, kind, n, ok for every kind of the spec, kinds without events included."""
    kinds = F.explode(F.array(*[F.lit(k) for k in spec]))
    n = events.groupBy(key, kind).agg(F.count("*").alias("n"))
    every = events.select(key).distinct().select(key, kinds.alias(kind))
    ok: Column = F.lit(None).cast("boolean")
    for k, (low, high) in spec.items():
        own = F.col("n") >= low if high is None else F.col("n").between(low, high)
        ok = F.when(F.col(kind) == k, own).otherwise(ok)
    return every.join(n, [key, kind], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).withColumn("ok", ok)


def happens_before(events: DataFrame, key: str, kind: str, order: str, rules: list[tuple[str, str]]) -> DataFrame:
    """key, before, after, status: the last `before` must precede the first `after`."""
    by = events.groupBy(key)
    out = None
    for before, after in rules:
        found = by.agg(F.max(F.when(F.col(kind) == before, F.col(order))).alias("b"), F.min(F.when(F.col(kind) == after, F.col(order))).alias("a"))
        status = F.when(F.col("a").isNull(), "ok").when(F.col("b").isNull(), "missing_before").when(F.col("b") < F.col("a"), "ok").otherwise("violated")
        own = found.select(key, F.lit(before).alias("before"), F.lit(after).alias("after"), status.alias("status"))
        out = own if out is None else out.unionByName(own)
    return out


def ordered(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    return events.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def first_divergence(left: DataFrame, right: DataFrame, position: str, value: str) -> DataFrame:
    """The first position at which two ordered sequences differ; no row if they are equal."""
    both = left.select(position, F.col(value).alias("left_value")).join(right.select(position, F.col(value).alias("right_value")), position, "full_outer")
    return both.where(~F.col("left_value").eqNullSafe(F.col("right_value"))).orderBy(position).limit(1)


def numbered(events: DataFrame, key: str, order: list[str], cell: Column) -> DataFrame:
    """events with position, from 1, in each key's order.

    `cell` may not decrease in the order; counts of a key's cells give the offsets,
    so that a task sorts one cell of a key and not all of its events.
    """
    dealt = events.withColumn("__cell", cell)
    cells = dealt.groupBy(key, "__cell").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(key).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(F.col(key).alias("__k"), F.col("__cell").alias("__c"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    nth = dealt.withColumn("__i", F.row_number().over(Window.partitionBy(key, "__cell").orderBy(*order)))
    same = F.col(key).eqNullSafe(F.col("__k")) & F.col("__cell").eqNullSafe(F.col("__c"))
    return nth.join(offsets, same).withColumn("position", F.col("__before") + F.col("__i")).drop("__cell", "__c", "__k", "__i", "__before")


def following(keys: DataFrame, key: str, width: int = 1024) -> DataFrame:
    """key, next: each whole-number key with the next greater one; the last has none.

    Keys are dealt to cells of `width`, so only one row for each cell meets in one task.
    """
    dealt = keys.select(key).where(F.col(key).isNotNull()).distinct().withColumn("__cell", F.floor(F.col(key) / width))
    heads = dealt.groupBy("__cell").agg(F.min(key).alias("__head"))
    heads = heads.select("__cell", F.lead("__head").over(Window.orderBy("__cell")).alias("__then"))
    inner = dealt.withColumn("__in", F.lead(key).over(Window.partitionBy("__cell").orderBy(key)))
    return inner.join(heads, "__cell").select(key, F.coalesce("__in", "__then").alias("next")).where("next IS NOT NULL")


def divergence_by_key(left: DataFrame, right: DataFrame, key: str, position: str, value: str) -> DataFrame:
    """key, position, left_value, right_value: each key's first position at which its two sequences differ; no row for equal ones."""
    side = lambda df, i: df.select(F.col(key).alias(f"__k{i}"), F.col(position).alias(f"__p{i}"), F.col(value).alias(f"__v{i}"))
    both = side(left, 0).join(side(right, 1), F.col("__k0").eqNullSafe(F.col("__k1")) & (F.col("__p0") == F.col("__p1")), "full_outer")
    odd = both.where(F.col("__p0").isNull() | F.col("__p1").isNull() | ~F.col("__v0").eqNullSafe(F.col("__v1")))
    first = F.min(F.struct(F.coalesce("__p0", "__p1").alias("p"), F.col("__v0").alias("l"), F.col("__v1").alias("r"))).alias("x")
    found = odd.groupBy(F.when(F.col("__p0").isNull(), F.col("__k1")).otherwise(F.col("__k0")).alias(key)).agg(first)
    return found.select(key, F.col("x.p").alias(position), F.col("x.l").alias("left_value"), F.col("x.r").alias("right_value"))


def variants(events: DataFrame, by: list[str], kind: str) -> DataFrame:
    """variant, n: groups of `by` with the same kinds equally often; a variant lists kind:count of all of a group's events."""
    n = events.groupBy(*by, kind).agg(F.count("*").alias("__n"))
    pair = F.struct(F.coalesce(kind, F.lit("null")).alias("k"), F.col("__n").alias("n"))
    seen = n.groupBy(*by).agg(F.sort_array(F.collect_list(pair)).alias("__s"))
    text = F.array_join(F.transform("__s", lambda x: F.concat_ws(":", x["k"], x["n"].cast("string"))), ",")
    return seen.groupBy(text.alias("variant")).agg(F.count("*").alias("n"))


def run_automaton(events: DataFrame, key: str, order: list[str], kind: str, start: str, moves: dict[tuple[str, str], str]) -> DataFrame:
    """key, state, matched: a fold over each key's events; events without a move are skipped."""
    seq = F.transform(F.sort_array(F.collect_list(F.struct(*order, kind))), lambda x: x[kind])

    def step(acc: Column, k: Column) -> Column:
        state: Column = F.lit(None).cast("string")
        for (at, on), to in moves.items():
            state = F.when((acc["state"] == at) & (k == on), F.lit(to)).otherwise(state)
        return F.struct(F.coalesce(state, acc["state"]).alias("state"), (acc["matched"] + state.isNotNull().cast("int")).alias("matched"))

    run = F.aggregate(seq, F.struct(F.lit(start).alias("state"), F.lit(0).alias("matched")), step)
    return events.groupBy(key).agg(run.alias("r")).select(key, "r.state", "r.matched")


def not_before(events: DataFrame, key: str, kind: str, order: str, anchor: str, event: str) -> DataFrame:
    """key, status: the first `event` may not come before the first `anchor`, which it requires."""
    first = lambda k: F.min(F.when(F.col(kind) == k, F.col(order)))
    found = events.groupBy(key).agg(first(event).alias("e"), first(anchor).alias("a"))
    return found.select(key, F.when(F.col("e").isNull(), "ok").when(F.col("a").isNull(), "missing_anchor").when(F.col("e") < F.col("a"), "violated").otherwise("ok").alias("status"))


def boundary(events: DataFrame, key: str, order: list[str], kind: str, prefix: list[str], suffix: list[str]) -> DataFrame:
    """key, prefix_ok, suffix_ok.  Only the first and last positions of a key are kept, not its whole sequence."""
    n, m = len(prefix), len(suffix)
    w = Window.partitionBy(key)
    up = [F.asc(c) for c in order]
    down = [F.desc(c) for c in order]
    placed = events.select(key, kind, F.row_number().over(w.orderBy(*up)).alias("__i"), F.row_number().over(w.orderBy(*down)).alias("__j"))
    near = placed.where((F.col("__i") <= n) | (F.col("__j") <= m))
    hits = lambda at, want: sum((F.max(F.when((F.col(at) == i + 1) & (F.col(kind) == v), 1).otherwise(0)) for i, v in enumerate(want)), F.lit(0))
    return near.groupBy(key).agg((hits("__i", prefix) == n).alias("prefix_ok"), (hits("__j", suffix[::-1]) == m).alias("suffix_ok"))


def sequence(events: DataFrame, key: str, order: list[str], kind: str, steps: list[str]) -> DataFrame:
    """key, reached: how many of the steps occur in this order, each after the one before."""

    def step(acc: Column, k: Column) -> Column:
        want: Column = F.lit(None).cast("string")
        for i, s in enumerate(steps):
            want = F.when(acc == i, F.lit(s)).otherwise(want)
        return F.when(want == k, acc + 1).otherwise(acc)

    seq = F.transform(F.sort_array(F.collect_list(F.struct(*order, kind))), lambda x: x[kind])
    return events.where(F.col(kind).isin(*steps)).groupBy(key).agg(F.aggregate(seq, F.lit(0), step).alias("reached"))


def sessions(events: DataFrame, key: str, time: str, tie: str, gap: str) -> DataFrame:
    """events with session (from 1): a new one starts after a pause longer than the gap."""
    w = Window.partitionBy(key).orderBy(time, tie)
    starts = F.coalesce(F.col(time) > F.lag(time).over(w) + F.expr(f"INTERVAL {gap}"), F.lit(True)).cast("int")
    return events.withColumn("__new", starts).withColumn("session", F.sum("__new").over(w)).drop("__new")


def evaluated(events: DataFrame, key: list[str], kind: str, order: str, counts: dict[str, tuple[int, int]], rules: list[tuple[str, str]]) -> DataFrame:
    """key, side (pass, fail or unknown) and order: cardinalities first, then order rules, each before its successors.

    A required kind without any event leaves the side open.  `order` is a digest
    of the kinds that the rules name, in their order.
    """
    of = lambda k: F.col(kind) == k
    named = sorted({k for rule in rules for k in rule} | set(counts))
    aggs = [F.count_if(of(k)).alias(f"__n{i}") for i, k in enumerate(counts)]
    aggs += [F.max(F.when(of(b), F.col(order))).alias(f"__b{i}") for i, (b, _) in enumerate(rules)] + [F.min(F.when(of(a), F.col(order))).alias(f"__a{i}") for i, (_, a) in enumerate(rules)]
    seq = F.sort_array(F.collect_list(F.when(F.col(kind).isin(*named), F.struct(F.col(order).alias("o"), F.col(kind).alias("k")))))
    aggs.append(F.sha2(F.array_join(F.transform(seq, lambda x: x["k"]), ","), 256).alias("order"))
    g = events.groupBy(*key).agg(*aggs)
    side: Column = F.lit("pass")
    for i in range(len(rules)):
        side = F.when(F.col(f"__a{i}").isNotNull() & (F.col(f"__b{i}") >= F.col(f"__a{i}")), "fail").otherwise(side)
    for i, (_, high) in enumerate(counts.values()):
        side = F.when(F.col(f"__n{i}") > high, "fail").otherwise(side)
    for i, (low, _) in enumerate(counts.values()):
        side = F.when(F.col(f"__n{i}") < low, "unknown").otherwise(side)
    return g.select(*key, side.alias("side"), "order")


def repeatable(captures: DataFrame, key: str, time: str, dimensions: list[str], timing: set[str]) -> DataFrame:
    """key, samples, unstable, verdict: each capture of a key against its first."""
    first = captures.groupBy(key).agg(F.count("*").alias("samples"), F.min(F.struct(time, *dimensions)).alias("__f"))
    same = captures.join(first, key).groupBy(key, "samples").agg(*[F.bool_and(F.col(x).eqNullSafe(F.col(f"__f.{x}"))).alias(f"__{x}") for x in dimensions])
    unstable = F.concat_ws(",", *[F.when(~F.col(f"__{x}"), F.lit(x)) for x in dimensions])
    still = [F.col(f"__{x}") for x in dimensions if x not in timing]
    rest = still[0]
    for x in still[1:]:
        rest = rest & x
    verdict = F.when(F.col("samples") < 2, "insufficient").when(unstable == "", "stable").when(rest, "timing_variance").otherwise("unstable")
    return same.select(key, "samples", unstable.alias("unstable"), verdict.alias("verdict"))


def heads(revisions: DataFrame, key: str, revision: str, digest: str, claimed: str, prior: str) -> DataFrame:
    """key, head, digest, chained: the last revision, and whether every one claims the digest of the one before it."""
    return revisions.groupBy(key).agg(F.max(revision).alias("head"), F.max_by(digest, revision).alias("digest"), F.bool_and(F.col(claimed).eqNullSafe(F.col(prior))).alias("chained"))


class Machine:
    """One key's state in a replay machine: a small step function, used by batches and streams alike.

    machine: start, visits (state to its limit), max_transitions and moves, in
    order of declaration, with id, from, to, on and, if given, priority, guards
    and captures (variable to field) and max_uses.
    """

    def __init__(self, machine: dict, state: dict | None = None):
        self.machine = machine
        self.s = state or {"at": machine["start"], "known": {}, "uses": {}, "visits": {machine["start"]: 1}, "n": 0, "last": None}

    def step(self, at, kind, fields: dict) -> tuple[str, str | None]:
        """Outcome and, if matched, the move; nothing changes on a refusal."""
        s, m = self.s, self.machine
        if s["last"] is not None and at < s["last"]:
            return "limit_exhausted", None
        s["last"] = at
        matching = [x for x in m["moves"] if x["on"] == kind]
        open_ = sorted((x for x in matching if x["from"] == s["at"]), key=lambda x: x.get("priority", 0))
        if not open_:
            return ("invalid_state" if matching else "unmatched"), None
        passed = [x for x in open_ if all(v in s["known"] and fields.get(f) is not None and s["known"][v] == fields[f] for v, f in x.get("guards", {}).items())]
        if not passed:
            return "guard_failed", None
        move = next((x for x in passed if s["uses"].get(x["id"], 0) < x.get("max_uses", 1 << 62)), None)
        if move is None or s["n"] >= m["max_transitions"]:
            return "transition_exhausted", None
        visits = s["visits"].get(move["to"], 0) + 1
        if visits > m["visits"].get(move["to"], 0):
            return "limit_exhausted", None
        captured = {v: fields.get(f) for v, f in move.get("captures", {}).items()}
        if any(v is None for v in captured.values()):
            return "invalid_capture", None
        s["known"].update(captured)
        s["uses"][move["id"]] = s["uses"].get(move["id"], 0) + 1
        s["visits"][move["to"]] = visits
        s["at"], s["n"] = move["to"], s["n"] + 1
        return "matched", move["id"]


def replay(events: DataFrame, key: str, order: str, kind: str, fields: list[str], machine: dict) -> DataFrame:
    """key, order, outcome, transition and state after each event of each key, in order.

    A partition's sorted rows stream through one machine at a time, so a task
    holds one key's state, however many events the key has.
    """
    schema = events.select(key, order).schema.add("outcome", "string").add("transition", "string").add("state", "string")

    def run(frames):
        import pandas as pd

        now, at = None, object()
        for frame in frames:
            out = []
            for row in frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None):
                own = dict(zip(frame.columns, row, strict=True))
                if now is None or own[key] != at:
                    now, at = Machine(machine), own[key]
                outcome, move = now.step(own[order], own[kind], own)
                out.append((own[key], own[order], outcome, move, now.s["at"]))
            yield pd.DataFrame(out, columns=schema.names)

    names = list(dict.fromkeys([key, order, kind, *fields]))
    return events.select(*names).where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, order).mapInPandas(run, schema)


def triggered(events: DataFrame, key: str, order: str, kind: str, trigger: tuple, since: DataFrame) -> DataFrame:
    """key, at: the least order at which a trigger holds for each key of since (key, since), by events after it; null if it does not.

    A trigger is ("event", kind), ("all", *triggers), ("any", *triggers),
    ("sequence", *triggers), each after the one before, or ("repeat", kind, least,
    most): more than the most is no match.  Every step is a join on the key.
    """
    what, *parts = trigger
    e = events.select(F.col(key).alias("__k"), F.col(order).alias("__o"), F.col(kind).alias("__w"))
    if what in ("event", "repeat"):
        hits = since.where("since IS NOT NULL").join(e.where(F.col("__w") == parts[0]), (F.col(key) == F.col("__k")) & (F.col("__o") > F.col("since")))
        if what == "event":
            found = hits.groupBy(key).agg(F.min("__o").alias("at"))
        else:
            w = Window.partitionBy(key)
            nth = hits.withColumn("__i", F.row_number().over(w.orderBy("__o"))).withColumn("__n", F.count("*").over(w))
            found = nth.where((F.col("__i") == parts[1]) & (F.col("__n") <= parts[2])).select(key, F.col("__o").alias("at"))
        return since.select(key).join(found, key, "left")
    if what == "sequence":
        for part in parts:
            since = triggered(events, key, order, kind, part, since).withColumnRenamed("at", "since")
        return since.withColumnRenamed("since", "at")
    told = since.select(key)
    for i, part in enumerate(parts):
        told = told.join(triggered(events, key, order, kind, part, since).withColumnRenamed("at", f"__{i}"), key)
    every = [F.col(f"__{i}") for i in range(len(parts))]
    absent = every[0].isNull()
    for x in every[1:]:
        absent = absent | x.isNull()
    at = (F.when(~absent, F.greatest(*every)) if what == "all" else F.least(*every)) if len(every) > 1 else every[0]
    return told.select(key, at.alias("at"))
