"""Operator 12, near-duplicate vectors by NN-descent.

1. Classes.  Equal vectors are one class, represented by the least id.
2. First graph.  In each of `TABLES` turns random planes give a vector a bucket;
   vectors are sorted by bucket and one more projection, ranges of that order are
   dealt to the tasks, and runs of `RUN` neighbours in it offer each other.
   There are no groups, so copies of one vector fill many tasks.
3. Descent.  Each vector keeps a list of its nearest so far.  In a round every
   vector lets its list and a sample of those that list it meet: a pair of which
   one is new, and that is nearer than the last in a list, enters that list.
   Vectors travel as 16-bit floats; rounds end when few lists change.
4. Saturation.  A full list whose last is still near is doubled in the next
   round, up to `WIDEST`.  Where that isn't enough, the vector lies in a dense
   component, whose members are then counted whole: they are sorted and packed
   into shards with a centre and a radius; by the triangle inequality all or no
   members of most shards are near those of another, only the rest is compared.
   Numbers travel, no pairs.
5. Edges at or above the threshold are verified with doubles; components come
   from contracting them.
6. Audit.  The links of a bounded sample are counted by brute force; below the
   wanted recall, new tables join the graph and the descent goes on.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing; shorter vectors count as filled up with zeros.
Rows without an id are left out; repeated ids are vectors of their own.  An
empty table gives no rows.  Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import forget, stored
from tracewell.llm.exact_topk import valid
from tracewell.llm.ngram_join import contract

LIST, WIDEST = 16, 64
TABLES, RUN, OFFERS = 4, 128, 8
#: Vectors in a shard of a dense component, and in the audit's sample.
SHARD, SAMPLE = 1024, 512
#: Rounding of similarities between 16-bit floats.
MARGIN = 0.004
ROUNDS = 10


def _matrix(column: pa.Array, kind) -> np.ndarray:
    """Packed vectors as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _packed(x: np.ndarray) -> pa.Array:
    wide = x.shape[1] * x.itemsize
    raw = np.ascontiguousarray(x).tobytes()
    return pa.array([raw[i : i + wide] for i in range(0, len(raw), wide)], pa.binary())


def _units(dim: int, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors as doubles, and as 16-bit floats."""
    for b in it:
        x = np.zeros((b.num_rows, dim))
        for i, v in enumerate(b.column("vec").to_pylist()):
            x[i, : len(v)] = v
        x /= np.abs(x).max(1, keepdims=True, initial=1e-300)
        x /= np.sqrt((x**2).sum(1, keepdims=True))
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n"), _packed(x), _packed(x.astype(np.float16))], ["id", "n", "unit", "code"])


def _dealt(dim: int, bits: int, seed: int, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(turn, bucket, along): where each vector lies in the order of each turn."""
    planes = np.random.default_rng(seed).normal(size=(TABLES, dim, bits + 1))
    for b in it:
        x = _matrix(b.column("code"), np.float16).astype(np.float32)
        for t in range(TABLES):
            side = x @ planes[t]
            bucket = (side[:, :bits] > 0) @ (1 << np.arange(bits))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(bucket.astype(np.int64)), pa.array(side[:, bits]), b.column("id"), b.column("code")], ["turn", "bucket", "along", "id", "code"])


EDGES = "u long, v long, s float"


def _edges(u: np.ndarray, v: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(v.astype(np.int64)), pa.array(s.astype(np.float32))], ["u", "v", "s"])


def _most(s: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the `most` highest of each row; minus infinity is none."""
    if s.shape[1] > most:
        cut = -np.partition(-s, most - 1, 1)[:, most - 1 : most]
        return np.nonzero((s >= cut) & (s > -np.inf))
    return np.nonzero(s > -np.inf)


def _runs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours in each turn's order offer each other, in runs that overlap by half."""

    def offer(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        s = x @ x.T
        s[ids[:, None] == ids] = -np.inf
        r, c = _most(s, OFFERS)
        return _edges(ids[r], ids[c], s[r, c])

    turn, ids, x = None, np.zeros(0, np.int64), None
    for b in it:
        turns, own, codes = b.column("turn").to_numpy(), b.column("id").to_numpy(), _matrix(b.column("code"), np.float16).astype(np.float32)
        for t in np.unique(turns):
            at = turns == t
            if t != turn:
                if len(ids):
                    yield offer(ids, x)
                turn, ids, x = t, own[at], codes[at]
            else:
                ids, x = np.append(ids, own[at]), np.concatenate([x, codes[at]])
            k = 0
            while len(ids) - k > RUN:
                yield offer(ids[k : k + RUN], x[k : k + RUN])
                k += RUN // 2
            ids, x = ids[k:], x[k:]
    if len(ids):
        yield offer(ids, x)


def _meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Offers between those that meet at a vector; rows come sorted by it."""

    def offers(who: np.ndarray, fresh: np.ndarray, floor: np.ndarray, x: np.ndarray) -> tuple | None:
        s = x @ x.T
        s[(who[:, None] == who) | ~(fresh[:, None] | fresh) | (s <= floor[:, None])] = -np.inf
        r, c = _most(s, OFFERS)
        return (who[r], who[c], s[r, c]) if len(r) else None

    rest = None
    for b in it:
        cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("at", "who", "fresh", "floor")] + [_matrix(b.column("code"), np.float16).astype(np.float32)]
        if rest is not None:
            cols = [np.concatenate(p) for p in zip(rest, cols, strict=True)]
        at = np.nonzero(np.append(True, cols[0][1:] != cols[0][:-1])[: len(cols[0])])[0]
        found = [f for x, y in zip(at[:-1], at[1:], strict=True) if (f := offers(*(c[x:y] for c in cols[1:])))]
        if found:
            yield _edges(*(np.concatenate(c) for c in zip(*found, strict=True)))
        rest = [c[at[-1] :] for c in cols] if len(at) else None
    if rest is not None and (f := offers(*rest[1:])):
        yield _edges(*f)


def _best(edges: DataFrame, widths: DataFrame | None) -> DataFrame:
    """Lists (u, v, s, fresh, width) of the nearest of all offers (u, v, s, fresh); stored."""
    one = edges.groupBy("u", "v").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"))
    ranked = one.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "v"))).where(F.col("r") <= WIDEST)
    ranked = ranked.withColumn("width", F.lit(LIST)) if widths is None else ranked.join(widths, "u", "left").withColumn("width", F.coalesce("width", F.lit(LIST)))
    return stored(ranked.where(F.col("r") <= F.col("width")).select("u", "v", "s", "fresh", "width"))


def _lists(graph: DataFrame, near: float) -> DataFrame:
    """(u, floor, width, full) of each list: its last if it is full, and whether that is still near; full lists are to be doubled."""
    own = graph.groupBy("u").agg(F.count("*").alias("many"), F.min("s").alias("last"), F.max("width").alias("width"))
    is_full = F.col("many") >= F.col("width")
    full = is_full & (F.col("last") >= near)
    return own.select("u", F.when(is_full & ~full, F.col("last")).otherwise(F.lit(-2.0)).cast("float").alias("floor"), F.when(full, F.least(2 * F.col("width"), F.lit(WIDEST))).otherwise(F.col("width")).alias("width"), full.alias("full"))


def first_graph(reps: DataFrame, dim: int, n: int, seed: int) -> DataFrame:
    """Offers (u, v, s, fresh) between neighbours in the orders of `TABLES` turns."""
    bits = min(62, max(1, int(np.log2(max(2, n / RUN)))))
    order = reps.select("id", "code").mapInArrow(partial(_dealt, dim, bits, seed), "turn int, bucket long, along double, id long, code binary")
    key = ["turn", "bucket", "along"]
    return order.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(_runs, EDGES).withColumn("fresh", F.lit(True))


def descend(graph: DataFrame, reps: DataFrame, near: float, few: float = 0.02) -> DataFrame:
    """The graph after rounds of neighbours that meet, until at most `few` of all entries are new."""
    codes = reps.select(F.col("id").alias("who"), "code")
    for turn in range(ROUNDS):
        lists = stored(_lists(graph, near))
        forward = graph.select(F.col("u").alias("at"), F.col("v").alias("who"), "fresh")
        w = Window.partitionBy("at").orderBy(F.desc("fresh"), F.xxhash64("who", F.lit(turn)))
        back = graph.select(F.col("v").alias("at"), F.col("u").alias("who"), "fresh").withColumn("r", F.row_number().over(w)).where(F.col("r") <= LIST).drop("r")
        rows = forward.unionByName(back).groupBy("at", "who").agg(F.max("fresh").alias("fresh"))
        known = codes.join(lists.select(F.col("u").alias("who"), "floor"), "who", "left").select("who", "code", F.coalesce("floor", F.lit(-2.0).cast("float")).alias("floor"))
        met = rows.join(known, "who").select("at", "who", "fresh", "floor", "code").repartition("at").sortWithinPartitions("at").mapInArrow(_meet, EDGES)
        offers = stored(met.groupBy("u", "v").agg(F.max("s").alias("s")))
        every = graph.select("u", "v", "s", F.lit(False).alias("fresh")).unionByName(offers.withColumn("fresh", F.lit(True)))
        after = _best(every, lists.select("u", "width"))
        forget(graph, lists, offers)
        graph = after
        new, total = graph.agg(F.count_if("fresh"), F.count("*")).first()
        if new <= few * total:
            break
    return graph


def _verified(threshold: float, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        ok = (_matrix(b.column("ua"), float) * _matrix(b.column("ub"), float)).sum(1) >= threshold
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok))


def links(graph: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b), a < b, of the graph at or above the threshold, in doubles; stored."""
    pairs = graph.where(F.col("s") >= threshold - MARGIN).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    of = lambda side: reps.select(F.col("id").alias(side), F.col("unit").alias(f"u{side}"))
    return stored(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "ua", "ub").mapInArrow(partial(_verified, threshold), "a long, b long"))


def _shards(size: int, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows of `size` members of one component; rows come sorted by it."""
    from pyspark import TaskContext

    part, nth, rest = TaskContext.get().partitionId(), 0, None

    def shard(comp: int, rows: pa.Table) -> pa.RecordBatch:
        nonlocal nth
        nth += 1
        x = _matrix(rows.column("unit"), float)
        centre = x.mean(0)
        centre /= max(1e-12, np.sqrt((centre**2).sum()))
        radius = float(np.arccos(np.clip(x @ centre, -1, 1)).max())
        n = rows.column("n").to_numpy()
        values = [comp, part << 32 | nth, rows.column("id").to_numpy().tobytes(), n.tobytes(), x.tobytes(), centre.tobytes(), radius, int(n.sum())]
        return pa.RecordBatch.from_pydict({c: [v] for c, v in zip(("comp", "shard", "ids", "many", "units", "centre", "radius", "weight"), values, strict=True)})

    for b in it:
        t = pa.Table.from_batches([b])
        rest = t if rest is None else pa.concat_tables([rest, t])
        comp = rest.column("comp").to_numpy()
        at = np.append(np.nonzero(np.append(True, comp[1:] != comp[:-1]))[0], len(comp)) if len(comp) else np.zeros(1, np.int64)
        done = 0
        for x, y in zip(at[:-1], at[1:], strict=True):
            last = y == len(comp)
            while x < y and (not last or y - x >= size):
                to = min(y, x + size)
                yield shard(int(comp[x]), rest.slice(x, to - x))
                x = to
            done = x
        rest = rest.slice(done)
    if rest is not None and rest.num_rows:
        yield shard(int(rest.column("comp")[0].as_py()), rest)


def _decided(angle: float, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of shards of which all members are near each other (decided), or some may be."""
    for b in it:
        apart = np.arccos(np.clip((_matrix(b.column("ca"), float) * _matrix(b.column("cb"), float)).sum(1), -1, 1))
        apart[b.column("a").to_numpy() == b.column("b").to_numpy()] = 0
        reach = b.column("ra").to_numpy() + b.column("rb").to_numpy()
        out = pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), b.column("wa"), b.column("wb"), pa.array(apart + reach <= angle - 1e-7)], ["a", "b", "wa", "wb", "decided"])
        yield out.filter(pa.array(apart - reach <= angle + 1e-7))


def _compared(threshold: float, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near weights of each member of two shards."""
    for b in it:
        for i in range(b.num_rows):
            row = {c: b.column(c)[i].as_py() for c in b.schema.names}
            na, nb = np.frombuffer(row["na"], np.int64), np.frombuffer(row["nb"], np.int64)
            near = np.frombuffer(row["ua"]).reshape(len(na), -1) @ np.frombuffer(row["ub"]).reshape(len(nb), -1).T >= threshold
            out = [(row["a"], (near @ nb).astype(np.int64).tobytes())]
            if row["a"] != row["b"]:
                out.append((row["b"], (na @ near).astype(np.int64).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out]), pa.array([x for _, x in out], pa.binary())], ["shard", "sums"])


def _totals(shards: pa.Table, sums: pa.Table) -> pa.Table:
    ids = np.frombuffer(shards.column("ids")[0].as_py(), np.int64) if shards.num_rows else np.zeros(0, np.int64)
    total = np.full(len(ids), shards.column("all")[0].as_py() if shards.num_rows else 0)
    for x in sums.column("sums").to_pylist():
        total = total + np.frombuffer(x, np.int64)
    return pa.table({"id": pa.array(ids), "near": pa.array(total.astype(np.int64))})


def count_near(members: DataFrame, threshold: float, angle_planes: np.ndarray) -> DataFrame:
    """(id, near) of members (comp, id, n, unit): how many vectors of its component are near each, itself included; stored."""

    def along(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            side = _matrix(b.column("unit"), float) @ angle_planes
            bucket = (side[:, :-1] > 0) @ (1 << np.arange(side.shape[1] - 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bucket.astype(np.int64)), pa.array(side[:, -1])], [*b.schema.names, "bucket", "along"])

    key = ["comp", "bucket", "along", "id"]
    placed = members.select("comp", "id", "n", "unit").mapInArrow(along, "comp long, id long, n long, unit binary, bucket long, along double")
    shards = stored(placed.repartitionByRange(*key).sortWithinPartitions(*key).drop("bucket", "along").mapInArrow(partial(_shards, SHARD), "comp long, shard long, ids binary, many binary, units binary, centre binary, radius double, weight long"))
    head = lambda x: shards.select("comp", F.col("shard").alias(x), F.col("centre").alias(f"c{x}"), F.col("radius").alias(f"r{x}"), F.col("weight").alias(f"w{x}"))
    pairs = head("a").join(head("b"), "comp").where("a <= b").mapInArrow(partial(_decided, float(np.arccos(threshold))), "a long, b long, wa long, wb long, decided boolean")
    pairs = stored(pairs)
    whole = pairs.where("decided").select(F.explode(F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("shard"), F.col("wb").alias("w")))).otherwise(F.array(F.struct(F.col("a").alias("shard"), F.col("wb").alias("w")), F.struct(F.col("b").alias("shard"), F.col("wa").alias("w"))))).alias("x"))
    whole = whole.groupBy("x.shard").agg(F.sum("x.w").alias("all"))
    full = lambda x: shards.select(F.col("shard").alias(x), F.col("many").alias(f"n{x}"), F.col("units").alias(f"u{x}"))
    sums = pairs.where("NOT decided").select("a", "b").join(full("a"), "a").join(full("b"), "b").mapInArrow(partial(_compared, threshold), "shard long, sums binary")
    own = shards.select("shard", "ids").join(whole, "shard", "left").withColumn("all", F.coalesce("all", F.lit(0)))
    out = stored(own.groupBy("shard").cogroup(sums.groupBy("shard")).applyInArrow(_totals, "id long, near long"))
    forget(shards, pairs)
    return out


def audit(reps: DataFrame, counted: DataFrame, threshold: float) -> float:
    """Recall of (id, near) against brute force for `SAMPLE` vectors of least id hash."""
    few = reps.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(SAMPLE).select("id", "unit").collect()  # at most SAMPLE rows
    names = np.array([r["id"] for r in few])
    x = np.array([np.frombuffer(r["unit"]) for r in few])

    def fn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(names), np.int64)
        for b in it:
            total += ((x @ _matrix(b.column("unit"), float).T >= threshold) @ b.column("n").to_numpy()).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total)], ["id", "true"])

    truth = reps.select("n", "unit").mapInArrow(fn, "id long, true long").groupBy("id").agg(F.sum("true").alias("true"))
    both = truth.join(reps.select("id", "n"), "id").join(counted, "id", "left")
    found, true = both.agg(F.sum(F.coalesce("near", "n") - F.col("n")), F.sum(F.col("true") - F.col("n"))).first()
    return found / true if true else 1.0


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.99, turns: int = 3, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of each vector; more turns while the audited recall is below `recall`."""
    own = vectors.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    ok = valid(F.col("vec")) & F.exists("vec", lambda x: x != 0)
    hashed = own.withColumns({"k1": F.when(ok, F.xxhash64("vec")), "k2": F.when(ok, F.xxhash64(F.lit(7), "vec"))})
    keys = stored(hashed.select("id", "k1", "k2"))
    classes = stored(hashed.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.any_value("vec").alias("vec")))
    again = classes.groupBy("rep").count().where("count > 1").select("rep", F.lit(True).alias("again"))  # an id of several vectors
    classed = classes.join(again, "rep", "left").withColumn("id", F.when(F.col("again"), F.col("k1")).otherwise(F.col("rep")))
    n, dim = classes.agg(F.count("*"), F.max(F.size("vec"))).first()
    dim = dim or 1
    reps = stored(classed.select("id", "n", "vec").mapInArrow(partial(_units, dim), "id long, n long, unit binary, code binary"))
    graph = None
    for turn in range(turns):
        offers = first_graph(reps, dim, n, turn)
        if graph is not None:
            offers = offers.unionByName(graph.select("u", "v", "s", F.lit(False).alias("fresh")))
        before, graph = graph, _best(offers, None if graph is None else graph.groupBy("u").agg(F.max("width").alias("width")))
        if before is not None:
            forget(before)
        graph = descend(graph, reps, threshold)
        pairs = links(graph, reps, threshold)
        ends = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct())
        labels = contract(ends.select("doc", F.col("doc").alias("comp")), pairs.select("a", "b"))
        wide = _lists(graph, threshold - MARGIN).where("full").select(F.col("u").alias("doc"))
        dense = stored(labels.join(wide, "doc", "left_semi").select("comp").distinct())
        inside = labels.join(dense, "comp", "left_semi")
        members = inside.join(reps.withColumnRenamed("id", "doc"), "doc").select("comp", F.col("doc").alias("id"), "n", "unit")
        ranged = None if dense.isEmpty() else count_near(members, threshold, np.random.default_rng(99).normal(size=(dim, 9)))
        both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        listed = both.join(reps.select(F.col("id").alias("b"), "n"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
        counted = listed.join(inside.select(F.col("doc").alias("id")), "id", "left_anti").join(reps.select("id", "n"), "id").select("id", (F.col("others") + F.col("n")).alias("near"))
        near = stored(counted if ranged is None else counted.unionByName(ranged))
        done = turn + 1 == turns or audit(reps, near, threshold) >= recall
        forget(pairs, dense, *([] if ranged is None else [ranged]))
        if done:
            break
        forget(near, labels, ends)
    told = classed.select("k1", "k2", "id", "rep", "n").join(near, "id", "left").join(labels.withColumnRenamed("doc", "id"), "id", "left")
    least = told.where("comp IS NOT NULL").groupBy("comp").agg(F.min("rep").alias("least"))
    told = told.join(least, "comp", "left").select("k1", "k2", (F.coalesce("near", "n") - 1).alias("others"), F.coalesce("least", "rep").alias("comp"))
    component = F.coalesce("comp", "id")
    named = keys.join(told, ["k1", "k2"], "left")
    out = stored(named.select(F.col("id").alias("vec_id"), F.coalesce("others", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept")))
    forget(keys, classes, reps, graph, near, labels, ends)
    return out
