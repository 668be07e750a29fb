"""Operator 3, exact top-k inner-product search with ball trees.

1. Cells.  At most `PIVOTS` vectors, those of the least id hashes, are pivots; a
   vector's cell is its nearest pivot.  A cell of more than `shard_rows` vectors
   is split by the hash of the id, so a vector that a third of all rows repeat
   fills many shards.  Each shard becomes one row: its vectors, ordered by a
   ball tree, and the tree's nodes; the root ball is the shard's head.
2. Seeds.  Each query searches one shard, that of the highest product with the
   head's centre, and so gets its first k-th score.
3. The rest.  A query goes to a shard only if <q, centre> + |q| * radius of its
   head reaches the k-th score, which travels with it: first the
   `NEXT` best of them, whose results raise the score, then those that are left.
   A shard's queries come in salted blocks of `block_rows`.
4. The best k of all partial results of a query.

In a tree a node's bound is that of its ball.  The set of queries still active
at a node shrinks on the way down, and each query visits the child of the
higher bound first.  A node whose bound equals the k-th score is still visited:
a tie may go to a smaller id.  Scores are integer inner products, exact: matrix
products in doubles where they stay below 2**53, else Python integers.

A task holds one shard and one block of its queries at a time.  Heads reach the
tasks in lots of `HEADS`, one after another, whatever their number.

Defined cases: vectors that are null, empty, or hold null or non-finite
components take no part; shorter vectors count as filled up with zeros; ties go
to the smaller id; a query is no candidate of its own (by id); fewer candidates
than k give fewer rows; an empty table gives none.  Rows with a null id take no
part.  A repeated id is one more candidate with that id for other queries; equal
rows that ask are one query.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import forget, stored

LEAF = 128
PIVOTS = 256
#: Shards that a query searches before the rest, and heads that a task gets at once.
NEXT = 3
HEADS = 8192


def valid(vec: Column) -> Column:
    return vec.isNotNull() & (F.size(vec) > 0) & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))


def quantised(vec: Column, scale: float = 64.0) -> Column:
    return F.transform(vec, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def build_tree(x: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]], np.ndarray, np.ndarray]:
    """Order of the rows; nodes (start, end, left, right); centres; radii."""
    order = np.arange(len(x))
    nodes, centres, radii = [], [], []

    def add(a: int, b: int) -> int:
        own = x[order[a:b]]
        c = own.mean(0)
        d = np.sqrt(((own - c) ** 2).sum(1))
        k = len(nodes)
        nodes.append((a, b, -1, -1))
        centres.append(c)
        radii.append(float(d.max()))
        return k

    todo = [add(0, len(x))]
    while todo:
        k = todo.pop()
        a, b, _, _ = nodes[k]
        if b - a <= LEAF or radii[k] == 0:
            continue
        own = x[order[a:b]]
        p = own[np.argmax(((own - centres[k]) ** 2).sum(1))]
        q = own[np.argmax(((own - p) ** 2).sum(1))]
        side = own @ (q - p)
        half = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(side, half)]
        left, right = add(a, a + half), add(a + half, b)
        nodes[k] = (a, b, left, right)
        todo += [left, right]
    return order, nodes, np.array(centres), np.array(radii)


class Search:
    """The best k of each query of a block, of scores that reach its floor."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.norm = np.sqrt((q.astype(float) ** 2).sum(1))
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]
        self.kth = floor.astype(float)

    def visit(self, ids: np.ndarray, x: np.ndarray, nodes, centres, radii) -> None:
        q = self.q.astype(float)
        wide = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1] >= 2**52
        xs = x.astype(object) if wide else x.astype(float)
        qs = self.q.astype(object) if wide else q
        bounds = _bounds(q, self.norm, centres, radii)
        todo = [(0, np.arange(len(self.ids)))]
        while todo:
            k, act = todo.pop()
            act = act[bounds[act, k] >= self.kth[act]]
            if not len(act):
                continue
            a, b, left, right = nodes[k]
            if left < 0:
                self.take(act, ids[a:b], qs[act] @ xs[a:b].T)
                continue
            first = bounds[act, left] >= bounds[act, right]
            todo += [(right, act[first]), (left, act[~first]), (right, act[~first]), (left, act[first])]

    def take(self, act: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        r, c = np.nonzero((scores >= self.kth[act][:, None]) & (ids[None, :] != self.ids[act][:, None]))
        if not len(r):
            return
        s = scores[r, c]
        for i in np.unique(r):
            lo, hi = np.searchsorted(r, i), np.searchsorted(r, i, "right")
            own = self.best[act[i]]
            own += [(-int(v), int(d)) for v, d in zip(s[lo:hi], ids[c[lo:hi]], strict=True)]
            own.sort()
            del own[self.k :]
            if len(own) == self.k:
                self.kth[act[i]] = max(self.kth[act[i]], -own[-1][0])


def _bounds(q: np.ndarray, norm: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Upper bounds of the products of queries with what lies in balls."""
    out = q @ centres.T + norm[:, None] * radii
    return out + 1e-6 + 1e-9 * np.abs(out)  # against rounding: never below the true bound


def _matrix(column, dim: int) -> np.ndarray:
    """Arrays of `dim` numbers as rows."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _packed(dim: int):
    """One row of all rows of a shard."""

    def fn(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        ids, x = t.column("id").to_numpy(), _matrix(t.column("vec"), dim)
        by_id = np.argsort(ids, kind="stable")
        ids, x = ids[by_id], x[by_id]
        order, nodes, centres, radii = build_tree(x.astype(float))
        return pa.table({
            "part": pa.array([key[0].as_py()], pa.int32()), "ids": [ids[order].tobytes()], "vecs": [x[order].tobytes()], "nodes": [np.array(nodes, np.int32).tobytes()],
            "centres": [centres.astype(float).tobytes()], "radii": [radii.astype(float).tobytes()], "centre": [centres[0].astype(float).tobytes()], "radius": pa.array([float(radii[0])]),
        })

    return fn


PACKED = "part int, ids binary, vecs binary, nodes binary, centres binary, radii binary, centre binary, radius double"
FOUND = "query_id long, twin long, vec_id long, score long"


def _searched(packed: DataFrame, pairs: DataFrame, dim: int, k: int, block_rows: int) -> DataFrame:
    """Partial results of pairs (part, id, twin, vec, floor): what of a shard reaches a query's floor, k at most; stored."""
    sizes = pairs.groupBy("part").agg((F.floor((F.count("*") - 1) / block_rows) + 1).cast("int").alias("salts"))
    shards = packed.drop("centre", "radius").join(sizes, "part").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    own = pairs.join(sizes.select("part", F.col("salts").alias("of")), "part")
    blocks = own.select("part", "id", "twin", "vec", "floor", F.pmod(F.xxhash64("id", "twin"), F.col("of")).cast("int").alias("salt"))

    def fn(shard: pa.Table, asks: pa.Table) -> pa.Table:
        cols = [[], [], [], []]
        if shard.num_rows and asks.num_rows:
            row = {c: shard.column(c)[0].as_py() for c in ("ids", "vecs", "nodes", "centres", "radii")}
            s = Search(asks.column("id").to_numpy(), _matrix(asks.column("vec"), dim), asks.column("floor").to_numpy(), k)
            s.visit(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vecs"], np.int64).reshape(-1, dim), np.frombuffer(row["nodes"], np.int32).reshape(-1, 4), np.frombuffer(row["centres"]).reshape(-1, dim), np.frombuffer(row["radii"]))
            found = [(int(q), int(t), d, -score) for q, t, best in zip(s.ids, asks.column("twin").to_numpy(), s.best, strict=True) for score, d in best]
            cols = list(zip(*found, strict=True)) or cols
        return pa.table([pa.array(c, pa.int64()) for c in cols], ["query_id", "twin", "vec_id", "score"])

    return stored(shards.groupBy("part", "salt").cogroup(blocks.groupBy("part", "salt")).applyInArrow(fn, FOUND))


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id", "twin").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vec: str = "embedding", shard_rows: int = 8192, block_rows: int = 1024, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each query."""
    spark = vectors.sparkSession
    own = vectors.where(F.col(vec_id).isNotNull() & valid(F.col(vec))).select(F.col(vec_id).cast("long").alias("id"), quantised(F.col(vec), scale).alias("vec"), is_query.alias("asks"))
    n, dim = (int(x or 0) for x in own.agg(F.count("*"), F.max(F.size("vec"))).first())
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    own = own.withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("vec"))))
    few = own.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(min(PIVOTS, -(-n // shard_rows))).select("vec").collect()  # at most PIVOTS rows
    pivots = np.array([r["vec"] for r in few], float)

    def nearest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square = (pivots**2).sum(1)
        for b in it:
            x = _matrix(b.column("vec"), dim).astype(float)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vec"), pa.array((square - 2 * (x @ pivots.T)).argmin(1).astype(np.int32))], ["id", "vec", "cell"])

    dealt = stored(own.select("id", "vec").mapInArrow(nearest, "id long, vec array<long>, cell int"))
    counts = {r["cell"]: -(-r["count"] // shard_rows) for r in dealt.groupBy("cell").count().collect()}  # at most PIVOTS rows
    first = np.cumsum([0, *counts.values()])
    # cells are few, so their shards' numbers fit into the plan
    base = F.create_map(*[F.lit(int(v)) for pair in zip(counts, first, strict=False) for v in pair])[F.col("cell")]
    many = F.create_map(*[F.lit(int(v)) for pair in counts.items() for v in pair])[F.col("cell")]
    part = (base + F.pmod(F.xxhash64("id", F.lit(11)), many)).cast("int")
    packed = stored(dealt.select(part.alias("part"), "id", "vec").groupBy("part").applyInArrow(_packed(dim), PACKED))
    forget(dealt)
    asks = stored(own.where("asks").select("id", F.xxhash64("vec").alias("twin"), "vec").dropDuplicates(["id", "twin"]))
    lots = range(0, int(first[-1]), HEADS)

    def heads(lo: int):
        rows = packed.where((F.col("part") >= lo) & (F.col("part") < lo + HEADS)).select("part", "centre", "radius").collect()  # at most HEADS rows
        return np.array([r["part"] for r in rows], np.int32), np.array([np.frombuffer(r["centre"]) for r in rows]).reshape(-1, dim), np.array([r["radius"] for r in rows])

    def offered(lo: int, queries: DataFrame, most: int | None) -> DataFrame:
        """part, id, twin, vec, floor and bound: the shards of a lot that may beat a query's floor; with `most`, the best so many.

        most = 0 asks for the one shard whose centre is best, whatever its bound.
        """
        shared = spark.sparkContext.broadcast(heads(lo))

        def fn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts, centres, radii = shared.value
            for big in it:
                for at in range(0, big.num_rows, 256):
                    b = big.slice(at, 256)
                    q = _matrix(b.column("vec"), dim).astype(float)
                    floor, done = b.column("floor").to_numpy(), b.column("done").to_pylist()
                    bound = q @ centres.T if most == 0 else _bounds(q, np.sqrt((q**2).sum(1)), centres, radii)
                    open_ = np.ones(bound.shape, bool) if most == 0 else bound >= floor[:, None]
                    for i, own in enumerate(done):
                        open_[i] &= ~np.isin(parts, own)
                    bound = np.where(open_, bound, -np.inf)
                    if most is not None and bound.shape[1] > max(1, most):
                        cut = -np.partition(-bound, max(1, most) - 1, 1)[:, max(1, most) - 1]
                        open_ &= bound >= cut[:, None]
                    r, c = np.nonzero(open_)
                    rows = pa.array(r)
                    yield pa.RecordBatch.from_arrays([pa.array(parts[c]), *(b.column(x).take(rows) for x in ("id", "twin", "vec", "floor")), pa.array(bound[r, c])], ["part", "id", "twin", "vec", "floor", "bound"])

        return queries.mapInArrow(fn, "part int, id long, twin long, vec array<long>, floor double, bound double")

    def best(queries: DataFrame, most: int | None) -> DataFrame:
        every = [offered(lo, queries, most) for lo in lots]
        all_ = reduce(DataFrame.unionByName, every)
        if most is not None and len(every) > 1:
            w = Window.partitionBy("id", "twin").orderBy(F.desc("bound"), "part")
            all_ = all_.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= max(1, most)).drop("__r")
        return stored(all_.drop("bound"))

    found, gone, visited = [], [], None
    for most in (0, NEXT, None):
        floor = F.lit(float("-inf"))
        queries = asks.withColumn("floor", floor).withColumn("done", F.array().cast("array<int>"))
        if visited is not None:
            so_far = _top(reduce(DataFrame.unionByName, found), k).groupBy("query_id", "twin").agg(F.min(F.when(F.col("rank") == k, F.col("score"))).cast("double").alias("floor"))
            seen = visited.groupBy("id", "twin").agg(F.collect_set("part").alias("done"))  # NEXT + 1 and ties at most
            told = asks.join(so_far.withColumnRenamed("query_id", "id"), ["id", "twin"], "left").join(seen, ["id", "twin"], "left")
            queries = stored(told.select("id", "twin", "vec", F.coalesce("floor", floor).alias("floor"), F.coalesce("done", F.array().cast("array<int>")).alias("done")))
            gone.append(queries)
        pairs = best(queries, most)
        gone.append(pairs)
        found.append(_searched(packed, pairs, dim, k, block_rows))
        own_parts = pairs.select("id", "twin", "part")
        visited = own_parts if visited is None else visited.unionByName(own_parts)
    result = stored(_top(reduce(DataFrame.unionByName, found), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
    forget(packed, asks, *gone, *found)
    return result
