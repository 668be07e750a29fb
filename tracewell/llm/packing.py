"""Operator 2, best-fit packing of tokenised documents into fixed sequences.

`tokenise` cuts each document's ids (with a closing id) into pieces of at most
`capacity`.  How well pieces pack depends on their lengths alone, so `plan`
works on the number of pieces of each length (at most `capacity` numbers,
whatever the corpus size):

* pieces above a third of the capacity fit at most twice in a sequence; they
  are matched greedily, the longest left with the longest that still fits;
* the others, from long to short, best-fit the smallest gap that takes them,
  and open new sequences only where no gap does.

Equal moves are made for all sequences of a kind at once, so the plan is a
list of slots (length, first rank, count, first sequence, offset) whose size
depends on the capacity only.  A piece finds its slot by its rank among the
pieces of its length.  Ranks are counted in hash buckets of a length, so a
length that a third of all pieces share is spread over all tasks.

Defined cases: null and empty texts are one piece with the closing id alone.
Repeated rows are packed like any others.  An empty table gives no rows.
`tokenise` returns its own columns only; `pack` keeps the columns of pieces,
but replaces those named sequence_id or offset.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm import bpe
from tracewell.llm.common import fresh, slices, stored

CLOSE = 0
BATCH_BYTES = 4 << 20


def tokenise(docs: DataFrame, path: str, capacity: int = 2048, text: str = "text", doc_id: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and (with_ids) the ids of each piece."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it, text, BATCH_BYTES):
            ids, ends = bpe.word_coder(path).batch(b.column(text))
            begins = np.append(0, ends[:-1]) if len(ends) else ends
            rows, piece, start, length, crc, raw = [], [], [], [], [], []
            for i, (x, y) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True)):
                own = np.append(ids[x:y], np.uint32(CLOSE)).astype("<u4").tobytes()
                n = y - x + 1
                for k, a in enumerate(range(0, n, capacity)):
                    part = own[4 * a : 4 * (a + capacity)]
                    rows.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(len(part) >> 2)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        raw.append(part)
            cols = [b.column(doc_id).take(pa.array(rows, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = [doc_id, "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(raw, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    schema = f"`{doc_id}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(doc_id, text).mapInArrow(batches, schema)


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Slots (length, first rank, count, first sequence, offset), and the sequences used."""
    left = {n: c for n, c in counts.items() if c}
    slots, used, ranks = [], 0, defaultdict(int)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (first sequence, count)
    sizes: list[int] = []

    def put(n: int, count: int, seq: int, offset: int) -> None:
        slots.append((n, ranks[n], count, seq, offset))
        ranks[n] += count
        left[n] -= count

    def leave(gap: int, seq: int, count: int) -> None:
        if gap and count:
            if not gaps[gap]:
                insort(sizes, gap)
            gaps[gap].append((seq, count))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        if not left[n]:
            large.pop()
            continue
        k = bisect_left(large, capacity - n + 1) - 1
        while k >= 0 and left[large[k]] < 1 + (large[k] == n):
            k -= 1
        if k < 0:
            count = left[n]
            put(n, count, used, 0)
            leave(capacity - n, used, count)
        else:
            m = large[k]
            count = min(left[n], left[m]) if m != n else left[n] // 2
            put(n, count, used, 0)
            put(m, count, used, n)
            leave(capacity - n - m, used, count)
            large = [x for x in large if left[x]] if not left[m] else large
        used += count
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            k = bisect_left(sizes, n)
            if k == len(sizes):
                gap, seq, count = capacity, used, -(-left[n] // (capacity // n))
                used += count
            else:
                gap = sizes[k]
                seq, count = gaps[gap].pop()
                if not gaps[gap]:
                    sizes.pop(k)
            each = gap // n
            full = min(count, left[n] // each)
            offset = capacity - gap
            for i in range(each if full else 0):
                put(n, full, seq, offset + i * n)
            leave(gap - each * n, seq, full)
            rest = min(left[n], each - 1) if full < count else 0
            for i in range(rest):
                put(n, 1, seq + full, offset + i * n)
            if rest:
                leave(gap - rest * n, seq + full, 1)
                full += 1
            leave(gap, seq + full, count - full)
    out = np.array(slots, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))], used


def pack(pieces: DataFrame, capacity: int = 2048, key: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Add sequence_id and offset to pieces, which must be the same on each read.

    pieces has the column length, 1 to capacity; key tells its rows apart.
    """
    spark = pieces.sparkSession
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    bucket, rank, before, n = (fresh(pieces, x) for x in ("__bucket", "__rank", "__before", "__n"))
    own = pieces.select(*names, F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int").alias(bucket))
    tally = stored(own.groupBy("length", bucket).agg(F.count("*").alias(n)))
    counts = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum(n).alias("n")).collect()}  # at most `capacity` rows
    slots, _ = plan(counts, capacity)
    ahead = tally.select("length", bucket, (F.sum(n).over(Window.partitionBy("length").orderBy(bucket)) - F.col(n)).alias(before))
    within = F.row_number().over(Window.partitionBy("length", bucket).orderBy(*key)) - 1
    ranked = own.withColumn(rank, within).join(ahead, ["length", bucket]).withColumn(rank, F.col(rank) + F.col(before))
    keys = slots[:, 0] << 44 | slots[:, 1]
    schema = pieces.select(*names).schema.add("sequence_id", "long").add("offset", "long")

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            nth = b.column(rank).to_numpy()
            s = slots[np.searchsorted(keys, b.column("length").to_numpy() << 44 | nth, "right") - 1]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(s[:, 3] + nth - s[:, 1]), pa.array(s[:, 4])], [*names, "sequence_id", "offset"])

    return ranked.select(*names, rank).mapInArrow(place, schema)
