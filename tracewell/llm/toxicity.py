"""Operator 9, toxicity: a factorization machine over hashed terms.

Terms are a text's lower-case words and their first 4, 5 and 6 bytes (stems of
inflected forms), hashed to 2**20 numbers; a text has a term or not.  The model
is w0 + sum(w_i) + sum over pairs of <v_i, v_j>, so that two terms together,
such as an insult and a mention of a group, can weigh more than each alone.

`fit` takes at most `sample` labelled rows, chosen by the hash of their id, and
of these, in that order, as many as have at most `most_terms` terms in all, so
what reaches the driver is bounded.  All their terms come into the machine;
none is dropped, as terms that tell nothing alone may tell the classes apart
as a pair.  AdaGrad fits it in two turns: `epochs` over the terms that a
log-likelihood ratio above `telling` sets apart, then `further` over all terms,
which learn what the first turn leaves over; terms in less than a hundredth of
the rows take the smaller steps the rarer they are.  The model has a fixed size
whatever the corpus; `score` applies it batch by batch without a shuffle, over
whole texts.

Defined cases: null and empty texts have no terms and score sigmoid(w0);
without a usable label of both classes every score is the share of label 1 (0
if there are no labels).  Null labels and ids are left out of training; of
repeated labels the larger counts.  Repeated rows are scored alike; an empty
table gives no rows.  Other columns pass through, one named as the output is
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm import hashing
from tracewell.llm.bpe import lowered
from tracewell.llm.common import forget, slices, stored

BITS = 20
PREFIXES = (4, 5, 6)
LETTER = np.zeros(256, bool)
LETTER[0x80:] = LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = True
BATCH_BYTES = 1 << 20


@dataclass
class Model:
    place: np.ndarray  # term -> feature; 0 for terms not seen, whose weights are 0
    w0: float
    w: np.ndarray
    v: np.ndarray


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, term) pairs, not yet distinct."""
    data, ends = hashing.flat(texts)
    data = lowered(data)
    starts, stops = hashing.runs(LETTER[data], ends)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    p = hashing.Prefix(data)
    text = hashing.owner(starts, ends)
    who, what = [text], [p.of(starts, stops)]
    for n in PREFIXES:
        own = stops - starts >= n
        who.append(text[own])
        what.append(p.of(starts[own], starts[own] + n) + hashing.U(n))
    return np.concatenate(who), (hashing.mix(np.concatenate(what)) >> hashing.U(64 - BITS)).astype(np.int64)


def _ratio(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> np.ndarray:
    """Log-likelihood ratio of each term's presence in two classes."""

    def part(k, n, p):
        return np.where(k > 0, k * np.log(np.maximum(k, 1e-12) / np.maximum(n * p, 1e-12)), 0)

    p = (a + b) / (na + nb)
    return 2 * (part(a, na, p) + part(b, nb, p) + part(na - a, na, 1 - p) + part(nb - b, nb, 1 - p))


def train(docs: list[np.ndarray], y: np.ndarray, factors: int = 4, epochs: int = 25, further: int = 20, telling: float = 15.0, seed: int = 7) -> Model:
    """A machine from the distinct terms and the label (0 or 1) of each row."""
    place = np.zeros(1 << BITS, np.int32)
    share = float(y.mean()) if len(y) else 0.0
    if not 0 < share < 1:
        return Model(place, 30.0 if share else -30.0, np.zeros(1, np.float32), np.zeros((1, factors), np.float32))
    count = np.zeros((2, 1 << BITS), np.int32)
    for d, own in zip(docs, y, strict=True):
        count[int(own), d] += 1
    seen = np.nonzero(count.sum(0))[0]
    place[seen] = np.arange(1, len(seen) + 1)
    b, a = count[:, seen].astype(float)
    del count
    tells = np.append(False, (_ratio(a, b, int((y == 1).sum()), int((y == 0).sum())) > telling) & (a + b >= 3))
    pace = np.where(tells, 1.0, np.append(0, np.minimum(1.0, (a + b) / (0.01 * len(y))) ** 2))
    rng = np.random.default_rng(seed)
    w0, w = float(np.log(share / (1 - share))), np.zeros(len(pace))
    v = rng.normal(0, 0.02, (len(w), factors)) * np.sqrt(pace)[:, None]
    # a term that tells nothing alone starts with a small step, which only a steady slope makes count
    g0, gw, gv = 1e-6, np.where(tells, 1e-6, 1.0), np.repeat(np.where(tells, 1e-6, 1e-2)[:, None], factors, 1)

    def numbered(rows: np.ndarray, many: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, ...]:
        """A mini-batch: rows, rows that have terms, where each one's begin, the distinct terms, and the terms' numbers among them."""
        names, inverse = np.unique(terms, return_inverse=True)
        some = many > 0
        return rows, some, (np.cumsum(many) - many)[some], names, inverse.astype(np.int32)

    every, telling_ones, docs = [], [], list(docs)
    for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // 256)):
        own = [place[docs[i]] for i in rows]
        for i in rows:
            docs[i] = None  # its memory is needed for the batch
        for into, kept in ((every, own), (telling_ones, [t[tells[t]] for t in own])):
            into.append(numbered(rows, np.array([len(t) for t in kept]), np.concatenate(kept)))
    for batches, turns in ((telling_ones, epochs), (every, further)):
        for _ in range(turns):
            for k in rng.permutation(len(batches)):
                rows, some, at, names, inverse = batches[k]
                z = np.full(len(rows), w0)
                if len(at):
                    many = np.diff(np.append(at, len(inverse)))
                    vx = v[names][inverse]
                    s = np.add.reduceat(vx, at)
                    z[some] += np.add.reduceat(w[names][inverse], at) + 0.5 * ((s**2).sum(1) - np.add.reduceat((vx**2).sum(1), at))
                d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
                if len(at):
                    by = np.repeat(d[some], many)
                    sums = lambda x: np.bincount(inverse, x, len(names))  # noqa: B023, E731
                    dw = sums(by) + 1e-5 * w[names]
                    dv = np.stack([sums(by * (np.repeat(s[:, f], many) - vx[:, f])) for f in range(factors)], 1) + 1e-4 * v[names]
                    gw[names] += dw**2
                    gv[names] += dv**2
                    w[names] -= 0.2 * pace[names] * dw / np.sqrt(gw[names])
                    v[names] -= 0.05 * pace[names][:, None] * dv / np.sqrt(gv[names])
                g0 += d.sum() ** 2
                w0 -= 0.1 * d.sum() / np.sqrt(g0)
    return Model(place, w0, w.astype(np.float32), v.astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", doc_id: str = "doc_id", sample: int = 12_000, most_terms: int = 10_000_000, **how) -> Model:
    """A model from at most `sample` labelled rows and `most_terms` terms; labels: doc_id and label (0 or 1)."""
    own = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).groupBy(doc_id).agg(F.max(label).alias("__y"))
    turn = F.xxhash64(F.col(doc_id).cast("string"))
    own = own.orderBy(turn, doc_id).limit(sample).withColumn("__turn", turn)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it, "__text", BATCH_BYTES):
            who, what = terms(b.column("__text"))
            pairs = np.unique(who << BITS | what)
            ends = np.searchsorted(pairs >> BITS, np.arange(b.num_rows), "right")
            found = (pairs & ((1 << BITS) - 1)).astype("<u4")
            yield pa.RecordBatch.from_arrays([pa.array([found[x:y].tobytes() for x, y in zip(np.append(0, ends[:-1]), ends, strict=True)], pa.binary()), b.column("__y"), b.column("__turn")], ["terms", "y", "turn"])

    # The sample is at most `sample` rows of three numbers, so it may be broadcast.
    rows = docs.select(doc_id, F.col(text).alias("__text")).join(F.broadcast(own), doc_id).select("__text", F.col("__y").cast("int").alias("__y"), "__turn")
    found = stored(rows.mapInArrow(batches, "terms binary, y int, turn long"))
    # a window over the sample's sizes only
    sizes = found.select("turn", F.octet_length("terms").alias("n")).groupBy("turn").agg(F.sum("n").alias("n")).select("turn", F.sum("n").over(Window.orderBy("turn")).alias("upto"))
    got = found.join(F.broadcast(sizes.where(F.col("upto") <= 4 * most_terms)), "turn").orderBy("turn", "y", "terms").toArrow()
    forget(found)
    y, raw = got.column("y").to_numpy(), got.column("terms").to_pylist()
    del got
    return train([np.frombuffer(raw.pop(), "<u4") for _ in range(len(raw))][::-1], y, **how)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add the probability `out` of label 1."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded: 2**BITS places and weights
    rest = [c for c in docs.columns if c.lower() != out.lower()]
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField(out, T.DoubleType())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        square = (m.v**2).sum(1)
        for b in slices(it, text, BATCH_BYTES):
            who, what = terms(b.column(text))
            at = m.place[what]
            pairs = np.unique((who << BITS | at)[at > 0])
            who, at = pairs >> BITS, pairs & ((1 << BITS) - 1)
            n = b.num_rows
            add = lambda x: np.bincount(who, x[at], n)  # noqa: B023, E731
            z = m.w0 + add(m.w) - 0.5 * add(square)
            for f in range(m.v.shape[1]):
                z += 0.5 * add(m.v[:, f]) ** 2
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], [*rest, out])

    return docs.mapInArrow(batches, schema)


def held_out(doc_id):
    """Rows kept from training: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0
