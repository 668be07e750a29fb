"""Operator 4, removal of repeated byte strings by prefix-free parsing.

Removed is every byte covered by a string of `size` bytes that also starts in
a document with a smaller id; strings are judged on the input.

1. Dealing.  A rolling hash over `TRIGGER` bytes gives each `size`-byte window
   its anchor, the leftmost least hash in it.  Windows in a row with the same
   anchor form a run (their bytes overlap into the next run, so no window is
   lost between two).  Equal windows have equal anchors, wherever they are; so
   windows can only repeat between runs of the same anchor, and the corpus
   falls into buckets of runs that can be judged apart.
2. Whole copies.  Runs meet at their anchor's hash bucket.  A run of which a
   smaller document has an equal copy is repeated as a whole; what is left is
   one holder of each distinct run.  A window reaches from its anchor at least
   half of the other bytes to the left, or more than the rest to the right, and
   brings those bytes along; so the windows of a run fall into a left and a
   right piece, and a piece can only share a window with one whose anchor has
   the same bytes on that side.  Pieces whose side occurs in another document
   go on; all others are unique.
3. Prefix-free parsing of each bucket's pieces, dealt by their sides.  Every
   place whose rolling hash over `PARSE` bytes is 0 modulo `MODULUS` is a
   trigger; a phrase goes from one trigger to the end of the next.  The suffix
   array of the dictionary of distinct phrases and that of the parse (each
   piece as a sequence of phrases) come from prefix doubling; a window's place
   in corpus order is the rank of its phrase's suffix, then the rank of the
   parse that follows.  No suffix that ends in a trigger is a prefix of
   another, so this is the order of the bytes; neighbours that share `size`
   bytes form a class, whose least document keeps them.
4. Removal.  The repeated windows of each document are painted over its bytes.

Copies shrink before they travel: of equal runs in one batch only that of
the least document is sent.  Texts are shuffled twice, in buckets whose number
grows with the bytes of all texts; no task holds more than its bucket.  Runs
and marks travel sorted by document, as differences in the fewest bytes.
Stages are written to the shared folder and deleted after their last use, but
for the marks that the result reads.

Defined cases: null texts are empty; texts shorter than `size` lose nothing;
rows without an id lose nothing and repeat nothing.  An id names one document:
repeated rows of an id are no copies of one another.  Other columns pass
through unless named like an output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm import hashing
from tracewell.llm.common import fresh, giving_back, slices, stored

TRIGGER = 16
#: Bytes of a phrase trigger, and one in how many places is one.
PARSE, MODULUS = 8, 64
#: About so many bytes of text fall into a bucket of documents, and of pieces that go on into one of theirs.
BUCKET_BYTES, PIECE_BYTES = 8 << 20, 1 << 19
#: Bytes of text that a task hashes at once, and of which it sends the runs together.
SLICE_BYTES, BATCH_BYTES = 1 << 18, 4 << 20
MARKS = "dbucket int, n int, base long, docs binary, starts binary, wins binary, sides binary, kind int, bytes long"
WHOLE, OPEN = 0, 1
#: Columns that `remove` adds.
MADE = ("n_bytes", "n_removed", "n_spans", "kept", "removed")
MEETS, SETTLED = 0, 1


def runs(data: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """First window, windows of the left and of the right piece, anchor hash, hash, and left and right side of each run (0: no such piece)."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < size:
        return none, none, none, *[none.astype(np.uint64)] * 2, *[none.astype(np.uint32)] * 2
    p = hashing.Prefix(data)
    h = p.of(np.arange(n - TRIGGER + 1), np.arange(TRIGGER, n + 1))
    width = size - TRIGGER + 1
    m = n - size + 1
    # Sliding minimum by doubling; at[i] is the leftmost least hash in [i, i + reach).
    least, at, reach = h, np.arange(len(h), dtype=np.int32 if n < 2**31 else np.int64), 1
    while reach < width:
        step = min(reach, width - reach)
        k = len(least) - step
        right = least[step:] < least[:k]
        least = np.where(right, least[step:], least[:k])
        at = np.where(right, at[step:], at[:k])
        reach += step
    at = at[:m]
    inside = np.ones(m, bool)  # windows that do not run over a text's end
    edge = np.zeros(n + size + 1, np.int32)
    begins = np.append(0, ends[:-1])
    last = np.maximum(ends - size + 1, begins)  # first window of a text that does not fit
    np.add.at(edge, last, 1)
    np.add.at(edge, ends, -1)
    inside = np.cumsum(edge)[:m] == 0
    new = np.append(True, at[1:] != at[:-1])
    new[begins[begins < m]] = True
    new |= ~inside
    new[1:] |= ~inside[:-1]
    first = np.nonzero(new)[0]
    count = np.diff(np.append(first, m))
    own = inside[first]
    first, count = first[own], count[own]
    anchor = at[first].astype(np.int64)
    half = width // 2  # bytes left of the anchor that a window of the left piece has; one of the right piece has width - half bytes right of it
    left = np.clip(anchor - half + 1 - first, 0, count)
    sides = [np.zeros(len(first), np.uint32) for _ in range(2)]
    for side, own, x, y in ((sides[0], left > 0, anchor - half, anchor + TRIGGER), (sides[1], left < count, anchor, anchor + TRIGGER + width - half)):
        side[own] = (p.of(x[own], y[own]) >> hashing.U(32)).astype(np.uint32) | np.uint32(1)
    return first, left, count - left, h[at[first]], p.of(first, first + count + size - 1), *sides


def _dense(x: np.ndarray) -> bytes:
    return x.astype(np.min_scalar_type(x.max())).tobytes()


def _split(bucket: np.ndarray, docs: np.ndarray, starts: np.ndarray, dense: list[np.ndarray], plain: list[np.ndarray]) -> Iterator[tuple]:
    """Rows of each bucket: its number, how many, the least document, then binary columns, of numbers in the fewest bytes or as they are."""
    order = np.lexsort((starts, docs, bucket))
    names, at = np.unique(bucket[order], return_index=True)
    for b, x, y in zip(names, at, np.append(at, len(order))[1:], strict=True):
        o = order[x:y]
        d = docs[o].astype(np.int64).view(np.uint64)
        yield int(b), y - x, int(d[:1].view(np.int64)[0]), _dense(np.append(hashing.U(0), d[1:] - d[:-1])), _dense(starts[o]), *(_dense(c[o]) for c in dense), *(c[o].tobytes() for c in plain)


def _numbers(t: pa.Table, name: str) -> np.ndarray:
    """A column that _dense wrote."""
    return np.concatenate([np.frombuffer(x, f"<u{len(x) // n}").astype(np.int64) for x, n in zip(t.column(name).to_pylist(), t.column("n").to_pylist(), strict=True)] or [np.zeros(0, np.int64)])


def _docs(t: pa.Table) -> np.ndarray:
    out = [np.cumsum(np.frombuffer(x, f"<u{len(x) // n}"), dtype=np.uint64).view(np.int64) + base for x, n, base in zip(*(t.column(c).to_pylist() for c in ("docs", "n", "base")), strict=True)]
    return np.concatenate(out or [np.zeros(0, np.int64)])


def _dbucket(docs: np.ndarray, buckets: int) -> np.ndarray:
    d = docs.astype(np.int64)
    return (d ^ (d >> 7) ^ (d >> 15) ^ (d >> 31)) % buckets


def _sent(held: list[tuple], buckets: int, deal: int) -> pa.RecordBatch:
    """Of equal runs the one of the least document goes on; the others are settled."""
    trigger, phrase, left, right, doc, start, a, b = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((doc, phrase, trigger))
    same = np.append(False, (trigger[order][1:] == trigger[order][:-1]) & (phrase[order][1:] == phrase[order][:-1]))
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    own = doc[order] == doc[order][head]
    keep, gone = order[own], order[~own]
    rows = [(MEETS, *x) for x in _split((trigger[keep] % np.uint64(buckets)).astype(np.int64), doc[keep], start[keep], [a[keep], b[keep]], [phrase[keep], left[keep], right[keep]])]
    if len(gone):
        rows += [(SETTLED, *x, *[b""] * 4) for x in _split(_dbucket(doc[gone], deal), doc[gone], start[gone], [a[gone] + b[gone]], [])]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), [pa.int32()] * 3 + [pa.int64()] + [pa.binary()] * 7, strict=True)], [x.split()[0] for x in PARSED.split(", ")])


def _parse(size: int, buckets: int, deal: int):
    def fn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bytes_held = [], 0
        for b in slices(it, "text", SLICE_BYTES):
            data, ends = hashing.flat(b.column("text"))
            first, left, right, trigger, phrase, *sides = runs(data, ends, size)
            if len(first):
                text = hashing.owner(first, ends)
                held.append((trigger, phrase, *sides, b.column("doc_id").to_numpy()[text].astype(np.int64), first - np.append(0, ends[:-1])[text], left.astype(np.uint16), right.astype(np.uint16)))
                bytes_held += len(data)
            if bytes_held >= BATCH_BYTES:
                yield _sent(held, buckets, deal)
                held, bytes_held = [], 0
        if held:
            yield _sent(held, buckets, deal)

    return fn


PARSED = "sort int, bucket int, n int, base long, docs binary, starts binary, lefts binary, rights binary, phrase binary, left binary, right binary"


def _join(t: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(name).to_pylist()), kind)


def _marks(rows: list) -> pa.Table:
    """Rows of dbucket, n, base, docs, starts, wins, sides, kind and bytes."""
    names = [x.split() for x in MARKS.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.table([pa.array(c, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[kind]) for c, (_, kind) in zip(cols, names, strict=True)], [n for n, _ in names])


def _shared(side: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which sides occur in two documents."""
    if not len(side):
        return np.zeros(0, bool)
    _, group = np.unique(side, return_inverse=True)
    order = np.argsort(group, kind="stable")
    begins = np.nonzero(np.append(True, np.diff(group[order]) != 0))[0]
    return (np.minimum.reduceat(doc[order], begins) != np.maximum.reduceat(doc[order], begins))[group]


def _meet(size: int, deal: int):
    """Runs of a bucket: repeated as a whole, with pieces to go on, or unique."""

    def fn(t: pa.Table) -> pa.Table:
        doc, start, a, b = _docs(t), _numbers(t, "starts"), _numbers(t, "lefts"), _numbers(t, "rights")
        phrase, left, right = _join(t, "phrase", np.uint64), _join(t, "left", np.uint32), _join(t, "right", np.uint32)
        order = np.lexsort((doc, right, left, phrase))
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in (phrase, left, right, a, b)])
        head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        gone = doc[order] != doc[order][head]
        o, rest = order[gone], order[~gone]
        rows = [(*x, b"", WHOLE, 0) for x in _split(_dbucket(doc[o], deal), doc[o], start[o], [a[o] + b[o]], [])] if len(o) else []
        doc, start, a, b, left, right = (x[rest] for x in (doc, start, a, b, left, right))
        pieces = []
        for side, first, wins in ((left, start, a), (right, start + a, b)):
            own = np.nonzero(side)[0]
            own = own[_shared(side[own], doc[own])]
            pieces.append((doc[own], first[own], wins[own], side[own]))
        doc, start, wins, side = (np.concatenate(x) for x in zip(*pieces, strict=True))
        if len(doc):
            place = _dbucket(doc, deal)
            total = np.bincount(place, wins + size - 1)
            rows += [(*x, OPEN, int(total[x[0]])) for x in _split(place, doc, start, [wins], [side])]
        return _marks(rows)

    return fn


def _by_doc(marks: pa.Table) -> dict[int, tuple[np.ndarray, ...]]:
    """Starts, windows and, of pieces that go on, sides of each document."""
    doc, start, wins, side = _docs(marks), _numbers(marks, "starts"), _numbers(marks, "wins"), _join(marks, "sides", np.uint32)
    order = np.argsort(doc, kind="stable")
    names, at = np.unique(doc[order], return_index=True)
    cols = [x[order] for x in (start, wins, side) if len(x) == len(order)]
    return {int(k): tuple(c[x:y] for c in cols) for k, x, y in zip(names, at, np.append(at, len(order))[1:], strict=True)}


def _texts(size: int, buckets: int):
    """The bytes of the pieces that go on, dealt by their sides."""

    def fn(docs: pa.Table, marks: pa.Table) -> pa.Table:
        out, seen = [], set()
        wanted = _by_doc(marks)
        for i, doc in enumerate(docs.column("doc_id").to_pylist()):
            if doc not in wanted or doc in seen:
                continue
            seen.add(doc)
            raw = np.frombuffer(docs.column("text")[i].as_py().encode(), np.uint8)
            start, wins, side = wanted[doc]
            out.append((np.full(len(start), doc, np.int64), start, wins, side, [raw[a : a + w + size - 1] for a, w in zip(start.tolist(), wins.tolist(), strict=True)]))
        rows = []
        if out:
            doc, start, wins, side = (np.concatenate([x[i] for x in out]) for i in range(4))
            content = [c for x in out for c in x[4]]
            bucket = (side // np.uint32(2)).astype(np.int64) % buckets
            order = np.lexsort((start, doc, bucket))  # as _split has it
            names, at = np.unique(bucket[order], return_index=True)
            texts = [np.concatenate([content[i] for i in order[x:y]]).tobytes() for x, y in zip(at, np.append(at, len(order))[1:], strict=True)]
            rows = [(*x, c) for x, c in zip(_split(bucket, doc, start, [wins], []), texts, strict=True)]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        return pa.table([pa.array(c, kind) for c, kind in zip(cols, [pa.int32()] * 2 + [pa.int64()] + [pa.binary()] * 4, strict=True)], [x.split()[0] for x in CONTENT.split(", ")])

    return fn


CONTENT = "bucket int, n int, base long, docs binary, starts binary, wins binary, content binary"


def suffix_ranks(data: np.ndarray, size: int, ends: np.ndarray | None = None) -> np.ndarray:
    """Rank of each suffix by its first `size` bytes, by prefix doubling.

    A suffix ends where its string does (ends: of strings that lie one after
    another; else data is one); ends come before all bytes.  Equal ones share a
    rank, and ranks are in byte order.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    ends = np.array([n]) if ends is None else ends
    left = np.repeat(ends, np.diff(np.append(0, ends))) - np.arange(n)
    symbol = np.append(data.astype(np.uint64) + np.uint64(1), np.zeros(size + 7, np.uint64))
    depth = min(7, size)
    key = np.zeros(n, np.uint64)
    for i in range(depth):
        key = key << np.uint64(9) | np.where(left > i, symbol[i : i + n], np.uint64(0))
    rank = np.unique(key, return_inverse=True)[1].astype(np.uint64)
    while depth < size:
        step = min(depth, size - depth)
        after = np.zeros(n, np.uint64)
        after[:-step] = np.where(left[:-step] > step, rank[step:] + np.uint64(1), np.uint64(0))
        rank = np.unique(rank << np.uint64(32) | after, return_inverse=True)[1].astype(np.uint64)
        depth += step
    return rank.astype(np.int64)


def _parse_ranks(phrase: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Rank of each suffix of the parse by its first `size` phrases (phrases by rank, from 1); fewer if that parts no more."""
    n = len(phrase)
    left = np.repeat(ends, np.diff(np.append(0, ends))) - np.arange(n)
    rank, parts, depth = phrase.astype(np.uint64), 0, 1
    while depth < size:
        after = np.zeros(n, np.uint64)
        if depth < n:
            after[:-depth] = np.where(left[:-depth] > depth, rank[depth:], np.uint64(0))
        names, rank = np.unique(rank << np.uint64(32) | after, return_inverse=True)
        rank = rank.astype(np.uint64) + np.uint64(1)
        if len(names) == parts:
            break
        parts, depth = len(names), 2 * depth
    return rank.astype(np.int64)


def corpus_order(data: np.ndarray, ends: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the windows that begin at `at`, by their first `size` (8 or more) bytes, and which of them, so ordered, begin a class.

    data holds strings one after another; every window lies within one.
    """
    p = hashing.Prefix(data)
    begins = np.append(0, ends[:-1])
    m = max(0, len(data) - PARSE + 1)
    trigger = np.nonzero(p.of(np.arange(m), np.arange(PARSE, PARSE + m)) % hashing.U(MODULUS) == 0)[0]
    trigger = trigger[trigger + PARSE <= ends[hashing.owner(trigger, ends)]]
    start = np.unique(np.concatenate([begins[begins < ends], trigger]))
    text = hashing.owner(start, ends)
    last = np.append(text[1:] != text[:-1], True)
    stop = np.where(last, ends[text], np.append(start[1:], 0) + PARSE)
    _, first, kind = np.unique(p.of(start, stop), return_index=True, return_inverse=True)
    long = (stop - start)[first]
    stops = np.cumsum(long)
    dictionary = data[np.arange(stops[-1]) + np.repeat(start[first] - (stops - long), long)]
    ranks = suffix_ranks(dictionary, size, stops)
    follows = _parse_ranks(ranks[(stops - long)[kind]] + 1, np.append(np.nonzero(last)[0] + 1, []).astype(np.int64), size)
    follows = np.where(last, 0, np.append(follows[1:], 0))
    j = np.searchsorted(start, at, "right") - 1
    key = ranks[(stops - long)[kind[j]] + at - start[j]].astype(np.uint64) << hashing.U(32) | follows[j].astype(np.uint64)
    order = np.argsort(key)
    place = at[order]
    wide = np.append(data, np.zeros(8, np.uint8))
    words = np.zeros(len(data), np.uint64)
    for i in range(8):
        words = words << hashing.U(8) | wide[i : i + len(data)]
    new = np.ones(len(place), bool)
    same = np.ones(max(0, len(place) - 1), bool)
    for i in [*range(0, size - 8, 8), size - 8]:
        same &= words[place[1:] + i] == words[place[:-1] + i]
    new[1:] = ~same
    return order, new


def _classes(size: int, deal: int):
    """Windows of a bucket's pieces that a smaller document holds too."""

    def fn(t: pa.Table) -> pa.Table:
        doc, start, wins = _docs(t), _numbers(t, "starts"), _numbers(t, "wins")
        data = _join(t, "content", np.uint8)
        long = wins + size - 1
        ends = np.cumsum(long)
        who = np.repeat(np.arange(len(doc)), wins)
        nth = np.arange(len(who)) - np.repeat(np.cumsum(wins) - wins, wins)
        order, new = corpus_order(data, ends, (ends - long)[who] + nth, size)
        who, nth = who[order], nth[order]
        least = np.minimum.reduceat(doc[who], np.nonzero(new)[0])[np.cumsum(new) - 1]
        gone = doc[who] > least
        d, s = doc[who[gone]], start[who[gone]] + nth[gone]
        if not len(d):
            return _marks([])
        order = np.lexsort((s, d))
        d, s = d[order], s[order]
        begins = np.nonzero(np.append(True, (d[1:] != d[:-1]) | (s[1:] != s[:-1] + 1)))[0]  # of windows in a row
        return _marks([(*x, b"", WHOLE, 0) for x in _split(_dbucket(d[begins], deal), d[begins], s[begins], [np.diff(np.append(begins, len(d)))], [])])

    return fn


def _whole_characters(raw: np.ndarray, cover: np.ndarray) -> np.ndarray:
    """Cover without the UTF-8 characters of which only a part is covered."""
    first = (raw & 0xC0) != 0x80
    at = np.nonzero(first)[0]
    return np.repeat(np.logical_and.reduceat(cover, at), np.diff(np.append(at, len(raw))))


def _remove(size: int, rest: list[str], characters: bool, doc_id: str, text: str):
    def fn(docs: pa.Table, marks: pa.Table) -> pa.Table:
        gone = _by_doc(marks)
        n_bytes, n_removed, n_spans, kept, spans = [], [], [], [], []
        for doc, content in zip(docs.column(doc_id).to_pylist(), docs.column(text).to_pylist(), strict=True):
            raw = np.frombuffer(content.encode(), np.uint8)
            own = gone.get(doc)
            if own is None:
                cover = np.zeros(len(raw), bool)
            else:
                edge = np.zeros(len(raw) + size + 1, np.int32)
                np.add.at(edge, own[0], 1)
                np.add.at(edge, np.minimum(own[0] + own[1] + size - 1, len(raw)), -1)
                cover = np.cumsum(edge)[: len(raw)] > 0
            if characters and cover.any():
                cover = _whole_characters(raw, cover)
            step = np.diff(np.concatenate([[0], cover.view(np.int8), [0]]))
            n_bytes.append(len(raw))
            n_removed.append(int(cover.sum()))
            n_spans.append(int((step == 1).sum()))
            kept.append(raw[~cover].tobytes())
            spans.append(np.stack([np.nonzero(step == 1)[0], np.nonzero(step == -1)[0]], 1).astype(np.int64).ravel())
        made = [pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.int64()))]
        return pa.table([*(docs.column(c) for c in rest), *made], [*rest, "n_bytes", "n_removed", "n_spans", "kept", "removed"])

    return fn


def _meet_or_pass(size: int, deal: int):
    meet = _meet(size, deal)

    def fn(t: pa.Table) -> pa.Table:
        if t.column("sort")[0].as_py() == SETTLED:
            n = t.num_rows
            return _marks(list(zip(*(t.column(c).to_pylist() for c in ("bucket", "n", "base", "docs", "starts", "lefts")), [b""] * n, [WHOLE] * n, [0] * n, strict=True)))
        return meet(t)

    return fn


def _bucket_column(doc_id: str, text: str, buckets: int) -> Column:
    """A document's bucket, as _dbucket computes it; rows without an id go by their text."""
    d = F.col(doc_id)
    mixed = d.bitwiseXOR(F.shiftright(d, 7)).bitwiseXOR(F.shiftright(d, 15)).bitwiseXOR(F.shiftright(d, 31))
    return F.coalesce(F.pmod(mixed, F.lit(buckets)), F.pmod(F.xxhash64(text), F.lit(buckets))).cast("int")


def repeated(docs: DataFrame, size: int = 50, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, int]:
    """Marks of the repeated windows of each document, dealt to buckets, and their number."""
    spark = docs.sparkSession
    own = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    deal = max(partitions, -(-total // BUCKET_BYTES))  # buckets of documents, and of runs that meet
    met = stored(own.mapInArrow(_parse(size, deal, deal), PARSED).groupBy("sort", "bucket").applyInArrow(giving_back(_meet_or_pass(size, deal)), MARKS))
    open_marks = met.where(F.col("kind") == OPEN)
    buckets = max(partitions, -(-(open_marks.agg(F.sum("bytes")).first()[0] or 0) // PIECE_BYTES))  # of dictionaries, whose suffixes take more room
    dealt = own.withColumn("dbucket", _bucket_column("doc_id", "text", deal))
    texts = dealt.groupBy("dbucket").cogroup(open_marks.groupBy("dbucket")).applyInArrow(giving_back(_texts(size, buckets)), CONTENT)
    found = stored(texts.groupBy("bucket").applyInArrow(giving_back(_classes(size, deal)), MARKS))
    return met.where(F.col("kind") == WHOLE).unionByName(found), deal


def remove(docs: DataFrame, size: int = 50, text: str = "text", doc_id: str = "doc_id", characters: bool = False) -> DataFrame:
    """Add n_bytes, n_removed, n_spans, kept (binary) and removed (byte offsets, start and end in turn).

    characters: leave characters whole of which only some bytes are repeated,
    so that kept is UTF-8 again.
    """
    marks, buckets = repeated(docs, size, text, doc_id)
    rest = [c for c in docs.columns if c.lower() not in MADE]
    schema = T.StructType([docs.schema[c] for c in rest])
    for c in MADE[:3]:
        schema = schema.add(c, "long")
    schema = schema.add("kept", "binary").add("removed", T.ArrayType(T.LongType()))
    who, what, bucket = (fresh(docs, x) for x in ("__id", "__text", "dbucket"))
    own = docs.select(*rest, F.col(doc_id).cast("long").alias(who), F.coalesce(F.col(text).cast("string"), F.lit("")).alias(what))
    own = own.withColumn(bucket, _bucket_column(who, what, buckets))
    return own.groupBy(bucket).cogroup(marks.groupBy("dbucket")).applyInArrow(giving_back(_remove(size, rest, characters, who, what)), schema)
