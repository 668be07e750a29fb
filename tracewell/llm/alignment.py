"""Operator 11, alignment of two tokenizers' tokens by the bytes that they cover.

Both tokenizers see a space and the text.  A (byte-level BPE) takes it whole, B
(sentencepiece BPE) puts that space there itself.

1. Tokens.  A comes from the matrices of `bpe`.  No piece of B holds a space
   after another letter (checked when the model is read), so its merges never
   cross a place before such a space: texts are cut there, and each distinct
   unit is encoded once per worker by the library.
2. Cuts.  A bitset over the bytes marks where tokens of A end, another where
   tokens of B do; their AND holds the shared cuts.  The running popcount of
   the words before a cut, and of the bits before it in its word, is its rank:
   the number of tokens that end up to it.  A cut's ranks in A and B are the
   token ranges of its group.
3. Links.  A group links all its A tokens with all its B tokens.  Groups are
   opened into pairs of ids; a group of more than `WIDE` links is first reduced
   to its distinct ids and their numbers.  A document keeps its distinct pairs
   and how often it links each.
4. Counts.  A slice of texts is a shard; it sends each of its distinct pairs
   once, with the number of its documents that hold it, in packed rows by hash
   bucket.  Buckets add up a pair's shards; a second deal, by A id, finds the
   highest count of each A id; the counts then go back to the shards that asked,
   which sum them up over each document's pairs.  Packed rows have a bounded
   number of bytes, so a pair that is everywhere is a few bytes of many rows.

Defined cases: texts that are null or empty, or whose tokens don't give back a
space and the text (some letters that a model writes as blanks), have no tokens:
zeros and an empty groups_sha256.  Special tokens' strings are plain text.
Repeated rows, with or without one id, are documents of their own; very long
texts are taken whole.  An empty table gives no rows.  Other columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import bpe, hashing
from tracewell.llm.common import forget, slices, stored

BATCH_BYTES = 3 << 19
#: Links of a group above which its ids are counted before they are paired, and pairs that are open at once.
WIDE, OPEN = 256, 1 << 19
#: Bits of a B id in a pair.
B_BITS = 16
#: Pairs in a packed row at most, and about so many bytes of text for each bucket of pairs.
ROW, BUCKET_BYTES = 1 << 16, 8 << 20
SPACE = "▁"


class PieceCoder:
    """Encodes batches of texts with a sentencepiece BPE model, each unit of a worker once."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece holds a space after another letter: units can't be cut before spaces")
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else b"" if self.model.is_control(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.blank = [pieces.index(SPACE)]
        self.known: dict[str, bytes] = {}

    def learn(self, units: list[str]) -> None:
        """Remember the ids of units that begin with a space, which the model adds itself."""
        found = [ids or self.blank for ids in self.model.encode([u[1:] for u in units], num_threads=1)]
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) * 4).tolist()
        data = np.fromiter(chain.from_iterable(found), "<u4").tobytes()
        self.known.update(zip(units, (data[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)), strict=True))

    def batch(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts (a space first) that lie one after another, and where each text's ids end."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(ends), np.int64)
        blank = data == 0x20
        start = blank.copy()
        start[1:] &= ~blank[:-1]
        start[0] = True
        start[ends[:-1]] = True
        starts = np.nonzero(start)[0]
        every = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)])
        coded = every.dictionary_encode()
        own = coded.dictionary.to_pylist()
        if len(self.known) > bpe.CACHE_MAX:
            self.known.clear()
        if new := [u for u in own if u not in self.known]:
            self.learn(new)
        found = list(map(self.known.__getitem__, own))
        source = np.frombuffer(b"".join(found), np.uint32)
        size = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        begin, index = np.cumsum(size) - size, coded.indices.to_numpy()
        many = size[index]
        total = np.cumsum(many)
        ids = source[np.arange(total[-1]) + np.repeat(begin[index] - (total - many), many)]
        return ids, total[np.append(np.searchsorted(starts, ends[:-1]), len(starts)) - 1]


@lru_cache(maxsize=4)
def piece_coder(path: str) -> PieceCoder:
    return PieceCoder(path)


@lru_cache(maxsize=8)
def _flat_bytes(path: str, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all ids, one after another; where each begins and its size."""
    every = bpe.token_bytes(path) if kind == "rank" else piece_coder(path).bytes
    size = np.array([len(x) for x in every], np.int64)
    return np.frombuffer(b"".join(every), np.uint8), np.cumsum(size) - size, size


def spelled(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of tokens and where each token ends."""
    raw, begin, size = table
    many = size[ids]
    ends = np.cumsum(many)
    return raw[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[ids] - (ends - many), many)], ends


def bitset(ends: np.ndarray, n: int) -> np.ndarray:
    """Words of a bitset of n bits in which the bit before each end is set."""
    bits = np.zeros(-(-n // 64) * 64, bool)
    bits[ends - 1] = True
    return np.packbits(bits, bitorder="little").view("<u8")


def rank(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bits that are set up to and with each place."""
    before = np.cumsum(np.bitwise_count(words), dtype=np.int64) - np.bitwise_count(words)
    word, bit = at >> 6, (at & 63).astype(np.uint64)
    upto = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - bit)
    return before[word] + np.bitwise_count(words[word] & upto)


def select(words: np.ndarray) -> np.ndarray:
    """Places of all bits that are set."""
    return np.nonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))[0]


def shared_cuts(a_ends: np.ndarray, b_ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes before which both end, and how many tokens of A and B end up to each."""
    a, b = bitset(a_ends, n), bitset(b_ends, n)
    at = select(a & b)
    return at + 1, rank(a, at), rank(b, at)


def _blocks(size: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of groups whose sizes sum up to `most`, or single larger ones."""
    upto, at = np.cumsum(size), 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield slice(at, to)
        at = to


def _distinct(doc: np.ndarray, key: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, pair), in order, and their summed numbers."""
    order = np.lexsort((key, doc)) if len(doc) and doc[-1] >> 31 else np.argsort(doc.astype(np.uint64) << np.uint64(33) | key)
    doc, key, many = doc[order], key[order], many[order]
    new = np.nonzero(np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))[: len(doc)])[0]
    return doc[new], key[new], np.add.reduceat(many, new) if len(new) else many


def _opened(a: np.ndarray, b: np.ndarray, wa: np.ndarray, wb: np.ndarray, a_at: np.ndarray, na: np.ndarray, b_at: np.ndarray, nb: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair, number) of all pairs of groups whose ids are ranges of a and b."""
    many = na * nb
    end = np.cumsum(many)
    nth = np.arange(end[-1] if len(end) else 0) - np.repeat(end - many, many)
    per = np.repeat(nb, many)
    i, j = np.repeat(a_at, many) + nth // per, np.repeat(b_at, many) + nth % per
    return np.repeat(doc, many), a[i].astype(np.uint64) << np.uint64(B_BITS) | b[j].astype(np.uint64), wa[i] * wb[j]


def pairs(a: np.ndarray, b: np.ndarray, a_at: np.ndarray, na: np.ndarray, b_at: np.ndarray, nb: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, pair of ids) of the links of all groups, and how often each is linked."""
    out = []

    def add(found) -> None:
        out.append(_distinct(*found))
        if len(out) > 16:  # merge what is there
            out[:] = [_distinct(*(np.concatenate(c) for c in zip(*out, strict=True)))]

    one_a, one_b = np.ones(len(a), np.int64), np.ones(len(b), np.int64)
    small = np.nonzero(na * nb <= WIDE)[0]
    for s in _blocks((na * nb)[small], OPEN):
        g = small[s]
        add(_opened(a, b, one_a, one_b, a_at[g], na[g], b_at[g], nb[g], doc[g]))
    for g in np.nonzero(na * nb > WIDE)[0]:
        x, cx = np.unique(a[a_at[g] : a_at[g] + na[g]], return_counts=True)
        y, cy = np.unique(b[b_at[g] : b_at[g] + nb[g]], return_counts=True)
        step = max(1, OPEN // len(y))
        for k in range(0, len(x), step):
            own = min(step, len(x) - k)
            z = np.zeros(1, np.int64)
            add(_opened(x[k : k + own], y, cx[k : k + own], cy, z, z + own, z, z + len(y), doc[g : g + 1]))
    if not out:
        return doc[:0], np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return out[0] if len(out) == 1 else _distinct(*(np.concatenate(c) for c in zip(*out, strict=True)))


@lru_cache(maxsize=2)
def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of each id with a place for a separator, and which of them are used."""
    wide = len(str(n - 1))
    text, used = np.zeros((n, wide + 1), np.uint8), np.zeros((n, wide + 1), bool)
    left = np.arange(n)
    for k in range(wide):
        text[:, wide - 1 - k] = 0x30 + left % 10
        used[:, wide - 1 - k] = (left > 0) | (k == 0)
        left = left // 10
    used[:, wide] = True
    return text, used


def listed(a: np.ndarray, b: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`a1,a2|b1;a3|b2,b3;` of all groups, and where each group's text ends; cuts: tokens up to the end of each group."""
    na, nb = np.diff(np.append(0, a_cut)), np.diff(np.append(0, b_cut))
    ids, sign = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    place_a = np.arange(len(a)) + np.repeat(b_cut - nb, na)
    place_b = np.arange(len(b)) + np.repeat(a_cut, nb)
    ids[place_a], ids[place_b] = a, b
    last = a_cut + b_cut
    sign[last - 1] = ord(";")
    sign[last - nb - 1] = ord("|")
    text, used = _decimals(1 << B_BITS)
    rows, own = text[ids], used[ids]
    rows[:, -1] = sign
    return rows[own], np.cumsum(own.sum(1))[last - 1]


def _binary(chunks: list[bytes]) -> pa.Array:
    return pa.array(chunks, pa.binary())


ALIGNED = "shard long, doc_id {0}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys binary, many binary, bucket int, pairs binary, docs binary"
NAMES = ["shard", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "keys", "many", "bucket", "pairs", "docs"]


def _aligned(a_path: str, b_path: str, pattern: str, buckets: int):
    """Rows of documents, and rows (bucket, pairs, docs) of each shard."""

    def fn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth = TaskContext.get().partitionId(), 0
        for b in slices(it, "text", BATCH_BYTES):
            shard = part << 32 | nth
            nth += 1
            every, at = hashing.flat(b.column("text"))
            n = b.num_rows
            size = np.diff(np.append(0, at))
            # a space before each text that has letters
            ends = np.cumsum(size + (size > 0))
            data = np.full(int(ends[-1]) if n else 0, 0x20, np.uint8)
            inside = np.ones(len(data), bool)
            inside[(ends - size - 1)[size > 0]] = False
            data[inside] = every
            full = np.nonzero(size)[0]
            a, a_upto = bpe.byte_level_coder(a_path, pattern).batch(pa.Array.from_buffers(pa.large_string(), len(full), [None, pa.py_buffer(np.append(0, ends[full]).astype(np.int64)), pa.py_buffer(data)]))
            c, c_upto = piece_coder(b_path).batch(data, ends[full])
            keep = np.ones(len(full), bool)
            for ids, upto, table in ((a, a_upto, _flat_bytes(a_path, "rank")), (c, c_upto, _flat_bytes(b_path, "piece"))):
                raw, stop = spelled(ids, table)
                text_end = stop[upto - 1] if len(upto) else upto
                keep &= _same(data, ends[full], raw, text_end)
            own = full[keep]
            a, a_upto = _only(a, a_upto, keep)
            c, c_upto = _only(c, c_upto, keep)
            lengths = (size + 1)[own]
            total = np.cumsum(lengths)
            a_ends, c_ends = (np.cumsum(_flat_bytes(p, k)[2][ids]) for ids, p, k in ((a, a_path, "rank"), (c, b_path, "piece")))
            cut, a_cut, c_cut = shared_cuts(a_ends, c_ends, int(total[-1]) if len(total) else 0)
            groups_upto = np.searchsorted(cut, total, "right")
            na, nc = np.diff(np.append(0, a_cut)), np.diff(np.append(0, c_cut))
            links = na * nc
            doc = np.repeat(np.arange(len(own)), np.diff(np.append(0, groups_upto)))
            who, key, many = pairs(a, c, a_cut - na, na, c_cut - nc, nc, doc)
            counts = np.zeros((4, n), np.int64)
            for i, upto in enumerate((a_upto, c_upto, groups_upto, np.append(0, np.cumsum(links))[groups_upto])):
                counts[i, own] = np.diff(np.append(0, upto))
            texts, stop = listed(a, c, a_cut, c_cut)
            stop = np.append(0, np.append(0, stop)[groups_upto])
            shas = [""] * n
            for i, x, y in zip(own.tolist(), stop[:-1].tolist(), stop[1:].tolist(), strict=True):
                shas[i] = hashlib.sha256(texts[x : y - 1]).hexdigest()
            upto = np.searchsorted(who, np.arange(len(own)), "right")
            keys, numbers = [b""] * n, [b""] * n
            raw_keys, raw_many = key.astype("<u4").tobytes(), many.astype("<i8").tobytes()
            for i, x, y in zip(own.tolist(), [0, *(4 * upto[:-1]).tolist()] if len(own) else [], (4 * upto).tolist(), strict=True):
                keys[i], numbers[i] = raw_keys[x:y], raw_many[2 * x : 2 * y]
            made = [pa.array(np.full(n, shard)), b.column("doc_id"), *map(pa.array, counts), pa.array(shas), pa.array(keys, pa.binary()), pa.array(numbers, pa.binary())]
            yield pa.RecordBatch.from_arrays([*made, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], NAMES)
            names, docs = np.unique(key, return_counts=True)
            rows = list(_packed(names, [docs.astype("<u4")], buckets))
            asked = _table(rows, NAMES[-3:], [pa.int32(), pa.binary(), pa.binary()]).combine_chunks()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), shard)), *(pa.nulls(len(rows), c.type) for c in made[1:]), *(asked.column(c).combine_chunks() for c in NAMES[-3:])], NAMES)

    return fn


def _same(data: np.ndarray, ends: np.ndarray, raw: np.ndarray, raw_ends: np.ndarray) -> np.ndarray:
    """Whether each text's tokens spell it."""
    size, own = np.diff(np.append(0, ends)), np.diff(np.append(0, raw_ends))
    ok = size == own
    place = np.arange(len(data)) + np.repeat((raw_ends - own) - (ends - size), size)
    odd = np.ones(len(data), bool)
    fit = np.repeat(ok, size)
    odd[fit] = data[fit] != raw[place[fit]]
    return ok & (np.add.reduceat(odd, ends - size) == 0) if len(ends) else ok


def _only(ids: np.ndarray, upto: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the ids of texts that are not kept."""
    size = np.diff(np.append(0, upto))
    return ids[np.repeat(keep, size)], np.cumsum(size[keep])


def _packed(key: np.ndarray, cols: list[np.ndarray], buckets: int, by: np.ndarray | None = None) -> Iterator[tuple]:
    """(bucket, keys, columns...) in packed rows of ROW items at most."""
    of = hashing.mix((key if by is None else by).astype(np.uint64)) % np.uint64(buckets)
    order = np.argsort(of, kind="stable")
    names, at = np.unique(of[order], return_index=True)
    for name, x, y in zip(names, at, np.append(at, len(order))[1:], strict=True):
        for k in range(x, y, ROW):
            o = order[k : min(y, k + ROW)]
            yield int(name), key[o].astype("<u4").tobytes(), *(c[o].tobytes() for c in cols)


def _table(rows: list[tuple], names: list[str], kinds: list) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def _joined(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Items of a packed column, and the row of each."""
    chunks = t.column(name).to_pylist()
    return np.frombuffer(b"".join(chunks), "<u4"), np.repeat(np.arange(len(chunks)), [len(c) >> 2 for c in chunks])


def _summed(by_a: int):
    """The pairs of a bucket with the documents of all shards, dealt by A id."""

    def fn(t: pa.Table) -> pa.Table:
        key, _ = _joined(t, "pairs")
        docs, _ = _joined(t, "docs")
        names, index = np.unique(key, return_inverse=True)
        total = np.bincount(index, docs, len(names)).astype(np.int64)
        rows = [(k, x, y) for k, x, y in _packed(names, [total.astype("<i8")], by_a, by=names >> B_BITS)]
        return _table(rows, ["bucket", "pairs", "docs"], [pa.int32(), pa.binary(), pa.binary()])

    return fn


def _highest(buckets: int):
    """The pairs of a bucket of A ids with their counts, and whether that is their A id's highest; dealt by pair again."""

    def fn(t: pa.Table) -> pa.Table:
        key, _ = _joined(t, "pairs")
        total = np.frombuffer(b"".join(t.column("docs").to_pylist()), "<i8")
        a, index = np.unique(key >> B_BITS, return_inverse=True)
        top = np.zeros(len(a), np.int64)
        np.maximum.at(top, index, total)
        rows = list(_packed(key, [total, (total == top[index]).astype(np.uint8)], buckets))
        return _table(rows, ["bucket", "pairs", "total", "best"], [pa.int32(), pa.binary(), pa.binary(), pa.binary()])

    return fn


def _answers(asked: pa.Table, known: pa.Table) -> pa.Table:
    """For each row of a shard's pairs in a bucket their counts."""
    rows = []
    if asked.num_rows and known.num_rows:
        key, _ = _joined(known, "pairs")
        total = np.frombuffer(b"".join(known.column("total").to_pylist()), "<i8")
        best = np.frombuffer(b"".join(known.column("best").to_pylist()), np.uint8)
        order = np.argsort(key)
        key, total, best = key[order], total[order], best[order]
        for shard, wanted in zip(asked.column("shard").to_pylist(), asked.column("pairs").to_pylist(), strict=True):
            at = np.searchsorted(key, np.frombuffer(wanted, "<u4"))
            rows.append((shard, wanted, total[at].tobytes(), best[at].tobytes()))
    return _table(rows, ["shard", "pairs", "total", "best"], [pa.int64(), pa.binary(), pa.binary(), pa.binary()])


def _scored(docs: pa.Table, known: pa.Table) -> pa.Table:
    """Documents of a shard with the counts of their links."""
    key, _ = _joined(known, "pairs")
    total = np.frombuffer(b"".join(known.column("total").to_pylist()), "<i8")
    best = np.frombuffer(b"".join(known.column("best").to_pylist()), np.uint8)
    order = np.argsort(key)
    key, total, best = key[order], total[order], best[order]
    asked, row = _joined(docs, "keys")
    many = np.frombuffer(b"".join(docs.column("many").to_pylist()), "<i8")
    at = np.searchsorted(key, asked)
    sums = []
    for x in (many * best[at], many * total[at]):
        upto = np.append(0, np.cumsum(x))
        ends = np.searchsorted(row, np.arange(docs.num_rows), "right")
        sums.append(np.diff(np.append(0, upto[ends])))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    return pa.table([*(docs.column(c) for c in names), pa.array(sums[0]), pa.array(sums[1]), docs.column("groups_sha256")], [*names, "n_best", "count_sum", "groups_sha256"])


def align(docs: DataFrame, a_path: str, b_path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document.

    a_path: a .tiktoken file and its splitting pattern; b_path: a sentencepiece
    BPE model that adds a space.  Ids of A and B are below 2**16.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    both = stored(own.mapInArrow(_aligned(a_path, b_path, pattern, buckets), ALIGNED.format(kind)))
    asked = both.where("bucket IS NOT NULL").select("shard", "bucket", "pairs", "docs")
    texts = both.where("bucket IS NULL").drop("bucket", "pairs", "docs")
    summed = asked.select("bucket", "pairs", "docs").groupBy("bucket").applyInArrow(_summed(buckets), "bucket int, pairs binary, docs binary")
    known = summed.groupBy("bucket").applyInArrow(_highest(buckets), "bucket int, pairs binary, total binary, best binary")
    told = asked.select("bucket", "shard", "pairs").groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(_answers, "shard long, pairs binary, total binary, best binary")
    result = texts.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(_scored, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    out = stored(result)
    forget(both)
    return out
