"""Byte-pair encoding in length-bucketed numpy matrices.

`Merger` applies ranked merges to many pieces at once.  Pieces are bucketed by
length and padded to a matrix of symbol ids, with a matrix of pair ranks
beside it.  Each round every row merges its leftmost pair of least rank: the
rank matrix's argmin; then both matrices close up by one column (compaction)
and only the two pairs beside the merge are looked up again, in an
open-addressing hash table.  Rows without a mergeable pair leave the matrix.
Rounds times width is quadratic in a piece's length, so pieces above
`MATRIX_MAX` symbols use the same rule on a heap, which is n log n.

`UnitCoder` encodes whole Arrow batches: texts are cut into units that no piece
of the splitting pattern crosses, equal units of a batch are encoded once, and
ids are gathered back by index.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

MATRIX_MAX = 128
NONE = np.iinfo(np.int32).max
#: Bound on the units that a worker remembers between batches.
CACHE_MAX = 250_000


class PairTable:
    """Hash table from a pair of ids to a rank; open addressing, looked up in arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        bits = max(4, int(len(left) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, NONE, np.int32)
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot, rest = self._slot(keys), np.arange(len(keys))
        while len(rest):
            at = slot[rest]
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[rest[free]]  # of rivals for a slot one stays
            won = self.keys[at] == keys[rest]
            self.ranks[at[won]] = rank[rest[won]]
            rest = rest[~won]
            slot[rest] = (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot = self._slot(keys)
        out = np.full(len(keys), NONE, np.int32)
        rest = np.arange(len(keys))
        while len(rest):
            at = slot[rest]
            k = self.keys[at]
            hit = k == keys[rest]
            out[rest[hit]] = self.ranks[at[hit]]
            more = ~hit & (k != -1)
            rest = rest[more]
            slot[rest] = (slot[rest] + 1) & self.mask
        return out


class Merger:
    """merged[rank] is the id that the pair of that rank becomes."""

    def __init__(self, left, right, rank, merged):
        self.table = PairTable(np.asarray(left), np.asarray(right), np.asarray(rank, np.int32))
        self.merged = np.asarray(merged, np.int32)

    def encode(self, flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge pieces that lie one after another in flat; their ids and new sizes."""
        begin = np.cumsum(size) - size
        out, left = flat.astype(np.int32), size.astype(np.int64)
        low, high = 1, 4
        while low < MATRIX_MAX:
            rows = np.nonzero((size > low) & (size <= high))[0]
            step = max(1, (1 << 18) // high)
            for a in range(0, len(rows), step):
                self._matrix(out, begin[rows[a : a + step]], left, rows[a : a + step])
            low, high = high, min(MATRIX_MAX, high + 3 if high < 16 else high * 2)
        for i in np.nonzero(size > MATRIX_MAX)[0]:
            ids = self._heap(out[begin[i] : begin[i] + size[i]])
            out[begin[i] : begin[i] + len(ids)] = ids
            left[i] = len(ids)
        keep = np.arange(len(out)) - np.repeat(begin, size) < np.repeat(left, size)
        return out[keep], left

    def _matrix(self, out: np.ndarray, begin: np.ndarray, sizes: np.ndarray, names: np.ndarray) -> None:
        """Merge the pieces `names` in place: their ids in out, their sizes in sizes."""
        left = sizes[names]
        n, w = len(names), int(left.max())
        cols = np.arange(w)
        inside = cols < left[:, None]
        ids = np.zeros((n, w), np.int32)
        ids[inside] = out[(begin[:, None] + cols)[inside]]
        ranks = np.full((n, w), NONE, np.int32)  # a row's last column stays empty
        r, c = np.nonzero(cols < left[:, None] - 1)
        ranks[r, c] = self.table.get(ids[r, c], ids[r, c + 1])
        while len(names):
            rows = np.arange(len(names))
            j = ranks.argmin(1)
            best = ranks[rows, j]
            done = best == NONE
            if done.any():
                inside = np.arange(ids.shape[1]) < left[done][:, None]
                out[(begin[done][:, None] + np.arange(ids.shape[1]))[inside]] = ids[done][inside]
                sizes[names[done]] = left[done]
                go = ~done
                if not go.any():
                    return
                w = int(left[go].max())
                ids, ranks, left, names, begin, j, best = ids[go, :w], ranks[go, :w], left[go], names[go], begin[go], j[go], best[go]
                rows = np.arange(len(names))
            w = ids.shape[1]
            ids[rows, j] = self.merged[best]
            at = np.arange(w - 1) + (np.arange(w - 1) >= j[:, None])  # close up: drop column j of ranks, j + 1 of ids
            ranks = np.take_along_axis(ranks, at, 1)
            at = np.arange(w - 1) + (np.arange(w - 1) > j[:, None])
            ids = np.take_along_axis(ids, at, 1)
            left = left - 1
            for at in (j - 1, j):
                ok = (at >= 0) & (at < left - 1)
                r = rows[ok]
                ranks[r, at[ok]] = self.table.get(ids[r, at[ok]], ids[r, at[ok] + 1])
            last = (j == left - 1) & (j < w - 1)
            ranks[rows[last], j[last]] = NONE

    def _heap(self, piece: np.ndarray) -> np.ndarray:
        ids = piece.tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.table.get(piece[:-1], piece[1:]).tolist()
        live = [True] * n
        heap = [(r, i) for i, r in enumerate(ranks) if r != NONE]
        heapq.heapify(heap)
        ranks.append(NONE)

        def again(i: int) -> None:
            k = after[i]
            ranks[i] = int(self.table.get(np.array([ids[i]]), np.array([ids[k]]))[0]) if k < n else NONE
            if ranks[i] != NONE:
                heapq.heappush(heap, (ranks[i], i))

        while heap:
            r, i = heapq.heappop(heap)
            if not live[i] or ranks[i] != r:
                continue
            k = after[i]
            ids[i] = int(self.merged[r])
            live[k] = False
            after[i] = after[k]
            if after[i] < n:
                before[after[i]] = i
            again(i)
            if before[i] >= 0:
                again(before[i])
        return np.array([x for x, ok in zip(ids, live, strict=True) if ok], np.int32)


#: Classes of bytes: letter, digit, other sign, line feed, space, not simple.
LETTER, DIGIT, SIGN, LINE, SPACE, HARD = range(1, 7)
CLASS = np.full(256, HARD, np.uint8)
CLASS[0x21:0x7F] = SIGN
CLASS[np.r_[0x41:0x5B, 0x61:0x7B]] = LETTER
CLASS[0x30:0x3A] = DIGIT
CLASS[0x0A], CLASS[0x20], CLASS[0x27] = LINE, SPACE, HARD  # apostrophes may open contractions
#: A unit of one class, as `units` cuts it out of simple text.
SIMPLE = r" ?(?:[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)|\n"


def units(data: np.ndarray, ends: np.ndarray, words_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the units of texts that lie one after another in data.

    First, texts are cut before a single space between two letters or signs
    that are surely no white space; no piece of the splitting patterns crosses
    such a cut.  A chunk of simple bytes (ASCII without apostrophe and blanks,
    Latin-1 letters, single line feeds) is then cut where the class changes,
    which is what the patterns do; any other chunk stays one unit.  words_only
    leaves out spaces and line feeds and parts digits.
    """
    n = len(data)
    kind = CLASS[data]
    lead = np.nonzero(data[:-1] == 0xC3)[0]  # U+00C0 to U+00FF
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = LETTER
    begin = np.zeros(n + 1, bool)
    begin[0] = True
    begin[ends] = True
    solid = (kind <= SIGN) | (data == 0x27)
    edge_before = np.append(False, solid[:-1])
    edge_after = np.append(solid[1:], False)
    space = kind == SPACE
    cuts = space & edge_before & edge_after & ~begin[:-1] & ~begin[1:]
    bad = kind == HARD
    bad |= space & ~cuts
    line = kind == LINE
    bad |= line & ~(edge_before & edge_after)
    if words_only:  # may open a special token
        bad[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
    chunk = begin[:-1] | cuts
    at = np.nonzero(chunk)[0]
    hard = np.logical_or.reduceat(bad, at)
    own = kind.copy()
    own[:-1][cuts[:-1]] = kind[1:][cuts[:-1]]  # a space goes with what follows
    change = np.append(True, own[1:] != own[:-1])
    if words_only:
        change |= own == DIGIT
        change[1:] |= cuts[:-1]
    start = chunk | (change & ~np.repeat(hard, np.diff(np.append(at, n))))
    starts = np.nonzero(start)[0]
    stops = np.append(starts[1:], n)
    if words_only:  # blanks between simple units go; a blank stays in a unit that is not simple
        simple_blank = (cuts | (line & ~np.repeat(hard, np.diff(np.append(at, n)))))[starts] & (stops - starts == 1)
        starts, stops = starts[~simple_blank], stops[~simple_blank]
    return starts, stops


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters; other bytes stay."""
    out = LOWER[data]
    lead = np.nonzero(data[:-1] == 0xC3)[0] + 1
    up = lead[(data[lead] >= 0x80) & (data[lead] <= 0x9E) & (data[lead] != 0x97)]
    out[up] += 0x20
    return out


class UnitCoder:
    """Encodes batches of texts, each unit of a batch once.

    simple(units) encodes units of the pattern SIMPLE, hard(units) all others;
    both give a list of little-endian ids as bytes.
    """

    def __init__(self, simple, hard, words_only: bool):
        self.simple, self.hard, self.words_only = simple, hard, words_only
        self.known: dict[str, bytes] = {}
        self.is_simple = re.compile(SIMPLE).fullmatch

    def learn(self, own: list[str]) -> None:
        if len(self.known) > CACHE_MAX:
            self.known.clear()
        known = self.known
        new = [u for u in own if u not in known]
        plain = [u for u in new if self.is_simple(u)]
        known.update(zip(plain, self.simple(plain), strict=True))
        rest = [u for u in new if u not in known]
        known.update(zip(rest, self.hard(rest), strict=True))

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and where each text's ids end."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        if not n or offsets[-1] == offsets[0]:
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        ends = offsets[1:] - offsets[0]
        starts, stops = units(data, ends, self.words_only)
        if self.words_only:
            data = lowered(data)
            if len(starts) and not (stops[:-1] == starts[1:]).all():  # close the gaps
                size = stops - starts
                mark = np.zeros(len(data) + 1, np.int8)
                mark[starts] += 1
                mark[stops] -= 1
                data = data[np.cumsum(mark[:-1], dtype=np.int8).astype(bool)]
                bounds = np.append(0, np.cumsum(size))
            else:
                bounds = np.append(starts, stops[-1:])
        else:
            bounds = np.append(starts, len(data))
        every = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        coded = every.dictionary_encode()
        own = coded.dictionary.to_pylist()
        self.learn(own)
        found = list(map(self.known.__getitem__, own))
        source = np.frombuffer(b"".join(found), np.uint32)
        size = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        begin = np.cumsum(size) - size
        index = coded.indices.to_numpy()
        many = size[index]
        total = np.cumsum(many)
        ids = source[np.arange(total[-1]) + np.repeat(begin[index] - (total - many), many)] if len(total) and total[-1] else np.zeros(0, np.uint32)
        return ids, np.append(0, total)[np.searchsorted(starts, ends, "left")]


def encoder(merger: Merger, byte_ids: np.ndarray, last_ids: np.ndarray | None = None, whole: dict | None = None):
    """A function from a list of pieces to their ids as bytes.

    last_ids: ids of a piece's last byte, where the vocabulary marks word ends.
    whole: pieces that are ids of their own.
    """

    def encode(pieces: list[str]) -> list[bytes]:
        if not pieces:
            return []
        every = pa.array(pieces, pa.large_string())
        bounds = np.frombuffer(every.buffers()[1], np.int64)[: len(pieces) + 1]
        raw = np.frombuffer(every.buffers()[2], np.uint8)[: bounds[-1]]
        flat, size = byte_ids[raw], np.diff(bounds)
        if last_ids is not None:
            flat[bounds[1:] - 1] = last_ids[raw[bounds[1:] - 1]]
        ids, left = merger.encode(flat, size)
        data = ids.astype("<u4").tobytes()
        stop = (np.cumsum(left) * 4).tolist()
        out = [data[a:b] for a, b in zip([0, *stop[:-1]], stop, strict=True)]
        if whole is not None:
            for i, p in enumerate(pieces):
                k = whole.get(p)
                if k is not None:
                    out[i] = k
        return out

    return encode


@lru_cache(maxsize=4)
def rank_file(path: str) -> tuple[dict[bytes, int], Merger, np.ndarray]:
    """Ranks, merges and byte ids of a .tiktoken file; a token's rank is its id."""
    import base64

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    left, right, rank = [], [], []
    for token, k in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                left.append(a)
                right.append(b)
                rank.append(k)
    byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
    return ranks, Merger(left, right, rank, np.arange(max(ranks.values()) + 1)), byte_ids


@lru_cache(maxsize=4)
def byte_level_coder(path: str, pattern: str) -> UnitCoder:
    import regex

    ranks, merger, byte_ids = rank_file(path)
    whole = {}
    for token, k in ranks.items():
        try:
            whole[token.decode()] = k.to_bytes(4, "little")
        except UnicodeDecodeError:  # part of a letter: no piece of a text
            continue
    encode = encoder(merger, byte_ids, whole=whole)
    split = regex.compile(pattern).findall

    def hard(chunks: list[str]) -> list[bytes]:
        pieces = [split(c) for c in chunks]
        own = list({p for c in pieces for p in c})
        get = dict(zip(own, encode(own), strict=True)).__getitem__
        return [b"".join(map(get, p)) for p in pieces]

    return UnitCoder(encode, hard, words_only=False)


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    ranks, _, _ = rank_file(path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, k in ranks.items():
        out[k] = token
    return out


#: Texts of these letters need no normal form, and lower-case letter by letter.
PLAIN = r"[\t\n\r\x20-\x7e\xa1-\xff]*"
WORD_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@lru_cache(maxsize=4)
def word_coder(path: str) -> UnitCoder:
    """Ids as the tokenizers library gives them for a lower-case BPE file with word ends.

    Chunks of plain letters go through the matrices; any other chunk, and any
    that may hold a special token, through the library itself.
    """
    import json

    import regex
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, end = model["vocab"], model["end_of_word_suffix"]
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    merger = Merger([vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs], range(len(pairs)), [vocab[a + b] for a, b in pairs])
    shown = [i for i in range(256) if 0x21 <= i <= 0x7E or 0xA1 <= i <= 0xAC or 0xAE <= i <= 0xFF]
    letter = {i: chr(i) for i in shown} | {i: chr(256 + k) for k, i in enumerate(i for i in range(256) if i not in shown)}
    encode = encoder(merger, np.array([vocab[letter[i]] for i in range(256)], np.int32), np.array([vocab[letter[i] + end] for i in range(256)], np.int32))
    library = Tokenizer.from_file(path)
    plain, split = re.compile(PLAIN).fullmatch, regex.compile(WORD_PIECES).findall

    def hard(chunks: list[str]) -> list[bytes]:
        pieces = [split(c.lower()) if plain(c) and "<|" not in c else None for c in chunks]
        own = list({p for c in pieces if c is not None for p in c})
        get = dict(zip(own, encode(own), strict=True)).__getitem__
        return [np.array(library.encode(c, add_special_tokens=False).ids, "<u4").tobytes() if p is None else b"".join(map(get, p)) for c, p in zip(chunks, pieces, strict=True)]

    return UnitCoder(encode, hard, words_only=True)
