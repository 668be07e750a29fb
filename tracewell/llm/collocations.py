"""Operator 13, mining of phrase collocations with word-id suffix arrays.

Everything is counted per language.  A text is lower-cased (A-Z), cut into
pieces at `[.,;:!?\\x0A-\\x0D]` and these into words `[^\\x20\\x09]+`; a phrase is a
run of words within a piece.

1. Shards.  A task takes slices of its texts.  The words of a slice get ids, and
   prefix doubling over them ranks every suffix by its first 2**j words, piece
   ends before all words.  Neighbours in suffix order that share k words lie in
   one LCP interval of depth k, whose width is the count of a k-word phrase.
   A shard sends one row for each distinct phrase.
2. Merge.  Rows of one phrase are summed; sums below `least` go.
3. Levels.  A phrase is at least as rare as any part of it.  So words are
   counted first, then pairs, then longer phrases, and a shard only ranks what
   can still reach `least`: a word (pair) whose bit is not set in a bitmap of
   the words (pairs) that did is a piece end.  The bitmap has `2**BITS` bits
   whatever the input; two that share a bit cost rows, never a count.
4. Scores.  Each cut of a candidate looks its two parts up in the counts; the
   candidate's score is the least floor(scale * a / (l + r)), in decimals.
   Candidates lose to longer ones that hold them as often, then the first
   `top` of each language are ranked, first within salts, so that a language
   with most rows isn't sorted by one task.

Defined cases: null and empty texts and texts without words hold nothing; a null
language is `und`, as is a language of that name; repeated rows count again;
very long texts are taken whole, one at a time; an empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm import hashing
from tracewell.llm.bpe import LOWER
from tracewell.llm.common import forget, slices, stored

BATCH_BYTES = 8 << 20
#: Bits of the bitmap that prunes a level: 8 MB.
BITS = 26
SALTS = 32
CUT = np.zeros(256, bool)
CUT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09]] = True
COUNTS = "lang string, k int, phrase string, n long"


def tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Ids of all words, the words by id (from 1), and which words end their piece."""
    data, ends = hashing.flat(texts)
    low = LOWER[data]
    cut = CUT[low]
    inside = ~cut & ~BLANK[low]
    starts, stops = hashing.runs(inside, ends)
    size = stops - starts
    every = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.append(0, np.cumsum(size))), pa.py_buffer(low[inside])])
    coded = every.dictionary_encode()
    edges = np.cumsum(np.append(cut, False))[starts] + hashing.owner(starts, ends)  # grows with each cut and each text
    return coded.indices.to_numpy().astype(np.int64) + 1, coded.dictionary, np.append(edges[1:] != edges[:-1], True)[: len(starts)]


def lengths_left(ids: np.ndarray, last: np.ndarray, depth: int) -> np.ndarray:
    """Words from each place to the end of its piece, `depth` at most; none at a word that no phrase may hold."""
    left = (ids > 0).astype(np.int64)
    for _ in range(depth - 1):
        left[:-1] = np.where((ids[:-1] > 0) & ~last[:-1], 1 + np.minimum(left[1:], depth - 1), left[:-1])
    return left


def suffix_array(ids: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by their first `depth` words, and the words that each shares with the one before it.

    ids are from 1, or 0 for a word that no phrase may hold; left: words from
    each place to the end of its piece.  Suffixes that begin with 0 come first.
    """
    n = len(ids)
    levels, rank, reach = [(1, ids)], ids, 1
    while reach < depth:  # prefix doubling
        after = np.zeros(n, np.int64)
        after[:-reach] = np.where(left[:-reach] > reach, rank[reach:], 0)
        rank = np.unique(rank << 32 | after, return_inverse=True)[1] + 1
        rank[ids == 0] = 0
        reach *= 2
        levels.append((reach, rank))
    order = np.argsort(rank, kind="stable")
    shared = np.zeros(n, np.int64)
    here, there = order[1:], order[:-1]
    for step, rank in reversed(levels):  # from the longest step down, as far as both reach
        both = np.minimum(left[here], left[there]) >= shared[1:] + step
        x, y = np.where(both, here + shared[1:], 0), np.where(both, there + shared[1:], 0)
        shared[1:] += np.where(both & (rank[x] == rank[y]), step, 0)
    return order, shared


def lcp_counts(order: np.ndarray, shared: np.ndarray, long: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct phrase of k words, and its count: the LCP intervals of depth k.

    long: words from each place to the end of its piece.
    """
    own = long[order] >= k
    begins = np.nonzero(own & (shared < k))[0]
    upto = np.cumsum(own)
    many = np.diff(np.append(upto[begins] - 1, upto[-1] if len(upto) else 0))
    return order[begins], many


def _set(bitmap: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether the bits at these places are set."""
    return (bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _hashes(lang: str, words: pa.Array) -> np.ndarray:
    """xxhash64(lang, word) as Spark computes it, by word id; 0 stands for no word."""
    seed = xxhash.xxh64_intdigest(lang.encode(), 42)
    return np.array([0, *(xxhash.xxh64_intdigest(w, seed) for w in words.cast(pa.large_binary()).to_pylist())], np.uint64)


def _of(lang: pa.Array, name: str) -> np.ndarray:
    return pc.equal(lang, name).to_numpy(zero_copy_only=False)


def _shard(level: int, lengths: tuple[int, ...], known: Broadcast | None):
    """Counts of the phrases of these lengths; known: bitmap of the words (level 2) or pairs (level 3) that phrases may hold."""

    def fn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it, "text", BATCH_BYTES):
            langs = b.column("lang")
            for name in pc.unique(langs).to_pylist():
                ids, words, last = tokens(b.column("text").filter(pa.array(_of(langs, name))))
                if not len(ids):
                    continue
                mask = np.uint64((1 << BITS) - 1)
                if level == 2:
                    ok = np.append(False, _set(known.value, _hashes(name, words)[1:] & mask))
                    ids = np.where(ok[ids], ids, 0)
                elif level == 3:
                    h = _hashes(name, words)[ids]
                    joined = np.zeros(len(ids), bool)  # this word and the next are a known pair
                    joined[:-1] = ~last[:-1] & _set(known.value, (h[:-1] << np.uint64(1) ^ h[1:]) & mask)
                    last = ~joined
                depth = 1 << (max(lengths) - 1).bit_length()
                long = lengths_left(ids, last, depth)
                order, shared = suffix_array(ids, long, depth)
                for k in lengths:
                    at, many = lcp_counts(order, shared, long, k)
                    parts = [words.take(pa.array(ids[at + i] - 1)) for i in range(k)]
                    phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if k > 1 else parts[0]
                    m = len(at)
                    for x in range(0, m, 100_000):
                        y = min(m, x + 100_000)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * (y - x)), pa.array(np.full(y - x, k, np.int32)), phrase[x:y].cast(pa.string()), pa.array(many[x:y])], ["lang", "k", "phrase", "n"])

    return fn


def _level(docs: DataFrame, level: int, lengths: tuple[int, ...], known: Broadcast | None, least: int) -> DataFrame:
    """Phrases of these lengths that reach `least`; of words all, for their total."""
    rows = docs.mapInArrow(_shard(level, lengths, known), COUNTS)
    sums = rows.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))
    return stored(sums if level == 1 else sums.where(F.col("n") >= least))


def _bitmap(found: DataFrame, k: int) -> Broadcast:
    """Bit h of the bitmap is set for each phrase of k words (one or two) of hash h; at most 2**BITS bits, in rows of 32,768."""
    word = F.split("phrase", " ")
    h = [F.xxhash64("lang", word[i]) for i in range(k)]
    place = (h[0] if k == 1 else F.shiftleft(h[0], 1).bitwiseXOR(h[1])).bitwiseAND(F.lit((1 << BITS) - 1))
    rows = found.where(F.col("k") == k).select(place.alias("place")).groupBy(F.shiftright("place", 15).alias("row")).agg(F.bitmap_construct_agg(F.col("place") % 32768).alias("bits"))
    bits = np.zeros((1 << BITS - 15, 4096), np.uint8)
    for r in rows.collect():  # at most 2**(BITS - 15) rows of 4 KB
        bits[r["row"]] = np.frombuffer(r["bits"], np.uint8)
    return found.sparkSession.sparkContext.broadcast(bits.reshape(-1))


def counts(docs: DataFrame, longest: int = 4, least: int = 30, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, n) of all phrases of up to `longest` words that occur `least` times, and (lang, n) of all words."""
    own = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    words = _level(own, 1, (1,), None, least)
    total = stored(words.groupBy("lang").agg(F.sum("n").alias("n")))
    frequent = stored(words.where(F.col("n") >= least))
    forget(words)
    found = [frequent]
    for level, lengths in ((2, (2,)), (3, tuple(range(3, longest + 1)))):
        if lengths and lengths[0] <= longest:
            known = _bitmap(found[-1], level - 1)
            found.append(_level(own, level, lengths, known, least))
            known.destroy()
    every = found[0]
    for df in found[1:]:
        every = every.unionByName(df)
    out = stored(every)
    forget(*found)
    return out, total


def mine(docs: DataFrame, longest: int = 4, least: int = 30, top: int = 2000, percent: int = 80, scale: int = 2_000_000, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best `top` candidates of each language."""
    known, total = counts(docs, longest, least, text, lang)
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    word = F.split("phrase", " ")
    part = lambda w, a, n: F.array_join(F.slice(w, a, n), " ")
    candidates = known.where("k > 1").select("lang", "k", "phrase", F.col("n").alias("a"))
    cuts = candidates.select("lang", "k", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(word, 1, F.col("cut")).alias("first"), part(word, F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    one = known.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    two = known.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    scored = cuts.join(one, ["lang", "first"]).join(two, ["lang", "rest"]).select("lang", "phrase", "a", "cut", "l", "r")
    scored = scored.withColumns({"__p": wide("a") * F.lit(scale).cast("decimal(10,0)"), "__q": wide("l") + wide("r")}).withColumn("score", F.expr("__p div __q"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    # parts of two words or more of each longer candidate: (from, size)
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: part(word, i, m))))
    held = candidates.where("k > 2").select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), F.col("a").alias("longer"))
    held = held.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = best.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * percent))
    left = left.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    few = left.withColumn("__salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "__salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    out = stored(ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
    forget(known, total)
    return out
