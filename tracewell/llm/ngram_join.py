"""Operator 6, exact n-gram Jaccard join with vertical partitioning.

A document's set holds the hashes (64 bits) of its distinct `n`-word shingles.

1. Classes.  Documents of equal sets (a 128-bit digest and the size) are one
   class, represented by the least id; only representatives go on.
2. Fragments.  All shingles have one global order, that of their hashes.  Sets
   are grouped by size; a group's order is cut into fragments of about `load`
   shingles of a set each, and a set falls into a segment for each fragment.
   Two sets of a group that link differ in at most k shingles, which touch at
   most k fragments; so of the segments of either, all but k are equal in both.
   Each set sends the hashes of its k + 1 largest segments (ties by hash): of
   two that link at least one is common.  A chance meeting takes all shingles
   of a fragment, not one.  A set near its group's end joins the next group
   too.  A set whose segments are k or fewer (small ones, low similarities)
   also sends its prefix of single shingles, by which two such sets meet.
3. Candidates, in rounds.  A hash that two classes or more sent is a bucket;
   of buckets with the same members one stays.  A bucket's least member is its
   first pivot; it is compared with every other member.  Members that are
   linked by now, in this or another bucket, need no comparison: a document
   first meets the pivot that it shares most buckets with, then those pivots
   that are still in other components.  The bucket goes on with further
   pivots until its members that have not been pivots are all in one component.
   So every pair is compared or known to be connected, but a group of g copies
   costs about g comparisons, not g * g.  Large buckets are salted.
4. Overlap.  A sketch of a set, the parities of its hashes in 512 cells, bounds
   from below in how many shingles two sets differ; pairs that differ in too
   many are no candidates.  The order is cut into `fragments` ranges, each set
   into that many segments.  A pair's overlap is counted in every fragment on
   its own (a row for each) and summed per pair.
5. Components come from contracting links to the least neighbour, round by
   round, as DataFrames.

What is stored between the steps is deleted as soon as it was read for the
last time; in the end only ids, sizes and components are left.

Defined cases: texts without words (null, empty, blank) have an empty set and
link with nothing: their component is their own id.  A text of fewer than n
words is one shingle.  Repeated rows fall into one class.  An empty table
gives no rows.  Rows without an id are left out; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm import hashing
from tracewell.llm.bpe import LOWER
from tracewell.llm.common import forget, slices, stored

#: Members of a bucket up to which all are pivots at once.
SMALL = 32
#: A bucket has a salt for each so many members.
SALT = 1024
#: A size group spans so many steps of the largest ratio that two sizes of a link can have.
STEPS = 3
#: A set's sketch: the parities of its hashes in 64 * WORDS cells.
WORDS = 8
SKETCH = "struct<" + ", ".join(f"s{i}:long" for i in range(WORDS)) + ">"
#: Pairs that may be broadcast: 32 bytes each.
FEW = 200_000
BATCH_BYTES = 1 << 20
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle hash), distinct and sorted by both."""
    data, ends = hashing.flat(texts)
    starts, stops = hashing.runs(~BLANK[data], ends)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = hashing.Prefix(LOWER[data]).of(starts, stops)
    text = hashing.owner(starts, ends)
    count = np.bincount(text, minlength=len(ends))
    size = np.minimum(count, n)[text]
    nth = np.arange(len(word)) - (np.cumsum(count) - count)[text]
    full = nth <= count[text] - size
    at, own = np.nonzero(full)[0], text[full]
    h = np.full(len(at), 0x1234567, np.uint64)
    padded = np.append(word, np.zeros(n, np.uint64))
    for i in range(n):
        more = i < size[at]
        h = np.where(more, hashing.mix(h * hashing.U(hashing.BASE) + padded[at + i]), h)
    order = np.argsort(h)  # then by text, stable
    order = order[np.argsort(own[order].astype(np.uint16 if len(ends) <= 1 << 16 else np.int64), kind="stable")]
    h, own = h[order], own[order]
    new = np.append(True, (h[1:] != h[:-1]) | (own[1:] != own[:-1]))
    return own[new], h[new]


@lru_cache(maxsize=8)
def size_groups(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Least size of each group (one more at the end), and its number of fragments."""
    least = [1]
    while least[-1] < 1 << 40:
        wide = -(-least[-1] * 100**STEPS // percent**STEPS)
        least.append(max(least[-1] + 1, wide))
    first = np.array(least, np.int64)
    load = 0.65 * (100 + percent) / max(2 * (100 - percent), 1)
    return first, np.maximum(8, np.ceil((first[1:] - 1) / load)).astype(np.int64)


def signatures(own: np.ndarray, h: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash): what each set sends; h is sorted within each text."""
    first, fragments = size_groups(percent)
    begin = np.cumsum(size) - size
    texts = np.nonzero(size)[0]
    a = size[texts]
    group = np.searchsorted(first, a, "right") - 1
    most = 100 * a // percent
    guest = most >= first[group + 1]
    t = np.concatenate([texts, texts[guest]])
    g = np.concatenate([group, group[guest] + 1])
    partner = np.concatenate([np.minimum(most, first[group + 1] - 1), most[guest]])
    k = (100 - percent) * (size[t] + partner) // (100 + percent)
    t, g, k = t[k > 0], g[k > 0], k[k > 0]  # else only equal sets link, which are one class
    if not len(t):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    many = size[t]
    who = np.repeat(np.arange(len(t)), many)
    x = h[np.arange(len(who)) + np.repeat(begin[t] - (np.cumsum(many) - many), many)]
    cell = ((x >> hashing.U(32)) * fragments[g].astype(np.uint64)[who]) >> hashing.U(32)
    at = np.nonzero(np.append(True, (who[1:] != who[:-1]) | (cell[1:] != cell[:-1])))[0]
    count, mine = np.diff(np.append(at, len(x))), who[at]
    content = np.add.reduceat(hashing.mix(x ^ hashing.U(0x6A09E667F3BCC909)), at)
    sig = hashing.mix(content + hashing.mix(g.astype(np.uint64) + hashing.U(101))[mine])
    order = np.lexsort((sig, -count, mine))
    mine, sig = mine[order], sig[order]
    full = np.bincount(mine, minlength=len(t))
    nth = np.arange(len(mine)) - np.repeat(np.cumsum(full) - full, full)
    sent = nth <= k[mine]
    short = np.unique(t[full <= k])  # the largest segments may all be touched
    plain = size[short] - (percent * size[short] + 99) // 100 + 1
    single = np.arange(plain.sum()) + np.repeat(begin[short] - (np.cumsum(plain) - plain), plain)
    return np.concatenate([t[mine[sent]], np.repeat(short, plain)]), np.concatenate([sig[sent], hashing.mix(h[single] ^ hashing.U(0xBB67AE8584CAA73B))])


def _sets(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, digests k1 and k2, the signatures and the sketch of each document."""

    def fn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it, "text", BATCH_BYTES, row=1024):
            own, h = shingles(b.column("text"), n)
            size = np.bincount(own, minlength=b.num_rows)
            begin = np.cumsum(size) - size
            k1, k2 = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.uint64)
            some = np.nonzero(size)[0]
            if len(some):
                k1[some] = np.add.reduceat(hashing.mix(h + hashing.U(11)), begin[some])
                k2[some] = np.add.reduceat(hashing.mix(h ^ hashing.U(0x5851F42D4C957F2D)), begin[some])
            who, sig = signatures(own, h, size, percent)
            sig = sig[np.argsort(who, kind="stable")].view(np.int64)
            ends = np.append(0, np.cumsum(np.bincount(who, minlength=b.num_rows))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(sig))
            odd = np.bincount(own * (64 * WORDS) + (h % hashing.U(64 * WORDS)).astype(np.int64), minlength=64 * WORDS * b.num_rows) % 2
            bits = np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(-1, WORDS)
            sketch = pa.StructArray.from_arrays([pa.array(bits[:, i].copy()) for i in range(WORDS)], [f"s{i}" for i in range(WORDS)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), lists, sketch], ["doc_id", "n_shingles", "k1", "k2", "sent", "sketch"])

    return docs.mapInArrow(fn, f"doc_id long, n_shingles long, k1 long, k2 long, sent array<long>, sketch {SKETCH}")


def _alike(x: str, y: str, xn: str, yn: str, percent: int) -> Column:
    """Whether two sketches leave room for the similarity: each cell whose parities differ holds a shingle that one set lacks."""
    differ = sum((F.bit_count(F.col(f"{x}.s{i}").bitwiseXOR(F.col(f"{y}.s{i}"))) for i in range(WORDS)), F.lit(0))
    return (100 + percent) * differ <= (100 - percent) * (F.col(xn) + F.col(yn))


def _segments(docs: DataFrame, n: int, fragments: int, also: str | None = None) -> DataFrame:
    """doc_id, fragment, segment (the sorted hashes of the set in that fragment), and the column `also`."""
    shift = hashing.U(64 - (fragments - 1).bit_length())
    kept = ["doc_id"] + [also] * (also is not None)

    def fn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it, "text", BATCH_BYTES):
            own, h = shingles(b.column("text"), n)
            part = (h >> shift).astype(np.int64) if fragments > 1 else np.zeros(len(h), np.int64)
            new = np.nonzero(np.append(True, (own[1:] != own[:-1]) | (part[1:] != part[:-1])))[0] if len(h) else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(h)).astype(np.int32)), pa.array(h.view(np.int64)))
            at = pa.array(own[new])
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in kept), pa.array(part[new].astype(np.int32)), lists], [*kept, "fragment", "segment"])

    schema = docs.select(*kept).schema.add("fragment", "integer").add("segment", T.ArrayType(T.LongType()))
    return docs.select(*kept, "text").mapInArrow(fn, schema)


def _few(df: DataFrame, rows: int) -> DataFrame:
    """Marked for a broadcast if its counted rows are few, else left to shuffles."""
    return F.broadcast(df) if rows <= FEW else df


def _links(pairs: DataFrame, sketches: DataFrame, own: DataFrame, n: int, percent: int, fragments: int) -> DataFrame:
    """Pairs (a, b) of (a, b, an, bn) whose summed overlap reaches the similarity; stored."""
    of = lambda side: sketches.select(F.col("doc").alias(side), F.col("sketch").alias(f"k{side}"))
    # a may be a pivot of many; joined first, its rows can be split, as they are dealt anew by b
    met = pairs.join(of("a"), "a").join(of("b"), "b").where(_alike("ka", "kb", "an", "bn", percent))
    close = stored(met.select("a", "b", "an", "bn").distinct())
    rows = close.count()
    if not rows:
        return close.select("a", "b")
    targets = close.groupBy("b").agg(F.collect_list(F.struct("a", "an", "bn")).alias("to")).withColumnRenamed("b", "doc_id")
    right = _segments(own.join(_few(targets, rows), "doc_id"), n, fragments, "to").select(F.col("doc_id").alias("b"), F.explode("to").alias("t"), "fragment", F.col("segment").alias("sb"))
    firsts = close.select(F.col("a").alias("doc_id")).distinct()
    left = _segments(own.join(_few(firsts, rows), "doc_id", "left_semi"), n, fragments).select(F.col("doc_id").alias("a"), "fragment", F.col("segment").alias("sa"))
    both = right.select("b", "t.a", "t.an", "t.bn", "fragment", "sb").join(left, ["a", "fragment"])
    partial = both.select("a", "b", "an", "bn", "fragment", F.size(F.array_intersect("sa", "sb")).cast("long").alias("part"))
    partial = partial.repartition("a", "b")  # else a pivot's many partners are summed in the one task that joined them
    one = partial.groupBy("a", "b", "an", "bn", "fragment").agg(F.max("part").alias("part"))  # repeated rows of an id count once
    total = one.groupBy("a", "b", "an", "bn").agg(F.sum("part").alias("both"))
    linked = stored(total.where(100 * F.col("both") >= percent * (F.col("an") + F.col("bn") - F.col("both"))).select("a", "b"))
    forget(close)
    return linked


def contract(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (doc, comp) after joining the components that links (a, b) connect; both are given up for the result."""
    at = lambda side: labels.select(F.col("doc").alias(side), F.col("comp").alias(f"c{side}"))
    edges = stored(links.join(at("a"), "a").join(at("b"), "b").where("ca != cb").select(F.col("ca").alias("u"), F.col("cb").alias("v")).distinct())
    maps = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        down = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("to")).where("to != u"))
        maps.append(down)
        to = lambda side: down.select(F.col("u").alias(side), F.col("to").alias(f"t{side}"))  # noqa: B023, E731
        fewer = stored(
            edges.join(to("u"), "u", "left").join(to("v"), "v", "left").select(F.coalesce("tu", "u").alias("u"), F.coalesce("tv", "v").alias("v")).where("u != v").distinct()
        )
        forget(edges)
        edges = fewer
    forget(edges, links)
    if not maps:
        return labels
    told = labels
    for down in maps:
        told = told.join(down.select(F.col("u").alias("comp"), "to"), "comp", "left").select("doc", F.coalesce("to", "comp").alias("comp"))
    told = stored(told)
    forget(labels, *maps)
    return told


def _near(x: Column, y: Column, percent: int) -> Column:
    return (100 * F.least(x, y)) >= (percent * F.greatest(x, y))


def _salted(df: DataFrame, of: str) -> DataFrame:
    """Members of a bucket (its size in `most`) dealt to its salts."""
    return df.withColumn("salt", F.pmod(F.xxhash64(of), F.floor(F.col("most") / SALT) + 1))


def _to_salts(df: DataFrame) -> DataFrame:
    """Rows that meet all members of a bucket, one for each of its salts."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("most") / SALT))))


def _buckets(reps: DataFrame) -> DataFrame:
    """Buckets h of two members or more, each set of members once: h, doc, n, most (members in all), least and least_n."""
    entries = reps.select(F.explode("sent").alias("h"), F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"))
    again = stored(entries.groupBy("h").agg(F.count("*").alias("__n")).where("__n > 1").select("h"))  # counted before the shuffle; a hot h is a row for each task
    shared = stored(entries.join(again, "h"))
    hashed = F.xxhash64("doc")
    total = lambda x: F.sum(F.shiftrightunsigned(x, 28))  # noqa: E731  of multisets: a member that an id's other text brings again does not cancel
    tally = shared.groupBy("h").agg(F.count("*").alias("most"), F.min(F.struct("doc", "n")).alias("least"), F.max("doc").alias("last"), total(hashed).alias("x1"), total(F.xxhash64(hashed)).alias("x2"))
    kept = stored(tally.where("least.doc != last").groupBy("most", "least", "last", "x1", "x2").agg(F.min("h").alias("h")).select("h", "most", F.col("least.doc").alias("least"), F.col("least.n").alias("least_n")))
    members = stored(shared.join(kept, "h").where("doc != least"))
    forget(again, shared, kept)
    return members


def components(docs: DataFrame, n: int = 4, percent: int = 85, fragments: int = 4, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id (the least id of the component)."""
    own = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    sets = stored(_sets(own, n, percent))
    key = ["k1", "k2", "n_shingles"]
    classes = stored(sets.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("rep")))
    reps = stored(sets.join(classes.withColumnRenamed("rep", "doc_id"), [*key, "doc_id"], "left_semi").dropDuplicates([*key, "doc_id"]).select("doc_id", "n_shingles", "sent", "sketch"))
    ids = stored(sets.select("doc_id", *key))
    forget(sets)
    members = _buckets(reps)
    met = members.where(_near(F.col("least_n"), F.col("n"), percent)).groupBy(F.col("least").alias("a"), F.col("doc").alias("b"), F.col("least_n").alias("an"), F.col("n").alias("bn"))
    met = stored(met.agg(F.count("*").alias("shared")))
    involved = members.select(F.explode(F.array("least", "doc")).alias("doc")).distinct()
    labels = stored(involved.select("doc", F.col("doc").alias("comp")))
    sketches = stored(reps.select(F.col("doc_id").alias("doc"), "sketch").join(labels, "doc", "left_semi"))
    forget(reps)
    # the pivot that a document shares most with comes first; of its others, those that this has not connected to it
    first = stored(met.groupBy("b").agg(F.max(F.struct("shared", "a", "an", "bn")).alias("x")).select("x.a", "b", "x.an", "x.bn"))
    labels = contract(labels, _links(first, sketches, own, n, percent, fragments))
    at = lambda side: labels.select(F.col("doc").alias(side), F.col("comp").alias(f"c{side}"))
    others = stored(met.join(first.select("a", "b"), ["a", "b"], "left_anti").join(at("b"), "b").join(at("a"), "a").where("ca != cb").select("a", "b", "an", "bn"))
    labels = contract(labels, _links(others, sketches, own, n, percent, fragments))
    done = [first, others]
    tested = met.select("a", "b")
    left = members.where("most > 2").select("h", "doc", "n", "most")
    turn = 0
    while True:
        turn += 1
        told = left.join(labels, "doc")
        of = told.groupBy("h", "most").agg(F.count("*").alias("size"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min_by("doc", F.xxhash64("doc", F.lit(turn))).alias("first")).where("c0 != c1")
        open_ = _salted(told, "doc").join(_to_salts(of.select("h", "most", "size", "first")), ["h", "most", "salt"])
        active = stored(open_.join(sketches, "doc"))
        done.append(active)
        if active.isEmpty():
            break
        pivot = (F.col("size") <= SMALL) | (F.col("doc") == F.col("first")) | (F.pmod(F.xxhash64("doc", F.lit(turn)), F.col("size")) < F.lit(8 ** (turn - 1)))
        marked = active.withColumn("pivot", pivot)
        one = _to_salts(marked.where("pivot").select("h", "most", F.col("doc").alias("p"), F.col("n").alias("pn"), F.col("comp").alias("pc"), F.col("sketch").alias("ps")))
        cand = marked.join(one, ["h", "most", "salt"]).where(
            (F.col("comp") != F.col("pc")) & _near(F.col("n"), F.col("pn"), percent) & _alike("sketch", "ps", "n", "pn", percent) & (~F.col("pivot") | (F.col("doc") > F.col("p")))
        )
        lo, hi = F.least(F.struct(F.col("p").alias("d"), F.col("pn").alias("n")), F.struct(F.col("doc").alias("d"), "n")), F.greatest(F.struct(F.col("p").alias("d"), F.col("pn").alias("n")), F.struct(F.col("doc").alias("d"), "n"))
        pairs = cand.select(lo.alias("lo"), hi.alias("hi")).distinct().select(F.col("lo.d").alias("a"), F.col("hi.d").alias("b"), F.col("lo.n").alias("an"), F.col("hi.n").alias("bn"))
        pairs = stored(pairs.join(tested, ["a", "b"], "left_anti"))
        done.append(pairs)
        labels = contract(labels, _links(pairs, sketches, own, n, percent, fragments))
        tested = tested.unionByName(pairs.select("a", "b"))
        left = marked.where("not pivot").select("h", "doc", "n", "most")
    named = ids.join(classes, key, "left").join(labels.select(F.col("doc").alias("rep"), "comp"), "rep", "left")
    found = stored(named.select("doc_id", "n_shingles", F.coalesce("comp", "rep", "doc_id").alias("component_id")))
    forget(ids, classes, labels, members, met, sketches, *done)
    return found
