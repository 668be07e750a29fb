"""Entity matching: tiers of unique keys, consuming matches, scores, sequences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import status
from tracewell.operators import graph


def _unique(df: DataFrame, id_col: str, key: Column) -> DataFrame:
    """Keys that exactly one row has, with that row's id."""
    own = df.select(key.alias("__k"), F.col(id_col).alias("__id")).where("__k IS NOT NULL")
    return own.groupBy("__k").agg(F.count("*").alias("__n"), F.min("__id").alias("__id")).where("__n = 1").drop("__n")


def tiered_unique(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tiers: list[tuple[str, Column]]) -> DataFrame:
    """left_id, right_id, tier.  A key matches if it is unique on both sides among rows not matched yet."""
    found, a, b = None, left, right
    for name, key in tiers:
        u, v = _unique(a, left_id, key), _unique(b, right_id, key)
        hit = u.withColumnRenamed("__id", "left_id").join(v.withColumnRenamed("__id", "right_id"), "__k").select("left_id", "right_id", F.lit(name).alias("tier"))
        found = hit if found is None else found.unionByName(hit)
        a = a.join(hit.select(F.col("left_id").alias(left_id)), left_id, "left_anti")
        b = b.join(hit.select(F.col("right_id").alias(right_id)), right_id, "left_anti")
    return found


def consuming(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tiers: list[tuple[str, Column]]) -> DataFrame:
    """left_id, tier, status and candidates; an ambiguous key uses its rows up."""
    parts, a = [], left
    for name, key in tiers:
        have = right.select(key.alias("__k"), F.col(right_id).alias("__r")).groupBy("__k").agg(F.count("*").alias("candidates"), F.min("__r").alias("right_id"))
        hit = a.select(F.col(left_id).alias("left_id"), key.alias("__k")).join(have, "__k").select(
            "left_id", F.lit(name).alias("tier"), F.when(F.col("candidates") == 1, "matched").otherwise("ambiguous").alias("status"), "candidates", F.when(F.col("candidates") == 1, F.col("right_id")).alias("right_id")
        )
        parts.append(hit)
        a = a.join(hit.select(F.col("left_id").alias(left_id)), left_id, "left_anti")
    none = a.select(F.col(left_id).alias("left_id"), F.lit("none").alias("tier"), F.lit("unmatched").alias("status"), F.lit(0).cast("long").alias("candidates"), F.lit(None).cast("long").alias("right_id"))
    return reduce(DataFrame.unionByName, [*parts, none])


def one_to_one(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tiers: list[tuple[str, Column]]) -> DataFrame:
    """side, id, tier, status, lefts, rights, partner: one row for every row of both sides.

    A key that both sides have is matched if one row on each side has it, else
    ambiguous; either way its rows on both sides are used up before the next
    tier.  A null key meets nothing.
    """
    parts, a, b = [], left.select(left_id, *[k.alias(f"__k{i}") for i, (_, k) in enumerate(tiers)]), right.select(right_id, *[k.alias(f"__k{i}") for i, (_, k) in enumerate(tiers)])
    told = lambda df, key, id_col, n, out: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(n), F.min(id_col).alias(out))
    single = (F.col("lefts") == 1) & (F.col("rights") == 1)
    for i, (name, _) in enumerate(tiers):
        key = f"__k{i}"
        groups = told(a, key, left_id, "lefts", "__l").join(told(b, key, right_id, "rights", "__r"), key)
        for side, df, own, other in (("left", a, left_id, "__r"), ("right", b, right_id, "__l")):
            status = F.when(single, "matched").otherwise("ambiguous")
            parts.append(df.join(groups, key).select(F.lit(side).alias("side"), F.col(own).alias("id"), F.lit(name).alias("tier"), status.alias("status"), "lefts", "rights", F.when(single, F.col(other)).alias("partner")))
        used = groups.select(key)
        a, b = a.join(used, key, "left_anti"), b.join(used, key, "left_anti")
    zero = F.lit(0).cast("long")
    for side, df, own, other in (("left", a, left_id, right.schema[right_id]), ("right", b, right_id, left.schema[left_id])):
        parts.append(df.select(F.lit(side).alias("side"), F.col(own).alias("id"), F.lit("none").alias("tier"), F.lit("unmatched").alias("status"), zero.alias("lefts"), zero.alias("rights"), F.lit(None).cast(other.dataType).alias("partner")))
    return reduce(DataFrame.unionByName, parts)


def top_candidates(scored: DataFrame, by: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each `by`, with rank and the number of rows left out."""
    w = Window.partitionBy(by)
    ranked = scored.withColumn("rank", F.row_number().over(w.orderBy(F.desc(score), tie)))
    return ranked.withColumn("omitted", F.greatest(F.count("*").over(w) - k, F.lit(0))).where(F.col("rank") <= k)


def relational_division(rows: DataFrame, who: str, what: str, required: DataFrame) -> DataFrame:
    """Every `who` that has all required values of `what`."""
    need = required.select(what).distinct()
    have = rows.select(who, what).distinct().join(need, what, "left_semi").groupBy(who).agg(F.count("*").alias("have"))
    return have.crossJoin(F.broadcast(need.agg(F.count("*").alias("need")))).where("have = need").select(who, "have")  # one row of one count


def asof(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str) -> DataFrame:
    """The latest right row at or before each left row, by union and window, not by a range join."""
    both = left.select(key, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.lit(None).cast(right.schema[right_time].dataType).alias("__vt")).unionByName(
        right.select(key, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.col(value).alias("__v"), F.col(right_time).alias("__vt")), allowMissingColumns=True
    )
    w = Window.partitionBy(key).orderBy("__t", "__side", "__v").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("last_value", F.last("__v", True).over(w)).withColumn("last_time", F.last("__vt", True).over(w))
    return seen.where("__side = 1").select("__row.*", "last_value", "last_time")


def contained(points: DataFrame, ranges: DataFrame, at: str, start: str, end: str, width: int) -> DataFrame:
    """Every point with the range [start, end) that holds it, or nulls.

    Ranges are dealt to buckets of `width`, so the join is an equi-join; give a
    width near the usual length of a range.
    """
    cells = F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))
    dealt = ranges.where(F.col(end) > F.col(start)).withColumn("__cell", F.explode(cells))
    own = points.withColumn("__cell", F.floor(F.col(at) / width))
    inside = (own["__cell"] == dealt["__cell"]) & (own[at] >= dealt[start]) & (own[at] < dealt[end])
    return own.join(dealt, inside, "left").drop("__cell")


def unique_target(left: DataFrame, right: DataFrame, key: str, target: str) -> DataFrame:
    """left rows with status and target: paired if exactly one right row has the key."""
    have = right.groupBy(key).agg(F.count("*").alias("candidates"), F.min(target).alias("__t"))
    n = F.coalesce("candidates", F.lit(0).cast("long"))
    status = F.when(n == 0, "unpaired").when(n == 1, "paired").otherwise("ambiguous")
    return left.join(have, key, "left").withColumn("candidates", n).withColumn("status", status).withColumn("target", F.when(n == 1, F.col("__t"))).drop("__t")


def reciprocal(left: DataFrame, right: DataFrame, left_id: str, right_id: str, keys: list[Column]) -> DataFrame:
    """left_id, right_id: pairs that keys unique on each side point at, where both sides have this one partner."""
    named = [F.concat(F.lit(f"{i}:"), k) for i, k in enumerate(keys)]

    def unique(df: DataFrame, id_col: str, out: str) -> DataFrame:
        every = df.select(F.explode(F.array(*named)).alias("__k"), F.col(id_col).alias("__id")).where("__k IS NOT NULL")
        return every.groupBy("__k").agg(F.count("*").alias("__n"), F.min("__id").alias(out)).where("__n = 1").drop("__n")

    pairs = unique(left, left_id, "left_id").join(unique(right, right_id, "right_id"), "__k").select("left_id", "right_id").distinct()
    one = pairs.groupBy("left_id").agg(F.count("*").alias("__n"), F.min("right_id").alias("right_id")).where("__n = 1")
    back = pairs.groupBy("right_id").agg(F.count("*").alias("__m"), F.min("left_id").alias("left_id")).where("__m = 1")
    return one.join(back, ["left_id", "right_id"]).select("left_id", "right_id")


def reconcile(entities: DataFrame, candidates: DataFrame, entity: str, candidate: str, digest: str, place: str) -> DataFrame:
    """entity, status, candidate.

    Content and place together win, then unique content; a place alone counts
    only for an entity whose content was not captured (null digest).  Candidates
    are counted by key before the joins, so no key fans out.
    """
    told = lambda *by: candidates.groupBy(*by).agg(F.count("*").alias(f"__n{len(by)}{by[0]}"), F.min(candidate).alias(f"__c{len(by)}{by[0]}"))
    found = entities.join(told(digest, place), [digest, place], "left").join(told(digest), digest, "left").join(told(place), place, "left")
    both, content, at = (F.coalesce(F.col(c), F.lit(0).cast("long")) for c in (f"__n2{digest}", f"__n1{digest}", f"__n1{place}"))
    bare = F.col(digest).isNull()
    status = (
        F.when(both == 1, "content_and_location").when(content == 1, "content").when(content > 1, "ambiguous")
        .when(bare & (at == 1), "location").when(bare & (at > 1), "ambiguous").otherwise("unmatched")
    )
    chosen = F.when(status == "content_and_location", F.col(f"__c2{digest}")).when(status == "content", F.col(f"__c1{digest}")).when(status == "location", F.col(f"__c1{place}"))
    return found.select(entity, status.alias("status"), chosen.alias("candidate"))


def scored(sources: DataFrame, nodes: DataFrame, source: str, node: str, block: str, signals: list[tuple[str, int]], least: int) -> DataFrame:
    """source, node, score, rank of node classes that share the blocking key.

    Rows alike in all signals are one class on each side, represented by its
    least id, so copies do not multiply.  A signal adds its points if equal.
    """
    cols = [block, *[c for c, _ in signals if c != block]]
    a = sources.groupBy(*cols).agg(F.min(source).alias("source"))
    b = nodes.groupBy(*cols).agg(F.min(node).alias("node"))
    b = b.select("node", F.col(block), *[F.col(c).alias(f"__{c}") for c in cols if c != block])
    points = sum((F.when(F.lit(True) if c == block else F.col(c) == F.col(f"__{c}"), w).otherwise(0) for c, w in signals), F.lit(0))
    found = a.join(b, block).withColumn("score", points).where(F.col("score") >= least)
    return found.select("source", "node", "score", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "node")).alias("rank"))


def place_classes(rows: DataFrame, row: str, cols: list[str]) -> DataFrame:
    """rows with class_id, the least id of the rows alike in cols (nulls are alike)."""
    least = rows.groupBy(*[F.col(c).alias(f"__{c}") for c in cols]).agg(F.min(row).alias("class_id"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in cols])
    return rows.join(least, same).drop(*[f"__{c}" for c in cols])


def _base(c: str) -> Column:
    return F.substring_index(c, "/", -1)


def _by_name(nodes: DataFrame) -> DataFrame:
    """node, __b: the base names of a node's path and of its original one."""
    b = nodes.select(F.col("class_id").alias("node"), "path", "original").distinct()
    return b.select("node", F.explode(F.array_distinct(F.array(_base("path"), _base("original")))).alias("__b")).where("__b IS NOT NULL")


def _by_digest(places: DataFrame, out: str) -> DataFrame:
    return places.where("digest IS NOT NULL").select("digest", F.col("class_id").alias(out)).distinct()


def evaluations(sources: DataFrame, nodes: DataFrame, most: int, width: int = 1024) -> DataFrame:
    """source, hits, evaluated, omitted: how many of each source's candidates a budget for all of them reaches.

    A hit is a node class with the base name, or one digest that both have, so
    hits follow from the counts of the two indexes and no pair is made.  Sources
    use the budget up in the order of their ids; ids are whole numbers, and one
    row for each `width` of them meets in one task.
    """
    names = _by_name(nodes).groupBy("__b").agg(F.count("*").alias("__n"))
    digests = _by_digest(nodes, "node").groupBy("digest").agg(F.count("*").alias("__n"))
    own = sources.select(F.col("class_id").alias("source"), "path").distinct()
    near = own.select("source", _base("path").alias("__b")).join(names, "__b").select("source", "__n")
    equal = _by_digest(sources, "source").join(digests, "digest").select("source", "__n")
    hits = near.unionByName(equal).groupBy("source").agg(F.sum("__n").alias("__hits"))
    every = own.select("source").distinct().join(hits, "source", "left").select("source", F.coalesce("__hits", F.lit(0)).cast("long").alias("hits"), F.floor(F.col("source") / width).alias("__cell"))
    before = lambda w: F.coalesce(F.sum("hits").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = every.groupBy("__cell").agg(F.sum("hits").alias("hits"))
    offsets = cells.select("__cell", before(Window.orderBy("__cell")).alias("__offset"))
    told = every.withColumn("__own", before(Window.partitionBy("__cell").orderBy("source"))).join(offsets, "__cell")
    evaluated = F.greatest(F.lit(0).cast("long"), F.least("hits", F.lit(most).cast("long") - F.col("__own") - F.col("__offset")))
    return told.select("source", "hits", evaluated.alias("evaluated")).withColumn("omitted", F.col("hits") - F.col("evaluated"))


def signal_pairs(sources: DataFrame, nodes: DataFrame, least: int = 20, budget: DataFrame | None = None) -> DataFrame:
    """source, node, digest, score, rank of classes of places.

    sources have class_id, path and digest, nodes also original, the path before
    bundling.  A row with a null digest holds for all pages of the two classes,
    one with a digest for those that both have it.  Candidates share the digest
    or a base name; the index of path suffixes finds no others, as a source's
    path that ends a node's path has its base name too.

    budget, from `evaluations`: a source without a candidate left makes no pair,
    and the one at which the budget ends only its first ones, by node and then
    digest, the base name last.
    """
    ext = lambda c: F.lower(F.regexp_extract(_base(c), r"^.+(\.[^.]*)$", 1))

    def candidates(some: DataFrame) -> DataFrame:
        near = some.select(F.col("class_id").alias("source"), _base("path").alias("__b")).distinct().join(_by_name(nodes), "__b").select("source", "node", F.lit(None).cast("string").alias("digest"))
        return near.unionByName(_by_digest(some, "source").join(_by_digest(nodes, "node"), "digest").select("source", "node", "digest"))

    a = sources.select(F.col("class_id").alias("source"), F.col("path").alias("own")).distinct()
    b = nodes.select(F.col("class_id").alias("node"), "path", "original").distinct()
    if budget is None:
        found = candidates(sources)
    else:
        whole = budget.where("evaluated = hits").select(F.col("source").alias("class_id"))
        found = candidates(sources.join(whole, "class_id", "left_semi"))
        last = budget.where("evaluated > 0 AND omitted > 0").select("source", "evaluated").first()  # one source at most
        if last is not None:
            found = found.unionByName(candidates(sources.where(F.col("class_id") == last.source)).orderBy("node", F.asc_nulls_last("digest")).limit(last.evaluated))
    found = found.join(a, "source").join(b, "node")
    ends = lambda c: F.endswith(F.col(c), F.concat(F.lit("/"), "own"))
    signals = [
        (F.col("digest").isNotNull(), 100), ((F.col("original") == F.col("own")) | ends("original"), 70), (F.col("path") == F.col("own"), 60), (ends("path"), 40),
        ((_base("path") == _base("own")) | (_base("original") == _base("own")), 20), ((ext("own") != "") & ((ext("path") == ext("own")) | (ext("original") == ext("own"))), 5),
    ]
    score = sum((F.when(hit, w).otherwise(0) for hit, w in signals), F.lit(0))
    w = Window.partitionBy("source").orderBy(F.desc("score"), "node", F.asc_nulls_last("digest"))
    return found.select("source", "node", "digest", score.alias("score")).where(F.col("score") >= least).withColumn("rank", F.row_number().over(w))


def listed(named: DataFrame, name: str, category: str, address: str, k: int) -> DataFrame:
    """category, name, address, n, position: names once each, at their least address; each category's count and its first k."""
    once = named.groupBy(name, category).agg(F.min(address).alias(address))
    w = Window.partitionBy(category)
    counted = once.withColumn("n", F.count("*").over(w)).withColumn("position", F.row_number().over(w.orderBy(address)))
    return counted.where(F.col("position") <= k).select(category, name, address, "n", "position")


def mappings(pairs: DataFrame, sources: DataFrame, source: str, complete: Column) -> DataFrame:
    """source, status, nodes for every source, from (source, node, score, exact, located) pairs.

    One exact node: unchanged, or merged if another source has that node alone
    too; several: duplicated.  Else the best-scored located nodes: one leaves
    the outcome open, a tie is a split.  Without any pair the source is removed
    if both inventories are complete.
    """
    best = pairs.groupBy(source).agg(F.max(F.when(F.col("located"), F.col("score"))).alias("__top"))
    at_top = F.col("located") & (F.col("score") == F.col("__top"))
    told = pairs.join(best, source).groupBy(source).agg(
        F.count("*").alias("__n"), F.count_if("exact").alias("__exact"), F.count_if(at_top).alias("__tied"), F.min(F.when(F.col("exact"), F.col("node"))).alias("__node")
    )
    shared = told.where("__exact = 1").groupBy("__node").agg((F.count("*") > 1).alias("__merged"))
    every = sources.select(source).join(told, source, "left").join(shared, "__node", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    own = status.source_mapping(F.lit(True), n("__exact"), n("__tied"), n("__n") > 0, complete)
    merged = F.coalesce((n("__exact") == 1) & F.col("__merged"), F.lit(False))
    nodes = F.when(n("__exact") > 0, n("__exact")).otherwise(n("__tied"))
    return every.select(source, F.when(merged, "merged").otherwise(own).alias("status"), nodes.alias("nodes"))


def gate(expected: DataFrame, actual: DataFrame, key: str, dimensions: list[str], volatile: set[str], truncated: Column) -> DataFrame:
    """key, mismatch, verdict: the first dimension, in order, whose actual value differs.

    Volatile dimensions are not looked at; one without an actual value leaves
    the verdict open; a mismatch or a truncated record fails.
    """
    own = [x for x in dimensions if x not in volatile]
    both = expected.select(key, *own).join(actual.select(key, *[F.col(x).alias(f"__{x}") for x in own]), key)
    differs = [F.col(f"__{x}").isNotNull() & ~F.col(x).eqNullSafe(F.col(f"__{x}")) for x in own]
    first = F.coalesce(*[F.when(bad, F.lit(x)) for x, bad in zip(own, differs, strict=True)])
    absent = reduce(lambda a, b: a | b, [F.col(f"__{x}").isNull() for x in own])
    return both.select(key, first.alias("mismatch"), status.trust_gate(first.isNotNull(), truncated, absent).alias("verdict"))


def required(subjects: DataFrame, have: DataFrame, key: str, check: str, need: list[tuple[str, str]]) -> DataFrame:
    """key, missing, findings, status: which of the (lane, check) pairs each subject has no proof of."""
    proofs = have.where(F.col(check).isin(*[c for _, c in need])).groupBy(key).agg(F.collect_set(check).alias("__have"))  # at most the checks of `need`
    absent = F.filter(F.array(*[F.when(~F.array_contains("__have", c), F.lit(f"{lane}:{c}")) for lane, c in sorted(need)]), lambda x: x.isNotNull())
    told = subjects.select(key).distinct().join(proofs, key, "left").withColumn("__have", F.coalesce("__have", F.array().cast("array<string>"))).select(key, absent.alias("a"))
    n = F.size("a").cast("long")
    return told.select(key, n.alias("missing"), F.when(n > 0, F.array_join("a", ",")).alias("findings"), F.when(n == 0, "ready").otherwise("blocked").alias("status"))


def reopened(nodes: DataFrame, needs: DataFrame) -> DataFrame:
    """id, own, status, dependency_open: nodes (id, own) that need, directly or not, one that is open are open."""
    bad = graph.spread(nodes.where("own = 'open'"), needs).withColumn("__open", F.lit(True))
    open_ = F.coalesce("__open", F.lit(False))
    return nodes.join(bad, "id", "left").select("id", "own", F.when(open_, "open").otherwise(F.col("own")).alias("status"), ((F.col("own") == "verified") & open_).alias("dependency_open"))


def merged(records: DataFrame, id_col: str, digest: str) -> DataFrame:
    """id, copies, digest, status: records of one id merge if they are the same, else they conflict."""
    n = records.groupBy(id_col, digest).agg(F.count("*").alias("__c"))
    g = n.groupBy(id_col).agg(F.sum("__c").alias("copies"), F.count("*").alias("__n"), F.min(digest).alias("__d"))
    return g.select(id_col, "copies", F.when(F.col("__n") == 1, F.col("__d")).alias("digest"), F.when(F.col("__n") > 1, "conflict").when(F.col("copies") > 1, "duplicate").otherwise("single").alias("status"))


def script_urls(scripts: DataFrame, resources: DataFrame, key: str) -> DataFrame:
    """key, status, resource: exact only if one resource alone has the script's url; a match without query and fragment is never exact."""
    same = resources.groupBy("url").agg(F.count("*").alias("__n"), F.min(key).alias("__hit"))
    near = resources.groupBy("clean").agg(F.count("*").alias("__m"))
    j = scripts.join(same, "url", "left").join(near, "clean", "left")
    one = F.col("__n") == 1
    return j.select(key, F.when(one, "exact").when((F.col("__n") > 1) | (F.col("__m") > 0), "ambiguous").otherwise("unmatched").alias("status"), F.when(one, F.col("__hit")).alias("resource"))


def aligned(before: DataFrame, after: DataFrame, key: str, step: str, order: str) -> DataFrame:
    """key, step, before, after, status: steps of two captures by name; a name that one of them has twice is a duplicate."""
    told = lambda df, at, n: df.groupBy(key, step).agg(F.min(order).alias(at), F.count("*").alias(n))
    j = told(before, "before", "__b").join(told(after, "after", "__a"), [key, step], "full_outer")
    twice = (F.coalesce("__b", F.lit(0)) > 1) | (F.coalesce("__a", F.lit(0)) > 1)
    status_ = F.when(twice, "duplicate").when(F.col("__b").isNull(), "missing_before").when(F.col("__a").isNull(), "missing_after").otherwise("aligned")
    return j.select(key, step, "before", "after", status_.alias("status"))
