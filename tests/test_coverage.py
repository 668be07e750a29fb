"""Bounded paths and source matching, traversals with their status, comparisons with coverage."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from tests.test_machines import searched
from tracewell.operators import coverage, graph, match
from tracewell.plans import catalog
from tracewell.plans import coverage as plans

FOLDER = "/root/testdata/sf0.01"


def seen(spark, name, column):
    return {r[0] for r in catalog.QUERIES[name](spark, FOLDER).select(column).distinct().collect()}


def test_outcomes_at_size(spark):
    told = catalog.QUERIES["source_match_budget"](spark, FOLDER).selectExpr("CASE WHEN evaluated = 0 THEN 'none' WHEN omitted > 0 THEN 'some' ELSE 'all' END AS k").distinct().collect()
    assert {r.k for r in told} == {"all", "some", "none"}
    assert seen(spark, "member_items", "status") == set(coverage.STATUSES) and seen(spark, "member_items", "matching") == set(coverage.MATCHINGS)
    assert seen(spark, "member_coverage", "coverage") >= {"partial", "truncated"}


# ---- paths


def all_paths(edges, start, goal, depth):
    out, todo = [], [(start,)]
    while todo:
        p = todo.pop()
        if p[-1] == goal:
            out.append(p)
        elif len(p) <= depth:
            todo += [(*p, b) for a, b in edges if a == p[-1] and b not in p]
    return sorted(out, key=lambda p: (len(p), p))


@pytest.mark.parametrize("seed", [1, 2])
def test_routes_against_all_paths(spark, seed):
    rng = random.Random(seed)
    edges = {(rng.randrange(9), rng.randrange(9)) for _ in range(24)}
    known = [x for x in range(9) if x not in (2, 7)]
    pairs = [(a, b) for a in range(9) for b in (0, 3, 7, 11)]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = graph.routes(df(sorted(edges), "src long, dst long"), df([*pairs, (None, 3), (4, None)], "start long, goal long"), 4, 2, df([(x,) for x in known], "node long")).where("start IS NOT NULL AND goal IS NOT NULL")
    for r in got.collect():
        want = all_paths(edges, r.start, r.goal, 4)
        reach, front = {r.start}, {r.start}
        for _ in range(3):
            front = {b for a, b in edges if a in front} - reach
            reach |= front
        rest = "not_found" if reach <= set(known) else "unknown"
        assert r.status == ("truncated" if len(want) > 2 else "found" if want else rest), r
        assert r.paths == min(len(want), 2) and r.hops == (len(want[0]) - 1 if want else None) and r.first == (",".join(map(str, want[0])) if want else None)


def test_routes_end_in_a_dense_graph(spark):
    """Of twelve nodes that all lead to each other only the last leads on to the goal; bounds on open paths keep the shortest."""
    n = 12
    rows = [(a, b) for a in range(n) for b in range(n) if a != b] + [(n - 1 if i == 0 else 100 + i - 1, 100 + i) for i in range(3)]
    edges = spark.createDataFrame(rows, "src long, dst long")
    complete = edges.select(F.col("src").alias("node")).distinct()
    ask = lambda most: graph.routes(edges, spark.createDataFrame([(0, 102)], "start long, goal long"), 7, 5, complete, max_open=most).first()
    assert tuple(ask(20))[2:] == ("truncated", 5, 4, "0,11,100,101,102")


# ---- source matching


@pytest.mark.parametrize("most", [0, 1, 7, 23, 10_000])
def test_budget_of_evaluations(spark, most):
    rng = random.Random(5)
    path = lambda: rng.choice(["a/", "b/", ""]) + rng.choice(["x.js", "y.js", "index.html"])
    s = spark.createDataFrame([(3000 * i, rng.choice([path(), path(), None]), rng.choice(["d1", "d2", None])) for i in range(30)], "id long, path string, digest string")
    n = spark.createDataFrame([(i, rng.choice([path(), None]), rng.choice([path(), None]), rng.choice(["d1", "d2", "d3", None])) for i in range(25)], "id long, path string, original string, digest string")
    a, b = match.place_classes(s, "id", ["path"]), match.place_classes(n, "id", ["path", "original"])
    base = lambda p: None if p is None else p.rsplit("/", 1)[-1]
    sources, nodes = collections.defaultdict(set), collections.defaultdict(set)
    for r in a.collect():
        sources[r.class_id].add((base(r.path), r.digest))
    for r in b.collect():
        nodes[r.class_id].add((base(r.path), base(r.original), r.digest))
    hits, whole = [], {}
    for c in sorted(sources):
        own = {(m, "~") for m, told in nodes.items() for x in told for y in sources[c] if y[0] is not None and y[0] in x[:2]}
        own |= {(m, x[2]) for m, told in nodes.items() for x in told for y in sources[c] if x[2] is not None and x[2] == y[1]}
        hits += [(c, *h) for h in sorted(own)]
        whole[c] = len(own)
    reached = collections.Counter(c for c, *_ in hits[:most])
    budget = match.evaluations(a, b, most, width=4000)
    assert {tuple(r) for r in budget.collect()} == {(c, k, reached[c], k - reached[c]) for c, k in whole.items()}
    got = {(r.source, r.node, r.digest or "~") for r in match.signal_pairs(a, b, least=0, budget=budget).collect()}
    assert got == set(hits[:most])


# ---- traversals


def test_answers_against_the_search(spark):
    d = "/root/testdata/sf0.001"
    got = collections.defaultdict(list)
    for r in catalog.QUERIES["traversal_answers"](spark, d).collect():
        got[r.question].append(r)
    statuses = {q: rows[0].status for q, rows in got.items()}
    assert set(statuses.values()) == {"found", "truncated", "partial", "ambiguous", "no-match", "unsupported"}
    edges = plans.traversal_edges(spark, d)
    for name, direction, allowed, where, bounds, sink in plans.QUESTIONS:
        if direction not in graph.DIRECTIONS:
            assert [tuple(r)[2:] for r in got[name]] == [(None, None, None)]
            continue
        entries = [tuple(r) for r in graph.turned(edges, direction, allowed).select("id", "at", "relation", "next").collect()]
        seeds = [f"p{r[0]}" for r in spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey AS id").where(where).collect()]
        depths, _, frontier = searched(entries, seeds, *bounds)
        why = collections.defaultdict(set)
        for node, _, reason in frontier:
            why[node].add(reason)
        want = {(n, depths[n], ",".join(sorted(why[n])) or None) for n in depths} or {(None, None, None)}
        assert {tuple(r)[2:] for r in got[name]} == want, name


def test_queries_without_edges_or_seeds(spark):
    edges = spark.createDataFrame([], "id long, src long, dst long, relation string")
    nodes, status = graph.answered(edges, spark.createDataFrame([(1,), (None,)], "node long"), "ownership", None, 5, 5, 2)
    assert [tuple(r) for r in nodes.collect()] == [(1, 0, None)] and status == "found"
    assert graph.answered(edges, spark.createDataFrame([], "node long"), "callers", None, 5, 5, 2)[1] == "no-match"


# ---- comparisons


def test_items_and_coverage(spark):
    rows = "id long, module string, k string, v long"
    left = spark.createDataFrame([(1, "m", "a", 1), (2, "m", "b", 1), (3, "m", "c", 1), (4, "m", "d", 1), (5, "m", "d", 1), (6, "m", None, 1), (7, None, "a", 1)], rows)
    right = spark.createDataFrame([(11, "m", "a", 1), (12, "m", "b", 2), (13, "m", "x", 1), (14, "m", "d", 1), (15, None, "a", None), (16, "z", "a", 1)], rows)
    tiers = [("key", F.col("k"))]
    sides = spark.createDataFrame([("m", True, False), ("z", None, True)], "module string, left_complete boolean, right_complete boolean")
    got = {tuple(r)[1:] for r in coverage.items(left, right, "id", ["module"], tiers, "v", sides).collect()}
    assert got == {
        (1, 11, "key", "matched", "unchanged"), (2, 12, "key", "matched", "changed"), (3, None, "none", "unmatched", "unknown"), (4, None, "key", "ambiguous", "unknown"), (5, None, "key", "ambiguous", "unknown"),
        (None, 14, "key", "ambiguous", "unknown"), (6, None, "none", "unmatched", "unknown"), (None, 13, "none", "unmatched", "added"), (7, 15, "key", "matched", "changed"), (None, 16, "none", "unmatched", "unknown"),
    }


def test_summary(spark):
    found = spark.createDataFrame([("a", 1, 2, "matched", "unchanged"), ("a", 3, None, "unmatched", "removed"), ("b", 4, 5, "matched", "changed"), ("d", 6, 7, "matched", "changed")], "g string, left_id long, right_id long, matching string, status string")
    sides = spark.createDataFrame([("a", 0, True, True, True), ("b", 0, True, True, True), ("c", 2, False, True, True), ("d", 3, True, False, None), ("e", 0, None, True, True)], "g string, omitted long, left_complete boolean, right_complete boolean, known boolean")
    told = {r.g: r for r in coverage.summary(found, "g", 1, sides).collect()}
    assert {g: r.coverage for g, r in told.items()} == {"a": "truncated", "b": "complete-within-inputs", "c": "truncated", "d": "partial", "e": "partial"}
    assert (told["a"].unchanged, told["a"].removed, told["a"].omitted_items) == (1, 0, 1) and told["c"].unchanged == 0 and told["c"].left_status == "partial" and told["d"].left_status == "partial"


def test_pages(spark):
    m = spark.createDataFrame([(i, "a" if i < 5 else "b") for i in range(7)], "id long, g string")
    page = coverage.paged(m, ["g"], ["id"], F.lit(3))
    assert {tuple(r) for r in coverage.omissions(m, page, ["g"]).collect()} == {("a", 5, 3, 2, False), ("b", 2, 2, 0, True)}


@pytest.mark.parametrize("few", [0, 9, 10_000])
def test_small_fronts_take_one_job_each(spark, few):
    rng = random.Random(5)
    rows = [(i, rng.randrange(14), rng.randrange(14), rng.choice(["calls", "owns"])) for i in range(34)]
    entries = graph.turned(spark.createDataFrame(rows, "id long, src long, dst long, relation string"), "ownership")
    own, seeds, sc = [tuple(r) for r in entries.collect()], [0, 1, 2, 3], spark.sparkContext
    for bounds in [(9, 8, 2), (99, 99, 9), (3, 99, 9)]:
        sc.setJobGroup(f"few {few} {bounds}", "")
        nodes, edges, frontier = graph.traverse(entries, spark.createDataFrame([(s,) for s in seeds], "node long"), *bounds, few=few)
        jobs = len(sc.statusTracker().getJobIdsForGroup(f"few {few} {bounds}"))
        sc.setLocalProperty("spark.jobGroup.id", None)
        want = searched(own, seeds, *bounds)
        assert ({r.node: r.depth for r in nodes.collect()}, {r.id for r in edges.collect()}, {tuple(r) for r in frontier.collect()}) == want
        assert few < 99 or jobs <= 3 * (2 + max(want[0].values()))
