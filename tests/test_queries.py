"""Every registered query of the reference's operators against DuckDB, on the smallest tables."""

import hashlib
import numbers
import os
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewell.operators import match, trace
from tracewell.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def plain(x):
    if pd.isna(x):
        return "null"
    return str(float(x)) if isinstance(x, numbers.Number) and not isinstance(x, bool) else str(x)


def rows(frame):
    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, FOLDER).toPandas(), duck.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_stand_ins_show_something(spark):
    count = lambda name, where="true": catalog.QUERIES[name](spark, FOLDER).where(where).count()
    assert count("anti_orphans") and count("late_rows") and count("lag_chain", "NOT valid")
    exact = spark.read.parquet(f"{FOLDER}/lineitem.parquet").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("n"))
    for r in catalog.QUERIES["approx_distinct"](spark, FOLDER).join(exact, "l_returnflag").collect():
        assert abs(r.parts - r.n) <= 0.2 * r.n


def test_automaton(spark):
    want = {}
    moves = {("new", "signup"): "member", ("member", "purchase"): "buyer", ("buyer", "signup"): "member"}
    for r in sorted(spark.read.parquet(f"{FOLDER}/events.parquet").collect(), key=lambda r: (r.ts, r.event_id)):
        state, n = want.get(r.user_id, ("new", 0))
        to = moves.get((state, r.event_type))
        want[r.user_id] = (to or state, n + (to is not None))
    assert {r.user_id: (r.state, r.matched) for r in catalog.fsm_replay(spark, FOLDER).collect()} == want


def test_first_divergence_of_every_key(spark):
    rows = [(u, t, i, k) for u, order in ((1, "ab"), (2, "aba"), (7, "abcab"), (8, "aab")) for i, (t, k) in enumerate(zip([0, 2, 1, 3, 4], order))]
    e = spark.createDataFrame(rows, "user_id int, ts int, event_id int, event_type string")
    left = trace.numbered(e, "user_id", ["ts", "event_id"], F.floor(F.col("ts") / 2))
    right = trace.numbered(e, "user_id", ["event_id"], F.floor(F.col("event_id") / 3))
    got = {tuple(r) for r in trace.divergence_by_key(left, right, "user_id", "position", "event_type").collect()}
    assert got == {(2, 2, "a", "b"), (7, 2, "c", "b"), (8, 2, "b", "a")}
    short = trace.divergence_by_key(left, left.where("user_id != 7 OR position < 3"), "user_id", "position", "event_type")
    assert [tuple(r) for r in short.collect()] == [(7, 3, "b", None)]


def test_first_divergence_reads_every_user(spark, tmp_path):
    rows = [(0, 5, 900, "a"), (1, 4, 900, "b"), (2, 1, 901, "b"), (3, 2, 901, "b"), (4, 1, 5000, "b"), (5, 7, 5000, "b")]
    e = spark.createDataFrame(rows, "event_id long, t long, user_id long, event_type string")
    e.withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in catalog.QUERIES["first_divergence_by_user"](spark, str(tmp_path)).collect()] == [(900, 901, 2, "a", "b")]


def test_variants_keep_all_events(spark, tmp_path):
    rows = [(1, 0, "a"), (1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 0, "a"), (2, 1, "a"), (2, 2, "b"), (2, 3, "d"), (3, 0, "b"), (3, 1, "a"), (3, 2, "c"), (3, 3, "a")]
    e = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_id long, user_id int, t long, event_type string")
    e.withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    assert {tuple(r) for r in catalog.QUERIES["trace_variants_whole"](spark, str(tmp_path)).collect()} == {("a:2,b:1,c:1", 2), ("a:2,b:1,d:1", 1)}


def test_one_to_one_uses_up_both_sides(spark):
    left = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "y"), (4, "c", "y"), (5, None, "z"), (6, "d", "w")], "id int, k string, j string")
    right = spark.createDataFrame([(11, "a", "x"), (12, "q", "x"), (13, "c", "y"), (14, None, "z"), (15, None, "v")], "id int, k string, j string")
    got = {tuple(r)[:4] + tuple(r)[6:] for r in match.one_to_one(left, right, "id", "id", [("full", F.col("k")), ("partial", F.col("j"))]).collect()}
    assert got == {
        ("left", 1, "full", "matched", 11), ("right", 11, "full", "matched", 1), ("left", 2, "partial", "matched", 12), ("right", 12, "partial", "matched", 2),
        ("left", 3, "full", "ambiguous", None), ("left", 4, "full", "ambiguous", None), ("right", 13, "full", "ambiguous", None),
        ("left", 5, "partial", "matched", 14), ("right", 14, "partial", "matched", 5), ("left", 6, "none", "unmatched", None), ("right", 15, "none", "unmatched", None),
    }


def test_signal_pairs_keep_every_page(spark):
    s = spark.createDataFrame([(2, "src/a.js", "d1"), (4, "src/a.js", "d2"), (6, "b", "d3"), (8, None, "d4")], "id int, path string, digest string")
    n = spark.createDataFrame(
        [(1, "src/a.js", None, "d2"), (3, "src/a.js", None, "d9"), (5, "x/src/a.js", None, "d8"), (7, "z.js", "src/a.js", "d7"), (9, "other", None, "d3"), (11, None, None, "d4")],
        "id int, path string, original string, digest string",
    )
    a, b = match.place_classes(s, "id", ["path"]), match.place_classes(n, "id", ["path", "original"])
    assert {(r.id, r.class_id) for r in a.collect()} == {(2, 2), (4, 2), (6, 6), (8, 8)}
    assert {(r.id, r.class_id) for r in b.collect()} == {(1, 1), (3, 1), (5, 5), (7, 7), (9, 9), (11, 11)}
    got = {tuple(r) for r in match.signal_pairs(a, b).collect()}
    assert got == {(2, 1, "d2", 185, 1), (2, 7, None, 95, 2), (2, 1, None, 85, 3), (2, 5, None, 65, 4), (6, 9, "d3", 100, 1), (8, 11, "d4", 100, 1)}


# -- queries whose SQL had made their job smaller: all lines, kinds and units count
LARGER = "/root/testdata/sf0.01"


def test_relational_division_counts_every_line(spark):
    lines, part = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("lineitem", "part"))
    brands = dict(part.select("p_partkey", "p_brand").collect())
    have = {}
    for who, what in lines.select("l_suppkey", "l_partkey").collect():
        have.setdefault(who, set()).add(brands[what])
    want = {(who, len(b)) for who, b in have.items() if len(b) == len(set(brands.values()))}
    assert {tuple(r) for r in catalog.QUERIES["relational_division"](spark, LARGER).collect()} == want and len(want) == 100


def test_comparable_payloads_compare_to_the_unit(spark):
    totals = {}
    for r in spark.read.parquet(f"{LARGER}/events.parquet").select("user_id", "event_type", "ts", "value").collect():
        n, total = totals.setdefault((r.user_id, r.event_type), {}).get(r.ts.day < 16, (0, 0.0))
        totals[r.user_id, r.event_type][r.ts.day < 16] = (n + 1, total + r.value)
    want = {k: t[True][0] == t[False][0] and round(t[True][1]) == round(t[False][1]) for k, t in totals.items() if len(t) == 2}
    told = catalog.QUERIES["comparable_payloads"](spark, LARGER).collect()
    assert {(r.user_id, r.event_type): r.exact for r in told} == want and any(r.same and not r.exact for r in told)


def test_hypotheses_take_all_kinds_exactly(spark):
    told = catalog.QUERIES["hypothesis_join"](spark, LARGER).collect()
    events = spark.read.parquet(f"{LARGER}/events.parquet").select("user_id", "event_type", "ts", "value").collect()
    assert {(r.user_id, r.event_type) for r in told if not r.all_kinds} == {(e.user_id, e.event_type) for e in events}
    n, sums = {}, {}
    for e in events:
        early = e.ts.day < 16
        n.setdefault(e.user_id, {}).setdefault(e.event_type, [0, 0])[early] += 1
        sums.setdefault(e.user_id, [0.0, 0.0])[early] += e.value
    for r in (r for r in told if r.all_kinds):
        counts, (late, early) = n[r.user_id].values(), sums[r.user_id]
        moved, differs = any(a != b for a, b in counts), round(late) != round(early)
        want = "unknown" if any(0 in c for c in counts) else {(True, True): "cochanged", (True, False): "static_only", (False, True): "runtime_only", (False, False): "both_unchanged"}[moved, differs]
        assert (r.exact_pattern, r.exact_verdict) == (want, {"unknown": "unresolved", "cochanged": "consistent"}.get(want, "contradicted"))


def test_graph_identity_has_every_line(spark):
    lines, part = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("lineitem", "part"))
    target = {r.p_partkey: f"{r.p_type}/{r.p_brand}" for r in part.collect()}
    edges = {}
    for who, what in lines.select("l_suppkey", "l_partkey").collect():
        edges.setdefault(who, set()).add(target[what])
    want = {k: (len(v), hashlib.sha256(",".join(sorted(v)).encode()).hexdigest()) for k, v in edges.items()}
    assert {r.node: (r.degree, r.edges_digest) for r in catalog.QUERIES["graph_identity"](spark, LARGER).where("graph = 'whole'").collect()} == want


def test_capture_ages_of_any_time_in_any_zone(spark, tmp_path):
    rng = random.Random(2)
    edge = [-1501, -1500, -1499, -501, -500, -499, -1, 0, 1, 499, 500, 1500, 59_999_499, 59_999_500, 1_705_881_599_999_499, 1_705_881_600_000_500, 59_999_999, 60_000_000, -30_000_000, -60_000_000, -60_000_001, 1_705_881_600_000_000, 1_705_881_599_999_999, 1_710_054_000_000_000, 253_402_300_799_999_999]
    at = edge + [rng.randrange(-(10**16), 10**16) for _ in range(300)] + [None]
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT i AS event_id, make_timestamp(us) AS ts FROM (SELECT unnest(?::BIGINT[]) AS us, unnest(range(?)) AS i)", [at, len(at)])
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    want, zone = set(con.execute(f"SELECT event_id, stale, at_ms FROM ({catalog.ORACLE_SQL['capture_ages']})").fetchall()), spark.conf.get("spark.sql.session.timeZone")
    try:
        for other in (zone, "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", other)
            assert {tuple(r) for r in catalog.QUERIES["capture_ages"](spark, str(tmp_path)).select("event_id", "stale", "at_ms").collect()} == want, other
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
