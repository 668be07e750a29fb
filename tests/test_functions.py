"""Functions that SQL cannot check, against plain Python."""

import itertools

import pytest
from pyspark.sql import functions as F

from tracewell.functions import scalar, status, text
from tracewell.operators import graph, search, trace


def test_canonical_json():
    cases = {
        '{"b": 1, "a": [1.0, 2.50, 1e3]}': '{"a":[1,2.5,1000],"b":1}', '"\\u00e9\\n"': '"é\\n"', "1e21": "1e+21", "1e-7": "1e-7", "0.000001": "0.000001", "-1.5e-5": "-0.000015", "123456789012345680000": "123456789012345680000",
        "NaN": None, "{": None, '{"\\ud83d\\ude00": 1, "\\ufb33": 2}': '{"\U0001f600":1,"דּ":2}', "true": "true", "-0.0": "0", "[]": "[]",
    }
    assert {k: text.canonical_text(k) for k in cases} == cases


def test_text_functions(spark):
    df = spark.createDataFrame([("ﬁle Ⅷ ÄB", "0X00fF", '{"a":[[1,"[["]]}', "password=x")], "a string, h string, j string, p string")
    r = df.select(
        text.folded(F.col("a")), text.hex_address(F.col("h")), text.json_within(F.col("j"), 3, 99), text.json_within(F.col("j"), 2, 99), text.json_within(F.col("j"), 9, 5),
        text.redacted(F.col("p"), [("x$", "pw")]), text.canonical_json(F.col("j")), text.address_number(F.lit("0xffffffffffffffff")),
    ).first()
    assert list(r)[:7] == ["file viii äb", "0xff", True, False, False, "password=<secret:pw>", '{"a":[[1,"[["]]}'] and int(r[7]) == 2**64 - 1


def test_digest_is_injective(spark):
    rows = [("a|b", "c"), ("a", "b|c"), ("a", None), ("a", "null"), ("a", "n"), ("a", ""), (None, "a"), ("1:a", "")]
    assert spark.createDataFrame(rows, "x string, y string").select(scalar.digest("x", "y")).distinct().count() == len(rows)


def test_ladders_take_the_first_that_holds(spark):
    steps = [(True, "a"), (False, "b")]
    rows = list(itertools.product([True, False, None], repeat=2))
    df = spark.createDataFrame(rows, "x boolean, y boolean")
    got = df.select("x", "y", status.ladder([(F.col("x"), "a"), (F.col("y"), "b")], "c").alias("s")).collect()
    assert {(r.x, r.y): r.s for r in got} == {(x, y): "a" if x else "b" if y else "c" for x, y in rows} and steps
    worst = spark.createDataFrame([(1, "u"), (1, "c"), (2, "u")], "k int, s string").groupBy("k").agg(status.worst(F.col("s"), ["c", "x", "u"]).alias("w"))
    assert {r.k: r.w for r in worst.collect()} == {1: "c", 2: "u"}


def test_cursors():
    token = "tw_200_" + __import__("hashlib").sha256(b"q").hexdigest()[:12]
    assert search.resume(token, "q", 500) == 200
    for bad in ((token, "other", 500), (token, "q", 100), ("tw_x", "q", 5)):
        with pytest.raises(ValueError):
            search.resume(*bad)


def test_levels_of_a_long_chain(spark):
    edges = spark.range(40).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = graph.levels(edges, spark.range(1).select(F.col("id").alias("src")), 64)
    assert {r.node: r.level for r in got.collect()} == {i: i for i in range(41)}
    assert graph.spread(spark.range(1), edges.select(F.col("dst").alias("id"), F.col("src").alias("needs"))).count() == 41


def test_process_tree_events(spark):
    rows = [(0, "spawn", 1, None, None), (5, "exit", 2, None, 3), (10, "spawn", 2, 1, None), (20, "re_exec", 2, None, None), (30, "reparent", 2, 9, None), (50, "exit", 2, None, 7), (60, "exit", 2, None, 8), (400, "exit", 2, None, 9), (500, "spawn", 2, 1, None)]
    got = {r.pid: tuple(r)[1:] for r in graph.process_tree(spark.createDataFrame(rows, "at long, type string, pid long, ppid long, code long")).collect()}
    assert got == {1: (None, 0, None, None, False, False, 2, 0, 0), 2: (9, 10, 400, 9, True, True, 0, 2, 1)}


MACHINE = {
    "start": "idle", "visits": {"idle": 9, "in": 2, "out": 9}, "max_transitions": 6,
    "moves": [
        {"id": "login", "from": "idle", "to": "in", "on": "login", "priority": 1, "captures": {"user": "user"}, "max_uses": 2},
        {"id": "again", "from": "idle", "to": "in", "on": "login", "priority": 2, "captures": {"user": "user"}},
        {"id": "buy", "from": "in", "to": "in", "on": "buy", "guards": {"user": "user"}, "max_uses": 1},
        {"id": "leave", "from": "in", "to": "idle", "on": "leave"},
    ],
}


def test_replay_machine(spark):
    seq = [("login", "a"), ("login", "b"), ("buy", "b"), ("what", "a"), ("leave", None), ("login", "b"), ("leave", None), ("login", "c"), ("login", None)]
    rows = [("k", i, kind, user) for i, (kind, user) in enumerate(seq)] + [("late", 5, "login", "a"), ("late", 4, "leave", "a"), ("late", 6, "leave", "a")]
    df = spark.createDataFrame(rows, "key string, at long, kind string, user string")
    got = trace.replay(df, "key", "at", "kind", ["user"], MACHINE)
    told = {k: [(r.outcome, r.transition, r.state) for r in sorted(got.where(F.col("key") == k).collect(), key=lambda r: r["at"])] for k in ("k", "late")}
    assert told["k"] == [
        ("matched", "login", "in"), ("invalid_state", None, "in"), ("guard_failed", None, "in"), ("unmatched", None, "in"), ("matched", "leave", "idle"), ("matched", "login", "in"),
        ("matched", "leave", "idle"), ("limit_exhausted", None, "idle"), ("limit_exhausted", None, "idle"),
    ]
    assert [x[0] for x in told["late"]] == ["invalid_state", "matched", "matched"]


def test_shortest_edit_scripts():
    import random

    rng = random.Random(3)

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        same = common(a, b)
        assert text.edits(a, b) == (len(b) - same, len(a) - same)
    assert text.edits(["a"] * 50, ["b"] * 50, most=20) is None
