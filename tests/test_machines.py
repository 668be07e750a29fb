"""Reactive scenarios, flows over machines, trace specifications and pattern admission."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tracewell.functions import patterns, status
from tracewell.operators import graph, reactive, specification
from tracewell.plans import catalog, machines

FOLDER = "/root/testdata/sf0.01"


def run(scenario, inputs, end=None):
    now, out = reactive.Reactor(scenario), []
    for at, kind in inputs:
        out += now.step(at, kind)
    return out + [(False, *x) for x in (now.until(end) if end is not None else [])]


TWO = {
    "start": "a",
    "states": {
        "a": {"deadline": 10, "visits": 2, "on": [{"id": "go", "when": ("event", "x"), "goto": "b", "max_uses": 1}, {"id": "again", "when": ("event", "x"), "priority": 1, "goto": "b"}]},
        "b": {"deadline": 5, "on": [{"id": "back", "when": ("repeat", "y", 2, 3), "goto": "a"}, {"id": "out", "when": ("all", ("event", "z"), ("event", "y")), "finish": "done"}]},
    },
}


def test_scenario_decisions():
    assert run(TWO, [(0, "x"), (1, "y"), (2, "y"), (3, "q"), (4, "x"), (5, "z"), (6, "y")]) == [
        (True, "moved", "go", "b", None), (True, "waiting", None, "b", None), (True, "moved", "back", "a", None), (True, "waiting", None, "a", None), (True, "moved", "again", "b", None),
        (True, "waiting", None, "b", None), (True, "finished", "out", "b", "done"),
    ]
    last = lambda inputs, **k: run(TWO | k, inputs)[-1][1:]
    assert last([(0, "x"), (1, "z"), (1, "y")]) == ("finished", "out", "b", "done")
    both = {"start": "a", "states": {"a": {"on": [{"id": i, "when": ("event", "x"), "priority": 3, "finish": i} for i in ("p", "q")] + [{"id": "r", "when": ("event", "x"), "priority": 4, "finish": "r"}]}}}
    assert run(both, [(0, "x")]) == [(True, "finished", None, "a", "ambiguous_match")]
    assert last([(5, "q"), (4, "x")]) == ("finished", None, "a", "capture_incomplete")
    assert last([(0, "q"), (1, "q"), (2, "q")], most_events=2) == ("finished", None, "a", "capture_incomplete")
    assert last([(0, "x"), (1, "y"), (1, "y"), (2, "x"), (3, "y"), (3, "y")]) == ("finished", None, "b", "capture_incomplete")  # a third visit
    assert last([(0, "q"), (3, "@cancel")]) == ("finished", None, "a", "cancelled") and last([(0, "q"), (3, "@lost"), (4, "x")])[0] == "already_finished"


def test_deadlines():
    assert run(TWO, [(0, "q"), (10, "x")]) == [(True, "waiting", None, "a", None), (False, "finished", None, "a", "predicate_timeout"), (True, "already_finished", None, "a", "predicate_timeout")]
    assert run(TWO, [(0, "q"), (9, "x"), (13, "q"), (14, "q")])[-2][4] == "predicate_timeout"  # that of a is void, that of b counts from 9
    assert run(TWO | {"deadline": 12}, [(0, "q"), (9, "x"), (12, "q")])[2] == (False, "finished", None, "b", "scenario_deadline")
    assert run(TWO, [(0, "x"), (5, "@cancel")])[1][4] == "cancelled" and run(TWO, [(0, "x"), (6, "@cancel")])[1][4] == "predicate_timeout"  # control inputs come first at one time
    assert run(TWO, [(0, "x")], end=4)[-1][1] == "moved" and run(TWO, [(0, "x")], end=5)[-1] == (False, "finished", None, "b", "predicate_timeout")


def test_consumed_events_are_gone():
    on = [{"id": "t", "when": ("event", "x"), "goto": "a", "consume": True}, {"id": "u", "when": ("sequence", ("event", "y"), ("event", "x")), "priority": -1, "finish": "u"}]
    since = lambda **k: {"start": "a", "since": "start", "states": {"a": {"on": [on[0] | k, on[1]]}}}
    assert [x[1] for x in run(since(), [(0, "x"), (1, "q"), (2, "q")])] == ["moved", "waiting", "waiting"]
    assert [x[1] for x in run(since(consume=False), [(0, "x"), (1, "q"), (2, "q")])] == ["moved", "moved", "moved"]
    assert run(since(), [(0, "x"), (1, "y"), (2, "x")])[-1][4] == "u"


def test_batch_and_stream_agree(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    for i in range(4):  # later files hold later events
        e.where(f"event_id % 1000 >= {250 * i} AND event_id % 1000 < {250 * (i + 1)}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    late = spark.createDataFrame([(99_999, -1, "click")], "event_id long, user_id long, event_type string").withColumn("ts", F.to_timestamp(F.lit("2025-01-01")))
    for day in ("2025-01-01", "2025-02-01"):  # the last ones move the watermark past all timers
        late.withColumn("ts", F.to_timestamp(F.lit(day))).select(*e.columns).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    told = reactive.react_stream(stream, "user_id", ["ts", "event_id"], "ts", "event_id", "event_type", machines.SCENARIO, "1 day")
    q = told.writeStream.format("memory").queryName("reacted").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = spark.table("reacted").where("user_id >= 0 AND decision <> 'already_finished'").collect()
    rows = e.withColumn("at", F.unix_micros("ts"))
    want = reactive.react(rows, "user_id", ["at", "event_id"], "at", "event_id", "event_type", machines.SCENARIO, end=2 * 10**15).where("decision <> 'already_finished'").collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert {r.outcome for r in want} >= {None, "left", "predicate_timeout"}


def test_available_facts(spark):
    rng = random.Random(4)
    for turn in range(2):
        edges = [(str(i), rng.randrange(7), rng.randrange(7), rng.sample("abc", rng.randrange(3))) for i in range(11)]
        needs = [(str(i), rng.choice("abc")) for i in range(11) if rng.random() < 0.3]
        have, changed = {0: set()}, True
        while changed:
            changed = False
            for i, u, v, gives in edges:
                if u in have and all(f in have[u] for j, f in needs if j == i):
                    new = have[u] | set(gives)
                    changed |= v not in have or not new <= have[v]
                    have[v] = have.get(v, set()) | new
        e = spark.createDataFrame(edges, "id string, src long, dst long, gives array<string>")
        start = spark.createDataFrame([(0,)], "node long")
        nodes, facts = graph.available(e, start, spark.createDataFrame(needs, "id string, fact string"))
        assert {r.node for r in nodes.collect()} == set(have) and {(r.node, r.fact) for r in facts.collect()} == {(n, f) for n, fs in have.items() for f in fs}
        sure, changed = {0: set()}, True
        while changed:
            changed = False
            for _, u, v, gives in edges:
                if u in sure:
                    new = (sure[u] | set(gives)) if v not in sure else sure[v] & (sure[u] | set(gives))
                    changed |= sure.get(v) != new
                    sure[v] = new
        assert {(r.node, r.fact) for r in graph.definite(e, start).collect()} == {(n, f) for n, fs in sure.items() for f in fs}


def test_state_reachability(spark):
    states = spark.createDataFrame([(i, i in (3, 6)) for i in range(9)], "node long, terminal boolean")
    edges = spark.createDataFrame([(0, 1), (1, 3), (1, 2), (2, 2), (0, 4), (3, 0), (0, 6), (7, 0)], "src long, dst long")
    got = {r.node: r.verdict for r in graph.state_reachability(states, edges, spark.createDataFrame([(0,)], "node long")).collect()}
    assert got == {0: "live", 1: "live", 2: "endless", 3: "terminal_with_moves", 4: "dead_end", 5: "unreachable", 6: "terminal", 7: "unreachable", 8: "unreachable"}


def test_specifications(spark):
    events = [(s, i) for s in "abcd" for i in range(4)] + [("a", 1)]
    rules = [("a", 0, 1), ("a", 1, 2), ("a", 2, 3), ("b", 0, 1), ("b", 1, 0), ("b", 9, 2), ("c", 0, 1), ("c", 0, 2), ("c", 1, 3), ("c", 2, 3), ("d", 0, 1)]
    free = [("c", "g", 1), ("c", "g", 2), ("d", "g", 0), ("d", "g", 1), ("d", "h", 2), ("d", "h", 3)]
    got = specification.violations(spark.createDataFrame(events, "spec string, id long"), spark.createDataFrame(rules, "spec string, before long, after long"), spark.createDataFrame(free, "spec string, group string, id long"), "spec")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [("a", "duplicate_event", 1, None), ("b", "unknown_event", 9, None), ("b", "cycle", 0, None), ("b", "cycle", 1, None), ("d", "conflict", 0, 1), *(("d", "undeclared_pair", a, b) for a, b in itertools.product((0, 1), (2, 3)))], key=str
    )


def test_pattern_admission(spark):
    rng = random.Random(7)

    def made(depth, inside):
        """(pattern, paths, steps) of a random tree."""
        kind = rng.randrange(5 if depth else 2)
        if kind < 2:
            return rng.choice(["a", ".", r"\d", "[^]x-z]", r"\.", "^"]), 1, 1
        if kind == 2:
            parts = [made(depth - 1, inside) for _ in range(rng.randrange(1, 4))]
            p = 1
            for x in parts:
                p *= x[1]
            return "".join(x[0] for x in parts), p, sum(x[2] for x in parts)
        parts = [made(depth - 1, inside or kind == 4) for _ in range(rng.randrange(1, 4))]
        text, p, s = f"({rng.choice(['', '?:', '?P<n>'])}" + "|".join(x[0] for x in parts) + ")", sum(x[1] for x in parts), max(x[2] for x in parts)
        if kind == 3 or inside:
            return text, p, s
        low, high = sorted((rng.randrange(3), rng.randrange(1, 4)))
        return text + f"{{{low},{high}}}" + rng.choice(["", "?"]), sum(p**n for n in range(low, high + 1)), high * s

    for _ in range(300):
        text, p, s = made(3, False)
        assert patterns.judged(text, most_paths=10**9) == ("admitted", p, s), text
    refused = {"(?=a)": "lookaround", "(?<!a)b": "lookaround", r"(a)\1": "back_reference", "(?P=n)": "back_reference", "(a{0,2}){0,2}": "nested_repeat", "((a+))*": "unbounded_repeat", "a*": "unbounded_repeat", "a+": "unbounded_repeat", "a{2,}": "unbounded_repeat", "a{1001}": "unbounded_repeat", "(a|b){20}": "too_many_paths", "(": "syntax", "a)": "syntax", "[a": "syntax", "*": "syntax", "(?i)a": "unsupported"}
    assert {t: patterns.judged(t)[0] for t in refused} == refused
    assert patterns.judged("") == ("admitted", 1, 0) and patterns.judged("a?") == ("admitted", 2, 1) and patterns.judged("a{,2}b{x}") == ("admitted", 3, 6)
    df = spark.createDataFrame([("a?",), (None,), ("a*",)], "p string")
    assert sorted(map(str, df.select(patterns.admission(F.col("p")).alias("x")).select("x.*").collect())) == sorted(["Row(status='admitted', paths=2, steps=1)", "Row(status=None, paths=None, steps=None)", "Row(status='unbounded_repeat', paths=None, steps=None)"])


OUTCOMES = {
    "reactive_scenarios": ("outcome", {"left", "failed", "ambiguous_match", "predicate_timeout", "scenario_deadline", "capture_incomplete"}),
    "machine_states": ("verdict", {"unreachable", "terminal", "terminal_with_moves", "dead_end", "endless", "live"}),
    "specification_checks": ("violation", {"duplicate_event", "unknown_event", "cycle", "conflict", "undeclared_pair"}),
    "pattern_admission": ("status", {"admitted", "nested_repeat", "lookaround", "back_reference", "unbounded_repeat", "too_many_paths", "syntax"}),
    "replay_outcomes": ("outcome", {"matched", "unmatched", "invalid_state", "guard_failed", "transition_exhausted", "limit_exhausted", "invalid_capture"}),
    "readiness": ("status", {"ready", "blocked"}),
    "trigger_tree": ("outcome", {"matched", "deadline"}),
    "trace_verdict": ("verdict", {"unknown", "equivalent", "nonconforming", "different"}),
    "repeatability": ("verdict", {"insufficient", "stable", "timing_variance", "unstable"}),
    "batch_outcomes": ("status", {"ok", "partial", "error"}),
    "capability_rollup": ("availability", {"available", "degraded"}),
    "idempotent_merge": ("status", {"single", "duplicate", "conflict"}),
    "distinct_links": ("n", {1, 2, 3}),
    "obligation_dependencies": ("status", {"verified", "open"}),
    "trace_partial_order": ("status", {"ok", "missing_before", "violated"}),
    "claim_verdicts": ("verdict", {"supported", "contradicted", "unverified"}),
    "hypothesis_join": ("pattern", {"cochanged", "static_only", "runtime_only", "both_unchanged"}),
    "comparable_payloads": ("same", {True, False}),
    "family_totals": ("provenance", {"1", "2", "25"}),
    "capture_comparison": ("status", {"changed", "unchanged"}),
    "line_changes": ("changes", {"0,0", "2,0", "3,1"}),
    "graph_identity": ("dangling", {True, False}),
    "script_urls": ("status", {"exact", "ambiguous", "unmatched"}),
    "shim_routes": ("outcome", {"matched", "exhausted", "unmatched"}),
}


@pytest.mark.parametrize("name", sorted(OUTCOMES))
def test_every_outcome_occurs(spark, name):
    column, want = OUTCOMES[name]
    assert {r[0] for r in catalog.QUERIES[name](spark, FOLDER).select(column).distinct().collect()} >= want


def test_both_meets_differ(spark):
    told = catalog.QUERIES["available_facts"](spark, "/root/testdata/sf0.001").collect()
    assert any(r.may != r.sure and r.sure for r in told) and any(r.may == r.sure for r in told)


def test_null_conditions_count_as_false(spark):
    """Each ladder with null in each place gives what false gives there."""
    made = {
        status.artifacts: 5, status.process: 3, status.function: 5, status.web_capture: 2, status.web_dimension: 2, status.scenario: 3, status.bundle: 3, status.correlation: 3, status.changed_behavior: 4, status.claim: 3, status.specification: 2,
        status.trust_gate: 3, status.matched_item: 3, status.call_path: 3,
    }
    cols = []
    for fn, n in made.items():
        for i in range(n):
            for others in (False, True):
                given = lambda x: fn(*[F.lit(x).cast("boolean") if k == i else F.lit(others) for k in range(n)])  # noqa: B023, E731
                cols.append((given(None) == given(False)).alias(f"c{len(cols)}"))
    both = lambda f: f(None) == f(False)
    b = lambda x: F.lit(x).cast("boolean")
    cols += [both(lambda x: status.semantic_query(b(x), F.lit(False), F.lit(False), F.lit(1), F.lit(False))), both(lambda x: status.source_mapping(b(x), F.lit(1), F.lit(0), F.lit(False), F.lit(True)))]
    cols += [both(lambda x: status.trace(F.lit("fail"), F.lit("fail"), b(x))), both(lambda x: status.obligations(F.lit(1), F.lit(False), F.lit(False), F.lit(True), b(x)))]
    assert set(spark.range(1).select(*cols).first()) == {True}


def searched(entries, seeds, max_nodes, max_edges, max_depth):
    """The search, edge by edge; entries (id, at, relation, next)."""
    seeds = sorted(set(seeds))
    depths, edges, frontier = {s: 0 for s in seeds[:max_nodes]}, set(), {(s, 0, "max-nodes") for s in seeds[max_nodes:]}
    queue = list(depths)
    for at in queue:
        for i, _, _, to in sorted((e for e in entries if e[1] == at), key=lambda e: (e[2], e[3], e[0])):
            if depths[at] >= max_depth:
                frontier.add((at, depths[at], "max-depth"))
            elif i not in edges and len(edges) >= max_edges:
                frontier.add((at, depths[at], "max-edges"))
            elif to not in depths and len(depths) >= max_nodes:
                frontier.add((at, depths[at], "max-nodes"))
            else:
                edges.add(i)
                if to not in depths:
                    depths[to] = depths[at] + 1
                    queue.append(to)
    return depths, edges, frontier


@pytest.mark.parametrize(("direction", "seeds", "bounds", "reasons"), [("backward-provenance", [0, 1, 2], (5, 50, 1), {"max-depth", "max-nodes"}), ("ownership", [0, 1, 2, 3, 4], (9, 8, 2), {"max-depth", "max-edges"})])
def test_bounded_traversal(spark, direction, seeds, bounds, reasons):
    rng = random.Random(direction)
    rows = [(i, rng.randrange(14), rng.randrange(14), rng.choice(["calls", "owns", "reads"])) for i in range(34)]
    df = spark.createDataFrame(rows, "id long, src long, dst long, relation string")
    entries = graph.turned(df, direction, ["calls", "owns"])
    own = [tuple(r) for r in entries.select("id", "at", "relation", "next").collect()]
    nodes, edges, frontier = graph.traverse(entries, spark.createDataFrame([(s,) for s in seeds], "node long"), *bounds)
    want = searched(own, seeds, *bounds)
    assert {r.node: r.depth for r in nodes.collect()} == want[0] and {r.id for r in edges.collect()} == want[1]
    assert {tuple(r) for r in frontier.collect()} == want[2] and {r for _, _, r in want[2]} >= reasons
