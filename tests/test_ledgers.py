"""JSON shapes, script fingerprints and exports, drift, unknowns, obligations, orders of texts and extraction."""

import collections
import hashlib
import io
import json
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tracewell import sinks
from tracewell.functions import scripts, shapes, text
from tracewell.operators import conformance, obligations
from tracewell.plans import catalog, ledgers  # noqa: F401
from tracewell.sources import archives

FOLDER = "/root/testdata/sf0.01"


def test_outcomes_at_size(spark):
    seen = lambda name, column: {r[0] for r in catalog.QUERIES[name](spark, FOLDER).select(column).distinct().collect()}
    assert seen("body_shapes", "root_type") == {"object", "array", "string", None} and seen("body_shapes", "truncated") == {True, False, None}
    assert seen("body_shape_groups", "always") == {True, False}
    assert seen("export_selection", "status") == {"selected", "ambiguous", "missing"}
    assert seen("scenario_drift", "verdict") == {"drifting", "failing", "stable", "insufficient"} and seen("package_drift", "gate") == {"fail", "unknown", "pass"}
    assert seen("obligation_ledger", "status") == {"blocked", "unknown", "unowned", "verified", "contradicted", "implemented", "out-of-scope"}
    orders = catalog.QUERIES["text_orders"](spark, FOLDER)
    assert orders.where("code_points <> code_units").count() and orders.where("code_points <> locale").count() and orders.where("code_units <> locale").count()


# ---- shapes


def walk(value, depth):
    """(path, member, type) of all nodes within depth, and whether there are more."""
    kinds = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}
    out, cut, todo = [], False, [("", False, 0, value)]
    while todo:
        path, member, d, v = todo.pop()
        if d > depth:
            cut = True
            continue
        out.append((path, member, kinds.get(type(v), "number")))
        if isinstance(v, dict):
            todo += [(path + "/" + k.replace("~", "~0").replace("/", "~1"), True, d + 1, x) for k, x in v.items()]
        if isinstance(v, list):
            todo += [(path + "/*", False, d + 1, x) for x in v]
    return out, cut


def made(r, depth=0):
    pick = r.randrange(8 if depth < 4 else 5)
    if pick == 5 or pick == 7:
        return {r.choice(["a", "b", "c/d", "~", "é", "*", ""]): made(r, depth + 1) for _ in range(r.randrange(4))}
    if pick == 6:
        return [made(r, depth + 1) for _ in range(r.randrange(4))]
    return [1, "x", None, True, 2.5][min(pick, 4)]


def test_shapes_against_a_walk(spark):
    r = random.Random(5)
    texts = [json.dumps(made(r)) for _ in range(300)]
    df = spark.createDataFrame([(i, i % 3, t) for i, t in enumerate(texts)], "k int, g int, t string")
    got = {x.k: x for x in shapes.summarised(df, "k", F.col("t"), 3).collect()}
    for i, t in enumerate(texts):
        nodes, cut = walk(json.loads(t), 3)
        by = collections.defaultdict(list)
        for path, member, kind in nodes:
            if member:
                by[path].append(kind)
        lines = [f"{p}:{'|'.join(sorted(set(k)))}:{len(k)}" for p, k in by.items()]
        assert (got[i].root_type, got[i].node_count, got[i].truncated, sorted(got[i].properties.split(";") if lines else [])) == ([n for n in nodes if n[0] == ""][0][2], len(nodes), cut, sorted(lines)), t
    every = shapes.counted(df, ["g"], F.col("t"), 3)
    parts = [shapes.counted(df.where(F.col("k") % 5 == i), ["g"], F.col("t"), 3) for i in (3, 0, 4, 2, 1)]
    left = parts[0]
    for p in parts[1:]:
        left = shapes.merged(left.unionByName(p), ["g"])  # one after the other
    assert sorted(map(tuple, left.collect())) == sorted(map(tuple, every.collect()))
    texts_with = collections.Counter((i % 3, p) for i, t in enumerate(texts) for p in {n[0] for n in walk(json.loads(t), 3)[0]})
    told = shapes.described(every, ["g"]).collect()
    assert {(x.g, x.path): x.texts for x in told} == dict(texts_with)
    assert all(x.always == (x.texts == 100) for x in told)


def test_texts_without_a_shape(spark):
    rows = [(1, None), (2, ""), (3, '{"a": '), (4, '{"a": 1, "a": 2}'), (5, '"' + "x" * 100 + '"'), (6, "[]"), (7, "1e400"), (8, json.dumps({f"k{i}": i for i in range(5000)}))]
    got = {r.k: r for r in shapes.summarised(spark.createDataFrame(rows, "k int, t string"), "k", F.col("t"), max_bytes=90_000).collect()}
    assert [got[k].root_type for k in range(1, 9)] == [None, None, None, None, "string", "array", "number", "object"]
    assert got[2][1:] == (None,) * 5 and got[6].properties == "" and got[8].node_count == 5001
    short = shapes.summarised(spark.createDataFrame(rows[4:6], "k int, t string"), "k", F.col("t"), max_bytes=90).collect()
    assert {r.k: r.root_type for r in short} == {5: None, 6: "array"}
    assert shapes.counted(spark.createDataFrame([], "k int, t string"), ["k"], F.col("t")).count() == 0
    null_group = shapes.described(shapes.counted(spark.createDataFrame([(None, "[1]"), (None, "[]")], "g int, t string"), ["g"], F.col("t")), ["g"])
    assert {(r.g, r.path, r.texts, r.always) for r in null_group.collect()} == {(None, "", 2, True), (None, "/*", 1, False)}


# ---- scripts


def test_fingerprints(spark):
    base = "function f(a, b) { const x = {k: a, m: 'q'}; return a.size + b[0] * 2; }"
    same = ["function g(c,d){const yy={k:c,m:'q'};return c.size+d[0]*2;}", "function f(a, /* , */ b) { // x\n const x = {k: a, m: 'q'}; return a.size + b[0] * 2; }"]
    number, prop, key, mark, quote = base.replace("2", "3"), base.replace("size", "width"), base.replace("k:", "j:"), base.replace("+", "-"), base.replace("'q'", "'r'")
    rows = list(enumerate([base, *same, number, prop, key, mark, quote, "", None, "let a = '" + "\\'" * 200_000 + "';"]))
    df = spark.createDataFrame(rows, "k int, s string")
    kept = {r.k: r.sha256 for r in scripts.fingerprints(df, "k", F.col("s")).collect()}
    assert kept[0] == kept[1] == kept[2] and len({kept[k] for k in (0, 3, 4, 5, 6, 7, 8, 10)}) == 8 and kept[9] is None
    loose = {r.k: r.sha256 for r in scripts.fingerprints(df, "k", F.col("s"), literals=False).collect()}
    assert loose[0] == loose[1] == loose[3] == loose[7] and len({loose[k] for k in (0, 4, 5, 6)}) == 4


def test_exports(spark):
    cases = {
        "exports.a = 1; module.exports.b = function () {}; x.exports.c = 2; exports.d == 3; exports['e'] = 4; exports.f.g = 5;": {"a", "b", "e"},
        "module.exports = { a, b: { c: 1, d: [e, f] }, 'g-h': (i, j), k(l, m) { return { n: 1 }; } }; var o = { p: 1, q };": {"a", "b", "g-h", "k"},
        "module.exports = f(); // exports.z = 1": {"default"},
        "Object.defineProperty(exports, \"a\", { value: 1 }); Object.defineProperty(module.exports, 'b', {}); Object.defineProperty(other, 'c', {});": {"a", "b"},
        "export function a() {} export const b = 1; export default class {} export async function c() {} export class D {}": {"a", "b", "default", "c", "D"},
        "exports = {}; exports = { a: 1 }; exports.a = 2;": {"a"},
        "let exportsX = 'exports.y = 1';": set(),
    }
    df = spark.createDataFrame([*enumerate(cases), (99, None)], "k int, s string")
    got = collections.defaultdict(set)
    found = scripts.exports(df, "k", F.col("s")).collect()
    for r in found:
        got[r.k].add(r.name)
    assert [got[k] for k in range(len(cases))] == list(cases.values()) and len(found) == sum(map(len, cases.values()))


def test_selectors(spark):
    c = spark.createDataFrame([("m", "a"), ("m", "b"), ("n", "a"), ("o", "c"), ("o", "c")], "module string, name string")
    w = spark.createDataFrame([("m", "a"), ("m", "c"), ("o", "c"), ("q", "z"), (None, "a")], "module string, name string")
    assert {tuple(r) for r in scripts.selected(c, w, "module", "name").collect()} == {
        ("m", "a", "selected", 1, 0), ("m", "c", "missing", 0, 4), ("o", "c", "ambiguous", 2, 0), ("q", "z", "missing", 0, 0), (None, "a", "missing", 0, 2),
    }


# ---- drift


def test_drift(spark):
    runs = [("p", "a", 1, "pass", "x", 1), ("p", "a", 2, "pass", "x", 2), ("p", "a", 3, "pass", "y", 1), ("p", "b", 1, "pass", "x", 1), ("p", "b", 2, "error", "z", 1), ("q", "c", 1, "pass", "x", 1), ("q", "c", 2, "skipped", "x", 1),
            ("q", "d", 5, "pass", "x", 1), ("q", "e", 1, "pass", None, 1), ("q", "e", 2, "pass", "x", 1), ("r", "c", 1, "pass", "x", 1), ("r", "c", 2, "pass", "x", 1), (None, "c", 1, "fail", "x", 1)]
    told = conformance.drift(spark.createDataFrame(runs, "p string, s string, r int, status string, u string, v int"), "p", "s", "r", "status", ["u", "v"])
    got = {(x.p, x.s): (x.verdict, x.passed, x.failed, x.errored, x.skipped, x.drift and tuple(x.drift)) for x in told.collect()}
    assert got == {
        ("p", "a"): ("drifting", 3, 0, 0, 0, (2, "v")), ("p", "b"): ("failing", 1, 0, 1, 0, (2, "u")), ("q", "c"): ("stable", 1, 0, 0, 1, None),
        ("q", "d"): ("insufficient", 1, 0, 0, 0, None), ("q", "e"): ("unknown", 2, 0, 0, 0, None), ("r", "c"): ("stable", 2, 0, 0, 0, None),
    }
    packages = {x.p: (x.scenarios, x.passed, x.errored, x.drift_detected, x.first_drift and tuple(x.first_drift), x.gate) for x in conformance.packages(told, "p", "s").collect()}
    assert packages == {"p": (2, 4, 1, True, ("a", 2, "v"), "fail"), "q": (3, 4, 0, False, None, "unknown"), "r": (1, 2, 0, False, None, "pass")}


# ---- unknowns and obligations


def test_unknowns_follow_typed_relations(spark):
    revisions = spark.createDataFrame([(1, 1, "resolved"), (1, 2, "open"), (2, 1, "open"), (3, 1, "open"), (4, 1, "open"), (4, 2, "resolved"), (5, 1, "open"), (6, 1, "open")], "id int, revision int, status string")
    heads = obligations.heads(revisions, "id", "revision")
    assert {(r.id, r.status) for r in heads.collect()} == {(1, "open"), (2, "open"), (3, "open"), (4, "resolved"), (5, "open"), (6, "open")}
    evidence = spark.createDataFrame([(1, "e1"), (4, "e2"), (6, "e2")], "id int, evidence string")
    claims = spark.createDataFrame([("c", "e1"), ("d", "e2"), ("e", "e9")], "claim string, evidence string")
    relations = lambda kind: spark.createDataFrame([(1, "depends-on", 2), (2, kind, 3), (2, "contradicts", 1), (2, "depends-on", 4), (4, "depends-on", 5), (6, "related-to", 5), (3, "depends-on", 77)], "id int, type string, other int")
    run = lambda kind: {tuple(r) for r in obligations.active_unknowns(heads, evidence, relations(kind), claims).collect()}
    assert run("related-to") == {("c", 1, True), ("c", 2, False), ("d", 6, True)}
    assert run("depends-on") == {("c", 1, True), ("c", 2, False), ("c", 3, False), ("d", 6, True)}
    state = spark.createDataFrame([("c", "x", "unknown"), ("d", "y", "unknown"), ("e", "z", "unknown"), ("f", "x", "changed")], "claim string, kind string, status string")
    advice = spark.createDataFrame([(1, "look"), (2, "look"), (3, "run")], "id int, operation string")
    got = obligations.probes(state, obligations.active_unknowns(heads, evidence, relations("depends-on"), claims), advice, {"y": "trace"}, "list")
    assert {tuple(r) for r in got.collect()} == {("look", 1, 3), ("run", 1, 3), ("trace", 1, 1), ("list", 1, 0)}


def test_ledger(spark):
    seen = [(k, "a", 1, f"n{k}", f"e{k}", "x", "observed") for k in range(1, 13)] + [(3, "a", 2, "m3", "e3", "x", "candidate"), (8, "a", 1, "n8", "e8", "x", "observed"), (20, "other", 1, "n", "e", "x", "observed"), (13, "b", 1, "n13", None, None, None)]
    found = obligations.candidates(spark.createDataFrame(seen, "node int, kind string, source int, label string, evidence string, location string, state string"), {"a": "A", "b": "B"})
    by = {r.node: r for r in found.collect()}
    assert set(by) == {*range(1, 14)} and (by[3].definitions, by[3].authorities, by[3].title, by[3].source_state) == (2, 2, "m3", "observed")
    assert by[8].authorities == 1 and (by[13].authorities, by[13].source_state, by[13].family) == (0, "unknown", "B") and len({r.obligation for r in by.values()}) == 13
    bindings = spark.createDataFrame([(k, k != 4) for k in (1, 2, 3, 4, 6, 7, 8, 9, 10, 11, 12, 13)] + [(7, True)], "node int, verified boolean")
    against = spark.createDataFrame([(9, "there"), (10, "there"), (10, "gone")], "node int, evidence string")
    there = spark.createDataFrame([("there",)], "evidence string")
    put = spark.createDataFrame([(11, "blocked"), (12, "out-of-scope")], "node int, disposition string")
    needs = spark.createDataFrame([(1, 2), (2, 1), (6, 8), (8, 5), (9, 99), (12, 5), (6, 99)], "node int, needs int")
    rows = obligations.ledger(found, bindings, against, there, spark.createDataFrame([(7,)], "node int"), put, needs, key="node")
    assert {r.node: (r.status, r.diagnostics) for r in rows.collect()} == {
        1: ("verified", ""), 2: ("verified", ""), 3: ("unknown", "duplicate-definition"), 4: ("implemented", "verifier-failed"), 5: ("unowned", ""), 6: ("blocked", "dependency-missing,dependency-open"),
        7: ("unknown", "duplicate-binding,residual-unknown"), 8: ("blocked", "dependency-open"), 9: ("contradicted", "contradiction,dependency-missing"), 10: ("implemented", "contradiction-evidence-missing"),
        11: ("blocked", "blocked"), 12: ("out-of-scope", "dependency-open,out-of-scope"), 13: ("unknown", "unavailable-authority"),
    }
    groups = F.when(F.col("node") <= 2, "ready").when(F.col("node") == 5, "open").when(F.col("node").isin(4, 9), "failed").when(F.col("node") == 3, "unknown").otherwise("rest")
    told = {r.g: (r.total, r.verified, r.required_open, r.verdict) for r in obligations.summary(rows.withColumn("g", groups), "g", F.col("node") != 13).collect()}
    assert told == {"ready": (2, 2, 0, "ready"), "open": (1, 0, 1, "open"), "failed": (2, 0, 2, "failed"), "unknown": (1, 0, 1, "unknown"), "rest": (7, 0, 6, "unknown")}


# ---- orders


def test_orders_of_texts(spark):
    texts = ["Z", "a", "A", "á", "b", "ｍ", "\U0001f600", "", "ab", "a b", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    order = lambda key: [r.t for r in df.where("t IS NOT NULL").orderBy(key).collect()]
    known = [t for t in texts if t is not None]
    assert order(F.col("t")) == sorted(known) and order(text.code_unit_key(F.col("t"))) == sorted(known, key=lambda t: t.encode("utf-16-be"))
    assert order(text.in_locale(F.col("t"))) == ["", "\U0001f600", "a", "A", "á", "a b", "ab", "b", "ｍ", "Z"]
    assert df.orderBy(text.code_unit_key(F.col("t"))).first().t is None


# ---- extraction


def test_extract(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, content in {"a.txt": b"one", "deep/b.bin": bytes(range(256)), "c": b"", "../d": b"out"}.items():
            z.writestr(name, content)
    os.mkdir(tmp_path / "in")
    (tmp_path / "in/x.zip").write_bytes(data.getvalue())
    entries = archives.zip_entries(spark, f"{tmp_path}/in", keep=True)
    every = {r.entry: r for r in entries.collect()}
    one = lambda entry, path=None, sha=None: (every["a.txt"].archive, entry, sha or (every[entry].sha256 if entry in every else "?"), path or entry)
    table = lambda *rows: spark.createDataFrame(rows, "archive string, entry string, sha256 string, path string")
    got = sinks.extract(entries, table(one("a.txt"), one("deep/b.bin"), one("c", "other/é/c")), f"{tmp_path}/out")
    assert {(r.path, r.size) for r in got.collect()} == {("a.txt", 3), ("deep/b.bin", 256), ("other/é/c", 0)}
    files = {str(p.relative_to(tmp_path / "out/tree")) for p in (tmp_path / "out/tree").rglob("*") if p.is_file() and not p.name.endswith(".crc")}
    assert files == {"a.txt", "deep/b.bin", "other/é/c"} and hashlib.sha256((tmp_path / "out/tree/deep/b.bin").read_bytes()).hexdigest() == every["deep/b.bin"].sha256
    with pytest.raises(ValueError, match="there already"):
        sinks.extract(entries, table(one("a.txt")), f"{tmp_path}/out")
    refused = {
        "1 not_found": [one("a.txt"), one("nothing")], "1 other_digest": [one("a.txt", sha="0" * 64), one("c")], "1 unsafe": [one("../d", "d")], "1 unsafe_path": [one("a.txt", "x/../y")],
        "2 path_taken": [one("a.txt", "X"), one("c", "x")], "1 path_taken": [one("a.txt", "p"), one("c", "p/q")],
    }
    for problem, rows in refused.items():
        with pytest.raises(ValueError, match=problem):
            sinks.extract(entries, table(*rows), f"{tmp_path}/second")
        assert sorted(p.name for p in tmp_path.iterdir()) == ["in", "out"]
