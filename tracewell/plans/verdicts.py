"""Queries of status ladders, verdicts, coverage and ledgers, on stand-ins of the test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import status
from tracewell.operators import diff, match, trace
from tracewell.plans.catalog import DIFF, HALVES, _halves, query
from tracewell.plans.evidence import _PLACES, _places
from tracewell.sources import table

_BITS = ", ".join(f"(o_orderkey // {1 << i}) % 2 = 1 AS b{i}" for i in range(5))


@query(f"""WITH f AS (SELECT o_orderkey, o_orderkey % 3 AS k, o_orderkey % 4 AS j, {_BITS} FROM orders), t AS (SELECT *, CASE k WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' ELSE 'unknown' END AS l, CASE (o_orderkey // 3) % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' ELSE 'unknown' END AS r FROM f)
SELECT o_orderkey,
CASE WHEN b0 THEN 'truncated' WHEN b1 THEN 'contradiction' WHEN NOT b2 THEN 'unknown' WHEN b3 THEN 'unknown' WHEN NOT b4 THEN 'unchanged' ELSE 'changed' END AS artifacts,
CASE WHEN b0 THEN 'truncated' WHEN b1 THEN 'changed' WHEN b2 THEN 'unknown' ELSE 'unchanged' END AS process,
CASE WHEN b0 THEN 'truncated' WHEN b1 OR b2 THEN 'unknown' WHEN b3 OR b4 THEN 'changed' ELSE 'unchanged' END AS function,
CASE WHEN b0 THEN 'changed' WHEN b1 THEN 'unknown' ELSE 'unchanged' END AS web_capture,
CASE WHEN b0 THEN 'changed' WHEN b1 THEN 'unchanged' ELSE 'unknown' END AS web_dimension,
CASE WHEN b0 THEN 'changed' WHEN b1 OR NOT b2 THEN 'unknown' ELSE 'unchanged' END AS scenario,
CASE WHEN b0 AND NOT b1 THEN 'unchanged' WHEN b2 THEN 'unknown' ELSE 'changed' END AS bundle,
CASE WHEN b0 THEN 'truncated' WHEN b1 THEN 'unknown' WHEN b2 THEN 'contradicted' ELSE 'correlated' END AS correlation,
CASE WHEN b0 THEN 'unknown' WHEN b1 THEN 'truncated' WHEN b2 THEN 'unknown' WHEN b3 THEN 'changed' ELSE 'unchanged' END AS changed_behavior,
CASE WHEN b0 THEN 'unknown' WHEN b1 THEN 'fail' WHEN b2 THEN 'unknown' ELSE 'pass' END AS claim,
CASE WHEN b0 THEN 'fail' WHEN b1 THEN 'unknown' ELSE 'pass' END AS specification,
CASE WHEN j = 0 THEN 'ready' WHEN b2 THEN 'failed' WHEN b3 THEN 'unknown' ELSE 'partial' END AS closure,
CASE WHEN NOT b2 THEN 'unsupported' WHEN b3 THEN 'truncated' WHEN b4 THEN 'ambiguous' WHEN k = 0 THEN 'no-match' WHEN b0 THEN 'partial' WHEN k > 1 THEN 'ambiguous' ELSE 'found' END AS semantic_query,
CASE WHEN l = 'unknown' OR r = 'unknown' THEN 'unknown' WHEN l = 'pass' AND r = 'pass' THEN 'equivalent' WHEN l <> r OR NOT b0 THEN 'different' ELSE 'nonconforming' END AS trace,
CASE WHEN b0 OR b1 THEN 'fail' WHEN b2 THEN 'unknown' ELSE 'pass' END AS trust_gate,
CASE WHEN b0 OR (b1 AND b2) THEN 'changed' WHEN b1 THEN 'unchanged' ELSE 'unknown' END AS matched_item,
CASE WHEN b0 THEN 'unknown' WHEN b1 THEN 'added' ELSE 'unknown' END AS one_sided_item,
CASE WHEN NOT b0 THEN 'unknown' WHEN k = 1 THEN 'unchanged' WHEN k > 1 THEN 'duplicated' WHEN j = 1 THEN 'unknown' WHEN j > 1 THEN 'split' WHEN b3 THEN 'unknown' WHEN b4 THEN 'removed' ELSE 'unknown' END AS source_mapping,
CASE WHEN b0 THEN 'truncated' WHEN b1 THEN 'found' WHEN b2 THEN 'not_found' ELSE 'unknown' END AS call_path,
CASE WHEN k <> 0 AND b0 THEN 'failed' WHEN b3 THEN 'unknown' WHEN k = 0 THEN 'unknown' WHEN b1 THEN 'unknown' WHEN b2 THEN 'ready' ELSE 'open' END AS obligations
FROM t""")
def status_ladders(spark, d):
    """All twenty ladders; an order's key gives the conditions."""
    key = F.col("o_orderkey")
    b = [F.floor(key / (1 << i)) % 2 == 1 for i in range(5)]
    k, j = key % 3, key % 4
    word = lambda x: F.when(x == 0, "pass").when(x == 1, "fail").otherwise("unknown")
    s = {
        "artifacts": status.artifacts(*b), "process": status.process(*b[:3]), "function": status.function(*b), "web_capture": status.web_capture(*b[:2]), "web_dimension": status.web_dimension(*b[:2]),
        "scenario": status.scenario(*b[:3]), "bundle": status.bundle(*b[:3]), "correlation": status.correlation(*b[:3]), "changed_behavior": status.changed_behavior(*b[:4]), "claim": status.claim(*b[:3]),
        "specification": status.specification(*b[:2]), "closure": status.closure(j, b[2], b[3]), "semantic_query": status.semantic_query(b[2], b[3], b[4], k, b[0]), "trace": status.trace(word(k), word(F.floor(key / 3) % 3), b[0]),
        "trust_gate": status.trust_gate(*b[:3]), "matched_item": status.matched_item(*b[:3]), "one_sided_item": status.one_sided_item(b[0], b[1], "added"), "source_mapping": status.source_mapping(b[0], k, j, b[3], b[4]),
        "call_path": status.call_path(*b[:3]), "obligations": status.obligations(k, b[0], b[1], b[2], b[3]),
    }
    return table(spark, d, "orders").select("o_orderkey", *[c.alias(name) for name, c in s.items()])


@query(f"""WITH {HALVES}, x AS ({DIFF}), g AS (SELECT user_id, count(left_n) AS nl, count(right_n) AS nr, count(*) FILTER (status = 'changed') AS c, count(*) FILTER (status IN ('added', 'removed')) AS o FROM x GROUP BY 1)
SELECT user_id, CASE WHEN user_id % 5 <> 0 THEN greatest(0, least(nl, nr) - c) ELSE 0 END AS unchanged, CASE WHEN c > 0 THEN 'changed' WHEN o > 0 THEN 'unknown' ELSE 'unchanged' END AS process, CASE WHEN o > 0 THEN 'unknown' WHEN c > 0 THEN 'changed' ELSE 'unchanged' END AS function FROM g""")
def folded_status(spark, d):
    """Counts of unchanged kinds of covered users (id not divisible by 5), and the worst status in two orders of rank."""
    x = diff.keyed_diff(*_halves(spark, d), ["user_id", "event_type"], ["n"])
    own = F.when(F.col("status").isin("added", "removed"), "unknown").otherwise(F.col("status"))
    g = x.withColumn("own", own).groupBy("user_id").agg(
        F.count("left_n").alias("nl"), F.count("right_n").alias("nr"), F.count_if(F.col("status") == "changed").alias("c"),
        status.worst(F.col("own"), ["changed", "unknown", "unchanged"]).alias("process"), status.worst(F.col("own"), ["unknown", "changed", "unchanged"]).alias("function"),
    )
    least = F.greatest(F.lit(0).cast("long"), F.least("nl", "nr") - F.col("c"))
    return g.select("user_id", F.when(F.col("user_id") % 5 != 0, least).otherwise(F.lit(0).cast("long")).alias("unchanged"), "process", "function")


_NODES = """e AS (SELECT s.class_id AS source, n.class_id AS node, s.digest = n.digest AS exact, n.path = s.path AS located FROM s JOIN n ON s.digest = n.digest OR n.path = s.path),
p AS (SELECT source, node, bool_or(exact) AS exact, bool_or(located) AS located, CASE WHEN bool_or(exact) THEN 100 ELSE 0 END + CASE WHEN bool_or(located) THEN 60 ELSE 0 END AS score FROM e GROUP BY ALL)"""


@query(f"""WITH {_PLACES}, {_NODES}, b AS (SELECT source, max(score) FILTER (located) AS top FROM p GROUP BY 1),
g AS (SELECT source, count(*) AS n, count(*) FILTER (exact) AS e, count(*) FILTER (located AND score = top) AS t, min(node) FILTER (exact) AS node FROM p JOIN b USING (source) GROUP BY 1),
m AS (SELECT node, count(*) > 1 AS merged FROM g WHERE e = 1 GROUP BY 1), a AS (SELECT DISTINCT class_id AS source FROM s)
SELECT source, CASE WHEN e = 1 AND merged THEN 'merged' WHEN e = 1 THEN 'unchanged' WHEN e > 1 THEN 'duplicated' WHEN t = 1 THEN 'unknown' WHEN t > 1 THEN 'split' WHEN n > 0 THEN 'unknown' ELSE 'removed' END AS status,
coalesce(CASE WHEN e > 0 THEN e ELSE t END, 0) AS nodes FROM a LEFT JOIN g USING (source) LEFT JOIN m USING (node)""")
def source_mapping_status(spark, d):
    """Page classes as in source_to_bundle_members; equal content is exact, an equal path locates."""
    s, n = _places(spark, d)
    pair = lambda on: s.select(F.col("class_id").alias("source"), F.col(on).alias("k")).join(n.select(F.col("class_id").alias("node"), F.col(on).alias("k")), "k").select("source", "node").distinct()
    both = pair("digest").withColumn("exact", F.lit(True)).join(pair("path").withColumn("located", F.lit(True)), ["source", "node"], "full_outer")
    flag = lambda c: F.coalesce(c, F.lit(False))
    pairs = both.select("source", "node", flag("exact").alias("exact"), flag("located").alias("located")).withColumn("score", F.when(F.col("exact"), 100).otherwise(0) + F.when(F.col("located"), 60).otherwise(0))
    return match.mappings(pairs, s.select(F.col("class_id").alias("source")).distinct(), "source", F.lit(True))


_GATE = [("o_orderstatus", "o_orderstatus"), ("o_orderpriority", "o_orderpriority"), ("o_totalprice", "o_totalprice")]


@query("""WITH a AS (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS s2, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS p2, CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS t2 FROM orders)
SELECT o_orderkey, CASE WHEN s2 <> o_orderstatus THEN 'o_orderstatus' WHEN t2 <> o_totalprice THEN 'o_totalprice' END AS mismatch,
CASE WHEN s2 <> o_orderstatus OR t2 <> o_totalprice OR o_orderkey % 13 = 0 THEN 'fail' WHEN p2 IS NULL THEN 'unknown' ELSE 'pass' END AS verdict FROM a""")
def trust_gate(spark, d):
    """Expected against actual orders; a dimension without an actual value is unknown, the date is volatile and ignored; every 13th is truncated."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    actual = o.select(
        "o_orderkey", F.when(k % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.when(k % 5 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(k % 11 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"), F.current_timestamp().alias("o_orderdate"),
    )
    return match.gate(o, actual, "o_orderkey", ["o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate"], {"o_orderdate"}, k % 13 == 0)


@query("""WITH need(lane, event_type) AS (VALUES ('entry', 'signup'), ('entry', 'view'), ('use', 'click'), ('use', 'purchase')), u AS (SELECT DISTINCT user_id FROM events), h AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 90)
SELECT user_id, count(*) FILTER (h.event_type IS NULL) AS missing, string_agg(lane || ':' || need.event_type, ',' ORDER BY lane, need.event_type) FILTER (h.event_type IS NULL) AS findings, CASE WHEN bool_and(h.event_type IS NOT NULL) THEN 'ready' ELSE 'blocked' END AS status
FROM u CROSS JOIN need LEFT JOIN h USING (user_id, event_type) GROUP BY 1""")
def readiness(spark, d):
    """Checks of two lanes that each user needs; an event above 90 of the kind is the proof."""
    need = [("entry", "signup"), ("entry", "view"), ("use", "click"), ("use", "purchase")]
    e = table(spark, d, "events")
    have = e.where("value > 90").select("user_id", F.col("event_type").alias("check"))
    return match.required(e.select("user_id"), have, "user_id", "check", need)


@query("""WITH c AS (SELECT c_custkey, count(o_orderkey) AS orders, count(*) FILTER (o_orderstatus = 'F') AS bad, count(*) FILTER (o_orderpriority LIKE '5%') AS soft, count(*) FILTER (o_totalprice > 300000) AS large FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
r AS (SELECT c_custkey, unnest(list_filter([CASE WHEN orders = 0 THEN 'surface-missing' END, CASE WHEN bad > 2 THEN 'verifier-failed' END, CASE WHEN soft > 1 THEN 'active-unknown' END, CASE WHEN large > 0 THEN 'owner-missing' END], lambda x: x IS NOT NULL)) AS code FROM c)
SELECT c.c_custkey, string_agg(code, ',' ORDER BY code) AS reasons, CASE WHEN count(code) = 0 THEN 'ready' WHEN bool_or(code = 'verifier-failed') THEN 'failed' WHEN bool_or(code = 'active-unknown') THEN 'unknown' ELSE 'partial' END AS status FROM c LEFT JOIN r USING (c_custkey) GROUP BY 1""")
def closure_reasons(spark, d):
    """Reasons against a customer's closure, from its orders, and the status they lead to."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", "o_orderpriority", "o_totalprice")
    n = table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").groupBy("c_custkey").agg(
        F.count("o_orderstatus").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("bad"), F.count_if(F.startswith("o_orderpriority", F.lit("5"))).alias("soft"), F.count_if(F.col("o_totalprice") > 300000).alias("large")
    )
    codes = {"surface-missing": F.col("orders") == 0, "verifier-failed": F.col("bad") > 2, "active-unknown": F.col("soft") > 1, "owner-missing": F.col("large") > 0}
    found = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in sorted(codes.items())]), lambda x: x.isNotNull())
    told = n.select("c_custkey", found.alias("r"))
    own = status.closure(F.size("r"), F.array_contains("r", "verifier-failed"), F.array_contains("r", "active-unknown"))
    return told.select("c_custkey", F.when(F.size("r") > 0, F.array_join("r", ",")).alias("reasons"), own.alias("status"))


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 3 THEN 'open' ELSE 'verified' END AS own FROM part), bad AS (SELECT id FROM p WHERE own = 'open' UNION SELECT p.id FROM bad JOIN p ON p.id IN (2 * bad.id, 2 * bad.id + 1))
SELECT p.id AS p_partkey, own, CASE WHEN bad.id IS NOT NULL THEN 'open' ELSE own END AS status, own = 'verified' AND bad.id IS NOT NULL AS dependency_open FROM p LEFT JOIN bad USING (id)""")
def obligation_dependencies(spark, d):
    """Part k depends on part k // 2; a verified one whose dependency is open is open too, until nothing changes."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 7 == 3, "open").otherwise("verified").alias("own"))
    needs = p.select("id", F.floor(F.col("id") / 2).alias("needs")).where("needs < id")
    found = match.reopened(p, needs)
    return found.select(F.col("id").alias("p_partkey"), "own", "status", "dependency_open")


@query("""WITH s AS (SELECT user_id * 100 + day(ts) AS slot, hour(ts) < 12 AS early, count(*) FILTER (event_type = 'signup') AS n, max(event_id) FILTER (event_type = 'signup') AS b, min(event_id) FILTER (event_type = 'purchase') AS a, string_agg(event_type, ',' ORDER BY event_id) FILTER (event_type IN ('signup', 'purchase')) AS seq FROM events GROUP BY ALL),
v AS (SELECT slot, early, seq, CASE WHEN n = 0 THEN 'unknown' WHEN n > 2 THEN 'fail' WHEN a IS NOT NULL AND b >= a THEN 'fail' ELSE 'pass' END AS side FROM s)
SELECT slot, l.side AS left_side, r.side AS right_side, CASE WHEN l.side = 'unknown' OR r.side = 'unknown' THEN 'unknown' WHEN l.side = 'pass' AND r.side = 'pass' THEN 'equivalent' WHEN l.side <> r.side OR l.seq IS DISTINCT FROM r.seq THEN 'different' ELSE 'nonconforming' END AS verdict
FROM (SELECT * FROM v WHERE early) l JOIN (SELECT * FROM v WHERE NOT early) r USING (slot)""")
def trace_verdict(spark, d):
    """A user's morning against the afternoon of the same day: cardinality of signups (1 to 2), then signups before purchases, then order."""
    e = table(spark, d, "events").withColumns({"slot": F.col("user_id") * 100 + F.dayofmonth("ts"), "early": F.hour("ts") < 12})
    sides = trace.evaluated(e, ["slot", "early"], "event_type", "event_id", {"signup": (1, 2)}, [("signup", "purchase")])
    l = sides.where("early").select("slot", F.col("side").alias("left_side"), F.col("order").alias("lo"))
    r = sides.where("NOT early").select("slot", F.col("side").alias("right_side"), F.col("order").alias("ro"))
    verdict = status.trace(F.col("left_side"), F.col("right_side"), F.col("lo").eqNullSafe(F.col("ro")))
    return l.join(r, "slot").select("slot", "left_side", "right_side", verdict.alias("verdict"))


@query("""WITH c AS (SELECT user_id * 100 + day(ts) AS user_id, hour(ts) AS day, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'purchase') AS purchases, count(DISTINCT event_type) AS kinds FROM events GROUP BY ALL),
f AS (SELECT user_id, min(day) AS day, count(*) AS samples FROM c GROUP BY 1), b AS (SELECT c.user_id, samples, clicks, purchases, kinds FROM c JOIN f USING (user_id, day)),
x AS (SELECT user_id, b.samples, bool_and(c.clicks = b.clicks) AS s1, bool_and(c.purchases = b.purchases) AS s2, bool_and(c.kinds = b.kinds) AS s3 FROM c JOIN b USING (user_id) GROUP BY ALL)
SELECT user_id, samples, concat_ws(',', CASE WHEN NOT s1 THEN 'clicks' END, CASE WHEN NOT s2 THEN 'purchases' END, CASE WHEN NOT s3 THEN 'kinds' END) AS unstable, CASE WHEN samples < 2 THEN 'insufficient' WHEN s1 AND s2 AND s3 THEN 'stable' WHEN s2 AND s3 THEN 'timing_variance' ELSE 'unstable' END AS verdict FROM x""")
def repeatability(spark, d):
    """The hours of a user's day are captures, each compared with the first; clicks stand for the timing dimension."""
    day = F.hour("ts")
    c = table(spark, d, "events").groupBy((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("user_id"), day.alias("day")).agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.count_distinct("event_type").alias("kinds"))
    return trace.repeatable(c, "user_id", "day", ["clicks", "purchases", "kinds"], {"clicks"})


@query("""SELECT l_orderkey, count(*) AS returned, max(l_linenumber)::BIGINT AS total, min(l_linenumber) = 1 AND count(*) = max(l_linenumber) AND count(*) FILTER (l_quantity < 2) = 0 AS complete, greatest(0, max(l_linenumber) - count(*)) + count(*) FILTER (l_quantity < 2) AS omitted FROM lineitem GROUP BY 1""")
def known_page_coverage(spark, d):
    """An order's lines are a page from its least line number; lines of quantity 1 are dropped downstream."""
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("returned"), F.max("l_linenumber").cast("long").alias("total"), F.min("l_linenumber").alias("low"), F.count_if(F.col("l_quantity") < 2).alias("dropped"))
    complete = (F.col("low") == 1) & (F.col("returned") == F.col("total")) & (F.col("dropped") == 0)
    return n.select("l_orderkey", "returned", "total", complete.alias("complete"), (F.greatest(F.lit(0).cast("long"), F.col("total") - F.col("returned")) + F.col("dropped")).alias("omitted"))


@query("""SELECT conv_id, CASE WHEN max(turn) + 1 > count(*) THEN 'truncated' WHEN bool_or(role = 'system') THEN 'policy_filtered' WHEN min(turn) > 0 THEN 'attach_limited' ELSE 'complete' END AS state, greatest(0, max(turn) + 1 - count(*))::BIGINT AS dropped FROM conversations GROUP BY 1""")
def capture_completeness(spark, d):
    """A conversation is a capture; turns that are missing were dropped, a system turn stands for a filter."""
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last"), F.count("*").alias("n"), F.min("turn").alias("first"), F.bool_or(F.col("role") == "system").alias("filtered"))
    state = F.when(F.col("last") + 1 > F.col("n"), "truncated").when(F.col("filtered"), "policy_filtered").when(F.col("first") > 0, "attach_limited").otherwise("complete")
    return g.select("conv_id", state.alias("state"), F.greatest(F.lit(0).cast("long"), F.col("last") + 1 - F.col("n")).alias("dropped"))


@query("""WITH m AS (SELECT p_partkey AS id, p_brand || '/' || p_type || '/' || p_size AS k, CASE WHEN p_partkey % 2 = 0 THEN 'l' ELSE 'r' END AS side, round(p_retailprice) AS content FROM part),
g AS (SELECT k, count(*) FILTER (side = 'l') AS l, count(*) FILTER (side = 'r') AS r, min(content) FILTER (side = 'l') AS lc, min(content) FILTER (side = 'r') AS rc FROM m GROUP BY 1),
i AS (SELECT k, CASE WHEN l = 1 AND r = 1 THEN CASE WHEN lc <> rc THEN 'changed' ELSE 'unchanged' END WHEN l > 0 AND r > 0 THEN 'unknown' WHEN l = 0 THEN 'added' ELSE 'removed' END AS status, l, r FROM g)
SELECT status, count(*) AS items, sum(l)::BIGINT AS lefts, sum(r)::BIGINT AS rights FROM i GROUP BY 1""")
def version_items(spark, d):
    """Parts of even and odd keys as two versions; a pair is changed if its rounded price differs, an ambiguous group is unknown."""
    p = table(spark, d, "part").select(F.concat_ws("/", "p_brand", "p_type", F.col("p_size").cast("string")).alias("k"), (F.col("p_partkey") % 2 == 0).alias("left"), F.round("p_retailprice").alias("content"))
    l = F.col("left")
    g = p.groupBy("k").agg(F.count_if(l).alias("l"), F.count_if(~l).alias("r"), F.min(F.when(l, F.col("content"))).alias("lc"), F.min(F.when(~l, F.col("content"))).alias("rc"))
    both = (F.col("l") > 0) & (F.col("r") > 0)
    single = (F.col("l") == 1) & (F.col("r") == 1)
    one = F.when(F.col("l") == 0, status.one_sided_item(F.lit(False), F.lit(True), "added")).otherwise(status.one_sided_item(F.lit(False), F.lit(True), "removed"))
    own = F.when(single, status.matched_item(F.col("lc") != F.col("rc"), F.lit(True), F.lit(False))).when(both, "unknown").otherwise(one)
    return g.select(own.alias("status"), "l", "r").groupBy("status").agg(F.count("*").alias("items"), F.sum("l").alias("lefts"), F.sum("r").alias("rights"))


@query("""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN source END AS source, sha256(text) AS digest FROM documents), seen AS (SELECT DISTINCT digest FROM s WHERE doc_id % 2 = 1), res AS (SELECT DISTINCT source FROM s JOIN seen USING (digest) WHERE source IS NOT NULL)
SELECT doc_id, CASE WHEN seen.digest IS NOT NULL THEN 'observed' WHEN res.source IS NOT NULL THEN 'resident-in-observed' WHEN s.source IS NULL THEN 'unknown' ELSE 'unobserved' END AS state FROM s LEFT JOIN seen USING (digest) LEFT JOIN res USING (source) WHERE doc_id % 2 = 0""")
def load_states(spark, d):
    """Even documents are static nodes, odd ones were loaded; the source is the layer that contains a node, unknown for every third."""
    s = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("layer"), F.sha2("text", 256).alias("digest"))
    seen = s.where("doc_id % 2 = 1").select("digest", F.lit(True).alias("seen")).distinct()
    told = s.join(seen, "digest", "left")
    layers = told.where("seen AND layer IS NOT NULL").select("layer", F.lit(True).alias("resident")).distinct()
    state = F.when(F.col("seen"), "observed").when(F.col("resident"), "resident-in-observed").when(F.col("layer").isNull(), "unknown").otherwise("unobserved")
    return told.where("doc_id % 2 = 0").join(layers, "layer", "left").select("doc_id", state.alias("state"))


@query("""WITH t AS (SELECT event_id, user_id * 100 + day(ts) AS batch, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'x' ELSE props->>'$.k' END AS BIGINT) AS k FROM events)
SELECT batch, count(k) AS ok, count(*) - count(k) AS failed, CASE WHEN count(k) = count(*) THEN 'ok' WHEN count(k) = 0 THEN 'error' ELSE 'partial' END AS status FROM t GROUP BY 1""")
def batch_outcomes(spark, d):
    """Each event is an item whose k is parsed; every third is malformed, which fails that item alone."""
    k = F.when(F.col("event_id") % 3 == 0, "x").otherwise(F.get_json_object("props", "$.k")).try_cast("bigint")
    g = table(spark, d, "events").select((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("batch"), k.alias("k")).groupBy("batch").agg(F.count("k").alias("ok"), (F.count("*") - F.count("k")).alias("failed"))
    return g.withColumn("status", F.when(F.col("failed") == 0, "ok").when(F.col("ok") == 0, "error").otherwise("partial"))


@query("""SELECT l_shipyear AS family, l_returnflag AS operation, count(DISTINCT l_suppkey) AS providers, count(*) AS uses, CASE WHEN count(DISTINCT l_suppkey) >= 5 THEN 'available' WHEN count(*) > 0 THEN 'degraded' END AS availability
FROM (SELECT *, year(l_shipdate) * 100 + week(l_shipdate) AS l_shipyear FROM lineitem WHERE l_quantity > 45) GROUP BY ALL""")
def capability_rollup(spark, d):
    """Suppliers are providers of an operation (return flag) in a family (week)."""
    li = table(spark, d, "lineitem").where("l_quantity > 45")
    g = li.groupBy((F.year("l_shipdate") * 100 + F.weekofyear("l_shipdate")).alias("family"), F.col("l_returnflag").alias("operation")).agg(F.count_distinct("l_suppkey").alias("providers"), F.count("*").alias("uses"))
    return g.withColumn("availability", F.when(F.col("providers") >= 5, "available").otherwise("degraded"))


@query(f"""WITH {HALVES}, x AS ({DIFF}), f AS (SELECT user_id, 'static' AS layer, status AS class FROM x WHERE status <> 'unchanged' UNION ALL SELECT user_id, 'runtime', CASE WHEN abs(sum(CASE WHEN ts < TIMESTAMP '2024-01-16' THEN value ELSE -value END)) > 100 THEN 'changed' ELSE 'unchanged' END FROM events GROUP BY user_id)
SELECT layer, class, count(*) AS findings, count(DISTINCT user_id) AS subjects FROM f GROUP BY ALL""")
def finding_totals(spark, d):
    """Findings of the static side (event counts) and the runtime side (value sums), by class."""
    x = diff.keyed_diff(*_halves(spark, d), ["user_id", "event_type"], ["n"]).where("status <> 'unchanged'").select("user_id", F.lit("static").alias("layer"), F.col("status").alias("class"))
    early = F.col("ts") < F.to_timestamp_ntz(F.lit("2024-01-16"))
    moved = F.abs(F.sum(F.when(early, F.col("value")).otherwise(-F.col("value")))) > 100
    r = table(spark, d, "events").groupBy("user_id").agg(F.when(moved, "changed").otherwise("unchanged").alias("class")).select("user_id", F.lit("runtime").alias("layer"), "class")
    return x.unionByName(r).groupBy("layer", "class").agg(F.count("*").alias("findings"), F.count_distinct("user_id").alias("subjects"))


@query("""WITH r AS (SELECT o_custkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS revision, sha256(concat_ws('|', o_orderkey::VARCHAR, o_orderstatus)) AS digest, CASE WHEN o_orderkey % 97 = 0 THEN 'none' END AS broken FROM orders),
l AS (SELECT *, lag(digest) OVER (PARTITION BY id ORDER BY revision) AS prior, coalesce(broken, lag(digest) OVER (PARTITION BY id ORDER BY revision)) AS claimed FROM r)
SELECT id, max(revision) AS head, arg_max(digest, revision) AS digest, bool_and(claimed IS NOT DISTINCT FROM prior) AS chained FROM l GROUP BY 1""")
def latest_revisions(spark, d):
    """A customer's orders are the revisions of a record; every 97th order claims a wrong digest of the one before."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus"), 256).alias("digest"))
    w = Window.partitionBy("id").orderBy("o_orderkey")
    prior = F.lag("digest").over(w)
    r = o.select("id", F.row_number().over(w).cast("long").alias("revision"), "digest", prior.alias("prior"), F.when(F.col("o_orderkey") % 97 == 0, "none").otherwise(prior).alias("claimed"))
    return trace.heads(r, "id", "revision", "digest", "claimed", "prior")


@query("""WITH r AS (SELECT o_orderkey // 2 AS id, sha256(o_orderstatus) AS digest FROM orders WHERE o_orderkey % 7 <> 0), g AS (SELECT id, count(*) AS copies, count(DISTINCT digest) AS n, min(digest) AS digest FROM r GROUP BY 1)
SELECT id, copies, CASE WHEN n = 1 THEN digest END AS digest, CASE WHEN n > 1 THEN 'conflict' WHEN copies > 1 THEN 'duplicate' ELSE 'single' END AS status FROM g""")
def idempotent_merge(spark, d):
    """Records of one id are the same record only if their content is: equal ones merge, others are a conflict."""
    r = table(spark, d, "orders").where("o_orderkey % 7 <> 0").select(F.floor(F.col("o_orderkey") / 2).alias("id"), F.sha2("o_orderstatus", 256).alias("digest"))
    return match.merged(r, "id", "digest")


@query("""WITH a AS (SELECT l_orderkey, list(DISTINCT l_returnflag ORDER BY l_returnflag) AS s, list(l_returnflag ORDER BY l_returnflag) AS m FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1), b AS (SELECT l_orderkey, list(DISTINCT l_returnflag ORDER BY l_returnflag) AS s, list(l_returnflag ORDER BY l_returnflag) AS m FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1)
SELECT l_orderkey, coalesce(a.s = b.s, false) AS same_set, coalesce(a.m = b.m, false) AS same_multiset FROM a FULL JOIN b USING (l_orderkey)""")
def set_comparison(spark, d):
    """Return flags of an order's odd and even lines, as sets and as multisets, by counts of each flag."""
    odd = F.col("l_linenumber") % 2 == 1
    n = table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count_if(odd).alias("a"), F.count_if(~odd).alias("b"))
    return n.groupBy("l_orderkey").agg(F.bool_and((F.col("a") > 0) == (F.col("b") > 0)).alias("same_set"), F.bool_and(F.col("a") == F.col("b")).alias("same_multiset"))


@query("SELECT o_custkey, (o_orderdate::VARCHAR)[1:10] AS day, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def uniqueness_violations(spark, d):
    """Customers and days that should name one order but name more."""
    return table(spark, d, "orders").groupBy("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n")).where("n > 1")


@query("""SELECT n_nationkey, array_to_string(list_sort(list_distinct(list(DISTINCT c_mktsegment))), ',') AS segments, count(DISTINCT c_mktsegment) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9500 GROUP BY 1""")
def distinct_links(spark, d):
    """The sorted distinct segments of a nation's richest customers."""
    c = table(spark, d, "customer").where("c_acctbal > 9500").select(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment").distinct()
    g = table(spark, d, "nation").select("n_nationkey").join(c, "n_nationkey", "left").groupBy("n_nationkey").agg(F.sort_array(F.collect_set("c_mktsegment")).alias("s"))
    return g.select("n_nationkey", F.array_join("s", ",").alias("segments"), F.size("s").cast("long").alias("n"))


def _unioned(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


@query("""SELECT 'customer' AS kind, count(*) AS total, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT c_name AS x FROM customer ORDER BY c_name LIMIT 3)) AS sample FROM customer UNION ALL
SELECT 'supplier', count(*), (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT s_name AS x FROM supplier ORDER BY s_name LIMIT 3)) FROM supplier UNION ALL SELECT 'part', count(*), (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT p_name || p_partkey AS x FROM part ORDER BY x LIMIT 3)) FROM part""")
def overview_counts(spark, d):
    """Totals of three kinds with a sample of three names each."""

    def one(kind: str, name) -> DataFrame:
        names = table(spark, d, kind).select(name.alias("x"))
        total = names.agg(F.count("*").alias("total"))
        sample = names.orderBy("x").limit(3).agg(F.array_join(F.sort_array(F.collect_list("x")), ",").alias("sample"))
        return total.crossJoin(F.broadcast(sample)).select(F.lit(kind).alias("kind"), "total", "sample")  # one row each

    return _unioned([one("customer", F.col("c_name")), one("supplier", F.col("s_name")), one("part", F.concat("p_name", F.col("p_partkey").cast("string")))])


@query("""WITH s AS (SELECT p_name AS name, min(p_partkey) AS address, count(*) AS entries FROM part GROUP BY 1) SELECT name, address, entries, regexp_matches(name, '^(sub|loc|fcn)_?[0-9a-f]+$') AS auto FROM s""")
def first_by_name(spark, d):
    """The first entry of each name, and whether the name is made from an address."""
    g = table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("address"), F.count("*").alias("entries"))
    return g.withColumn("auto", F.rlike("name", F.lit("^(sub|loc|fcn)_?[0-9a-f]+$")))
