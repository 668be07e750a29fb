"""Registry of the queries and of their DuckDB equivalents.

The reference operators act on records about software; here each runs on a
stand-in relation of the test tables, which its docstring or SQL names.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import scalar
from tracewell.operators import diff, graph, match, search, trace
from tracewell.sources import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


CUT = "2024-01-16"


def _halves(spark, d):
    e = table(spark, d, "events")
    per = lambda x: x.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    cut = F.to_timestamp_ntz(F.lit(CUT))
    return per(e.where(F.col("ts") < cut)), per(e.where(F.col("ts") >= cut))


HALVES = f"""a AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '{CUT}' GROUP BY ALL),
b AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '{CUT}' GROUP BY ALL)"""
DIFF = """SELECT user_id, event_type, a.n AS left_n, b.n AS right_n,
  CASE WHEN a.n IS NOT NULL AND b.n IS NOT NULL AND a.n <> b.n THEN 'n' ELSE '' END AS changed,
  CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' WHEN a.n <> b.n THEN 'changed' ELSE 'unchanged' END AS status
FROM a FULL JOIN b USING (user_id, event_type)"""


@query(f"WITH {HALVES} {DIFF}")
def events_keyed_diff(spark, d):
    return diff.keyed_diff(*_halves(spark, d), ["user_id", "event_type"], ["n"])


@query(f"WITH {HALVES}, x AS ({DIFF}) SELECT event_type, CASE WHEN status IN ('added', 'removed') THEN 'unknown' ELSE status END AS status, count(*) AS n FROM x GROUP BY ALL")
def artifact_status_summary(spark, d):
    a, b = _halves(spark, d)
    return diff.status_summary(diff.keyed_diff(a, b, ["user_id", "event_type"], ["n"], right_complete=False), ["event_type"])


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 THEN 'changed' ELSE 'unchanged' END AS status,
  concat_ws(',', CASE WHEN o_orderkey % 7 = 0 THEN 'o_orderstatus' END, CASE WHEN o_orderkey % 5 = 0 THEN 'o_totalprice' END) AS changed FROM orders""")
def orders_dimension_diff(spark, d):
    a = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    b = a.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus"))).withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return diff.keyed_diff(a, b, ["o_orderkey"], ["o_orderstatus", "o_totalprice"]).select("o_orderkey", "status", "changed")


@query(f"""WITH {HALVES}, x AS ({DIFF}), r AS (SELECT event_type, user_id, status, row_number() OVER (ORDER BY event_type, user_id) AS position FROM x WHERE status <> 'unchanged')
SELECT event_type, user_id, status, position, position <= 50 AS kept FROM r""")
def web_dimension_budget(spark, d):
    x = diff.keyed_diff(*_halves(spark, d), ["user_id", "event_type"], ["n"]).where("status <> 'unchanged'")
    return diff.budgeted(x, ["event_type", "user_id"], 50).select("event_type", "user_id", "status", "position", "kept")


@query("""WITH a AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R')
SELECT l_partkey, l_suppkey, CASE WHEN a.x IS NULL THEN 'right_only' WHEN b.y IS NULL THEN 'left_only' ELSE 'both' END AS side
FROM (SELECT *, 1 AS x FROM a) a FULL JOIN (SELECT *, 1 AS y FROM b) b USING (l_partkey, l_suppkey)""")
def bundle_membership(spark, d):
    li = table(spark, d, "lineitem")
    return diff.membership(li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'R'"), ["l_partkey", "l_suppkey"])


@query("""WITH a AS (SELECT o_custkey, list(o_orderstatus ORDER BY o_orderkey) AS a FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1), b AS (SELECT o_custkey, list(o_orderstatus ORDER BY o_orderkey) AS b FROM orders WHERE o_orderkey % 10 <> 3 GROUP BY 1)
SELECT o_custkey, coalesce(len(a), 0) AS left_size, coalesce(len(b), 0) AS right_size, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' WHEN a = b THEN 'unchanged' WHEN b[1:len(a)] = a OR a[1:len(b)] = b THEN 'advanced' ELSE 'diverged' END AS relation FROM a FULL JOIN b USING (o_custkey)""")
def history_prefix(spark, d):
    """A customer's early orders against all but some of them."""
    o = table(spark, d, "orders")
    return diff.history_relation(o.where("o_orderdate < timestamp_ntz'1997-01-01'"), o.where("o_orderkey % 10 <> 3"), "o_custkey", "o_orderkey", "o_orderstatus")


@query("""WITH p AS (SELECT p_partkey, p_brand || '/' || p_type || '/' || p_size AS k1, p_brand || '/' || p_type AS k2 FROM part),
a AS (SELECT * FROM p WHERE p_partkey % 2 = 0), b AS (SELECT * FROM p WHERE p_partkey % 2 = 1),
ua AS (SELECT k1, min(p_partkey) AS l FROM a GROUP BY k1 HAVING count(*) = 1), ub AS (SELECT k1, min(p_partkey) AS r FROM b GROUP BY k1 HAVING count(*) = 1),
t1 AS (SELECT l, r FROM ua JOIN ub USING (k1)),
va AS (SELECT k2, min(p_partkey) AS l FROM a WHERE p_partkey NOT IN (SELECT l FROM t1) GROUP BY k2 HAVING count(*) = 1),
vb AS (SELECT k2, min(p_partkey) AS r FROM b WHERE p_partkey NOT IN (SELECT r FROM t1) GROUP BY k2 HAVING count(*) = 1)
SELECT l AS left_id, r AS right_id, 'exact' AS tier FROM t1 UNION ALL SELECT l, r, 'kind' FROM va JOIN vb USING (k2)""")
def version_match_tiers(spark, d):
    p = table(spark, d, "part")
    tiers = [("exact", F.concat_ws("/", "p_brand", "p_type", F.col("p_size").cast("string"))), ("kind", F.concat_ws("/", "p_brand", "p_type"))]
    return match.tiered_unique(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 2 = 1"), "p_partkey", "p_partkey", tiers)


@query("""WITH a AS (SELECT * FROM part WHERE p_partkey % 2 = 0), b AS (SELECT * FROM part WHERE p_partkey % 2 = 1),
x AS (SELECT a.p_partkey AS left_id, count(*) AS c, min(b.p_partkey) AS r FROM a JOIN b USING (p_brand, p_type, p_size) GROUP BY 1),
y AS (SELECT a.p_partkey AS left_id, count(*) AS c, min(b.p_partkey) AS r FROM a JOIN b USING (p_brand, p_size) WHERE a.p_partkey NOT IN (SELECT left_id FROM x) GROUP BY 1),
z AS (SELECT 'full' AS tier, * FROM x UNION ALL SELECT 'partial', * FROM y)
SELECT left_id, tier, CASE WHEN c = 1 THEN 'matched' ELSE 'ambiguous' END AS status, c AS candidates, CASE WHEN c = 1 THEN r END AS right_id FROM z
UNION ALL SELECT p_partkey, 'none', 'unmatched', 0, NULL FROM a WHERE p_partkey NOT IN (SELECT left_id FROM z)""")
def member_match_consuming(spark, d):
    p = table(spark, d, "part")
    tiers = [("full", F.concat_ws("/", "p_brand", "p_type", F.col("p_size").cast("string"))), ("partial", F.concat_ws("/", "p_brand", F.col("p_size").cast("string")))]
    return match.consuming(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 2 = 1"), "p_partkey", "p_partkey", tiers)


@query("""WITH p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'left' ELSE 'right' END AS side, concat_ws('/', p_brand, p_type, p_size) AS k1, concat_ws('/', p_brand, p_size) AS k2 FROM part),
g1 AS (SELECT k1, count(*) FILTER (side = 'left') AS lefts, count(*) FILTER (side = 'right') AS rights, min(id) FILTER (side = 'left') AS l, min(id) FILTER (side = 'right') AS r FROM p GROUP BY 1 HAVING lefts > 0 AND rights > 0),
q AS (SELECT * FROM p WHERE k1 NOT IN (SELECT k1 FROM g1)),
g2 AS (SELECT k2, count(*) FILTER (side = 'left') AS lefts, count(*) FILTER (side = 'right') AS rights, min(id) FILTER (side = 'left') AS l, min(id) FILTER (side = 'right') AS r FROM q GROUP BY 1 HAVING lefts > 0 AND rights > 0),
x AS (SELECT side, id, 'full' AS tier, lefts, rights, l, r FROM p JOIN g1 USING (k1) UNION ALL SELECT side, id, 'partial', lefts, rights, l, r FROM q JOIN g2 USING (k2))
SELECT side, id, tier, CASE WHEN lefts = 1 AND rights = 1 THEN 'matched' ELSE 'ambiguous' END AS status, lefts, rights, CASE WHEN lefts = 1 AND rights = 1 THEN CASE side WHEN 'left' THEN r ELSE l END END AS partner FROM x
UNION ALL SELECT side, id, 'none', 'unmatched', 0, 0, NULL FROM q WHERE k2 NOT IN (SELECT k2 FROM g2)""")
def member_match_one_to_one(spark, d):
    """As member_match_consuming, but a key is used up on both sides and matches only if it is 1-to-1."""
    p = table(spark, d, "part")
    tiers = [("full", F.concat_ws("/", "p_brand", "p_type", F.col("p_size").cast("string"))), ("partial", F.concat_ws("/", "p_brand", F.col("p_size").cast("string")))]
    return match.one_to_one(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 2 = 1"), "p_partkey", "p_partkey", tiers)


@query("""SELECT o_custkey, o_orderkey, o_totalprice, rank::INT AS rank, greatest(n - 3, 0) AS omitted FROM (
SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE rank <= 3""")
def topk_candidates(spark, d):
    return match.top_candidates(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_totalprice", "o_orderkey", 3)


@query("""WITH need AS (SELECT DISTINCT p_brand FROM part) SELECT l_suppkey, count(DISTINCT p_brand) AS have FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY 1 HAVING count(DISTINCT p_brand) = (SELECT count(*) FROM need)""")
def relational_division(spark, d):
    part = table(spark, d, "part")
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct().join(part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return match.relational_division(rows, "l_suppkey", "p_brand", part)


@query("""SELECT e.event_id, e.user_id, (SELECT max(s.ts) FROM events s WHERE s.user_id = e.user_id AND s.event_type = 'signup' AND s.ts <= e.ts) AS last_time FROM events e WHERE e.event_type = 'purchase'""")
def asof_frontier(spark, d):
    e = table(spark, d, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'signup'").select("user_id", F.col("ts").alias("rts"), F.col("event_id").alias("rid"))
    return match.asof(left, right, "user_id", "ts", "rts", "rid").select("event_id", "user_id", "last_time")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000 AND o_orderpriority LIKE '1%')")
def anti_orphans(spark, d):
    """Customers without a large urgent order."""
    o = table(spark, d, "orders").where("o_totalprice > 150000 AND o_orderpriority LIKE '1%'")
    return table(spark, d, "customer").join(o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_select(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("SELECT n_nationkey, count(s_suppkey) AS owners, CASE count(s_suppkey) WHEN 0 THEN 'missing' WHEN 1 THEN 'ok' ELSE 'ambiguous' END AS status FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def ownership_diagnostics(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey").agg(F.count("s_suppkey").alias("owners"))
    return n.withColumn("status", F.when(F.col("owners") == 0, "missing").when(F.col("owners") == 1, "ok").otherwise("ambiguous"))


@query("SELECT c_custkey, sha256(concat_ws('|', length(c_custkey::VARCHAR) || ':' || c_custkey::VARCHAR, length(c_name) || ':' || c_name, length(c_mktsegment) || ':' || c_mktsegment)) AS evidence_id FROM customer")
def evidence_ids(spark, d):
    return table(spark, d, "customer").select("c_custkey", scalar.digest("c_custkey", "c_name", "c_mktsegment").alias("evidence_id"))


@query("SELECT l_orderkey, sha256(string_agg(h, ',' ORDER BY h)) AS digest FROM (SELECT l_orderkey, sha256(concat_ws('|', length(l_partkey::VARCHAR) || ':' || l_partkey::VARCHAR, length(l_suppkey::VARCHAR) || ':' || l_suppkey::VARCHAR)) AS h FROM lineitem) GROUP BY 1")
def multiset_digest(spark, d):
    h = table(spark, d, "lineitem").select("l_orderkey", scalar.digest("l_partkey", "l_suppkey").alias("h"))
    return h.groupBy("l_orderkey").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ","), 256).alias("digest"))


@query("SELECT r_name, sha256(string_agg(h, ',' ORDER BY h)) AS digest FROM (SELECT n_regionkey, sha256(concat_ws('|', length(n_nationkey::VARCHAR) || ':' || n_nationkey::VARCHAR, length(n_name) || ':' || n_name)) AS h FROM nation) JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def tree_digest(spark, d):
    h = table(spark, d, "nation").select("n_regionkey", scalar.digest("n_nationkey", "n_name").alias("h"))
    return h.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ","), 256).alias("digest"))


@query("SELECT doc_id, (length(text) - length(replace(text, 'the', ''))) // 3 AS hits FROM documents WHERE contains(text, 'the')")
def search_literal(spark, d):
    return search.literal(table(spark, d, "documents").select("doc_id", "text"), "text", "the").select("doc_id", "hits")


@query("SELECT doc_id, hits FROM (SELECT doc_id, len(regexp_extract_all(text, '[A-Z][a-z]+ion')) AS hits FROM documents) WHERE hits > 0")
def search_regex(spark, d):
    return search.regex(table(spark, d, "documents").select("doc_id", "text"), "text", "[A-Z][a-z]+ion").select("doc_id", "hits")


@query("""SELECT p_partkey, p_name, position, total, CASE WHEN total > 40 THEN 40 END AS next_offset FROM (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_name, p_partkey) AS position, count(*) OVER () AS total FROM part) WHERE position > 20 AND position <= 40""")
def search_page(spark, d):
    return search.page(table(spark, d, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"], 20, 20)


KINDS = ("signup", "purchase")


@query("""WITH u AS (SELECT DISTINCT user_id FROM events), k(event_type) AS (VALUES ('signup'), ('purchase')), n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, event_type, coalesce(n, 0) AS n, CASE event_type WHEN 'signup' THEN coalesce(n, 0) BETWEEN 1 AND 20 ELSE coalesce(n, 0) >= 5 END AS ok FROM u CROSS JOIN k LEFT JOIN n USING (user_id, event_type)""")
def trace_cardinality(spark, d):
    return trace.cardinality(table(spark, d, "events"), "user_id", "event_type", {"signup": (1, 20), "purchase": (5, None)})


@query("""WITH x AS (SELECT user_id * 100 + day(ts) AS slot, max(event_id) FILTER (event_type = 'signup') AS b, min(event_id) FILTER (event_type = 'purchase') AS a FROM events GROUP BY 1)
SELECT slot, 'signup' AS before, 'purchase' AS after, CASE WHEN a IS NULL THEN 'ok' WHEN b IS NULL THEN 'missing_before' WHEN b < a THEN 'ok' ELSE 'violated' END AS status FROM x""")
def trace_partial_order(spark, d):
    return trace.happens_before(table(spark, d, "events").withColumn("slot", F.col("user_id") * 100 + F.dayofmonth("ts")), "slot", "event_type", "event_id", [KINDS])


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS position FROM events")
def global_order(spark, d):
    return trace.ordered(table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("event_id", "user_id", "position")


_SEQ = "SELECT row_number() OVER (ORDER BY ts, event_id)::INT AS position, event_type FROM events WHERE user_id = {}"


@query(f"""WITH a AS ({_SEQ.format(1)}), b AS ({_SEQ.format(2)}) SELECT position, a.event_type AS left_value, b.event_type AS right_value FROM a FULL JOIN b USING (position)
WHERE a.event_type IS DISTINCT FROM b.event_type ORDER BY position LIMIT 1""")
def first_divergence(spark, d):
    seq = trace.ordered(table(spark, d, "events").where("user_id IN (1, 2)"), "user_id", ["ts", "event_id"])
    return trace.first_divergence(seq.where("user_id = 1"), seq.where("user_id = 2"), "position", "event_type")


@query("""WITH s AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events),
u AS (SELECT user_id, lead(user_id) OVER (ORDER BY user_id) AS next_id FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL)),
a AS (SELECT user_id, position, event_type AS left_value FROM s JOIN u USING (user_id) WHERE next_id IS NOT NULL), b AS (SELECT u.user_id, position, event_type AS right_value FROM s JOIN u ON s.user_id = next_id),
x AS (SELECT user_id, position, left_value, right_value, min(position) OVER (PARTITION BY user_id) AS first FROM a FULL JOIN b USING (user_id, position) WHERE left_value IS DISTINCT FROM right_value)
SELECT user_id, next_id, position, left_value, right_value FROM x JOIN u USING (user_id) WHERE position = first""")
def first_divergence_by_user(spark, d):
    """Every user's sequence against that of the next user; first_divergence is the row of user 1."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    seq = trace.numbered(e, "user_id", ["ts", "event_id"], F.to_date("ts"))
    pairs = trace.following(e, "user_id").withColumnRenamed("next", "next_id")
    left = seq.join(pairs.select("user_id"), "user_id", "left_semi")
    right = seq.withColumnRenamed("user_id", "next_id").join(pairs, "next_id")
    return trace.divergence_by_key(left, right, "user_id", "position", "event_type").join(pairs, "user_id").select("user_id", "next_id", "position", "left_value", "right_value")


_EVENTS = "e AS (SELECT user_id, event_id, ts, event_type, nullif((props->>'$.k')::BIGINT % 4, 3) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"


@query(f"""WITH RECURSIVE {_EVENTS}, r AS (SELECT DISTINCT user_id, 0::BIGINT AS n, 'new' AS state, 0 AS matched FROM events UNION ALL
SELECT r.user_id, e.n, CASE WHEN state = 'new' AND event_type = 'signup' THEN 'member' WHEN state = 'member' AND event_type = 'purchase' THEN 'buyer' WHEN state = 'buyer' AND event_type = 'signup' THEN 'member' ELSE state END,
matched + CASE WHEN (state IN ('new', 'buyer') AND event_type = 'signup') OR (state = 'member' AND event_type = 'purchase') THEN 1 ELSE 0 END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, arg_max(state, n) AS state, arg_max(matched, n)::INT AS matched FROM r GROUP BY 1""")
def fsm_replay(spark, d):
    """Per-user event fold over a small automaton."""
    moves = {("new", "signup"): "member", ("member", "purchase"): "buyer", ("buyer", "signup"): "member"}
    return trace.run_automaton(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], "event_type", "new", moves)


SESSIONS = {
    "start": "out", "visits": {"out": 1_000_000, "in": 8}, "max_transitions": 15,
    "moves": [
        {"id": "enter", "from": "out", "to": "in", "on": "signup", "priority": 1, "captures": {"c": "k"}, "max_uses": 5},
        {"id": "enter_late", "from": "out", "to": "in", "on": "signup", "priority": 2, "captures": {"c": "k"}},
        {"id": "buy", "from": "in", "to": "in", "on": "purchase", "guards": {"c": "k"}},
        {"id": "leave", "from": "in", "to": "out", "on": "click"},
    ],
}


@query(f"""WITH RECURSIVE {_EVENTS}, r AS (SELECT DISTINCT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::VARCHAR AS outcome, 'out' AS state, NULL::BIGINT AS c, 0 AS u, 0 AS visits, 0 AS moves, NULL::VARCHAR AS transition FROM events UNION ALL
SELECT user_id, n, event_id, outcome, CASE WHEN outcome = 'matched' THEN CASE event_type WHEN 'click' THEN 'out' ELSE 'in' END ELSE state END, CASE WHEN outcome = 'matched' AND event_type = 'signup' THEN k ELSE c END, u + CASE WHEN outcome = 'matched' AND event_type = 'signup' AND u < 5 THEN 1 ELSE 0 END,
visits + CASE WHEN outcome = 'matched' AND event_type <> 'click' THEN 1 ELSE 0 END, moves + CASE WHEN outcome = 'matched' THEN 1 ELSE 0 END, CASE WHEN outcome = 'matched' THEN CASE event_type WHEN 'signup' THEN CASE WHEN u < 5 THEN 'enter' ELSE 'enter_late' END WHEN 'purchase' THEN 'buy' ELSE 'leave' END END
FROM (SELECT r.user_id, e.n, e.event_id, e.event_type, e.k, state, c, u, visits, moves, CASE WHEN event_type NOT IN ('signup', 'purchase', 'click') THEN 'unmatched' WHEN (event_type = 'signup') <> (state = 'out') THEN 'invalid_state'
WHEN event_type = 'purchase' AND c IS DISTINCT FROM e.k THEN 'guard_failed' WHEN moves >= 15 THEN 'transition_exhausted' WHEN event_type <> 'click' AND visits >= 8 THEN 'limit_exhausted' WHEN event_type = 'signup' AND e.k IS NULL THEN 'invalid_capture' ELSE 'matched' END AS outcome
FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
SELECT user_id, event_id, outcome, transition, state FROM r WHERE n > 0""")
def replay_outcomes(spark, d):
    """Every event's outcome in a machine with a guard on a captured value, a fallback and limits."""
    told = trace.replay(_timed(spark, d), "user_id", "at", "event_type", ["k"], SESSIONS)
    return told.select("user_id", F.substring_index("at", "/", -1).cast("long").alias("event_id"), "outcome", "transition", "state")


def _timed(spark, d):
    """Events with an order text: the time, then the id; k is null in a quarter of them."""
    at = F.concat_ws("/", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lpad(F.col("event_id").cast("string"), 15, "0"))
    return table(spark, d, "events").select("user_id", at.alias("at"), "event_type", F.nullif(F.get_json_object("props", "$.k").cast("long") % 4, F.lit(3).cast("long")).alias("k"))


def _moves(spark, d):
    """Edges between regions and nations: nation k leads to nations k + 1 and 2k of the same table."""
    n = table(spark, d, "nation")
    return n.select(F.col("n_nationkey").alias("src"), F.explode(F.array((F.col("n_nationkey") + 1) % 25, (F.col("n_nationkey") * 2) % 25)).alias("dst"))


_EDGES = "e AS (SELECT DISTINCT src, dst FROM (SELECT n_nationkey AS src, (n_nationkey + 1) % 25 AS dst FROM nation UNION ALL SELECT n_nationkey, (n_nationkey * 2) % 25 FROM nation))"


@query(f"""WITH RECURSIVE {_EDGES}, p AS (SELECT [src::VARCHAR] AS p, src AS at, 0 AS depth FROM (SELECT 1 AS src) UNION ALL
SELECT list_append(p.p, e.dst::VARCHAR), e.dst, p.depth + 1 FROM p JOIN e ON p.at = e.src WHERE p.depth < 4 AND NOT list_contains(p.p, e.dst::VARCHAR))
SELECT array_to_string(p, ',') AS path, depth::INT AS depth FROM p WHERE depth > 0""")
def call_paths(spark, d):
    return graph.simple_paths(_moves(spark, d), spark.range(1, 2).select(F.col("id").cast("int").alias("src")), 4)


@query(f"""WITH RECURSIVE {_EDGES}, p AS (SELECT 1 AS node, 0 AS level UNION SELECT e.dst, p.level + 1 FROM p JOIN e ON p.node = e.src WHERE p.level < 6)
SELECT node::INT AS node, min(level)::INT AS level FROM p GROUP BY 1""")
def bfs_levels(spark, d):
    return graph.levels(_moves(spark, d), spark.range(1, 2).select(F.col("id").cast("int").alias("src")), 6)


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_path(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT page_id, regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '([^/]*/[^/]*)$', 1) AS suffix FROM pages")
def path_suffixes(spark, d):
    return table(spark, d, "pages").select("page_id", scalar.path_suffix(scalar.url_path(F.col("url")), 2).alias("suffix"))


@query("SELECT p_partkey, concat_ws(',', CASE WHEN p_size & 1 <> 0 THEN 'read' END, CASE WHEN p_size & 2 <> 0 THEN 'write' END, CASE WHEN p_size & 4 <> 0 THEN 'exec' END) AS flags FROM part")
def flags_decode(spark, d):
    return table(spark, d, "part").select("p_partkey", scalar.flags(F.col("p_size"), ["read", "write", "exec"]).alias("flags"))


@query("""SELECT r_regionkey, n_nationkey, omitted FROM (SELECT r_regionkey, n_nationkey, row_number() OVER (ORDER BY r_regionkey, n_nationkey) AS k, greatest(count(*) OVER () - 40, 0) AS omitted FROM region, nation) WHERE k <= 40""")
def bounded_cartesian(spark, d):
    """All pairs of two tables of fixed size (5 and 25 rows), 40 of them at most."""
    pairs = table(spark, d, "region").select("r_regionkey").crossJoin(F.broadcast(table(spark, d, "nation").select("n_nationkey")))
    found = search.page(pairs, ["r_regionkey", "n_nationkey"], 0, 40)
    return found.select("r_regionkey", "n_nationkey", F.greatest(F.col("total") - 40, F.lit(0).cast("long")).alias("omitted"))


@query("SELECT user_id, date_trunc('day', ts)::DATE::VARCHAR AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling(spark, d):
    return table(spark, d, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_cube(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
