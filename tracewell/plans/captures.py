"""Queries of captures, projections, handoffs and samples, on stand-ins of the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.functions import scalar, text
from tracewell.operators import graph, trace
from tracewell.plans.catalog import query
from tracewell.sources import table


@query("""WITH f AS (SELECT user_id, event_type, count(*) AS n, round(sum(value)) AS total, round(sum(value) / 100) AS hundreds, min(event_id) AS volatile FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY ALL), g AS (SELECT user_id, event_type, count(*) AS n, round(sum(value)) AS total, round(sum(value) / 100) AS hundreds, min(event_id) AS volatile FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY ALL)
SELECT user_id, event_type, f.n = g.n AND f.hundreds = g.hundreds AS same, f.n = g.n AND f.total = g.total AS exact FROM f JOIN g USING (user_id, event_type)""")
def comparable_payloads(spark, d):
    """Payloads of two captures without their volatile field: the same to the hundred, and exactly."""
    early = F.col("ts") < F.to_timestamp_ntz(F.lit("2024-01-16"))
    total = scalar.summed(F.col("value"))
    payload = F.struct(F.count("*").alias("n"), scalar.rounded(total).alias("total"), scalar.rounded(total, 2).alias("hundreds"), F.min("event_id").alias("volatile"))
    p = table(spark, d, "events").groupBy("user_id", "event_type", early.alias("early")).agg(payload.alias("p")).withColumn("p", F.col("p").dropFields("volatile"))
    a, b = (p.where(c).select("user_id", "event_type", F.col("p").alias(n)) for c, n in (("early", "a"), ("NOT early", "b")))
    same = lambda left_out: F.col("a").dropFields(left_out) == F.col("b").dropFields(left_out)
    return a.join(b, ["user_id", "event_type"]).select("user_id", "event_type", same("total").alias("same"), same("hundreds").alias("exact"))


@query("""SELECT event_id, 'event' AS source, user_id AS subject_id, epoch_us(ts) // 1000 AS at_ms, event_type AS payload FROM events WHERE event_type IN ('signup', 'error')
UNION ALL SELECT o_orderkey, 'order', o_custkey, epoch_us(o_orderdate) // 1000, o_orderstatus FROM orders WHERE o_orderpriority LIKE '1%'""")
def observations(spark, d):
    """Records of two journals in one form: source, subject, time and payload."""
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    e = table(spark, d, "events").where("event_type IN ('signup', 'error')").select("event_id", F.lit("event").alias("source"), F.col("user_id").alias("subject_id"), ms("ts").alias("at_ms"), F.col("event_type").alias("payload"))
    o = table(spark, d, "orders").where("o_orderpriority LIKE '1%'").select(F.col("o_orderkey").alias("event_id"), F.lit("order").alias("source"), F.col("o_custkey").alias("subject_id"), ms("o_orderdate").alias("at_ms"), F.col("o_orderstatus").alias("payload"))
    return e.unionByName(o)


@query("""WITH h AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_orderpriority, o_orderkey) AS severity, max(o_orderkey) AS revision FROM orders GROUP BY 1) SELECT o_custkey, status, severity, revision FROM h WHERE status = 'O' AND severity LIKE '1%'""")
def unknown_heads(spark, d):
    """The last revision of each record, of one status and severity."""
    h = table(spark, d, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority")).alias("h"))
    return h.where("h.o_orderstatus = 'O' AND h.o_orderpriority LIKE '1%'").select("o_custkey", F.col("h.o_orderstatus").alias("status"), F.col("h.o_orderpriority").alias("severity"), F.col("h.o_orderkey").alias("revision"))


@query("""WITH RECURSIVE k AS (SELECT p_partkey AS id, p_partkey // 3 AS needs, p_partkey % 13 <> 5 AS own FROM part), bad AS (SELECT id FROM k WHERE NOT own UNION SELECT k.id FROM bad JOIN k ON k.needs = bad.id AND k.id <> k.needs)
SELECT id AS p_partkey FROM k WHERE id NOT IN (SELECT id FROM bad)""")
def target_restriction(spark, d):
    """Records of one target whose dependencies are all of that target too, until nothing more falls out."""
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(k.alias("id"), F.floor(k / 3).alias("needs"), (k % 13 != 5).alias("own"))
    bad = graph.spread(p.where("NOT own"), p.where("needs <> id").select("id", "needs"))
    return p.join(bad, "id", "left_anti").select(F.col("id").alias("p_partkey"))


@query("""SELECT p_partkey, CASE WHEN lower(p_name) LIKE '%a%' AND contains(lower(p_name), 'blue') THEN 'name' WHEN contains(lower(p_type), 'steel') THEN 'type' WHEN contains(lower(p_brand), '1') THEN 'brand' END AS field FROM part
WHERE (lower(p_name) LIKE '%a%' AND contains(lower(p_name), 'blue')) OR contains(lower(p_type), 'steel') OR contains(lower(p_brand), '1')""")
def seed_matches(spark, d):
    """Parts that a seed finds, and the first of the allowed fields that holds it."""
    has = lambda c, x: F.contains(F.lower(c), F.lit(x))
    field = F.when(has("p_name", "a") & has("p_name", "blue"), "name").when(has("p_type", "steel"), "type").when(has("p_brand", "1"), "brand")
    return table(spark, d, "part").select("p_partkey", field.alias("field")).where("field IS NOT NULL")


@query("""SELECT event_id, '/props/k' AS path, props->>'$.k' AS value FROM events WHERE (props->>'$.k') IS NOT NULL UNION ALL SELECT event_id, '/type', event_type FROM events WHERE event_type IS NOT NULL UNION ALL SELECT event_id, '/tags/' || i, 't' || (event_id + i) % 4 FROM events, (VALUES (0), (1)) AS t(i)""")
def flattened_properties(spark, d):
    """Leaves of nested properties with their paths."""
    e = table(spark, d, "events")
    tags = F.transform(F.array(F.lit(0), F.lit(1)), lambda i: F.struct(F.concat(F.lit("/tags/"), i.cast("string")).alias("path"), F.concat(F.lit("t"), ((F.col("event_id") + i) % 4).cast("string")).alias("value")))
    own = F.array(F.struct(F.lit("/props/k").alias("path"), F.get_json_object("props", "$.k").alias("value")), F.struct(F.lit("/type").alias("path"), F.col("event_type").alias("value")))
    return e.select("event_id", F.explode(F.concat(own, tags)).alias("x")).select("event_id", "x.path", "x.value").where("value IS NOT NULL")


@query("""SELECT l_orderkey, l_linenumber, l_returnflag AS relation FROM lineitem WHERE l_returnflag IN ('A', 'R') AND (l_linestatus <> 'O' OR l_quantity > 40)""")
def allowed_relations(spark, d):
    """Edges of two relations; candidate edges only with strong evidence."""
    return table(spark, d, "lineitem").where(F.col("l_returnflag").isin("A", "R") & ((F.col("l_linestatus") != "O") | (F.col("l_quantity") > 40))).select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("relation"))


@query("""WITH c AS (SELECT l_orderkey, string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS calls, string_agg(DISTINCT l_shipmode, ',' ORDER BY l_shipmode) AS refs, count(*) AS size FROM (SELECT l_orderkey, l_partkey, l_returnflag || l_linestatus AS l_shipmode FROM lineitem) GROUP BY 1)
SELECT a.l_orderkey AS left_id, a.l_orderkey + 1 AS right_id, a.calls = b.calls AS same_calls, a.refs = b.refs AS same_refs, a.size = b.size AS same_size FROM c a JOIN c b ON b.l_orderkey = a.l_orderkey + 1""")
def explicit_pairs(spark, d):
    """Each order against the next by the facets of a function: calls, references, size."""
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("calls"), F.sort_array(F.collect_set(F.concat("l_returnflag", "l_linestatus"))).alias("refs"), F.count("*").alias("size"))
    b = g.select((F.col("l_orderkey") - 1).alias("l_orderkey"), *[F.col(c).alias(f"r_{c}") for c in ("calls", "refs", "size")])
    return g.join(b, "l_orderkey").select(F.col("l_orderkey").alias("left_id"), (F.col("l_orderkey") + 1).alias("right_id"), *[(F.col(c) == F.col(f"r_{c}")).alias(f"same_{c}") for c in ("calls", "refs", "size")])


@query("""SELECT c_custkey, c_mktsegment AS category, coalesce(n, 0) AS orders, CASE WHEN n IS NULL THEN 'unavailable' ELSE 'ok' END AS orders_state, CASE WHEN s_suppkey IS NULL THEN 'unavailable' ELSE 'ok' END AS supplier_state FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1) ON o_custkey = c_custkey LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1) ON s_nationkey = c_nationkey""")
def address_context(spark, d):
    """Facets of an address, each there or unavailable."""
    n = table(spark, d, "orders").where("o_totalprice > 100000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_suppkey").alias("s"))
    state = lambda c: F.when(F.col(c).isNull(), "unavailable").otherwise("ok")
    j = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment").join(n, "c_custkey", "left").join(s, "c_nationkey", "left")
    return j.select("c_custkey", F.col("c_mktsegment").alias("category"), F.coalesce("n", F.lit(0).cast("long")).alias("orders"), state("n").alias("orders_state"), state("s").alias("supplier_state"))


@query("""WITH n AS (SELECT s_suppkey, sha256(s_name) AS digest FROM supplier WHERE s_suppkey % 2 = 0), v AS (SELECT sha256(s_name) AS digest, min(s_nationkey) AS evidence FROM supplier WHERE s_suppkey % 3 = 0 GROUP BY 1), x AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS exports FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT s_suppkey, evidence, coalesce(exports, 0) AS exports, CASE WHEN evidence IS NULL THEN 'requires-provider-analysis' ELSE 'linked' END AS status FROM n LEFT JOIN v USING (digest) LEFT JOIN x ON l_suppkey = s_suppkey""")
def native_handoffs(spark, d):
    """Native nodes with the evidence of equal digest and their exports."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.sha2("s_name", 256).alias("digest"))
    v = s.where("s_suppkey % 3 = 0").groupBy("digest").agg(F.min("s_nationkey").alias("evidence"))
    x = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count_distinct("l_partkey").alias("exports"))
    j = s.where("s_suppkey % 2 = 0").join(v, "digest", "left").join(x, "s_suppkey", "left")
    return j.select("s_suppkey", "evidence", F.coalesce("exports", F.lit(0).cast("long")).alias("exports"), F.when(F.col("evidence").isNull(), "requires-provider-analysis").otherwise("linked").alias("status"))


@query("""WITH d AS (SELECT doc_id, sha256(text) AS digest FROM documents), x AS (SELECT a.doc_id AS entity, b.doc_id AS node FROM d a JOIN d b USING (digest) WHERE a.doc_id % 2 = 0 AND b.doc_id % 2 = 1), u AS (SELECT entity, count(*) AS n, min(node) AS node FROM x GROUP BY 1)
SELECT entity AS src, node AS dst, 'observed_as' AS relation FROM u WHERE n = 1""")
def reconciled_edges(spark, d):
    """Runtime entities that exactly one static node equals, as edges."""
    t = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    n = t.where("doc_id % 2 = 1").groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("dst")).where("n = 1")
    return t.where("doc_id % 2 = 0").join(n, "digest").select(F.col("doc_id").alias("src"), "dst", F.lit("observed_as").alias("relation"))


@query("""WITH r AS (SELECT o_custkey AS id, o_orderkey AS rank, o_orderpriority || '=>' || o_orderstatus AS rule FROM orders) SELECT id, count(*) AS rules, sha256(string_agg(rule, chr(10) ORDER BY rank)) AS commitment FROM r GROUP BY 1""")
def rule_commitments(spark, d):
    """A customer's orders are rules; their canonical order is committed to by a digest."""
    rule = F.concat("o_orderpriority", F.lit("=>"), "o_orderstatus")
    g = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("rules"), F.sort_array(F.collect_list(F.struct("o_orderkey", rule.alias("r")))).alias("s"))
    return g.select("id", "rules", F.sha2(F.array_join(F.transform("s", lambda x: x["r"]), "\n"), 256).alias("commitment"))


@query("""WITH f AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS first FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY first, l_partkey) AS pid FROM f)
SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey, r.pid, (floor(l.l_quantity / 10) * 10)::BIGINT AS bucket FROM lineitem l JOIN r USING (l_orderkey, l_partkey)""")
def renumbered_samples(spark, d):
    """Samples of an order with their process ids (parts) numbered by first appearance, and times (quantities) in buckets."""
    li = table(spark, d, "lineitem")
    first = li.groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("first"))
    r = first.select("l_orderkey", "l_partkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("first", "l_partkey")).cast("long").alias("pid"))
    return li.join(r, ["l_orderkey", "l_partkey"]).select("l_orderkey", "l_linenumber", "l_suppkey", "pid", (F.floor(F.col("l_quantity") / 10) * 10).cast("long").alias("bucket"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS use FROM events) SELECT event_id, CASE event_type WHEN 'click' THEN 'a' WHEN 'view' THEN 'b' WHEN 'error' THEN 'c' END AS route, CASE WHEN event_type NOT IN ('click', 'view', 'error') THEN 'unmatched' WHEN use > CASE event_type WHEN 'click' THEN 5 WHEN 'view' THEN 1 ELSE 3 END THEN 'exhausted' ELSE 'matched' END AS outcome FROM r""")
def shim_routes(spark, d):
    """Commands find a route by their type; each route serves a user a number of times."""
    use = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    t = F.col("event_type")
    limit = F.when(t == "click", 5).when(t == "view", 1).when(t == "error", 3)
    route = F.when(t == "click", "a").when(t == "view", "b").when(t == "error", "c")
    return table(spark, d, "events").withColumn("use", use).select("event_id", route.alias("route"), F.when(limit.isNull(), "unmatched").when(F.col("use") > limit, "exhausted").otherwise("matched").alias("outcome"))


@query("""WITH g AS (SELECT user_id, event_type, count(*) FILTER (user_id % 2 = 0 AND ts < TIMESTAMP '2024-01-11') AS x, count(*) FILTER (ts >= TIMESTAMP '2024-01-11' AND ts < TIMESTAMP '2024-01-21') AS b, count(*) FILTER (ts < TIMESTAMP '2024-01-11') AS a FROM events GROUP BY ALL)
SELECT event_type, count(*) AS subjects, count(*) FILTER (a = b) AS same, count(*) FILTER (a < b) AS more, count(*) FILTER (a > b) AS less FROM g GROUP BY 1""")
def paired_experiment(spark, d):
    """Ten days as the baseline and ten as the variant of each user, compared by kind."""
    t = F.col("ts")
    at = lambda x: F.to_timestamp_ntz(F.lit(x))
    g = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count_if(t < at("2024-01-11")).alias("a"), F.count_if((t >= at("2024-01-11")) & (t < at("2024-01-21"))).alias("b"))
    return g.groupBy("event_type").agg(F.count("*").alias("subjects"), F.count_if(F.col("a") == F.col("b")).alias("same"), F.count_if(F.col("a") < F.col("b")).alias("more"), F.count_if(F.col("a") > F.col("b")).alias("less"))


@query("""WITH a AS (SELECT user_id, min(ts) AS armed FROM events WHERE event_type = 'signup' GROUP BY 1) SELECT user_id, count(*) AS seen, count(*) FILTER (event_type = 'purchase') AS purchases FROM events JOIN a USING (user_id) WHERE ts >= armed AND ts < armed + INTERVAL 3 DAYS GROUP BY 1""")
def observation_windows(spark, d):
    """What three days from each user's first signup on show."""
    e = table(spark, d, "events")
    a = e.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("armed"))
    j = e.join(a, "user_id").where("ts >= armed AND ts < armed + INTERVAL 3 DAYS")
    return j.groupBy("user_id").agg(F.count("*").alias("seen"), F.count_if(F.col("event_type") == "purchase").alias("purchases"))


@query("""WITH s AS (SELECT event_id, user_id, max(event_id) OVER (PARTITION BY user_id ORDER BY event_id % 100, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM events) SELECT event_id, CASE WHEN seen IS NULL OR event_id > seen THEN 'admitted' ELSE 'rejected' END AS admission FROM s""")
def ordered_admission(spark, d):
    """Events arrive by the last two digits of their ids; one that is not beyond all before it is rejected."""
    w = Window.partitionBy("user_id").orderBy(F.col("event_id") % 100, "event_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.max("event_id").over(w)
    return table(spark, d, "events").select("event_id", F.when(seen.isNull() | (F.col("event_id") > seen), "admitted").otherwise("rejected").alias("admission"))


@query("""WITH s AS (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id, turn) AS copies, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before, role FROM conversations)
SELECT conv_id, turn, 'gap' AS issue FROM s WHERE turn > before + 1 UNION ALL SELECT conv_id, turn, 'late_start' FROM s WHERE before IS NULL AND turn > 0 UNION ALL SELECT DISTINCT conv_id, turn, 'duplicate' FROM s WHERE copies > 1 UNION ALL SELECT conv_id, turn, 'opens_with_' || role FROM s WHERE before IS NULL AND role <> 'user'""")
def capture_issues(spark, d):
    """Turns that break a rule of a capture: gaps, late starts, repeats, openings by another role."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    s = table(spark, d, "conversations").select("conv_id", "turn", "role", F.count("*").over(Window.partitionBy("conv_id", "turn")).alias("copies"), F.lag("turn").over(w).alias("before"))
    first = F.col("before").isNull()
    checks = F.array(F.when(F.col("turn") > F.col("before") + 1, "gap"), F.when(first & (F.col("turn") > 0), "late_start"), F.when(first & (F.col("role") != "user"), F.concat(F.lit("opens_with_"), "role")))
    own = s.select("conv_id", "turn", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("issue"))
    return own.unionByName(s.where("copies > 1").select("conv_id", "turn", F.lit("duplicate").alias("issue")).distinct())


@query("""WITH a AS (SELECT c_custkey AS id, 1 AS run, c_acctbal AS value FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 2, c_acctbal + c_custkey % 2 FROM customer WHERE c_custkey % 3 <> 1) SELECT id, max(run) AS run, arg_max(value, run) AS value, count(*) AS versions FROM a GROUP BY 1""")
def merged_investigations(spark, d):
    """Two runs of evidence by id; the later one's counts."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    a = c.where(k % 3 != 0).select(k.alias("id"), F.lit(1).alias("run"), F.col("c_acctbal").alias("value"))
    b = c.where(k % 3 != 1).select(k.alias("id"), F.lit(2).alias("run"), (F.col("c_acctbal") + k % 2).alias("value"))
    return a.unionByName(b).groupBy("id").agg(F.max("run").alias("run"), F.max_by("value", "run").alias("value"), F.count("*").alias("versions"))


@query("""WITH f AS (SELECT p_partkey, p_type AS family, split_part(p_brand, '#', 2) AS provenance, p_size FROM part) SELECT family, provenance, count(*) AS artifacts, sum(p_size)::BIGINT AS bytes, min(p_partkey) AS first FROM f GROUP BY ALL""")
def family_totals(spark, d):
    """Artifacts by family and provenance."""
    return table(spark, d, "part").groupBy(F.col("p_type").alias("family"), F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("provenance")).agg(F.count("*").alias("artifacts"), F.sum("p_size").cast("long").alias("bytes"), F.min("p_partkey").alias("first"))


@query("""WITH c AS (SELECT p_partkey AS id, unnest([p_partkey * 2, p_partkey * 2 + 1, p_partkey // 2]) AS target, unnest([1, 2, 3]) AS rank FROM part), r AS (SELECT id, min(rank) AS rank, arg_min(target, rank) AS target FROM c WHERE target IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY 1)
SELECT p_partkey AS id, target, coalesce(rank, 0) AS rank FROM part LEFT JOIN r ON r.id = p_partkey""")
def module_resolution(spark, d):
    """A specifier's candidates in order; the first that exists is it."""
    k = F.col("p_partkey")
    p = table(spark, d, "part")
    c = p.select(k.alias("id"), F.posexplode(F.array(k * 2, k * 2 + 1, F.floor(k / 2))).alias("rank", "target"))
    r = c.join(p.where("p_size > 25").select(k.alias("target")), "target", "left_semi").groupBy("id").agg(F.min(F.struct("rank", "target")).alias("x"))
    return p.select(k.alias("id")).join(r, "id", "left").select("id", "x.target", F.coalesce(F.col("x.rank") + 1, F.lit(0)).alias("rank"))


@query("""WITH e AS (SELECT * REPLACE (user_id * 100 + day(ts) AS user_id) FROM events), a AS (SELECT user_id, event_type, count(*) AS n, min(ts) AS first FROM e WHERE hour(ts) < 12 GROUP BY ALL), b AS (SELECT user_id, event_type, count(*) AS n, min(ts) AS first FROM e WHERE hour(ts) >= 12 GROUP BY ALL), j AS (SELECT user_id, event_type, a.n AS x, b.n AS y, a.first AS first FROM a FULL JOIN b USING (user_id, event_type))
SELECT user_id, CASE WHEN count(*) FILTER (x IS DISTINCT FROM y) > 0 THEN 'changed' ELSE 'unchanged' END AS status, arg_min(event_type, (coalesce(first, TIMESTAMP '2099-01-01'), event_type)) FILTER (x IS DISTINCT FROM y) AS first_dimension, count(*) FILTER (x IS DISTINCT FROM y) AS dimensions FROM j GROUP BY 1""")
def capture_comparison(spark, d):
    """A morning and an afternoon of a user's day by dimension (event type), and the dimension in which they first differ."""
    e = table(spark, d, "events").withColumns({"user_id": F.col("user_id") * 100 + F.dayofmonth("ts"), "early": F.hour("ts") < 12})
    g = e.groupBy("user_id", "event_type").agg(F.count_if("early").alias("x"), F.count_if(~F.col("early")).alias("y"), F.min(F.when(F.col("early"), F.col("ts"))).alias("first"))
    odd = F.col("x") != F.col("y")
    at = F.struct(F.coalesce("first", F.to_timestamp_ntz(F.lit("2099-01-01"))), "event_type")
    r = g.groupBy("user_id").agg(F.min_by("event_type", F.when(odd, at)).alias("d"), F.count_if(odd).alias("n"))
    return r.select("user_id", F.when(F.col("n") > 0, "changed").otherwise("unchanged").alias("status"), F.when(F.col("n") > 0, F.col("d")).alias("first_dimension"), F.col("n").alias("dimensions"))


@query("""WITH o AS (SELECT l_orderkey AS id, 'p' || l_partkey AS claim, l_returnflag AS state FROM lineitem) SELECT id, count(DISTINCT claim) AS claims, count(*) > count(DISTINCT claim) AS repeated, sha256(string_agg(claim || '=' || state, ',' ORDER BY claim, state)) AS digest FROM o GROUP BY 1""")
def completion_ledger(spark, d):
    """An order's parts are claims in canonical order; a claim made twice breaks the ledger."""
    o = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("claim"), "l_returnflag")
    g = o.groupBy("id").agg(F.count_distinct("claim").alias("claims"), F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("claim", "l_returnflag"))).alias("s"))
    line = F.array_join(F.transform("s", lambda x: F.concat(x["claim"], F.lit("="), x["l_returnflag"])), ",")
    return g.select("id", "claims", (F.col("n") > F.col("claims")).alias("repeated"), F.sha2(line, 256).alias("digest"))




@query("""WITH s AS (SELECT user_id, min(event_id) AS t FROM events WHERE event_type = 'signup' GROUP BY 1),
c AS (SELECT user_id, min(event_id) AS t FROM events e JOIN s USING (user_id) WHERE event_type = 'click' AND event_id > s.t GROUP BY 1), v AS (SELECT user_id, min(event_id) AS t FROM events e JOIN s USING (user_id) WHERE event_type = 'view' AND event_id > s.t GROUP BY 1),
r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events e JOIN s USING (user_id) WHERE event_type = 'error' AND event_id > s.t),
m AS (SELECT u.user_id, least(CASE WHEN c.t IS NOT NULL AND v.t IS NOT NULL THEN greatest(c.t, v.t) END, r.event_id) AS t FROM s u LEFT JOIN c USING (user_id) LEFT JOIN v USING (user_id) LEFT JOIN (SELECT user_id, event_id FROM r WHERE i = 2 AND n <= 12) r USING (user_id)),
p AS (SELECT user_id, min(event_id) AS t FROM events e JOIN m USING (user_id) WHERE event_type = 'purchase' AND event_id > m.t GROUP BY 1), u AS (SELECT DISTINCT user_id FROM events)
SELECT user_id, p.t AS at, CASE WHEN p.t IS NULL THEN 'unmatched' WHEN p.t - s.t > 500 THEN 'deadline' ELSE 'matched' END AS outcome FROM u LEFT JOIN p USING (user_id) LEFT JOIN s USING (user_id)""")
def trigger_tree(spark, d):
    """A signup, then either a click and a view or two to twelve errors, then a purchase, within 500 events of the signup."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    tree = ("sequence", ("event", "signup"), ("any", ("all", ("event", "click"), ("event", "view")), ("repeat", "error", 2, 12)), ("event", "purchase"))
    found = trace.triggered(e, "user_id", "event_id", "event_type", tree, e.select("user_id").distinct().withColumn("since", F.lit(-1).cast("long")))
    start = e.where("event_type = 'signup'").groupBy("user_id").agg(F.min("event_id").alias("start"))
    outcome = F.when(F.col("at").isNull(), "unmatched").when(F.col("at") - F.col("start") > 500, "deadline").otherwise("matched")
    return found.join(start, "user_id", "left").select("user_id", "at", outcome.alias("outcome"))


@query("""SELECT doc_id, CASE WHEN text IS NOT NULL THEN CASE doc_id % 3 WHEN 0 THEN '0,0' WHEN 1 THEN '2,0' ELSE '3,1' END END AS changes FROM documents""")
def line_changes(spark, d):
    """Every text against itself: unchanged, with two lines more, or with its first line replaced too."""
    t = F.col("text")
    rest = F.substring(t, F.length(F.substring_index("text", "\n", 1)) + 1, F.length(t))
    more = F.lit("\n\x02\n\x03")
    form = F.col("doc_id") % 3
    other = F.when(form == 0, t).when(form == 1, F.concat(t, more)).otherwise(F.concat(F.lit("\x01 "), F.col("doc_id").cast("string"), rest, more))
    return table(spark, d, "documents").select("doc_id", text.line_changes(t, other).alias("changes"))
