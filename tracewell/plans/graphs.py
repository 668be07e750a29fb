"""Graph queries on tables that grow: parts, orders and events as nodes and edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import graph
from tracewell.plans.catalog import query
from tracewell.sources import table

_PARTS = """e AS (SELECT DISTINCT src, dst FROM (SELECT p_partkey AS src, unnest([2 * p_partkey, 3 * p_partkey]) AS dst FROM part) WHERE dst IN (SELECT p_partkey FROM part)),
k AS (SELECT p_partkey AS node FROM part WHERE p_partkey % 11 <> 0)"""


def _calls(spark, d):
    """Part k calls parts 2k and 3k; the calls of every 11th part are not known to be all."""
    p = table(spark, d, "part").select("p_partkey")
    edges = p.select(F.col("p_partkey").alias("src"), F.explode(F.array(F.col("p_partkey") * 2, F.col("p_partkey") * 3)).alias("dst"))
    return edges.join(p.select(F.col("p_partkey").alias("dst")), "dst", "left_semi").select("src", "dst"), p.where("p_partkey % 11 <> 0").select(F.col("p_partkey").alias("node"))


@query(f"""WITH RECURSIVE {_PARTS}, q AS (SELECT p_partkey AS start, CASE WHEN p_partkey % 2 = 1 THEN 12 * p_partkey ELSE 5 * p_partkey END AS goal FROM part),
r AS (SELECT start, goal, start AS cur, [start] AS path FROM q UNION ALL SELECT r.start, r.goal, e.dst, list_append(r.path, e.dst) FROM r JOIN e ON r.cur = e.src WHERE len(r.path) <= 4 AND r.cur <> r.goal AND NOT list_contains(r.path, e.dst)),
f AS (SELECT start, goal, path, row_number() OVER (PARTITION BY start, goal ORDER BY len(path), path) AS rank FROM r WHERE cur = goal), t AS (SELECT start, goal, count(*) AS n, arg_min(path, rank) AS p FROM f GROUP BY ALL),
o AS (SELECT DISTINCT start, goal FROM r WHERE cur <> goal AND len(path) <= 4 AND cur NOT IN (SELECT node FROM k))
SELECT q.start, q.goal, CASE WHEN n > 2 THEN 'truncated' WHEN n > 0 THEN 'found' WHEN o.start IS NULL THEN 'not_found' ELSE 'unknown' END AS status, least(coalesce(n, 0), 2) AS paths, len(p) - 1 AS hops, array_to_string(p, ',') AS first
FROM q LEFT JOIN t USING (start, goal) LEFT JOIN o ON o.start = q.start AND o.goal = q.goal""")
def call_routes(spark, d):
    """From every part to its twelvefold (odd keys: three ways, two count) or fivefold (no way), in at most four calls."""
    edges, complete = _calls(spark, d)
    k = F.col("p_partkey")
    pairs = table(spark, d, "part").select(k.alias("start"), F.when(k % 2 == 1, k * 12).otherwise(k * 5).alias("goal"))
    return graph.routes(edges, pairs, 4, 2, complete)


@query(f"""WITH RECURSIVE {_PARTS}, p AS (SELECT 1::BIGINT AS node, 0 AS level UNION SELECT e.dst, p.level + 1 FROM p JOIN e ON p.node = e.src WHERE p.level < 9), s AS (SELECT node, min(level) AS level FROM p GROUP BY 1),
m AS (SELECT DISTINCT s.node FROM s JOIN e ON e.src = s.node WHERE s.level = 9 AND e.dst NOT IN (SELECT node FROM s))
SELECT s.node, s.level, CASE WHEN s.node NOT IN (SELECT node FROM k) THEN 'incomplete' WHEN m.node IS NOT NULL THEN 'depth' END AS frontier FROM s LEFT JOIN m USING (node)""")
def reach_frontier(spark, d):
    """What part 1 reaches in nine calls, and where the search had to stop."""
    edges, complete = _calls(spark, d)
    return graph.reach(edges, spark.range(1, 2).select(F.col("id").alias("src")), 9, complete)


@query(f"""WITH RECURSIVE {_PARTS}, p AS (SELECT 1::BIGINT AS node, 0 AS level UNION SELECT e.dst, p.level + 1 FROM p JOIN e ON p.node = e.src WHERE p.level < 9), s AS (SELECT node, min(level) AS level FROM p GROUP BY 1)
SELECT s.node, s.level, (SELECT min(e.src) FROM e JOIN s u ON u.node = e.src WHERE e.dst = s.node AND u.level = s.level - 1) AS previous FROM s""")
def feature_tree(spark, d):
    """The tree of that search."""
    edges, _ = _calls(spark, d)
    return graph.predecessors(edges, spark.range(1, 2).select(F.col("id").alias("src")), 9)


_CYCLE = "e AS (SELECT p_partkey AS src, CASE WHEN p_partkey % 6 = 5 THEN p_partkey - 5 ELSE p_partkey + 1 END AS dst FROM part)"


@query(f"WITH RECURSIVE {_CYCLE}, p AS (SELECT src, dst, 1 AS depth FROM e UNION SELECT p.src, e.dst, p.depth + 1 FROM p JOIN e ON p.dst = e.src WHERE p.depth < 8) SELECT src AS node, min(depth) FILTER (src = dst) AS cycle, count(DISTINCT dst) AS reachable FROM p GROUP BY 1")
def part_cycles(spark, d):
    """Six parts in a row lead round in a circle."""
    k = F.col("p_partkey")
    e = table(spark, d, "part").select(k.alias("src"), F.when(k % 6 == 5, k - 5).otherwise(k + 1).alias("dst"))
    return graph.closure(e, 8).groupBy(F.col("src").alias("node")).agg(F.min(F.when(F.col("src") == F.col("dst"), F.col("depth"))).alias("cycle"), F.count("*").alias("reachable"))


_TREE = """x AS (SELECT event_id AS tm, user_id * 100000 + event_id // 3 AS pid, (user_id * 100000 + event_id // 12) AS ppid, CASE event_type WHEN 'signup' THEN 'spawn' WHEN 'error' THEN 'spawn' WHEN 'view' THEN 'reparent' WHEN 'click' THEN 're_exec' ELSE 'exit' END AS type, event_id % 5 AS code FROM events),
f AS (SELECT pid, min(tm) AS start FROM x WHERE type = 'spawn' GROUP BY 1), l AS (SELECT x.*, f.start, coalesce(x.tm >= f.start, false) AS late FROM x LEFT JOIN f USING (pid)),
c AS (SELECT ppid AS pid, count(*) AS children FROM x WHERE type = 'spawn' GROUP BY 1),
g AS (SELECT pid, max(start) AS spawned, arg_min(ppid, tm) FILTER (type = 'spawn') AS p0, max(tm) FILTER (type = 'exit' AND late) AS exited, arg_max(code, tm) FILTER (type = 'exit' AND late) AS code, coalesce(bool_or(type = 're_exec' AND late), false) AS re_exec,
arg_max(ppid, tm) FILTER (type = 'reparent' AND late) AS p1, count(*) FILTER (type = 'reparent' AND late) > 0 AS reparented, count(*) FILTER (type = 'exit' AND late AND tm - start < 2) AS short_lived, count(*) FILTER (type <> 'spawn' AND NOT late) AS unmatched FROM l GROUP BY 1)"""


@query(f"WITH {_TREE} SELECT pid, CASE WHEN reparented THEN p1 ELSE p0 END AS ppid, spawned, exited, code, re_exec, reparented, CASE WHEN spawned IS NOT NULL THEN coalesce(children, 0) END AS children, short_lived, unmatched FROM g LEFT JOIN c USING (pid)")
def process_tree(spark, d):
    """Three events in a row of a user are one process, of the event types' meaning; ids are times."""
    t = F.col("event_type")
    pid = lambda n: F.col("user_id") * 100000 + F.floor(F.col("event_id") / n)
    kind = F.when(t.isin("signup", "error"), "spawn").when(t == "view", "reparent").when(t == "click", "re_exec").otherwise("exit")
    x = table(spark, d, "events").select(F.col("event_id").alias("at"), kind.alias("type"), pid(3).alias("pid"), pid(12).alias("ppid"), (F.col("event_id") % 5).alias("code"))
    return graph.process_tree(x, short_ms=2)


@query("""WITH l AS (SELECT l_orderkey, sha256(string_agg(h, ',' ORDER BY h)) AS digest FROM (SELECT l_orderkey, sha256(l_linenumber || '/' || l_partkey) AS h FROM lineitem) GROUP BY 1),
o AS (SELECT o_custkey, sha256(string_agg(h, ',' ORDER BY h)) AS digest FROM (SELECT o_custkey, sha256(o_orderkey || '/' || coalesce(l.digest, '')) AS h FROM orders LEFT JOIN l ON l_orderkey = o_orderkey) GROUP BY 1),
c AS (SELECT c_nationkey, sha256(string_agg(h, ',' ORDER BY h)) AS digest FROM (SELECT c_nationkey, sha256(c_custkey || '/' || coalesce(o.digest, '')) AS h FROM customer LEFT JOIN o ON o_custkey = c_custkey) GROUP BY 1)
SELECT n_nationkey, c.digest FROM nation LEFT JOIN c ON c_nationkey = n_nationkey""")
def tree_digest_bottom_up(spark, d):
    """Lines are the files, orders, customers and nations the folders; each level follows from the digests of the one below."""
    return scalar_tree(spark, d)


def scalar_tree(spark, d):
    def level(rows, parent: str, name: str):
        h = rows.select(parent, F.sha2(F.concat(F.col(name).cast("string"), F.lit("/"), F.coalesce("digest", F.lit(""))), 256).alias("h"))
        return h.groupBy(parent).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ","), 256).alias("digest"))

    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("digest"))
    lines = level(li, "l_orderkey", "l_linenumber").withColumnRenamed("l_orderkey", "o_orderkey")
    orders = level(table(spark, d, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey", "left"), "o_custkey", "o_orderkey").withColumnRenamed("o_custkey", "c_custkey")
    nations = level(table(spark, d, "customer").select("c_custkey", "c_nationkey").join(orders, "c_custkey", "left"), "c_nationkey", "c_custkey").withColumnRenamed("c_nationkey", "n_nationkey")
    return table(spark, d, "nation").select("n_nationkey").join(nations, "n_nationkey", "left")


@query("""WITH a AS (SELECT l_partkey AS l, l_suppkey AS r FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL), b AS (SELECT l_partkey AS l, l_suppkey AS r FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL),
u AS (SELECT l, r, 'supplied_by' AS relation FROM a UNION SELECT l, r, 'supplied_by' FROM b)
SELECT l AS src, r AS dst, relation FROM u UNION ALL SELECT x.l, x.l, 'changed_from' FROM (SELECT l, count(*) AS n FROM a GROUP BY 1) x JOIN (SELECT l, count(*) AS n FROM b GROUP BY 1) y USING (l) WHERE x.n <> y.n""")
def change_graph(spark, d):
    """Two versions of the part-supplier graph, joined, with an edge for each part that has another number of suppliers."""
    li = table(spark, d, "lineitem")
    side = lambda flag: li.where(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    a, b = side("A"), side("R")
    n = lambda df, name: df.groupBy("src").agg(F.count("*").alias(name))
    moved = n(a, "x").join(n(b, "y"), "src").where("x <> y").select("src", F.col("src").alias("dst"), F.lit("changed_from").alias("relation"))
    return a.union(b).distinct().withColumn("relation", F.lit("supplied_by")).unionByName(moved)


@query("""WITH l AS (SELECT l_suppkey AS src, p_type, p_brand, p_size < 3 AND l_quantity > 45 AS small FROM lineitem JOIN part ON p_partkey = l_partkey),
e AS (SELECT DISTINCT 'whole' AS graph, src, p_type || '/' || p_brand AS dst FROM l UNION ALL SELECT DISTINCT 'small', src, p_brand FROM l WHERE small), n AS (SELECT s_suppkey, s_name, graph FROM supplier, (VALUES ('whole'), ('small')) v(graph))
SELECT n.graph, s_suppkey AS node, 'n_' || sha256('supplier/' || s_suppkey || '/' || s_name) AS node_id, count(dst) AS degree, sha256(coalesce(string_agg(dst, ',' ORDER BY dst), '')) AS edges_digest, count(dst) = 0 AS dangling FROM n LEFT JOIN e ON src = s_suppkey AND e.graph = n.graph GROUP BY n.graph, s_suppkey, s_name""")
def graph_identity(spark, d):
    """Ids of nodes from their content, digests of their sorted edges, and nodes without any: in the graph of all lines, and in that of large orders of small parts."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand", "p_size")
    small = F.bool_or((F.col("p_size") < 3) & (F.col("l_quantity") > 45)).alias("small")
    e = table(spark, d, "lineitem").join(part, "l_partkey").groupBy(F.col("l_suppkey").alias("s_suppkey"), "p_type", "p_brand").agg(small)
    edges = lambda dst: F.sort_array(F.collect_set(dst))
    g = table(spark, d, "supplier").select("s_suppkey", "s_name").join(e, "s_suppkey", "left").groupBy("s_suppkey", "s_name").agg(edges(F.concat("p_type", F.lit("/"), "p_brand")).alias("whole"), edges(F.when(F.col("small"), F.col("p_brand"))).alias("small"))
    g = g.select("s_suppkey", "s_name", F.inline(F.array(*[F.struct(F.lit(n).alias("graph"), F.col(n).alias("t")) for n in ("whole", "small")])))
    node_id = F.concat(F.lit("n_"), F.sha2(F.concat_ws("/", F.lit("supplier"), F.col("s_suppkey").cast("string"), "s_name"), 256))
    return g.select("graph", F.col("s_suppkey").alias("node"), node_id.alias("node_id"), F.size("t").cast("long").alias("degree"), F.sha2(F.array_join("t", ","), 256).alias("edges_digest"), (F.size("t") == 0).alias("dangling"))


