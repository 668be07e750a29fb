"""Queries of bounded searches and comparisons: candidate budgets, traversals with their status, member items and coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import coverage, graph, match
from tracewell.operators.stages import cut
from tracewell.plans.catalog import query
from tracewell.sources import table

#: Candidates that the sources of a comparison may look at, all together.
EVALUATIONS = 500

_PARTS = """r AS (SELECT p_partkey AS id, p_brand || '/' || p_size || '/' || p_type || '.js' AS path, CASE WHEN p_size % 3 = 0 THEN 'src/' || p_type || '.ts' WHEN p_size % 3 = 1 THEN p_size || '/' || p_type || '.js' END AS original, CASE WHEN p_size % 5 > 0 THEN sha256(p_name) END AS digest FROM part),
s AS (SELECT id, path, digest, min(id) OVER (PARTITION BY path) AS class_id FROM r WHERE id % 2 = 0), n AS (SELECT *, min(id) OVER (PARTITION BY path, original) AS class_id FROM r WHERE id % 2 = 1)"""


def _places(spark, d):
    """Even parts are the sources, odd ones the nodes; brand, size and type make the path, the name is the content."""
    size = F.col("p_size")
    path = lambda *x: F.concat_ws("/", *x, F.concat("p_type", F.lit(".js")))
    original = F.when(size % 3 == 0, F.concat(F.lit("src/"), "p_type", F.lit(".ts"))).when(size % 3 == 1, path(size.cast("string")))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), path("p_brand", size.cast("string")).alias("path"), original.alias("original"), F.when(size % 5 > 0, F.sha2("p_name", 256)).alias("digest"))
    return match.place_classes(p.where("id % 2 = 0").drop("original"), "id", ["path"]), match.place_classes(p.where("id % 2 = 1"), "id", ["path", "original"])


_BUDGET = f"""{_PARTS}, nb AS (SELECT class_id AS node, regexp_extract(path, '[^/]*$') AS base FROM n WHERE path IS NOT NULL UNION SELECT class_id, regexp_extract(original, '[^/]*$') FROM n WHERE original IS NOT NULL),
h AS (SELECT DISTINCT s.class_id AS source, node, NULL AS digest FROM s JOIN nb ON regexp_extract(s.path, '[^/]*$') = nb.base UNION ALL SELECT DISTINCT s.class_id, n.class_id, digest FROM s JOIN n USING (digest)),
g AS (SELECT *, row_number() OVER (ORDER BY source, node, digest NULLS LAST) AS place FROM h)"""


@query(f"WITH {_BUDGET} SELECT c.source, count(g.source) AS hits, count(*) FILTER (place <= {EVALUATIONS}) AS evaluated, count(*) FILTER (place > {EVALUATIONS}) AS omitted FROM (SELECT DISTINCT class_id AS source FROM s) c LEFT JOIN g USING (source) GROUP BY 1")
def source_match_budget(spark, d):
    """How far a budget for all sources together reaches."""
    return match.evaluations(*_places(spark, d), EVALUATIONS)


@query(f"""WITH {_BUDGET}, a AS (SELECT DISTINCT class_id AS source, path AS own FROM s), m AS (SELECT DISTINCT class_id AS node, path, original FROM n),
x AS (SELECT regexp_extract(own, '[^/]*$') AS own_base, regexp_extract(path, '[^/]*$') AS base, regexp_extract(original, '[^/]*$') AS original_base, * FROM g JOIN a USING (source) JOIN m USING (node) WHERE place <= {EVALUATIONS}),
e AS (SELECT *, lower(regexp_extract(own_base, '^.+(\\.[^.]*)$', 1)) AS own_ext, lower(regexp_extract(base, '^.+(\\.[^.]*)$', 1)) AS ext, lower(regexp_extract(original_base, '^.+(\\.[^.]*)$', 1)) AS original_ext FROM x),
p AS (SELECT source, node, digest, CASE WHEN digest IS NOT NULL THEN 100 ELSE 0 END + CASE WHEN original = own OR ends_with(original, '/' || own) THEN 70 ELSE 0 END + CASE WHEN path = own THEN 60 ELSE 0 END + CASE WHEN ends_with(path, '/' || own) THEN 40 ELSE 0 END
+ CASE WHEN base = own_base OR original_base = own_base THEN 20 ELSE 0 END + CASE WHEN own_ext <> '' AND (ext = own_ext OR original_ext = own_ext) THEN 5 ELSE 0 END AS score FROM e)
SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, node, digest NULLS LAST) AS rank FROM p WHERE score >= 20""")
def source_pairs_within_budget(spark, d):
    """The scored pairs that this budget reaches; source_to_bundle_pairs is the form without one."""
    s, n = _places(spark, d)
    return match.signal_pairs(s, n, budget=match.evaluations(s, n, EVALUATIONS))


#: Questions to the part and supplier graph: name, direction, relations, seeds (SQL), bounds on nodes, edges and depth, a node that should be reached.
QUESTIONS = [
    ("calls of part 70", "forward-effects", ["calls"], "id = 70", (2000, 4000, 40), None),
    ("suppliers of part 1", "forward-effects", ["supplied_by"], "id = 1", (50, 2, 3), None),
    ("callers of part 30", "callers", None, "id = 30", (2000, 4000, 40), "p6"),
    ("callers of parts 50 and 75", "callers", None, "id IN (50, 75)", (2000, 4000, 40), None),
    ("owners of no part", "ownership", None, "id < 0", (10, 10, 3), None),
    ("a way nobody knows", "sideways", None, "id = 1", (10, 10, 3), None),
]


def traversal_edges(spark, d) -> DataFrame:
    """id, src, dst, relation: part k calls parts 2k and 3k; a part is supplied by the suppliers of its lines."""
    p = table(spark, d, "part").select("p_partkey")
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    calls = p.select("p_partkey", F.explode(F.array(F.col("p_partkey") * 2, F.col("p_partkey") * 3)).alias("to")).join(p.select(F.col("p_partkey").alias("to")), "to", "left_semi")
    calls = cut(calls.select(node("p", "p_partkey").alias("src"), node("p", "to").alias("dst"), F.lit("calls").alias("relation")))  # each front reads them
    lines = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    every = calls.unionByName(lines.select(node("p", "l_partkey").alias("src"), node("s", "l_suppkey").alias("dst"), F.lit("supplied_by").alias("relation")))
    return every.select(F.concat_ws(">", "src", "dst").alias("id"), "src", "dst", "relation")


@query()
def traversal_answers(spark, d):
    """The nodes that each question reaches, why the search stopped there, and the status of the answer; a question without nodes has one row."""
    edges = traversal_edges(spark, d)
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    out = []
    for name, direction, allowed, where, bounds, sink in QUESTIONS:
        seeds = parts.where(where).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("node"))
        expected = None if sink is None else spark.range(1).select(F.lit(sink).alias("node"))
        nodes, status = graph.answered(edges, seeds, direction, allowed, *bounds, expected=expected)
        one = spark.range(1).select(F.lit(name).alias("question"), F.lit(status).alias("status"))
        out.append(one.join(nodes.withColumn("question", F.lit(name)), "question", "left").select("question", "status", "node", "depth", "reasons"))
    return reduce(DataFrame.unionByName, out)


#: Members on a page of one brand and scope, and items that a comparison keeps of a brand.
PAGE, ITEMS = 27, 60

_MEMBERS = f"""m AS (SELECT p_partkey AS id, p_brand AS module, CASE WHEN p_size > 15 THEN 'method' ELSE 'field' END AS scope, p_type || '/' || p_size AS exact, CASE WHEN p_size > 15 THEN p_type || '/' || p_size // 5 END AS shape, split_part(p_name, ' ', 2) AS content, p_partkey % 2 AS version FROM part),
q AS (SELECT *, row_number() OVER (PARTITION BY module, scope, version ORDER BY id) AS place FROM m), l AS (SELECT * FROM q WHERE version = 0 AND place <= {PAGE}), r AS (SELECT * FROM q WHERE version = 1 AND place <= {PAGE}),
z AS (SELECT module, scope, bool_and(place <= {PAGE}) FILTER (version = 0) AS left_complete, bool_and(place <= {PAGE}) FILTER (version = 1) AS right_complete, count(*) FILTER (place > {PAGE}) AS omitted FROM q GROUP BY 1, 2),
e1 AS (SELECT a.module, a.scope, a.exact, a.n AS x, b.n AS y, a.id AS i, b.id AS j FROM (SELECT module, scope, exact, count(*) AS n, min(id) AS id FROM l WHERE exact IS NOT NULL GROUP BY 1, 2, 3) a JOIN (SELECT module, scope, exact, count(*) AS n, min(id) AS id FROM r WHERE exact IS NOT NULL GROUP BY 1, 2, 3) b USING (module, scope, exact)),
l2 AS (SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM e1 WHERE e1.module = l.module AND e1.scope = l.scope AND e1.exact = l.exact)), r2 AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM e1 WHERE e1.module = r.module AND e1.scope = r.scope AND e1.exact = r.exact)),
e2 AS (SELECT a.module, a.scope, a.shape, a.n AS x, b.n AS y, a.id AS i, b.id AS j FROM (SELECT module, scope, shape, count(*) AS n, min(id) AS id FROM l2 WHERE shape IS NOT NULL GROUP BY 1, 2, 3) a JOIN (SELECT module, scope, shape, count(*) AS n, min(id) AS id FROM r2 WHERE shape IS NOT NULL GROUP BY 1, 2, 3) b USING (module, scope, shape)),
s AS (SELECT 'left' AS side, l.id, l.module, l.scope, 'exact' AS basis, x * y = 1 AS one, CASE WHEN x * y = 1 THEN j END AS partner FROM l JOIN e1 USING (module, scope, exact) UNION ALL SELECT 'right', r.id, r.module, r.scope, 'exact', x * y = 1, i FROM r JOIN e1 USING (module, scope, exact)
UNION ALL SELECT 'left', l2.id, l2.module, l2.scope, 'shape', x * y = 1, CASE WHEN x * y = 1 THEN j END FROM l2 JOIN e2 USING (module, scope, shape) UNION ALL SELECT 'right', r2.id, r2.module, r2.scope, 'shape', x * y = 1, i FROM r2 JOIN e2 USING (module, scope, shape)),
u AS (SELECT * FROM s UNION ALL SELECT 'left', id, module, scope, 'none', NULL, NULL FROM l WHERE id NOT IN (SELECT id FROM s WHERE side = 'left') UNION ALL SELECT 'right', id, module, scope, 'none', NULL, NULL FROM r WHERE id NOT IN (SELECT id FROM s WHERE side = 'right')),
i AS (SELECT u.module, u.scope, CASE WHEN side = 'left' THEN u.id END AS left_id, CASE WHEN side = 'left' THEN partner ELSE u.id END AS right_id, basis, CASE WHEN one THEN 'matched' WHEN basis = 'none' THEN 'unmatched' ELSE 'ambiguous' END AS matching,
CASE WHEN one THEN CASE WHEN ml.content IS DISTINCT FROM mr.content THEN 'changed' ELSE 'unchanged' END WHEN basis <> 'none' THEN 'unknown' WHEN side = 'left' AND right_complete THEN 'removed' WHEN side = 'right' AND left_complete THEN 'added' ELSE 'unknown' END AS status
FROM u JOIN z USING (module, scope) LEFT JOIN m ml ON ml.id = u.id LEFT JOIN m mr ON mr.id = partner WHERE side = 'left' OR one IS DISTINCT FROM true)"""


def _members(spark, d):
    """Pages of even (left) and odd (right) parts of each brand and scope, and what they leave out."""
    group, k, size = ["module", "scope"], F.col("p_partkey"), F.col("p_size")
    shape = F.concat_ws("/", "p_type", F.floor(size / 5).cast("string"))
    m = table(spark, d, "part").select(
        k.alias("id"), F.col("p_brand").alias("module"), F.when(size > 15, "method").otherwise("field").alias("scope"), F.concat_ws("/", "p_type", size.cast("string")).alias("exact"),
        F.when(size > 15, shape).alias("shape"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("content"), (k % 2).alias("version"),
    )
    sides = []
    for version, name in ((0, "left"), (1, "right")):
        every = m.where(F.col("version") == version)
        page = coverage.paged(every, group, ["id"], F.lit(PAGE)).drop("total", "position")
        left_out = coverage.omissions(every, page, group).select(*group, F.col("complete").alias(f"{name}_complete"), F.col("omitted").alias(f"{name}_omitted"))
        sides.append((page, left_out))
    (left, a), (right, b) = sides
    return left, right, a.join(b, group, "full")


def _items(spark, d):
    left, right, sides = _members(spark, d)
    return coverage.items(left, right, "id", ["module", "scope"], [("exact", F.col("exact")), ("shape", F.col("shape"))], "content", sides), sides


@query(f"WITH {_MEMBERS} SELECT * FROM i")
def member_items(spark, d):
    """Members of two versions of a brand, matched by type and size, then methods by type and size class."""
    return _items(spark, d)[0]


@query(f"""WITH {_MEMBERS}, k AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY left_id NULLS LAST, right_id) <= {ITEMS} AS kept FROM i),
c AS (SELECT module, {", ".join(f"count(*) FILTER (kept AND status = '{s}') AS {s}" for s in coverage.STATUSES)}, {", ".join(f"count(*) FILTER (kept AND matching = '{s}') AS {s}" for s in coverage.MATCHINGS)}, count(*) FILTER (NOT kept) AS omitted_items FROM k GROUP BY 1),
y AS (SELECT module, sum(omitted)::BIGINT AS omitted, bool_and(left_complete) AS lc, bool_and(right_complete) AS rc, module NOT LIKE '%5' AS known FROM z GROUP BY 1)
SELECT c.*, omitted AS omitted_members, CASE WHEN known AND lc THEN 'complete' ELSE 'partial' END AS left_status, CASE WHEN known AND rc THEN 'complete' ELSE 'partial' END AS right_status,
CASE WHEN NOT known THEN 'partial' WHEN omitted + omitted_items > 0 THEN 'truncated' WHEN lc AND rc THEN 'complete-within-inputs' ELSE 'partial' END AS coverage FROM c JOIN y USING (module)""")
def member_coverage(spark, d):
    """Counts of each brand's items, and whether pages or limits left something out; brands that end in 5 don't know their extent."""
    found, sides = _items(spark, d)
    zero = F.lit(0).cast("long")
    by_module = sides.groupBy("module").agg(
        F.sum(F.coalesce("left_omitted", zero) + F.coalesce("right_omitted", zero)).alias("omitted"), F.bool_and("left_complete").alias("left_complete"), F.bool_and("right_complete").alias("right_complete")
    )
    return coverage.summary(found, "module", ITEMS, by_module.withColumn("known", ~F.col("module").endswith("5")))
