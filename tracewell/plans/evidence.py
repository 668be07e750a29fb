"""Further queries: evidence matching, verdict ladders, windows and sessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.functions import scalar
from tracewell.operators import diff, graph, match, trace
from tracewell.plans.catalog import DIFF, HALVES, _halves, query
from tracewell.sources import table

_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


@query(f"""WITH p AS (SELECT page_id, {_PATH} AS path, regexp_extract({_PATH}, '([^/]*)$', 1) AS base FROM pages WHERE url IS NOT NULL),
a AS (SELECT path, base, min(page_id) AS source FROM p WHERE page_id % 2 = 0 GROUP BY ALL), b AS (SELECT path, base, min(page_id) AS node FROM p WHERE page_id % 2 = 1 GROUP BY ALL),
s AS (SELECT source, node, CASE WHEN a.path = b.path THEN 60 ELSE 0 END + 20 AS score FROM a JOIN b USING (base))
SELECT source, node, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, node) AS rank FROM s WHERE score >= 20""")
def source_to_bundle_score(spark, d):
    """Pages with even ids are the sources, the others the nodes."""
    path = scalar.url_path(F.col("url"))
    p = table(spark, d, "pages").where("url IS NOT NULL").select("page_id", path.alias("path"), scalar.path_suffix(path, 1).alias("base"))
    return match.scored(p.where("page_id % 2 = 0"), p.where("page_id % 2 = 1"), "page_id", "page_id", "base", [("path", 60), ("base", 20)], 20)


_PLACES = f"""r AS (SELECT page_id, regexp_replace({_PATH}, '^/+|/+$', '', 'g') AS path, sha256(html) AS digest, nullif(regexp_replace(regexp_extract(html, '<a href="([^"?#]*)', 1), '^/+|/+$', '', 'g'), '') AS original FROM pages),
s AS (SELECT page_id, path, digest, min(page_id) OVER (PARTITION BY path) AS class_id FROM r WHERE page_id % 2 = 0), n AS (SELECT *, min(page_id) OVER (PARTITION BY path, original) AS class_id FROM r WHERE page_id % 2 = 1)"""


def _places(spark, d):
    """Pages with even ids are the sources, the others the nodes; a page's first link stands for a node's original path."""
    whole = lambda c: F.regexp_replace(c, "^/+|/+$", "")
    p = table(spark, d, "pages").select("page_id", whole(scalar.url_path(F.col("url"))).alias("path"), F.sha2("html", 256).alias("digest"), F.nullif(whole(F.regexp_extract("html", '<a href="([^"?#]*)', 1)), F.lit("")).alias("original"))
    return match.place_classes(p.where("page_id % 2 = 0").drop("original"), "page_id", ["path"]), match.place_classes(p.where("page_id % 2 = 1"), "page_id", ["path", "original"])


@query(f"WITH {_PLACES} SELECT page_id, 'source' AS side, class_id, digest FROM s UNION ALL SELECT page_id, 'node', class_id, digest FROM n")
def source_to_bundle_members(spark, d):
    """Every page with its class in source_to_bundle_pairs."""
    s, n = _places(spark, d)
    one = lambda df, side: df.select("page_id", F.lit(side).alias("side"), "class_id", "digest")
    return one(s, "source").unionByName(one(n, "node"))


@query(f"""WITH {_PLACES},
a AS (SELECT DISTINCT class_id AS source, path AS own, regexp_extract(path, '[^/]*$') AS own_base FROM s), m AS (SELECT DISTINCT class_id AS node, path, original, regexp_extract(path, '[^/]*$') AS base, regexp_extract(original, '[^/]*$') AS original_base FROM n),
c AS (SELECT source, node, NULL AS digest FROM a JOIN m ON own_base = base UNION SELECT source, node, NULL FROM a JOIN m ON own_base = original_base UNION SELECT s.class_id, n.class_id, digest FROM s JOIN n USING (digest)),
e AS (SELECT c.*, a.own, a.own_base, m.path, m.original, m.base, m.original_base, lower(regexp_extract(own_base, '^.+(\\.[^.]*)$', 1)) AS own_ext, lower(regexp_extract(base, '^.+(\\.[^.]*)$', 1)) AS ext, lower(regexp_extract(original_base, '^.+(\\.[^.]*)$', 1)) AS original_ext FROM c JOIN a USING (source) JOIN m USING (node)),
p AS (SELECT source, node, digest, CASE WHEN digest IS NOT NULL THEN 100 ELSE 0 END + CASE WHEN original = own OR ends_with(original, '/' || own) THEN 70 ELSE 0 END + CASE WHEN path = own THEN 60 ELSE 0 END + CASE WHEN ends_with(path, '/' || own) THEN 40 ELSE 0 END
+ CASE WHEN base = own_base OR original_base = own_base THEN 20 ELSE 0 END + CASE WHEN own_ext <> '' AND (ext = own_ext OR original_ext = own_ext) THEN 5 ELSE 0 END AS score FROM e)
SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, node, digest NULLS LAST) AS rank FROM p WHERE score >= 20""")
def source_to_bundle_pairs(spark, d):
    return match.signal_pairs(*_places(spark, d))


@query("""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN sha256(text) END AS digest, source FROM documents), c AS (SELECT doc_id, sha256(text) AS digest, source FROM documents WHERE doc_id % 2 = 1),
n2 AS (SELECT digest, source, count(*) AS n, min(doc_id) AS c FROM c GROUP BY ALL), n1 AS (SELECT digest, count(*) AS n, min(doc_id) AS c FROM c GROUP BY ALL), n0 AS (SELECT source, count(*) AS n, min(doc_id) AS c FROM c GROUP BY ALL),
s AS (SELECT x.doc_id, n2.c AS c2, n1.c AS c1, n0.c AS c0, CASE WHEN n2.n = 1 THEN 'content_and_location' WHEN n1.n = 1 THEN 'content' WHEN n1.n > 1 THEN 'ambiguous' WHEN x.digest IS NULL AND n0.n = 1 THEN 'location' WHEN x.digest IS NULL AND n0.n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS status
FROM x LEFT JOIN n2 USING (digest, source) LEFT JOIN n1 USING (digest) LEFT JOIN n0 ON x.source = n0.source WHERE x.doc_id % 2 = 0)
SELECT doc_id, status, CASE status WHEN 'content_and_location' THEN c2 WHEN 'content' THEN c1 WHEN 'location' THEN c0 END AS candidate FROM s""")
def runtime_reconcile(spark, d):
    """Even documents against odd ones; every third has no captured content."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), "source")
    seen = docs.where("doc_id % 2 = 0").withColumn("digest", F.when(F.col("doc_id") % 3 != 0, F.col("digest")))
    return match.reconcile(seen, docs.where("doc_id % 2 = 1"), "doc_id", "doc_id", "digest", "source")


@query(f"""WITH {HALVES}, x AS ({DIFF}), s AS (SELECT user_id, event_type, grouping(event_type) = 1 AS all_kinds, bool_or(status = 'changed') AS moved, bool_or(status IN ('added', 'removed')) AS open FROM x GROUP BY GROUPING SETS ((user_id, event_type), (user_id))),
h AS (SELECT user_id, sum(value) FILTER (ts < TIMESTAMP '2024-01-16') AS early, sum(value) FILTER (ts >= TIMESTAMP '2024-01-16') AS late FROM events GROUP BY 1),
r AS (SELECT user_id, abs(early - late) > 100 AS moved, round(early) <> round(late) AS exactly FROM h),
p AS (SELECT user_id, event_type, all_kinds, CASE WHEN s.open OR r.moved IS NULL THEN 'unknown' WHEN s.moved AND r.moved THEN 'cochanged' WHEN s.moved THEN 'static_only' WHEN r.moved THEN 'runtime_only' ELSE 'both_unchanged' END AS pattern,
CASE WHEN s.open OR r.exactly IS NULL THEN 'unknown' WHEN s.moved AND r.exactly THEN 'cochanged' WHEN s.moved THEN 'static_only' WHEN r.exactly THEN 'runtime_only' ELSE 'both_unchanged' END AS exact_pattern FROM s JOIN r USING (user_id))
SELECT *, CASE pattern WHEN 'unknown' THEN 'unresolved' WHEN 'cochanged' THEN 'consistent' ELSE 'contradicted' END AS verdict, CASE exact_pattern WHEN 'unknown' THEN 'unresolved' WHEN 'cochanged' THEN 'consistent' ELSE 'contradicted' END AS exact_verdict FROM p""")
def hypothesis_join(spark, d):
    """Counts of each kind of event, and of all kinds together, are the static side; value sums (by more than 100, and exactly) the runtime side; expected: both change."""
    x = diff.keyed_diff(*_halves(spark, d), ["user_id", "event_type"], ["n"])
    user, kind = F.col("user_id"), F.col("event_type")
    s = x.groupingSets([[user, kind], [user]], user, kind).agg((F.grouping("event_type") == 1).alias("all_kinds"), F.bool_or(F.col("status") == "changed").alias("s"), F.bool_or(F.col("status").isin("added", "removed")).alias("open"))
    early = F.col("ts") < F.to_timestamp_ntz(F.lit("2024-01-16"))
    h = table(spark, d, "events").groupBy("user_id").agg(F.sum(F.when(early, F.col("value"))).alias("a"), F.sum(F.when(~early, F.col("value"))).alias("b"))
    r = h.select("user_id", (F.abs(F.col("a") - F.col("b")) > 100).alias("r"), (F.round("a") != F.round("b")).alias("exactly"))
    pattern = lambda c: F.when(F.col("open") | F.col(c).isNull(), "unknown").when(F.col("s") & F.col(c), "cochanged").when(F.col("s"), "static_only").when(F.col(c), "runtime_only").otherwise("both_unchanged")
    verdict = lambda c: F.when(F.col(c) == "unknown", "unresolved").when(F.col(c) == "cochanged", "consistent").otherwise("contradicted")
    p = s.join(r, "user_id").select("user_id", "event_type", "all_kinds", pattern("r").alias("pattern"), pattern("exactly").alias("exact_pattern"))
    return p.withColumn("verdict", verdict("pattern")).withColumn("exact_verdict", verdict("exact_pattern"))


@query("""SELECT conv_id, count(*) FILTER (role = 'user') AS before, count(*) FILTER (role = 'assistant') AS after,
CASE WHEN count(*) FILTER (role = 'user') > 1 OR count(*) FILTER (role = 'assistant') > 1 THEN 'duplicate' WHEN count(*) FILTER (role = 'user') = 0 THEN 'missing_before' WHEN count(*) FILTER (role = 'assistant') = 0 THEN 'missing_after' ELSE 'aligned' END AS status
FROM conversations WHERE role IN ('user', 'assistant') GROUP BY 1""")
def step_alignment(spark, d):
    n = table(spark, d, "conversations").where("role IN ('user', 'assistant')").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("before"), F.count_if(F.col("role") == "assistant").alias("after"))
    return n.withColumn("status", F.when((F.col("before") > 1) | (F.col("after") > 1), "duplicate").when(F.col("before") == 0, "missing_before").when(F.col("after") == 0, "missing_after").otherwise("aligned"))


@query("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON lower(regexp_replace(s_name, '^[A-Za-z]+#0*', '')) = lower(regexp_replace(c_name, '^[A-Za-z]+#0*', ''))")
def symbol_join(spark, d):
    norm = lambda c: F.lower(F.regexp_replace(c, "^[A-Za-z]+#0*", ""))
    return table(spark, d, "supplier").select("s_suppkey", norm("s_name").alias("k")).join(table(spark, d, "customer").select("c_custkey", norm("c_name").alias("k")), "k").select("s_suppkey", "c_custkey")


@query("""WITH h AS (SELECT s_nationkey, count(*) AS n, min(s_suppkey) AS t FROM supplier GROUP BY 1)
SELECT c_custkey, coalesce(n, 0) AS candidates, CASE WHEN n IS NULL THEN 'unpaired' WHEN n = 1 THEN 'paired' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN t END AS target FROM customer LEFT JOIN h ON s_nationkey = c_nationkey""")
def unique_handler(spark, d):
    left = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k"))
    return match.unique_target(left, table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k")), "k", "s_suppkey").select("c_custkey", "candidates", "status", "target")


@query("""WITH k AS (SELECT p_partkey, '0:' || p_brand || '/' || p_type AS k FROM part UNION ALL SELECT p_partkey, '1:' || p_brand || '/' || p_size FROM part),
a AS (SELECT k, min(p_partkey) AS l FROM k WHERE p_partkey % 2 = 0 GROUP BY k HAVING count(*) = 1), b AS (SELECT k, min(p_partkey) AS r FROM k WHERE p_partkey % 2 = 1 GROUP BY k HAVING count(*) = 1),
p AS (SELECT DISTINCT l, r FROM a JOIN b USING (k))
SELECT l AS left_id, r AS right_id FROM (SELECT *, count(*) OVER (PARTITION BY l) AS x, count(*) OVER (PARTITION BY r) AS y FROM p) WHERE x = 1 AND y = 1""")
def reciprocal_pairing(spark, d):
    p = table(spark, d, "part")
    keys = [F.concat_ws("/", "p_brand", "p_type"), F.concat_ws("/", "p_brand", F.col("p_size").cast("string"))]
    return match.reciprocal(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 2 = 1"), "p_partkey", "p_partkey", keys)


@query("SELECT p_partkey, s_suppkey FROM part LEFT JOIN supplier ON p_partkey >= s_suppkey * 20 AND p_partkey < s_suppkey * 20 + 15")
def range_containment(spark, d):
    """Parts are addresses; supplier k owns [20k, 20k + 15)."""
    ranges = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") * 20).alias("a"), (F.col("s_suppkey") * 20 + 15).alias("b"))
    return match.contained(table(spark, d, "part").select("p_partkey"), ranges, "p_partkey", "a", "b", 20).select("p_partkey", "s_suppkey")


@query(f"""WITH {HALVES.replace("b AS (", "c AS (")}, b AS (SELECT * FROM c WHERE NOT (user_id % 29 = 1 AND event_type = 'view')), x AS ({DIFF}) SELECT user_id, event_type, count(*) AS n, CASE WHEN bool_or(status IN ('added', 'removed')) THEN 'unverified' WHEN bool_or(status = 'changed') THEN 'contradicted' ELSE 'supported' END AS verdict FROM x GROUP BY 1, 2""")
def claim_verdicts(spark, d):
    """A claim for each user and kind: as many in both halves; the second half lacks the views of every 29th user."""
    a, b = _halves(spark, d)
    x = diff.keyed_diff(a, b.where("NOT (user_id % 29 = 1 AND event_type = 'view')"), ["user_id", "event_type"], ["n"])
    verdict = F.when(F.bool_or(F.col("status").isin("added", "removed")), "unverified").when(F.bool_or(F.col("status") == "changed"), "contradicted").otherwise("supported")
    return x.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), verdict.alias("verdict"))


@query("""WITH v AS (SELECT vec_id // 2 AS pair, vec_id % 2 AS side, embedding FROM embeddings), u AS (SELECT pair, unnest(a.embedding)::DOUBLE AS x, unnest(b.embedding)::DOUBLE AS y FROM v a JOIN v b USING (pair) WHERE a.side = 0 AND b.side = 1),
z AS (SELECT pair, abs(x - y) AS delta FROM u)
SELECT pair, count(*) FILTER (delta <> 0) AS changed, round(max(delta), 6) AS max_delta, round(avg(delta), 6) AS mean_delta FROM z GROUP BY 1""")
def value_delta_stats(spark, d):
    v = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("pair"), (F.col("vec_id") % 2).alias("side"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    both = v.where("side = 0").select("pair", F.col("e").alias("a")).join(v.where("side = 1").select("pair", F.col("e").alias("b")), "pair")
    delta = both.select("pair", F.zip_with("a", "b", lambda x, y: F.abs(x - y)).alias("z"))
    total = F.aggregate("z", F.lit(0.0), lambda s, x: s + x)
    return delta.select("pair", F.size(F.filter("z", lambda x: x != 0)).cast("long").alias("changed"), F.round(F.array_max("z"), 6).alias("max_delta"), F.round(total / F.size("z"), 6).alias("mean_delta"))


_DAYS = "WITH s AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL)"


@query(f"""{_DAYS} SELECT coalesce(c.user_id, p.user_id) AS user_id, coalesce(c.day, p.next)::VARCHAR AS day, CASE WHEN p.n IS NULL THEN 'created' WHEN c.n IS NULL THEN 'deleted' WHEN p.n <> c.n THEN 'modified' ELSE 'unchanged' END AS effect
FROM s c FULL JOIN (SELECT user_id, (day + 1)::DATE AS next, n FROM s) p ON c.user_id = p.user_id AND c.day = p.next""")
def checkpoint_effects(spark, d):
    s = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    was = s.select("user_id", F.date_add("day", 1).alias("day"), F.col("n").alias("p"))
    effect = F.when(F.col("p").isNull(), "created").when(F.col("n").isNull(), "deleted").when(F.col("p") != F.col("n"), "modified").otherwise("unchanged")
    return s.join(was, ["user_id", "day"], "full_outer").select("user_id", F.col("day").cast("string").alias("day"), effect.alias("effect"))


@query("SELECT event_id, user_id, lag(event_id) OVER w AS previous, coalesce(ts >= lag(ts) OVER w, true) AS valid FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id % 10, event_id)")
def lag_chain(spark, d):
    """Events are recorded by the last digit of their ids, so a chain of times may break."""
    w = Window.partitionBy("user_id").orderBy(F.col("event_id") % 10, "event_id")
    return table(spark, d, "events").select("event_id", "user_id", F.lag("event_id").over(w).alias("previous"), F.coalesce(F.col("ts") >= F.lag("ts").over(w), F.lit(True)).alias("valid"))


@query("""WITH x AS (SELECT user_id, min(event_id) FILTER (event_type = 'purchase') AS e, min(event_id) FILTER (event_type = 'signup') AS a FROM events GROUP BY 1)
SELECT user_id, CASE WHEN e IS NULL THEN 'ok' WHEN a IS NULL THEN 'missing_anchor' WHEN e < a THEN 'violated' ELSE 'ok' END AS status FROM x""")
def trace_not_before(spark, d):
    return trace.not_before(table(spark, d, "events"), "user_id", "event_type", "event_id", "signup", "purchase")


@query("""WITH s AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS s FROM events GROUP BY 1) SELECT user_id, s[1:1] = ['signup'] AS prefix_ok, s[-2:] = ['click', 'purchase'] AS suffix_ok FROM s""")
def trace_boundary(spark, d):
    return trace.boundary(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", ["signup"], ["click", "purchase"])


@query("""WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS k, ts::DATE AS day FROM events), v AS (SELECT string_agg(event_type, ',' ORDER BY event_type) AS variant FROM r WHERE k <= 3 GROUP BY user_id, day)
SELECT variant, count(*) AS n FROM v GROUP BY 1""")
def trace_variants(spark, d):
    """The first three events of a user's day as one unordered group."""
    day = F.to_date("ts")
    r = table(spark, d, "events").select("user_id", day.alias("day"), "event_type", F.row_number().over(Window.partitionBy("user_id", day).orderBy("ts", "event_id")).alias("k"))
    v = r.where("k <= 3").groupBy("user_id", "day").agg(F.array_join(F.sort_array(F.collect_list("event_type")), ",").alias("variant"))
    return v.groupBy("variant").agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT user_id, ts::DATE AS day, coalesce(event_type, 'null') AS kind, count(*) AS n FROM events GROUP BY ALL), v AS (SELECT string_agg(kind || ':' || n, ',' ORDER BY kind) AS variant FROM n GROUP BY user_id, day)
SELECT variant, count(*) AS n FROM v GROUP BY 1""")
def trace_variants_whole(spark, d):
    """All events of a user's day as one unordered group, each type with its count."""
    return trace.variants(table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_type"), ["user_id", "day"], "event_type")


@query("""WITH a AS (SELECT user_id, min((ts, event_id)) AS t FROM events WHERE event_type = 'signup' GROUP BY 1), b AS (SELECT e.user_id, min((e.ts, e.event_id)) AS t FROM events e JOIN a USING (user_id) WHERE event_type = 'click' AND (e.ts, e.event_id) > a.t GROUP BY 1),
c AS (SELECT e.user_id, min((e.ts, e.event_id)) AS t FROM events e JOIN b USING (user_id) WHERE event_type = 'purchase' AND (e.ts, e.event_id) > b.t GROUP BY 1), u AS (SELECT DISTINCT user_id FROM events WHERE event_type IN ('signup', 'click', 'purchase'))
SELECT user_id, (CASE WHEN a.t IS NULL THEN 0 WHEN b.t IS NULL THEN 1 WHEN c.t IS NULL THEN 2 ELSE 3 END)::INT AS reached FROM u LEFT JOIN a USING (user_id) LEFT JOIN b USING (user_id) LEFT JOIN c USING (user_id)""")
def cep_sequence(spark, d):
    return trace.sequence(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", ["signup", "click", "purchase"])


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS n, count(*) FILTER (event_type = 'click') BETWEEN 2 AND 30 AS matched FROM events GROUP BY 1")
def cep_repeat(spark, d):
    """More than the maximum is no match, not a cut."""
    n = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("n"))
    return n.withColumn("matched", F.col("n").between(2, 30))


@query("SELECT doc_id, CASE WHEN len(s) > 2 THEN length(array_to_string(s[1:2], 'the')) + 1 END AS at FROM (SELECT doc_id, string_split(text, 'the') AS s FROM documents WHERE text IS NOT NULL)")
def nth_occurrence(spark, d):
    """Where the second 'the' of a text starts, from 1."""
    s = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.split("text", "the").alias("s"))
    return s.select("doc_id", F.when(F.size("s") > 2, F.length(F.array_join(F.slice("s", 1, 2), "the")) + 1).cast("long").alias("at"))


@query("SELECT l_orderkey, count(DISTINCT l_linenumber) AS have, max(l_linenumber)::BIGINT AS total, count(*) > count(DISTINCT l_linenumber) AS overlap, count(DISTINCT l_linenumber) = max(l_linenumber) AND min(l_linenumber) = 1 AS complete FROM lineitem GROUP BY 1")
def page_reassembly(spark, d):
    """Line numbers are the positions of an order's pages; whole if 1 to the last are covered."""
    per = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("c"))
    n = per.groupBy("l_orderkey").agg(F.count("*").alias("have"), F.max("l_linenumber").cast("long").alias("total"), (F.max("c") > 1).alias("overlap"), F.min("l_linenumber").alias("low"))
    return n.select("l_orderkey", "have", "total", "overlap", ((F.col("have") == F.col("total")) & (F.col("low") == 1)).alias("complete"))


@query("""WITH m AS (SELECT o_custkey, min(o_orderpriority) AS p FROM orders GROUP BY 1) SELECT o_custkey, p AS priority, min(o_orderkey) AS o_orderkey, count(*) > 1 AS ambiguous FROM orders JOIN m USING (o_custkey) WHERE o_orderpriority = p GROUP BY ALL""")
def priority_select(spark, d):
    per = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("k"), F.count("*").alias("n"))
    best = per.groupBy("o_custkey").agg(F.min(F.struct("o_orderpriority", "k", "n")).alias("b"))
    return best.select("o_custkey", F.col("b.o_orderpriority").alias("priority"), F.col("b.k").alias("o_orderkey"), (F.col("b.n") > 1).alias("ambiguous"))


@query("""WITH f AS (SELECT p_brand || ' ' || p_type AS name, split_part(p_type, ' ', 1) AS category, min(p_partkey) AS address FROM part GROUP BY ALL)
SELECT category, name, address, n, position FROM (SELECT *, count(*) OVER (PARTITION BY category) AS n, row_number() OVER (PARTITION BY category ORDER BY address)::INT AS position FROM f) WHERE position <= 50""")
def category_counts(spark, d):
    """Types are named by brand and type, the first of each name by part key stays; each category has its count and its first 50."""
    named = table(spark, d, "part").select(F.concat_ws(" ", "p_brand", "p_type").alias("name"), F.substring_index("p_type", " ", 1).alias("category"), F.col("p_partkey").alias("address"))
    return match.listed(named, "name", "category", "address", 50)


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey * 2) % 25 AS dst FROM nation), p AS (SELECT src, dst, 1 AS depth FROM e UNION SELECT p.src, e.dst, p.depth + 1 FROM p JOIN e ON p.dst = e.src WHERE p.depth < 6)
SELECT src::INT AS node, (min(depth) FILTER (src = dst))::INT AS cycle, count(DISTINCT dst) AS reachable FROM p GROUP BY 1""")
def closure_cycles(spark, d):
    """Edges lead from nation k to 2k; for each node the shortest cycle through it and what it reaches."""
    e = table(spark, d, "nation").select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 2) % 25).alias("dst"))
    return graph.closure(e, 6).groupBy(F.col("src").alias("node")).agg(F.min(F.when(F.col("src") == F.col("dst"), F.col("depth"))).alias("cycle"), F.count("*").alias("reachable"))


@query("SELECT c.event_id, p.event_type AS parent_type, CASE WHEN c.event_id // 2 = c.event_id THEN 'root' WHEN p.event_id IS NULL THEN 'orphan' ELSE 'child' END AS kind FROM events c LEFT JOIN events p ON p.event_id = c.event_id // 2")
def parent_relations(spark, d):
    """Event k is a child of event k // 2."""
    e = table(spark, d, "events")
    up = e.select(F.col("event_id").alias("up"), F.col("event_type").alias("parent_type"))
    own = e.select("event_id", F.floor(F.col("event_id") / 2).alias("at"))
    kind = F.when(F.col("at") == F.col("event_id"), "root").when(F.col("up").isNull(), "orphan").otherwise("child")
    return own.join(up, F.col("at") == F.col("up"), "left").select("event_id", "parent_type", kind.alias("kind"))


@query("""WITH s AS (SELECT *, coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOURS, true)::INT AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM s)
SELECT user_id, session::BIGINT AS session, count(*) AS n FROM g GROUP BY ALL""")
def session_gap(spark, d):
    return trace.sessions(table(spark, d, "events"), "user_id", "ts", "event_id", "'6' HOUR").groupBy("user_id", "session").agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY ALL), x AS (SELECT day, event_type, n FROM n UNION ALL SELECT (day - 1)::DATE, event_type, n FROM n)
SELECT day::VARCHAR AS start, event_type, sum(n)::BIGINT AS n FROM x GROUP BY ALL""")
def sliding(spark, d):
    """Windows of two days that start every day."""
    n = table(spark, d, "events").groupBy(F.window("ts", "2 days", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return n.select(F.to_date("window.start").cast("string").alias("start"), "event_type", "n")


@query("SELECT event_id, user_id FROM (SELECT *, max(ts) OVER (PARTITION BY user_id ORDER BY event_id % 10, event_id) AS seen FROM events) WHERE ts < seen - INTERVAL 1 DAY")
def late_rows(spark, d):
    """Events arrive by the last digit of their ids; those a day behind the newest are late."""
    w = Window.partitionBy("user_id").orderBy(F.col("event_id") % 10, "event_id")
    return table(spark, d, "events").select("event_id", "user_id", "ts", F.max("ts").over(w).alias("seen")).where("ts < seen - INTERVAL 1 DAY").select("event_id", "user_id")


@query("SELECT l_returnflag, year, count(*) AS n FROM (SELECT l_returnflag, strftime(l_shipdate, '%Y') AS year FROM lineitem) GROUP BY GROUPING SETS ((l_returnflag), (year), ())")
def grouping_sets(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", F.date_format("l_shipdate", "yyyy").alias("year"))
    return rows.groupingSets([["l_returnflag"], ["year"], []], "l_returnflag", "year").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, rank() OVER w AS rank, dense_rank() OVER w AS dense, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS tile FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
def rank_frames(spark, d):
    w, t = Window.partitionBy("o_custkey").orderBy("o_orderpriority"), Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.rank().over(w).alias("rank"), F.dense_rank().over(w).alias("dense"), F.ntile(4).over(t).alias("tile"))


@query()
def approx_distinct(spark, d):
    """Approximate, so without SQL."""
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"))
