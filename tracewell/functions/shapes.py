"""Shapes of JSON texts: which members of which types, without any value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NODES = "array<struct<path: string, member: boolean, depth: int, value: variant>>"
_TOLD = "array<struct<path: string, member: boolean, depth: int, type: string>>"


def _members(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _items(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _type(v: Column) -> Column:
    plain = F.schema_of_variant(v)
    simple = F.when(plain == "VOID", "null").when(plain == "STRING", "string").when(plain == "BOOLEAN", "boolean").otherwise("number")
    return F.when(_members(v).isNotNull(), "object").when(_items(v).isNotNull(), "array").otherwise(simple)


def _within(node: Column) -> Column:
    """The nodes right below one, objects' members by name and arrays' items as *."""
    name = lambda key: F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    deeper = (node["depth"] + 1).cast("int")
    members = F.transform(F.map_entries(_members(node["value"])), lambda e: F.struct(F.concat(node["path"], F.lit("/"), name(e["key"])).alias("path"), F.lit(True).alias("member"), deeper.alias("depth"), e["value"].alias("value")))
    items = F.transform(_items(node["value"]), lambda v: F.struct(F.concat(node["path"], F.lit("/*")).alias("path"), F.lit(False).alias("member"), deeper.alias("depth"), v.alias("value")))
    return F.coalesce(members, items, F.array().cast(_NODES))


def nodes(text: Column, max_depth: int = 8, max_bytes: int = 1 << 20) -> Column:
    """Every node of a JSON text down to max_depth: path (JSON Pointer, items as *), member, depth and type; and whether the text goes on below.

    Null where the text is null, no JSON, has a name twice in one object, or is longer than max_bytes.  The walk is a
    native fold over levels: one level's nodes are opened at a time, so a row needs no shuffle.
    """
    root = F.when(F.octet_length(text) <= max_bytes, F.try_parse_json(text))
    start = F.array(F.struct(F.lit("").alias("path"), F.lit(False).alias("member"), F.lit(0).alias("depth"), root.alias("value"))).cast(_NODES)
    named = lambda front: F.transform(front, lambda n: F.struct(n["path"].alias("path"), n["member"].alias("member"), n["depth"].alias("depth"), _type(n["value"]).alias("type")))
    zero = F.struct(F.array().cast(_TOLD).alias("told"), start.alias("front"))
    step = lambda acc, _: F.struct(F.concat(acc["told"], named(acc["front"])).alias("told"), F.flatten(F.transform(acc["front"], _within)).alias("front"))
    walk = F.aggregate(F.sequence(F.lit(0), F.lit(max_depth)), zero, step, lambda acc: F.struct(acc["told"].alias("nodes"), (F.size(acc["front"]) > 0).alias("truncated")))
    return F.when(root.isNotNull(), walk)


def _listed(df: DataFrame, keys: list[str], text: Column, max_depth: int, max_bytes: int) -> DataFrame:
    """keys, s, path, member, depth, type, first: one row for each node; first: of its path in its text."""
    own = df.select(*keys, nodes(text, max_depth, max_bytes).alias("s")).withColumn("__n", F.array_sort("s.nodes"))  # by path, then type
    flagged = F.transform("__n", lambda n, i: F.struct(n["path"].alias("path"), n["member"].alias("member"), n["depth"].alias("depth"), n["type"].alias("type"), (F.get("__n", i - 1)["path"].eqNullSafe(n["path"])).alias("again")))
    return own.select(*keys, "s.truncated", F.explode_outer(flagged).alias("n")).select(*keys, "truncated", "n.*")


def summarised(df: DataFrame, key: str, text: Column, max_depth: int = 8, max_bytes: int = 1 << 20) -> DataFrame:
    """key, root_type, node_count, depth, truncated, properties: one row for each key (which is unique); those without a shape have nulls.

    properties: path:types:observations of each member, sorted by path, with its types joined by |.
    """
    path = _listed(df, [key], text, max_depth, max_bytes).groupBy(key, "path").agg(
        F.array_join(F.sort_array(F.collect_set("type")), "|").alias("types"), F.count("type").alias("n"), F.bool_or("member").alias("member"), F.max("depth").alias("depth"), F.bool_or("truncated").alias("truncated")
    )
    line = F.struct("path", F.concat_ws(":", "path", "types", F.col("n").cast("string")).alias("line"))
    told = path.groupBy(key).agg(
        F.max(F.when(F.col("path") == "", F.col("types"))).alias("root_type"), F.sum("n").alias("n"), F.max("depth").cast("long").alias("depth"), F.bool_or("truncated").alias("truncated"),
        F.sort_array(F.collect_list(F.when(F.col("member"), line))).alias("lines"),
    )
    known = F.col("root_type").isNotNull()
    return told.select(key, "root_type", F.when(known, F.col("n")).alias("node_count"), "depth", "truncated", F.when(known, F.array_join(F.transform("lines", lambda x: x["line"]), ";")).alias("properties"))


def counted(df: DataFrame, keys: list[str], text: Column, max_depth: int = 8, max_bytes: int = 1 << 20) -> DataFrame:
    """keys, path, type, observations, texts: how often a group's texts have a node of a path and type; texts: those whose first node of the path has it.

    The root's path is empty.  Counts of parts of the rows, put together in any
    order by `merged`, are those of all rows; tasks count before they shuffle.
    """
    seen = _listed(df, keys, text, max_depth, max_bytes).where("type IS NOT NULL")
    return seen.groupBy(*keys, "path", "type").agg(F.count("*").alias("observations"), F.count_if(~F.col("again")).alias("texts"))


def merged(counts: DataFrame, keys: list[str]) -> DataFrame:
    return counts.groupBy(*keys, "path", "type").agg(F.sum("observations").alias("observations"), F.sum("texts").alias("texts"))


def described(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path, types, observations, texts, always: a group's shape, path by path; always: every text of the group with a shape has the path."""
    path = counts.groupBy(*keys, "path").agg(F.array_join(F.sort_array(F.collect_set("type")), "|").alias("types"), F.sum("observations").alias("observations"), F.sum("texts").alias("texts"))
    every = counts.where(F.col("path") == "").groupBy(*keys).agg(F.sum("texts").alias("__every"))
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys]
    both = path.alias("p").join(every.alias("e"), same)
    return both.select(*[f"p.{k}" for k in keys], "path", "types", "observations", "texts", (F.col("texts") == F.col("__every")).alias("always"))
