"""Literal and regular-expression search, and stable pages."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def literal(df: DataFrame, column: str, needle: str) -> DataFrame:
    hits = (F.length(column) - F.length(F.replace(F.col(column), F.lit(needle), F.lit("")))) / len(needle)
    return df.where(F.contains(F.col(column), F.lit(needle))).withColumn("hits", hits.cast("long"))


def regex(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.withColumn("hits", F.size(F.regexp_extract_all(column, F.lit(pattern), F.lit(0))).cast("long")).where("hits > 0")


def page(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """Rows offset+1 to offset+limit in order, with total and next_offset.

    The rows come from a top-k (each task sends offset+limit rows at most); the total from a count.
    """
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).limit(offset + limit)
    own = rows.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long")).where(F.col("position") > offset)
    more = F.when(F.col("total") > offset + limit, F.lit(offset + limit).cast("long"))
    return own.crossJoin(F.broadcast(total)).withColumn("next_offset", more)  # one row


def numbered(df: DataFrame, order: list[str], cell: Column) -> DataFrame:
    """df with position, from 1, over all rows; `cell` is a prefix of the order, whose counts give the offsets."""
    dealt = df.withColumn("__cell", cell)
    counts = dealt.groupBy("__cell").agg(F.count("*").alias("__n"))
    before = counts.select("__cell", (F.sum("__n").over(Window.orderBy("__cell")) - F.col("__n")).alias("__before"))
    nth = dealt.withColumn("__i", F.row_number().over(Window.partitionBy("__cell").orderBy(*order)))
    return nth.join(before, "__cell").withColumn("position", F.col("__before") + F.col("__i")).drop("__cell", "__i", "__before")


def cursor(query_id: str, offset: Column) -> Column:
    """A token for a page's offset that belongs to one query."""
    mark = hashlib.sha256(query_id.encode()).hexdigest()[:12]
    return F.concat(F.lit("tw_"), offset.cast("string"), F.lit(f"_{mark}"))


def resume(token: str, query_id: str, total: int) -> int:
    """The offset of a cursor; one of another query or beyond the end is refused."""
    m = re.fullmatch(r"tw_(\d+)_([0-9a-f]{12})", token)
    if m is None or m[2] != hashlib.sha256(query_id.encode()).hexdigest()[:12]:
        raise ValueError("the cursor belongs to another query")
    if int(m[1]) > total:
        raise ValueError("the cursor is beyond the end")
    return int(m[1])


def distances(df: DataFrame, number: str, out: str, most: int, width: int) -> DataFrame:
    """df with the distance to the next greater number, null from `most` on; numbers meet in cells of `width`, their first ones across cells."""
    dealt = df.withColumn("__cell", F.floor(F.col(number) / width))
    heads = dealt.groupBy("__cell").agg(F.min(number).alias("__head"))
    then = heads.select("__cell", F.lead("__head").over(Window.orderBy("__cell")).alias("__then"))
    near = dealt.withColumn("__next", F.lead(number).over(Window.partitionBy("__cell").orderBy(number))).join(then, "__cell")
    gap = F.coalesce("__next", "__then") - F.col(number)
    return near.withColumn(out, F.when(gap < most, gap).cast("decimal(20,0)")).drop("__cell", "__next", "__then")


def field_changes(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """key, pointer, change: entries of two maps (JSON Pointer to text) that were added, removed or changed."""
    names = F.array_union(F.map_keys(a), F.map_keys(b))
    x, y = F.try_element_at(F.col(a), F.col("pointer")), F.try_element_at(F.col(b), F.col("pointer"))
    change = F.when(x.isNull(), "added").when(y.isNull(), "removed").when(x != y, "changed")
    return df.select(key, a, b, F.explode(names).alias("pointer")).select(key, "pointer", change.alias("change")).where("change IS NOT NULL")
