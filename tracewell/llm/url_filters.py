"""Operator 8, URL filters: a sort-merge range join over reversed-host keys.

A host's key is its labels in reverse, each closed by a dot
(`www.example.com` -> `com.example.www.`), so a rule's host covers exactly the
keys that begin with its own key: one interval of the sorted keys, and
intervals of two rules are nested or disjoint.

1. Rules are grouped by host; each rule host gets its stack: the rules of all
   rule hosts that enclose it, itself included.
2. Distinct hosts of the urls and the rule hosts are sorted together.  A sweep
   carries the stack of the last rule host that began; what of it encloses the
   current key is active there.  Nesting makes this exact.
3. Every url looks at its host's active rules; of those whose path begins the
   url's path the longest (host and path together) wins, on a tie the longer
   host, then the smaller rule text.

The sweep runs in fragments: hosts are hashed to `fragments` groups and the
rule hosts go to each of them.  A host with a third of all urls is one row of
the sweep; the join back to the urls is an ordinary one on the host, in which
adaptive execution splits the partitions of hot hosts.  Nothing is broadcast
by hand.

Defined cases: a null url or one without `://` has an empty host and path and
fits no rule; verdict then is `default`.  Repeated urls are judged alike; an
empty rule table gives every url the default.  Output columns that clash with
input columns replace them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.common import ascii_lower, fresh


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_frame(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules (verdict, host and path as text) as rows."""
    return spark.createDataFrame(rules, "verdict string, rule string")


def _stacks(rules: DataFrame) -> DataFrame:
    """Rule hosts with the rules of all rule hosts that enclose them."""
    host = ascii_lower(F.substring_index("rule", "/", 1))
    r = rules.select(
        host_key(host).alias("rule_key"),
        F.struct(
            F.length("rule").alias("size"),
            F.length(host).alias("host_size"),
            F.substring(F.col("rule"), F.length(host) + 1, F.length("rule")).alias("rule_path"),
            "rule",
            "verdict",
        ).alias("r"),
    )
    own = r.groupBy("rule_key").agg(F.collect_set("r").alias("own"))
    labels = F.split(F.expr("substring(rule_key, 1, length(rule_key) - 1)"), r"\.")
    above = own.select("rule_key", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))).alias("outer_key"))
    return above.join(own.select(F.col("rule_key").alias("outer_key"), "own"), "outer_key").groupBy("rule_key").agg(
        F.collect_list(F.struct(F.col("outer_key"), F.col("own").alias("rules"))).alias("stack")
    )


def active_rules(hosts: DataFrame, rules: DataFrame, fragments: int) -> DataFrame:
    """Distinct hosts (column host) with their active rules, by the sweep."""
    every = F.explode(F.sequence(F.lit(0), F.lit(fragments - 1)))
    stacks = _stacks(rules)
    begins = stacks.select(every.alias("fragment"), F.col("rule_key").alias("key"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"), "stack")
    points = hosts.select(
        F.pmod(F.xxhash64("host"), F.lit(fragments)).cast("int").alias("fragment"), host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "host", F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack")
    )
    sweep = Window.partitionBy("fragment").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = begins.unionByName(points).withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    active = F.filter("stack", lambda s: F.startswith(F.col("key"), s["outer_key"]))
    return swept.select("host", F.flatten(F.transform(active, lambda s: s["rules"])).alias("active"))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", fragments: int | None = None) -> DataFrame:
    """Add host, path, rule and verdict to pages."""
    spark = pages.sparkSession
    fragments = fragments or int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = ("host", "path", "rule", "verdict")
    rest = [c for c in pages.columns if c.lower() not in made]
    link = F.col(url)
    host, path, own, top = (fresh(pages, f"__{x}") for x in ("host", "path", "active", "best"))
    split = pages.select(*rest, host_of(link).alias(host), path_of(link).alias(path))
    active = active_rules(split.select(F.col(host).alias("host")).distinct(), rules, fragments).select(F.col("host").alias(host), F.col("active").alias(own))
    fits = F.filter(own, lambda r: F.startswith(F.col(path), r["rule_path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["size"].alias("size"), r["host_size"].alias("host_size"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    joined = split.join(active, host, "left").withColumn(top, best)
    return joined.select(
        *rest,
        F.col(host).alias("host"),
        F.col(path).alias("path"),
        F.col(top)["rule"].alias("rule"),
        F.coalesce(F.col(top)["verdict"], F.lit(default)).alias("verdict"),
    )
