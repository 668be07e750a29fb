"""Repeated runs of scenarios against their first run: which ones drift, and what a package of them amounts to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drift(runs: DataFrame, package: str, scenario: str, run: str, status: str, dimensions: list[str]) -> DataFrame:
    """package, scenario, verdict, passed, failed, errored, skipped and drift (run and dimension): one row for each scenario.

    runs: one row for each run of a scenario, with its status (pass, fail, error
    or skipped) and what was observed of it.  The first run is what was
    committed; drift is the first later one, and in it the first dimension in the
    given order, that differs.  A dimension that is null was not observed and
    differs from nothing.  failing: a run failed or ended in an error; else
    drifting; unknown: something was not observed; insufficient: a single run;
    else stable.  Rows without a package, scenario or run take no part.
    """
    own = runs.select(package, scenario, run, status, *dimensions).dropna(subset=[package, scenario, run])
    first = own.groupBy(package, scenario).agg(F.min(F.struct(run, *dimensions)).alias("__f"))
    both = own.join(first, [package, scenario])
    later = F.col(run) != F.col(f"__f.{run}")
    differing = F.coalesce(*[F.when(F.col(x) != F.col(f"__f.{x}"), F.lit(x)) for x in dimensions])
    absent = F.lit(False)
    for x in dimensions:
        absent = absent | F.col(x).isNull()
    count = lambda s: F.count_if(F.col(status) == s)
    g = both.groupBy(package, scenario).agg(
        F.count("*").alias("__runs"), count("pass").alias("passed"), count("fail").alias("failed"), count("error").alias("errored"), count("skipped").alias("skipped"),
        F.min(F.when(later & differing.isNotNull(), F.struct(F.col(run).alias("run"), differing.alias("dimension")))).alias("drift"), F.bool_or(absent).alias("__absent"),
    )
    verdict = (
        F.when(F.col("failed") + F.col("errored") > 0, "failing").when(F.col("drift").isNotNull(), "drifting").when(F.col("__absent"), "unknown")
        .when(F.col("__runs") == 1, "insufficient").otherwise("stable")
    )
    return g.select(package, scenario, verdict.alias("verdict"), "passed", "failed", "errored", "skipped", "drift")


def packages(scenarios: DataFrame, package: str, scenario: str) -> DataFrame:
    """package, scenarios, passed, failed, errored, skipped, drift_detected, first_drift (scenario, run, dimension), gate: what `drift` says of a package's scenarios.

    gate: fail, if a scenario drifts or fails; unknown, if one is unknown or insufficient; else pass.
    """
    drifted = F.when(F.col("drift").isNotNull(), F.struct(scenario, "drift.run", "drift.dimension"))
    bad, open_ = F.bool_or(F.col("drift").isNotNull() | (F.col("verdict") == "failing")), F.bool_or(F.col("verdict").isin("unknown", "insufficient"))
    return scenarios.groupBy(package).agg(
        F.count("*").alias("scenarios"), *[F.sum(c).alias(c) for c in ("passed", "failed", "errored", "skipped")],
        F.bool_or(F.col("drift").isNotNull()).alias("drift_detected"), F.min(drifted).alias("first_drift"), F.when(bad, "fail").when(open_, "unknown").otherwise("pass").alias("gate"),
    )
