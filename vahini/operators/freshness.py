"""Run logs and source health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def source_health(runs: DataFrame, now: Column, stale_minutes: int = 60, every_minutes: int = 15) -> DataFrame:
    """Per portal of runs(portal, id, started, finished, ok, changed): last run, last success, last change, age and state.

    "unknown" without a run, "failed" if the last run failed, "stale" if the last success is too old, else "up_to_date".
    """
    ok = F.coalesce(F.col("ok"), F.lit(False))
    per = runs.groupBy("portal").agg(
        F.max("id").alias("last_id"), F.max_by(ok, "id").alias("last_ok"), F.max_by("finished", "id").alias("last_attempt"),
        F.max(F.when(ok, F.col("finished"))).alias("last_success"), F.max(F.when(F.coalesce(F.col("changed"), F.lit(0)) > 0, F.col("finished"))).alias("last_change"),
    )
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp("last_success")) / 60)
    state = F.when(~F.col("last_ok"), "failed").when(F.col("last_success").isNull(), "unknown").when(age > stale_minutes, "stale").otherwise("up_to_date")
    return per.withColumns({"age_minutes": age, "state": state, "next_run": F.col("last_attempt") + F.expr(f"INTERVAL {every_minutes} MINUTES")})


def overall(health: DataFrame) -> DataFrame:
    """One row: unknown without portals, failed if all failed, partial if some did, stale if any is, else up_to_date."""
    n, failed, stale = F.count("*"), F.count_if(F.col("state") == "failed"), F.count_if(F.col("state").isin("stale", "unknown"))
    state = F.when(n == 0, "unknown").when(failed == n, "failed").when(failed > 0, "partial").when(stale > 0, "stale").otherwise("up_to_date")
    return health.agg(n.alias("n_portals"), failed.alias("n_failed"), stale.alias("n_stale"), state.alias("state"))


def relative_age(seconds: Column) -> Column:
    """'just now', 'n minutes ago' ... 'n days ago'; NULL stays NULL."""
    unit = lambda size, name: F.concat(F.floor(seconds / size).cast("string"), F.lit(f" {name}"), F.when(F.floor(seconds / size) == 1, "").otherwise("s"), F.lit(" ago"))
    return F.when(seconds < 60, "just now").when(seconds < 3600, unit(60, "minute")).when(seconds < 86400, unit(3600, "hour")).when(seconds.isNotNull(), unit(86400, "day"))
