"""Right-censoring: which stops are no evidence of failure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagewise.bridge import Config
from stagewise.operators.status import method, methods


def clean_dates(canon: DataFrame, cfg: Config) -> DataFrame:
    """canon with d: status_date if it lies in the archive's time, else null (never moved to a bound)."""
    return canon.withColumn("d", F.when(F.col("status_date").between(F.lit(cfg.valid_from), F.lit(cfg.freeze)), F.col("status_date")))


def _last() -> list[Column]:
    return [
        F.max("d").alias("last_any"),
        F.max(F.when(F.col("stage_ord").isNotNull(), F.col("d"))).alias("last_ladder"),
        F.max(F.when(F.col("status_canon") == "work_stopped", F.col("d"))).alias("stop_date"),
    ]


def activity(clean: DataFrame) -> DataFrame:
    """Last activity, last ladder event, last stop and unusable dates of each target."""
    return clean.groupBy("target_id", "centre").agg(*_last(), F.count_if(F.col("d").isNull()).alias("n_bad_dates"))


def rollup(clean: DataFrame) -> DataFrame:
    """Stage, method, last dates and first date of each target_id in one aggregate."""
    out = clean.groupBy("target_id").agg(F.max("stage_ord").alias("max_stage"), *methods(), *_last(), F.min("d").alias("first_event"))
    return out.withColumn("method", method()).drop("any_xray", "any_nmr", "any_em")


def wind_down(act: DataFrame, cfg: Config) -> DataFrame:
    """The date by which nearly all targets of a centre had their last activity (exact quantile of day numbers, counted by distinct day)."""
    days = act.where("last_any IS NOT NULL").groupBy("centre", "last_any").agg(F.count(F.lit(1)).alias("n"))
    at = F.percentile(F.unix_date("last_any").cast("double"), F.lit(cfg.quantile), F.col("n"))
    return days.groupBy("centre").agg(F.date_from_unix_date(F.floor(at).cast("int")).alias("wind_down"))


def bulk_dates(act: DataFrame, cfg: Config) -> DataFrame:
    """(centre, d) on which so many targets stopped that it looks like an administrative closure."""
    stops = act.where("stop_date IS NOT NULL").groupBy("centre", F.col("stop_date").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    stops = stops.withColumn("total", F.sum("n").over(Window.partitionBy("centre")))
    pct = F.lit(100.0) * F.col("n") / F.col("total")
    return stops.where((F.col("n") >= cfg.bulk_min_targets) & (pct >= cfg.bulk_min_pct) & F.lit(cfg.bulk_enabled)).withColumn("pct", F.round(pct, 2))


def censor(targets: DataFrame, stage: DataFrame, act: DataFrame, cfg: Config) -> DataFrame:
    """One row for each target: both rules, the combined flag and the reason."""
    j = targets.select("target_id", "centre").join(stage.select("target_id", "max_stage", "method"), "target_id").join(act.drop("centre", "n_bad_dates"), "target_id", "left")
    return judged(j, act, cfg)


def judged(j: DataFrame, act: DataFrame, cfg: Config) -> DataFrame:
    """j (centre, max_stage, last_any, stop_date) with both rules, the combined flag and the reason."""
    j = j.join(F.broadcast(wind_down(act, cfg)), "centre", "left")  # a row for each centre
    bulk = bulk_dates(act, cfg).select(F.col("centre").alias("b_centre"), F.col("d").alias("b_d"), F.col("n").alias("bulk_closure_size"))
    bulk = F.broadcast(bulk) if cfg.bulk_min_pct >= 1 else bulk  # a date has that share of a centre, so a centre has a hundred at most
    j = j.join(bulk, (F.col("centre") == F.col("b_centre")) & (F.col("stop_date") == F.col("b_d")), "left")
    below = F.coalesce("max_stage", F.lit(-1)) < 8
    late = F.datediff("wind_down", "last_any") < cfg.window_days
    if cfg.freeze_window:
        late = late | (F.datediff(F.lit(cfg.freeze), "last_any") < cfg.window_days)
    j = j.withColumns({"reached_top_gate": ~below, "by_winddown": F.coalesce(below & F.col("last_any").isNotNull() & late, F.lit(False)), "by_bulk": below & F.col("b_d").isNotNull()})
    a, b = F.col("by_winddown"), F.col("by_bulk")
    reason = F.when(a & b, "both").when(b, "bulk_closure").when(a, "centre_winddown").otherwise("")
    return j.drop("b_centre", "b_d").withColumns({"censored": a | b, "censored_reason": reason})


def acceptance(cens: DataFrame, low: float = 12.0, high: float = 22.0) -> DataFrame:
    pct = F.round(F.avg(F.when(F.col("censored"), 100.0).otherwise(0.0)), 2)
    return cens.agg(pct.alias("censored_pct")).withColumn("passed", F.col("censored_pct").between(low, high))


def report(cens: DataFrame, by: str) -> DataFrame:
    """Targets, censored targets and their share for each value of a column."""
    share = F.round(F.avg(F.when(F.col("censored"), 100.0).otherwise(0.0)), 2)
    return cens.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if("censored").alias("n_censored"), share.alias("censored_pct"))
