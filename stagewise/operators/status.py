"""Canonical statuses and the stage rollup of each target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonicalise(events: DataFrame, status_map: DataFrame) -> DataFrame:
    """events with status_canon, stage_ord, method and terminal; unmapped raw values keep nulls. The vocabulary is a few dozen rows."""
    return events.join(F.broadcast(status_map), "status_raw", "left")


def unmapped(events: DataFrame, status_map: DataFrame) -> DataFrame:
    """Raw values without a mapping and how often they occur: never a silent null."""
    counts = events.groupBy("status_raw").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(status_map), "status_raw", "left_anti")


def methods() -> list[Column]:
    return [F.max(F.when(F.col("method") == m, 1).otherwise(0)).alias(f"any_{m}") for m in ("xray", "nmr", "em")]


def method() -> Column:
    return F.when(F.col("any_xray") == 1, "xray").when(F.col("any_nmr") == 1, "nmr").when(F.col("any_em") == 1, "em").otherwise("none")


def target_stage(canon: DataFrame) -> DataFrame:
    """One row for each (target_id, centre): how far it got, when, by which method."""
    out = canon.groupBy("target_id", "centre").agg(
        F.max("stage_ord").alias("max_stage"), F.count(F.lit(1)).alias("n_events"), F.count("stage_ord").alias("n_ladder_events"),
        F.min("status_date").alias("first_event"), F.max("status_date").alias("last_event"), F.bool_or("terminal").alias("stopped"),
        *methods(), F.countDistinct("trial_id").alias("n_trials"), F.count_if(F.col("status_canon").isNull()).alias("n_unmapped"),
    )
    return out.withColumn("method", method())
