"""Labels at three levels: gates, outcomes and pairs within a family."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gate_transitions(cens: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """A row for each gate 0 .. min(max_stage, 7) that a target came to; gates beyond are not attempts. Without targets, cens has their columns."""
    j = cens.where("max_stage IS NOT NULL").select("target_id", "centre", "max_stage", "censored", *(["seq_md5", "organism"] if targets is None else []))
    j = j.join(targets.select("target_id", "seq_md5", "organism"), "target_id") if targets is not None else j
    j = j.withColumn("gate", F.explode(F.sequence(F.lit(0), F.least("max_stage", F.lit(7)))))
    passed = F.col("max_stage") > F.col("gate")
    return j.withColumns({"label": F.when(passed, "cleared").when(F.col("censored"), "censored").otherwise("failed"), "in_loss": passed | ~F.col("censored")})


def outcomes(cens: DataFrame) -> DataFrame:
    top = F.col("max_stage") >= 8
    out = F.when(top, "deposited").otherwise(F.concat(F.lit("stalled_at_"), F.col("max_stage").cast("string")))
    return cens.where("NOT censored AND max_stage IS NOT NULL").select("target_id", "centre", "max_stage", out.alias("outcome"), top.alias("deposited"))


def _first(m: DataFrame, by: list[str], k: int) -> DataFrame:
    return m.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("target_id"))).where(F.col("_k") <= k).drop("_k")


def pairs(cens: DataFrame, targets: DataFrame, cap: int) -> DataFrame:
    """Pairs of a family whose stages differ by two or more; at most cap for each family, close relatives and wide gaps first.

    Targets of one close family and stage have the same partners, so a pair of the first cap holds only the
    cap smallest ids of these; for distant pairs twice cap of a stage are enough, cap of each close family at
    most. Both joins are therefore bounded for every family, and the result is that of all pairs."""
    m = cens.where("NOT censored AND max_stage IS NOT NULL").select("target_id", "centre", "max_stage").join(targets.select("target_id", "cluster30", "cluster70"), "target_id")
    near = _first(m, ["cluster30", "cluster70", "max_stage"], cap)
    far = _first(near, ["cluster30", "max_stage"], 2 * cap)
    same = F.col("a.cluster70") == F.col("b.cluster70")

    def join(x: DataFrame, hard: bool) -> DataFrame:
        which = same if hard else ~F.coalesce(same, F.lit(False))
        j = x.alias("a").join(x.alias("b"), (F.col("a.cluster30") == F.col("b.cluster30")) & (F.col("a.max_stage") > F.col("b.max_stage") + 1) & which)
        return j.select(
            F.col("a.cluster30").alias("cluster_id"), F.col("a.target_id").alias("chosen_id"), F.col("b.target_id").alias("rejected_id"),
            F.col("a.max_stage").alias("chosen_stage"), F.col("b.max_stage").alias("rejected_stage"), (F.col("a.max_stage") - F.col("b.max_stage")).alias("stage_gap"),
            F.lit(hard).alias("hard"), (F.col("a.centre") != F.col("b.centre")).alias("cross_centre"),
        )

    w = Window.partitionBy("cluster_id").orderBy(F.desc("hard"), F.desc("stage_gap"), "chosen_id", "rejected_id")
    return join(near, True).union(join(far, False)).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap).drop("rn")


def label_report(l1: DataFrame) -> DataFrame:
    n = lambda x: F.count_if(F.col("label") == x).alias(f"n_{x}")
    bad = F.count_if((F.col("gate") > F.col("max_stage")) | (F.col("in_loss") & (F.col("label") == "censored"))).alias("n_violations")
    return l1.groupBy("gate").agg(F.count(F.lit(1)).alias("n"), n("cleared"), n("failed"), n("censored"), bad)
