"""Peer statistics without the row's own contribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _gates():
    return F.explode(F.sequence(F.lit(0), F.lit(7)))


def pool(splits: DataFrame) -> DataFrame:
    return splits.withColumn("eligible", (F.col("split_cluster") == "train") & ~F.col("censored"))


def profiles(pooled: DataFrame) -> DataFrame:
    """pooled with the counts of its family, from one join by cluster_id: entered and cleared (a list by gate), n_train, n_unc, n_cens, n_dep and n70 (null
    without a close family). A close family lies within one family and has few in it, so its counts travel as a map."""
    train = F.col("split_cluster") == "train"
    counts = {"n_train": train, "n_unc": F.col("eligible"), "n_cens": train & F.col("censored"), "n_dep": F.col("eligible") & (F.col("max_stage") >= 8)}
    counts |= {f"entered_{g}": F.col("eligible") & (F.col("max_stage") >= g) for g in range(8)} | {f"cleared_{g}": F.col("eligible") & (F.col("max_stage") > g) for g in range(8)}
    close = pooled.groupBy("cluster_id", "cluster70").agg(*[F.count_if(c).alias(k) for k, c in counts.items()])
    by = F.map_from_entries(F.collect_list(F.when(F.col("cluster70").isNotNull(), F.struct("cluster70", "n_unc")))).alias("close")
    family = close.groupBy("cluster_id").agg(by, *[F.sum(k).alias(k) for k in counts])
    lists = [F.array(*[F.col(f"{x}_{g}") for g in range(8)]).alias(x) for x in ("entered", "cleared")]
    family = family.select("cluster_id", *lists, "n_train", "n_unc", "n_cens", "n_dep", "close")
    return pooled.join(family, "cluster_id").withColumn("n70", F.try_element_at("close", F.col("cluster70"))).drop("close")


def gates_of(profile: DataFrame, *keep: str) -> DataFrame:
    """What gate_context gives, from rows of profiles, with the columns `keep`: a row becomes eight, nothing is joined or moved."""
    at = lambda c: F.get(c, F.col("gate"))
    own = lambda cond: F.when(F.col("eligible") & cond, 1).otherwise(0)
    j = profile.withColumn("gate", _gates())
    n = at("entered") - own(F.col("max_stage") >= F.col("gate"))
    k = at("cleared") - own(F.col("max_stage") > F.col("gate"))
    j = j.select("target_id", "gate", n.alias("n_precedents"), k.alias("n_precedents_cleared"), *keep)
    n, k = F.col("n_precedents"), F.col("n_precedents_cleared")
    return j.select("target_id", "gate", n, k, F.when(n > 0, F.round(k.cast("double") / n, 6)).alias("cluster_base_rate"), *keep)


def summary_of(profile: DataFrame) -> DataFrame:
    """What cluster_summary gives, from rows of profiles: all their columns and the summary's."""
    own = F.when(F.col("eligible"), 1).otherwise(0)
    j = profile.where("n70 IS NOT NULL").withColumns({
        "n_cluster_precedents": F.col("n_unc") - own, "n_close_precedents": F.col("n70") - own,
        "cluster_censored_frac": F.when(F.col("n_train") > 0, F.round(F.col("n_cens").cast("double") / F.col("n_train"), 6)),
        "dep": F.col("n_dep") - F.when(F.col("eligible") & (F.col("max_stage") >= 8), 1).otherwise(0),
    })
    return summed_up(j)


def gate_totals(pooled: DataFrame) -> DataFrame:
    x = pooled.where("eligible").select("cluster_id", "max_stage", _gates().alias("gate"))
    return x.groupBy("cluster_id", "gate").agg(F.count_if(F.col("max_stage") >= F.col("gate")).alias("entered"), F.count_if(F.col("max_stage") > F.col("gate")).alias("cleared"))


def gate_context(pooled: DataFrame) -> DataFrame:
    """n_precedents, n_precedents_cleared and their rate (null without precedents) of each (target, gate)."""
    j = pooled.withColumn("gate", _gates()).join(gate_totals(pooled), ["cluster_id", "gate"], "left")
    own = lambda cond: F.when(F.col("eligible") & cond, 1).otherwise(0)
    n = F.coalesce(F.col("entered") - own(F.col("max_stage") >= F.col("gate")), F.lit(0))
    k = F.coalesce(F.col("cleared") - own(F.col("max_stage") > F.col("gate")), F.lit(0))
    return j.select("target_id", "gate", n.alias("n_precedents"), k.alias("n_precedents_cleared"), F.when(n > 0, F.round(k.cast("double") / n, 6)).alias("cluster_base_rate"))


def cluster_summary(pooled: DataFrame) -> DataFrame:
    train = F.col("split_cluster") == "train"
    family = pooled.groupBy("cluster_id").agg(
        F.count_if(train).alias("n_train"), F.count_if("eligible").alias("n_unc"), F.count_if(train & F.col("censored")).alias("n_cens"), F.count_if(F.col("eligible") & (F.col("max_stage") >= 8)).alias("n_dep")
    )
    close = pooled.groupBy("cluster70").agg(F.count_if("eligible").alias("n70"))
    own = F.when(F.col("eligible"), 1).otherwise(0)
    j = pooled.join(family, "cluster_id").join(close, "cluster70").select(
        "target_id", "cluster_id", "cluster70", (F.col("n_unc") - own).alias("n_cluster_precedents"), (F.col("n70") - own).alias("n_close_precedents"),
        F.when(F.col("n_train") > 0, F.round(F.col("n_cens").cast("double") / F.col("n_train"), 6)).alias("cluster_censored_frac"),
        (F.col("n_dep") - F.when(F.col("eligible") & (F.col("max_stage") >= 8), 1).otherwise(0)).alias("dep"),
    )
    return summed_up(j)


SUMMARY = ("target_id", "cluster_id", "cluster70", "n_cluster_precedents", "n_close_precedents", "cluster_censored_frac", "dep", "cluster_deposit_rate", "closest_identity_band", "strength")


def summed_up(j: DataFrame) -> DataFrame:
    n, close_n = F.col("n_cluster_precedents"), F.col("n_close_precedents")
    return j.withColumns({
        "cluster_deposit_rate": F.when(n > 0, F.round(F.col("dep").cast("double") / n, 6)),
        "closest_identity_band": F.when(close_n > 0, 0.7).when(n > 0, 0.3).otherwise(0.0),
        "strength": strength(n, close_n),
    })


def strength(n, n_close):
    return F.when((n >= 20) & (n_close >= 3), "STRONG").when(n >= 5, "MODERATE").when(n >= 1, "WEAK").otherwise("NONE")
