"""Splits that keep families whole, by time, and by centre."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagewise.bridge import Config

RATIOS = {"train": 0.8, "valid": 0.1, "test": 0.1}
NAMES = ("test", "train", "valid")


def assign_clusters(sizes) -> dict:
    """Largest cluster first, each to the split that lacks most of its quota (ties: the later name)."""
    sizes = sorted(sizes, key=lambda x: (-x[1], x[0]))
    lack = {k: r * sum(n for _, n in sizes) for k, r in RATIOS.items()}
    out = {}
    for cluster, n in sizes:
        pick = max(lack, key=lambda k: (lack[k], k))
        out[cluster] = pick
        lack[pick] -= n
    return out


def assign(sizes: np.ndarray) -> np.ndarray:
    """The place in NAMES of each cluster's split, by the rule of assign_clusters; sizes fall."""
    total, out = int(sizes.sum()), bytearray(len(sizes))
    test, train, valid = (RATIOS[k] * total for k in NAMES)
    for k, n in enumerate(sizes.tolist()):
        if valid >= train and valid >= test:
            valid -= n
            out[k] = 2
        elif train >= test:
            train -= n
            out[k] = 1
        else:
            test -= n
    return np.frombuffer(out, np.int8)


def cluster_split(targets: DataFrame) -> DataFrame:
    """(cluster_id, split_cluster). The rule is sequential over clusters: their sizes, not their members, come to the driver, as columns."""
    got = targets.groupBy("cluster30").count().toArrow()
    ids, sizes = got["cluster30"].to_numpy(), got["count"].to_numpy()
    order = np.lexsort((ids, -sizes))
    table = pa.table({"cluster_id": ids[order].astype(np.int64), "k": assign(sizes[order])})
    name = F.element_at(F.array(*map(F.lit, NAMES)), F.col("k").cast("int") + 1)
    return targets.sparkSession.createDataFrame(table).select("cluster_id", name.alias("split_cluster"))


def build(cens: DataFrame, targets: DataFrame, clean: DataFrame, cfg: Config) -> DataFrame:
    first = clean.groupBy("target_id").agg(F.min("d").alias("first_event"))
    j = cens.select("target_id", "centre", "max_stage", "censored", F.col("last_any").alias("last_event"))
    j = j.join(targets.select("target_id", F.col("cluster30").alias("cluster_id"), "cluster70", "seq_md5"), "target_id").join(first, "target_id").join(cluster_split(targets), "cluster_id")
    return timed(j, cfg)


def timed(j: DataFrame, cfg: Config) -> DataFrame:
    """j (first_event, last_event, centre) with the split by time and whether its centre is held out."""
    temporal = F.when(F.col("last_event") < F.lit(cfg.boundary), "train").when(F.col("first_event") >= F.lit(cfg.boundary), "test").otherwise("straddles")
    return j.withColumns({"split_temporal": temporal, "loco_eligible": F.col("centre").isin(*cfg.held_out_centres)})


def leaks(splits: DataFrame) -> DataFrame:
    """How many clusters and sequences lie in more than one split."""
    one = lambda key: splits.groupBy(key).agg(F.countDistinct("split_cluster").alias("k")).where("k > 1").agg(F.count(F.lit(1)).alias("n_leaks")).select(F.lit(key).alias("key"), "n_leaks")
    return one("cluster_id").union(one("seq_md5"))


def drift(splits: DataFrame) -> DataFrame:
    """Rows and share of each split."""
    n = splits.groupBy("split_cluster").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))  # three rows
