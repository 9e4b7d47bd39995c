"""Models of the attrition frame and what is asked of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise.operators import context as X
from stagewise.operators import model as B
from stagewise.plans.model import Model
from stagewise.session import stored

CONTEXT = ("seq_len", "n_cluster_precedents", "n_close_precedents", "closest_identity_band", "cluster_censored_frac", "cluster_deposit_rate", "n_precedents", "n_precedents_cleared", "cluster_base_rate")
HEADLINE = B.Spec(CONTEXT, ("centre", "organism"), iterations=8, depth=4)
DECLARED = B.Spec((*CONTEXT, "cold_shock"), ("centre", "organism", "host", "tag"), iterations=8, depth=4)
LEVERS = [("host", "ecoli"), ("host", "cell_free"), ("host", "insect"), ("tag", "his"), ("tag", "mbp"), ("cold_shock", 1.0)]


def _protocol(m: Model) -> DataFrame:
    protocol = m.trials.groupBy("target_id").agg(F.min("size").alias("size"), F.min("kind").alias("kind"))
    host = F.when(F.col("size") % 3 == 0, "ecoli").when(F.col("size") % 3 == 1, "cell_free").otherwise("insect")
    tag = F.when(F.col("kind").contains("STEEL"), "mbp").when(F.col("kind").contains("BRASS"), "his").otherwise("")
    return protocol.select("target_id", host.alias("host"), tag.alias("tag"), (F.col("size") % 5 == 0).alias("cold_shock"))


def _label(stage: Column, censored: Column, gate: Column) -> tuple[Column, Column]:
    """in_loss and y of a gate; null where it was not tried."""
    tried = stage >= gate  # null: its stage is not known
    return F.when(tried, (stage > gate) | ~censored).alias("in_loss"), F.when(tried, (stage > gate).cast("double")).alias("y")


KEEP = ("n_cluster_precedents", "n_close_precedents", "cluster_censored_frac", "cluster_deposit_rate", "closest_identity_band", "centre", "organism", "seq_len", "cluster_id", "split_cluster", "split_temporal")


def frame(m: Model) -> DataFrame:
    """The grid of every target and gate with features, split and label (null where the gate was not tried)."""
    if m.facts is None:
        return joined_frame(m)
    g = X.gates_of(X.summary_of(m.profile), *KEEP, "max_stage", "censored")
    return g.select("*", *_label(F.col("max_stage"), F.col("censored"), F.col("gate"))).drop("max_stage", "censored")


def joined_frame(m: Model) -> DataFrame:
    """frame with the protocol, joined by target and gate: for targets of repeated ids."""
    protocol = _protocol(m)
    g = m.context.join(m.cluster_features.drop("cluster_id", "cluster70"), "target_id").join(m.targets.select("target_id", "centre", "organism", "seq_len"), "target_id")
    g = g.join(m.splits.select("target_id", "cluster_id", "split_cluster", "split_temporal"), "target_id").join(protocol, "target_id", "left")
    lab = m.labels_l1.select("target_id", "gate", "in_loss", (F.col("label") == "cleared").cast("double").alias("y"))
    return g.join(lab, ["target_id", "gate"], "left")


def grid(m: Model, spec: B.Spec) -> DataFrame | B.ByGate:
    """The grid for models: a row for each target is stored, with two numbers for each gate, and a gate's rows are made from it as they are read."""
    columns = ("target_id", "gate", "cluster_id", "split_cluster", "split_temporal", "in_loss", "y", *spec.numeric, *[f"{c}_missing" for c in spec.numeric], *spec.categorical)
    if m.facts is None:
        return stored(B.typed(joined_frame(m), spec).select(*columns), "grid")
    p = X.summary_of(m.profile)
    declared = [c for c in ("host", "tag", "cold_shock") if c in (*spec.numeric, *spec.categorical)]
    p = p.join(_protocol(m), "target_id", "left") if declared else p
    own = lambda cond: F.when(F.col("eligible") & cond, 1).otherwise(0)
    n = [(F.get("entered", F.lit(g)) - own(F.col("max_stage") >= g)).alias(f"n_{g}") for g in range(8)] + [(F.get("cleared", F.lit(g)) - own(F.col("max_stage") > g)).alias(f"k_{g}") for g in range(8)]
    rows = stored(p.select("target_id", *KEEP, *declared, "max_stage", "censored", *n), "grid")

    def at(gate: int) -> DataFrame:
        n, k, g = F.col(f"n_{gate}"), F.col(f"k_{gate}"), F.lit(gate)
        one = rows.select("*", g.alias("gate"), n.alias("n_precedents"), k.alias("n_precedents_cleared"), F.when(n > 0, F.round(k.cast("double") / n, 6)).alias("cluster_base_rate"), *_label(F.col("max_stage"), F.col("censored"), g))
        return B.typed(one, spec).select(*columns)

    return B.ByGate(at)


def held_out(m: Model) -> DataFrame:
    g = grid(m, HEADLINE)
    models = B.fit_gates(g.where("in_loss AND split_cluster = 'train'"), HEADLINE)
    return B.quality(B.score(models, g.where("in_loss AND split_cluster = 'test'")))


def temporal(m: Model) -> DataFrame:
    g = grid(m, HEADLINE)
    models = B.fit_gates(g.where("in_loss AND split_temporal = 'train'"), HEADLINE)
    return B.score(models, g.where("split_temporal = 'test'")).select("target_id", "gate", "p")


def out_of_fold(m: Model) -> DataFrame:
    g = grid(m, B.Spec(CONTEXT, ("centre", "organism"), iterations=3, depth=3))
    spec = B.Spec(CONTEXT, ("centre", "organism"), iterations=3, depth=3)
    return B.out_of_fold(g.where("in_loss AND split_cluster = 'train'"), g.where("NOT (coalesce(in_loss, false) AND split_cluster = 'train')"), spec, "cluster_id", 3).select("target_id", "gate", "p")


def category_levels(m: Model) -> DataFrame:
    g = B.typed(frame(m), HEADLINE).where("in_loss AND split_cluster = 'train'")
    return m.spark.createDataFrame(B.levels(B.indexer(g, HEADLINE)), "feature string, position int, level string")


def feature_gain(m: Model) -> DataFrame:
    models = B.fit_gates(grid(m, HEADLINE).where("in_loss AND split_cluster = 'train'"), HEADLINE)
    return m.spark.createDataFrame(B.importance(models, HEADLINE), "feature string, gain double")


def levers(m: Model) -> DataFrame:
    g = grid(m, DECLARED)
    models = B.fit_gates(g.where("in_loss AND split_cluster = 'train'"), DECLARED)
    return B.counterfactuals(models, g.where("split_cluster = 'test'").drop("in_loss", "y"), "target_id", LEVERS)


def blocks(m: Model) -> DataFrame:
    return m.spark.createDataFrame([(b, f) for b, fs in B.BLOCKS.items() for f in fs], "block string, feature string")


def typed(m: Model) -> DataFrame:
    g = m.context.join(m.targets.select("target_id", "centre"), "target_id") if m.facts is None else X.gates_of(m.profile, "centre")
    return B.typed(g, B.Spec(("cluster_base_rate", "n_precedents"), ("centre",))).select("target_id", "gate", "centre", "cluster_base_rate", "cluster_base_rate_missing", "n_precedents")


_VALUES = ", ".join(f"('{b}', '{f}')" for b, fs in B.BLOCKS.items() for f in fs)
_LEVEL = lambda c, t: f"SELECT '{c}' AS feature, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS position, v AS level FROM (SELECT DISTINCT {t}.{c} AS v FROM labels_l1 l JOIN splits s USING (target_id) JOIN targets t ON t.target_id = l.target_id WHERE l.in_loss AND s.split_cluster = 'train')"
CORE = {
    "b2_feature_blocks": (blocks, f"SELECT col0 AS block, col1 AS feature FROM (VALUES {_VALUES})"),
    "b4_category_levels": (category_levels, f"{_LEVEL('centre', 't')} UNION ALL {_LEVEL('organism', 't')}"),
    "b13_typed_frame": (typed, "SELECT c.target_id, c.gate, t.centre, coalesce(c.cluster_base_rate, -1.0::DOUBLE) AS cluster_base_rate, CASE WHEN c.cluster_base_rate IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cluster_base_rate_missing, CAST(c.n_precedents AS DOUBLE) AS n_precedents FROM context c JOIN targets t USING (target_id)"),
}
#: Models have no SQL; tests hold their parts against plain Python.
FITTED = {"b3_gate_models": held_out, "b5_out_of_fold": out_of_fold, "b7_counterfactuals": levers, "b11_importance": feature_gain, "b14_temporal_scores": temporal}
