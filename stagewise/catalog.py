"""Every registered query of the library and the SQL that it is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagewise.bridge import DUCK_CTE
from stagewise.functions.sequence import intervals, sequence_features
from stagewise.operators import censoring, labels, relatives, similarity, splits, status
from stagewise.plans import domain, files, portable, training
from stagewise.plans.model import FIRST, Model

SHARED, DUAL = portable.SHARED | domain.SHARED, portable.DUAL | domain.DUAL

#: query -> (what of the model, its SQL over DUCK_CTE)
CORE: dict[str, tuple[Callable[[Model], DataFrame], str]] = {
    "s1_parquet_scan": (lambda m: m.table("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem"),
    "s15_vocabulary": (lambda m: m.status_map, "SELECT * FROM status_map"),
    "s16_unmapped_report": (lambda m: status.unmapped(m.events, m.status_map), "SELECT status_raw, count(*) AS n FROM canon WHERE status_canon IS NULL GROUP BY status_raw"),
    "c1_canonicalise": (lambda m: m.canon, "SELECT * FROM canon"),
    "a1_target_stage": (lambda m: m.target_stage, "SELECT * FROM target_stage"),
    "c2_date_hygiene": (lambda m: m.clean.select("target_id", "trial_id", "d"), "SELECT target_id, trial_id, d FROM clean"),
    "c3_activity": (lambda m: m.activity, "SELECT * FROM activity"),
    "a3_quantile_date": (lambda m: m.wind_down, "SELECT * FROM wind_down"),
    "c4_winddown": (lambda m: m.censoring.select("target_id", "wind_down", "by_winddown"), "SELECT target_id, wind_down, by_winddown FROM censoring"),
    "a4_share_of_group": (lambda m: m.bulk_dates, "SELECT * FROM bulk_dates"),
    "c5_bulk_closure": (lambda m: m.censoring.select("target_id", "bulk_closure_size", "by_bulk"), "SELECT target_id, bulk_closure_size, by_bulk FROM censoring"),
    "c6_censoring": (lambda m: m.censoring, "SELECT * FROM censoring"),
    "c7_acceptance": (
        lambda m: censoring.acceptance(m.censoring),
        "SELECT pct AS censored_pct, pct BETWEEN 12 AND 22 AS passed FROM (SELECT round(avg(CASE WHEN censored THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END), 2) AS pct FROM censoring)",
    ),
    "c8_report_by_centre": (
        lambda m: censoring.report(m.censoring, "centre"),
        "SELECT centre, count(*) AS n, count(*) FILTER (WHERE censored) AS n_censored, round(avg(CASE WHEN censored THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END), 2) AS censored_pct FROM censoring GROUP BY centre",
    ),
    "l1_gate_transitions": (lambda m: m.labels_l1, "SELECT * FROM labels_l1"),
    "l2_outcomes": (lambda m: m.labels_l2, "SELECT * FROM labels_l2"),
    "l3_preference_pairs": (lambda m: m.labels_l3, "SELECT * FROM labels_l3"),
    "w1_row_number_cap": (lambda m: labels.pairs(m.censoring, m.targets, 3), "SELECT * FROM labels_l3 QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY hard DESC, stage_gap DESC, chosen_id, rejected_id) <= 3"),
    "l4_label_report": (
        lambda m: labels.label_report(m.labels_l1),
        "SELECT gate, count(*) AS n, count(*) FILTER (WHERE label = 'cleared') AS n_cleared, count(*) FILTER (WHERE label = 'failed') AS n_failed, count(*) FILTER (WHERE label = 'censored') AS n_censored, count(*) FILTER (WHERE gate > max_stage OR in_loss AND label = 'censored') AS n_violations FROM labels_l1 GROUP BY gate",
    ),
    "d1_cluster_split": (lambda m: splits.cluster_split(m.targets), "SELECT cluster_id, split AS split_cluster FROM greedy WHERE cluster_id IS NOT NULL"),
    "d2_splits": (lambda m: m.splits, "SELECT * FROM splits"),
    "d4_leak_check": (lambda m: splits.leaks(m.splits), " UNION ALL ".join(f"SELECT '{k}' AS key, count(*) AS n_leaks FROM (SELECT {k} FROM splits WHERE {k} IS NOT NULL GROUP BY {k} HAVING min(split_cluster) <> max(split_cluster))" for k in ("cluster_id", "seq_md5"))),
    "d4_drift": (lambda m: splits.drift(m.splits), "SELECT split_cluster, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM splits), 2) AS pct FROM splits GROUP BY split_cluster"),
    "t3_relatives_top": (
        lambda m: relatives.first_relatives(m.splits.withColumn("low", F.when(F.col("max_stage") < 4, 1).otherwise(0)), "cluster_id", "target_id", [F.col("censored"), F.col("low"), F.desc_nulls_last("max_stage"), F.col("target_id")], 6, []).select(F.col("query").alias("target_id"), F.col("target_id").alias("relative_id"), "rn"),
        """SELECT target_id, relative_id, CAST(rn AS INTEGER) AS rn FROM (SELECT a.target_id, b.target_id AS relative_id, row_number() OVER (PARTITION BY a.target_id
        ORDER BY b.censored, CASE WHEN b.max_stage < 4 THEN 1 ELSE 0 END, b.max_stage DESC NULLS LAST, b.target_id) AS rn
        FROM splits a JOIN splits b ON a.cluster_id = b.cluster_id AND a.target_id <> b.target_id) WHERE rn <= 6""",
    ),
    "t3_relatives_informative": (
        lambda m: relatives.informative(m.splits, m.trials),
        """SELECT r.target_id, r.relative_id, CAST(r.rn AS INTEGER) AS rn, t.trials FROM (SELECT a.target_id, b.target_id AS relative_id, row_number() OVER (PARTITION BY a.target_id
        ORDER BY b.censored, coalesce(b.max_stage, -1) DESC, CASE WHEN a.cluster70 = b.cluster70 THEN 0 ELSE 1 END, b.target_id) AS rn
        FROM splits a JOIN splits b ON a.cluster_id = b.cluster_id AND a.target_id <> b.target_id) r
        LEFT JOIN (SELECT target_id, list_sort(list(DISTINCT trial_id))[1:3] AS trials FROM trials GROUP BY target_id) t ON t.target_id = r.relative_id WHERE r.rn <= 6""",
    ),
    "g3_precedent_list": (
        lambda m: relatives.precedents(m.splits),
        "SELECT query_id AS target_id, list(target_id ORDER BY rn) AS precedents FROM relatives WHERE rn <= 8 GROUP BY query_id",
    ),
    "j12_retrieved_hits": (lambda m: m.relatives, "SELECT * FROM relatives"),
    "j14_similarity_join": (
        lambda m: similarity.similar_pairs(m.table("embeddings")),
        """SELECT q.vec_id AS query_id, t.vec_id AS target_id, round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[])), 6) AS identity
        FROM embeddings q JOIN embeddings t ON q.vec_id <> t.vec_id WHERE list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[])) >= 0.3::DOUBLE""",
    ),
    "j14_similarity_join_all": (
        lambda m: similarity.similar_pairs(m.table("embeddings")),
        """SELECT q.vec_id AS query_id, t.vec_id AS target_id, round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[])), 6) AS identity
        FROM embeddings q JOIN embeddings t ON q.vec_id <> t.vec_id WHERE list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[])) >= 0.3::DOUBLE""",
    ),
    "x1_pool": (lambda m: m.pooled.select("target_id", "cluster_id", "cluster70", "eligible"), "SELECT target_id, cluster_id, cluster70, eligible FROM pooled"),
    "x3_leave_one_out": (lambda m: m.context.select("target_id", "gate", "n_precedents", "n_precedents_cleared"), "SELECT target_id, gate, n_precedents, n_precedents_cleared FROM context"),
    "x4_base_rate": (lambda m: m.context, "SELECT * FROM context"),
    "x5_cluster_summary": (lambda m: m.cluster_features, "SELECT * FROM cluster_features"),
}

CORE |= files.CORE | training.CORE

_NAME = re.compile(r"\{([A-Za-z_]\w*)\}")


def model_of(spark: SparkSession, sf_dir: str) -> Model:
    """A new model for each query, so that none sees another's stored tables."""
    return Model(spark, sf_dir)


def _portable(text: str) -> Callable[[SparkSession, str], DataFrame]:
    names = sorted(set(_NAME.findall(text)), key=lambda n: (n not in FIRST, n == "targets", n))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = model_of(spark, sf_dir)
        return spark.sql(text, **{n: getattr(m, n) if hasattr(Model, n) else m.table(n) for n in names})

    return run


def _core(make: Callable[[Model], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: make(model_of(spark, sf_dir))


def _duck(text: str) -> str:
    return DUCK_CTE + _NAME.sub(lambda m: "events_b" if m[1] == "events" else m[1], text)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: _core(f) for k, (f, _) in CORE.items()}
QUERIES |= {k: _portable(t) for k, t in SHARED.items()} | {k: _portable(t) for k, (t, _) in DUAL.items()}
QUERIES |= {k: _portable(t) for k, t in domain.WHOLE.items()}
ORACLE_SQL: dict[str, str] = {k: DUCK_CTE + t for k, (_, t) in CORE.items()}
ORACLE_SQL |= {k: _duck(t) for k, t in SHARED.items()} | {k: DUCK_CTE + t for k, (_, t) in DUAL.items()}


#: Beyond SQL: tests hold these against plain Python.
QUERIES["m17_sequence_features"] = _core(lambda m: sequence_features(m.table("documents").selectExpr("doc_id", "upper(text) AS s"), "doc_id", "s"))
QUERIES["m12_jeffreys"] = _core(lambda m: intervals(m.context.select("target_id", "gate", "n_precedents", "n_precedents_cleared"), "n_precedents_cleared", "n_precedents"))
QUERIES |= {k: _core(f) for k, f in training.FITTED.items()}
