"""Boosted trees for each gate, their scores out of fold, levers and quality."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Names of features by what is known when. Those after the fact are never inputs.
BLOCKS = {
    "prediction_time": (
        "seq_len pi gravy net_charge_ph7 aromatic_frac cys_frac met_frac gly_frac pro_frac cys_count met_count tm_helices signal_peptide disorder_frac disorder_nterm "
        "disorder_cterm disorder_internal low_complexity_frac superkingdom kingdom phylum n_sequences n_references has_pfam has_uniprot archive_says_membrane "
        "archive_says_eukaryotic archive_says_multidomain centre n_cluster_precedents n_close_precedents closest_identity_band cluster_censored_frac "
        "cluster_deposit_rate n_precedents n_precedents_cleared cluster_base_rate"
    ).split(),
    "declared_protocol": "host tag protease codon_optimised autoinduction cold_shock iptg".split(),
    "post_hoc": (
        "has_pdb_ref method n_trials n_trials_with_gene any_step_failed expression_pct solubility_pct final_conc_mg_ml max_trial_seq_len min_trial_seq_len construct_start "
        "construct_end target_construct_type construct_type selenomethionine refolding detergent"
    ).split(),
}


@dataclass(frozen=True)
class Spec:
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    iterations: int = 20
    depth: int = 5
    rate: float = 0.1
    max_bins: int = 256
    seed: int = 42


def typed(df: DataFrame, spec: Spec) -> DataFrame:
    """Numbers and booleans as doubles, a missing one as -1 with a flag beside it; categories as text, a missing one as ''."""
    out = {}
    for c in spec.numeric:
        x = F.col(c).cast("double")
        out[c] = F.when(x.isNull() | F.isnan(x), -1.0).otherwise(x)
        out[f"{c}_missing"] = (x.isNull() | F.isnan(x)).cast("double")
    for c in spec.categorical:
        out[c] = F.coalesce(F.col(c).cast("string"), F.lit(""))
    return df.withColumns(out)


class ByGate:
    """Rows of every (key, gate), given gate by gate: at(gate) reads what that gate needs and no other gate's rows. It has the few methods of a DataFrame that are used here."""

    def __init__(self, at: Callable[[int], DataFrame], gates: Iterable[int] = range(8)) -> None:
        self.at, self.gates = at, tuple(gates)

    def _each(self, f: Callable[[DataFrame], DataFrame]) -> ByGate:
        return ByGate(lambda gate: f(self.at(gate)), self.gates)

    def where(self, condition) -> ByGate:
        return self._each(lambda d: d.where(condition))

    def withColumn(self, name: str, column: Column) -> ByGate:  # noqa: N802
        return self._each(lambda d: d.withColumn(name, column))

    def drop(self, *names: str) -> ByGate:
        return self._each(lambda d: d.drop(*names))

    def unionByName(self, other: ByGate) -> ByGate:  # noqa: N802
        return ByGate(lambda gate: self.at(gate).unionByName(other.at(gate)), self.gates)

    def select(self, *columns) -> DataFrame:
        """The rows of all gates."""
        return reduce(DataFrame.unionByName, (self.at(gate).select(*columns) for gate in self.gates))

    @property
    def schema(self):
        return self.at(self.gates[0]).schema

    @property
    def columns(self) -> list[str]:
        return self.at(self.gates[0]).columns


def at_gate(rows: DataFrame | ByGate, gate: int) -> DataFrame:
    return rows.at(gate) if isinstance(rows, ByGate) else rows.where(F.col("gate") == gate)


def inputs(spec: Spec) -> list[str]:
    return [*spec.numeric, *[f"{c}_missing" for c in spec.numeric], *[f"{c}_level" for c in spec.categorical]]


def indexer(train: DataFrame | ByGate, spec: Spec):
    """Levels of every category in alphabetical order; they travel with each model, and an unknown one is its own level."""
    return StringIndexer(inputCols=list(spec.categorical), outputCols=[f"{c}_level" for c in spec.categorical], handleInvalid="keep", stringOrderType="alphabetAsc").fit(train.select(*spec.categorical).distinct())


def levels(model) -> list[tuple[str, int, str]]:
    return [(c, k, v) for c, found in zip(model.getInputCols(), model.labelsArray, strict=True) for k, v in enumerate(found)]


def fit_gates(train: DataFrame | ByGate, spec: Spec, threads: int = 4) -> dict[int, PipelineModel | float]:
    """train: typed, with gate and y. A model for each gate; a gate of one class has its rate instead. Fits run side by side."""
    seen = train.select("gate", "y", *spec.categorical).groupBy("gate").agg(F.avg("y").alias("rate"), F.count("y").alias("n"), *[F.collect_set(c).alias(c) for c in spec.categorical]).collect()  # eight rows
    if not seen:
        return {}
    rates, found = {r["gate"]: (r["rate"], r["n"]) for r in seen}, [sorted({v for r in seen for v in r[c]}) for c in spec.categorical]
    rows = [tuple(v[min(k, len(v) - 1)] for v in found) for k in range(max(map(len, found)))]
    index = indexer(SparkSession.active().createDataFrame(rows, ", ".join(f"`{c}` string" for c in spec.categorical)), spec)

    def fit(gate: int):
        rate, _ = rates[gate]
        if rate in (0.0, 1.0):
            return rate
        trees = GBTClassifier(labelCol="y", featuresCol="x", maxIter=spec.iterations, maxDepth=spec.depth, stepSize=spec.rate, maxBins=spec.max_bins, seed=spec.seed, subsamplingRate=0.8, featureSubsetStrategy="0.8")
        assembler = VectorAssembler(inputCols=inputs(spec), outputCol="x")
        x = assembler.transform(index.transform(at_gate(train, gate))).select("y", "x").persist(StorageLevel.MEMORY_AND_DISK)  # the fit reads it three times
        try:
            return PipelineModel([index, assembler, trees.fit(x)])
        finally:
            x.unpersist()

    with ThreadPoolExecutor(threads) as pool:
        return dict(zip(rates, pool.map(fit, rates), strict=True))


def score(models: dict[int, PipelineModel | float], rows: DataFrame | ByGate) -> DataFrame:
    """rows (typed, with gate) with p, the chance to clear, held to 0.01..0.99; gates without a model are left out."""
    parts, columns = [], rows.columns
    for gate, model in sorted(models.items()):
        at = at_gate(rows, gate)
        p = at.withColumn("p", F.lit(float(model))) if isinstance(model, float) else model.transform(at).withColumn("p", vector_to_array("probability")[1])
        parts.append(p.select(*columns, F.greatest(F.lit(0.01), F.least(F.lit(0.99), "p")).alias("p")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def folds(train: DataFrame | ByGate, group: str, k: int = 5) -> DataFrame | ByGate:
    """train with fold: by a hash of the group, so a family is never in two folds."""
    return train.withColumn("fold", F.pmod(F.xxhash64(group, F.lit(42)), F.lit(k)).cast("int"))


def out_of_fold(train: DataFrame | ByGate, others: DataFrame | ByGate, spec: Spec, group: str, k: int = 5) -> DataFrame:
    """Scores of every row by models that saw none of its family: training rows by the other folds, the others by all of them."""
    f = folds(train, group, k)
    out = score(fit_gates(train, spec), others)
    for i in range(k):
        out = out.unionByName(score(fit_gates(f.where(F.col("fold") != i), spec), f.where(F.col("fold") == i).drop("fold")))
    return out


def quality(scored: DataFrame) -> DataFrame:
    """gate, n, positive_rate, brier, ece (10 bins), auroc (null for one class) of rows with y and p.

    Rows are first counted by probability of six decimals, so the ranking window holds at most a million rows for a gate."""
    r = scored.groupBy("gate", F.round("p", 6).alias("p")).agg(F.sum("y").cast("double").alias("pos"), (F.count("y") - F.sum("y")).cast("double").alias("neg"))
    edges = [0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9]
    bin_ = sum((F.when(F.col("p") >= e, 1).otherwise(0) for e in edges), F.lit(0))
    below = F.sum("neg").over(Window.partitionBy("gate").orderBy("p")) - F.col("neg")
    r = r.withColumns({"bin": bin_, "below": below})
    n = F.col("pos") + F.col("neg")
    b = r.groupBy("gate", "bin").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum(F.col("p") * n).alias("sp"), F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("u"),
        F.sum(F.col("pos") * (1 - F.col("p")) ** 2 + F.col("neg") * F.col("p") ** 2).alias("se"),
    )
    g = b.groupBy("gate").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("u").alias("u"), F.sum("se").alias("se"), F.sum(F.abs(F.col("pos") - F.col("sp"))).alias("gap"))
    return g.select("gate", n.cast("long").alias("n"), (F.col("pos") / n).alias("positive_rate"), (F.col("se") / n).alias("brier"), (F.col("gap") / n).alias("ece"), F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("u") / (F.col("pos") * F.col("neg"))).alias("auroc"))


def importance(models: dict[int, PipelineModel | float], spec: Spec) -> list[tuple[str, float]]:
    """Gain of each input summed over the gates, largest first."""
    total = dict.fromkeys(inputs(spec), 0.0)
    for m in models.values():
        if not isinstance(m, float):
            for name, gain in zip(inputs(spec), m.stages[-1].featureImportances.toArray(), strict=True):
                total[name] += float(gain)
    return sorted(total.items(), key=lambda kv: (-kv[1], kv[0]))


def survival(scored: DataFrame, keys: list[str]) -> DataFrame:
    """keys, alive (chance to be alive after each gate in order) and wall (the gate that loses most, the first of equals)."""
    p = F.transform(F.array_sort(F.collect_list(F.struct("gate", "p"))), lambda x: x["p"])
    j = scored.groupBy(*keys).agg(p.alias("cond"))
    j = j.withColumn("alive", F.transform("cond", lambda _, i: F.aggregate(F.slice("cond", 1, i + 1), F.lit(1.0), lambda a, x: a * x)))
    drops = F.transform("alive", lambda x, i: F.when(i == 0, 1.0 - x).otherwise(F.get("alive", i - 1) - x))
    return j.withColumn("_d", drops).withColumn("wall", (F.array_position("_d", F.array_max("_d")) - 1).cast("int")).drop("_d")


def counterfactuals(models: dict, rows: DataFrame | ByGate, key: str, levers: list[tuple[str, object]], top: int = 6) -> DataFrame:
    """The `top` single changes of each key by the points they add at the present wall: key, change, delta_pts, delta_final_pts, moves_wall_to.

    rows: typed, one for each (key, gate). Levers that change nothing are left out; ties go by name."""
    base = survival(score(models, rows), [key]).select(key, F.col("alive").alias("b_alive"), F.col("wall").alias("b_wall"))
    alt, schema = None, rows.schema
    for column, value in levers:  # a short list
        kind = schema[column].dataType
        one = rows.where(~F.col(column).eqNullSafe(F.lit(value).cast(kind))).withColumn(column, F.lit(value).cast(kind)).withColumn("change", F.lit(f"{column}:{value}"))
        alt = one if alt is None else alt.unionByName(one)
    j = survival(score(models, alt), [key, "change"]).join(base, key)
    at = lambda c, i: F.get(c, i)
    j = j.select(
        key, "change", F.round(100 * (at("alive", F.col("b_wall")) - at("b_alive", F.col("b_wall"))), 1).alias("delta_pts"),
        F.round(100 * (F.element_at("alive", -1) - F.element_at("b_alive", -1)), 1).alias("delta_final_pts"), F.when(F.col("wall") != F.col("b_wall"), F.col("wall")).alias("moves_wall_to"),
    )
    return j.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("delta_pts"), "change"))).where(F.col("rn") <= top)
