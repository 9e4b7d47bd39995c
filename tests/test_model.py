import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stagewise.operators import model as B
from stagewise.operators import relatives, splits
from stagewise.operators.labels import pairs
from stagewise.operators.taxonomy import SUPERKINGDOMS, classify, lineage


def test_blocks_are_disjoint():
    names = [f for fs in B.BLOCKS.values() for f in fs]
    assert [len(x) for x in B.BLOCKS.values()] == [37, 7, 17] and len(set(names)) == len(names)


def test_quality_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(g, round(rng.random(), 2), float(rng.random() < 0.4)) for g in (0, 1) for _ in range(150)] + [(2, 0.3, 1.0)]
    got = {r.gate: r for r in B.quality(spark.createDataFrame(rows, "gate int, p double, y double")).collect()}
    for g in (0, 1):
        at = [(p, y) for k, p, y in rows if k == g]
        pos, neg = [p for p, y in at if y], [p for p, y in at if not y]
        assert got[g].auroc == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))
        assert got[g].brier == pytest.approx(sum((p - y) ** 2 for p, y in at) / len(at))
        edges, gap = [k * 0.1 for k in range(1, 10)], 0.0
        for b in range(10):
            inside = [(p, y) for p, y in at if sum(p >= e for e in edges) == b]
            gap += abs(sum(y for _, y in inside) - sum(p for p, _ in inside))
        assert got[g].ece == pytest.approx(gap / len(at)) and got[g].n == 150
    assert got[2].auroc is None


def test_survival(spark):
    r = B.survival(spark.createDataFrame([("a", 0, 0.5), ("a", 1, 0.5), ("a", 2, 1.0), ("b", 0, 0.9), ("b", 1, 0.1)], "t string, gate int, p double"), ["t"]).collect()
    assert {x.t: (x.alive, x.wall) for x in r} == {"a": ([0.5, 0.25, 0.25], 0), "b": ([0.9, pytest.approx(0.09)], 1)}


def test_folds_keep_families_whole(spark):
    f = B.folds(spark.range(500).selectExpr("id", "id % 40 AS family"), "family").groupBy("family").agg({"fold": "count", "*": "count"})
    seen = B.folds(spark.range(500).selectExpr("id", "id % 40 AS family"), "family").select("family", "fold").distinct()
    assert seen.count() == f.count() == 40 and {r.fold for r in seen.collect()} == set(range(5))


def test_unknown_and_missing_inputs(spark):
    spec = B.Spec(("a",), ("c",), iterations=2, depth=2)
    train = B.typed(spark.createDataFrame([(0, float(k % 7), "xy"[k % 2], float(k % 2)) for k in range(60)] + [(1, 1.0, "x", 1.0)], "gate int, a double, c string, y double"), spec)
    models = B.fit_gates(train, spec)
    new = B.typed(spark.createDataFrame([(0, None, "never seen"), (0, float("nan"), None), (1, 2.0, "x")], "gate int, a double, c string"), spec)
    got = B.score(models, new).collect()
    assert len(got) == 3 and all(0.01 <= r.p <= 0.99 for r in got) and models[1] == 1.0


def test_lineage_with_cycle_gap_and_root(spark):
    rows = [(1, 1, "no rank", "root"), (2, 1, "domain", "Bacteria"), (3, 2, "phylum", "P"), (4, 3, "genus", "G"), (5, 6, "x", "five"), (6, 5, "y", "six"), (7, 99, "genus", "alone"), (8, 8, "z", "self")]
    paths = lineage(spark.createDataFrame(rows, "taxid long, parent long, rank string, name string"))
    got = {r.taxid: [x.taxid for x in r.path] for r in paths.collect()}
    assert got == {1: [], 2: [2], 3: [3, 2], 4: [4, 3, 2], 5: [5, 6], 6: [6, 5], 7: [7], 8: [8]}
    kinds = {r.taxid: (r.superkingdom, r.tax_phylum, r.tax_genus) for r in classify(paths, ("phylum", "genus"), SUPERKINGDOMS).collect()}
    assert kinds[4] == ("Bacteria", "P", "G") and kinds[7] == ("", "", "alone") and kinds[1] == ("", "", "")


def test_long_chain(spark):
    n = 50
    rows = [(k, k - 1, "r", str(k)) for k in range(1, n + 1)]
    got = {r.taxid: len(r.path) for r in lineage(spark.createDataFrame(rows, "taxid long, parent long, rank string, name string")).collect()}
    assert got == {k: k - 1 for k in range(1, n + 1)}


@pytest.mark.parametrize("cap", [1, 3, 20])
def test_pairs_against_all_pairs(spark, cap):
    rng = random.Random(cap)
    rows = [(t, "ab"[rng.randrange(2)], rng.randrange(9), False, rng.randrange(3), rng.choice([None, 0, 1])) for t in range(150)]
    cens = spark.createDataFrame([r[:4] for r in rows], "target_id long, centre string, max_stage int, censored boolean")
    targets = spark.createDataFrame([(r[0], r[4], r[5]) for r in rows], "target_id long, cluster30 long, cluster70 long")
    want = []
    for family in range(3):
        m = [r for r in rows if r[4] == family]
        every = [(not (a[5] == b[5] and a[5] is not None), b[2] - a[2], a[0], b[0]) for a in m for b in m if a[2] > b[2] + 1]
        want += [(family, *x) for x in sorted(every)[:cap]]
    got = [(r.cluster_id, not r.hard, -r.stage_gap, r.chosen_id, r.rejected_id) for r in pairs(cens, targets, cap).collect()]
    assert sorted(got) == sorted(want)


def test_first_relatives(spark):
    from pyspark.sql import functions as F

    rng = random.Random(1)
    rows = [(t, rng.randrange(4), rng.choice([None, 1, 2, 3])) for t in range(80)] + [(99, 77, 1)]
    got = relatives.first_relatives(spark.createDataFrame(rows, "t long, g long, s int"), "g", "t", [F.desc_nulls_last("s"), F.col("t")], 5, ["s"]).collect()
    want = set()
    for t, g, _ in rows:
        fellows = sorted((r for r in rows if r[1] == g and r[0] != t), key=lambda r: (-(r[2] or 0), r[0]))[:5]
        want |= {(t, k + 1, r[0]) for k, r in enumerate(fellows)}
    assert {(r["query"], r.rn, r.t) for r in got} == want


def test_gates_read_apart_give_the_same_models(spark):
    rng = random.Random(8)
    spec = B.Spec(("a",), ("c",), iterations=2, depth=2)
    rows = [(k, g, float(rng.randrange(9)), rng.choice("xyz"), float(rng.random() < 0.4)) for k in range(80) for g in range(3)]
    train = B.typed(spark.createDataFrame(rows, "id int, gate int, a double, c string, y double"), spec).coalesce(1).cache()
    apart = B.ByGate(lambda g: train.where(f"gate = {g}"), range(3))
    want, got = (sorted(map(tuple, B.score(B.fit_gates(t, spec), t).select("id", "gate", "p").collect())) for t in (train, apart))
    assert want == got and len(got) == 240
    more = apart.where("id < 40").withColumn("one", F.lit(1)).unionByName(apart.where("id >= 40").withColumn("one", F.lit(2)))
    assert more.select("*").drop("one").exceptAll(train).count() == 0 and more.drop("one").columns == train.columns
    assert B.fit_gates(train.where("id < 0"), spec) == {}


def test_assign_follows_the_greedy_rule():
    rng = random.Random(2)
    for _ in range(20):
        sizes = {k: rng.choice([1, 1, 2, 3, 7, 40]) for k in range(rng.randrange(1, 300))}
        order = sorted(sizes.items(), key=lambda x: (-x[1], x[0]))
        want = splits.assign_clusters(order)
        got = splits.assign(np.array([n for _, n in order]))
        assert [splits.NAMES[k] for k in got] == [want[c] for c, _ in order]
