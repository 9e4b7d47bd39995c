import random

from stagewise import catalog
from stagewise.operators import similarity
from stagewise.operators.similarity import similar_pairs


def test_pairs_across_labels(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 0.3) for _ in range(8)], r.choice([None, 1, 2])) for i in range(150)]
    rows += [(None, [1.0] * 8, 1), (200, None, 1), (201, [1.0, None], 1), (202, [1.0, 1.0], 2), (203, [0.5, 0.5], None), (1, rows[1][1], 2)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    usable = [x for x in rows if x[0] is not None and x[1] is not None and None not in x[1]]
    want = sorted((a, b, round(dot(v, w), 6)) for a, v, _ in usable for b, w, _ in usable if a != b and len(v) == len(w) and dot(v, w) >= 0.3)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for block in (2048, 40):
        assert sorted((r.query_id, r.target_id, round(r.identity, 6)) for r in similar_pairs(df, block=block).collect()) == want
    label = {x[0]: x[2] for x in usable}
    assert any(label[a] != label[b] for a, b, _ in want)


def test_pairs_of_one_label(spark):
    r = random.Random(5)
    rows = [(i, [float(r.randrange(-2, 3)) for _ in range(4)], r.choice([None, 1, 2, 2])) for i in range(120)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    want = sorted((a, b, dot(v, w)) for a, v, k in rows for b, w, m in rows if a != b and k is not None and k == m and dot(v, w) >= 1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for block in (2048, 30):
        assert sorted(map(tuple, similar_pairs(df, 1.0, block, within="label").collect())) == want


def test_rows_are_compared_in_blocks_not_one_by_one(spark, sf):
    plan = catalog.QUERIES["j14_similarity_join"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Join" not in plan
    assert similarity.n_blocks(600_000, similarity.BLOCK) < 20 and similarity.n_blocks(0, similarity.BLOCK) == 1


def test_small_tiles_and_batches(spark, monkeypatch):
    import numpy as np

    r = np.random.default_rng(1)
    v, ids = r.integers(-2, 3, (90, 5)).astype(float), np.arange(90) // 2
    want = sorted((a, b) for a in range(50) for b in range(50, 90) if v[a] @ v[b] >= 2 and ids[a] != ids[b])
    monkeypatch.setattr(similarity, "TILE", 100)
    monkeypatch.setattr(similarity, "BATCH", 7)
    got = list(similarity._batches(v, ids, np.arange(50), np.arange(50, 90), 2.0, True))
    assert max(b.num_rows for b in got) <= 7
    pairs = [x for b in got for x in zip(b["query_id"].to_pylist(), b["target_id"].to_pylist(), strict=True)]
    assert sorted(pairs) == sorted([(ids[a], ids[b]) for a, b in want] + [(ids[b], ids[a]) for a, b in want])


def test_query_links_across_labels(spark, sf):
    label = {r.vec_id: r.label for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    assert any(label[r.query_id] != label[r.target_id] for r in catalog.QUERIES["j14_similarity_join"](spark, sf).collect())
