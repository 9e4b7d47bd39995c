import numpy as np

from stagewise.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, score double"


def brute(rows, k=20):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    ids, x = np.array([i for i, _ in ok]), np.array([v for _, v in ok])
    out = {}
    for i, v in ok:
        if i % 20 == 0:
            s = (x * v).sum(1)
            order = np.lexsort((ids, -s))
            out[i] = [(int(ids[j]), float(s[j])) for j in order if ids[j] != i][:k]
    return out


def test_recall_and_order(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, got = brute(rows), {}
    for r in N.op2_nearest(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert set(got) == set(want)
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))
    score = {(q, i): s for q in want for i, s in want[q]}
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        assert all(abs(score.get((q, i), s) - s) < 1e-12 for i, s in found)


def test_copies_and_bad_vectors(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in r.standard_normal(8)]) for i in range(300)]
    rows += [(1000 + i, [1.0] * 8) for i in range(400)]
    rows += [(2000, None), (2020, [0.0] * 8), (2040, [None] + [1.0] * 7), (2060, [float("nan")] * 8), (2080, [float("inf")] * 8), (2100, []), (2120, [1.0] * 7)]
    df = spark.createDataFrame([(i, v, 0.0) for i, v in rows], SCHEMA)
    got = {}
    for x in N.nearest(df, df.where("vec_id % 20 = 0"), leaf=20, leaf_rows=50).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append(x.vec_id)
    want = brute([x for x in rows if x[0] < 2100])
    assert set(got) == set(want)
    assert got[1100] == [i for i, _ in want[1100]]
    assert sum(len(set(got[q]) & {i for i, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0.0), (20, [0.5, 0.5], 0.0), (3, [0.0, 2.0], 0.0)], SCHEMA)
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in N.nearest(df, df.where("vec_id % 20 = 0")).collect())
    assert got == [(0, 1, 20, 0.5), (0, 2, 3, 0.0), (20, 1, 3, 1.0), (20, 2, 0, 0.5)]
    empty = spark.createDataFrame([], SCHEMA)
    assert N.nearest(empty, empty).count() == 0


def test_depth_follows_the_table_and_clusters_cost_little():
    r = np.random.default_rng(3)
    sample = r.standard_normal((4096, 16))
    assert [N.Forest(sample, n, 1, 400, 0).depth for n in (100, 1000, 51282, 10**9)] == [0, 2, 8, 9]
    centres = r.standard_normal((200, 16)) * 4
    clustered = centres[r.integers(0, 200, 4096)] + 0.1 * r.standard_normal((4096, 16))
    clustered /= np.linalg.norm(clustered, axis=1, keepdims=True)
    assert N.Forest(clustered, 4096 * 8, 8, 400, 0).calibrate(clustered, 10, 0.95) < 0.2


def test_repeated_ids_and_clashing_names(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (5, [0.5, 0.5], 2), (5, [0.5, 0.5], 2), (5, [0.0, 1.0], 3), (None, [1.0, 1.0], 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, tree int").withColumn("leaf", N.F.lit("x")).withColumn("id", N.F.lit(1)).withColumn("v", N.F.lit(2))
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in N.nearest(df, df.where("vec_id = 0")).collect())
    assert got == [(0, 1, 5, 0.5), (0, 2, 5, 0.0)]
