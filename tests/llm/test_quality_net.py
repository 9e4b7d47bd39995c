import zlib

import numpy as np

from stagewise.llm import quality_net as Q


def auc(s, y):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = Q.op6_quality_net(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    y = np.array([labels[r.doc_id] for r in held])
    area = auc(np.array([r.score for r in held]), y)
    right = np.mean([r.predicted == labels[r.doc_id] for r in held])
    print("held-out AUC", area, "accuracy", right, len(held))
    assert area > 0.9 and right > 0.9


def slow_chunks(responses):
    n = len(responses)
    return np.array([responses[a : a + Q.CHUNK].max(0) for a in range(0, max(1, n - Q.STRIDE), Q.STRIDE)])


def slow_score(net, data):
    """The net as its definition says, one place and one tap at a time."""
    if not len(data):
        return 1 / (1 + np.exp(-float(net.out_bias[0])))
    y = np.zeros((len(data), Q.FILTERS))
    for i in range(len(data)):
        for t in range(Q.TAPS):
            y[i] += net.w[t][data[i + t] if i + t < len(data) else 0]
    h = np.maximum(slow_chunks(y) + net.bias, 0)
    return 1 / (1 + np.exp(-float(np.concatenate([h.mean(0), h.max(0)]) @ net.out + net.out_bias[0])))


def test_query_against_the_slow_net(spark, tmp_path):
    rows = [(i, ("good tidy prose of a page " if i % 2 else "x9$ zz#! qq ") * (1 + i % 40)) for i in range(150)] + [(900, None), (901, ""), (None, "y" * 129), (3, "repeated id"), (902, "é" * 3000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, None) for i in range(150)] + [(901, None, 0), (7777, 1, 1)], "doc_id long, quality int, text int").write.parquet(f"{tmp_path}/labels.parquet")
    got = Q.op6_quality_net(spark, str(tmp_path)).collect()
    docs, labels = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    net = Q.fit(docs, labels)
    want = sorted(((d, round(slow_score(net, np.frombuffer((t or "").encode(), np.uint8)), 4)) for d, t in rows), key=repr)
    assert sorted(((r.doc_id, round(r.score, 4)) for r in got), key=repr) == want
    assert all((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in got if r.doc_id is not None and 3 < r.doc_id < 150)


def test_training_rows_are_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(0, f"row {i} " * 5) for i in range(300)] + [(i, "long text " * 20000) for i in range(3, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(Q, "train", lambda texts, y: seen.append((texts, y)))
    Q.fit(docs, labels, per_class=5, train_chars=1600)
    texts, y = seen[0]
    assert len(texts) <= 10 and max(map(len, texts)) <= 1600 and 0 < y.sum() <= 5


def test_chunks_cover_the_whole_text():
    net = Q.Net(3)
    data = np.random.default_rng(0).integers(0, 256, 5000).astype(np.uint8)
    tables = net.tables()
    slow = np.zeros((len(data), Q.FILTERS), np.float32)
    for i in range(len(data)):
        for t in range(Q.TAPS):
            slow[i] += net.w[t][data[i + t] if i + t < len(data) else 0]
    whole = slow_chunks(slow)
    assert np.allclose(net.chunks(data, tables, piece=1024), whole, atol=1e-5)
    assert np.allclose(net.chunks(data, tables), whole, atol=1e-5)


def test_gradient():
    data = np.frombuffer(b"some text of a document, " * 30, np.uint8)
    net = Q.Net(1)
    grads = [np.zeros_like(p, dtype=np.float64) for p in (net.w, net.bias, net.out, net.out_bias)]
    Q._backward(net, data, 1.0, 1.0, grads)
    loss = lambda: -np.log(net.score(data, net.tables()))
    for p, g in zip((net.out, net.bias, net.w), (grads[2], grads[1], grads[0])):
        k = np.unravel_index(np.abs(g).argmax(), g.shape)
        base = p[k]
        p[k] = base + 1e-3
        up = loss()
        p[k] = base - 1e-3
        down = loss()
        p[k] = base
        assert abs((up - down) / 2e-3 - g[k]) < 0.05 * abs(g[k]) + 1e-3


def test_cases(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (None, "x", 1.0), (3, "a" * 300000, 1.0), (3, "b", 1.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in Q.score(docs, Q.fit(docs, none)).collect()} == {0.5}
    net = Q.train([b"aaa", b"bbb", b""], np.array([1.0, 0.0, 1.0]))
    got = Q.score(docs, net).collect()
    assert len(got) == 5 and all(np.isfinite(r.score) for r in got)
    assert Q.score(spark.createDataFrame([], docs.schema), net).count() == 0
