import random

import numpy as np
import pytest
import xxhash

from stagewise.llm import simhash as S

SCHEMA = "text string, doc_id long, fp string"


def slow_fingerprint(text, n=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(pairs):
    """pairs: (id, fp)."""
    ids, fps = [i for i, _ in pairs], [f for _, f in pairs]
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, format(f, "016x"), least[find(i)]) for i, (d, f) in enumerate(pairs))


def test_against_brute_force(spark, sf, tmp_path):
    r = random.Random(2)
    words = ["w%d" % i for i in range(50)] + ["É", "A"]
    base = [r.choice(words) for _ in range(400)]
    rows = [(None, 900, ""), ("", 901, ""), (" \n", 902, ""), ("one two", 903, ""), ("ONE  two", 904, ""), ("a b c d", 905, "")]
    for i in range(60):
        w = list(base)
        for _ in range(r.randrange(0, 6)):
            w[r.randrange(400)] = r.choice(words)
        rows.append((" ".join(w), 100 - i, ""))
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, S.op5_simhash(spark, str(tmp_path)).collect()))
    assert got == components([(d, slow_fingerprint(t)) for t, d, _ in rows])


def test_query(spark, sf):
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, S.op5_simhash(spark, sf).collect())) == components(rows)


def test_large_groups_and_chunks(spark):
    r = random.Random(4)
    fps = set()
    for _ in range(40):
        c = r.getrandbits(64)
        for _ in range(15):
            x = c
            for b in r.sample(range(64), r.randrange(0, 5)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)), None if i % 5 == 0 else i % 7) for i, x in enumerate(fps)], "fp long, least long")
    got = {(e.a.id, e.b.id) for e in S.links(df, 4, plan_sample=64, limit=20).collect()}
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    edges = S.connected_components(spark.createDataFrame(list(got), "a long, b long")).collect()
    of = {e.node: e.component for e in edges}
    want = dict((i, c) for i, _, c in components(list(enumerate(fps))))
    name = {}
    for i, x in enumerate(signed):
        assert name.setdefault(want[i], of.get(x, x)) == of.get(x, x)
    assert len(set(name.values())) == len(name)


def test_empty(spark):
    assert S.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("t", [3, 4, 7])
def test_plan_is_complete(t):
    sample = np.random.default_rng(0).integers(0, 2**63, 200).astype(np.uint64)
    parts = S.plan(sample, 10**6, t)
    assert sum(e + 1 for _, _, e, _ in parts) == t + 1
    assert sum(mask for _, mask, _, _ in parts) < 1 << 64


def test_likely_plan_reaches_its_recall():
    r = np.random.default_rng(1)
    m, n = S.shape(10**5, 0.8, 0.99)
    parts = S.likely_plan(r.integers(0, 2**63, (300, n)).astype(np.uint64) * np.uint64(2), 10**5, m, 0.8, 0.99)
    met = 0
    for _ in range(400):
        h = r.integers(0, 1 << 64, 340, np.uint64)
        a, b = S.majorities(h[:306], n), S.majorities(h[34:], n)  # 272 of 340 in common
        met += any(np.bitwise_count((a[w] ^ b[w]) & np.uint64(mask)) <= e for w, mask, e, _ in parts)
    assert met >= 0.97 * 400
    assert S.shape(10**9, 0.8, 0.99)[0] < m


def test_null_repeated_and_shared_ids(spark):
    rows = [("a b c d e f", None, ""), ("a b c d e f", None, ""), ("x y z u v w", None, ""), ("x y z u v w", 5, ""), ("a b c", 7, ""), ("k l m n o p", 7, ""), ("k l m n o p", 7, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.doc_id, r.component_id) for r in S.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(None, None), (None, None), (None, 5), (5, 5), (7, 7), (7, 7), (7, 7)], key=repr)
    long = " ".join(f"w{i}" for i in range(200000))
    assert S.near_duplicates(spark.createDataFrame([(long, 2, ""), (long, 1, "")], SCHEMA)).first().component_id == 1
