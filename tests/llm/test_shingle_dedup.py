"""Near-dedup against brute-force Jaccard over five-word shingles."""

import random

import corpus_pipeline as C
from stagewise.llm import shingle_dedup as D


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """The rows that stay, by all pairs: of each group that with the smallest id, missing ids last."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        k = (d is None, d or 0)
        best[find(i)] = min(best.get(find(i), k), k)
    return sorted(best.values())


def varied(r, base, similarity):
    """Base with words changed in one run: its shingles agree to about the similarity."""
    n = len(base) - 4
    k = max(1, round(n * (1 - similarity) / (1 + similarity)) - 4)
    w = list(base)
    w[50 : 50 + k] = [f"x{r.random()}" for _ in range(k)]
    return w


def corpus(n):
    r, rows = random.Random(5), []
    for i in range(n):
        base = [f"w{r.randrange(10**6)}" for _ in range(r.choice([150, 300, 600]))]
        rows.append((10 * i, " ".join(base)))
        for k, s in enumerate((0.5, 0.6, 0.7, 0.76, 0.79, 0.81, 0.83, 0.9)):
            rows.append((10 * i + 1 + k, " ".join(varied(r, base, s))))
    return rows


def test_against_brute_force(spark, sf):
    rows = corpus(40)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in C.near_dedup(spark, docs, sf).collect())
    want = brute(rows)
    assert 0 < len(want) < len(rows)
    assert got == want


def test_chunks(spark):
    rows = corpus(12)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((False, r.doc_id) for r in D.keep_one(docs, limit=3).collect())
    assert got == brute(rows)


def test_shared_passage_is_no_copy(spark, sf):
    r = random.Random(1)
    shared = " ".join(f"s{i}" for i in range(120))
    rows = [(i, shared + " " + " ".join(f"w{r.random()}" for _ in range(60))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert C.near_dedup(spark, docs, sf).count() == 60


def test_one_row_of_each_group(spark, sf):
    a, b, c = ("copied " + " ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, a), (1, a), (2, a), (None, a), (None, b), (None, b), (3, c), (2, "of its own"), (4, None), (5, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, C.near_dedup(spark, docs, sf).collect()), key=repr)
    assert got == sorted([(1, a), (None, b), (3, c), (2, "of its own"), (4, None)], key=repr)
    assert C.near_dedup(spark, docs.limit(0), sf).count() == 0
