import hashlib
import random

import pytest

from stagewise.llm.substring_dedup import dedup_windows, difference_cover

SCHEMA = "text string, doc_id long, n_words string"


def brute(rows, window=13):
    words = [(d, (t or "").encode().split()) for t, d, _ in rows]
    least = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(least.get(k, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), b" ".join(kept).decode()))
    return sorted(out)


def cases():
    r = random.Random(3)
    vocabulary = ["w%d" % i for i in range(40)] + ["é", " x", "日本"]
    word = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage, long = word(60), word(4000)
    rows = []
    for i in range(60):
        w = word(r.randrange(0, 80))
        if i % 3 == 0:
            k = r.randrange(0, 40)
            w = w[: len(w) // 2] + passage[k : k + r.choice([12, 13, 14, 20])] + w[len(w) // 2 :]
        rows.append((r.choice([" ", "\n", "\t  ", "\x0b"]).join(w), i, "other"))
    rows += [(None, 100, ""), ("", 101, ""), ("  \n", 102, ""), (" ".join(long), 103, ""), (" ".join(long[100:3000]), 104, ""), (" ".join(long), 105, "")]
    rows += [(" ".join(passage), 106, ""), (" ".join(passage), 106, "")]
    return rows


def test_against_brute_force(spark):
    rows = cases()
    got = sorted(map(tuple, dedup_windows(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == brute(rows)
    assert sum(x[2] for x in got) > 5000


def test_empty_table_and_null_id(spark):
    assert dedup_windows(spark.createDataFrame([], SCHEMA)).count() == 0
    t = " ".join(map(str, range(20)))
    got = {r.doc_id: r.n_removed for r in dedup_windows(spark.createDataFrame([(t, 5, ""), (t, None, "")], SCHEMA)).collect()}
    assert got[5] == 0 and got[None] == 20


@pytest.mark.parametrize("period", [3, 5, 7, 13])
def test_cover(period):
    d = difference_cover(period)
    for i in range(period):
        for j in range(period):
            assert any((i + s) % period in d and (j + s) % period in d for s in range(period))


def test_query(spark, sf):
    from stagewise.llm.substring_dedup import op1_substring_dedup

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.text, r.doc_id, "") for r in docs.collect()]
    want = {(d, n, m, hashlib.sha256(k.encode()).hexdigest()) for d, n, m, k in brute(rows)}
    assert {tuple(r)[:4] for r in op1_substring_dedup(spark, sf).collect()} == want


def thue_morse(n, a, b):
    x = [0]
    while len(x) < n:
        x += [1 - y for y in x]
    return "".join((a, b)[y] for y in x[:n])


def test_words_that_a_plain_hash_takes_for_one(spark):
    """Two long words of equal hash modulo 2**64 stay two words."""
    import numpy as np
    from stagewise.llm.common import Powers, PrimePowers, find_pairs, pack_columns, runs_check, runs_hash, unpack_columns

    a, b = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")
    data = np.frombuffer((a + b).encode(), np.uint8).astype(np.uint64)
    starts, ends = np.array([0, 2048]), np.array([2048, 4096])
    one, two = runs_hash(data, starts, ends, Powers(0xD6E8FEB86659FD93))
    assert one == two
    one, two = runs_check(data, starts, ends, PrimePowers(0x2C1B3C6D))
    assert one != two
    tail = " ".join(f"w{i}" for i in range(12))
    got = {r.doc_id: r.n_removed for r in dedup_windows(spark.createDataFrame([(f"{a} {tail}", 1, ""), (f"{b} {tail}", 2, ""), (f"{a} {tail}", 3, "")], SCHEMA)).collect()}
    assert got == {1: 0, 2: 0, 3: 13}
    h, g = np.array([1, 5, 5, 5, 9], np.uint64), np.array([7, 1, 2, 3, 7], np.uint64)
    assert find_pairs(h, g, np.array([5, 5, 1, 9, 4, 5], np.uint64), np.array([3, 1, 7, 8, 0, 4], np.uint64)).tolist() == [3, 1, 0, -1, -1, -1]
    hashes, numbers = unpack_columns(pack_columns([h, g], [h.view(np.int64) - 3]))
    assert (hashes[0] == h).all() and (hashes[1] == g).all() and (numbers[0] == h.view(np.int64) - 3).all()


def test_blocks_do_not_grow_with_an_id(spark, monkeypatch):
    from stagewise.llm import anchors

    monkeypatch.setattr(anchors, "n_blocks", lambda docs, text: 7)
    df = spark.createDataFrame([(f"text {i}", None if i % 2 else 5, "") for i in range(700)], SCHEMA).repartition(3)
    blocks, n = anchors.in_blocks(df, "doc_id", "text")
    assert n == 7 and max(r["count"] for r in blocks.groupBy("block").count().collect()) < 170


def test_the_blocks_are_dealt_once(spark, sf):
    import io
    from contextlib import redirect_stdout

    from stagewise.llm.substring_dedup import op1_substring_dedup

    df, out = op1_substring_dedup(spark, sf), io.StringIO()
    df.collect()
    with redirect_stdout(out):
        df.explain()
    assert out.getvalue().count("ReusedExchange") >= 1


def test_blocks_of_several_pieces(spark, monkeypatch):
    """A block is read in bounded pieces: here of some 500 bytes."""
    from stagewise.llm import common, substring_dedup

    monkeypatch.setattr(substring_dedup, "pieces", lambda offsets: common.pieces(offsets, 500))
    rows = cases()
    assert sorted(map(tuple, dedup_windows(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows)
