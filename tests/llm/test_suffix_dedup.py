import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from stagewise.llm.suffix_dedup import dedup_bytes, equal_groups, op4_suffix_dedup

SCHEMA = "text string, doc_id long, kept string"


def brute(rows, length=50):
    data = [(d, (t or "").encode()) for t, d, _ in rows]
    least = {}
    for d, b in data:
        for i in range(len(b) - length + 1):
            k = b[i : i + length]
            least[k] = min(least.get(k, d), d)
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if least[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def digest(df):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in df.collect())


def test_against_brute_force(spark):
    r = random.Random(5)
    text = lambda n: "".join(r.choice("ab é日\n") for _ in range(n))
    passage = text(300)
    rows = []
    for i in range(60):
        t = text(r.randrange(0, 300))
        if i % 2:
            k = r.randrange(0, 200)
            t = t[: len(t) // 2] + passage[k : k + r.choice([20, 40, 60, 90])] + t[len(t) // 2 :]
        rows.append((t, i, ""))
    long = text(5000)
    rows += [(None, 100, ""), ("", 101, ""), ("a" * 400, 102, ""), ("a" * 120 + "b" + "a" * 60, 103, ""), (long, 104, ""), (long[50:3000], 105, ""), (long, 106, ""), (passage, 107, ""), (passage, 107, "")]
    rows += [("ab" * 300, 108, ""), ("xab" * 5 + "ab" * 40, 109, "")]
    assert digest(dedup_bytes(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_groups_of_equal_strings():
    r = random.Random(1)
    strings = [bytes(r.choice(b"ab") for _ in range(r.randrange(1, 60))) for _ in range(40)]
    text = np.frombuffer(b"".join(strings), np.uint8)
    left = np.concatenate([np.arange(len(s), 0, -1) for s in strings])
    place, group = equal_groups(text, left, 12)
    found, want = {}, {}
    for p, g in zip(place.tolist(), group.tolist()):
        found.setdefault(g, set()).add(p)
    whole = text.tobytes()
    for p in range(len(text)):
        if left[p] >= 12:
            want.setdefault(whole[p : p + 12], set()).add(p)
    assert sorted(map(sorted, found.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


def test_empty_table_and_null_id(spark):
    assert dedup_bytes(spark.createDataFrame([], SCHEMA)).count() == 0
    t = "".join(map(str, range(40)))
    got = {r.doc_id: r.n_removed for r in dedup_bytes(spark.createDataFrame([(t, 5, ""), (t, None, "")], SCHEMA)).collect()}
    assert got == {5: 0, None: len(t)}


def test_query(spark, sf):
    rows = [(r.text, r.doc_id, "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, op4_suffix_dedup(spark, sf).collect())) == brute(rows)


def test_runs_that_a_plain_hash_takes_for_one(spark):
    from test_substring_dedup import thue_morse

    a, b = thue_morse(4096, "a", "b"), thue_morse(4096, "b", "a")
    rows = [(a, 1, ""), (b, 2, ""), ("a" * 2048 + "b", 3, ""), (a[:2048], 4, ""), (b[:1024] + a[:1024], 5, ""), ("a" * 2048 + "c", 6, "")]
    assert digest(dedup_bytes(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_blocks_of_several_pieces(spark, sf, monkeypatch):
    """A block is read in bounded pieces: here of some 3000 bytes."""
    from stagewise.llm import common, suffix_dedup

    monkeypatch.setattr(suffix_dedup, "pieces", lambda offsets: common.pieces(offsets, 3000))
    rows = [(r.text, r.doc_id, "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, op4_suffix_dedup(spark, sf).collect())) == brute(rows)


def test_a_hot_minimizer_is_dealt_window_by_window(spark, sf, monkeypatch):
    """A passage between texts of its own makes as many runs as documents: no index takes them all."""
    from stagewise.llm import suffix_dedup

    r = random.Random(8)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = text(90)
    rows = [(text(r.randrange(0, 90)) + passage[r.randrange(0, 3) :] + text(r.randrange(0, 90)), i, "") for i in range(400)]
    rows += [("a" * 300, 500, ""), ("b" + "a" * 200 + "c", 501, ""), (passage, None, ""), (passage[5:70], 399, "")]
    rows += [(x.text, x.doc_id, "") for x in spark.read.parquet(f"{sf}/documents.parquet").limit(50).collect()]
    docs, want = spark.createDataFrame(rows, SCHEMA).repartition(3).cache(), sorted(((1 << 63) - 1 if d is None else d, t, k) for t, d, k in rows)
    want = brute([(t, d, k) for d, t, k in want])
    real, big = suffix_dedup.in_blocks, suffix_dedup.equal_groups

    def bounded(text, left, length):
        assert len(text) < 20_000, "one index holds the runs of all documents"
        return big(text, left, length)

    def several(docs, id_col, text_col):
        blocks, _ = real(docs, id_col, text_col)
        return blocks.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(5)).cast("int")), 5

    whole = [digest_with_null(dedup_bytes(docs, **x)) for x in ({}, {"hot": 0}, {"hot": 10})]
    monkeypatch.setattr(suffix_dedup, "in_blocks", several)
    whole += [digest_with_null(dedup_bytes(docs, **x)) for x in ({}, {"hot": 0}, {"hot": 10})]
    assert all(x == want for x in whole)
    monkeypatch.setattr(suffix_dedup, "equal_groups", bounded)
    assert digest_with_null(dedup_bytes(docs, hot=100)) == want


def digest_with_null(df):
    last = (1 << 63) - 1
    return sorted((last if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in df.collect())


def test_messages_take_no_steps_of_their_own(spark, sf, monkeypatch):
    """Their number is blocks times buckets: they are slices of one array, not packed one by one."""
    from stagewise.llm import suffix_dedup

    real = suffix_dedup.slices
    data = np.arange(10, dtype=np.uint32)
    got = real(data, np.array([0, 3, 3, 10]))
    assert [np.frombuffer(x.as_py(), np.uint32).tolist() for x in got] == [[0, 1, 2], [], list(range(3, 10))]
    assert got.buffers()[2].address == data.ctypes.data
    raw, at = suffix_dedup.joined(suffix_dedup.pa.chunked_array([got[1:], got[:1]]))
    assert raw.view(np.uint32).tolist() == [*range(3, 10), 0, 1, 2] and at.tolist() == [0, 0, 28, 40]
    rows = [(r.text, r.doc_id, "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs = spark.createDataFrame(rows, SCHEMA)
    blocks = lambda d, *_: (d.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(40)).cast("int").alias("block")), 40)
    monkeypatch.setattr(suffix_dedup, "in_blocks", blocks)
    assert digest(dedup_bytes(docs)) == brute(rows)
