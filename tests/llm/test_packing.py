import math
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from stagewise.llm import packing as P


def expected(rows, size=1024):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for doc, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        start, k = 0, 0
        while start < len(ids):
            n = (len(ids) - start) % size or size
            out.append((doc, k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())))
            start, k = start + n, k + 1
    return sorted(out, key=repr)


def check(packed, rows, size=1024):
    got = packed.collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == expected(rows, size)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= size
    return len(by), math.ceil(sum(r.length for r in got) / size)


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    used, least = check(P.op7_packing(spark, sf), rows)
    assert used <= least + 1


def test_cases_and_rounds(spark):
    r = random.Random(1)
    rows = [(None, "a"), (1, None), (1, ""), (1, "same"), (1, "same"), (2, "x <|endoftext|> y"), (3, "日本語 👍 русский"), (4, "word " * 5000)]
    rows += [(10 + i, " ".join(r.choice(["tea", "of", "ea1", "é"]) for _ in range(r.randrange(1, 900)))) for i in range(300)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, length int")
    used, least = check(P.pack_pieces(P.pieces(df), shard_items=60), rows)
    assert used <= least * 1.03 + 1
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert P.pack_pieces(P.pieces(empty)).count() == 0


def test_pieces_that_do_not_pair(spark):
    parts = spark.createDataFrame([(i, 0, 0, 600, i) for i in range(200)], P.PIECE)
    got = P.pack_pieces(parts, shard_items=20).collect()
    assert len({r.sequence_id for r in got}) == 200 and {r.offset for r in got} == {0}


def test_crossover_keeps_all_pieces():
    r = random.Random(3)
    sizes = [r.randrange(1, 1024) for _ in range(300)]
    a, b = P.pack(sizes, 1024), P.pack(sorted(sizes), 1024)
    for _ in range(20):
        for c in (P.crossover(a, b, 1024, r), P.mutate(a, 1024, r)):
            assert sorted(x for g in c for x in g) == sorted(sizes)
            assert all(sum(g) <= 1024 for g in c)
    best = P.evolve(sizes, [], 1024, 6, 10, 0)
    assert len(best) <= len(P.pack(sorted(sizes, reverse=True), 1024))


def test_equal_rows_are_dealt_out(spark):
    """A third of all rows are alike: no shard takes them all."""
    parts = spark.createDataFrame([(7, 0, 0, 300, 1)] * 300 + [(i, 0, 0, 300 + i % 500, i) for i in range(600)], P.PIECE)
    n = parts.withColumn("row", P.F.monotonically_increasing_id())
    sizes = [r["count"] for r in P._dealt(n, 9, 100, 0).groupBy("shard").count().collect()]
    assert len(sizes) == 9 and max(sizes) < 160
    check_bins(P.pack_pieces(parts, shard_items=100).collect(), 900)


def check_bins(rows, n, size=1024):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by.values():
        at = 0
        for o, k in sorted(x):
            assert o == at
            at += k
        assert at <= size
    assert len(rows) == n
    return by


def test_positions_reach_the_sequences(spark):
    r = random.Random(2)
    rows = [(i, 0, 0, r.choice([1024, r.randrange(1, 1024)]), i, i / 2000) for i in range(2000)]
    rows += [(5000 + i, 0, 0, 200, i, 0.25) for i in range(700)] + [(9000, 0, 0, 5, 0, None)]
    parts = spark.createDataFrame(rows, P.PIECE + ", position double")
    got = P.pack_pieces(parts, shard_items=200).collect()
    by = check_bins(got, len(rows))
    assert len(by) <= 1.03 * math.ceil(sum(x[3] for x in rows) / 1024) + 1
    own = {x[0]: x[5] for x in rows}
    least = {}
    for x in got:
        if own[x.doc_id] is not None:
            least[x.sequence_id] = min(least.get(x.sequence_id, 2), own[x.doc_id])
    assert all(x.position == least.get(x.sequence_id, x.position) for x in got)
    near = [abs(own[x.doc_id] - x.position) < 0.15 for x in got if own[x.doc_id] is not None]
    assert sum(near) > 0.8 * len(near)


def test_random_texts_encode_as_the_vocabulary_says():
    r, t, e = random.Random(9), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), P.Encoder(None, None)
    letters = "abcdefgh ABC  \n\t0123456789'\".,;!?-_()éüßñçœĀŁž<|>$€…日本語я👍\u00a0\u200b\r"
    for _ in range(6000):
        x = "".join(r.choice(letters[:60] if r.random() < 0.7 else letters) for _ in range(r.randrange(1, 60)))
        assert list(e(x)) == t.encode(x, add_special_tokens=False).ids, repr(x)
