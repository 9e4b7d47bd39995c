"""Every stage of the pipeline against plain Python, on its own input."""

import re

import numpy as np
import pytest
from oracle import sql_rows
from test_shingle_dedup import shingles

import corpus_pipeline as C
from stagewise.llm import mixing, quality_rules, secret_scan


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    folder, out = tmp_path_factory.mktemp("stages"), []
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (_, stage) in enumerate(C.STAGES):
        out.append(docs.collect())
        stage(spark, docs, sf).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k < 4:
            assert docs.columns == spark.read.parquet(f"{sf}/documents.parquet").columns
    return [*out, docs.collect()]


def test_quality(stages, sf):
    names, rows = sql_rows(sf, quality_rules.ORACLE)
    kept = {r[names.index("doc_id")] for r in rows if r[names.index("kept")]}
    assert {r.doc_id for r in stages[1]} == kept
    before = {r.doc_id: r for r in stages[0]}
    assert all(set(r.text.split("\n")) <= set(before[r.doc_id].text.split("\n")) and r.n_chars == len(r.text) for r in stages[1])


def test_near_dedup(stages):
    """All pairs by the similarity of their five-word shingle sets; one row of each group stays."""
    rows = stages[1]
    sets = [shingles(r.text) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in stages[2]) == sorted(least.values())
    text = {r.doc_id: r.text for r in rows}
    assert all(r.text == text[r.doc_id] for r in stages[2])


def test_secrets(stages):
    compiled = [(re.compile(p, re.ASCII), n, g) for _, p, n, g in secret_scan.RULES]
    before = {r.doc_id: r.text for r in stages[2]}
    assert sorted(before) == sorted(r.doc_id for r in stages[3])
    for r in stages[3]:
        found = secret_scan.scan_text(before[r.doc_id], compiled)
        assert (r.text == before[r.doc_id]) == (not found)
        assert not secret_scan.scan_text(r.text, compiled)


def test_mix(stages, spark):
    docs = spark.createDataFrame(stages[3])
    plan = {r.doc_id: r.taken for r in mixing.mix(docs).collect() if r.taken}
    got = {}
    for r in stages[4]:
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
    assert got == plan


def test_pack(stages):
    from collections import Counter

    from test_packing import expected

    rows = stages[5]
    want = expected([(r.doc_id, r.text) for r in stages[4]])
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == Counter(want)
    fill = np.zeros(len(rows))
    ids = {s: i for i, s in enumerate({r.sequence_id for r in rows})}
    for r in rows:
        fill[ids[r.sequence_id]] += r.length
    assert fill.max() <= 1024


def test_run(spark, sf, stages):
    assert C.run(spark, sf).count() == len(stages[5])


COLUMNS = ["text", "doc_id", "lang", "source", "n_chars", "_k1", "_k2", "blob", "spans", "clean", "row", "size", "position", "content", "host", "node", "c0"]
ODD = "text string, doc_id long, lang string, source string, n_chars int, _k1 string, _k2 long, blob string, spans int, clean string, row int, size string, position double, content string, host int, node string, c0 int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, long and repeated texts, shared ids, and columns named like those the operators use."""
    own = lambda k, n=80: " ".join(f"w{k}x{i}" for i in range(n))
    more = ("k", 1, "b", 2, "c", 3, "s", 0.5, "t", 4, "n", 5)
    texts = [(None, 1), ("", 2), (" \n ", 3), (own(1), 10), (own(1), 10), (own(1), 11), (own(1), None), (own(2), 11), (own(3, 150000), 12), (own(4) + " token=abcdefghijklmnop", 13), (own(5), None), (own(6), 14)]
    rows = [(t, d, None if d == 10 else "en", None if d in (12, 14) else "s", None if t is None else len(t), *(more if k % 2 else [None] * 12)) for k, (t, d) in enumerate(texts)]
    return spark.createDataFrame(rows, ODD)


@pytest.mark.parametrize("k", range(5))
def test_odd_input(spark, sf, odd, k):
    out = C.STAGES[k][1](spark, odd, sf)
    assert C.STAGES[k][1](spark, odd.limit(0), sf).count() == 0
    got = out.collect()
    if k < 4:
        assert out.columns == COLUMNS
        before = {(r.doc_id, r.text): tuple(r)[5:] for r in odd.collect()}
        assert all(tuple(r)[5:] in before.values() for r in got)
    ids = sorted((r.doc_id for r in got), key=repr)
    if k == 0:  # the copies and the others stay, what has no words goes
        assert ids == sorted([10, 10, 11, None, 11, 12, 13, None, 14], key=repr)
    elif k == 1:  # one of the empty ones, one of the copies
        assert ids == sorted([1, 10, 11, 12, 13, None, 14], key=repr)
    elif k == 2:
        assert len(got) == 12 and [r.text for r in got if r.doc_id == 13][0].endswith(" <assign>") and {r.text for r in got if r.doc_id == 1} == {None}
    elif k == 3:
        assert sum(len((r.text or "").split()) for r in got) == sum(r.taken for r in mixing.mix(odd).collect()) > 150000
    else:
        assert sum(r.piece == 0 for r in got) == 12


def test_pack_follows_the_mix(spark, sf, stages, tmp_path):
    """Pieces of the pipeline's last stage carry the place where mixing wrote their documents."""
    spark.createDataFrame([(f"{i} " + "tea " * 300, i) for i in range(500)], "text string, doc_id long").repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    own = {r.doc_id: r.position for r in mixing.stored_order(docs, "position").collect()}
    assert [own[i] for i in range(500)] == sorted(own.values())
    got, least = C.pack(spark, docs, sf).collect(), {}
    for r in got:
        least[r.sequence_id] = min(least.get(r.sequence_id, 2), own[r.doc_id])
    assert len(got) == 500 and all(r.position == least[r.sequence_id] for r in got)
    assert "position" in stages[5][0].asDict()
