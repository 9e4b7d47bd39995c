import random

import pytest
from oracle import compare
from pyspark.sql import functions as F

from stagewise.llm import mixing as M


def fill(sizes, weights, factor=1.5, cap=2.0):
    """Targets by repeated resharing."""
    total, target, free = factor * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        level = (total - sum(cap * sizes[i] for i in range(len(sizes)) if i not in free)) / sum(weights[i] for i in free)
        over = {i for i in free if level * weights[i] >= cap * sizes[i]}
        if not over:
            for i in free:
                target[i] = level * weights[i]
            break
        free -= over
        for i in over:
            target[i] = cap * sizes[i]
    return target


def test_query(spark, sf):
    compare(M.op8_mixing(spark, sf), sf, M.ORACLE)


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_taken(spark, seed):
    r = random.Random(seed)
    names = ["a", "é", "B", "日", None, "z", "empty"]
    rows = []
    for k, n in enumerate(names):
        for i in range(0 if n == "empty" else r.choice([1, 3, 40])):
            rows.append((" ".join(["w"] * r.choice([0, 1, 5, 50])) or None, len(rows), n, 3))
    rows.append(("", 999, "empty", 3))
    rows.append(("  ", 999, "empty", 3))
    df = spark.createDataFrame(rows, "text string, doc_id long, source string, size int")
    got = M.mix(df).collect()
    assert len(got) == len(rows)
    order = sorted({x[2] for x in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(len((t or "").split()) for t, _, s, _ in rows if s == n) for n in order]
    want = dict(zip(order, fill(sizes, [(3, 1, 2)[i % 3] for i in range(len(order))])))
    for n, size in zip(order, sizes):
        mine = [x for x in got if x.source == n]
        assert all(x.target == pytest.approx(want[n]) and x.source_size == size for x in mine)
        assert abs(sum(x.taken for x in mine) - want[n]) <= 1
        assert all(0 <= x.taken <= 2 * x.size for x in mine)
        assert all((x.positions == []) == (x.taken == 0) and (len(x.positions) - 1) * x.size < max(1, x.taken) <= max(1, len(x.positions) * x.size) for x in mine)
    assert sorted(map(repr, got)) == sorted(map(repr, M.mix(df.repartition(3)).collect()))


def test_schedule(spark):
    df = spark.createDataFrame([("w " * 10, i, s) for i in range(600) for s in "ab"], "text string, doc_id long, source string")
    got = [p for x in M.mix(df, tilts=(1.0,)).collect() for p in x.positions]
    assert len([p for p in got if p < 0.5]) / len(got) == pytest.approx(0.75, abs=0.03)


def test_blend(spark):
    rows = [(f"x{i} " + "w " * (i % 7), i, s, 1.0) for i in range(200) for s in "abc"] + [(None, 1000, "a", 1.0)]
    df = spark.createDataFrame(rows, "text string, doc_id long, source string, position double")
    plan = {(x.doc_id, x.source): x for x in M.mix(df).collect()}
    out = M.blend(df)
    assert out.columns == df.columns
    taken = {}
    for x in out.collect():
        taken[x.doc_id, x.source] = taken.get((x.doc_id, x.source), 0) + len(x.text.split())
    assert taken == {k: x.taken for k, x in plan.items() if x.taken}


def test_empty(spark):
    assert M.mix(spark.createDataFrame([], "text string, doc_id long, source string")).count() == 0


def test_repeated_rows_each_keep_their_words(spark):
    """Ten equal rows of 8 words: what the plan takes is what the mix holds."""
    for n in (10, 11, 3):
        df = spark.createDataFrame([(" ".join("abcdefgh"), 1, "s")] * n + [("x " * 7, None, "s")] * n + [("y", None, None)], "text string, doc_id long, source string")
        taken = sum(x.taken for x in M.mix(df).collect())
        assert sum(len(x.text.split()) for x in M.blend(df).collect()) == taken
        assert abs(taken - 1.5 * (15 * n + 1)) <= 2


def test_blend_is_in_the_order_of_training(spark):
    rows = [(f"{i} " + "w " * 9, i, s) for i in range(300) for s in "abc"]
    df = spark.createDataFrame(rows, "text string, doc_id long, source string")
    got = M.blend(df, tilts=(1.0, -1.0, 0.0), position_col="at").collect()
    assert [x.at for x in got] == sorted(x.at for x in got)
    early = [x.source for x in got[: len(got) // 4]]
    assert early.count("a") > 2 * early.count("b")
    plan = sorted((x.doc_id, x.source, p) for x in M.mix(df, tilts=(1.0, -1.0, 0.0)).collect() for p in x.positions)
    assert plan == sorted((x.doc_id, x.source, x.at) for x in got)


def test_clashing_columns_and_long_text(spark):
    schema = "text string, doc_id long, source string, row string, size string, key int, p_taken int, occurrences string, position double, named string, slice string"
    rows = [("w " * 300000, 1, "a", "r", "s", 1, 2, "o", 0.5, "n", "x"), (None, None, None, *[None] * 8), ("", 2, "a", *[None] * 8)]
    df = spark.createDataFrame(rows, schema)
    out = M.blend(df)
    assert out.columns == df.columns
    got = out.collect()
    assert {x.doc_id for x in got} == {1} and all(tuple(x)[3:] == rows[0][3:] for x in got)
    assert sum(len(x.text.split()) for x in got) == sum(x.taken for x in M.mix(df).collect()) > 0
    assert M.blend(df.limit(0)).count() == 0


def test_stored_order(spark, tmp_path):
    df = spark.createDataFrame([(f"{i} " + "w " * 9, i, s) for i in range(300) for s in "abc"], "text string, doc_id long, source string")
    assert M.stored_order(df, "at") is None
    M.blend(df, position_col="true").write.parquet(f"{tmp_path}/mixed")
    got = M.stored_order(spark.read.parquet(f"{tmp_path}/mixed"), "at").collect()
    assert [x.true for x in sorted(got, key=lambda x: x["at"])] == sorted(x.true for x in got)
    assert 0 <= min(x["at"] for x in got) and max(x["at"] for x in got) <= 1


def test_query_is_in_the_order_of_training(spark, sf, tmp_path):
    """The method ends with a range sort by position; documents that the mix leaves out come last."""
    out = M.op8_mixing(spark, sf)
    out.write.parquet(f"{tmp_path}/mixed")
    stored = M.stored_order(spark.read.parquet(f"{tmp_path}/mixed"), "at").collect()
    for got in (out.collect(), sorted(stored, key=lambda x: x["at"])):
        at = [2.0 if x.first_position is None else x.first_position for x in got]
        assert at == sorted(at) and len(set(at)) > 100
        assert all((x.first_position is None) == (x.taken == 0) for x in got)


def test_documents_left_out_are_dealt_evenly(spark):
    """They have no position, and one partition must not take them all."""
    df = spark.createDataFrame([("w " * 5, i, s) for i in range(4000) for s in "ab"] + [(None, i, "a") for i in range(4000)], "text string, doc_id long, source string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = M.mix(df).select("taken", F.spark_partition_id().alias("p")).groupBy("p").agg(F.sum((F.col("taken") == 0).cast("int")).alias("out"), F.count("*").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(x.n for x in parts) == 12000 and sum(x.out for x in parts) >= 4000
    assert max(x.n for x in parts) < 3 * 12000 / len(parts) and sum(x.out > 0 for x in parts) > 1
