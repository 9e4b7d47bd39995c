from oracle import compare, sql_rows
from pyspark.sql import functions as F

from stagewise.llm import quality_rules as Q


def test_query(spark, sf):
    compare(Q.op9_quality_rules(spark, sf), sf, Q.ORACLE)


def brute(text):
    w = (text or "").encode().split()
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    return len({i + d for v in at.values() if len(v) > 1 for i in v for d in range(3)})


def test_repeats_and_cases(spark):
    texts = [None, "", " \n\n", "a b", "a b c", "a a a a", "a b c a b c", " x y x y x y x z\n\nx y x", "é ü\x0bé ü\x0cé ü", "q r s t u v " * 300, "日 本 " * 5]
    rows = [(t, i, None if i % 2 else "h", 7) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in Q.line_rules(spark.createDataFrame(rows, "text string, doc_id long, source string, kept int")).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i].n_repeat_words == brute(t), t
        assert got[i].n_words == len((t or "").split())
    assert got[2].n_dup_lines == 0 and got[7].n_dup_lines == 0
    assert Q.line_rules(spark.createDataFrame([], "text string, doc_id long, source string")).count() == 0


def test_line_rule(spark):
    letters = lambda n: "".join("abcdefghij"[int(d)] for d in str(n))

    def doc(i, n):
        return "\n".join(["Cookie   notice 12: accept all of this " * 6] + [f"{letters(1000 * i + k)} text of its own" for k in range(n)])

    copy = "\n".join(" ".join(letters(k) + x for x in ("line", "of", "the", "copy")) for k in range(20))
    rows = [(doc(i, 30), i, "h") for i in range(40)] + [(doc(40, 6), 40, "h")] + [(copy, 50 + k, "h") for k in range(30)]
    got = {r.doc_id: r for r in Q.line_rules(spark.createDataFrame(rows, "text string, doc_id long, source string")).collect()}
    assert all(got[i].n_line_words == 42 for i in range(41))
    assert got[40].n_words == 72 and not got[40].kept
    assert got[40].n_line_words > 0.5 * got[40].n_words
    # a text that 30 documents copy is boilerplate of the host like any other; one document repeated is not
    assert all(got[50 + k].n_line_words == 80 and not got[50 + k].kept for k in range(30))
    again = [(copy, 7, "h")] * 30 + [(doc(i, 30), i, "h") for i in range(10, 30)]
    got = Q.line_rules(spark.createDataFrame(again, "text string, doc_id long, source string")).where("doc_id = 7").collect()
    assert len(got) == 30 and all(r.n_line_words == 0 and r.kept for r in got)


def test_ids_that_are_null_or_shared(spark, tmp_path):
    """Against the SQL: repeated rows, ids shared by texts, null ids and hosts, ties at the limit."""
    page = lambda k: "\n".join([f"shared line of the host number {'abcdefghij'[k % 3]}"] + [f"own {'abcdefghij'[i]} {'abcdefghij'[k // 10]}{'abcdefghij'[k % 10]} of text" for i in range(10)])
    rows = [(page(k), None if k % 7 == 0 else k // 2, None if k % 5 == 0 else "h") for k in range(70)] + [(page(1), 0, "h")] * 12 + [(page(2), 1000 + k, None) for k in range(12)] + [(page(3), 2000 + k, "h") for k in range(10)]
    df = spark.createDataFrame(rows, "text string, doc_id long, source string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    import duckdb

    want = duckdb.connect().execute(Q.ORACLE.replace("FROM documents", f"FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")).fetchall()
    got = Q.op9_quality_rules(spark, str(tmp_path)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_line_words").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert any(r.n_line_words for r in got) and any(not r.n_line_words for r in got)


def test_very_long_texts_are_exact(spark):
    """Five million words without a repeat, but for one window."""
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(5_000_000)), lambda i: F.when(i == 4_900_000, F.lit("7")).when(i == 4_900_001, F.lit("8")).when(i == 4_900_002, F.lit("9")).otherwise(i.cast("string"))))
    df = spark.range(1).select(words.alias("text"))
    assert df.select(Q.n_repeat_words(Q.words_of(F.col("text"))).alias("n")).first().n == 6


def test_clashing_columns(spark):
    schema = "text string, doc_id long, source string, content string, w int, kept string, words int, r_lines string, host string, copies int"
    long = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(long, 1, "s", "c", 1, "k", 2, "r", "h", 3), ("short", 2, "s", *[None] * 7)], schema)
    assert [tuple(r) for r in Q.keep_good(df).collect()] == [(long, 1, "s", "c", 1, "k", 2, "r", "h", 3)]
    assert Q.keep_good(df.limit(0)).count() == 0


def test_no_python(spark, sf):
    import io
    from contextlib import redirect_stdout

    out = io.StringIO()
    with redirect_stdout(out):
        Q.op9_quality_rules(spark, sf).explain()
    assert "Python" not in out.getvalue() and "Arrow" not in out.getvalue() and "NestedLoop" not in out.getvalue()


def test_sql_has_rows(sf):
    assert sql_rows(sf, Q.ORACLE)[1]


def test_many_copied_texts_are_shuffled(spark):
    rows = [(f"line {k % 4} of it\nown {k % 6}", k, "h") for k in range(48)]
    df = spark.createDataFrame(rows, "text string, doc_id long, source string")
    got = [sorted(map(tuple, Q.removed_words(df, "doc_id", "text", "source", 5, 0.1, small).drop("r_lines").collect())) for small in (0, 200_000)]
    assert got[0] == got[1] and got[0]
