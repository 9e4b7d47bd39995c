"""Quality rules by cross-document line frequency, on DataFrame functions only.

Two kinds of rule decide on a document. Base rules look at it alone: too few words, or
too many words in repeated 3-word windows. The line rule looks across documents: lines
are normalised (lower case, digits to 0, white space to one space) and hashed, and for
each host (source) the distinct documents that hold a line are counted. A
line above the limit, `max(min_docs, share * documents of the host)`, is boilerplate and
is removed; a document that keeps less than `least_kept` of its words is depleted and is
rejected. A document is an id with its text: copies under several ids are several documents, a row that is
repeated in whole counts once.

Texts are named by their hash, so the lines of many copies are counted by one row for each distinct text and line, weighted by
the text's documents; counts are combined before the shuffle, and only lines above their limit are joined back.

Defined cases: null text has no words and fails; a null source is a host of its own; rows with equal or null ids are separate
rows here and get the verdict of their own text, but count as one document if their texts agree too; a count equal to its limit
is not above it; texts of any length are compared by their words, not by hashes alone; an empty table gives an empty
result; other columns are not looked at, and pass through `keep_good` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise.llm.common import SPLIT, cut


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPLIT), lambda w: w != "")


def n_repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found at least twice.

    Each window becomes one long, its hash with the low bits replaced by its position; sorted, equal windows
    are neighbours. Those that have such a neighbour are sorted once more, by their words, and only neighbours of equal
    words count; their positions are merged."""

    def packed(w):
        n = F.size(w)
        high = -F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double")))).cast("long")

        def one(m):
            h = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
            return F.transform(F.sequence(F.lit(0), n - 3), lambda i: h(i).bitwiseAND(m).bitwiseOR(i.cast("long")))

        def alike(s, m):  # positions that may repeat
            top = lambda x: x.bitwiseAND(m)
            at = F.filter(s, lambda x, k: (top(x) == top(F.get(s, k - 1))) | (top(x) == top(F.get(s, k + 1))))
            return F.transform(at, lambda x: x.bitwiseAND(F.bitwise_not(m)).cast("int"))

        def covered(s):  # windows in the order of their words
            same = lambda a, b: (a["a"] == b["a"]) & (a["b"] == b["b"]) & (a["c"] == b["c"])
            at = F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))
            at = F.sort_array(F.transform(at, lambda x: x["i"].cast("long")))
            start = F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
            step_ = lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(3).cast("long"), x - acc["last"])).alias("n"))
            return F.aggregate(at, start, step_, lambda acc: acc["n"])

        window = lambda i: F.struct(F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("i"))
        by_words = lambda at: F.when(F.size(at) == 0, F.lit(0).cast("long")).otherwise(_let(F.sort_array(F.transform(at, window)), covered))
        return _let(high, lambda m: _let(F.sort_array(one(m)), lambda s: _let(alike(s, m), by_words)))

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(_let(words, packed))


def line_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = 10, share: float = 0.1, least_kept: float = 0.5, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each input row: doc_id, the base counts, base_failed, n_line_words (removed by the line rule), kept, the hashes of
    its lines above the limit (r_lines, null if none), and the columns to carry as c_<name>."""
    held = [F.col(c).alias(f"c_{c}") for c in carry]
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = words_of(F.col(text_col))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text).alias("content"),
        F.col(host_col).alias("host"),
        words.alias("w"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        *held,
    )
    base = base.select(
        "doc_id", "content", "host", "n_symbols", F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("w").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        n_repeat_words(F.col("w")).alias("n_repeat_words"), *(f"c_{c}" for c in carry),
    )
    base = base.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    removed = removed_words(docs, id_col, text_col, host_col, min_docs, share)
    out = base.join(removed, (base.content == removed.r_content) & base.host.eqNullSafe(removed.r_host), "left")
    depleted = F.coalesce(F.col("n_line_words"), F.lit(0)) > (1 - least_kept) * F.col("n_words")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~depleted).alias("kept"), F.coalesce("n_line_words", F.lit(0).cast("long")).alias("n_line_words"), "r_lines", *(f"c_{c}" for c in carry),
    )


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **options) -> DataFrame:
    """The documents that are kept, without their lines above the limit; docs' columns."""
    out = line_rules(docs, id_col, text_col, host_col, carry=tuple(docs.columns), **options).where("kept")
    text, common = F.col(f"c_{text_col}"), F.col("r_lines")
    fresh = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(common, F.xxhash64(F.trim(_normal(x)))))
    clean = F.when(common.isNull(), text).otherwise(F.array_join(fresh, "\n"))
    return out.select(*((clean if c == text_col else F.col(f"c_{c}")).alias(c) for c in docs.columns))


def _normal(text: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(text), "123456789", "000000000"), r"[\x20\x09\x0B-\x0D]+", " ")


def removed_words(docs: DataFrame, id_col: str, text_col: str, host_col: str, min_docs: int, share: float, small: int = 200_000) -> DataFrame:
    """(r_content, r_host, n_line_words, r_lines) of each distinct text of a host that has lines above their limit.

    Texts of several documents are broadcast if there are at most `small` of them (some 10 MB), else shuffled."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(host_col).alias("host"), F.xxhash64(text).alias("content"), F.explode(F.split(_normal(text), "\n")).alias("line"))
    rows = rows.select("host", "content", F.trim("line").alias("line")).where(F.col("line") != "")
    rows = rows.select("host", "content", F.xxhash64("line").alias("line"), (F.length("line") - F.length(F.translate("line", " ", "")) + 1).cast("long").alias("words"))
    # a text's rows and documents within a host; a line's words within a text are summed over its repeats and the text's rows
    copies = docs.groupBy(F.col(host_col).alias("host"), F.xxhash64(text).alias("content"), F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("rows"))
    copies = cut(copies.groupBy("host", "content").agg(F.sum("rows").alias("copies"), F.count(F.lit(1)).alias("documents")))
    # every line has words; the test keeps the sum in all three uses of held, so that they read one shuffle
    held = rows.groupBy("host", "content", "line").agg(F.sum("words").alias("words")).where("words > 0")
    limits = copies.groupBy("host").agg(F.greatest(F.lit(float(min_docs)), share * F.sum("documents")).alias("most"))
    of = copies.select(F.col("host").alias("k_host"), F.col("content").alias("k_content"), "copies", "documents")
    # texts of one document each are counted without a join: few have more
    several = of.where("documents > 1")
    if several.count() <= small:
        several = F.broadcast(several)
    more = held.join(several, (held.content == F.col("k_content")) & held.host.eqNullSafe(F.col("k_host"))).select("host", "line", (F.col("documents") - 1).alias("n"))
    common = held.select("host", "line", F.lit(1).cast("long").alias("n")).union(more).groupBy("host", "line").agg(F.sum("n").alias("n")).where(F.col("n") > min_docs)
    common = common.join(limits, common.host.eqNullSafe(limits.host)).where(F.col("n") > F.col("most")).select(common.host.alias("c_host"), F.col("line").alias("c_line"))
    hit = held.join(common, held.host.eqNullSafe(F.col("c_host")) & (held.line == F.col("c_line")))
    hit = hit.groupBy("host", "content").agg(F.sum("words").alias("words"), F.collect_set("line").alias("r_lines")).join(of, (F.col("content") == F.col("k_content")) & F.col("host").eqNullSafe(F.col("k_host")))
    return hit.select(F.col("content").alias("r_content"), F.col("host").alias("r_host"), F.expr("words div copies").alias("n_line_words"), "r_lines")


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    return line_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("r_lines")


_W = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

ORACLE = rf"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS text, {_W} AS w FROM documents
), windows AS (
  SELECT rid, i, w[i:i+2] AS g FROM base, LATERAL unnest(range(1, greatest(len(w) - 1, 1))) AS t(i)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT i + d) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS d) GROUP BY rid
), lines AS (
  SELECT rid, doc_id, host, text, line FROM base, LATERAL unnest(string_split(text, chr(10))) AS t(line)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dup AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY rid
), normal AS (
  SELECT rid, doc_id, host, text, trim(regexp_replace(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]', '0', 'g')) AS line,
    len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words FROM lines
), common AS (
  SELECT n.host, n.line FROM (SELECT host, line, count(DISTINCT (doc_id, text)) AS n FROM normal GROUP BY ALL) n
  JOIN (SELECT host, count(DISTINCT (doc_id, text)) AS docs FROM base GROUP BY host) h ON n.host IS NOT DISTINCT FROM h.host
  WHERE n.n > greatest(10, 0.1 * h.docs)
), gone AS (
  SELECT rid, sum(words) AS n FROM normal n JOIN common c ON n.host IS NOT DISTINCT FROM c.host AND n.line = c.line GROUP BY rid
), counts AS (
  SELECT b.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(d.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(g.n, 0) AS BIGINT) AS n_line_words
  FROM base b LEFT JOIN covered c USING (rid) LEFT JOIN dup d USING (rid) LEFT JOIN gone g USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (n_line_words > 0.5 * n_words) AS kept, n_line_words
FROM counts
"""
