"""Mixing sources to target weights as a time-varying curriculum.

Each source has a target in words (water filling: weights share the demand, a target
stops at `cap` times its source's size and the excess goes to the others by weight) and
a schedule, the rate at which training consumes it at time t in [0, 1]. Rates are linear:
w(t) = target * (1 + tilt * (1 - 2t)), so a source with a tilt above zero comes early and one below zero late; `tilts`
(between -1 and 1) go to the sources in turn, by code point like the weights. The integral, the cumulative demand
target * (t + tilt * (t - t^2)), is inverted for the words that stand before an occurrence of a document in its source: that
is its position in training. A source's documents occur in a fixed pseudo-random order, pass after pass, for as long as the
words before an occurrence are fewer than the demand at t = 1; the last occurrence gives only the words still asked for.
`mix` returns these occurrences, `taken` is the sum of their words, and `blend` writes them out. Both are range-sorted by position, `blend`
by that of every occurrence and `mix`, which has one row for each document, by that of the first; what is not taken comes last, by hash.

Prefix sums run in three levels (256 slices of the order, 256 in each, then documents), so no task sees a whole source. The
plan is carried on the row itself, so rows that agree in everything each keep their own share.

Defined cases: null text has no words; a null source is a source of its own, the last; the order is that of a hash of id and
text, so a rerun differs at most in which of identical rows is cut (rows that agree in id and text share a slice); sources of
size 0 and texts without words take nothing, whatever their length; ties of sources in `cap / weight` are ordered by name; an
empty table gives an empty mix; other columns stay out of `mix` and pass through `blend` unread, whatever their names.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagewise.llm.quality_rules import words_of

SLICE = 4  # hex digits of a document's hash that name its slice


def targets(sources: DataFrame, factor: float = 1.5, cap: float = 2.0, weights=(3, 1, 2), tilts=(0.0,)) -> DataFrame:
    """sources (source, source_size, others) -> with weight, tilt and target. One row for each source, all in one task."""
    w = Window.orderBy(F.col("source").asc_nulls_last())
    turn = lambda values: F.get(F.array(*(F.lit(float(x)) for x in values)), ((F.col("turn") - 1) % len(values)).cast("int"))
    s = sources.withColumn("turn", F.row_number().over(w))
    s = s.withColumn("weight", turn(weights)).withColumn("tilt", turn(tilts)).drop("turn")
    # sources reach their cap in the order of cap / weight; what those before and with a source take is known by prefix sums
    order = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    s = s.withColumn("total", factor * F.sum("source_size").over(every))
    s = s.withColumn("level", F.greatest(F.lit(0.0), (F.col("total") - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)))
    s = s.withColumn("full", F.col("level") * F.col("weight") >= cap * F.col("source_size"))
    # the level at the first source that is not filled holds for all from there on
    s = s.withColumn("level", F.min(F.when(~F.col("full"), F.struct(F.col("source_size") / F.col("weight"), F.col("level")))).over(every)["level"])
    return s.select(*sources.columns, "weight", "tilt", F.least(cap * F.col("source_size"), F.coalesce(F.col("level") * F.col("weight"), cap * F.col("source_size"))).alias("target"))


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, factor: float, cap: float, weights, tilts, carry: bool) -> DataFrame:
    """doc_id, source, size, source_size, target, occurrences (position, words) of every row, and with carry the row itself as a struct."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(text)))
    named = F.when(F.col(source_col).isNull(), "").otherwise(F.concat(F.lit("="), F.col(source_col).cast("string")))  # never null: joins and windows share one exchange
    held = [F.struct(*docs.columns).alias("row")] if carry else []
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), named.alias("named"), F.size(words_of(F.col(text_col))).cast("long").alias("size"), key.alias("key"), *held)
    sized = sized.withColumn("slice", F.substring("key", 1, SLICE))
    per_slice = sized.groupBy("named", "slice").agg(F.first("source").alias("source"), F.sum("size").alias("slice_size"))
    per_slice = per_slice.withColumn("coarse", F.substring("slice", 1, SLICE // 2))
    coarse = per_slice.groupBy("named", "coarse").agg(F.first("source").alias("source"), F.sum("slice_size").alias("coarse_size"))
    of = targets(coarse.groupBy("named").agg(F.first("source").alias("source"), F.sum("coarse_size").alias("source_size")), factor, cap, weights, tilts)
    coarse = coarse.withColumn("coarse_before", F.sum("coarse_size").over(Window.partitionBy("named").orderBy("coarse")) - F.col("coarse_size"))
    coarse = coarse.drop("source", "coarse_size").join(of.drop("source"), "named")
    slices = per_slice.withColumn("slice_before", F.sum("slice_size").over(Window.partitionBy("named", "coarse").orderBy("slice")) - F.col("slice_size"))
    slices = slices.select("named", "coarse", "slice", "slice_before").join(coarse, ["named", "coarse"])
    slices = slices.withColumn("slice_before", F.col("coarse_before") + F.col("slice_before")).drop("coarse", "coarse_before")
    rows = sized.withColumn("inside", F.sum("size").over(Window.partitionBy("named", "slice").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    rows = rows.join(slices, ["named", "slice"]).withColumn("before", F.col("slice_before") + F.col("inside"))
    demand = F.round(F.col("target")).cast("long")
    n = F.when((F.col("size") > 0) & (demand > F.col("before")), F.ceil((demand - F.col("before")) / F.col("source_size"))).otherwise(0).cast("int")
    k = F.col("tilt")

    def occurrence(c):
        done = F.col("before") + c * F.col("source_size")  # words of the source before this one
        share = done / F.col("target")
        t = F.when(k == 0, share).otherwise(((1 + k) - F.sqrt(F.greatest(F.lit(0.0), (1 + k) * (1 + k) - 4 * k * share))) / (2 * k))
        return F.struct(F.least(F.lit(1.0), t).alias("position"), F.least(F.col("size"), demand - done).alias("words"))

    occurrences = F.transform(F.slice(F.sequence(F.lit(0), n), F.lit(1), n), occurrence)
    return rows.select("doc_id", "source", "size", "source_size", "target", occurrences.alias("occurrences"), F.xxhash64("key").alias("deal"), *(["row"] if carry else []))


def _in_order(rows: DataFrame, *by: str) -> DataFrame:
    """rows range-sorted over all partitions, nulls last."""
    by = [F.col(c).asc_nulls_last() for c in by]
    return rows.repartitionByRange(*by).sortWithinPartitions(*by)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", factor: float = 1.5, cap: float = 2.0, weights=(3, 1, 2), tilts=(0.5, -0.5, 0.0)) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, positions (in training, 0 to 1, of each occurrence).

    Documents come in the order of training by their first occurrence, those not taken last."""
    rows = _planned(docs, id_col, text_col, source_col, factor, cap, weights, tilts, carry=False)
    taken = F.aggregate("occurrences", F.lit(0).cast("long"), lambda n, x: n + x["words"])
    rows = rows.withColumns({"taken": taken, "positions": F.col("occurrences.position"), "first": F.get("occurrences.position", F.lit(0))}).drop("occurrences")
    return _in_order(rows, "first", "deal").select("doc_id", "source", "size", "source_size", "target", "taken", "positions")


def blend(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", factor: float = 1.5, cap: float = 2.0, weights=(3, 1, 2), tilts=(0.5, -0.5, 0.0), position_col: str | None = None) -> DataFrame:
    """The mix itself: docs' columns, a row for each occurrence (of the last, its first words only), range-sorted by training position.

    position_col adds the position under that name."""
    rows = _planned(docs, id_col, text_col, source_col, factor, cap, weights, tilts, carry=True).select("row", "size", F.explode("occurrences").alias("at"))
    rows = _in_order(rows.select("row", "size", "at.position", "at.words"), "position")
    text = F.col("row").getField(text_col)
    text = F.when(F.col("words") >= F.col("size"), text).otherwise(F.array_join(F.slice(words_of(text), F.lit(1), F.col("words").cast("int")), " "))
    out = [(text if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns]
    return rows.select(*out, *([F.col("position").alias(position_col)] if position_col else []))


def stored_order(docs: DataFrame, position_col: str) -> DataFrame | None:
    """docs with their place, from 0 to 1, in the order in which a range-sorted table was written; None if docs aren't read from files.

    Files count by their part number, rows by their place in the file: two numbers of the whole table come to the driver."""
    try:
        at = docs.select("*", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).alias(f"{position_col}_part"), F.col("_metadata.row_index").alias(f"{position_col}_row"))
    except AnalysisException:
        return None
    part, row = F.coalesce(F.expr(f"try_cast({position_col}_part AS bigint)"), F.lit(0)), F.col(f"{position_col}_row")
    parts, rows = at.agg(F.max(part), F.max(row)).first()
    return at.withColumn(position_col, (part + row / ((rows or 0) + 1)) / ((parts or 0) + 1)).drop(f"{position_col}_part", f"{position_col}_row")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", "taken", F.size("positions").alias("passes"), F.get("positions", F.lit(0)).alias("first_position"))


ORACLE = r"""
WITH docs AS (
  SELECT doc_id, source, md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', md5(coalesce(text, '')))) AS key,
    CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
    [0.5::DOUBLE, -0.5::DOUBLE, 0.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS tilt FROM docs GROUP BY source
), levels AS (
  SELECT *, greatest(0.0::DOUBLE, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level FROM sources
  WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST)
), level AS (
  SELECT arg_min(level, source_size / weight) AS level FROM levels WHERE level * weight < 2.0::DOUBLE * source_size
), targets AS (
  SELECT source, source_size, tilt, least(2.0::DOUBLE * source_size, coalesce(level.level * weight, 2.0::DOUBLE * source_size)) AS target FROM levels, level
), placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.tilt AS k, CAST(round(t.target) AS BIGINT) AS demand,
    CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS before
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), counted AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE (SELECT count(*) FROM range(0, 3) AS r(c) WHERE before + r.c * source_size < demand) END AS passes,
    before / target AS share FROM placed
)
SELECT doc_id, size, source_size, target, CAST(passes AS INTEGER) AS passes,
  CASE WHEN passes = 0 THEN 0 ELSE (passes - 1) * size + least(size, demand - before - (passes - 1) * source_size) END::BIGINT AS taken,
  CASE WHEN passes > 0 THEN least(1.0::DOUBLE, CASE WHEN k = 0 THEN share ELSE ((1 + k) - sqrt(greatest(0.0::DOUBLE, (1 + k) * (1 + k) - 4 * k * share))) / (2 * k) END) END AS first_position
FROM counted
"""
