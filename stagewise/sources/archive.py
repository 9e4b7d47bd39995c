"""Reading an XML archive of targets into flat tables, and FASTA out of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """_id string, name string, status string,
    sequence array<struct<_type string, _VALUE string>>,
    trial array<struct<_id string, status string, history array<struct<_date string, _status string>>>>"""


def read_targets(spark: SparkSession, path: str, tag: str = "target") -> DataFrame:
    """One row for each element `tag`; malformed parts become null instead of ending the read. Files are read in parallel."""
    return spark.read.format("xml").option("rowTag", tag).option("mode", "PERMISSIVE").schema(SCHEMA).load(path)


def clean_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_sequence(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"\s", ""))


def sequences(raw: DataFrame) -> DataFrame:
    """target_id, seq_idx, kind, sequence, seq_md5 ('' for an empty sequence), seq_len, is_primary.

    Primary is the longest protein sequence, else the longest of any kind; the first of equals."""
    s = raw.select(F.col("_id").alias("target_id"), F.posexplode("sequence").alias("seq_idx", "q"))
    text = F.coalesce(clean_sequence(F.col("q._VALUE")), F.lit(""))
    s = s.select("target_id", "seq_idx", F.col("q._type").alias("kind"), text.alias("sequence"))
    s = s.withColumns({"seq_md5": F.when(F.col("sequence") != "", F.md5("sequence")).otherwise(""), "seq_len": F.length("sequence")})
    rank = F.struct(F.coalesce(F.lower("kind") == "protein", F.lit(False)), "seq_len", -F.col("seq_idx"))
    best = s.groupBy(F.col("target_id").alias("t")).agg(F.max_by("seq_idx", rank).alias("best"))
    return s.join(best, F.col("target_id") == F.col("t")).withColumn("is_primary", F.col("seq_idx") == F.col("best")).drop("t", "best")


def targets(raw: DataFrame) -> DataFrame:
    dates = F.flatten(F.transform(F.coalesce("trial", F.array().cast("array<struct<_id:string,status:string,history:array<struct<_date:string,_status:string>>>>")), lambda t: F.transform(F.coalesce(t["history"], F.array().cast("array<struct<_date:string,_status:string>>")), lambda h: h["_date"])))
    return raw.select(
        F.col("_id").alias("target_id"), F.substring_index("_id", "-", 1).alias("centre"), clean_text(F.col("name")).alias("name"), clean_text(F.col("status")).alias("status_raw"),
        F.coalesce(F.size("sequence"), F.lit(0)).alias("n_sequences"), F.coalesce(F.size("trial"), F.lit(0)).alias("n_trials"), F.array_min(dates).alias("first_seen"), F.array_max(dates).alias("last_seen"),
    )


def history(raw: DataFrame) -> DataFrame:
    """target_id, trial_id, status_raw, status_date: one row for each event."""
    t = raw.select(F.col("_id").alias("target_id"), F.explode("trial").alias("t"))
    h = t.select("target_id", F.expr("try_cast(t._id AS BIGINT)").alias("trial_id"), F.explode("t.history").alias("h"))
    return h.select("target_id", "trial_id", clean_text(F.col("h._status")).alias("status_raw"), strict_date(F.col("h._date")).alias("status_date"))


def strict_date(c: Column) -> Column:
    """A date only for year-month-day; '2010' and '2010-06' are no dates."""
    return F.when(c.rlike(r"^\s*\d{4}-\d{1,2}-\d{1,2}\s*$"), F.try_to_date(F.trim(c)))


def write_fasta(seqs: DataFrame, path: str) -> None:
    """One record for each distinct sequence, headed by its md5."""
    one = seqs.where("sequence <> ''").dropDuplicates(["seq_md5"])
    one.select(F.concat(F.lit(">"), "seq_md5", F.lit("\n"), "sequence").alias("value")).write.text(path)
