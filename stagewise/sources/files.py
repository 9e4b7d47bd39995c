"""Delimited, line and FASTA files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_tsv(spark: SparkSession, path: str, key: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """All columns as text; rows without a key are left out. A byte order mark before the header is dropped."""
    df = spark.read.csv(path, sep="\t", header=True, encoding=encoding, quote="")
    df = df.toDF(*[c.removeprefix("﻿").removeprefix("ï»¿") for c in df.columns])
    return df.where(F.trim(F.coalesce(F.col(key), F.lit(""))) != "")


def write_tsv(df: DataFrame, path: str, encoding: str = "ISO-8859-1") -> None:
    df.write.csv(path, sep="\t", header=True, encoding=encoding, quote="", emptyValue="")


def write_chat(records: DataFrame, path: str) -> None:
    """One {"messages": [...]} to a line, shortest record first over all part files in their order."""
    message = lambda role: F.struct(F.lit(role).alias("role"), F.col(f"{role}_text").alias("content"))
    size = sum((F.length(f"{r}_text") for r in ("system", "user", "assistant")), F.lit(0))
    line = F.to_json(F.struct(F.array(message("system"), message("user"), message("assistant")).alias("messages")))
    records.select(F.floor(size / 4).alias("tokens"), line.alias("value")).orderBy("tokens", "value").select("value").write.text(path)


def read_chat(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("messages array<struct<role string, content string>>").json(path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """header, sequence of each record; a sequence may span lines."""
    r = spark.read.option("lineSep", ">").text(path).where("value <> ''")
    return r.select(F.trim(F.substring_index("value", "\n", 1)).alias("header"), F.regexp_replace(F.expr("substr(value, instr(value, '\n') + 1)"), r"\s", "").alias("sequence"))
