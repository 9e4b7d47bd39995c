"""Names and lineages in a taxonomy tree."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stagewise.session import stored

# Fixed values, in the order in which they count.
SUPERKINGDOMS = ("Bacteria", "Archaea", "Eukaryota", "Viruses")
SYNONYMS = ("synonym", "equivalent name", "genbank synonym")


def _field(k: int) -> Column:
    return F.trim(F.get(F.split("value", r"\t\|\t?"), F.lit(k)))


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("encoding", "ISO-8859-1").text(path)
    return lines.select(_field(0).cast("long").alias("taxid"), _field(1).cast("long").alias("parent"), _field(2).alias("rank"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("encoding", "ISO-8859-1").text(path)
    return lines.select(_field(0).cast("long").alias("taxid"), _field(1).alias("name"), _field(3).alias("class"))


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(_field(0).cast("long").alias("old"), _field(1).cast("long").alias("new"))


def scientific(names: DataFrame) -> DataFrame:
    return names.where(F.col("class") == "scientific name").groupBy("taxid").agg(F.min("name").alias("name"))


def lookup(names: DataFrame) -> DataFrame:
    """key (lower case), taxid: a scientific name counts before a synonym, then the smaller id."""
    n = names.where(F.col("class").isin("scientific name", *SYNONYMS))
    return n.groupBy(F.lower("name").alias("key")).agg(F.min(F.struct((F.col("class") != "scientific name").alias("late"), "taxid"))["taxid"].alias("taxid"))


def resolve_ids(ids: DataFrame, column: str, nodes: DataFrame, merged: DataFrame) -> DataFrame:
    """ids with taxid: redirected if merged, null if not in the tree."""
    j = ids.join(merged, F.expr(f"try_cast(trim({column}) AS BIGINT)") == F.col("old"), "left")
    j = j.withColumn("_id", F.coalesce("new", F.expr(f"try_cast(trim({column}) AS BIGINT)"))).drop("old", "new")
    return j.join(nodes.select("taxid"), F.col("_id") == F.col("taxid"), "left").drop("_id")


def resolve_names(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """rows with taxid by the whole name, then ever shorter beginnings of two words or more, then the first word; else null.

    Each distinct name is looked up once, so a frequent organism costs one row."""
    shorter = F.when(F.size("w") > 2, F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda k: F.struct((F.size("w") - k).alias("r"), F.array_join(F.slice("w", 1, k), " ").alias("key"))))
    genus = F.array(F.struct(F.lit(1 << 20).alias("r"), F.get("w", F.lit(0)).alias("key")))
    tried = rows.select(F.col(column).alias("_name")).where("trim(_name) <> ''").distinct().withColumn("w", F.split(F.trim(F.lower("_name")), r"\s+"))
    empty = F.array().cast("array<struct<r:int,key:string>>")
    whole = F.array(F.struct(F.lit(0).alias("r"), F.trim(F.lower("_name")).alias("key")))
    tried = tried.select("_name", F.explode(F.concat(whole, F.coalesce(shorter, empty), genus)).alias("c")).select("_name", "c.r", "c.key")
    found = tried.join(keys, "key").groupBy("_name").agg(F.min_by("taxid", "r").alias("taxid"))
    return rows.join(found, F.col(column) == F.col("_name"), "left").drop("_name")


def lineage(nodes: DataFrame, max_depth: int = 64) -> DataFrame:
    """taxid, path: (taxid, rank, name) from the node up to below the root (id 1, or a parent not in the tree).

    Each round joins every path to the path of its last parent, so that lengths double: six rounds reach
    64 levels. A cycle ends where a node would come again."""
    here = F.array(F.struct("taxid", "rank", F.coalesce("name", F.lit("")).alias("name")))
    out = nodes.select("taxid", F.when(F.col("taxid") == 1, F.slice(here, 1, 0)).otherwise(here).alias("path"), F.when((F.col("taxid") != 1) & ~F.col("parent").isin(0, 1), F.col("parent")).alias("next"))
    for _ in range(max(1, math.ceil(math.log2(max_depth)))):
        up = out.select(F.col("taxid").alias("u"), F.col("path").alias("u_path"), F.col("next").alias("u_next"))
        j = out.join(up, F.col("next") == F.col("u"), "left").withColumn("both", F.when(F.col("u").isNull(), F.col("path")).otherwise(F.array_distinct(F.concat("path", "u_path"))))
        grows = F.size("both") == F.size("path") + F.size("u_path")
        out = stored(j.select("taxid", F.col("both").alias("path"), F.when(grows, F.col("u_next")).alias("next")), "lineage")
        if out.where("next IS NOT NULL").isEmpty():
            break
    return out.select("taxid", "path")


def classify(paths: DataFrame, ranks: tuple[str, ...] = ("kingdom", "phylum", "class", "order", "family", "genus"), kingdoms: tuple[str, ...] = SUPERKINGDOMS) -> DataFrame:
    """taxid, superkingdom (by name anywhere in the path, the first of the list that occurs) and the nearest name of each rank; '' for none."""
    names = F.transform("path", lambda x: x["name"])
    top = F.coalesce(*[F.when(F.array_contains(names, k), k) for k in kingdoms], F.lit(""))
    nearest = lambda r: F.coalesce(F.get(F.filter("path", lambda x: x["rank"] == r), F.lit(0))["name"], F.lit("")).alias(f"tax_{r}")
    return paths.select("taxid", top.alias("superkingdom"), *map(nearest, ranks))
