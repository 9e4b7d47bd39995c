"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.llm.common import cut


def connected_components(edges: DataFrame, salts: int = 8) -> DataFrame:
    """(node, component) of every node of edges (a, b); component is the smallest node reachable.

    Neighbour minima are aggregates (combined before the shuffle) joined back to the edges,
    never a list of neighbours, so a node with very many edges fits; the edges of a node are dealt over
    `salts` copies of its minimum. Nodes may be numbers or structs. Rounds end when the
    edge table no longer changes; every round is cut off by a checkpoint."""
    e = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    state, copies = None, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    salt = lambda x: F.pmod(F.xxhash64(x), F.lit(salts)).cast("int")
    while True:
        # large star: link every larger neighbour of u to the smallest neighbour of u
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"), copies.alias("salt"))
        large = both.where("v > u").withColumn("salt", salt("v")).join(low, ["u", "salt"]).select(F.col("v"), F.col("m")).where("v <> m").distinct()
        # small star: link every smaller neighbour of v, and v itself, to the smallest of them
        low = large.groupBy("v").agg(F.min("m").alias("s"))
        small = large.join(low, "v").select(F.col("m").alias("b"), F.col("s").alias("a")).union(low.select(F.col("v").alias("b"), F.col("s").alias("a")))
        e = cut(small.where("a <> b").select("a", "b").distinct())
        now = e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == state:
            return e.select(F.col("b").alias("node"), F.col("a").alias("component")).union(e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        state = now
