"""All pairs of vectors with an inner product of at least a bound, by pairs of blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a tile of products, and pairs of an output batch.
TILE, BATCH = 1 << 22, 1 << 15
#: Rows of a block.
BLOCK = 1 << 15


def n_blocks(rows: int, block: int) -> int:
    """Blocks of `block` rows, but up to twelve of 1024 rows or more: these are 78 cells, so that a small table has tasks enough."""
    return max(1, math.ceil(rows / block), min(12, math.ceil(rows / 1024)))


def _vectors(table: pa.Table, dim: int) -> np.ndarray:
    return table["v"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(table.num_rows, dim)


def _batches(v: np.ndarray, ids: np.ndarray, left: np.ndarray, right: np.ndarray, least: float, both: bool) -> Iterator[pa.RecordBatch]:
    """Batches of the pairs of left and right rows, and of their reverses if both."""
    height = max(1, TILE // max(1, len(right)))
    other = np.ascontiguousarray(v[right].T)
    for k in range(0, len(left), height):
        part = left[k : k + height]
        hit = np.flatnonzero((v[part] @ other >= least - 1e-9).ravel())
        for s in range(0, len(hit), BATCH):
            i, j = np.divmod(hit[s : s + BATCH], len(right))
            x, y = part[i], right[j]
            product = np.add.accumulate(v[x] * v[y], axis=1)[:, -1] if v.shape[1] else np.zeros(len(x))
            near = (product >= least) & (ids[x] != ids[y])
            x, y, product = ids[x[near]], ids[y[near]], product[near]
            for a, b in ((x, y), (y, x))[: 2 if both else 1]:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(product)], names=["query_id", "target_id", "identity"])


def similar_pairs(vectors: DataFrame, least: float = 0.3, block: int = BLOCK, within: str | None = None) -> DataFrame:
    """query_id, target_id, identity of all ordered pairs, whatever their labels; of rows that agree in the column `within`, if it is given.

    Exact, so its work and its result are quadratic in the rows; each row goes to one cell for each block, a cell holds two blocks
    and gives its pairs batch by batch. Rows without an id, and vectors that are null or hold a null, pair with nothing; only vectors of
    equal length are compared; equal ids are not paired."""
    kind = "FLOAT" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "DOUBLE"
    rows = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL)")
    rows = rows.selectExpr("CAST(vec_id AS LONG) AS id", f"CAST(embedding AS ARRAY<{kind}>) AS v", "size(embedding) AS dim", *([f"{within} AS part"] if within else []))
    rows = rows.where("part IS NOT NULL") if within else rows
    blocks = n_blocks(rows.count(), block)
    cells = rows.withColumn("own", F.expr(f"cast(pmod(xxhash64(id), {blocks}) as int)")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["dim", "c", "d", *(["part"] if within else [])]
    cells = cells.select("*", F.least("own", "other").alias("c"), F.greatest("own", "other").alias("d")).select(*keys, "own", "id", "v")

    def compare(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim, c, d = (k.as_py() for k in key[:3])
        table = pa.Table.from_batches(batches)
        own, ids, v = table["own"].to_numpy(), table["id"].to_numpy(), _vectors(table, dim)
        del table
        yield from _batches(v, ids, np.flatnonzero(own == c), np.flatnonzero(own == d), least, c != d)

    # Twice as many tasks as cells, as they are dealt by hash; by number, so that they aren't joined for their few bytes.
    cells = cells.repartition(min(blocks * (blocks + 1), 4096), *keys)
    return cells.groupBy(*keys).applyInArrow(compare, "query_id long, target_id long, identity double").withColumn("identity", F.round("identity", 6))
