"""Approximate nearest neighbours: a forest of random-projection trees.

The trees are fitted on a bounded sample (`sample` vectors): each node splits at the
median of a random projection. Their depth grows with the table, to leaves of some `leaf` vectors, as far as the sample can fit
medians (8 of it a leaf). Every vector is filed in one leaf of each tree. A query
searches all trees through one priority queue: the queue holds nodes of any tree, the
most promising first (the smallest margin on the way to a node says how surely the query
belongs below it), and leaves are taken until they hold `visits` times the number of
vectors. The query goes to those leaves, and their candidates are reranked by the exact inner product; a leaf whose best candidate
is below a query's k-th best so far costs the query one product.

`visits` is calibrated on the sample: the smallest budget that finds `recall` of the
sample's true neighbours by brute force. (The sample is sparser than the table, its
neighbours are farther, so the table's recall is higher.) It follows the data: for clustered vectors it is a small share, for
vectors without structure no tree can do with less than a large one, and work per query then grows with the table. Leaves over `leaf_rows`
vectors, as of many copies of one vector, are cut into salts. Vectors of a leaf are held, queries stream past them.

Defined cases: vectors that are null, zero, of another dimension, or hold null or
non-finite components take no part; with fewer than k candidates all are returned;
equal scores are ordered by id; rows of equal id and vector are one candidate, rows of equal id with other vectors one each, and query rows of
equal id share one list; a query's own id is never a candidate; empty tables give an empty result; other columns are not looked at.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagewise.llm.common import cut


class Forest:
    """Full binary trees in arrays: node k has the children 2k + 1 and 2k + 2."""

    def __init__(self, sample: np.ndarray, rows: int, trees: int, leaf: int, seed: int) -> None:
        r = np.random.default_rng(seed)
        self.depth = max(0, min(math.ceil(math.log2(max(1, rows) / leaf)), math.floor(math.log2(max(8, len(sample)) / 8))))
        self.trees, self.inner = trees, 2**self.depth - 1
        dim = sample.shape[1]
        self.planes = r.standard_normal((trees, self.inner, dim)) / math.sqrt(max(1, dim))
        self.at = np.zeros((trees, self.inner))
        for t in range(trees):
            node = np.zeros(len(sample), int)
            for k in range(self.inner):
                rows = np.flatnonzero(node == k)
                p = sample[rows] @ self.planes[t, k]
                self.at[t, k] = np.median(p) if len(p) else 0
                node[rows] = 2 * k + 1 + (p > self.at[t, k])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): the leaf of each row in each tree, from 0."""
        out = np.zeros((len(x), self.trees), np.int32)
        for t in range(self.trees):
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", x, self.planes[t][node]) > self.at[t][node]
                node = 2 * node + 1 + side
            out[:, t] = node - self.inner
        return out

    def search(self, margins: np.ndarray, sizes: np.ndarray, budget: float) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of the shared queue until their sizes reach the budget. margins: (trees, inner) of one query."""
        queue, got, taken = [(-math.inf, t, 0) for t in range(self.trees)], 0, []
        margins = margins.tolist()
        while queue and got < budget:
            p, t, k = heapq.heappop(queue)
            if k >= self.inner:
                taken.append((t, k - self.inner))
                got += sizes[t][k - self.inner]
                continue
            m = margins[t][k]
            heapq.heappush(queue, (max(p, -m), t, 2 * k + 2))
            heapq.heappush(queue, (max(p, m), t, 2 * k + 1))
        return taken

    def margins(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees, inner)."""
        return np.einsum("id,tkd->itk", x, self.planes, optimize=True) - self.at

    def calibrate(self, sample: np.ndarray, k: int, recall: float, queries: int = 200) -> float:
        """The smallest budget, in multiples of the number of rows, with that recall among the sample."""
        q = sample[:queries]
        score = q @ sample.T
        score[np.arange(len(q)), np.arange(len(q))] = -np.inf
        k = min(k, len(sample) - 1)
        if k < 1:
            return float(self.trees)
        true = np.argsort(-score, axis=1, kind="stable")[:, :k]
        leaf = self.leaves(sample)
        sizes = [np.bincount(leaf[:, t], minlength=self.inner + 1).tolist() for t in range(self.trees)]
        margins = self.margins(q)
        reach = []  # for each query and true neighbour: rows visited when it is found
        for i in range(len(q)):
            at = np.full((self.trees, self.inner + 1), np.inf)
            got = 0
            for t, x in self.search(margins[i], sizes, math.inf):
                got += sizes[t][x]
                at[t, x] = got
            reach.append(at[np.arange(self.trees), leaf[true[i]]].min(1))
        return float(np.quantile(np.concatenate(reach), recall)) / len(sample)


def _usable(v, dim: int):
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return v.isNotNull() & (F.size(v) == dim) & F.forall(v, fine) & F.exists(v, lambda x: x != 0)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = 8192, trees: int = 8, leaf: int = 400, recall: float = 0.95, leaf_rows: int = 20_000, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row of queries (same columns as vectors)."""
    kind = vectors.schema[vec_col].dataType
    double = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.DoubleType)
    dtype, vec = ("<f8" if double else "<f4"), F.col("v")
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>" if double else "array<float>").alias("v")).where(F.col("id").isNotNull() & vec.isNotNull())
    first = pick(vectors).where(F.size("v") > 0).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = first["d"] if first else 1
    rows, asked = pick(vectors).where(_usable(vec, dim)), pick(queries).where(_usable(vec, dim))
    got = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    fitted = np.array(got["v"].combine_chunks().flatten(), np.float64).reshape(-1, dim) if len(got) else np.zeros((0, dim))
    forest = Forest(fitted, rows.count(), trees, leaf, seed)
    visits = forest.calibrate(fitted, k, recall)

    def block(column) -> np.ndarray:
        return np.asarray(column.flatten()).astype(dtype).reshape(-1, dim)

    def file(batches):
        for b in batches:
            x = block(b.column(1))
            leaves = forest.leaves(x.astype(float))
            yield pa.record_batch([b.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(list(leaves), pa.list_(pa.int32()))], names=["id", "v", "leaves"])

    filed = cut(rows.mapInArrow(file, "id long, v binary, leaves array<int>"))
    # at most trees * leaves rows: bounded by the forest
    counts = filed.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").count().collect()
    sizes = np.zeros((trees, forest.inner + 1), np.int64)
    for c in counts:
        sizes[c["tree"], c["leaf"]] = c["count"]
    salts = np.maximum(1, -(-sizes // leaf_rows))
    budget, size_list = visits * sizes[0].sum(), sizes.tolist()
    columns = "tree int, leaf int, salt int, kind int, id long, v binary"

    def probe(batches):
        for b in batches:
            ids, x = b.column(0).to_numpy(), block(b.column(1))
            margins = forest.margins(x.astype(float))
            out = [(t, n, s, 1, int(ids[i]), x[i].tobytes()) for i in range(len(ids)) for t, n in forest.search(margins[i], size_list, budget) for s in range(salts[t, n])]
            if out:
                yield pa.record_batch([pa.array(c, k_) for c, k_ in zip(zip(*out, strict=True), (*[pa.int32()] * 4, pa.int64(), pa.binary()), strict=True)], names=[c.split()[0] for c in columns.split(", ")])

    salt_of = F.array(*(F.array(*(F.lit(int(s)) for s in row)) for row in salts)) if salts.max() > 1 else None
    index = filed.select("id", "v", F.posexplode("leaves").alias("tree", "leaf"))
    salt = F.pmod(F.xxhash64("id"), F.get(F.get(salt_of, F.col("tree")), F.col("leaf"))).cast("int") if salt_of is not None else F.lit(0)
    index = index.select("tree", "leaf", salt.alias("salt"), F.lit(0).alias("kind"), "id", "v")
    both = index.union(asked.repartition(F.col("id")).mapInArrow(probe, columns))
    both = both.repartition("tree", "leaf", "salt").sortWithinPartitions("tree", "leaf", "salt", "kind")

    def search(batches):
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # ids and scores of a query, best first
        worst: dict[int, float] = {}  # score of its k-th
        key, held, own, x = None, [], None, None

        def flush():
            ids = list(best)
            table = pa.record_batch([pa.array(ids, pa.int64()), pa.array([best[i][0] for i in ids], pa.list_(pa.int64())), pa.array([best[i][1] for i in ids], pa.list_(pa.float64()))], names=["query_id", "ids", "scores"])
            best.clear()
            worst.clear()
            return table

        def rank(ids: list[int], q: np.ndarray) -> None:
            rough = q @ x.T
            low = np.array([worst.get(i, -math.inf) for i in ids])
            for i in np.flatnonzero(rough.max(1) >= low - 1e-9 * (1 + np.abs(low))):
                least = low[i]
                if len(own) > k + 1:
                    least = max(least, -np.partition(-rough[i], k)[k])  # one more than k: the query itself may be among them
                near = np.flatnonzero((rough[i] >= least - 1e-9 * (1 + abs(least))) & (own != ids[i]))
                found, score = own[near], (x[near] * q[i]).sum(1)  # the same sum for the same numbers, wherever they stand
                if ids[i] in best:
                    found, score = (np.concatenate(y) for y in zip(best[ids[i]], (found, score), strict=True))
                order = np.lexsort((found, -score))
                if len(order) > 1:  # a vector is met in several trees
                    f, s = found[order], score[order]
                    order = order[np.r_[True, (f[1:] != f[:-1]) | (s[1:] != s[:-1])]]
                best[ids[i]] = found[order[:k]], score[order[:k]]
                if len(order) >= k:
                    worst[ids[i]] = score[order[k - 1]]

        for b in batches:
            tree, leaf_, salt_, what, ids = (b.column(i).to_numpy() for i in range(5))
            vectors = np.frombuffer(b"".join(b.column(5).to_pylist()), dtype).reshape(-1, dim)
            new = np.flatnonzero(np.r_[True, (tree[1:] != tree[:-1]) | (leaf_[1:] != leaf_[:-1]) | (salt_[1:] != salt_[:-1]) | (what[1:] != what[:-1])]) if len(ids) else []
            for a, e in zip(new, [*new[1:], len(ids)], strict=True):
                if (tree[a], leaf_[a], salt_[a]) != key:
                    key, held, x = (tree[a], leaf_[a], salt_[a]), [], None
                if what[a] == 0:  # the leaf's vectors come before its queries
                    held.append((ids[a:e], vectors[a:e].astype(float)))
                elif held:
                    if x is None:
                        own, x = (np.concatenate(y) for y in zip(*held, strict=True))
                    for c in range(a, e, 256):
                        rank(ids[c : min(e, c + 256)].tolist(), vectors[c : min(e, c + 256)].astype(float))
            if len(best) > 50_000:
                yield flush()
        if best:
            yield flush()

    found = both.mapInArrow(search, "query_id long, ids array<long>, scores array<double>")
    merged = found.groupBy("query_id").agg(F.flatten(F.collect_list(F.arrays_zip((F.transform("scores", lambda s: -s)).alias("s"), F.col("ids").alias("i")))).alias("all"))
    top = F.slice(F.array_sort(F.array_distinct("all")), 1, k)
    return merged.select("query_id", F.posexplode(top).alias("pos", "x")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score"))


def op2_nearest(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
