"""Near-dedup by SimHash, verified on sets of word shingles.

Fingerprints of many words and the generalised pigeonhole search of `simhash` find candidates: a pair at the least similarity meets
in some group of bits with probability `recall`, more similar pairs with more, and only pairs whose first two words (kept out of the
groups) differ in few bits are linked. The components of these links hold every candidate pair.
Within a component all pairs are compared on the whole shingle sets, and only pairs at `least` or more are
linked; the links' components are the groups. A component over `limit` sets or `volume` shingles is dealt out over
pairs of chunks: exact, but its work is quadratic in the component.

Defined cases: shingles are compared by their 64-bit hashes; texts with equal sets are one group, null and empty ones
too; a text under `shingle` words is one shingle; texts of any length count whole. Rows count one by one, whatever their ids: of
each group exactly one row stays, that with the smallest id (a missing id is larger than any), then the smallest row hash; of equal
rows any one. A pair at exactly the least similarity is linked. An empty table stays empty; other columns pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.llm.common import cut
from stagewise.llm.components import connected_components
from stagewise.llm.simhash import Near, differing, likely_plan, majorities, search, shape, shingle_hashes, words_sample

KEY = ["_k1", "_k2"]


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text or b"", shingle))


def set_key(s: np.ndarray) -> int:
    """One 64-bit name of a set of hashes."""
    import xxhash

    return xxhash.xxh64_intdigest(s.tobytes(), 1)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_k1", F.xxhash64(*docs.columns)).withColumn("_k2", F.xxhash64(F.lit(1), *docs.columns))


def signatures(rows: DataFrame, id_col: str, text_col: str, shingle: int, n: int) -> DataFrame:
    """_k1, _k2, doc_id, node (the set's name), size, words (n * 64 bits of its fingerprint) of every row."""

    def run(batches):
        for b in batches:
            node, size, words = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.int64), np.zeros((b.num_rows, n), np.uint64)
            for i, x in enumerate(b.column(3).cast(pa.binary())):
                s = shingle_set(x.as_py(), shingle)
                node[i], size[i], words[i] = set_key(s), len(s), majorities(s, n)
            yield pa.record_batch([*b.columns[:3], pa.array(node.view(np.int64)), pa.array(size), pa.array(list(words.view(np.int64)), pa.list_(pa.int64()))], names=[*KEY, "doc_id", "node", "size", "words"])

    return rows.select(*KEY, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "_k1 long, _k2 long, doc_id long, node long, size long, words array<long>")


def candidates(nodes: DataFrame, total: int, m: int, n: int, least: float, recall: float, plan_sample: int = 1024) -> DataFrame:
    """(node, component) of the sets that have a candidate. nodes: node, words (2 that only verify, and n in groups of 64 / m bits)."""
    points = nodes.select(F.lit(0).cast("long").alias("least"), F.col("node").alias("id"), F.col("words")[0].alias("fp"), F.col("words")[1].alias("fp2"), F.slice("words", 3, F.size("words") - 2).alias("words"))
    parts = likely_plan(words_sample(points, plan_sample, n), total, m, least, recall)
    d = differing(least)
    bits = lambda n, z: int(n * d + z * (n * d * (1 - d)) ** 0.5)
    return connected_components(search(points, parts, Near(bits(64, 4), bits(128, 3.5))).select("a", "b"))


def exact_links(sets: list[np.ndarray], least: tuple[int, int] = (4, 5)) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose Jaccard similarity is at least the fraction `least`."""
    p, q = least
    size = np.array([len(s) for s in sets])
    ids, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)[np.argsort(at, kind="stable")]  # the sets of each shingle, shingle by shingle
    held = np.bincount(at, minlength=len(ids))
    first, start = np.cumsum(held) - held, np.cumsum(size) - size
    left, out = np.arange(len(sets)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            mine = at[start[x] : start[x] + size[x]]
            n = held[mine]
            where = np.repeat(first[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            common = np.bincount(owner[where], minlength=len(sets))[left]
            near = common * (p + q) >= p * (size[x] + size[left])  # common >= p / q of the union
            out += [(int(x), int(y)) for y in left[near]]
            queue += left[near].tolist()
            left = left[~near]
    return out


def verified(cells: DataFrame, least: tuple[int, int] = (4, 5)) -> DataFrame:
    """(a, b): links of the sets of each cell. cells: component, c, d, node, shingles."""

    def settle(group):
        sets = [np.frombuffer(x, np.uint64) for _, x in group]
        return [(group[i][0], group[j][0]) for i, j in exact_links(sets, least)] if len(sets) > 1 else []

    def run(batches):
        held, key = [], None
        for b in batches:
            out = []
            for *k, node, x in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if k != key:
                    out += settle(held)
                    held, key = [], k
                held.append((node, x))
            yield pa.record_batch([pa.array([x[i] for x in out], pa.int64()) for i in range(2)], names=["a", "b"])
        out = settle(held)
        yield pa.record_batch([pa.array([x[i] for x in out], pa.int64()) for i in range(2)], names=["a", "b"])

    rows = cells.select("component", "c", "d", "node", "shingles")
    return rows.repartition("component", "c", "d").sortWithinPartitions("component", "c", "d", "node").mapInArrow(run, "a long, b long")


def groups(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: tuple[int, int] = (4, 5), recall: float = 0.99, limit: int = 256, volume: int = 1 << 19, salts: int = 32) -> tuple[DataFrame, DataFrame]:
    """Keyed rows -> (_k1, _k2, n of every distinct row, _k1 and _k2 of the row that stays of each group)."""
    total, similarity = max(1, rows.count()), least[0] / least[1]
    m, n = shape(total, similarity, recall)
    every = cut(signatures(rows, id_col, text_col, shingle, n + 2))
    keys = every.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    nodes = cut(every.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *KEY)).alias("best"), F.max("size").alias("size"), F.first("words").alias("words")))
    loose = cut(candidates(nodes.where("size > 0"), total, m, n, similarity, recall))
    # large components are few, and their members find them by one of several copies of their row
    whole = loose.join(nodes.select("node", "size"), "node").groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / limit), F.ceil(F.sum("size") / volume)).cast("int").alias("chunks"))
    whole = whole.where("chunks > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    members = loose.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int")).join(whole, ["component", "salt"], "left").select("node", "component", F.coalesce("chunks", F.lit(1)).alias("chunks"))
    members = members.join(nodes, "node").select("node", "component", "chunks", "best._k1", "best._k2")
    found = rows.select(*KEY, F.col(text_col).alias("text")).join(members, KEY)
    if not keys.where("n > 1").isEmpty():  # equal rows: one set
        found = found.dropDuplicates(["node"])

    def run(batches):
        for b in batches:
            sets = [shingle_set(x.as_py(), shingle).tobytes() for x in b.column(3).cast(pa.binary())]
            yield pa.record_batch([*b.columns[:3], pa.array(sets, pa.binary())], names=["node", "component", "chunks", "shingles"])

    sets = found.select("node", "component", "chunks", "text").mapInArrow(run, "node long, component long, chunks int, shingles binary")
    sets = sets.withColumn("own", F.expr("cast(pmod(xxhash64(node), chunks) as int)")).withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    links = verified(sets.withColumn("c", F.least("own", "other")).withColumn("d", F.greatest("own", "other")), least)
    of = connected_components(links)
    best = nodes.join(of, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("best").alias("best"))
    return keys, best.select("best._k1", "best._k2")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one row of each group."""
    places = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # names that can't clash with the keys
    rows = keyed(docs.toDF(*places.values()))
    back = [F.col(p).alias(c) for c, p in places.items()]
    keys, stay = groups(rows, places[id_col], places[text_col], **how)
    keys, stay = cut(keys), cut(stay)
    gone = keys.select(*KEY).join(stay, KEY, "left_anti")
    repeated = keys.where("n > 1").join(stay, KEY, "left_semi").select(*KEY)
    if repeated.isEmpty():
        return rows.join(gone, KEY, "left_anti").select(*back)
    once = rows.join(repeated, KEY, "left_semi").dropDuplicates(KEY)
    return rows.join(gone.union(repeated), KEY, "left_anti").union(once).select(*back)
