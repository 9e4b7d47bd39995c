"""Best-fit packing by a grouping genetic algorithm on islands.

A document is its token ids and an end mark, cut into pieces of `size` tokens (the first
piece takes the rest). Full pieces fill a sequence each. All others are dealt out
into shards of about `shard_items` pieces; each shard is one packing problem, and only the count of
its pieces of each length travels, since pieces of one length can stand for each other.

`islands` islands evolve a population for each shard. A chromosome is a set of bins. The
crossover injects the well-filled bins of one parent whole into the other, drops the
other's bins that use pieces already placed, and puts the displaced pieces back largest
first, each into the fullest bin that holds it. After an epoch each island's best
chromosome migrates to the next island. The best of all islands decides; bins of it that
stay below `keep_fill` are dissolved, and their pieces from all shards are dealt out and
packed once more, in shards four and then sixteen times as large. Rounds end with the one that has a single shard, or when a
round of the largest shards left over 9 in 10 of its pieces: what is left then doesn't pair.

Pieces may carry a `position` in training, from 0 to 1. Shards are then ranges of it (a range with too many pieces is dealt out
by row), so a sequence holds documents of one stretch of the curriculum, and the column becomes the sequence's position, the
smallest of its pieces: ordered by it, the sequences follow the curriculum, but for the few made of dissolved bins.

Defined cases: null and empty texts are the end mark alone; texts of any length are encoded whole; equal and null ids and
repeated rows are separate documents, dealt by row and not by content; pieces of one length are placed by id; an empty table
packs to nothing; other columns stay out.
"""

from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagewise.llm.common import cut

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Token ids of a byte-level BPE vocabulary.

    The tiktoken form of the vocabulary is some four times as fast; the tokenizers form,
    which defines the ids, takes the texts for which the two could differ: those with a
    special token's name or with characters beyond Latin letters (other Unicode tables)."""

    def __init__(self, json_path: str | None, rank_path: str | None) -> None:
        import base64

        import public_tokenizers as P
        import tiktoken

        self.json_path = json_path or P.path("byte_bpe_50k.json")
        with open(rank_path or P.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow, self.odd = None, re.compile("[^\x00-ɏ]|<\\|")

    def __call__(self, text: str) -> list[int]:
        if not self.odd.search(text):
            return self.fast.encode_ordinary(text)
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.json_path)
        return self.slow.encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end_id: int = 2, json_path: str | None = None, rank_path: str | None = None, position_col: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and with position_col its document's position."""

    def run(batches):
        encode = Encoder(json_path, rank_path)
        for b in batches:
            out, row = [[] for _ in range(5)], []
            for i, (doc, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1), strict=True)):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                start, k = 0, 0
                while start < len(ids):
                    n = (len(ids) - start) % size or size
                    for col, x in zip(out, (doc, k, start, n, zlib.crc32(ids[start : start + n].tobytes())), strict=True):
                        col.append(x)
                    row.append(i)
                    start, k = start + n, k + 1
            made = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            more = [c.take(pa.array(row, pa.int64())) for c in b.columns[2:]]
            yield pa.record_batch([*made, *more], names=["doc_id", "piece", "start", "length", "ids_crc32", *(["position"] if more else [])])

    more = [F.col(position_col).cast("double").alias("position")] if position_col else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *more)
    return rows.mapInArrow(run, PIECE + (", position double" if more else ""))


class Bins:
    """Bins under construction, found by the room that they have left."""

    def __init__(self, size: int) -> None:
        self.size, self.items, self.by_room, self.mask = size, [], [[] for _ in range(size + 1)], 0

    def add(self, items: list[int]) -> None:
        room = self.size - sum(items)
        self.by_room[room].append(len(self.items))
        self.mask |= 1 << room
        self.items.append(items)

    def best_fit(self, item: int) -> None:
        above = self.mask >> item
        if not above:
            self.add([item])
            return
        room = item + (above & -above).bit_length() - 1
        k = self.by_room[room].pop()
        if not self.by_room[room]:
            self.mask ^= 1 << room
        self.items[k].append(item)
        self.by_room[room - item].append(k)
        self.mask |= 1 << (room - item)


def fitness(bins: list[list[int]], size: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones (mean square of the fill)."""
    return -len(bins), sum((sum(b) / size) ** 2 for b in bins) / max(1, len(bins))


def pack(items, size: int) -> list[list[int]]:
    bins = Bins(size)
    for x in items:
        bins.best_fit(x)
    return bins.items


def crossover(a: list[list[int]], b: list[list[int]], size: int, r: random.Random) -> list[list[int]]:
    """Injects well-filled bins of a into b whole."""
    ranked = sorted(a, key=sum, reverse=True)
    inject = ranked[: r.randrange(len(ranked) // 4, 3 * len(ranked) // 4 + 1)]
    used = [0] * (size + 1)
    for g in inject:
        for x in g:
            used[x] += 1
    bins, displaced = Bins(size), []
    for g in inject:
        bins.add(list(g))
    for g in b:
        taken = [x for x in g if used[x]]
        if not taken:
            bins.add(list(g))
            continue
        for x in g:  # the bin has duplicates of injected pieces: it goes, its other pieces are displaced
            if used[x]:
                used[x] -= 1
            else:
                displaced.append(x)
    for x in sorted(displaced, reverse=True):
        bins.best_fit(x)
    return bins.items


def mutate(bins: list[list[int]], size: int, r: random.Random) -> list[list[int]]:
    """Dissolves the emptiest bins and a few others, and best-fits their pieces in a shuffled order of sizes."""
    ranked = sorted(bins, key=sum)
    n = max(2, len(bins) // 20)
    gone = {id(g) for g in ranked[:n]} | {id(g) for g in r.sample(bins, min(n, len(bins)))}
    out, displaced = Bins(size), []
    for g in bins:
        if id(g) in gone:
            displaced += g
        else:
            out.add(list(g))
    displaced.sort(key=lambda x: -x * r.uniform(0.8, 1))
    for x in displaced:
        out.best_fit(x)
    return out.items


def evolve(sizes: list[int], start: list[list[list[int]]], size: int, population: int, generations: int, seed: int) -> list[list[int]]:
    r, least = random.Random(seed), math.ceil(sum(sizes) / size)
    alive = list(start)
    down = sorted(sizes, reverse=True)
    if not alive:
        alive.append(pack(down, size))
    while len(alive) < population and min(map(len, alive)) > least:
        alive.append(pack(sorted(down, key=lambda x: -x * r.uniform(0.9, 1)), size))
    alive.sort(key=lambda c: fitness(c, size), reverse=True)
    for _ in range(generations):
        if len(alive[0]) <= least:
            break
        children = []
        for _ in range(population // 2):
            a, b = r.sample(alive[: max(2, population // 2)], 2) if len(alive) > 1 else (alive[0], alive[0])
            children += [crossover(a, b, size, r), mutate(a, size, r)]
        alive = sorted([*alive, *children], key=lambda c: fitness(c, size), reverse=True)[:population]
    return alive[0]


def _flat(bins: list[list[int]]) -> list[int]:
    return [x for g in bins for x in (*g, 0)]


def _unflat(flat) -> list[list[int]]:
    out: list[list[int]] = [[]]
    for x in flat:
        if x:
            out[-1].append(x)
        else:
            out.append([])
    return out[:-1]


def _epoch(state: DataFrame, size: int, population: int, generations: int, epoch: int) -> DataFrame:
    """state: shard, island, counts (length, pieces), best, migrant (bins, each ended by a 0)."""

    def run(batches):
        for b in batches:
            rows = []
            for x in b.to_pylist():
                start = [_unflat(c) for c in (x["best"], x["migrant"]) if c]
                sizes = [c["length"] for c in x["counts"] for _ in range(c["n"])]
                rows.append(_flat(evolve(sizes, start, size, population, generations, x["shard"] * 1000003 + x["island"] * 101 + epoch)))
            yield pa.record_batch([b.column("shard"), b.column("island"), b.column("counts"), pa.array(rows, pa.list_(pa.int32()))], names=["shard", "island", "counts", "best"])

    return state.select("shard", "island", "counts", "best", "migrant").mapInArrow(run, "shard int, island int, counts array<struct<length:int,n:int>>, best array<int>")


def _best_bins(items: DataFrame, spread: bool, size: int, islands: int, epochs: int, population: int, generations: int) -> DataFrame:
    """(shard, bins): the best chromosome of the islands of each shard."""
    none = F.array().cast("array<int>")
    counts = items.groupBy("shard", F.col("length").cast("int").alias("length")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    shards = counts.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("length", "n"))).alias("counts"))
    state = shards.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "counts", none.alias("best"), none.alias("migrant"))
    for epoch in range(epochs):
        if epoch:  # the elite of each island goes to the next one
            ring = state.groupBy("shard").agg(F.first("counts").alias("counts"), F.array_sort(F.collect_list(F.struct("island", "best"))).alias("elite"))
            state = ring.select("shard", "counts", "elite", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
            state = state.select("shard", "island", "counts", F.get("elite", F.col("island"))["best"].alias("best"), F.get("elite", F.pmod(F.col("island") - 1, F.lit(islands)))["best"].alias("migrant"))
        state = _epoch(state.repartition("shard", "island") if spread else state, size, population, generations, epoch)
    bins = F.size(F.filter("best", lambda x: x == 0))
    return state.groupBy("shard").agg(F.min_by("best", F.struct(bins, F.col("island"))).alias("bins"))


def _placer(columns: list[str], size: int, keep_fill: float, level: int, last: bool):
    def place(key, rows, best):
        shard = key[0].as_py()
        rows = rows.sort_by([(c, "ascending") for c in ("length", "doc_id", "piece", "ids_crc32", "row")])
        length = rows["length"].to_numpy()
        at = np.searchsorted(length, np.arange(size + 2)).tolist()  # the next piece of each length
        sequence, offset = np.full(len(length), -1), np.zeros(len(length), np.int64)
        for k, g in enumerate(_unflat(best["bins"][0].as_py())):
            if last or sum(g) >= keep_fill * size:
                o = 0
                for x in g:
                    sequence[at[x]], offset[at[x]] = (level << 54) | (shard << 22) | k, o
                    at[x], o = at[x] + 1, o + x
        out = [rows[c] for c in columns]
        if "position" in columns:  # of the sequence, its smallest
            p = rows["position"].to_numpy().copy()
            names, inverse = np.unique(sequence, return_inverse=True)
            least = np.full(len(names), np.inf)
            np.fmin.at(least, inverse, p)
            out[columns.index("position")] = pa.array(np.where(sequence >= 0, least[inverse], p))
        return pa.table([*out, pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    return place


def _dealt(pool: DataFrame, shards: int, per_shard: int, level: int) -> DataFrame:
    """pool with its shard: by row, or with a position by its range and, where a range holds too many, by row within it."""
    by_row = lambda n: F.pmod(F.xxhash64("row", F.lit(level)), n).cast("int")
    if shards == 1:
        return pool.withColumn("shard", F.lit(0))
    if "position" not in pool.columns:
        return pool.withColumn("shard", by_row(F.lit(shards)))
    cell = F.least(F.lit(shards - 1), F.greatest(F.lit(0), F.floor(F.coalesce("position", F.lit(1.0)) * shards))).cast("int")
    pool = pool.withColumn("cell", cell)
    split = pool.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / (2 * per_shard)).cast("int").alias("split"))
    first = Window.partitionBy().orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # one row a cell
    split = split.withColumn("first", F.coalesce(F.sum("split").over(first), F.lit(0)).cast("int"))
    return pool.join(split, "cell").withColumn("shard", F.col("first") + by_row(F.col("split"))).drop("cell", "split", "first")


def pack_pieces(parts: DataFrame, size: int = 1024, shard_items: int = 4096, islands: int = 3, epochs: int = 2, population: int = 6, generations: int = 8, keep_fill: float = 0.995) -> DataFrame:
    """parts (doc_id, piece, start, length, ids_crc32, maybe position) with sequence_id and offset."""
    columns = parts.columns
    parts = cut(parts.withColumn("row", F.monotonically_increasing_id()))
    full = parts.where(F.col("length") == size)
    pool = parts.where(F.col("length") < size)
    n, done, level, before = pool.count(), [], 0, 0
    while n:
        per_shard = shard_items * 4 ** min(level, 2)
        shards = math.ceil(n / per_shard)
        items = _dealt(pool, shards, per_shard, level)
        last = shards == 1 or level > 2 and n > 0.9 * before
        if shards == 1:  # at most per_shard rows
            items = items.coalesce(1)
        bins = _best_bins(items, shards > 1, size, islands, epochs, population, generations)
        # the dissolved bins' pieces are those that nothing was assigned to
        schema = f"{PIECE}{', position double' if 'position' in columns else ''}, row long, sequence_id long, offset long"
        placed = cut(items.groupBy("shard").cogroup(bins.groupBy("shard")).applyInArrow(_placer([*columns, "row"], size, keep_fill, level, last), schema))
        done.append(placed.where("sequence_id >= 0").drop("row"))
        pool = placed.where("sequence_id < 0").drop("sequence_id", "offset")
        n, level, before = (0 if last else pool.count()), level + 1, n
    # full pieces: sequences of their own, numbered after all levels
    out = full.select(*columns, (F.lit(1 << 61) + F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    for d in done:
        out = out.unionByName(d)
    return out


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack_pieces(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")))
