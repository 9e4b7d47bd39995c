"""SimHash near-dedup with the generalised pigeonhole principle.

Fingerprints that differ in at most t bits agree, for any split of the bits into groups
with thresholds e_i where the sum of (e_i + 1) is t + 1, in some group up to e_i bits. Correlated bits
are put into one group, since a group of independent bits tells texts apart best, and
thresholds are allotted by dynamic programming on the estimated cost of each (group,
threshold): probes made plus candidate pairs to verify. The estimate uses a bounded
sample of fingerprints (`plan_sample`); the plan only changes the cost, never the result.
Every candidate is verified on all bits.

For texts whose shingle sets are similar (`shape`, `likely_plan`) the bits that differ are many and their number is random, so
no narrow radius holds them. There the fingerprint is longer (majority bits of further hashes of the same shingles), and the
same program allots thresholds until the chance that a pair at the least similarity meets in some group reaches `recall`: a group
where such a pair agrees with probability P brings -ln(1 - P) of the -ln(1 - recall) needed. Groups grow with the number of
texts, so that chance meetings of unrelated texts stay in proportion to it; the price is more groups, N^0.24 of them at 0.8.

The verified links that meet in a task are reduced to stars around the smallest member, so
a group of k near copies gives fewer than k rows; buckets over `limit` fingerprints are dealt out
over pairs of chunks. Only distinct fingerprints take part. Nodes are named by (smallest doc_id, fingerprint), so a component's
name holds its answer and is not looked up; the one join on the fingerprint has one row of each on the small side, and a
fingerprint that many documents share is split by the skew handling of the adaptive planner.

Defined cases: null and empty texts have the fingerprint zero and are linked like any
other; texts of any length are fingerprinted whole; documents with equal ids and repeated rows share a component only if linked (equal
texts always are); a component of documents that all lack an id has a null id; ties for the smallest id cannot arise; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.llm.common import cut, mix64
from stagewise.llm.components import connected_components


def majorities(h: np.ndarray, words: int) -> np.ndarray:
    """words * 64 bits: those that are set in over half of the hashes h, then of further hashes made from h."""
    many = np.empty((len(h), words), np.uint64)
    for w in range(words):
        many[:, w] = mix64(h ^ mix64(np.full(1, w, np.uint64) * np.uint64(0x9E3779B97F4A7C15))) if w else h
    count = np.zeros(64 * words, np.int64)
    for k in range(0, len(h), 255):  # sums that fit a byte
        count += np.add.reduce(np.unpackbits(many[k : k + 255].view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * count > len(h), bitorder="little").view(np.uint64)


def majority(h: np.ndarray) -> int:
    return int(majorities(h, 1)[0])


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of the shingles of words, repeats included; one of all words if there are fewer."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    if n == 1:
        return np.array([digest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[: n - 1] + 1].tolist()
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(doc_id, fp): the 64 majority bits as a signed long."""

    def run(batches):
        for b in batches:
            fp = np.array([majority(shingle_hashes(x.as_py() or b"", shingle)) for x in b.column(1).cast(pa.binary())], np.uint64)
            yield pa.record_batch([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def group_bits(sample: np.ndarray, m: int) -> list[list[int]]:
    """m groups of about equal size; each takes next the bit most correlated with those it has."""
    bits = np.unpackbits(np.ascontiguousarray(sample).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    bits -= bits.mean(0)
    spread = np.sqrt((bits**2).sum(0))
    like = np.abs(bits.T @ bits) / np.maximum(np.outer(spread, spread), 1e-12)
    free, groups = list(range(64)), []
    for k in range(m):
        group = [free.pop(0)]
        while len(group) < (64 - sum(map(len, groups))) // (m - k):
            best = max(free, key=lambda b: (like[b, group].sum(), -b))
            free.remove(best)
            group.append(best)
        groups.append(sorted(group))
    return groups


def allot(groups: list[tuple[int, list[int]]], sample: np.ndarray, total: int, need: int, units: Callable[[int, int], int], probe_cost: float = 100.0) -> tuple[float, list[int]]:
    """Thresholds (-1 skips a group, 0 or 1) with units(size of the group, threshold) that add up to `need` at least and the least estimated cost.

    groups: (word, bits). sample: (rows, words). Cost: probe_cost for each probe, 1 for each candidate pair."""
    costs = []
    for word, g in groups:
        part = sample[:, word] & np.uint64(sum(1 << b for b in g))
        near = np.zeros(2)
        for k in range(len(part)):
            d = np.bitwise_count(part[k + 1 :] ^ part[k])
            near += [np.count_nonzero(d == 0), np.count_nonzero(d <= 1)]
        pairs = max(1, len(part) * (len(part) - 1) / 2)
        by_chance = np.array([1, 1 + len(g)]) / 2.0 ** len(g)
        near = np.maximum(near / pairs, by_chance) * total * (total - 1) / 2
        costs.append([0, probe_cost * total + near[0], probe_cost * total * (1 + len(g) / 2) + near[1]])
    best = {0: (0.0, [])}
    for (_, g), c in zip(groups, costs, strict=True):
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, es) in best.items():
            for e in (-1, 0, 1):
                k = min(need, used + (units(len(g), e) if e >= 0 else 0))
                if k not in nxt or cost + c[e + 1] < nxt[k][0]:
                    nxt[k] = (cost + c[e + 1], [*es, e])
        best = nxt
    return best.get(need, (math.inf, []))


def _parts(groups: list[tuple[int, list[int]]], es: list[int]) -> list[tuple[int, int, int, list[int]]]:
    return [(w, sum(1 << b for b in g), e, g) for (w, g), e in zip(groups, es, strict=True) if e >= 0]


def plan(sample: np.ndarray, total: int, t: int) -> list[tuple[int, int, int, list[int]]]:
    """(word, mask, threshold, bits) of the groups of one word that are probed so that no pair within t bits is missed, for the cheapest number of groups."""
    found = []
    for m in range(max(1, (t + 2) // 2), min(t + 1, 32) + 1):
        groups = [(0, g) for g in group_bits(sample, m)]
        cost, es = allot(groups, sample[:, None], total, t + 1, lambda _, e: e + 1)
        if es:
            found.append((cost, m, _parts(groups, es)))
    return min(found)[2]


def differing(least: float) -> float:
    """The share of bits that differ between the fingerprints of sets of that Jaccard similarity (sets of equal size differ most)."""
    return math.acos(2 * least / (1 + least)) / math.pi


def _meets(k: float, e: int, least: float) -> float:
    """The chance that k bits of such a pair differ in at most e."""
    d = differing(least)
    return (1 - d) ** k + (k * d * (1 - d) ** (k - 1) if e else 0.0)


def shape(total: int, least: float, recall: float, probe_cost: float = 100.0) -> tuple[int, int]:
    """How many groups to make of a word, and of how many words a fingerprint needs them, for the least cost by chance alone."""

    def cost(m: int) -> tuple[float, int, int]:
        n = math.log(1 - recall) / math.log(1 - _meets(64 / m, 0, least))
        return n * (probe_cost * total + total * total / 2 / 2.0 ** (64 / m)), m, math.ceil(1.1 * n / m)

    return min(cost(m) for m in range(1, 9))[1:]


def likely_plan(sample: np.ndarray, total: int, m: int, least: float, recall: float) -> list[tuple[int, int, int, list[int]]]:
    """Groups of all words with thresholds for which a pair of the least similarity meets in one with probability `recall`."""
    groups = [(w, g) for w in range(sample.shape[1]) for g in group_bits(sample[:, w], m)]
    scale = 1000
    return _parts(groups, allot(groups, sample, total, math.ceil(-math.log(1 - recall) * scale), lambda k, e: math.floor(-math.log(1 - _meets(k, e, least)) * scale))[1])


#: Stands for a missing id, which is larger than any other.
NO_ID = (1 << 63) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Near:
    """The link test: at most t of the 64 bits differ and, if given, at most both_t of all 128."""

    def __init__(self, t: int, both_t: int | None) -> None:
        self.t, self.both_t = t, both_t

    def __call__(self, a, a2, b, b2) -> np.ndarray:
        d = np.bitwise_count(a ^ b)
        near = d <= self.t
        if self.both_t is not None and near.any():
            near &= d + np.bitwise_count(a2 ^ b2) <= self.both_t
        return near


def forest(fps: np.ndarray, fps2: np.ndarray, near: Near) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places that connect what all near pairs connect: all of them if they are few, else a spanning forest."""
    a, b, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for k in range(0, len(fps), 256):
        i, j = np.nonzero(near(fps[k : k + 256, None], fps2[k : k + 256, None], fps[None, k:], fps2[None, k:]))
        i, j = i[j > i], j[j > i]
        a.append(k + i)
        b.append(k + j)
        n += len(i)
        if n > 2 * len(fps):
            break
    else:
        return np.concatenate(a), np.concatenate(b)
    left, a, b = np.arange(len(fps)), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            at = near(fps[left], fps2[left], fps[x], fps2[x])
            if at.any():
                a.append(np.full(at.sum(), x))
                b.append(left[at])
                queue.extend(left[at].tolist())
                left = left[~at]
    return np.concatenate(a), np.concatenate(b)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row (smallest member, member) for each other member of the components of the links a - b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        if (low == label[x]).all() and (low == label[y]).all():
            break
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (label[label] != label).any():
            label = label[label]
    other = label != np.arange(len(nodes))
    return nodes[label[other]], nodes[other]


def whole_groups(batches, n_keys: int):
    """Columns of consecutive batches sorted by their first n_keys columns, so cut that no group is split."""
    held = None
    for b in batches:
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
        held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
        if not len(held[0]):
            continue
        last = np.ones(len(held[0]), bool)
        for c in held[:n_keys]:
            last &= c == c[-1]
        k = len(last) - int(last.sum())
        if k:
            yield [c[:k] for c in held]
            held = [c[k:] for c in held]
    if held is not None and len(held[0]):
        yield held


def search(points: DataFrame, parts: list[tuple[int, int, int, list[int]]], near: Near, limit: int = 8192) -> DataFrame:
    """(a_least, a, b_least, b): rows that connect what the near pairs connect that meet in a group, by way of the smallest (least, id) of those that meet in a task.

    points: least, id, fp, fp2 (for near), words (array<long>, what parts are groups of)."""
    probes = []
    for k, (word, mask, e, bits) in enumerate(parts):
        value = f"words[{word}] & {_signed(mask)}L"
        probes.append(f"array(named_struct('part', {k}, 'val', {value}))".replace("-9223372036854775808L", "(-9223372036854775807L - 1)"))
        if e == 1:
            # of two values that differ in one bit, the one without it probes for the other
            flips = ", ".join("(-9223372036854775807L - 1)" if b == 63 else f"{1 << b}L" for b in bits)
            probes.append(f"transform(filter(array({flips}), b -> words[{word}] & b = 0), b -> named_struct('part', {k}, 'val', ({value}) | b))")
    rows = points.select("least", "id", "fp", "fp2", F.expr(f"inline(concat({', '.join(probes)}))"))
    large = cut(rows.groupBy("part", "val").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit))
    if large.isEmpty():
        rows = rows.withColumn("c", F.lit(0)).withColumn("d", F.lit(0))
    else:
        rows = rows.join(large, ["part", "val"], "left").withColumn("chunks", F.expr(f"cast(coalesce(ceil(n / {limit}), 1) as int)"))
        rows = rows.withColumn("own", F.expr("cast(pmod(xxhash64(id), chunks) as int)")).withColumn("other", F.expr("explode(sequence(0, chunks - 1))"))
        rows = rows.withColumn("c", F.least("own", "other")).withColumn("d", F.greatest("own", "other"))
    rows = rows.select("part", "val", "c", "d", "least", "id", "fp", "fp2")
    rows = rows.repartition("part", "val", "c", "d").sortWithinPartitions("part", "val", "c", "d", "least", "id")

    def run(batches):
        for part, val, c, d, least, name, fp, fp2 in whole_groups(batches, 4):
            fp, fp2 = fp.view(np.uint64), fp2.view(np.uint64)
            order = np.lexsort((name, least))  # nodes are numbered in the order of (least, id)
            first = np.r_[True, (least[order][1:] != least[order][:-1]) | (name[order][1:] != name[order][:-1])]
            node = np.empty(len(fp), np.int64)
            node[order] = np.cumsum(first) - 1
            least_of, name_of = least[order][first], name[order][first]
            first = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (val[1:] != val[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1])])
            size = np.diff(np.r_[first, len(fp)])
            a, b = [], []
            # small groups all at once, by the distance of two rows; large ones one by one
            small = np.repeat(size <= 24, size)
            end = np.repeat(first + size, size)
            for step in range(1, int(size[size <= 24].max(initial=1))):
                at = np.flatnonzero(small[:-step] & (np.arange(len(fp) - step) + step < end[:-step]))
                at = at[near(fp[at], fp2[at], fp[at + step], fp2[at + step]) & (node[at] != node[at + step])]
                a.append(node[at])
                b.append(node[at + step])
            for k in np.flatnonzero(size > 24):
                held, at = np.unique(node[first[k] : first[k] + size[k]], return_index=True)
                x, y = forest(fp[first[k] + at], fp2[first[k] + at], near)
                a.append(held[x])
                b.append(held[y])
            if a:
                x, y = stars(np.concatenate(a), np.concatenate(b))
                yield pa.record_batch([pa.array(v) for v in (least_of[x], name_of[x], least_of[y], name_of[y])], names=["a_least", "a", "b_least", "b"])

    return rows.mapInArrow(run, "a_least long, a long, b_least long, b long")


def words_sample(points: DataFrame, n: int, words: int) -> np.ndarray:
    """(rows, words) of n points at most, chosen by hash; zeros for an empty table."""
    got = points.orderBy(F.xxhash64("id"), "id").limit(n).select("words").collect()
    return np.array([r["words"] for r in got], np.int64).view(np.uint64) if got else np.zeros((1, words), np.uint64)


def links(distinct: DataFrame, t: int, plan_sample: int = 2048, limit: int = 8192) -> DataFrame:
    """(a, b) as structs (least, id): what connects the fingerprints within t bits. distinct: fp, least."""
    points = distinct.select(F.coalesce("least", F.lit(NO_ID)).alias("least"), F.col("fp").alias("id"), "fp", F.lit(0).cast("long").alias("fp2"), F.array("fp").alias("words"))
    parts = plan(words_sample(points, plan_sample, 1)[:, 0], max(distinct.count(), 1), t)
    node = lambda x: F.struct(F.col(f"{x}_least").alias("least"), F.col(x).alias("id")).alias(x)
    return search(points, parts, Near(t, None), limit).select(node("a"), node("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_distance: int = 4) -> DataFrame:
    """doc_id, fp (long), component_id (smallest doc_id reachable over links, the own one included)."""
    fps = cut(fingerprints(docs, id_col, text_col, shingle))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    of = connected_components(links(distinct, max_distance)).select(F.col("node.id").alias("fp"), F.col("component.least").alias("root"))
    own = F.when(F.col("root").isNull(), F.col("least")).when(F.col("root") < NO_ID, F.col("root"))
    return fps.join(distinct.join(of, "fp", "left").select("fp", own.alias("component_id")), "fp").select("doc_id", "fp", "component_id")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
