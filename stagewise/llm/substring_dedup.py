"""Substring dedup over words by difference-cover anchors.

A window of `window` words that also starts in a document with a smaller id is removed.
Hashing every window would move more than the corpus. The positions of a document are
taken modulo `period`, and windows of window - period + 1 words are hashed only at the
residues of a difference cover: for any two positions i and j there is a shift d below
the period at which both i + d and j + d are cover positions, so two equal long windows
always share an equal anchor inside them. Windows around anchors that another document
holds too are then extended to the whole length and compared by the smallest id that
holds them. A window is compared by two hashes of its words, 128 bits in all, made from two hashes of each word, one modulo
2**64 and one over a prime field.

Defined cases: null text has no words; documents shorter than a window lose nothing; of
documents with the same id, repeated rows among them, none is smaller; a null id counts as larger than any other;
texts and words of any length count whole; an empty table gives an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.llm.anchors import answer_table, exchange, in_blocks, local_groups, n_buckets, send_hashes, sent_table, shared_flags
from stagewise.llm.common import Powers, PrimePowers, bucket_slices, find_pairs, ids_array, mix64, pack_columns, pieces, runs_check, runs_hash, spread, text_buffer, unpack_columns

_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[32, 9, 10, 11, 12, 13]] = True


def difference_cover(period: int) -> list[int]:
    """A smallest set of residues whose differences give every residue (search; periods are small)."""
    from itertools import combinations

    for size in range(1, period + 1):
        for rest in combinations(range(1, period), size - 1):
            d = (0, *rest)
            if len({(a - b) % period for a in d for b in d}) == period:
                return list(d)
    raise ValueError(period)


class _Words:
    """Hashes of the words of consecutive rows, and where each row's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, powers: tuple[Powers, Powers, PrimePowers, Powers]) -> None:
        n, self.powers = len(data), powers
        solid = ~_IS_WHITE[data]
        border = np.zeros(n + 1, bool)
        border[offsets] = True
        before = np.ones(n, bool)
        before[1:] = ~solid[:-1]
        starts = np.flatnonzero(solid & (before | border[:n]))
        after = np.ones(n, bool)
        after[:-1] = ~solid[1:]
        ends = np.flatnonzero(solid & (after | border[1:])) + 1
        self.first = np.searchsorted(starts, offsets)  # n rows + 1
        wide = data.astype(np.uint64)
        self.hash = runs_hash(wide, starts, ends, powers[0])
        self.span = starts, ends
        self.wide, self.check = wide, None
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.place = np.arange(len(starts)) - self.first[self.row]
        self.left = self.first[self.row + 1] - np.arange(len(starts))  # words from here to the row's end

    def windows(self, at: np.ndarray, length: int) -> np.ndarray:
        return runs_hash(self.hash, at, at + length, self.powers[1])

    def second(self, at: np.ndarray, length: int) -> np.ndarray:
        """Another hash of the same windows, from another hash of the words."""
        if self.check is None:
            self.check = mix64(runs_check(self.wide, *self.span, self.powers[2]) + np.uint64(0x9E3779B97F4A7C15))
        return runs_hash(self.check, at, at + length, self.powers[3])


def _chunks(table: pa.Table, powers):
    """(ids of the rows, _Words) of bounded pieces of a block."""
    data, offsets = text_buffer(table["text"])
    ids = ids_array(table["doc_id"])
    for a, b in pieces(offsets):
        o = offsets[a : b + 1]
        yield a, ids[a:b], _Words(data[o[0] : o[-1]], o - o[0], powers)


def dedup_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, period: int = 7) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space)."""
    if not 1 < period < window:
        raise ValueError("period must lie between 1 and window")
    cover, anchor = np.zeros(period, bool), window - period + 1
    cover[difference_cover(period)] = True
    blocks, n = in_blocks(docs, id_col, text_col)
    n = n_buckets(n)

    def new_powers():
        return Powers(0xD6E8FEB86659FD93), Powers(0xA0761D6478BD642F), PrimePowers(0x2C1B3C6D), Powers(0xE7037ED1A0B428DB)

    def anchors_of(table: pa.Table):
        hashes, rows, powers = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], new_powers()
        for a, _, w in _chunks(table, powers):
            at = np.flatnonzero(cover[w.place % period] & (w.left >= anchor))
            hashes.append(w.windows(at, anchor))
            rows.append(w.row[at] + a)
        return local_groups(np.concatenate(hashes), np.concatenate(rows))

    def sample(key, table):
        return send_hashes(key[0].as_py(), anchors_of(table)[0], n)

    def candidates(key, table, answers):
        if not len(table) or not len(answers):
            return sent_table([], 0, [])
        distinct, many = anchors_of(table)
        shared = distinct[shared_flags(distinct, n, answers) | many]
        hashes, checks, owner, powers = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], new_powers()
        for _, ids, w in _chunks(table, powers):
            at = np.flatnonzero(cover[w.place % period] & (w.left >= anchor))
            h = w.windows(at, anchor)
            near = at[shared[np.minimum(np.searchsorted(shared, h), len(shared) - 1)] == h] if len(shared) else at[:0]
            # every window that holds a shared anchor among its first `period` words
            marked = np.zeros(len(w.hash) + 1, np.int64)
            marked[near + 1] = 1
            marked = np.cumsum(marked)
            to = np.minimum(np.arange(len(w.hash)) + period, len(w.hash))
            full = np.flatnonzero((marked[to] > marked[:-1]) & (w.left >= window))
            hashes.append(w.windows(full, window))
            checks.append(w.second(full, window))
            owner.append(ids[w.row[full]])
        h, g, ids = np.concatenate(hashes), np.concatenate(checks), np.concatenate(owner)
        if not len(h):
            return sent_table([], 0, [])
        order = np.lexsort((g, h))
        h, g, ids = h[order], g[order], ids[order]
        first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
        h, g, low, high = h[first], g[first], np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first)
        cuts = bucket_slices(h, n)
        full = np.flatnonzero(cuts[1:] > cuts[:-1])
        parts = [slice(cuts[k], cuts[k + 1]) for k in full]
        return sent_table(full.tolist(), key[0].as_py(), [pack_columns([h[p], g[p]], [low[p], high[p] - low[p]]) for p in parts])

    def final(key, table, answers):
        out = {"doc_id": table["doc_id"].to_pylist(), "n_words": [], "n_removed": [], "kept_text": []}
        known = [unpack_columns(x) for x in answers["payload"].to_pylist()]
        h, g = (np.concatenate([x[0][i] for x in known]) if known else np.zeros(0, np.uint64) for i in (0, 1))
        low = np.concatenate([x[1][0] for x in known]) if known else np.zeros(0, np.int64)
        order = np.argsort(h)
        h, g, low = h[order], g[order], low[order]
        texts, powers = table["text"], new_powers()
        for a, ids, w in _chunks(table, powers):
            gone = np.zeros(len(w.hash), bool)
            if len(h):
                at = np.flatnonzero(w.left >= window)
                got = w.windows(at, window)
                near = np.flatnonzero(h[np.minimum(np.searchsorted(h, got), len(h) - 1)] == got)
                at, got = at[near], got[near]
                k = find_pairs(h, g, got, w.second(at, window))
                at = at[(k >= 0) & (low[k] < ids[w.row[at]])]
                gone = spread(len(w.hash), at, window)
            for i in range(len(ids)):
                words = (texts[a + i].as_py() or "").encode().split()
                rem = gone[w.first[i] : w.first[i + 1]]
                if rem.any():
                    words = [x for x, r in zip(words, rem.tolist(), strict=True) if not r]
                out["n_words"].append(len(rem))
                out["n_removed"].append(len(rem) - len(words))
                out["kept_text"].append(b" ".join(words).decode())
        return pa.table(out, schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())]))

    return exchange(blocks, n, sample, candidates, answer_smallest, final, "doc_id long, n_words long, n_removed long, kept_text string")


def answer_smallest(key, table):
    """For each message, those of its hashes that some block holds under a smaller id than the sender's largest."""
    blocks = table["block"].to_pylist()
    parts = [unpack_columns(x) for x in table["payload"].to_pylist()]
    h, g = (np.concatenate([p[0][i] for p in parts]) for i in (0, 1))
    low, high = (np.concatenate([p[1][i] for p in parts]) for i in (0, 1))
    high += low
    order = np.lexsort((g, h))
    first = np.flatnonzero(np.r_[True, (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])])
    least = np.empty(len(h), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(low[order], first), np.diff(np.r_[first, len(h)]))
    told = least < high
    ends = np.cumsum([len(p[0][0]) for p in parts])
    who, payload = [], []
    for block, p, e in zip(blocks, parts, ends, strict=True):
        keep = np.flatnonzero(told[e - len(p[0][0]) : e]) + e - len(p[0][0])
        if len(keep):
            who.append(block)
            payload.append(pack_columns([h[keep], g[keep]], [least[keep]]))
    return answer_table(who, key[0].as_py(), payload)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
