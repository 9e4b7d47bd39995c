"""Suffix-array dedup over bytes by threshold-bounded interval expansion.

A byte is removed if a string of `length` bytes that also starts in a document with a
smaller id covers it. Groups of equal strings come from suffix-array intervals: starting
from the intervals of all 16-byte strings (to which suffixes are sorted), each round extends every interval by one byte
to the left through the Burrows-Wheeler transform, so common prefixes grow by one each
round (breadth first, values ascending), intervals of one suffix are dropped, and the
expansion stops at the minimum length instead of deriving all longer prefixes.

One suffix array of the corpus fits no machine, so text is dealt out first. Every window
of `length` bytes is named by its minimizer, the smallest hash among its m-byte strings;
equal windows have equal minimizers. Only runs of windows whose minimizer another
document has too are sent on, to the bucket of that minimizer, which indexes the distinct
runs (identical ones once, with the smallest id that holds them) of each minimizer that has
several: a run that is its minimizer's only one can match no other. Runs are told apart by two hashes, one modulo 2**64 and one over
a prime field, over 90 bits together.

All distinct runs around one minimizer meet in one bucket, and a passage of many documents makes as many runs as it has surroundings. So
blocks also say how many different runs they hold of a minimizer, and one with more than `hot` of them is hot for all blocks: its windows
are dealt one by one, each by its own hash, so that equal ones still meet and the others scatter. A message is a slice of a block's
arrays, with no work of its own, for their number grows with blocks times buckets until there is one for each run.

Defined cases: null text is empty; shorter documents lose nothing; matches never cross
documents; of documents with the same id, repeated rows among them, none is smaller; a null id counts as larger than
any other; texts of any length count whole; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.llm.anchors import exchange, in_blocks, n_buckets
from stagewise.llm.common import Powers, PrimePowers, bucket_slices, ids_array, joined, mix64, pieces, runs_check, runs_hash, slices, text_buffer

_U = np.uint64
#: First round: the low 32 bits of a minimizer's hash (its bucket stands for the high ones), and how many further distinct runs of it the block
#: holds, as 16 times the logarithm of that number and 1.
NAME = np.dtype([("name", "<u4"), ("extra", "u1")])
#: Second round: a distinct run's smallest id, what the largest is beyond it, and its bytes; below zero for a single window of a hot minimizer.
RUN = np.dtype([("low", "<i8"), ("rest", "<i8"), ("size", "<i4")])
SENT_RUNS = "bucket int, block int, head binary, payload binary"
#: Its answer: a stretch of a run's windows and their smallest id; of size 0: a hot minimizer's hash.
TOLD = np.dtype([("hash", "<u8"), ("check", "<u4"), ("start", "<i4"), ("size", "<i4"), ("id", "<i8")])


def _eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one big-endian number (zeros beyond the end)."""
    x = np.zeros(len(data) + 8, _U)
    x[: len(data)] = data
    for step in (1, 2, 4):
        x = (x[:-step] << _U(8 * step)) | x[step:]
    return x[: len(data)]


def minimizers(data: np.ndarray, length: int, m: int) -> np.ndarray:
    """For each start of a window of `length` bytes its smallest hash of m consecutive bytes (8 < m <= 24)."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, _U)
    x = _eights(data)
    k = len(data) - m + 1
    least = mix64(mix64(x[:k] * _U(0xD6E8FEB86659FD93) ^ x[(m - 8) // 2 : (m - 8) // 2 + k]) ^ x[m - 8 : m - 8 + k])
    width, have = length - m + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return least[:n]


class _Runs:
    """Maximal runs of windows of one row with the same minimizer."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, m: int) -> None:
        least = minimizers(data, length, m)
        n, rows = len(least), len(offsets) - 1
        sizes = np.maximum(np.diff(offsets) - length + 1, 0)  # windows of each row
        edge = np.zeros(len(data) + 1, np.int32)
        np.add.at(edge, offsets[:-1], (sizes > 0).astype(np.int32))
        np.add.at(edge, offsets[:-1] + sizes, -(sizes > 0).astype(np.int32))
        valid = np.cumsum(edge)[:n] > 0
        new = np.ones(n, bool)
        new[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
        first = offsets[:-1][sizes > 0]
        new[first] = True
        starts = np.flatnonzero(new & valid)
        # a run ends where the next begins or where its row's windows end
        row = np.searchsorted(offsets, starts, "right") - 1
        self.row = np.minimum(row, rows - 1)
        limit = offsets[self.row] + sizes[self.row]
        self.start = starts
        self.end = np.minimum(np.r_[starts[1:], n], limit)
        self.key = mix64(least[starts])  # minima crowd the low end; buckets need an even spread


def _expanded(runs: _Runs, on: np.ndarray, hot: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(start, end in bytes, row, key, single) of the runs on (places), those with a key in hot (sorted) window by window."""
    start, end, row, key = runs.start[on], runs.end[on] + length - 1, runs.row[on], runs.key[on]
    single = _member(key, hot)
    if not single.any():
        return start, end, row, key, single
    count = np.where(single, end - start - length + 1, 1)
    run = np.repeat(np.arange(len(on)), count)
    step = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    single = single[run]
    start = start[run] + step
    return start, np.where(single, start + length, end[run]), row[run], key[run], single


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each value is one of `among` (sorted)."""
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def _messages(block: int, cuts: np.ndarray, **arrays: tuple[np.ndarray, np.ndarray]) -> pa.Table:
    """A row for each bucket that gets something. cuts: borders of the entries by bucket; arrays: data and the n + 1 places of its entries, by column."""
    full = np.flatnonzero(cuts[1:] > cuts[:-1])
    at = np.r_[cuts[full], cuts[-1]]
    columns = {"bucket": pa.array(full, pa.int32()), "block": pa.array(np.full(len(full), block), pa.int32())}
    return pa.table(columns | {name: slices(data, places[at]) for name, (data, places) in arrays.items()})


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)
    return data[at]


def equal_groups(text: np.ndarray, left: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of text whose next `length` bytes occur elsewhere too, and a group number for each.

    left: for each place, how many bytes follow it within its own string (itself included)."""
    n = len(text)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n == 0:
        return none
    # the intervals of all 16-byte strings; suffixes too short for one belong to none
    start = min(16, length)
    place = _suffix_order(text, start)
    place = place[left[place] >= start]
    eights = _eights(text)
    first, second = eights[place] >> _U(8 * max(0, 8 - start)), eights[np.minimum(place + 8, n - 1)] >> _U(min(63, 8 * (16 - start)))
    if start <= 8:
        second = np.zeros(len(place), _U)
    del eights
    inside = np.zeros(n, bool)  # whether the byte to the left stands in the same string
    inside[1:] = left[:-1] == left[1:] + 1

    def several(border):
        """The entries of intervals of more than one suffix, and their intervals' numbers."""
        border = np.r_[True, border] if len(place) else np.zeros(0, bool)
        keep = ~(border & np.r_[border[1:], True]) if len(place) else border
        return place[keep], np.cumsum(border)[keep]

    place, group = several((first[1:] != first[:-1]) | (second[1:] != second[:-1]))
    for _ in range(start, length):
        # backward step: the suffix one byte to the left
        keep = inside[place]
        place, group = place[keep] - 1, group[keep]
        byte = text[place]
        order = np.argsort(byte, kind="stable")  # LF mapping: suffixes of one byte keep their order
        place, group, byte = place[order], group[order], byte[order]
        place, group = several((byte[1:] != byte[:-1]) | (group[1:] != group[:-1]))
    return place, group


def _suffix_order(text: np.ndarray, length: int) -> np.ndarray:
    """Suffixes sorted by their first `length` bytes at least (prefix doubling)."""
    n = len(text)
    key = _eights(text)
    order = np.argsort(key)
    s = key[order]
    border = np.r_[True, s[1:] != s[:-1]]
    del key, s
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(border, np.arange(n), 0))
    have = 8
    while have < length:
        first = np.flatnonzero(border)
        size = np.diff(np.r_[first, n])
        open_ = np.repeat(size > 1, size)
        if not open_.any():
            break
        at = np.flatnonzero(open_)
        places = order[at]
        nxt = np.full(len(places), -1, np.int64)
        inside = places + have < n
        nxt[inside] = rank[places[inside] + have]
        r = rank[places]
        sub = np.argsort(r * (n + 1) + nxt)
        places, r, nxt = places[sub], r[sub], nxt[sub]
        order[at] = places
        new = np.r_[True, (r[1:] != r[:-1]) | (nxt[1:] != nxt[:-1])]
        border[at] = new
        rank[places] = np.maximum.accumulate(np.where(new, at, 0))
        have *= 2
    return order


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, m: int = 20, hot: int = 16384) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (pairs start:end, comma-joined), kept (binary)."""
    if not (8 < m <= 24 and m < length):
        raise ValueError("m must lie in 9..24 and below length")
    blocks, n = in_blocks(docs, id_col, text_col)
    n, fine = n_buckets(n), 4 * n  # fine: buckets of the second round, where an index takes some 100 times its text

    def new_powers():
        return Powers(0xD6E8FEB86659FD93), PrimePowers(0x2C1B3C6D)

    def two_hashes(data, starts, ends, powers):
        wide = data.astype(np.uint64)
        return runs_hash(wide, starts, ends, powers[0]), runs_check(wide, starts, ends, powers[1])

    def chunks(table):
        data, offsets = text_buffer(table["text"])
        ids = ids_array(table["doc_id"])
        for a, b in pieces(offsets):
            o = offsets[a : b + 1]
            part = data[o[0] : o[-1]]
            yield a, ids[a:b], part, o - o[0], _Runs(part, o - o[0], length, m)

    def keys_of(table, count_runs):
        """Sorted distinct keys, whether several rows of the block hold each, and with count_runs how many runs beyond one (as in NAME)."""
        keys, rows, edges = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for a, _, data, _, runs in chunks(table):
            keys.append(runs.key)
            rows.append(runs.row + a)
            if count_runs and len(runs.key):  # the ends of a run tell it well enough for a count
                x = _eights(data)
                edges.append(mix64(mix64(x[runs.start]) ^ x[runs.end + length - 9] ^ (runs.end - runs.start).astype(_U)))
        keys, rows = np.concatenate(keys), np.concatenate(rows)
        if not len(keys):
            return keys, np.zeros(0, bool), np.zeros(0, np.uint8)
        order = np.argsort(keys, kind="stable")
        k, r = keys[order], rows[order]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        extra = np.zeros(len(first), np.uint8)
        if count_runs:
            count = np.diff(np.r_[first, len(k)])
            several = np.repeat(count > 1, count)
            group, edge = np.repeat(np.arange(len(first)), count)[several], np.concatenate(edges)[order][several]
            by = np.lexsort((edge, group))
            group, edge = group[by], edge[by]
            new = (group[1:] == group[:-1]) & (edge[1:] != edge[:-1])
            extra = np.minimum(np.rint(16 * np.log2(1 + np.bincount(group[1:][new], minlength=len(first)))), 255).astype(np.uint8)
        return k[first], np.minimum.reduceat(r, first) != np.maximum.reduceat(r, first), extra

    def sample(key, table):
        distinct, _, extra = keys_of(table, True)
        sent = np.empty(len(distinct), NAME)
        sent["name"], sent["extra"] = distinct.astype(np.uint32), extra
        return _messages(key[0].as_py(), bucket_slices(distinct, n), payload=(sent, np.arange(len(sent) + 1)))

    def share(key, table):
        """A byte for each name: bit 0 if other blocks sent it too, bit 1 if it is hot."""
        sent, at = joined(table["payload"])
        sent = sent.view(NAME)
        order = np.argsort(sent["name"], kind="stable")
        name = sent["name"][order]
        first = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
        count = np.diff(np.r_[first, len(name)])
        state = np.empty(len(sent), np.uint8)
        state[order] = np.repeat((count > 1) + 2 * (np.add.reduceat(np.exp2(sent["extra"][order].astype(float) / 16) - 1, first) > hot), count)
        return pa.table({"block": table["block"].cast(pa.int32()), "bucket": pa.array(np.full(len(table), key[0].as_py()), pa.int32()), "payload": slices(state, at // NAME.itemsize)})

    def candidates(key, table, answers):
        none = _messages(0, np.zeros(1, np.int64), head=(np.zeros(0, RUN), np.zeros(1, np.int64)), payload=(np.zeros(0, np.uint8), np.zeros(1, np.int64)))
        if not len(table) or not len(answers):
            return none
        distinct, many, _ = keys_of(table, False)
        state, _ = joined(answers.sort_by("bucket")["payload"])  # buckets are ranges of keys
        shared, hot_keys = distinct[(state & 1 > 0) | many], distinct[state & 2 > 0]
        if not len(shared):
            return none
        powers, seen = new_powers(), {k: [] for k in ("hash", "check", "key", "id", "size", "begin", "single")}
        text, before = text_buffer(table["text"])
        for a, ids, data, _, runs in chunks(table):
            start, end, row, k, single = _expanded(runs, np.flatnonzero(_member(runs.key, shared)), hot_keys, length)
            h, g = two_hashes(data, start, end, powers)
            for x, got in zip(seen, (h, g, np.where(single, h, k), ids[row], end - start, before[a] + start, single), strict=True):
                seen[x].append(got)
        h, g, k, ids, size, begin, single = (np.concatenate(x) for x in seen.values())
        # one entry for each distinct run, ordered by minimizer
        order = np.lexsort((g, h, k))
        h, g, k, ids = h[order], g[order], k[order], ids[order]
        first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
        low, high = np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first)
        one = order[first]
        head = np.empty(len(one), RUN)
        head["low"], head["rest"], head["size"] = low, high - low, np.where(single[one], -size[one], size[one])
        return _messages(
            key[0].as_py(), bucket_slices(k[first], fine),
            head=(head, np.arange(len(one) + 1)), payload=(_gather(text, begin[one], size[one]), np.r_[0, np.cumsum(size[one])]),
        )

    def answer(key, table):
        heads, at = joined(table["head"])
        text, _ = joined(table["payload"])
        heads = heads.view(RUN)
        owner = np.repeat(np.arange(len(table)), np.diff(at) // RUN.itemsize)
        low, size = heads["low"].astype(np.int64), heads["size"].astype(np.int64)
        high, single, size = low + heads["rest"], size < 0, np.abs(size)
        begin = np.cumsum(size) - size
        h, g = two_hashes(text, begin, begin + size, new_powers())
        order = np.lexsort((g, h))
        s, c = h[order], g[order]
        first = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (c[1:] != c[:-1])])
        entry = np.empty(len(h), np.int64)  # each message's run -> distinct run
        entry[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(s)]))
        least = np.minimum.reduceat(low[order], first)
        size_d, begin_d = size[order[first]], begin[order[first]]
        # a run can only share a window with another run of its minimizer: index those that have one; single windows are distinct
        name = mix64(minimizers(_gather(text, begin_d, np.full(len(begin_d), length)), length, m)[::length])
        runs = np.flatnonzero(~single[order[first]])
        _, inverse, count = np.unique(name[runs], return_inverse=True, return_counts=True)
        some = runs[count[inverse] > 1]
        indexed = _gather(text, begin_d[some], size_d[some])
        del text, heads
        at = np.cumsum(size_d[some]) - size_d[some]
        string = np.repeat(np.arange(len(some)), size_d[some])
        place, group = equal_groups(indexed, size_d[some][string] - (np.arange(len(indexed)) - at[string]), length)
        # the smallest id of each window: of its own run, or of its group
        windows = size_d - length + 1
        w_at = np.cumsum(windows) - windows
        best = np.repeat(least, windows)
        if len(place):
            by = np.argsort(group, kind="stable")
            place, group = place[by], group[by]
            border = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            run = some[string[place]]
            smallest = np.repeat(np.minimum.reduceat(least[run], border), np.diff(np.r_[border, len(place)]))
            best[w_at[run] + place - at[string[place]]] = smallest
        # stretches of windows of one run with the same smallest id
        own = np.repeat(np.arange(len(windows)), windows)
        border = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (best[1:] != best[:-1])]) if len(own) else np.zeros(0, np.int64)
        s_run, s_from, s_id = own[border], border - w_at[own[border]], best[border]
        s_size = np.diff(np.r_[border, len(own)])
        runs_first = np.searchsorted(s_run, np.arange(len(windows) + 1))
        count = (runs_first[1:] - runs_first[:-1])[entry]
        which = np.arange(count.sum()) + np.repeat(runs_first[entry] - (np.cumsum(count) - count), count)
        msg = np.repeat(np.arange(len(entry)), count)
        told = s_id[which] < high[msg]
        which, msg = which[told], msg[told]
        # the minimizers that the blocks have to take window by window
        lone = msg[single[msg]]
        lone = lone[np.unique(np.stack([owner[lone].astype(_U), name[entry[lone]]]), axis=1, return_index=True)[1]] if len(lone) else lone
        out = np.zeros(len(which) + len(lone), TOLD)
        out["hash"], out["check"] = np.r_[h[msg], name[entry[lone]]], np.r_[g[msg].astype(np.uint32), np.zeros(len(lone), np.uint32)]
        for x, got in zip(("start", "size", "id"), (s_from, s_size, s_id), strict=True):
            out[x][: len(which)] = got[which]
        to = np.r_[owner[msg], owner[lone]]
        by = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[by], np.arange(len(table) + 1))
        full = np.flatnonzero(cuts[1:] > cuts[:-1])
        bucket = pa.array(np.full(len(full), key[0].as_py()), pa.int32())
        return pa.table({"block": table["block"].cast(pa.int32()).take(pa.array(full)), "bucket": bucket, "payload": slices(out[by], np.r_[cuts[full], cuts[-1]])})

    def final(key, table, answers):
        told = joined(answers["payload"])[0].view(TOLD)
        hot_keys, told = np.unique(told["hash"][told["size"] == 0]), told[told["size"] > 0]
        told = told[np.argsort(told["hash"], kind="stable")]
        h, g = told["hash"].copy(), told["check"].astype(_U)
        w_from, w_size, w_id = (told[x].astype(np.int64) for x in ("start", "size", "id"))
        out = {"doc_id": table["doc_id"].to_pylist(), "n_bytes": [], "n_removed": [], "n_spans": [], "spans": [], "kept": []}
        powers = new_powers()
        for _, ids, data, offsets, runs in chunks(table):
            edge = np.zeros(len(data) + 1, np.int64)
            if len(h) and len(runs.start):
                start, end, row, _, _ = _expanded(runs, np.arange(len(runs.start)), hot_keys, length)
                rh, rg = two_hashes(data, start, end, powers)
                a, b = np.searchsorted(h, rh), np.searchsorted(h, rh, "right")
                count = b - a
                run = np.repeat(np.arange(len(rh)), count)
                k = np.arange(count.sum()) + np.repeat(a - (np.cumsum(count) - count), count)
                on = (g[k] == rg[run]) & (w_id[k] < ids[row[run]])
                run, k = run[on], k[on]
                begin = start[run] + w_from[k]
                edge = np.bincount(begin, minlength=len(data) + 1) - np.bincount(begin + w_size[k] + length - 1, minlength=len(data) + 1)
            gone = np.cumsum(edge[: len(data)]) > 0
            for i in range(len(ids)):
                d, lost = data[offsets[i] : offsets[i + 1]], gone[offsets[i] : offsets[i + 1]]
                turn = np.flatnonzero(np.diff(np.r_[False, lost, False].astype(np.int8)))
                out["n_bytes"].append(len(d))
                out["n_removed"].append(int(lost.sum()))
                out["n_spans"].append(len(turn) // 2)
                out["spans"].append(",".join(f"{x}:{y}" for x, y in turn.reshape(-1, 2).tolist()))
                out["kept"].append(d[~lost].tobytes())
        kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.string()), ("kept", pa.binary())]
        return pa.table(out, schema=pa.schema(kinds))

    return exchange(blocks, n, sample, candidates, answer, final, "doc_id long, n_bytes long, n_removed long, n_spans long, spans string, kept binary", share, SENT_RUNS)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
