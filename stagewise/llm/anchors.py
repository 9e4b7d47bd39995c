"""Exchange of hashes between blocks of documents.

Documents are dealt into blocks by row, whatever their ids, so that no block grows with a repeated or missing id. A block sends sorted arrays of
distinct 64-bit hashes to buckets (ranges of hash values, one for four blocks); the bucket answers which of
them other blocks sent too. Messages are packed arrays, one for each block and bucket,
so that a hash that a third of all documents holds costs one entry a block. (Beyond about a terabyte a message is down to
one hash, which is the usual row of a shuffle.)

Hashes of 64 bits only choose candidates here: what is removed is decided on the pairs of hashes (over 90 bits) that the second round sends.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.llm.common import bucket_slices, n_blocks

SENT = "bucket int, block int, payload binary"
ANSWER = "block int, bucket int, payload binary"


def sent_table(bucket: list[int], block: int, payload: list[bytes]) -> pa.Table:
    return pa.table({"bucket": pa.array(bucket, pa.int32()), "block": pa.array([block] * len(bucket), pa.int32()), "payload": pa.array(payload, pa.binary())})


def answer_table(block: list[int], bucket: int, payload: list[bytes]) -> pa.Table:
    return pa.table({"block": pa.array(block, pa.int32()), "bucket": pa.array([bucket] * len(block), pa.int32()), "payload": pa.array(payload, pa.binary())})


def in_blocks(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(doc_id, text, block) and the number of blocks."""
    n = n_blocks(docs, text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int").alias("block")), n


def n_buckets(blocks: int) -> int:
    return -(-blocks // 4)


def send_hashes(block: int, distinct: np.ndarray, n: int) -> pa.Table:
    """distinct: sorted hashes."""
    cuts = bucket_slices(distinct, n)
    full = np.flatnonzero(cuts[1:] > cuts[:-1])
    return sent_table(full.tolist(), block, [distinct[cuts[k] : cuts[k + 1]].tobytes() for k in full])


def answer_shared(key, table):
    """For each message, a bit for each of its hashes: whether another block sent it too."""
    blocks = table["block"].to_pylist()
    parts = [np.frombuffer(x, np.uint64) for x in table["payload"].to_pylist()]
    every = np.concatenate(parts)
    order = np.argsort(every, kind="stable")
    same = every[order][1:] == every[order][:-1]
    twice = np.zeros(len(every), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    ends = np.cumsum([len(p) for p in parts])
    return answer_table(blocks, key[0].as_py(), [np.packbits(twice[e - len(p) : e]).tobytes() for p, e in zip(parts, ends, strict=True)])


def shared_flags(distinct: np.ndarray, n: int, answers: pa.Table) -> np.ndarray:
    """The answers of answer_shared, in the order of the block's sorted hashes."""
    cuts, out = bucket_slices(distinct, n), np.zeros(len(distinct), bool)
    for bucket, bits in zip(answers["bucket"].to_pylist(), answers["payload"].to_pylist(), strict=True):
        a, b = cuts[bucket], cuts[bucket + 1]
        out[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
    return out


def local_groups(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes, and whether more than one row of the block holds each."""
    if not len(hashes):
        return hashes, np.zeros(0, bool)
    order = np.argsort(hashes, kind="stable")
    h, r = hashes[order], rows[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    return h[first], np.minimum.reduceat(r, first) != np.maximum.reduceat(r, first)


def exchange(docs: DataFrame, n: int, sample: Callable, candidates: Callable, answer: Callable, final: Callable, schema: str, share: Callable = answer_shared, sent_as: str = SENT) -> DataFrame:
    """Two rounds: which sampled hashes are shared, then what the candidates around them are worth.

    sample(key, docs) and candidates(key, docs, answers) send messages (the latter as sent_as), share(key, messages) and answer(key, messages)
    answer the first and the second round, final(key, docs, answers) makes the result. The three readers
    of docs share one exchange."""
    shared = docs.groupBy("block").applyInArrow(sample, SENT).groupBy("bucket").applyInArrow(share, ANSWER)
    sent = docs.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(candidates, sent_as)
    answers = sent.groupBy("bucket").applyInArrow(answer, ANSWER)
    return docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(final, schema)
