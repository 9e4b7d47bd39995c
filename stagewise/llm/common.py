"""Helpers that several corpus operators share."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: space and the controls 9 to 13. Everything else belongs to words.
WHITE = bytes([32, 9, 10, 11, 12, 13])
SPLIT = r"[\x20\x09-\x0D]+"

_U = np.uint64


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses spark.checkpoint.dir; only a local session without one (as in tests) gets its own folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    where = sc.getConf().get("spark.checkpoint.dir")
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "/tmp/checkpoints/stagewise"
    sc.setCheckpointDir(where)


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and reads it from there, so that lost executors cost nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a table that no later step reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def n_blocks(docs: DataFrame, text: str, target_bytes: int = 4 << 20) -> int:
    """Number of blocks of about target_bytes of text: follows the input, so a block's memory doesn't."""
    got = docs.agg(F.sum(F.octet_length(text)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    return max(1, math.ceil((got["b"] or 0) / target_bytes), math.ceil(got["n"] / 50_000))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class Powers:
    """Powers of an odd base modulo 2**64, and of its inverse, kept as far as needed."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.zeros(0, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, b in (("up", self.base), ("down", self.inverse)):
                x = np.full(size, b, _U)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up[:n], self.down[:n]


class PrimePowers:
    """Powers of a base modulo the prime 2**31 - 1, and of its inverse, kept as far as needed."""

    P = (1 << 31) - 1

    def __init__(self, base: int) -> None:
        self.base, self.up, self.down = (base, pow(base, -1, self.P)), np.ones(1, _U), np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        size = max(n, 1 << 16)
        while len(self.up) < n or len(self.up) < 1 << 16:
            k = min(len(self.up), size - len(self.up))
            up, down = (x[:k] * _U(pow(b, len(x), self.P)) % _U(self.P) for x, b in zip((self.up, self.down), self.base, strict=True))
            self.up, self.down = np.concatenate([self.up, up]), np.concatenate([self.down, down])
        return self.up[:n], self.down[:n]


def runs_check(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: PrimePowers) -> np.ndarray:
    """A second hash of each values[start:end] of bytes, of 31 bits: a polynomial over a prime field, so no structure of the bytes defeats it
    as it may the one modulo 2**64."""
    up, down = powers.get(len(values) + 1)
    terms, p = values * up[: len(values)], _U(powers.P)
    if len(values) > 1 << 24:  # else the sum of terms below 2**39 fits
        terms %= p
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(terms, out=sums[1:])
    return (sums[ends] - sums[starts]) % p * down[starts] % p


def planes(x: np.ndarray) -> bytes:
    """The bytes of 64-bit values plane by plane, so that their zero bytes compress."""
    return x.view(np.uint8).reshape(-1, 8).T.tobytes()


def pack_columns(hashes: list[np.ndarray], numbers: list[np.ndarray]) -> bytes:
    """Columns of one length as a message: hashes as they are, numbers (int64) compressed."""
    import pyarrow as pa

    raw = b"".join(map(planes, numbers))
    return np.array([len(hashes[0]), len(hashes), len(numbers)]).tobytes() + b"".join(x.tobytes() for x in hashes) + pa.compress(raw, codec="zstd", asbytes=True)


def unpack_columns(message: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    import pyarrow as pa

    n, h, k = np.frombuffer(message, np.int64, 3).tolist()
    hashes = np.frombuffer(message, _U, n * h, 24).reshape(h, n)
    raw = np.frombuffer(pa.decompress(memoryview(message)[24 + 8 * n * h :], decompressed_size=8 * n * k, codec="zstd"), np.uint8)
    numbers = np.ascontiguousarray(raw.reshape(k, 8, n).transpose(0, 2, 1)).view(np.int64)[:, :, 0]
    return list(hashes), list(numbers)


def find_pairs(h: np.ndarray, g: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The place of each pair (x, y) among the pairs (h, g) sorted by h, or -1."""
    if not len(h):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(h, x), len(h) - 1)
    out = np.where((h[at] == x) & (g[at] == y), at, -1)
    open_ = np.flatnonzero((h[at] == x) & (out < 0))  # another pair has the same h: look further
    while len(open_):
        at[open_] += 1
        open_ = open_[at[open_] < len(h)]
        open_ = open_[h[at[open_]] == x[open_]]
        hit = g[at[open_]] == y[open_]
        out[open_[hit]] = at[open_[hit]]
        open_ = open_[~hit]
    return out


def runs_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """64-bit hash of each values[start:end]; equal contents hash alike wherever they stand."""
    up, down = powers.get(len(values) + 1)
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    got = (sums[ends] - sums[starts]) * down[starts]
    return mix64(got + (ends - starts).astype(_U) * _U(0x9E3779B97F4A7C15))


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column, and the n + 1 offsets of its rows; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a = pc.fill_null(a.cast(pa.large_string()), "")
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = a.buffers()[2] if len(a) else None
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(data: np.ndarray, borders: np.ndarray):
    """An Arrow binary column whose values are data[borders[k]:borders[k + 1]], without a copy or a step for each."""
    import pyarrow as pa

    at = (np.asarray(borders, np.int64) * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])


def joined(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow binary column in one array, and the n + 1 offsets of its rows."""
    import pyarrow as pa

    a = column.cast(pa.large_binary()).combine_chunks()
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], pa.large_binary())
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def ids_array(column) -> np.ndarray:
    """Document ids as int64; a null id counts as larger than any other."""
    import pyarrow as pa
    import pyarrow.compute as pc

    return pc.fill_null(column.cast(pa.int64()), (1 << 63) - 1).to_numpy().astype(np.int64)


def pieces(offsets: np.ndarray, limit: int = 1 << 20):
    """Ranges [a, b) of rows of about limit bytes each: keeps the arrays of a task small."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = b


def bucket_slices(sorted_hashes: np.ndarray, n: int) -> np.ndarray:
    """n + 1 borders that cut sorted 64-bit hashes into n buckets of equal hash ranges."""
    at = (sorted_hashes >> _U(32)) * _U(n) >> _U(32)
    return np.searchsorted(at, np.arange(n + 1, dtype=_U))


def spread(total: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Marks every index that one of [start, start + length) covers."""
    edge = np.bincount(starts, minlength=total + 1) - np.bincount(np.minimum(starts + length, total), minlength=total + 1)
    return np.cumsum(edge[:total]) > 0
