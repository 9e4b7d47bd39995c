"""Per-sequence features that need windows, and interval estimates; vectorised over Arrow batches."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
# Hydropathy (Kyte and Doolittle) in the order of RESIDUES.
HYDROPATHY = np.array([1.8, 2.5, -3.5, -3.5, 2.8, -0.4, -3.2, 4.5, -3.9, 3.8, 1.9, -3.5, -1.6, -3.5, -4.5, -0.8, -0.7, 4.2, -0.9, -1.3])
# pKa (EMBOSS) and sign of the charged groups.
CHARGED = {"K": (10.8, 1), "R": (12.5, 1), "H": (6.5, 1), "D": (3.9, -1), "E": (4.1, -1), "C": (8.5, -1), "Y": (10.1, -1)}
ENDS = ((8.6, 1), (3.6, -1))

_CODE = np.full(256, -1)
for _i, _a in enumerate(RESIDUES):
    _CODE[ord(_a)] = _i


def encode(s: str) -> np.ndarray:
    """Residue numbers; anything else is left out."""
    c = _CODE[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)]
    return c[c >= 0]


def net_charge(counts: np.ndarray, ph) -> np.ndarray:
    """counts: (n, 20); ph: a number or one for each row."""
    ph = np.broadcast_to(np.asarray(ph, float), len(counts))
    total = sum(sign / (1 + 10.0 ** (sign * (ph - pka))) for pka, sign in ENDS)
    for a, (pka, sign) in CHARGED.items():
        total = total + sign * counts[:, RESIDUES.index(a)] / (1 + 10.0 ** (sign * (ph - pka)))
    return total


def isoelectric_point(counts: np.ndarray, steps: int = 60) -> np.ndarray:
    """The pH of charge zero by bisection on 0..14, for all rows at once."""
    low, high = np.zeros(len(counts)), np.full(len(counts), 14.0)
    for _ in range(steps):
        mid = (low + high) / 2
        positive = net_charge(counts, mid) > 0
        low, high = np.where(positive, mid, low), np.where(positive, high, mid)
    return (low + high) / 2


def window_means(x: np.ndarray, w: int) -> np.ndarray:
    c = np.r_[0.0, np.cumsum(x)]
    return (c[w:] - c[:-w]) / w if len(x) >= w else np.zeros(0)


def count_runs(mask: np.ndarray) -> int:
    return int((np.diff(np.r_[0, mask.astype(np.int8)]) == 1).sum())


def low_complexity(codes: np.ndarray, w: int = 20, bits: float = 2.9) -> float:
    """Share of windows whose residue entropy is below `bits`."""
    if len(codes) < w:
        return 0.0
    entropy = np.zeros(len(codes) - w + 1)
    for a in range(20):  # one residue at a time: memory is a few arrays of the sequence's length
        c = np.r_[0, np.cumsum(codes == a)]
        p = (c[w:] - c[:-w]) / w
        entropy -= p * np.log2(np.where(p > 0, p, 1))
    return float((entropy < bits).mean())


def disorder(codes: np.ndarray, window: int = 51) -> tuple[float, float, float, float]:
    """Shares of positions predicted disordered (FoldIndex below zero): overall, first 30, last 30, between; NaN for nothing."""
    if not len(codes):
        return (math.nan,) * 4
    w = min(window, len(codes))
    sign = np.zeros(20)
    sign[[RESIDUES.index(a) for a in "KR"]], sign[[RESIDUES.index(a) for a in "DE"]] = 1, -1
    # Fixed values of the index: slope of hydropathy scaled to 0..1, and offset.
    index = 2.785 * window_means((HYDROPATHY[codes] + 4.5) / 9.0, w) - np.abs(window_means(sign[codes], w)) - 1.151
    low, edge = index < 0, min(30, len(index))
    inner = low[edge:-edge]
    return float(low.mean()), float(low[:edge].mean()), float(low[-edge:].mean()), float(inner.mean()) if len(inner) else 0.0


def features(s: str) -> tuple[int, int, bool, float]:
    """(n_residues, helices, signal, low_complexity) of one sequence."""
    c = encode(s)
    h = HYDROPATHY[c]
    return len(c), count_runs(window_means(h, 19) > 1.6), bool((window_means(h[:30], 10) > 1.6).any()), low_complexity(c)


FEATURES = """seq_len int, n_residues int, pi double, gravy double, net_charge_ph7 double, aromatic_frac double, cys_frac double, met_frac double, gly_frac double,
    pro_frac double, cys_count int, met_count int, helices int, signal_peptide boolean, disorder_frac double, disorder_nterm double, disorder_cterm double,
    disorder_internal double, low_complexity double"""


def feature_frame(texts):
    """The features of FEATURES for an iterable of sequences, as a dict of arrays; the same for one row and for many."""
    codes = [encode(s) for s in texts]
    rows, spread = [features(s) for s in texts], np.array([disorder(c) for c in codes]).reshape(-1, 4)
    counts = np.array([np.bincount(c, minlength=20) for c in codes], float).reshape(-1, 20)
    n = counts.sum(1)
    with np.errstate(invalid="ignore", divide="ignore"):
        share = lambda letters: sum(counts[:, RESIDUES.index(a)] for a in letters) / n
        gravy = counts @ HYDROPATHY / n
    count = lambda a: counts[:, RESIDUES.index(a)].astype(int)
    return dict(
        seq_len=[len(s) for s in texts], n_residues=n.astype(int), pi=np.where(n > 0, isoelectric_point(counts), np.nan), gravy=gravy,
        net_charge_ph7=np.where(n > 0, net_charge(counts, 7.0), np.nan), aromatic_frac=share("FWY"), cys_frac=share("C"), met_frac=share("M"), gly_frac=share("G"), pro_frac=share("P"),
        cys_count=count("C"), met_count=count("M"), helices=[r[1] for r in rows], signal_peptide=[r[2] for r in rows],
        disorder_frac=spread[:, 0], disorder_nterm=spread[:, 1], disorder_cterm=spread[:, 2], disorder_internal=spread[:, 3], low_complexity=[r[3] for r in rows],
    )


def sequence_features(df: DataFrame, key: str, column: str) -> DataFrame:
    """key and FEATURES; each distinct sequence is computed once. Rows without a sequence have no features and are left out."""

    def run(batches):
        for b in batches:
            yield b.assign(**feature_frame(list(b["s"])))

    distinct = df.select(F.col(column).alias("s")).where("s IS NOT NULL").distinct()
    return df.select(F.col(key), F.col(column).alias("s")).join(distinct.mapInPandas(run, "s string, " + FEATURES), "s").drop("s")


def intervals(df: DataFrame, cleared: str, entered: str, level: float = 0.95) -> DataFrame:
    """df with lo and hi of the Jeffreys interval. Each distinct pair of counts is computed once."""

    def run(batches):
        for b in batches:
            both = [jeffreys(int(k), int(n), level) for k, n in zip(b["_k"], b["_n"], strict=True)]
            yield b.assign(lo=[x[0] for x in both], hi=[x[1] for x in both])

    pairs = df.select(F.col(cleared).cast("long").alias("_k"), F.col(entered).cast("long").alias("_n")).na.drop().distinct()
    table = pairs.mapInPandas(run, "_k long, _n long, lo double, hi double")
    return df.join(table, (F.col(cleared) == F.col("_k")) & (F.col(entered) == F.col("_n")), "left").drop("_k", "_n")


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for k in range(400):
        m = k // 2
        step = 1.0 if k == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if k % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + step * d)
        c = 1 + step / c
        f *= c * d
        if k and abs(c * d - 1) < 1e-13:
            break
    return front * (f - 1)


def jeffreys(cleared: int, entered: int, level: float = 0.95) -> tuple[float, float]:
    """Interval of a rate under the Jeffreys prior; nothing seen gives (0, 1), all or none seen closes that end."""
    if entered <= 0:
        return 0.0, 1.0

    def quantile(q: float) -> float:
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if beta_cdf(mid, cleared + 0.5, entered - cleared + 0.5) < q else (low, mid)
        return (low + high) / 2

    tail = (1 - level) / 2
    return (0.0 if cleared == 0 else quantile(tail)), (1.0 if cleared == entered else quantile(1 - tail))
