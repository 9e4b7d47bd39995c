import math

import numpy as np
import pytest

from stagewise.functions import sequence as S


def test_charge_is_zero_at_pi():
    counts = np.array([np.bincount(S.encode(s), minlength=20) for s in ("MKKLLRR", "DDEEAG", "ACDEFGHIKLMNPQRSTVWY" * 3)])
    assert np.abs(S.net_charge(counts, S.isoelectric_point(counts))).max() < 1e-6


def test_windows():
    x = np.arange(10.0)
    assert np.allclose(S.window_means(x, 4), [np.mean(x[i : i + 4]) for i in range(7)])
    assert S.features("L" * 25 + "D" * 30 + "I" * 25)[1] == 2
    assert S.features("L" * 12)[2] and not S.features("D" * 40)[2]
    assert S.low_complexity(S.encode("A" * 40)) == 1.0
    assert S.features("") == (0, 0, False, 0.0)


def test_beta_against_integration():
    for x, a, b in ((0.3, 2.5, 4.5), (0.9, 0.5, 3.5), (0.5, 10.5, 0.5)):
        u = (np.arange(400000) + 0.5) / 400000
        t = (1 - np.cos(math.pi * u)) / 2  # eases the ends
        w = t ** (a - 1) * (1 - t) ** (b - 1) * np.sin(math.pi * u)
        assert S.beta_cdf(x, a, b) == pytest.approx(w[t < x].sum() / w.sum(), abs=1e-4)


def test_jeffreys():
    assert S.jeffreys(0, 0) == (0.0, 1.0)
    wide, narrow = S.jeffreys(5, 10), S.jeffreys(50, 100)
    assert wide[0] < narrow[0] < 0.5 < narrow[1] < wide[1]
    assert S.jeffreys(0, 10)[0] == 0 and S.jeffreys(10, 10)[1] == 1


def test_frame_equals_single_rows(spark):
    rows = [(1, "MKLLLLLLLLLLLLLLLLLLLLLLLLLRRDE"), (2, "ACD"), (3, "ACD"), (4, "")]
    got = {r.k: r for r in S.sequence_features(spark.createDataFrame(rows, "k long, q string"), "k", "q").collect()}
    for k, s in rows:
        assert (got[k].n_residues, got[k].helices, got[k].signal_peptide, got[k].low_complexity) == S.features(s)


def test_disorder():
    assert S.disorder(S.encode("K" * 200)) == (1.0, 1.0, 1.0, 1.0)
    assert S.disorder(S.encode("I" * 200)) == (0.0, 0.0, 0.0, 0.0)
    whole, first, last, _ = S.disorder(S.encode("E" * 120 + "I" * 120))
    assert first == 1.0 and last == 0.0 and 0.4 < whole < 0.6
    assert all(math.isnan(x) for x in S.disorder(S.encode("")))


def test_intervals_equal_single_rows(spark):
    rows = [(1, 0, 0), (2, 3, 7), (3, 7, 7), (4, None, 5)]
    got = {r.t: (r.lo, r.hi) for r in S.intervals(spark.createDataFrame(rows, "t long, k int, n int"), "k", "n").collect()}
    assert got == {t: (None, None) if k is None else S.jeffreys(k, n) for t, k, n in rows}
