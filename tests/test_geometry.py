"""Spectra of matrices against decompositions, and the movement of changed coordinates by hand."""

import numpy as np
import pytest

from millrace.operators.geometry import matrix_diagnostics
from millrace.operators.metrics import update_support


def frame(spark, matrices):
    return spark.createDataFrame([(k, [float(v) for v in r]) for k, m in matrices.items() for r in m], "k string, row array<double>").repartition(4)


def spectrum(m):
    return np.linalg.svd(m, compute_uv=False)


def test_exact_spectra(spark):
    rng = np.random.default_rng(1)
    matrices = {"eye": np.eye(2), "tall": rng.normal(size=(30, 5)), "wide": rng.normal(size=(4, 9)), "zero": np.zeros((3, 2))}
    got = {r.k: r for r in matrix_diagnostics(frame(spark, matrices), "k", "row").collect()}
    for k, m in matrices.items():
        s, r = spectrum(m), got[k]
        assert (r["rows"], r["columns"]) == m.shape and r.spectral_norm == pytest.approx(s[0])
        gram = m @ m.T if m.shape[0] <= m.shape[1] else m.T @ m
        assert r.orthogonality_error == pytest.approx(np.linalg.norm(gram - np.eye(len(gram))) / len(gram) ** 0.5, abs=1e-6)
        if s[0]:
            s5, s95 = np.quantile(s, [0.05, 0.95])
            assert r.regularized_s95_to_s5 == pytest.approx(s95 / max(s5, 1e-6 * s95)) and r.singular_value_log_spread == pytest.approx(np.log(s[0] / s[-1]), abs=1e-6)
            assert r.captured_share == pytest.approx(1.0) and not r.rank_99_censored
    assert got["eye"].rank_99 == 2 and got["eye"].stable_rank == pytest.approx(2.0) and got["eye"].entropy == pytest.approx(np.log(2))
    assert got["zero"].rank_99 == 0 and got["zero"].stable_rank is None


def test_leading_values_of_wide_matrices(spark):
    """600 columns of which a few directions lead: the leading values are found to the stated residual, the rest counts as a tail."""
    rng = np.random.default_rng(2)
    u, v = np.linalg.qr(rng.normal(size=(300, 6)))[0], np.linalg.qr(rng.normal(size=(600, 6)))[0]
    m = u * np.array([50, 40, 30, 20, 10, 5]) @ v.T + rng.normal(size=(300, 600)) * 0.01
    flat = rng.normal(size=(40, 600))
    got = {r.k: r for r in matrix_diagnostics(frame(spark, {"m": m, "flat": flat}), "k", "row", "blocks", rank=8).collect()}
    s, r = spectrum(m), got["m"]
    assert r.spectral_norm == pytest.approx(s[0], rel=1e-6) and r.stable_rank == pytest.approx((s**2).sum() / s[0] ** 2, rel=1e-6)
    assert r.rank_99 == int(np.flatnonzero(np.cumsum(s**2) >= 0.99 * (s**2).sum())[0]) + 1 and r.residual < 0.01
    assert r.captured_share == pytest.approx((s[:8] ** 2).sum() / (s**2).sum(), rel=1e-5)
    f = got["flat"]
    assert f.rank_99_censored and f.rank_99 == 9 and f.spectral_norm <= spectrum(flat)[0] * (1 + 1e-9)
    want = np.linalg.norm(flat @ flat.T - np.eye(40)) / 40**0.5
    assert f.orthogonality_error == pytest.approx(want, rel=0.2)


def test_values_that_are_not_finite_are_errors(spark):
    with pytest.raises(Exception, match="not finite"):
        matrix_diagnostics(frame(spark, {"m": [[1.0, float("nan")]]}), "k", "row").collect()


def support(spark, rows, views, size, window):
    deltas = spark.createDataFrame(rows, "view string, update bigint, offset bigint, values array<double>")
    return {(r.group, r.update): r for r in update_support(deltas, spark.createDataFrame(views, "view string, numel bigint, groups array<string>"), size, window).collect()}


def test_support_follows_updates_and_begins_anew_after_a_gap(spark):
    steps = {1: [1.0, 0.0, 1.0, 0.0], 2: [1.0, 1.0, 0.0, 0.0], 3: [0.0, 1.0, 0.0, 1.0], 5: [1.0, 0.0, 0.0, 0.0], 6: [0.0] * 4, 7: [0.0] * 4}
    pieces = [("w", u, at, v[at : at + 2]) for u, v in steps.items() for at in (0, 2)]
    got = support(spark, pieces, [("w", 4, ["global"])], 4, 2)
    one = lambda u: got["global", u]
    assert one(1).jaccard is None and one(1).contiguous and one(1).changed_share == 0.5
    assert one(2).jaccard == pytest.approx(1 / 3) and one(2).window_frequency == 0.5 and one(2).never_changed_share == 0.25
    assert one(3).jaccard == pytest.approx(1 / 3) and one(3).contiguous
    assert one(5).jaccard is None and not one(5).contiguous and one(5).window_frequency == 0.25
    assert one(6).jaccard == 0.0 and one(6).contiguous and one(7).jaccard == 1.0 and one(7).never_changed_share == 1.0


def test_support_weighs_by_parameters(spark):
    got = support(spark, [("large", 1, 0, [1.0] * 100), ("small", 1, 0, [0.0] * 10)], [("large", 100, ["global", "a"]), ("small", 10, ["global"])], 2, 2)
    r = got["global", 1]
    assert r.sample_count == 4 and r.population == pytest.approx(110) and r.changed_share == pytest.approx(100 / 110)
    assert got["a", 1].population == pytest.approx(100)


def test_angles_between_any_spaces(spark):
    from millrace.operators.geometry import principal_angles

    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(40, 3)), rng.normal(size=(40, 4))
    a[:, 2] = a[:, 0] - 2 * a[:, 1]  # a plane, told by three columns
    rows = [("k", a[i].tolist(), b[i].tolist()) for i in range(40)]
    r = principal_angles(spark.createDataFrame(rows, "k string, a array<double>, b array<double>").repartition(3), "k", "a", "b").first()
    qa, qb = np.linalg.qr(a[:, :2])[0], np.linalg.qr(b)[0]
    want = np.degrees(np.arccos(np.linalg.svd(qa.T @ qb, compute_uv=False)))
    assert r.max_deg == pytest.approx(want.max(), abs=1e-6) and r.mean_deg == pytest.approx(want.mean(), abs=1e-6)
