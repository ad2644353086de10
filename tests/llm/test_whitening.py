"""Whitening against a plain eigensolver, and the divide and conquer on hard spectra."""

import numpy as np
import pytest

from meshflux.llm import whitening
from tests.llm.conftest import vectors


def plain(rows, most=16):
    usable = [(k, v) for k, v, *_ in rows if v is not None and len(v) == 20 and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(64 * np.array([v for _, v in usable], np.float32).astype(float)).astype(int) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = (n * fit - sums) / n
    values, vectors_ = np.linalg.eigh(centred.T @ centred / n)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    white = ((n * x - sums) / n) @ vectors_[:, :most] / np.sqrt(values[:most])
    return usable, n, ((n * x - sums) ** 2).sum(1), white, values[:most] / values.sum()


def test_whitening(spark, folder):
    from meshflux.llm import queries

    rows = queries.QUERIES["op11_whitening"](spark, folder).collect()
    usable, n, deviation, white, explained = plain(vectors())
    assert len(rows) == 16 * len(usable) and {r.n for r in rows} == {n}
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9

    def by(found):
        return sorted(found, key=lambda t: (t[0] is None, t[0] or 0, [round(abs(z), 6) for z in t[2]]))

    own = {}
    for r in rows:
        own.setdefault((r.vec_id, r.deviation, r.component), []).append(r)
    got = {}
    for (key, dev, component), some in own.items():
        got.setdefault((key, dev), [None] * 16)[component - 1] = abs(some[0].whitened)
        assert abs(some[0].explained / explained[component - 1] - 1) < 1e-9
    want = {(k, int(d)): np.abs(w) for (k, _), d, w in zip(usable, deviation, white, strict=True)}
    assert set(got) == set(want)
    assert all(np.allclose(got[k], want[k], atol=1e-9) for k in want)
    # One sign for all rows: whitened columns correlate fully.
    signs = {}
    for r in rows:
        k = [i for i, (key, d) in enumerate(zip([u[0] for u in usable], deviation, strict=True)) if key == r.vec_id and d == r.deviation][0]
        if abs(white[k, r.component - 1]) > 1e-6:
            signs.setdefault(r.component, set()).add(np.sign(r.whitened * white[k, r.component - 1]))
    assert all(len(s) == 1 for s in signs.values())


@pytest.mark.parametrize("spectrum", [[5, 4, 3, 2, 1], [1, 1, 1, 1], [0, 0, 0], [1e12, 1, 1e-3], [3, 3, 3, 1, 1, 0], [2, 2 - 1e-9, 1], [1], [-1, 1, 0, 0]])
def test_eigen(spectrum):
    turn = np.linalg.qr(np.random.default_rng(len(spectrum)).standard_normal((len(spectrum),) * 2))[0]
    v = turn @ np.diag(np.array(spectrum, float)) @ turn.T
    v = (v + v.T) / 2
    values, vectors_ = whitening.eigen(v)
    scale = max(1e-300, np.abs(v).max())
    assert np.allclose(values, sorted(spectrum, reverse=True), atol=1e-13 * scale)
    assert np.abs(v @ vectors_ - vectors_ * values).max() <= 1e-13 * scale * len(spectrum)
    assert np.abs(vectors_.T @ vectors_ - np.eye(len(spectrum))).max() < 1e-13


def test_polar_is_the_sign():
    a = np.diag([3.0, 1e-9, -2.0])
    assert np.allclose(whitening.polar(a), np.diag([1, 1, -1]), atol=1e-12)


def test_few_vectors(spark):
    def run(rows):
        return whitening.whiten(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()

    assert run([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []  # no spread
    two = run([(1, [1.0, 2.0]), (2, [2.0, 2.0]), (3, [3.0])])
    assert {(r.vec_id, r.component) for r in two} == {(1, 1), (2, 1)} and {round(abs(r.whitened), 9) for r in two} == {1.0}
    huge = run([(1, [1e30, 2.0]), (2, [2.0, 2.0])])  # beyond 64 bits
    assert all(r.deviation is None for r in huge) and len(huge) == 2
