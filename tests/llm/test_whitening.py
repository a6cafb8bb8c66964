"""Whitening against numpy's eigenvectors, exact sums, ties and hard matrices."""

import math

import numpy as np
import pytest

from payrecheck.llm import bidiagonal as B
from payrecheck.llm import queries as Q
from payrecheck.llm import whitening as W

KIND = "vec_id long, embedding array<float>"


def _table(spark, rows, tmp_path, kind=KIND):
    spark.createDataFrame(rows, kind).repartition(3).write.mode("overwrite").parquet(
        f"{tmp_path}/embeddings.parquet"
    )
    return Q.op13_whitening(spark, str(tmp_path)).collect()


def _vectors(n, d, seed=0):
    rng = np.random.default_rng(seed)
    mix = rng.standard_normal((d, d)) * np.logspace(0, -1.5, d)
    return (rng.standard_normal((n, d)) @ mix + rng.standard_normal(d)).astype(np.float32)


def _check(got, table, components):
    """``table``: id to vector, of the rows that stay."""
    ids = list(table)
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in table[i]] for i in ids], object)
    n, sums = len(ids), x.sum(axis=0)
    centred = np.array((x * n - sums) / n, float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == n * components
    by = {(r.vec_id, r.component): r for r in got}
    deviations = ((x * n - sums) ** 2).sum(axis=1)
    for k in range(components):
        mine = np.array([by[i, k + 1].whitened for i in ids])
        want = centred @ vectors[:, k] / math.sqrt(values[k])
        at = int(np.argmax(np.abs(want)))
        if mine[at] * want[at] < 0:
            want = -want
        assert np.abs(mine - want).max() < 1e-8
        for i, d in zip(ids, deviations, strict=True):
            r = by[i, k + 1]
            assert (r.n, r.deviation) == (n, d)
            assert abs(r.explained - values[k] / values.sum()) < 1e-10
            assert 0 <= r.identity_error < 1e-9


def test_equals_numpy(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "BLOCK_ROWS", 7)
    v = _vectors(200, 12)
    rows = [(k, [float(c) for c in x]) for k, x in enumerate(v)]
    bad = [
        (900, None),
        (901, []),
        (902, [1.0] * 11 + [None]),
        (903, [1.0] * 11 + [float("nan")]),
        (904, [float("-inf")] * 12),
        (905, [1.0] * 5),
    ]
    got = _table(spark, rows + bad, tmp_path)
    _check(got, dict(enumerate(v)), 12)


def test_thirty_two_at_most_and_many_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "FAN", 2)
    v = _vectors(300, 40, 4)
    got = _table(spark, [(k, [float(c) for c in x]) for k, x in enumerate(v)], tmp_path)
    _check(got, dict(enumerate(v)), 32)


def test_no_rows_one_row_and_equal_rows(spark, tmp_path):
    assert _table(spark, [], tmp_path / "a") == []
    assert _table(spark, [(1, None)], tmp_path / "b") == []
    for rows in ([(1, [1.0, 2.0])], [(k, [1.0, 2.0]) for k in range(9)]):
        got = _table(spark, rows, tmp_path / f"c{len(rows)}")
        assert len(got) == 2 * len(rows)
        assert {(r.whitened, r.explained, r.identity_error, r.deviation) for r in got} == {
            (0.0, 0.0, 0.0, 0)
        }


def test_null_and_repeated_ids_constant_entries_and_other_names(spark, tmp_path):
    rows = [(None if k % 3 else 7, [float(k), 5.0, float(k * k % 11), float(k)], k) for k in range(40)]
    got = _table(spark, rows, tmp_path, KIND + ", x int")
    assert len(got) == 160
    last = [r for r in got if r.component > 2]
    assert {r.whitened for r in last} == {0.0}
    assert sum(r.explained for r in got) / 40 == pytest.approx(1.0)
    assert max(r.identity_error for r in got) < 1e-9


def test_deviation_is_exact_beyond_floats(spark, tmp_path):
    for factor in (2048.0, 4096.0):
        rows = [(k, [k * factor + 0.25, 1.0 / (k + 1)]) for k in range(200)]
        got = _table(spark, rows, tmp_path / str(factor))
        x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows]
        sums = [sum(column) for column in zip(*x, strict=True)]
        for r in got:
            want = sum((200 * c - s) ** 2 for c, s in zip(x[r.vec_id], sums, strict=True))
            assert r.deviation == (want if want < 1 << 63 else None)
        assert any(r.deviation is None for r in got) == (factor == 4096.0)
        assert max(r.deviation or 0 for r in got) > 1 << 62


def _verify(matrix, count):
    values, vectors, total = B.right_vectors(matrix, count)
    want = np.linalg.svd(matrix)[1] ** 2
    there = values > 0
    k = int(there.sum())
    assert np.allclose(values[there], want[:k], rtol=1e-11, atol=0)
    v = vectors[:, there]
    assert np.abs(v.T @ v - np.eye(k)).max() < 1e-9
    image = matrix @ v / np.sqrt(values[there])
    assert np.abs(image.T @ image - np.eye(k)).max() < 1e-9
    assert total == pytest.approx(want.sum(), rel=1e-12)
    return k


@pytest.mark.parametrize(
    "values",
    [
        np.ones(24),
        np.r_[np.full(5, 2.0), np.full(19, 1.0)],
        1 + 1e-9 * np.arange(24),
        1 + 1e-5 * np.arange(24),
        np.r_[1.0, 1 - 1e-15, np.full(22, 0.5)],
        np.logspace(0, -4, 24),
        np.arange(1.0, 25.0),
    ],
)
def test_close_and_equal_values(values):
    rng = np.random.default_rng(3)
    turn = [np.linalg.qr(rng.standard_normal((24, 24)))[0] for _ in range(2)]
    assert _verify(turn[0] @ np.diag(values) @ turn[1], 24) == 24


def test_hard_matrices():
    rng = np.random.default_rng(6)
    assert _verify(np.diag(np.arange(9.0, 0.0, -1.0)), 9) == 9
    assert _verify(np.eye(3) * 1e-100, 3) == 3
    assert B.right_vectors(np.zeros((4, 4)), 4)[2] == 0.0
    m = rng.standard_normal((20, 20))
    m[:, 5] = 0
    m[:, 6] = m[:, 7]
    assert _verify(np.linalg.qr(m, mode="r"), 20) == 18
    for _ in range(40):
        d = int(rng.integers(1, 20))
        m = rng.standard_normal((d, d)) * 10.0 ** rng.uniform(-2, 2, d)
        values, vectors, _ = B.right_vectors(np.linalg.qr(m, mode="r"), d)
        there = values > 0
        v = vectors[:, there]
        assert np.abs(v.T @ v - np.eye(int(there.sum()))).max() < 1e-8
        # Rounding of the matrix itself bounds what the smallest can agree to.
        assert np.abs(values - np.linalg.svd(m)[1] ** 2).max() < 1e-13 * values[0]


def test_bidiagonal_form_and_dqds():
    rng = np.random.default_rng(8)
    m = rng.standard_normal((15, 15))
    a, b, v = B.bidiagonalise(m)
    form = np.diag(a) + np.diag(b, 1)
    assert np.allclose(v.T @ v, np.eye(15)) and np.allclose((m @ v).T @ (m @ v), form.T @ form)
    # A graded matrix: small values keep their digits.
    a, b = np.logspace(0, -10, 12), np.logspace(-1, -11, 11)
    got = B.dqds(a, b)
    assert np.prod(got / a**2) == pytest.approx(1.0, rel=1e-12)
