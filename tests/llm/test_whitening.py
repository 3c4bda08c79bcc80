"""Whitening against a dense eigendecomposition."""

import math

import numpy as np
import pytest

from readtally.llm import whitening


def dense(vectors):
    """Integer rows that remain, n, sums, eigenvalues and vectors of the distinct rows."""
    kept = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    size = max((len(x) for _, x in kept), default=0)
    kept = [(i, x + [0] * (size - len(x))) for i, x in kept]
    own = sorted(set(map(tuple, (x for _, x in kept))))
    if not size:
        return kept, len(own), [], np.empty(0), None
    total = [sum(c) for c in zip(*own, strict=True)]
    c = np.array([[a - s / len(own) for a, s in zip(x, total, strict=True)] for x in own])
    values, basis = np.linalg.eigh(c.T @ c / len(own))
    return kept, len(own), total, values[::-1], basis[:, ::-1]


def check(spark, vectors, tmp_path, size=None):
    spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in vectors], "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = whitening.op13(spark, str(tmp_path)).collect()
    kept, n, total, values, basis = dense([(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in vectors])
    wanted = int((values[:4] > 1e-12 * max(values[0], 1e-300)).sum()) if len(values) else 0
    assert len(got) == len(kept) * wanted and (size is None or wanted == size)
    by_row = {}
    for r in got:
        by_row.setdefault(r["deviation"], []).append(r)
        assert r["n"] == n and r["identity_error"] <= 1e-9 and abs(r["explained"] / (values[r["component"] - 1] / values.sum()) - 1) < 1e-9
    for _, x in kept if wanted else []:
        rows = by_row[sum((n * a - s) ** 2 for a, s in zip(x, total, strict=True))]
        for r in rows:
            e = values[r["component"] - 1]
            plain = np.dot(np.array(x) - np.array(total) / n, basis[:, r["component"] - 1]) / math.sqrt(e)
            assert any(abs(abs(q["whitened"]) - abs(plain)) < 1e-6 for q in rows if q["component"] == r["component"])
    return got


def test_against_dense(spark, tmp_path):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((400, 20)) * np.linspace(3, 0.1, 20) + 5
    rows = [(i, list(x)) for i, x in enumerate(v)] + [(i, list(v[0])) for i in range(300)]
    rows += [(900, None), (901, [None] * 20), (902, [float("nan")] * 20), (903, [float("inf")] + [0.0] * 19), (None, list(v[1]))]
    got = check(spark, rows, tmp_path, 4)
    w = {k: np.array([r["whitened"] for r in got if r["component"] == k]) for k in (1, 2, 3, 4)}
    assert all(len(x) == 701 for x in w.values()) and max(r["residual"] for r in got) < 1e-9


@pytest.mark.parametrize("case", ["one", "two", "line", "ragged", "none", "empty", "nothing"])
def test_edges(spark, tmp_path, case):
    rows, size = {
        "one": ([(1, [1.0, 2.0]), (2, [1.0, 2.0])], 0),
        "two": ([(1, [1.0, 2.0, 0.5]), (2, [0.0, 2.0, 1.5])], 1),
        "line": ([(i, [i / 256, 2 * i / 256, 0.0]) for i in range(50)], 1),
        "ragged": ([(i, [math.sin(i), math.cos(i * i), 2.0, i % 7 / 3][: 2 + i % 3]) for i in range(60)], 4),
        "none": ([(1, None), (2, [None, 1.0])], 0),
        "empty": ([], 0),
        "nothing": ([(1, []), (2, [])], 0),
    }[case]
    check(spark, rows, tmp_path, size)


def test_block_iteration():
    """Eigenpairs of a matrix with close eigenvalues, as of dense algebra; the spread asks for many rounds."""
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.standard_normal((300, 300)))[0]
    e = np.concatenate([[10, 9.999, 9.9, 5], np.linspace(4.9, 0, 296)])
    m = q * e @ q.T
    calls = []

    def product(block):
        calls.append(block.shape[1])
        assert np.allclose(block.T @ block, np.eye(block.shape[1]), atol=1e-12)
        return m @ block, float(e.sum())

    values, vectors, residuals, trace = whitening.eigenpairs(product, 300)
    assert np.allclose(values, e[:4], rtol=1e-12) and residuals.max() <= 1e-11 and trace == e.sum() and 3 < len(calls) < 100
    assert np.allclose(np.abs(np.diag(vectors.T @ q[:, :4])), 1, atol=1e-9)


def test_large_numbers(spark):
    """Exact deviations beyond 53 bits; those beyond 64 are an error."""
    rows = [(i, [1e6 + i, -3e3 * i]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = whitening.fit(df)
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(df, model).collect()}
    kept, n, total, *_ = dense(rows)
    assert got == {i: sum((n * a - s) ** 2 for a, s in zip(x, total, strict=True)) for i, x in kept} and max(got.values()) > 1 << 53
    wide = spark.createDataFrame([(1, [1e12]), (2, [-1e12])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        whitening.whiten(wide, whitening.fit(wide)).collect()


def test_extra_columns_stay(spark):
    df = spark.createDataFrame([(i, [float(i % 5), float(i % 3)], "x", 1) for i in range(30)], "vec_id long, embedding array<float>, x string, deviation int")
    out = whitening.whiten(df, whitening.fit(df))
    assert out.columns == ["vec_id", "embedding", "x", "deviation", "whitened"] and out.count() == 30
