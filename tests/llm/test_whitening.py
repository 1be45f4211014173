import math

import numpy as np
import pytest

from recordloom.llm import queries, whitening

VECTOR = "vec_id long, embedding array<float>, label int"


def brute(vectors):
    """Exact covariance, its eigenvectors and the deviations, with Python's integers throughout."""
    y = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, d = len(y), len(y[0])
    s = [sum(r[j] for r in y) for j in range(d)]
    centred = [[n * r[j] - s[j] for j in range(d)] for r in y]
    v = np.array([[sum(r[i] * r[j] for r in centred) / n**3 for j in range(d)] for i in range(d)])
    return n, [sum(x * x for x in r) for r in centred], np.array(centred, float) / n, v


def test_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    given = [r for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect() if r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)]
    n, deviations, x, v = brute([r.embedding for r in given])
    values, axes = np.linalg.eigh(v)
    rows = queries.op13_whitening(spark, sf_dir).collect()
    assert len(rows) == 32 * n and {r.n for r in rows} == {n} and {r.component for r in rows} == set(range(1, 33))
    assert {(r.vec_id, r.deviation) for r in rows} == {(g.vec_id, e) for g, e in zip(given, deviations, strict=True)}
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9
    found = {(r.vec_id, r.component): r for r in rows}
    for k in range(1, 33):
        want = x @ axes[:, -k] / math.sqrt(values[-k])
        got = np.array([found[g.vec_id, k].whitened for g in given])
        assert np.abs(got * np.sign(got @ want) - want).max() < 1e-6
        assert math.isclose(found[given[0].vec_id, k].explained, values[-k] / np.trace(v), rel_tol=1e-9)


def test_scatter_is_exact():
    rng = np.random.default_rng(3)
    for bits in (4, 19, 20, 31, 45, 62, 63):
        y = rng.integers(-(1 << bits), (1 << bits) - (1_000_001 if bits == 63 else 1), size=(300, 5))
        y[0], y[1] = -(1 << bits), 0
        total = whitening.Scatter(5)
        total.add(y)
        total.empty()
        rows = y.astype(object)
        assert (total.sums == rows.sum(axis=0)).all() and (total.products == rows.T @ rows).all()


def test_far_from_zero_keeps_small_variances(spark, tmp_path):
    """Naive sums of squares lose these differences; large entries saturate as a long does."""
    rng = np.random.default_rng(4)
    vectors = [[float(2**40 + a), float(b), 7.0] for a, b in rng.integers(0, 3, size=(200, 2))]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    n, deviations, x, v = brute(vectors)
    rows = whitening.whiten(frame).collect()
    assert len(rows) == 3 * n and sorted((r.vec_id, r.deviation) for r in rows) == sorted((i, e) for i, e in enumerate(deviations) for _ in range(3))
    assert rows[0].identity_error < 1e-9 and all(r.whitened == 0 and r.explained == 0 for r in rows if r.component == 3)
    assert whitening.shifted(np.array([1e300, -1e300, 0.999, -0.001])).tolist() == [(1 << 63) - 1 - 1_000_000, -(1 << 63), 63, -1]


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [], 1)], [(None, [1.0, 2.0], None)], [(1, [1.0, 2.0], 1)] * 3])
def test_small_tables(spark, rows):
    found = whitening.whiten(spark.createDataFrame(rows, VECTOR)).collect()
    kept = [r for r in rows if r[1]]
    assert len(found) == 2 * len(kept) and all(r.whitened == 0 and r.deviation == 0 and r.n == len(kept) for r in found)


def test_odd_vectors_and_names(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 1), (2, [nan, 2.0], 1), (3, [1.0, None], 1), (4, [inf, 1.0], 1), (5, None, 1), (6, [3.0], 1), (None, [0.5, 8.0], None), (1, [1.0, 2.0], 1), (7, [-inf, 1.0], 2)]
    frame = spark.createDataFrame(rows, VECTOR)
    for name in ("id", "v", "n", "i", "j", "whitened", "deviation", "place"):
        frame = frame.selectExpr("*", f"'x' AS {name}")
    found = whitening.whiten(frame).collect()
    assert sorted(str((r.vec_id, r.component)) for r in found) == sorted(str((i, c)) for i in (1, 1, 6, None) for c in (1, 2))
    _, deviations, _, _ = brute([[1, 2], [3, 0], [0.5, 8], [1, 2]])
    assert sorted(r.deviation for r in found if r.component == 1) == sorted(deviations) and found[0].identity_error < 1e-9


def test_deviation_beyond_a_long(spark):
    rows = whitening.transform(frame := spark.createDataFrame([(1, [1e15]), (2, [-1e15])], "vec_id long, embedding array<double>"), whitening.fit(frame)).collect()
    assert [int(r.deviation) for r in rows] == [(2 * 64 * 10**15) ** 2] * 2
    assert {r.deviation for r in whitening.whiten(frame).collect()} == {None}
