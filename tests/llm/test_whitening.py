import math
import random

import numpy as np

from curalume.llm.whitening import bidiagonalise, fit_whitening, whitened_embeddings

SCHEMA = "vec_id long, embedding array<float>, component string"


def brute(rows, components=4):
    """(n, S, eigenvalues, eigenvectors, trace) by a plain eigendecomposition, and the integer vectors of usable rows."""
    used = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in used})
    x = np.array(fit, float)
    e, q = np.linalg.eigh((x - x.mean(0)).T @ (x - x.mean(0)) / len(x))
    return len(fit), np.array(fit).sum(0), e[::-1][:components], q.T[::-1][:components], e.sum(), used


def compare(frame, rows, components=4):
    n, sums, e, q, trace, used = brute(rows, components)
    found = whitened_embeddings(frame([(i, v, "clash") for i, v in rows], SCHEMA)).collect()
    k = sum(x > 1e-9 * e[0] for x in e)
    assert len(found) == k * len(used)
    by = {}
    for r in found:
        by.setdefault(r.component, []).append(r)
    mean = sums / n
    for j in range(k):
        mine = sorted(by[j + 1], key=lambda r: (r.vec_id, r.deviation, abs(r.whitened)))
        want = sorted(((i, sum((n * a - int(s)) ** 2 for a, s in zip(x, sums, strict=True)), abs((np.array(x) - mean) @ q[j] / math.sqrt(e[j]))) for i, x in used))
        assert [(r.vec_id, r.deviation) for r in mine] == [w[:2] for w in want]
        assert np.allclose([abs(r.whitened) for r in mine], [w[2] for w in want], atol=1e-7)
        assert all(r.n == n and abs(r.explained * trace / e[j] - 1) < 1e-9 and r.identity_error < 1e-9 for r in mine)
        sign = {round(r.whitened / ((np.array(dict(used)[r.vec_id]) - mean) @ q[j]) * math.sqrt(e[j])) for r in mine if abs(r.whitened) > 1e-3}
        assert len(sign) <= 1, "one sign for all rows"


def vectors(seed, n, d):
    r = np.random.default_rng(seed)
    return (r.standard_normal((n, d)) * np.linspace(1, 3, d) + 5).astype(np.float32).tolist()


def test_whitening_equals_an_eigendecomposition(frame):
    rows = [*enumerate(vectors(1, 300, 12))]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]  # one vector very often
    rows += [(2000, None), (2001, []), (2002, [float("nan")] * 12), (2003, [None] + [1.0] * 11), (2004, [float("inf")] + [1.0] * 11)]
    compare(frame, rows)


def test_few_dimensions_and_directions_without_variance(frame):
    compare(frame, [*enumerate(vectors(2, 50, 3))])
    flat = [[a, 2 * a, 1.0, b, b] for a, b in np.random.default_rng(3).integers(-9, 9, (80, 2)).astype(float).tolist()]
    compare(frame, [*enumerate(flat)])


def test_fewer_rows_than_dimensions(frame):
    compare(frame, [*enumerate(vectors(4, 5, 9))])


def test_equal_vectors_empty_tables_and_other_widths(frame, spark):
    assert whitened_embeddings(frame([(i, [1.0, 2.0], "x") for i in range(5)], SCHEMA)).count() == 0
    assert whitened_embeddings(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitened_embeddings(spark.createDataFrame([(1, None, "")], SCHEMA)).count() == 0
    rows = [*enumerate(vectors(5, 40, 4))]
    found = whitened_embeddings(frame([*((i, v, "") for i, v in rows), (90, [1.0], ""), (None, rows[0][1], "")], SCHEMA)).collect()
    assert len(found) == 4 * 41 and {r.vec_id for r in found} == {*range(40), None}
    assert {r.n for r in found} == {40}


def test_deviations_beyond_64_bits_are_null(frame):
    rows = [(i, [float(10**7 * i), float(i % 7)]) for i in range(40)]
    found = whitened_embeddings(frame([(*r, "") for r in rows], SCHEMA)).collect()
    assert len(found) == 80 and {r.vec_id for r in found if r.deviation is None} and all(math.isfinite(r.whitened) for r in found)


def test_equal_singular_values_are_all_found():
    x = np.kron(np.eye(6), np.ones((2, 1))) * [3, 3, 3, 3, 1, 1]
    s, v, steps = bidiagonalise(lambda w: (float((x @ w) @ (x @ w)), x.T @ (x @ w)), 6, float((x**2).sum()), 4)
    assert np.allclose(s, 3 * math.sqrt(2)) and np.allclose(v @ v.T, np.eye(4)) and np.allclose(v[:, 4:], 0) and steps == 6


def test_a_falling_spectrum_ends_before_the_full_width():
    r = np.random.default_rng(8)
    x = r.standard_normal((400, 60)) * 10.0 ** -np.linspace(0, 12, 60)
    s, v, steps = bidiagonalise(lambda w: (float((x @ w) @ (x @ w)), x.T @ (x @ w)), 60, float((x**2).sum()), 4)
    want = np.linalg.svd(x)
    assert steps < 40 and np.allclose(s, want[1][:4], rtol=1e-12) and np.allclose(np.abs(np.sum(v * want[2][:4], 1)), 1)


def test_the_model_does_not_hang_on_the_order_of_rows(frame):
    rows = [(i, v, "") for i, v in enumerate(vectors(6, 120, 5))]
    random.Random(1).shuffle(rows)
    a, b = fit_whitening(frame(rows, SCHEMA)), fit_whitening(frame(rows[::-1], SCHEMA).repartition(5))
    assert a.n == b.n == 120 and a.sums == b.sums and np.allclose(np.abs(np.sum(a.components * b.components, 1)), 1)
