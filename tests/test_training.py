import hashlib
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from curalume.operators import training

SHAPE = "path string, features array<float>"


def vectors(seed, n, shift=0.0):
    r = np.random.default_rng(seed)
    return [(f"{seed}-{i}", [float(x) for x in r.normal(shift, 1, 6)]) for i in range(n)]


def test_scaler_is_population_and_keeps_constant_columns(frame):
    m = training.fit_scaler(frame([("a", [1.0, 5.0]), ("b", [3.0, 5.0])], SHAPE)).first()
    assert m["mean"] == [2.0, 5.0] and m["std"] == [1.0, 0.0]
    s = training.scaled(frame([("a", [3.0, 6.0])], SHAPE), training.fit_scaler(frame([("a", [1.0, 5.0]), ("b", [3.0, 5.0])], SHAPE)))
    assert s.first().features == [1.0, 1.0]


def test_training_set_has_paths_of_existing_stills_only(frame):
    d = datetime(2024, 1, 1)
    shape = "uuid string, path string, path_edited string, date timestamp, favorite boolean, screenshot boolean, ismissing boolean"
    rows = [("1", "/a.jpg", "/e1.jpg", d, True, False, False), ("2", "/b.mov", "/e2.jpg", d, True, False, False), ("3", "/gone.jpg", "/e3.jpg", d, True, False, False), ("4", "/gone4.jpg", None, d, True, False, False),
            ("5", "/r.jpg", None, None, False, True, False), ("6", "/x.jpg", None, d, False, False, False), ("7", "/y.jpg", "/y.mp4", d, False, False, False), ("8", None, None, d, False, False, False)]
    files = frame([("/a.jpg",), ("/b.mov",), ("/e2.jpg",), ("/e3.jpg",), ("/r.jpg",), ("/x.jpg",), ("/y.mp4",), ("/folder/1.jpg",)], "path string")
    lists = [frame([(u,) for u in x], "uuid string") for x in (["5", "1"], ["6", "7", "8"])]
    given = (frame(rows, shape), files, F.lit("2024-02-01").cast("timestamp"))
    found = training.training_set(*given, files.where("path like '/folder/%'"), *lists)
    assert sorted(tuple(r) for r in found.select("path", "label", "origin").collect()) == [("/a.jpg", 1, "library"), ("/e3.jpg", 1, "library"), ("/folder/1.jpg", 0, "folder"), ("/r.jpg", 1, "library"), ("/x.jpg", 0, "feedback")]
    assert sorted(tuple(r) for r in training.training_skipped(*given, *lists).collect()) == [("feedback", 1, 1), ("library", 1, 1)]


def test_two_classes_round_trip(spark, frame, tmp_path):
    good, bad = frame(vectors(1, 60, 1.5), SHAPE), frame(vectors(2, 60, -1.5), SHAPE)
    scorer = training.train_scorer(good, bad, trees=20)
    assert not scorer.is_one_class
    rows = training.label_rows(good, bad)
    v = training.validation_stats(training.score(rows, scorer)).first()
    assert v.verdict == "good" and v.separation > 0.5
    scorer.save(spark, str(tmp_path / "m"))
    again = training.Scorer.load(spark, str(tmp_path / "m"))
    assert {r.path: r.score for r in training.score(good, again).collect()} == {r.path: r.score for r in training.score(good, scorer).collect()}


def test_one_class_leaves_few_outside(spark, frame, tmp_path):
    good = frame(vectors(3, 150), SHAPE)
    scorer = training.train_scorer(good, frame(vectors(4, 9), SHAPE), rounds=25)
    assert scorer.is_one_class
    inside = [r.score for r in training.score(good, scorer).collect()]
    far = [r.score for r in training.score(frame(vectors(5, 30, 6.0), SHAPE), scorer).collect()]
    assert np.mean(np.array(inside) < 0.45) <= 0.2 and max(far) < np.median(inside)
    scorer.save(spark, str(tmp_path / "m"))
    assert training.Scorer.load(spark, str(tmp_path / "m")).is_one_class
    with pytest.raises(ValueError):
        training.score(good, None)


def kernel_of(x):
    return np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / x.shape[1])


def exact_one_class(k, total, steps=30_000):
    """Weights by projected gradient steps: the projection shifts all weights until those clipped to [0, 1] have the sum."""
    alpha, size = np.full(len(k), total / len(k)), 1 / np.linalg.norm(k, 2)
    for _ in range(steps):
        v = alpha - size * (k @ alpha)
        low, high = v.min() - 1, v.max()
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if np.clip(v - mid, 0, 1).sum() > total else (low, mid)
        new = np.clip(v - high, 0, 1)
        if abs(new - alpha).max() < 1e-10:
            break
        alpha = new
    return alpha


@pytest.mark.parametrize(("width", "working"), [(3, 32), (6, 4096)])
def test_one_class_equals_an_exact_solver(frame, width, working):
    r = np.random.default_rng(11)
    x = r.normal(0, 1, (150, width))
    fit = training.fit_one_class(frame([(v,) for v in x.tolist()] + [([*x[0].tolist()],)] * 5, "features array<double>"), tolerance=1e-5, working=working)
    x = np.vstack((x, x[:1].repeat(5, 0)))
    k = kernel_of(x)
    alpha = exact_one_class(k, fit.total)
    assert fit.total == 16 and fit.gap <= 1e-5 and abs(fit.alphas.sum() - fit.total) < 1e-8 and fit.alphas.max() <= 1
    objective = fit.alphas @ kernel_of(fit.vectors) @ fit.alphas / 2
    assert abs(objective - alpha @ k @ alpha / 2) <= 2e-5 * objective
    free = (alpha > 1e-4) & (alpha < 1 - 1e-4)
    rho = (k @ alpha)[free].mean()
    mine = np.exp(-((x[:, None] - fit.vectors[None]) ** 2).sum(2) / width) @ fit.alphas
    assert np.allclose(mine - fit.rho, k @ alpha - rho, atol=2e-2)
    assert working < 100 and fit.rounds > 1 or fit.rounds == 1


def test_a_fit_that_ends_early_says_so(frame):
    x = np.random.default_rng(12).normal(0, 1, (200, 3))
    with pytest.warns(UserWarning, match="ended after 1 rounds"):
        fit = training.fit_one_class(frame([(v,) for v in x.tolist()], "features array<double>"), rounds=1, tolerance=1e-7, working=8)
    assert fit.gap > 1e-7


def test_the_scale_of_one_class_scores(frame):
    good = frame(vectors(6, 120), SHAPE)
    plain, normal = (training.train_scorer(good, None, scale=x) for x in ("libsvm", "normalised"))
    assert plain.divisor == 1 and normal.divisor == 12 and plain.gap <= 1e-3
    a, b = ({r.path: r.score for r in training.score(good, x).collect()} for x in (plain, normal))
    assert sorted(a, key=a.get) == sorted(b, key=b.get) and max(abs(x - 0.5) for x in b.values()) < max(abs(x - 0.5) for x in a.values())
    with pytest.raises(ValueError):
        training.train_scorer(good, None, scale="other")


def test_exact_sample_finds_the_nth_hash_in_buckets(spark, frame):
    rows = spark.range(5000).selectExpr("cast(id % 4900 as string) as path")
    ordered = sorted((hashlib.md5(f"{i % 4900}|42".encode()).hexdigest()[:15], str(i % 4900)) for i in range(5000))
    for n, small in ((1, 4096), (700, 1), (700, 50), (4999, 1), (5000, 1), (9000, 1)):
        assert sorted(r.path for r in training.exact_sample(rows, n, small=small).collect()) == sorted(p for _, p in ordered[:n])
    assert training.exact_sample(frame([("a",)] * 20 + [(None,)] * 3, "path string"), 7, small=2).count() == 7
    assert training.exact_sample(rows.limit(0), 3).count() == 0 and training.exact_sample(rows, 0).count() == 0


def test_cache_fill_is_idempotent(spark, frame, tmp_path):
    from curalume.sources import sinks

    cache = frame([("a", [1.0])], SHAPE)
    sinks.append_features(frame([("a", [2.0]), ("b", [3.0]), ("b", [3.0])], SHAPE), cache, str(tmp_path / "c"))
    assert [r.path for r in spark.read.parquet(str(tmp_path / "c")).collect()] == ["b"]
