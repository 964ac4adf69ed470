"""Labelled sets, the feature cache, and preference models: a forest for two classes, a one-class model for one."""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curalume.functions.vectors import sigmoid, standardise
from curalume.operators.forest import Forest, fit_forest, forest_scores
from curalume.operators.photos import resolve_path, training_positives
from curalume.plans.tables import Scratch, saved


def attach_features(rows: DataFrame, features: DataFrame) -> DataFrame:
    """Rows with their features by path; rows without any are left out."""
    return rows.join(features.select("path", "features"), "path")


def features_to_extract(paths: DataFrame, cache: DataFrame) -> DataFrame:
    return paths.join(cache.select("path"), "path", "left_anti")


def add_rescued(positives: DataFrame, photos: DataFrame, rescued: DataFrame) -> DataFrame:
    """positives and the rescued photos of the library that are not among them."""
    return union_positives(positives, photos.join(rescued.select("uuid"), "uuid", "left_semi"))


def feedback_negatives(photos: DataFrame, bad: DataFrame) -> DataFrame:
    return photos.join(bad.select("uuid"), "uuid", "left_semi").where(~F.col("ismissing"))


#: Bits of a sample's hash that one pass over the rows settles, of 60.
_BITS = 15


def sample_hash(key: str, seed: int) -> Column:
    """60 bits of the key's md5, as long."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f"|{seed}")).cast("binary")), 1, 15), 16, 10).cast("long")


def exact_sample(df: DataFrame, n: int, seed: int = 42, key: str = "path", small: int = 4096) -> DataFrame:
    """n rows without replacement, those of the least hash of their key and the seed; all if there are no more.

    The n-th hash is found by counting rows in buckets of leading bits, then in those of the bucket that it is in, until that
    has `small` rows at most or is cut at its end; only those rows are sorted. Rows of one key are taken in any order.
    """
    scratch = Scratch(df.sparkSession)
    try:
        hashes = scratch.saved(df.select(sample_hash(key, seed).alias("h")), "hashes")
        low, left, shift = 0, n, 60
        while shift > 0:
            shift -= _BITS
            bucket = F.shiftright("h", shift)
            inside = hashes.where((F.col("h") >= low) & (F.col("h") < low + (1 << (shift + _BITS))))
            counts = inside.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).orderBy("b").collect()
            taken = np.cumsum([r.n for r in counts])
            at = int(np.searchsorted(taken, left))
            if at == len(counts):  # no more rows than wanted
                return df
            low, left, rows = counts[at].b << shift, left - int(taken[at] - counts[at].n), counts[at].n
            if left == rows or rows <= small:
                break
    finally:
        scratch.close()
    h = sample_hash(key, seed)
    below, cut = df.where(h < low), df.where((h >= low) & (h < low + (1 << shift)))
    return below.unionByName(cut if left == rows else cut.orderBy(h, key).limit(left))


def distinct_paths(files: DataFrame) -> DataFrame:
    return files.dropDuplicates(["path"])


def union_positives(library: DataFrame, rescued: DataFrame) -> DataFrame:
    """library and the rows of `rescued` whose uuid it doesn't have, each uuid once."""
    more = rescued.dropDuplicates(["uuid"]).join(library.select("uuid"), "uuid", "left_anti")
    return library.unionByName(more.select(*library.columns))


def union_negatives(folder: DataFrame, feedback: DataFrame) -> DataFrame:
    """Both lists one after the other; a path in both counts twice."""
    return folder.unionByName(feedback)


def label_rows(good: DataFrame, bad: DataFrame) -> DataFrame:
    return good.withColumn("label", F.lit(1)).unionByName(bad.withColumn("label", F.lit(0)))


def _training_photos(photos: DataFrame, cutoff: Column, rescued: DataFrame, bad: DataFrame, sample: int | None) -> tuple[DataFrame, DataFrame]:
    """Good photos, sampled if a size is given, and rejected ones, whose files are yet to be looked for."""
    good = add_rescued(training_positives(photos, cutoff), photos, rescued)
    return good if sample is None else exact_sample(good, sample, key="uuid"), feedback_negatives(photos, bad)


def training_set(photos: DataFrame, files: DataFrame, cutoff: Column, folder: DataFrame, rescued: DataFrame, bad: DataFrame, sample: int | None = None) -> DataFrame:
    """(path, label, origin): favourites before the cutoff and rescued photos as 1, the folder and rejected photos as 0.

    With a sample size, good photos and folder files are sampled each by itself, rejected photos never are. Photos
    of the library stand with the path that resolve_path finds in `files`; those without a file and videos drop
    out after the sample, and training_skipped counts them. Folder files are taken as they are listed.
    """
    good, rejected = _training_photos(photos, cutoff, rescued, bad, sample)
    listed = folder.select("path", F.lit("folder").alias("origin"))
    if sample is not None:
        listed = exact_sample(listed, sample)
    found = lambda rows, origin: resolve_path(rows, files).select("path", F.lit(origin).alias("origin"))
    return label_rows(found(good, "library"), union_negatives(listed, found(rejected, "feedback")))


def training_skipped(photos: DataFrame, files: DataFrame, cutoff: Column, rescued: DataFrame, bad: DataFrame, sample: int | None = None) -> DataFrame:
    """(origin, skipped, skipped_videos): how many photos training_set leaves out for want of a file, and as videos."""
    good, rejected = _training_photos(photos, cutoff, rescued, bad, sample)
    counts = lambda rows, origin: resolve_path(rows, files, counts=True).select(F.lit(origin).alias("origin"), "*")
    return counts(good, "library").unionByName(counts(rejected, "feedback"))


def training_counts(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows by label, origin and whether their features are cached."""
    known = cache.select("path").distinct().withColumn("cached", F.lit(True))
    return rows.join(known, "path", "left").groupBy("label", "origin", F.coalesce("cached", F.lit(False)).alias("cached")).agg(F.count("*").alias("n"))


def fit_scaler(rows: DataFrame) -> DataFrame:
    """One row (mean, std) of feature arrays: population deviation by element, 0 where all are equal. Each task keeps one summary of vectors; rows without features do not count."""
    stats = rows.where("features is not null").select(Summarizer.metrics("mean", "variance", "min", "max", "count").summary(array_to_vector(F.col("features").cast("array<double>"))).alias("s"))
    at = stats.select(F.col("s.count").alias("n"), *(vector_to_array(f"s.{c}").alias(c) for c in ("mean", "variance", "min", "max")))
    width = F.sequence(F.lit(0), F.size("mean") - 1)
    deviation = F.transform(width, lambda i: F.when(F.get("min", i) == F.get("max", i), F.lit(0.0)).otherwise(F.sqrt(F.get("variance", i) * (F.col("n") - 1) / F.col("n"))))
    return at.select("mean", deviation.alias("std"))


def scaled(rows: DataFrame, scaler: DataFrame) -> DataFrame:
    """rows with features standardised by a one-row scaler."""
    m = scaler.first()
    fixed = lambda v: F.array(*(F.lit(float(x)) for x in v))
    return rows.withColumn("features", standardise("features", fixed(m["mean"]), fixed(m["std"])))


@dataclass(frozen=True)
class Scorer:
    """A fitted scaler and model; one-class models carry support vectors, their weights and the offset."""

    mean: list[float]
    std: list[float]
    forest: Forest | None = None
    vectors: np.ndarray | None = None
    alphas: np.ndarray | None = None
    rho: float = 0.0
    gap: float | None = None  #: of a one-class model: its duality gap as a share of the objective
    divisor: float = 1.0  #: of one-class decisions

    @property
    def is_one_class(self) -> bool:
        return self.forest is None

    def save(self, spark: SparkSession, path: str) -> None:
        """Parameters as a one-row table beside the forest, if there is one."""
        vectors = None if self.vectors is None else self.vectors.tolist()
        alphas = None if self.alphas is None else self.alphas.tolist()
        spark.createDataFrame([(self.mean, self.std, self.rho, vectors, alphas, self.gap, self.divisor)], "mean array<double>, std array<double>, rho double, vectors array<array<double>>, alphas array<double>, gap double, divisor double").write.mode("overwrite").parquet(f"{path}/params")
        if self.forest is not None:
            self.forest.save(f"{path}/forest")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Scorer:
        p = spark.read.parquet(f"{path}/params").first()
        one_class = p.vectors is not None
        return Scorer(list(p.mean), list(p["std"]), None if one_class else Forest.load(spark, f"{path}/forest"), np.array(p.vectors) if one_class else None, np.array(p.alphas) if one_class else None, p.rho, p.gap, p.divisor)


def _kernel_sum(x: np.ndarray, vectors: np.ndarray, weights: np.ndarray, gamma: float) -> np.ndarray:
    """Sum of weighted RBF kernels to the vectors, in slices of bounded size."""
    out = np.empty(len(x))
    step = max(1, 4_000_000 // max(1, len(vectors)))
    for i in range(0, len(x), step):
        part = x[i : i + step]
        far = (part**2).sum(1)[:, None] + (vectors**2).sum(1)[None] - 2 * part @ vectors.T
        out[i : i + step] = np.exp(-gamma * np.maximum(far, 0)) @ weights
    return out


def _rows(column: pa.ListArray) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) if n else np.empty((0, 1))


def _with_kernel(rows: DataFrame, name: str, vectors: np.ndarray, weights: np.ndarray, gamma: float) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((vectors, weights))
    at = rows.columns.index("features")

    def run(batches):
        v, w = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_kernel_sum(_rows(batch.column(at)), v, w, gamma))], names=[*batch.schema.names, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, `{name}` double")


class OneClass(NamedTuple):
    """Support vectors of a one-class model with their weights, its offset, and what is left of its duality gap, as a share of the objective."""

    vectors: np.ndarray
    alphas: np.ndarray
    rho: float
    gap: float
    total: int  #: what the weights sum to
    rounds: int


def pairwise_steps(kernel: np.ndarray, gradient: np.ndarray, alpha: np.ndarray, tolerance: float, most: int = 1_000_000) -> np.ndarray:
    """alpha after steps that move weight from one row to another until no pair's gradients differ by more than `tolerance`.

    Weights stay between 0 and 1 and keep their sum. A step takes the row of least gradient that can gain and,
    of those that can lose, the one that lowers the objective most; its length is exact.
    """
    alpha, g, own = alpha.copy(), gradient.copy(), np.diag(kernel).copy()
    for _ in range(most):
        to = int(np.argmin(np.where(alpha < 1, g, np.inf)))
        ahead = np.where(alpha > 0, g - g[to], -np.inf)
        if alpha[to] >= 1 or ahead.max() <= tolerance:
            break
        curve = np.maximum(own[to] + own - 2 * kernel[to], 1e-12)
        back = int(np.argmax(np.where(ahead > 0, ahead**2 / curve, -np.inf)))
        step = min(ahead[back] / curve[back], 1 - alpha[to], alpha[back])
        alpha[to], alpha[back] = min(1.0, alpha[to] + step), max(0.0, alpha[back] - step)
        g += step * (kernel[to] - kernel[back])
    return alpha


def _gap(state: DataFrame, total: int) -> float:
    """The duality gap as a share of the objective: what the corner of least gradient would gain."""
    now = state.agg(F.sum(F.col("alpha") * F.col("g"))).first()[0]
    least = state.orderBy("g", "id").limit(total).agg(F.sum("g")).first()[0]
    return max(0.0, now - least) / (now / 2) if now else 0.0


def fit_one_class(rows: DataFrame, nu: float = 0.1, rounds: int = 100, tolerance: float = 1e-3, max_vectors: int = 10_000, working: int = 2048) -> OneClass:
    """A one-class SVM (RBF, gamma = 1 / width), from rows with standardised features.

    The dual, weights between 0 and 1 that sum to nu * n, is solved by pairwise Frank-Wolfe steps in blocks. A round takes
    the `working` rows whose gradients differ most: half of least gradient that can gain weight, half of greatest
    that can lose it. Steps among them are made on their own kernel matrix; one kernel pass brings their
    effect on every row. Weights and gradients live in a table. Rounds end when the duality gap is `tolerance` of
    the objective or less; a warning tells if `rounds` end before. `max_vectors` bounds the rows that a model is fitted
    on, and so its support vectors: beyond it these are the rows of least hash of their features. Rows are told
    apart by that hash and their number among equal ones, so the model does not hang on how they are dealt out.
    """
    hashed = rows.select(F.col("features").cast("array<double>").alias("features")).withColumn("h", F.xxhash64("features"))
    equal = hashed.groupBy("h").agg(F.any_value("features").alias("features"), F.count("*").alias("k")).select("h", "features", F.explode(F.sequence(F.lit(1), F.least("k", F.lit(max_vectors)))).alias("i"))
    base = equal.select(F.xxhash64("h", "i").alias("id"), "h", "i", "features")
    base = saved(base.orderBy("h", "i").limit(max_vectors).select("id", "features"), "rows")
    every = np.array([r.features for r in base.select("features").collect()])
    n, width = every.shape
    gamma, total = 1 / width, max(1, int(round(nu * n)))
    state = saved(_with_kernel(base.withColumn("alpha", F.lit(total / n)), "g", every, np.full(n, total / n), gamma), "dual")
    gap, done = _gap(state, total), 0
    while gap > tolerance and done < rounds:
        gain = state.where("alpha < 1").orderBy("g", "id").limit(working // 2)
        lose = state.where("alpha > 0").orderBy(F.desc("g"), "id").limit(working // 2)
        chosen = gain.unionByName(lose).dropDuplicates(["id"]).orderBy("id").collect()
        x, g, before = (np.array([r[c] for r in chosen]) for c in ("features", "g", "alpha"))
        kernel = np.stack([_kernel_sum(x, x[i : i + 1], np.ones(1), gamma) for i in range(len(x))])
        after = pairwise_steps(kernel, g, before, tolerance * abs(g).mean() / 10)
        moved = np.flatnonzero(after != before)
        if not len(moved):
            break
        new = state.sparkSession.createDataFrame([(chosen[i].id, float(after[i])) for i in moved.tolist()], "id long, new double")
        step = state.join(F.broadcast(new), "id", "left").withColumn("alpha", F.coalesce("new", "alpha")).drop("new")
        pulled = _with_kernel(step, "_d", x[moved], (after - before)[moved], gamma)
        state = saved(pulled.select("id", "features", "alpha", (F.col("g") + F.col("_d")).alias("g")), "dual")
        gap, done = _gap(state, total), done + 1
    if gap > tolerance:
        warnings.warn(f"the one-class fit ended after {done} rounds with a gap of {gap:.2g} of the objective", stacklevel=2)
    free = state.where("alpha > 1e-6 and alpha < 1 - 1e-6").agg(F.avg("g")).first()[0]
    if free is None:  # any offset between the rows at either bound
        ends = state.agg(F.max(F.when(F.col("alpha") > 0.5, F.col("g"))).alias("a"), F.min(F.when(F.col("alpha") < 0.5, F.col("g"))).alias("b")).first()
        free = np.mean([x for x in ends if x is not None])
    support = state.where("alpha > 1e-9").select("features", "alpha").collect()
    return OneClass(np.array([r.features for r in support]), np.array([r.alpha for r in support]), float(free), gap, total, done)


def train_scorer(good: DataFrame, bad: DataFrame | None, trees: int = 100, depth: int = 20, seed: int = 42, nu: float = 0.1, rounds: int = 100, scale: str = "libsvm") -> Scorer:
    """A scorer from rows with features: two classes if there are ten bad rows or more, else one class. The scaler is fitted on good rows only.

    One-class decisions are sums over weights that add up to nu * n (scale libsvm), so that scores of large sets are
    near 0 or 1, or are divided by that sum (normalised).
    """
    if scale not in ("libsvm", "normalised"):
        raise ValueError(f"no scale {scale}")
    m = fit_scaler(good).first()
    scaler = good.sparkSession.createDataFrame([(m["mean"], m["std"])], "mean array<double>, std array<double>")
    if bad is not None and bad.limit(10).count() >= 10:
        rows = scaled(label_rows(good.select("features"), bad.select("features")), scaler)
        forest = fit_forest(rows, trees, depth, seed)
        return Scorer(list(m["mean"]), list(m["std"]), forest)
    fit = fit_one_class(scaled(good.where("features is not null").select("features"), scaler), nu, rounds)
    return Scorer(list(m["mean"]), list(m["std"]), None, fit.vectors, fit.alphas, fit.rho, fit.gap, float(fit.total) if scale == "normalised" else 1.0)


def score(rows: DataFrame, scorer: Scorer | None) -> DataFrame:
    """rows with score from 0 to 1: the forest's share for good, or the sigmoid of the one-class decision."""
    if scorer is None:
        raise ValueError("the scorer is not trained")
    fixed = rows.sparkSession.createDataFrame([(scorer.mean, scorer.std)], "mean array<double>, std array<double>")
    ready = scaled(rows, fixed)
    if scorer.forest is not None:
        numbered = saved(ready.drop("score").withColumn("_id", F.monotonically_increasing_id()), "numbered")
        found = forest_scores(numbered.select(F.col("_id").alias("id"), "features"), scorer.forest).withColumnRenamed("id", "_id")
        out = numbered.join(found, "_id", "left")
    else:
        out = _with_kernel(ready, "_k", scorer.vectors, scorer.alphas, 1 / len(scorer.mean)).withColumn("score", sigmoid((F.col("_k") - scorer.rho) / scorer.divisor))
    return out.select(*[c for c in rows.columns if c != "features"], "score")


def validation_stats(scored: DataFrame) -> DataFrame:
    """One row: mean and population deviation of the scores of label 1 and 0, their distance, and the verdict on it."""
    by = lambda k, f, c: f(F.when(F.col("label") == k, F.col("score"))).alias(c)
    s = scored.agg(by(1, F.avg, "good_mean"), by(1, F.stddev_pop, "good_std"), by(0, F.avg, "bad_mean"), by(0, F.stddev_pop, "bad_std")).withColumn("separation", F.col("good_mean") - F.col("bad_mean"))
    return s.withColumn("verdict", F.when(F.col("separation") > 0.3, "good").when(F.col("separation") > 0.1, "moderate").otherwise("low"))


def new_features(extracted: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows to append to the feature cache: a run that broke off starts where it ended."""
    return extracted.dropDuplicates(["path"]).join(cache.select("path"), "path", "left_anti").select("path", "features")


