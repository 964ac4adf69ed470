"""Soft-membership mixing: document rates whose expected domain token totals match target weights.

A classifier trained on a labelled table gives each document a posterior over domains. Nonnegative rates r, one
a document, minimise

    1/2 sum_k (a_k - target_k)^2 / s_k  +  ridge/2 sum_i w_i (r_i - 1)^2,   a_k = sum_i w_i r_i p_ik,

where w_i is the document's share of all tokens, p_i its posterior and s_k the domain's share at rate 1.
Projected gradient with momentum in the token-weighted norm moves r_i by p_i . (a - target) / s + ridge (r_i - 1),
so a rate follows from the posterior and the path of a alone: a pass sends one vector of domain totals to the
driver, no rate is stored between passes, and any document can be rated where it lies.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curalume.llm.bytes_np import EXACT, row_groups, texts, words
from curalume.llm.linear import Model, probabilities, raw_scores, trained
from curalume.plans.tables import saved


class Mix(NamedTuple):
    """A fitted mix: the classifier, the gradient pull of each pass on a document of each domain, and how well it fits."""

    model: Model | None
    pulls: np.ndarray  #: (passes, domains)
    ridge: float
    reached: tuple[float, ...] = ()  #: the domains' totals, as shares of all tokens at rate 1
    gradient: float = 0.0  #: root mean square of the last projected gradient, over tokens

    @property
    def domains(self) -> list[str]:
        return list(self.model.classes) if self.model else ["all"]

    def path(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rates after all passes, where the next gradient is taken, and the last projected gradient."""
        r = y = np.ones(len(p))
        last = np.zeros(len(p))
        step = 1 / (1 + self.ridge)
        for t, pull in enumerate(self.pulls, 1):
            before, r = r, np.maximum(0.0, y - step * (p @ pull + self.ridge * (y - 1)))
            last = (y - r) / step
            y = r + (t - 1) / (t + 2) * (r - before)
        return r, y, last

    def rates(self, p: np.ndarray) -> np.ndarray:
        """Rates after all passes."""
        return self.path(p)[0]


def _posteriors(column: pa.Array, model: Model | None) -> tuple[np.ndarray, np.ndarray]:
    """Tokens (words split at ASCII white space) and posteriors of each text."""
    data, offsets = texts(column)
    tokens, p = [np.empty(0, np.int64)], [np.empty((0, len(model.classes) if model else 1))]
    for lo, hi in row_groups(offsets):
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        w = words(part, at, values=EXACT)
        tokens.append(np.diff(w.first))
        p.append(probabilities(raw_scores(part, at, model, w.hash, w.first), model) if model else np.ones((hi - lo, 1)))
    return np.concatenate(tokens), np.concatenate(p)


def _lists(p: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel(), pa.float64()))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def memberships(docs: DataFrame, model: Model | None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, posterior) per row of `docs`; a null or empty text has no tokens and the posterior of no evidence."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            tokens, p = _posteriors(batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), _lists(p)], names=["doc_id", "n_tokens", "posterior"])

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, posterior array<double>")


def fitted(members: DataFrame, model: Model | None, targets: dict[str, float], ridge: float = 1e-3, passes: int = 60, tolerance: float = 1e-3) -> Mix:
    """Fit rates to `members` (memberships, saved) until the projected gradient is `tolerance` or less, as a root mean square over tokens.

    Targets are made to sum to 1; a domain without one has target 0. A domain that no document can belong to is left out.
    """
    mix = Mix(model, np.empty((0, len(model.classes) if model else 1)), ridge)
    k = len(mix.domains)
    want = np.array([targets.get(d, 0.0) for d in mix.domains]) if model else np.ones(1)
    want = want / want.sum() if want.sum() else np.full(k, 1 / k)
    names = [*(f"a{j}" for j in range(k)), *(f"r{j}" for j in range(k)), "g"]

    def totals(m: Mix) -> np.ndarray:
        """The domains' totals where the next gradient is taken and at the rates, and the last gradient's squares, by tokens."""

        def run(batches):
            out = np.zeros(2 * k + 1)
            for batch in batches:
                p, w = _matrix(batch.column(1), k), batch.column(0).to_numpy()
                r, y, g = m.path(p)
                out += np.r_[(w * y) @ p, (w * r) @ p, w @ g**2]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in out], names=names)

        row = members.select("n_tokens", "posterior").where("n_tokens > 0").mapInArrow(run, ", ".join(f"{x} double" for x in names)).agg(*(F.sum(x) for x in names)).first()
        return np.array([x or 0.0 for x in row])

    start = totals(mix)[:k]
    if not start.sum():
        return mix
    total, share = start.sum(), start / start.sum()
    live = share > 1e-12
    a = share
    for _ in range(passes):
        pull = np.where(live, (a - want) / np.where(live, share, 1), 0.0)
        mix = mix._replace(pulls=np.vstack((mix.pulls, pull)))
        found = totals(mix) / total
        a, mix = found[:k], mix._replace(reached=tuple(found[k : 2 * k].tolist()), gradient=float(found[-1] ** 0.5))
        if mix.gradient <= tolerance:
            break
    return mix


def mixed(members: DataFrame, mix: Mix) -> DataFrame:
    """memberships with their rate: (doc_id, n_tokens, posterior, rate)."""
    shared = members.sparkSession.sparkContext.broadcast(mix)

    def run(batches):
        m = shared.value
        for batch in batches:
            rate = m.rates(_matrix(batch.column(2), len(m.domains)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate, pa.float64())], names=["doc_id", "n_tokens", "posterior", "rate"])

    return members.select("doc_id", "n_tokens", "posterior").mapInArrow(run, "doc_id long, n_tokens long, posterior array<double>, rate double")


def with_rates(docs: DataFrame, mix: Mix, text: str = "text", rate: str = "rate") -> DataFrame:
    """`docs` with its rate, made from each text where it lies, in place of a column of that name if there is one."""
    docs = docs.drop(rate)
    shared = docs.sparkSession.sparkContext.broadcast(mix)
    at = docs.columns.index(text)

    def run(batches):
        m = shared.value
        for batch in batches:
            _, p = _posteriors(batch.column(at), m.model)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(m.rates(p), pa.float64())], names=[*batch.schema.names, rate])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(rate, T.DoubleType())]))


def mix_to_targets(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id: str = "doc_id", text: str = "text", max_rows: int = 8000) -> tuple[DataFrame, Mix]:
    """Rates of all documents for domains learnt from labelled(doc_id, domain), and the fitted mix.

    Rows without text or label are not learnt from; at most `max_rows` labelled rows are (see linear.trained).
    With fewer than two domains among them every rate is 1. Null and repeated ids keep their rows: a rate
    depends on the text only. An empty table gives no rows.
    """
    named = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    model = trained(named, labelled.select("doc_id", F.col("domain").alias("label")), max_rows)
    members = saved(memberships(named, model), "members")
    mix = fitted(members, model, targets)
    return mixed(members, mix), mix
