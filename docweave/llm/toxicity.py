"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives, any other texts are unlabelled and
hold toxic ones at an unknown place. A linear numpy classifier minimises
    prior * R(positives, +1) + max(0, R(unlabelled, -1) - prior * R(positives, -1)),
the risk corrected for the class prior; where the bracket falls below zero the gradient is
turned round, so that it can't be driven negative by over-fitting.

A pilot is fitted on bounded samples of labelled rows: positives, and rows with any label, which isn't looked at. Then all
unlabelled rows of the corpus have their say: the risk's gradient and a bound of its curvature are summed in the tasks over every
row, and each weight takes one step by them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, Scratch, arrow_map, held, short_batches, texts_of
from .training import bounded

#: Hashed features; labelled rows that the pilot is fitted on, at most: positives, and rows of any label.
BUCKETS, MAX_POSITIVE, MAX_MIXED = 1 << 18, 4000, 8000
#: Tasks that sum up the gradients of all others.
SUMS = 64

#: Log odds that the bias is raised by after fitting, at most.
MOST_LIFT = 1.0

_WORD = re.compile(r"\w+")


def _word_features(word: str) -> tuple[int, ...]:
    """The word, and its beginning, which holds against endings."""
    keys = [word] + [f"{n}^{word[:n]}" for n in (4, 5) if len(word) >= n]
    return tuple(xxhash.xxh32_intdigest(k.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for k in keys)


def feature_memo() -> Memo:
    return Memo(_word_features)


def features(text: str | None, memo: Memo) -> np.ndarray:
    """The distinct hashed features of a whole text."""
    found: set[int] = set()
    for f in map(memo.__getitem__, set(_WORD.findall(text.lower())) if text else ()):
        found.update(f)
    return np.fromiter(found, np.int32, len(found))


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, found: np.ndarray) -> float:
        z = self.bias + float(self.weights[found].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


class _Rows:
    """Sparse rows of ones."""

    def __init__(self, rows: list[np.ndarray]):
        self.flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.ends = np.cumsum(self.sizes)

    def _with(self, flat: np.ndarray, sizes: np.ndarray) -> _Rows:
        out = _Rows([])
        out.flat, out.sizes, out.ends = flat, sizes, np.cumsum(sizes)
        return out

    def only(self, chosen: np.ndarray) -> _Rows:
        """These features alone, numbered from 0."""
        number = np.full(BUCKETS, -1, np.int32)
        number[chosen] = np.arange(len(chosen))
        now = number[self.flat]
        there = now >= 0
        before = np.concatenate([[0], np.cumsum(there, dtype=np.int64)])
        return self._with(now[there], before[self.ends] - before[self.ends - self.sizes])

    def named(self, chosen: np.ndarray) -> _Rows:
        """Numbers turned back to features."""
        return self._with(chosen[self.flat], self.sizes)

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features and row numbers of the chosen rows."""
        n = self.sizes[which]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.ends[which] - n, n)
        return self.flat[at], np.repeat(np.arange(len(which)), n)


def _descend(p: _Rows, u: _Rows, size: int, prior: float, epochs: int, sparsity: float, batch: int, rate: float, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """Adagrad on the non-negative risk with the logistic loss; after each step weights shrink towards zero by `sparsity` times the prior.
    Steps that turn the gradient round make single ones restless: the mean over the second half is the result."""
    w, b = np.zeros(size), float(np.log(prior / (1 - prior)))
    gw, gb = np.full(size, 1e-2), 1e-2
    n_p, n_u = len(p.sizes), len(u.sizes)
    mean_w, mean_b, n = np.zeros(size), 0.0, 0
    for epoch in range(epochs):
        order_u, order_p = rng.permutation(n_u), rng.permutation(n_p)
        for s in range(max(n_p, n_u) // batch + 1):
            iu = order_u[np.arange(s * batch, (s + 1) * batch) % n_u]
            ip = order_p[np.arange(s * batch, (s + 1) * batch) % n_p]
            fp, rp = p.take(ip)
            fu, ru = u.take(iu)
            zp, zu = b + np.bincount(rp, w[fp], len(ip)), b + np.bincount(ru, w[fu], len(iu))
            sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            # derivatives of the logistic loss: s - 1 for label +1, s for label -1
            if negative >= 0:
                dp, du = prior * (sp - 1) / len(ip) - prior * sp / len(ip), su / len(iu)
            else:
                dp, du = prior * sp / len(ip), -su / len(iu)
            g = np.bincount(fp, dp[rp], size) + np.bincount(fu, du[ru], size)
            gw += g * g
            pace = rate / np.sqrt(gw)
            w -= pace * g
            w = np.sign(w) * np.maximum(0, np.abs(w) - pace * sparsity * prior)
            db = dp.sum() + du.sum()
            gb += db * db
            b -= rate * db / np.sqrt(gb)
            if 2 * epoch >= epochs:
                n += 1
                mean_w += (w - mean_w) / n
                mean_b += (b - mean_b) / n
    return mean_w, mean_b


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = 20, batch: int = 256, rate: float = 0.3, sparsity: float = 0.02, second: float = 0.25, seed: int = 7) -> Model:
    """Two descents: the first, with shrinkage, picks the features, so that those of less than about `sparsity` of the
    positives get no weight; the second shrinks them by `second` times that only. Without positives every text scores low."""
    weights, bias = np.zeros(BUCKETS, np.float32), -4.0
    if positive and unlabelled:
        rng, p, u = np.random.default_rng(seed), _Rows(positive), _Rows(unlabelled)
        chosen = np.flatnonzero(np.bincount(p.flat, minlength=BUCKETS) + np.bincount(u.flat, minlength=BUCKETS) >= 3).astype(np.int32)
        for shrink in (sparsity, sparsity * second):
            p, u = p.only(chosen), u.only(chosen)
            w, bias = _descend(p, u, len(chosen), prior, epochs, shrink, batch, rate, rng)
            weights = np.zeros(BUCKETS, np.float32)
            weights[chosen] = w
            p, u = p.named(chosen), u.named(chosen)
            chosen = np.flatnonzero(np.abs(weights) > 1e-3).astype(np.int32)
        # shrinkage holds scores down: the bias rises until nearly the prior's share of unlabelled rows scores one half
        scores = bias + np.bincount(np.repeat(np.arange(len(u.sizes)), u.sizes), weights[u.flat], len(u.sizes))
        bias += min(MOST_LIFT, max(0.0, -float(np.quantile(scores, 1 - 0.95 * prior))))
    return Model(weights, bias)


def train(docs: DataFrame, labels: DataFrame, in_training: Column, label: str = "toxic", prior: float | None = None, id_col: str = "doc_id",
          text_col: str = "text", max_positive: int = MAX_POSITIVE, max_mixed: int = MAX_MIXED) -> Model:
    """Fits a pilot on about max_positive confirmed toxic and max_mixed labelled rows of docs at most, chosen by a hash of the id, and
    improves it by all rows.

    in_training: a condition on the id. Labels other than 1 are used for the class prior alone (the share
    of 1 among them, unless prior is given): to both fits every row but the positives is unlabelled. The driver receives the sampled
    rows' features and SUMS sums, never more. Rows without an id are unlabelled; a null text has no words. Without positives
    or without rows every text scores low.
    """
    short_batches(docs.sparkSession)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).where(in_training).groupBy(id_col).agg(F.max(label).alias("y"))
    n = known.groupBy("y").count().collect()
    total, ones = sum(r["count"] for r in n), sum(r["count"] for r in n if r["y"] == 1)
    if not ones:
        return fit([], [], 0.5)
    prior = prior or min(0.5, max(0.001, ones / total))
    key = F.col(id_col)
    chosen = bounded(known.where("y = 1"), key, max_positive).select(key.alias("id"), F.lit(1).alias("y"), F.lit(0).alias("mixed"))
    chosen = chosen.union(bounded(known, key, max_mixed, 1).select(key, F.lit(0), F.lit(1))).groupBy("id").agg(F.max("y").alias("y"), F.max("mixed").alias("mixed"))
    rows = docs.select(key.alias("id"), F.col(text_col).cast("string").alias("text"))
    sample = rows.join(F.broadcast(chosen), "id").select("text", "y", "mixed")

    def start():
        memo = held(feature_memo)

        def work(batch: pa.RecordBatch) -> dict:
            return {"x": [features(t, memo).tobytes() for t in texts_of(batch)], "y": batch.column(1), "mixed": batch.column(2)}

        return work

    got = arrow_map(sample, "x binary, y int, mixed int", start).toPandas()
    x = [np.frombuffer(v, np.int32) for v in got["x"]]
    order = lambda rows: sorted(rows, key=lambda v: (len(v), v.tobytes()))  # noqa: E731  whatever order the tasks ended in
    positive, mixed = (order([v for v, y in zip(x, got[k], strict=True) if y]) for k in ("y", "mixed"))
    del got, x
    pilot = fit(positive, mixed, prior)
    return improved(pilot, positive, docs.where(F.coalesce(in_training, F.lit(True))), prior, text_col)


def risk_sums(docs: DataFrame, model: Model, text_col: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over all rows of docs, for the bias and then each feature with a weight: the sum of scores s, and the sum of s * (1 - s) times the number of the row's
    active features. The third array holds the number of rows and the sum of the loss of taking them for negative."""
    support = np.flatnonzero(model.weights).astype(np.int32)
    weights, bias = model.weights[support], model.bias

    def local(batches):
        memo, number = held(feature_memo), np.full(BUCKETS, -1, np.int32)
        number[support] = np.arange(1, len(support) + 1)
        own = np.concatenate([[bias], weights])
        s1, s2, facts = np.zeros(len(own)), np.zeros(len(own)), np.zeros(2)
        for batch in batches:
            found = [number[features(t, memo)] for t in texts_of(batch)]
            found = [np.concatenate([[0], f[f >= 0]]) for f in found]  # the bias is always active
            n = np.array([len(f) for f in found])
            flat, row = np.concatenate(found), np.repeat(np.arange(len(found)), n)
            z = np.clip(np.bincount(row, own[flat], len(found)), -30, 30)
            s = 1 / (1 + np.exp(-z))
            s1 += np.bincount(flat, s[row], len(own))
            s2 += np.bincount(flat, (s * (1 - s) * n)[row], len(own))
            facts += len(found), np.logaddexp(0, z).sum()
        yield _packed(TaskContext.get().partitionId(), np.concatenate([s1, s2, facts]))

    def summed(batches):
        total, part = None, 0
        for batch in batches:
            for part, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(x, np.float64)
                total = x if total is None else total + x
        if total is not None:
            yield _packed(part, total)

    sums = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(local, "part int, sums binary")
    scratch = Scratch(docs.sparkSession, "risk")
    sums = scratch.keep(sums, "sums").repartition(SUMS, F.col("part") % SUMS).sortWithinPartitions("part").mapInArrow(summed, "part int, sums binary")
    rows = sorted(sums.collect(), key=lambda r: r["part"])
    size = 1 + len(support)
    total = np.sum([np.frombuffer(r["sums"], np.float64) for r in rows], axis=0) if rows else np.zeros(2 * size + 2)
    return total[:size], total[size : 2 * size], total[2 * size :]


def _packed(part: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([values.tobytes()], pa.binary())], ["part", "sums"])


def improved(model: Model, positive: list[np.ndarray], docs: DataFrame, prior: float, text_col: str = "text") -> Model:
    """One step on the risk with all rows of docs as the unlabelled ones.

    A row's curvature s * (1 - s), spread over its active features, is a bound: divided by it, all weights can move at once without
    passing the minimum. Where the bracket of the risk is below zero there, the model stays as it is.
    """
    support = np.flatnonzero(model.weights)
    if not len(positive) or not len(support):
        return model
    s1, s2, (n, loss) = risk_sums(docs, model, text_col)
    rows = _Rows(positive)
    z = np.clip(model.bias + np.bincount(np.repeat(np.arange(len(rows.sizes)), rows.sizes), model.weights[rows.flat], len(rows.sizes)), -30, 30)
    if not n or loss / n < prior * np.logaddexp(0, z).mean():
        return model
    # the gradient is the mean of s over the rows less the prior's share of the positives, for each active feature
    often = np.concatenate([[1.0], np.bincount(rows.flat, minlength=BUCKETS)[support] / len(positive)])
    step = (s1 / n - prior * often) / (s2 / n + 1e-6)
    weights = model.weights.copy()
    weights[support] -= np.clip(step[1:], -1, 1)
    return Model(weights, model.bias - float(np.clip(step[0], -1, 1)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1, higher: likelier toxic) of each row of docs, from its whole text alone.

    A null or empty text gets the score of a text without words; texts of any length are read whole; repeated rows are scored each, and equally;
    ids may be null; an empty table gives no rows; other columns are left out, whatever their names.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def start():
        memo = held(feature_memo)

        def work(batch: pa.RecordBatch) -> dict:
            return {"id": batch.column(0), "score": [model.score(features(t, memo)) for t in texts_of(batch)]}

        return work

    return arrow_map(rows, f"id {rows.schema['id'].dataType.simpleString()}, score double", start).withColumnRenamed("id", id_col)


def below(docs: DataFrame, model: Model, limit: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text scores below `limit`; nothing is joined or shuffled.

    Null and empty texts are judged as texts without words, repeated rows each; an empty table stays empty.
    """
    short_batches(docs.sparkSession)
    kept = docs.schema
    at = docs.columns.index(text_col)

    def run(batches):
        memo = held(feature_memo)
        for batch in batches:
            yield batch.filter(pa.array([model.score(features(t, memo)) < limit for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, kept)
