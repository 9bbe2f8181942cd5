"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded to a vector; gated attention
    a_k = softmax_k( w . (tanh(V h_k) * sigmoid(U h_k)) )
weighs the passages; the weighted sum is the document's representation, and a
logistic unit on it gives the score. Only documents have labels: the attention is
learned from them.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, arrow_map, held, list_array, short_batches, texts_of
from .training import labelled

#: Words of a passage, buckets for hashed words, and labelled documents that the network is fitted on, at most.
PASSAGE, BUCKETS, MAX_DOCS = 80, 64, 8000
STYLE = 16
WIDTH = BUCKETS + STYLE

_WORD = re.compile(r"[^ \t-\r]+")


def _word_facts(word: str) -> tuple[int, int, int, int, int, int, int]:
    """bucket, length, letters, capitals, digits, marks, hash of a word."""
    letters = sum(c.isalpha() for c in word)
    capitals = sum(c.isupper() for c in word)
    digits = sum(c.isdigit() for c in word)
    symbols = sum(c in "#*$%&|<>{}[]\\^~=@_" for c in word)
    h = xxhash.xxh32_intdigest(word.lower().encode("utf-8", "surrogatepass"))
    return h % BUCKETS, len(word), letters, capitals, digits, symbols, h


def facts_memo() -> Memo:
    return Memo(_word_facts)


def encode(text: str | None, memo: Memo) -> np.ndarray:
    """A row of features for each passage of the whole text; one empty passage for a text without words."""
    if not text or not (words := _WORD.findall(text)):
        return np.zeros((1, WIDTH), np.float32)
    facts = np.array(list(map(memo.__getitem__, words)), np.int64)
    n = len(words)
    starts = np.arange(0, n, PASSAGE)
    if len(starts) > 1 and n - starts[-1] < PASSAGE // 4:
        starts = starts[:-1]  # a short tail joins the passage before it
    sizes = np.diff(np.append(starts, n)).astype(np.float64)
    of = np.repeat(np.arange(len(starts)), sizes.astype(int))
    out = np.zeros((len(starts), WIDTH))
    np.add.at(out, (of, facts[:, 0]), 1.0)
    out[:, :BUCKETS] = np.sqrt(out[:, :BUCKETS] / sizes[:, None])
    sums = np.add.reduceat(facts[:, 1:6], starts, axis=0).astype(np.float64)
    chars = np.maximum(1, sums[:, 0])
    s = out[:, BUCKETS:]
    s[:, 0] = sums[:, 0] / sizes / 10
    s[:, 1:5] = sums[:, 1:5] / chars[:, None]
    s[:, 5] = (chars - sums[:, 1] - sums[:, 3]) / chars
    both = of * np.int64(1 << 32) + facts[:, 6]
    s[:, 6] = np.bincount(np.unique(both) >> 32, minlength=len(starts)) / sizes  # distinct words
    pairs = both[:-1] * 3 + facts[1:, 6]
    same = of[:-1] == of[1:]
    s[:, 7] = np.bincount(of[:-1][same & (facts[:-1, 6] == facts[1:, 6])], minlength=len(starts)) / sizes  # word repeated at once
    seen, where = np.unique(pairs[same] if same.any() else pairs[:0], return_index=True)
    s[:, 8] = np.bincount(of[:-1][same][where], minlength=len(starts)) / sizes if len(seen) else 0  # distinct word pairs
    long_ = facts[:, 1] > 14
    s[:, 9] = np.bincount(of[long_], minlength=len(starts)) / sizes
    upper = (facts[:, 3] == facts[:, 2]) & (facts[:, 2] > 1)
    s[:, 10] = np.bincount(of[upper], minlength=len(starts)) / sizes
    bare = facts[:, 2] == 0
    s[:, 11] = np.bincount(of[bare], minlength=len(starts)) / sizes
    whole = np.unique(facts[:, 6])
    s[:, 12] = len(whole) / n  # of the whole document
    s[:, 13] = np.log1p(n) / 10
    lines = [x for x in text.split("\n") if x.strip()]
    s[:, 14] = 1 - len(set(lines)) / max(1, len(lines))
    s[:, 15] = np.log1p(len(lines)) / 10
    return out.astype(np.float32)


class Network:
    """Encoder, gated attention and score, with gradients worked out by hand."""

    SHAPES = {"A": (WIDTH, 24), "a": (24,), "V": (24, 12), "U": (24, 12), "w": (12,), "c": (24,), "b": (1,)}

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.p = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 or k in "wc" else np.zeros(s) for k, s in self.SHAPES.items()}
        self.mean, self.std = np.zeros(WIDTH), np.ones(WIDTH)

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict:
        """x: passages of all documents; starts: where each document begins."""
        p, bag = self.p, np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        x = (x - self.mean) / self.std
        h = np.tanh(x @ p["A"] + p["a"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        alpha = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(alpha[:, None] * h, starts, axis=0)
        logit = z @ p["c"] + p["b"][0]
        return {"x": x, "bag": bag, "h": h, "t": t, "g": g, "alpha": alpha, "z": z, "score": 1 / (1 + np.exp(-np.clip(logit, -30, 30)))}

    def gradients(self, f: dict, y: np.ndarray) -> dict:
        p, bag = self.p, f["bag"]
        d = (f["score"] - y) / len(y)
        out = {"c": f["z"].T @ d, "b": np.array([d.sum()])}
        dz = d[:, None] * p["c"]
        dh = f["alpha"][:, None] * dz[bag]
        da = (f["h"] * dz[bag]).sum(1)
        mean = np.bincount(bag, f["alpha"] * da, len(y))
        de = f["alpha"] * (da - mean[bag])
        tg = f["t"] * f["g"]
        out["w"] = tg.T @ de
        dtg = de[:, None] * p["w"]
        dv, du = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
        out["V"], out["U"] = f["h"].T @ dv, f["h"].T @ du
        dh += dv @ p["V"].T + du @ p["U"].T
        dh *= 1 - f["h"] ** 2
        out["A"], out["a"] = f["x"].T @ dh, dh.sum(0)
        return out

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = 14, batch: int = 64, rate: float = 4e-3, decay: float = 1e-4, seed: int = 5) -> Network:
        if not len(bags):
            return self
        every = np.concatenate(bags).astype(np.float64)
        self.mean, self.std = every.mean(0), every.std(0) + 0.02
        rng, m, v, n = np.random.default_rng(seed), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for i in range(0, len(order), batch):
                part = order[i : i + batch]
                own = [bags[j] for j in part]
                starts = np.cumsum([0] + [len(b) for b in own[:-1]])
                grads, n = self.gradients(self.forward(np.concatenate(own).astype(np.float64), starts), y[part]), n + 1
                for k, g in grads.items():
                    g = g + decay * self.p[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.999**n)) + 1e-8)
        return self


def train(docs: DataFrame, labels: DataFrame, in_training: Column, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_DOCS) -> Network:
    """Fits on about max_docs labelled rows at most (in_training: a condition on the id), chosen by a hash of the id.
    The driver receives the passages of those rows only. Without labelled rows the network stays as it began."""
    short_batches(docs.sparkSession)
    rows = labelled(docs, labels, label, in_training, max_docs, id_col, text_col).select("text", F.col("y").cast("int").alias("y"))

    def start():
        memo = held(facts_memo)

        def work(batch: pa.RecordBatch) -> dict:
            return {"x": [encode(t, memo).astype(np.float16).tobytes() for t in texts_of(batch)], "y": batch.column(1)}

        return work

    got = arrow_map(rows, "x binary, y int", start).toPandas()
    found = sorted(zip(got["x"], got["y"], strict=True), key=lambda v: (len(v[0]), bytes(v[0]), v[1]))
    return Network().fit([np.frombuffer(x, np.float16).reshape(-1, WIDTH).astype(np.float32) for x, _ in found], np.array([y for _, y in found], np.float64))


def score(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1, higher: likelier good) and attention (a weight for each passage) of each row of docs.

    Texts of any length are read whole. A null or empty text is one empty passage; repeated rows are scored each, and equally; ids may be null;
    an empty table gives no rows; other columns are left out, whatever their names.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def start():
        memo = held(facts_memo)

        def work(batch: pa.RecordBatch) -> dict:
            bags = [encode(t, memo) for t in texts_of(batch)]
            if not bags:
                return {"id": batch.column(0), "score": [], "attention": []}
            starts = np.cumsum([0] + [len(b) for b in bags[:-1]])
            f = network.forward(np.concatenate(bags).astype(np.float64), starts)
            # products of other sizes end in other last digits: equal texts get equal scores whatever batch they are in
            return {"id": batch.column(0), "score": f["score"].round(9), "attention": list_array(np.split(f["alpha"].astype(np.float32), starts[1:]), pa.float32())}

        return work

    return arrow_map(rows, f"id {rows.schema['id'].dataType.simpleString()}, score double, attention array<float>", start).withColumnRenamed("id", id_col)
