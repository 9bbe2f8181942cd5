"""Models behind small interfaces, with deterministic stand-ins that work offline."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class LanguageModel(Protocol):
    def generate(self, prompt: str) -> str: ...


class Embedder(Protocol):
    dim: int
    model_name: str

    def encode_batch(self, texts: list[str]) -> list[list[float]]: ...


class Tagger(Protocol):
    """Named entities, or parts of speech, of one sentence: (text, label) pairs."""

    def tag(self, sentence: str) -> list[tuple[str, str]]: ...


class ModelError(RuntimeError):
    """A model's reply that can't be used."""


def generate_json(model: LanguageModel, prompt: str) -> str:
    """The model's reply to a prompt that asks for JSON, without a code fence; a reply that is none is an error."""
    raw = model.generate(prompt).strip()
    if raw.startswith("```"):
        raw = raw.strip("`").removeprefix("json").strip()
    try:
        json.loads(raw)
    except ValueError as e:
        raise ModelError(f"not JSON: {raw[:80]}") from e
    return raw


_makers: dict[str, Callable[..., object]] = {}


def register(name: str, make: Callable[..., object]) -> None:
    """Names a kind of model or embedder, so that a setting can choose it."""
    _makers[name] = make


def create(name: str, **settings) -> object:
    if name not in _makers:
        raise ValueError(f"no provider {name!r}; there are {', '.join(sorted(_makers))}")
    return _makers[name](**settings)


def tag(rows: DataFrame, sentence: str, tagger: Tagger, name: str = "tagged") -> DataFrame:
    """rows with an array of struct(text, label) for each sentence; empty for null."""

    @F.pandas_udf("array<struct<text:string,label:string>>")
    def tags(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in frames:
            yield pd.Series([[] if pd.isna(t) else [{"text": a, "label": b} for a, b in tagger.tag(t)] for t in s])

    return rows.withColumn(name, tags(sentence))


class HashEmbedder:
    """Unit vectors from hashed words: equal texts get equal vectors, texts with common words similar ones."""

    model_name = "hash"

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode_batch(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.dim)
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.dim] += 1.0 if h >> 63 else -1.0
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out


class Echo:
    """A model that repeats its prompt."""

    def generate(self, prompt: str) -> str:
        return prompt


register("hash", HashEmbedder)
register("echo", Echo)


def embed(rows: DataFrame, text: str, embedder: Embedder, name: str = "vector") -> DataFrame:
    """rows with a vector of each text, a batch of texts at a time; null for null."""

    @F.pandas_udf("array<double>")
    def encode(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in frames:
            found = iter(embedder.encode_batch(s.dropna().tolist()))
            yield pd.Series([None if pd.isna(t) else next(found) for t in s])

    return rows.withColumn(name, encode(text))


def generate(rows: DataFrame, prompt: str, model: LanguageModel, name: str = "reply") -> DataFrame:
    """rows with the model's reply to each prompt, null for a null or blank prompt and for a call that fails; `name`_error tells how it failed."""

    def call(p: str | None) -> tuple[str | None, str | None]:
        if p is None or pd.isna(p) or not p.strip():
            return None, None
        try:
            return model.generate(p), None
        except Exception as e:  # whatever a model's client raises; it is reported
            return None, f"{type(e).__name__}: {e}"

    @F.pandas_udf("reply string, error string")
    def reply(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in frames:
            yield pd.DataFrame([call(p) for p in s], columns=["reply", "error"])

    answered = rows.withColumn(name, reply(prompt))
    return answered.select(*[c for c in rows.columns if c != name], F.col(f"{name}.reply").alias(name), F.col(f"{name}.error").alias(f"{name}_error"))
