"""Token counts from prefix sums.

No pre-token of the word tokenizer reaches across white space, so a text's
tokens are those of its units, a unit being a run without
ASCII blanks or line ends. Each distinct unit is encoded by the library once in
a worker; the recurrence count(prefix + unit) = count(prefix) + count(unit), and within a unit the ends of its tokens,
give the exact count at every token's end, and so at every prefix of the text. Questions on budgets and
truncation are searches in that array and need no encoding.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, held, list_array, short_batches, texts_of

_SCHEMA = "id {id}, n_bytes long, n_tokens long, prefix_ends array<int>, budget_chars int"
#: Units that a worker remembers, and the characters of the longest of them.
KNOWN_UNITS, LONGEST = 200_000, 48


class UnitCounter:
    """Where the tokens of units end, by the library, kept for a bounded number of distinct short units."""

    def __init__(self, path: str, limit: int = KNOWN_UNITS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.limit = Tokenizer.from_file(path), {}, limit

    def ends(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many tokens each unit has, and the code-point offsets in their unit at which they end, of all units one after the other."""
        known, found = self.known, {}
        fresh = [u for u in set(units) if u not in known]
        for u, e in zip(fresh, self.tokenizer.encode_batch(fresh, add_special_tokens=False), strict=True):
            # a character in several tokens ends with the last of them
            found[u] = np.maximum.accumulate(np.fromiter((end for _, end in e.offsets), np.int32, len(e))).tobytes()
        get = lambda u: known.get(u) or found.get(u) or b""
        parts = [get(u) for u in units]
        for u in fresh:
            if len(u) <= LONGEST and len(known) < self.limit:
                known[u] = found[u]
        return np.fromiter(map(len, parts), np.int64, len(parts)) // 4, np.frombuffer(b"".join(parts), np.int32)


def fitting(ends: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix with at most `budget` tokens: it ends with a token whose last character has no later token."""
    if len(ends) <= budget:
        return int(ends[-1]) if len(ends) else 0
    k = int(np.searchsorted(ends, ends[budget], "left"))
    return int(ends[k - 1]) if k else 0


_GAPS = str.maketrans("\n\t\r", "   ")


def units_of(text: str) -> tuple[list[str], np.ndarray]:
    """Units between blanks, tabs and line ends, and the code-point offset at which each ends."""
    parts = text.translate(_GAPS).split(" ") if not text.isascii() or any(c in text for c in "\n\t\r") else text.split(" ")
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    full = lengths > 0
    return [p for p in parts if p], ends[full]


def prefix_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", budget: int = 2048) -> DataFrame:
    """One row for each row of docs: id, n_bytes, n_tokens, prefix_ends, budget_chars.

    prefix_ends[i] is the code-point offset at which token i of the whole text ends, so i + 1 is the exact token count up to there. budget_chars is
    the longest prefix with at most `budget` tokens. A null or empty text has no bytes, no tokens and an empty array; a text of any length, with
    blanks or without, is counted whole; repeated rows are counted each; ids may be null; an empty table gives no rows; other columns of docs
    are left out, whatever their names.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def start():
        counter = held(UnitCounter, tokenizer_path)

        def work(batch: pa.RecordBatch) -> dict:
            texts = [t or "" for t in texts_of(batch)]
            split = [units_of(t) for t in texts]
            n, flat = counter.ends([u for units, _ in split for u in units])
            begins = np.concatenate([e - np.fromiter(map(len, units), np.int64, len(units)) for units, e in split]) if split else np.zeros(0, np.int64)
            flat = (flat + np.repeat(begins, n)).astype(np.int32)
            sizes = np.array([len(units) for units, _ in split], np.int64)
            tokens = np.add.reduceat(np.append(n, 0), np.cumsum(sizes) - sizes) * (sizes > 0) if len(sizes) else sizes
            ends = np.split(flat, np.cumsum(tokens)[:-1]) if len(tokens) else []
            return {
                "id": batch.column(0),
                "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts],
                "n_tokens": tokens,
                "prefix_ends": list_array(ends, pa.int32()),
                "budget_chars": [fitting(e, budget) for e in ends],
            }

        return work

    out = arrow_map(rows, _SCHEMA.format(id=rows.schema["id"].dataType.simpleString()), start)
    return out.withColumnRenamed("id", id_col)


def tokens_before(n_chars: int | Column, ends: str = "prefix_ends") -> Column:
    """Tokens that end within the first n_chars code points, from the stored array alone."""
    limit = F.lit(n_chars) if isinstance(n_chars, int) else n_chars
    return F.size(F.filter(F.col(ends), lambda e: e <= limit))


def chars_within(budget: int | Column, ends: str = "prefix_ends") -> Column:
    """Code points of the longest prefix with at most `budget` tokens, from the stored array alone."""
    limit = F.lit(budget) if isinstance(budget, int) else budget
    next_ = F.get(F.col(ends), limit)
    before = F.array_max(F.filter(F.col(ends), lambda e: next_.isNull() | (e < next_)))
    return F.coalesce(before, F.lit(0))
