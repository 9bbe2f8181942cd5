"""Context for resolving pronouns, sentence by sentence."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.config import DEFAULTS, PRONOUNS


def context(sentences: DataFrame, doc: str = "doc_id", at: str = "sentence_idx", text: str = "sentence", before: int = DEFAULTS.context_before, after: int = DEFAULTS.context_after) -> DataFrame:
    """previous and following sentences of each; windows are by document."""
    w = Window.partitionBy(doc).orderBy(at)
    return sentences.select(
        doc, at, text, F.collect_list(text).over(w.rowsBetween(-before, -1)).alias("previous"), F.collect_list(text).over(w.rowsBetween(1, after)).alias("following"))


def resolve(sentences: DataFrame, rewrite: Callable[[str, list[str], list[str]], str | None], doc: str = "doc_id", at: str = "sentence_idx", text: str = "sentence") -> DataFrame:
    """Sentences with a pronoun rewritten by rewrite(sentence, previous resolved, following), in order, each seeing what came of those
    before it; the rest stay. A rewrite that fails or gives nothing keeps the sentence; `error` tells how it failed. One document is one ordered fold;
    documents stream through their task one after the other, which holds the sentences around the one at hand only."""
    before, after = DEFAULTS.context_before, DEFAULTS.context_after

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, done = object(), deque(), deque(maxlen=before)

        def settle() -> tuple:
            """The first sentence that waits; those after it are what follows."""
            place, s = waiting.popleft()
            has = any(p in (s or "") for p in PRONOUNS)
            new = error = None
            if has:
                try:
                    new = rewrite(s, list(done), [x for _, x in waiting])
                except Exception as e:  # whatever a model's client raises; it is reported
                    error = f"{type(e).__name__}: {e}"
            done.append(new or s)
            return now, place, new or s, has, error

        def sent(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], [doc, at, text, "has_pronoun", "error"])

        types = None
        for batch in batches:
            out, types = [], types or [*[batch.schema.field(c).type for c in (doc, at)], pa.string(), pa.bool_(), pa.string()]
            for own, place, s in zip(*[batch.column(c).to_pylist() for c in (doc, at, text)], strict=True):
                if own != now:
                    while waiting:
                        out.append(settle())
                    now = own
                    done.clear()
                waiting.append((place, s))
                if len(waiting) > after:
                    out.append(settle())
            yield sent(out)
        if waiting:
            yield sent([settle() for _ in range(len(waiting))])

    kind = {c: sentences.schema[c].dataType.simpleString() for c in (doc, at)}
    ordered = sentences.select(doc, at, text).repartition(doc).sortWithinPartitions(doc, F.asc_nulls_last(at), text)
    return ordered.mapInArrow(run, f"{doc} {kind[doc]}, {at} {kind[at]}, {text} string, has_pronoun boolean, error string")
