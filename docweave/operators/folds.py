"""Ordered folds over the rows of each key, streamed: a task holds one key's state, not its rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def fold_rows(rows: DataFrame, key: str, order: str, start: Callable[[], object], step: Callable[[object, object], tuple], schema: str) -> DataFrame:
    """step(state, row) of each row, in order within its key, as a row of `schema`; a key's state is start() at its first row.
    Rows are named tuples of the columns of `rows`."""
    names = [c.strip().split(" ")[0] for c in _columns(schema)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = object(), None
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                own = getattr(row, key)
                if own != last and not (pd.isna(own) and last is None):
                    last, state = None if pd.isna(own) else own, start()
                out.append(step(state, row))
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, schema)


def _columns(schema: str) -> list[str]:
    """The columns of a schema, cut at commas outside brackets."""
    out, depth = [""], 0
    for c in schema:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out
