"""What filters remove from each other, for every order in which they can be applied.

A document counts only through the set of filters it fails, a bit mask, so the corpus
is summed up as a weight for each part and mask. In numpy the masks become a matrix (0 where
a filter fails, infinite where not) and the orders another one, of the position of each filter (the inverse
permutation). Their min-plus product is the step at which each mask is removed under each
order; weights scattered by these steps are the documents removed, and those failed later are redundant.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_GAP, Scratch, arrow_map, short_batches

#: The filters, in the order of their bits.
FILTERS = "ABCDE"


def failed_alone(text: Column) -> Column:
    """Bits of the filters that look at one text: A, under 50 words; B, distinct words below 65 %; C, upper-case letters above 5 %; D, an odd mark."""
    words = F.filter(F.split(text, WORD_GAP, -1), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    fails = (n < 50, 100 * distinct < 65 * n, 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text), text.rlike("[#$%&*|]"))
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0)).cast("int")


def removal_steps(masks: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All orders of n filters, and the step (from 0; n: kept) at which each order removes each mask: the min-plus product of
    masks x filters and filters x orders."""
    orders = np.array(list(permutations(range(n))))
    positions = np.argsort(orders, axis=1).T  # inverse permutations
    cost = np.where((masks[:, None] >> np.arange(n)) & 1, 0, n)  # n stands for infinity: no position is as large
    steps = np.full((len(masks), len(orders)), n)
    for f in range(n):
        np.minimum(steps, cost[:, f, None] + positions[f], out=steps)
    return orders, steps


def interactions(masks: np.ndarray, weights: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """Sums for every order and step, each an array of orders x n, from the weights (columns: all, good, toxic) of the masks."""
    orders, steps = removal_steps(masks, n)
    lines = np.arange(len(orders))
    removed = np.zeros((len(orders), n + 1, weights.shape[1]), np.int64)
    failing = np.zeros((len(orders), n), np.int64)
    fails = ((masks[:, None] >> np.arange(n)) & 1).astype(bool)
    for m, weight in enumerate(weights):
        removed[lines, steps[m]] += weight
        failing += weight[0] * fails[m][orders]
    gone = removed[:, :n, 0]
    alone = np.zeros(n, np.int64)
    single = fails.sum(1) == 1
    np.add.at(alone, fails[single].argmax(1), weights[single, 0])
    shapley = np.zeros(n, np.int64)
    np.add.at(shapley, orders, gone)
    return {
        "kept": weights[:, 0].sum() - np.cumsum(gone, axis=1), "removed": gone, "redundant": failing - gone, "unique_fails": alone[orders],
        "good_lost": removed[:, :n, 1], "toxic_lost": removed[:, :n, 2], "shapley": shapley[orders],
    }


def audit(sums: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step and the counts of interactions(), from a row (part, mask, n, good, toxic) for each part and mask.

    A part has at most 2**filters masks, so what comes together for it is bounded, however many documents and parts there are. An order has a letter for each filter.
    """
    short_batches(sums.sparkSession)
    parts = sums.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    n = len(filters)
    labels = ["".join(filters[f] for f in order) for order in permutations(range(n))]

    def start():
        def work(batch):
            found = []
            for masks in batch.column(1).to_pylist():
                table = np.array([[m["mask"], m["n"], m["good"], m["toxic"]] for m in masks], np.int64)
                found.append(interactions(table[:, 0], table[:, 1:], n))
            each = len(labels) * n
            return {
                "part": np.repeat(batch.column(0).to_numpy(zero_copy_only=False), each), "filter_order": np.tile(np.repeat(labels, n), len(found)),
                "step": np.tile(np.arange(1, n + 1), len(labels) * len(found)),
            } | {k: np.concatenate([f[k].ravel() for f in found]) if found else [] for k in names}

        return work

    return arrow_map(parts, "part string, filter_order string, step int, " + ", ".join(f"{k} long" for k in names), start)


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """part, mask, n, good and toxic: how many documents of each part fail exactly the filters of mask, and how many of them are labelled quality 1 and toxic 1.

    Filter E fails a text that a smaller id has as well. Rows of a text meet by its SHA-256 and only after they are summed up by part and label, so a text with a
    third of all rows is a few rows: in each such cell only the row of the least id can pass. Null ids are larger than all others and not than each other.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), failed_alone(text).alias("mask"))
    rows = Scratch(docs.sparkSession, "audit").keep(own, "rows")
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast(kind).alias("id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    ids = rows.where("id IS NOT NULL").join(known, "id", "left").na.fill(0, ["good", "toxic"])
    marked = ids.unionByName(rows.where("id IS NULL").selectExpr("*", "0 AS good", "0 AS toxic"))
    cell = ["digest", "part", "mask", "good", "toxic"]
    rank = F.struct(F.col("id").isNull().alias("last"), "id")
    cells = marked.groupBy("id", *cell).agg(F.count("*").alias("n")).groupBy(*cell).agg(F.sum("n").alias("n"), F.min(F.struct(rank.alias("rank"), "n")).alias("first"))
    first = F.when(F.col("first.rank") == F.min("first.rank").over(Window.partitionBy("digest")), F.col("first.n")).otherwise(0)
    split = cells.select(*cell[1:], "n", first.alias("passing"))
    both = F.array(F.struct(F.col("mask").alias("mask"), F.col("passing").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))
    out = split.select("part", "good", "toxic", F.explode(both).alias("x")).where("x.n > 0")
    return out.groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("good"), F.sum(F.col("x.n") * F.col("toxic")).alias("toxic"))


def audit_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """audit() of failures(): 600 rows for each part, a value of the source column (null: the empty string).

    A null or empty text fails filter A and is identical to every other such text; a text of any length is measured whole. Rows that repeat id and text all pass
    filter E if no smaller id has the text; null ids have no label and come after all others; a label table that repeats an id counts where any row says 1. An empty table has
    no parts and gives no rows; other columns are left out, whatever their names.
    """
    return audit(failures(docs, labels, id_col, text_col, source_col))
