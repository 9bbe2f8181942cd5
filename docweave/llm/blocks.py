"""Links inside groups of any size, without pairs.

A group (a bucket, a family) is cut into blocks of its members, and a sample of PIVOTS members, about, is added to every
block. A block is searched from member to member, each held against all that haven't been reached yet; the
edges of the trees so found are given out, at most one a member. What the blocks and the sample don't join, the
members outside a group's largest component, is then held against all blocks of its group.
So a task holds two blocks at most, and the components are those of all links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.operators.components import components

from .common import Scratch

#: Members of a group of several blocks that all its blocks see, on average.
PIVOTS = 16
#: Members outside the largest component that are held against a block at once.
OUTSIDE = 512


class Members:
    """Members of one or several groups: their marks (bytes), the sizes of their sets, and the sets, if they are given."""

    def __init__(self, rows: pa.RecordBatch, percent: int, least: int):
        self.percent, self.least, n = percent, least, len(rows)
        column = {name: rows.column(i) for i, name in enumerate(rows.schema.names)}
        self.nodes, self.sizes = column["node"], column["n"].to_numpy().astype(np.int64)
        self.marks = _flat(column["marks"], np.uint8).reshape(n, -1)
        self.sets = None
        if "shingles" in column:
            self.sets = _flat(column["shingles"], np.int64).view(np.uint64)
            self.ends = np.cumsum(self.sizes)

    def may_link(self, one, others) -> np.ndarray:
        """Whether sizes and marks allow a link of one member with others, or of as many members with one other each."""
        a, b = self.sizes[one], self.sizes[others]
        equal = (self.marks[others] == self.marks[one]).view(np.uint64)
        agree = (equal.sum(-1) * np.uint64(0x0101010101010101)) >> np.uint64(56)  # sums of bytes that are 0 or 1
        return (agree >= self.least) & (100 * np.minimum(a, b) >= self.percent * np.maximum(a, b))

    def links(self, one: int, others: np.ndarray) -> np.ndarray:
        """Those of others that are linked with one: by their sets, or, without sets, all that may be."""
        near = others[self.may_link(one, others)]
        if self.sets is None or not len(near):
            return near
        own, n = self.sets[self.ends[one] - self.sizes[one] : self.ends[one]], self.sizes[near]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.ends[near] - n, n)
        values = self.sets[at]
        known = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
        common = np.add.reduceat(known.astype(np.int64), np.cumsum(n) - n)
        return near[100 * common >= self.percent * (n + len(own) - common)]

    def trees(self, first: int, end: int) -> Iterator[tuple[int, np.ndarray]]:
        """Spanning trees of all links between the members from first to end: a member, and those reached from it."""
        left, reached = np.arange(first, end), []
        while len(left):
            if reached:
                one = reached.pop()
            else:
                one, left = left[0], left[1:]
            near = self.links(one, left) if len(left) else left
            if len(near):
                yield one, near
                left = left[~np.isin(left, near, assume_unique=True)]
                reached += near.tolist()

    def joins(self, outside: np.ndarray, roots: np.ndarray) -> Iterator[tuple[int, int]]:
        """Links between the outside members and members with other roots that make roots one."""
        roots = roots.copy()
        for one in outside:
            others = np.flatnonzero(roots != roots[one])
            near = self.links(one, others)
            for root in np.unique(roots[near]):
                yield one, near[roots[near] == root][0]
                roots[roots == root] = roots[one]


def _flat(column: pa.Array, kind: type) -> np.ndarray:
    """The values of a list or binary column in one array."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    if pa.types.is_list(column.type):
        return column.values.to_numpy()[offsets[0] : offsets[-1]]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(kind)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Sorted batches cut anew between groups: rows of whole groups, and where each group begins and the last one ends."""

    def changes(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(len(batch) - 1, bool)
        for k in keys:
            c = batch.column(batch.schema.get_field_index(k))
            out |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        return np.flatnonzero(out) + 1

    def joined(parts: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray]:
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if len(parts) > 1 else parts[0]
        return rows, np.concatenate([[0], changes(rows), [len(rows)]]).astype(np.int64)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        cuts = changes(batch)
        last = int(cuts[-1]) if len(cuts) else 0
        same = held and all(held[-1].column(i)[-1] == batch.column(i)[0] for i in map(batch.schema.get_field_index, keys))
        if same and not last:
            held.append(batch)
            continue
        if last:
            held.append(batch[:last])
        if held:
            yield joined(held)
        held = [batch[last:]]
    if held:
        yield joined(held)


def _edges(rows: DataFrame, keys: list[str], find: Callable[[pa.RecordBatch, np.ndarray], Iterator[tuple]]) -> DataFrame:
    """a and b of the edges that find() gives (as positions in arrays) for whole groups of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, keys):
            nodes = rows.column(rows.schema.get_field_index("node"))
            found = [(np.broadcast_to(a, np.shape(b)).ravel(), np.ravel(b)) for a, b in find(rows, starts)]
            if found:
                a, b = (pa.array(np.concatenate(x), pa.int64()) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([nodes.take(a), nodes.take(b)], ["a", "b"])

    return rows.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(run, "a binary, b binary")


def linked(rows: DataFrame, scratch: Scratch, percent: int, least: int) -> DataFrame:
    """node and root (the smallest node it can reach by links within groups) of every node that has a link.

    rows: key (the group), node, n (size of its set), marks, members and blocks of its group, and, if links are to be confirmed,
    shingles (distinct, in order as unsigned numbers). A link needs `least` equal marks and sizes that allow it; with shingles also
    100 * |intersection| >= percent * |union|.
    """
    columns = ["key", "node", "n", "marks", *(["shingles"] if "shingles" in rows.columns else [])]
    own = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    drawn = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 40)) < F.lit(float(PIVOTS << 40)) / F.col("members")
    where = F.when((F.col("blocks") > 1) & drawn, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))

    def inside(batch: pa.RecordBatch, starts: np.ndarray) -> Iterator[tuple]:
        every, sizes = Members(batch, percent, least), np.diff(starts)
        if every.sets is not None:
            for s, e in zip(starts, starts[1:], strict=False):
                yield from every.trees(s, e)
            return
        # most groups are stars round their first member
        first = np.repeat(starts[:-1], sizes)
        star = every.may_link(first, np.arange(len(first)))
        whole = np.logical_and.reduceat(star, starts[:-1])
        at = np.flatnonzero(np.repeat(whole, sizes) & (first != np.arange(len(first))))
        yield first[at], at
        for g in np.flatnonzero(~whole & (sizes > 1)):
            yield from every.trees(starts[g], starts[g + 1])

    links = scratch.keep(_edges(rows.select(*columns, F.explode(where).alias("block")), ["key", "block"], inside).distinct(), "links")
    roots = components(links)
    cut = rows.where("blocks > 1").select(*columns, "blocks").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by_root = cut.groupBy("key", "root").agg(F.count("*").alias("c"))
    open_ = scratch.keep(by_root.groupBy("key").agg(F.max(F.struct("c", "root"))["root"].alias("main"), F.sum("c").alias("all"), F.max("c").alias("most")).where("all > most"), "open")
    if open_.isEmpty():
        return roots
    parts = F.ceil((F.col("all") - F.col("most")) / OUTSIDE).cast("int")
    rest = cut.join(open_.select("key", "main", parts.alias("parts")), "key")
    part = F.pmod(F.xxhash64("node", F.lit(2)), "parts").cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns.append("root")
    every = rest.select(*columns, F.lit(False).alias("outside"), own.alias("block"), upto("parts").alias("part"))
    outside = rest.where("root <> main").select(*columns, F.lit(True).alias("outside"), upto("blocks").alias("block"), part.alias("part"))

    def across(batch: pa.RecordBatch, starts: np.ndarray) -> Iterator[tuple]:
        column = lambda name: batch.column(batch.schema.get_field_index(name))
        for s, e in zip(starts.tolist(), starts[1:].tolist(), strict=False):
            roots = column("root")[s:e].dictionary_encode().indices.to_numpy()
            own = Members(batch[s:e], percent, least)
            yield from ((a + s, b + s) for a, b in own.joins(np.flatnonzero(column("outside")[s:e].to_numpy(zero_copy_only=False)), roots))

    more = scratch.keep(_edges(every.unionByName(outside), ["key", "block", "part"], across).distinct(), "more")
    return components(links.union(more))
