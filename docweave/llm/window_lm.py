"""Masked pseudo-likelihood of texts under a bidirectional window network.

Every token is hidden in turn and predicted from the two tokens on either
side: a hidden layer over the four neighbours' embeddings, weighed by place, and from there a walk down a binary tree of all
tokens (the Huffman tree of their counts). Each branching is a logistic unit, so that the probabilities of a vocabulary of any
size sum to one at the cost of its logarithm. The sum of the log-probabilities scores a document.

The vocabulary comes from word counts of the whole corpus and grows with it: every word whose count
reaches threshold() is a token. The other words share classes by their endings; the network predicts the class, and the counts of the
corpus the word in its class, so that each word has a probability of its own. All documents train the network: they are
dealt by a hash to shards, whose number follows from the corpus alone; each shard starts from the same parameters and makes one
pass over its documents in order of the hash with Adagrad; the parameters are averaged, weighed by tokens, in order of the shards.
So scores don't depend on the partitions of the table or the number of tasks.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, mix, short_batches, words_of_batch
from .token_file import code_lengths

#: Classes that the words outside the vocabulary share by a hash of their last three bytes.
OTHER = 4096
#: The count from which a word is a token is the square root of the words of the corpus, divided by SPARE.
SPARE = 40
#: Neighbours, width of the hidden layer, tokens of a step; in training the first steps are short and double after every EARLY ones.
OFFSETS, HIDDEN, STEP, FIRST_STEP, EARLY = (-2, -1, 1, 2), 16, 4096, 256, 8
#: In training every HIDE-th token is hidden, from a place drawn by the document's hash; in scoring all are.
HIDE = 3
#: Log odds against a turn, at most; the longest way has less than 30 turns.
MOST = np.float32(22)
#: Words of a training shard, about, and for each token of the vocabulary: so the parameters of all shards stay smaller than the corpus.
SHARD_WORDS, SHARD_WORDS_A_TOKEN = 4_000_000, 64
#: Distinct words a task counts before it hands them on.
COUNTED = 300_000
#: Bytes of parameters that are averaged in one row.
BLOCK_BYTES = 4 << 20


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word (binary) and n over all documents; counted in the tasks before the shuffle."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            found = words_of_batch(batch.column(0))[0].value_counts()
            for w, n in zip(found.field(0).to_pylist(), found.field(1).to_pylist(), strict=True):
                counts[w] += n
            if len(counts) > COUNTED:
                yield out()
                counts.clear()
        yield out()

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def threshold(total: int) -> int:
    """The least count of a token in a corpus of `total` words."""
    return max(2, math.ceil(math.sqrt(total) / SPARE))


def vocabulary(counts: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """All words that reach the threshold (most frequent first, ties by the word), and the corpus count of every token: these words, then the classes."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    top = sorted((-r["n"], bytes(r["word"])) for r in counts.where(F.col("n") >= threshold(total)).collect())
    n = np.concatenate([[-c for c, _ in top], np.zeros(OTHER)])
    words = [w for _, w in top]
    n[len(top) :] = class_totals(counts, words, 0) - 1
    return words, n


def class_of(word: bytes) -> int:
    return int(classes_of(pa.array([word], pa.binary()))[0])


def classes_of(words: pa.Array) -> np.ndarray:
    """The class of each word (of one byte and more)."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)
    first, last, size = ends[:-1], ends[1:] - 1, np.diff(ends)
    key = np.zeros(len(size), np.uint64)
    for i in range(3):
        key |= np.where(size > i, data[np.maximum(last - i, first)], 0).astype(np.uint64) << np.uint64(8 * i)
    return (mix(key) % np.uint64(OTHER)).astype(np.int32)


def class_totals(counts: DataFrame, words: list[bytes], unseen: int = 1) -> np.ndarray:
    """For each class the words that share it: their occurrences and (with `unseen`) their number, and one for the unseen ones.

    A word that occurs n times has n parts of that total; each distinct word leaves one part, and the last one is added, to unseen words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums = pa.array(words, pa.binary()), np.zeros(OTHER)
        for batch in batches:
            rare = pc.is_null(pc.index_in(batch.column(0), value_set=known))
            found, n = batch.column(0).filter(rare), batch.column(1).filter(rare).to_numpy(zero_copy_only=False)
            if len(found):
                sums += np.bincount(classes_of(found), n + float(unseen), OTHER)
        yield pa.RecordBatch.from_arrays([pa.array(range(OTHER), pa.int32()), pa.array(sums, pa.float64())], ["class", "total"])

    out = np.ones(OTHER)
    for r in counts.select("word", "n").mapInArrow(run, "class int, total double").groupBy("class").agg(F.sum("total").alias("total")).collect():
        out[r["class"]] += r["total"]
    return out


class Tokens:
    """Token numbers of words: their place in the vocabulary, or that of their class after it."""

    def __init__(self, words: list[bytes]):
        self.known, self.first = pa.array(words, pa.binary()), len(words)

    def of(self, words: pa.Array) -> np.ndarray:
        if not len(words):
            return np.zeros(0, np.int32)
        found = pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
        rare = np.flatnonzero(found < 0)
        if len(rare):
            found[rare] = self.first + classes_of(words.take(pa.array(rare)))
        return found


class Tree:
    """The Huffman tree of some counts: for each token the branchings on its way from the root and the turns it takes there (0 or 1)."""

    def __init__(self, counts: np.ndarray):
        n = len(counts)
        lengths = code_lengths(counts + 1.0, max(24, n.bit_length() + 4)).astype(np.int64)
        order = np.lexsort((np.arange(n), lengths))
        sized = lengths[order]
        most = int(sized[-1])
        spans = np.int64(1) << (most - sized)
        codes = np.cumsum(spans) - spans  # canonical codes, in order, widened to `most` bits
        self.depth = lengths.astype(np.int32)
        self.starts = np.cumsum(lengths) - lengths
        self.path, self.turn = np.zeros(int(lengths.sum()), np.int32), np.zeros(int(lengths.sum()), np.int8)
        nodes = 0
        for d in range(most):
            deep = np.flatnonzero(sized > d)
            prefix = codes[deep] >> (most - d)
            new = np.concatenate([[True], prefix[1:] != prefix[:-1]])
            at = self.starts[order[deep]] + d
            self.path[at] = nodes + np.cumsum(new) - 1
            self.turn[at] = (codes[deep] >> (most - d - 1)) & 1
            nodes += int(new.sum())
        self.nodes = nodes

    def ways(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Branchings and turns of these tokens, one after the other, and how many each has."""
        n = self.depth[tokens].astype(np.int64)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - self.starts[tokens], n)
        return self.path.take(at), self.turn.take(at), n


class Network:
    def __init__(self, counts: np.ndarray, seed: int = 3):
        """Begins as the unigram distribution: the branchings know only how often either turn is taken."""
        self.tokens, self.tree = len(counts), Tree(counts)
        self.shapes = {"E": (self.tokens + 1, HIDDEN), "C": (len(OFFSETS), HIDDEN), "e": (HIDDEN,), "N": (self.tree.nodes, HIDDEN), "n": (self.tree.nodes,)}
        rng = np.random.default_rng(seed)
        self.p = {k: np.zeros(s, np.float32) for k, s in self.shapes.items()}
        self.p["E"][:] = rng.normal(0, 0.3, self.shapes["E"])
        self.p["C"][:] = 1 + rng.normal(0, 0.3, self.shapes["C"])
        weight, turn = np.repeat(counts + 1.0, self.tree.depth), self.tree.turn
        ones, zeros = np.bincount(self.tree.path, weight * turn, self.tree.nodes), np.bincount(self.tree.path, weight * (1 - turn), self.tree.nodes)
        self.p["n"][:] = np.log(ones / zeros)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.shapes])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for k, s in self.shapes.items():
            n = int(np.prod(s))
            self.p[k] = flat[at : at + n].reshape(s).astype(np.float32)
            at += n
        return self

    def hidden(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Activations, and the neighbours' embeddings."""
        x = self.p["E"].take(around, axis=0)  # take() copies rows faster than an index does
        z = self.p["e"] + x[0] * self.p["C"][0]
        for o in range(1, len(OFFSETS)):
            z += x[o] * self.p["C"][o]
        return np.tanh(z, out=z), x

    def log_probabilities(self, tokens: np.ndarray, around: np.ndarray) -> np.ndarray:
        h, _ = self.hidden(around)
        nodes, turns, n = self.tree.ways(tokens)
        z = np.einsum("lk,lk->l", self.p["N"].take(nodes, axis=0), np.repeat(h, n, axis=0)) + self.p["n"].take(nodes)
        # log of the product of 1 + exp(-z) over the way; MOST keeps 24 factors and more within doubles
        z = np.minimum(np.where(turns == 1, -z, z), MOST)
        return -np.log(np.multiply.reduceat(1 + np.exp(z).astype(np.float64), np.cumsum(n) - n))

    def gradients(self, tokens: np.ndarray, around: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log-probability."""
        out = {}
        for k, (at, g) in self.sparse_gradients(tokens, around).items():
            out[k] = np.zeros(self.shapes[k], g.dtype)
            out[k][at] = g / len(tokens)
        return out

    def sparse_gradients(self, tokens: np.ndarray, around: np.ndarray) -> dict[str, tuple]:
        """Of the sum of negative log-probabilities: for each parameter the rows that have any, and theirs."""
        h, x = self.hidden(around)
        nodes, turns, n = self.tree.ways(tokens)
        own, reached = self.p["N"].take(nodes, axis=0), np.repeat(h, n, axis=0)
        d = 1 / (1 + np.exp(-(np.einsum("lk,lk->l", own, reached) + self.p["n"].take(nodes)))) - turns
        own *= d[:, None]
        dz = np.add.reduceat(own, np.cumsum(n) - n, axis=0) * (1 - h * h)
        reached *= d[:, None]
        at, which = _numbered(nodes, self.tree.nodes)
        at_e, which_e = _numbered(around.ravel(), self.tokens + 1)
        return {
            "E": (at_e, _row_sums(which_e, (dz[None] * self.p["C"][:, None]).reshape(-1, HIDDEN), len(at_e))),
            "C": (slice(None), np.einsum("otk,tk->ok", x, dz)), "e": (slice(None), dz.sum(0)),
            "N": (at, _row_sums(which, reached, len(at))), "n": (at, np.bincount(which, d, len(at))),
        }


def _numbered(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and for each value its place among them."""
    number = np.zeros(size, np.int32)
    number[values] = 1
    distinct = np.flatnonzero(number)
    number[distinct] = np.arange(len(distinct))
    return distinct, number.take(values)


def _row_sums(which: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """The sum of the rows of each number."""
    which = which.astype(np.int64)
    return np.stack([np.bincount(which, x, size) for x in rows.T.astype(np.float64)], axis=1)


def neighbours(tokens: np.ndarray, mark: int) -> np.ndarray:
    """For each offset the token there; the mark beyond either end of the text."""
    reach = max(OFFSETS)
    padded = np.full(len(tokens) + 2 * reach, mark, np.int32)
    padded[reach : reach + len(tokens)] = tokens
    return np.stack([padded[reach + o : reach + o + len(tokens)] for o in OFFSETS])


class Trainer:
    """One pass over token sequences in the order they come, in steps of hidden tokens."""

    def __init__(self, counts: np.ndarray, rate: float):
        self.net, self.rate, self.seen, self.steps, self.waiting, self.n = Network(counts), rate, 0, 0, [], 0
        self.squares = {k: np.ones(s, np.float32) for k, s in self.net.shapes.items()}

    def see(self, tokens: np.ndarray, drawn: int) -> None:
        hidden = np.arange(drawn % HIDE, len(tokens), HIDE)
        self.seen += len(tokens)
        self.waiting.append((tokens[hidden], neighbours(tokens, self.net.tokens)[:, hidden]))
        self.n += len(hidden)
        if self.n >= self._size():
            (t, a), at = self._all(), 0
            while at + (size := self._size()) <= len(t):
                self._step(t[at : at + size], a[:, at : at + size])
                at += size
            self.waiting, self.n = [(t[at:], a[:, at:])], len(t) - at

    def _size(self) -> int:
        return min(STEP, FIRST_STEP << min(30, self.steps // EARLY))

    def _all(self) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([t for t, _ in self.waiting]), np.concatenate([a for _, a in self.waiting], axis=1)

    def _step(self, tokens: np.ndarray, around: np.ndarray) -> None:
        self.steps += 1
        for k, (at, g) in self.net.sparse_gradients(tokens, around).items():
            squares, p = self.squares[k], self.net.p[k]
            own = (squares if isinstance(at, slice) else squares.take(at, axis=0)) + g * g
            squares[at] = own
            p[at] = (p if isinstance(at, slice) else p.take(at, axis=0)) - self.rate * g / np.sqrt(own)

    def end(self) -> np.ndarray:
        if self.n:
            self._step(*self._all())
        return self.net.flat()


def shards_of(total: float, tokens: int) -> int:
    return max(1, round(total / max(SHARD_WORDS, SHARD_WORDS_A_TOKEN * tokens)))


def train(docs: DataFrame, words: list[bytes], counts: np.ndarray, text_col: str = "text", rate: float = 0.05, id_col: str = "doc_id", shards: int | None = None) -> Network:
    """One pass over all documents, in every shard from the same beginning; then the weighted mean of all shards' parameters.

    Rows are dealt to shards by a hash of id and text, so that copies of a text are spread. A null or empty text adds nothing.
    Without tokens the network stays at the unigram distribution.
    """
    short_batches(docs.sparkSession)
    shards, n_params = shards or shards_of(counts.sum(), len(counts)), int(sum(np.prod(s) for s in Network(counts).shapes.values()))
    blocks = max(1, -(-4 * n_params // BLOCK_BYTES))
    text = F.col(text_col).cast("string")
    drawn = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text)
    rows = docs.select(text.alias("text"), F.pmod(drawn, F.lit(shards)).cast("int").alias("shard"), drawn.alias("drawn")).where("text is not null")

    def tokenise():
        numbers = Tokens(words)

        def work(batch: pa.RecordBatch) -> dict:
            every, sizes = words_of_batch(batch.column(0))
            tokens, ends = numbers.of(every), np.cumsum(sizes)
            return {"shard": batch.column(1), "drawn": batch.column(2), "tokens": [tokens[a:b].tobytes() for a, b in zip(ends - sizes, ends, strict=True)]}

        return work

    def one(shard: int, trainer: Trainer) -> pa.RecordBatch:
        parts = np.array_split(trainer.end(), blocks)
        return pa.RecordBatch.from_arrays(
            [pa.array(range(blocks), pa.int32()), pa.array([shard] * blocks, pa.int32()), pa.array([float(trainer.seen)] * blocks), pa.array([x.tobytes() for x in parts], pa.binary())], schema=kind)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, trainer = -1, None
        for batch in batches:
            for s, drawn, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != shard:
                    if trainer and trainer.seen:
                        yield one(shard, trainer)
                    shard, trainer = s, Trainer(counts, rate)
                if raw:
                    trainer.see(np.frombuffer(raw, np.int32), drawn)
        if trainer and trainer.seen:
            yield one(shard, trainer)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Weighted means of the blocks that come in, one row at a time in order of block and shard; a task holds one sum."""
        block, low, weight, total = -1, 0, 0.0, None
        mean = lambda: pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([low], pa.int32()), pa.array([weight]), pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())], schema=kind)
        for batch in batches:
            for b, s, w, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != block:
                    if block >= 0:
                        yield mean()
                    block, low, weight, total = b, s, 0.0, 0.0
                weight, total = weight + w, total + w * np.frombuffer(x, np.float32).astype(np.float64)
        if block >= 0:
            yield mean()

    kind = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("weight", pa.float64()), ("mean", pa.binary())])
    schema = "block int, shard int, weight double, mean binary"
    dealt = arrow_map(rows, "shard int, drawn long, tokens binary", tokenise).repartitionById(shards, "shard").sortWithinPartitions("shard", "drawn", "tokens")
    models = dealt.mapInArrow(local, schema)
    some = models.repartition(max(blocks, math.isqrt(blocks * shards)), "block", F.col("shard") % max(1, math.isqrt(shards))).sortWithinPartitions("block", F.col("shard") % max(1, math.isqrt(shards)), "shard")
    means = Scratch(docs.sparkSession, "lm-means")
    some = means.keep(some.mapInArrow(summed, schema), "some")
    found = sorted(some.repartition(blocks, "block").sortWithinPartitions("block", "shard").mapInArrow(summed, schema).collect(), key=lambda r: r["block"])
    means.drop(some)
    if not found:
        return Network(counts)
    return Network(counts).load(np.concatenate([np.frombuffer(r["mean"], np.float32) for r in found]))


def score(docs: DataFrame, words: list[bytes], counts: np.ndarray, network: Network, id_col: str = "doc_id", text_col: str = "text",
          corpus: DataFrame | None = None) -> DataFrame:
    """id, n_tokens, log_likelihood (the sum over all tokens of the whole text) and mean_log_likelihood of each row of docs.

    `corpus` is the table of word_counts() that the vocabulary is from; if it isn't given, the words of docs are counted.
    A null or empty text has no tokens, a sum of 0 and a null mean; texts of any length are scored whole; repeated rows are scored each, and equally;
    ids may be null; an empty table gives no rows; other columns are left out, whatever their names.
    """
    short_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "lm-scores")
    if corpus is None:
        corpus = scratch.keep(word_counts(docs, text_col), "words")
    first, log_totals = len(counts) - OTHER, np.log(class_totals(corpus, words))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    flat = network.flat()

    def start():
        numbers, net, rows_before = Tokens(words), Network(counts).load(flat), itertools.count(TaskContext.get().partitionId() << 40)

        def work(batch: pa.RecordBatch) -> dict:
            every, sizes = words_of_batch(batch.column(1))
            tokens, ends = numbers.of(every), np.cumsum(sizes)
            sums, shared = np.zeros(len(sizes)), tokens >= first
            if len(tokens):
                around = np.concatenate([neighbours(tokens[a:b], len(counts)) for a, b in zip(ends - sizes, ends, strict=True)], axis=1)
                each = np.concatenate([net.log_probabilities(tokens[i : i + STEP], around[:, i : i + STEP]) for i in range(0, len(tokens), STEP)])
                each[shared] -= log_totals[tokens[shared] - first]
                sums = np.bincount(np.repeat(np.arange(len(sizes)), sizes), each, len(sizes))
            cuts = np.concatenate([[0], np.cumsum(shared)])[np.concatenate([[0], ends])]
            rare = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), every.filter(pa.array(shared)))
            return {"row": [next(rows_before) for _ in sizes], "id": batch.column(0), "n_tokens": sizes, "sum": sums, "rare": rare}

        return work

    kind = rows.schema["id"].dataType.simpleString()
    # what is known of a row but the counts of its words that share classes; these come by a join, words that occur once or never add nothing
    scored = scratch.keep(arrow_map(rows, f"row long, id {kind}, n_tokens long, sum double, rare array<binary>", start), "scored")
    seen = corpus.where("n > 1").select("word", F.log("n").alias("log_n"))
    added = scored.select("row", F.explode("rare").alias("word")).join(seen, "word").groupBy("row").agg(F.sum("log_n").alias("added"))
    total = F.col("sum") + F.coalesce("added", F.lit(0.0))
    return scored.select("row", "id", "n_tokens", "sum").join(added, "row", "left").select(
        F.col("id").alias(id_col), "n_tokens", total.alias("log_likelihood"), F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log_likelihood"))
