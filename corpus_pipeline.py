"""The corpus pipeline: five stages from raw documents to a token file.

Every stage but the last returns rows of its input with all their columns, whatever these are. Null ids, repeated rows and null,
empty or very long texts are ordinary input: what becomes of them is said at each stage. An empty table goes through all stages and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docweave.llm import decontamination, mixing, near_duplicates, token_file, toxicity
from docweave.llm.common import Scratch, read
from docweave.llm.queries import in_training, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half, by a model learned from the labelled ones among them. Null and empty texts are scored as texts without
    words; equal texts score equally; without a toxic label nothing is dropped."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), in_training("doc_id", 5, 0))
    return toxicity.below(docs, model, 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity of 0.8. Documents without words all stay; of rows that repeat an id and a
    text one stays; null ids come last in the choice."""
    return near_duplicates.without_copies(docs, width=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; null and empty texts stay."""
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document can come more than once. Null sources are one source; ties of the draw go by id and text."""
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document in the token file, read back from it; a null text has the end id alone."""
    path = Scratch(spark, "token-file").base
    token_file.write_token_file(docs, path, vocabulary("byte_bpe_50k.json"), end_id=2)
    return token_file.read_token_file(spark, path, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: Learned scores, hashing and tokenization aren't SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's rows written and read again before the next."""
    scratch, docs = Scratch(spark, "pipeline"), read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
