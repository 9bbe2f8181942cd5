"""From sentences to facts: preparing documents for extraction, extraction by a model, and what follows an assignment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave import providers
from docweave.config import RELATIONS
from docweave.operators import coreference, entities, graph, staging, tasks


def prepare(sentences: DataFrame, rewrite: Callable | None = None, mentions: DataFrame | None = None, embedder: providers.Embedder | None = None, doc: str = "source") -> tuple[DataFrame, DataFrame | None]:
    """Windows for extraction, and vectors of the normalised sentences if there is an embedder, from sentences(doc, sentence_idx, sentence).

    In order: names of a document's entities are made uniform (if mentions(doc, sentence_idx, forms) are given), pronouns are resolved (if rewrite
    is), the rest is as it was. An empty document has no windows.
    """
    rows = sentences.select(doc, "sentence_idx", "sentence")
    done = rows
    if mentions is not None:
        known = rows.join(mentions.select(doc, "sentence_idx", "forms"), [doc, "sentence_idx"], "left")
        done = entities.apply_registry(known, doc).select(doc, "sentence_idx", "sentence")
    if rewrite is not None:
        done = coreference.resolve(done, rewrite, doc, "sentence_idx", "sentence").select(doc, "sentence_idx", "sentence")
    vectors = None if embedder is None else providers.embed(done, "sentence", embedder).select(doc, "sentence_idx", "vector")
    both = rows.join(done.withColumnRenamed("sentence", "normal"), [doc, "sentence_idx"]).groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("sentence_idx", "sentence", "normal"))).alias("s"))
    arrays = both.select(doc, F.transform("s", lambda x: x["sentence"]).alias("sentences"), F.transform("s", lambda x: x["normal"]).alias("normalized"))
    return staging.extraction_windows(arrays, doc), vectors


def extraction_prompt(text: Column) -> Column:
    return F.concat(
        F.lit("請從下文抽取主詞、關係、受詞，只輸出 JSON：{\"triples\":[{\"subject\":\"\",\"subject_type\":\"\",\"rel_type\":\"\",\"verb\":\"\",\"object\":\"\",\"object_type\":\"\",\"confidence\":1}]}。\n"
              f"rel_type 只能是：{', '.join(RELATIONS)}。verb 用原文的說法，confidence 是 1 到 5；沒有就輸出空的 triples。\n文本：\n"), text)  # fmt: skip


def extract_triples(chunks: DataFrame, model: providers.LanguageModel | None, text: str = "text") -> DataFrame:
    """The valid triples of each chunk beside its other columns, see graph.parse_triples(). Blank texts, failed calls and a missing model give none."""
    rest = [c for c in chunks.columns if c != text]
    asked = chunks.where(F.trim(F.coalesce(text, F.lit(""))) != "").withColumn("__prompt", extraction_prompt(F.col(text)))
    if model is None:
        asked = asked.where(F.lit(False)).withColumn("raw", F.lit(None).cast("string"))
    else:
        asked = providers.generate(asked, "__prompt", model, "raw")
    return graph.parse_triples(asked.select(*rest, "raw").where(F.col("raw").isNotNull()))


def audit_pronouns(words: DataFrame, model: providers.LanguageModel) -> DataFrame:
    """word, sentence and accepted: whether the model takes the word for a pronoun in the sentence. A failed call accepts nothing."""
    prompt = F.format_string("句子：「%s」\n詞：「%s」\n這個詞在句子裡是代名詞或指代詞嗎？請回答「是」或「否」。", "sentence", "word")
    asked = providers.generate(words.withColumn("__prompt", prompt), "__prompt", model)
    return asked.select("word", "sentence", F.coalesce(F.trim("reply").startswith("是"), F.lit(False)).alias("accepted"))


def grown_lexicon(custom: DataFrame, audited: DataFrame, word: str = "word") -> DataFrame:
    """The custom lexicon with the accepted words that it doesn't hold yet."""
    return custom.select(word).union(audited.where("accepted").select(F.col("word").alias(word))).distinct()


def trigger_extraction(records: DataFrame, windows: DataFrame, queue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records and queue after documents were assigned: a record gets the number of its windows, each window a pending task.
    Windows without a record, and records without windows, change nothing."""
    totals = windows.groupBy("source").agg(F.max("total").alias("total"))
    fresh = records.select("kg_id", "source").join(windows.select("source", "chunk_index"), "source")
    return tasks.set_window_total(records, totals), tasks.enqueue(queue, fresh)
