"""Transcripts and pages from outside as a data source, in batches and as a stream.

How they are got is handed in as a transport; what the source adds is planning (a partition for each few documents), the choice of the language, and rows for
errors: a document that can't be had is a row with an error, never a failed job.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from docweave.session import ship

SCHEMA = "source string, language string, text string, error string"
#: Documents of a partition.
PER_PARTITION = 20


class Transport(Protocol):
    """Where documents come from. It is sent to the tasks, so it must be picklable; what it raises becomes an error row."""

    def sources(self) -> Sequence[str]:
        """All documents there are, in the order in which they came; later calls may have more."""

    def languages(self, source: str) -> Sequence[str]:
        """The languages a document is there in, the original first."""

    def text(self, source: str, language: str) -> str: ...


def choose(there: Sequence[str], wanted: Sequence[str]) -> str:
    """The first language wanted that is there, also by its main part (`zh` for `zh-TW` and the other way); else the first there is."""
    for match in (lambda a, b: a == b, lambda a, b: a.split("-")[0] == b.split("-")[0]):
        for w in wanted:
            for t in there:
                if match(t.lower(), w.lower()):
                    return t
    if not there:
        raise LookupError("no transcript")
    return there[0]


@dataclass
class Part(InputPartition):
    sources: tuple[str, ...]


class _Reading:
    def __init__(self, transport: Transport, options: dict):
        self.transport = transport
        self.wanted = [x.strip() for x in options.get("languages", "").split(",") if x.strip()]
        self.size = int(options.get("perPartition", PER_PARTITION))

    def parts(self, sources: Sequence[str]) -> list[Part]:
        return [Part(tuple(sources[i : i + self.size])) for i in range(0, len(sources), self.size)]

    def read(self, part: Part) -> Iterator[tuple]:
        for source in part.sources:
            try:
                language = choose(self.transport.languages(source), self.wanted)
                yield source, language, self.transport.text(source, language), None
            except Exception as e:  # whatever a transport raises
                yield source, None, None, f"{type(e).__name__}: {e}"


class _Batch(_Reading, DataSourceReader):
    def partitions(self) -> list[Part]:
        return self.parts(list(self.transport.sources()))


class _Stream(_Reading, DataSourceStreamReader):
    """The offset is the number of documents seen."""

    def initialOffset(self) -> dict:
        return {"seen": 0}

    def latestOffset(self) -> dict:
        return {"seen": len(self.transport.sources())}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return self.parts(list(self.transport.sources())[start["seen"] : end["seen"]])


def register(spark: SparkSession, transport: Transport, name: str = "transcripts") -> None:
    """Makes spark.read.format(name) and spark.readStream.format(name) read from the transport. Options: languages (wanted ones, best first, with commas), perPartition."""

    class Transcripts(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return _Batch(transport, self.options)

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _Stream(transport, self.options)

    ship(spark)
    spark.dataSource.register(Transcripts)
