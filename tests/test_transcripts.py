import json
from pathlib import Path

import pytest

from docweave.sources import transcripts
from docweave.sources.transcripts import choose


def transport(path):
    """A transport over files: NAME.json holds texts by language. Its class is local, so that it goes to the tasks by value."""

    class Folder:
        def sources(self):
            return sorted(p.stem for p in Path(path).glob("*.json"))

        def _all(self, source):
            return json.loads((Path(path) / f"{source}.json").read_text())

        def languages(self, source):
            return list(self._all(source))

        def text(self, source, language):
            return self._all(source)[language]

    return Folder()


def put(path, source, texts):
    (path / f"{source}.json").write_text(texts if isinstance(texts, str) else json.dumps(texts))


@pytest.mark.parametrize("there,wanted,want", [(["en", "zh-TW"], ["zh-TW", "en"], "zh-TW"), (["en", "zh"], ["fr", "zh-TW"], "zh"), (["en-GB", "de"], ["en"], "en-GB"), (["de", "fr"], ["ja"], "de"), (["de", "en"], [], "de")])
def test_languages(there, wanted, want):
    assert choose(there, wanted) == want
    with pytest.raises(LookupError):
        choose([], wanted)


def test_batch_and_stream_read_all_and_give_rows_for_errors(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder, "a", {"en": "hello", "de": "hallo"})
    put(folder, "b", "no json")
    put(folder, "c", {})
    put(folder, "d", {"fr": "salut"})
    transcripts.register(spark, transport(str(folder)), "folder")
    rows = spark.read.format("folder").option("languages", "de,en").option("perPartition", 3).load()
    got = {r.source: (r.language, r.text, (r.error or "").split(":")[0]) for r in rows.collect()}
    assert got == {"a": ("de", "hallo", ""), "b": (None, None, "JSONDecodeError"), "c": (None, None, "LookupError"), "d": ("fr", "salut", "")}
    assert rows.rdd.getNumPartitions() == 2

    def run():
        stream = spark.readStream.format("folder").option("languages", "en").load()
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.source, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [("a", "hello"), ("b", None), ("c", None), ("d", "salut")]
    put(folder, "e", {"en": "later"})
    assert run() == [("a", "hello"), ("b", None), ("c", None), ("d", "salut"), ("e", "later")]  # what was read isn't read again
