"""Entity names within documents: alias registries, mentions, edit ratios. Across documents: resolution.py."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.config import ENTITY_LABELS
from docweave.functions.text import code_mentions
from docweave.operators.folds import fold_rows


class Registry:
    """Entities of one document, in order of entry: [name, type, counts of its forms, sentences]. A rename puts an entity at the end; one that takes a name
    which another has already leaves that one as it is, and the first in order stands for the name."""

    def __init__(self):
        self.entries: list[list] = []
        self._initials: dict[str, str] = {}

    def __len__(self) -> int:
        return len(self.entries)

    def names(self) -> list[str]:
        return [e[0] for e in self.entries]

    def _match(self, form: str) -> int | None:
        """The place of the first entry with an equal form, one that contains the other, or the initials of a form's words."""
        upper, initials = form.upper(), self._initials
        for i, (_, _, forms, _) in enumerate(self.entries):
            if form in forms:
                return i
            for known in forms:
                if form in known or known in form or initials[known] == upper:
                    return i
        return None

    def _count(self, entry: list, form: str) -> None:
        entry[2][form] = entry[2].get(form, 0) + 1
        self._initials.setdefault(form, "".join(w[0] for w in form.split()).upper())

    def rows(self) -> list[tuple]:
        """What the registry knows, in order: position, name, type, counts of forms, first sentence, sentences."""
        return [(i, name, kind, dict(forms), at[0] if at else 0, list(at)) for i, (name, kind, forms, at) in enumerate(self.entries)]

    @classmethod
    def restored(cls, rows: list[tuple]) -> Registry:
        out = cls()
        for _, name, kind, forms, _, at in sorted(rows, key=lambda r: r[0]):
            out.entries.append([name, kind, {}, list(at)])
            for form, n in ({name: 0} | dict(forms)).items():
                out._count(out.entries[-1], form)
                out.entries[-1][2][form] = n
        return out

    def resolve(self, at: int, form: str, kind: str, ask: Callable[[str, list[str]], str | None] | None = None) -> str:
        """The name that stands for a form from now on. `ask` is put a form that no rule matches, and all names; an answer that is no name means a new entity."""
        form = form.strip()
        if not form:
            raise ValueError("a mention is blank")
        i = self._match(form)
        if i is None and ask is not None and self.entries:
            answer = ask(form, self.names())
            i = self.names().index(answer) if answer in self.names() else None
        if i is None:
            self.entries.append([form, kind, {}, []])
        entry = self.entries[-1 if i is None else i]
        self._count(entry, form)
        entry[3].append(at)
        name, _, forms, _ = entry
        if (len(form), forms[form]) > (len(name), forms.get(name, 0)) and form != name:  # longer, or as long and more frequent
            del self.entries[i]
            self.entries.append([form, *entry[1:]])  # at the end
            return form
        return name


_KNOWN = "position int, name string, entity_type string, forms map<string,int>, first_seen int, occurrences array<int>"


def registries(mentions: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The registry of each document after all its sentences (as in apply_registry()), a row for each name: doc, position, name, entity_type, counts
    of its forms, the sentence it was first seen in, and all its sentences. To be stored, and to go on from."""

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        names = Registry()
        for r in g.sort_values("sentence_idx").itertuples():
            for form in r.forms if r.forms is not None else ():
                names.resolve(r.sentence_idx, form, "概念")
        return pd.DataFrame([(getattr(r, doc), *row) for row in names.rows()], columns=[doc, "position", "name", "entity_type", "forms", "first_seen", "occurrences"])

    return mentions.select(doc, "sentence_idx", "forms").groupBy(doc).applyInPandas(fold, f"{doc} {mentions.schema[doc].dataType.simpleString()}, {_KNOWN}")


def resume_registry(mentions: DataFrame, known: DataFrame, doc: str = "doc_id") -> DataFrame:
    """apply_registry() for sentences that follow those from which `known` (see registries()) was made."""
    kind = mentions.schema[doc].dataType.simpleString()

    def fold(key, g: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        rows = [(r.position, r.name, r.entity_type, dict(r.forms), r.first_seen, [int(x) for x in r.occurrences]) for r in before.itertuples(index=False)]
        names = Registry.restored(rows)
        return pd.DataFrame([_applied(names, r, doc) for r in g.sort_values("sentence_idx").itertuples()], columns=[doc, "sentence_idx", "sentence", "n_names"])

    rows = mentions.select(doc, "sentence_idx", "sentence", "forms")
    return rows.groupBy(doc).cogroup(known.groupBy(doc)).applyInPandas(fold, f"{doc} {kind}, sentence_idx int, sentence string, n_names int")


def _applied(names: Registry, r, doc: str, ask: Callable | None = None) -> tuple:
    sentence = r.sentence
    for form in r.forms if r.forms is not None else ():
        name = names.resolve(r.sentence_idx, form, "概念", ask)
        if name != form:
            sentence = sentence.replace(form, name)
    return getattr(r, doc), r.sentence_idx, sentence, len(names)


def apply_registry(mentions: DataFrame, doc: str = "doc_id", ask: Callable[[str, list[str]], str | None] | None = None) -> DataFrame:
    """Each sentence (doc, sentence_idx, sentence, forms: array<string>) with its forms replaced by the names known at that point.

    Sentences of one document are one ordered fold; documents are independent. ask: see Registry.resolve().
    """
    kind = mentions.schema[doc].dataType.simpleString()
    rows = mentions.select(doc, "sentence_idx", "sentence", "forms")
    return fold_rows(rows, doc, "sentence_idx", Registry, lambda names, r: _applied(names, r, doc, ask), f"{doc} {kind}, sentence_idx int, sentence string, n_names int")


def edit_ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp similarity, which isn't symmetric."""
    return SequenceMatcher(None, a, b).ratio()


def edit_ratios(pairs: DataFrame, a: str, b: str, name: str = "ratio") -> DataFrame:
    """pairs with the edit ratio of two columns; null with a null."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if i is None or j is None else edit_ratio(i, j) for i, j in zip(x, y, strict=True)], dtype="float64")

    return pairs.withColumn(name, ratio(a, b))


def entity_type(label: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in ENTITY_LABELS.items() for x in kv])[label], F.lit("概念"))


def mentions_of(sentence: Column, tagged: Column) -> Column:
    """Tagged mentions (array of struct(text, entity_type)), then code mentions, each text once, in that order."""
    codes = F.transform(code_mentions(sentence), lambda t: F.struct(t.alias("text"), F.lit("概念").alias("entity_type")))
    every = F.concat(tagged, codes)
    texts = F.transform(every, lambda m: m["text"])
    return F.filter(every, lambda m, i: F.array_position(texts, m["text"]) == i + 1)
