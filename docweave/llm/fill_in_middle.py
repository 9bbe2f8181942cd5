"""Fill-in-the-middle transformation by rotations in place.

A text is cut at two unit boundaries into prefix, middle and suffix. Its bytes and
three sentinels, each before its segment, are laid out in one bytearray in the
order of the text, and two neighbouring blocks of it are exchanged by three
reversals. A rotation has an inverse of the same kind, so the text comes back
exactly: the blocks are turned back, then the sentinels are taken out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, short_batches

#: Sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Percent of the texts that are transformed, and of these percent in the order suffix, prefix, middle.
RATE, SPM_RATE = 50, 80

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def unit_ends(text: bytes) -> np.ndarray:
    """Byte offsets at which units end: a unit is blanks and the visible run after them, or the blanks at the text's end."""
    blank = _BLANK[np.frombuffer(text, np.uint8)]
    ends = np.flatnonzero(~blank & np.append(blank[1:], True)[: len(blank)]) + 1
    return np.append(ends, len(text)) if len(text) and blank[-1] else ends


def n_chars(text: bytes | bytearray) -> int:
    """Code points of UTF-8: the bytes that don't continue one."""
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def rotate(buffer: bytearray, start: int, at: int, end: int) -> None:
    """Exchanges the blocks [start, at) and [at, end) of the buffer, by three reversals in place."""
    view = np.frombuffer(buffer, np.uint8)
    for a, b in ((start, at), (at, end), (start, end)):
        half = (b - a) // 2
        left, right = view[a : a + half], view[b - half : b][::-1]
        left ^= right  # three times exclusive or: the halves change places without a copy
        right ^= left
        left ^= right


def draw(key: str, seed: int) -> list[int]:
    """Four numbers from a digest of seed and key, the same in every run."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def transform(text: bytes, key: str, seed: int = 42) -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, code points of prefix and of middle (None for a plain text), and the text in its new order."""
    ends = unit_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = draw(key, seed)
    if not text or h3 % 100 >= RATE or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (int(ends[k - 1]) if k else 0 for k in (first, second))
    buffer = bytearray(text)
    buffer[b:b] = SUFFIX  # from the back, so that the offsets before stay right
    buffer[a:a] = MIDDLE
    buffer[0:0] = PREFIX
    middle, suffix = len(PREFIX) + a, len(PREFIX) + len(MIDDLE) + b
    form = "spm" if h4 % 100 < SPM_RATE else "psm"
    if form == "psm":
        rotate(buffer, middle, suffix, len(buffer))  # <M>middle and <S>suffix change places
    else:
        rotate(buffer, 0, suffix, len(buffer))  # <P>prefix<M>middle and <S>suffix
    return n, form, n_chars(text[:a]), n_chars(text[a:b]), bytes(buffer)


def restore(output: bytes, form: str) -> bytes:
    """The text of an output: sentinels, each there once, tell the blocks, which are turned back."""
    if form == "plain":
        return output
    buffer = bytearray(output)
    if form == "psm":
        suffix, middle = buffer.index(SUFFIX), buffer.index(MIDDLE)
        rotate(buffer, suffix, middle, len(buffer))
    elif form == "spm":
        rotate(buffer, 0, buffer.index(PREFIX), len(buffer))
    else:
        raise ValueError(f"unknown form {form!r}")
    for sentinel in (SUFFIX, MIDDLE, PREFIX):
        at = buffer.index(sentinel)
        del buffer[at : at + len(sentinel)]
    return bytes(buffer)


def _strings(values: list[bytes]) -> pa.Array:
    """Bytes of texts as a string column, whether or not they are proper UTF-8."""
    return pa.array(values, pa.binary()).view(pa.string())


def _bytes(batch: pa.RecordBatch, i: int) -> list[bytes]:
    return [t or b"" for t in batch.column(i).cast(pa.binary()).to_pylist()]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """id, n (units), form (plain, psm or spm), prefix_chars, middle_chars and output of each row of docs.

    The cut points and the form come from a digest of the id alone, so reruns and other partitions agree; rows that repeat an id draw alike, and a null id
    counts as the empty text. A null or empty text, and one that holds a sentinel, stays plain (output: the text, never null). Texts of any length are
    worked on whole; repeated rows are given each; an empty table gives no rows; other columns are left out, whatever their names.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.col(text_col).cast("string").alias("text"))

    def start():
        def work(batch: pa.RecordBatch) -> dict:
            out = [transform(t, k, seed) for k, t in zip(batch.column(1).to_pylist(), _bytes(batch, 2), strict=True)]
            return {c: [r[i] for r in out] for i, c in enumerate(("n", "form", "prefix_chars", "middle_chars"))} | {"id": batch.column(0), "output": _strings([r[4] for r in out])}

        return work

    return arrow_map(rows, f"id {rows.schema['id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string", start).withColumnRenamed("id", id_col)


def restored(transformed: DataFrame, output_col: str = "output", form_col: str = "form", into: str = "restored") -> DataFrame:
    """transformed with the text before the transformation in the column `into`, worked out from output and form alone. A null output is an empty text."""
    short_batches(transformed.sparkSession)
    names = [c for c in transformed.columns if c != into]
    rows = transformed.select(*names)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", `{into}` string"
    output, form = names.index(output_col), names.index(form_col)

    def start():
        def work(batch: pa.RecordBatch) -> dict:
            back = [restore(t, f or "plain") for t, f in zip(_bytes(batch, output), batch.column(form).to_pylist(), strict=True)]
            return {c: batch.column(i) for i, c in enumerate(names)} | {into: _strings(back)}

        return work

    return arrow_map(rows, kind, start)
