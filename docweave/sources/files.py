"""Files as documents: a scan of a folder, routed by extension, read in the tasks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.config import DEFAULTS
from docweave.session import ship

#: Extension -> kind of parser (fixed values).
KINDS = {"txt": "text", "md": "text", "pdf": "pdf", "docx": "docx", "doc": "docx", "pptx": "pptx", "ppt": "pptx"} | dict.fromkeys(("mp3", "wav", "m4a", "ogg", "flac", "mp4", "mkv", "webm"), "media")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
#: How far below a row's first shape another may begin and still be in the row (fixed value, a quarter of an inch in EMU).
ROW_TOLERANCE = 228600


def decode(raw: bytes) -> str:
    """UTF-8, else Big5, else CP950 with what doesn't fit left out."""
    for encoding in ("utf-8", "big5"):
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            continue
    return raw.decode("cp950", "ignore")


def markdown_table(rows: list[list[str]]) -> str:
    clean = lambda c: c.replace("\n", "<br>").strip()
    line = lambda cells: "| " + " | ".join(cells) + " |"
    out = [line(map(clean, rows[0])), line("---" for _ in rows[0])] if rows else []
    for row in rows[1:]:
        out.append(line("" if i and row[i - 1] == c else clean(c) for i, c in enumerate(row)))
    return "\n".join(out)


def docx_text(raw: bytes) -> str:
    """Paragraphs and tables in document order."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")).find(f"{_W}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    out = []
    for e in body:
        if e.tag == f"{_W}p" and text(e).strip():
            out.append(text(e))
        elif e.tag == f"{_W}tbl":
            out.append(markdown_table([["\n".join(map(text, c.iter(f"{_W}p"))) for c in r.iter(f"{_W}tc")] for r in e.iter(f"{_W}tr")]))
    return "\n\n".join(out)


def _place(shape: ElementTree.Element) -> tuple[int, int]:
    """(top, left) of a shape; 0 where it isn't given."""
    off = next(shape.iter(f"{_A}off"), None)
    return (0, 0) if off is None else (int(off.get("y", 0)), int(off.get("x", 0)))


def in_reading_order(shapes: list, place: Callable = _place, tolerance: int = ROW_TOLERANCE) -> list:
    """Shapes by rows from the top, a row being what is no further than the tolerance below its first shape, and from the left within."""
    out, anchor = [], None
    for s in sorted(shapes, key=lambda s: place(s)[0]):
        if anchor is None or place(s)[0] - anchor > tolerance:
            out.append([])
            anchor = place(s)[0]
        out[-1].append(s)
    return [s for row in out for s in sorted(row, key=lambda s: place(s)[1])]


def pptx_text(raw: bytes) -> str:
    """A header, the paragraphs and the tables of each slide, in slide order, shapes in reading order."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_A}t"))
    out = []
    for i, name in slides:
        parts = [f"--- [Slide {i}] ---"]
        for shape in in_reading_order([e for tree in ElementTree.fromstring(z.read(name)).iter(f"{_P}spTree") for e in tree if e.tag in (f"{_P}sp", f"{_P}graphicFrame", f"{_P}grpSp")]):
            if tables := list(shape.iter(f"{_A}tbl")):
                parts += [markdown_table([["\n".join(map(text, c.iter(f"{_A}p"))) for c in r.iter(f"{_A}tc")] for r in t.iter(f"{_A}tr")]) for t in tables]
            else:
                parts += [p for p in map(text, shape.iter(f"{_A}p")) if p.strip()]
        out.append("\n".join(parts))
    return "\n\n".join(out)


PARSERS: dict[str, Callable[[bytes], str]] = {"text": decode, "docx": docx_text, "pptx": pptx_text}


def read_files(spark: SparkSession, path: str, parsers: dict[str, Callable[[bytes], str]] | None = None, max_mb: int = DEFAULTS.max_upload_mb) -> DataFrame:
    """path, kind, text and error of each file below path. Files above max_mb (which aren't loaded), kinds without a parser (PDF and media
    need one from outside) and files that don't parse have an error instead of a text."""
    ship(spark)
    use = PARSERS | (parsers or {})
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small, kind = F.col("length") <= max_mb * 1024 * 1024, F.coalesce(kinds[suffix], F.lit("unsupported")).alias("kind")
    files = every.where(small)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for p, kind, raw in zip(f["path"], f["kind"], f["content"], strict=True):
                text = error = None
                if kind not in use:
                    error = f"no parser for {kind}"
                else:
                    try:
                        text = use[kind](bytes(raw))
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                out.append((p, kind, text, error))
            yield pd.DataFrame(out, columns=["path", "kind", "text", "error"])

    large = every.where(~small).select("path", kind, F.lit(None).cast("string").alias("text"), F.lit(f"larger than {max_mb} MB").alias("error"))
    return files.select("path", kind, "content").mapInPandas(run, "path string, kind string, text string, error string").unionByName(large)


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """path and text of UTF-8 text files, read by Spark alone."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
