"""Text expressions: splitting, chunking, windows, detection. All of them are built-in Spark expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.config import DEFAULTS, PRONOUNS

#: Where a sentence ends (fixed pattern): after an ideographic mark or line end, or after . ? ! and white space, unless an
#: abbreviation, a capital or a digit stands before it.
SENTENCE_END = r"(?<![A-Z][a-z])(?<![A-Z])(?<!e\.g)(?<!i\.e)(?<!vs)(?<!\d)([。！？；…\n]|\.\s|\?\s|!\s)"
#: Marks the ends while a text is split; where a text holds it, it is written as ESCAPE and another mark meanwhile.
_MARK, _ESCAPE, _ESCAPED = "\u0001", "\u0002", ("\u0003", "\u0004")


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    """Array of sentences, delimiters and spaces kept: joined they are the text. Empty for an empty text, null for null."""
    split = lambda t: F.filter(F.split(F.regexp_replace(t, f"(?U){SENTENCE_END}", f"$1{_MARK}"), _MARK), lambda s: s != "")
    safe = F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + _ESCAPED[0])), F.lit(_MARK), F.lit(_ESCAPE + _ESCAPED[1]))
    back = lambda s: F.replace(F.replace(s, F.lit(_ESCAPE + _ESCAPED[1]), F.lit(_MARK)), F.lit(_ESCAPE + _ESCAPED[0]), F.lit(_ESCAPE))
    return F.when(text.rlike(f"[{_MARK}{_ESCAPE}]"), F.transform(split(safe), back)).otherwise(split(text))


def clean_sentences(parts: Column) -> Column:
    """Stripped sentences without the blank ones."""
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def chunks(parts: Column, size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap) -> Column:
    """Chunks of whole sentences. A sentence of `size` characters or more stands alone; a chunk that would pass `size` is
    closed, and the next begins with its last sentences of at most `overlap` characters together.

    The fold over the sentences carries places and lengths only: `a` is where the open chunk begins, `i` the sentence at hand (from 1), `n` the open
    chunk's length, `cuts` where closed chunks begin and how many sentences they have.
    """

    def fold(lengths: Column) -> Column:
        def kept(a: Column, i: Column) -> Column:
            """Sentences before i, back to a at most, that fit the overlap, and their length."""
            start = F.struct(F.lit(0).alias("k"), F.lit(0).alias("n"), F.lit(True).alias("more"))

            def take(s: Column, n: Column) -> Column:
                fits = s["more"] & (s["n"] + n <= overlap)
                return F.struct((s["k"] + fits.cast("int")).alias("k"), F.when(fits, s["n"] + n).otherwise(s["n"]).alias("n"), fits.alias("more"))

            return F.aggregate(F.reverse(F.slice(lengths, F.greatest(a, i - (overlap + 1)), i - F.greatest(a, i - (overlap + 1)))), start, take)

        def step(s: Column, n: Column) -> Column:
            i, alone, full = s["i"], n >= size, s["n"] + n > size
            own = F.array(F.struct(s["a"].alias("a"), (i - s["a"]).alias("k")))
            closed = F.when((alone | full) & (i > s["a"]), F.concat(s["cuts"], own)).otherwise(s["cuts"])
            cuts = F.when(alone, F.concat(closed, F.array(F.struct(i.alias("a"), F.lit(1).alias("k"))))).otherwise(closed)
            back = F.when(full & ~alone, kept(s["a"], i))
            return F.transform(
                F.array(back),
                lambda k: F.struct(
                    (i + 1).alias("i"), F.when(alone, i + 1).when(full, i - k["k"]).otherwise(s["a"]).alias("a"),
                    F.when(alone, F.lit(0)).when(full, k["n"] + n).otherwise(s["n"] + n).alias("n"), cuts.alias("cuts")),
            )[0]

        first = F.struct(F.lit(1).alias("i"), F.lit(1).alias("a"), F.lit(0).alias("n"), F.array().cast("array<struct<a:int,k:int>>").alias("cuts"))
        last = lambda s: F.when(s["i"] > s["a"], F.concat(s["cuts"], F.array(F.struct(s["a"].alias("a"), (s["i"] - s["a"]).alias("k"))))).otherwise(s["cuts"])
        return F.aggregate(lengths, first, step, last)

    def cut(p: Column) -> Column:
        found = _bound(F.transform(p, lambda s: F.length(s)), fold)
        return F.filter(F.transform(found, lambda c: strip(F.array_join(F.slice(p, c["a"], c["k"]), ""))), lambda c: c != "")

    return _bound(parts, cut)


def _total(n: Column, size: int, overlap: int) -> Column:
    """The number of windows over n sentences, at least one."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap smaller than size")
    return F.greatest(F.ceil((n - size) / (size - overlap)), F.lit(0)).cast("int") + 1


def window_count(parts: Column, size: int = DEFAULTS.window_sentences, overlap: int = DEFAULTS.window_overlap) -> Column:
    """How many windows() there are, without making them; 0 for null."""
    return _bound(F.size(parts), lambda n: F.when(n > 0, _total(n, size, overlap)).otherwise(0))


def windows(parts: Column, size: int = DEFAULTS.window_sentences, overlap: int = DEFAULTS.window_overlap) -> Column:
    """Overlapping windows of sentences: array of struct(chunk_index, total, sentence_start, sentence_end, sentences), from 1, ends included.
    The last window is the first that reaches the last sentence; no sentences, no windows."""
    step, n = size - overlap, F.size(parts)
    total = _total(n, size, overlap)
    at = F.sequence(F.lit(0), total - 1)
    made = F.transform(
        at,
        lambda i: F.struct(
            (i + 1).alias("chunk_index"), total.alias("total"), (i * step + 1).alias("sentence_start"),
            F.least(i * step + size, n).alias("sentence_end"), F.slice(parts, i * step + 1, F.lit(size)).alias("sentences"),
        ),
    )
    return F.when(n > 0, made).otherwise(F.slice(made, 1, 0))


def low_quality(text: Column) -> Column:
    """Blank, shorter than 80 characters, or less than 60 % of ideographs, ASCII letters and digits."""
    clean = strip(F.coalesce(text, F.lit("")))
    readable = F.regexp_count(clean, F.lit("[一-龥a-zA-Z0-9]"))
    return (F.length(clean) < 80) | (readable / F.length(clean) < 0.6)


def has_pronoun(sentence: Column, lexicon: tuple[str, ...] = PRONOUNS) -> Column:
    """Whether a sentence holds a word of the lexicon, each taken literally."""
    return sentence.rlike("|".join("\\Q" + w.replace("\\E", "\\E\\\\E\\Q") + "\\E" for w in lexicon))


def code_mentions(sentence: Column) -> Column:
    """Mentions such as I-35: one to five capitals, a hyphen or dash, a digit and more word characters."""
    return F.regexp_extract_all(sentence, F.lit(r"(?U)(\b[A-Z]{1,5}[\-‐-―]\d[\w\-]*\b)"), 1)


def concept_tokens(body: Column) -> Column:
    """Runs of two or more ideographs or ASCII letters."""
    return F.regexp_extract_all(body, F.lit("([一-鿿A-Za-z]{2,})"), 1)


def safe_stem(source: Column, longest: int = 80) -> Column:
    """A name for files from a path (its last part without the extension) or URL. Characters that give way, the length and the default are fixed values."""
    url = source.startswith("http://") | source.startswith("https://")
    last = F.regexp_extract(source, r"([^/\\]*)[/\\]*$", 1)
    bare = F.when(last.rlike(r"^\.*[^.].*\.[^.]*$"), F.regexp_replace(last, r"(.)\.[^.]*$", "$1")).otherwise(last)
    stem = F.when(url, source).otherwise(F.coalesce(F.nullif(bare, F.lit("")), source))
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace(stem, r'[\\/:*?"<>|]', "_"), r"(?U)\s+", "_"), "^_+|_+$", "")
    return F.left(F.coalesce(F.nullif(safe, F.lit("")), F.lit("untitled")), F.lit(longest))


def chunk_filename(index: Column, total: Column, prefix: str = "chunk") -> Column:
    """chunk-0001-of-1234.md: both numbers as wide as the total, three digits at least."""
    width = F.greatest(F.lit(3), F.length(total.cast("string")))
    pad = lambda c: F.lpad(c.cast("string"), width, F.lit("0"))
    return F.concat(F.lit(f"{prefix}-"), pad(index), F.lit("-of-"), pad(total), F.lit(".md"))


def front_matter(**fields: Column) -> Column:
    """A front-matter block; text values are quoted, with backslashes and quotes escaped."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    lines = [F.concat(F.lit(f"{k}: "), quoted(v) if k == "source" else v.cast("string")) for k, v in fields.items()]
    return F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"))


def without_front_matter(file: Column) -> Column:
    return F.regexp_replace(file, r"(?s)^---\n.*?\n---\n\n?", "")


def table_markdown(rows: Column) -> Column:
    """Markdown of array<array<string>>: a header, a rule, and body rows in which a cell equal to the one before it is empty (a merged cell)."""
    cell = lambda c: strip(F.replace(c, F.lit("\n"), F.lit("<br>")))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    head = line(F.transform(rows[0], cell))
    rule = line(F.transform(rows[0], lambda c: F.lit("---")))
    body = F.transform(
        F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))),
        lambda r: line(F.transform(r, lambda c, i: F.when((i > 0) & (F.get(r, F.greatest(i - 1, F.lit(0))) == c), F.lit("")).otherwise(cell(c)))),
    )
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(head, rule), body), "\n")).otherwise(F.lit(""))


def is_youtube(url: Column) -> Column:
    return url.rlike(r"(?i)^(https?://)?(www\.)?(youtube\.com|youtu\.be)/")


def youtube_id(url: Column) -> Column:
    """The first of four forms that fits (fixed patterns); null if none does."""
    forms = (r"v=([^&#]+)", r"youtu\.be/([^&#\?]+)", r"embed/([^&#\?]+)", r"shorts/([^&#\?]+)")
    return F.coalesce(*[F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in forms])


def url_kind(url: Column) -> Column:
    """youtube or web; a blank URL is an error."""
    return F.when(strip(F.coalesce(url, F.lit(""))) == "", F.lit("error")).when(is_youtube(url), F.lit("youtube")).otherwise(F.lit("web"))


def naming_reply(raw: Column) -> tuple[Column, Column]:
    """Name and description out of a model's reply; the name falls back to a default. The markers of the lines and the default are fixed texts."""
    last = lambda p: F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(raw, F.lit(p), 1)), -1)
    name = strip(last(r"(?m)^\s*(?:名稱|名称)：(.*)$"))
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("新知識庫")), strip(last(r"(?m)^\s*描述：(.*)$"))
