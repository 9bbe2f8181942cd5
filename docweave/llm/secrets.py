"""Secrets in texts: known forms by pattern, unknown ones by how badly they tokenize.

A byte-pair vocabulary writes language in few tokens and random strings in many. A
run of key-like characters whose characters-per-token ratio is low under all vocabularies, and that is neither
a digest of a usual length nor an identifier, is reported as `random`, beside the spans of known forms. A second vocabulary, of other
languages, keeps long words of these apart; a run that touches a letter outside ASCII is a piece of a word and isn't tested.
What isn't tested either is cut out of a run: digests (hexadecimal runs of their lengths, in one case of letters), UUIDs, known forms, hosts and e-mail
addresses. What remains is tested as a whole, then by its parts between `/` and `=`, then between `-`. Runs of
digits alone are numbers, not keys, and few have a ratio as low; runs below SHORTEST characters, or SHORTEST_WORD letters of one case, can't be told from words.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, held, short_batches, texts_of

#: Order of kinds that begin at one place.
KINDS = ("assign", "access", "hex", "random")
#: Shortest run that is tested, and the ratio below which a run of that length and more looks random (the largest ratio of all vocabularies counts).
RATIOS = {16: 1.81, 20: 2.01}
SHORTEST = min(RATIOS)
#: Shortest run of letters in one case, but for a capital: below, too many words of inflected languages tokenize as badly.
SHORTEST_WORD = 20

_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
_LETTER = re.compile(r"[^\W\d_]")
_LONG = re.compile(r"[^ \t-\r]{16,}")
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
_ADDRESS = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://(?P<user>[^/?#@\s]*@)?(?P<rest>[^/?#\s]*)")
_EMAIL = re.compile(r"(?P<before>[A-Za-z0-9._%-]+:)?[A-Za-z0-9._%+-]+@(?P<host>[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)")
#: Cuts between the parts of a run; padding stays with its part.
_CUTS = (re.compile(r"/+|=+(?=[^=])"), re.compile(r"-+"))
#: Hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 digests.
_DIGESTS = (32, 40, 56, 64, 96, 128)
_DIGEST = re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])")


class RandomTest:
    def __init__(self, ranks_paths: tuple[str, ...], pattern: str):
        import tiktoken

        self.encodings = []
        for i, path in enumerate(ranks_paths):
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.encodings.append(tiktoken.Encoding(f"secrets-{i}", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}))

    def looks_random(self, run: str) -> bool:
        plain = run.isalpha() and (run.islower() or run.isupper() or run.istitle())
        if len(run) < (SHORTEST_WORD if plain else SHORTEST) or not any(c.isalnum() for c in run):
            return False
        if plain:
            run = run.lower()  # words in capitals tokenize worse, random letters don't
        limit = max((n, x) for n, x in RATIOS.items() if n <= len(run))[1]
        return all(len(run) < limit * len(e.encode_ordinary(run)) for e in self.encodings)

    def random_parts(self, text: str, start: int, end: int, cuts: tuple = _CUTS) -> list[tuple[int, int]]:
        """The run itself if it looks random, else those of its parts that do."""
        if end - start < SHORTEST:
            return []
        if self.looks_random(text[start:end]):
            return [(start, end)]
        return [x for s, e in _between(start, end, [m.span() for m in cuts[0].finditer(text, start, end)]) for x in self.random_parts(text, s, e, cuts[1:])] if cuts else []


def _between(start: int, end: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What spans leave of start to end."""
    out = []
    for s, e in sorted(spans):
        if e > start and s < end:
            out.append((start, s))
            start = max(start, e)
    return [(s, e) for s, e in [*out, (start, end)] if s < e]


def _in_word(text: str, start: int, end: int) -> bool:
    """Whether a letter outside ASCII stands right before or after."""
    return any(not c.isascii() and _LETTER.match(c) for c in text[max(0, start - 1) : start] + text[end : end + 1])


def _known_parts(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Hosts, e-mail addresses, UUIDs and digests in one run of characters without blanks. The password of `user:password@host` is none."""
    out, part = [], text[a:b]
    if "://" in part:
        for m in _ADDRESS.finditer(text, a, b):
            out += [(m.start(), m.start("user") if m["user"] else m.start("rest")), m.span("rest")]
    elif "@" in part:
        for m in _EMAIL.finditer(text, a, b):
            out.append(m.span("host") if m["before"] and m["before"].lower() != "mailto:" else m.span())
    if part.count("-") >= 4:
        out += [m.span() for m in _UUID.finditer(text, a, b)]
    out += [m.span() for m in _DIGEST.finditer(text, a, b) if len(m[0]) in _DIGESTS]
    return out


def spans_of(text: str, test: RandomTest | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind; those of known forms first found as leftmost non-overlapping matches of each kind."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    longs = [m.span() for m in _LONG.finditer(text)]
    for a, b in longs:  # the other kinds have no white space and 16 characters at least
        part = text[a:b]
        if "AKIA" in part:
            found += [("access", a + m.start(), a + m.end()) for m in _ACCESS.finditer(part) if len(m[0]) >= 16]
        if b - a >= 32:
            found += [("hex", a + m.start(), a + m.end()) for m in _HEX.finditer(part) if len(m[0]) >= 32]
    if test:
        base = sorted((s, e) for _, s, e in found)
        for a, b in longs:
            known = None
            for m in _RUN.finditer(text, a, b) if b - a >= SHORTEST else ():
                if m.end() - m.start() >= SHORTEST and not _in_word(text, m.start(), m.end()):
                    known = known if known is not None else base + _known_parts(text, a, b)
                    found += [("random", *x) for s, e in _between(*m.span(), known) for x in test.random_parts(text, s, e)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_secrets(docs: DataFrame, ranks_paths: str | tuple[str, ...], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans and n_random for each row of docs.

    spans lists kind:start:end (code points, end exclusive) by start, then kind; base_sha256 is the digest of those without
    `random`. A null or empty text has none, and the digest of the empty string; texts of any length are scanned whole; repeated rows are
    scanned each; an empty table gives no rows; other columns are left out, whatever their names; ids may be null.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def start():
        test = held(RandomTest, (ranks_paths,) if isinstance(ranks_paths, str) else tuple(ranks_paths), pattern)

        def work(batch: pa.RecordBatch) -> dict:
            all_spans = [spans_of(t or "", test) for t in texts_of(batch)]
            base = [[s for s in spans if s[0] != "random"] for spans in all_spans]
            out = {"id": batch.column(0)}
            for kind in KINDS:
                out[f"n_{kind}"] = [sum(s[0] == kind for s in spans) for spans in all_spans]
            return out | {"base_sha256": [hashlib.sha256(joined(s).encode()).hexdigest() for s in base], "spans": list(map(joined, all_spans))}

        return work

    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"
    return arrow_map(rows, schema, start).withColumnRenamed("id", id_col)
