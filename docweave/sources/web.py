"""Web pages: main text out of HTML, with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of a page that never hold its main text (fixed values).
DROPPED = ("script", "style", "nav", "header", "footer", "aside", "noscript", "form")


def main_text(html: Column) -> Column:
    """The text of the page's article (or body, or all of it) without markup, blanks collapsed; null for null."""
    bare = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in DROPPED:
        bare = F.regexp_replace(bare, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    article = F.regexp_extract(bare, r"(?is)<article\b[^>]*>(.*)</article>", 1)
    body = F.regexp_extract(bare, r"(?is)<body\b[^>]*>(.*)</body>", 1)
    inner = F.coalesce(F.nullif(article, F.lit("")), F.nullif(body, F.lit("")), bare)
    text = F.regexp_replace(inner, r"(?s)<[^>]*>", " ")
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return F.regexp_replace(F.regexp_replace(text, r"[ \t\r\n]+", " "), "^ | $", "")


def main_markdown(html: Column) -> Column:
    """main_text() with links as [text](address) and tables as Markdown rows, a line each; the plain text of all of the page if that leaves nothing."""
    cell, row = "\u0001", "\u0002"
    linked = F.regexp_replace(html, r"(?is)<a\b[^>]*\bhref\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>", "[$2]($1)")
    rows = F.regexp_replace(F.regexp_replace(linked, r"(?is)</t[dh]>\s*", f" {cell} "), r"(?is)<tr\b[^>]*>", f" {row}{cell} ")
    text = main_text(F.regexp_replace(rows, r"(?is)</tr>\s*", f" {row} "))
    tidy = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r" \]\(", "]("), r"\[ (?=[^\]]*\]\()", "["), f" ?{row} ?(?:{row} ?)*", "\n"), f" ?{cell} ?", " | ")
    lined = F.regexp_replace(F.regexp_replace(tidy, r"(?m)^ \| ", "| "), r"(?m) \| $", " |")
    stripped = F.regexp_replace(lined, r"^\s+|\s+$", "")
    return F.coalesce(F.nullif(stripped, F.lit("")), main_text(F.regexp_replace(html, r"(?is)</?(article|body)\b[^>]*>", " ")))


def page_document(url: Column, html: Column) -> Column:
    return F.concat(F.lit("--- [網頁連結: "), url, F.lit("] ---\n\n"), main_text(html))
