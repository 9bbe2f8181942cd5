"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes for keeping (1), against (-1) or abstains (0). Expectation-
maximisation estimates how accurate each rule is on good and on bad documents, and how many documents are good,
from the agreement of the rules alone; a document is kept if its posterior probability of
being good is at least one half. The votes of all documents are first
counted by pattern, at most 3 ** rules of them, so that a round of estimation is one small aggregation, whose plan and
code are the same in all rounds. Rounds go on until the estimates stand.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, Scratch

#: Rounds of estimation, at most, and the change of a posterior weight below which they end.
ROUNDS, STILL = 60, 1e-3
#: How votes fall on good and on bad documents, and how many are good, before any are seen. The corpus has the better of it:
#: this counts as much as PRIOR_SHARE of the documents, whatever their number.
PRIOR_GOOD, PRIOR_BAD, PRIOR_CLEAN, PRIOR_SHARE = {1: 0.9, 0: 0.095, -1: 0.005}, {1: 0.4, 0: 0.2, -1: 0.4}, 0.8, 0.05


_BLANKS = "\\x20\\x09-\\x0D"


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts that the rules look at, for each row of docs. A null text counts as empty; other columns are left out.

    Windows of three words are told apart by a 64-bit hash. A bare word has no letter; a table line has two `|` and more.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.filter(F.split(text, WORD_GAP), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike("[^\\x20\\x09-\\x0D]"))
    without = lambda t, chars: F.length(t) - F.length(F.translate(t, chars, ""))
    stage = docs.select(F.col(id_col).alias("id"), text.alias("text"), words.alias("words"), lines.alias("lines"))
    n = F.size("words")
    window = F.transform(F.slice("words", 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    stage = stage.select("*", window.alias("windows"))
    placed = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    stage = stage.select("*", F.when(repeats, F.sort_array(placed)).alias("ordered"))
    # a window is repeated if a neighbour in this order is the same
    again = F.filter("ordered", lambda s, i: (F.get("ordered", i + 1)["h"] == s["h"]) | F.coalesce((i > 0) & (F.get("ordered", F.greatest(i - 1, F.lit(0)))["h"] == s["h"]), F.lit(False)))
    stage = stage.select("*", F.sort_array(F.transform(again, lambda s: s["p"])).alias("places"))
    covered = F.aggregate(
        F.transform("places", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("places", i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    letters = F.length(F.regexp_replace("text", "\\P{L}+", ""))
    capitals = F.length(F.regexp_replace("text", "\\P{Lu}+", ""))
    return stage.select(
        F.col("id").alias(id_col),
        n.cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        without(F.col("text"), "#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct_words"),
        F.regexp_count("text", F.lit(f"(?<![^{_BLANKS}])[^\\p{{L}}{_BLANKS}]+(?![^{_BLANKS}])")).cast("long").alias("n_bare_words"),
        F.size(F.filter("lines", lambda s: s.like("%|%|%"))).cast("long").alias("n_table_lines"),
        letters.cast("long").alias("n_letters"),
        capitals.cast("long").alias("n_capitals"),
    )


def _vote(value: Column, good: Column, bad: Column) -> Column:
    """null (nothing to measure) abstains."""
    return F.when(value.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0).cast("tinyint")


def rules() -> dict[str, Column]:
    """Votes from the columns of measures(). A text without words has nothing to measure but its length; all limits hold at any length."""
    share = lambda a, b: F.col(a) / F.when(F.col(b) > 0, F.col(b))
    mean, symbols, copies, repeats = share("word_chars", "n_words"), share("n_symbols", "n_words"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")
    letters, capitals, bare, tables = share("n_letters", "word_chars"), share("n_capitals", "n_letters"), share("n_bare_words", "n_words"), share("n_table_lines", "n_lines")
    n = F.col("n_words")
    variety = F.when(n > 1, F.log("n_distinct_words") / F.log(n))  # hardly changes with the length of a text
    return {
        "length": _vote(n, n >= 50, n < 50),
        "word_length": _vote(mean, mean.between(3, 10), (mean < 2.5) | (mean > 12)),
        "symbols": _vote(symbols, symbols < 0.05, symbols > 0.1),
        "lines": _vote(copies, copies < 0.1, (copies > 0.3) & (F.col("n_dup_lines") > 2)),
        "repeats": _vote(repeats, repeats < 0.1, repeats > 0.3),
        "letters": _vote(letters, letters > 0.8, letters < 0.65),
        "capitals": _vote(capitals, capitals < 0.15, capitals > 0.4),
        "variety": _vote(variety, variety > 0.8, variety < 0.6),
        "bare_words": _vote(bare, bare < 0.1, bare > 0.2),
        "tables": _vote(tables, tables < 0.1, tables > 0.3),
    }


#: rule -> vote -> (share of good documents with this vote, share of bad ones)
Rates = dict[str, dict[int, tuple[float, float]]]
_VOTES = (-1, 0, 1)


def _log_ratios(rates: Rates) -> list[float]:
    return [log(r[v][0] / r[v][1]) for r in rates.values() for v in _VOTES]


def posterior(rates: Rates, good: float) -> Column:
    """Probability that a document with these votes is good."""
    # one array literal: its values aren't part of the generated code, which all rounds share
    weights = F.lit([log(good / (1 - good)), *_log_ratios(rates)])
    terms = [F.get(weights, F.col(k).cast("int") + (3 * i + 2)) for i, k in enumerate(rates)]
    return 1 / (1 + F.exp(-sum(terms, F.get(weights, F.lit(0)))))


def estimate(patterns: DataFrame, names: list[str], rounds: int = ROUNDS) -> tuple[Rates, float]:
    """How often each rule casts each vote on good and on bad documents, and the share of good ones, from pattern counts (columns:
    names and n). A rule can be reliable in one way only: its votes against may weigh more than its votes for."""
    rates, good = {k: {v: (PRIOR_GOOD[v], PRIOR_BAD[v]) for v in _VOTES} for k in names}, PRIOR_CLEAN
    codes = F.explode(F.array(F.lit(-1), *[F.col(k).cast("int") + (3 * i + 1) for i, k in enumerate(names)]))
    for _ in range(rounds):
        judged = patterns.select("n", posterior(rates, good).alias("q"), codes.alias("code"))
        sums = {r["code"]: (r["good"], r["bad"]) for r in judged.groupBy("code").agg(F.sum(F.col("n") * F.col("q")).alias("good"), F.sum(F.col("n") * (1 - F.col("q"))).alias("bad")).collect()}
        if not sums:
            break
        n_good, n_bad = sums[-1]
        own = PRIOR_SHARE * (n_good + n_bad)
        before = _log_ratios(rates)
        share = lambda x, all_, prior: (x + own * prior) / (all_ + own)  # noqa: B023, E731
        seen = lambda i, v: sums.get(3 * i + 1 + v, (0.0, 0.0))  # noqa: B023, E731
        rates = {k: {v: (share(seen(i, v)[0], n_good, PRIOR_GOOD[v]), share(seen(i, v)[1], n_bad, PRIOR_BAD[v])) for v in _VOTES} for i, k in enumerate(names)}
        good = (n_good + own * PRIOR_CLEAN) / (n_good + n_bad + own)
        if max(abs(a - b) for a, b in zip(before, _log_ratios(rates), strict=True)) < STILL:
            break
    return rates, good


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of measures(), a vote_* column for each rule, base_failed, quality (posterior probability) and kept.

    A row with fewer than 50 words, or more than half of them in repeated windows of three words, fails the base and isn't kept.
    A null text counts as empty; texts of any length are measured whole; repeated rows are judged each, and equally; ids may be null;
    an empty table gives no rows; other columns are left out, whatever their names.
    """
    scratch, votes = Scratch(docs.sparkSession, "rules"), rules()
    names = [f"vote_{k}" for k in votes]
    measured = scratch.keep(measures(docs, id_col, text_col).select("*", *[v.alias(f"vote_{k}") for k, v in votes.items()]), "measures")
    patterns = scratch.keep(measured.groupBy(*names).agg(F.count("*").alias("n")).coalesce(1), "patterns")
    rates, good = estimate(patterns, names)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    quality = posterior(rates, good)
    return measured.select("*", failed.alias("base_failed"), quality.alias("quality"), (~failed & (quality >= 0.5)).alias("kept"))
