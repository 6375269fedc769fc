"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule is a Boolean expression that is true where a document is to be rejected. `measured` runs every rule over a bounded
sample and takes how often it rejects and how long it takes; `by_gain` puts the rules with the most rejections per cost
first; `cascade` compiles that order into one nested CASE, so that a document leaves at the first rule that rejects it. What
only one rule needs is computed within its branch. The order never changes which documents are kept, only how much is
evaluated.

Defined results: a null text has no words and every count is 0; empty texts likewise. Both fail the base rule, as all
texts under 20 words. Repeated rows are judged one by one and stay. An empty table gives an empty result.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, fresh, words_of

WINDOW = 8
MIN_WORDS = 20
#: Documents looked at to order the rules. The bound is fixed: the order is a matter of speed, never of results.
SAMPLE_ROWS = 1000
#: Runs of a rule over the sample, of which the fastest counts; seconds under which rules are held to be equally cheap.
RUNS, LEAST_SECONDS = 2, 0.002


@dataclass(frozen=True)
class Rule:
    """`rejects(stats, text)` is true for documents to reject; stats gives a count by its name."""

    name: str
    rejects: Callable[[Callable[[str], Column], Column], Column]


def _share(part: Column, percent: int, whole: Column) -> Column:
    return part * 100 > whole * percent


def _count(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


RULES = (
    Rule("symbols", lambda s, t: _share(s("n_symbols"), 10, s("n_words"))),
    Rule("word_length", lambda s, t: (s("word_chars") < s("n_words") * 2) | (s("word_chars") > s("n_words") * 14)),
    Rule("repeated_lines", lambda s, t: _share(s("n_dup_lines"), 50, s("n_lines"))),
    Rule("exclamations", lambda s, t: _share(_count(t, "!"), 50, s("n_words"))),
    Rule("shouting", lambda s, t: _share(_count(t, r"\p{Lu}"), 50, s("word_chars"))),
    Rule("few_letters", lambda s, t: _share(s("word_chars") - _count(t, r"\p{L}"), 50, s("word_chars"))),
    Rule("few_distinct_words", lambda s, t: s("n_distinct_words") * 100 < s("n_words") * 10),
)
#: The parts of the base rule; where its counts are not asked for, they are rules among the others.
BASE = (
    Rule("few_words", lambda s, t: s("n_words") < MIN_WORDS),
    Rule("repeated_words", lambda s, t: _share(s("n_repeat_words"), 30, s("n_words"))),
)
#: Counts that are always made, and of which a report consists.
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """How many words lie in windows of WINDOW words that the text has twice or more; windows are compared by 64 bits."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))

    def twins(order: Column) -> Column:
        same = lambda x, i, by: F.coalesce(x["h"] == F.get(order, i + by)["h"], F.lit(False))
        return F.filter(order, lambda x, i: same(x, i, -1) | same(x, i, 1))

    def covered(starts: Column) -> Column:
        own = F.transform(starts, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(own, F.lit(0), lambda a, b: a + b)

    def count(h: Column) -> Column:
        # only documents with a repeated window sort their windows
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        starts = _let(order, lambda o: F.sort_array(F.transform(twins(o), lambda x: x["i"])))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), _let(starts, covered)).otherwise(F.lit(0))

    return F.when(F.size(words) >= WINDOW, _let(_let(hashed, windows), count)).otherwise(F.lit(0))


def _counts(df: DataFrame, text: str) -> tuple[DataFrame, dict[str, Column], list[str]]:
    """`df` with its words and lines as columns, whose names come last; an expression for each count."""
    words, lines = fresh(df, "words", "lines")
    t = F.col(text)
    has_word = lambda x: F.length(F.btrim(x, F.lit(WS))) > 0
    df = df.withColumn(words, words_of(t)).withColumn(lines, F.filter(F.split(F.coalesce(t, F.lit("")), "\n"), has_word))
    w, ls = F.col(words), F.col(lines)
    counts = {
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": _count(t, "[#*$%&|<>]"),
        "n_lines": F.size(ls),
        "n_dup_lines": F.size(ls) - F.size(F.array_distinct(ls)),
        "n_distinct_words": F.size(F.array_distinct(w)),
        "n_repeat_words": _repeat_words(w),
    }
    return df, {k: c.cast("long") for k, c in counts.items()}, [words, lines]


def measured(df: DataFrame, text: str = "text", rules=RULES, sample_rows: int = SAMPLE_ROWS) -> dict[str, tuple[int, float]]:
    """name -> (rejections, seconds) of each rule over the first `sample_rows` rows; words and lines, which all share, aside."""
    sample, counts, _ = _counts(df.select(text), text)
    n = counts["n_words"] + counts["n_lines"]

    def run(e: Column) -> tuple[int, float]:
        took = []
        for _ in range(RUNS):
            start = time.perf_counter()
            # a limit that is collected reads only as many partitions as it needs
            rows = sample.select(e.alias("x"), n.alias("n")).limit(sample_rows).collect()
            took.append(time.perf_counter() - start)
        return sum(r["x"] for r in rows), min(took)

    base = run(F.lit(0))[1]
    out = {}
    for r in rules:
        hits, took = run(F.coalesce(r.rejects(counts.__getitem__, F.col(text)), F.lit(False)).cast("int"))
        out[r.name] = (hits, max(LEAST_SECONDS, took - base))
    return out


def by_gain(rules, found: dict[str, tuple[int, float]]) -> list[Rule]:
    """The rules by rejections per second, most first; then the cheaper ones first, and by name."""
    return sorted(rules, key=lambda r: (-found[r.name][0] / found[r.name][1], found[r.name][1], r.name))


def cascade_order(df: DataFrame, text: str = "text", rules=RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    return by_gain(rules, measured(df, text, rules, sample_rows))


def _chain(order: list[Rule], counts: Callable[[str], Column], text: Column) -> Column:
    """The first rule that rejects, or null; a later rule is evaluated only where every earlier one lets pass."""
    out = None
    for r in order:
        out = (F if out is None else out).when(r.rejects(counts, text), F.lit(r.name))
    return F.lit(None).cast("string") if out is None else out


def cascade(df: DataFrame, text: str = "text", rules=RULES, order: list[Rule] | None = None) -> tuple[DataFrame, str]:
    """`df` with a struct column of STATS, `base_failed`, `rejected_by` (the first rule, or null) and `kept`; its name."""
    order = cascade_order(df, text, rules) if order is None else order
    columns = df.columns
    out, counts, made = _counts(df, text)
    stats, by, verdict = fresh(out, "stats", "by", "verdict")
    out = out.withColumn(stats, F.struct(*[counts[k].alias(k) for k in STATS]))
    have = lambda k: F.col(stats)[k] if k in STATS else counts[k]
    failed = (have("n_words") < MIN_WORDS) | _share(have("n_repeat_words"), 30, have("n_words"))
    out = out.withColumn(by, F.when(failed, F.lit("base")).otherwise(_chain(order, have, F.col(text))))
    fields = [*[F.col(stats)[k].alias(k) for k in STATS], failed.alias("base_failed"), F.col(by).alias("rejected_by"), F.col(by).isNull().alias("kept")]
    return _fixed(out.select(*[F.col(f"`{c}`") for c in columns], F.struct(*fields).alias(verdict)), verdict), verdict


def _fixed(df: DataFrame, column: str) -> DataFrame:
    """The same rows; a filter on `column` isn't pushed below, where Spark would write its expression out once more for
    every use, but stays above a generated row."""
    (own,) = fresh(df, "fixed")
    rest = [F.col(f"`{c}`") for c in df.columns if c != column]
    return df.select(*rest, F.explode(F.array(F.col(column))).alias(own)).withColumnRenamed(own, column)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass the base rule and every rule of the cascade, with the columns they came with."""
    rules = (*BASE, *RULES)
    order = cascade_order(docs, text, rules)
    out, counts, _ = _counts(docs, text)
    (kept,) = fresh(out, "kept")
    out = out.withColumn(kept, _chain(order, counts.__getitem__, F.col(text)).isNull())
    out = _fixed(out.select(*[F.col(f"`{c}`") for c in docs.columns], kept), kept)
    return out.where(F.col(kept)).drop(kept)


def quality_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    out, v = cascade(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    return out.select("doc_id", *[F.col(v)[k].alias(k) for k in (*STATS, "base_failed", "kept")])
