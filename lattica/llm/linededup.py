"""Line dedup over overlapping windows of three lines, in DataFrame expressions only.

Lines are what `\\n` separates; lines without a word belong to no window and always stay. Three consecutive lines with
words, white space at their ends aside, form a window; windows overlap. Of equal windows anywhere in the corpus the
first (smallest doc_id, then position) stays and every later one is removed: a line goes if any removed window covers it.

Only hashes and positions are shuffled to find the repeats: the windows' first occurrences are pre-aggregated before
the shuffle, and the join back to the occurrences may be split by Spark where one window is very frequent. Texts are
shuffled once, by document, to take the lines out.

Defined results: a null text stays null; texts with fewer than three lines never change; rows that repeat a doc_id and
its text count as one document and change alike; a null doc_id orders before all others. Windows are compared by 128
bits of hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, fresh

WINDOW = 3


def _lines(text):
    """Lines with words: their trimmed text and their place among all lines."""
    parts = F.transform(F.split(text, "\n"), lambda x, i: F.struct(F.btrim(x, F.lit(WS)).alias("l"), i.alias("i")))
    return F.filter(parts, lambda x: F.length(x["l"]) > 0)


def line_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, th, j, h1, h2): the j-th window of a document, hashed twice; th tells texts under one id apart."""
    t = F.col(text)
    rows = docs.where(t.isNotNull()).select(F.col(doc_id).alias("id"), F.xxhash64(t).alias("th"), _lines(t).alias("ls"))
    rows = rows.where(F.size("ls") >= WINDOW)

    def hashed(j):
        three = [F.get("ls", j + k)["l"] for k in range(WINDOW)]
        return F.struct(F.xxhash64(*three).alias("h1"), F.xxhash64(F.lit(7), *three).alias("h2"))

    each = F.transform(F.sequence(F.lit(0), F.size("ls") - WINDOW), hashed)
    return rows.select("id", "th", F.posexplode(each).alias("j", "h")).select("id", "th", "j", "h.h1", "h.h2")


def later_windows(windows: DataFrame) -> DataFrame:
    """(id, th, starts): each document's windows that have occurred before."""
    first = (
        windows.groupBy("h1", "h2")
        .agg(F.min(F.struct("id", "th", "j")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )
    again = windows.join(first, ["h1", "h2"]).where(~F.struct("id", "th", "j").eqNullSafe(F.col("first")))
    return again.groupBy("id", "th").agg(F.collect_set("j").alias("starts"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counts: bool = False) -> DataFrame:
    """`docs` with the repeated lines taken out of their texts; with `counts`, also n_lines and n_removed."""
    again = later_windows(line_windows(docs, doc_id, text))
    th, starts, gone, all_lines, places, id2, th2 = fresh(docs, "th", "starts", "gone", "all_lines", "places", "id2", "th2")
    again = again.select(F.col("id").alias(id2), F.col("th").alias(th2), F.col("starts").alias(starts))
    t = F.col(text)
    out = docs.withColumn(th, F.xxhash64(t))
    out = out.join(again, F.col(doc_id).eqNullSafe(F.col(id2)) & (F.col(th) == F.col(th2)), "left")
    out = out.withColumn(places, F.when(F.col(starts).isNotNull(), F.transform(_lines(t), lambda x: x["i"])))
    out = out.withColumn(
        gone,
        F.when(
            F.col(starts).isNotNull(),
            F.array_distinct(F.flatten(F.transform(starts, lambda j: F.slice(places, j + 1, WINDOW)))),
        ),
    )
    out = out.withColumn(all_lines, F.split(t, "\n"))
    # array_except is a hash lookup, so that a text of many lines stays linear
    left = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col(gone))
    cut = F.when(F.col(gone).isNull(), t).otherwise(F.array_join(F.transform(left, lambda i: F.get(all_lines, i)), "\n"))
    made = {"n_lines": F.coalesce(F.when(t.isNotNull(), F.size(all_lines)), F.lit(0)), "n_removed": F.coalesce(F.when(F.col(gone).isNotNull(), F.size(gone)), F.lit(0))} if counts else {}
    keep = [c for c in docs.columns if c.lower() not in made and c != text]
    return out.select(*[F.col(f"`{c}`") for c in keep], cut.alias(text), *[c.cast("long").alias(k) for k, c in made.items()]).select(
        *[c for c in docs.columns if c in keep or c == text], *made
    )


def line_dedup_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed and the text that is left."""
    return dedup_lines(docs.select("doc_id", "text"), counts=True)
