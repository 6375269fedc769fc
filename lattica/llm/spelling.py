"""Spelling variants by anagram hashing: words that differ by one letter, found as integers that differ by a letter's value.

1. Words are counted over whole texts; each task adds up what it meets before anything is shuffled.
2. A word's key is the sum of the fifth powers of its code points, the same for all orders of its letters. A letter more adds
   that letter's value to the key, a letter less takes it away, another letter changes it by the difference of two values.
   No two such changes have the same value: a**5 + b**5 = c**5 + d**5 has no solution of different code points this small.
3. Each word is filed under its key, and under its key less the value of each of its letters. Words that are one letter
   apart meet there once: in the key of the shorter word, or in that of the letters that an exchange leaves as they are.
4. The order of letters is verified for those that meet. One change leaves the letters before it, or those after it, as they
   are, so a word is filed under either half of its remaining letters as well, and anagrams of other halves never meet.
5. A word's form is the most frequent word near it, where that is frequent enough; a word's root is where forms lead to, found
   by doubling the length of the step in each round. Frequencies at least double along the way (at a ratio of 2), so that
   rounds are few.

Defined results: runs are `[A-Za-z\\u00C0-\\u00FF]+` with only A-Z in lower case; a null text has none. Ties go to the word that
is first in code-point order. Repeated rows count each time. A null id is written as nothing where typos are planted. An
empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

_WORD = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Different words that a task adds up before it hands them on.
HELD = 200_000


def planted(doc_id: int | None, word: str, every: int) -> str:
    """The word, without one of its letters where a hash of it and the id is divisible by `every`."""
    h = crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    return word if h % every else word[: h % len(word)] + word[h % len(word) + 1 :]


def count_words(docs: DataFrame, min_length: int = 5, min_count: int = 3, typos: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the words of all texts, with at least `min_length` code points and `min_count` occurrences.

    typos: plant a missing letter in about one of so many (document, word), by `planted`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def summed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                for raw, n in Counter(m[0] for m in _WORD.finditer(t.as_py() or "")).items():
                    word = raw.lower() if raw.isascii() else raw.translate(_LOWER)
                    if typos:
                        word = planted(i, word, typos)
                    if len(word) >= min_length:
                        total[word] += n
                if len(total) > HELD:
                    yield summed()
        yield summed()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def filed(words: DataFrame) -> DataFrame:
    """(key, front, half, word, n): each word under its key, and its key less each different letter; once by the front half of
    the letters that are left, and once by the back half.

    Of a word without one letter it isn't known which place the letter had, so the halves are those of the whole word, cut to
    the length that a word with the same letters left has: the first h letters and the last m - h, m being what is left.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                words = part.column("word").to_pylist()
                size = np.array([len(x) for x in words], np.int64)
                letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
                key = np.add.reduceat(letters**5, np.cumsum(size) - size)
                of = np.repeat(np.arange(len(words)), size)
                pairs = np.unique((of.astype(np.uint64) << np.uint64(32)) | letters)
                owner, letter = (pairs >> np.uint64(32)).astype(np.int64), pairs & np.uint64(0xFFFFFFFF)
                at = np.concatenate([np.arange(len(words)), owner])
                keys = np.concatenate([key, key[owner] - letter**5]).view(np.int64)
                left = np.concatenate([size, size[owner] - 1])
                fronts = [words[i][: m // 2] for i, m in zip(at.tolist(), left.tolist())]
                backs = [words[i][len(words[i]) - (m - m // 2) :] for i, m in zip(at.tolist(), left.tolist())]
                twice = np.concatenate([at, at])
                columns = {"key": np.concatenate([keys, keys]), "front": np.repeat([True, False], len(at)), "half": fronts + backs}
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns.values()), part.column("word").take(twice), part.column("n").take(twice)], [*columns, "word", "n"])

    return words.where(F.length("word") > 0).select("word", "n").mapInArrow(run, "key long, front boolean, half string, word string, n long")


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n) of all words that differ by one letter inserted, deleted or replaced, both ways around.

    Spark sizes what `filed` makes by the words that go in, of which each leaves two rows per letter: the join is told not to
    broadcast it.
    """
    rows = filed(words)
    a = rows.select("key", "front", "half", "word")
    b = rows.select("key", "front", "half", F.col("word").alias("near"), F.col("n").alias("near_n"))
    met = a.join(b.hint("merge"), ["key", "front", "half"]).where((F.col("word") != F.col("near")) & (F.levenshtein("word", "near", 1) == 1))
    # words that share both halves meet twice, and count in front
    left = F.least(F.length("word"), F.length("near")) - (F.length("word") == F.length("near")).cast("int")
    front = F.floor(left / 2).cast("int")
    same = F.substring("word", F.lit(1), front) == F.substring("near", F.lit(1), front)
    return met.where(F.col("front") | ~same).select("word", "near", "near_n")


def variant_groups(words: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every row of `words` (word, n), whose words are distinct.

    Tables of words are larger than their files, by which Spark would choose to broadcast them: joins with them are merges.
    """
    words = written(words.select("word", "n"))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("top"))
    enough = -F.col("top.m") >= ratio * F.col("n")
    formed = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("top.w")).alias("form"), F.when(enough, -F.col("top.m")).alias("form_n")
    )
    formed = written(formed)
    dropped(words)
    steps = written(formed.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = written(steps.join(on.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        dropped(steps)
        steps = longer
        if steps.where("moved").isEmpty():
            break
    roots = steps.select("word", "root")
    return formed.join(roots.hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_report(docs: DataFrame) -> DataFrame:
    """One row per word of 5 letters and 3 occurrences or more: word, n, n_near, form, form_n, root; a letter is left out of one
    in 97 of a document's words."""
    return variant_groups(count_words(docs, typos=97))
