"""Spelling variants against brute force over all pairs of words."""

import random
import re
from collections import Counter
from zlib import crc32

from lattica.llm import spelling


def edits(a, b):
    """Whether two different words are one inserted, deleted or replaced letter apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def groups(counts):
    forms, out = {}, {}
    for w, n in counts.items():
        near = [x for x in counts if x != w and edits(w, x)]
        top = min(near, key=lambda x: (-counts[x], x), default=None)
        forms[w] = top if top is not None and counts[top] >= 2 * n else None
        out[w] = [n, len(near), forms[w], counts.get(forms[w])]
    for w, row in out.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        row.append(root)
    return out


def as_dict(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: [r.n, r.n_near, r.form, r.form_n, r.root] for r in rows}


def test_any_words(spark):
    """Short words over few letters: many anagrams, many neighbours, repeated letters."""
    rng = random.Random(1)
    words = {"".join(rng.choices("abé", k=rng.randint(1, 6))) for _ in range(400)} | {"letter", "lettre", "leter", "lettter", "ab", "ba", "z"}
    counts = {w: rng.choice([1, 2, 3, 5, 8, 16, 40]) for w in words}
    assert as_dict(spelling.variant_groups(spark.createDataFrame(list(counts.items()), "word string, n long"))) == groups(counts)


def test_chains_of_forms(spark):
    counts = {"a" * i: 2**i for i in range(5, 25)}
    got = as_dict(spelling.variant_groups(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == groups(counts) and {x[4] for x in got.values()} == {"a" * 24}


def test_crowd_of_anagrams(spark):
    rng = random.Random(2)
    words = {"".join(rng.sample("abcdefgh", 8)) for _ in range(1500)} | {"abcdefg", "abcdefgx"}
    counts = dict.fromkeys(words, 3)
    assert as_dict(spelling.variant_groups(spark.createDataFrame(list(counts.items()), "word string, n long"))) == groups(counts)


def test_nothing_of_a_row_per_word_is_broadcast(spark):
    """Spark takes what `filed` makes, and tables of words, for smaller than they are."""
    words = spark.createDataFrame([("letter", 9), ("lettre", 3), ("leter", 3)], "word string, n long")
    for df in (spelling.near_words(words), spelling.variant_groups(words)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_documents(spark, plain):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["Colour", "colour", "color", "Großes", "ÉTÉS÷été", "übel-taten", "x1yzzy", "straße", "theatre"], k=60)) for _ in range(30)] + [None, "", "12 \n"]
    counts = Counter()
    for i, t in enumerate(texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in run)
            h = crc32(f"{i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += len(w) >= 5
    wanted = groups({w: n for w, n in counts.items() if n >= 3})
    assert as_dict(spelling.spelling_report(plain(texts))) == wanted



def test_odd_rows(spark, weird, nothing):
    words = {r.word: r.n for r in spelling.count_words(weird, min_length=1, min_count=1).collect()}
    assert words["x" * 70_000] == 1 and words["tail"] == 3 and "éè" in words
    assert spelling.spelling_report(weird).count() > 0
    assert spelling.spelling_report(nothing).count() == 0
    # repeated rows count each time, and an id that is null is written as nothing
    docs = spark.createDataFrame([(None, "wordy wordy"), (None, "wordy wordy")], "doc_id long, text string")
    assert as_dict(spelling.variant_groups(spelling.count_words(docs, typos=10**9))) == {"wordy": [4, 0, None, None, "wordy"]}
