"""SimHash: fingerprints and links against brute force."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from lattica.llm import simhash
from lattica.llm.components import components

from .brute import words


def fingerprint(text, k=4):
    w = words(re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def least(ids, near):
    """id -> smallest id that links reach."""
    out = {}
    for i in sorted(ids):
        if i not in out:
            todo, out[i] = [i], i
            while todo:
                a = todo.pop()
                for b in ids:
                    if b not in out and near(a, b):
                        out[b] = i
                        todo.append(b)
    return out


def far(a, b):
    return bin(a ^ b).count("1")


def test_documents(spark, plain):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "中文"]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 90))) for _ in range(40)]
    texts = base + [t.upper() for t in base[:5]] + ["  " + t.replace(" ", " \n") for t in base[5:10]] + [None, "", "\t", "one", "one two"]
    for t in base[10:30]:
        w = t.split(" ")
        w[rng.randrange(len(w))] = "other"
        texts.append(" ".join(w))
    got = {r.doc_id: r for r in simhash.simhash_report(plain(texts)).collect()}
    fps = {i: fingerprint(t) for i, t in enumerate(texts)}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == fps and all(len(r.fingerprint) == 16 for r in got.values())
    assert {i: r.component_id for i, r in got.items()} == least(fps, lambda a, b: far(fps[a], fps[b]) <= 4)


def groups(spark, fps, distance):
    rows = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    found = {r.id: r.component for r in components(simhash.links(rows, distance)).collect()}
    out = {}
    for x in fps:
        signed = x - (1 << 64) if x >> 63 else x
        out.setdefault(found.get(signed, signed), set()).add(x)
    return sorted(map(sorted, out.values()))


def wanted(fps, distance):
    out = {}
    for x, name in least(fps, lambda a, b: far(a, b) <= distance).items():
        out.setdefault(name, set()).add(x)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 4, 5])
def test_every_pair_within_the_distance_is_linked(spark, distance):
    rng, fps = random.Random(distance), set()
    for _ in range(150):
        x = rng.getrandbits(64)
        fps |= {x, *[x ^ sum(1 << b for b in rng.sample(range(64), n)) for n in (distance, distance + 1)]}
        # differences that the counts can't see, and that fall on few segments
        fps.add(x ^ (3 << 2 * rng.randrange(32)))
    assert groups(spark, fps, distance) == wanted(fps, distance)


def test_crowded_cells(spark, monkeypatch):
    """Thousands of fingerprints about few centres, so that cells are split into blocks."""
    monkeypatch.setattr(simhash, "CROWD", 200)
    rng, fps = random.Random(3), set()
    for _ in range(3):
        centre = rng.getrandbits(64)
        fps |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(500)}
    assert groups(spark, fps, 4) == wanted(fps, 4)


def test_distance_is_bounded(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 6)


def test_odd_rows(spark, weird, nothing):
    rows = simhash.near_duplicates(weird, k=4).collect()
    assert len(rows) == weird.count()
    by = {}
    for r in rows:
        by.setdefault(r.fp, set()).add(r.component)
    assert by[0] == {1}  # null texts and those without words; ids 1, 2, 3 and null
    assert all(len(x) == 1 for x in by.values())
    assert simhash.simhash_report(nothing).count() == 0


def test_ids_may_all_be_null(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e")], "doc_id long, text string")
    assert [r.component_id for r in simhash.simhash_report(docs).collect()] == [None, None]


def test_copies_stay_one_class(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the same text in very many rows").alias("text"))
    assert simhash.simhash_report(docs).select("component_id", "fingerprint").distinct().count() == 1
