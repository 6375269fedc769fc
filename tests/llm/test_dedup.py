"""Substring, suffix-array and near dedup; decontamination; packing; the pipeline."""

import functools
import hashlib
import itertools
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import components, decontam, hashing, neardup, packing, repeats, rlz

from ..conftest import DATA
from . import brute

SF = f"{DATA}/sf0.001"


def _text(rng, n, vocabulary=5000):
    return " ".join(f"t{rng.randrange(vocabulary)}" for _ in range(n))


# --- substring dedup


def _rlz(docs):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rlz.substring_dedup_report(docs).collect()}


def _rlz_brute(docs):
    gone, out = brute.rlz_removed(docs), {}
    for i, t in docs.items():
        w = brute.words(t)
        kept = " ".join(x for p, x in enumerate(w) if p not in gone[i])
        out[i] = (len(w), len(gone[i]), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("seed", range(3))
def test_rlz_by_brute_force(plain, seed):
    rng = random.Random(seed)
    passages = [_text(rng, n) for n in (19, 20, 21, 45, 90)]
    docs = {i: " ".join(rng.choice(passages) if rng.random() < 0.4 else _text(rng, rng.randrange(1, 30)) for _ in range(rng.randrange(9))) for i in range(60)}
    docs |= {100: "a " * 70, 101: "a b " * 40, 102: None, 103: ""}
    assert _rlz(plain(docs)) == _rlz_brute(docs)


def test_rlz_with_frequent_anchors_filed_alone(plain, monkeypatch):
    rng = random.Random(9)
    common = _text(rng, 60)
    docs = {i: f"{_text(rng, 10)} {common} {_text(rng, 10)}" for i in range(150)}
    monkeypatch.setattr(rlz, "SAMPLE", 1)
    monkeypatch.setattr(rlz, "FREQUENT", 20)
    assert _rlz(plain(docs)) == _rlz_brute(docs)


@pytest.mark.parametrize("known", [1, 30, 100_000])
def test_rlz_over_many_slices_of_a_task(plain, monkeypatch, known):
    rng = random.Random(known)
    passages = [_text(rng, n) for n in (20, 33, 60)]
    ids = rng.sample(range(1000), 120)  # in no order, so that windows which are known turn out later
    docs = {i: " ".join(rng.choice(passages) if rng.random() < 0.6 else _text(rng, rng.randrange(1, 30)) for _ in range(rng.randrange(5))) for i in ids}
    monkeypatch.setattr(rlz, "KNOWN", known)
    monkeypatch.setattr(rlz, "slices", functools.partial(hashing.slices, most=1500))
    assert _rlz(plain(docs).coalesce(1)) == _rlz_brute(docs)


def test_rlz_factors_name_their_source(plain):
    rng = random.Random(4)
    a, b = _text(rng, 40), _text(rng, 40)
    docs = plain({1: a, 2: b, 3: f"x {a} {b} y"})
    rows = rlz.factors(docs).collect()
    assert [(r.id, [tuple(f) for f in r.factors]) for r in rows] == [(3, [(1, 40, 1, 0), (41, 40, 2, 0)])]


def test_rlz_of_odd_rows(weird, nothing):
    assert rlz.substring_dedup_report(weird).count() == weird.count()
    rows = rlz.substring_dedup_report(weird).where("doc_id = 7").collect()
    assert rows[0].n_removed == rows[1].n_removed > 0
    assert rlz.substring_dedup_report(nothing).count() == 0


def test_rlz_judges_rows_by_their_own_text(spark):
    rng = random.Random(21)
    a, b, c = (_text(rng, 40) for _ in range(3))
    rows = [(1, a), (2, a), (2, b), (None, c), (None, "x " + c), (None, None), (3, c), (4, b), (5, "y"), (5, "y")]
    out = rlz.substring_dedup_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in out)
    assert [x for x in got if x[0]] == [(1, 40, 0), (2, 40, 0), (2, 40, 40), (3, 40, 40), (4, 40, 40), (5, 1, 0), (5, 1, 0)]
    assert [n for i, n, _ in got if not i] == [0, 40, 41] and sum(k for i, _, k in got if not i) == 40


# --- suffix arrays


def _spans(docs):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.repeat_removal_report(docs).collect()}


def _spans_brute(docs):
    gone, out = brute.repeated_bytes(docs), {}
    for i, t in docs.items():
        b, own = (t or "").encode(), gone[i]
        kept = bytes(x for p, x in enumerate(b) if p not in own)
        out[i] = (len(b), len(own), sum(p - 1 not in own for p in own), hashlib.sha256(kept).hexdigest())
    return out


def _bytes(rng, n, alphabet="abcdefghijklmnop é"):
    return "".join(rng.choice(alphabet) for _ in range(n))


@pytest.mark.parametrize("group", [256, 2])
def test_repeats_by_brute_force(plain, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    rng = random.Random(group)
    passages = [_bytes(rng, n) for n in (300, 390, 400, 401, 700, 900)]
    docs = {}
    for i in range(40):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            p = rng.choice(passages)
            cut = rng.randrange(0, 60)
            parts += [p[cut:] if rng.random() < 0.5 else p[: len(p) - cut], _bytes(rng, rng.randrange(0, 120))]
        docs[i] = "".join(parts)
    docs |= {100: "ab" * 500, 101: "z" * 1300, 102: None, 103: "", 104: docs[0], 105: "ab" * 230}
    assert _spans(plain(docs)) == _spans_brute(docs)


def test_maximal_repeats_hold_all_occurrences():
    core = b"k" * 40
    one = (b"L" * 300 + core + b"R" * 200, 300)
    two = (b"x" + b"L" * 250 + core + b"R" * 200, 251)
    three = (b"y" + b"L" * 250 + core + b"R" * 199 + b"z", 251)
    found = {(n, tuple(sorted(m for m, _ in places))) for n, places in repeats.maximal_repeats([one, two, three])}
    assert (489, (0, 1, 2)) in found and (490, (0, 1)) in found


def test_repeats_of_odd_rows(weird, nothing):
    out = {}
    for r in repeats.repeat_removal_report(weird).collect():
        out.setdefault(r.doc_id, r)
    assert out[5].n_removed == out[5].n_bytes == out[10].n_removed and out[9].n_removed == 70_000 and out[1].n_bytes == 0
    assert repeats.repeat_removal_report(nothing).count() == 0


# --- near dedup


def _noisy(rng, text, share):
    w = text.split()
    for _ in range(int(len(w) * share)):
        w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("seed", range(2))
def test_near_duplicates_by_brute_force(plain, seed):
    rng = random.Random(seed)
    base = [_text(rng, rng.randrange(60, 200)) for _ in range(12)]
    docs = {i: _noisy(rng, rng.choice(base), rng.choice((0, 0.01, 0.02, 0.03, 0.1))) for i in range(150)}
    docs |= {200: "a b", 201: "A b", 202: None, 203: "", 204: "a b c d", 205: "a b c d a b c d"}
    got = {r.doc_id: r.component_id for r in neardup.near_duplicate_report(plain(docs)).collect()}
    assert got == brute.components(docs, 4, 80)


def test_a_crowd_in_one_bucket(plain):
    """One group of hundreds of near copies, and many that share half of their text with it and are linked with none."""
    rng = random.Random(5)
    hub = _text(rng, 200)
    half = " ".join(hub.split()[:140])
    docs = {i: _noisy(rng, hub, 0.02) for i in range(200)} | {500 + i: f"{half} {_text(rng, 60)}" for i in range(60)}
    got = {r.doc_id: r.component_id for r in neardup.near_duplicate_report(plain(docs)).collect()}
    assert got == brute.components(docs, 4, 80)


def test_pigeonhole_guarantee():
    """Signatures as far apart as is allowed share a chunk but for one component; one further apart need not."""
    cuts = neardup.CUTS
    assert (cuts[0], cuts[-1], len(cuts)) == (0, neardup.COMPONENTS, neardup.CHUNKS + 1) and neardup.MAX_DIFFERENT == 29
    rng = random.Random(6)
    for _ in range(200):
        differ = set(rng.sample(range(neardup.COMPONENTS), neardup.MAX_DIFFERENT))
        assert any(len(differ & set(range(a, b))) <= 1 for a, b in zip(cuts, cuts[1:]))
    # at a similarity of 0.8 a component differs with a chance of 0.2
    p = sum(math.comb(66, k) * 0.2**k * 0.8 ** (66 - k) for k in range(neardup.MAX_DIFFERENT + 1, 67))
    assert p < 4e-6


def test_near_duplicates_of_odd_rows(weird, nothing):
    out = neardup.near_duplicate_report(weird)
    assert {r.doc_id: r.component_id for r in out.collect()}[10] == 5 and out.count() == weird.count()
    kept = neardup.keep_one(weird)
    assert kept.columns == weird.columns and kept.where("doc_id is null").count() == 1 and kept.where("doc_id = 7").count() == 2
    assert neardup.near_duplicate_report(nothing).count() == 0 and neardup.keep_one(nothing).count() == 0


def test_near_duplicates_judge_rows_by_their_own_text(spark):
    rng = random.Random(12)
    a, b, c, d = (_text(rng, 60) for _ in range(4))
    rows = [(None, a), (2, a), (2, b), (3, b), (None, c), (None, c + " more"), (None, None), (4, None), (None, ""), (5, d), (5, d)]
    docs = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, n int")
    out = {(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicate_report(docs).collect()}
    assert {x for x in out if x[0] is not None} == {(2, 2, True), (3, 2, False), (4, 4, True), (5, 5, True)}
    assert neardup.near_duplicate_report(docs).count() == len(rows)
    kept = {r.n for r in neardup.keep_one(docs).collect()}
    assert kept - {4, 5} == {1, 2, 6, 7, 8, 9, 10} and len(kept & {4, 5}) == 1


def test_components(spark):
    rng = random.Random(7)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {}
    for a, b in pairs:
        ra, rb = a, b
        while root.get(ra, ra) != ra:
            ra = root[ra]
        while root.get(rb, rb) != rb:
            rb = root[rb]
        root[max(ra, rb)] = root[min(ra, rb)] = min(ra, rb)
    for i in got:
        r = i
        while root.get(r, r) != r:
            r = root[r]
        assert got[i] == r
    assert {i for p in pairs if p[0] != p[1] for i in p} <= set(got)


def test_stars_are_known_without_another_round(spark, monkeypatch):
    """A round is a dozen shuffles: none for edges that are stars already, one for a star around a later id."""
    rounds, step = [], components._small_star
    monkeypatch.setattr(components, "_small_star", lambda edges: rounds.append(1) or step(edges))
    for hub, most in ((0, 0), (25, 1)):
        rounds.clear()
        edges = spark.createDataFrame([(hub, i) for i in range(50)], "a long, b long")
        assert {(r.id, r.component) for r in components.components(edges).collect()} == {(i, 0) for i in range(50)}
        assert len(rounds) == most


def test_components_are_not_made_between_rounds_of_pivots(plain, monkeypatch):
    """Once after the pivots, and once more where blocks find links; and all links are found for it."""
    made, whole = [], neardup.components
    monkeypatch.setattr(neardup, "components", lambda edges: made.append(1) or whole(edges))
    rng = random.Random(15)
    docs, text = {}, _text(rng, 300)
    for i in range(120):  # a chain: each text is near the next ones, and the ends share little
        docs[i] = text
        w = text.split()
        w[(7 * i) % 290 : (7 * i) % 290 + 7] = [f"c{i}x{j}" for j in range(7)]
        text = " ".join(w)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicate_report(plain(docs)).collect()}
    assert got == brute.components(docs, 4, 80)
    assert len(made) <= 2


def test_window_hashes_depend_on_the_words_alone():
    import pyarrow as pa

    w = hashing.Words(pa.array(["a b c", "", None, "x a b c"]))
    h, _ = w.windows(3)
    assert w.counts().tolist() == [3, 0, 0, 4] and len(h) == 3 and h[0] == h[2] != h[1]


# --- decontamination


def test_masks_hit_every_tolerated_overlap():
    for size in range(decontam.MIN_TOKENS, decontam.WINDOW + 1):
        errors = size - -(-size * decontam.PERCENT // 100)
        starts = [(m, s) for m in decontam.MASKS for s in range(size - max(m))]
        for bad in itertools.combinations(range(size), errors):
            gone = set(bad)
            assert any(all(s + p not in gone for p in m) for m, s in starts), (size, bad)


def test_decontamination_by_brute_force(spark, plain):
    rng = random.Random(8)
    items = [(i, _text(rng, n)) for i, n in enumerate((9, 10, 14, 20, 35, 60, 1, 3, 5))] + [(9, None), (10, "")]
    docs = {}
    for i in range(80):
        _, t = items[rng.randrange(9)]
        docs[i] = f"{_text(rng, rng.randrange(15))}, {_noisy(rng, t, rng.choice((0, 0.1, 0.2, 0.3)))}! {_text(rng, rng.randrange(15))}"
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: set(r.item_ids) for r in decontam.decontamination_report(plain(docs), benchmark).collect()}
    assert got == {i: brute.contaminated(t, [x for x in items if x[1]]) for i, t in docs.items()}


def test_decontamination_of_the_table_by_brute_force(spark):
    docs, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    want = {r.doc_id: brute.contaminated(r.text, items) for r in docs.orderBy("doc_id").collect()}
    got = {r.doc_id: set(r.item_ids) for r in decontam.decontamination_report(docs, benchmark).collect()}
    assert got == want and any(want.values())


def test_a_seed_that_many_items_share(spark, plain, monkeypatch):
    monkeypatch.setattr(decontam, "HITS", 50)
    phrase = "one stock phrase that every item of this benchmark begins with in its first line"
    index = decontam.Index(list(range(40)), [f"{phrase} {i}" for i in range(40)])
    import pyarrow as pa

    assert {x[1] for x in index.overlaps(pa.array([f"a text, {phrase} and more"]))} == set(range(40))


def test_texts_that_repeat_what_thousands_of_items_share(spark, plain):
    phrase = "one stock phrase that every item of this benchmark begins with in its first line"
    benchmark = spark.createDataFrame([(i, f"{phrase} {i}") for i in range(3000)], "item_id long, text string")
    docs = plain([f"{phrase} and more " * 90] * 4 + ["nothing of the kind"])
    for r in decontam.decontamination_report(docs, benchmark).collect():
        assert r.item_ids == (list(range(3000)) if r.doc_id < 4 else [])
        assert r.n_overlaps == (90 * 3000 if r.doc_id < 4 else 0)


def test_stretches_of_an_item_on_several_diagonals():
    import pyarrow as pa

    rng = random.Random(12)
    item = [f"t{i}" for i in range(60)]
    noise = lambda n: [f"x{rng.random()}" for _ in range(n)]
    text = [*noise(5), *item[:30], *noise(40), *item[20:50], *item[10:40], *noise(7)]
    index = decontam.Index([5], [" ".join(item)])
    rows = index.overlaps(pa.array([" ".join(noise(30)).replace(".", ""), " ".join(text).replace(".", "")])).tolist()
    # up to four tokens beside a stretch don't match, as a window may have a fifth of them
    assert [r[:2] for r in rows] == [[1, 0], [1, 0]] and [r[4] for r in rows] == [30, 30]
    (a, b), (c, d) = [(r[2], r[2] + r[3]) for r in rows]
    assert 1 <= a <= 5 and 35 <= b <= 39 and 71 <= c <= 75 and 135 <= d <= 139


def test_decontamination_in_blocks_is_the_same(spark, monkeypatch):
    docs, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    one = sorted(map(str, decontam.decontamination_report(docs, benchmark).collect()))
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 1000)
    assert sorted(map(str, decontam.decontamination_report(docs, benchmark).collect())) == one


@pytest.mark.parametrize("block", [8_000_000, 200])
def test_decontamination_judges_rows_without_own_ids_one_by_one(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_CHARS", block)
    items = [" ".join(f"w{i}x{j}" for j in range(25)) for i in range(4)]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(None, items[0], 1), (None, "a clean text", 2), (None, None, 3), (7, items[1], 4), (7, "another clean text", 5), (7, items[1] + " , " + items[2], 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    assert sorted(r.n for r in decontam.keep_clean(docs, benchmark).collect()) == [2, 3, 5]
    got = sorted((r.doc_id or 0, r.item_ids, r.n_overlaps) for r in decontam.decontamination_report(docs, benchmark).collect())
    assert got == [(0, [], 0), (0, [], 0), (0, [0], 1), (7, [], 0), (7, [1], 1), (7, [1, 2], 2)]


def test_repeats_of_texts_without_own_ids(spark):
    rng = random.Random(31)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    shared = word(4 * repeats.WINDOW)
    texts = [word(50) + shared, shared + word(70), word(300), word(400)]
    for doc_id in (None, 5):
        rows = spark.createDataFrame([(doc_id, t) for t in texts], "doc_id long, text string")
        kept = sorted(bytes(r.kept).decode() for r in repeats.remove_repeats(rows).collect())
        assert kept == sorted([texts[0][:50], texts[1][-70:], texts[2], texts[3]])


def test_decontamination_of_odd_rows(spark, weird, nothing):
    benchmark = spark.createDataFrame([(1, "one line of text that comes again and a second one follows it here"), (2, None)], "item_id long, text string")
    rows = decontam.decontamination_report(weird, benchmark).collect()
    assert {r.doc_id for r in rows if r.contaminated} == {6, 7, None}
    assert decontam.decontamination_report(weird, benchmark.limit(0)).where("contaminated").count() == 0
    assert decontam.keep_clean(weird, benchmark).columns == weird.columns
    assert decontam.decontamination_report(nothing, benchmark).count() == 0


# --- packing


def _check_packing(docs, rows, capacity=4096):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    assert set(pieces) == {i for i, _ in docs}
    for i, t in docs:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // capacity)))
        for r in own:
            part = ids[r.piece * capacity : (r.piece + 1) * capacity]
            assert (r.start, r.length) == (r.piece * capacity, len(part))
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    total = sum(r.length for r in rows)
    assert len(bins) <= -(-total // capacity) * 1.01 + 1


def test_packing_round_trip(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    _check_packing([tuple(r) for r in docs.collect()], packing.packing_report(docs).collect())


def test_packing_of_odd_words(plain):
    texts = ["Hello, World. A.B.C. <unk> é café. don't 3.14, x,", "  spaces ​ zero", "UPPER Lower. ...", "a\tb\r\nc", "中文。 \U0001f600!", None, "", "<s> </s> <pad>."]
    docs = plain(texts)
    _check_packing(list(enumerate(texts)), packing.packing_report(docs).collect())


def test_new_words_are_encoded_in_runs():
    """A run of them costs one call's overhead, and gives each word the ids that it has alone."""
    words = packing.WordCache(packing.tokenizer_path())
    real, handed = words.tokenizer, []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            handed.extend(texts)
            return real.encode_batch_fast(texts, **options)

    words.tokenizer = Counting()
    rng = random.Random(21)
    odd = ["caf\u00e9", "e\u0301", "\u0301", "\u4e2d\u6587\u3002", "\U0001f600!", "don't", "'", "s", "A.B.", "\u200b", "\u00a0", "endoftext|>", "|", "<|endoftext|>", "x<|endoftext|>y", "</s>", "<", "a<b"]
    texts = [" ".join(odd + [f"w{rng.randrange(10**9)}x" for _ in range(2000)])]
    flat, sizes = words.ids([t.encode() for t in texts])
    assert flat.tolist() == real.encode(texts[0], add_special_tokens=False).ids and sizes.tolist() == [len(flat)]
    assert len(handed) < 40


def test_words_of_letters_are_encoded_without_marks():
    """Between spaces, as a mark costs more than such a word; those that the tokenizer splits, joins or lengthens keep their ids."""
    words = packing.WordCache(packing.tokenizer_path())
    real, handed = words.tokenizer, []

    class Recording:
        def encode_batch_fast(self, texts, **options):
            handed.extend(texts)
            return real.encode_batch_fast(texts, **options)

    words.tokenizer = Recording()
    rng = random.Random(22)
    letters = ["".join(rng.choice("abcdeT\u00e9\u00df\u00d6") for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    flat, sizes = words.ids([" ".join(letters).encode()])
    assert flat.tolist() == real.encode(" ".join(letters), add_special_tokens=False).ids and sizes.tolist() == [len(flat)]
    assert handed and not any(packing.MARK.decode() in x for x in handed)
    odd = ["\u0130stanbul", "\ufb01n", "\u1100\u1161\u11a8", "\u212b", "\u212a", "\u03a3\u03a3", "\u1e9e", "\u4e2d\u6587", "\u02b0x", "\u0958", "\u2126", "\u1fbc", "\u01c5"]
    for x in [*odd, " ".join(odd), " ".join(odd + letters[:300]), "".join(odd), "H\u0331 h\u0331 \u0331 h", "\u0130 \u1e9e"]:
        fresh, _ = packing.WordCache(packing.tokenizer_path()).ids([x.encode()])
        assert fresh.tolist() == real.encode(x, add_special_tokens=False).ids, x


def test_units_of_texts_by_plain_python():
    rng = random.Random(23)
    alphabet = ["a", "B", "7", ".", ",", "#", "<", ">", "|", "\u00e9", "\u00c9", "\u3002", " ", " ", "\n", "\x0b", "\u00a0"]
    for n in (0, 1, 2, 40):
        for _ in range(60):
            texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(12))).encode() for _ in range(n)]
            want = []
            for t in texts:
                own = []
                for w in t.split():
                    core = w.rstrip(packing.PUNCTUATION)
                    if b"<" in w or not core[-1:].isalnum():
                        core = w
                    own += [core if b"<" in w or not w.isascii() else core.lower(), *([w[len(core) :]] if core != w else [])]
                want.append(own)
            units, cuts = packing._units(texts)
            assert [units.slice(a, b - a).to_pylist() for a, b in zip(cuts, cuts[1:])] == want


def test_words_are_learned_again_once_forgotten(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    words = packing.WordCache(packing.tokenizer_path())
    for text in ("one two, three four", "five one", "two. six", "one two, three four", ""):
        flat, sizes = words.ids([text.encode(), b" ", text.encode()])
        own = words.tokenizer.encode(text, add_special_tokens=False).ids
        assert flat.tolist() == own * 2 and sizes.tolist() == [len(own), 0, len(own)]


def test_best_two_fit_replaces_the_smallest():
    # 6 + 3 leaves 1; replacing the 3 by 2 + 2 fills the bin
    bins, offsets = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert bins.tolist() == [0, 1, 0, 0] and sorted(offsets[[0, 2, 3]].tolist()) == [0, 6, 8]


def test_sequences_hold_their_pieces(plain):
    pieces = packing.token_pieces(plain(["a b c", "d e f g"]), packing.tokenizer_path())
    from lattica.llm.common import written

    packed = packing.pack(written(pieces))
    ids = packing.sequences(packed).first().ids
    want = b"".join(bytes(r.ids) for r in sorted(packed.collect(), key=lambda r: r.offset))
    assert bytes(ids) == want


def test_packing_of_nothing(weird, nothing):
    assert packing.packing_report(nothing).count() == 0
    assert packing.packing_report(weird).select("doc_id").distinct().count() == 12


# --- the pipeline


def test_pipeline_by_brute_force(spark):
    import corpus_pipeline
    from lattica.llm import quality
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in quality.quality_report(docs).where("kept").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept}
    texts = brute.deduped_lines(texts)
    root = brute.components(texts, 5, 80)
    texts = {i: t for i, t in texts.items() if root[i] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {i: t for i, t in texts.items() if not brute.contaminated(t, items)}
    rows = corpus_pipeline.run(spark, SF).collect()
    _check_packing(list(texts.items()), rows)
    assert Tokenizer and [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "decontamination", "packing"]


def test_stages_keep_the_columns_of_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(30), SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes


def test_stages_of_odd_rows(spark, weird):
    import corpus_pipeline

    docs = weird.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).count()
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_everything_else_works_without_this_subpackage():
    """The rest neither imports the subpackage nor names its tables' operators."""
    import pathlib

    import lattica

    for p in pathlib.Path(lattica.__file__).parent.rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p


def test_quality_stage_drops_what_it_rejects(spark):
    import corpus_pipeline
    from lattica.llm import quality

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, SF).collect()}
    assert got == {r.doc_id for r in quality.quality_report(docs).where(F.col("kept")).collect()}
