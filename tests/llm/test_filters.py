"""Quality rules, line dedup, language ID, toxicity, licences."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lattica.llm import langid, licenses, linededup, quality, registry, toxicity
from lattica.llm.licence_texts import MIT, TEXTS

from ..conftest import DATA, same_rows
from . import brute

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_twin(spark, duck, name):
    same_rows(registry.queries()[name](spark, SF), duck(SF).sql(registry.oracle_sql()[name]))


# --- quality rules


def test_order_of_rules_never_changes_the_verdict(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    results = []
    for order in (list(quality.RULES), list(reversed(quality.RULES))):
        out, v = quality.cascade(docs, order=order)
        results.append({r[0]: r[1] for r in out.select("doc_id", F.col(v)["kept"]).collect()})
    assert results[0] == results[1]


def test_rules_that_reject_much_for_little_come_first(spark):
    always, never, dear = (quality.Rule(n, lambda s, t, v=v: F.lit(v)) for n, v in (("always", True), ("never", False), ("dear", True)))
    docs = spark.createDataFrame([(1, "some text here"), (2, None)], "doc_id long, text string")
    found = quality.measured(docs, rules=(never, dear, always))
    assert {k: hits for k, (hits, _) in found.items()} == {"always": 2, "never": 0, "dear": 2} and all(s > 0 for _, s in found.values())
    found = {"always": (2, 0.01), "never": (0, 0.01), "dear": (2, 0.5)}
    assert [r.name for r in quality.by_gain((never, dear, always), found)] == ["always", "dear", "never"]


def test_a_dear_rule_takes_longer_on_the_sample(spark):
    docs = spark.createDataFrame([(i, "word " * 2000) for i in range(300)], "doc_id long, text string").repartition(1)
    rules = [quality.Rule("cheap", lambda s, t: s("n_words") < 0), quality.Rule("dear", lambda s, t: s("n_repeat_words") < 0)]
    found = quality.measured(docs, rules=rules)
    assert found["dear"][1] > 2 * found["cheap"][1]


def test_a_later_rule_is_not_evaluated_where_an_earlier_one_rejects(spark):
    docs = spark.createDataFrame([(1, "a few words that are here " * 10)], "doc_id long, text string")
    fails = quality.Rule("fails", lambda s, t: F.raise_error(F.lit("evaluated")).cast("boolean"))
    first = quality.Rule("first", lambda s, t: s("n_symbols") >= 0)
    out, v = quality.cascade(docs.withColumn("text", F.concat("text", F.lit(" x"), F.expr("array_join(transform(sequence(1, 400), i -> string(i)), ' ')"))), order=[first, fails])
    assert out.select(F.col(v)["rejected_by"]).first()[0] == "first"


@pytest.mark.parametrize("column", ["kept", "base_failed", "n_words > 50", "n_repeat_words > 0"])
def test_the_report_can_be_filtered(spark, column):
    report = quality.quality_report(spark.read.parquet(f"{SF}/documents.parquet"))
    every = report.collect()
    assert sorted(report.where(column).collect()) == sorted(spark.createDataFrame(every, report.schema).where(column).collect())


def test_quality_of_odd_rows(weird, nothing):
    rows = quality.quality_report(weird).collect()
    assert len(rows) == weird.count() and not any(r.kept for r in rows if r.n_words < 20)
    assert quality.keep_good(weird).columns == weird.columns
    assert quality.quality_report(nothing).count() == 0 and quality.keep_good(nothing).count() == 0


def test_repeated_words(plain):
    text = " ".join(f"w{i}" for i in range(12)) + " " + " ".join(f"w{i}" for i in range(10))
    assert quality.quality_report(plain([text])).first().n_repeat_words == 20


# --- line dedup


def test_line_dedup_by_brute_force(plain):
    docs = {1: "a\nb\nc\nd", 2: "x\n\nb\n c \nd\ny", 3: "a\nb", 4: "a\nb\nc\na\nb\nc", 5: "", 6: None, 7: "q\r\nr\r\ns\nq\nr\ns"}
    assert {r.doc_id: r.text for r in linededup.dedup_lines(plain(docs)).collect()} == brute.deduped_lines(docs)


def test_line_dedup_of_odd_rows(weird, nothing):
    out = linededup.dedup_lines(weird)
    assert out.columns == weird.columns and out.count() == weird.count()
    # the null id comes first and holds both of their windows, so that the others lose every line
    assert {r.text for r in out.where("doc_id = 7").collect()} == {""}
    assert linededup.dedup_lines(nothing).count() == 0


# --- language ID


def test_language_accuracy_and_held_out_labels(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    out = langid.language_report(docs)
    rows = {r.doc_id: r for r in out.collect()}
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i, r in rows.items() if r.held_out and lang[i]]
    assert sum(rows[i].lang_pred == lang[i] for i in held) > 0.93 * len(held) > 100
    assert all(0 <= r.score <= 1 for r in rows.values())
    other = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("?"))
    assert {r.doc_id: (r.lang_pred, r.score) for r in langid.language_report(other).collect()} == {i: (r.lang_pred, r.score) for i, r in rows.items()}


def test_bitmask_filters_have_no_false_negatives():
    import numpy as np

    rng = np.random.default_rng(0)
    grams, of = rng.integers(0, 1 << 63, 5000).astype(np.uint64), rng.integers(0, 3, 5000)
    f = langid.Filters(["a", "b", "c"], grams, of)
    bits = np.full(5000, 255, np.uint8)
    for slot in langid._probes(grams, f.bits):
        bits &= f.slots[slot]
    assert ((bits >> of) & 1).all()


def test_language_of_odd_rows(weird, nothing):
    rows = langid.language_report(weird).collect()
    assert len(rows) == weird.count()
    assert all((r.lang_pred, r.score) == ("und", 0) for r in rows if r.doc_id in (1, 2, 3))
    assert langid.language_report(nothing).count() == 0


# --- toxicity


def test_toxicity_on_labels_that_it_has_not_seen(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    seen = F.pmod(F.xxhash64("doc_id"), F.lit(4)) != 0
    chain = toxicity.train(docs, labels.where(seen), {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")})
    assert chain.names == ["low_quality", "toxic"] and len(chain.weights[1]) == len(chain.weights[0]) + 1
    rows = toxicity.score(docs.join(labels.where(~seen), "doc_id", "left_semi"), chain).join(labels, "doc_id").collect()
    hit = sum(r.p_toxic >= 0.5 for r in rows if r.toxic == 1) / max(1, sum(r.toxic == 1 for r in rows))
    false = sum(r.p_toxic >= 0.5 for r in rows if r.toxic == 0) / sum(r.toxic == 0 for r in rows)
    assert hit > 0.9 and false < 0.02, (hit, false)


def test_toxicity_of_odd_rows(spark, weird, nothing):
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 1), (7, None, 1), (None, 1, 1), (7, 0, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity_report(weird, labels).collect()
    assert len(rows) == weird.count() and all(0 <= r.p_toxic <= 1 for r in rows)
    assert toxicity.toxicity_report(nothing, labels.limit(0)).count() == 0
    assert toxicity.toxicity_report(weird, labels.limit(0)).count() == weird.count()


# --- licences


def test_licences_in_other_spellings(plain):
    docs = plain({
        1: "Copyright (c) 2024 Somebody\n\n" + MIT, 2: MIT.upper().replace("LICENSE", "LICENCE"), 3: MIT.replace(",", " ,").replace("\n", "\r\n"),
        4: MIT[:-30], 5: MIT + "\nAnd one more sentence.", 6: "text\nreleased under the MIT licence.\nmore", 7: None, 8: "", 9: "... !!!",
    })
    rows = {r.doc_id: r for r in licenses.scan_licences(docs).collect()}
    assert [rows[i].license_id for i in range(1, 10)] == ["MIT", "MIT", "MIT"] + [None] * 6
    assert rows[6].notice_ids == ["MIT"] and rows[6].has_license and not rows[9].has_license


def test_every_known_text_is_found_and_a_joined_table_gives_the_same(spark, plain, monkeypatch):
    docs = plain([t for _, t in TEXTS] + ["nothing"])
    want = [k for k, _ in TEXTS] + [None]
    one = {r.doc_id: r.license_id for r in licenses.scan_licences(docs).collect()}
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", 0)
    two = {r.doc_id: r.license_id for r in licenses.scan_licences(docs).collect()}
    assert one == two == dict(enumerate(want))


def test_licences_by_brute_force(spark):
    """Every unit of every document, in canonical form by itself, without what keeps long ones from being looked up."""
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    known = licenses.known_licences(spark).collect()
    by = {(r.unit, r.digest): r.license_id for r in known}
    lines = F.transform(F.split("text", "\n"), licenses.digest)
    rows = docs.select("doc_id", licenses.digest(F.col("text")).alias("d"), lines.alias("l")).collect()
    want = {r.doc_id: (by.get(("text", r.d)), sorted({by[("notice", x)] for x in r.l if ("notice", x) in by})) for r in rows}
    got = {r.doc_id: (r.license_id, r.notice_ids) for r in licenses.scan_licences(docs).collect()}
    assert got == want and any(x for _, x in want.values())


def test_a_long_text_with_the_phrase_often(plain):
    body = "All rights reserved.\n" * 3000 + MIT.replace("\n\n", "\nAll rights reserved\n")
    assert licenses.scan_licences(plain([body])).first().license_id == "MIT"


def test_full_licence_texts(plain):
    import os

    where = "/usr/share/common-licenses"
    if not os.path.exists(f"{where}/GPL-3"):
        pytest.skip("no licence texts on this machine")
    texts = ["Copyright (C) 2001 Somebody\n\n" + open(f"{where}/{n}").read() for n in ("GPL-3", "LGPL-2.1", "MPL-2.0", "Apache-2.0")]
    rows = {r.doc_id: r.license_id for r in licenses.scan_licences(plain([*texts, texts[0] + " one more", texts[1][:-200]])).collect()}
    assert rows == {0: "GPL-3.0", 1: "LGPL-2.1", 2: "MPL-2.0", 3: "Apache-2.0", 4: None, 5: None}


def test_licences_judge_rows_by_their_own_text(spark):
    rows = [(None, "Released under the MIT License."), (None, "nothing here"), (1, "Released under the MIT License."), (1, "nothing"), (1, None)]
    out = licenses.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.has_license) for r in out) == [(0, False), (0, True), (1, False), (1, False), (1, True)]


def test_digest_is_of_the_canonical_form(spark):
    df = spark.createDataFrame([("Copyright 2020 X\nAll Rights Reserved. Hello,   WORLD!",)], "t string")
    assert df.select(licenses.digest(F.col("t"))).first()[0] == hashlib.sha256(b"hello world").hexdigest()


def test_licences_of_odd_rows(weird, nothing):
    assert licenses.scan_licences(weird).count() == weird.count()
    assert licenses.scan_licences(nothing).count() == 0
