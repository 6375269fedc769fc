"""Documents that operators have to get through: nulls, empty and long texts, repeated rows, clashing column names."""

import pytest

EXTRA = ("_th", "TH", "words", "stats", "id", "component", "gone", "h1", "starts", "_kept", "hits", "piece", "group", "_group", "lang_pred")


@pytest.fixture(scope="session")
def weird(spark):
    long = " ".join(f"word{i % 997} and{i % 31}" for i in range(30_000))
    line = "one line of text that comes again\nand a second one follows it here\nthen the third line closes it\n"
    texts = [
        (1, None), (2, ""), (3, " \t\n "), (4, "short"), (5, long), (6, line * 3), (7, line + "tail"), (7, line + "tail"),
        (None, line + "tail"), (None, None), (8, "éè 中文 \U0001f600 mixed   spaces" * 30), (9, "x" * 70_000), (10, long), (11, "MIT License\r\n\x00\x01"),
    ]
    rows = [(i, t, None if i == 4 else "en", "src", len(t or ""), *[str(n)] * len(EXTRA)) for n, (i, t) in enumerate(texts)]
    # names that differ in case only are one name to Spark, so they don't come together
    names = [c for c in EXTRA if c != "TH"]
    rows = [r[: 5 + len(names)] for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names))


@pytest.fixture(scope="session")
def nothing(weird):
    return weird.limit(0)


@pytest.fixture(scope="session")
def plain(spark):
    def make(texts):
        rows = list(enumerate(texts)) if not isinstance(texts, dict) else list(texts.items())
        return spark.createDataFrame(rows, "doc_id long, text string")

    return make
