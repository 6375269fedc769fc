"""Licence scan by canonical digest, in DataFrame expressions only.

A text is brought to a canonical form: lower case; lines that begin with a copyright notice and the phrase "all rights
reserved" dropped; equivalent spellings made equal; everything but letters and digits turned into single spaces. The
SHA-256 of the whole canonical text is joined by hash with the digests of known licences. Two units are looked up, both
whole: the document, and each of its lines (one-line notices such as "Released under the MIT License.").

Defined results: a null or empty text, or one that is empty in canonical form, matches nothing; each row is looked up by its
own text, whatever its doc_id; digests that are listed twice give the alphabetically first licence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_key
from .licence_texts import DIGESTS, NOTICES, TEXTS

#: More known licences than this are joined by shuffle: only a small table is broadcast.
BROADCAST_ROWS = 10_000

#: Spellings that mean the same in a licence, each with the one used here.
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("licencing", "licensing"),
    ("sublicence", "sublicense"),
    ("sub license", "sublicense"),
    ("sub licence", "sublicense"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
    ("favour", "favor"),
    ("favourable", "favorable"),
    ("organisation", "organization"),
    ("organisations", "organizations"),
    ("authorised", "authorized"),
    ("acknowledgement", "acknowledgment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labour", "labor"),
    ("modelled", "modeled"),
    ("per cent", "percent"),
    ("wilful", "willful"),
    ("whilst", "while"),
    ("fulfil", "fulfill"),
    ("https", "http"),
)


#: A spelling is never shortened to less than this part of its length, so that a longer text can't become a shorter known one.
LEAST_PART = 0.75
#: Canonical words that a text has to begin with as a known one does, and words from which these follow: a spelling, or the
#: phrase that is dropped, changes three words at most, so that with LEFT words left the first HEAD are sure.
HEAD, BEGINNING, LEFT = 3, 12, 6


def _plain(line: Column) -> Column:
    """A lower-case line without punctuation, or empty for a copyright line."""
    marked = F.contains(line, F.lit("copyright")) | F.contains(line, F.lit("(c)")) | F.contains(line, F.lit("©"))
    notice = marked & line.rlike(r"^[^\p{L}\p{N}]*(copyright\b(?=.*(©|\(c\)|\d{4}))|©|\(c\) *\d{4})")
    return F.when(notice, F.lit("")).otherwise(F.btrim(F.regexp_replace(line, r"[^\p{L}\p{N}]+", " ")))


def _lines(text: Column) -> Column:
    """The plain form of each line that has one."""
    return F.filter(F.transform(F.split(F.lower(text), "\n"), _plain), lambda x: F.length(x) > 0)


def _spelled(plain: Column) -> Column:
    # each word with spaces of its own, so that one match doesn't take the space that the next one begins with
    own = lambda words: " " + words.replace(" ", "  ") + " "
    out = F.concat(F.lit(" "), F.replace(plain, F.lit(" "), F.lit("  ")), F.lit(" "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(own(a)), F.lit(own(b)))
    return F.btrim(F.replace(F.replace(out, F.lit(own("all rights reserved")), F.lit("")), F.lit("  "), F.lit(" ")))


def _head(plain: Column) -> Column:
    return F.substring_index(plain, " ", HEAD)


def canonical(text: Column) -> Column:
    """The canonical form of a text; null stays null."""
    return _spelled(F.array_join(_lines(text), " "))


def digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the canonical form; null where that is empty or the text null."""
    c = canonical(text)
    return F.when(F.length(c) > 0, F.sha2(c, 256))


def known_licences(spark: SparkSession, texts=TEXTS, notices=NOTICES, digests=DIGESTS) -> DataFrame:
    """(unit, digest, length, head, license_id) of known texts; unit is `text` or `notice`, length that of the canonical form,
    head its first HEAD words.

    `digests` are (license_id, digest, length, head) of further texts.
    """
    rows = [("text", k, v) for k, v in texts] + [("notice", k, v) for k, v in notices]
    known = spark.createDataFrame(rows, "unit string, license_id string, body string")
    known = known.select("unit", "license_id", digest(F.col("body")).alias("digest"), F.length(canonical(F.col("body"))).alias("length"), _head(canonical(F.col("body"))).alias("head"))
    if digests:
        more = spark.createDataFrame(list(digests), "license_id string, digest string, length int, head string")
        known = known.unionByName(more.withColumn("unit", F.lit("text")))
    return known.groupBy("unit", "digest", "length", "head").agg(F.min("license_id").alias("license_id"))


def scan_licences(docs: DataFrame, known: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, license_id (of the whole text, or null), notice_ids (of its lines, sorted),
    has_license. `known` has columns unit, digest, length, license_id; a small one is broadcast, a large one shuffled.

    A unit too long for any known text of its kind is not hashed, as it can't be equal to one; nor is a text that begins
    otherwise, where a small `known` has a column head.
    """
    known = known_licences(docs.sparkSession) if known is None else known
    sizes = {r["unit"]: r for r in known.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("most")).collect()}
    heads = None
    if sum(r["n"] for r in sizes.values()) <= BROADCAST_ROWS:
        if "head" in known.columns:
            heads = [r[0] for r in known.where("unit = 'text'").select("head").distinct().collect()]
        known = F.broadcast(known.select("unit", "digest", "license_id"))
    most = {u: (r["most"] or 0) / LEAST_PART for u, r in sizes.items()}

    def fits(unit: str, length: Column, body: Column) -> Column:
        # only a text that is too long has to be written out without the phrase, which may stand in it often
        return (length <= most.get(unit, 0)) | (F.length(F.replace(body, F.lit("all rights reserved"), F.lit(""))) <= most.get(unit, 0))

    def candidates(unit: str, bodies: Column) -> Column:
        return F.transform(bodies, lambda x: F.struct(F.lit(unit).alias("unit"), x.alias("body")))

    rows = docs.select(F.col(doc_id).alias("of"), text_key(doc_id, text).alias("key"), _lines(F.col(text)).alias("lines"))
    joined = F.array_join("lines", " ")
    beginning = _spelled(F.substring_index(F.array_join(F.slice("lines", 1, BEGINNING), " "), " ", BEGINNING))
    likely = F.lit(True) if heads is None else (F.size(F.split(beginning, " ")) < LEFT) | _head(beginning).isin(heads)
    length = F.aggregate("lines", F.size("lines") - 1, lambda a, x: a + F.length(x))
    whole = F.when((F.size("lines") > 0) & likely, F.when(fits("text", length, joined), F.array(joined)))
    notices = F.filter("lines", lambda x: fits("notice", F.length(x), x))
    each = F.concat(F.coalesce(candidates("text", whole), F.array()), candidates("notice", notices))
    units = rows.select("of", "key", F.explode(each).alias("u")).select("of", "key", "u.unit", F.sha2(_spelled(F.col("u.body")), 256).alias("digest"))
    found = units.join(known, ["unit", "digest"]).groupBy("of", "key").agg(
        F.min(F.when(F.col("unit") == "text", F.col("license_id"))).alias("license_id"),
        F.sort_array(F.collect_set(F.when(F.col("unit") == "notice", F.col("license_id")))).alias("ids"),
    )
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    asked = docs.select(F.col(doc_id).alias("doc_id"), text_key(doc_id, text).alias("own"))
    return asked.join(found, (F.col("own") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("of")), "left").select(
        "doc_id", "license_id", ids.alias("notice_ids"), (F.col("license_id").isNotNull() | (F.size(ids) > 0)).alias("has_license")
    )
