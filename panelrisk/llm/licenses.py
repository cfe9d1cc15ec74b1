"""Licence scan by canonical digest: whole texts and single lines against known licences.

Normalisation: copyright and all-rights-reserved lines go; A-Z is folded; every
run of characters that are neither letters nor numbers becomes one space (line
breaks are kept until the lines have been looked up); equivalent spellings are
read as one. The SHA-256 of what is left is looked up by an equi-join with the
table of known digests, which is built here from ``license_texts`` through the
same expressions and holds a few hundred rows whatever the corpus: it is
broadcast under that bound. Documents never move.

Cases: null or blank text has the digest of the empty text and no licence; a
very long text is hashed whole; equal texts give equal rows; an empty table
gives an empty table; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelrisk.llm import license_texts as known

#: a line that names a holder: not the prose in which a licence speaks of copyright holders
COPYRIGHT_LINE = (
    r"(^|\n)[ \t*#/;<!%-]*((portions |parts )?copyright[ \t:,]*(\(c\)|©|[0-9]{4}|<|\[|by )|copyright [^\n]*[ ,](inc|ltd|llc|gmbh|corp|corporation)[ .,\n]"
    r"|spdx-filecopyrighttext:|\(c\)|©|all rights reserved)[^\n]*"
)
NOT_TEXT = r"[^\p{L}\p{N}\n]+"


def normal_lines(text: Column) -> Column:
    """The normalised lines of a text; null counts as empty."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ\r", "abcdefghijklmnopqrstuvwxyz\n")
    low = F.regexp_replace(low, COPYRIGHT_LINE, "\n")
    low = F.regexp_replace(low, NOT_TEXT, " ")
    return F.filter(F.transform(F.split(low, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def spell(line: Column) -> Column:
    """Equivalent spellings read as one; words are separated by single spaces."""
    out = F.concat(F.lit(" "), line, F.lit(" "))
    for a, b in known.SPELLINGS.items():
        out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.substring(out, F.lit(2), F.char_length(out) - 2)


def digest(line: Column) -> Column:
    return F.sha2(line.cast("binary"), 256)


def known_digests(spark) -> DataFrame:
    """(digest, spdx, kind): every known text with and without a title, and every notice line."""
    rows = []
    for spdx, text in known.TEXTS.items():
        rows += [(spdx, "text", f"{title}\n\n{text}") for title in ["", *known.TITLES.get(spdx, [])]]
    for spdx, names in known.NAMES.items():
        rows += [(spdx, "notice", form.format(name)) for form in known.NOTICES for name in names]
    table = spark.createDataFrame(rows, "spdx string, kind string, text string")
    whole = spell(F.array_join(normal_lines(F.col("text")), " "))
    return table.select(digest(whole).alias("digest"), "kind", "spdx").groupBy("kind", "digest").agg(F.min("spdx").alias("spdx"))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, license, notices, n_notices) for every row of ``docs`` (doc_id, text).

    ``license``: identifier of the licence that the whole text is, "<identifier> header" where it
    is that licence's file-header notice alone, else empty.
    ``notices``: sorted identifiers of the licences that lines refer to, comma-separated;
    ``n_notices``: number of such lines.
    """
    table = known_digests(docs.sparkSession)
    texts = F.broadcast(table.where("kind = 'text'").select(F.col("digest").alias("_t"), F.col("spdx").alias("license")))
    notices = table.where("kind = 'notice'").agg(F.map_from_entries(F.collect_list(F.struct("digest", "spdx"))).alias("_notices"))
    rows = docs.select("doc_id", normal_lines(F.col("text").cast("string")).alias("_lines"))
    # every known notice holds the word license; other lines cannot match
    hinted = F.filter("_lines", lambda x: x.contains("licen") | x.contains("released under") | x.contains("distributed under"))
    rows = rows.select("doc_id", digest(spell(F.array_join("_lines", " "))).alias("digest"), F.transform(hinted, lambda x: digest(spell(x))).alias("_d"))
    rows = rows.join(F.broadcast(notices)).withColumn("_hits", F.filter(F.transform("_d", lambda d: F.col("_notices")[d]), lambda s: s.isNotNull()))
    rows = rows.join(texts, F.col("digest") == F.col("_t"), "left")
    return rows.select(
        "doc_id", "digest", F.coalesce("license", F.lit("")).alias("license"),
        F.array_join(F.array_sort(F.array_distinct("_hits")), ",").alias("notices"), F.size("_hits").cast("long").alias("n_notices"),
    )
