"""Document fingerprints: bottom-k sketches of hashed word shingles, in built-in expressions only.

A text's shingles are its runs of five words (A-Z folded); a text of fewer
words is one shingle, a text without words has none. A sketch is the sorted
list of the k smallest distinct shingle hashes (16 hexadecimal digits each).
The sketch of a union is the bottom k of the sketches' union, so sketches of
parts merge into the sketch of the whole; two sketches estimate resemblance,
containment and the number of distinct shingles.

The sort is kept short: hashes are uniform, so a text of n shingles first drops
those above twice the expected k-th smallest; only where too few distinct ones
stay (much repetition) the whole list is sorted.

Next documents: rows are dealt into ranges of ids, each of a few hundred rows
or more, and ordered inside their range; a range's last row meets the first row of the
next range by a join with one row per range. Whole texts move once.

Cases: a null text is an empty text; empty texts resemble each other fully and
anything else not at all; rows that share an id are ordered by text; a single document is its own next one; an empty table gives an empty
table; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, WIDTH, RANGE_ROWS, MAX_RANGES = 128, 5, 512, 4096


def shingle_digests(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: the hashes of the shingles of column ``text``, in text order, with repeats."""
    folded = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df = df.withColumn("_w", F.regexp_extract_all(folded, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    words = ", ".join(f"_w[i + {j}]" for j in range(WIDTH))
    many = f"transform(sequence(0, size(_w) - {WIDTH}), i -> substring(md5(concat_ws(' ', {words})), 1, 16))"
    few = "array(substring(md5(concat_ws(' ', _w)), 1, 16))"
    return df.withColumn(out, F.expr(f"CASE WHEN size(_w) >= {WIDTH} THEN {many} WHEN size(_w) > 0 THEN {few} ELSE CAST(array() AS array<string>) END")).drop("_w")


def bottom_k(df: DataFrame, digests: str, out: str, k: int = K) -> DataFrame:
    """Add ``out``: the sketch of the hash list ``digests``, which is dropped."""
    limit = f"CASE WHEN size({digests}) > {4 * k} THEN lpad(hex(CAST({2 * k} * (1152921504606846976 / size({digests})) AS bigint)), 15, '0') ELSE 'g' END"
    df = df.withColumn("_limit", F.lower(F.expr(limit)))
    df = df.withColumn("_low", F.expr(f"array_distinct(filter({digests}, h -> h < _limit))"))
    full = f"CASE WHEN size(_low) >= {k} OR _limit = 'g' THEN _low ELSE array_distinct({digests}) END"
    return df.withColumn(out, F.expr(f"slice(sort_array({full}), 1, {k})")).drop("_limit", "_low", digests)


def sketch(df: DataFrame, text: str, out: str, k: int = K) -> DataFrame:
    """Add column ``out``: the sketch of column ``text``."""
    return bottom_k(shingle_digests(df, text, "_h"), "_h", out, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two sketched sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the union that both sets have; exact while the union has at most k."""
    def share(both: Column) -> Column:
        last = F.element_at(both, -1)
        common = F.size(F.filter(F.array_intersect(a, b), lambda h: h <= last))
        return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(common / F.size(both))

    # a lambda over a single element names the merged sketch: it is made once per row
    return F.element_at(F.transform(F.array(merge(a, b, k)), share), 1)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    top = F.conv(F.substring(F.element_at(a, -1), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / top)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too (0 to 1); null if a has none."""
    shared = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.least(F.lit(1.0), shared / F.nullif(distinct_shingles(a, k), F.lit(0.0)))


def id_range(docs: DataFrame) -> Column:
    """Number of the range that a row's doc_id lies in; ranges hold about ``RANGE_ROWS`` rows each."""
    count = docs.count()
    ranges = max(1, min(MAX_RANGES, count // RANGE_ROWS))
    share = [i / ranges for i in range(1, ranges)]
    bounds = docs.agg(F.percentile_approx("doc_id", share, 20 * ranges).alias("b")).first()["b"] if share else []
    bounds = sorted({b for b in bounds or [] if b is not None})
    # position among the sorted bounds: blocks of 64 first, then inside the block
    coarse = F.array(*[F.lit(b).cast("bigint") for b in bounds[63::64]]) if len(bounds) >= 64 else F.array().cast("array<bigint>")
    everything = F.array(*[F.lit(b).cast("bigint") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    block = F.size(F.filter(coarse, lambda b: b <= F.col("doc_id"))) * 64
    inside = F.size(F.filter(F.slice(everything, block + 1, F.lit(64)), lambda b: b <= F.col("doc_id")))
    return F.coalesce(block + inside, F.lit(0)).alias("_range")


def with_next(rows: DataFrame, docs: DataFrame, spot: Column) -> DataFrame:
    """Add ``_next``: the struct (text, fp) of the following row of ``rows`` (doc_id, text, fp, _range),
    ascending by id; after the last comes the first. ``docs``: (doc_id, text) of the same rows."""
    first = docs.select("doc_id", spot).groupBy("_range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("n"), "doc_id")).alias("f"))
    first = first.select("_range", F.col("f.doc_id").alias("doc_id"))
    heads = docs.withColumnRenamed("doc_id", "_d").join(F.broadcast(first), F.col("_d").eqNullSafe(F.col("doc_id")))  # a row per range at most
    heads = sketch(heads.groupBy("_range").agg(F.min("text").alias("text")), "text", "fp").select("_range", F.struct("text", "fp").alias("_head"))
    turn = Window.partitionBy(F.lit(0)).orderBy("_range")  # one row per range
    heads = heads.select("_range", F.coalesce(F.lead("_head").over(turn), F.first("_head").over(turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_head"))

    order = Window.partitionBy("_range").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    rows = rows.withColumn("_lead", F.lead(F.struct("text", "fp")).over(order))
    return rows.join(heads, "_range").withColumn("_next", F.coalesce("_lead", "_head")).drop("_lead", "_head", "_range")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spot = id_range(docs)
    # texts move to their range first and are sketched there: sketches never move
    rows = sketch(docs.withColumn("_range", spot).repartition("_range"), "text", "fp")
    rows = with_next(rows, docs, spot)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.col("_next.text"), F.lit(1), half))
    rows = sketch(rows.select("doc_id", n.cast("long").alias("n_chars"), "fp", F.col("_next.fp").alias("fp_next"), edited.alias("edited")), "edited", "fp_edited")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.array_join("fp", "").alias("fingerprint"), F.array_join("fp_edited", "").alias("edited_fingerprint"),
        resemblance(F.col("fp"), F.col("fp_edited")).alias("near_edited"), resemblance(F.col("fp"), F.col("fp_next")).alias("near_next"),
    )
