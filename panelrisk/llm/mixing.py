"""Mixing sources to target weights: exact block quotas split down a tree of output shards.

Targets: sources in code-point order (null last) weigh 5, 2, 1, 5, 2, 1, ...
and share 1.5 times all words; a source stops at twice its own words and the
excess is shared again by weight, until none is above. With the sources sorted
by cap / weight that fixed point is one running sum: the common level is that
of the first source whose cap is not below it.

Draw: the documents of a source are permuted by a hash and cut into blocks of
about ``BLOCK`` documents. A source gives whole copies of all its blocks, then
the first blocks of the permutation up to its target's last word; only the
block on that edge is ordered document by document, and only the document on
the edge gives a part of its words. Where a block begins comes from running
sums over spans of ``SPAN`` blocks, then within each span.

Shards: every (source, copy, block) drawn is a unit. The tree halves the
shards level by level, to about ``SHARD_WORDS`` words; the units that go left
are the half with the smaller keys of that level, so the counts per source are
a multivariate hypergeometric draw and every quota is exact. Ranks within a
node come from 4,096 key ranges, so no node meets in one task. Inside a shard,
rows are shuffled by ``shuffle_key``.

All draws are hashes of ids: reruns agree. Only the table of sources (one row
each) and of blocks are ever joined to the documents; a source that holds a
third of all rows is a third of the blocks.

Cases: a null source is a source, last in order; null or blank text has size 0
and is never taken; rows that share source, id and size have one place in the
permutation and count one after the other: on the edge some are taken whole,
one in part, the rest not; if all sizes are 0 every target is 0; an empty table
gives an empty table; extra columns are carried along untouched, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelrisk.session import cut_lineage

WEIGHTS, SHARE, CAP, BLOCK, SEED = (5, 2, 1), 1.5, 2, 256, "mix-1"
SPAN = 1024  # blocks that are summed up together
SHARD_WORDS, MIN_LEVELS = 1 << 26, 4  # words of a shard at most; 16 shards at least


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _place(doc_id: Column) -> Column:
    """Place in the permutation, as 32 hexadecimal digits."""
    return F.md5(F.concat(F.lit(SEED + "|"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def _block(place: Column, blocks: Column) -> Column:
    return F.shiftright(F.conv(F.substring(place, 1, 8), 16, 10).cast("long") * blocks, 32)


def targets(sized: DataFrame) -> DataFrame:
    """One row per source: (source, rank, docs, source_size, target, quota, blocks)."""
    own = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))  # one row per source
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    own = own.withColumn("rank", rank).withColumn("w", weight.cast("long")).withColumn("cap", F.col("source_size") * CAP)
    by_level = Window.orderBy((F.col("cap") / F.col("w")).asc(), "rank")
    whole = Window.partitionBy(F.lit(0))
    own = own.withColumn("fixed", F.sum("cap").over(by_level) - F.col("cap"))
    own = own.withColumn("open", F.sum("w").over(whole) - F.sum("w").over(by_level) + F.col("w"))
    own = own.withColumn("level", (F.sum("source_size").over(whole) * SHARE - F.col("fixed")) / F.col("open"))
    level = F.min(F.when(F.col("cap") / F.col("w") >= F.col("level"), F.struct(F.col("cap") / F.col("w"), "rank", "level"))).over(whole)
    own = own.withColumn("level", level["level"])
    target = F.least(F.col("cap").cast("double"), F.col("w") * F.col("level"))
    return own.select(
        "source", "rank", "docs", "source_size", target.alias("target"), F.floor(target + 0.5).cast("long").alias("quota"),
        F.ceil(F.col("docs") / BLOCK).cast("long").alias("blocks"),
    )


def _split(units: DataFrame, level: int) -> DataFrame:
    """One level of the tree: the half of every node's units with the smaller keys goes left."""
    key = F.md5(F.concat_ws("|", F.lit(f"{SEED}/{level}"), "rank", "copy", "block").cast("binary"))
    units = units.withColumn("key", key).withColumn("bucket", F.substring(key, 1, 3))
    counts = units.groupBy("node", "bucket").agg(F.count("*").alias("n"))
    node = Window.partitionBy("node")
    counts = counts.select(
        "node", "bucket", (F.sum("n").over(node.orderBy("bucket")) - F.col("n")).alias("before"), F.floor(F.sum("n").over(node) / 2).alias("left")
    )
    spot = F.row_number().over(Window.partitionBy("node", "bucket").orderBy("key", "rank", "copy", "block")) + F.col("before")
    units = units.join(counts, ["node", "bucket"])
    return units.select("rank", "copy", "block", (F.col("node") * 2 + F.when(spot <= F.col("left"), 0).otherwise(1)).alias("node"))


def levels(words: float) -> int:
    """Levels of the tree for a mix of so many words."""
    return max(MIN_LEVELS, math.ceil(math.log2(max(1.0, words / SHARD_WORDS))))


def _before(blocks: DataFrame) -> DataFrame:
    """Adds ``before``, the words of a source's earlier blocks."""
    spans = blocks.withColumn("span", F.floor(F.col("block") / SPAN))
    own = spans.groupBy("rank", "span").agg(F.sum("words").alias("all"))
    own = own.select("rank", "span", (F.sum("all").over(Window.partitionBy("rank").orderBy("span")) - F.col("all")).alias("ahead"))
    inside = F.sum("words").over(Window.partitionBy("rank", "span").orderBy("block")) - F.col("words")
    return spans.withColumn("inside", inside).join(own, ["rank", "span"]).withColumn("before", F.col("inside") + F.col("ahead")).drop("span", "inside", "ahead")


def draw(sized: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From (doc_id, source, size): the sources; the drawn (rank, block) with the copies' shards;
    and, for the (rank, doc_id, size) of edge blocks, the words that all such rows give together."""
    sources = cut_lineage(targets(sized))
    known = sources.withColumnRenamed("source", "_source")
    docs = sized.join(known, F.col("source").eqNullSafe(F.col("_source"))).withColumn("place", _place(F.col("doc_id")))
    docs = docs.withColumn("block", _block(F.col("place"), F.col("blocks")))
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size"))).otherwise(0).cast("long")
    sums = docs.groupBy("rank", "block").agg(F.sum("size").alias("words"))
    table = sums.join(sources.select("rank", "source_size", "quota"), "rank").withColumn("copies", copies)
    table = _before(table.withColumn("rest", F.col("quota") - F.col("copies") * F.col("source_size")))
    part = F.greatest(F.lit(0), F.least(F.col("words"), F.col("rest") - F.col("before")))  # words of the last, partial copy
    blocks = cut_lineage(table.withColumn("part", part).select("rank", "block", "words", "copies", "rest", "before", "part"))

    drawn = F.col("copies") + F.when(F.col("part") > 0, 1).otherwise(0)
    units = blocks.where((F.col("words") > 0) & (drawn > 0)).select("rank", "block", F.explode(F.sequence(F.lit(1), drawn)).alias("copy"), F.lit(0).cast("long").alias("node"))
    for level in range(levels(sources.agg(F.sum("target")).first()[0] or 0)):
        units = _split(units, level)
        if level % MIN_LEVELS == MIN_LEVELS - 1:
            units = cut_lineage(units)
    shards = units.groupBy("rank", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("copy", "node"))), lambda u: u["node"]).alias("shards"))
    blocks = cut_lineage(blocks.join(shards, ["rank", "block"], "left"))

    edge = blocks.where("part > 0 AND part < words").select("rank", "block", (F.col("rest") - F.col("before")).alias("need"))
    rows = docs.join(edge, ["rank", "block"]).groupBy("rank", "block", "place", "doc_id", "size", "need").agg(F.count("*").alias("rows"))
    order = Window.partitionBy("rank", "block").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_of = F.col("size") * F.col("rows")
    gives = F.greatest(F.lit(0), F.least(all_of, F.col("need") - (F.sum(all_of).over(order) - all_of)))
    return sources, blocks, cut_lineage(rows.select("rank", "doc_id", "size", "rows", gives.alias("gives")))


def place_documents(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Every row of ``docs`` (doc_id, source, text, ...) with columns ``keep`` and size, source_size,
    target, taken, and ``copies``: an array of (words, shard), whole copies first."""
    sized = cut_lineage(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    sources, blocks, parts = draw(sized)
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]).alias("_rest"), F.col("doc_id").alias("_id"), F.col("source").alias("_source"), n_words(F.col("text")).alias("size"))
    return _attach(rows, sources, blocks, parts, keep)


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds ``number``, 0, 1, ... among the rows of a source, counted per written partition first."""
    rows = cut_lineage(rows.withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_p", F.shiftright("_at", 33))
    counts = rows.groupBy("rank", "_p").agg(F.count("*").alias("_n"))
    counts = counts.select("rank", "_p", (F.sum("_n").over(Window.partitionBy("rank").orderBy("_p")) - F.col("_n")).alias("_ahead"))
    local = F.row_number().over(Window.partitionBy("rank", "_p").orderBy("_at")) - 1
    return rows.withColumn("_local", local).join(counts, ["rank", "_p"]).withColumn("number", F.col("_local") + F.col("_ahead")).drop("_at", "_p", "_local", "_ahead")


def _attach(rows: DataFrame, sources: DataFrame, blocks: DataFrame, parts: DataFrame, keep: list[str]) -> DataFrame:
    own = sources.select("source", "rank", "source_size", "target", "blocks")
    out = rows.join(own, F.col("_source").eqNullSafe(F.col("source"))).withColumn("block", _block(_place(F.col("_id")), F.col("blocks")))
    out = out.join(blocks.select("rank", "block", "words", "copies", "part", "shards"), ["rank", "block"], "left")
    given = parts.select(F.col("rank").alias("_r"), F.col("doc_id").alias("_d"), F.col("size").alias("_s"), "gives", "rows")
    out = out.join(given, (F.col("rank") == F.col("_r")) & F.col("_id").eqNullSafe(F.col("_d")) & (F.col("size") == F.col("_s")), "left").drop("_r", "_d", "_s")
    out = out.withColumn("gives", F.when(F.col("part") <= 0, 0).when(F.col("part") >= F.col("words"), F.col("size") * F.coalesce("rows", F.lit(1))).otherwise(F.coalesce("gives", F.lit(0))))
    # one place a source at most is cut through; only there do equal rows differ
    cut = (F.col("gives") > 0) & (F.col("gives") < F.col("size") * F.col("rows"))
    repeated = parts.where("rows > 1 AND gives > 0 AND gives < size * rows")
    if not repeated.isEmpty():
        many = F.coalesce(cut & (F.col("rows") > 1), F.lit(False))
        out = out.where(~many).withColumn("number", F.lit(0).cast("long")).unionByName(_numbered(out.where(many)))
    else:
        out = out.withColumn("number", F.lit(0).cast("long"))
    whole_rows = F.when(F.coalesce(cut, F.lit(False)), F.greatest(F.lit(0), F.least(F.col("size"), F.col("gives") - F.col("number") * F.col("size"))))
    last = F.coalesce(whole_rows, F.when(F.col("gives") > 0, F.col("size")), F.lit(0)).cast("long")
    whole = F.coalesce("copies", F.lit(0))
    amounts = F.concat(F.array_repeat(F.col("size"), whole.cast("int")), F.array(last))
    placed = F.filter(F.zip_with(amounts, F.coalesce("shards", F.array().cast("array<bigint>")), lambda w, s: F.struct(w.alias("words"), s.alias("shard"))), lambda p: p["words"] > 0)
    return out.select(
        *[F.col(f"_rest.c{i}").alias(c) for i, c in enumerate(keep)], "size", "source_size", "target", (whole * F.col("size") + last).alias("taken"), placed.alias("copies")
    )


def _first_words(text: Column, n: Column) -> Column:
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), 0), 1, n.cast("int")), " ")


def drawn_rows(docs: DataFrame) -> DataFrame:
    """The mix, a row per copy: ``row`` (a struct of all columns of ``docs``), shard and shuffle_key.

    A copy of fewer words than its document holds the first ones, joined by spaces.
    """
    names = docs.columns
    hidden = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "doc_id", "source", "text")
    rows = place_documents(hidden, ["row"]).select("row", "size", F.posexplode("copies").alias("copy", "c"))
    text = F.when(F.col("c.words") < F.col("size"), _first_words(F.col("row.text"), F.col("c.words"))).otherwise(F.col("row.text"))
    row = F.struct(*[text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in names])
    key = F.md5(F.concat_ws("|", F.lit(SEED + "/local"), F.col("row.doc_id").cast("string"), F.col("copy")).cast("binary"))
    return rows.select(row.alias("row"), F.col("c.shard").alias("shard"), key.alias("shuffle_key"))


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: the columns of ``docs`` but for ``shard`` and ``shuffle_key``, and those two."""
    own = [c for c in docs.columns if c not in ("shard", "shuffle_key")]
    return drawn_rows(docs).select(*[F.col("row").getField(c).alias(c) for c in own], "shard", "shuffle_key")


def shuffled(drawn: DataFrame) -> DataFrame:
    """Rows in shuffled order within their shard; a task sorts a sixteenth of a shard, cut by the order itself."""
    return drawn.repartition("shard", F.substring("shuffle_key", 1, 1)).sortWithinPartitions("shard", "shuffle_key")


def write_shards(mixed: DataFrame, path: str) -> None:
    """One folder per shard; its files hold the sixteenths of its shuffled order."""
    slice_of = F.substring("shuffle_key", 1, 1)
    shuffled(mixed).withColumn("slice", slice_of).drop("shuffle_key").write.partitionBy("shard", "slice").parquet(path)
