"""The pipeline's stages over ``documents``: each calls one operator and lets its decisions take effect.

All but the last return the columns of documents. Rows and columns of a stage's
input that the stage has no say about pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelrisk.llm import chunks, langid, minhash, mixing, packing
from panelrisk.llm.queries import vocabulary
from panelrisk.session import bound_batches, cut_lineage


def _with_length(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text where the table has that column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def _apart(docs: DataFrame, *also: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with its columns renamed by place, so that they never meet an operator's, and
    those of ``also`` once more by name; the new names in the order of the columns."""
    inner = [f"c{i}" for i in range(len(docs.columns))]
    return docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(docs.columns, inner)], *also), inner


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any language (``und``) go; ``lang`` becomes the predicted one.

    Ambiguous documents stay: in the corpora seen they are clean prose in two
    languages. Null and empty texts, and those without a letter, are ``und`` and
    go; rows with a null id or language are predicted like the others; repeated
    rows are judged each; columns of any name pass through.
    """
    bound_batches(spark)
    model = langid.fit(docs.where(~langid.held_out()))
    rows, inner = _apart(docs, "text")
    out = langid.predict(model, rows, inner).where("lang_pred <> 'und'")
    return out.select(*[F.col("lang_pred" if c == "lang" else i).alias(c) for c, i in zip(docs.columns, inner)])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id, once.

    Decided row by row: of rows that share an id, those with the text that the
    group keeps stay. Rows with the same id and text stay once. Null and empty
    texts link with nothing and stay; a row without an id goes if its words equal
    a document's that has one, else it stays; columns of any name pass through.
    """
    bound_batches(spark)
    mark = F.xxhash64("text")  # tells the texts of one id apart
    kept = minhash.near_duplicates(docs.select("doc_id", "text", mark.alias("mark")), keep=["mark"]).where("kept")
    kept = cut_lineage(kept.groupBy("doc_id", "mark").agg(F.count("*").alias("n")))
    rows, inner = _apart(docs, "doc_id", "text")
    rows = rows.withColumn("id", F.col("doc_id").cast("long")).withColumn("mark", mark).drop("doc_id")

    def among(some: DataFrame) -> DataFrame:
        named = some.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"))
        return rows.join(named, F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left_semi")

    stay = among(kept.where("n = 1")) if kept.where("n > 1").isEmpty() else among(kept).dropDuplicates(["id", "mark"])
    return stay.select(*[F.col(i).alias(c) for c, i in zip(docs.columns, inner)])


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat are cut out of all but their first document.

    Rows that share an id count as one document; rows without an id, null and
    empty texts stay as they are; no row goes; columns of any name pass through.
    """
    bound_batches(spark)
    rows, inner = _apart(docs, "doc_id", "text")
    at = dict(zip(docs.columns, inner))
    out = chunks.dedup_substrings(rows.drop(at["text"]))
    return _with_length(out.select(*[F.col("text" if c == "text" else at[c]).alias(c) for c in docs.columns]))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row per copy taken, each shard in shuffled order.

    Documents that the mix does not take, and those without words, go; a null
    source is a source; rows that share an id are taken one after the other;
    columns of any name pass through.
    """
    bound_batches(spark)
    rows = mixing.shuffled(mixing.drawn_rows(docs))
    return _with_length(rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row per piece.

    A null or empty text is the end id alone; rows that share an id, or have
    none, are packed each; other columns are not read.
    """
    bound_batches(spark)
    return packing.pack(docs, vocabulary())
