"""URL filters: a blocked Bloom filter of the listed URLs, then an exact hash join of what passes it.

A listing entry is a host and the beginning of a path. It fits a URL whose host
is that host or a subdomain of it and whose path starts with that path; of the
entries that fit, the longest decides (ties: the longer host). A URL that no
entry fits gets the default verdict.

The filter holds two keys an entry: its host alone, and its host and path
together. Every key sets one bit in each of the eight words of one 512-bit
block, so a lookup touches one block. A URL is looked up in two steps: its host
and the parent domains first, then, for those that the filter knows, the
beginnings of the path of every listed length. Host and path lie side by side,
so every such key is a span of the same bytes and whole batches are hashed at
once. What the filter turns away cannot be listed and never leaves its task;
the rest goes to an equi-join with the listing, which removes the false
positives.

Bounds: the filter has ``BITS`` bits a key up to ``MAX_BLOCKS`` blocks (16 MB),
which is what the driver gathers and sends out. A longer listing makes the
filter fuller and the join larger, never the result different. Only the
distinct path lengths of the listing (at most as many as the longest path has
bytes) are gathered besides. The listing itself is joined by Spark's choice.

Cases: a null url, or one without ``://``, has an empty host and path, which
fit only an entry that lists them; case is folded for A-Z in hosts only; entries
with a null host or verdict are left out and a null path is empty; an entry
listed twice with different verdicts blocks; repeated rows are judged each;
columns of the input that are called like a result column give way to it;
an empty table or listing is no special case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from panelrisk.llm.textbytes import span_hashes, splitmix, text_blocks
from panelrisk.session import cut_lineage

BITS, MAX_BLOCKS, WORDS = 16, 1 << 18, 8
PROBES = 1 << 20  # keys that are tested at once
RESULT = ["host", "path", "rule", "verdict"]
_HOST_KEY = np.uint64(0xA5A5A5A55A5A5A5A)  # sets keys of hosts apart from keys of whole entries
_SALTS = splitmix(np.arange(WORDS, dtype=np.uint64)) | np.uint64(1)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Canonical host and path: what follows the first ``://`` up to ``/ ? #``, and from there up to ``? #``."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _blocks_of(hashes: np.ndarray, n_blocks: int) -> np.ndarray:
    return (splitmix(hashes) % np.uint64(n_blocks)).astype(np.int64)


def _masks(hashes: np.ndarray) -> np.ndarray:
    """One bit in each word of a key's block: an array of keys x words."""
    return np.uint64(1) << ((hashes[:, None] * _SALTS) >> np.uint64(58))


def _entry_bits(n_blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, data, offsets in text_blocks(batch.column(0)):
                host_end = offsets[:-1] + np.asarray(batch.column(1).slice(lo, len(offsets) - 1), np.int64)
                hashes = np.r_[span_hashes(data, offsets[:-1], host_end) ^ _HOST_KEY, span_hashes(data, offsets[:-1], offsets[1:])]
                words = _masks(hashes).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_blocks_of(hashes, n_blocks)), *[pa.array(words[:, j].copy()) for j in range(WORDS)]],
                    ["block", *[f"w{j}" for j in range(WORDS)]],
                )

    return run


def bloom_filter(entries: DataFrame) -> np.ndarray:
    """The filter over ``entries`` (key, host_bytes): an array of blocks x words, at most ``MAX_BLOCKS`` long."""
    n_blocks = min(MAX_BLOCKS, max(1, -(-2 * entries.count() * BITS // (64 * WORDS))))
    names = [f"w{j}" for j in range(WORDS)]
    bits = entries.select("key", "host_bytes").mapInArrow(_entry_bits(n_blocks), "block long, " + ", ".join(f"{w} long" for w in names))
    rows = bits.groupBy("block").agg(*[F.bit_or(w).alias(w) for w in names]).toArrow()
    table = np.zeros((n_blocks, WORDS), np.uint64)
    if rows.num_rows:
        table[rows["block"].to_numpy()] = np.stack([rows[w].to_numpy() for w in names], axis=1).view(np.uint64)
    return table


def _known(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    masks = _masks(hashes)
    return ((table[_blocks_of(hashes, len(table))] & masks) == masks).all(axis=1)


def _possible(table: np.ndarray, lengths: np.ndarray, data: np.ndarray, begin: np.ndarray, host_end: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, end) of the spans that the filter lets pass; ``lengths`` are the listed path lengths, sorted."""
    dots = np.flatnonzero(data == ord("."))
    row = np.searchsorted(begin, dots, side="right") - 1
    inside = dots < host_end[row]
    rows = np.r_[np.arange(len(begin)), row[inside]]
    starts = np.r_[begin, dots[inside] + 1]
    seen = _known(table, span_hashes(data, starts, host_end[rows]) ^ _HOST_KEY)
    rows, starts = rows[seen], starts[seen]
    tries = np.searchsorted(lengths, (end - host_end)[rows], side="right")
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    lo, done = 0, np.r_[0, np.cumsum(tries)]
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] + PROBES, side="right")) - 1)
        n = tries[lo:hi]
        which = np.repeat(np.arange(lo, hi), n)
        stops = host_end[rows[which]] + lengths[np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)]
        passed = _known(table, span_hashes(data, starts[which], stops))
        out.append((rows[which][passed], starts[which][passed], stops[passed]))
        lo = hi
    if not out:
        return (np.zeros(0, np.int64),) * 3
    row, first, stop = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(row, kind="stable")
    return row[order], first[order], stop[order]


def _probe(table, lengths: np.ndarray, names: list[str]):
    """Adds ``maybe``, the keys that the filter lets pass, to batches whose last columns are key and host_bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = table.value
        for batch in batches:
            key, host_bytes = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            for lo, data, offsets in text_blocks(key):
                n = len(offsets) - 1
                host_end = offsets[:-1] + np.asarray(host_bytes.slice(lo, n), np.int64)
                row, first, stop = _possible(filled, lengths, data, offsets[:-1], host_end, offsets[1:])
                raw = data.tobytes()
                keys = pa.array([raw[a:b].decode() for a, b in zip(first.tolist(), stop.tolist())], pa.string())
                maybe = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), keys)
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(lo, n) for i in range(batch.num_columns - 2)], maybe], names)

    return run


def judge(pages: DataFrame, listing: DataFrame, keep: list[str], url: str = "url", default: str = "allow") -> DataFrame:
    """``keep`` columns of every page with its host, path, rule (``host`` + ``path`` of the deciding entry, or null) and verdict.

    ``listing`` has the columns host, path and verdict.
    """
    spark: SparkSession = pages.sparkSession
    keep = [c for c in keep if c not in RESULT]
    entries = listing.where("host is not null and verdict is not null").select(
        F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    )
    entries = entries.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    entries = cut_lineage(
        entries.select(
            F.concat("host", "path").alias("key"),
            F.octet_length("host").cast("long").alias("host_bytes"),
            F.octet_length("path").cast("long").alias("path_bytes"),
            F.struct(F.char_length(F.concat("host", "path")), F.char_length("host")).alias("reach"),
            "verdict",
        )
    )
    table = spark.sparkContext.broadcast(bloom_filter(entries))
    lengths = np.array(sorted(r[0] for r in entries.select("path_bytes").distinct().collect()), np.int64)

    inner = [f"c{i}" for i in range(len(keep))]
    host, path = host_and_path(F.col(f"`{url}`").cast("string"))
    parts = pages.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(keep, inner)], host.alias("host"), path.alias("path"))
    names = [*inner, "host", "path", "maybe"]
    kinds = StructType([*parts.schema.fields, StructField("maybe", ArrayType(StringType()))])
    looked = parts.select("*", F.concat("host", "path"), F.octet_length("host").cast("long"))
    probed = cut_lineage(looked.mapInArrow(_probe(table, lengths, names), kinds))

    passed = probed.where(F.size("maybe") > 0)
    tried = passed.select("host", "path", F.explode(F.array_distinct("maybe")).alias("key")).distinct()
    rules = tried.join(entries, "key").groupBy("host", "path").agg(F.max_by(F.struct("key", "verdict"), "reach").alias("hit"))
    judged = passed.join(rules, ["host", "path"], "left")
    rest = probed.where(F.size("maybe") == 0).select(*inner, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    judged = judged.select(*inner, "host", "path", F.col("hit.key").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))
    out = judged.unionAll(rest)
    return out.select(*[F.col(i).alias(c) for c, i in zip(keep, inner)], *RESULT)
