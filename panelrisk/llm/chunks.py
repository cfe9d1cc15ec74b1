"""Substring dedup: content-defined chunks cut by a gear rolling hash, deduplicated by digest.

The gear hash of a position mixes the 16 bytes before it (each byte's random
code, shifted once per byte since). A cut is a word start whose hash is the
largest among the ``REACH`` word starts on either side, so cuts depend on
nearby content alone: an insertion moves the cuts around it and no others, and
chunks have no size limits that would carry a shift further. A chunk runs from
cut to cut, with its trailing white space left out of the digest.

A run of more than ``LONG_RUN`` characters without white space (Chinese, Japanese,
Thai, minified code, base64) is not one word: its words are the pieces between
the characters whose hash is the largest among ``REACH`` on either side, five
characters on average, so ``MIN_WORDS`` of them are about 120 characters. A stretch
of one repeated character has no such places and stays one word.

Every digest keeps its first occurrence (smallest doc_id, then position). A run
of later occurrences that lie side by side is removed when it has at least
``MIN_WORDS`` words, so a phrase that two texts share by chance stays. The
first occurrence is never removed: each removed passage is still in the corpus.

Plan: one pass emits (digest, doc_id, first place) once per document and
digest; a partially aggregated count finds shared digests; the shared ones
(few) go back to their documents, whose texts are cut a second time. No digest
is gathered in one task: a passage in a third of all documents is one
aggregated key and one skewed key of a plain join.

Cases: null stays null and empty stays empty, nothing removed; a text without
words is untouched; the first of several equal texts is kept and the others
lose every run of enough words; a row without an id has no place in the order,
so it is carried along untouched and nothing is removed for its sake; rows that share an id and a text count as one
document and are treated alike; extra columns are carried along untouched,
whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.llm.textbytes import byte_codes, span_hashes, splitmix, text_blocks, word_spans

WINDOW, REACH, MIN_WORDS, LONG_RUN = 16, 2, 24, 16


def gear_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hash after each byte over the last ``WINDOW`` bytes of its row: sum of code << age."""
    h, span = byte_codes(False)[data], 1
    full = np.diff(offsets) > 0
    begin, end = offsets[:-1][full][1:], offsets[1:][full][1:]  # before the first row lies nothing
    while span < WINDOW:
        older = np.zeros_like(h)
        older[span:] = h[:-span]
        for i in range(span):  # what lies before the row
            older[(begin + i)[begin + i < end]] = 0
        h = h + (older << np.uint64(span))
        span *= 2
    return h


def _largest(value: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which values are the largest among the ``REACH`` on either side in their group."""
    top = np.ones(len(value), dtype=bool)
    for d in range(1, REACH + 1):
        same = group[d:] == group[:-d]
        # of equal hashes the earlier one is the larger
        top[:-d] &= ~same | (value[:-d] >= value[d:])
        top[d:] &= ~same | (value[d:] > value[:-d])
    return top


def cut_words(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which words begin a chunk, by the hashes of their starts; the first word of every row does."""
    top = _largest(value, np.repeat(np.arange(len(at) - 1), np.diff(at)))
    top[at[:-1][np.diff(at) > 0]] = True
    return top


def _words(data: np.ndarray, offsets: np.ndarray, value: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, per-row index into them) of the words, long runs without white space in pieces."""
    starts, ends, at = word_spans(data, offsets)
    if not (ends - starts > LONG_RUN).any():
        return starts, ends, at
    lead = (data & 0xC0) != 0x80
    before = np.r_[0, np.cumsum(lead)]
    long = before[ends] - before[starts] > LONG_RUN
    if not long.any():
        return starts, ends, at
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts[long]] += 1
    edge[ends[long]] -= 1
    spot = np.flatnonzero((np.cumsum(edge[:-1]) > 0) & lead)
    pieces = np.union1d(starts, spot[_largest(value(spot), np.searchsorted(starts, spot, side="right"))])
    run = np.searchsorted(starts, pieces, side="right") - 1
    return pieces, np.minimum(np.r_[pieces[1:], len(data)], ends[run]), np.searchsorted(pieces, offsets)


def _chunks(data: np.ndarray, offsets: np.ndarray):
    """(row index into chunks, first byte, end byte, words, digest) of the chunks of each row."""
    hashes = gear_hashes(data, offsets)
    opens = np.zeros(len(data) + 1, dtype=bool)
    opens[offsets] = True

    def value(spot: np.ndarray) -> np.ndarray:
        """Hash of the bytes before a place; none at the start of a row."""
        out = splitmix(hashes[np.maximum(spot - 1, 0)]) if len(spot) else np.zeros(0, np.uint64)
        out[opens[spot]] = 0
        return out

    starts, ends, at = _words(data, offsets, value)
    first = np.flatnonzero(cut_words(value(starts), at))
    last = np.r_[first[1:], len(starts)] - 1
    return np.searchsorted(first, at), starts[first], ends[last] if len(first) else starts[first], last - first + 1, span_hashes(data, starts[first], ends[last] if len(first) else starts[first]).astype(np.int64)


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = np.asarray(batch.column(0))
        for lo, data, offsets in text_blocks(batch.column(1)):
            at, _, _, words, digest = _chunks(data, offsets)
            row = np.repeat(np.arange(len(at) - 1), np.diff(at))
            place = np.arange(len(digest)) - at[row]
            order = np.lexsort((place, digest, row))
            r, g = row[order], digest[order]
            new = np.r_[True, (r[1:] != r[:-1]) | (g[1:] != g[:-1])] if len(r) else np.zeros(0, bool)
            count = np.diff(np.r_[np.flatnonzero(new), len(r)])
            pick = order[new]
            yield pa.RecordBatch.from_arrays(
                [pa.array(digest[pick]), pa.array(ids[lo + row[pick]]), pa.array(place[pick].astype(np.int32)), pa.array((count > 1).astype(bool))],
                ["digest", "doc_id", "place", "again"],
            )


def _removed(data: np.ndarray, shared: dict[int, int], min_words: int) -> list[tuple[int, int]]:
    """Byte spans to remove from one text; ``shared``: digest -> place of its kept occurrence here, or -1."""
    offsets = np.array([0, len(data)])
    _, begin, end, words, digest = _chunks(data, offsets)
    later = np.array([shared.get(g, i) != i for i, g in enumerate(digest.tolist())], dtype=bool)
    edge = np.flatnonzero(np.diff(np.r_[False, later, False].astype(np.int8)))
    return [(int(begin[i]), int(end[j - 1])) for i, j in zip(edge[::2], edge[1::2]) if words[i:j].sum() >= min_words]


def _strip(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column("_text"), batch.column("_shared")
            out, spans, gone = [], [], []
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                digests = lists[i].as_py() if text else None
                if not digests:
                    out.append(text), spans.append([]), gone.append(0)
                    continue
                raw = text.encode()
                cuts = _removed(np.frombuffer(raw, np.uint8), {d["digest"]: d["place"] for d in digests}, min_words)
                parts, here, chars, where = [], 0, 0, []
                for a, b in cuts:
                    before, inside = raw[here:a].decode(), len(raw[a:b].decode())
                    chars += len(before)
                    where.append({"start": chars, "length": inside})
                    chars += inside
                    parts.append(before)
                    here = b
                out.append("".join([*parts, raw[here:].decode()])), spans.append(where), gone.append(sum(w["length"] for w in where))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in batch.schema.names if c not in ("_text", "_shared")], pa.array(out, pa.string()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), pa.array(gone, pa.int64())],
                [*[c for c in batch.schema.names if c not in ("_text", "_shared")], "_out", "_spans", "_gone"],
            )

    return run


def shared_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, place): chunks that occur more than once; place is that of the kept
    occurrence if this document holds it, else -1."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    seen = rows.mapInArrow(_emit, "digest long, doc_id long, place int, again boolean")
    first = F.min(F.struct("doc_id", "place"))
    shared = seen.groupBy("digest").agg(first.alias("f"), F.count("*").alias("n"), F.max("again").alias("again")).where("n > 1 OR again")
    shared = shared.select("digest", F.col("f.doc_id").alias("home"), F.col("f.place").alias("place"))
    here = seen.select("digest", "doc_id").join(shared, "digest")
    return here.select("doc_id", "digest", F.when(F.col("doc_id") == F.col("home"), F.col("place")).otherwise(-1).alias("place"))


def dedup_substrings(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``, plus ``removed_spans`` (code points of
    the old text) and ``removed_chars``; all other columns as they came."""
    marks = shared_chunks(docs).groupBy("doc_id").agg(F.collect_set(F.struct("digest", "place")).alias("_shared"))
    names = docs.columns
    rest = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c != "text"])
    packed = docs.select(F.col("doc_id").cast("long").alias("_id"), rest.alias("_rest"), F.col("text").cast("string").alias("_text"))
    joined = packed.join(marks.withColumnRenamed("doc_id", "_id"), "_id", "left").drop("_id")
    kind = joined.schema["_rest"].dataType.simpleString()
    done = joined.mapInArrow(_strip(min_words), f"_rest {kind}, _out string, _spans array<struct<start:bigint,length:bigint>>, _gone long")
    return done.select(
        *[F.col("_out").alias("text") if c == "text" else F.col(f"_rest.c{i}").alias(c) for i, c in enumerate(names)],
        F.col("_spans").alias("removed_spans"), F.col("_gone").alias("removed_chars"),
    )
