"""MinHash near-duplicates: fast similarity sketching, banding, exact verification.

Sketch: round i sends every element of a set into one of ``bins`` bins with
the value (i, fraction); a bin keeps its smallest value. Rounds ``bins`` to
``2 * bins - 1`` send every element into bin i - ``bins``, so every coordinate
is filled after them, and usually after a few. Two sets agree in a coordinate
with probability equal to their resemblance, with the concentration of
independent coordinates.

Plan: one pass over the texts makes (document, set size, set digest, band
keys); documents with the same set share one representative; representatives
meet by band key. Each is first verified against the most central document it
meets, the one with the most meetings (a star, linear in the rows). Only bucket
members that these links left in different components are then compared with
each other. They meet in blocks (see ``units``) as bitmaps of their sets: a bit
that one has and the other lacks is at least one shingle not shared, which
bounds the resemblance from above. That bound is exact, so only pairs that can
link leave a task, no bucket emits all its pairs, and no candidate that could
link is dropped. Every link is confirmed on the full shingle sets.

Cases: null or blank text has an empty set, links with nothing and is kept;
texts under five words form one shingle; repeated rows share a set and thus a
component; two rows with one id are two members of that component; an empty
table gives an empty table. Other columns are never read, so clashing names
cannot matter.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.llm.links import components
from panelrisk.llm.textbytes import shingle_hashes, span_hashes, splitmix, text_blocks, word_spans
from panelrisk.llm.units import block_units, runs, whole_units
from panelrisk.session import cut_lineage

BLOCK = 512
BINS, ROWS = 128, 4  # 32 bands of 4: a pair at resemblance 0.75 is missed with probability 5e-6
_LOW = np.uint64((1 << 56) - 1)


def sketch(elements: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Fast similarity sketch of a set of distinct uint64 hashes (not empty)."""
    out = np.full(bins, np.iinfo(np.uint64).max, dtype=np.uint64)
    n, done = len(elements), 0
    while done < 2 * bins and out.max() == np.iinfo(np.uint64).max:
        rounds = np.arange(done, min(2 * bins, done + max(1, 4 * bins // n)), dtype=np.uint64)[:, None]
        h = splitmix(elements[None, :] ^ splitmix(rounds + np.uint64(1 << 40)))
        # the low 56 bits are the fraction, the high ones the bin; late rounds fill one bin each
        where = np.where(rounds < bins, (h >> np.uint64(56)) % np.uint64(bins), rounds % np.uint64(bins))
        np.minimum.at(out, where.astype(np.int64).ravel(), ((rounds << np.uint64(56)) | (h & _LOW)).ravel())
        done += len(rounds)
    return out


def band_keys(coords: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One key per band of ``rows`` coordinates; the band's number is part of the key."""
    groups = coords.reshape(-1, rows)
    key = np.arange(len(groups), dtype=np.uint64)
    for j in range(rows):
        key = splitmix(key ^ groups[:, j]) * np.uint64(0x9E3779B97F4A7C15)
    return key


def _shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    for _, data, offsets in text_blocks(column):
        starts, ends, at = word_spans(data, offsets)
        words = span_hashes(data, starts, ends, fold_case=True)
        for i in range(len(offsets) - 1):
            yield shingle_hashes(words[at[i] : at[i + 1]])


def _set_id(s: np.ndarray) -> int:
    """Order-free 64-bit digest of a set, as a signed long."""
    total = np.add.reduce(splitmix(s)) ^ splitmix(np.array([len(s)], np.uint64))[0]
    return int(total.astype(np.int64))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, ids, keys = [], [], []
        for s in _shingle_sets(batch.column(1)):
            size.append(len(s))
            ids.append(_set_id(s))
            keys.append(band_keys(sketch(s)).astype(np.int64) if len(s) else np.zeros(0, np.int64))
        flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        ends = np.cumsum([0, *map(len, keys)])
        bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *batch.columns[2:], pa.array(size, pa.int64()), pa.array(ids, pa.int64()), bands],
            ["doc_id", *batch.schema.names[2:], "n_shingles", "sid", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(_shingle_sets(batch.column(1)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([_set_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["sid", "shingles"]
        )


def _bitmap(s: np.ndarray) -> np.ndarray:
    """One bit per hash bucket that the set touches; at least 8 bits per element, a power of two."""
    bits = np.zeros(max(64, 1 << int(8 * len(s) - 1).bit_length()), dtype=np.uint8)
    bits[(splitmix(s) & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in _shingle_sets(batch.column(1)):
            yield pa.RecordBatch.from_arrays([pa.array([_set_id(s)], pa.int64()), pa.array([_bitmap(s).tobytes()], pa.binary())], ["sid", "bits"])


def can_link(bits: list[np.ndarray], size: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each set i, the sets j > i that its bitmap cannot rule out.

    Sets that differ more in size than ``percent`` allows are ruled out; of the
    rest, a longer bitmap is folded to the shorter's length.
    """
    width = np.array([len(b) for b in bits])
    levels = {w: np.flatnonzero(width == w) for w in np.unique(width)}
    tables = {w: np.stack([bits[i] for i in at]) for w, at in levels.items()}
    for w in list(tables):
        if w // 2 in tables or w // 2 in levels:  # also as seen by sets of the next shorter length
            tables[-w] = tables[w][:, : w // 2] | tables[w][:, w // 2 :]
    for i in range(len(bits)):
        out = []
        for w, fold in ((width[i], False), (width[i] // 2, True), (2 * width[i], False)):
            at = levels.get(w)
            if at is None:
                continue
            later = at > i
            if not later.any():
                continue
            if w == width[i]:
                own, others = bits[i], tables[w][later]
            elif fold:  # the others are shorter
                own, others = bits[i][:w] | bits[i][w:], tables[w][later]
            else:
                own, others = bits[i], tables[-w][later]
            both = np.bitwise_count(others & own).sum(axis=1, dtype=np.int64)
            mine = size[i] - (int(np.bitwise_count(own).sum()) - both)
            theirs = size[at[later]] - (np.bitwise_count(others).sum(axis=1, dtype=np.int64) - both)
            most = np.minimum(mine, theirs)
            out.append(at[later][100 * most >= percent * (size[i] + size[at[later]] - most)])
        if out:
            yield i, np.sort(np.concatenate(out))


def _open_pairs(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_units(batches):
            a, b = [], []
            unit, part = np.asarray(batch.column("unit")), np.asarray(batch.column("c"))
            sid, block, size = (np.asarray(batch.column(c)) for c in ("sid", "block", "size"))
            for lo, hi in runs(unit):
                if (part[lo:hi] == part[lo]).all():
                    continue
                across = batch.column("across")[lo].as_py()
                bits = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("bits").slice(lo, hi - lo)]
                for i, js in can_link(bits, size[lo:hi], percent):
                    js = js[part[lo + js] != part[lo + i]]
                    if across:
                        js = js[block[lo + js] != block[lo + i]]
                    a.append(np.full(len(js), sid[lo + i]))
                    b.append(sid[lo + js])
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def _compare(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(s) > len(t):
                    s, t = t, s
                at = np.searchsorted(t, s)
                common = int((t[np.minimum(at, len(t) - 1)] == s).sum())
                keep.append(100 * common >= percent * (len(s) + len(t) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _texts_of(texts: DataFrame, classes: DataFrame, sids: DataFrame) -> DataFrame:
    """(doc_id, text) of the representatives of the given sets."""
    rows = classes.join(sids, "sid", "left_semi").select(F.col("rep").alias("doc_id")).distinct()
    return texts.join(rows, "doc_id", "left_semi").select("doc_id", "text")


def _verified(texts: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of set ids whose full sets have 100 * common >= percent * union.

    Sets are rebuilt from the texts of the representatives that occur in a pair.
    The members' sets (b, spread evenly) are attached first and the hub's (a)
    last: a hub with many pairs is a skewed side of a plain join, which adaptive
    execution splits.
    """
    wanted = pairs.select(F.col("a").alias("sid")).unionAll(pairs.select(F.col("b").alias("sid"))).distinct()
    sets = _texts_of(texts, classes, wanted).mapInArrow(_sets, "sid long, shingles binary")
    sets = cut_lineage(sets.join(wanted, "sid", "left_semi").dropDuplicates(["sid"]))
    both = pairs.join(sets.select(F.col("sid").alias("b"), F.col("shingles").alias("sb")), "b")
    both = both.join(sets.select(F.col("sid").alias("a"), F.col("shingles").alias("sa")), "a")
    return both.select("a", "b", "sa", "sb").mapInArrow(_compare(percent), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 75, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, *keep, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text, *keep).

    The bands and the bitmaps' lengths are made for resemblances of 75 per cent and more.
    """
    if not 75 <= percent <= 100:
        raise ValueError("percent must be between 75 and 100")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    more_columns = [f"k{i}" for i in range(len(keep))]
    carried = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`").alias(k) for c, k in zip(keep, more_columns)])
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in carried.schema.fields[2:])
    known = cut_lineage(carried.mapInArrow(_describe, f"doc_id long, {kinds}n_shingles long, sid long, bands array<long>"))
    # equal sets are one class; partial aggregation spreads a hot one
    alike = known.where("n_shingles > 0").groupBy("sid")
    classes = cut_lineage(alike.agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("size"), F.first("bands").alias("bands")))
    slots = classes.select("sid", F.explode("bands").alias("key"))
    meets = slots.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = cut_lineage(slots.join(meets, "key").select("key", "sid", "n"))

    central = members.groupBy("sid").agg(F.sum("n").alias("w"))
    hubs = members.join(central, "sid").groupBy("key").agg(F.max(F.struct("w", "sid")).alias("hub"))
    star = members.join(hubs, "key").where("sid <> hub.sid").groupBy(F.col("sid").alias("b")).agg(F.max("hub").alias("hub"))
    star = cut_lineage(star.select(F.col("hub.sid").alias("a"), "b"))
    links = cut_lineage(_verified(texts, classes, star, percent))
    found = components(links)

    # members of one bucket that are not yet connected: compare those that can still link
    placed = members.join(found.withColumnRenamed("node", "sid"), "sid", "left").select("key", "sid", "n", F.coalesce("component", "sid").alias("c"))
    mixed = placed.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("key")
    placed = cut_lineage(placed.join(mixed, "key", "left_semi"))
    left_over = placed.select("sid").distinct()
    bitmaps = _texts_of(texts, classes, left_over).mapInArrow(_bitmaps, "sid long, bits binary").dropDuplicates(["sid"])
    bitmaps = cut_lineage(bitmaps.join(classes.select("sid", "size"), "sid"))
    units = block_units(placed, "key", "n", "sid", BLOCK).select("unit", "block", "across", "sid", "c").join(bitmaps, "sid")
    units = units.repartition("unit").sortWithinPartitions("unit", "sid").select("unit", "block", "across", "sid", "c", "size", "bits")
    more = units.mapInArrow(_open_pairs(percent), "a long, b long").distinct()
    tried = star.select("a", "b").unionAll(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
    more = cut_lineage(more.join(tried, ["a", "b"], "left_anti"))
    links = links.unionAll(_verified(texts, classes, more, percent))

    found = components(links)
    least = found.join(classes.select(F.col("sid").alias("node"), "rep"), "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    named = found.join(least, "component").select(F.col("node").alias("sid"), "component_id")
    alone = classes.join(named, "sid", "left").select("sid", F.coalesce("component_id", "rep").alias("component_id"))
    out = known.select("doc_id", *more_columns, "n_shingles", "sid").join(alone, "sid", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", *[F.col(k).alias(c) for c, k in zip(keep, more_columns)], "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
