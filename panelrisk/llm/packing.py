"""Packing token sequences: best-fit decreasing over a segment tree of remaining capacities.

A document's ids (its text's, then the end id) are first cut into full windows;
what is left over is one shorter piece. Pieces are dealt into groups of about
``GROUP`` pieces by a hash, and every group is packed by one task: pieces in
order of falling length, each into the open window with the least remaining
room that still takes it. The open windows are counted by remaining room, and a
segment tree over those counts finds the tightest one in log(window) steps.

The texts are read and tokenised once; the packing sees lengths only. A group
is bounded by construction, whatever the length distribution, and wastes about
one window, so the padding does not depend on the number of groups.

Cases: a null or empty text is the end id alone; a text of any length is cut
freely and every id lies in exactly one piece; rows that share an id are packed
each on their own; other columns are not read; an empty table gives an empty
table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.llm.tokens import encode_column
from panelrisk.session import cut_lineage

WINDOW, END_ID, GROUP = 1024, 0, 20_000


class Rooms:
    """Open windows by remaining room, with the tightest fit found by a segment tree."""

    def __init__(self, window: int) -> None:
        self.width = 1 << window.bit_length()
        self.count = [0] * (2 * self.width)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, room: int, by: int) -> None:
        i = room + self.width
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, room: int, bin_id: int) -> None:
        if room:
            self.open[room].append(bin_id)
            self._add(room, 1)

    def tightest(self, need: int) -> int:
        """Smallest room >= need that some open window has, or -1."""
        i = need + self.width
        if self.count[i]:
            return need
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.width:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.width
            i >>= 1
        return -1

    def take(self, room: int) -> int:
        self._add(room, -1)
        return self.open[room].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every piece; pieces longer than the window are not allowed."""
    rooms, bins = Rooms(window), 0
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        room = rooms.tightest(need)
        if room < 0:
            room, where = window, bins
            bins += 1
        else:
            where = rooms.take(room)
        bin_of[i], offset[i] = where, window - room
        rooms.put(room - need, where)
    return bin_of, offset


def _pieces(path: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids_of = batch.column(0)
            row, start, length, crc, total = [], [], [], [], []
            for i, ids in enumerate(encode_column(batch.column(1), path)):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                for a in range(0, len(ids), window):
                    part = ids[a : a + window]
                    row.append(i), start.append(a), length.append(len(part)), crc.append(zlib.crc32(part.tobytes())), total.append(len(ids))
            yield pa.RecordBatch.from_arrays(
                [ids_of.take(pa.array(row, pa.int64())), *[pa.array(x, pa.int64()) for x in (start, length, crc, total)]],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return run


def _pack_group(window: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32", "doc_tokens"], ascending=[False, True, True, True, True]).reset_index(drop=True)
        where, offset = best_fit_decreasing(rows["length"].to_numpy(), window)
        rows["sequence_id"] = (int(key[0]) << 32) + where
        rows["offset"] = offset
        return rows[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return run


def pack(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row per piece."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = cut_lineage(texts.mapInArrow(_pieces(path, window), columns))
    groups = max(1, -(-pieces.count() // GROUP))
    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("g").applyInPandas(_pack_group(window), f"{columns}, sequence_id long, offset long")
