"""Cross-tokenizer alignment: interval coalescing over the byte ranges of two tokenisations.

A text, with a space put before it, is encoded by a byte-level BPE (A) and by a
SentencePiece model (B). Every token becomes the byte range that it spells. All
ranges of a run of texts are lexsorted by start; the running maximum of their
ends (``maximum.accumulate``) closes a group wherever a start reaches it, so a
group is a shortest stretch on whose both ends A and B agree. Within the groups
the overlaps are expanded: each A range meets the B ranges between the first one
that ends behind its start and the last one that starts before its end.

``token_groups`` returns the groups themselves. ``alignment`` returns a row per
document, whose link figures need the whole corpus: how many documents hold an
id pair. It reads and encodes the texts once and writes blocks of about
``BLOCK`` (document, pair) entries: the distinct pairs of the block, how many of
its documents hold each, and per document the places of its pairs in that list.
The pair counts are a grouped sum over the blocks' lists, and go back to the
blocks by an equi-join on the pair and a cogroup on the block, so what moves is
a block's distinct pairs, not every document's. A task holds one block; the
pairs of one A id are at most as many as B's vocabulary.

Cases: a text that is null or empty, or that one of the vocabularies does not
spell back byte for byte (for B a text that holds U+2581), has no tokens:
zeros, and '' as the digest; the strings of special tokens are plain text;
texts of any length; rows that share an id count as documents of their own; a
null id is carried; other columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelrisk.llm.textbytes import span_hashes, text_blocks
from panelrisk.llm.tokens import PieceMemory, encoder
from panelrisk.session import cut_lineage

BLOCK = 1 << 20  # (document, pair) entries of a block
TEXT_BYTES, TEXT_ROWS = 1 << 19, 1 << 15  # texts that are aligned at once
_ID_BITS = 24  # ids of either vocabulary fit
_SPACE = 0x20
_META = "▁"  # stands for a space in SentencePiece pieces


class PieceModel:
    """A SentencePiece model with a memory of the words that it has met.

    No piece holds a space behind another character, so no merge crosses from a
    word into the spaces before the next one: the ids of a text are those of its
    stretches of spaces and the characters after them. A model with such pieces is refused.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        if any(_META in p.lstrip(_META) for p in pieces):
            raise ValueError("a piece of this model reaches over a space")
        self.spelled = [bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace(_META, " ").encode() for i, p in enumerate(pieces)]
        self.sizes = np.array([len(x) for x in self.spelled], np.int64)
        self.memory = PieceMemory()

    def _ids(self, words: list[bytes]) -> list[list[int]]:
        # the model puts a space before what it is given
        found = self.model.encode([w[1:].decode() for w in words], num_threads=1)
        return [ids if w != b" " else [self.model.piece_to_id(_META)] for w, ids in zip(words, found)]

    def _learn(self, words: list[bytes]) -> tuple[list[list[int]], list[bool]]:
        ids = self._ids(words)
        return ids, [b"".join([self.spelled[i] for i in x]) == w for x, w in zip(ids, words)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids end to end, row offsets into them, rows that are spelled back); every row begins with a space or is empty."""
        space = data == _SPACE
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        edges = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[edges] = True
        begin = np.flatnonzero(begins)
        end = np.r_[begin[1:], len(data)] if len(begin) else begin
        rows = np.searchsorted(begin, offsets)
        ids, at, good = self.memory.ids_of(span_hashes(data, begin, end), data, begin, end, self._learn)
        bad = np.r_[0, np.cumsum(~good)]
        return ids, at[rows], bad[rows[1:]] == bad[rows[:-1]]


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


@lru_cache(maxsize=2)
def _byte_sizes(path: str) -> np.ndarray:
    """Bytes that each id of a byte-level vocabulary stands for (one character of its spelling is one byte)."""
    model = encoder(path).tokenizer
    sizes = np.zeros(model.get_vocab_size(with_added_tokens=True), np.int64)
    for token, i in model.get_vocab(with_added_tokens=True).items():
        sizes[i] = len(token)
    return sizes


class Aligned(NamedTuple):
    """Tokens, groups and links of a run of rows; token arrays are in text order."""

    ids: tuple[np.ndarray, np.ndarray]
    row: tuple[np.ndarray, np.ndarray]  # of each token
    start: tuple[np.ndarray, np.ndarray]  # byte offset of each token in the run
    group: tuple[np.ndarray, np.ndarray]  # of each token, from 0
    group_row: np.ndarray
    base: np.ndarray  # byte offset of each row in the run
    link: tuple[np.ndarray, np.ndarray]  # A token, B token


def _ranges(ids: np.ndarray, at: np.ndarray, sizes: np.ndarray, base: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, row, start, end) of the tokens of the good rows."""
    row = np.repeat(np.arange(len(good)), np.diff(at))
    kept = good[row]
    ids, row = ids[kept], row[kept]
    size = sizes[ids]
    done = np.cumsum(size) - size
    first = np.searchsorted(row, np.arange(len(good)))
    lead = base[:-1] - np.r_[done, 0][np.minimum(first, len(done))]
    start = done + lead[row]
    return ids, row, start, start + size


def align_rows(data: np.ndarray, offsets: np.ndarray, path_a: str, path_b: str) -> Aligned:
    """Align the texts of a run of rows."""
    some = np.flatnonzero(offsets[:-1] < offsets[1:])
    data = np.insert(data, offsets[some], _SPACE)
    added = np.zeros(len(offsets), np.int64)
    added[some + 1] = 1
    offsets = offsets + np.cumsum(added)
    model_b = piece_model(path_b)
    ids_b, at_b, good = model_b.encode(data, offsets)
    ids_a, at_a = encoder(path_a).encode(data, offsets)
    sizes_a = _byte_sizes(path_a)
    total = np.r_[0, np.cumsum(sizes_a[ids_a])]
    good &= np.diff(total[at_a]) == np.diff(offsets)
    a, row_a, start_a, end_a = _ranges(ids_a, at_a, sizes_a, offsets, good)
    b, row_b, start_b, end_b = _ranges(ids_b, at_b, model_b.sizes, offsets, good)

    kind = np.repeat(np.array([0, 1], np.int8), [len(a), len(b)])
    starts, ends = np.r_[start_a, start_b], np.r_[end_a, end_b]
    order = np.lexsort((kind, starts))
    reach = np.maximum.accumulate(ends[order])
    breaks = np.ones(len(order), dtype=bool)
    breaks[1:] = starts[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks) - 1
    group_row = np.r_[row_a, row_b][order[breaks]]

    lo = np.searchsorted(end_b, start_a, side="right")
    n = np.searchsorted(start_b, end_a, side="left") - lo
    link_a = np.repeat(np.arange(len(a)), n)
    link_b = np.arange(len(link_a)) + np.repeat(lo - (np.cumsum(n) - n), n)
    return Aligned((a, b), (row_a, row_b), (start_a, start_b), (group[: len(a)], group[len(a) :]), group_row, offsets, (link_a, link_b))


@lru_cache(maxsize=4)
def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 .. n-1, right-aligned, and where they are."""
    width = len(str(max(n - 1, 0)))
    places = np.arange(n)[:, None] // 10 ** np.arange(width - 1, -1, -1)
    shown = places > 0
    shown[:, -1] = True
    return (places % 10 + ord("0")).astype(np.uint8), shown


def _digests(run: Aligned, n_rows: int) -> list[str]:
    """SHA-256 of ``a,a|b;a|b,b`` of each row, '' without tokens."""
    n_groups = len(run.group_row)
    many = [np.bincount(g, minlength=n_groups) for g in run.group]
    before = [np.r_[0, np.cumsum(m)] for m in many]  # tokens of earlier groups
    total = len(run.ids[0]) + len(run.ids[1])
    width = max(len(str(max((int(i.max()) for i in run.ids if len(i)), default=0))), 1)
    digits, shown = _digits(10**width)
    text = np.zeros((total, width + 1), np.uint8)
    used = np.ones((total, width + 1), dtype=bool)
    last_group = np.ones(n_groups, dtype=bool)  # of its row
    last_group[:-1] = run.group_row[1:] != run.group_row[:-1]
    for k, mark in ((0, ord("|")), (1, ord(";"))):
        ids, group = run.ids[k], run.group[k]
        spot = np.arange(len(ids)) + before[1 - k][group + k]
        text[spot, :width], used[spot, :width] = digits[ids], shown[ids]
        ends = np.ones(len(ids), dtype=bool)
        ends[:-1] = group[1:] != group[:-1]
        text[spot, width] = np.where(ends, mark, ord(","))
        if k:
            used[spot[ends & last_group[group]], width] = False
    raw = text[used].tobytes()
    size = np.r_[0, np.cumsum(used.sum(axis=1))]
    tokens = sum(np.bincount(r, minlength=n_rows) for r in run.row)
    at = size[np.r_[0, np.cumsum(tokens)]].tolist()
    return [hashlib.sha256(raw[x:y]).hexdigest() if x < y else "" for x, y in zip(at, at[1:])]


_BLOCK_TYPE = pa.schema(
    [("block", pa.int64()), ("pairs", pa.list_(pa.int64())), ("held", pa.list_(pa.int32())), ("doc_id", pa.list_(pa.int64()))]
    + [(c, pa.list_(pa.int64())) for c in ("n_a", "n_b", "n_groups", "n_links")]
    + [("groups_sha256", pa.list_(pa.string())), ("entries", pa.list_(pa.int32())), ("places", pa.binary()), ("times", pa.binary())]
)
_BLOCK_SQL = (
    "block long, pairs array<long>, held array<int>, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "groups_sha256 array<string>, entries array<int>, places binary, times binary"
)


class _Block:
    """Documents gathered until they hold enough pair entries."""

    def __init__(self) -> None:
        self.docs: list[list[pa.Array]] = []
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.entries: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: pa.Array, run: Aligned) -> None:
        n = len(doc_id)
        a, b = run.link
        keys = (run.row[0][a].astype(np.uint64) << np.uint64(2 * _ID_BITS)) | (run.ids[0][a].astype(np.uint64) << np.uint64(_ID_BITS)) | run.ids[1][b].astype(np.uint64)
        keys, times = np.unique(keys, return_counts=True)
        self.pairs.append((keys & np.uint64((1 << 2 * _ID_BITS) - 1)).astype(np.int64))
        self.times.append(times.astype(np.int32))
        self.entries.append(np.bincount((keys >> np.uint64(2 * _ID_BITS)).astype(np.int64), minlength=n))
        counts = [np.bincount(x, minlength=n) for x in (*run.row, run.group_row, run.row[0][a])]
        self.docs.append([doc_id, *map(pa.array, counts), pa.array(_digests(run, n), pa.string())])
        self.size += len(keys)

    def flush(self, block: int) -> pa.RecordBatch:
        pairs, place, held = np.unique(np.concatenate(self.pairs), return_inverse=True, return_counts=True)
        entries = np.concatenate(self.entries)
        step = np.diff(place, prepend=0)  # places rise within a document
        first = (np.cumsum(entries) - entries)[entries > 0]
        step[first] = place[first]
        blobs = [pa.compress(x.astype("<i4").tobytes(), codec="zstd", asbytes=True) for x in (step, np.concatenate(self.times))]
        lists = [pa.concat_arrays([d[i] for d in self.docs]) for i in range(6)]
        values = [block, pairs, held.astype(np.int32), *lists, entries.astype(np.int32), *blobs]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _BLOCK_TYPE)], schema=_BLOCK_TYPE)


def _blocks(path_a: str, path_b: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, open_block = TaskContext.get().partitionId() << 32, _Block()
        for batch in batches:
            for lo, data, offsets in text_blocks(batch.column(1), TEXT_BYTES, TEXT_ROWS):
                open_block.add(batch.column(0).slice(lo, len(offsets) - 1), align_rows(data, offsets, path_a, path_b))
                if open_block.size >= most:
                    yield open_block.flush(at)
                    at, open_block = at + 1, _Block()
        if open_block.docs:
            yield open_block.flush(at)

    return run


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _figures(block: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of a block, with the corpus-wide counts of its pairs."""
    place = counts["place"].to_numpy()
    held, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    held[place], best[place] = counts["docs"].to_numpy(), counts["best"].to_numpy()
    row = {c: block[c].combine_chunks() for c in block.column_names}
    step, times = (np.frombuffer(pa.decompress(row[c][0].as_buffer(), 4 * int(np.sum(row["entries"].flatten().to_numpy())), "zstd"), "<i4") for c in ("places", "times"))
    entries = row["entries"].flatten().to_numpy()
    stop = np.cumsum(entries)
    run = np.r_[0, np.cumsum(step, dtype=np.int64)]
    spot = run[1:] - np.repeat(run[stop - entries], entries)
    figures = []
    for value in (best, held):
        done = np.r_[0, np.cumsum(value[spot] * times)]
        figures.append(pa.array(done[stop] - done[stop - entries]))
    given = [row[c].flatten() for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    names = [x.split()[0] for x in _RESULT.split(", ")]
    return pa.table([*given, *figures, row["groups_sha256"].flatten()], names=names)


def alignment(docs: DataFrame, path_a: str, path_b: str, block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``n_best`` counts the links whose pair is held by as many documents as any
    pair of their A id, ``count_sum`` adds up that number over the links.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = cut_lineage(texts.mapInArrow(_blocks(path_a, path_b, block), _BLOCK_SQL))
    held = blocks.select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.held").alias("docs"))
    of_a = Window.partitionBy(F.shiftright("pair", _ID_BITS))
    counts = cut_lineage(held.select("pair", "docs", (F.col("docs") == F.max("docs").over(of_a)).cast("int").alias("best")))
    asked = blocks.select(F.col("block").alias("unit"), F.posexplode("pairs").alias("place", "pair"))
    answered = asked.join(counts, "pair").select("unit", "place", "docs", "best")
    return blocks.drop("pairs", "held").groupBy("block").cogroup(answered.groupBy("unit")).applyInArrow(_figures, _RESULT)


def token_groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row per group: doc_id, group (from 0), start and stop (bytes of space + text), a and b (ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, data, offsets in text_blocks(batch.column(1), TEXT_BYTES, TEXT_ROWS):
                found = align_rows(data, offsets, path_a, path_b)
                n, row = len(found.group_row), found.group_row
                at = [np.searchsorted(g, np.arange(n + 1)) for g in found.group]
                start = found.start[0][at[0][:-1]] if n else np.zeros(0, np.int64)
                last = np.ones(n, dtype=bool)
                last[:-1] = row[1:] != row[:-1]
                stop = np.where(last, found.base[row + 1], np.r_[start[1:], 0]) if n else start
                lists = [pa.ListArray.from_arrays(pa.array(x, pa.int32()), pa.array(ids, pa.int32())) for x, ids in zip(at, found.ids)]
                number = np.arange(n) - np.searchsorted(row, row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(lo + row)), *[pa.array(x, pa.int64()) for x in (number, start - found.base[row], stop - found.base[row])], *lists],
                    ["doc_id", "group", "start", "stop", "a", "b"],
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, group long, start long, stop long, a array<int>, b array<int>")
