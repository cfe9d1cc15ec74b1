"""Spelling variant grouping: FM-index search schemes over the delimited vocabulary of a corpus.

Two words are near if one inserted, deleted or replaced code point turns one
into the other. That edit lies in one half of the word, so the other half
matches exactly. Scheme 1 matches the first half and extends to the right, over
the second half, with one error; scheme 2 does the same from the other end.
Together they use an FM-index in both directions. Each scheme extends in one
direction only, from a delimiter, so each keeps just the index of its direction:
scheme 2 is scheme 1 over reversed words.

An index holds the words of a shard, delimited. A state of the search is an
interval of suffix ranks; one step narrows the intervals of thousands of states
at once by rank lookups in the Burrows-Wheeler transform. Where the error may
be, a state branches into a deletion and into every symbol that occurs in its
interval (insertion or replacement). A word is found where the symbol before a
suffix of a final interval is the delimiter.

Shards are ranges of the sorted words (and of the sorted reversed words), of
about ``SHARD`` words. A word is looked up in the shards that hold its exact
half as a beginning, known from an equi-join on beginnings, so nothing is
compared with a whole vocabulary. The words that ask one shard are dealt into
units of about ``UNIT``; a unit is a task's work, and its index is cut again at
``SYMBOLS`` symbols, so that long words do not add up. If very many words share
a half, each of them asks all the shards of that half.

Words are counted from the whole texts: once per run of texts in the task,
then by a partially aggregated sum.

Cases: a null text has no words; a null id deletes nothing (see ``drop_every``);
words of any length; rows that share an id count as documents of their own;
other columns are not read; an empty table, or one without repeated words,
gives an empty table; ties between forms go to the smallest word by code points.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.llm.textbytes import span_hashes, splitmix, text_blocks
from panelrisk.session import cut_lineage

SHARD, UNIT = 1 << 14, 1 << 15  # words of an index, words that ask it at once
SYMBOLS = 1 << 18  # of an index at most, but for a single longer word
TABLE = 1 << 24  # entries of a rank table; larger indexes search sorted positions instead
STATES = 1 << 12  # queries that are searched together
MIN_LENGTH, MIN_COUNT, FORM_TIMES = 7, 2, 10

# ---- words -----------------------------------------------------------------


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def crc32_spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """CRC-32 of each span, continued from the checksum ``lead`` of what precedes it."""
    order = np.argsort(begin - end, kind="stable")  # longest first
    begin, size, crc = begin[order], (end - begin)[order], lead[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    for j in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -j, side="left"))  # spans with more than j bytes
        if n <= 4:  # what is left is long
            for k in range(n):
                raw = data[begin[k] + j : begin[k] + size[k]].tobytes()
                crc[k] = zlib.crc32(raw, int(crc[k]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
            break
        crc[:n] = _CRC[(crc[:n] ^ data[begin[:n] + j]) & 0xFF] ^ (crc[:n] >> 8)
    out = np.empty(len(order), np.uint32)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, code points) of the maximal runs of A-Z, a-z and U+00C0-U+00FF, which are C3 80-BF in UTF-8."""
    wide = data == 0xC3
    letter = ((data | 0x20) - np.uint8(97) < 26) | wide
    letter[1:] |= wide[:-1]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before, after = np.ones(len(data), dtype=bool), np.ones(len(data), dtype=bool)
    before[1:], after[:-1] = ~letter[:-1], ~letter[1:]
    begin = np.flatnonzero(letter & (before | edge[:-1]))
    end = np.flatnonzero(letter & (after | edge[1:])) + 1
    wides = np.r_[0, np.cumsum(wide)]
    return begin, end, end - begin - (wides[end] - wides[begin])


def _gather(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans as strings."""
    size = end - begin
    stop = np.cumsum(size)
    body = data[np.repeat(begin - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)]
    ends = np.r_[0, stop].astype(np.int32)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(ends.tobytes()), pa.py_buffer(body.tobytes()))


def _without(word: str, at: int) -> str:
    return word[:at] + word[at + 1 :]


def _count(drop_every: int, min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, data, offsets in text_blocks(batch.column(1), 1 << 20):
                data = data + (((data - np.uint8(65)) < 26) * np.uint8(32)).astype(np.uint8)
                begin, end, points = letter_runs(data, offsets)
                long = points >= min_length
                begin, end, points = begin[long], end[long], points[long]
                row = np.searchsorted(offsets, begin, side="right") - 1
                hashes = span_hashes(data, begin, end)
                if drop_every:
                    _, one, n = np.unique(hashes ^ splitmix(row.astype(np.uint64)), return_index=True, return_counts=True)
                    begin, end, points, row, hashes = (x[one] for x in (begin, end, points, row, hashes))
                    ids = [x.as_py() for x in batch.column(0).slice(lo, len(offsets) - 1)]
                    lead = np.array([0 if i is None else zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
                    crc = crc32_spans(data, begin, end, lead[row])
                    named = np.array([i is not None for i in ids], dtype=bool)
                    hit = (crc % np.uint32(drop_every) == 0) & named[row]
                    cut = hit & (points > min_length)
                    raw = [data[a:b].tobytes().decode() for a, b in zip(begin[cut], end[cut])]
                    cut_words = [_without(w, h % len(w)) for w, h in zip(raw, crc[cut].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(cut_words, pa.string()), pa.array(n[cut])], ["word", "n"])
                    begin, end, hashes, n = (x[~hit] for x in (begin, end, hashes, n))
                else:
                    n = np.ones(len(begin), np.int64)
                _, one, where = np.unique(hashes, return_index=True, return_inverse=True)
                total = np.bincount(where, weights=n, minlength=len(one)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([_gather(data, begin[one], end[one]), pa.array(total)], ["word", "n"])

    return run


def count_words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, drop_every: int = 0) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, of at least ``min_length`` code points that occur ``min_count`` times.

    With ``drop_every`` k, let h be the CRC-32 of ``<doc_id>:<word>``: where k
    divides h, the word's code point h % length is deleted before it is counted.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = texts.mapInArrow(_count(drop_every, min_length), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# ---- index -----------------------------------------------------------------


class Index:
    """FM-index of delimited words; steps extend a match to the right.

    The indexed text is every word reversed, then a delimiter (symbol 0). The
    delimiters count as different symbols in word order, so every suffix is
    decided at the next one.
    """

    def __init__(self, codes: np.ndarray, offsets: np.ndarray) -> None:
        """``codes``: code points of the words end to end."""
        m, n = len(offsets) - 1, len(codes) + len(offsets) - 1
        self.alphabet = np.unique(codes)
        size = np.diff(offsets)
        stop = np.cumsum(size + 1) - 1  # places of the delimiters
        text = np.zeros(n, np.int32)
        word = np.repeat(np.arange(m), size)
        # the j-th code point of a word lies j + 1 places before its delimiter
        text[stop[word] - 1 - (np.arange(len(codes)) - offsets[word])] = np.searchsorted(self.alphabet, codes) + 1
        rank = text.astype(np.int64) + m - 1
        rank[stop] = np.arange(m)
        step, parts = 1, 0
        while parts < n:
            follow = np.empty(n, np.int64)
            follow[: n - step], follow[n - step :] = rank[step:], 0
            kinds, rank = np.unique(rank * (n + m + 1) + follow, return_inverse=True)
            parts, step = len(kinds), min(2 * step, n)
        place = np.empty(n, np.int64)
        place[rank] = np.arange(n)
        self.bwt = text[place - 1]
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=len(self.alphabet) + 1))]  # rows before each symbol's
        word_of = np.repeat(np.arange(m), size + 1)
        self.found = word_of[place[self.bwt == 0]]  # the word of every row that a delimiter precedes
        self.m, symbols = m, len(self.alphabet) + 1
        self.table = self.sorted = None
        if (n + 1) * symbols <= TABLE:
            self.table = np.zeros((n + 1, symbols), np.int32)
            self.table[np.arange(1, n + 1), self.bwt] = 1
            np.cumsum(self.table, axis=0, out=self.table)
            self.table += self.first[:-1].astype(np.int32)
        else:
            self.sorted = np.sort(self.bwt.astype(np.int64) * (n + 1) + np.arange(n))
            self.base = np.arange(symbols) * (n + 1)

    def rows(self, at: np.ndarray) -> np.ndarray:
        """For every symbol, the first row of the interval that the rows from ``at`` narrow to."""
        if self.table is not None:
            return self.table[at]
        return np.searchsorted(self.sorted, self.base + at[:, None])

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[at, symbol]
        return np.searchsorted(self.sorted, self.base[symbol] + at)

    def near(self, codes: np.ndarray, offsets: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) for every word that begins with a query's first ``half`` symbols and is one edit away."""
        spot = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        # a symbol that the index lacks becomes -1: no step takes it
        symbols = np.r_[np.where(self.alphabet[spot] == codes, spot + 1, -1), -1] if len(self.alphabet) else np.full(len(codes) + 1, -1)
        out = [self._near(symbols, offsets, half, lo, min(lo + STATES, len(half))) for lo in range(0, len(half), STATES)]
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2

    def _exact(self, symbols, offsets, q, i, lo, hi):
        """Narrow each state by its query's symbol ``i``; states without rows end."""
        c = symbols[offsets[q] + i]
        ok = c > 0
        q, i, c, lo, hi = q[ok], i[ok], c[ok], lo[ok], hi[ok]
        lo, hi = self.step(c, lo), self.step(c, hi)
        ok = lo < hi
        return q[ok], i[ok] + 1, lo[ok], hi[ok]

    def _near(self, symbols, offsets, half, first, end):
        size = np.diff(offsets)
        q = np.arange(first, end)
        i, lo, hi = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.full(len(q), self.m)
        ready = []  # states whose half has matched
        while len(q):
            done = i == half[q]
            ready.append((q[done], i[done], lo[done], hi[done]))
            q, i, lo, hi = self._exact(symbols, offsets, *(x[~done] for x in (q, i, lo, hi)))
        q, i, lo, hi = (np.concatenate(x) for x in zip(*ready))
        one_error = []
        while len(q):
            here = symbols[offsets[q] + i]
            inside = i < size[q]
            here[~inside] = -2
            after = symbols[offsets[q] + i + inside]
            after[i + 1 >= size[q]] = -2
            gone = inside & (here != after)  # of equal neighbours, the last one is deleted
            one_error.append((q[gone], i[gone] + 1, lo[gone], hi[gone]))
            a, b = self.rows(lo), self.rows(hi)
            state, c = np.nonzero(a < b)
            keep = (c > 0) & (c != here[state])  # before an equal symbol, the insertion comes after it
            state, c = state[keep], c[keep]
            narrowed = a[state, c], b[state, c]
            one_error.append((q[state], i[state], *narrowed))
            swap = inside[state]
            one_error.append((q[state][swap], i[state][swap] + 1, *(x[swap] for x in narrowed)))
            q, i, lo, hi = self._exact(symbols, offsets, *(x[inside] for x in (q, i, lo, hi)))
        q, i, lo, hi = (np.concatenate(x) for x in zip(*one_error)) if one_error else (np.zeros(0, np.int64),) * 4
        pairs = [(np.zeros(0, np.int64),) * 2]
        before = np.r_[0, np.cumsum(self.bwt == 0)]
        while len(q):
            over = i == size[q]
            a, b = before[lo[over]], before[hi[over]]
            whole = a < b  # words differ, so one at most
            pairs.append((q[over][whole], self.found[a[whole]]))
            q, i, lo, hi = self._exact(symbols, offsets, *(x[~over] for x in (q, i, lo, hi)))
        return tuple(np.concatenate(x) for x in zip(*pairs))


def _codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words end to end, and where each begins."""
    text = words.to_pylist()
    return np.frombuffer("".join(text).encode("utf-32-le"), np.uint32).astype(np.int64), np.r_[0, np.cumsum([len(w) for w in text], dtype=np.int64)]


def _search(index: pa.Table, asking: pa.Table) -> pa.Table:
    """(word, near, near_n) for the words that ask one unit of a shard."""
    words, queries = index["text"].combine_chunks(), asking["text"].combine_chunks()
    codes, offsets = _codes(words)
    q_codes, q_offsets = _codes(queries)
    half = np.asarray(asking["half"].combine_chunks(), np.int64)
    found = []
    lo = 0
    while lo < len(words):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SYMBOLS, side="right")) - 1)
        query, word = Index(codes[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]).near(q_codes, q_offsets, half)
        found.append((query, word + lo))
        lo = hi
    query, word = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    names = ["scheme", "word", "near", "near_n"]
    scheme = pa.array(np.full(len(query), index["scheme"][0].as_py() if len(index) else 0, np.int32))
    word = pa.array(word)
    return pa.table([scheme, queries.take(pa.array(query)), words.take(word), index["n"].combine_chunks().take(word)], names=names)


# ---- groups ----------------------------------------------------------------


def near_words(vocabulary: DataFrame, shard: int = SHARD, unit: int = UNIT) -> DataFrame:
    """(word, near, near_n): every ordered pair of words of ``vocabulary`` (word, n; distinct) that are one edit apart."""
    both = vocabulary.select(F.lit(0).alias("scheme"), F.col("word").alias("text"), "n").unionAll(
        vocabulary.select(F.lit(1), F.reverse("word"), "n")
    )
    shards = max(1, -(-2 * vocabulary.count() // shard))
    placed = cut_lineage(both.repartitionByRange(shards, "scheme", "text").withColumn("shard", 2 * F.spark_partition_id() + F.col("scheme")))
    # the exact half of a word of length l: the first l / 2 code points, rounded down in scheme 1 and up in scheme 2
    size = F.char_length("text")
    half = F.floor((size + F.col("scheme")) / 2).cast("int")
    begin = lambda h: F.substring(F.col("text"), F.lit(1), h)
    asked = F.array_distinct(F.array(*[begin(F.floor((size + F.col("scheme") + d) / 2).cast("int")) for d in (-1, 0, 1)]))
    begins = placed.select("scheme", "shard", F.explode(asked).alias("begin")).distinct()
    asking = placed.select("scheme", "text", half.alias("half"), begin(half).alias("begin")).join(begins, ["scheme", "begin"]).drop("begin", "scheme")
    asking = cut_lineage(asking)
    units = asking.groupBy("shard").agg(F.ceil(F.count("*") / unit).cast("int").alias("units"))
    asking = asking.join(units, "shard").select(F.col("shard").alias("in"), F.pmod(F.xxhash64("text"), "units").cast("int").alias("of"), "text", "half")
    index = placed.join(units, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("unit"), "scheme", "text", "n")
    pairs = index.groupBy("shard", "unit").cogroup(asking.groupBy("in", "of")).applyInArrow(_search, "scheme int, word string, near string, near_n long")
    turned = lambda c: F.when(F.col("scheme") == 0, F.col(c)).otherwise(F.reverse(c)).alias(c)
    pairs = pairs.select("scheme", turned("word"), turned("near"), "near_n")
    # what begins with the same first half is scheme 1's
    h = F.floor(F.char_length("word") / 2).cast("int")
    own = (F.col("scheme") == 0) | (F.substring(F.col("word"), F.lit(1), h) != F.substring(F.col("near"), F.lit(1), h))
    return pairs.where(own).select("word", "near", "near_n")


def variant_forms(vocabulary: DataFrame, form_times: int = FORM_TIMES) -> DataFrame:
    """Per word of ``vocabulary`` (word, n): word, form, root, n, n_near, form_n.

    ``form`` is the near word that occurs most often (ties: the smallest), if
    it occurs at least ``form_times`` as often; ``root`` follows forms to the last.
    """
    vocabulary = cut_lineage(vocabulary.select("word", "n"))
    pairs = near_words(vocabulary)
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("top"))
    joined = vocabulary.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("top.near").alias("near"), (-F.col("top.less")).alias("near_n"))
    has = F.col("near_n") >= form_times * F.col("n")
    words = cut_lineage(joined.select("word", "n", "n_near", F.when(has, F.col("near")).alias("form"), F.when(has, F.col("near_n")).alias("form_n")))
    roots = words.where("form is not null").select("word", F.col("form").alias("root"))
    # counts rise by form_times at every form, which bounds the chain; a round doubles the steps that are taken
    most = words.agg(F.max("n")).first()[0] or 1
    chain = math.log(most, form_times) + 1 if form_times > 1 else most
    for _ in range(math.ceil(math.log2(max(2.0, chain)))):
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = cut_lineage(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return words.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
