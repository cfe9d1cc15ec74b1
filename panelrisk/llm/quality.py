"""Quality classifier: labellers weighed by expectation-maximisation teach a hashed linear scorer.

Ten rough labellers look at the whole text and vote good (1), bad (0) or
abstain (-1). The corpus is summed up as the number of documents per vote
pattern (at most 3^10 rows, whatever the corpus). On that table a two-class
latent model is fitted by expectation-maximisation: for every labeller, how
often it votes good given a good and given a bad text, where it votes. The model gives each
pattern its posterior; a hashed linear scorer then learns the posteriors from
the texts and scores every document, also those on which the labellers abstain
or quarrel.

Scorer features: three-character windows of the text with letters read as
their case class and other characters as themselves, plus windows of two word
relations (equal to the word before, equal length, longer, shorter), hashed
into ``BUCKETS``; a feature is the square root of a bucket's share. The scorer
is fitted on about ``FIT_ROWS`` documents drawn by a hash of the id (the
documented bound of the training sample); the vote table covers all documents.

Cases: null or wordless text gets no votes, score 0 and is not kept; when the
labellers never disagree with one another the posterior is the vote itself;
equal texts get equal answers; an empty table gives an empty table; extra
columns are not read.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.llm.textbytes import span_hashes, text_blocks, word_spans

BUCKET_BITS, FIT_ROWS, STEPS, ROUNDS = 12, 2000, 200, 100
BUCKETS = 1 << BUCKET_BITS
LABELLERS = ("symbols", "capitals", "variety", "repeats", "separators", "short_words", "word_length", "digits", "alternation", "single_chars")
#: per labeller: at or below the first bound one vote, at or above the second the other, between them none
_GOOD_LOW = {"symbols": (0.06, 0.1), "capitals": (0.15, 0.5), "repeats": (0.05, 0.2), "separators": (0.02, 0.08), "digits": (0.1, 0.25),
             "alternation": (0.1, 0.25), "single_chars": (0.15, 0.3)}
_GOOD_HIGH = {"variety": (0.3, 0.45), "short_words": (0.1, 0.25)}
_WORD_LENGTH = (2.5, 3.5, 9.0, 14.0)  # bad, none, good, none, bad
_MIN_WORDS = 4  # shares of shorter texts say little: no vote

_UPPER, _LOWER, _DIGIT, _BLANK, _SIGN = 0, 1, 2, 3, 4


@lru_cache(maxsize=1)
def _char_classes() -> np.ndarray:
    kinds = {"Lu": _UPPER, "Lt": _UPPER, "Nd": _DIGIT, "Zs": _BLANK, "Cc": _BLANK}
    return np.fromiter((kinds.get(k := unicodedata.category(chr(c)), _LOWER if k[0] in "LM" else _SIGN) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(values)]
    return total[at[1:]] - total[at[:-1]]


def _vote(low: np.ndarray, high: np.ndarray, good_low: bool) -> np.ndarray:
    return np.where(low, 1 if good_low else 0, np.where(high, 0 if good_low else 1, -1)).astype(np.int8)


class Block:
    """Measurements of a run of texts, shared by the labellers and the scorer."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        lead = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
        self.chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        self.char_at = lead[offsets]
        self.kind = _char_classes()[self.chars]
        starts, ends, self.word_at = word_spans(data, offsets)
        self.hashes = span_hashes(data, starts, ends)
        self.lengths = lead[ends] - lead[starts]  # in characters
        self.first = self.chars[lead[starts]] if len(starts) else self.chars[:0]
        self.words = np.diff(self.word_at)

    def votes(self) -> np.ndarray:
        """texts x labellers: 1, 0 or -1."""
        n = len(self.words)
        solid = _sums(self.kind != _BLANK, self.char_at)
        letters = _sums(self.kind <= _LOWER, self.char_at)
        row = np.repeat(np.arange(n), self.words)
        same = np.r_[False, (self.hashes[1:] == self.hashes[:-1]) & (row[1:] == row[:-1])] if len(row) else np.zeros(0, bool)
        every_other = np.r_[False, False, (self.hashes[2:] == self.hashes[:-2]) & (row[2:] == row[:-2])][: len(row)] if len(row) > 1 else np.zeros(len(row), bool)
        bare = (self.lengths == 1) & (_char_classes()[self.first] == _SIGN)
        distinct = np.array([len(np.unique(self.hashes[a:b])) for a, b in zip(self.word_at[:-1], self.word_at[1:])])
        # long texts repeat their words: compare with the number that a text of that length could use
        value = {
            "symbols": _share(_sums(self.kind == _SIGN, self.char_at), solid), "capitals": _share(_sums(self.kind == _UPPER, self.char_at), letters),
            "repeats": _share(_sums(same, self.word_at), self.words), "separators": _share(_sums(bare, self.word_at), self.words),
            "alternation": _share(_sums(every_other, self.word_at), self.words), "single_chars": _share(_sums(self.lengths == 1, self.word_at), self.words),
            "digits": _share(_sums(self.kind == _DIGIT, self.char_at), solid),
            "variety": _share(distinct, np.minimum(self.words, 200)), "short_words": _share(_sums(self.lengths <= 4, self.word_at), self.words),
        }
        out = np.full((n, len(LABELLERS)), -1, dtype=np.int8)
        for j, name in enumerate(LABELLERS):
            if name == "word_length":
                mean = _share(_sums(self.lengths, self.word_at), self.words)
                a, b, c, d = _WORD_LENGTH
                out[:, j] = np.where((mean >= b) & (mean <= c), 1, np.where((mean <= a) | (mean >= d), 0, -1))
            else:
                low, high = (_GOOD_LOW.get(name) or _GOOD_HIGH[name])
                out[:, j] = _vote(value[name] <= low, value[name] >= high, name in _GOOD_LOW)
        out[self.words < _MIN_WORDS] = -1
        return out

    def features(self) -> np.ndarray:
        """texts x buckets: square roots of the shares of hashed windows."""
        shape = np.where(self.kind <= _BLANK, self.kind.astype(np.uint32), self.chars + np.uint32(8))
        h = shape * np.uint32(0x9E3779B1)
        for d in (1, 2):
            h[:-d] += shape[d:] * np.uint32((0x85EBCA77, 0xC2B2AE3D)[d - 1])
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        windows = (h >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)
        relation = np.zeros(len(self.hashes), np.int64)
        if len(relation) > 1:
            relation[1:] = np.where(self.hashes[1:] == self.hashes[:-1], 1, 2 + np.sign(self.lengths[1:] - self.lengths[:-1]) + 1)
        opens = self.word_at[:-1][self.words > 0]  # a text's first word has no word before
        relation[opens] = 0
        pairs = relation.copy()
        pairs[1:] += 8 * relation[:-1]
        pairs[opens] = 0
        pairs = (pairs + 1) * 40503 % BUCKETS
        out = np.zeros((len(self.words), BUCKETS), dtype=np.float32)
        for i in range(len(self.words)):
            counts = np.bincount(windows[self.char_at[i] : max(self.char_at[i], self.char_at[i + 1] - 2)], minlength=BUCKETS).astype(np.float64)
            counts /= max(1.0, counts.sum())
            shape_pairs = np.bincount(pairs[self.word_at[i] : self.word_at[i + 1]], minlength=BUCKETS)
            out[i] = np.sqrt((counts + shape_pairs / max(1, shape_pairs.sum())) / 2)
        return out


def _blocks(column: pa.Array) -> Iterator[Block]:
    for _, data, offsets in text_blocks(column, max_rows=512):  # a row of features is 16 kB
        yield Block(data, offsets)


def _pattern(votes: np.ndarray) -> np.ndarray:
    return (votes.astype(np.int64) + 1) @ (3 ** np.arange(votes.shape[1]))


def _unpattern(pattern: np.ndarray) -> np.ndarray:
    return (pattern[:, None] // 3 ** np.arange(len(LABELLERS))) % 3 - 1


@dataclass(frozen=True)
class LabelModel:
    share: np.ndarray  # of bad and good texts
    rates: np.ndarray  # class x labeller x vote (bad, good) where it votes

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of good per row of votes; an abstention is no evidence."""
        logs = np.log(self.share)[None, :] + sum(
            np.where(votes[:, j, None] >= 0, np.log(self.rates[:, j, :])[:, np.maximum(votes[:, j], 0)].T, 0.0) for j in range(votes.shape[1])
        )
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -700, 700)))

    def accuracy(self) -> np.ndarray:
        """Per labeller: the share of its votes, abstentions aside, that are right."""
        return self.share[0] * self.rates[0, :, 0] + self.share[1] * self.rates[1, :, 1]


def fit_labellers(votes: np.ndarray, count: np.ndarray) -> LabelModel:
    """Expectation-maximisation over vote patterns (patterns x labellers) and their counts."""
    # begin from the cautious reading: each labeller watches for one defect, so one bad vote outweighs the rest
    good = np.where((votes == 0).any(axis=1), 0.1, np.where((votes == 1).any(axis=1), 0.9, 0.5))
    for _ in range(ROUNDS):
        weight = np.stack([count * (1 - good), count * good])
        share = (weight.sum(axis=1) + 1) / (count.sum() + 2)
        rates = np.stack([(weight[:, None, :] * (votes.T == v)[None]).sum(axis=2) + 0.5 for v in (0, 1)], axis=2)
        model = LabelModel(share, rates / rates.sum(axis=2, keepdims=True))
        good = model.posterior(votes)
    return model


def fit_scorer(x: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.float32]:
    """Logistic scorer of soft labels; both classes weigh the same."""
    share = good / max(good.sum(), 1e-9) + (1 - good) / max((1 - good).sum(), 1e-9)
    share, good = (share / share.sum()).astype(np.float32), good.astype(np.float32)
    w, vw = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32)
    b = vb = np.float32(0)
    for k in range(STEPS):
        lw, lb = w + vw, b + vb
        pull = share * (good - 1 / (1 + np.exp(-np.clip(x @ lw + lb, -50, 50))))
        nw, nb = lw + np.float32(4) * (pull @ x - np.float32(1e-6) * lw), lb + np.float32(4) * pull.sum()
        momentum = np.float32(k / (k + 3))
        vw, vb = momentum * (nw - w), momentum * (nb - b)
        w, b = nw, nb
    return w, b


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in _blocks(batch.column(0)):
            pattern, count = np.unique(_pattern(block.votes()[block.words > 0]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pattern), pa.array(count)], ["pattern", "n"])


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in _blocks(batch.column(0)):
            live = block.words > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(_pattern(block.votes()[live])), pa.array([x.tobytes() for x in block.features()[live]], pa.binary())], ["pattern", "x"]
            )


def _score(model: LabelModel, w: np.ndarray, b: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, score = [np.zeros(0)], [np.zeros(0)]
            for block in _blocks(batch.column("_text")):
                live = block.words > 0
                good.append(np.where(live, model.posterior(block.votes().astype(np.int64)), 0.0))
                score.append(np.where(live, 1 / (1 + np.exp(-np.clip(block.features() @ w + b, -50, 50))), 0.0))
            yield pa.RecordBatch.from_arrays([batch.column("_rest"), pa.array(np.concatenate(good)), pa.array(np.concatenate(score))], ["_rest", "_good", "_score"])

    return run


def classify(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` plus posterior (of the labellers), score (of the scorer) and kept."""
    text = docs.select(F.col("text").cast("string").alias("text"))
    table = text.mapInArrow(_patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]).alias("_rest"), F.col("text").cast("string").alias("_text"))
    names = [F.col(f"_rest.c{i}").alias(c) for i, c in enumerate(keep)]
    if not table:  # no text with a word
        return rows.select(*names, F.lit(0.0).alias("posterior"), F.lit(0.0).alias("score"), F.lit(False).alias("kept"))
    patterns, counts = np.array([r["pattern"] for r in table]), np.array([r["n"] for r in table], float)
    model = fit_labellers(_unpattern(patterns), counts)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = docs.where(draw < min(1.0, FIT_ROWS / counts.sum())).select(F.col("text").cast("string").alias("text"))
    sample = drawn.mapInArrow(_samples, "pattern long, x binary").collect()  # bounded by FIT_ROWS
    sample.sort(key=lambda r: (r["pattern"], bytes(r["x"])))
    w, b = np.zeros(BUCKETS), 0.0
    if sample:
        x = np.frombuffer(b"".join(bytes(r["x"]) for r in sample), np.float32).reshape(len(sample), BUCKETS)
        w, b = fit_scorer(x, model.posterior(_unpattern(np.array([r["pattern"] for r in sample]))))
    kind = rows.schema["_rest"].dataType.simpleString()
    done = rows.mapInArrow(_score(model, w.astype(np.float32), float(b)), f"_rest {kind}, _good double, _score double")
    return done.select(*names, F.col("_good").alias("posterior"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).alias("kept"))
