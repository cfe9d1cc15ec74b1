"""Language identification by error-correcting output codes.

Every learned language has a codeword; one binary classifier per bit, linear
over hashed byte n-grams, predicts the codeword's bits. Decoding adds up, over
the bits, the bit's weight (how far its training accuracy is above chance)
times the logistic loss of its margin against the codeword's bit, and takes
the codeword with the least loss. A text whose second-best codeword is nearly
as close is flagged as ambiguous.

Features: the n-grams of 2, 3 and 4 bytes of the whole text, with A-Z folded
and every run of ASCII bytes that are not letters read as one space, hashed
into ``BUCKETS``; a feature is the square root of a bucket's share.

Fitting uses at most ``FIT_ROWS`` labelled texts per language and about
``FIT_TOTAL`` in all, drawn by a hash of the id (the documented bound of the
training sample). Each bit is fitted by its own Spark task on that bounded
sample. The model (buckets x bits floats) does not grow with the data.

Cases: a text that is null or has no letter is ``und`` with score 0; with no
labelled row at all every text is ``und``; with one language every text with
letters gets it; equal texts get equal answers; an empty table gives an empty
table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelrisk.llm.textbytes import text_blocks

BUCKET_BITS, FIT_ROWS, FIT_TOTAL, MAX_BITS, STEPS, AMBIGUOUS = 12, 200, 4000, 24, 300, 0.6
BUCKETS = 1 << BUCKET_BITS

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_FOLD[:0x41] = 0x20
_FOLD[0x5B:0x61] = 0x20
_FOLD[0x7B:0x80] = 0x20


@dataclass(frozen=True)
class Model:
    langs: list[str]
    codes: np.ndarray  # languages x bits, +-1
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # per bit


def codewords(n: int) -> np.ndarray:
    """n codewords of +-1: all splits of the languages while those are few, else random splits."""
    if n < 2:
        return np.ones((n, 1))
    if 2 ** (n - 1) - 1 <= MAX_BITS:
        splits = np.arange(1, 2 ** (n - 1))
        return np.where((splits[None, :] >> np.arange(n)[:, None]) & 1, 1.0, -1.0)
    rng, best, far = np.random.default_rng(n), None, -1
    for _ in range(200):  # keep the draw whose closest two codewords are farthest apart
        draw = rng.integers(0, 2, (n, MAX_BITS)) * 2.0 - 1
        gap = min(int((draw[i] != draw[i + 1 :]).sum(axis=1).min()) for i in range(n - 1))
        if gap > far and (np.abs(draw.sum(axis=0)) < n).all():
            best, far = draw, gap
    if far < 1:
        raise ValueError(f"{n} languages do not fit into {MAX_BITS} bits")
    return best


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every n-gram, row offsets into them); every row is framed by spaces."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    # a space, the text, a space, and two zero bytes: windows never reach into the next row
    framed = np.full(len(data) + 4 * n, 0x20, dtype=np.uint8)
    row = np.repeat(np.arange(n), sizes)
    framed[np.arange(len(data)) + 4 * row + 1] = _FOLD[data]
    edge = np.cumsum(np.r_[0, sizes + 4])
    framed[edge[1:] - 1] = framed[edge[1:] - 2] = 0
    # runs of blanks count as one, but rows stay apart
    blank = framed == 0x20
    keep = np.ones(len(framed), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[edge[:-1]] = True
    at = np.r_[0, np.cumsum(keep)][edge]
    text = framed[keep].astype(np.uint32)
    g2 = np.zeros(len(text), np.uint32)
    g2[:-1] = text[:-1] | (text[1:] << np.uint32(8))
    g3, g4 = g2.copy(), g2.copy()
    g3[:-2] |= text[2:] << np.uint32(16)
    g4[:-3] = g3[:-3] | (text[3:] << np.uint32(24))
    out = np.empty((len(text), 3), dtype=np.int32)
    for j, g in enumerate((g2, g3, g4)):
        h = (g + np.uint32(j + 1)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA77)
        out[:, j] = (h >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)
    return out, at


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """One matrix (texts x buckets) per run of texts."""
    for _, data, offsets in text_blocks(column, max_rows=512):  # a row of features is 16 kB
        grams, at = _grams(data, offsets)
        out = np.zeros((len(at) - 1, BUCKETS), dtype=np.float32)
        for i in range(len(at) - 1):
            counts = np.bincount(grams[at[i] : at[i + 1] - 3].ravel(), minlength=BUCKETS)
            out[i] = np.sqrt(counts / max(1, counts.sum()))
        yield out


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [x.tobytes() for block in features(batch.column(1)) for x in block]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["lang", "x"])


def fit_bit(x: np.ndarray, y: np.ndarray, rows_of: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Logistic regression by accelerated gradient steps; languages weigh the same.

    Returns (weights, bias, accuracy).
    """
    share = 1.0 / np.bincount(rows_of)[rows_of]
    for side in (y > 0, y < 0):  # and so do the two sides of the split
        share[side] /= max(share[side].sum(), 1e-12)
    share /= share.sum()
    w, b, vw, vb = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0
    rate = 2.0  # rows have length one, and one more for the bias
    for k in range(STEPS):
        lw, lb = w + vw, b + vb
        pull = share * y / (1 + np.exp(np.clip(y * (x @ lw + lb), -50, 50)))
        nw, nb = lw + rate * (x.T @ pull - 1e-6 * lw), lb + rate * pull.sum()
        vw, vb = k / (k + 3) * (nw - w), k / (k + 3) * (nb - b)
        w, b = nw, nb
    return w, b, float((share * ((x @ w + b) * y > 0)).sum())


def _fit_group(langs: list[str], codes: np.ndarray):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bit = int(key[0])
        rows = rows.sort_values(["lang", "x"])  # the arrival order must not matter
        x = np.frombuffer(b"".join(rows["x"]), dtype=np.float32).reshape(len(rows), BUCKETS).astype(np.float64)
        which = np.array([langs.index(v) for v in rows["lang"]])
        w, b, right = fit_bit(x, codes[which, bit], np.unique(which, return_inverse=True)[1])
        return pd.DataFrame({"bit": [bit], "w": [w.tobytes()], "b": [b], "right": [right]})

    return run


def fit(labelled: DataFrame) -> Model | None:
    """Learn from ``labelled`` (doc_id, text, lang); rows without text or lang teach nothing."""
    rows = labelled.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    langs = sorted(counts)
    if not langs:
        return None
    codes = codewords(len(langs))
    each = max(8, min(FIT_ROWS, FIT_TOTAL // len(langs)))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, each / n))])
    sample = rows.where(draw < share[F.col("lang")]).select("lang", "text").mapInArrow(_sample_features, "lang string, x binary")
    bits = sample.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(codes.shape[1] - 1))))
    fitted = bits.groupBy("bit").applyInPandas(_fit_group(langs, codes), "bit int, w binary, b double, right double").collect()
    if not fitted:
        return None
    w, b, trust = np.zeros((BUCKETS, codes.shape[1])), np.zeros(codes.shape[1]), np.zeros(codes.shape[1])
    for r in fitted:
        w[:, r["bit"]], b[r["bit"]], trust[r["bit"]] = np.frombuffer(r["w"]), r["b"], max(r["right"] - 0.5, 1e-3)
    return Model(langs, codes, w.astype(np.float32), b, trust / trust.sum())


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest codeword, its share of exp(-loss)) per row of margins."""
    loss = np.stack([(model.trust * np.logaddexp(0, -margins * c)).sum(axis=1) for c in model.codes], axis=1)
    weight = np.exp((loss.min(axis=1, keepdims=True) - loss) * model.codes.shape[1])
    best = weight.argmax(axis=1)
    return best, weight.max(axis=1) / weight.sum(axis=1)


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(model.langs, dtype=object)
        for batch in batches:
            lang, score = [], []
            for x in features(batch.column("_text")):
                best, sure = decode(model, x @ model.weights + model.bias)
                lang.extend(names[best])
                score.append(sure)
            rest = [c for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in rest], pa.array(lang, pa.string()), pa.array(np.concatenate(score) if score else np.zeros(0), pa.float64())],
                [*rest, "_lang", "_score"],
            )

    return run


def predict(model: Model | None, docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` plus lang_pred, score and ambiguous; only the text decides."""
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]).alias("_rest"), lettered.alias("_ok"), F.when(lettered, F.col("text").cast("string")).alias("_text"))
    if model is None:
        done = rows.select("_rest", F.lit(False).alias("_ok"), F.lit("und").alias("_lang"), F.lit(0.0).alias("_score"))
    else:
        kind = rows.schema["_rest"].dataType.simpleString()
        done = rows.mapInArrow(_predict(model), f"_rest {kind}, _ok boolean, _lang string, _score double")
    score = F.when(F.col("_ok"), F.col("_score")).otherwise(0.0)
    return done.select(
        *[F.col(f"_rest.c{i}").alias(c) for i, c in enumerate(keep)],
        F.when(F.col("_ok"), F.col("_lang")).otherwise("und").alias("lang_pred"), score.alias("score"), (score < AMBIGUOUS).alias("ambiguous"),
    )


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the third of the ids that never teaches."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) for every row of ``docs``."""
    model = fit(docs.where(~held_out()))
    return predict(model, docs, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
