"""Embedding near-duplicates: randomised-rotation binary codes with correction factors.

A unit vector o is turned by fixed random rotations; the signs of the turned
coordinates are its binary code. With the code's own unit vector c (all
coordinates +-1/sqrt(d)) and the stored factor f = <c, o>, the value
<c, q> / f is an unbiased estimate of <o, q>, with an error of about
sqrt((1 - f^2) / f^2 / (d - 1)). ``CODE_ROTATIONS`` independent rotations are
averaged. A pair whose estimate plus ``SIGMAS`` such errors stays below the
threshold is rejected by its codes; every other pair is recomputed exactly, in
double precision, and only exact values make links.

Candidates: ``BANDS`` groups of ``BITS`` code bits; vectors of one label meet
when they agree in a group. Two vectors at cosine 0.93 agree in one bit with
probability 0.88 and miss each other in all groups with probability 6e-5.

Work: equal vectors of a label are one class (weighted by its rows). Only
classes that share a group with another one are moved. A group larger than
``BLOCK`` rows is cut into blocks and every pair of blocks is a task's unit, so
no group meets in one task. Pairs are counted where they arise (in the first
group that the two share) and never emitted; each unit passes on a count per
class and a spanning tree of its links.

Cases: a null label, a null, empty or zero vector, and a vector with null or
non-finite components link with nothing and are kept; vectors of different
lengths never meet; repeated rows link with each other and count one by one;
rows that share an id stay separate rows; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.llm.links import components
from panelrisk.llm.textbytes import splitmix
from panelrisk.llm.units import block_units, runs, whole_units
from panelrisk.session import cut_lineage

BITS, BANDS, CODE_ROTATIONS, SIGMAS, BLOCK, SEED = 20, 120, 4, 5.0, 512, 20240229


@lru_cache(maxsize=8)
def rotations(dim: int) -> np.ndarray:
    """Fixed random rotations of ``dim``-dimensional space, enough for all code bits."""
    rng = np.random.default_rng([SEED, dim])
    count = max(CODE_ROTATIONS, math.ceil(BITS * BANDS / dim))
    out = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(count)]
    return np.stack(out)


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, safe for tiny and huge components."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def encode(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed code bits, correction factor per code rotation) of unit rows."""
    dim = v.shape[1]
    turned = np.einsum("nd,rde->nre", v, rotations(dim))
    bits = turned.reshape(len(v), -1)[:, : max(BITS * BANDS, CODE_ROTATIONS * dim)] > 0
    factors = np.abs(turned[:, :CODE_ROTATIONS]).sum(axis=2) / math.sqrt(dim)
    return np.packbits(bits, axis=1), factors


def _groups(code: np.ndarray) -> np.ndarray:
    """The value of every bit group, one row per vector."""
    bits = np.unpackbits(code, axis=1)[:, : BITS * BANDS].reshape(len(code), BANDS, BITS)
    return bits.astype(np.int64) @ (1 << np.arange(BITS, dtype=np.int64))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _bytes_matrix(column: pa.Array, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(len(column), -1)


def _encode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.asarray(pc.list_value_length(batch.column("embedding")))
        for dim in np.unique(sizes):
            part = batch.filter(pa.array(sizes == dim))
            for lo in range(0, part.num_rows, 1024):
                rows = part.slice(lo, 1024)
                v = unit(_matrix(rows.column("embedding")))
                code, factors = encode(v)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("cid"), rows.column("space"), rows.column("weight"),
                        pa.array([x.tobytes() for x in v], pa.binary()),
                        pa.array([x.tobytes() for x in code], pa.binary()),
                        pa.array([x.tobytes() for x in factors], pa.binary()),
                    ],
                    ["cid", "space", "weight", "v", "code", "factors"],
                )


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            rows = batch.slice(lo, 4096)
            code, start = [np.frombuffer(x, np.uint8) for x in rows.column("code").to_pylist()], 0
            while start < len(code):  # runs of codes of one length
                stop = start
                while stop < len(code) and len(code[stop]) == len(code[start]):
                    stop += 1
                groups = _groups(np.stack(code[start:stop])).astype(np.uint64)
                space = np.asarray(rows.column("space"))[start:stop].astype(np.uint64)
                key = splitmix(splitmix(space[:, None] + np.arange(BANDS, dtype=np.uint64)) ^ groups)
                cid = np.repeat(np.asarray(rows.column("cid"))[start:stop], BANDS)
                band = np.tile(np.arange(BANDS, dtype=np.int32), stop - start)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().astype(np.int64)), pa.array(band), pa.array(cid)], ["key", "band", "cid"])
                start = stop


def estimate(code: np.ndarray, factors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of every coded vector with every row of ``v``, and their error per coded vector."""
    dim = v.shape[1]
    total = np.zeros((len(code), len(v)))
    signs = np.unpackbits(code, axis=1)[:, : CODE_ROTATIONS * dim].reshape(len(code), CODE_ROTATIONS, dim).astype(np.float32) * 2 - 1
    for r in range(CODE_ROTATIONS):
        turned = (v @ rotations(dim)[r]).astype(np.float32)
        total += (signs[:, r] @ turned.T) / (math.sqrt(dim) * factors[:, r, None])
    error = np.sqrt(((1 - factors**2).clip(0) / factors**2).sum(axis=1) / max(dim - 1, 1)) / CODE_ROTATIONS
    return total / CODE_ROTATIONS, error


def _unit_links(rows: dict[str, np.ndarray], band: int, across: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links x < y (row numbers) of one unit for which ``band`` is the first group they share."""
    est, error = estimate(rows["code"], rows["factors"], rows["v"])
    maybe = est + SIGMAS * error[:, None] >= threshold
    maybe = np.triu(maybe & maybe.T, 1)
    if across:
        maybe &= rows["block"][:, None] != rows["block"][None, :]
    x, y = np.nonzero(maybe)
    keep = np.zeros(len(x), dtype=bool)
    for lo in range(0, len(x), 1 << 14):
        a, b = x[lo : lo + (1 << 14)], y[lo : lo + (1 << 14)]
        near = np.einsum("ij,ij->i", rows["v"][a], rows["v"][b]) >= threshold
        earlier = (rows["groups"][a, :band] == rows["groups"][b, :band]).any(axis=1)
        keep[lo : lo + (1 << 14)] = near & ~earlier
    return x[keep], y[keep]


def _spanning(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest row number that each row reaches over the links."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        root = root[root]
        if (root == before).all():
            return root


def _links_of(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_units(batches):
            out: list[list[np.ndarray]] = [[], [], []]
            for lo, hi in runs(np.asarray(batch.column("unit")), np.asarray(batch.column("space"))):
                if hi - lo < 2:
                    continue
                part = batch.slice(lo, hi - lo)
                code = _bytes_matrix(part.column("code"), np.uint8)
                cid, w = np.asarray(part.column("cid")), np.asarray(part.column("weight"))
                rows = {
                    "block": np.asarray(part.column("block")), "code": code, "groups": _groups(code).astype(np.int32),
                    "v": _bytes_matrix(part.column("v"), np.float64), "factors": _bytes_matrix(part.column("factors"), np.float64),
                }
                x, y = _unit_links(rows, part.column("band")[0].as_py(), part.column("across")[0].as_py(), threshold)
                if len(x):
                    count = np.bincount(x, w[y], hi - lo) + np.bincount(y, w[x], hi - lo)
                    hit = count > 0
                    for to, values in zip(out, (cid[hit], count[hit].astype(np.int64), cid[_spanning(hi - lo, x, y)[hit]])):
                        to.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in out], ["cid", "links", "root"])

    return run


def cosine_links(rows: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``rows`` (vec_id, embedding, label)."""
    rows = rows.select("vec_id", "embedding", F.col("label").alias("label"))
    low = F.array_min(F.transform("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))
    some = F.array_max(F.transform("embedding", lambda x: F.abs(x) > 0))
    sound = F.coalesce(F.col("label").isNotNull() & (F.size("embedding") > 0) & low & some, F.lit(False))
    # equal vectors of a label are one class; partial aggregation spreads a hot one
    sign_free = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    marked = rows.select("vec_id", F.when(sound, F.sha2(F.to_json(F.struct(F.col("label"), sign_free.alias("e"))), 256)).alias("same"), "label", "embedding")
    classes = (
        marked.where("same IS NOT NULL").groupBy("same")
        .agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
        .select(F.monotonically_increasing_id().alias("cid"), "same", "least", "weight", F.xxhash64(F.col("label").cast("string"), F.size("embedding")).alias("space"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    )
    classes = cut_lineage(classes)  # from here on the class ids are fixed
    coded = cut_lineage(
        classes.select("cid", "space", "weight", "embedding")
        .mapInArrow(_encode_rows, "cid long, space long, weight long, v binary, code binary, factors binary")
    )
    slots = coded.select("cid", "space", "code").mapInArrow(_slots, "key long, band int, cid long")
    shared = slots.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    units = block_units(slots.join(shared, "key").select("key", "band", "cid", "n"), "key", "n", "cid", BLOCK)
    units = units.join(coded, "cid").repartition("unit").sortWithinPartitions("unit", "space", "cid")
    found = cut_lineage(
        units.select("unit", "band", "block", "across", "cid", "space", "weight", "v", "code", "factors")
        .mapInArrow(_links_of(threshold), "cid long, links long, root long")
    )
    degree = found.groupBy("cid").agg(F.sum("links").alias("links"))
    group = components(found.where("cid <> root").select(F.col("cid").alias("a"), F.col("root").alias("b")))
    named = classes.select("cid", "same", "least", "weight").join(degree, "cid", "left").join(group.withColumnRenamed("node", "cid"), "cid", "left")
    named = cut_lineage(named.select("same", "least", F.coalesce("component", "cid").alias("c"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    least = named.groupBy("c").agg(F.min("least").alias("component_id"))
    named = named.join(least, "c").select("same", "n_links", "component_id")
    out = marked.select("vec_id", "same").join(named, "same", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
