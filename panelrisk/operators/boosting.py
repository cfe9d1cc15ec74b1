"""Gradient-boosted trees on all train rows, grown in one barrier stage.

The method is that of MLlib's ``GBTClassifier``: log loss, first tree on the
labels, candidate thresholds from the rows that MLlib would sample, best cut of
a node by its gain in variance, leaves of weighted means. MLlib starts a job for
every level of every tree and sums all nodes of a level from all rows. Here the
rows lie in bins (bytes), in blocks dealt evenly to the tasks of one barrier
stage; for a level the tasks exchange sums (files in the shared checkpoint
folder), and only of the smaller child of a node: the other one is the rest.
What is exchanged depends on nodes, features and bins, never on rows. A task
holds ``HELD_BYTES`` of rows; what is more lies in a scratch file of its own that
is read block by block. Where the
folder is no path that tasks can open, or executors come and go (dynamic
allocation), MLlib's own fit is used.

The trees are written in MLlib's format and loaded as its model, so scoring,
importance and storing are MLlib's. Rows and features are drawn by other random
numbers than MLlib's; without drawing, its trees come out but for rounding.
"""

from __future__ import annotations

import json
import math
import os
import re
import tempfile
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelrisk.session import cut_lineage, ensure_checkpoint_dir

NODES = ("tree int, id int, prediction double, impurity double, stats array<double>, n long, gain double, "
         "left int, right int, feature int, cut double")


WAIT_S = 3600  # the longest wait for another task's sums
MOST_CELLS = 1 << 10  # combinations of bins of a bundle of features
BLOCK_ROWS = 1 << 16  # rows that are counted together
HELD_BYTES = 128 << 20  # rows (bins, labels, margins) that a task holds in memory


@dataclass(frozen=True)
class Settings:
    trees: int
    rate: float
    depth: int
    min_rows: int
    rows: float  # share of rows of a tree
    features: int  # features of a node
    seed: int
    scale: float  # weighted targets are summed in steps of 1 / scale
    weights: tuple[float, float] | None  # those of the two labels, or None if they differ within one


def fit(estimator: GBTClassifier, train: DataFrame) -> GBTClassificationModel:
    """``estimator.fit(train)`` in one barrier stage; what that cannot do is left to MLlib."""
    spark = train.sparkSession
    get = lambda name: estimator.getOrDefault(name)
    row = vector_to_array(get("featuresCol")).alias("x")
    rows = train.select(row, F.col(get("labelCol")).cast("double").alias("label"), F.col(get("weightCol")).cast("double").alias("weight"))
    fine = F.col("label").isin(0.0, 1.0) & (F.col("weight") >= 0)
    of = lambda how, label: how(F.when(F.col("label") == label, F.col("weight")))
    seen = rows.agg(
        F.count(F.lit(1)).alias("n"), F.sum(fine.cast("long")).alias("fine"), F.first(F.size("x")).alias("width"), F.max("weight").alias("top"),
        F.array(of(F.min, 0.0), of(F.min, 1.0)).alias("least"), F.array(of(F.max, 0.0), of(F.max, 1.0)).alias("most")).first()
    features = _features(get("featureSubsetStrategy"), seen.width or 0)
    moving = spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true"  # no barrier stages then
    folder = _local(ensure_checkpoint_dir(spark))
    if seen.n < 2 or seen.fine != seen.n or features is None or get("maxBins") > 256 or moving or folder is None:
        return estimator.fit(train)
    chosen = Settings(get("maxIter"), get("stepSize"), get("maxDepth"), get("minInstancesPerNode"), get("subsamplingRate"), features, get("seed"),
                      exact_scale(seen.n, seen.top), tuple(w or 0.0 for w in seen.most) if seen.least == seen.most else None)
    cuts = candidates(rows, seen.n, get("maxBins"), get("seed"))
    tasks = slots(spark)
    blocks = cut_lineage(rows.mapInArrow(_blocks(cuts), "x binary, label binary, weight binary"))
    spread = blocks.repartition(tasks)  # no coalesce: a barrier stage has as many partitions as what it reads
    if spread.rdd.getNumPartitions() > tasks:  # the session deals into more tasks than run at once
        return estimator.fit(train)
    grown = spread.mapInArrow(_grow(cuts, chosen, f"{folder}/panelrisk-sums"), NODES, barrier=True)
    return _as_mllib(spark, estimator, grown, seen.width, chosen)


def exact_scale(n: int, weight: float) -> float:
    """The largest power of two by which ``n`` weighted targets (4 times the weight at most) sum up to less than 2^53."""
    return 2.0 ** (52 - math.ceil(math.log2(max(1.0, 4 * n * weight))))


def _features(strategy: str, width: int) -> int | None:
    """Features of a node, or None for a strategy that is left to MLlib."""
    if strategy in ("all", "auto"):
        return width
    share = float(strategy) if re.fullmatch(r"0?\.\d+|1\.0", strategy) else None
    return None if share is None else math.ceil(share * width)


def _local(folder: str) -> str | None:
    """The shared checkpoint folder as a path that tasks can open, or None if it has none (HDFS, an object store)."""
    path = re.sub(r"^file:(//)?(?=/)", "", folder)
    return path.rstrip("/") if path.startswith("/") else None


def slots(spark: SparkSession) -> int:
    """Tasks that the session can run at once: all tasks of a barrier stage start together."""
    sc = spark.sparkContext
    local = re.fullmatch(r"local\[(\d+)(,.*)?\]", sc.master)
    if local:
        return max(1, min(sc.defaultParallelism, int(local[1])))
    cores = sc.getConf().get("spark.executor.cores")
    if sc.master.startswith("local") or not cores:
        return max(1, sc.defaultParallelism)
    executors = len(sc._jsc.sc().statusTracker().getExecutorInfos()) - 1  # the driver is one of them
    return max(1, min(sc.defaultParallelism, executors * int(cores) // int(sc.getConf().get("spark.task.cpus", "1"))))


# ---- bins ------------------------------------------------------------------


def candidates(rows: DataFrame, n: int, max_bins: int, seed: int) -> list[np.ndarray]:
    """Thresholds of each feature, from as many rows as MLlib looks at for them: max(max_bins^2, 10,000)."""
    look = max(max_bins * max_bins, 10_000)
    some = (rows if n <= look else rows.sample(look / n, seed)).select("x", "weight").toPandas()
    x, w = np.array(some["x"].tolist(), float), some["weight"].to_numpy(float)
    return [thresholds(x[:, j], w, min(max_bins, n) - 1) for j in range(x.shape[1])] if len(x) else []


def thresholds(values: np.ndarray, weights: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` middles between neighbouring values, at even steps of the weight below them."""
    values, at = np.unique(values, return_inverse=True)
    middles = (values[:-1] + values[1:]) / 2
    if len(middles) <= most:
        return middles
    step = weights.sum() / (most + 1)
    below, target, out = np.cumsum(np.bincount(at, weights)), step, []
    for i in range(1, len(values)):
        if abs(below[i - 1] - target) < abs(below[i] - target):
            out.append(middles[i - 1])
            target += step
    return np.array(out[:most])


def _blocks(cuts: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(cuts))
            if not np.isfinite(x).all():
                raise ValueError("features must not be NaN or infinite")
            bins = np.empty(x.shape[::-1], np.uint8)
            for j, c in enumerate(cuts):
                bins[j] = np.searchsorted(c, x[:, j], side="left")
            values = [bins.tobytes(), *(batch.column(c).to_numpy(zero_copy_only=False).astype(float).tobytes() for c in ("label", "weight"))]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], ["x", "label", "weight"])

    return run


# ---- growing ---------------------------------------------------------------


class _Bundles:
    """Features joined, so that one count over the combinations of their bins serves all of them."""

    def __init__(self, bins: list[int], most: int = MOST_CELLS) -> None:
        self.bins, self.features, self.sizes = bins, [], []  # the features of a bundle, and its combinations
        for j in sorted(range(len(bins)), key=lambda j: (bins[j], j)):
            if self.sizes and self.sizes[-1] * bins[j] <= most:
                self.features[-1].append(j)
                self.sizes[-1] *= bins[j]
            else:
                self.features.append([j])
                self.sizes.append(bins[j])
        self.of, self.step = np.zeros(len(bins), np.int64), np.ones(len(bins), np.int64)
        for b, own in enumerate(self.features):
            self.of[own] = b
            for j, following in zip(reversed(own[:-1]), reversed(own[1:])):
                self.step[j] = self.step[following] * bins[following]
        self.widest = max(self.sizes, default=1)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """The combination of each bundle (bundles x rows) for bins ``x`` (features x rows)."""
        out = np.zeros((len(self.features), x.shape[1]), np.uint16)
        for b, own in enumerate(self.features):
            for j in own:
                out[b] += x[j] * np.uint16(self.step[j])
        return out

    def goes_right(self, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """nodes x combinations: whether the bin of the node's feature lies above its cut."""
        at = np.arange(self.widest)[None, :] // self.step[feature][:, None] % np.array(self.bins, np.int64)[feature][:, None]
        return at > cut[:, None]

    def apart(self, sums: list[np.ndarray], bins: int) -> np.ndarray:
        """Sums per (layer, node, feature, bin) from those per (layer, node, combination) of each bundle."""
        out = np.zeros((*sums[0].shape[:2], len(self.bins), bins))
        for own, s in zip(self.features, sums):
            s = s.reshape(*s.shape[:2], *(self.bins[j] for j in own))
            for i, j in enumerate(own):
                out[:, :, j, : self.bins[j]] = s.sum(axis=tuple(k + 2 for k in range(len(own)) if k != i))
        return out


class _Shelf:
    """Arrays of a task: in memory up to ``most`` bytes, the others in a scratch file without a name."""

    def __init__(self, most: int) -> None:
        self.left, self.end, self.file = most, 0, None

    def keep(self, values: np.ndarray) -> "_Kept":
        if self.left >= values.nbytes:
            self.left -= values.nbytes
            return _Kept(self, values, 0)
        if self.file is None:
            self.file = tempfile.TemporaryFile(buffering=0)
        kept = _Kept(self, None, self.end, values.dtype, values.shape)
        self.end += values.nbytes
        kept.set(values)
        return kept


class _Kept:
    def __init__(self, shelf: _Shelf, values: np.ndarray | None, at: int, dtype=None, shape=()) -> None:
        self.shelf, self.values, self.at, self.dtype, self.shape = shelf, values, at, dtype, shape

    def get(self) -> np.ndarray:
        if self.values is not None:
            return self.values
        out = np.empty(self.shape, self.dtype)
        view, done = memoryview(out).cast("B") if out.size else memoryview(b""), 0
        while done < len(view):
            n = os.preadv(self.shelf.file.fileno(), [view[done:]], self.at + done)
            if not n:
                raise OSError("the scratch file ends early")
            done += n
        return out

    def set(self, values: np.ndarray) -> None:
        if self.values is not None:
            self.values = values
            return
        raw, done = memoryview(np.ascontiguousarray(values, self.dtype)).cast("B") if values.size else memoryview(b""), 0
        while done < len(raw):
            done += os.pwrite(self.shelf.file.fileno(), raw[done:], self.at + done)


def _coded(batch: tuple[bytes, bytes, bytes], bundles: _Bundles, shelf: _Shelf) -> tuple[int, _Kept, _Kept, _Kept]:
    """(number that draws its rows, combinations by bundle, labels, weights) of a batch."""
    x, label, weight = batch
    codes = bundles.codes(np.frombuffer(x, np.uint8).reshape(-1, len(label) // 8))
    return zlib.crc32(x), shelf.keep(codes), shelf.keep(np.frombuffer(label).astype(np.int8)), shelf.keep(np.frombuffer(weight))


class _Block:
    """Some batches of rows: bins by bundle, labels -1/1, weights, margins, and the node each row is at.

    Weighted targets are rounded to steps of 1 / ``scale`` where cuts are looked
    for, which makes their sums exact: cuts of equal rows have equal gains,
    whatever the order of the rows and the bundles.
    """

    def __init__(self, batches: list[tuple], bundles: _Bundles, s: Settings, shelf: _Shelf | None = None) -> None:
        shelf = shelf or _Shelf(1 << 62)
        batches = [_coded(b, bundles, shelf) if len(b) == 3 else b for b in batches]
        self.drawn = [(crc, kept.get().shape[-1]) for crc, _, kept, _ in batches]
        self.codes, n = [kept for _, kept, _, _ in batches], sum(k for _, k in self.drawn)
        if all(kept.values is not None for kept in self.codes):
            self.codes = [_Kept(shelf, np.concatenate([kept.values for kept in self.codes], axis=1), 0)]
        self.y = shelf.keep(2 * np.concatenate([kept.get() for _, _, kept, _ in batches]) - 1)
        self.w = shelf.keep(np.concatenate([kept.get() for _, _, _, kept in batches]))
        self.margin, self.target = shelf.keep(np.zeros(n)), shelf.keep(np.zeros(n))
        self.at, self.some = shelf.keep(np.zeros(n, np.int32)), shelf.keep(np.ones(n, bool))
        self.bundles, self.s = bundles, s

    def _codes(self) -> np.ndarray:
        return self.codes[0].get() if len(self.codes) == 1 else np.concatenate([kept.get() for kept in self.codes], axis=1)

    def start(self, tree: int) -> None:
        s, y = self.s, self.y.get().astype(float)
        self.target.set(4 * y / (1 + np.exp(2 * y * self.margin.get())) if tree else y)
        if s.rows < 1:  # a batch's rows are drawn by the batch
            self.some.set(np.concatenate([np.random.default_rng([s.seed, tree, i]).random(k) < s.rows for i, k in self.drawn]))
        self.at.set(np.zeros(len(y), np.int32))

    def add_sums(self, out: list[np.ndarray], place: np.ndarray) -> None:
        """Adds up per bundle and (place of the node, combination); place -1 is left out.

        The layers are rows of label 0, rows of label 1 (or, where weights differ
        within a class, rows and weights), and weighted targets.
        """
        spot = place[self.at.get()]
        rows = np.flatnonzero((spot >= 0) & self.some.get())
        spot, w = spot[rows], self.w.get()[rows]
        wt, by_class = np.rint(w * self.target.get()[rows] * self.s.scale), self.s.weights is not None
        own = (self.y.get()[rows] > 0).astype(np.int64) if by_class else np.rint(w * self.s.scale)
        for sums, codes in zip(out, self._codes()):
            k, cells = sums.shape[1:]
            key = spot * cells
            key += codes[rows]
            sums[2] += np.bincount(key, wt, k * cells).reshape(k, cells)
            if by_class:
                key += own * (k * cells)
                sums[:2] += np.bincount(key, minlength=2 * k * cells).reshape(2, k, cells)
            else:
                sums[0] += np.bincount(key, minlength=k * cells).reshape(k, cells)
                sums[1] += np.bincount(key, own, k * cells).reshape(k, cells)

    def go_down(self, feature: np.ndarray, right: np.ndarray, left: np.ndarray) -> None:
        """Rows of nodes that were cut go to a child (``right``: by the combination of their feature's bundle); a leaf leads back to itself."""
        at = self.at.get().astype(np.int64)
        code = self._codes().ravel().take((self.bundles.of[feature] * len(at))[at] + np.arange(len(at)))
        self.at.set((left[at] + right.ravel().take(at * self.bundles.widest + code)).astype(np.int32))

    def node_sums(self, nodes: int) -> np.ndarray:
        rows = self.some.get()
        at, w, target = self.at.get()[rows], self.w.get()[rows], self.target.get()[rows]
        wt = w * target
        return np.array([np.bincount(at, v, nodes) if v is not None else np.bincount(at, minlength=nodes) for v in (None, w, wt, wt * target)], float)

    def add_margin(self, value: np.ndarray) -> None:
        self.margin.set(self.margin.get() + value[self.at.get()])


def _level_sums(blocks: list[_Block], bundles: _Bundles, s: Settings, place: np.ndarray, asked: int, bins: int) -> np.ndarray:
    """(rows, weight, weighted target) per (asked node, feature, bin) of the rows of ``blocks``; the last two exact in steps of 1 / scale."""
    found = [np.zeros((3, asked, size)) for size in bundles.sizes]
    for b in blocks:
        b.add_sums(found, place)
    return bundles.apart(found, bins)


def _meant(sums: np.ndarray, s: Settings) -> np.ndarray:
    """(rows, weight, weighted target) from the layers that were summed over all tasks."""
    first, second, target = sums
    if s.weights is None:
        return np.stack([first, second / s.scale, target / s.scale])
    return np.stack([first + second, first * s.weights[0] + second * s.weights[1], target / s.scale])


class _Exchange:
    """Sums over the tasks of a barrier stage, by files in the shared checkpoint folder.

    ``allGather`` sleeps for a second when a task has to wait for another one, a
    thousand times a fit. A task's file of a round is removed once all tasks
    have written the next one, so a task has two files at most.
    """

    def __init__(self, ctx: BarrierTaskContext, folder: str) -> None:
        self.task, self.round = ctx.partitionId(), 0
        # a new folder for each attempt of the stage, named by the first task
        name = ctx.allGather(uuid.uuid4().hex)
        self.tasks, self.folder = len(name), f"{folder}/{name[0]}"
        os.makedirs(self.folder, exist_ok=True)

    def _path(self, task: int, turn: int) -> str:
        return f"{self.folder}/{turn}-{task}"

    def total(self, own: np.ndarray) -> np.ndarray:
        """The sum of all tasks' arrays, the same in every task."""
        self.round += 1
        mine = self._path(self.task, self.round)
        with open(f"{mine}.part", "wb") as f:
            f.write(np.ascontiguousarray(own, float).tobytes())
        os.replace(f"{mine}.part", mine)
        out = np.zeros(own.size)
        for task in range(self.tasks):  # in this order everywhere, so that all tasks see equal sums
            out += np.frombuffer(self._wait(self._path(task, self.round)))
        if self.round > 1:
            os.remove(self._path(self.task, self.round - 1))
        return out.reshape(own.shape)

    def _wait(self, path: str) -> bytes:
        pause, until = 0.0005, time.monotonic() + WAIT_S
        while not os.path.exists(path):
            if time.monotonic() > until:
                raise TimeoutError(f"no sums from another task within {WAIT_S} s: {path}")
            time.sleep(pause)
            pause = min(0.02, pause * 1.5)
        with open(path, "rb") as f:
            return f.read()

    def close(self, ctx: BarrierTaskContext) -> None:
        ctx.barrier()  # all have read the last round
        os.remove(self._path(self.task, self.round))


def best_cuts(sums: np.ndarray, min_rows: int, seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain, feature, bin) of the best cut of each node, from (rows, weight, weighted target) per (node, feature, bin).

    ``seen`` marks the features that a node may use. A gain of 0 stands for none.
    """
    k, width, bins = sums.shape[1:]
    n, w, s = left = np.cumsum(sums, axis=3)
    right = left[..., -1:] - left
    fine = (n >= min_rows) & (right[0] >= min_rows) & (w > 0) & (right[1] > 0)
    if seen is not None:
        fine &= seen[:, :, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        whole, rest = left[1, ..., -1:], left[2, ..., -1:]
        gain = np.where(fine, (s**2 / w + right[2] ** 2 / right[1] - rest**2 / whole) / whole, 0.0)
    flat = gain.reshape(k, width * bins)
    best = flat.argmax(axis=1)
    return flat[np.arange(k), best], best // bins, best % bins


def _one_tree(sums_of: _Exchange, blocks: list[_Block], bundles: _Bundles, s: Settings, tree: int) -> dict[str, np.ndarray]:
    width, bins = len(bundles.bins), max(bundles.bins, default=1)
    for b in blocks:
        b.start(tree)
    draw = np.random.default_rng([s.seed, tree])
    feature, cut, left, gain = [0], [255], [0], [0.0]
    level, sums = np.array([0]), None  # nodes of the level and their sums
    for depth in range(s.depth):
        # of two children, the one of fewer rows is summed; the other one is the rest of their parent
        asked = level if not depth else level[::2] + small
        place = np.full(len(left), -1)
        place[asked] = np.arange(len(asked))
        found = sums_of.total(_level_sums(blocks, bundles, s, place, len(asked), bins))
        if depth:
            both = np.empty((3, len(level), width, bins))
            at = np.arange(len(asked))
            both[:, 2 * at + small], both[:, 2 * at + 1 - small] = found, sums - found
            found = both
        seen = None
        if s.features < width:
            seen = np.argsort(draw.random((len(level), width)), axis=1).argsort(axis=1) < s.features
        best, by, where = best_cuts(_meant(found, s), s.min_rows, seen)
        split = np.flatnonzero(best > 1e-12)
        if not len(split):
            break
        for i in split.tolist():
            node, new = int(level[i]), len(left)
            feature[node], cut[node], left[node], gain[node] = int(by[i]), int(where[i]), new, float(best[i])
            for column, v in ((feature, (0, 0)), (cut, (255, 255)), (left, (new, new + 1)), (gain, (0.0, 0.0))):
                column.extend(v)
        sums = found[:, split]
        rows = _meant(sums, s)[0]
        rows_left = np.cumsum(rows, axis=2)[np.arange(len(split)), by[split], where[split]]
        small = (rows_left * 2 > rows[:, 0].sum(axis=1)).astype(int)
        level = np.concatenate([[left[level[i]], left[level[i]] + 1] for i in split])
        right = bundles.goes_right(np.array(feature), np.array(cut))
        for b in blocks:
            b.go_down(np.array(feature), right, np.array(left))
    stats = sums_of.total(np.sum([b.node_sums(len(left)) for b in blocks], axis=0) if blocks else np.zeros((4, len(left))))
    for node in reversed(range(len(left))):
        if left[node] != node:
            stats[:, node] = stats[:, left[node]] + stats[:, left[node] + 1]
    value = np.divide(stats[2], stats[1], out=np.zeros(len(left)), where=stats[1] > 0)
    for b in blocks:
        b.add_margin((s.rate if tree else 1.0) * value)
    return {"feature": np.array(feature), "cut": np.array(cut), "left": np.array(left), "gain": np.array(gain), "stats": stats, "value": value}


def _runs(batches: list[tuple]) -> Iterator[list[tuple]]:
    """The batches in runs of about ``BLOCK_ROWS`` rows; they leave the list as they are taken."""
    batches.reverse()
    while batches:
        run, n = [], 0
        while batches and n < BLOCK_ROWS:
            run.append(batches.pop())
            n += len(run[-1][1]) // 8 if len(run[-1]) == 3 else run[-1][2].get().shape[-1]
        yield run


def _grow(cuts: list[np.ndarray], s: Settings, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = BarrierTaskContext.get()
        bundles, shelf = _Bundles([len(c) + 1 for c in cuts]), _Shelf(HELD_BYTES)
        found = [_coded(tuple(batch.column(c)[i].as_py() for c in ("x", "label", "weight")), bundles, shelf) for batch in batches for i in range(batch.num_rows)]
        blocks = [_Block(some, bundles, s, shelf) for some in _runs(sorted(found, key=lambda b: b[0]))]
        del found
        exchange = _Exchange(ctx, folder)
        for tree in range(s.trees):
            t = _one_tree(exchange, blocks, bundles, s, tree)
            if ctx.partitionId() == 0:
                yield _nodes(tree, t, cuts)
        exchange.close(ctx)

    return run


def _nodes(tree: int, t: dict[str, np.ndarray], cuts: list[np.ndarray]) -> pa.RecordBatch:
    """A tree as rows of ``NODES``."""
    ids = np.arange(len(t["left"]))
    inner = t["left"] != ids
    n, w, s, q = t["stats"]
    impurity = np.divide(q - s * t["value"], w, out=np.zeros(len(ids)), where=w > 0)
    at = [float(cuts[f][c]) if i else 0.0 for f, c, i in zip(t["feature"], t["cut"], inner)]
    columns = [
        pa.array(np.full(len(ids), tree), pa.int32()), pa.array(ids, pa.int32()), pa.array(t["value"]), pa.array(impurity),
        pa.array([list(map(float, v)) for v in zip(w, s, q)], pa.list_(pa.float64())), pa.array(n.astype(np.int64)), pa.array(np.where(inner, t["gain"], -1.0)),
        pa.array(np.where(inner, t["left"], -1), pa.int32()), pa.array(np.where(inner, t["left"] + 1, -1), pa.int32()),
        pa.array(np.where(inner, t["feature"], -1), pa.int32()), pa.array(at),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in NODES.split(", ")])


# ---- the model -------------------------------------------------------------


def _as_mllib(spark: SparkSession, estimator: GBTClassifier, grown: DataFrame, width: int, s: Settings) -> GBTClassificationModel:
    """The grown trees as MLlib's model: its format, as a tiny fit of the same estimator writes it, around other nodes."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/panelrisk-models/{uuid.uuid4().hex}"
    tiny = spark.createDataFrame([(Vectors.dense([0.0] * width), float(i), 1.0) for i in (0, 1)], ["f", "l", "w"]).toDF(
        *(estimator.getOrDefault(c) for c in ("featuresCol", "labelCol", "weightCol")))
    estimator.copy({estimator.maxIter: 1}).fit(tiny).write().save(f"{base}/tiny")
    meta = json.loads(spark.read.text(f"{base}/tiny/metadata").first()[0])
    meta["paramMap"]["maxIter"], meta["numTrees"] = s.trees, s.trees
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{base}/model/metadata")
    own = spark.read.parquet(f"{base}/tiny/treesMetadata")
    kept = own.first()
    trees = [(t, kept[1], s.rate if t else 1.0) for t in range(s.trees)]
    spark.createDataFrame(trees, own.schema).coalesce(1).write.parquet(f"{base}/model/treesMetadata")
    like = spark.read.parquet(f"{base}/tiny/data").schema
    at = F.when(F.col("left") >= 0, F.array("cut")).otherwise(F.array().cast("array<double>"))
    split = F.struct(F.col("feature").alias("featureIndex"), at.alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
    node = F.struct("id", "prediction", "impurity", F.col("stats").alias("impurityStats"), F.col("n").alias("rawCount"), "gain",
                    F.col("left").alias("leftChild"), F.col("right").alias("rightChild"), split.alias("split"))
    grown.select(F.col("tree").alias("treeID"), node.cast(like["nodeData"].dataType).alias("nodeData")).write.parquet(f"{base}/model/data")
    return GBTClassificationModel.load(f"{base}/model")


__all__ = ["fit", "candidates", "thresholds", "best_cuts", "slots"]
