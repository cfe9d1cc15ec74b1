"""Comparing the members of buckets in bounded units of work.

A bucket of n rows is cut into blocks of about ``block`` rows by a hash; every
pair of blocks is a unit, so a bucket of any size is spread over many tasks and
a task holds two blocks at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_units(rows: DataFrame, key: str, count: str, member: str, block: int) -> DataFrame:
    """``rows`` once per unit that they take part in, with columns unit, block and across.

    ``count`` holds the number of rows of the bucket. A unit pairs block i with
    block j >= i; ``across`` is True where the two differ, and then only pairs
    of rows from different blocks are the unit's own.
    """
    blocks = F.ceil(F.col(count) / block).cast("int")
    placed = rows.withColumn("_nb", blocks).withColumn("block", F.pmod(F.xxhash64(member), F.col("_nb")).cast("int"))
    placed = placed.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    unit = F.xxhash64(key, F.least("block", "_o"), F.greatest("block", "_o"))
    return placed.withColumn("unit", unit).withColumn("across", F.col("block") != F.col("_o")).drop("_nb", "_o")


def whole_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Regroup batches sorted by ``unit`` so that no unit is torn; holds one unit beyond a batch at most."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        unit = np.asarray(batch.column("unit"))
        edges = np.flatnonzero(unit[1:] != unit[:-1]) + 1
        if held and unit[0] != held[-1].column("unit")[0].as_py():
            yield pa.concat_batches(held)
            held = []
        if len(edges):
            yield pa.concat_batches([*held, batch.slice(0, edges[-1])])
            held = [batch.slice(edges[-1])]
        else:
            held.append(batch)
    if held:
        yield pa.concat_batches(held)


def runs(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, end) of each run of rows that agree in all columns."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    cut = np.flatnonzero(new)
    yield from zip(cut.tolist(), np.r_[cut[1:], len(new)].tolist())
