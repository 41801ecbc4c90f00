"""Shared plumbing of the corpus operators: scratch tables and Arrow helpers."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import new_folder, remove


class Scratch:
    """Parquet tables in the shared folder that cut lineage between jobs.

    A table survives the loss of any executor, unlike cached blocks. Results are
    planned over them; ``quirelake.sources.tables.clean`` removes them afterwards.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = new_folder(spark, name)
        self._n = 0

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` once and return it read back, with its schema fixed."""
        self._n += 1
        path = f"{self.root}/{self._n}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of this scratch that no later plan reads."""
        remove(self.spark, *(t._scratch_path for t in tables))


def arrow_table(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    """A record batch of ``columns`` (arrays or lists) cast to ``schema``."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is the empty text."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def binary_rows(values: np.ndarray) -> pa.Array:
    """Each row of a C-contiguous 2-D array as one binary value."""
    values = np.ascontiguousarray(values)
    width = values.shape[1] * values.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(values), [None, pa.py_buffer(values)]).cast(pa.binary())


def runs(*keys: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal keys in sorted columns: starts, then the end."""
    n = len(keys[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), n)


def grouped_batches(batches, n_keys: int):
    """Yield record batches that hold whole groups of rows sorted by the first
    ``n_keys`` columns; only the last, open group is carried over."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        whole = table.to_batches()[0]
        cut = int(runs(*(whole.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)))[-2])
        if cut:
            yield whole.slice(0, cut)
        held = whole.slice(cut)
    if held is not None and held.num_rows:
        yield held


class Forest:
    """Components of rows 0..n-1 as pairs arrive in arrays; labels are least rows."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label[:] = label[label]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """A star around the least row of each component."""
        rows = np.flatnonzero(self.label != np.arange(len(self.label)))
        return rows, self.label[rows]


def block_tasks(df: DataFrame, size: str, block: int, row_id: str, keys: list[str]) -> DataFrame:
    """Spread each group of ``size`` rows over tasks of at most about two blocks.

    A group of up to ``block`` rows is one task (0, 0). A larger one is cut into
    blocks by a hash of ``row_id`` and every pair of blocks is a task (i, j), so
    all pairs of rows still meet and no task holds more than two blocks. Adds
    the columns ``bi`` and ``bj``, and ``own`` for the row's block, and deals rows
    out by ``keys`` and the first two, sorted so that groups are contiguous.
    """
    n = F.greatest(F.lit(1), F.ceil(F.col(size) / F.lit(block))).cast("int")
    own = F.pmod(F.xxhash64(F.col(row_id), F.lit(7)), F.col("_nb")).cast("int")
    spread = (
        df.withColumn("_nb", n)
        .withColumn("own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
        .withColumn("bi", F.least("own", "_other"))
        .withColumn("bj", F.greatest("own", "_other"))
        .drop("_nb", "_other")
    )
    by = [*keys, "bi", "bj"]
    return spread.repartition(*by).sortWithinPartitions(*by)


def splittable(df: DataFrame) -> DataFrame:
    """An aggregate that a join is to deal out anew. Joined as it stands, it would
    keep the partitions of its own keys, and AQE couldn't split a hot one."""
    return df.hint("rebalance")


def bounded_broadcast(spark: SparkSession, df: DataFrame, rows: int, limit: int = 200_000) -> DataFrame:
    """Hint a broadcast only if the measured number of narrow rows is within
    ``limit``; a larger side keeps the shuffled join."""
    return F.broadcast(df) if rows <= limit else df


_LIVE: dict[tuple, object] = {}


def worker_object(kind: str, key, make):
    """An encoder or memo that a Python worker keeps between tasks.

    Workers outlive stages, so only the one in use is kept: asking for another
    drops it, and idle workers don't add up the memos of every operator.
    """
    if (kind, key) not in _LIVE:
        _LIVE.clear()
        _LIVE[kind, key] = make()
    return _LIVE[kind, key]


def tokenizer_path(name: str) -> str:
    """Path of a public vocabulary file, found on the machine that runs the task."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
