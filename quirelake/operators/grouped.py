"""Sequential work within groups, many groups an Arrow batch.

Rows are dealt out by a key and sorted, so a group is a run of rows; a batch of
runs becomes numpy columns once, and only the run that is still open is carried
over. A group must fit a task, as a page does. Work on small groups takes one
step of all groups of a batch at a time, padded to the size of the largest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A function of a group's columns: places of the rows that are returned, and the
#: values of added columns in these rows.
Work = Callable[[dict[str, np.ndarray]], tuple[np.ndarray, tuple[np.ndarray, ...]]]

#: The same of many groups whose columns lie end to end between bounds.
ManyWork = Callable[[dict[str, np.ndarray], np.ndarray], tuple[np.ndarray, tuple[np.ndarray, ...]]]

_ARROW = {T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.IntegerType(): pa.int32()}

#: Cells of a padded block: few enough for its arrays to stay in a core's cache.
CELLS = 1 << 15


def padded(sizes: np.ndarray, cells: Callable[[int], int] = lambda n: n) -> Iterator[tuple[np.ndarray, int]]:
    """Groups with rows, in blocks of like size: their numbers and the size of the largest.

    ``cells`` tells how many cells a group of a size takes when padded; a group
    that has more than a block's is a block alone.
    """
    order = np.argsort(sizes, kind="stable")
    own, end = sizes[order], len(order)
    while end and (most := int(own[end - 1])):
        start = max(end - max(CELLS // cells(most), 1), int(np.searchsorted(own, (most + 1) // 2)))
        yield order[start:end], most
        end = start


def over_groups(df: DataFrame, key: str, order: list[str], needs: list[str], work: Work, keep: list[str], adds: list[T.StructField] | None = None) -> DataFrame:
    """Rows that ``work`` returns of each group of ``key``, in its order.

    ``work`` sees the columns ``needs`` of one group, sorted by ``order``; rows come
    back with the columns ``keep`` (of any type, untouched) and those of ``adds``.
    Rows of a null key are one group.
    """

    def each(columns: dict[str, np.ndarray], bounds: np.ndarray) -> tuple:
        places, values = [np.zeros(0, np.int64)], [[] for _ in adds or []]
        for a, b in zip(bounds, bounds[1:], strict=False):
            found, more = work({c: v[a:b] for c, v in columns.items()})
            places.append(np.asarray(found, np.int64) + a)
            for held, v in zip(values, more, strict=True):
                held.append(v)
        return np.concatenate(places), tuple(np.concatenate(v) if v else () for v in values)

    return over_many_groups(df, key, order, needs, each, keep, adds)


def over_many_groups(df: DataFrame, key: str, order: list[str], needs: list[str], work: ManyWork, keep: list[str], adds: list[T.StructField] | None = None) -> DataFrame:
    """``over_groups`` with work that takes all whole groups of a batch at once.

    Rows are dealt out and sorted by a window over the key, for which a table
    that is dealt out by the key already, as detections numbered within their
    page are, is not dealt out again. The window's number is 1 where a group
    begins.
    """
    adds = adds or []
    names = list(dict.fromkeys([key, *order, *needs, *keep]))
    dealt = df.select(*names, F.row_number().over(Window.partitionBy(key).orderBy(*order)).alias("_place_in_group"))
    schema = T.StructType([*[dealt.schema[c] for c in keep], *adds])
    at = {c: i for i, c in enumerate(names)}
    added = [_ARROW[f.dataType] for f in adds]
    out_names = [f.name for f in schema]

    def give(rows: pa.RecordBatch, bounds: np.ndarray) -> pa.RecordBatch:
        places, values = work({c: rows.column(at[c]).to_numpy(zero_copy_only=False) for c in needs}, bounds)
        take = pa.array(places, pa.int64())
        new = [pa.array(v, t) for v, t in zip(values, added, strict=True)]
        return pa.RecordBatch.from_arrays([*(rows.column(at[c]).take(take) for c in keep), *new], out_names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            starts = np.flatnonzero(batch.column(len(names)).to_numpy() == 1)
            if not len(starts):
                held += [batch] if batch.num_rows else []
                continue
            ahead = sum(x.num_rows for x in held)
            rows = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
            bounds = ([0] if ahead else []) + (starts + ahead).tolist()
            if len(bounds) > 1:
                yield give(rows.slice(0, bounds[-1]), np.array(bounds))
            held = [rows.slice(bounds[-1])]
        if held:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            yield give(rows, np.array([0, rows.num_rows]))

    return dealt.mapInArrow(run, schema)
