"""Flat tensors in array columns: shapes, positions, and token places."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reshape(flat: Column, width: Column | int) -> Column:
    """Rows of ``width`` values of a flat array; a short last row stays short."""
    w = F.lit(width) if isinstance(width, int) else width
    rows = F.ceil(F.size(flat) / w).cast("int")
    return F.when(rows > 0, F.transform(F.sequence(F.lit(0), rows - 1), lambda i: F.slice(flat, i * w + 1, w))).otherwise(F.array())


def first_columns(rows: Column, n: int) -> Column:
    """The first ``n`` values of each row, row after row."""
    return F.flatten(F.transform(rows, lambda r: F.slice(r, 1, n)))


def filled(n: Column, value) -> Column:
    """``n`` times a value (ones of a mask, for example)."""
    return F.array_repeat(F.lit(value), n)


def linspace(start: Column, end: Column, steps: Column) -> Column:
    """``steps`` values from ``start`` to ``end``, both included; one step is the start."""
    gap = (end - start) / F.greatest(steps - 1, F.lit(1))
    return F.transform(F.sequence(F.lit(0), steps - 1), lambda i: start + i * gap)


def flat_place(flat: Column, classes: int) -> tuple[Column, Column]:
    """(query, class) of an index into flattened scores."""
    return F.floor(flat / classes).cast("int"), F.pmod(flat, F.lit(classes)).cast("int")


def scatter_features(tokens: DataFrame, features: DataFrame, keys: list[str], place: str, token: str, image_token: int, feature_place: str, value: str) -> DataFrame:
    """Tokens with the feature of the n-th image token of a sequence put at it.

    Image tokens are numbered by place, features by their own; both meet in an
    equi-join on the sequence and number. Other tokens have no feature; an image
    token beyond the features has none either.
    """
    marked = tokens.withColumn("_image", F.col(token) == image_token)
    upto = Window.partitionBy(*keys).orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = marked.withColumn("_n", F.when(F.col("_image"), F.sum(F.col("_image").cast("long")).over(upto)))
    own = features.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(feature_place)).cast("long")).select(*keys, "_n", value)
    return numbered.join(own, [*keys, "_n"], "left").drop("_n", "_image")


def gather(rows: DataFrame, source: DataFrame, keys: list[str], index: str, source_index: str) -> DataFrame:
    """Rows with the columns of the source row that their index names."""
    return rows.join(source.withColumnRenamed(source_index, index), [*keys, index], "left")


def axis_positions(ids: np.ndarray, image_token: int, grids: list[tuple[int, int, int]], merge: int = 2) -> np.ndarray:
    """(3, length) time, row and column positions of one sequence.

    A text token has one position on all axes, one beyond the greatest before;
    an image's tokens count through its grid (sides divided by ``merge``) from
    there.
    """
    out, at, grid, i = np.zeros((3, len(ids)), np.int64), 0, iter(grids), 0
    while i < len(ids):
        if ids[i] != image_token:
            out[:, i] = at
            at, i = at + 1, i + 1
            continue
        t, h, w = next(grid)
        h, w = h // merge, w // merge
        n = t * h * w
        block = np.indices((t, h, w)).reshape(3, n)
        out[:, i : i + n] = at + block
        at, i = at + max(t, h, w), i + n
    return out


def attention_mask(ids: np.ndarray, end: int, opens: int, closes: int, pad: int = 0) -> np.ndarray:
    """(length, length) of who sees whom: earlier tokens of the same document, and
    all of the same image; padding at the left is seen by none."""
    n = len(ids)
    real = np.cumsum(ids != pad) > 0
    ended = np.cumsum(ids == end)
    segment = np.concatenate([[0], ended[:-1]])
    opened, closed = np.cumsum(ids == opens), np.concatenate([[0], np.cumsum(ids == closes)[:-1]])
    image = np.where(opened > closed, opened, 0)
    causal = np.tril(np.ones((n, n), bool)) & (segment[:, None] == segment[None]) & real[None]
    return causal | ((image[:, None] == image[None]) & (image > 0)[None])


def left_padded(ids: Column, length: Column, pad: int = 0) -> Column:
    """Ids with padding at the left up to ``length``."""
    gap = F.greatest(length - F.size(ids), F.lit(0))
    return F.concat(F.array_repeat(F.lit(pad).cast("bigint"), gap.cast("int")), ids)


def stretched(df: DataFrame, value: str, by: list[str], top: float = 255.0, name: str = "stretched") -> DataFrame:
    """Adds a value moved to 0..``top`` between the least and greatest of its group; 0 where these are one."""
    w = Window.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(name, F.when(high > low, (F.col(value) - low) / (high - low) * top).otherwise(0.0))


def commonest(df: DataFrame, value: str, by: list[str], order: str, name: str = "commonest") -> DataFrame:
    """The commonest value of each group; of equals the one met first.

    Two aggregates with map-side combine, no window over whole groups.
    """
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    best = F.max_by(F.struct(value, "_n"), F.struct(F.col("_n"), (-F.col("_first")).alias("_early")))
    return counts.groupBy(*by).agg(best.alias("_b")).select(*by, F.col("_b")[value].alias(name), F.col("_b._n").alias("n"))


def all_finished(df: DataFrame, by: list[str], test: Column, name: str = "finished") -> DataFrame:
    """Whether every row of a group passes."""
    return df.groupBy(*by).agg(F.bool_and(test).alias(name))
