"""Decoding of model outputs: scores, top classes, sequence collapse."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(scores: Column) -> Column:
    """Shifted by the greatest score, summed in double precision."""
    top = F.array_max(scores)
    powers = F.transform(scores, lambda v: F.exp((v - top).cast("double")))
    total = F.aggregate(powers, F.lit(0.0), lambda a, v: a + v)
    return F.transform(powers, lambda v: v / total)


def top_probability(scores: Column) -> Column:
    """Softmax probability of the greatest score: one over the shifted sum."""
    top = F.array_max(scores)
    return 1 / F.aggregate(scores, F.lit(0.0), lambda a, v: a + F.exp((v - top).cast("double")))


def argmax(scores: Column) -> Column:
    """Index of the greatest value; the first of equals."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def argmax_of_last_row(flat: Column, rows: Column, width: Column, item: Column | None = None) -> Column:
    """Argmax of the last row of one item of a flattened (item, row, column) tensor."""
    item = F.lit(0) if item is None else item
    return argmax(F.slice(flat, ((item + 1) * rows - 1) * width + 1, width))


def truncate_at(tokens: Column, end: int) -> Column:
    """Prefix up to and with the first end id; the whole array without one."""
    at = F.array_position(tokens, F.lit(end).cast("bigint"))
    return F.when(at > 0, F.slice(tokens, 1, at)).otherwise(tokens)


def drop_special(tokens: Column, special: list[int], size: int) -> Column:
    """Tokens without special ids and without ids outside the vocabulary."""
    return F.filter(tokens, lambda t: ~t.isin(special) & (t >= 0) & (t < size))


def top_k(df: DataFrame, key: str, scores: str, k: int = 1, labels: dict[int, str] | None = None) -> DataFrame:
    """(key, rank, index, score, label) of the k best classes a row, ties to the
    lower index; a label without a name is its index.

    Ranked inside the row's array, so nothing is exploded or shuffled for it.
    """
    pairs = F.transform(scores, lambda v, i: F.struct((-v).alias("neg"), i.alias("index"), v.alias("score")))
    best = df.select(key, F.posexplode(F.slice(F.array_sort(pairs), 1, k)).alias("rank", "_b"))
    index = F.col("_b.index")
    name = F.coalesce(*([F.element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), index)] if labels else []), index.cast("string"))
    return best.select(key, (F.col("rank") + 1).alias("rank"), index.alias("index"), F.col("_b.score").alias("score"), name.alias("label"))


def ctc_collapse(steps: DataFrame, keys: list[str], order: str, index: str, prob: str | None = None, blank: int = 0) -> DataFrame:
    """Steps that count: not blank, and not the index of the step before."""
    before = F.lag(index).over(Window.partitionBy(*keys).orderBy(order))
    marked = steps.withColumn("_before", before)
    return marked.where((F.col(index) != blank) & (F.col("_before").isNull() | (F.col("_before") != F.col(index)))).drop("_before")


def collapsed(classes: Column, values: Column, blank: int = 0) -> Column:
    """Array of struct(k, v) of the steps that count, within a row: not blank, and
    not the class of the step before.

    Each step is paired with the one before it first: a step looked up from
    within a lambda would have the whole array worked out anew.
    """

    def keep(x):
        before = F.concat(F.array(F.lit(None).cast("int")), F.slice(x["k"], 1, F.greatest(F.size(x["k"]) - 1, F.lit(0))))
        counts = F.zip_with(x["k"], before, lambda k, p: (k != blank) & F.coalesce(p != k, F.lit(True)))
        both = F.arrays_zip(counts.alias("c"), x["k"].alias("k"), x["v"].alias("v"))
        return F.transform(F.filter(both, lambda y: y["c"]), lambda y: F.struct(y["k"].alias("k"), y["v"].alias("v")))

    return F.get(F.transform(F.array(F.struct(classes.alias("k"), values.alias("v"))), keep), F.lit(0))


def ctc_decode(logits: Column, alphabet: list[str]) -> Column:
    """struct(text, scores) of an array of per-step class scores, inside the row.

    Class 0 is the blank; class i > 0 is alphabet[i - 1]. A kept step of an index
    beyond the alphabet adds to the mean score but no character; no kept step
    scores 0.
    """
    kept = collapsed(F.transform(logits, argmax), F.transform(logits, lambda row: F.array_max(row).cast("double")))
    chars = F.array(*map(F.lit, alphabet))

    def read(steps):
        text = F.array_join(F.transform(steps, lambda s: F.coalesce(F.get(chars, s["k"] - 1), F.lit(""))), "")
        mean = F.aggregate(steps, F.lit(0.0), lambda a, s: a + s["v"]) / F.size(steps)
        return F.struct(text.alias("text"), F.array(F.when(F.size(steps) > 0, mean).otherwise(F.lit(0.0))).alias("scores"))

    return F.get(F.transform(F.array(kept), read), F.lit(0))


def segment_ids(steps: DataFrame, keys: list[str], order: str, end: Column) -> DataFrame:
    """Adds ``segment``: end markers before each position of a sequence."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("segment", F.coalesce(F.sum(end.cast("long")).over(w), F.lit(0).cast("long")))


def open_depth(steps: DataFrame, keys: list[str], order: str, opens: Column, closes: Column) -> DataFrame:
    """Adds ``depth``: openings up to and with each position, less closings before it."""
    w = Window.partitionBy(*keys).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("depth", F.sum(opens.cast("long")).over(upto) - F.coalesce(F.sum(closes.cast("long")).over(before), F.lit(0).cast("long")))


def spans_of_segments(bounds: np.ndarray, end: np.ndarray, opens: np.ndarray, closes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sequence, segment, length and summed depth of every segment, of sequences
    that lie end to end between ``bounds``: ``segment_ids`` and ``open_depth``
    grouped by segment, with no row a position."""
    first = np.zeros(len(end) + 1, bool)
    first[1:] = end
    first[bounds] = True
    at = np.flatnonzero(first[:-1])
    own = np.searchsorted(bounds, at, "right") - 1
    ends, opened, closed = (np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (end, opens, closes))
    starts = bounds[own]
    n = np.diff(np.append(at, len(end)))
    depth = np.add.reduceat(opened[1:] - closed[:-1], at) if len(at) else np.zeros(0, np.int64)
    return own, ends[at] - ends[starts], n, depth - n * (opened[starts] - closed[starts])


def kept_steps(classes: np.ndarray, bounds: np.ndarray, blank: int = 0) -> np.ndarray:
    """Places of the steps that count, as ``collapsed``, of sequences that lie end
    to end between ``bounds``."""
    keep = classes != blank
    same = np.zeros(len(classes) + 1, bool)
    same[1:-1] = classes[1:] == classes[:-1]
    same[bounds] = False
    return np.flatnonzero(keep & ~same[:-1])
