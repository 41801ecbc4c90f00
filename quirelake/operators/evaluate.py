"""Scoring of results against references."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .grouped import over_many_groups, padded


def edit_distances(pairs: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """Adds ``distance`` (code points) and ``longest``."""
    r, h = F.coalesce(reference, F.lit("")), F.coalesce(hypothesis, F.lit(""))
    return pairs.withColumn("distance", F.levenshtein(r, h).cast("long")).withColumn("longest", F.greatest(F.length(r), F.length(h)).cast("long"))


def normalized_accuracy(pairs: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """One row: pairs, exact, distance, longest and accuracy (1 - distance / longest)."""
    blank = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s", "")
    stripped = pairs.withColumn("_r", blank(F.col(reference))).withColumn("_h", blank(F.col(hypothesis)))
    return edit_distances(stripped, "_r", "_h").agg(
        F.count("*").alias("n_pairs"),
        F.count_if(F.col("_r") == F.col("_h")).alias("n_exact"),
        F.sum("distance").alias("distance"),
        F.sum("longest").alias("longest"),
        (1 - F.sum("distance") / F.sum("longest")).alias("accuracy"),
    )


def worst(scored: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The ``n`` pairs of the lowest accuracy, six places; ties by key."""
    accuracy = F.when(F.col("longest") > 0, 1 - F.col("distance") / F.col("longest")).otherwise(1.0)
    return scored.select(key, "distance", "longest", F.round(accuracy, 6).alias("accuracy")).orderBy("accuracy", key).limit(n)


def token_distance(a: np.ndarray, b: np.ndarray) -> int:
    """Edit distance of two id sequences, one vector operation a token of ``a``."""
    row = np.arange(len(b) + 1)
    steps = np.arange(len(b) + 1)
    for i, t in enumerate(a, 1):
        best = np.minimum(row[:-1] + (b != t), row[1:] + 1)
        now = np.concatenate([[i], best])
        row = np.minimum.accumulate(now - steps) + steps
    return int(row[-1])


@F.pandas_udf(T.LongType())
def token_distances(a: pd.Series, b: pd.Series) -> pd.Series:
    """``token_distance`` over two array columns; null is empty."""
    none = np.zeros(0, np.int64)
    return pd.Series([token_distance(none if x is None else np.asarray(x), none if y is None else np.asarray(y)) for x, y in zip(a, b, strict=True)], dtype="int64")


def token_error_rate(pairs: DataFrame, reference: Column, hypothesis: Column) -> DataFrame:
    """One row: summed distance, summed reference length and their ratio."""
    d = pairs.select(token_distances(reference, hypothesis).alias("d"), F.size(reference).alias("n"))
    return d.agg(F.sum("d").alias("distance"), F.sum("n").alias("n_tokens"), (F.sum("d") / F.sum("n")).alias("error_rate"))


def _ratio(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """IoU of boxes whose sides are arrays."""
    w = np.minimum(a[2], b[2]) - np.maximum(a[0], b[0])
    h = np.minimum(a[3], b[3]) - np.maximum(a[1], b[1])
    common = np.maximum(w, 0) * np.maximum(h, 0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - common
    return np.divide(common, union, out=np.zeros(common.shape), where=union > 0)


_BOX = ["x1", "y1", "x2", "y2"]


def _matched(left: DataFrame, right: DataFrame, score: Callable, accept: Callable) -> DataFrame:
    """page_id, left_id, right_id, score: each left box of a page in turn takes the
    free right box of the best score, if that is accepted.

    ``score`` has a left box of each page with its class, as columns, and the
    pages' right boxes with theirs, a page a row; boxes are lists of their sides.
    """
    sides = [df.select("page_id", "det_id", "cls", *(F.col(c).cast("double").alias(c) for c in _BOX), F.lit(n).alias("side")) for n, df in enumerate((left, right))]

    def match(c: dict[str, np.ndarray], bounds: np.ndarray) -> tuple:
        lefts = np.add.reduceat(c["side"] == 0, bounds[:-1], dtype=np.int64)
        rights = np.where(lefts > 0, np.diff(bounds) - lefts, 0)
        boxes, cls = [c[x] for x in _BOX], c["cls"]
        rows, partners, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for pages, n in padded(rights):
            free = np.arange(n) < rights[pages, None]
            at = np.where(free, (bounds[pages] + lefts[pages])[:, None] + np.arange(n), bounds[pages, None])
            others, kinds, each = [v[at] for v in boxes], cls[at], np.arange(len(pages))
            for i in range(lefts[pages].max()):
                has = i < lefts[pages]
                one = np.where(has, bounds[pages] + i, bounds[pages])
                s = np.where(free, score([v[one, None] for v in boxes], cls[one, None], others, kinds), -np.inf)
                j = s.argmax(axis=1)
                best = s[each, j]
                got = has & accept(best)
                free[each[got], j[got]] = False
                rows.append(one[got])
                partners.append(at[each[got], j[got]])
                scores.append(np.abs(best[got]))
        return np.concatenate(rows), (c["det_id"][np.concatenate(partners)], np.concatenate(scores))

    added = [T.StructField("right_id", T.LongType()), T.StructField("score", T.DoubleType())]
    both = over_many_groups(sides[0].unionByName(sides[1]), "page_id", ["side", "det_id"], ["side", "det_id", "cls", *_BOX], match, ["page_id", "det_id"], added)
    return both.withColumnRenamed("det_id", "left_id")


def match_by_overlap(left: DataFrame, right: DataFrame, least: float = 0.5) -> DataFrame:
    """One-to-one matches of a page's boxes: each left box in turn takes the best
    free right box, if their IoU is above ``least``."""
    return _matched(left, right, lambda box, cls, boxes, classes: _ratio(box, boxes), lambda s: s > least)


def match_by_label(left: DataFrame, right: DataFrame, tolerance: float = 5) -> DataFrame:
    """One-to-one matches of a page's boxes of one class: the free box of the
    least summed difference of sides, if that is below four tolerances."""
    gap = lambda box, cls, boxes, classes: np.where(classes == cls, -sum(np.abs(b - a) for a, b in zip(box, boxes, strict=True)), -np.inf)
    return _matched(left, right, gap, lambda s: s > -4 * tolerance)


def compare_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys of one side alone, and of both."""
    a, b = left.select(key).distinct().withColumn("_a", F.lit(1)), right.select(key).distinct().withColumn("_b", F.lit(1))
    side = F.when(F.col("_b").isNull(), "left").when(F.col("_a").isNull(), "right").otherwise("both")
    return a.join(b, key, "full_outer").select(key, side.alias("side"))


def spread(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Count, mean, median, 95th and 99th percentile and maximum of a column in each group.

    Exact, with percentiles between two values where they fall there. Equal
    values are counted first, on the map side too; a group's distinct values are
    then summed up in order by a window, which spills, and read by plain
    aggregates. No task holds a group's values in memory. Nulls don't count, and a group of
    nulls alone has no row.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    group = Window.partitionBy(*by)
    upto = counted.withColumn("_upto", F.sum("_c").over(group.orderBy("_v"))).withColumn("_n", F.sum("_c").over(group))
    at = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    place = lambda q: (F.col("_n") - 1) * F.lit(q)
    low = [F.min(F.when(F.col("_upto") > F.floor(place(q)), F.col("_v"))).alias(f"_low_{name}") for name, q in at.items()]
    high = [F.min(F.when(F.col("_upto") > F.ceil(place(q)), F.col("_v"))).alias(f"_high_{name}") for name, q in at.items()]
    out = upto.groupBy(*by).agg(F.max("_n").alias("n"), (F.sum(F.col("_v") * F.col("_c")) / F.max("_n")).alias("mean"), *low, *high, F.max("_v").alias("most"))
    part = lambda q: (F.col("n") - 1) * F.lit(q) - F.floor((F.col("n") - 1) * F.lit(q))
    return out.select(*by, "n", "mean", *[(F.col(f"_low_{name}") + (F.col(f"_high_{name}") - F.col(f"_low_{name}")) * part(q)).alias(name) for name, q in at.items()], "most")


def verdict(label_rate: float, score_rate: float, box_rate: float, score_p99: float, box_p99: float, count_rate: float) -> bool:
    """Whether two implementations' layouts agree."""
    return label_rate > 0.99 and score_rate > 0.95 and box_rate > 0.95 and score_p99 < 0.01 and box_p99 < 1 and count_rate > 0.95


def agreement(pairs: DataFrame, score_tolerance: float = 0.01, box_tolerance: float = 5) -> DataFrame:
    """One row of how far matched detections agree: pairs hold ``same`` (0 or 1),
    ``score_gap`` and ``box_gap``. ``verdict`` takes its rates."""
    rate = lambda test: F.round(F.avg(test.cast("int")), 9)
    return pairs.agg(
        F.count("*").alias("n"),
        F.round(F.avg("same"), 9).alias("label_rate"),
        rate(F.col("score_gap") < score_tolerance).alias("score_rate"),
        rate(F.col("box_gap") < box_tolerance).alias("box_rate"),
        F.round(F.percentile("score_gap", F.lit(0.99)), 9).alias("score_p99"),
        F.round(F.percentile("box_gap", F.lit(0.99)), 9).alias("box_p99"),
    )
