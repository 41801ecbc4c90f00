"""Layout post-processing over detections keyed by page."""

from __future__ import annotations

import numpy as np
import pandas as pd
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import boxes
from ..functions.boxes import Box
from .grouped import CELLS, over_many_groups, padded


def score_filter(det: DataFrame, threshold: float | int, score: str = "score", inclusive: bool = False) -> DataFrame:
    """Detections above the threshold (or at it) with a class."""
    test = F.col(score) >= threshold if inclusive else F.col(score) > threshold
    return det.where(test & (F.col("cls") > -1))


def per_class_filter(det: DataFrame, thresholds: dict[int, float | int], default: float | int, score: str = "score") -> DataFrame:
    """Each class has its own threshold; others the default. The map is a literal."""
    table = F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv])
    return det.where(F.col(score) > F.coalesce(F.element_at(table, F.col("cls")), F.lit(default)))


def drop_oversized(det: DataFrame, width: Column, height: Column, image_class: int, wide: float = 0.82, tall: float = 0.93, page: str = "page_id") -> DataFrame:
    """Image boxes that cover nearly the whole page, where it has other boxes; if
    all boxes of a page would go, all stay. One window over the page."""
    clipped = boxes.clip(Box.of(), width, height)
    limit = F.when(width > height, F.lit(wide)).otherwise(F.lit(tall)) * width * height
    large = (F.col("cls") == image_class) & (boxes.area(clipped) > limit)
    w = Window.partitionBy(page)
    marked = det.withColumn("_large", large).withColumn("_n", F.count("*").over(w)).withColumn("_stay", F.count_if(~F.col("_large")).over(w))
    return marked.where(~F.col("_large") | (F.col("_n") == 1) | (F.col("_stay") == 0)).drop("_large", "_n", "_stay")


def clip_boxes(det: DataFrame, width: Column, height: Column) -> DataFrame:
    """Boxes moved inside the page; those left without area go."""
    box = boxes.clip(Box.of(), width, height)
    out = det.withColumns(dict(zip(("x1", "y1", "x2", "y2"), box, strict=True)))
    return out.where(~boxes.degenerate(Box.of()))


def candidate_pairs(det: DataFrame, page: str = "page_id", det_id: str = "det_id") -> DataFrame:
    """Overlapping pairs of a page's boxes with their IoU: an equi-join on the page."""
    a, b = det.alias("a"), det.alias("b")
    x, y = Box.of("a"), Box.of("b")
    test = (F.col(f"a.{page}") == F.col(f"b.{page}")) & (F.col(f"a.{det_id}") < F.col(f"b.{det_id}")) & boxes.overlaps(x, y)
    return a.join(b, test).select(F.col(f"a.{page}").alias(page), F.col(f"a.{det_id}").alias("a_id"), F.col(f"b.{det_id}").alias("b_id"), boxes.iou(x, y).alias("iou"))


def suppressed(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, cls: np.ndarray, same: float, other: float, bounds: np.ndarray | None = None) -> np.ndarray:
    """Which boxes stay, best first: one goes if it overlaps a kept one before it
    by ``same`` in its class or by ``other`` in another.

    With ``bounds``, the boxes of many pages lie end to end between them; each
    step takes one box of all pages of like size.
    """
    bounds = np.array([0, len(x1)]) if bounds is None else bounds
    sizes, stays = np.diff(bounds), np.zeros(len(x1), bool)
    for pages, n in padded(sizes):
        real = np.arange(n)[:, None] < sizes[pages]
        at = np.where(real, bounds[pages] + np.arange(n)[:, None], bounds[pages])
        a, b, c, d = (np.where(real, v[at], 0.0) for v in (x1, y1, x2, y2))
        kind, size, live = cls[at], (c - a) * (d - b), real
        for i in range(n - 1):
            if live[i].any():
                w = np.minimum(c[i], c[i + 1 :]) - np.maximum(a[i], a[i + 1 :])
                h = np.minimum(d[i], d[i + 1 :]) - np.maximum(b[i], b[i + 1 :])
                common = np.maximum(w, 0) * np.maximum(h, 0)
                union = size[i] + size[i + 1 :] - common
                ratio = np.divide(common, union, out=np.zeros(common.shape), where=union > 0)
                live[i + 1 :] &= (ratio < np.where(kind[i + 1 :] == kind[i], same, other)) | ~live[i]
        stays[at[live]] = True
    return stays


def suppress(frame: pd.DataFrame, same: float, other: float) -> pd.DataFrame:
    """``suppressed`` over one page's rows, which ``det_id`` puts best first."""
    frame = frame.sort_values("det_id")
    box = [frame[c].to_numpy(np.float64) for c in ("x1", "y1", "x2", "y2")]
    return frame[suppressed(*box, frame["cls"].to_numpy(), same, other)]


def non_maximum_suppression(det: DataFrame, same: float = 0.6, other: float = 0.98, page: str = "page_id") -> DataFrame:
    """``suppressed`` over every page. Which boxes stay depends on which stayed
    before, so a page is one group; pages hold hundreds of boxes at most."""

    def stay(c: dict[str, np.ndarray], bounds: np.ndarray) -> tuple:
        box = [c[n].astype(np.float64) for n in ("x1", "y1", "x2", "y2")]
        return np.flatnonzero(suppressed(*box, c["cls"], same, other, bounds)), ()

    return over_many_groups(det, page, ["det_id"], ["x1", "y1", "x2", "y2", "cls"], stay, det.columns)


def top_queries(df: DataFrame, key: str, scores: str, n: int, classes: int) -> DataFrame:
    """Best ``n`` of a flattened (query, class) score array: rank, query, class, score.

    Ranked inside the row's array; ties go to the lower place.
    """
    pairs = F.transform(scores, lambda v, i: F.struct((-v).alias("neg"), i.alias("flat"), v.alias("score")))
    best = df.select(key, F.posexplode(F.slice(F.array_sort(pairs), 1, n)).alias("rank", "_b"))
    flat = F.col("_b.flat")
    return best.select(key, (F.col("rank") + 1).alias("rank"), F.floor(flat / classes).cast("int").alias("query"), F.pmod(flat, F.lit(classes)).alias("cls"), F.col("_b.score").alias("score"))


#: Scores of boxes standing before others, from their columns as arrays that broadcast.
Before = Callable[[dict[str, np.ndarray], dict[str, np.ndarray]], np.ndarray]


def pair_votes(columns: dict[str, np.ndarray], ids: np.ndarray, bounds: np.ndarray, before: Before) -> np.ndarray:
    """Votes of boxes whose pages lie end to end between ``bounds``, by id in each.

    Pairs are taken a strip of a page at a time, so that memory doesn't grow with
    the square of a page. A pair without a score counts for neither.
    """
    sizes, votes = np.diff(bounds), np.zeros(len(ids))
    for pages, n in padded(sizes, lambda m: m * m):
        real = np.arange(n) < sizes[pages, None]
        at = np.where(real, bounds[pages, None] + np.arange(n), bounds[pages, None])
        after = {c: v[at][:, None, :] for c, v in columns.items()}
        strip = max(CELLS // n, 1) if len(pages) == 1 else n
        for a in range(0, n, strip):
            ahead = at[:, a : a + strip, None]
            score = before({c: v[ahead] for c, v in columns.items()}, after)
            counts = real[:, a : a + strip, None] & real[:, None, :] & (ids[ahead] < ids[at][:, None, :]) & (score == score)
            score = np.where(counts, score, 0)
            votes[at[real]] += score.sum(axis=1)[real]
            own = real[:, a : a + strip]
            votes[ahead[..., 0][own]] += (counts.sum(axis=2) - score.sum(axis=2))[own]
    return votes


def reading_order(det: DataFrame, before: Before, columns: list[str], page: str = "page_id", det_id: str = "det_id") -> DataFrame:
    """Rank of each box by pairwise votes: det's page, id, votes and read_rank.

    ``before`` gives the score of box a standing before box b, for a ahead of b
    by id, from their ``columns``. A box gathers the scores of all pairs that put
    others ahead of it; the rank is by votes upwards, ties by id. Pairs of many
    pages are taken at once, and no pair is a row.
    """

    def rank(c: dict[str, np.ndarray], bounds: np.ndarray) -> tuple:
        votes = pair_votes({n: c[n] for n in columns}, c[det_id], bounds, before)
        pages = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        order = np.lexsort((c[det_id], votes, pages))
        return order, (votes[order], (np.arange(len(order)) - bounds[pages]).astype(np.int32))

    adds = [T.StructField("votes", T.DoubleType()), T.StructField("read_rank", T.IntegerType())]
    return over_many_groups(det, page, [det_id], [det_id, *columns], rank, [page, det_id], adds)


def lexical_order(det: DataFrame, first: str, second: str, tie: str, page: str = "page_id") -> DataFrame:
    """Place of each box by ``first`` upwards, then ``second`` downwards."""
    return det.withColumn("place", F.row_number().over(Window.partitionBy(page).orderBy(F.asc(first), F.desc(second), F.asc(tie))))


def name_labels(det: DataFrame, labels: dict[int, str] | tuple[str, ...]) -> DataFrame:
    """Adds ``label``: the class's name, or its id where it has none."""
    pairs = labels.items() if isinstance(labels, dict) else enumerate(labels)
    table = F.create_map(*[F.lit(x) for kv in pairs for x in kv])
    return det.withColumn("label", F.coalesce(F.element_at(table, F.col("cls")), F.col("cls").cast("string")))


MERGE_MODES = ("union", "large", "small")


def check_merge_mode(mode: str | dict[int, str] | None) -> None:
    """Merge modes are accepted and validated; all of them keep every box."""
    for m in mode.values() if isinstance(mode, dict) else [mode] if mode is not None else []:
        if m not in MERGE_MODES:
            raise ValueError(f"merge mode must be one of {MERGE_MODES}, not {m!r}")
