"""Geometry of boxes as Column expressions; all stay inside code generation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    """Four columns: left, top, right, bottom."""

    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @classmethod
    def of(cls, alias: str | None = None, names=("x1", "y1", "x2", "y2")) -> Box:
        lead = f"{alias}." if alias else ""
        return cls(*(F.col(lead + n) for n in names))

    def __iter__(self):
        return iter((self.x1, self.y1, self.x2, self.y2))


def round_half_up(x: Column) -> Column:
    """Halves go towards plus infinity, unlike ``round`` below zero."""
    return F.floor(x + 0.5)


def from_center(cx: Column, cy: Column, w: Column, h: Column) -> Box:
    """Centre and size to corners."""
    return Box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def scale(box: Box, sx: Column, sy: Column) -> Box:
    return Box(box.x1 * sx, box.y1 * sy, box.x2 * sx, box.y2 * sy)


def clip(box: Box, width: Column, height: Column) -> Box:
    """Corners moved inside [0, width] x [0, height]."""
    zero = F.lit(0)
    return Box(F.greatest(box.x1, zero), F.greatest(box.y1, zero), F.least(box.x2, width), F.least(box.y2, height))


def degenerate(box: Box) -> Column:
    return (box.x2 <= box.x1) | (box.y2 <= box.y1)


def area(box: Box) -> Column:
    return (box.x2 - box.x1) * (box.y2 - box.y1)


def overlap(a: Box, b: Box) -> Box:
    """The common part; degenerate where there is none."""
    return Box(F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1), F.least(a.x2, b.x2), F.least(a.y2, b.y2))


def overlaps(a: Box, b: Box) -> Column:
    """Strict: boxes that only touch don't overlap."""
    return (a.x1 < b.x2) & (b.x1 < a.x2) & (a.y1 < b.y2) & (b.y1 < a.y2)


def contains(outer: Box, inner: Box) -> Column:
    """Inclusive on all four sides."""
    return (inner.x1 >= outer.x1) & (inner.y1 >= outer.y1) & (inner.x2 <= outer.x2) & (inner.y2 <= outer.y2)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the union is not positive."""
    both = overlap(a, b)
    common = F.greatest(both.x2 - both.x1, F.lit(0)) * F.greatest(both.y2 - both.y1, F.lit(0))
    union = area(a) + area(b) - common
    return F.when(union > 0, common / union).otherwise(F.lit(0.0))


def crop(box: Box, width: Column, height: Column) -> Box:
    """Rounded and clamped rectangle to cut out; the whole page where it is empty."""
    cut = Box(
        F.least(F.greatest(round_half_up(box.x1), F.lit(0)), width),
        F.least(F.greatest(round_half_up(box.y1), F.lit(0)), height),
        F.least(F.greatest(round_half_up(box.x2), F.lit(0)), width),
        F.least(F.greatest(round_half_up(box.y2), F.lit(0)), height),
    )
    empty = degenerate(cut)
    whole = (F.lit(0), F.lit(0), width, height)
    return Box(*(F.when(empty, w).otherwise(c) for w, c in zip(whole, cut, strict=True)))


def to_local(box: Box, region: Box) -> Box:
    """Page coordinates of ``box`` within ``region``, rounded, clamped to it."""
    cut = overlap(box, region)
    w, h = round_half_up(region.x2 - region.x1), round_half_up(region.y2 - region.y1)
    inside = lambda v, most: F.least(F.greatest(round_half_up(v), F.lit(0)), most)
    return Box(inside(cut.x1 - region.x1, w), inside(cut.y1 - region.y1, h), inside(cut.x2 - region.x1, w), inside(cut.y2 - region.y1, h))


def poly_bounds(poly: Column) -> Box:
    """Bounding box of an array of [x, y] points."""
    xs, ys = F.transform(poly, lambda p: p[0]), F.transform(poly, lambda p: p[1])
    return Box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def rescale_point(v: Column, source: Column, target: Column) -> Column:
    """A detector's coordinate on the page: rounded and clamped to [0, target]."""
    return F.least(F.greatest(round_half_up(v * target / source), F.lit(0)), target)


def order_corners(poly: Column) -> Column:
    """Four points as top left, top right, bottom right, bottom left: the two
    leftmost and the two rightmost, each by height."""
    by_x = F.array_sort(F.transform(poly, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    left, right = F.slice(by_x, 1, 2), F.slice(by_x, 3, 2)
    y = lambda a, i: F.get(a, F.lit(i))["y"]
    point = lambda a, i: F.array(F.get(a, F.lit(i))["x"], F.get(a, F.lit(i))["y"])
    upper = lambda a: F.when(y(a, 1) > y(a, 0), point(a, 0)).otherwise(point(a, 1))
    lower = lambda a: F.when(y(a, 1) > y(a, 0), point(a, 1)).otherwise(point(a, 0))
    return F.array(upper(left), upper(right), lower(right), lower(left))


def _to_multiple(x: Column, step: int) -> Column:
    """Nearest multiple, halves upwards, one step at least."""
    return F.greatest(round_half_up(x / step) * step, F.lit(step)).cast("int")


def detector_size(width: Column, height: Column, limit: int, kind: str = "max", most: int = 4000, step: int = 32) -> tuple[Column, Column]:
    """Input size of a text detector: sides scaled by policy ``max`` (long side
    down to limit), ``min`` (short side up to it) or ``resize_long`` (long side
    to it), capped at ``most``, and rounded to a multiple of ``step``."""
    long, short = F.greatest(width, height), F.least(width, height)
    match kind.lower():
        case "max":
            ratio = F.when(long > limit, limit / long).otherwise(1.0)
        case "min":
            ratio = F.when(short < limit, limit / short).otherwise(1.0)
        case "resize_long":
            ratio = limit / long
        case _:
            raise ValueError(f"no such policy: {kind}")
    w, h = round_half_up(width * ratio), round_half_up(height * ratio)
    over = F.greatest(w, h)
    cap = F.when(over > most, most / over).otherwise(1.0)
    return _to_multiple(round_half_up(w * cap), step), _to_multiple(round_half_up(h * cap), step)


def long_side_size(width: Column, height: Column, long: int, step: int = 128) -> tuple[Column, Column]:
    """Long side to ``long``, sides cut to whole pixels and then up to a multiple of ``step``."""
    ratio = long / F.greatest(width, height)
    up = lambda v: (F.ceil(F.floor(v * ratio) / step) * step).cast("int")
    return up(width), up(height)


def fit_within(width: Column, height: Column, most_width: int = 960, most_height: int = 1408, step: int = 64) -> tuple[Column, Column]:
    """Shrunk in proportion into a frame, then down to multiples of ``step``, one at least."""
    ratio = width / height
    tall = ratio * most_height <= most_width
    over = (width > most_width) | (height > most_height)
    w = F.when(over, F.when(tall, F.floor(most_height * ratio)).otherwise(most_width)).otherwise(width)
    h = F.when(over, F.when(tall, most_height).otherwise(F.floor(most_width / ratio))).otherwise(height)
    down = lambda v: F.greatest(F.floor(v / step) * step, F.lit(step)).cast("int")
    return down(w), down(h)


def recognizer_width(width: Column, height: Column, line_height: int = 48, base: int = 320, most: int = 3200) -> Column:
    """Width of a line image scaled to ``line_height``: at least the base ratio, at most ``most``."""
    ratio = F.greatest(F.lit(base / line_height), width / height)
    return F.least(F.floor(line_height * ratio), F.lit(most)).cast("int")


def pixel_budget(width: Column, height: Column, least: int, most: int, step: int = 28, frames: int = 2) -> tuple[Column, Column]:
    """Sides as multiples of ``step`` whose area times ``frames`` lies within [least, most].

    A side below ``step`` is first scaled up to it, with the other.
    """
    small = (width < step) | (height < step)
    grow = F.greatest(step / height, step / width)
    w0, h0 = F.when(small, F.floor(width * grow)).otherwise(width), F.when(small, F.floor(height * grow)).otherwise(height)
    w, h = round_half_up(w0 / step) * step, round_half_up(h0 / step) * step
    down, up = F.sqrt(frames * w0 * h0 / most), F.sqrt(F.lit(least) / (frames * w0 * h0))
    side = lambda v, r: F.when(frames * w * h > most, F.greatest(F.floor(v / down / step) * step, F.lit(step))).when(frames * w * h < least, F.ceil(v * up / step) * step).otherwise(r).cast("int")
    return side(w0, w), side(h0, h)


def fixed_size(width: Column, height: Column, shape: tuple[int, ...]) -> tuple[Column, Column, Column, Column]:
    """A given input shape, (height, width) or (channels, height, width), as
    (width, height) and the ratios of a box's sides to them."""
    if len(shape) not in (2, 3) or min(shape) < 1:
        raise ValueError(f"an input shape is (height, width) or (channels, height, width), not {tuple(shape)}")
    h, w = shape[-2:]
    return F.lit(w), F.lit(h), w / width, h / height


def nearest_grid(width: Column, height: Column, options: list[tuple[int, int]]) -> tuple[Column, Column]:
    """(rows, columns) of the grid whose proportion is nearest, the first of equals."""
    gaps = [F.struct(F.abs(F.lit(c / r) - width / height).alias("gap"), F.lit(i).alias("i"), F.lit(r).alias("r"), F.lit(c).alias("c")) for i, (r, c) in enumerate(options)]
    best = F.array_min(F.array(*gaps))
    return best["r"], best["c"]


def capped_size(width: Column, height: Column, longest: int = 1540, step: int = 28) -> tuple[Column, Column]:
    """Long side down to ``longest``, in whole pixels, then both up to multiples of ``step``."""
    ratio = F.greatest(F.greatest(width, height) / longest, F.lit(1.0))
    up = lambda v: ((F.floor((F.floor(v / ratio) - 1) / step) + 1) * step).cast("int")
    return up(width), up(height)
