"""Routing of layout regions to branches, and their re-assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import boxes
from ..functions.boxes import Box


def region_type(label: Column) -> Column:
    """formula, table, image or text, by the label alone."""
    return (
        F.when(label.isin(*schema.FORMULA_LABELS), "formula").when(label.isin(*schema.TABLE_LABELS), "table").when(label.isin(*schema.IMAGE_LABELS), "image").otherwise("text")
    )


def _inside(page: str) -> Column:
    return (F.col(f"f.{page}") == F.col(f"t.{page}")) & boxes.contains(Box.of("t"), Box.of("f"))


def formulas_outside_tables(regions: DataFrame, page: str = "page_id", label: str = "label") -> DataFrame:
    """Formula regions that no table of their page contains."""
    f, t = regions.where(F.col(label).isin(*schema.FORMULA_LABELS)), regions.where(F.col(label).isin(*schema.TABLE_LABELS))
    return f.alias("f").join(t.select(page, "x1", "y1", "x2", "y2").alias("t"), _inside(page), "left_anti")


def formulas_inside_tables(regions: DataFrame, page: str = "page_id", label: str = "label") -> DataFrame:
    """Formula regions that a table of their page contains."""
    f, t = regions.where(F.col(label).isin(*schema.FORMULA_LABELS)), regions.where(F.col(label).isin(*schema.TABLE_LABELS))
    return f.alias("f").join(t.select(page, "x1", "y1", "x2", "y2").alias("t"), _inside(page), "left_semi")


def route(regions: DataFrame, page: str = "page_id", key: str = "det_id", has_formula: bool = True, has_table: bool = True, label: str = "label") -> DataFrame:
    """Adds ``route``: the branch that reads a region.

    A formula goes to text without a formula model or inside a table; a table
    goes to text without a table model.
    """
    kind = region_type(F.col(label))
    inside = formulas_inside_tables(regions, page, label).select(page, key).withColumn("_in", F.lit(True))
    to_formula = (kind == "formula") & F.lit(has_formula) & F.col("_in").isNull()
    to_table = (kind == "table") & F.lit(has_table)
    marked = regions.join(inside, [page, key], "left")
    return marked.withColumn("route", F.when(kind == "image", "image").when(to_formula, "formula").when(to_table, "table").otherwise("text")).drop("_in")


def whole_page_regions(pages: DataFrame) -> DataFrame:
    """One text region a page, for when there is no layout model: index -1."""
    zero, label = F.lit(0.0).cast("float"), F.lit("text")
    return pages.select("page_id", F.lit(-1).alias("layout_index"), label.alias("label"), zero.alias("x1"), zero.alias("y1"), F.col("width").cast("float").alias("x2"), F.col("height").cast("float").alias("y2"), label.alias("route"))


def inline_formula_masks(regions: DataFrame, page: str = "page_id", key: str = "det_id", label: str = "label") -> DataFrame:
    """Rectangles, in a text region's own coordinates, where inline formulas of
    the page lie over it. An equi-join on the page with a strict overlap test."""
    text = regions.where(~F.col(label).isin(*schema.FORMULA_LABELS) & (region_type(F.col(label)) == "text")).alias("t")
    inline = regions.where(F.col(label).isin(*schema.INLINE_LABELS)).alias("f")
    on = (F.col(f"t.{page}") == F.col(f"f.{page}")) & boxes.overlaps(Box.of("t"), Box.of("f"))
    local = boxes.to_local(Box.of("f"), Box.of("t"))
    out = text.join(inline, on).select(F.col(f"t.{page}").alias(page), F.col(f"t.{key}").alias("region_id"), F.col(f"f.{key}").alias("formula_id"), *(c.cast("long").alias(n) for c, n in zip(local, ("mx1", "my1", "mx2", "my2"), strict=True)))
    return out.where("mx2 > mx1 and my2 > my1")


def lines_of(regions: DataFrame, polys: str = "polys", keys: tuple[str, ...] = ("page_id", "layout_index")) -> DataFrame:
    """One row a detected line: keys, line_index, poly, det_score. A region
    without detections has no row here and comes back in ``assemble``."""
    zipped = F.arrays_zip(F.col(f"{polys}.polys").alias("poly"), F.col(f"{polys}.scores").alias("det_score"))
    return regions.select(*keys, F.posexplode(zipped).alias("line_index", "_l")).select(*keys, "line_index", "_l.poly", "_l.det_score")


def join_lines(lines: DataFrame, keys: list[str], order: str, text: str = "text") -> DataFrame:
    """Texts of a region's lines in order, without a separator."""
    rows = F.array_sort(F.collect_list(F.struct(order, text)))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r[text]), "").alias("region_text"), F.count("*").alias("n_lines"))


def fan_in(branches: list[DataFrame], page: str, slot: str, value: str = "content") -> DataFrame:
    """Results of all branches back in the slots of their page: one row a page
    with its contents in slot order. Branches share (page, slot, route, value)."""
    rows = branches[0]
    for b in branches[1:]:
        rows = rows.unionByName(b)
    return rows.groupBy(page).agg(F.array_sort(F.collect_list(F.struct(slot, "route", value))).alias("slots"))


def assemble(pages: DataFrame, regions: DataFrame, lines: DataFrame) -> DataFrame:
    """Pages with their regions, and these with their lines, as nested arrays in
    order; pages and regions without children stay, with empty arrays."""
    line = F.struct("line_index", "poly", "det_score", "text", "scores")
    per_region = lines.groupBy("page_id", "layout_index").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    full = regions.join(per_region, ["page_id", "layout_index"], "left").withColumn("lines", F.coalesce("lines", F.array().cast(per_region.schema["lines"].dataType)))
    region = F.struct("layout_index", *[c for c in full.columns if c not in ("page_id", "layout_index")])
    per_page = full.groupBy("page_id").agg(F.array_sort(F.collect_list(region)).alias("regions"))
    return pages.join(per_page, "page_id", "left").withColumn("regions", F.coalesce("regions", F.array().cast(per_page.schema["regions"].dataType)))


def region_text(kind: Column, text: Column, formula: Column, table: Column) -> Column:
    """What a region says, by its type; an image says nothing."""
    return F.when(kind == "text", text).when(kind == "formula", formula).when(kind == "table", table)


def rotates_page(label: Column, score: Column, threshold: float = 0.3) -> Column:
    """Whether a page is turned: a label, a score above the threshold, an angle."""
    return F.coalesce((score > threshold) & (label.cast("double") > 1e-7), F.lit(False))


def flips_line(label: Column) -> Column:
    """Whether a line is turned: by its label alone, whatever the score."""
    return F.coalesce(label == "180_degree", F.lit(False))
