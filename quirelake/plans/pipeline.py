"""Pages to text: orientation, layout, routing, branches, fan-in.

Each stage is one pass over rows that the stage before made, so batches of a
model fill across pages and regions. Pixels never pass a shuffle: a page's
regions lie in one array of its row, where routing is done by array functions,
and crops are cut in the pass that makes their rows. The only shuffles are those
of the fan-in, over text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields, replace
from time import perf_counter

import numpy as np
import pandas as pd
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import schema
from ..functions import boxes, pixels
from ..functions.boxes import Box
from ..operators import route as routing
from ..operators.models import Factory, Options, batches, bisect_retry, cached_model
from ..operators.readorder import band_order
from ..sources.tables import written

_PAGE = "page_id bigint, path string, height int, width int, data binary, doc_ori_label string, doc_ori_score float"
_REGION = "layout_index int, cls_id int, label string, score float, x1 float, y1 float, x2 float, y2 float"
_CROP = f"page_id bigint, {_REGION}, route string, height int, width int, data binary"
_LINE = "page_id bigint, layout_index int, line_index int, poly array<array<int>>, det_score float, height int, width int, data binary"


@dataclass(frozen=True)
class Stage:
    """A model of a stage: its factory, name, batch size and options.

    ``clock`` is an accumulator of the seconds spent in the model by all tasks;
    ``ocr`` gives each stage one.
    """

    factory: Factory
    name: str = "model"
    batch: int = 1
    options: Options = field(default_factory=Options)
    clock: Accumulator | None = None

    def run(self, items: list) -> list:
        """Results of items in order, in batches, halved where one fails."""
        model = cached_model(self.factory, self.name, self.options)
        began, out = perf_counter(), []
        for part in batches(items, self.batch):
            out += bisect_retry(part, lambda x: model(x, self.options))
        if self.clock is not None:
            self.clock.add(perf_counter() - began)
        return out


@dataclass(frozen=True)
class Models:
    """Models of the stages; those that are None are left out.

    detection: image -> (polys, scores); recognition: image -> (text, scores);
    layout: image -> list of (cls_id, label, score, (x1, y1, x2, y2));
    orientations: image -> (score, label); formula: image -> (text, tokens,
    score); table: image -> (text, tokens).
    """

    detection: Stage
    recognition: Stage
    layout: Stage | None = None
    doc_orientation: Stage | None = None
    line_orientation: Stage | None = None
    formula: Stage | None = None
    table: Stage | None = None


@dataclass(frozen=True)
class Tables:
    """Results as rows; what each stage saw (rows, once it has run); and the
    seconds that each model took, retried tasks included."""

    pages: DataFrame
    regions: DataFrame
    lines: DataFrame
    seen: dict[str, Observation]
    seconds: dict[str, Accumulator]

    def nested(self) -> DataFrame:
        """One row a page, with its regions and their lines."""
        return routing.assemble(self.pages, self.regions, self.lines)


def _images(f: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(d, np.uint8).reshape(h, w, 3) for h, w, d in zip(f["height"], f["width"], f["data"], strict=True)]


def _put(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns)


def _columns(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]


#: What a stage works on at once: so many rows, and so many bytes of pixels
#: unless one image alone has more.
_ROWS, _BYTES = 512, 16 << 20


def pieces(f: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """An Arrow batch's rows in order, few enough at a time that a stage's images,
    crops and records don't grow with the batch."""
    a, held = 0, 0
    for i, n in enumerate(map(len, f["data"])):
        if i > a and (i - a == _ROWS or held + n > _BYTES):
            yield f.iloc[a:i].reset_index(drop=True)
            a, held = i, 0
        held += n
    if len(f):
        yield f.iloc[a:].reset_index(drop=True)


def _flow(stage: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield from map(stage, pieces(f))

    return run


def orient(pages: DataFrame, model: Stage | None, threshold: float = 0.3) -> DataFrame:
    """Pages turned upright where the model is sure enough; label and score stay."""
    if model is None:
        return pages.select("page_id", "path", "height", "width", "data", F.lit(None).cast("string").alias("doc_ori_label"), F.lit(None).cast("float").alias("doc_ori_score"))

    def turn(f: pd.DataFrame) -> pd.DataFrame:
        images = _images(f)
        found = model.run(images)
        out = []
        for row, image, (score, label) in zip(f.to_dict("records"), images, found, strict=True):
            if label is not None and score > threshold and float(label) > 1e-7:
                image = pixels.rotate(image, int(float(label)))
                row |= {"height": image.shape[0], "width": image.shape[1], "data": image.tobytes()}
            out.append(row | {"doc_ori_label": label, "doc_ori_score": score})
        return _put(out, _columns(_PAGE))

    return pages.select("page_id", "path", "height", "width", "data").mapInPandas(_flow(turn), _PAGE)


def lay_out(pages: DataFrame, model: Stage | None) -> DataFrame:
    """Pages with ``regions``; without a model the whole page, as region -1."""
    kind = f"array<struct<{_REGION.replace(' ', ':').replace(',:', ',')}>>"
    if model is None:
        whole = F.struct(F.lit(-1).alias("layout_index"), F.lit(-1).alias("cls_id"), F.lit("text").alias("label"), F.lit(0).alias("score"), F.lit(0).alias("x1"), F.lit(0).alias("y1"), F.col("width").alias("x2"), F.col("height").alias("y2"))
        return pages.withColumn("regions", F.array(whole).cast(kind))

    def find(f: pd.DataFrame) -> pd.DataFrame:
        found = model.run(_images(f))
        names = _columns(_REGION)
        rows = [[dict(zip(names, (i, cls, label, score, *box), strict=True)) for i, (cls, label, score, box) in enumerate(regions or [])] for regions in found]
        return f.assign(regions=rows)

    return pages.mapInPandas(_flow(find), f"{_PAGE}, regions {kind}")


def route_in_page(pages: DataFrame, has_formula: bool, has_table: bool) -> DataFrame:
    """``regions`` with ``route`` and, for text, ``masks``: the inline formulas that
    lie over a region, in its own coordinates. All within the row of a page."""
    box = lambda r: Box(r["x1"], r["y1"], r["x2"], r["y2"])
    tables = F.filter("regions", lambda r: r["label"].isin(*schema.TABLE_LABELS))
    inline = F.filter("regions", lambda r: r["label"].isin(*schema.INLINE_LABELS))

    def choose(r: Column) -> Column:
        kind = routing.region_type(r["label"])
        inside = F.exists(tables, lambda t: boxes.contains(box(t), box(r)))
        return F.when(kind == "image", "image").when((kind == "formula") & F.lit(has_formula) & ~inside, "formula").when((kind == "table") & F.lit(has_table), "table").otherwise("text")

    def masks(r: Column) -> Column:
        over = F.filter(inline, lambda f: boxes.overlaps(box(f), box(r)))
        local = F.transform(over, lambda f: F.array(*(c.cast("int") for c in boxes.to_local(box(f), box(r)))))
        whole = F.filter(local, lambda m: (m[2] > m[0]) & (m[3] > m[1]))
        plain = routing.region_type(r["label"]) == "text"
        return F.when(plain & (choose(r) == "text") & F.lit(has_formula), whole).otherwise(F.array().cast("array<array<int>>"))

    names = _columns(_REGION)
    return pages.withColumn("regions", F.transform("regions", lambda r: F.struct(*(r[n].alias(n) for n in names), choose(r).alias("route"), masks(r).alias("masks"))))


def cut_regions(pages: DataFrame) -> DataFrame:
    """One row a region, with its pixels; inline formulas are written over in white."""

    def cut(f: pd.DataFrame) -> pd.DataFrame:
        out = []
        for page, image, regions in zip(f["page_id"], _images(f), f["regions"], strict=True):
            for r in regions:
                r = r if isinstance(r, dict) else r.asDict()
                part = pixels.crop_box(image, (r["x1"], r["y1"], r["x2"], r["y2"]))
                if len(r["masks"]):
                    part = pixels.mask_boxes(part, [tuple(m) for m in r["masks"]])
                out.append({k: r[k] for k in r if k != "masks"} | {"page_id": page, "height": part.shape[0], "width": part.shape[1], "data": np.ascontiguousarray(part).tobytes()})
        return _put(out, _columns(_CROP))

    return pages.select("page_id", "height", "width", "data", "regions").mapInPandas(_flow(cut), _CROP)


def find_lines(crops: DataFrame, model: Stage) -> DataFrame:
    """One row a text line of text regions, in reading order, with its pixels.

    Line and quad belong together; a region without lines has no row here.
    """

    def find(f: pd.DataFrame) -> pd.DataFrame:
        images, out = _images(f), []
        for page, index, image, found in zip(f["page_id"], f["layout_index"], images, model.run(images), strict=True):
            polys, scores = found if found is not None else ([], [])
            for n, i in enumerate(band_order([tuple(p[0]) for p in polys])):
                quad = pixels.crop_quad(image, np.array(polys[i]))
                out.append({"page_id": page, "layout_index": index, "line_index": n, "poly": [list(map(int, xy)) for xy in polys[i]], "det_score": scores[i], "height": quad.shape[0], "width": quad.shape[1], "data": quad.tobytes()})
        return _put(out, _columns(_LINE.replace("array<array<int>>", "x")))

    return crops.select("page_id", "layout_index", "height", "width", "data").mapInPandas(_flow(find), _LINE)


def orient_lines(lines: DataFrame, model: Stage | None) -> DataFrame:
    """Lines turned where the model says so, whatever its score."""
    if model is None:
        return lines.withColumns({"line_ori_label": F.lit(None).cast("string"), "line_ori_score": F.lit(None).cast("float")})

    def turn(f: pd.DataFrame) -> pd.DataFrame:
        images = _images(f)
        found = model.run(images)
        data = [pixels.rotate(x, 180).tobytes() if label == "180_degree" else d for x, d, (_, label) in zip(images, f["data"], found, strict=True)]
        return f.assign(data=data, line_ori_label=[label for _, label in found], line_ori_score=[score for score, _ in found])

    return lines.mapInPandas(_flow(turn), f"{_LINE}, line_ori_label string, line_ori_score float")


def read_lines(lines: DataFrame, model: Stage) -> DataFrame:
    """Text and scores of lines; the lines of a batch are read widest first, so
    that those padded together are of like width. Pixels end here."""

    def read(f: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(-(f["width"] / f["height"]).to_numpy(), kind="stable")
        images = _images(f)
        found: list = [None] * len(f)
        for i, r in zip(order, model.run([images[i] for i in order]), strict=True):
            found[i] = r
        return f.drop(columns=["height", "width", "data"]).assign(text=[t for t, _ in found], scores=[list(map(float, s)) for _, s in found])

    return lines.mapInPandas(_flow(read), schema.LINES)


def read_formulas(crops: DataFrame, model: Stage) -> DataFrame:
    def read(f: pd.DataFrame) -> pd.DataFrame:
        found = model.run(_images(f))
        return f[["page_id", "layout_index"]].assign(formula=[{"text": t, "tokens": list(ids), "score": s} for t, ids, s in found])

    return crops.mapInPandas(_flow(read), f"page_id bigint, layout_index int, formula struct<{_struct(schema.TEXT_RESULT)}>")


def read_tables(crops: DataFrame, model: Stage) -> DataFrame:
    def read(f: pd.DataFrame) -> pd.DataFrame:
        found = model.run(_images(f))
        return f[["page_id", "layout_index"]].assign(table=[{"text": t, "tokens": list(ids)} for t, ids in found])

    return crops.mapInPandas(_flow(read), f"page_id bigint, layout_index int, `table` struct<{_struct(schema.TABLE_RESULT)}>")


def _struct(ddl: str) -> str:
    return ", ".join(part.replace(" ", ":", 1) for part in ddl.split(", "))


def ocr(pages: DataFrame, models: Models) -> Tables:
    """Read pages (page_id, path, height, width, data as RGB bytes).

    A formula inside a table and, without their models, formulas and tables are
    read as text; images are not read. Cut regions are written once, by route,
    so no model runs twice and a lost executor costs its tasks only; no pages
    give empty tables.
    """
    seen: dict[str, Observation] = {}
    given = {f.name: stage for f in fields(models) if (stage := getattr(models, f.name)) is not None}
    seconds = {name: pages.sparkSession.sparkContext.accumulator(0.0) for name in given}
    models = replace(models, **{name: replace(stage, clock=seconds[name]) for name, stage in given.items()})

    def note(df: DataFrame, stage: str) -> DataFrame:
        seen[stage] = Observation(stage)
        return df.observe(seen[stage], F.count(F.lit(1)).alias("rows"))

    laid = route_in_page(lay_out(note(orient(pages, models.doc_orientation), "orientation"), models.layout), models.formula is not None, models.table is not None)
    upright = written(note(laid, "layout"), "pages")
    crops = written(note(cut_regions(upright), "regions"), "regions", by="route")
    branch = lambda r: crops.where(F.col("route") == r)
    found = note(find_lines(branch("text"), models.detection), "detection")
    lines = written(note(read_lines(orient_lines(found, models.line_orientation), models.recognition), "recognition"), "lines")
    regions = crops.select("page_id", *_columns(_REGION), F.col("route").alias("region_type"))
    for name, model, read, kind in (("formula", models.formula, read_formulas, schema.TEXT_RESULT), ("table", models.table, read_tables, schema.TABLE_RESULT)):
        if model is None:
            regions = regions.withColumn(name, F.lit(None).cast(f"struct<{_struct(kind)}>"))
        else:
            done = written(note(read(branch(name), model), name), name)
            regions = regions.join(done, ["page_id", "layout_index"], "left")
    return Tables(upright.select("page_id", "path", "width", "height", "doc_ori_label", "doc_ori_score"), regions, lines, seen, seconds)
