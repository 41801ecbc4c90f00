"""The page pipeline with fake models that note their calls."""

import os
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from quirelake.operators.models import Options
from quirelake.plans.pipeline import Models, Stage, ocr
from quirelake.sources import images
from quirelake.sources.imagefile import png_bytes
from quirelake.sources.tables import result_json, write_results


def fake(result, fails_above=None):
    """A factory of models that give ``result`` for each item, note the size of
    each call, and fail on large batches if asked to."""

    def make(name, options):
        def model(items, call):
            with open(os.path.join(options.get("log"), name), "a") as f:
                f.write(f"{len(items)}\n")
            if fails_above and len(items) > fails_above:
                raise RuntimeError("too many")
            return [result(x) if callable(result) else result for x in items]

        return model

    return make


MIXED = [(22, "text", 0.9, (0, 0, 100, 30)), (5, "display_formula", 0.9, (0, 30, 100, 60)), (21, "table", 0.9, (0, 60, 100, 79)), (14, "image", 0.8, (100, 0, 119, 79))]
LINE = ([[(5, 5), (55, 5), (55, 25), (5, 25)]], [0.95])
LINES = ([[(5, y), (55, y), (55, y + 10), (5, y + 10)] for y in (50, 5, 35, 20)], [0.5, 0.05, 0.35, 0.2])


@pytest.fixture
def stage(tmp_path):
    def make(name, result, batch=1, fails_above=None):
        return Stage(fake(result, fails_above), name, batch, Options.of(log=str(tmp_path)))

    make.sizes = lambda name: [int(x) for x in (tmp_path / name).read_text().split()] if (tmp_path / name).exists() else []
    return make


def models(stage, **more):
    own = {"detection": stage("detection", LINE), "recognition": stage("recognition", ("ok", [1.0]))}
    return Models(**(own | more))


def pages(spark, n):
    return images.blank_pages(spark, n).coalesce(1)


def test_mixed_page_takes_every_branch(spark, stage):
    out = ocr(
        pages(spark, 2),
        models(
            stage,
            layout=stage("layout", MIXED, 2),
            doc_orientation=stage("doc", (0.99, "0"), 2),
            line_orientation=stage("line", (0.99, "0_degree")),
            formula=stage("formula", ("x^2", [1, 2], -1.0), 8),
            table=stage("table", ("<table></table>", [3])),
        ),
    )
    got = out.nested().orderBy("page_id").collect()
    assert [r.page_id for r in got] == [0, 1]
    for page in got:
        assert [(r.layout_index, r.region_type) for r in page.regions] == [(0, "text"), (1, "formula"), (2, "table"), (3, "image")]
        assert [line.text for line in page.regions[0].lines] == ["ok"] and page.regions[0].lines[0].scores == [1.0]
        assert page.regions[1].formula.text == "x^2" and page.regions[1].formula.tokens == [1, 2]
        assert page.regions[2].table.text == "<table></table>" and not page.regions[3].lines
        assert page.doc_ori_label == "0"
    assert stage.sizes("layout") == [2] and stage.sizes("formula") == [2] and stage.sizes("detection") == [1, 1]
    assert {k: v.get["rows"] for k, v in out.seen.items()} == {"orientation": 2, "layout": 2, "regions": 8, "detection": 2, "recognition": 2, "formula": 2, "table": 2}
    assert set(out.seconds) == {"layout", "doc_orientation", "line_orientation", "formula", "table", "detection", "recognition"} and all(c.value > 0 for c in out.seconds.values())
    assert list(out.seen) == ["orientation", "layout", "regions", "detection", "recognition", "formula", "table"]


def test_without_a_layout_model_a_page_is_one_region(spark, stage):
    (page,) = ocr(pages(spark, 1), models(stage)).nested().collect()
    assert [(r.layout_index, r.region_type) for r in page.regions] == [(-1, "text")] and page.regions[0].lines[0].text == "ok"


def test_formulas_and_tables_without_models_are_text(spark, stage):
    out = ocr(pages(spark, 1), models(stage, layout=stage("layout", MIXED)))
    assert [r.region_type for r in out.regions.orderBy("layout_index").collect()] == ["text", "text", "text", "image"]
    assert out.lines.count() == 3


def test_formula_inside_a_table_is_text(spark, stage):
    boxes = [(21, "table", 0.9, (0, 0, 100, 70)), (5, "display_formula", 0.9, (10, 10, 50, 30)), (5, "display_formula", 0.9, (90, 10, 110, 30))]
    out = ocr(pages(spark, 1), models(stage, layout=stage("layout", boxes), formula=stage("formula", ("f", [], -1.0)), table=stage("table", ("t", []))))
    assert [r.region_type for r in out.regions.orderBy("layout_index").collect()] == ["table", "text", "formula"]


def test_inline_formulas_are_written_over(spark, stage, tmp_path):
    black = np.zeros((80, 120, 3), np.uint8)
    boxes = [(22, "text", 0.9, (0, 0, 100, 70)), (15, "inline_formula", 0.9, (10, 10, 20, 20))]

    def see(image):
        (tmp_path / "white").write_text(str(int((image == 255).all(axis=2).sum())))
        return LINE

    ocr(images.from_arrays(spark, [black]).coalesce(1), models(stage, detection=stage("detection", see), layout=stage("layout", boxes), formula=stage("formula", ("f", [], -1.0))))
    assert (tmp_path / "white").read_text() == "100"


@pytest.mark.parametrize("name", ["layout", "detection", "recognition", "formula", "table"])
def test_a_batch_that_fails_is_halved(spark, stage, name):
    results = {"layout": MIXED, "detection": LINE, "recognition": ("ok", [1.0]), "formula": ("f", [1], -1.0), "table": ("t", [2])}
    all_ = {k: stage(k, v, 2, 1 if k == name else None) for k, v in results.items()}
    out = ocr(pages(spark, 2), Models(**all_))
    assert stage.sizes(name) == [2, 1, 1]
    assert out.lines.count() == 2 and out.regions.count() == 8


def test_lines_of_all_pages_share_batches(spark, stage):
    out = ocr(pages(spark, 2), models(stage, detection=stage("detection", LINES, 2), recognition=stage("recognition", ("ok", [1.0]), 3)))
    assert stage.sizes("recognition") == [3, 3, 2]
    first = out.lines.where("page_id = 0").orderBy("line_index").collect()
    assert [r.poly[0][1] for r in first] == [5, 20, 35, 50] and [round(r.det_score, 2) for r in first] == [0.05, 0.2, 0.35, 0.5]


def test_default_batches_are_single(spark, stage):
    ocr(pages(spark, 2), models(stage, layout=stage("layout", MIXED)))
    assert set(stage.sizes("layout")) == set(stage.sizes("detection")) == set(stage.sizes("recognition")) == {1}


def test_orientation_gates(spark, stage, tmp_path):
    image = np.zeros((10, 20, 3), np.uint8)
    image[0, 0] = 200
    for score, size in ((0.9, (10, 20)), (0.3, (20, 10))):
        out = ocr(images.from_arrays(spark, [image]), models(stage, doc_orientation=stage(f"doc{score}", (score, "90"))))
        (page,) = out.pages.collect()
        assert (page.width, page.height) == size

    def see(x):
        with open(tmp_path / "seen", "a") as f:
            f.write(f"{x[0, 0, 0]} ")
        return ("ok", [1.0])

    for label in ("0_degree", "180_degree"):
        detect = stage("whole", lambda x: ([[(0, 0), (20, 0), (20, 10), (0, 10)]], [1.0]))
        ocr(images.from_arrays(spark, [image]), Models(detection=detect, recognition=stage(f"see{label}", see), line_orientation=stage(f"line{label}", (0.01, label))))
    assert Path(tmp_path / "seen").read_text().split() == ["200", "0"]


def test_nothing_found_and_no_pages(spark, stage):
    out = ocr(pages(spark, 1), models(stage, detection=stage("none", ([], []))))
    (page,) = out.nested().collect()
    assert page.regions[0].lines == []
    empty = ocr(images.read_images(spark), models(stage))
    assert empty.nested().count() == 0
    (bare,) = ocr(pages(spark, 1), models(stage, layout=stage("empty", []))).nested().collect()
    assert bare.regions == []


def test_image_files_and_results(spark, stage, tmp_path):
    rng = np.random.default_rng(0)
    one = rng.integers(0, 255, (6, 9, 3), dtype=np.uint8)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(png_bytes(one))
    (tmp_path / "in" / "b.txt").write_bytes(b"no image")
    by_source = images.read_images(spark, str(tmp_path / "in")).collect()
    by_bytes = images.read_files(spark, str(tmp_path / "in")).collect()
    assert len(by_source) == len(by_bytes) == 1
    for row in (by_source[0], by_bytes[0]):
        assert (np.frombuffer(row.data, np.uint8).reshape(6, 9, 3) == one).all()
    nested = ocr(images.read_files(spark, str(tmp_path / "in")), models(stage)).nested()
    write_results(result_json(nested), str(tmp_path / "out"), "json")
    (back,) = spark.read.json(str(tmp_path / "out")).collect()
    assert '"text":"ok"' in back.json


def test_a_stream_reads_what_a_batch_reads(spark, stage, tmp_path):
    from quirelake.streaming.pages import page_stream, read_stream

    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.png").write_bytes(png_bytes(np.full((8, 12, 3), 40 * i, np.uint8)))
    own = models(stage)
    query = read_stream(page_stream(spark, str(tmp_path / "in"), files_per_batch=2), own, str(tmp_path / "out"), str(tmp_path / "check"), once=True)
    assert query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = ocr(images.read_files(spark, str(tmp_path / "in")), own).nested()
    assert Counter(got.select("path").collect()) == Counter(batch.select("path").collect()) and got.select("batch").distinct().count() == 2
