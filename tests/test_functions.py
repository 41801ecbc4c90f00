"""Literal fixtures of single functions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quirelake.functions import boxes, decode, pixels, probmap, tensors, textnorm
from quirelake.functions.boxes import Box
from quirelake.operators import evaluate, layout, models, route
from quirelake.operators.readorder import band_order
from quirelake.sources import dictionaries, imagefile


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def steps_of(path, best, classes=5):
    rows = [[0.01] * classes for _ in path]
    for row, i, p in zip(rows, path, best, strict=True):
        row[i] = p
    return rows


def lit_rows(rows):
    return F.array(*[F.array(*map(F.lit, r)) for r in rows])


def test_ctc_collapse_keeps_changes_that_are_not_blank(spark):
    rows = steps_of([1, 1, 0, 2, 2, 3], [0.90, 0.91, 0.95, 0.80, 0.81, 0.85])
    (got,) = one(spark, decode.ctc_decode(lit_rows(rows), list("ABCD")))
    assert got.text == "ABC" and got.scores[0] == pytest.approx((0.90 + 0.80 + 0.85) / 3)


def test_ctc_index_beyond_the_alphabet_scores_without_a_letter(spark):
    (got,) = one(spark, decode.ctc_decode(lit_rows(steps_of([4, 0, 1], [0.5, 0.9, 0.7])), list("ABC")))
    assert got.text == "A" and got.scores[0] == pytest.approx(0.6)
    (none,) = one(spark, decode.ctc_decode(lit_rows(steps_of([0, 0], [0.9, 0.9])), list("ABC")))
    assert none.text == "" and none.scores == [0.0]


def test_argmax_reads_the_last_row_of_the_right_item(spark):
    flat = F.array(*map(F.lit, [90.0, 1.0, 2.0, 3.0, 89.0, 4.0, 5.0, 6.0, 88.0]))
    assert one(spark, decode.argmax_of_last_row(flat, F.lit(3), F.lit(3)))[0] == 2
    two = np.zeros((2, 3, 4))
    two[0, 2], two[1, 2] = [1, 2, 97, 3], [4, 94, 6, 7]
    col = F.array(*map(F.lit, two.ravel().tolist()))
    assert one(spark, decode.argmax_of_last_row(col, F.lit(3), F.lit(4), F.lit(0)), decode.argmax_of_last_row(col, F.lit(3), F.lit(4), F.lit(1))) == (2, 1)


def test_argmax_and_top_k_take_the_first_of_equals(spark):
    assert one(spark, decode.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))))[0] == 1
    df = spark.createDataFrame([(1, [0.2, 0.9, 0.9, 0.1])], "k int, s array<double>")
    assert [tuple(r) for r in decode.top_k(df, "k", "s", 3, {1: "one"}).collect()] == [(1, 1, 1, 0.9, "one"), (1, 2, 2, 0.9, "2"), (1, 3, 0, 0.2, "0")]


def test_flat_tensors(spark):
    rows = F.array(F.array(*map(F.lit, (10, 11, 12))), F.array(*map(F.lit, (20, 21, 22))))
    assert one(spark, tensors.first_columns(rows, 2))[0] == [10, 11, 20, 21]
    assert one(spark, tensors.reshape(F.array(*map(F.lit, range(5))), 2))[0] == [[0, 1], [2, 3], [4]]
    assert one(spark, tensors.reshape(F.array().cast("array<int>"), 2))[0] == []
    assert one(spark, tensors.linspace(F.lit(0.0), F.lit(1.0), F.lit(5)))[0] == [0, 0.25, 0.5, 0.75, 1]
    assert one(spark, tensors.linspace(F.lit(2.0), F.lit(9.0), F.lit(1)))[0] == [2]
    assert one(spark, tensors.filled(F.lit(3), 1), *tensors.flat_place(F.lit(53), 25)) == ([1, 1, 1], 2, 3)


def test_softmax_sums_to_one(spark):
    (p,) = one(spark, decode.softmax(F.array(F.lit(1000.0), F.lit(1001.0), F.lit(-5.0))))
    assert sum(p) == pytest.approx(1) and p[1] > p[0] > p[2] >= 0


def test_end_truncation_and_special_tokens(spark):
    ids = F.array(*[F.lit(x).cast("bigint") for x in (0, 7, 2, 8)])
    assert one(spark, decode.truncate_at(ids, 2), decode.truncate_at(ids, 5), decode.drop_special(ids, [0, 2], 8)) == ([0, 7, 2], [0, 7, 2, 8], [7])


def test_image_tokens_take_features_in_order(spark):
    tokens = spark.createDataFrame([(1, i, t) for i, t in enumerate([5, 9, 9, 6, 9])], "s int, i int, t int")
    features = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "s int, j int, f string")
    got = tensors.scatter_features(tokens, features, ["s"], "i", "t", 9, "j", "f").orderBy("i").collect()
    assert [r.f for r in got] == [None, "a", "b", None, None]


def test_positions_and_mask():
    assert tensors.axis_positions(np.array([7, 9, 9, 9, 9, 8]), 9, [(1, 4, 4)]).tolist() == [[0, 1, 1, 1, 1, 3], [0, 1, 1, 2, 2, 3], [0, 1, 2, 1, 2, 3]]
    m = tensors.attention_mask(np.array([0, 5, 1, 5, 3, 5, 4]), end=1, opens=3, closes=4)
    assert m[1].tolist() == [False, True, False, False, False, False, False]
    assert m[3].tolist() == [False, False, False, True, False, False, False]
    assert m[4].tolist() == [False, False, False, True, True, True, True] and not m[:, 0].any()


def test_boxes(spark):
    a, b = Box(*map(F.lit, (0, 0, 10, 10))), Box(*map(F.lit, (5, 0, 15, 10)))
    flat = Box(*map(F.lit, (3, 3, 3, 3)))
    assert one(spark, boxes.iou(a, b), boxes.iou(flat, flat), boxes.contains(a, a), boxes.overlaps(a, Box(*map(F.lit, (10, 0, 20, 10))))) == (pytest.approx(1 / 3), 0, True, False)
    assert one(spark, boxes.round_half_up(F.lit(-2.5)), boxes.round_half_up(F.lit(2.5))) == (-2, 3)
    whole = boxes.crop(Box(*map(F.lit, (50.0, 5.0, 40.0, 9.0))), F.lit(100), F.lit(80))
    assert one(spark, *whole) == (0, 0, 100, 80)
    quad = F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((9, 8), (1, 1), (2, 9), (8, 0))])
    assert one(spark, boxes.order_corners(quad))[0] == [[1, 1], [8, 0], [9, 8], [2, 9]]


def test_size_policies(spark):
    got = one(spark, *boxes.detector_size(F.lit(1920), F.lit(1080), 960), *boxes.detector_size(F.lit(10), F.lit(10), 960), *boxes.detector_size(F.lit(100), F.lit(50), 64, "min"), boxes.recognizer_width(F.lit(10), F.lit(100)), boxes.recognizer_width(F.lit(100_000), F.lit(10)))
    assert got == (960, 544, 32, 32, 128, 64, 320, 3200)
    with pytest.raises(ValueError):
        boxes.detector_size(F.lit(1), F.lit(1), 1, "none")
    w, h = one(spark, *boxes.pixel_budget(F.lit(4000), F.lit(3000), 3136, 1_000_000))
    assert w % 28 == h % 28 == 0 and 2 * w * h <= 1_000_000
    small = boxes.pixel_budget(F.lit(14), F.lit(28), 3136, 1_000_000, frames=1)
    assert one(spark, *small) == one(spark, *boxes.pixel_budget(F.lit(28), F.lit(56), 3136, 1_000_000, frames=1))
    assert one(spark, *boxes.long_side_size(F.lit(1000), F.lit(500), 960), *boxes.fit_within(F.lit(2000), F.lit(1000)), *boxes.fit_within(F.lit(70), F.lit(30))) == (1024, 512, 960, 448, 64, 64)
    assert one(spark, *boxes.detector_size(F.lit(5000), F.lit(100), 64, "min")) == (4000, 96)


def test_band_order():
    assert band_order([(50, 5), (10, 8), (0, 40)]) == [1, 0, 2]
    assert band_order([(50, 5), (10, 15), (0, 40)]) == [0, 1, 2]
    assert band_order([]) == []


def test_line_input_is_scaled_and_padded_with_zeros():
    row = np.array([[[0, 127, 255], [10, 20, 30]]], np.uint8)
    out = pixels.line_input(row, height=1, width=4)
    assert out.shape == (3, 1, 4)
    assert np.allclose(out[:, 0, :2], (row[0].T.astype(float) * 2 / 255 - 1), atol=1e-6) and not out[:, :, 2:].any()


def test_probability_map_gives_boxes():
    prob = np.zeros((32, 32), np.float32)
    prob[4:12, 4:12] = prob[20:28, 20:28] = 0.95
    found = probmap.text_boxes(prob, 32, 32, threshold=0.3, least_score=0.1)
    assert len(found.polys) == len(found.scores) == 2
    one_ = np.zeros((32, 32), np.float32)
    one_[4:12, 4:12] = 0.95
    (score,) = probmap.text_boxes(one_, 64, 32).scores
    assert score > 0.9
    assert probmap.text_boxes(np.zeros((8, 8)), 8, 8) == ([], [])
    assert len(probmap.text_boxes(prob, 32, 32, candidates=1).polys) == 1


def test_components_against_flood_fill():
    rng = np.random.default_rng(5)
    for _ in range(20):
        mask = rng.random((17, 23)) < 0.45
        got, seen = probmap.components(mask), np.zeros(mask.shape, int)
        n = 0
        for y, x in np.argwhere(mask):
            if not seen[y, x]:
                n += 1
                stack = [(y, x)]
                while stack:
                    a, b = stack.pop()
                    if 0 <= a < 17 and 0 <= b < 23 and mask[a, b] and not seen[a, b]:
                        seen[a, b] = n
                        stack += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        assert (got == seen).all()


def test_pixels():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 255, (10, 20, 3), dtype=np.uint8)
    assert (pixels.resize(image, (20, 10)) == image).all() and pixels.resize(image, (7, 5), "cubic", True).shape == (5, 7, 3)
    flat = np.full((9, 9, 3), 77, np.uint8)
    assert (pixels.resize(flat, (4, 13), "cubic") == 77).all() and (pixels.resize(flat, (31, 3), "linear", True) == 77).all()
    assert (pixels.resize(np.arange(8, dtype=float).reshape(2, 4), (2, 1), "area") == [[2.5, 4.5]]).all()
    assert pixels.resize_by_short(image, 5).shape == (5, 10, 3)
    assert (pixels.rotate(pixels.rotate(image, 90), 270) == image).all() and (pixels.rotate(image, 180) == image[::-1, ::-1]).all()
    assert pixels.crop(image, (4, 4)).shape == (4, 4, 3)
    with pytest.raises(ValueError):
        pixels.crop(image, (40, 4))
    page = np.full((20, 30, 3), 250, np.uint8)
    page[5:9, 10:17] = 0
    assert pixels.trim_border(page).shape == (4, 7, 3) == pixels.trim_margin(page).shape
    assert pixels.trim_border(flat).shape == flat.shape == pixels.trim_margin(flat).shape
    assert pixels.pad_to(image, (25, 12)).shape == (12, 25, 3) and pixels.expand(image, 2).shape == (14, 24, 3)
    assert (pixels.crop_quad(image, [(0, 0), (20, 0), (20, 10), (0, 10)]) == image).all()
    assert pixels.crop_quad(image, [(0, 0), (4, 0), (4, 10), (0, 10)]).shape == (4, 10, 3)
    assert (pixels.mask_boxes(image, [(1, 1, 3, 3), (5, 5, 5, 5)])[1:3, 1:3] == 255).all()
    assert pixels.pack([image, image]).shape == (2, 3, 10, 20)


def test_png_and_pnm_round_trip():
    rng = np.random.default_rng(2)
    image = rng.integers(0, 255, (5, 7, 3), dtype=np.uint8)
    assert (imagefile.decode_image(imagefile.png_bytes(image)) == image).all()
    assert (imagefile.decode_image(b"P6\n# note\n7 5\n255\n" + image.tobytes()) == image).all()
    with pytest.raises(ValueError):
        imagefile.decode_image(b"GIF89a")
    assert (imagefile.draw_boxes(image, [(0, 0, 6, 4)])[0] == (255, 0, 0)).all()


def test_png_filters_are_undone():
    import struct
    import zlib

    rng = np.random.default_rng(8)
    image = rng.integers(0, 255, (5, 6, 3), dtype=np.uint8)
    flat, lines = image.reshape(5, 18).astype(int), []
    for y, kind in enumerate((0, 1, 2, 3, 4)):
        left = np.concatenate([np.zeros(3, int), flat[y, :-3]])
        up = flat[y - 1] if y else np.zeros(18, int)
        corner = np.concatenate([np.zeros(3, int), up[:-3]])
        p = left + up - corner
        paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        guess = (0, left, up, (left + up) // 2, paeth)[kind]
        lines.append(bytes([kind]) + ((flat[y] - guess) % 256).astype(np.uint8).tobytes())
    part = lambda k, b: struct.pack(">I", len(b)) + k + b + b"\0\0\0\0"
    png = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 6, 5, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"".join(lines))) + part(b"IEND", b"")
    assert (imagefile.decode_image(png) == image).all()


def test_prompts(spark):
    f = lambda t, m, p: textnorm.fill_prompt(F.lit(t), F.lit(m), F.lit(p))
    assert one(spark, f("{media}\n{prompt}", "<IMG>", "  "), f("{{media}} {{prompt}}", "<IMG>", "read")) == ("<IMG>\nRead all text in the image.", "<IMG> read")
    assert one(spark, textnorm.remove_prompt(F.lit("say: x </s><pad>"), "say:"))[0] == "x"
    assert one(spark, textnorm.chat_prompt("User:%s<end>", F.lit("hi")))[0] == "User:hi<end>"
    (tiles,) = one(spark, textnorm.image_prompt(F.lit(1), F.lit(2), 2))
    assert tiles.count("<image>") == 6 and "<row_1_col_2>" in tiles


def test_text_rules(spark):
    got = one(
        spark,
        textnorm.clean_tokens(F.lit("\\[<s>aĠb_____c-<|sn|>dĊ......<|sn|>e\\]")),
        textnorm.clean_tokens(F.lit("\\[a")),
        textnorm.remove_style(F.lit(r" \[\mathbf{a} + \textit {b}\] ")),
        textnorm.add_newlines(F.lit("\\begin{x} a\\\\ b\\\\\nc\n\n\\end{x}")),
        textnorm.remove_dollar(F.lit("$$ x $$")),
        textnorm.remove_dollar(F.lit("$$$")),
        textnorm.remove_text_wrapping(F.lit('\\text{ 中文 } "q" \\text{abc}')),
        textnorm.shorten(F.lit("x" * 201)),
        textnorm.without_blanks(F.lit(" a\tb\n")),
        textnorm.end_markers(F.lit(" a<|end_of_text|>")),
    )
    assert got == ("a b___cd\n... e", "\\[a", "a + b", "\\begin{x}\na\\\\\nb\\\\\nc\n\\end{x}", " x ", "$$$", '中文 q \\text{abc}', "x" * 200 + "...", "ab", "a")
    assert one(spark, textnorm.detokenize(F.array(*map(F.lit, ("<s>", "Ġa", "Ġb", None, "</s>")))))[0] == ["a", "b", ""]


def test_latex_spaces():
    fix = textnorm.normalize_latex_text
    assert fix(r"\operatorname { a b } x + y \frac { 1 } { 2 }") == r"\operatorname{a b}x+y\frac{1}{2}"
    assert fix(r"a b") == "a b" and fix("") == "" and fix(r"1 2 x") == "12x"
    assert fix(r"\ \alpha \beta") == r"\ \alpha\beta"
    assert fix(r"\mathrm {\alpha x} + a b") == r"\mathrm{\alpha x}+ab"


def test_registry():
    r = models.Registry("layout")
    r.register(["model1", "model2"], lambda n, o: None)
    r.register("model3", lambda n, o: None)
    assert r.names() == {"model1", "model2", "model3"} and r.is_registered("model1")
    assert (r.unregister("model1"), r.unregister("model1")) == (True, False)
    with pytest.raises(KeyError):
        r.factory("model1")
    r.clear()
    assert not r.names()


def test_batches_and_retry():
    assert [list(b) for b in models.batches([1, 2, 3], 2)] == [[1, 2], [3]] and not list(models.batches([], 2))
    with pytest.raises(ValueError):
        list(models.batches([1], 0))
    calls = []

    def run(items):
        calls.append(len(items))
        if len(items) > 1:
            raise RuntimeError
        return [10 * x for x in items]

    assert models.bisect_retry([1, 2], run) == [10, 20] and calls == [2, 1, 1]
    with pytest.raises(RuntimeError):
        models.bisect_retry([1], lambda x: (_ for _ in ()).throw(RuntimeError()))


def test_options_are_copies():
    import pickle

    o = models.Options.of(encoder=0, cap="768")
    assert o.number("cap", 512) == 768 and o.number("none", 512) == 512 and o.get("encoder") == 0
    assert o.with_(decoder=-1).get("decoder") == -1 and o.get("decoder") is None
    assert pickle.loads(pickle.dumps(o)).get("cap") == "768"
    assert (models.batch_size(None, 8), models.batch_size(0, 8), models.batch_size(3, 8)) == (8, 8, 3)


def test_generation_stops_and_feeds_finished_rows():
    def step(ids):
        out = np.zeros((len(ids), 5))
        out[0, 2 if ids.shape[1] > 1 else 3] = 1
        out[1, 4] = 1
        return out

    assert models.generate(step, np.array([1, 1]), end=2, most=4) == [[3, 2], [4, 4, 4, 4]]
    sampled = models.generate(step, np.array([1, 1]), end=2, most=3, temperature=0.2)
    assert sampled == models.generate(step, np.array([1, 1]), end=2, most=3, temperature=0.2)
    ids, real = models.left_pad([[1, 2, 3], [4]])
    assert ids.tolist() == [[1, 2, 3], [0, 0, 4]] and real.tolist() == [[True] * 3, [False, False, True]]


def test_label_routes(spark):
    got = [one(spark, route.region_type(F.lit(x)))[0] for x in ("display_formula", "table", "paragraph_title", "figure", "formula", "Picture")]
    assert got == ["formula", "table", "text", "text", "text", "image"]
    assert one(spark, route.rotates_page(F.lit("90"), F.lit(0.31)), route.rotates_page(F.lit("90"), F.lit(0.3)), route.rotates_page(F.lit("0"), F.lit(0.9)), route.rotates_page(F.lit(None).cast("string"), F.lit(0.9)), route.flips_line(F.lit("180_degree"))) == (True, False, False, False, True)


def test_all_dropped_guard(spark):
    df = spark.createDataFrame([(1, 1, 14, 0, 0, 100, 100), (1, 2, 14, 0, 0, 99, 100), (2, 1, 14, 0, 0, 100, 100), (2, 2, 3, 0, 0, 5, 5)], "page_id long, det_id long, cls int, x1 int, y1 int, x2 int, y2 int")
    out = layout.drop_oversized(df, F.lit(100), F.lit(90), 14)
    assert sorted((r.page_id, r.det_id) for r in out.collect()) == [(1, 1), (1, 2), (2, 2)]


def test_merge_modes():
    layout.check_merge_mode(None)
    layout.check_merge_mode({0: "union", 1: "large"})
    with pytest.raises(ValueError):
        layout.check_merge_mode("most")


def test_token_distance_against_a_table():
    rng = np.random.default_rng(4)
    for _ in range(30):
        a, b = rng.integers(0, 3, rng.integers(0, 9)), rng.integers(0, 3, rng.integers(0, 9))
        d = np.zeros((len(a) + 1, len(b) + 1), int)
        d[:, 0], d[0] = np.arange(len(a) + 1), np.arange(len(b) + 1)
        for i in range(len(a)):
            for j in range(len(b)):
                d[i + 1, j + 1] = min(d[i, j] + (a[i] != b[j]), d[i, j + 1] + 1, d[i + 1, j] + 1)
        assert evaluate.token_distance(a, b) == d[-1, -1]


def test_verdict_and_greedy_match(spark):
    assert evaluate.verdict(1, 0.99, 0.99, 0.005, 0.3, 0.99) and not evaluate.verdict(1, 0.99, 0.99, 0.02, 0.3, 0.99)
    det = "page_id long, det_id long, cls int, x1 double, y1 double, x2 double, y2 double"
    left = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 10.0, 10.0), (1, 2, 1, 50.0, 50.0, 60.0, 60.0), (2, 1, 0, 0.0, 0.0, 1.0, 1.0)], det)
    right = spark.createDataFrame([(1, 7, 0, 1.0, 0.0, 11.0, 10.0), (1, 8, 0, 50.0, 50.0, 60.0, 61.0)], det)
    assert sorted((r.left_id, r.right_id) for r in evaluate.match_by_overlap(left, right).collect()) == [(1, 7), (2, 8)]
    assert [(r.left_id, r.right_id, r.score) for r in evaluate.match_by_label(left, right).collect()] == [(1, 7, 2.0)]


def test_dictionaries(spark, tmp_path):
    yaml = "Global:\n  x: 1\nPostProcess:\n  name: d\n  character_dict:\n  - a\n  - ''''\n  - \"\\u00e9\"\n  - '-'\nOther: 1\n"
    assert dictionaries.character_dict(yaml) == ["a", "'", "é", "-", " "]
    f = tmp_path / "c.json"
    f.write_text('{"id2label": {"10": "b", "2": "a"}, "id_to_token": {"1": "y", "0": "x"}, "text_config": {"n": 3}}')
    assert list(dictionaries.id_to_label(str(f)).items()) == [(2, "a"), (10, "b")]
    assert dictionaries.id_to_token(str(f)) == {0: "x", 1: "y"}
    assert dictionaries.model_settings(str(f), n=1, m=2) == {"n": 3, "m": 2}
    assert [tuple(r) for r in dictionaries.lookup_table(spark, {2: "a"}).collect()] == [(2, "a")]
    with pytest.raises(FileNotFoundError):
        dictionaries.required_files(str(f), "/nowhere")
    assert dictionaries.model_path("r", "n", "f.onnx", "_onnx") == "r/n_onnx/f.onnx"


def test_normalize_latex_column(spark):
    df = spark.createDataFrame(pd.DataFrame({"x": [r"a + b", None]}))
    assert [r[0] for r in df.select(textnorm.normalize_latex("x")).collect()] == ["a+b", None]


def test_groups_across_batches(spark):
    from collections import defaultdict

    from pyspark.sql import types as T

    from quirelake.operators.grouped import over_groups

    rows = [(None if k % 7 == 3 else k % 7, i, f"t{i}") for i, k in enumerate(range(200))]
    df = spark.createDataFrame(rows, "k int, i long, t string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = over_groups(df, "k", ["i"], ["i"], lambda c: (np.arange(0, len(c["i"]), 2), (c["i"][::2] * 10,)), ["k", "t"], [T.StructField("ten", T.LongType())]).collect()
        none = over_groups(df.limit(0), "k", ["i"], ["i"], lambda c: (np.arange(len(c["i"])), ()), ["k"]).count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups = defaultdict(list)
    for k, i, _ in rows:
        groups[k].append(i)
    assert {(r.k, r.t, r.ten) for r in got} == {(k, f"t{i}", 10 * i) for k, own in groups.items() for i in own[::2]} and len(got) == sum(len(own[::2]) for own in groups.values()) and none == 0
