"""Views of generators: sizes against the column forms, layouts against plain loops."""

import numpy as np
import pytest

from quirelake.functions import boxes, pixels, views
from quirelake.operators.families import GENERATORS, Runtime, published_generator
from quirelake.operators.models import Options

RNG = np.random.default_rng(8)
SIZES = [(int(w), int(h)) for w, h in RNG.integers(1, 5000, (60, 2))] + [(1, 1), (28, 28), (27, 900), (1540, 1540), (1541, 3), (960, 1408), (961, 1408), (4096, 1)]


def image(w, h):
    return RNG.integers(0, 256, (h, w, 3)).astype(np.uint8)


def test_sizes_are_those_of_the_columns(spark):
    df = spark.createDataFrame(SIZES, "w int, h int")
    w, h = df.w.cast("double"), df.h.cast("double")
    pairs = {
        "fit": (boxes.fit_within(w, h), views.fit_within),
        "budget": (boxes.pixel_budget(w, h, 12544, 9633792), lambda a, b: views.pixel_budget(a, b, 12544, 9633792)),
        "capped": (boxes.capped_size(w, h), views.capped_size),
    }
    got = df.select("w", "h", *(c.alias(f"{k}{i}") for k, (pair, _) in pairs.items() for i, c in enumerate(pair))).collect()
    for r in got:
        for k, (_, plain) in pairs.items():
            assert (r[f"{k}0"], r[f"{k}1"]) == plain(r.w, r.h), (k, r.w, r.h)
    rows, cols = boxes.nearest_grid(w, h, views.grids())
    for r in df.select("w", "h", rows.alias("r"), cols.alias("c")).collect():
        best = min(abs(c / n - r.w / r.h) for n, c in views.grids())
        assert abs(r.c / r.r - r.w / r.h) == best and r.r * r.c == 288


def test_a_given_shape_has_two_or_three_sides(spark):
    from pyspark.sql import functions as F

    one = F.lit(2.0)
    for bad in ((), (3,), (1, 3, 4, 5), (0, 4)):
        with pytest.raises(ValueError, match="input shape"):
            boxes.fixed_size(one, one, bad)
    got = spark.range(1).select(*(c.alias(n) for c, n in zip(boxes.fixed_size(one, F.lit(4.0), (3, 8, 6)), "whab", strict=True))).first()
    assert tuple(got) == (6, 8, 3.0, 2.0)


def test_patches_of_a_block_follow_one_another():
    chw = RNG.standard_normal((3, 24, 16))
    got, rows = views.patches(chw, 4), []
    for y in range(0, 24, 8):
        for x in range(0, 16, 8):
            for dy in (0, 4):
                for dx in (0, 4):
                    part = chw[:, y + dy : y + dy + 4, x + dx : x + dx + 4]
                    rows.append(np.concatenate([part[c].ravel() for c in range(3) for _ in range(2)]))
    assert np.array_equal(got, np.array(rows))


def test_grids_are_all_there_are():
    assert views.grids() == [(12, 24), (16, 18), (18, 16), (24, 12)]
    assert views.grids(16, 1, 16, 1) == [(1, 16), (2, 8), (4, 4), (8, 2), (16, 1)]


def test_tiles_and_the_whole():
    x = image(300, 130)
    got = views.tiled_view(x, longest=64, tile=16)
    assert (got.rows, got.cols) == (2, 4) and got.values.shape == (9, 3, 16, 16)
    stretched = pixels.resize(pixels.resize(x, (64, 28)), (64, 32))
    whole = np.concatenate([np.concatenate(list(got.values[r * 4 : r * 4 + 4]), axis=2) for r in range(2)], axis=1)
    assert np.allclose(whole, pixels.to_chw(pixels.normalize(stretched)))
    assert np.allclose(got.values[-1], pixels.to_chw(pixels.normalize(pixels.resize(stretched, (16, 16)))))
    assert views.tiled_view(image(5, 9), longest=16, tile=16).values.shape == (1, 3, 16, 16)
    for w, h in SIZES:
        scaled, stretched = views.whole_tiles(w, h)
        assert max(scaled) == 2048 and min(scaled) >= 1 and all(s % 512 == 0 and s >= 512 for s in stretched)


def test_a_framed_image_is_whole_and_in_the_middle():
    for w, h in ((40, 10), (10, 40), (13, 13), (1, 90), (90, 1)):
        out = views.framed(np.full((h, w, 3), 200, np.uint8), (56, 22), fill=7)
        assert out.shape == (22, 56, 3)
        ys, xs = np.nonzero((out == 200).all(axis=2))
        top, left, bottom, right = ys.min(), xs.min(), 21 - ys.max(), 55 - xs.max()
        assert 0 <= bottom - top <= 1 and 0 <= right - left <= 1 and len(ys) == (ys.max() - top + 1) * (xs.max() - left + 1)


def test_a_fixed_cubic_is_sharper_than_a_widened_one():
    step = np.zeros((1, 8, 3), np.float64)
    step[:, 4:] = 1.0
    assert pixels.resize(step, (16, 1), "cubic").max() > pixels.resize(step, (16, 1), "cubic", True).max() > 1


def test_each_generator_is_given_its_view():
    shapes = {}
    for of in GENERATORS:
        seen = []

        def encode(items, prompt, seen=seen):
            seen.extend(items)
            return np.zeros((len(items), 1), int), None

        def step(new, kept, end=(of.ends or (2,))[0]):
            scores = np.zeros((len(new), 200_000))
            scores[:, end] = 1
            return scores, 1

        task = next(iter(of.prompts))
        model = published_generator(Runtime(encode, step, lambda ids: ""), of, task)
        assert [t for t, *_ in model([image(90, 40)], Options())] == [""]
        v = seen[0]
        shapes[of.names[0]] = (v.values.shape, v.grid, v.tokens) if isinstance(v, views.Patched) else (v.values.shape, v.rows, v.cols) if isinstance(v, views.Tiled) else v.shape
    assert shapes == {
        "PP-FormulaNet-L": (1, 768, 768), "PP-FormulaNet-S": (1, 384, 384), "pix2text-mfr": (3, 384, 384), "pix2text-mfr-1.5": (3, 384, 384),
        "TexTeller": (1, 448, 448), "nougat-latex-base": (3, 224, 560), "granite-docling-258M": ((9, 3, 512, 512), 2, 4), "CodeFormulaV2": ((9, 3, 512, 512), 2, 4),
        "Dolphin": (3, 896, 896), "unirec-0.1b": (3, 64, 64), "Falcon-OCR": (40, 90, 3), "GOT-OCR-2.0": (3, 1024, 1024), "LlamaJCpp-OCR": (40, 90, 3),
        "GLM-OCR": ((40, 1176), (1, 4, 10), 10), "LightOnOCR-2-1B": (3, 56, 112), "llava-onevision-qwen2-0.5b-ov-hf": (3, 384, 384),
        "Qwen3-VL-2B-Instruct": ((288, 1536), (1, 12, 24), 72), "blip": (3, 384, 384),
    }
