"""Queries without SQL against plain loops over whole tables, written apart from the operators."""

import re

import numpy as np
import pytest

from quirelake.plans import sample
from quirelake.plans.catalogue import QUERIES, _halves
from quirelake.sources.images import read_images, undecodable_images


def by_page(df):
    pages = {}
    for r in df.select("page_id", "det_id", "cls", "x1", "y1", "x2", "y2").collect():
        pages.setdefault(r.page_id, []).append(tuple(r)[1:])
    return {p: sorted(rows) for p, rows in pages.items()}


def iou(a, b):
    w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda x: (x[4] - x[2]) * (x[5] - x[3])
    return w * h / (area(a) + area(b) - w * h)


def matched(spark, sf_dir, score, accepted, shown):
    left, right = map(by_page, _halves(spark, sf_dir))
    out = []
    for page, boxes in left.items():
        free = list(right.get(page, []))
        for a in boxes:
            found = [(score(a, b), -k) for k, b in enumerate(free)]
            if found and accepted((best := max(found))[0]):
                b = free.pop(-best[1])
                out.append((page, a[0], b[0], round(shown(best[0]), 9)))
    return sorted(out)


def test_greedy_match(spark, sf_dir):
    got = sorted(tuple(r) for r in QUERIES["greedy_match"](spark, sf_dir).collect())
    assert got == matched(spark, sf_dir, iou, lambda s: s > 0.5, float) and len(got) > 500


def test_label_match(spark, sf_dir):
    gap = lambda a, b: -float(sum(abs(x - y) for x, y in zip(a[2:], b[2:], strict=True))) if a[1] == b[1] else float("-inf")
    got = sorted(tuple(r) for r in QUERIES["label_match"](spark, sf_dir).collect())
    assert got == matched(spark, sf_dir, gap, lambda s: s > -20, lambda s: -s) and len(got) > 500


def test_quad_band_sort(spark, sf_dir):
    pages, want = {}, set()
    for r in sample.det(spark, sf_dir).select("page_id", "det_id", "x1", "y1").collect():
        pages.setdefault(r.page_id, []).append((r.y1, r.x1, r.det_id))
    for page, lines in pages.items():
        placed = []
        for y, x, k in sorted(lines):
            ahead = 0
            for b, a, _ in reversed(placed):
                if abs(y - b) >= 10 or x >= a:
                    break
                ahead += 1
            placed.insert(len(placed) - ahead, (y, x, k))
        want |= {(page, k, i) for i, (_, _, k) in enumerate(placed)}
    assert {tuple(r) for r in QUERIES["quad_band_sort"](spark, sf_dir).collect()} == want and len(want) > 5000


def test_token_error_rate(spark, sf_dir):
    turns = sorted(((r.conv_id, r.turn, r.text) for r in sample.table(spark, sf_dir, "conversations").collect()))
    wrong = total = 0
    for (c, _, a), (d, _, b) in zip(turns, turns[1:], strict=False):
        if c != d:
            continue
        x, y = (re.split(r"[ \t\n\x0b\f\r]+", t) for t in (a, b))
        row = list(range(len(y) + 1))
        for i, s in enumerate(x, 1):
            now = [i]
            for j, t in enumerate(y, 1):
                now.append(min(now[-1] + 1, row[j] + 1, row[j - 1] + (s != t)))
            row = now
        wrong, total = wrong + row[-1], total + len(x)
    (got,) = QUERIES["token_error_rate"](spark, sf_dir).collect()
    assert (got.distance, got.n_tokens) == (wrong, total) and got.error_rate == pytest.approx(wrong / total)


def test_an_undecodable_image_is_reported(spark, tmp_path):
    (tmp_path / "no.png").write_bytes(b"this is no image")
    assert [r.path.rsplit("/", 1)[1] for r in undecodable_images(spark, str(tmp_path)).collect()] == ["no.png"] and read_images(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="no.png"):
        read_images(spark, str(tmp_path), strict=True).collect()


def test_sequences_collapse_within_rows(spark):
    from pyspark.sql import functions as F

    from quirelake.functions import decode

    rng = np.random.default_rng(2)
    logits = [rng.standard_normal((n, 4)).round(3).tolist() for n in (0, 1, 7, 60)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(logits)], "i int, x array<array<double>>")
    for r in df.select("i", decode.ctc_decode(F.col("x"), list("ab")).alias("d")).collect():
        best = [max(range(4), key=lambda k: (s[k], -k)) for s in logits[r.i]]
        kept = [t for t, k in enumerate(best) if k and (t == 0 or best[t - 1] != k)]
        assert r.d.text == "".join("ab"[best[t] - 1] for t in kept if best[t] <= 2)
        assert r.d.scores == pytest.approx([sum(max(logits[r.i][t]) for t in kept) / len(kept) if kept else 0.0])
