"""Work that must not grow faster than the input: no row a character, and odd texts."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import differences, run_sql

from quirelake.plans import sample
from quirelake.plans.catalogue import ORACLE_SQL, QUERIES

ODD = ["", None, "a", " ", ",", "aa,,bc//defg.", "ÿ€\U0001f600 x,\U0001f600a\n", "ƀƄ ƈ" * 7, "ƀ,", "d" * 9 + "a", "x" * 3000 + ", a"]


@pytest.fixture
def odd_texts(tmp_path):
    """Texts that are null, empty, of one step, of letters beyond ASCII, and longer than what is worked on at once."""
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings", "pages", "benchmark", "labels", "conversations"):
        (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    pq.write_table(pa.table({"doc_id": pa.array(range(len(ODD)), pa.int64()), "text": pa.array(ODD, pa.string())}), tmp_path / "documents.parquet")
    return str(tmp_path)


def steps_stay_within(spark, sf_dir, monkeypatch, name):
    for most in (8, 1 << 20):
        monkeypatch.setattr(sample, "_AT_ONCE", most)
        df = QUERIES[name](spark, sf_dir)
        assert not differences(df.toArrow(), run_sql(sf_dir, ORACLE_SQL[name]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan and "lambdafunction" not in plan


def test_doc_segments_of_odd_texts(spark, odd_texts, monkeypatch):
    # An empty text had a segment, and each character was a row.
    steps_stay_within(spark, odd_texts, monkeypatch, "doc_segments")


def test_ctc_confidence_of_odd_texts(spark, odd_texts, monkeypatch):
    # Each character went through interpreted functions of arrays.
    steps_stay_within(spark, odd_texts, monkeypatch, "ctc_confidence")


def test_ctc_collapse_of_odd_texts(spark, odd_texts, monkeypatch):
    steps_stay_within(spark, odd_texts, monkeypatch, "ctc_collapse")


def plain_suppressed(boxes, same, other):
    """Boxes (x1, y1, x2, y2, class) that stay, by a plain loop."""
    kept = []
    for i, (a, b, c, d, k) in enumerate(boxes):
        for j in kept:
            e, f, g, h, m = boxes[j]
            common = max(min(c, g) - max(a, e), 0) * max(min(d, h) - max(b, f), 0)
            union = (c - a) * (d - b) + (g - e) * (h - f) - common
            if union > 0 and common / union >= (same if k == m else other):
                break
        else:
            kept.append(i)
    return kept


def pages_of_boxes(spark, rng, sizes, span=30):
    """Detections of pages of given sizes, whole corners on a small field."""
    rows = []
    for page, n in enumerate(sizes):
        x, y, w, h = rng.integers(0, span, (4, n))
        rows += [(page, i, int(rng.integers(0, 2)), *map(float, (x[i], y[i], x[i] + w[i], y[i] + h[i]))) for i in range(n)]
    order = rng.permutation(len(rows))
    return rows, spark.createDataFrame([rows[i] for i in order], "page_id long, det_id long, cls int, x1 double, y1 double, x2 double, y2 double")


SIZES = [1, 2, 3, 70, 9, 40, 1, 33, 34, 700, 5, 2, 31]


def test_pages_are_suppressed_together(spark, monkeypatch):
    from quirelake.operators import grouped, layout

    rows, det = pages_of_boxes(spark, np.random.default_rng(5), SIZES)
    want = {(p, i) for p in range(len(SIZES)) for i in plain_suppressed([r[3:] + (r[2],) for r in rows if r[0] == p], 0.5, 0.9)}
    columns = [np.array([r[k] for r in rows], float) for k in (3, 4, 5, 6)]
    bounds = np.concatenate([[0], np.cumsum(SIZES)])
    for cells in (1, 50, 1 << 15):
        monkeypatch.setattr(grouped, "CELLS", cells)
        stays = layout.suppressed(*columns, np.array([r[2] for r in rows]), 0.5, 0.9, bounds)
        assert {rows[i][:2] for i in np.flatnonzero(stays)} == want
    got = layout.non_maximum_suppression(det, 0.5, 0.9)
    assert {(r.page_id, r.det_id) for r in got.collect()} == want and got.columns == det.columns


def test_nms_deals_its_pages_out_once(spark, sf_dir):
    # They were dealt out to be numbered, and once more to be worked on.
    assert QUERIES["nms"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_pages_are_matched_together(spark):
    from quirelake.operators import evaluate

    rng = np.random.default_rng(7)
    rows, det = pages_of_boxes(spark, rng, SIZES, 12)
    left, right = det.where("det_id % 3 = 0 and page_id <> 4"), det.where("det_id % 3 <> 0 and page_id <> 5")
    iou = lambda a, b: (c := max(min(a[5], b[5]) - max(a[3], b[3]), 0) * max(min(a[6], b[6]) - max(a[4], b[4]), 0)) / (u if (u := (a[5] - a[3]) * (a[6] - a[4]) + (b[5] - b[3]) * (b[6] - b[4]) - c) > 0 else 1)
    gap = lambda a, b: -sum(abs(x - y) for x, y in zip(a[3:], b[3:], strict=True)) if a[2] == b[2] else -np.inf
    for match, score, least in ((evaluate.match_by_overlap, iou, 0.5), (evaluate.match_by_label, gap, -20)):
        want = set()
        for p in set(range(len(SIZES))) - {4, 5}:
            free = [r for r in rows if r[0] == p and r[1] % 3]
            for a in (r for r in rows if r[0] == p and r[1] % 3 == 0):
                best = max(free, key=lambda b: score(a, b), default=None)
                if best is not None and score(a, best) > least:
                    free.remove(best)
                    want.add((p, a[1], best[1], round(float(abs(score(a, best))), 9)))
        got = [(r.page_id, r.left_id, r.right_id, round(r.score, 9)) for r in match(left, right).collect()]
        assert set(got) == want and len(got) == len(want) > 100


@pytest.mark.parametrize("name", ["greedy_match", "label_match"])
def test_boxes_are_numbered_once_for_each_side(spark, sf_dir, name):
    # The right side was numbered twice, as a union.
    assert QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().count("row_number() windowspecdefinition(page_id#") == 3


def test_pages_are_voted_together(spark):
    from quirelake.operators import layout

    rows, det = pages_of_boxes(spark, np.random.default_rng(9), SIZES)
    det = det.selectExpr("page_id", "det_id", "if(det_id = 2, null, cast(x1 as int)) as v")
    want = set()
    for p, n in enumerate(SIZES):
        v, votes = [int(r[3]) for r in rows if r[0] == p], [0] * n
        for a in range(n):
            for b in range(a + 1, n):
                if a != 2 and b != 2:
                    s = (v[a] * 7 + v[b] * 3) % 101
                    votes[b] += s
                    votes[a] += 1 - s
        want |= {(p, i, votes[i], rank) for rank, i in enumerate(sorted(range(n), key=lambda i: (votes[i], i)))}
    got = layout.reading_order(det, lambda a, b: np.fmod(a["v"] * 7 + b["v"] * 3, 101), ["v"])
    assert {tuple(r) for r in got.collect()} == want and got.columns == ["page_id", "det_id", "votes", "read_rank"]
    assert "lambdafunction" not in got._jdf.queryExecution().executedPlan().toString()


def test_few_texts_are_python_strings_at_once():
    import tracemalloc

    from quirelake.functions import textnorm

    texts = ["a + b " * 100 + str(i) if i % 7 else None for i in range(40_000)]
    column = pa.array(texts)
    tracemalloc.start()
    out = textnorm.in_slices(lambda t: t[::-1], column)
    held, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert out.to_pylist() == [t and t[::-1] for t in texts] and most < 8 << 20
    assert textnorm.in_slices(str, pa.array([], pa.string())).to_pylist() == []
    assert textnorm.in_slices(str, pa.array(["x" * (3 << 20), "", None, "y"])).to_pylist() == ["x" * (3 << 20), "", None, "y"]


def test_stages_work_on_pieces_of_a_batch(monkeypatch):
    import pandas as pd

    from quirelake.plans import pipeline

    f = pd.DataFrame({"page_id": range(3000), "data": [bytes(i % 5 * 1000) for i in range(3000)]})
    seen = []
    whole = pd.concat(pipeline._flow(lambda x: seen.append((len(x), sum(map(len, x["data"])))) or x)([f.iloc[:0], f]))
    assert whole["page_id"].tolist() == list(range(3000)) and max(n for n, _ in seen) == 512
    monkeypatch.setattr(pipeline, "_BYTES", 6000)
    seen.clear()
    whole = pd.concat(pipeline._flow(lambda x: seen.append((len(x), sum(map(len, x["data"])))) or x)([f]))
    assert whole["page_id"].tolist() == list(range(3000)) and max(b for _, b in seen) <= 6000
    monkeypatch.setattr(pipeline, "_BYTES", 10)
    assert [len(x) for x in pipeline.pieces(pd.DataFrame({"data": [b"a" * 50, b"", b"b" * 11]}))] == [1, 1, 1]
