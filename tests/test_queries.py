"""Each registered query of the document-analysis operators against its SQL."""

import random

import numpy as np
import pytest
from compare import differences, run_sql

from quirelake.operators.layout import suppress
from quirelake.operators.readorder import band_order
from quirelake.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_what_sql_gives(spark, sf_dir, name):
    assert not differences(QUERIES[name](spark, sf_dir).toArrow(), run_sql(sf_dir, ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    out = QUERIES[name](spark, sf_dir)
    assert out.count() > 0 and len(set(out.columns)) == len(out.columns)


def test_entry_is_the_flagship(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["page_id", "det_id", "label"] and out.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_no_hot_path_runs_python_row_by_row(spark, sf_dir):
    for name in ("formula_outside_table", "iou_pairs", "top_queries", "reading_order", "ctc_collapse"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_quad_band_sort_gives_what_a_plain_loop_gives(spark, sf_dir):
    rows = QUERIES["quad_band_sort"](spark, sf_dir)
    from quirelake.plans import sample

    pages = {}
    for r in sample.det(spark, sf_dir).select("page_id", "det_id", "x1", "y1").orderBy("page_id", "det_id").collect():
        pages.setdefault(r.page_id, []).append((r.det_id, r.x1, r.y1))
    expected = set()
    for page, boxes in pages.items():
        for rank, i in enumerate(band_order([(x, y) for _, x, y in boxes])):
            expected.add((page, boxes[i][0], rank))
    assert {tuple(r) for r in rows.collect()} == expected


def test_suppression_leaves_no_conflict():
    import pandas as pd

    rng = random.Random(3)
    for _ in range(20):
        n = rng.randint(0, 40)
        at = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(n)]
        frame = pd.DataFrame([(i, rng.randint(0, 2), x, y, x + rng.randint(5, 50), y + rng.randint(5, 50)) for i, (x, y) in enumerate(at)], columns=["det_id", "cls", "x1", "y1", "x2", "y2"])
        kept = suppress(frame, 0.6, 0.98)
        b = kept[["x1", "y1", "x2", "y2"]].to_numpy(float)
        for i in range(len(b)):
            for j in range(i):
                w = min(b[i, 2], b[j, 2]) - max(b[i, 0], b[j, 0])
                h = min(b[i, 3], b[j, 3]) - max(b[i, 1], b[j, 1])
                common = max(w, 0) * max(h, 0)
                union = np.prod(b[i, 2:] - b[i, :2]) + np.prod(b[j, 2:] - b[j, :2]) - common
                same = kept["cls"].iloc[i] == kept["cls"].iloc[j]
                assert common / union < (0.6 if same else 0.98)
