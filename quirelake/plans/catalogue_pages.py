"""More registered queries: sizes, tensors, prompts, sinks and whole pages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import boxes, decode, probmap, tensors, textnorm, views
from ..operators import evaluate, layout, route
from ..operators.models import Options
from ..sources.tables import result_json
from . import sample
from .pipeline import Models, Stage, ocr
from .registry import query


def _det(rest: str) -> str:
    return f"WITH {sample.DET_SQL} {rest}"


@query(
    _det(
        """, s AS (SELECT page_id, det_id, CAST((x2 - x1) * 9 AS DOUBLE) AS w, CAST((y2 - y1) * 11 AS DOUBLE) AS h FROM det),
a AS (SELECT *, CASE WHEN least(w, h) < 736 THEN 736.0::DOUBLE / least(w, h) ELSE 1 END AS r FROM s),
b AS (SELECT *, floor(w * r + 0.5) AS mw, floor(h * r + 0.5) AS mh FROM a),
c AS (SELECT *, CASE WHEN greatest(mw, mh) > 4000 THEN 4000.0::DOUBLE / greatest(mw, mh) ELSE 1 END AS k FROM b),
d AS (SELECT *, 960.0::DOUBLE / greatest(w, h) AS l, w / h AS q FROM c),
e AS (SELECT *, CASE WHEN w > 960 OR h > 1408 THEN CASE WHEN q * 1408 <= 960 THEN floor(1408 * q) ELSE 960 END ELSE w END AS fw,
  CASE WHEN w > 960 OR h > 1408 THEN CASE WHEN q * 1408 <= 960 THEN 1408 ELSE floor(960 / q) END ELSE h END AS fh FROM d)
SELECT page_id, det_id, CAST(greatest(floor(floor(mw * k + 0.5) / 32 + 0.5) * 32, 32) AS INTEGER) AS min_w, CAST(greatest(floor(floor(mh * k + 0.5) / 32 + 0.5) * 32, 32) AS INTEGER) AS min_h,
  CAST(ceil(floor(w * l) / 128) * 128 AS INTEGER) AS long_w, CAST(ceil(floor(h * l) / 128) * 128 AS INTEGER) AS long_h,
  CAST(greatest(floor(fw / 64) * 64, 64) AS INTEGER) AS fit_w, CAST(greatest(floor(fh / 64) * 64, 64) AS INTEGER) AS fit_h FROM e"""
    )
)
def size_policies(spark, sf_dir):
    d = sample.det(spark, sf_dir)
    w, h = ((d.x2 - d.x1) * 9).cast("double"), ((d.y2 - d.y1) * 11).cast("double")
    by = {"min": boxes.detector_size(w, h, 736, "min"), "long": boxes.long_side_size(w, h, 960), "fit": boxes.fit_within(w, h)}
    return d.select("page_id", "det_id", *(c.alias(f"{k}_{side}") for k, pair in by.items() for c, side in zip(pair, "wh", strict=True)))


@query(
    _det(
        """, a AS (SELECT page_id, det_id, CAST((x2 - x1) * 9 AS DOUBLE) AS w, CAST((y2 - y1) * 11 AS DOUBLE) AS h FROM det),
g AS (SELECT page_id, det_id, min([abs(c / r - w / h), i, r, c]) AS g FROM a, (VALUES (0.0::DOUBLE, 12.0::DOUBLE, 24.0::DOUBLE), (1, 16, 18), (2, 18, 16), (3, 24, 12)) AS t(i, r, c) GROUP BY ALL),
b AS (SELECT *, greatest(greatest(w, h) / 1540, 1) AS over, CASE WHEN least(w, h) < 28 THEN greatest(28 / h, 28 / w) END AS grow FROM a),
s AS (SELECT *, coalesce(floor(w * grow), w) AS w0, coalesce(floor(h * grow), h) AS h0 FROM b),
n AS (SELECT *, floor(w0 / 28 + 0.5) * 28 AS nw, floor(h0 / 28 + 0.5) * 28 AS nh, sqrt(2 * w0 * h0 / 200000) AS down, sqrt(40000 / (2 * w0 * h0)) AS up FROM s)
SELECT n.page_id, n.det_id, CAST(g[3] AS INTEGER) AS grid_rows, CAST(g[4] AS INTEGER) AS grid_cols,
  CAST((floor((floor(w / over) - 1) / 28) + 1) * 28 AS INTEGER) AS capped_w, CAST((floor((floor(h / over) - 1) / 28) + 1) * 28 AS INTEGER) AS capped_h,
  CAST(CASE WHEN 2 * nw * nh > 200000 THEN greatest(floor(w0 / down / 28) * 28, 28) WHEN 2 * nw * nh < 40000 THEN ceil(w0 * up / 28) * 28 ELSE nw END AS INTEGER) AS budget_w,
  CAST(CASE WHEN 2 * nw * nh > 200000 THEN greatest(floor(h0 / down / 28) * 28, 28) WHEN 2 * nw * nh < 40000 THEN ceil(h0 * up / 28) * 28 ELSE nh END AS INTEGER) AS budget_h,
  round(640 / w, 9) AS fixed_rw, round(480 / h, 9) AS fixed_rh
FROM n JOIN g ON g.page_id = n.page_id AND g.det_id = n.det_id"""
    )
)
def encoder_sizes(spark, sf_dir):
    d = sample.det(spark, sf_dir)
    w, h = ((d.x2 - d.x1) * 9).cast("double"), ((d.y2 - d.y1) * 11).cast("double")
    rows, cols = boxes.nearest_grid(w, h, views.grids())
    capped, budget = boxes.capped_size(w, h), boxes.pixel_budget(w, h, 40_000, 200_000)
    fixed = [F.round(r, 9) for r in boxes.fixed_size(w, h, (3, 480, 640))[2:]]
    names = ["grid_rows", "grid_cols", "capped_w", "capped_h", "budget_w", "budget_h", "fixed_rw", "fixed_rh"]
    return d.select("page_id", "det_id", *(c.alias(n) for c, n in zip([rows, cols, *capped, *budget, *fixed], names, strict=True)))


@query(
    _det(
        """, t AS (SELECT page_id, det_id, cls, CASE WHEN cls = 14 THEN row_number() OVER (PARTITION BY page_id, cls = 14 ORDER BY det_id) END AS n FROM det),
f AS (SELECT page_id, score_m, row_number() OVER (PARTITION BY page_id ORDER BY det_id) AS n FROM det WHERE cls >= 12)
SELECT t.page_id, t.det_id, t.cls, f.score_m AS feature FROM t LEFT JOIN f ON f.page_id = t.page_id AND f.n = t.n"""
    )
)
def image_token_scatter(spark, sf_dir):
    d = sample.det(spark, sf_dir)
    features = d.where("cls >= 12").select("page_id", F.col("det_id").alias("at"), F.col("score_m").alias("feature"))
    return tensors.scatter_features(d.select("page_id", "det_id", "cls"), features, ["page_id"], "det_id", "cls", 14, "at", "feature").select("page_id", "det_id", "cls", "feature")


@query(_det("SELECT a.page_id, a.det_id, a.det_id * 2 % 7 AS query, b.cls, b.score_m FROM det a LEFT JOIN det b ON b.page_id = a.page_id AND b.det_id = a.det_id * 2 % 7"))
def gather_by_index(spark, sf_dir):
    d = sample.det(spark, sf_dir)
    rows = d.select("page_id", "det_id", (F.col("det_id") * 2 % 7).alias("query"))
    return tensors.gather(rows, d.select("page_id", F.col("det_id").alias("place"), "cls", "score_m"), ["page_id"], "query", "place").select("page_id", "det_id", "query", "cls", "score_m")


@query(
    _det(
        """, b AS (SELECT page_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, bool_and(score_m > 40) AS finished FROM det GROUP BY page_id),
c AS (SELECT page_id, cls, count(*) AS n, min(det_id) AS f FROM det GROUP BY page_id, cls),
m AS (SELECT page_id, cls AS commonest, n FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, f) AS k FROM c) WHERE k = 1)
SELECT b.page_id, x1, y1, x2, y2, finished, commonest, n FROM b JOIN m ON m.page_id = b.page_id"""
    )
)
def page_extents(spark, sf_dir):
    d = sample.det(spark, sf_dir)
    rect = d.groupBy("page_id").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.bool_and(F.col("score_m") > 40).alias("finished"))
    return rect.join(tensors.commonest(d, "cls", ["page_id"], "det_id"), "page_id")


@query(
    _det(
        "SELECT page_id, det_id, round(CASE WHEN max(score_m) OVER p > min(score_m) OVER p THEN (score_m - min(score_m) OVER p)::DOUBLE / (max(score_m) OVER p - min(score_m) OVER p) * 255 ELSE 0 END, 9) AS stretched FROM det WINDOW p AS (PARTITION BY page_id)"
    )
)
def stretched_scores(spark, sf_dir):
    return tensors.stretched(sample.det(spark, sf_dir), "score_m", ["page_id"]).select("page_id", "det_id", F.round("stretched", 9).alias("stretched"))


@query(
    _det(
        """, i AS (SELECT page_id, list(cls ORDER BY det_id) AS ids FROM det GROUP BY page_id), b AS (SELECT page_id, ids, max(len(ids)) OVER (PARTITION BY page_id // 16) AS n FROM i)
SELECT page_id, CAST(n AS INTEGER) AS n, array_to_string(list_concat(list_transform(range(n - len(ids)), lambda x: 0), ids), ',') AS ids,
  array_to_string(list_slice(ids, 1, 2), ',') AS first_row, CAST(ceil(len(ids) / 4.0) AS INTEGER) AS n_rows FROM b"""
    )
)
def left_padded_batches(spark, sf_dir):
    rows = F.transform(F.array_sort(F.collect_list(F.struct("det_id", "cls"))), lambda r: r["cls"].cast("bigint"))
    held = sample.det(spark, sf_dir).groupBy("page_id").agg(rows.alias("row"))
    sized = held.withColumn("n", F.max(F.size("row")).over(Window.partitionBy(F.floor(F.col("page_id") / 16))))
    grid = tensors.reshape(F.col("row"), 4)
    spelt = lambda a: F.array_join(a.cast("array<string>"), ",")
    return sized.select("page_id", "n", spelt(tensors.left_padded(F.col("row"), F.col("n"))).alias("ids"), spelt(tensors.first_columns(F.slice(grid, 1, 1), 2)).alias("first_row"), F.size(grid).alias("n_rows"))


@query("SELECT part.p_partkey, array_to_string(list_transform(range(p_size), lambda i: CAST(round(-1 + i * (2.0::DOUBLE / greatest(p_size - 1, 1)), 6) AS DECIMAL(9, 6))), ',') AS places FROM part")
def linspace_positions(spark, sf_dir):
    places = tensors.linspace(F.lit(-1.0), F.lit(1.0), F.col("p_size"))
    spelt = F.transform(places, lambda v: F.round(v, 6).cast("decimal(9,6)").cast("string"))
    return sample.table(spark, sf_dir, "part").select("p_partkey", F.array_join(spelt, ",").alias("places"))


@query(
    """WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '  ' ELSE text END AS asked, text FROM conversations)
SELECT conv_id, turn, text, replace(replace(replace(replace('{{media}} {media}: {{prompt}}/{prompt}', '{{media}}', '<IMG>'), '{media}', '<IMG>'), '{{prompt}}', p), '{prompt}', p) AS prompt
FROM (SELECT *, CASE WHEN regexp_replace(asked, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') = '' THEN 'Read all text in the image.' ELSE asked END AS p FROM c)"""
)
def filled_prompts(spark, sf_dir):
    turns = sample.table(spark, sf_dir, "conversations")
    asked = F.when(F.col("turn") % 3 == 0, "  ").otherwise(F.col("text"))
    return turns.select("conv_id", "turn", "text", textnorm.fill_prompt(F.lit("{{media}} {media}: {{prompt}}/{prompt}"), F.lit("<IMG>"), asked).alias("prompt"))


@query(
    """WITH t AS (SELECT doc_id, list_concat(['<s>'], string_split(replace(text, ' ', ' Ġ'), ' '), ['</s>', '<pad>']) AS ids FROM documents)
SELECT doc_id, md5(array_to_string(list_filter(list_transform(ids, lambda x: regexp_replace(replace(x, 'Ġ', ' '), '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')), lambda x: x NOT IN ('<s>', '</s>', '<pad>')), '|')) AS tokens_md5 FROM t"""
)
def detokenized(spark, sf_dir):
    ids = F.concat(F.array(F.lit("<s>")), F.split(F.replace("text", F.lit(" "), F.lit(" Ġ")), " "), F.array(F.lit("</s>"), F.lit("<pad>")))
    return sample.table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(textnorm.detokenize(ids), "|")).alias("tokens_md5"))


@query(
    """SELECT doc_id, md5(regexp_replace('<|end_of_query|>' || text || ' <|end_of_text|>', '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')) AS marked_md5,
  md5(regexp_replace(replace(replace(text, '<|end_of_query|>', ''), '<|end_of_text|>', ''), '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')) AS text_md5,
  md5(replace(regexp_replace('\\text{ 中文 ' || text || '"', '\\\\text[ \\t\\n\\x0B\\f\\r]*\\{[ \\t\\n\\x0B\\f\\r]*([^}]*?[\\x{4e00}-\\x{9fff}]+[^}]*?)[ \\t\\n\\x0B\\f\\r]*\\}', '\\1', 'g'), '"', '')) AS unwrapped_md5 FROM documents"""
)
def generated_text(spark, sf_dir):
    text = F.col("text")
    marked = F.concat(F.lit("<|end_of_query|>"), text, F.lit(" <|end_of_text|>"))
    wrapped = F.concat(F.lit("\\text{ 中文 "), text, F.lit('"'))
    return sample.table(spark, sf_dir, "documents").select("doc_id", F.md5(textnorm.strip(marked)).alias("marked_md5"), F.md5(textnorm.end_markers(marked)).alias("text_md5"), F.md5(textnorm.remove_text_wrapping(wrapped)).alias("unwrapped_md5"))


@query("SELECT vec_id, round(list_max(p), 9) AS top, round(list_sum(p), 9) AS total FROM (SELECT vec_id, list_transform(e, lambda v: exp(v - m) / s) AS p FROM (SELECT *, list_sum(list_transform(e, lambda v: exp(v - m))) AS s FROM (SELECT vec_id, e, list_max(e) AS m FROM (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings))))")
def softmax_rows(spark, sf_dir):
    p = decode.softmax(F.col("embedding").cast("array<double>"))
    rows = sample.table(spark, sf_dir, "embeddings").select("vec_id", p.alias("p"))
    return rows.select("vec_id", F.round(F.array_max("p"), 9).alias("top"), F.round(F.aggregate("p", F.lit(0.0), lambda a, v: a + v), 9).alias("total"))


@query(_det("""SELECT page_id, '{"boxes":[' || string_agg('{"det_id":' || det_id || ',"cls":' || cls || ',"x1":' || x1 || '}', ',' ORDER BY det_id) || ']}' AS json FROM det GROUP BY page_id"""))
def result_strings(spark, sf_dir):
    pages = sample.det(spark, sf_dir).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("det_id", "cls", "x1"))).alias("boxes"))
    return result_json(pages)


@query(
    _det(
        """, g AS (SELECT page_id, det_id, CASE WHEN cls % 5 = 0 THEN NULL ELSE CAST(cls % 4 * 90 AS VARCHAR) END AS label, score_m / 1000.0::DOUBLE AS score, CASE WHEN score_m % 2 = 0 THEN '180_degree' ELSE '0_degree' END AS line FROM det)
SELECT page_id, det_id, coalesce(score > 0.3 AND CAST(label AS DOUBLE) > 1e-7, false) AS turned, line = '180_degree' AS flipped FROM g"""
    )
)
def orientation_gates(spark, sf_dir):
    label = F.when(F.col("cls") % 5 == 0, F.lit(None)).otherwise((F.col("cls") % 4 * 90).cast("string"))
    line = F.when(F.col("score_m") % 2 == 0, "180_degree").otherwise("0_degree")
    return sample.det(spark, sf_dir).select("page_id", "det_id", route.rotates_page(label, F.col("score_m") / 1000.0).alias("turned"), route.flips_line(line).alias("flipped"))


@query(
    _det(
        """, r AS (SELECT page_id, det_id, cls, row_number() OVER (PARTITION BY page_id, cls ORDER BY det_id) - 1 AS line_index, x1, score_m FROM det)
SELECT page_id, CAST(cls AS INTEGER) AS layout_index, CAST(line_index AS INTEGER) AS line_index, x1 AS poly_x, score_m / 1000.0::DOUBLE AS det_score FROM r"""
    )
)
def line_fan_out(spark, sf_dir):
    d = sample.det(spark, sf_dir)
    rows = F.array_sort(F.collect_list(F.struct("det_id", F.array(F.array("x1", "y1"), F.array("x2", "y2")).alias("poly"), (F.col("score_m") / 1000.0).alias("score"))))
    regions = d.groupBy("page_id", F.col("cls").alias("layout_index")).agg(rows.alias("r"))
    found = regions.select("page_id", "layout_index", F.struct(F.col("r.poly").alias("polys"), F.col("r.score").alias("scores")).alias("polys"))
    return route.lines_of(found).select("page_id", "layout_index", "line_index", F.col("poly")[0][0].alias("poly_x"), "det_score")


@query("SELECT page_id, -1 AS layout_index, 'text' AS label, CAST(0 AS FLOAT) AS x1, CAST(0 AS FLOAT) AS y1, CAST(length(url) AS FLOAT) AS x2, CAST(length(html) AS FLOAT) AS y2, 'text' AS route FROM pages")
def whole_page_regions(spark, sf_dir):
    sized = sample.table(spark, sf_dir, "pages").select("page_id", F.length("url").alias("width"), F.length("html").alias("height"))
    return route.whole_page_regions(sized)


@query(
    _det(
        """, m AS (SELECT score_m / 1000.0::DOUBLE AS a, (score_m + det_id % 3) / 1000.0::DOUBLE AS b, CASE WHEN det_id % 50 = 0 THEN cls + 1 ELSE cls END = cls AS same, det_id % 6 AS gap FROM det)
SELECT count(*) AS n, round(avg(CAST(same AS INTEGER)), 9) AS label_rate, round(avg(CAST(abs(a - b) < 0.01 AS INTEGER)), 9) AS score_rate, round(avg(CAST(gap < 5 AS INTEGER)), 9) AS box_rate,
  round(quantile_cont(abs(a - b), 0.99), 9) AS score_p99, round(quantile_cont(gap, 0.99), 9) AS box_p99 FROM m"""
    )
)
def agreement_report(spark, sf_dir):
    d = sample.det(spark, sf_dir)
    a, b = F.col("score_m") / 1000.0, (F.col("score_m") + F.col("det_id") % 3) / 1000.0
    label = F.when(F.col("det_id") % 50 == 0, F.col("cls") + 1).otherwise(F.col("cls"))
    pairs = d.select((label == F.col("cls")).cast("int").alias("same"), F.abs(a - b).alias("score_gap"), (F.col("det_id") % 6).alias("box_gap"))
    return evaluate.agreement(pairs)


@query(
    "SELECT cls, count(*) AS n FROM (" + _det("SELECT cls FROM det WHERE score_m > CASE WHEN cls = 3 THEN 900 ELSE 500 END") + ") GROUP BY cls"
)
def class_branches(spark, sf_dir):
    # The filtered boxes of each class are put together again by a union.
    d = sample.det(spark, sf_dir)
    one = layout.score_filter(d.where("cls = 3"), 900, "score_m")
    rest = layout.score_filter(d.where("cls <> 3"), 500, "score_m")
    return one.unionByName(rest).groupBy("cls").agg(F.count("*").alias("n"))


@query()
def probability_boxes(spark, sf_dir):
    """Text boxes of maps made from scores, eight a row, each four by four."""

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for key, e in zip(f["vec_id"], f["embedding"], strict=True):
                prob = 1 / (1 + np.exp(-4 * np.kron(np.asarray(e, float).reshape(-1, 8), np.ones((4, 4)))))
                found = probmap.text_boxes(prob, 64, 2 * len(prob), threshold=0.6, least_score=0.5)
                out += [(key, i, sum(p, []), round(s, 9)) for i, (p, s) in enumerate(zip(found.polys, found.scores, strict=True))]
            yield pd.DataFrame(out, columns=["vec_id", "box", "quad", "score"])

    whole = sample.table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", "embedding")
    return whole.mapInPandas(find, "vec_id long, box int, quad array<int>, score double")


def _blank_layout(name: str, options: Options):
    """A title above a formula above a table, on every page."""
    regions = [(17, "paragraph_title", 0.9, (0, 0, 40, 10)), (5, "display_formula", 0.8, (0, 10, 40, 20)), (21, "table", 0.7, (0, 20, 40, 30))]
    return lambda items, call: [regions for _ in items]


def _two_lines(name: str, options: Options):
    return lambda items, call: [([[(0, 5), (20, 5), (20, 9), (0, 9)], [(0, 0), (20, 0), (20, 4), (0, 4)]], [0.8, 0.9]) for _ in items]


def _brightness(name: str, options: Options):
    return lambda items, call: [(f"{name}{int(x.mean())}", [0.5]) for x in items]


def _formula(name: str, options: Options):
    return lambda items, call: [(f"x_{{{int(x.mean())}}}", [int(x.mean())], -1.0) for x in items]


def _table(name: str, options: Options):
    return lambda items, call: [(f"<table>{x.shape[0]}</table>", [1, 2]) for x in items]


@query("SELECT page_id, 3 AS n_regions, 'a' || (page_id % 251) || 'a' || (page_id % 251) AS title, 'x_{' || (page_id % 251) || '}' AS formula, '<table>10</table>' AS \"table\" FROM pages")
def page_reading(spark, sf_dir):
    """Pages of one shade through the whole pipeline, with models that tell the shade."""

    def paint(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a in range(0, len(f), 512):
                part = f.iloc[a : a + 512]
                yield part.assign(path="blank", height=np.int32(30), width=np.int32(40), data=[bytes([i % 251]) * 3600 for i in part["page_id"]])

    pages = sample.table(spark, sf_dir, "pages").select("page_id").mapInPandas(paint, "page_id long, path string, height int, width int, data binary")
    models = Models(detection=Stage(_two_lines, batch=8), recognition=Stage(_brightness, "a", batch=32), layout=Stage(_blank_layout, batch=8), formula=Stage(_formula, batch=8), table=Stage(_table, batch=8))
    got = ocr(pages, models).nested()
    line = F.transform(F.col("regions")[0]["lines"], lambda x: x["text"])
    return got.select("page_id", F.size("regions").alias("n_regions"), F.array_join(line, "").alias("title"), F.col("regions")[1]["formula"]["text"].alias("formula"), F.col("regions")[2]["table"]["text"].alias("table"))
