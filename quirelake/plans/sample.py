"""Stand-in inputs for queries: detections, scores, steps and pairs made from
relational tables by integer arithmetic, alike in Spark and SQL.

The operators are those of document analysis; the inputs are synthetic, as the
tables hold no images.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import LAYOUT_LABELS

DET_SQL = """
det0 AS (
  SELECT CAST(floor(l_orderkey / 8.0) AS BIGINT) AS page_id, CAST((l_partkey + l_linenumber) % 25 AS INTEGER) AS cls,
         (l_partkey * 13 + l_linenumber * 7) % 1000 AS score_m, (l_partkey * 37) % 160 AS x1, (l_suppkey * 53 + l_linenumber * 17) % 200 AS y1,
         l_partkey, l_suppkey, l_linenumber, l_orderkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
  FROM lineitem),
det1 AS (
  SELECT *, x1 + 40 + (l_partkey * 7) % 200 + CASE WHEN cls = 21 THEN 150 ELSE 0 END AS x2,
            y1 + 20 + (l_partkey * 11) % 60 + CASE WHEN cls = 21 THEN 120 ELSE 0 END AS y2
  FROM det0),
det AS (
  SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY score_m DESC, x1, y1, x2, y2, cls, l_orderkey, l_partkey, l_suppkey, l_linenumber,
         l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS BIGINT) AS det_id, cls, score_m, x1, y1, x2, y2
  FROM det1)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def det(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections: page_id, det_id (best score first), cls, score_m (thousandths), box."""
    li = table(spark, sf_dir, "lineitem")
    part, supp, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    boxed = (
        li.withColumn("page_id", F.floor(F.col("l_orderkey") / 8.0))
        .withColumn("cls", ((part + line) % 25).cast("int"))
        .withColumn("score_m", (part * 13 + line * 7) % 1000)
        .withColumn("x1", (part * 37) % 160)
        .withColumn("y1", (supp * 53 + line * 17) % 200)
    )
    table_box = F.col("cls") == 21
    boxed = boxed.withColumn("x2", F.col("x1") + 40 + (part * 7) % 200 + F.when(table_box, 150).otherwise(0))
    boxed = boxed.withColumn("y2", F.col("y1") + 20 + (part * 11) % 60 + F.when(table_box, 120).otherwise(0))
    rest = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    w = Window.partitionBy("page_id").orderBy(F.desc("score_m"), "x1", "y1", "x2", "y2", "cls", *rest)
    return boxed.withColumn("det_id", F.row_number().over(w).cast("long")).select("page_id", "det_id", "cls", "score_m", "x1", "y1", "x2", "y2")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with the names of the 25-class head."""
    names = F.array(*map(F.lit, LAYOUT_LABELS))
    return det(spark, sf_dir).withColumn("label", F.get(names, F.col("cls")))


def labels_sql() -> str:
    return "[" + ", ".join(f"'{x}'" for x in LAYOUT_LABELS) + "]"


STEP_CLASSES = 97
_ARROW = {T.LongType(): pa.int64(), T.StringType(): pa.string()}


def over_cores(spark: SparkSession, df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt out by a key if its scan has fewer parts than twice the cores, as
    a small file has; a large table has parts enough and stays where it is."""
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(2 * cores, key) if df.rdd.getNumPartitions() < 2 * cores else df


#: Code points of texts whose steps are worked on at once.
_AT_ONCE = 1 << 20


def text_steps(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Steps of texts end to end: each code point, its class, and the bounds of the texts.

    A step is a character, with a class that repeats and blanks as a recogniser's
    do: three classes in four of a character's code are folded together, so runs
    and blanks (class 0) are common.
    """
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    code = np.frombuffer("".join(texts).encode("utf-32-le"), np.int32)
    k = code >> 2
    k -= k // STEP_CLASSES * STEP_CLASSES
    k[code == 32] = 0
    return code, k, bounds


def step_prob(code: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Probabilities, in thousandths, of code points at places from 0 in their texts."""
    return (code.astype(np.int64) * 31 + t * 7) % 1000


def over_steps(spark: SparkSession, sf_dir: str, work: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, list]], adds: str) -> DataFrame:
    """doc_id, and what ``work`` makes of the steps of many documents at once.

    ``work`` takes what ``text_steps`` gives, and returns the place of each of its
    rows' document and the columns ``adds``. No step is a row or a value of its
    own, and nothing is shuffled; a null text has no steps.
    """
    docs = over_cores(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(adds).fields])
    kinds = [_ARROW[f.dataType] for f in schema.fields[1:]]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // _AT_ONCE
            cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(texts)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                own, columns = work(*text_steps([x or "" for x in texts.slice(a, b - a).to_pylist()]))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a).take(pa.array(own)), *(pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True))], names)

    return docs.mapInArrow(run, schema)


STEPS_SQL = f"""
chars AS (SELECT doc_id, CAST(unnest(range(1, length(text) + 1)) AS BIGINT) AS t, text FROM documents),
cut AS (SELECT doc_id, t, substr(text, t, 1) AS c FROM chars),
steps AS (
  SELECT doc_id, t, CAST(CASE WHEN c = ' ' THEN 0 ELSE (unicode(c) // 4) % {STEP_CLASSES} END AS INTEGER) AS k, CAST((unicode(c) * 31 + (t - 1) * 7) % 1000 AS BIGINT) AS prob_m FROM cut)
"""
