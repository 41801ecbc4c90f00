"""Training-data pipeline over ``documents``: five stages, each on what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm.common import Scratch
from quirelake.llm.line_dedup import drop_recurring_lines
from quirelake.llm.minhash_dedup import NearDup, near_duplicates
from quirelake.llm.packing import pack_documents
from quirelake.llm.quality_rules import judge_documents
from quirelake.llm.secret_scan import redact_secrets
from quirelake.sources.tables import clean, mark

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; those rejected go.

    Null and empty texts have no words and go; a null source is a host of its
    own; null doc_ids and repeated rows are judged each for itself; a text of any
    length is judged whole; a rate at a limit passes; no rows give none.
    """
    judged = judge_documents(spark, docs, keep=("text", "lang", "source", "n_chars"))
    return judged.where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; one whose lines all recur elsewhere goes.

    Null and empty texts stay; rows of one doc_id and text lose the same lines;
    of the documents that hold a line the smallest doc_id keeps it, a null one
    last; texts of any length are cut whole; no rows give none.
    """
    cleaned = drop_recurring_lines(spark, docs)
    left = cleaned.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^ \t-\r]"))
    return left.select("doc_id", "text", "lang", "source", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, 0.8): the smallest doc_id.

    Texts without words, null ones too, are duplicates of nothing and stay, as do
    rows with a null doc_id. Rows that share the smallest doc_id of a group all
    stay. A pair at 0.8 itself is linked; texts of any length are compared whole;
    no rows give none.
    """
    gone = near_duplicates(spark, docs, NearDup()).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every found secret written over.

    Null and empty texts, null doc_ids, null sources and repeated rows stay; spans
    that overlap or start together become one mark; texts of any length are
    written over whole; no rows give none.
    """
    return redact_secrets(spark, docs).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with their ids, packed into windows.

    Null and empty texts are the end id alone; null doc_ids are kept and repeated
    rows packed each for itself; pieces of equal length go in any order; a text
    longer than a window is cut; no rows give none.
    """
    return pack_documents(spark, docs, with_ids=True)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("secret scan", secret_scan), ("packing", packing)]

#: Templates, components and packing can't be told in SQL; tests hold run()
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written before the next reads it.

    A stage's inner tables, and the table it read, are removed once it is written.
    """
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        inner = mark()
        done = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        clean(spark, inner)
        if k:
            scratch.drop(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
