"""Written tables: stages that several branches read, and results."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of intermediate tables that this process made and has not removed.
_MADE: list[str] = []


@functools.cache
def _local_folder() -> str:
    path = tempfile.mkdtemp(prefix="quirelake-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return "file://" + path


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all machines reach.

    Where that is unset, a session whose master is ``local`` gets a temporary
    folder, removed at the end; on a cluster other machines would not see one,
    so there it is an error. The session's settings are left as they are.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not _is_local(spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines reach")
    return _local_folder()


def _is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path for intermediate tables, which ``clean`` removes."""
    path = f"{shared_folder(spark)}/quirelake-{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def mark() -> int:
    """How many folders were made so far, for ``clean``."""
    return len(_MADE)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders, wherever Spark reaches them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def clean(spark: SparkSession, since: int = 0) -> None:
    """Remove the intermediate tables made since a ``mark``.

    Results are planned over them, so call it when results are written or no
    longer wanted.
    """
    remove(spark, *_MADE[since:])
    del _MADE[since:]


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, read back.

    Branches over it don't run its plan again, and a lost executor doesn't lose
    it. With ``by``, each value has a folder, and a branch reads its own alone.
    """
    path = new_folder(df.sparkSession, name)
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def result_json(pages: DataFrame, columns: list[str] | None = None, name: str = "json") -> DataFrame:
    """Each page's result as one JSON string."""
    keep = columns or [c for c in pages.columns if c != "page_id"]
    return pages.select("page_id", F.to_json(F.struct(*keep)).alias(name))


def write_results(pages: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    """Results as Parquet, ORC, or JSON lines."""
    pages.write.format(kind).mode(mode).save(path)
