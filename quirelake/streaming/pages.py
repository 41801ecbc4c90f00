"""Pages as they arrive: a stream of image files read like a table of them.

An extension over batch reading; results are those of ``plans.pipeline.ocr`` for
the same files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.pipeline import Models, ocr
from ..sources.images import decode_files

_FILES = "path string, modificationTime timestamp, length long, content binary"


def page_stream(spark: SparkSession, folder: str, glob: str = "*.png", files_per_batch: int = 64) -> DataFrame:
    """Pages of PNG and PNM files that arrive in a folder. A batch holds so many
    files at most, which bounds a task's memory."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return decode_files(files.select("path", "content"))


def read_stream(pages: DataFrame, models: Models, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write the nested results of a stream of pages, a folder for each batch.

    A batch that is run again after a loss overwrites its own folder, so no page
    is lost or doubled.
    """

    def read(batch: DataFrame, number: int) -> None:
        ocr(batch, models).nested().write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = pages.writeStream.foreachBatch(read).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
