"""Pages from image files: page_id, path, height, width and RGB bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixels
from .imagefile import decode_image

#: A page with its pixels: rows of red, green, blue bytes.
PIXELS = "page_id bigint, path string, height int, width int, data binary"


def page_key(path) -> F.Column:
    """A page's number: a hash of its path, alike wherever it is read."""
    return F.xxhash64(path)


def undecodable_images(spark: SparkSession, *paths: str) -> DataFrame:
    """``path`` of each file that Spark's image source can't decode, which
    ``read_images`` leaves out unless it is strict."""
    found = spark.read.format("image").option("dropInvalid", False).load(list(paths))
    return found.where("image.height < 0").select(F.col("image.origin").alias("path"))


def read_images(spark: SparkSession, *paths: str, strict: bool = False) -> DataFrame:
    """Image files of any kind that Spark's image source decodes.

    A folder may hold other files too: they are left out, and
    ``undecodable_images`` lists them; with ``strict`` the first fails the read by
    name. No paths give no pages. The source's bytes are blue, green, red;
    they are turned in one Arrow-batched pass.
    """
    if not paths:
        return spark.createDataFrame([], PIXELS)
    found = spark.read.format("image").option("dropInvalid", not strict).load(list(paths))
    flat = found.select(page_key(F.col("image.origin")).alias("page_id"), F.col("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.data")

    def turn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, height in zip(f["path"], f["height"], strict=True):
                if height < 0:  # as the source marks what it can't decode
                    raise ValueError(f"{path}: not an image")
            data = [pixels.from_row(r).tobytes() for r in f.to_dict("records")]
            yield f.assign(data=data)[["page_id", "path", "height", "width", "data"]]

    return flat.mapInPandas(turn, PIXELS)


def decode_files(files: DataFrame) -> DataFrame:
    """Pages of files read by the ``binaryFile`` source (path, content), batch or
    stream. PNG and PNM files are decoded; others fail the batch by name."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            images = []
            for path, content in zip(f["path"], f["content"], strict=True):
                try:
                    images.append(decode_image(bytes(content)))
                except Exception as e:
                    raise ValueError(f"{path}: {e}") from e
            sizes = [x.shape[:2] for x in images]
            yield pd.DataFrame({"page_id": f["page_id"], "path": f["path"], "height": np.array([s[0] for s in sizes], np.int32), "width": np.array([s[1] for s in sizes], np.int32), "data": [np.ascontiguousarray(x).tobytes() for x in images]})

    return files.select(page_key(F.col("path")).alias("page_id"), "path", "content").mapInPandas(decode, PIXELS)


def read_files(spark: SparkSession, path: str, glob: str = "*.png") -> DataFrame:
    """PNG and PNM files of a folder; the pattern is tested by the source."""
    return decode_files(spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content"))


def blank_pages(spark: SparkSession, n: int, width: int = 120, height: int = 80, value: int = 255) -> DataFrame:
    """Pages of one colour, for tests and dry runs."""
    data = F.lit(bytearray([value]) * (width * height * 3))
    return spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("blank:"), F.col("id").cast("string")).alias("path"), F.lit(height).alias("height"), F.lit(width).alias("width"), data.alias("data"))


def from_arrays(spark: SparkSession, images: list[np.ndarray]) -> DataFrame:
    """Pages of RGB arrays held by the driver, numbered in order."""
    rows = [(i, f"array:{i}", x.shape[0], x.shape[1], bytearray(np.ascontiguousarray(x).tobytes())) for i, x in enumerate(images)]
    return spark.createDataFrame(rows, PIXELS)
