"""Packing of tokenised documents into fixed windows, best fit decreasing."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, grouped_batches, runs
from .encoders import chunk_encoder

WINDOW = 4096
END_ID = 2
VOCABULARY = "word_bpe_49k.json"
#: Pieces, and ids where they ride along, that are packed together and held by a
#: task at once; waste is at most a few windows a group.
GROUP_PIECES = 50_000
GROUP_IDS = 4_000_000
#: Shuffle partitions; beyond that, a task packs several groups one after another.
MOST_PARTS = 100_000


class OpenWindows:
    """Segment tree over remaining capacity 0..window; a node counts the open
    windows below it. ``take`` finds the tightest window that still fits."""

    def __init__(self, window: int):
        self.window = window
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        count = self.count
        while node:
            count[node] += by
            node >>= 1

    def put(self, window_id: int, capacity: int) -> None:
        if capacity > 0:
            self.at[capacity].append(window_id)
            self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(window, its capacity) of the least capacity >= need, taken out."""
        count = self.count
        node = need + self.leaves
        if not count[node]:
            while True:  # up to the first subtree on the right that has a window
                if node <= 1:
                    return None
                if not node & 1 and count[node + 1]:
                    node += 1
                    break
                node >>= 1
            while node < self.leaves:
                node *= 2
                if not count[node]:
                    node += 1
        capacity = node - self.leaves
        self._add(capacity, -1)
        return self.at[capacity].pop(), capacity


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece; pieces are at most ``window`` long.

    Longest first; equal lengths keep their order.
    """
    order = np.argsort(-lengths.astype(np.int64), kind="stable")
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, n = OpenWindows(window), 0
    for i, need in zip(order.tolist(), lengths[order].tolist(), strict=True):
        found = tree.take(need) if need < window else None
        if found is None:
            found, n = (n, window), n + 1
        where[i], offset[i] = found[0], window - found[1]
        tree.put(found[0], found[1] - need)
    return where, offset


PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


def _cutter(vocabulary: str, window: int, end_id: int, with_ids: bool):
    fields = [pa.int64()] * 5 + [pa.binary()]

    def cut(batches):
        encoder = chunk_encoder(vocabulary)
        for batch in batches:
            rows: list[list] = [[] for _ in PIECES]
            docs = batch.column(0).to_pylist()
            for doc, ids in zip(docs, encoder.encode_column(batch.column(1)), strict=True):
                raw = np.append(ids, end_id).astype("<u4").tobytes()
                total = len(raw) // 4
                for at in range(0, total, window):
                    piece = raw[4 * at : 4 * (at + window)]
                    for column, value in zip(rows, (doc, at, len(piece) // 4, zlib.crc32(piece), total, piece if with_ids else None), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, fields, strict=True)], PIECES.names)

    return cut


def _packer(window: int):
    def pack(batches):
        for batch in grouped_batches(batches, 1):
            group, lengths = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            seq, off = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
            bounds = runs(group)
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                where, off[a:b] = best_fit_decreasing(lengths[a:b], window)
                seq[a:b] = (group[a:b] << 32) | where
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(seq), pa.array(off)], [*batch.schema.names[1:], "sequence_id", "offset"])

    return pack


def pack_documents(
    spark: SparkSession,
    docs: DataFrame,
    vocabulary: str = VOCABULARY,
    window: int = WINDOW,
    end_id: int = END_ID,
    with_ids: bool = True,
    group_pieces: int = GROUP_PIECES,
    group_ids: int = GROUP_IDS,
) -> DataFrame:
    """Pack ``docs`` (doc_id, text; more columns are left out) into windows.

    A document is its ids by ``vocabulary`` and then ``end_id``. One longer than
    a window is first cut into full windows and a rest; pieces are then placed
    longest first into the open window with the least room that takes them.
    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset and, with ``with_ids``, the piece's ids as little-endian
    unsigned 32-bit integers.

    The ids are made in one map over the texts; only the pieces are dealt out,
    by a hash of their place in the written table, into groups of about
    ``group_pieces`` (and ``group_ids``, with ids) that are packed apart. So a hot
    source, a repeated row or very many equal lengths load no task more than
    another, and what a task holds doesn't grow with the corpus. Each group
    leaves at most a few windows part empty.

    Null and empty texts are the end id alone. A null doc_id is kept, repeated
    rows are packed each for itself, and an empty table gives no rows. A text is
    held in memory whole by the task that encodes it.
    """
    scratch = Scratch(spark, "packing")
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_cutter(vocabulary, window, end_id, with_ids), PIECES)
    pieces = scratch.table(cut, "pieces")
    n, ids = pieces.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    groups = max(1, -(-n // group_pieces), -(-ids // group_ids) if with_ids else 1)
    columns = PIECES.names if with_ids else PIECES.names[:-1]
    dealt = (
        pieces.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).alias("g"), *columns)
        .repartition(min(groups, MOST_PARTS), "g")
        .sortWithinPartitions("g", F.desc("length"))
    )
    schema = T.StructType([f for f in PIECES if f.name in columns] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return dealt.mapInArrow(_packer(window), schema)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents with the window and offset each is packed at."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(spark, docs, with_ids=False)
