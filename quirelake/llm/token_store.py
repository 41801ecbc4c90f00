"""Token shards as wavelet matrices: one compressed, searchable blob a shard."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch
from .encoders import MEMO_ENTRIES, chunk_encoder

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
#: A shard is closed at the first document that takes it to so many ids.
SHARD_IDS = 2_000_000
#: Bytes of the input's files that one range of documents holds, about.
RANGE_BYTES = 12 << 20
_HEAD = struct.Struct("<4sHHQI")
#: Bytes of a bit-plane that are compressed together and have a rank sample each.
BLOCK = 4096


class WaveletMatrix:
    """Succinct sequence of ids: one bit-plane a binary digit, highest first.

    Each plane holds the current digit of the ids in the order that the higher
    digits have sorted them into (stably, zeros first). A plane is kept in
    blocks, with the number of one-bits before each (the rank samples). Both are
    in the file: ``rank`` reads a sample and one block, ``select`` finds its block
    among the samples and reads that one. So ``access``, ``count`` and ``find``
    walk the planes once and, on a matrix read from a file, undo the compression
    of two blocks a plane at most, not of the shard.
    """

    def __init__(self, n: int, zeros: list[int], samples: list[np.ndarray], block):
        self.n, self.zeros, self.samples = n, zeros, samples
        #: Gives the bytes of block k of a plane.
        self.block = block

    @classmethod
    def build(cls, ids: np.ndarray, bits: int | None = None) -> WaveletMatrix:
        ids = np.ascontiguousarray(ids)
        bits = bits or max(1, int(ids.max(initial=0)).bit_length())
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros = [], []
        for digit in range(bits - 1, -1, -1):
            ones = ((now >> digit) & 1).astype(bool)
            planes.append(np.packbits(ones, bitorder="little"))
            low = np.compress(~ones, now)  # several times faster than a mask on digits without a pattern
            zeros.append(len(low))
            now = np.concatenate([low, np.compress(ones, now)])
        samples = []
        for plane in planes:
            counts = np.add.reduceat(np.bitwise_count(plane).astype(np.int64), np.arange(0, len(plane), BLOCK)) if len(plane) else np.zeros(0, np.int64)
            samples.append(np.concatenate([[0], np.cumsum(counts)]).astype(np.int64))
        return cls(len(ids), zeros, samples, lambda level, k: planes[level][k * BLOCK : (k + 1) * BLOCK])

    def _plane(self, level: int) -> np.ndarray:
        parts = [self.block(level, k) for k in range(len(self.samples[level]) - 1)]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint8)

    def decode(self) -> np.ndarray:
        """All ids, by undoing each plane's partition from the lowest digit up."""
        kind = np.uint16 if len(self.zeros) <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for digit, zeros in enumerate(reversed(self.zeros)):
            ones = np.unpackbits(self._plane(len(self.zeros) - 1 - digit), count=self.n, bitorder="little").view(bool)
            now[zeros:] |= kind(1 << digit)
            before = np.empty(self.n, kind)
            before[np.concatenate([np.flatnonzero(~ones), np.flatnonzero(ones)])] = now
            now = before
        return now

    def _rank(self, level: int, at: int) -> int:
        """One-bits of a plane before position ``at``."""
        k, rest = divmod(at, 8 * BLOCK)
        ones = int(self.samples[level][k])
        if rest:
            raw = self.block(level, k)[: (rest + 7) // 8]
            ones += int(np.bitwise_count(raw[: rest // 8]).sum())
            if rest & 7:
                ones += (int(raw[-1]) & ((1 << (rest & 7)) - 1)).bit_count()
        return ones

    def _bit(self, level: int, at: int) -> int:
        k, rest = divmod(at, 8 * BLOCK)
        return int(self.block(level, k)[rest >> 3] >> (rest & 7)) & 1

    def access(self, at: int) -> int:
        """The id at a position."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit, ones = self._bit(level, at), self._rank(level, at)
            value = value << 1 | bit
            at = zeros + ones if bit else at - ones
        return value

    def _span(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        for level, zeros in enumerate(self.zeros):
            a, b = self._rank(level, lo), self._rank(level, hi)
            lo, hi = (zeros + a, zeros + b) if value >> (len(self.zeros) - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of an id in [lo, hi)."""
        if value < 0 or value >> len(self.zeros):
            return 0
        a, b = self._span(value, lo, self.n if hi is None else hi)
        return b - a

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) digit ``bit`` of a plane."""
        before = self.samples[level]
        if not bit:
            before = np.minimum(np.arange(len(before)) * 8 * BLOCK, self.n) - before
        at = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self.block(level, at), bitorder="little")[: self.n - at * 8 * BLOCK]
        return at * 8 * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[at])])

    def find(self, value: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of an id."""
        if not 0 <= k < self.count(value):
            raise IndexError(k)
        lo, _ = self._span(value, 0, 0)
        at = lo + k
        for level in range(len(self.zeros) - 1, -1, -1):
            bit = value >> (len(self.zeros) - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def to_bytes(self) -> bytes:
        """Head (magic, version, planes, ids, block size), zeros of each plane, then of
        each plane its rank samples and its blocks' ends, then the blocks by zstd."""
        codec = pa.Codec("zstd", compression_level=1)
        packed = [[codec.compress(self.block(level, k).tobytes(), asbytes=True) for k in range(len(s) - 1)] for level, s in enumerate(self.samples)]
        ends = np.cumsum([len(x) for plane in packed for x in plane]).astype("<u8")
        head = _HEAD.pack(b"QLWM", 2, len(self.zeros), self.n, BLOCK)
        samples = np.concatenate([s.astype("<u8") for s in self.samples]) if self.samples else np.zeros(0, "<u8")
        return b"".join([head, struct.pack(f"<{len(self.zeros)}Q", *self.zeros), samples.tobytes(), ends.tobytes(), *(x for plane in packed for x in plane)])

    @classmethod
    def from_bytes(cls, blob: bytes) -> WaveletMatrix:
        """A matrix over a file's bytes; a block is read when it is asked for."""
        magic, version, bits, n, size = _HEAD.unpack_from(blob) if len(blob) >= _HEAD.size else (b"", 0, 0, 0, 0)
        if (magic, version, size) != (b"QLWM", 2, BLOCK):
            raise ValueError("not a token shard")
        at, length = _HEAD.size, (n + 7) // 8
        zeros = list(struct.unpack_from(f"<{bits}Q", blob, at))
        blocks = -(-length // BLOCK)
        at += 8 * bits
        samples = np.frombuffer(blob, "<u8", bits * (blocks + 1), at).astype(np.int64).reshape(bits, blocks + 1)
        at += 8 * bits * (blocks + 1)
        ends = np.frombuffer(blob, "<u8", bits * blocks, at).astype(np.int64)
        at += 8 * bits * blocks
        codec, view = pa.Codec("zstd"), memoryview(blob)

        def block(level: int, k: int) -> np.ndarray:
            i = level * blocks + k
            raw = view[at + (int(ends[i - 1]) if i else 0) : at + int(ends[i])]
            return np.frombuffer(codec.decompress(raw, decompressed_size=min(BLOCK, length - k * BLOCK)), np.uint8)

        return cls(n, zeros, list(samples), block)


SHARDS = T.StructType(
    [
        T.StructField("part", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("base", T.LongType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("doc_ends", T.ArrayType(T.LongType())),
        T.StructField("blob", T.BinaryType()),
    ]
)
_SHARD_ARROW = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2 + [pa.binary()]


def _shard_writer(vocabulary: str, end_id: int, shard_ids: int):
    def write(batches):
        from pyspark import TaskContext

        encoder, part = chunk_encoder(vocabulary, 2 * MEMO_ENTRIES), TaskContext.get().partitionId()
        docs, held, size, seq, base = [], [], 0, 0, 0

        def shard():
            ids = np.concatenate(held)
            ends = np.cumsum([len(x) for x in held])
            row = (part, seq, base, len(ids), docs, ends, WaveletMatrix.build(ids).to_bytes())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _SHARD_ARROW, strict=True)], SHARDS.names)

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode_column(batch.column(1)), strict=True):
                docs.append(doc)
                held.append(np.append(ids, end_id).astype(encoder.dtype))
                size += len(held[-1])
                if size >= shard_ids:
                    yield shard()
                    docs, held, seq, base, size = [], [], seq + 1, base + size, 0
        if held:
            yield shard()

    return write


def write_token_shards(
    spark: SparkSession, docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, shard_ids: int = SHARD_IDS, range_bytes: int = RANGE_BYTES
) -> None:
    """Write the ids of ``docs`` (doc_id, text) as shards in ascending doc_id order.

    Documents are dealt out in doc_id ranges of about ``range_bytes``, encoded
    and closed into a shard every ``shard_ids`` ids, so a task holds one shard
    whatever the size of its range. A shard is a row (part, seq, base: ids
    before it in its part, n_ids, doc_ids, doc_ends, blob); Spark's committer
    publishes the files, so a lost executor leaves no half shard. Null texts are
    empty, a null doc_id comes first, repeated doc_ids follow each other by text.
    """
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(1, min(-(-size // range_bytes), 100_000))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    out = ordered.mapInArrow(_shard_writer(vocabulary, end_id, shard_ids), SHARDS)
    out.write.option("maxRecordsPerFile", 8).option("compression", "none").parquet(path)


def _decoder():
    def decode(batches):
        for batch in batches:
            for part, base, docs, ends, blob in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                ids = WaveletMatrix.from_bytes(blob).decode().astype("<u4")
                starts = [0, *ends[:-1]]
                sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
                n = len(docs)
                starts, ends = np.array(starts, np.int64), np.array(ends, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array([part] * n, pa.int64()), pa.array(starts + base), pa.array(ends - starts), pa.array(sums, pa.int64())], ["doc_id", "part", "in_part", "n_tokens", "ids_crc32"])

    return decode


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """Read shards back: doc_id, start, n_tokens and ids_crc32 of each document.

    The ids before a part come from one sum a part (as many as write tasks);
    they go to the driver as one small table and back as a join.
    """
    shards = spark.read.schema(SHARDS).parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    bases, at = [], 0
    for row in totals:
        bases.append((row["part"], at))
        at += row["n"]
    base = spark.createDataFrame(bases, "part long, part_base long")
    decoded = shards.select("part", "base", "doc_ids", "doc_ends", "blob").mapInArrow(_decoder(), "doc_id long, part long, in_part long, n_tokens long, ids_crc32 long")
    return decoded.join(F.broadcast(base), "part").select("doc_id", (F.col("part_base") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32")


def tokens_at(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """doc_id, place and token of each wanted (doc_id, place), read from the shards.

    Each shard's file is opened once for so many of the places in it, and only
    the blocks that these lead to are read. Places before a document's start or
    past its end, and documents that no shard has, give a null token; of rows of
    one doc_id each that has the place answers.
    """
    shards = spark.read.schema(SHARDS).parquet(path)
    held = shards.select("part", "seq", F.posexplode(F.arrays_zip("doc_ids", "doc_ends")).alias("k", "d"), "doc_ends")
    held = held.select("part", "seq", F.col("d.doc_ids").alias("doc_id"), F.when(F.col("k") > 0, F.get("doc_ends", F.col("k") - 1)).otherwise(0).alias("first"), F.col("d.doc_ends").alias("end"))
    asked = wanted.select("doc_id", F.col("place").cast("long").alias("place")).distinct()
    inside = asked.join(held, "doc_id").where("place >= 0 AND first + place < end").select("doc_id", "place", "part", "seq", (F.col("first") + F.col("place")).alias("at"))
    # No list of places is longer than a batch, whatever is asked of one shard.
    slices = inside.withColumn("slice", F.pmod(F.xxhash64("doc_id", "place"), F.lit(64))).groupBy("part", "seq", "slice").agg(F.collect_list(F.struct("doc_id", "place", "at")).alias("asked"))

    def read(batches):
        for batch in batches:
            for asked, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                matrix = WaveletMatrix.from_bytes(blob)
                rows = [(x["doc_id"], x["place"], matrix.access(x["at"])) for x in asked]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "place", "token"])

    found = slices.join(shards.select("part", "seq", "blob"), ["part", "seq"]).select("asked", "blob").mapInArrow(read, "doc_id long, place long, token long")
    return asked.join(found, ["doc_id", "place"], "left")


def _searcher(tokens: list[int], places: bool):
    def search(batches):
        for batch in batches:
            for part, seq, docs, ends, blob in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                matrix = WaveletMatrix.from_bytes(blob)
                for token in tokens:
                    n = matrix.count(token)
                    if not places:
                        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (part, seq, token, n)], ["part", "seq", "token", "n"])
                        continue
                    for low in range(0, n, 4096):
                        at = np.array([matrix.find(token, k) for k in range(low, min(n, low + 4096))], np.int64)
                        k = np.searchsorted(ends, at, "right")
                        first = np.array([0, *ends[:-1]], np.int64)[k]
                        yield pa.RecordBatch.from_arrays([pa.array([docs[i] for i in k], pa.int64()), pa.array(at - first), pa.array([token] * len(at), pa.int64())], ["doc_id", "place", "token"])

    return search


def token_occurrences(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """token and n: how often each of a few tokens stands in all shards, by rank alone."""
    shards = spark.read.schema(SHARDS).parquet(path).select("part", "seq", "doc_ids", "doc_ends", "blob")
    return shards.mapInArrow(_searcher(list(tokens), False), "part long, seq long, token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def find_tokens(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """doc_id, place and token of every occurrence of a few tokens, by select."""
    shards = spark.read.schema(SHARDS).parquet(path).select("part", "seq", "doc_ids", "doc_ends", "blob")
    return shards.mapInArrow(_searcher(list(tokens), True), "doc_id long, place long, token long")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as wavelet shards and report them as read back."""
    scratch = Scratch(spark, "shards")
    write_token_shards(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{scratch.root}/shards")
    return read_token_shards(spark, f"{scratch.root}/shards")
