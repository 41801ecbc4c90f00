"""Near-duplicate documents: a multi-index Hamming join over b-bit MinHash."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, binary_rows, grouped_batches, runs, splittable, worker_object
from .components import connected_components, spanning_links

#: Distinct words a worker remembers the hash of; bounds its memory only.
WORD_MEMO = 250_000
#: Rows of a bucket, and shingles of a group, that one block of a task holds.
BUCKET_BLOCK = 4096
GROUP_SHINGLES = 500_000
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


@dataclass(frozen=True)
class NearDup:
    """Shingle length, similarity (percent), signature and its chunks.

    A signature is ``positions`` MinHashes of 16 bits. It is cut into ``chunks``
    and each chunk may hold one error, so by pigeonhole every pair that differs
    in at most ``2 * chunks - 1`` positions agrees in all but one position of
    some chunk. With 13 chunks of 64 positions that is distance 25; a pair of
    similarity 0.85 is beyond it with a probability of about 5e-6, one of 0.9
    of 1e-10. 16 chunks (distance 31) give about 1e-6 at similarity 0.8.
    """

    shingle: int = 5
    percent: int = 80
    positions: int = 64
    chunks: int = 16

    @property
    def distance(self) -> int:
        return 2 * self.chunks - 1

    def spans(self) -> list[list[int]]:
        return [list(map(int, x)) for x in np.array_split(np.arange(self.positions), self.chunks)]

    def seeds(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(20_240_501)
        return rng.integers(1, 2**63, self.positions, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, self.positions, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sorted distinct 64-bit shingle hashes of a text's words."""

    def __init__(self, size: int):
        self.size = size
        self.memo: dict[bytes, int] = {}

    def words(self, text: bytes) -> list[bytes]:
        """ASCII-lower-cased words between ASCII white space."""
        return text.lower().split()

    def __call__(self, text: bytes) -> np.ndarray:
        words = self.words(text)
        memo = self.memo
        new = [w for w in words if w not in memo]
        if new:
            if len(memo) + len(new) > WORD_MEMO:
                memo.clear()
                new = words
            for w in new:
                memo[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        n = len(words)
        hashes = np.fromiter(map(memo.__getitem__, words), np.uint64, n)
        if len(memo) > WORD_MEMO:  # one text with very many words
            memo.clear()
        if not n:
            return hashes
        size = min(self.size, n)
        out = np.full(n - size + 1, size, np.uint64)
        for k in range(size):
            out = _mix(out * _M3 + hashes[k : n - size + 1 + k])
        return np.unique(out)


def shingler(size: int) -> Shingler:
    """The worker's shingler."""
    return worker_object("shingles", size, lambda: Shingler(size))


def signature(shingles: np.ndarray, seeds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The low 16 bits of the least hash of a non-empty set under each seed."""
    a, b = seeds
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        x = shingles[at : at + 2048, None] * a + b
        x ^= x >> np.uint64(31)
        low = np.minimum(low, x.min(axis=0))
    return ((low * _M1) >> np.uint64(48)).astype(np.uint16)


def chunk_keys(signatures: np.ndarray, spec: NearDup) -> np.ndarray:
    """Keys of every chunk with each one of its positions left out (or none of
    them, where a chunk is a single position): rows of 64-bit hashes."""
    wide = signatures.astype(np.uint64)
    keys = []
    for c, span in enumerate(spec.spans()):
        for left in span:
            key = np.full(len(wide), np.uint64(c * 1000 + left + 1))
            for p in span:
                if p != left:
                    key = _mix(key * _M3 + wide[:, p] + np.uint64(1))
            keys.append(key)
    return np.stack(keys, axis=1).view(np.int64)


def _profiler(spec: NearDup):
    def profile(batches):
        make, seeds = shingler(spec.shingle), spec.seeds()
        for batch in batches:
            n = batch.num_rows
            sizes, hashes = np.zeros(n, np.int64), [None] * n
            sigs = np.zeros((n, spec.positions), np.uint16)
            for i, text in enumerate(batch.column(1).cast(pa.large_binary()).to_pylist()):
                found = make(text or b"")
                sizes[i] = len(found)
                if len(found):
                    hashes[i] = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                    sigs[i] = signature(found, seeds)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(hashes, pa.binary()), binary_rows(sigs)], ["doc_id", "n_shingles", "set_hash", "sig"])

    return profile


def _keyer(spec: NearDup):
    def keys(batches):
        for batch in batches:
            sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, spec.positions)
            for at in range(0, len(sigs), 4096):
                part = chunk_keys(sigs[at : at + 4096], spec)
                docs = np.repeat(batch.column(0).to_numpy()[at : at + 4096], part.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(part.ravel()), pa.array(docs)], ["key", "doc"])

    return keys


def _merge_all(known: np.ndarray, near) -> list[tuple[int, int]]:
    """Links that connect rows as all links that ``near(i, others)`` tests would;
    rows of one value of ``known`` are connected already.

    Each row is compared with the rows outside its component so far, so a group
    of mutual near copies costs a pass or two, and only rows that stay apart are
    all compared with one another. Components, hence the links, are exact.
    """
    label = np.unique(known, return_inverse=True)[1]
    out = []
    for i in range(len(label)):
        others = np.flatnonzero(label != label[i])
        if not len(others):
            break
        hit = others[near(i, others)]
        for j in hit[np.unique(label[hit], return_index=True)[1]]:
            out.append((i, int(j)))
        if len(hit):
            label[np.isin(label, label[hit])] = label[i]
    return out


def _edges(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*rows, strict=True) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _bucket_joiner(spec: NearDup):
    """Spanning edges of the pairs within the signature distance in each bucket."""

    def join(batches):
        for batch in grouped_batches(batches, 3):
            docs = batch.column(3).to_numpy()
            sigs = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint16).reshape(-1, spec.positions)
            known = batch.column(5).to_numpy()
            bounds = runs(*(batch.column(i).to_numpy() for i in range(3)))
            first, size = bounds[:-1], np.diff(bounds)
            out = []
            two = first[size == 2]
            if len(two):
                close = np.concatenate([(sigs[x] != sigs[x + 1]).sum(axis=1) <= spec.distance for x in np.array_split(two, len(two) // 8192 + 1)])
                out.extend(zip(docs[two[close]].tolist(), docs[two[close] + 1].tolist(), strict=True))
            for a, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                own = sigs[a : a + n]
                for i, j in _merge_all(known[a : a + n], lambda i, others, own=own: (own[others] != own[i]).sum(axis=1) <= spec.distance):
                    out.append((int(docs[a + i]), int(docs[a + j])))
            yield _edges(out)

    return join


def _verifier(spec: NearDup):
    """Spanning edges of the links on full sets in each block task of a group."""

    def verify(batches):
        for batch in grouped_batches(batches, 3):
            docs, known = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            bounds = runs(*(batch.column(i).to_numpy() for i in range(3)))
            out = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                sets = [np.frombuffer(x, np.uint64) for x in batch.column(4).slice(a, b - a).to_pylist()]
                sizes = np.array([len(s) for s in sets])
                every, codes = np.unique(np.concatenate(sets), return_inverse=True)
                starts = np.cumsum(sizes) - sizes
                coded = np.split(codes, starts[1:])
                mark = np.zeros(len(every), bool)

                def near(i, others, coded=coded, sizes=sizes, mark=mark):
                    low, high = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
                    hit = np.zeros(len(others), bool)
                    able = np.flatnonzero(100 * low >= spec.percent * high)
                    if not len(able):
                        return hit
                    mark[coded[i]] = True
                    own = [coded[j] for j in others[able]]
                    n = sizes[others[able]]
                    both = np.add.reduceat(mark[np.concatenate(own)].astype(np.int64), np.cumsum(n) - n)
                    mark[coded[i]] = False
                    hit[able] = 100 * both >= spec.percent * (n + sizes[i] - both)
                    return hit

                out.extend((int(docs[a + i]), int(docs[a + j])) for i, j in _merge_all(known[a:b], near))
            yield _edges(out)

    return verify


def _set_reader(spec: NearDup):
    """Shingle sets of the representatives among rows (doc_id, text, rep fields)."""

    def read(batches):
        make = shingler(spec.shingle)
        for batch in batches:
            rows = []
            for doc, text, group, want, mass in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), *(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                raw = make(text or b"").tobytes()
                if hashlib.blake2b(raw, digest_size=16).digest() == want:
                    rows.append((group, mass, doc, raw))
            g, m, d, s = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(m, pa.int64()), pa.array(d, pa.int64()), pa.array(s, pa.binary())], ["g", "mass", "doc", "shingles"])

    return read


def near_duplicates(spark: SparkSession, docs: DataFrame, spec: NearDup = NearDup()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of ``docs`` (doc_id, text).

    Two documents are linked if the Jaccard similarity of their shingle sets is
    at least ``spec.percent`` / 100; a component is named after its smallest
    doc_id, which is the one kept.

    1. One map gives each text's set size, a hash of its set and its signature.
    2. Documents with equal sets are one class, kept by its smallest doc_id; the
       aggregate combines on the map side, so masses of copies cost one row a task.
    3. Multi-index Hamming join: every chunk of a signature with one position
       left out is a key. Keys are counted first; only rows of keys that occur
       twice or more carry signatures into buckets. A bucket gives a spanning
       forest of its pairs within the guaranteed distance, never all pairs; one
       of more than ``BUCKET_BLOCK`` rows is dealt out in blocks (see
       ``spanning_links``).
    4. Components of that forest are groups of candidates. Texts of these alone
       are read again, and every pair of a group not yet connected is tested on
       its full sets, in tasks of bounded mass (blocks for large groups).
    5. Components over the links found, joined back to all documents.

    Null and empty texts have no shingles and are linked with nothing. Rows with
    one doc_id are one document: each row is returned with its own n_shingles and
    their component. A null doc_id is linked with nothing, has no component, and
    is kept. Further columns are ignored; no rows give none.
    """
    scratch = Scratch(spark, "minhash")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = scratch.table(texts.mapInArrow(_profiler(spec), "doc_id long, n_shingles long, set_hash binary, sig binary"), "profiles")
    usable = rows.where("doc_id is not null and set_hash is not null")
    classes = scratch.table(usable.groupBy("set_hash").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.count("*").alias("copies")), "classes")
    keys = classes.select("doc", "sig").mapInArrow(_keyer(spec), "key long, doc long")
    keys = scratch.table(keys, "keys")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = scratch.table(keys.join(splittable(shared), "key"), "members")
    most = members.agg(F.max("n")).first()[0]
    bucket = members.join(classes.select("doc", "sig"), "doc")
    near = spanning_links(spark, scratch, bucket, ["key"], "doc", "sig", "n", F.lit(1), BUCKET_BLOCK, most, _bucket_joiner(spec))
    groups = connected_components(spark, near, scratch)
    scratch.drop(keys, members)
    sized = scratch.table(groups.join(classes.select(F.col("doc").alias("node"), "n_shingles", "set_hash"), "node"), "groups")
    mass = scratch.table(sized.groupBy("component").agg(F.sum("n_shingles").alias("mass")), "mass")
    most = mass.agg(F.max("mass")).first()[0]
    wanted = sized.join(mass, "component").select(F.col("node").alias("doc_id"), F.col("component").alias("g"), "set_hash", "mass")
    # A merge join at every size, so that figures at one size tell of others.
    sets = texts.join(wanted.hint("merge"), "doc_id").select("doc_id", "text", "g", "set_hash", "mass").mapInArrow(_set_reader(spec), "g long, mass long, doc long, shingles binary")
    links = spanning_links(spark, scratch, sets, ["g"], "doc", "shingles", "mass", F.length("shingles") / 8, GROUP_SHINGLES, most, _verifier(spec))
    # Rows of a class point to its representative; those edges are links too.
    own = usable.join(classes.where("copies > 1").select("set_hash", "doc"), "set_hash").select(F.col("doc_id").alias("a"), F.col("doc").alias("b"))
    found = connected_components(spark, links.unionByName(own), scratch)
    out = rows.select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 3-word shingles, 85 percent."""
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), NearDup(shingle=3, percent=85, chunks=13))
