"""Near-duplicate vectors by a subspace pigeonhole join."""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Forest, Scratch, block_tasks, bounded_broadcast, grouped_batches, runs
from .components import connected_components

COSINE = 0.98
BLOCKS = 8
#: Rows of a cell that one slice of a task holds.
TASK_ROWS = 32_768
#: Pairs of rows compared at a time within a task.
PAIRS = 1 << 20
#: Dimensions of a block that the grid inside a task cuts.
FINE = 5
_SLACK = 1e-9


def rotation(dims: int) -> np.ndarray:
    """A fixed random rotation, so that no subspace is special in the data."""
    q, r = np.linalg.qr(np.random.default_rng(64).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


class Subspaces:
    """Low-dimensional blocks of the rotated space, and the range join in each.

    Unit vectors of cosine >= c are within the squared distance 2 - 2c, so at
    least one of B blocks of their coordinates is within (2 - 2c) / B. Rows are
    dealt out by coarse cells, four radii wide, in the first ``grid`` dimensions
    of a block (none of them while a label fits a task); within a task a fine
    grid, one radius wide, in up to ``FINE`` dimensions proposes the pairs.
    """

    def __init__(self, dims: int, cosine: float, blocks: int, grid: int):
        self.dims, self.cosine = dims, cosine
        self.turn = rotation(dims)
        self.spans = np.array_split(np.arange(dims), min(blocks, dims))
        self.budget = max(2 - 2 * cosine, 0.0) / len(self.spans) + _SLACK
        self.radius = math.sqrt(self.budget)
        self.width = 4 * max(self.radius, 1e-3)
        #: Cells a dimension that unit vectors can lie in, with one beyond each end.
        self.cells_a_side = 2 * math.ceil(1 / self.width) + 3
        self.grid = min(grid, int(62 / math.log2(self.cells_a_side)))

    def turned(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ self.turn

    def cells(self, turned: np.ndarray):
        """Yield (rows, block, cell, home) arrays: each row once at home in every
        block, and once in each neighbouring cell past its own that it is near
        to, so that rows of two cells meet in the later of the two alone. A
        cell's number has a digit a dimension and can't wrap."""
        for b, span in enumerate(self.spans):
            at = turned[:, span[: self.grid]]
            home = np.floor(at / self.width).astype(np.int64)
            inside = at - home * self.width
            low, high = inside <= self.radius, inside >= self.width - self.radius
            digits = self.cells_a_side ** np.arange(at.shape[1] - 1, -1, -1, dtype=np.int64)
            number = (home + self.cells_a_side // 2) @ digits
            for step in product((-1, 0, 1), repeat=at.shape[1]):
                first = next((x for x in step if x), 0)
                if first < 0:
                    continue
                near = np.ones(len(at), bool)
                for d, s in enumerate(step):
                    near &= low[:, d] if s < 0 else high[:, d] if s > 0 else True
                rows = np.flatnonzero(near)
                yield rows, b, number[rows] + int(np.array(step, np.int64) @ digits), first == 0

    def pairs(self, turned: np.ndarray, block: int, tested: list | None = None):
        """Yield (i, j) arrays, i != j, of each pair of rows that is close in this
        block and in none before it, so that every pair has one block.

        Rows are sorted by their fine cell; each cell meets itself and the
        neighbours on one side. ``tested`` is told how many pairs were compared.
        """
        part = turned[:, self.spans[block]]
        width = max(self.radius, 1e-3)
        fine = np.floor(part[:, :FINE] / width).astype(np.int64) + 2048
        digits = 4096 ** np.arange(fine.shape[1] - 1, -1, -1, dtype=np.int64)
        order = np.argsort(fine @ digits, kind="stable")
        cell, first, size = np.unique((fine @ digits)[order], return_index=True, return_counts=True)
        for step in product((-1, 0, 1), repeat=fine.shape[1]):
            lead = next((x for x in step if x), 0)
            if lead < 0:
                continue
            want = cell + int(np.array(step, np.int64) @ digits)
            at = np.minimum(np.searchsorted(cell, want), len(cell) - 1)
            a = np.flatnonzero(cell[at] == want)
            b = at[a]
            for x, y in _expand(first[a], size[a], first[b], size[b]):
                if not lead:
                    x, y = x[x < y], y[x < y]
                i, j = order[x], order[y]
                if tested is not None:
                    tested.append(len(i))
                for d in range(part.shape[1] - 1, -1, -1):  # a dimension at a time: most pairs go early
                    stay = np.abs(part[i, d] - part[j, d]) <= self.radius
                    i, j = i[stay], j[stay]
                # Summed alike whichever row comes first, so all tasks agree on the block.
                gaps = np.stack([((turned[i][:, s] - turned[j][:, s]) ** 2).sum(axis=1) for s in self.spans[: block + 1]], axis=1)
                own = (gaps[:, block] <= self.budget) & ~(gaps[:, :block] <= self.budget).any(axis=1)
                if own.any():
                    yield i[own], j[own]


def _expand(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray):
    """Yield all pairs of places of the runs (a, na) and (b, nb), run by run, about
    ``PAIRS`` at a time; a run too long for that is cut."""
    rows = np.repeat(a, na) + np.arange(na.sum()) - np.repeat(np.cumsum(na) - na, na)
    start, many = np.repeat(b, na), np.repeat(nb, na)
    ends = np.cumsum(many)
    at = 0
    while at < len(rows):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        n = many[at:upto]
        total = int(n.sum())
        yield np.repeat(rows[at:upto], n), np.repeat(start[at:upto] - np.cumsum(n) + n, n) + np.arange(total)
        at = upto


def _matrix(raw: pa.Array, dims: int) -> np.ndarray:
    """Binary rows of ``dims`` single-precision numbers as a matrix of doubles."""
    raw = pa.concat_arrays([raw]) if raw.offset else raw
    at = np.frombuffer(raw.buffers()[1], np.int32, len(raw) + 1, raw.offset * 4)
    return np.frombuffer(raw.buffers()[2], np.uint8)[at[0] : at[-1]].view(np.float32).reshape(-1, dims).astype(np.float64)


def _packed(batches):
    """Rows (vec, label, copies, e) with each array as its bytes."""
    for batch in batches:
        e = batch.column(3)
        at = e.offsets.to_numpy().astype(np.int64)
        values = np.ascontiguousarray(e.flatten().to_numpy(zero_copy_only=False), np.float32)
        if 4 * len(values) >= 1 << 31:
            raise ValueError("a batch of vectors is over 2 GB; lower spark.sql.execution.arrow.maxRecordsPerBatch")
        raw = pa.Array.from_buffers(pa.binary(), len(e), [None, pa.py_buffer(((at - at[0]) * 4).astype(np.int32)), pa.py_buffer(values)])
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], raw], ["vec", "label", "copies", "raw"])


def _dealer(cosine: float, blocks: int, grid: int, with_rows: bool):
    """Rows (label, dims, block, cell, home, vec, copies, raw), or the first four alone."""

    def deal(batches):
        spaces: dict[int, Subspaces] = {}
        for batch in batches:
            vec, label, copies = (batch.column(i).to_numpy() for i in range(3))
            raw = batch.column(3)
            sizes = pc.binary_length(raw).to_numpy() // 4
            for dims in np.unique(sizes).tolist():
                pick = np.flatnonzero(sizes == dims)
                space = spaces.setdefault(dims, Subspaces(dims, cosine, blocks, grid))
                own = _matrix(raw.take(pa.array(pick)), dims)
                for rows, b, cell, home in space.cells(space.turned(own)):
                    if len(rows):
                        n, at = len(rows), pick[rows]
                        columns = [pa.array(label[at]), pa.array(np.full(n, dims, np.int64)), pa.array(np.full(n, b, np.int64)), pa.array(cell)]
                        if with_rows:
                            columns += [pa.array(np.full(n, home)), pa.array(vec[at]), pa.array(copies[at]), raw.take(pa.array(at))]
                        yield pa.RecordBatch.from_arrays(columns, ["label", "dims", "block", "cell", "home", "vec", "copies", "raw"][: len(columns)])

    return deal


def _joiner(cosine: float, blocks: int, grid: int):
    """Links of each vector, and spanning edges, of the pairs found in each task."""

    def join(batches):
        spaces: dict[int, Subspaces] = {}
        for batch in grouped_batches(batches, 6):
            keys = [batch.column(i).to_numpy() for i in range(6)]
            own, home, vec, copies = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6, 10))
            raw = batch.column(10)
            bounds = runs(*keys)
            ids, linked, ea, eb = [], [], [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                dims, block, across = int(keys[1][a]), int(keys[2][a]), keys[4][a] != keys[5][a]
                space = spaces.setdefault(dims, Subspaces(dims, cosine, blocks, grid))
                full = _matrix(raw.slice(a, b - a), dims)
                norm, part, at_home = np.linalg.norm(full, axis=1), own[a:b], home[a:b].astype(bool)
                count, forest = np.zeros(b - a, np.int64), Forest(b - a)
                for p, q in space.pairs(space.turned(full), block):
                    # Of a cell's visitors, none with one another; of two slices, pairs across;
                    # of repeated vec_ids, none, as they are one vector.
                    meet = (at_home[p] | at_home[q]) & (vec[a + p] != vec[a + q])
                    if across:
                        meet &= part[p] != part[q]
                    p, q = p[meet], q[meet]
                    true = (full[p] * full[q]).sum(axis=1) / (norm[p] * norm[q]) >= cosine
                    p, q = p[true], q[true]
                    np.add.at(count, p, copies[a + q])
                    np.add.at(count, q, copies[a + p])
                    forest.link(p, q)
                some = np.flatnonzero(count)
                ids += vec[a + some].tolist()
                linked += count[some].tolist()
                x, y = forest.edges()
                ea += vec[a + x].tolist()
                eb += vec[a + y].tolist()
            n, m = len(ids), len(ea)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids + ea, pa.int64()), pa.array([None] * n + eb, pa.int64()), pa.array(linked + [None] * m, pa.int64())],
                ["a", "b", "links"],
            )

    return join


def near_vectors(spark: SparkSession, vectors: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS) -> DataFrame:
    """vec_id, n_links, component_id and kept of ``vectors`` (vec_id, embedding, label).

    Vectors of one label are linked if their cosine in double precision is at
    least ``cosine`` (a tie with it links). Vectors that are null, empty, zero or
    hold null or non-finite components, or whose label or vec_id is null, link
    with nothing; vectors of different lengths never link.

    Equal vectors of a label are one class with a number of copies, so masses of
    copies cost one row a map task. Classes are rotated and cut into low
    -dimensional blocks; each block is range-joined under its share of the
    squared distance, and the pairs found are tested exactly in the same task
    (see ``Subspaces``). A pair counts in the first block it is close in. A row
    goes out once a block while the largest label fits ``TASK_ROWS``; coarse
    grid dimensions are added as it grows, and cells of more rows are dealt out
    in pairs of slices. Tasks give numbers of links and a spanning set of them,
    not all pairs.

    Rows with one vec_id are one vector: each is returned, with the sum of links
    and the component of all. Null vec_ids are returned with no links and no
    component, and are kept. Further columns are ignored; no rows give none. A
    very long vector is one row like another.
    """
    scratch = Scratch(spark, "vectors")
    read = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<float>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("e", lambda x: x != 0)
    usable = read.where("vec_id is not null and label is not null and e is not null").where(F.coalesce(finite, F.lit(False)))
    # Adding zero makes both zeros one, so that equal vectors have equal bytes.
    usable = usable.select("vec_id", "label", F.transform("e", lambda x: x + F.lit(0).cast("float")).alias("e"))
    key = F.struct(F.xxhash64("e"), F.xxhash64(F.lit(1), "e"))  # 128 bits tell arrays apart
    classes = scratch.table(usable.groupBy("label", "e").agg(F.min("vec_id").alias("vec"), F.count("*").alias("copies")), "classes")
    copied = classes.where("copies > 1").select("label", key.alias("key"), "vec")
    members = scratch.table(usable.select("vec_id", "label", key.alias("key")).join(copied, ["label", "key"]).select("vec_id", "vec"), "members")
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    grid = 0 if most <= TASK_ROWS else min(8, math.ceil(math.log2(most / TASK_ROWS)))

    packed = classes.select("vec", "label", "copies", "e").mapInArrow(_packed, "vec long, label long, copies long, raw binary")
    by = ["label", "dims", "block", "cell"]
    dealt = packed.mapInArrow(_dealer(cosine, blocks, grid, True), "label long, dims long, block long, cell long, home boolean, vec long, copies long, raw binary")
    if grid:
        counted = packed.mapInArrow(_dealer(cosine, blocks, grid, False), "label long, dims long, block long, cell long")
        crowded = scratch.table(counted.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > TASK_ROWS), "crowded")
        sized = dealt.join(bounded_broadcast(spark, crowded, crowded.count()), by, "left").withColumn("n", F.coalesce("n", F.lit(1)))
    else:
        sized = dealt.withColumn("n", F.lit(1))
    tasks = block_tasks(sized, "n", TASK_ROWS, "vec", by).select(*by, "bi", "bj", "own", "home", "vec", "copies", "raw")
    found = scratch.table(tasks.mapInArrow(_joiner(cosine, blocks, grid), "a long, b long, links long"), "found")
    counts = found.where("links is not null").groupBy(F.col("a").alias("vec")).agg(F.sum("links").alias("links"))
    edges = found.where("b is not null").select("a", "b").unionByName(members.select(F.col("vec_id").alias("a"), F.col("vec").alias("b")))
    comps = connected_components(spark, edges, scratch).withColumnRenamed("node", "vec_id")
    of_class = classes.select("vec", "copies").join(counts, "vec", "left").groupBy("vec").agg(F.sum(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"))
    class_of = members.unionByName(classes.where("copies = 1").select(F.col("vec").alias("vec_id"), "vec"))
    links = class_of.join(of_class, "vec").groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    out = read.select("vec_id").join(links, "vec_id", "left").join(comps, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors of a label at cosine 0.98."""
    return near_vectors(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
