"""Near duplicates of vectors, documents and lines against plain versions."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from compare import differences, run_sql
from pyspark.sql import functions as F

from quirelake.llm import embedding_dedup, line_dedup, minhash_dedup
from quirelake.llm.common import Forest, Scratch, grouped_batches, runs
from quirelake.llm.components import connected_components, spanning_links
from quirelake.llm.embedding_dedup import Subspaces, near_vectors
from quirelake.llm.line_dedup import LineRules, drop_recurring_lines
from quirelake.llm.minhash_dedup import NearDup, Shingler, _merge_all, chunk_keys, near_duplicates, signature
from quirelake.llm.queries import ORACLE_SQL, QUERIES

WORDS = [f"w{i}" for i in range(400)]


@pytest.mark.parametrize("name", ["op1_embedding_dedup", "op3_minhash_dedup"])
def test_query_gives_what_sql_gives(spark, sf_dir, name):
    assert not differences(QUERIES[name](spark, sf_dir).toArrow(), run_sql(sf_dir, ORACLE_SQL[name]))


def test_components_of_paths_stars_and_noise(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(rng.randint(1000, 1100), rng.randint(1000, 1100)) for _ in range(60)]
    rng.shuffle(links)
    edges = spark.createDataFrame([*links, (7, 7), (None, 8), (9, None)], "a long, b long")
    got = {r.node: r.component for r in connected_components(spark, edges, Scratch(spark, "test")).collect()}
    links = [(a, b) for a, b in links if a != b]
    assert got == brute.components({x for e in links for x in e}, links)
    assert connected_components(spark, edges.limit(0), Scratch(spark, "test")).count() == 0


@pytest.mark.parametrize("apart", [0, 30])
def test_a_mass_of_near_copies_moves_a_few_times_its_rows(spark, apart):
    """20,000 rows that all link, and some that link with a tenth of them, in blocks of 100."""
    seen = spark.sparkContext.accumulator(0)

    def joiner(batches):
        for batch in grouped_batches(batches, 3):
            seen.add(batch.num_rows)
            ids, kind, known = batch.column(3).to_numpy(), batch.column(4).to_numpy(), batch.column(5).to_numpy()
            bounds, out = runs(*(batch.column(i).to_numpy() for i in range(3))), []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                own = kind[a:b]
                out += [(int(ids[a + i]), int(ids[a + j])) for i, j in _merge_all(known[a:b], lambda i, others, own=own: (own[others] == own[i]) | ((own[others] + own[i]) % 1000 == 7))]
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    n = 20_000
    rows = spark.range(n).selectExpr("1L AS g", "id", f"CASE WHEN id < {apart} THEN id * 2 + 10 ELSE 0 END AS kind", f"{n}L AS size").unionAll(spark.sql("SELECT 2L, 50000L, 997L, 1L"))
    links = spanning_links(spark, Scratch(spark, "test"), rows, ["g"], "id", "kind", "size", F.lit(1), 100, n, joiner)
    got = {r.node: r.component for r in connected_components(spark, links, Scratch(spark, "test")).collect()}
    assert all(got[i] == apart for i in range(apart, n)) and not set(got) & set(range(apart)) and 50000 not in got
    assert seen.value < 6 * n


def test_forest():
    f = Forest(6)
    f.link(np.array([5, 4, 1]), np.array([4, 3, 0]))
    rows, roots = f.edges()
    assert dict(zip(rows.tolist(), roots.tolist(), strict=True)) == {1: 0, 4: 3, 5: 3}


def vectors_near(rng, n_groups, size, dims=16):
    """Groups of vectors at a cosine of about the threshold to their centre."""
    out = []
    for g in range(n_groups):
        centre = rng.standard_normal(dims)
        for k in range(size):
            out.append((centre + rng.standard_normal(dims) * (0.02 + 0.03 * (k % 5))).tolist())
    return out


@pytest.mark.parametrize("blocks,task_rows", [(4, 2048), (3, 4)])
def test_vectors(spark, monkeypatch, blocks, task_rows):
    monkeypatch.setattr(embedding_dedup, "TASK_ROWS", task_rows)
    rng = np.random.default_rng(9)
    vectors = vectors_near(rng, 6, 12)
    rows = [(i, v, i % 2) for i, v in enumerate(vectors)] + [(200 + i, vectors[i], i % 2) for i in range(5)]
    nan, inf = float("nan"), float("inf")
    rows += [(300, None, 0), (301, [], 0), (302, [0.0] * 16, 0), (303, [nan] * 16, 0), (304, [inf] + [1.0] * 15, 0), (305, [None] + [1.0] * 15, 0), (306, vectors[0], None), (307, vectors[0][:8], 0), (308, [3 * x for x in vectors[0]], 0)]
    df = spark.createDataFrame([(*r, *"abcdefghijk") for r in rows], "vec_id long, embedding array<float>, label int, kept string, cell string, vec string, e string, key string, copies string, n string, own string, bi string, links string, node string")
    got = near_vectors(spark, df, blocks=blocks).collect()
    expect = brute.near_vectors(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == expect and len(got) == len(rows)
    assert sum(n > 0 for n, _ in expect.values()) > 20 and all(r.kept == (r.component_id == r.vec_id) for r in got)


def test_vectors_without_rows_and_with_null_ids(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert near_vectors(spark, spark.createDataFrame([], schema)).count() == 0
    got = near_vectors(spark, spark.createDataFrame([(None, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (1, [2.0, 4.0], 0), (None, None, None)], schema)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=repr) == sorted([(None, 0, None, True)] * 2 + [(1, 0, 1, True)] * 2, key=repr)


def test_pairs_within_the_distance_share_a_cell():
    rng = np.random.default_rng(5)
    space = Subspaces(32, 0.98, 4, 3)
    a = rng.standard_normal((300, 32))
    b = a + rng.standard_normal((300, 32)) * rng.uniform(0, 0.25, (300, 1))
    near = (a * b).sum(1) / np.linalg.norm(a, axis=1) / np.linalg.norm(b, axis=1) >= 0.98
    assert 20 < near.sum() < 300
    both = np.concatenate([space.turned(a), space.turned(b)])
    homes, reach = {}, set()
    for rows, block, cell, home in space.cells(both):
        for r, c in zip(rows.tolist(), cell.tolist(), strict=True):
            reach.add((r, block, c))
            if home:
                homes[r, block] = c
    for i in np.flatnonzero(near):
        gaps = [((both[i][s] - both[300 + i][s]) ** 2).sum() for s in space.spans]
        block = int(np.argmin(gaps))
        meet = [(300 + i, block, homes[i, block]) in reach, (i, block, homes[300 + i, block]) in reach]
        # In one cell at home, or in the later of the two cells alone.
        assert gaps[block] <= space.budget and sum(meet) == (2 if homes[i, block] == homes[300 + i, block] else 1)


@pytest.mark.parametrize("dims,blocks,cosine", [(32, 4, 0.98), (7, 3, 0.9), (3, 8, 0.98), (64, 8, 0.98), (16, 1, 1.0)])
def test_pairs_of_a_task_are_all_close_pairs_once(monkeypatch, dims, blocks, cosine):
    monkeypatch.setattr(embedding_dedup, "PAIRS", 97)
    rng = np.random.default_rng(8)
    space = Subspaces(dims, cosine, blocks, 0)
    some = rng.standard_normal((60, dims))
    rows = space.turned(np.concatenate([some, some + rng.standard_normal(some.shape) * 0.1, some[:9]]))
    gaps = np.stack([((rows[:, None, s] - rows[None, :, s]) ** 2).sum(2) for s in space.spans], 2)
    got = [(min(i, j), max(i, j)) for b in range(len(space.spans)) for x, y in space.pairs(rows, b) for i, j in zip(x.tolist(), y.tolist(), strict=True)]
    close = {(i, j) for i, j in zip(*np.nonzero((gaps <= space.budget).any(2)), strict=True) if i < j}
    assert sorted(got) == sorted(close) and len(close) >= 9
    assert (np.array([len(list(space.pairs(rows[:k], 0))) for k in (0, 1)]) == 0).all()


def test_signatures_within_the_distance_share_a_key():
    rng = np.random.default_rng(6)
    for spec in (NearDup(), NearDup(chunks=13)):
        base = rng.integers(0, 1 << 16, (200, 64)).astype(np.uint16)
        other = base.copy()
        for row in other:
            at = rng.choice(64, rng.integers(0, spec.distance + 1), replace=False)
            row[at] ^= 1
        assert (chunk_keys(base, spec) == chunk_keys(other, spec)).any(axis=1).all()


def test_signatures_estimate_similarity():
    spec, make = NearDup(), Shingler(5)
    rng = random.Random(4)
    a = [rng.choice(WORDS) for _ in range(600)]
    b = [*a[:-60], *(rng.choice(WORDS) for _ in range(60))]
    x, y = make(" ".join(a).encode()), make(" ".join(b).encode())
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert abs((signature(x, spec.seeds()) == signature(y, spec.seeds())).mean() - true) < 0.2
    assert len(make(b"")) == 0 and len(make(b" one  two ")) == 1 and (make(b"A b c d E") == make(b"a B c\td e")).all()


def near_texts(rng, groups, size, length=120):
    out = []
    for _ in range(groups):
        base = [rng.choice(WORDS) for _ in range(length)]
        for k in range(size):
            own = list(base)
            for _ in range(k % 6):
                own[rng.randrange(length)] = rng.choice(WORDS)
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize("blocks", [None, (4, 400)])
def test_documents(spark, make_docs, odd_rows, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(minhash_dedup, "BUCKET_BLOCK", blocks[0])
        monkeypatch.setattr(minhash_dedup, "GROUP_SHINGLES", blocks[1])
    rng = random.Random(11)
    rows = [(i + 100, t, "s") for i, t in enumerate(near_texts(rng, 5, 12))] + [(900 + i, "copy of one text with some more words " * 3, "s") for i in range(9)]
    for spec in (NearDup(), NearDup(shingle=3, percent=85, chunks=13)):
        expect, sizes = brute.near_documents([(d, t) for d, t, _ in rows], spec.shingle, spec.percent)
        got = near_duplicates(spark, make_docs(rows + odd_rows), spec).collect()
        assert {r.doc_id: r.component_id for r in got if r.doc_id and r.doc_id >= 100} == expect and len(got) == len(rows) + len(odd_rows)
        assert all(r.n_shingles == sizes[r.doc_id] for r in got if r.doc_id in sizes)
        odd = {r.doc_id: (r.component_id, r.kept) for r in got if r.doc_id is None or r.doc_id < 100}
        assert odd[None] == (None, True) and odd[6] == (5, False) and odd[11] == (7, False) and odd[1] == (1, True) and odd[2] == (2, True)
    assert near_duplicates(spark, make_docs([])).count() == 0


def log_lines(rng):
    return f"user {rng.randint(1, 10**6)} logged in from host{rng.randint(1, 99)} at port {rng.randint(1, 9999)}"


@pytest.mark.parametrize("block", [2048, 3])
def test_lines(spark, make_docs, monkeypatch, block):
    monkeypatch.setattr(line_dedup, "LEAF_BLOCK", block)
    rng = random.Random(12)
    passage = " ".join(rng.choice(WORDS[:9]).strip("0123456789") + rng.choice("abcdefg") for _ in range(70))
    rows = []
    for d in range(40):
        lines = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 6))]
        if d % 3 == 0:
            lines.insert(rng.randrange(len(lines) + 1), log_lines(rng))
        if d % 5 == 0:
            lines.append(passage)
        rows.append((d, "\n".join(lines) + "\n" * (d % 2), "s"))
    got = drop_recurring_lines(spark, make_docs(rows)).collect()
    expect = brute.line_dedup([(d, t) for d, t, _ in rows])
    assert {r.doc_id: r.text for r in got} == expect and sum(r.n_dropped for r in got) >= 20
    assert all(r.n_lines == len(t.split("\n")) for r in got for d, t, _ in rows if d == r.doc_id)
    assert sum(passage in r.text for r in got) == 1


def test_lines_of_odd_rows(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    out = drop_recurring_lines(spark, docs, LineRules(min_docs=2))
    assert set(docs.columns) <= set(out.columns) and out.columns.count("n_lines") == 1
    got = out.collect()
    assert len(got) == len(odd_rows)
    # The same line is in documents null, 5 (two texts) and 6: it stays with the first of 5's texts.
    first = {(r.doc_id, r.n_dropped) for r in got if r.doc_id in (None, 6) and r.text is not None}
    assert (6, 1) in first and (None, 1) in first
    assert {r.text for r in got if r.doc_id == 1} == {None} and {r.th for r in got} == {"x"}
    assert drop_recurring_lines(spark, make_docs([])).count() == 0
