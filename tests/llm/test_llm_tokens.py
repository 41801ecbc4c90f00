"""Token counts, packing, byte-level BPE and token shards against the libraries."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirelake.llm.byte_bpe import ByteEncoder, encode_documents, merge_ranks
from quirelake.llm.encoders import ChunkEncoder
from quirelake.llm.packing import OpenWindows, best_fit_decreasing, pack_documents
from quirelake.llm.queries import QUERIES
from quirelake.llm.token_counts import PrefixCounter, count_tokens
from quirelake.llm.token_store import WaveletMatrix, find_tokens, read_token_shards, token_occurrences, tokens_at, write_token_shards

P = pytest.importorskip("public_tokenizers")
PIECES = ["the ", "The", " ", "  ", "\n", "\t", "'s", "don't", "ing", "été", "中文", "😀", "▁", "<s>", "</s>", "<|endoftext|>", "<|", "x1", "123", "....", "!?", ",", "a" * 40, " ", " ", "\r\n", "ß", "İ", "é", "\x00", "-", "_", "<unk>", "ab", "q"]
texts = st.lists(st.sampled_from(PIECES), max_size=25).map("".join)


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def words():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def ranked():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return ranks, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def counter():
    return PrefixCounter()


@pytest.fixture(scope="module")
def chunks():
    return ChunkEncoder("word_bpe_49k.json")


@pytest.fixture(scope="module")
def byte_encoder():
    return ByteEncoder()


def ids_of(words, text):
    return np.array(words.encode(text or "", add_special_tokens=False).ids + [2], "<u4")


@settings(max_examples=300, deadline=None)
@given(text=texts)
def test_prefix_counts_are_the_librarys(counter, pieces, text):
    assert counter.count(text) == len(pieces.encode(text))
    counts = counter.prefix_counts(text)
    assert counts[-1] == counter.count(text) and len(counts) == len(text) + 1
    for i in range(0, len(text), 7):
        assert counts[i] == len(pieces.encode(text[:i]))


def test_budget_gives_the_longest_prefix(counter, pieces):
    text = "the quick brown fox, jumps over 12 dogs. " * 9
    for budget in (0, 1, 7, 50, 10_000):
        n = counter.fit(text, budget)
        assert len(pieces.encode(text[:n])) <= budget and (n == len(text) or all(len(pieces.encode(text[:m])) > budget for m in range(n + 1, min(len(text), n + 20))))


@settings(max_examples=300, deadline=None)
@given(text=texts)
def test_chunk_ids_are_the_librarys(chunks, words, text):
    import pyarrow as pa

    (got,) = chunks.encode_column(pa.array([text]))
    assert got.tolist() == words.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(text=texts)
def test_byte_ids_are_the_librarys(byte_encoder, ranked, text):
    ids = byte_encoder.encode(text)
    assert ids == ranked[1].encode_ordinary(text) and byte_encoder.decode(ids).decode() == text


def test_merges_of_long_pieces(ranked):
    rng = random.Random(7)
    for n in (1, 2, 3, 17, 64, 65, 3000):
        piece = "".join(rng.choice("abcde ing") for _ in range(n)).replace(" ", "x").encode()
        assert merge_ranks(piece, ranked[0]) == ranked[1]._encode_single_piece(piece)


def test_wavelet_matrix():
    rng = np.random.default_rng(3)
    for ids in (np.zeros(0, np.uint16), np.zeros(5, np.uint16), rng.integers(0, 49_408, 3000).astype(np.uint16), rng.integers(0, 7, 2000).astype(np.uint16), rng.integers(0, 1 << 20, 900).astype(np.uint32)):
        m = WaveletMatrix.from_bytes(WaveletMatrix.build(ids).to_bytes())
        assert m.decode().tolist() == ids.tolist()
        for at in rng.integers(0, max(len(ids), 1), 40) if len(ids) else []:
            v = int(ids[at])
            assert m.access(int(at)) == v and m.count(v) == int((ids == v).sum()) and m.count(v, 0, int(at)) == int((ids[:at] == v).sum())
            assert ids[m.find(v, 0)] == v and m.find(v, m.count(v) - 1) == int(np.flatnonzero(ids == v)[-1])
        with pytest.raises(IndexError):
            m.access(len(ids))
    with pytest.raises(ValueError):
        WaveletMatrix.from_bytes(b"x" * 64)


def test_a_shard_is_read_in_part():
    ids = np.random.default_rng(5).integers(0, 49_408, 400_000).astype(np.uint16)
    m = WaveletMatrix.from_bytes(WaveletMatrix.build(ids).to_bytes())
    blocks, block = [], m.block
    m.block = lambda level, k: blocks.append((level, k)) or block(level, k)
    assert m.access(123_456) == ids[123_456] and len(blocks) <= 2 * len(m.zeros)
    token = int(ids[5])
    where = np.flatnonzero(ids == token)
    blocks.clear()
    assert m.count(token, 1000, 300_001) == int(((where >= 1000) & (where < 300_001)).sum()) and m.find(token, len(where) - 1) == where[-1]
    # Of 13 blocks a plane, some six.
    assert len(blocks) <= 7 * len(m.zeros) < 13 * len(m.zeros)


def test_access_count_and_find_over_shards(spark, make_docs, odd_rows, words, tmp_path):
    path = f"file://{tmp_path}/shards"
    rows = [r for r in odd_rows if r[0] is not None and r[0] != 5]
    write_token_shards(spark, make_docs(rows), path, shard_ids=700)
    ids = {d: ids_of(words, t).tolist() for d, t, _ in rows}
    asked = [(d, p) for d in ids for p in (0, len(ids[d]) - 1, len(ids[d]) // 2, len(ids[d]), -1)] + [(999, 0), (4, 0)]
    got = {(r.doc_id, r.place): r.token for r in tokens_at(spark, path, spark.createDataFrame(asked, "doc_id long, place int")).collect()}
    assert got == {(d, p): ids[d][p] if 0 <= p < len(ids.get(d, [])) else None for d, p in asked}
    some = [2, ids[6][3], 49_000]
    every = [(d, p, t) for d, own in ids.items() for p, t in enumerate(own) if t in some]
    assert {r.token: r.n for r in token_occurrences(spark, path, some).collect()} == {t: sum(x[2] == t for x in every) for t in some}
    assert sorted(tuple(r) for r in find_tokens(spark, path, some).collect()) == sorted(every)


def test_best_fit_is_the_tightest_open_window():
    rng = random.Random(1)
    for _ in range(15):
        lengths = np.array([rng.randint(1, 50) for _ in range(rng.randint(0, 80))])
        where, offset = best_fit_decreasing(lengths, 50)
        room, expect = [], {}
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            fit = [w for w in range(len(room)) if room[w] >= lengths[i]]
            w = min(fit, key=lambda w: room[w]) if fit else len(room)
            if not fit:
                room.append(50)
            room[w] -= lengths[i]
            expect[i] = lengths[i]
        assert len(set(where.tolist())) == len(room)
        for w in set(where.tolist()):
            mine = sorted((int(offset[i]), int(lengths[i])) for i in np.flatnonzero(where == w))
            assert mine[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(mine, mine[1:], strict=False)) and sum(n for _, n in mine) <= 50
    tree = OpenWindows(10)
    assert tree.take(1) is None
    tree.put(0, 4)
    tree.put(1, 7)
    assert tree.take(5) == (1, 7) and tree.take(5) is None and tree.take(4) == (0, 4)


def test_queries_over_whole_tables(spark, sf_dir, small_docs, pieces, words, ranked):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op2_token_counts"](spark, sf_dir).collect()}
    counts = {d: len(pieces.encode(t or "")) for d, t in small_docs}
    assert got == {d: (len((t or "").encode()), counts[d], counts[d] > 4096) for d, t in small_docs}
    ids = {d: ids_of(words, t) for d, t in small_docs}
    assert brute.check_packing(QUERIES["op6_packing"](spark, sf_dir).collect(), ids) > 0.9
    at, expect = 0, {}
    for d in sorted(ids):
        expect[d] = (at, len(ids[d]), zlib.crc32(ids[d].tobytes()))
        at += len(ids[d])
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op10_token_store"](spark, sf_dir).collect()} == expect
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expect = {}
    for d, t in small_docs:
        own = ranked[1].encode_ordinary(t or "")
        expect[d] = (len(own), sha(" ".join(map(str, own)).encode()), sha((t or "").encode()))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op7_byte_bpe"](spark, sf_dir).collect()} == expect


def test_odd_rows(spark, make_docs, odd_rows, pieces, words, ranked, tmp_path):
    docs = make_docs(odd_rows)
    got = Counter((r.doc_id, r.n_tokens) for r in count_tokens(docs).collect())
    assert got == Counter((d, len(pieces.encode(t or ""))) for d, t, _ in odd_rows)
    got = Counter((r.doc_id, r.n_tokens, len(r.ids)) for r in encode_documents(docs).collect())
    assert got == Counter((d, n := len(ranked[1].encode_ordinary(t or "")), n) for d, t, _ in odd_rows)
    packed = pack_documents(spark, docs).collect()
    assert sum(r.length for r in packed) == sum(len(ids_of(words, t)) for _, t, _ in odd_rows) and all(len(r.ids) == 4 * r.length for r in packed)
    write_token_shards(spark, docs, f"file://{tmp_path}/shards", shard_ids=1000)
    read = read_token_shards(spark, f"file://{tmp_path}/shards").orderBy("start").collect()
    assert Counter((r.doc_id, r.n_tokens) for r in read) == Counter((d, len(ids_of(words, t))) for d, t, _ in odd_rows)
    assert [r.start for r in read] == np.concatenate([[0], np.cumsum([r.n_tokens for r in read])[:-1]]).tolist()
    known = [r.doc_id for r in read]
    assert known == sorted(known, key=lambda d: (d is not None, d or 0))


def test_no_rows(spark, make_docs, tmp_path):
    docs = make_docs([])
    assert count_tokens(docs).count() == encode_documents(docs).count() == pack_documents(spark, docs).count() == 0
    write_token_shards(spark, docs, f"file://{tmp_path}/none")
    assert read_token_shards(spark, f"file://{tmp_path}/none").count() == 0
