"""Byte-level BPE encoding by a segment tree over pair ranks, and decoding."""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import tokenizer_path, worker_object
from .encoders import MEMO_ENTRIES, MEMO_KEY_BYTES

RANKS = "byte_bpe_50k.tiktoken"
#: White space as the library's pattern engine has it.
_BLANK = r"\t-\r \x85\xa0  -     　"
_NONE = 1 << 60


def merge_ranks(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the lowest-ranked pair, leftmost of equals, is merged
    until none is left.

    Node ``i`` of the tree stands for the token that starts at byte ``i``; a
    leaf holds the rank of it joined with its right neighbour, an inner node
    the least (rank, byte) below it. A merge changes at most three leaves, each
    in a logarithmic number of steps.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    ends = list(range(1, n + 1))  # of the live token that starts at a byte
    prior = list(range(-1, n - 1))
    shift = size.bit_length()
    empty = _NONE << shift
    tree = [empty] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        tree[size + i] = get(piece[i : i + 2], _NONE) << shift | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        while i > 1:
            i >>= 1
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a <= b else b
            if tree[i] == low:
                break
            tree[i] = low

    while (low := tree[1]) >> shift < _NONE:
        i = low & ((1 << shift) - 1)
        j = ends[i]
        end = ends[i] = ends[j]
        put(j, empty)
        if end < n:
            prior[end] = i
            put(i, get(piece[i : ends[end]], _NONE) << shift | i)
        else:
            put(i, empty)
        h = prior[i]
        if h >= 0:
            put(h, get(piece[h:end], _NONE) << shift | h)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


class ByteEncoder:
    """Encoder and decoder of a rank file, with a bounded memo of pieces."""

    def __init__(self, name: str = RANKS, pattern: str | None = None, entries: int = MEMO_ENTRIES):
        import public_tokenizers
        import regex

        with open(tokenizer_path(name), "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        pattern = pattern or public_tokenizers.PATTERN
        # The classes are spelt out, as engines differ in what \\s holds.
        spelt = pattern.replace(r"[^\s", f"[^{_BLANK}").replace(r"\S", f"[^{_BLANK}]").replace(r"\s", f"[{_BLANK}]")
        self.split = regex.compile(spelt).findall
        ascii_ = pattern.replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9").replace("a-zA-Z+", "[a-zA-Z]+").replace("0-9+", "[0-9]+")
        ascii_ = ascii_.replace(r"[^\sa-zA-Z0-9]", r"[^\t-\r a-zA-Z0-9]").replace(r"\S", r"[^\t-\r ]").replace(r"\s", r"[\t-\r ]")
        self.split_ascii = re.compile(ascii_).findall
        self.memo: dict[str, tuple] = {}
        self.entries = entries

    def pieces(self, text: str) -> list[str]:
        """Matches of the pattern, each to be encoded apart."""
        return self.split_ascii(text) if text.isascii() else self.split(text)

    def _learn(self, piece: str) -> tuple[str, int, bytes]:
        ids = merge_ranks(piece.encode("utf-8"), self.ranks)
        known = (" ".join(map(str, ids)), len(ids), self.decode(ids))
        if len(piece) <= MEMO_KEY_BYTES:
            if len(self.memo) >= self.entries:
                self.memo.clear()
            self.memo[piece] = known
        return known

    def spell(self, text: str) -> tuple[str, int, bytes]:
        """The ids of a text in decimal joined by a space, how many, and the bytes they stand for."""
        memo, learn = self.memo, self._learn
        known = [memo[p] if p in memo else learn(p) for p in self.pieces(text)]
        return " ".join([k[0] for k in known]), sum([k[1] for k in known]), b"".join([k[2] for k in known])

    def encode(self, text: str) -> list[int]:
        return list(map(int, self.spell(text)[0].split()))

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of a list of ids."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


def byte_encoder(name: str = RANKS) -> ByteEncoder:
    """The worker's encoder for a rank file."""
    return worker_object("bytes", name, lambda: ByteEncoder(name))


def encode_documents(docs: DataFrame, ranks: str = RANKS, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded bytes, and the ids.

    A map without a shuffle over whole texts. Null texts are empty (no ids, the
    digests of nothing); null doc_ids, repeated rows and further columns do no
    harm; no rows give none. A very long text is held whole by its task, with its
    ids; a match of any length takes logarithmic steps a merge. Of pairs of equal
    rank the leftmost is merged.
    """

    def encode(batches):
        encoder = byte_encoder(ranks)
        for batch in batches:
            n, ids_sha, text_sha, ids = [], [], [], []
            for text in batch.column(1).to_pylist():
                spelt, count, back = encoder.spell(text or "")
                n.append(count)
                ids_sha.append(hashlib.sha256(spelt.encode()).hexdigest())
                text_sha.append(hashlib.sha256(back).hexdigest())
                ids.append(list(map(int, spelt.split())) if with_ids else None)
            out = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                out, names = [*out, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(encode, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and decoded bytes of all documents."""
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
