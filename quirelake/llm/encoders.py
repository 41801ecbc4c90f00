"""Exact encoders of public vocabularies with bounded per-worker memos."""

from __future__ import annotations

import os
import re
from array import array
from itertools import chain
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import tokenizer_path, worker_object

#: Entries a worker's memo holds before it starts afresh; bounds its memory only.
MEMO_ENTRIES = 400_000
#: Longer pieces are encoded each time, so that the memo's bytes are bounded too.
MEMO_KEY_BYTES = 64


def _byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in shown}
    table.update((b, chr(256 + n)) for n, b in enumerate(b for b in range(256) if b not in table))
    return table


_BYTE_ALPHABET = _byte_alphabet()


class ChunkEncoder:
    """Ids of a ``tokenizers`` JSON vocabulary whose pre-tokenizer drops white space.

    No token of such a vocabulary spans ASCII white space and neither NFC nor
    the lower-casing (one code point at a time) looks across it, so a text's ids
    are those of its white-space-delimited chunks one after another. Arrow
    splits the texts and numbers the distinct chunks of a batch; each goes
    through the library once in a worker's life, as long as the memo holds it.
    Texts with ``<|``, where the spelling of a special token counts, go through
    the library whole.
    """

    TAIL = b".,;:!?"
    PLAIN = re.compile("[a-zß-öø-ÿ]+")

    def __init__(self, name: str, entries: int = MEMO_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_path(name))
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.memo: dict[bytes, bytes] = {}
        self.entries = entries

    def _learn(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of new chunks. Words of Latin-1 letters are one pre-token and
        already normal, so they go to the merge model itself, spelt in its byte
        alphabet; all else takes the library's whole way."""
        out: list = [None] * len(chunks)
        tokenize, plain, rest = self.library.model.tokenize, self.PLAIN.fullmatch, []
        code = "HI"[self.dtype.itemsize // 4]
        for i, c in enumerate(chunks):
            word = c.decode("utf-8").lower()
            if plain(word):
                word = word if len(word) == len(c) else word.encode().decode("latin-1").translate(_BYTE_ALPHABET)
                out[i] = array(code, [t.id for t in tokenize(word)]).tobytes()
            else:
                rest.append(i)
        found = self.library.encode_batch_fast([chunks[i].decode("utf-8") for i in rest], add_special_tokens=False)
        for i, e in zip(rest, found, strict=True):
            out[i] = np.array(e.ids, self.dtype).tobytes()
        return out

    def _ids_of(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of distinct chunks. Marks at a chunk's end are tokens apart from
        the letter or digit before them, so both parts are looked up."""
        memo, tail = self.memo, self.TAIL
        if len(memo) > self.entries:
            memo.clear()
        cores = [c.rstrip(tail) for c in chunks]
        cores = [k if k[-1:].isalnum() else c for k, c in zip(cores, chunks, strict=True)]
        tails = [c[len(k) :] for k, c in zip(cores, chunks, strict=True)]
        new = [k for k in dict.fromkeys(chain(cores, set(tails))) if k not in memo]
        if new:
            learned = dict(zip(new, self._learn(new), strict=True))
            memo.update(learned)
        out = list(map(add, map(memo.__getitem__, cores), map(memo.__getitem__, tails)))
        for k in new:
            if len(k) > MEMO_KEY_BYTES:
                del memo[k]
        return out

    def encode_column(self, column: pa.Array, step: int = 4096):
        """Yield the ids of each whole text of a string column (null: empty),
        without special tokens added."""
        for at in range(0, len(column), step):
            texts = pc.fill_null(column.slice(at, step).cast(pa.large_string()), "")
            odd = pc.match_substring(texts, "<|")
            chunks = pc.ascii_split_whitespace(pc.ascii_lower(pc.if_else(odd, "", texts)))
            coded = chunks.flatten().dictionary_encode()
            ids = self._ids_of(coded.dictionary.cast(pa.large_binary()).to_pylist())
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
            pool = np.frombuffer(b"".join(ids), self.dtype)
            starts = np.cumsum(sizes) - sizes
            codes = coded.indices.to_numpy()
            n = sizes[codes]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            flat = pool[np.repeat((starts[codes] - ends + n).astype(np.int32), n) + np.arange(total, dtype=np.int32)]
            bounds = np.concatenate([[0], ends])[chunks.offsets.to_numpy() - chunks.offsets[0].as_py()].tolist()
            for i, whole in enumerate(odd.to_pylist()):
                if whole:
                    yield np.array(self.library.encode(texts[i].as_py(), add_special_tokens=False).ids, self.dtype)
                else:
                    yield flat[bounds[i] : bounds[i + 1]]


def chunk_encoder(name: str, entries: int = MEMO_ENTRIES) -> ChunkEncoder:
    """The worker's encoder for a vocabulary."""
    return worker_object("chunks", (name, entries), lambda: ChunkEncoder(name, entries))
