"""Exact token counts at every prefix of a text, by dynamic programming."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import tokenizer_path, worker_object
from .encoders import MEMO_ENTRIES, MEMO_KEY_BYTES

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
_SPACE = "▁"


class PrefixCounter:
    """Token counts of all prefixes under a sentencepiece BPE model.

    The last token of a prefix's encoding is the one token that ends there and
    that may follow the last token of the prefix before it; two tokens may
    follow each other if the model encodes their joined text as just the two.
    So one pass over a text gives the last token, and with it the count, at
    every prefix ("prefix[i] = prefix[i - len(token)] + 1"). Pairs are tried by
    the model's own merges once and remembered.

    The model must be BPE without text normalisation, with byte fallback and no
    piece that runs on from another character into the space mark; then a text
    falls into segments (a run of space marks with the word after it, or a
    character that no longer piece holds) that are encoded apart.
    """

    MARKS = ".,;:!?"

    def __init__(self, name: str = MODEL, entries: int = MEMO_ENTRIES):
        import ahocorasick
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
        sp = self.library
        self.score: dict[str, float] = {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
                self.score[sp.id_to_piece(i)] = sp.get_score(i)
        if any(_SPACE in p.lstrip(_SPACE) for p in self.score) or sp.encode("a  b\t\n ", out_type=str)[:3] != ["▁a", "▁", "▁b"]:
            raise ValueError("not a model of the kind that can be counted by segments")
        #: Pieces that their own text is encoded as; no other can be in an encoding.
        self.pieces = ["", *(p for p in self.score if self._merge(p) == [p])]
        #: Number of each one-character piece; 0, as at a text's start, where a character falls into bytes.
        self.lone = {p: k for k, p in enumerate(self.pieces) if len(p) == 1}
        self.ending = ahocorasick.Automaton()
        for k, p in enumerate(self.pieces):
            if len(p) > 1:
                self.ending.add_word(p, (k, len(p)))
        self.ending.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.joined = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.memo: dict[str, bytes | np.ndarray] = {}
        self.totals: dict[str, int] = {}
        self.entries = entries
        apart = {c for c in "\n" if not any(c in p for p in self.score)}
        self.segments = re.compile(f"{_SPACE}*[^{_SPACE}\n]+|{_SPACE}+|\n" if apart else f"{_SPACE}*[^{_SPACE}]+|{_SPACE}+", re.S).findall

    def _merge(self, text: str) -> list[str]:
        """The model's merges on a short text: best score first, leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _follows(self, key: int) -> bool:
        """Whether two pieces (numbers in the high and low part of a key) may follow each other."""
        if len(self.pairs) >= self.entries:
            self.pairs.clear()
        left, right = self.pieces[key >> 32], self.pieces[key & 0xFFFFFFFF]
        known = self.pairs[key] = not left or self._merge(left + right) == [left, right]
        return known

    def _scan(self, segment: str) -> list[int]:
        """Counts at prefixes 1..len of a segment.

        The automaton gives the pieces that end at each place; the first that may
        follow the last piece of the prefix before it ends the encoding there,
        and where none may, the character itself does.
        """
        pairs, follows, lone = self.pairs.get, self._follows, self.lone.get
        n = len(segment)
        last, count, done = [0] * (n + 1), [0] * (n + 1), 0
        for end, (piece, size) in self.ending.iter(segment):
            if end < done:
                continue
            while done < end:
                c = segment[done]
                done += 1
                last[done] = k = lone(c, 0)
                count[done] = count[done - 1] + (1 if k else len(c.encode()))
            start = end + 1 - size
            key = last[start] << 32 | piece
            ok = pairs(key)
            if ok or (ok is None and follows(key)):
                done = end + 1
                last[done], count[done] = piece, count[start] + 1
        while done < n:
            c = segment[done]
            done += 1
            count[done] = count[done - 1] + (1 if c in self.lone else len(c.encode()))
        del count[0]
        return count

    def _parts(self, segment: str) -> tuple[str, str]:
        """A segment and its closing marks, where no piece spans the two."""
        core = segment.rstrip(self.MARKS)
        if core and core != segment and segment[len(core) - 1 : len(core) + 1] not in self.joined:
            return core, segment[len(core) :]
        return segment, ""

    def _counted(self, segment: str):
        """Counts at prefixes 1..len of a segment, as bytes where they fit."""
        known = self.memo.get(segment)
        if known is None:
            core, marks = self._parts(segment)
            counts = self._scan(core)
            if marks:
                counts += [counts[-1] + c for c in self._counted(marks)]
            known = bytes(counts) if max(counts) < 256 else np.array(counts, np.int64)
            if len(segment) <= MEMO_KEY_BYTES:
                if len(self.memo) >= self.entries:
                    self.memo.clear()
                self.memo[segment] = known
        return known

    def _segments(self, text: str) -> list[str]:
        return self.segments(_SPACE + text.replace(" ", _SPACE)) if text else []

    def _sizes(self, segments: list[str]) -> np.ndarray:
        """Tokens of each segment: its count at the last prefix."""
        totals, parts, scan = self.totals, self._parts, self._scan
        if len(totals) > self.entries:
            totals.clear()
        for s in set(segments).difference(totals):
            core, marks = parts(s)
            if core not in totals:
                totals[core] = scan(core)[-1]
            if marks:
                totals[s] = totals[core] + int(self._counted(marks)[-1])
        out = np.fromiter(map(totals.__getitem__, segments), np.int64, len(segments))
        if len(totals) > self.entries:  # one text with very many words
            totals.clear()
        return out

    def count(self, text: str) -> int:
        """Tokens of the whole text, from the count at its last prefix."""
        return int(self._sizes(self._segments(text)).sum())

    def prefix_counts(self, text: str) -> np.ndarray:
        """Token count of text[:i] for every i in 0..len(text)."""
        out, base = [np.zeros(1, np.int64)], 0
        for s in self._segments(text):
            known = self._counted(s)
            counts = (np.frombuffer(known, np.uint8) if isinstance(known, bytes) else known).astype(np.int64) + base
            out.append(counts)
            base = int(counts[-1])
        counts = np.concatenate(out)
        if len(counts) > 1:  # the model's leading space mark isn't a character of the text
            counts = np.delete(counts, 1)
        return counts

    def count_and_fit(self, text: str, budget: int) -> tuple[int, int]:
        """Tokens of the text, and the length of its longest prefix of at most ``budget``.

        No prefix past the segment that first takes the count over the budget is
        within it, so of the segments' prefix counts only that one's are read.
        """
        segments = self._segments(text)
        sums = np.cumsum(self._sizes(segments))
        total = int(sums[-1]) if segments else 0
        if total <= budget:
            return total, len(text)
        k = int(np.searchsorted(sums, budget, "right"))
        left = budget - (int(sums[k - 1]) if k else 0)
        inside = [i for i, c in enumerate(self._counted(segments[k]), 1) if c <= left]
        # The model's leading space mark isn't a character of the text.
        return total, max(0, sum(map(len, segments[:k])) + (inside[-1] if inside else 0) - 1)

    def fit(self, text: str, budget: int) -> int:
        """Length of the longest prefix of at most ``budget`` tokens."""
        return self.count_and_fit(text, budget)[1]


def prefix_counter(name: str = MODEL) -> PrefixCounter:
    """The worker's counter for a model."""
    return worker_object("prefixes", name, lambda: PrefixCounter(name))


def count_tokens(docs: DataFrame, limit: int = LIMIT, model: str = MODEL) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and fit_chars of ``docs`` (doc_id, text).

    ``n_tokens`` is the count at the last prefix of the whole text;
    ``fit_chars`` is the length in code points of the longest prefix of at most
    ``limit`` tokens, read from the same counts. A map without a shuffle.

    Null and empty texts have no bytes and tokens; null doc_ids, repeated rows
    and further columns are let through (columns are left out); no rows give
    none. A very long text is held whole by its task, with its words and their
    counts; a word of any length is counted in one pass. Of pieces that end at
    one place at most one may follow what stands before, so there are no ties.
    """

    def tokens(batches):
        counter = prefix_counter(model)
        for batch in batches:
            sizes, counts, fits = [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                n, fit = counter.count_and_fit(text, limit)
                sizes.append(len(text.encode()))
                counts.append(n)
                fits.append(fit)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (sizes, counts)), pa.array([n > limit for n in counts], pa.bool_()), pa.array(fits, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(tokens, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
