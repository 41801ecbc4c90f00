"""Line dedup by log templates of a fixed-depth parse tree."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, grouped_batches, runs, splittable
from .components import connected_components, spanning_links
from .minhash_dedup import _merge_all

ANY = b"<*>"
#: Distinct masked lines of a leaf that one block of a task holds.
LEAF_BLOCK = 2048
_DIGIT = re.compile(rb"[0-9]")
#: Letters of scripts written without spaces: Thai, Lao, kana, Chinese characters.
_UNSPACED = re.compile(rb"\xe0[\xb8-\xbb].|\xe3[\x81-\x83].|[\xe4-\xe9]..", re.DOTALL)


@dataclass(frozen=True)
class LineRules:
    """Depth and similarity of the tree, and which templates are dropped.

    ``lead`` tokens after the token count are the tree's levels. Lines of a leaf
    whose tokens agree in ``percent`` of the places share a template. A template
    in ``min_docs`` documents or more is recurring, one of ``long_tokens`` tokens
    or more (two letters of a script without spaces counting as one) in
    ``long_docs``. A line of fewer than
    ``min_tokens`` tokens is a template of its own: all its tokens lead. So
    is one with too few constant tokens, by its exact tokens (``parsed``).
    """

    lead: int = 3
    percent: int = 80
    min_docs: int = 3
    min_tokens: int = 5
    long_tokens: int = 50
    long_docs: int = 2


def masked(line: bytes) -> list[bytes]:
    """Tokens between ASCII white space; those with a digit are variable fields."""
    tokens = line.split()
    return [ANY if _DIGIT.search(t) else t for t in tokens] if _DIGIT.search(line) else tokens


def parsed(line: bytes, rules: LineRules) -> tuple[list[bytes], bool]:
    """Tokens that a line is told by, and whether it is masked: a line with digits
    is, if half of its tokens or more are constant, one of the leading ones too.
    Else, as in rows of numbers, all tokens count as they stand."""
    parts = masked(line)
    if not _DIGIT.search(line):
        return parts, True
    constant = [p is not ANY for p in parts]
    if 2 * sum(constant) >= len(parts) and any(constant[: rules.lead]):
        return parts, True
    return line.split(), False


def _digest(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def _parse(text: bytes | None, rules: LineRules):
    """Yield (line hash, leaf hash, masked line, documents it needs to recur) of
    each distinct line of a text that is not blank."""
    seen = set()
    for raw in (text or b"").split(b"\n"):
        parts, template = parsed(raw, rules)
        if not parts:
            continue
        lead = rules.lead if template and len(parts) >= rules.min_tokens else len(parts)
        joined = b" ".join(parts)
        line = _digest(joined)
        if line not in seen:
            seen.add(line)
            words = len(parts) + (0 if joined.isascii() else len(_UNSPACED.findall(joined)) // 2)
            need = min(rules.long_docs, rules.min_docs) if words >= rules.long_tokens else rules.min_docs
            yield line, _digest(b"%d %s" % (len(parts), b" ".join(parts[:lead]))), joined, need


def _lines(rules: LineRules):
    """(doc_id, text hash, line hash, leaf hash, documents needed) of each such line."""

    def split(batches):
        for batch in batches:
            at, line, leaf, need = [], [], [], []
            for i, text in enumerate(batch.column(2).cast(pa.large_binary()).to_pylist()):
                for x, y, _, n in _parse(text, rules):
                    at.append(i)
                    line.append(x)
                    leaf.append(y)
                    need.append(n)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(line, pa.int64()), pa.array(leaf, pa.int64()), pa.array(need, pa.int32())], ["doc_id", "th", "line", "leaf", "need"])

    return split


def _wanted(rules: LineRules):
    """(line, leaf, n, tokens) of the lines that a text is asked for."""

    def find(batches):
        for batch in batches:
            rows = []
            for text, asked in zip(batch.column(0).cast(pa.large_binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = {x["line"]: x["n"] for x in asked}
                rows += [(line, leaf, n[line], joined) for line, leaf, joined, _ in _parse(text, rules) if line in n]
            columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.binary()], strict=True)], ["line", "leaf", "n", "tokens"])

    return find


def _matcher(rules: LineRules):
    """Spanning links of the lines of a leaf that agree in enough places."""

    def match(batches):
        for batch in grouped_batches(batches, 3):
            line, raw, known = batch.column(3).to_numpy(), batch.column(4).to_pylist(), batch.column(5).to_numpy()
            bounds = runs(*(batch.column(i).to_numpy() for i in range(3)))
            a_out, b_out = [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                rows = [x.split(b" ") for x in raw[a:b]]
                sizes = np.array([len(r) for r in rows])
                for size in np.unique(sizes).tolist():  # one, unless hashes of leaves clash
                    at = np.flatnonzero(sizes == size)
                    code: dict[bytes, int] = {}
                    table = np.array([[code.setdefault(t, len(code)) for t in rows[k]] for k in at], np.int32)
                    own = line[a + at]
                    for i, j in _merge_all(known[a + at], lambda i, others, table=table, size=size: 100 * (table[others] == table[i]).sum(axis=1) >= rules.percent * size):
                        a_out.append(int(own[i]))
                        b_out.append(int(own[j]))
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    return match


def _cleaner(rules: LineRules):
    """Texts without their dropped lines; a line goes with the break before it,
    the first with the break after it."""

    def clean(batches):
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, drop in zip(batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines = (text or b"").split(b"\n")
                n_lines.append(len(lines))
                if not drop:
                    texts.append(text)
                    n_dropped.append(0)
                    continue
                gone = set(drop)
                kept = []
                for raw in lines:
                    parts, _ = parsed(raw, rules)
                    if not parts or _digest(b" ".join(parts)) not in gone:
                        kept.append(raw)
                texts.append(b"\n".join(kept))
                n_dropped.append(len(lines) - len(kept))
            cleaned = pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), cleaned, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], ["_keep", "text", "n_lines", "n_dropped"])

    return clean


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text``; adds n_lines, n_dropped.

    Lines are parsed by a fixed-depth tree: token count, then the leading
    tokens, tokens with digits standing for a variable field. The lines of a
    leaf that agree in enough places share a template; short lines and those
    mostly of variable fields have a leaf each, blank ones none. A template that lies in
    ``rules.min_docs`` documents or more (a long one in ``rules.long_docs``) is
    dropped everywhere but in the document of the smallest doc_id that holds it,
    where all its lines stay.

    1. One map gives the hashes of the lines of each document and of their
       leaves, as a narrow table.
    2. Lines are counted with map-side combine, so a line in a third of all
       documents is one row a task. Only lines that share a leaf with another
       are read again, each from one document that holds it, and compared; a
       leaf of more than ``LEAF_BLOCK`` distinct lines is dealt out in blocks (see
       ``spanning_links``), so it is compared whole and no task holds it whole.
    3. Templates are the components of agreeing lines. They are counted by
       documents, and those that recur join back to (document, line) rows alone.
    4. Texts are joined with the lines they lose.

    Rows of one doc_id and text are one document; all of them lose the same
    lines. A null doc_id comes last. Texts without a recurring line, null and
    empty ones are returned as they are. Further columns are kept, whatever their
    names, but for n_lines and n_dropped, which are made anew; no rows give none.
    """
    scratch = Scratch(spark, "lines")
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    text = F.col("text").cast("string")
    base = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.xxhash64(text).alias("_th"), F.struct(*[c for c in names if c != "text"]).alias("_keep"), text.alias("text"))
    ids = scratch.table(base.select("_doc", "_th", "text").mapInArrow(_lines(rules), "doc_id long, th long, line long, leaf long, need int"), "lines")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    lines = scratch.table(ids.groupBy("line").agg(F.min("leaf").alias("leaf"), F.min("need").alias("need"), F.count("*").alias("docs"), F.min(place).alias("at")), "distinct")
    crowd = scratch.table(lines.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1"), "crowd")
    most = crowd.agg(F.max("n")).first()[0]
    asked = lines.join(crowd, "leaf").select(F.col("at.doc_id").alias("_doc"), F.col("at.th").alias("_th"), "line", "n")
    asked = asked.groupBy("_doc", "_th").agg(F.collect_list(F.struct("line", "n")).alias("asked"))
    same = lambda x: base["_doc"].eqNullSafe(x["_doc"]) & (base["_th"] == x["_th"])
    found = base.join(asked, same(asked)).select("text", "asked").mapInArrow(_wanted(rules), "line long, leaf long, n long, tokens binary")
    alike = spanning_links(spark, scratch, found, ["leaf"], "line", "tokens", "n", F.lit(1), LEAF_BLOCK, most, _matcher(rules))
    template = connected_components(spark, alike, scratch).select(F.col("node").alias("line"), F.col("component").alias("template"))
    named = lines.select("line", "docs", "need").join(template, "line", "left").select("line", "docs", "need", F.coalesce("template", "line").alias("template"))
    # An upper bound, as a document may hold several lines of a template; the exact count follows.
    sums = named.groupBy("template").agg(F.sum("docs").alias("s"), F.min("need").alias("need")).where(F.col("s") >= F.col("need")).select("template", "need")
    held = scratch.table(named.drop("need").join(splittable(sums), "template").select("line", "template", "need"), "often")
    places = scratch.table(ids.select("doc_id", "th", "line").join(held, "line"), "places")
    per_doc = places.groupBy("template", "doc_id", "th").agg(F.min("need").alias("need"))
    recurring = per_doc.groupBy("template").agg(F.count("*").alias("n"), F.min("need").alias("need"), F.min(place).alias("first")).where(F.col("n") >= F.col("need")).select("template", F.col("first.doc_id").alias("first"), F.col("first.th").alias("first_th"))
    later = ~(F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("th") == F.col("first_th")))
    gone = places.join(splittable(recurring), "template").where(later).groupBy(F.col("doc_id").alias("_doc"), F.col("th").alias("_th")).agg(F.collect_set("line").alias("_drop"))
    full = base.join(gone, same(gone), "left").select(base["_keep"], base["text"], "_drop")
    schema = T.StructType([*full.select("_keep", "text").schema, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    out = full.mapInArrow(_cleaner(rules), schema)
    return out.select(*[F.col("text") if c == "text" else F.col("_keep")[c].alias(c) for c in names], "n_lines", "n_dropped")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, dropped lines and the remaining text of all documents."""
    out = drop_recurring_lines(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", "text")
