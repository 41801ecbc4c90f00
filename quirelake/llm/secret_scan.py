"""Secret scan with corpus-wide ownership frequency. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, splittable

_NAMES = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in name) for name in ("password", "passwd", "secret", "token", "api_?key"))
_VALUE = "[A-Za-z0-9+/_.=-]+"
_LEAD = rf"""(?:{_NAMES})["']?\x20*[:=]\x20*["']?"""
#: Base kinds in their order: pattern, and the test that a match must pass.
BASE = (
    ("assign", rf"{_LEAD}{_VALUE}"),
    ("access", r"AKIA[A-Z0-9]+"),
    ("hex", r"[0-9a-f]{16,}"),
)
#: Candidates of the method's own: long tokens that mix letters and digits.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
#: A candidate is a widely copied example from so many owners on, or, within
#: whatever owners, from so many distinct repositories on.
EXAMPLE_OWNERS = 3
EXAMPLE_REPOSITORIES = 10
#: Elements of an array that are worked on together (see ``_chunks``).
CHUNK = 512
_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once: an expression named within a
    lambda would be worked out anew for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _chunks(array: Column) -> Column:
    """An array cut into arrays of ``CHUNK`` elements.

    Appending to an array copies it, so a running sum over n elements is taken
    over chunks: within each, and over the chunks' totals.
    """

    def cut(x):
        n = F.ceil(F.size(x) / F.lit(CHUNK)).cast("int")
        return F.transform(F.filter(F.sequence(F.lit(0), n), lambda c: c < n), lambda c: F.slice(x, c * CHUNK + 1, CHUNK))

    return _let(array, cut)


def _pairs(text: Column, pattern: str) -> Column:
    """(g, m): each leftmost non-overlapping match and the text between it and the one before."""
    return F.filter(F.arrays_zip(F.split(text, pattern).alias("g"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("m")), lambda p: p["m"].isNotNull())


def _spans(text: Column, pattern: str, kind: str, passes) -> Column:
    """Spans (start, kind number, end, value) of the matches of a pattern that pass,
    in code points. Starts follow from the lengths of the pieces before them."""
    number = F.lit(KINDS.index(kind))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def starts(chunks):
        long = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, p: a + p["g"] + p["n"]))
        return F.aggregate(long, first, lambda s, n: F.struct((s["at"] + n).alias("at"), F.array_append(s["out"], s["at"]).alias("out")), lambda s: s["out"])

    def step(s, p):
        start = s["at"] + p["g"]
        end = start + p["n"]
        span = F.struct(start.alias("start"), number.alias("kind"), end.alias("end"), p["m"].alias("value"))
        return F.struct(end.alias("at"), F.array_append(s["out"], span).alias("out"))

    def placed(chunks):
        return F.flatten(F.transform(F.arrays_zip(chunks.alias("c"), starts(chunks).alias("at")), lambda z: F.aggregate(z["c"], F.struct(z["at"].alias("at"), F.array().cast(_SPAN).alias("out")), step, lambda s: s["out"])))

    lengths = F.transform(_pairs(text, pattern), lambda p: F.struct(F.length(p["g"]).alias("g"), F.length(p["m"]).alias("n"), p["m"].alias("m")))
    return F.filter(_let(_chunks(lengths), placed), lambda s: passes(s["value"]))


def _secret_of(match: Column) -> Column:
    """The value of an assignment: what follows its lead."""
    return F.regexp_replace(match, rf"^{_LEAD}", "")


def find_candidates(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, owner, and ``spans``: all base spans and candidate tokens of each
    whole text. Each pattern is run only over texts that hold its marks."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.xxhash64(F.col("text").cast("string")).alias("th")
    read = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("owner"), key, text.alias("_t"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    assign = F.when(
        F.col("_t").rlike(_LEAD),
        _spans(F.col("_t"), BASE[0][1], "assign", lambda m: F.length(_secret_of(m)) >= 12),
    ).otherwise(none)
    access = F.when(F.col("_t").contains("AKIA"), _spans(F.col("_t"), BASE[1][1], "access", lambda m: F.length(m) >= 18)).otherwise(none)
    hexes = F.when(F.col("_t").rlike(BASE[2][1]), _spans(F.col("_t"), BASE[2][1], "hex", lambda m: F.length(m) >= 16)).otherwise(none)
    mixed = lambda m: m.rlike("[A-Z]") & m.rlike("[a-z]") & m.rlike("[0-9]")
    tokens = F.when(F.col("_t").rlike(TOKEN), _spans(F.col("_t"), TOKEN, "owned", mixed)).otherwise(none)
    return read.select("doc_id", "th", "owner", F.concat(assign, access, hexes, tokens).alias("spans"))


def _spell(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def ownership(each: DataFrame) -> DataFrame:
    """(hash, repositories, owners) of candidates (hash, owner, doc_id, row).

    Repositories are distinct documents: rows of one doc_id count once, each row
    of a null doc_id apart. Three aggregates with map-side combine, by hash,
    owner and document, then by hash and owner, then by hash: no task holds the
    documents or owners of a value that a third of all rows have.
    """
    document = F.coalesce(F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.concat(F.lit("r"), F.col("row").cast("string")))
    held = each.groupBy("hash", "owner", document.alias("d")).agg(F.count("*").alias("n"))
    by_owner = held.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("repositories"), F.count("*").alias("owners"))


def scan_secrets(spark: SparkSession, docs: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """Spans of secrets in each whole text of ``docs`` (doc_id, text, source).

    Returns doc_id, th (hash of the text), owner, ``spans`` (array of start, kind,
    end, live, repositories, owners, after; sorted by start, then kind; ``after``
    is the largest end before it), n_live, n_example and the most repositories
    and owners of a candidate. Base kinds are always spans: assign,
    access and hex. Every base value and every long token of mixed letters and
    digits is a candidate; its hash is counted over the corpus by distinct
    repositories (documents) and owners (sources). From ``example_owners`` owners
    or ``example_repositories`` repositories on it is a widely copied example;
    below both it is owner-specific and live-looking, so one mirror of a document
    doesn't clear its keys. Live tokens that no base span overlaps become spans
    of the kind "owned"; examples of that sort are left alone.

    The texts are read once, into a narrow table of candidates, counted as
    ``ownership`` tells; the verdicts join back to candidate rows alone, and AQE
    splits that join at hot hashes.

    Null texts are empty, a null source is the owner "", null doc_ids and
    repeated rows are scanned each for itself (rows are told apart by their place
    in the written table), further columns are ignored, and no rows give none.
    A text of very many matches takes time in proportion to them but for a small
    part; its spans are held by one task. Spans that start together are sorted by
    kind; a candidate at either limit is an example.
    """
    scratch = Scratch(spark, "secrets")
    found = scratch.table(find_candidates(docs).withColumn("row", F.monotonically_increasing_id()), "candidates")
    value = F.when(F.col("s.kind") == 0, _secret_of(F.col("s.value"))).otherwise(F.col("s.value"))
    each = found.select("row", "doc_id", "owner", F.explode("spans").alias("s")).select("row", "doc_id", "owner", F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"), F.sha2(value, 256).alias("hash"))
    live = (F.col("owners") < example_owners) & (F.col("repositories") < example_repositories)
    judged = each.join(splittable(ownership(each)), "hash").select("row", "start", "kind", "end", live.alias("live"), "repositories", "owners")
    # Overlaps within a row: the largest base end before a span, the least base start after
    # it. Both frames end at the row before, which a window takes in one pass.
    order = Window.partitionBy("row").orderBy("start", "kind", "end")
    base = F.col("kind") < 3
    behind = order.rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    placed = judged.select(
        "*",
        F.coalesce(F.min(F.when(base, F.col("start"))).over(ahead) < F.col("end"), F.lit(False)).alias("over"),
        F.coalesce(F.max(F.when(base, F.col("end"))).over(behind) > F.col("start"), F.lit(False)).alias("under"),
    )
    placed = placed.withColumn("chosen", base | (F.col("live") & ~F.col("under") & ~F.col("over")))
    placed = placed.withColumn("after", F.coalesce(F.max(F.when(F.col("chosen"), F.col("end"))).over(behind), F.lit(0)))
    span = F.struct("start", "kind", "end", "live", "repositories", "owners", "after")
    rows = placed.groupBy("row").agg(
        F.sort_array(F.collect_list(F.when(F.col("chosen"), span))).alias("spans"),
        F.sum(F.col("live").cast("long")).alias("n_live"),
        F.sum((~F.col("live")).cast("long")).alias("n_example"),
        F.max("repositories").alias("repositories"),
        F.max("owners").alias("owners"),
    )
    out = found.select("row", "doc_id", "th", "owner").join(rows, "row", "left")
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean,repositories:bigint,owners:bigint,after:int>>")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "th", "owner", F.coalesce("spans", empty).alias("spans"), count("n_live"), count("n_example"), count("repositories"), count("owners"))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and digests of the spans of ``scan_secrets``."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return scanned.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_spell(base), 256).alias("base_sha256"),
        _spell(F.col("spans")).alias("spans"),
        "n_live",
        "n_example",
        "repositories",
        "owners",
    )


def redact_secrets(spark: SparkSession, docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``scan_secrets`` written over by ``mark``.

    Spans that overlap become one mark. Texts are joined with spans of their
    doc_id and text; ``n_chars``, where there is such a column, is counted anew.
    Texts without a span, null and empty ones stay as they are; so do further
    columns, whatever their names, null doc_ids and repeated rows; no rows give
    none. A text of any length is written over whole, by the task that holds it.
    """
    found = scan_secrets(spark, docs).where(F.size("spans") > 0)
    spans = found.groupBy(F.col("doc_id").alias("_doc"), F.col("th").alias("_th")).agg(F.first("spans").alias("_spans"))
    keyed = docs.select(F.struct("*").alias("_row"), F.xxhash64(F.col("text").cast("string")).alias("_own"))
    joined = keyed.join(spans, F.col("_row")["doc_id"].eqNullSafe(F.col("_doc")) & (F.col("_own") == F.col("_th")), "left")
    text, hit = F.col("_row")["text"], F.col("_spans").isNotNull()

    def part(whole, low, chunk):
        # ``whole`` is the text from place ``low`` to the chunk's last end.
        return F.transform(chunk, lambda x: F.when(x["start"] >= x["after"], F.concat(F.substr(whole, x["after"] - low + 1, x["start"] - x["after"]), F.lit(mark))).otherwise(""))

    def piece(chunk):
        low, end = F.get(chunk, F.lit(0))["after"], F.array_max(F.transform(chunk, lambda x: x["end"]))
        one = F.transform(F.array(F.struct(low.alias("low"), F.substr(text, low + 1, end - low).alias("whole"))), lambda z: F.array_join(part(z["whole"], z["low"], chunk), ""))
        return F.get(one, F.lit(0))

    # Counting code points to a place takes time in proportion to it, so a chunk's text is cut out first.
    end = F.array_max(F.transform("_spans", lambda x: x["end"]))
    clean = F.concat(F.array_join(F.transform(_chunks(F.col("_spans")), piece), ""), F.substr(text, end + 1))
    made = joined.withColumn("_clean", F.when(hit, clean).otherwise(text))
    new = {"text": F.col("_clean"), "n_chars": F.when(hit, F.length("_clean").cast("long")).otherwise(F.col("_row")["n_chars"]) if "n_chars" in docs.columns else None}
    return made.select(*[(new[c] if c in new else F.col("_row")[c]).alias(c) for c in docs.columns])


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of all documents."""
    return digest(scan_secrets(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")))
