"""Document quality rules with verdicts shrunk by host. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_broadcast

_BLANK = r"[ \t-\r]+"
#: Rules of the method and their limits for documents of a host in good and in
#: bad standing. Each is (name, normal limit, strict limit) on a share of words
#: or lines.
RULES = (("symbols", 0.25, 0.10), ("dup_lines", 0.60, 0.45), ("word_length", 16.0, 12.0))
#: A host is in bad standing if its shrunk failure rate is above this.
BAD_RATE = 0.5
#: Scripts written without spaces (Thai, Lao, Tibetan, Burmese, Khmer, kana, Han),
#: where a run between blanks is a clause and its length tells nothing.
UNSPACED = r"[\x{0E00}-\x{109F}\x{1780}-\x{17FF}\x{3000}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}]"


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text.

    Windows are joined with a space, which no word holds, and sorted with their
    places; equal neighbours are the repeats.
    """
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")))
    return F.sort_array(windows)


def document_metrics(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts of each document's whole text: n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, n_lines, whether long words are mostly of an
    unspaced script, and base_failed, next to doc_id, host and the columns of
    ``keep``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), *keep, text.alias("_t"))
    split = read.select(
        "*",
        F.filter(F.split("_t", _BLANK), lambda w: w != "").alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^ \t-\r]")).alias("_l"),
    )
    chars = F.length(F.array_join("_w", ""))
    # Only texts of long words are searched for their script.
    unspaced = F.when(chars > RULES[2][2] * F.size("_w"), F.length("_t") - F.length(F.regexp_replace("_t", UNSPACED, ""))).otherwise(0)
    counted = split.select(
        *[c for c in split.columns if c not in ("_t", "_w", "_l")],
        F.size("_w").cast("long").alias("n_words"),
        chars.cast("long").alias("word_chars"),
        (2 * unspaced > chars).alias("unspaced"),
        F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_w") >= 3, _repeat_words(F.col("_w"))).alias("_s"),
    )
    twice = F.transform(
        F.filter(F.arrays_zip(F.slice("_s", 1, F.size("_s") - 1).alias("a"), F.slice("_s", 2, F.size("_s") - 1).alias("b")), lambda p: p["a"]["w"] == p["b"]["w"]),
        lambda p: F.array(p["a"]["i"], p["a"]["i"] + 1, p["a"]["i"] + 2, p["b"]["i"], p["b"]["i"] + 1, p["b"]["i"] + 2),
    )
    repeat = F.when(F.size("_s") > 1, F.size(F.array_distinct(F.flatten(twice)))).otherwise(0).cast("long")
    done = counted.withColumn("n_repeat_words", F.coalesce(repeat, F.lit(0).cast("long"))).drop("_s")
    return done.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _rates() -> dict[str, Column]:
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return {"symbols": F.col("n_symbols") / words, "dup_lines": F.col("n_dup_lines") / lines, "word_length": F.when(F.col("unspaced"), 0.0).otherwise(F.col("word_chars") / words)}


def _fails(strict: bool) -> Column:
    rates = _rates()
    out = F.lit(False)
    for name, normal, tight in RULES:
        out = out | (rates[name] > F.lit(tight if strict else normal))
    return out


def host_verdicts(metrics: DataFrame) -> DataFrame:
    """(host, host_rate, host_bad): failure rate of each host, shrunk to the corpus.

    A document counts as failing if it fails the base rules or any rule of the
    method at its normal limit. The prior beta(a, b) of hosts' rates is fitted by
    moments over all hosts, each weighing alike; a host's rate is
    (a + failures) / (a + b + documents). Two small aggregates with map-side
    combine; a hot host is one row a map task.
    """
    failed = (F.col("base_failed") | _fails(False)).cast("int")
    hosts = metrics.groupBy("host").agg(F.count("*").alias("n"), F.sum(failed).alias("f"))
    rate = F.col("f") / F.col("n")
    moments = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"), F.avg(1 / F.col("n")).alias("r"), F.count("*").alias("h")).first()
    mean = min(max(moments["m"] if moments["m"] is not None else 0.5, 1e-6), 1 - 1e-6)
    # Of the spread of the raw rates, the part that sampling alone would give is taken off.
    spread = max((moments["v"] or 0.0) - mean * (1 - mean) * (moments["r"] or 0.0), 0.0)
    strength = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e4) if spread > 0 else 1e4 if (moments["h"] or 0) > 1 else 1.0
    shrunk = (F.lit(mean * strength) + F.col("f")) / (F.lit(strength) + F.col("n"))
    return hosts.select("host", shrunk.alias("host_rate"), (shrunk > BAD_RATE).alias("host_bad"))


def judge_documents(spark: SparkSession, docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Metrics and verdict of each document of ``docs`` (doc_id, text, source).

    A document is kept if it passes the base rules (50 words or more, at most
    half of its words in repeated 3-word windows) and the method's rules: share
    of symbols, share of repeated lines and mean word length (not where most
    letters are of a script written without spaces), at the strict limits if its
    host's shrunk failure rate is above one half, else at the normal ones. So a
    clean document of a bad host stays.

    The metrics are one pass over whole texts, written as a narrow table; hosts
    are aggregated from it and joined back, by broadcast while the measured
    number of hosts is bounded, else by a shuffled join of narrow rows that AQE
    splits at hot hosts. Columns of ``keep`` ride along.

    Null texts are empty, a null source is the host "", null doc_ids and repeated
    rows are judged each for itself, further columns are ignored, and no rows
    give none. A very long text is held whole by its task, with a window a word,
    sorted; a share or rate at its limit passes.
    """
    scratch = Scratch(spark, "quality")
    metrics = scratch.table(document_metrics(docs, keep), "metrics")
    hosts = scratch.table(host_verdicts(metrics), "hosts")
    joined = metrics.join(bounded_broadcast(spark, hosts, hosts.count()), "host", "left")
    fails = F.when(F.col("host_bad"), _fails(True)).otherwise(_fails(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~fails)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of all documents."""
    judged = judge_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 9).alias("host_rate"))
