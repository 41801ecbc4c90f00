import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

#: Columns of other operators' results and inner steps, as an input may have them too.
CLASHES = ["n_lines", "n_dropped", "kept", "spans", "th", "row", "base", "hits", "host", "component", "node", "a", "b", "start", "ids", "key", "_t", "_w", "_doc", "_th", "_own", "_row", "_keep", "_spans", "_clean"]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of (doc_id, text, source) rows, with further columns of clashing names."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
        return spark.createDataFrame([(d, t, None, s, len(t) if t is not None else None, *["x"] * len(CLASHES)) for d, t, s in rows], schema)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, very long, repeated and tied rows."""
    long = " ".join(f"word{i % 7919} and more" for i in range(60_000))
    plain = "the quick brown fox jumps over the lazy dog and runs into the dark wood again " * 5
    return [
        (None, plain, "s"), (1, None, "s"), (2, "", None), (3, " \n\t ", "s"), (4, long, "s"), (5, plain, "s"), (5, plain, "s"), (5, plain + "end", "t"),
        (6, plain, None), (7, "one", "s"), (8, "é 中文 😀 <|endoftext|> </s> ▁ x", "s"), (9, "under the MIT License token: abcdefGHIJ0123456789xyz", "t"),
        (10, "a\nb\nc\n" * 50, "t"), (None, None, None), (11, "one", "s"),
    ]


@pytest.fixture(scope="session")
def small_docs(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
