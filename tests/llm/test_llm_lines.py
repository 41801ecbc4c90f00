"""Lines that recur: short ones, long ones in two documents, rows of numbers."""

import brute

from quirelake.llm.line_dedup import drop_recurring_lines
from quirelake.llm.queries import QUERIES


def cleaned(spark, make_docs, texts):
    got = drop_recurring_lines(spark, make_docs([(d, t, "s") for d, t in enumerate(texts)])).collect()
    return [r.text for r in sorted(got, key=lambda r: r.doc_id)]


def test_short_lines_recur(spark, make_docs):
    own = ["a line that only this one has", "quite other words stand in that one", "nothing of this is seen again here"]
    texts = [f"All rights reserved.\n\n{x}\n版权所有不得转载\nPage {i} end" for i, x in enumerate(own)]
    assert cleaned(spark, make_docs, texts) == [texts[0], f"\n{own[1]}", f"\n{own[2]}"]
    # Two documents are not enough, and short lines that differ in a word are not alike.
    texts = ["One two three four\nYes.", "One two three five\nYes.", "One two three six"]
    assert cleaned(spark, make_docs, texts) == texts


def test_long_lines_recur_from_two_documents_on(spark, make_docs):
    words = [f"{a}{b}" for a in "abcdefgh" for b in "klmnopqr"]
    long, unspaced = " ".join(words[:51]), "版权所有不得转载本文" * 10
    texts = [f"one here\n{long}\n{' '.join(words[:20])}\n{unspaced}", f"one there\n{long}\n{' '.join(words[:20])}\n{unspaced}"]
    assert cleaned(spark, make_docs, texts) == [texts[0], f"one there\n{' '.join(words[:20])}"]


def test_rows_of_numbers_are_told_by_their_exact_text(spark, make_docs):
    rows = [[f"{d}.{k} {d * k} 3 4 5\nx {d} {k} 7 {d + k}\n{d}{k}" for k in range(3)] for d in range(4)]
    texts = ["\n".join(r) + "\n1 2 3 4 5 6\nuser 12 logged in from host7" for r in rows]
    tail = "\n1 2 3 4 5 6\nuser 12 logged in from host7"
    assert cleaned(spark, make_docs, texts) == [texts[0], *(t.removesuffix(tail) for t in texts[1:])]
    logs = [f"user {d} logged in from host{d}\nkept{chr(97 + d)}" for d in range(3)]
    assert cleaned(spark, make_docs, logs) == [logs[0], "keptb", "keptc"]


def test_query_over_whole_table(spark, sf_dir, small_docs):
    got = {r.doc_id: r.text for r in QUERIES["op8_line_dedup"](spark, sf_dir).collect()}
    assert got == brute.line_dedup(small_docs)
