"""run() of the pipeline against its stages in plain Python and SQL."""

import brute
import numpy as np
import pytest

import corpus_pipeline
from quirelake.llm.oracles import ORACLE_SQL

P = pytest.importorskip("public_tokenizers")


def test_run_gives_what_plain_stages_give(spark):
    from tokenizers import Tokenizer

    sf_dir = "/root/testdata/sf0.01"  # in the smaller table no near duplicates are left after the lines
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    kept = {r["doc_id"] for r in brute.sql_on(docs, ORACLE_SQL["op4_quality_rules"]) if r["kept"]}
    docs = [d for d in docs if d[0] in kept]
    cleaned = brute.line_dedup([(d, t) for d, t, _ in docs])
    docs = [(d, cleaned[d], s) for d, t, s in docs if cleaned[d] == t or brute.WORD.search(cleaned[d])]
    component, _ = brute.near_documents([(d, t) for d, t, _ in docs], 5, 80)
    before = len(docs)
    docs = [d for d in docs if component[d[0]] == d[0]]
    assert len(docs) < before
    spans = {}
    for r in brute.sql_on(docs, ORACLE_SQL["op5_secret_scan"]):
        spans[r["doc_id"]] = [tuple(map(int, s.split(":")[1:])) for s in r["spans"].split(",") if s]
    assert any(spans.values())
    words = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {d: np.array(words.encode(brute.redact(t, spans[d]), add_special_tokens=False).ids + [2], "<u4") for d, t, _ in docs}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert brute.check_packing(got, ids) > 0.9
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == ids[r.doc_id][r.start : r.start + r.length].tolist()


def test_stages_cope_with_odd_rows(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows).select(*corpus_pipeline.COLUMNS)
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/nowhere")
        assert name == "packing" or out.columns == list(corpus_pipeline.COLUMNS)
        got[name] = out.collect()
        assert stage(spark, docs.limit(0), "/nowhere").count() == 0
    whole = sorted(((d, t) for d, t, _ in odd_rows), key=repr)
    told = lambda name: sorted(((r.doc_id, r.text) for r in got[name]), key=repr)
    assert told("quality rules") == sorted(((d, t) for d, t, _ in odd_rows if not brute.quality(t)[-1] and "a\nb" not in (t or "")), key=repr)
    # "one" and the plain line lie in three documents or fewer: rows of one doc_id and text lose the same.
    kept = dict.fromkeys(d for d, _ in told("line dedup"))
    assert {1, 2, 3, 4, 7, 8, 9, 10, 11} <= set(kept) and (1, None) in told("line dedup") and (2, "") in told("line dedup")
    # The smallest doc_id of a group stays with all its rows; null texts and ids do too.
    assert told("near dedup") == sorted(((d, t) for d, t in whole if d not in (6, 11)), key=repr)
    assert told("secret scan") == sorted(((d, "under the MIT License [SECRET]" if d == 9 else t) for d, t in whole), key=repr)
    starts = [(r.doc_id, r.doc_tokens) for r in got["packing"] if r.start == 0]
    assert sorted((d for d, _ in starts), key=repr) == sorted((d for d, _, _ in odd_rows), key=repr) and sum(r.length for r in got["packing"]) == sum(n for _, n in starts)


def test_stages_are_named():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "secret scan", "packing"]
