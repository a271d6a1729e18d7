"""The pipeline's last stage decodes what it has encoded."""

import hashlib

from test_llm import BYTE, documents

import corpus_pipeline
from tracewright.llm import encoding


def test_last_stage_decodes(spark, monkeypatch):
    rows = [(1, "Hello there"), (2, None), (3, ""), (4, "é 日本\n x")]
    got = {r.doc_id: r for r in corpus_pipeline.encode_tokens(spark, documents(spark, rows), None).collect()}
    assert all(got[i].round_trip and got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for i, t in rows)
    right = encoding.encode
    monkeypatch.setattr(encoding, "encode", lambda docs, path: right(docs.selectExpr("doc_id", "lang", "source", "n_chars", "text AS whole", "concat(text, '!') AS text"), path).selectExpr("* EXCEPT (text, whole)", "whole AS text"))
    wrong = {r.doc_id: r.round_trip for r in corpus_pipeline.encode_tokens(spark, documents(spark, rows), None).collect()}
    assert wrong == {1: False, 2: True, 3: False, 4: False}
