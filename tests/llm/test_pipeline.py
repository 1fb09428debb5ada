"""The pipeline against brute-force versions of its stages, and the registered queries."""

from pathlib import Path

import pytest

import __spark_entry__
import corpus_pipeline
from tests.llm import brute
from tickerloom.llm import jaccard_join, queries, secret_scan, words

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def test_stages(spark):
    docs, columns = spark.read.parquet(f"{SF}/documents.parquet"), None
    columns = docs.columns
    out = {"documents": [r.asDict() for r in docs.collect()]}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        rows = [r.asDict() for r in docs.collect()]
        docs = spark.createDataFrame(rows, docs.schema)
        out[name] = rows
        assert name == "best_fit_packing" or docs.columns == columns
    start = out["documents"]
    assert out["language_id"] and {r["doc_id"] for r in start if any(c.isalpha() for c in r["text"] or "")} == {r["doc_id"] for r in out["language_id"]}
    same = brute.same_text(out["language_id"])
    assert {r["doc_id"] for r in out["exact_dedup"]} == set(same.values())
    _, near = brute.near_components(out["exact_dedup"])
    assert {r["doc_id"] for r in out["jaccard_join"]} == set(near.values())
    clean = {r["doc_id"]: r["text"] for r in out["jaccard_join"]}
    for r in out["secret_scan"]:
        assert not brute.base_spans(r["text"])
        assert r["text"] == clean[r["doc_id"]] or brute.base_spans(clean[r["doc_id"]]) or "[SECRET]" in r["text"]
    import public_tokenizers

    want = brute.packed_pieces(words.load(public_tokenizers.path("word_bpe_49k.json")), out["secret_scan"])
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in out["best_fit_packing"]} == want
    ran = corpus_pipeline.run(spark, SF)
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in ran.collect()} == want


def test_stages_of_odd_tables(spark):
    """No rows; nulls in every column; repeated rows and ids; columns that operators use names of."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, _row long, best string"
    rows = [(None, None, None, None, None, None, None, None, None)] * 2 + [(i % 5, f"the same words here again and more of them {i % 3}", "en", "s", 40, 0.5, "x", 7, "b") for i in range(40)]
    for frame in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = frame
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            if name != "best_fit_packing":
                assert docs.columns == frame.columns
                docs = spark.createDataFrame(docs.collect(), schema)
        assert docs.count() == (3 if frame.count() else 0)


def test_queries_are_registered():
    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{n}" for n in range(1, 11)}
    assert set(queries.queries()) <= names and "pipeline" in names
    assert jaccard_join.QUERIES and secret_scan.QUERIES
