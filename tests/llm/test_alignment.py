"""Cross-tokenizer alignment against whole texts and all pairs of tokens."""

import random

import pytest
from tests.llm import brute
from tickerloom.llm import token_alignment

KEYS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def odd_texts(n: int = 120) -> list[str | None]:
    rng = random.Random(5)
    parts = ["word", "Tiea.", "don't", " ", "  ", "   ", "\n", "\n ", " \t", "\r\n", "▁", " ", "　", "\x1c", "\x00", "café", "漢字", "\U0001f600", "<|endoftext|>", "</s>", "<0x0A>", "12345", "é", "...", "'ll", "﻿", "​"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 25))) for _ in range(n)]
    return [None, "", " ", "  ", "a", " a", "a ", "\n", *texts, texts[3], texts[3], "x" * 3000, "漢" * 500]


def rows(frame) -> dict:
    return {r["doc_id"]: {k: r[k] for k in KEYS} for r in frame.collect()}


def test_odd_texts(spark, monkeypatch):
    docs = [{"doc_id": k, "text": t} for k, t in enumerate(odd_texts())]
    want = {r["doc_id"]: {k: r[k] for k in KEYS} for r in brute.alignments(docs)}
    assert sum(r["n_a"] > 0 for r in want.values()) > 60 and any(r["n_a"] == 0 for k, r in want.items() if k > 1)
    frame = spark.createDataFrame([(r["doc_id"], r["text"], 1, "x") for r in docs], "doc_id long, text string, units int, block string").repartition(3)
    assert rows(token_alignment.align_documents(frame)) == want
    # small blocks, and counts joined by a shuffle: the same
    monkeypatch.setattr(token_alignment, "BLOCK_CHARS", 200)
    monkeypatch.setattr(token_alignment, "BROADCAST_PAIRS", 0)
    assert rows(token_alignment.align_documents(frame)) == want


def test_whole_table(spark):
    path = "/root/testdata/sf0.001"
    docs = [r.asDict() for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    short = [r for r in docs if len(r["text"] or "") < 1500]
    want = {r["doc_id"]: {k: r[k] for k in KEYS} for r in brute.alignments(short)}
    assert rows(token_alignment.align_documents(spark.createDataFrame([(r["doc_id"], r["text"]) for r in short], "doc_id long, text string"))) == want
    assert token_alignment.op12_token_alignment(spark, path).count() == len(docs)


def test_units_are_whole():
    for text in odd_texts(400)[2:]:
        assert "".join(token_alignment.units_of(text)) == " " + text


def test_null_ids_repeats_and_no_rows(spark):
    frame = spark.createDataFrame([(None, "one two"), (1, "one two"), (1, "one two"), (2, None)], "doc_id long, text string")
    got = token_alignment.align_documents(frame).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_links"], r["count_sum"]) for r in got)[0] == (False, 1, got[0]["n_links"] or 2, 6)
    assert len(got) == 4
    assert token_alignment.align_documents(frame.where("doc_id = 9")).collect() == []


@pytest.mark.parametrize("text", ["x " * 60_000, "y" * 60_000])
def test_long_texts_are_linear(spark, text):
    got = token_alignment.align_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert got["n_groups"] > 0 and got["n_links"] == got["n_a"] + got["n_b"] - got["n_groups"]


def test_ends_are_held_once_a_shape(spark):
    """Where tokens end travels once for all units that are cut alike, and each unit's shape is its own."""
    import public_tokenizers

    path = {x: public_tokenizers.path(x) for x in ("byte_bpe_50k.tiktoken", "piece_bpe_32k.model")}
    frame = spark.createDataFrame([(k, f"w{k} the an of tokenization {k} café 漢字") for k in range(300)], "doc_id long, text string").coalesce(1)
    block = token_alignment.tokenised(frame, *path.values()).collect()
    assert len(block) == 1
    block = block[0]
    assert len(block["shape"]) == len(block["tokens"]) > 600 and len(block["a_ends"]) == len(block["b_ends"]) == len(set(block["shape"])) < 100
    assert all(len(x) == len(block["a_ends"][k]) + len(block["b_ends"][k]) for x, k in zip(block["tokens"], block["shape"]))


def test_a_task_tells_each_unit_once(spark, monkeypatch):
    """Blocks of one task share its units, and a block tells each id pair once, with its documents' number; the rest is packed."""
    import public_tokenizers

    monkeypatch.setattr(token_alignment, "BLOCK_CHARS", 200)
    path = [public_tokenizers.path(x) for x in ("byte_bpe_50k.tiktoken", "piece_bpe_32k.model")]
    frame = spark.createDataFrame([(k, f"the tokenization of {k % 7} café the") for k in range(60)], "doc_id long, text string").coalesce(1)
    tokenised = token_alignment.tokenised(frame, *path)
    blocks = sorted(tokenised.collect(), key=lambda r: r["block"])
    assert len(blocks) > 5 and sum(len(r["tokens"]) for r in blocks) == 4 + 7
    assert [r["known"] for r in blocks] == [sum(len(x["tokens"]) for x in blocks[:k]) for k in range(len(blocks))]
    for r in token_alignment.placed(token_alignment.aligned_blocks(tokenised)).collect():
        assert len(r["pairs"]) == len(set(r["pairs"])) == len(r["holders"]) and max(r["holders"]) == len(r["doc_ids"])
        sizes, units, n_links, places = token_alignment._unpacked(r["packed"])
        assert sizes.tolist() == [6] * len(r["doc_ids"]) and units.max() == len(n_links) - 1 and places.max() == len(r["pairs"]) - 1
    # units are forgotten in between: the same rows
    want = rows(token_alignment.align_documents(frame))
    monkeypatch.setattr(token_alignment, "KNOWN_CHARS", 0)
    assert rows(token_alignment.align_documents(frame)) == want
