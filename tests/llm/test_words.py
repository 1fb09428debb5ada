"""BPE and packing against the tokenizers library and brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from tests.llm import brute
from tickerloom.llm import bpe, packing, words

public_tokenizers = pytest.importorskip("public_tokenizers")

ODD = [
    "", None, "  a  b\n\n c ", "it's we'll 'tis\t\tx", " \x1c\x1d a\x1cb", "foo  <|endoftext|>bar <|endoftext|>", "<|endoftext|>", "　x \xa0y",
    "é́ ñ 日本語 テスト 🙂🙂", "a\x85b \x85 c", "\r\n\r\n x", " ", "\n", "123 456,789 --- ...", "x" * 5000, "a᠎b ​ c",
    "It's WE'LL foo. Bar,baz |x| ÉCOLE, straße ẞ İx Σας ΣΑΣ. 12,3 a1. b2, ﬁ, µ. Ÿ. café.", "word " * 5000,
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")


def test_bpe(spark):
    tokenizer = words.load(public_tokenizers.path("byte_bpe_50k.json"))
    docs = frame(spark, ODD)
    got = {r.doc_id: r for r in bpe.encode_documents(docs, digests=True).collect()}
    plain = bpe.encode_documents(docs)
    ids = {r.doc_id: r.ids for r in plain.collect()}
    for i, text in enumerate(ODD):
        want = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert ids[i] == want and got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(tokenizer.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert {r.doc_id: r.text for r in bpe.decode_documents(plain).collect()} == {i: t or "" for i, t in enumerate(ODD)}
    assert bpe.encode_documents(docs.where("false")).count() == 0


def test_blocks_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 40)
    docs = spark.createDataFrame([(i % 7, f"word{i % 5} the the end") for i in range(60)], "doc_id long, text string")
    got = Counter((r.doc_id, tuple(r.ids)) for r in bpe.encode_documents(docs).collect())
    tokenizer = words.load(public_tokenizers.path("byte_bpe_50k.json"))
    assert got == Counter((i % 7, tuple(tokenizer.encode(f"word{i % 5} the the end").ids)) for i in range(60))


def layout_holds(rows, capacity=2048):
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack_documents(frame(spark, ODD)).collect()
    want = brute.packed_pieces(words.load(path), [{"doc_id": i, "text": t} for i, t in enumerate(ODD)])
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    assert layout_holds(rows) == math.ceil(sum(r.length for r in rows) / 2048)
    assert packing.pack_documents(frame(spark, ODD).where("false")).count() == 0


def test_tokenizers_that_keep_case_are_refused(spark):
    with pytest.raises(ValueError):
        words.Encoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_packing_of_ties(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 20)
    rng = random.Random(1)
    pieces = [(i // 2, 0, 0, rng.choice([700, 700, 700, 1400, 30, 2048, 1]), 5) for i in range(300)]
    rows = packing.pack(spark.createDataFrame(pieces, packing.PIECES)).collect()
    assert Counter((r.doc_id, r.length) for r in rows) == Counter((p[0], p[3]) for p in pieces)
    layout_holds(rows)


@pytest.mark.parametrize("groups", [8, 64, 512])
def test_plan(groups):
    rng = np.random.default_rng(groups)
    lengths = np.minimum(2048, rng.lognormal(5.5, 1.2, 20_000).astype(int) + 1)
    hist = Counter(lengths.tolist())
    sequences, places = packing.plan(dict(hist), 2048, groups)
    placed: dict[int, list] = {}
    for length, rank, n, sequence, offset in places:
        placed.setdefault(length, []).append((rank, n))
    for length, runs in placed.items():
        at = 0
        for rank, n in sorted(runs):
            assert rank == at
            at += n
        assert at == hist[length]
    assert set(placed) == set(hist)
    fill = np.zeros(sequences, np.int64)
    for length, _, n, sequence, _ in places:
        fill[sequence : sequence + n] += length
    assert fill.max() <= 2048
    assert packing.best_plan(dict(hist))[0] <= sequences
    assert sequences <= 1.02 * math.ceil(lengths.sum() / 2048) + 1
