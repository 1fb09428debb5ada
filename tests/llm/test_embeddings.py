"""Vector codes against all entries, near vectors against all pairs, and the rounds of components."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from tickerloom.llm import code_compression, embedding_dedup
from tickerloom.llm.components import components

SF = "/root/testdata/sf0.001"


# codes


def brute_codes(rows: list[tuple], rounds: int = 2) -> dict:
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max(len(v) for _, v, _ in kept) // 16))
    kept = [(i, v + [0] * (16 * width - len(v)), label) for i, v, label in kept]
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(v, p) for _, v, _ in sorted(kept, key=lambda r: (r[0] is None, r[0]))[:64]] for p in range(16)]
    near = lambda q, book: min((sum((x - y) ** 2 for x, y in zip(q, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            members = defaultdict(list)
            for _, v, _ in kept:
                members[near(part(v, p), book)[1]].append(part(v, p))
            books[p] = [[sum(c) // len(c) for c in zip(*members[k])] if k in members else e for k, e in enumerate(book)]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    found = [(i, [near(part(v, p), books[p]) for p in range(16)], label) for i, v, label in kept]
    errors = defaultdict(int)
    for _, best, label in found:
        errors[label] += sum(d for d, _ in best)
    return {i: ("".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), errors[label], digest) for i, best, label in found}


def coded(frame) -> dict:
    return {r["vec_id"]: (r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in frame.collect()}


def test_codes_and_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(k), rng.normal(size=32).round(2).tolist(), int(k) % 3 if k % 5 else None) for k in rng.permutation(150)]
    rows += [(150, rows[0][1], 0), (151, [0.0] * 32, 1), (152, None, 1), (153, [float("nan")] + [0.0] * 31, 1), (154, [None] + [0.0] * 31, 1), (155, [float("inf")] * 32, 1)]
    rows += [(156, [], 2), (157, [1.5] * 20, 2), (158, [-1e-9] * 32, None), (159, [65000.0, -65000.0] * 16, 7)]
    frame = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<float>, label int, code string, n int").repartition(3)
    want = brute_codes(rows)
    assert len(want) == 156 and coded(code_compression.compress_vectors(frame)) == want
    monkeypatch.setattr(code_compression, "CHUNK", 7)
    monkeypatch.setattr(code_compression, "LABEL_ROWS", 10)
    assert coded(code_compression.compress_vectors(frame)) == want


def test_few_equal_and_no_vectors(spark):
    schema = "vec_id long, embedding array<double>, label string"
    rows = [(k, [0.5] * 16, None) for k in range(5)]
    assert coded(code_compression.compress_vectors(spark.createDataFrame(rows, schema))) == brute_codes(rows)
    none = spark.createDataFrame([(1, None, "a")], schema)
    assert code_compression.compress_vectors(none).collect() == [] and code_compression.compress_vectors(none.where("vec_id = 2")).collect() == []
    twice = code_compression.compress_vectors(spark.createDataFrame([(None, [1.0] * 16, "a"), (1, [2.0] * 16, "a"), (1, [2.0] * 16, "a")], schema)).collect()
    assert len(twice) == 3 and {r["label_error"] for r in twice} == {0}


def test_annulus_holds_the_nearest():
    rng = np.random.default_rng(4)
    for scale in (3, 1000, 1 << 24):
        entries, q = rng.integers(-scale, scale, (64, 4)), rng.integers(-scale, scale, (3000, 4))
        index, distance = code_compression.Codebook(entries).nearest(q)
        every = ((q[:, None] - entries) ** 2).sum(axis=2)
        assert (distance == every.min(axis=1)).all() and (index == every.argmin(axis=1)).all()


# near vectors


def brute_near(rows: list[tuple], threshold: float = 0.95) -> dict:
    good = [(k, np.asarray(v, np.float64) / max(map(abs, v))) for k, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, label = defaultdict(int), list(range(len(rows)))
    for n, (i, x) in enumerate(good):
        for j, y in good[:n]:
            if len(x) == len(y) and (x / np.linalg.norm(x)) @ (y / np.linalg.norm(y)) >= threshold - 1e-12:
                links[i] += 1
                links[j] += 1
                a, b = sorted((label[i], label[j]))
                label = [a if c == b else c for c in label]
    least = {c: min(rows[k][0] for k in range(len(rows)) if label[k] == c) for c in set(label)}
    return {i: (links[k], least[label[k]], i == least[label[k]]) for k, (i, _) in enumerate(rows)}


def linked(frame) -> dict:
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in frame.collect()}


def groups_of_vectors(seed: int, size: int = 64) -> list[tuple]:
    rng, rows = np.random.default_rng(seed), []
    for many in (1, 1, 2, 2, 3, 5, 20, 60):
        base = rng.normal(size=size)
        rows += [base + rng.normal(size=size) * np.linalg.norm(base) * s / np.sqrt(size) for s in rng.uniform(0.02, 0.28, many)]
    rows += [rows[0], rows[3], 2.5 * rows[4], -rows[5]]
    return [(3 * int(k) + 1, x.tolist()) for k, x in zip(rng.permutation(len(rows)), rows)]


@pytest.mark.parametrize("block", [1024, 9])
def test_near_vectors(spark, monkeypatch, block):
    rows = groups_of_vectors(1)
    rows += [(1000, None), (1001, []), (1002, [0.0] * 64), (1003, [float("nan")] * 64), (1004, [None] + [1.0] * 63), (1005, [float("inf")] * 64)]
    rows += [(1006, [1e300] * 3), (1007, [1e-300] * 3), (1008, [1.0, 1.0, 1.01]), (1009, [1.0]), (1010, [-1.0]), (1011, [5.0])]
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "FEW", 32 if block > 9 else 4)
    monkeypatch.setattr(embedding_dedup, "CHUNK_PAIRS", 200_000 if block > 9 else 50)
    monkeypatch.setattr(embedding_dedup, "TASK_ROWS", 20_000 if block > 9 else 100)
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, bucket string, n int").repartition(3)
    assert linked(embedding_dedup.near_vectors(frame)) == brute_near(rows)


def test_repeated_rows_null_ids_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(4, [1.0, 2.0]), (4, [1.0, 2.0]), (2, [-1.0, 0.0]), (None, [1.0, 2.0]), (7, [1.0, 2.1])]
    got = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, schema)).collect()))
    assert got == [(0, 3, 4, False), (2, 0, 2, True), (4, 3, 4, True), (4, 3, 4, True), (7, 3, 4, False)]
    assert embedding_dedup.near_vectors(spark.createDataFrame([], schema)).collect() == []


def test_recall_at_the_threshold():
    """Of pairs at the threshold itself fewer than one in a thousand is in no common bucket."""
    rng = np.random.default_rng(7)
    for size, rotations in ((64, 2), (64, 3), (100, 3)):
        x, z = rng.normal(size=(2, 3000, size))
        x /= np.linalg.norm(x, axis=1)[:, None]
        z -= np.einsum("ij,ij->i", x, z)[:, None] * x
        y = 0.95 * x + math.sqrt(1 - 0.95**2) * z / np.linalg.norm(z, axis=1)[:, None]
        a, b = embedding_dedup.buckets_of(x, rotations), embedding_dedup.buckets_of(y, rotations)
        met = ((a == b[..., :1]).any(axis=2) | (b == a[..., :1]).any(axis=2)).any(axis=1)
        assert (~met).mean() < 0.001


def test_whole_table_against_all_pairs(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    rng = np.random.default_rng(9)
    near = [(10_000 + i, (np.array(v) + rng.normal(size=64) * 0.03).tolist()) for i, v in rows[:40]]
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows + near], "vec_id long, embedding array<double>")
    assert linked(embedding_dedup.near_vectors(frame)) == brute_near(rows + near)


# components


@pytest.mark.parametrize("shape", ["chain", "shuffled chain", "star", "grid"])
def test_rounds_are_logarithmic(spark, shape):
    n = 10_000 if shape == "chain" else 2_500
    names = np.random.default_rng(1).permutation(n) if shape == "shuffled chain" else np.arange(n)
    if "chain" in shape:
        links = [(names[k], names[k + 1]) for k in range(n - 1)]
    elif shape == "star":
        links = [(n - 1, k) for k in range(n - 1)]
    else:
        links = [(k, k + step) for k in range(n) for step in (1, 50) if k + step < n and (step == 50 or k % 50 < 49)]
    rounds: list[int] = []
    found = components(spark.createDataFrame([(int(a), int(b)) for a, b in links], "a long, b long"), rounds).collect()
    assert len(found) == n and {r["component"] for r in found} == {0}
    assert all(2 * b <= a for a, b in zip(rounds, rounds[1:])) and len(rounds) <= 7
