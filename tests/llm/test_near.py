"""The Jaccard join, components and fingerprints against brute force."""

import hashlib
import random

import numpy as np
from tests.llm import brute
from tickerloom.llm import fingerprints, jaccard_join
from tickerloom.llm.components import components


def planted(seed: int) -> list[dict]:
    """Groups of near copies at similarities around the threshold, a passage that most share, short and empty texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choices(words, k=60))
    docs: list[str | None] = []
    for _ in range(30):
        base = rng.choices(words, k=rng.choice([6, 8, 12, 25, 60, 300]))
        for _ in range(rng.choice([1, 2, 5])):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 15))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append(" ".join(copy) + (" " + passage if rng.random() < 0.4 else ""))
    hub = rng.choices(words, k=200)
    for _ in range(60):
        copy = list(hub)
        for _ in range(rng.randrange(0, 7)):
            copy[rng.randrange(200)] = rng.choice(words)
        docs.append(" ".join(copy))
    docs += [None, "", " \n", "One Two", "one\ttwo", "one two three", "a b c d e", "A B C D E", "a b c d e f", passage, passage + " end", docs[0], docs[0].upper()]
    rng.shuffle(docs)
    return [{"doc_id": 3 * i + 1, "text": t} for i, t in enumerate(docs)]


def test_jaccard_components(spark):
    for seed in (1, 2):
        docs = planted(seed)
        sizes, component = brute.near_components(docs)
        got = jaccard_join.jaccard_components(spark.createDataFrame([(r["doc_id"], r["text"], "x", 1) for r in docs], "doc_id long, text string, n string, h1 int")).collect()
        assert len(got) == len(docs)
        assert {r.doc_id: r.n_shingles for r in got} == sizes
        assert {r.doc_id: r.component_id for r in got} == component


def test_common_shingles_and_large_keys(spark, monkeypatch):
    """Every shingle common, and every key large: the last resorts find the same components."""
    docs = planted(3)
    _, component = brute.near_components(docs)
    frame = spark.createDataFrame([(r["doc_id"], r["text"]) for r in docs], "doc_id long, text string")
    for name, value in (("SAMPLE", 1), ("LEAST_COMMON", 2), ("PAIRS_UP_TO", 1), ("BLOCK", 8), ("BLOCK_SHINGLES", 900), ("CHECKED_BYTES", 2000), ("KEPT_SETS", 3)):
        monkeypatch.setattr(jaccard_join, name, value)
    got = jaccard_join.jaccard_components(frame).collect()
    assert {r.doc_id: r.component_id for r in got} == component


def test_common_shingles_stay_few(spark, monkeypatch):
    """Where there are more common shingles than the bitmap is made for, only the commonest count, and segments remain."""
    docs = planted(5)
    _, component = brute.near_components(docs)
    frame = spark.createDataFrame([(r["doc_id"], r["text"]) for r in docs], "doc_id long, text string")
    for name, value in (("SAMPLE", 1), ("LEAST_COMMON", 1), ("MOST_COMMON", 300)):
        monkeypatch.setattr(jaccard_join, name, value)
    bitmap = jaccard_join.common_shingles(frame)
    assert 0 < int(np.unpackbits(bitmap[0].view(np.uint8)).sum()) <= 300
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(frame).collect()} == component


def test_sets_whose_hashes_clash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "_hashes", lambda s: (len(s), len(s)))
    docs = [(1, "a b c d e"), (2, "v w x y z"), (3, "a  b c d E"), (4, None)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 1, 4: 4}


def test_each_allocation_finds_the_same(spark, monkeypatch):
    docs = planted(4)
    _, component = brute.near_components(docs)
    frame = spark.createDataFrame([(r["doc_id"], r["text"]) for r in docs], "doc_id long, text string")
    for option in jaccard_join.OPTIONS[1:3]:
        monkeypatch.setattr(jaccard_join, "allocate", lambda *_, o=option: {band: o for band in range(20)})
        assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(frame).collect()} == component


def test_hashes_tell_apart_what_a_polynomial_cannot(spark):
    """Two Thue-Morse words of opposite letters are equal under any polynomial hash modulo 2**64."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    docs = [(1, f"w1 w2 w3 w4 {word}"), (2, f"w1 w2 w3 w4 {other}"), (3, f"W1 w2  w3 w4 {word}")]
    got = jaccard_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 1}


def test_near_goes_by_words(monkeypatch):
    """Where hashes clash, the words decide; and one text of a million words, one of a single long word."""
    from tickerloom.llm import shingles

    x, y = shingles.shingles(["a b c d e f g h", "a b c d e f g i"])
    assert not shingles.near(x, y) and shingles.near(x, x)
    y.hashes = x.hashes
    assert not shingles.near(x, y)
    long = " ".join(f"w{i % 999_983}" for i in range(1_000_000))
    one, two, three = shingles.shingles([long, long + " end", "z" * 5_000_000])
    assert shingles.near(one, two) and not shingles.near(one, three) and len(three.hashes) == 1


def test_repeats_of_a_passage_are_one_class(spark):
    """Equal sets of different words in order are compared, and linked."""
    passage = " ".join(f"p{i}" for i in range(40))
    looped = " ".join([passage] * 3)
    docs = [(1, looped), (2, " ".join([passage] * 5)), (3, passage), (4, "other words than these are here")]
    got = jaccard_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_jaccard_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.jaccard_components(empty).count() == 0
    repeated = spark.createDataFrame([(4, "a b c"), (4, "a b c"), (None, "a b c"), (9, "A b c")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard_join.jaccard_components(repeated).collect())
    assert got == [(0, 4), (4, 4), (4, 4), (9, 4)]


def test_components(spark):
    rng = random.Random(7)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 180)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(500, 500)]
    parent = {i: i for e in links for i in e if e[0] != e[1]}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: root(i) for i in parent}


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distances():
    rng, letters = random.Random(3), fingerprints.ALPHABET.tobytes().decode()
    word = lambda: "".join(rng.choices(letters[: rng.choice([2, 5, 64])], k=rng.randrange(0, 65)))
    pairs = [(word(), word()) for _ in range(300)]
    assert fingerprints.edit_distances(pairs).tolist() == [distance(a, b) for a, b in pairs]


def slow_fingerprint(text: str) -> str:
    """By the definition, one byte at a time."""
    data, m, letters = text.encode(), 1 << 64, fingerprints.ALPHABET.tobytes().decode()
    powers = [pow(fingerprints._BASE, k, m) for k in range(len(data) + 1)]
    hashed = lambda s: sum(int(fingerprints._BYTES[c]) * powers[k] for k, c in enumerate(s)) % m
    rolled = [hashed(data[max(0, i - 6) : i + 1]) >> 33 for i in range(len(data))]

    def signature(size, longest):
        pieces, start = [], 0
        for i, h in enumerate(rolled):
            if (h + 1) % size == 0 and len(pieces) < longest - 1:
                pieces.append(data[start : i + 1])
                start = i + 1
        pieces += [data[start:]] if start < len(data) else []
        mixed = [(h ^ h >> 29) * 0xBF58476D1CE4E5B9 % m for h in map(hashed, pieces)]
        return "".join(letters[h >> 58] for h in mixed)

    k = 0
    while data and 3 << k < len(data) / 64:
        k += 1
    while k and sum((h + 1) % (3 << k) == 0 for h in rolled) < 32:
        k -= 1
    return f"{3 << k}:{signature(3 << k, 64)}:{signature(6 << k, 32)}"


def test_fingerprints(spark):
    rng = random.Random(5)
    texts = ["", None, "a", "abcdefg", "é🙂" * 10] + [" ".join(rng.choices(["alpha", "béta", "gamma", "delta", "x"], k=rng.randrange(1, 700))) for _ in range(40)]
    texts += [texts[7], texts[7] + " more"]
    rows = [(i * 2 - 9, t, 1) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string, part int")).collect()}
    assert len(got) == len(rows)
    for k, (i, text, _) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (slow_fingerprint(text), slow_fingerprint(edited))
        assert r.near_next == fingerprints.likeness([(r.fingerprint, slow_fingerprint(following))])[0]
        assert r.near_edited == fingerprints.likeness([(r.fingerprint, r.edited_fingerprint)])[0]
    assert got[rows[-1][0]].near_edited >= 0.4


def test_fingerprints_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fingerprints.fingerprint_documents(empty).count() == 0
    one = fingerprints.fingerprint_documents(spark.createDataFrame([(None, "only")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(None, 1.0)]
    assert fingerprints.fingerprint_documents(spark.createDataFrame([(1, "b"), (1, "a"), (1, "a")], "doc_id long, text string")).count() == 3


def test_one_of_each_group_without_or_with_repeated_ids(spark):
    one, two, three, four = (" ".join(f"{c}{i}" for i in range(60)) for c in "abcd")
    rows = [(None, one), (7, one + " more"), (7, one + " more"), (None, two), (None, two + " more"), (5, three), (5, four), (9, four), (3, four + " more"), (None, None), (None, ""), (8, ""), (8, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string").repartition(3)
    found = jaccard_join.one_of_each_group(docs)
    got = sorted(((r.doc_id or 0, (r.text or "")[:1]) for r in found.collect()))
    assert found.columns == docs.columns
    assert got == [(0, ""), (0, ""), (0, "b"), (3, "d"), (5, "c"), (7, "a"), (8, "")]
