"""Line dedup against brute force."""

import random
from collections import defaultdict

from tickerloom.llm import line_dedup as ld


def brute(docs):
    """doc_id to its kept text."""
    field = lambda t: ld.FIELD if any(c.isdigit() and c.isascii() for c in t) else t
    needed = lambda n: max(ld.LEAST_DOCS, -(-ld.TOKENS_SEEN // n))
    leaves = defaultdict(list)
    for i, text in docs:
        for place, line in enumerate((text or "").split("\n")):
            tokens = [field(t) for t in line.split()]
            if i is not None and tokens:
                leaves[len(tokens), *tokens[: ld.DEPTH]].append((i, place, tokens))
    drop = defaultdict(set)
    for (size, *_), lines in leaves.items():
        need = needed(size)
        holders, support = defaultdict(set), defaultdict(int)
        for i, _, tokens in lines:
            holders[tuple(tokens)].add(i)
        for tokens, ids in holders.items():
            for at, t in enumerate(tokens):
                support[at, t] += len(ids)
        by = defaultdict(list)
        for i, place, tokens in lines:
            constant = [t != ld.FIELD and support[at, t] >= need for at, t in enumerate(tokens)]
            if sum(constant) / size >= ld.LEAST_SHARE:
                by[tuple(t if c else ld.FIELD for t, c in zip(tokens, constant))].append((i, place))
        for places in by.values():
            ids = {i for i, _ in places}
            if len(ids) >= need:
                for i, place in places:
                    if i > min(ids):
                        drop[i].add(place)
    return {i: "\n".join(x for k, x in enumerate((text or "").split("\n")) if k not in drop[i]) for i, text in docs}, sum(map(len, drop.values()))


def test_line_dedup(spark):
    rng = random.Random(4)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    passage = " ".join(rng.choices(words, k=60))
    docs = []
    for i in range(80):
        lines = [" ".join(rng.choices(words, k=rng.randrange(1, 40))) for _ in range(rng.randrange(0, 5))]
        if rng.random() < 0.3:
            lines.insert(rng.randrange(len(lines) + 1), f"This work by {rng.choice(words)} is licensed under version {rng.randrange(9)}.0 of that license")
        if rng.random() < 0.1:
            lines.append(passage)
        if rng.random() < 0.4:
            lines += ["", "All rights", "All rights reserved.", "  "]
        docs.append((i, "\n".join(lines)))
    docs += [(100, None), (101, ""), (102, "x " * 30_000 + "\n" + passage)]
    want, dropped = brute(docs)
    assert dropped > 30
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n_lines int, place string")
    got = ld.drop_lines(frame).collect()
    assert {r.doc_id: r.text or "" for r in got} == want
    assert sum(r.n_dropped for r in got) == dropped and all(r.n_lines == len((dict(docs)[r.doc_id] or "").split("\n")) for r in got)


def test_large_leaves_are_counted_by_spark(spark, monkeypatch):
    """The same lines go whichever way a leaf is worked out; and a leaf of many lines in one document."""
    docs = [(i, f"This work by n{chr(97 + i % 26)}{chr(97 + i // 26)} of some city is under the terms of that licence\n" + "menu\n" * (i % 2)) for i in range(100)]
    docs.append((200, "\n".join(f"a b c {chr(97 + i % 26)}x d e f g h i" for i in range(300))))
    want, dropped = brute(docs)
    assert dropped == 99 + 49
    for tokens in (ld.TASK_TOKENS, 50, 0):
        monkeypatch.setattr(ld, "TASK_TOKENS", max(tokens, 1))
        got = ld.drop_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        assert {r.doc_id: r.text for r in got} == want


def test_odd_tables(spark):
    frame = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (8, "\n" * 100_000)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text, r.n_dropped) for r in ld.drop_lines(frame).collect()) == [(0, "a b c d", 0), (7, "a b c d", 0), (7, "a b c d", 0), (8, "\n" * 100_000, 0)]
    assert ld.drop_lines(frame.where("false")).count() == 0


def test_a_template_is_found_at_every_size(spark):
    """Each name and city is held by n / 100 documents; a rare template and a rare passage are in the common one's leaf."""
    word = lambda kind, i: f"{kind}{chr(97 + i // 10)}{chr(97 + i % 10)}"
    for n in (60, 3000):
        docs = [(i, f"This work by {word('n', i % 100)} of {word('c', (i // 100 + i) % 100)} is licensed under the terms of that licence") for i in range(n)]
        docs += [(n + i, f"This work by hand was made in a single winter by {word('n', i)} for us") for i in range(3)]
        docs += [(n + 3 + i, "This work by nobody was lost before any of you could ever read it") for i in range(2)]
        docs += [(n + 5 + i, f"All goods by {word('n', i % 100)} of {word('c', (i // 100 + i) % 100)} stay ours till then") for i in range(n)]
        got = ld.drop_lines(spark.createDataFrame(docs, "doc_id long, text string")).where("n_dropped = 0").collect()
        assert sorted(r.doc_id for r in got) == [0, n, n + 3, n + 5]
