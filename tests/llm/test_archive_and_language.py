"""WARC conversion and language ID."""

import base64
import gzip
import hashlib
import random
import zlib

import pytest

from tickerloom.llm import language_id, warc


def test_archives(spark, tmp_path):
    pages = [(1, "http://a/ b", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "WARC/1.1\r\n\r\nfiledesc://x\n" * 500), (None, "http://f", "<p>é</p>"), (7, "http://g#page=1", "x\r\n\r\ny\n")]
    frame = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, payload string, ip int").repartition(3)
    rows = warc.archive_pages(frame, f"{tmp_path}/a").select("*", warc.page_of("target_uri").alias("page"), warc.page_of("refers_to_uri").alias("to")).collect()
    got = {r.page: r for r in rows}
    assert len(rows) == len(pages)
    for page, _, html in pages:
        body = (html or "").encode()
        r = got[page]
        assert r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert r.payload_bytes == len(body) and (r.payload is None if r.warc_type == "revisit" else r.payload == body)
    assert {p: (r.warc_type, r.to) for p, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), None: ("revisit", 2), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), 7: ("response", None)}
    assert len({r.record_id for r in rows}) == len(rows)
    assert warc.archive_pages(frame.where("false"), f"{tmp_path}/b").count() == 0


def test_repeated_rows_are_records_of_their_own(spark, tmp_path, monkeypatch):
    """Of two rows that are equal throughout one is the response, also over several archives of a partition."""
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 2)
    monkeypatch.setattr(warc, "ROWS_PER_SALT", 1)
    frame = spark.createDataFrame([(7, "http://a", "same")] * 5 + [(8, "http://b", "other")] * 2, "page_id long, url string, html string").coalesce(1)
    rows = warc.archive_pages(frame, f"{tmp_path}/a").collect()
    assert len(rows) == 7 and len({r.record_id for r in rows}) == 7
    for uri, n in (("http://a#page=7", 5), ("http://b#page=8", 2)):
        mine = [r for r in rows if r.target_uri == uri]
        assert sorted(r.warc_type for r in mine) == ["response"] + ["revisit"] * (n - 1)
        assert all(r.refers_to_uri == uri for r in mine if r.warc_type == "revisit")


def test_parse_arc():
    one, two = (f"{v} 0 x\n{warc.FIELDS[v]}\n" for v in (1, 2))
    data = (
        f"filedesc://a 0.0.0.0 19960101000000 text/plain {len(one)}\n{one}\nhttp://a 1.2.3.4 199601010203 text/html 5\nab\ncd\n"
        f"filedesc://b 0.0.0.0 19960101000000 text/plain 200 - - 0 b {len(two)}\n{two}\nhttp://b 1.2.3.4 19970101000000 text/html; charset=x 200 - - 77 f 3\nxyz\n"
    ).encode()
    assert list(warc.parse_arc(data)) == [("http://a", "1.2.3.4", "19960101020300", b"ab\ncd", data.index(b"http://a")), ("http://b", "1.2.3.4", "19970101000000", b"xyz", data.index(b"http://b"))]
    with pytest.raises(ValueError):
        list(warc.parse_arc(b"http://a 1.2.3.4 199601010203 text/html 1\nx\n"))


def test_payloads_that_are_no_text(spark, tmp_path):
    body = bytes(range(256))
    block = f"1 0 x\n{warc.FIELDS[1]}\n"
    (tmp_path / "in").mkdir()
    data = f"filedesc://a 0.0.0.0 19960101000000 text/plain {len(block)}\n{block}\nhttp://a 1.2.3.4 19960101020304 image/png 256\n".encode() + body + b"\n"
    (tmp_path / "in/a.arc.gz").write_bytes(gzip.compress(data))
    records = warc.deduplicate(warc.read_arc(spark, f"{tmp_path}/in"), warc.page_of("target_uri"))
    warc.write_warc(records, f"{tmp_path}/out")
    r = warc.read_warc(spark, f"{tmp_path}/out").collect()
    assert [(x.payload, x.warc_date, x.target_uri) for x in r] == [(body, "1996-01-01T02:03:04Z", "http://a")]


def speech(rng, letters, n):
    return " ".join("".join(rng.choices(letters, k=rng.randrange(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    alphabets = {"xx": "abcdefg", "yy": "efghijk", "zz": "абвгд"}
    return [(i, speech(rng, alphabets[lang], rng.randrange(1, 60)), lang) for i in range(400) for lang in [rng.choice(list(alphabets))]]


def test_language_id(spark, corpus):
    docs = spark.createDataFrame([(i, t, lang, "clash") for i, t, lang in corpus], "doc_id long, text string, lang string, score string")
    model = language_id.model_of(docs)
    assert model.langs == ["xx", "yy", "zz"]
    more = [(1000, None, None, ""), (1001, "", None, ""), (1002, "12 !? ...", None, ""), (1003, "漢字仮名交文" * 40, None, ""), (1004, corpus[0][1].upper(), None, "")]
    got = {r.doc_id: r for r in language_id.identify(docs.unionByName(spark.createDataFrame(more, docs.schema)), model).collect()}
    assert len(got) == len(corpus) + len(more)
    held = [(i, lang) for i, _, lang in corpus if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].lang_pred == lang for i, lang in held) >= 0.97 * len(held)
    assert all(got[i].accepted for i, _, _ in corpus)
    assert [(got[i].lang_pred, got[i].score, got[i].accepted) for i in (1000, 1001, 1002)] == [("und", 0.0, False)] * 3
    assert not got[1003].accepted and got[1004].lang_pred == corpus[0][2]
    assert all(0 <= r.score <= 1 for r in got.values())


def test_probabilities_sum_to_one(spark, corpus):
    """Over all symbols after any context, seen or not, with the symbols that no model knows as one."""
    import numpy as np

    model = language_id.train(spark.createDataFrame([(t, lang) for _, t, lang in corpus], "text string, lang string"))
    symbols = model.grams[1]
    for context in ("abc", "bcd", "xyz", "ab ", "   "):
        base = np.uint64(0)
        for c in context:
            base = base << np.uint64(16) | np.uint64(ord(c))
        total = np.exp(model.log_probability(base << np.uint64(16) | symbols)).sum(axis=0)
        assert (total <= 1.0001).all() and (total > 0.9).all()


def kneser_ney(texts):
    """log p(symbol | context) by the textbook recursion over dictionaries, for one language's lower-case texts of letters
    and single spaces."""
    import math
    from collections import Counter

    counts = {4: Counter(("   " + t)[i : i + 4] for t in texts for i in range(len(t)))}
    for k in (3, 2, 1):
        counts[k] = Counter(gram[1:] for gram in counts[k + 1])
    uniform = 1 / (len(counts[1]) + 1)
    discount = {}
    for k, c in counts.items():
        ones, twos = (sum(n == i for n in c.values()) for i in (1, 2))
        discount[k] = ones / (ones + 2 * twos) if ones and twos else 0.75

    def p(gram):
        if not gram:
            return uniform
        k = len(gram)
        after = [n for g, n in counts[k].items() if g[:-1] == gram[:-1]]
        if not after:
            return p(gram[1:])
        d = discount[k]
        return (max(counts[k][gram] - d, 0) + d * len(after) * p(gram[1:])) / sum(after)

    return lambda gram: math.log(p(gram))


def test_model_against_brute_force(spark):
    import numpy as np

    rng = random.Random(8)
    texts = [speech(rng, "abcdefg", rng.randrange(1, 30)) for _ in range(40)]
    model = language_id.train(spark.createDataFrame([(t, "xx") for t in texts], "text string, lang string"))
    want = kneser_ney(texts)
    tried = {("   " + t)[i : i + 4] for t in texts[:10] for i in range(len(t))} | {"".join(rng.choices("abcdefg z", k=4)) for _ in range(200)}
    for gram in tried:
        key = np.array([sum(ord(c) << 16 * (3 - k) for k, c in enumerate(gram))], np.uint64)
        assert model.log_probability(key)[0, 0] == pytest.approx(want(gram), abs=2e-4)


def test_accepted_documents_keep_columns_of_any_name(spark, corpus):
    rows = [(i, t, lang, 0.5, "p", True) for i, t, lang in corpus] + [(None, None, "xx", 0.1, "q", False), (5, corpus[5][1], "xx", 0.2, "r", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string, accepted boolean")
    got = language_id.accepted_documents(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted((r for r in rows if r[1]), key=str)


def test_long_texts_are_scored_whole(spark, corpus):
    docs = spark.createDataFrame([(i, t, lang) for i, t, lang in corpus], "doc_id long, text string, lang string")
    long = " ".join(t for _, t, lang in corpus if lang == "yy") * 40
    got = language_id.identify(spark.createDataFrame([(1, long + " " + corpus[0][1])], "doc_id long, text string"), language_id.model_of(docs)).first()
    assert got.lang_pred == "yy" and got.n_letters > 200_000


def test_language_id_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, "xx")], "doc_id long, text string, lang string")
    got = language_id.identify(docs, language_id.model_of(docs)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * 2
    assert language_id.accepted_documents(docs.where("false")).count() == 0


def test_limits_of_common_and_rare_languages(spark):
    """A common language's limit is that of all its rows; one with a single row has a limit that good texts pass."""
    rng = random.Random(5)
    rows = [(speech(rng, "abcdefg", rng.randrange(5, 25)), "xx") for _ in range(6000)] + [(speech(rng, "mnopqrs", 20), "qq")]
    frame = spark.createDataFrame(rows, "text string, lang string")
    model = language_id.train(frame)
    assert sorted(model.limits) == model.langs == ["qq", "xx"] and model.limits["qq"] == -model.uniform
    own = language_id.identify(frame, model).where("lang_pred = 'xx' AND n_letters >= 20").collect()
    cost, other = [r.cross_entropy for r in own], sum(r.runner_up for r in own) / len(own)
    mean = sum(cost) / len(cost)
    sd = (sum((c - mean) ** 2 for c in cost) / len(cost)) ** 0.5
    assert model.limits["xx"] == pytest.approx(min(max(mean + 8 * max(sd, 0.1), other), -model.uniform), rel=1e-9)
    good = " ".join(rows[-1][0].split(" ")[::-1])
    more = spark.createDataFrame([(good,), ("漢字仮名交文" * 40,)], "text string")
    assert {r.text: r.accepted for r in language_id.identify(more, model).collect()} == {good: True, "漢字仮名交文" * 40: False}


def test_a_model_holds_all_grams_and_languages(spark):
    rng = random.Random(6)
    rows = [("".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(5000)), "cjk") for _ in range(60)]
    rows += [(speech(rng, "abcdefg", 20), f"l{i:02}") for i in range(70)]
    model = language_id.train(spark.createDataFrame(rows, "text string, lang string"))
    assert model.langs == sorted({lang for _, lang in rows})
    grams = {(" " * 3 + t)[i : i + 4] for t, lang in rows if lang == "cjk" for i in range(len(t))}
    found = model.grams[4]
    assert len(grams) > 200_000 and (found & 0xFFFF >= 0x4E00).sum() == len(grams)
