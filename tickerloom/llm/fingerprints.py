"""Document fingerprints by context-triggered piecewise hashing, compared by edit distance.

A rolling hash over WINDOW bytes ends a piece wherever it is -1 modulo the block size, so an edit moves only the ends
near it. A fingerprint is size:one:two: a character of 6 hash bits for each piece at the block size and at its double.
Block sizes are FIRST * 2**k, the largest that gives half of LONGEST pieces at least, begun at the one that would give
LONGEST. A string's last character stands for all that is left after LONGEST - 1 pieces. Two fingerprints are compared
where their block sizes are equal or one is the double of the other: 1 - edit distance / the longer length, else 0.

For its neighbour each document needs the next doc_id's text. Documents are dealt out by range of doc_id and sorted,
so the next one is the next row of the same task; only each task's first and last row meet others, in a second step
over two rows a task. The texts are shuffled once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickerloom.llm.common import materialise, table, text_of

WINDOW, FIRST, LONGEST = 7, 3, 64
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
#: Rows of a range partition, on average.
PARTITION_ROWS = 20_000
GROUP_CHARS = 1_000_000
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(9).integers(1, 1 << 63, 256, np.uint64)


class _Powers:
    """Powers of the base and of its inverse, as many as the longest text so far needs."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            size = max(n, 2 * len(cls.up), 1 << 16)
            cls.up, cls.down = (np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)], dtype=np.uint64) for b in (_BASE, _INVERSE))
        return cls.up[:n], cls.down[:n]


def fingerprint(text: str) -> str:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(data)
    if not n:
        return f"{FIRST}::"
    up, down = _Powers.of(n + 1)
    total = np.zeros(n + 1, np.uint64)  # total[i]: the hash of the first i bytes
    np.cumsum(_BYTES[data] * up[:n], out=total[1:])
    rolled = total[1:].copy()
    rolled[WINDOW:] -= total[1 : max(1, n - WINDOW + 1)]
    rolled[WINDOW:] *= down[1 : max(1, n - WINDOW + 1)]  # so that equal windows have equal hashes wherever they lie
    after = (rolled >> np.uint64(33)).astype(np.uint32) + np.uint32(1)
    ends = np.flatnonzero(after % np.uint32(FIRST) == 0)
    factor = after[ends].astype(np.uint64) // np.uint64(FIRST)
    low = factor & (~factor + np.uint64(1))  # the largest power of two in it
    k = 0
    while FIRST << k < n / LONGEST:
        k += 1
    while k and np.count_nonzero(low >= np.uint64(1 << k)) < LONGEST // 2:
        k -= 1

    def signature(k: int, longest: int) -> str:
        stops = ends[low >= np.uint64(1 << k)][: longest - 1] + 1
        if not len(stops) or stops[-1] < n:
            stops = np.r_[stops, n]
        starts = np.r_[0, stops[:-1]]
        pieces = (total[stops] - total[starts]) * down[starts]
        pieces = (pieces ^ pieces >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        return ALPHABET[pieces >> np.uint64(58)].tobytes().decode()

    return f"{FIRST << k}:{signature(k, LONGEST)}:{signature(k + 1, LONGEST // 2)}"


def edit_distances(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Levenshtein distances of strings of LONGEST characters at most, all pairs at once, a bit for each character."""
    m = np.array([len(a) for a, _ in pairs], np.int64)
    length = np.array([len(b) for _, b in pairs], np.int64)
    if not len(pairs):
        return m
    code = np.zeros(256, np.int64)
    code[ALPHABET] = np.arange(64)
    left, right = (code[np.frombuffer("".join(p[i].ljust(LONGEST, "A") for p in pairs).encode(), np.uint8)].reshape(-1, LONGEST) for i in (0, 1))
    rows, one = np.arange(len(pairs)), np.uint64(1)
    equal = np.zeros((len(pairs), 64), np.uint64)
    for i in range(LONGEST):
        equal[rows, left[:, i]] |= np.where(i < m, one << np.uint64(i), np.uint64(0))
    plus, minus, score = np.full(len(pairs), ~np.uint64(0)), np.zeros(len(pairs), np.uint64), m.copy()
    top = np.maximum(m - 1, 0).astype(np.uint64)
    for j in range(int(length.max(initial=0))):
        e = equal[rows, right[:, j]]
        x = e | minus
        d = (((e & plus) + plus) ^ plus) | e
        up, down = minus | ~(d | plus), plus & d
        score += np.where(j < length, (up >> top & one).astype(np.int64) - (down >> top & one).astype(np.int64), 0)
        up, down = up << one | one, down << one
        plus, minus = down | ~(x | up), up & x
    return np.where(m == 0, length, score)


def likeness(pairs: list[tuple[str, str]]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints; equal ones 1."""
    out, todo, places = np.zeros(len(pairs)), [], []
    for at, (a, b) in enumerate(pairs):
        if a == b:
            out[at] = 1.0
            continue
        (p, *one), (q, *two) = a.split(":"), b.split(":")
        p, q = int(p), int(q)
        for x, y in [(one[0], two[0]), (one[1], two[1])] if p == q else [(one[0], two[1])] if p == 2 * q else [(one[1], two[0])] if q == 2 * p else []:
            todo.append((x, y))
            places.append(at)
    if todo:
        longest = np.array([max(len(x), len(y), 1) for x, y in todo])
        np.maximum.at(out, places, np.where([bool(x and y) for x, y in todo], 1 - edit_distances(todo) / longest, 0.0))
    return out


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(ids: list, texts: list[str], following: list[str], prints: dict[str, str]) -> list[tuple]:
    """The columns OUT for texts with the texts that follow. prints: fingerprints known already."""
    for text in {*texts, *following}.difference(prints):
        prints[text] = fingerprint(text)
    edited = [_edited(a, b) for a, b in zip(texts, following)]
    own, new, after = [prints[x] for x in texts], [fingerprint(x) for x in edited], [prints[x] for x in following]
    near, nearer = likeness(list(zip(own, new))), likeness(list(zip(own, after)))
    return [list(ids), [len(x) for x in texts], [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in edited], own, new, near, nearer]


_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *[(x, pa.string()) for x in ("edited_sha256", "fingerprint", "edited_fingerprint")], ("near_edited", pa.float64()), ("near_next", pa.float64())])
_ENDS = pa.schema([*_ARROW, ("part", pa.int32()), ("first_text", pa.string()), ("last_text", pa.string())])


def _record(columns: list, n: int, part=None, first=None, last=None) -> pa.RecordBatch:
    more = [[part] * n, [first] * n, [last] * n]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*columns, *more], _ENDS)], schema=_ENDS)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """The columns OUT for each row of doc_id, text (null: empty), every whole text.

    The next document is the next row by doc_id, then text; null doc_ids come first; the last row's next is the first,
    so a single row's next is itself. Repeated rows are rows of their own. No rows: no result. Other columns aren't read.
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // PARTITION_ROWS))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    ranged = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def within(batches):
        part, first, held, prints = TaskContext.get().partitionId(), None, None, {}
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if not texts:
                continue
            first = texts[0] if first is None else first
            if held is not None:
                ids, texts = [held[0], *ids], [held[1], *texts]
            start = size = 0
            for at in range(len(texts) - 1):
                size += len(texts[at])
                if size >= GROUP_CHARS or at == len(texts) - 2:
                    some = slice(start, at + 1)
                    yield _record(_compared(ids[some], texts[some], texts[start + 1 : at + 2], prints), at + 1 - start)
                    prints = {texts[at + 1]: prints[texts[at + 1]]}
                    start, size = at + 1, 0
            held = ids[-1], texts[-1]
        if held is not None:  # its next row is another task's
            yield _record([[held[0]], *[[None]] * 6], 1, part, first, held[1])

    schema = f"{OUT}, part int, first_text string, last_text string"
    done = materialise(ranged.mapInArrow(within, schema), "fingerprints")
    ends = done.where("part IS NOT NULL").select("doc_id", "part", "first_text", "last_text")
    # a number for each task of the step before, without its texts, then its own and the next one's text by number
    order = Window.orderBy("part")
    begins = F.min("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = ends.select("part").withColumn("after", F.coalesce(F.lead("part").over(order), begins))
    firsts = ends.select(F.col("part").alias("after"), F.col("first_text").alias("following"))
    following = ends.select("doc_id", "part", "last_text").join(after, "part").join(firsts, "after").select("doc_id", "last_text", "following")

    def across(batches):
        for batch in batches:
            if batch.num_rows:
                columns = _compared(*(c.to_pylist() for c in batch.columns), {})
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

    return done.where("part IS NULL").select(*_ARROW.names).unionByName(following.mapInArrow(across, OUT))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op9_fingerprints": op9_fingerprints}
ORACLE: dict[str, str] = {}
