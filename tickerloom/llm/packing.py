"""Best-fit packing of token sequences by a linear grouping scheme.

What has to be decided depends on lengths alone, and there are no more lengths than the capacity, so the plan is made
from the histogram of lengths (2048 rows at most, however large the corpus) and the rows find their places in Spark:

1. large lengths (over SMALL of the capacity) are put in groups of equal cardinality, each rounded up to its largest;
2. for these few sizes configurations are chosen: the largest size left, with the subset of the others that fills its
   sequence best, is used as often as the counts allow;
3. the documents themselves take the places of the rounded sizes; sequences that then hold the same lengths are a run;
4. small lengths go, the longest first, where the least room is left that still holds them.

The number of groups is doubled from FEWEST_GROUPS until the plan reaches the lower bound, all tokens over the capacity,
or there are four groups to a size; the plan with the fewest sequences stays. A piece's place follows from its rank
among the pieces of its length. Ranks are counted in (length, bucket) groups of bounded size, so that a length that a
third of all pieces share is no single task's work.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickerloom.llm import words
from tickerloom.llm.common import materialise, table, trim

CAPACITY, SMALL = 2048, 1 / 8
#: Groups of large lengths that are tried first. There are no more sizes than the capacity, so finer ones end there.
FEWEST_GROUPS = 32
#: Mean number of pieces in a bucket.
BUCKET_ROWS = 50_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """PIECES of every whole text (null: empty): its ids, then the id end, cut only where longer than capacity."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    last = np.array([end], "<u4").tobytes()

    def cut(batches):
        encoder = words.Encoder(tokenizer)
        for batch in batches:
            for a, b in words.groups(texts := [x or "" for x in batch.column(1).to_pylist()]):
                rows = []
                for doc_id, ids in zip(batch.column(0).slice(a, b - a).to_pylist(), encoder.encode(texts[a:b])):
                    ids += last
                    for k, at in enumerate(range(0, len(ids) // 4, capacity)):
                        part = ids[4 * at : 4 * (at + capacity)]
                        rows.append((doc_id, k, at, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
        del encoder
        trim()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


class _Group:
    """The lengths of one size, longest first, handed out from the front."""

    def __init__(self, lengths: list[list[int]]):
        self.size, self.left, self.runs = lengths[0][0], sum(n for _, n, _ in lengths), lengths

    def take(self, n: int) -> list[tuple[int, int, int]]:
        """(length, count, first rank) of the next n."""
        out = []
        self.left -= n
        while n:
            length, has, rank = run = self.runs[0]
            some = min(n, has)
            out.append((length, some, rank))
            run[1:] = [has - some, rank + some]
            if has == some:
                self.runs.pop(0)
            n -= some
        return out


def _grouped(hist: list[tuple[int, int]], n_groups: int) -> list[_Group]:
    """Groups of equal cardinality, the largest lengths first; a length may be divided between two."""
    total = sum(n for _, n in hist)
    each = math.ceil(total / n_groups)
    out, now, room = [], [], each
    for length, n in sorted(hist, reverse=True):
        rank = 0
        while n:
            some = min(n, room)
            now.append([length, some, rank])
            n, rank, room = n - some, rank + some, room - some
            if not room:
                out.append(_Group(now))
                now, room = [], each
    out += [_Group(now)] if now else []
    # groups that round up to one size are one for what follows
    merged: list[_Group] = []
    for group in out:
        if merged and merged[-1].size == group.size:
            merged[-1].left += group.left
            merged[-1].runs += group.runs
        else:
            merged.append(group)
    return merged


def _best_fill(sizes: list[tuple[int, int]], room: int) -> list[int]:
    """The indices, repeats included, of the sizes (size, count; largest first) whose sum is the largest up to room."""
    reach, steps = 1, []  # bit s of reach: the sum s can be made
    limit = (1 << (room + 1)) - 1
    for k, (size, n) in enumerate(sizes):
        if size > room:
            continue
        for _ in range(min(n, room // size)):
            more = (reach | reach << size) & limit
            if more == reach:
                break
            steps.append((k, reach))
            reach = more
        if reach >> room:
            break
    total, out = reach.bit_length() - 1, []
    for k, before in reversed(steps):
        if not before >> total & 1:
            out.append(k)
            total -= sizes[k][0]
    return out


def plan(hist: dict[int, int], capacity: int = CAPACITY, n_groups: int = FEWEST_GROUPS) -> tuple[int, list[tuple[int, int, int, int, int]]]:
    """(number of sequences, places): a place (length, rank, count, sequence, offset) puts the pieces of that length
    with ranks from rank on, count of them, into as many sequences from sequence on, each at offset."""
    small = capacity * SMALL
    groups = _grouped([(x, n) for x, n in hist.items() if x > small], n_groups)
    places, rooms, sequences = [], defaultdict(list), 0  # rooms: by what is left, (sequence, count)
    while groups:
        first = groups[0]
        others = [(g.size, g.left - (g is first)) for g in groups]
        chosen = [0, *_best_fill([(s, n) for s, n in others], capacity - first.size)]
        uses = {k: chosen.count(k) for k in chosen}
        times = min(groups[k].left // n for k, n in uses.items())
        slots = [groups[k].take(times) for k in chosen]
        groups = [g for g in groups if g.left]
        at = 0
        while at < times:
            some = min(slot[0][1] for slot in slots)
            offset = 0
            for slot in slots:
                length, n, rank = slot[0]
                places.append((length, rank, some, sequences + at, offset))
                offset += length
                slot[:1] = [(length, n - some, rank + some)] if n > some else []
            rooms[capacity - offset].append((sequences + at, some))
            at += some
        sequences += times
    left = sorted(r for r in rooms if r)
    for length in sorted((x for x in hist if x <= small), reverse=True):
        n, rank = hist[length], 0
        while n:
            if (k := bisect_left(left, length)) == len(left):
                new = math.ceil(n / (capacity // length))
                rooms[capacity].append((sequences, new))
                sequences += new
                left.append(capacity)
                continue
            room = left[k]
            sequence, has = rooms[room].pop()
            some = min(n, has)
            if has > some:
                rooms[room].append((sequence + some, has - some))
            places.append((length, rank, some, sequence, capacity - room))
            if room > length:
                if not rooms[room - length]:
                    insort(left, room - length)
                rooms[room - length].append((sequence, some))
            if not rooms[room]:
                left.remove(room)
            n, rank = n - some, rank + some
    return sequences, places


def best_plan(hist: dict[int, int], capacity: int = CAPACITY) -> tuple[int, list[tuple[int, int, int, int, int]]]:
    """The plan of the grouping with the fewest sequences; of equal ones the coarsest."""
    bound = math.ceil(sum(x * n for x, n in hist.items()) / capacity)
    n_groups, best = FEWEST_GROUPS, plan(hist, capacity, FEWEST_GROUPS)
    while best[0] > bound and n_groups < 4 * capacity:
        n_groups *= 2
        best = min(best, plan(hist, capacity, n_groups), key=lambda p: p[0])
    return best


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (PIECES, read twice) with sequence_id and offset. Equal lengths are placed in the order of doc_id, piece,
    ids_crc32; repeated rows get a place each; an empty table gives an empty result."""
    columns = pieces.columns
    buckets = max(1, math.ceil(pieces.count() / BUCKET_ROWS))
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    hist = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    _, places = best_plan(hist, capacity)
    before = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = rows.withColumn("within", within).join(before, ["length", "bucket"]).select(*columns, (F.col("within") + F.col("before")).alias("rank"))
    table_ = np.array(sorted(places) or np.empty((0, 5)), np.int64)
    key = table_[:, 0] << 48 | table_[:, 1]

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = table_[np.searchsorted(key, length << 48 | rank, "right") - 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(at[:, 3] + rank - at[:, 1]), pa.array(at[:, 4])],
                names=[*columns, "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Each piece of docs (doc_id, text) with its place. Null and empty texts are a piece of the end id alone; null doc_ids
    stay; repeated rows get pieces and places of their own, ties as pack() says; no rows: no result. Other columns aren't
    read. The tokenizer must tell no upper from lower case and drop white space."""
    return pack(materialise(pieces_of(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"), capacity), "pieces"), capacity)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op10_best_fit_packing": op10_best_fit_packing}
ORACLE: dict[str, str] = {}
