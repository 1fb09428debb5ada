"""Embedding near-dedup by cross-polytope hashing: fast Hadamard rotations, multiprobe buckets, verified pairs.

* Equal vectors are one class, combined before the shuffle; all that follows is between classes.
* Hash: a vector is rotated by three rounds of random signs and a Walsh-Hadamard transform, filled up with zeros to a power
  of two; its vertex of the cross-polytope is the position and sign of its largest component. A table's bucket is the
  vertices of several such rotations; their number follows the number of classes, so that unrelated vectors seldom meet.
* Multiprobe: in each of TABLES tables a vector is put in PROBES buckets, its own and those that the next largest components
  name, by the squares of what they fall short of. Two vectors are candidates if one's own bucket is among the other's.
* Buckets with a single vector go. The others' vectors come to tasks of a bounded size: small buckets many to a task, of
  large ones each block of BLOCK vectors meets each other block. There every candidate pair's cosine is worked out in
  double precision. A pair is counted in the first table that it meets in, which both vectors' buckets tell, so no pairs
  leave a task: only how many links each vector has there, and for each connected set one link from each to its smallest.
* Components are found from these links; a class's links count its members and those of the classes that it is linked with.

A pair is found in a table with a chance that depends on its cosine alone; at 0.95, the threshold, fewer than one in a
thousand is missed by all tables (tests/llm/test_embeddings.py measures it), above that fewer still.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm.common import forget, materialise, table, trim
from tickerloom.llm.components import components

THRESHOLD, TABLES, PROBES, MOST_ROTATIONS, SEED = 0.95, 8, 8, 4, 20240229
#: Largest components of a rotation that probes are made of.
NEXT = 4
#: Vectors of a block of a large bucket; placements of a task with small ones.
BLOCK, TASK_ROWS = 1024, 20_000
#: Buckets of up to so many vectors are compared pair by pair, larger ones by matrices.
FEW = 32
#: Rotated numbers, and pairs, that are held at once.
CHUNK_NUMBERS, CHUNK_PAIRS = 4_000_000, 200_000


def _signs(size: int, rotations: int) -> np.ndarray:
    return np.random.default_rng([SEED, size]).choice(np.array([-1, 1], np.float32), (TABLES, rotations, 3, size))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of the last axis, whose length is a power of two."""
    n, h = x.shape[-1], 1
    while h < n:
        x = x.reshape(*x.shape[:-1], -1, 2, h) if x.shape[-1] == n else x
        x = np.concatenate([x[..., 0, :] + x[..., 1, :], x[..., 0, :] - x[..., 1, :]], axis=-1).reshape(*x.shape[:-3], n)
        h *= 2
    return x / np.float32(math.sqrt(n))


def _probes(x: np.ndarray, rotations: int) -> np.ndarray:
    """A row for each unit vector: its PROBES buckets in each of TABLES tables, its own first."""
    size = max(2, 1 << (x.shape[1] - 1).bit_length())
    padded, signs = np.zeros((len(x), size), np.float32), _signs(size, rotations)
    padded[:, : x.shape[1]] = x
    next_ = min(NEXT, size)
    combinations = np.array(list(itertools.product(range(next_), repeat=rotations)))
    combinations = combinations[np.argsort(combinations.sum(axis=1), kind="stable")]  # each rotation's largest first
    out = np.empty((len(x), TABLES, PROBES), np.int64)
    for t in range(TABLES):
        y = np.repeat(padded[:, None, :], rotations, axis=1)
        for k in range(3):
            y = hadamard(y * signs[t, :, k])
        top = np.argpartition(-np.abs(y), np.arange(next_), axis=-1)[..., :next_]
        value = np.take_along_axis(y, top, axis=-1)
        short = (np.abs(value[..., :1]) - np.abs(value)) ** 2
        vertex = 2 * top + (value < 0)
        score, bucket = np.zeros((len(x), len(combinations)), np.float32), np.full((len(x), len(combinations)), x.shape[1] * TABLES + t, np.int64)
        for r in range(rotations):
            score += short[:, r, combinations[:, r]]
            bucket = bucket * (2 * size) + vertex[:, r, combinations[:, r]]
        score[:, 0] = -1
        best = np.argsort(score, axis=1, kind="stable")[:, :PROBES]
        found = np.take_along_axis(bucket, best, axis=1)
        out[:, t] = np.concatenate([found, np.repeat(found[:, :1], PROBES - found.shape[1], axis=1)], axis=1)
    return out


def buckets_of(x: np.ndarray, rotations: int) -> np.ndarray:
    step = max(1, CHUNK_NUMBERS // (2 * rotations * max(1, x.shape[1])))
    found = [_probes(x[at : at + step], rotations) for at in range(0, len(x), step)]
    return np.concatenate(found) if found else np.empty((0, TABLES, PROBES), np.int64)


def _units(vectors: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length: (the places of the vectors of that length, the vectors at length one in double precision)."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat, start, out = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes, []
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        x = flat[start[at][:, None] + np.arange(n)].astype(np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares are neither infinite nor zero
        out.append((at, x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]))
    return out


def _comparable(vector: str) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def placements(classes: DataFrame, rotations: int) -> DataFrame:
    """bucket, at (the table), own, id: where each class is put."""

    def place(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, x in _units(batch.column(1)):
                found = buckets_of(x, rotations)
                tables, own = np.broadcast_to(np.arange(TABLES)[:, None], found.shape[1:]), np.broadcast_to(np.arange(PROBES) == 0, found.shape[1:])
                again = (found[..., 1:] == found[..., :1])  # too few components for PROBES buckets
                keep = np.concatenate([np.ones_like(again[..., :1]), ~again], axis=2).reshape(-1)
                columns = [found.reshape(-1), np.tile(tables.reshape(-1), len(at)), np.tile(own.reshape(-1), len(at)), np.repeat(ids[at], TABLES * PROBES)]
                yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], names=["bucket", "at", "own", "id"])
        trim()

    return classes.select("id", "embedding").mapInArrow(place, "bucket long, at long, own boolean, id long")


def smallest_linked(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of each of n numbers the smallest that links from a to b connect it with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        for end in (a, b):
            np.minimum.at(label, label[end], low)
            np.minimum.at(label, end, low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(label, before):
            return label


def _near_pairs(x: np.ndarray, bucket: np.ndarray, side: np.ndarray | None, threshold: float):
    """(one, two): places of pairs of rows in one bucket whose vectors are near; with sides, of the one bucket there is, pairs
    between its sides 0 and 1."""
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[starts, len(bucket)])
    few = np.repeat((sizes <= FEW) & (side is None), sizes)
    for step in range(1, min(FEW, len(bucket))):
        one = np.flatnonzero(few[:-step] & (bucket[:-step] == bucket[step:]))
        for at in range(0, len(one), CHUNK_PAIRS):
            some = one[at : at + CHUNK_PAIRS]
            some = some[np.einsum("ij,ij->i", x[some], x[some + step]) >= threshold]
            yield some, some + step
    for rows in (np.arange(a, a + n) for a, n in zip(starts, sizes) if not few[a]):
        one, two = (rows, rows) if side is None else (rows[side[rows] == 0], rows[side[rows] == 1])
        step = max(1, CHUNK_PAIRS // max(1, len(two)))
        for some in (one[at : at + step] for at in range(0, len(one), step)):
            a, b = np.nonzero(x[some] @ x[two].T >= threshold)
            a, b = some[a], two[b]
            yield (a, b) if side is not None else (a[a < b], b[a < b])


def _first_meeting(probes: np.ndarray, at: np.ndarray, bucket: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether vectors p and q, in one bucket of the table at, are candidates there, and have been in no bucket before it."""

    def meet(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (b == a[:, :1]).any(axis=1), (a == b[:, :1]).any(axis=1)

    a, b = probes[p, at], probes[q, at]
    mine, yours = meet(a, b)
    none = np.iinfo(np.int64).max
    new = bucket == np.minimum(np.where(mine, a[:, 0], none), np.where(yours, b[:, 0], none))
    for t in range(TABLES):
        left = np.flatnonzero(new & (t < at))
        mine, yours = meet(probes[p[left], t], probes[q[left], t])
        new[left] = ~(mine | yours)
    return new


def _compared(rows: pa.Table, rotations: int, threshold: float) -> pa.Table:
    """a, b, n: how many rows a is linked with here (b null), or a link (n null), of placements with their vectors."""
    order = np.lexsort((rows["id"].to_numpy(), rows["bucket"].to_numpy()))
    bucket, at, side, id_ = (rows[c].to_numpy()[order] for c in ("bucket", "at", "side", "id"))
    across = rows["i"][0].as_py() != rows["j"][0].as_py()
    ids, first, who = np.unique(rows["id"].to_numpy(), return_index=True, return_inverse=True)
    who, copies = who[order], rows["n"].to_numpy()[first]
    links, ends = np.zeros(len(ids), np.int64), [(np.empty(0, np.int64),) * 2]
    for places, x in _units(rows["embedding"].combine_chunks().take(pa.array(first))):
        probes, where = buckets_of(x, rotations), np.full(len(ids), -1)
        where[places] = np.arange(len(places))
        own = np.flatnonzero(where[who] >= 0)  # buckets hold vectors of one length
        v = where[who[own]]
        for one, two in _near_pairs(x[v], bucket[own], side[own] if across else None, threshold):
            new = _first_meeting(probes, at[own[one]], bucket[own[one]], v[one], v[two])
            one, two = places[v[one[new]]], places[v[two[new]]]
            links += np.bincount(one, copies[two], len(ids)).astype(np.int64) + np.bincount(two, copies[one], len(ids)).astype(np.int64)
            ends.append((one, two))
            if sum(len(a) for a, _ in ends) > CHUNK_PAIRS:  # what connects the same is enough
                low = smallest_linked(*map(np.concatenate, zip(*ends)), len(ids))
                ends = [(low, np.arange(len(ids)))]
    low = smallest_linked(*map(np.concatenate, zip(*ends)), len(ids))
    apart, linked = np.flatnonzero(low != np.arange(len(ids))), np.flatnonzero(links)
    is_link = np.r_[np.ones(len(apart), bool), np.zeros(len(linked), bool)]
    a, b, n = np.r_[ids[low[apart]], ids[linked]], np.r_[ids[apart], ids[linked]], np.r_[apart, links[linked]]
    return pa.table({"a": pa.array(a), "b": pa.array(b, mask=~is_link), "n": pa.array(n, mask=is_link)})


def _dealt(placed: DataFrame) -> DataFrame:
    """Placements in buckets that hold a candidate pair: bucket, at, id, side, and the group that they are compared in."""
    shared = placed.groupBy("bucket").agg(F.count("*").alias("m"), F.count_if("own").alias("own")).where("m > 1 AND own > 0").drop("own")
    shared = materialise(shared, "buckets")
    tasks = max(1, -(-(shared.agg(F.sum(F.when(F.col("m") <= BLOCK, F.col("m")))).first()[0] or 0) // TASK_ROWS))
    large, blocks = F.col("m") > BLOCK, F.ceil(F.col("m") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("id"), blocks).cast("int")
    others = F.explode(F.when(large, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.lit(0))))
    rows = placed.join(shared, "bucket").select("bucket", "at", "id", "m", F.when(large, mine).otherwise(0).alias("mine"), others.alias("other"))
    task = F.when(large, F.col("bucket")).otherwise(F.pmod(F.xxhash64("bucket"), F.lit(tasks)))
    group = [large.alias("large"), task.alias("task"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")]
    return rows.select("bucket", "at", "id", (F.col("mine") > F.col("other")).cast("int").alias("side"), *group)


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vec_id, embedding.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; vectors of unequal lengths
    don't link. Rows that repeat a vector link with each other, rows that repeat a vec_id too if they're near; null vec_ids
    count as largest. kept: vec_id is component_id. No rows: no result. Other columns aren't read.
    """
    rows = rows.select("vec_id", "embedding")
    usable = rows.where(_comparable("embedding"))
    classes = usable.groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    classes = materialise(classes.select(F.monotonically_increasing_id().alias("id"), "*"), "classes")
    size = classes.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("longest")).first()
    vertices = 2 * (1 << max(1, ((size["longest"] or 1) - 1).bit_length()))
    rotations = min(MOST_ROTATIONS, max(1, math.ceil(math.log(max(2, size["n"])) / math.log(vertices))))
    placed = materialise(placements(classes, rotations), "placements")
    dealt = _dealt(placed).join(classes.select("id", "n", "embedding"), "id")
    found = dealt.groupBy("large", "task", "i", "j").applyInArrow(lambda x: _compared(x, rotations, threshold), "a long, b long, n long")
    found = materialise(found, "links")
    forget(placed)
    connected = components(found.where("b IS NOT NULL").select("a", "b"))
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    labelled = classes.join(counts, "id", "left").join(connected, "id", "left").select("id", "embedding", "first", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component"))
    labelled = materialise(labelled, "labelled")
    least = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    facts = materialise(labelled.join(least, "component").select("embedding", "n_links", "component_id"), "facts")
    forget(classes, found, labelled, connected)
    linked = usable.join(facts, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(_comparable("embedding"), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("*", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_embedding_dedup": op13_embedding_dedup}
ORACLE: dict[str, str] = {}
