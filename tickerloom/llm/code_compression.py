"""Vector code compression: product codes whose nearest entries are found by annular norm pruning, in integers.

A vector's components become floor(256 * x) and are cut into PARTS equal consecutive parts, each with a codebook of ENTRIES
entries. A part's codebook is sorted by the entries' norms once. A part q of norm r starts with the entries beside r in
that order; with the best distance d so far no entry whose norm is below r - d or above r + d can be nearer, so a binary
search gives the interval of the order that is left, its ends included, and only that annulus is worked out exactly.
Distances are integers, so equal ones are told, and the lower index wins.

The codebooks have a fixed size, so they go to the driver and the tasks whole. A round of k-means is a pass over the
vectors: each task sums its parts by entry, Spark adds the sums up, and one row for each entry and position comes back.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm.common import join_by_parts, materialise, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integers beyond count as this, so that squared distances fit 64 bits: components from -65,536 to 65,536 are kept as they are.
LIMIT = 1 << 24
#: Parts that are compared at once.
CHUNK = 8192
#: Rows of a label that a task joins to the label's sum.
LABEL_ROWS = 1_000_000


def _usable(vector: str) -> Column:
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def integers(vectors: pa.Array, width: int) -> np.ndarray:
    """A row for each vector: PARTS * width integers, zeros after a vector's end."""
    flat = np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    flat = np.clip(flat, -LIMIT, LIMIT).astype(np.int64)
    sizes = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), PARTS * width), np.int64)
    if len(flat):
        out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


class Codebook:
    """The entries of one part, sorted by norm."""

    def __init__(self, entries: np.ndarray):
        norms = np.sqrt(_squares(entries).astype(np.float64))
        self.index = np.argsort(norms, kind="stable")
        self.entries, self.norms = entries[self.index], norms[self.index]

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance) of each row of q; of equal distances the lowest index."""
        found = [self._nearest(q[at : at + CHUNK]) for at in range(0, len(q), CHUNK)]
        return tuple(map(np.concatenate, zip(*found))) if found else (np.empty(0, np.int64), np.empty(0, np.int64))

    def _nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        norm, last = np.sqrt(_squares(q).astype(np.float64)), len(self.norms) - 1
        beside = np.searchsorted(self.norms, norm)
        best = np.minimum.reduce([_squares(q - self.entries[np.clip(beside + k, 0, last)]) for k in (-2, -1, 0, 1)])
        # a little wider than the exact interval, since norms are rounded
        reach = np.sqrt(best.astype(np.float64)) + 1e-9 * (norm + 1)
        reach += 1e-9 * (reach + 1)
        low, high = np.searchsorted(self.norms, norm - reach, "left"), np.searchsorted(self.norms, norm + reach, "right")
        sizes = high - low  # one at least: an entry with the best distance is inside
        first = np.cumsum(sizes) - sizes
        entry = np.arange(int(sizes.sum())) + np.repeat(low - first, sizes)
        distance = _squares(np.repeat(q, sizes, axis=0) - self.entries[entry])
        least = np.minimum.reduceat(distance, first)
        index = np.where(distance == np.repeat(least, sizes), self.index[entry], ENTRIES)
        return np.minimum.reduceat(index, first), least


def _codes(q: np.ndarray, books: list[Codebook], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(a row of codes for each vector, each vector's squared distances added up)."""
    found = [book.nearest(q[:, p * width : (p + 1) * width]) for p, book in enumerate(books)]
    return np.stack([c for c, _ in found], axis=1), sum(d for _, d in found)


def _batches(batches, place: int, width: int):
    for batch in batches:
        if batch.num_rows:
            yield batch, integers(batch.column(place), width)


def first_codebooks(kept: DataFrame, width: int) -> np.ndarray:
    """PARTS codebooks of the parts of the vectors with the ENTRIES smallest vec_ids, ascending: part, entry, position."""
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).select("embedding").collect()  # ENTRIES rows at most
    vectors = integers(pa.array([r["embedding"] for r in rows], pa.list_(pa.float64())), width)
    return vectors.reshape(len(rows), PARTS, width).transpose(1, 0, 2)


def improved(kept: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry the floor of its parts' mean, unused ones as they were."""
    n_parts, n_entries, width = codebooks.shape

    def add(batches):
        books, sums = [Codebook(x) for x in codebooks], np.zeros(codebooks.shape, np.int64)
        counts = np.zeros(codebooks.shape[:2], np.int64)
        for _, q in _batches(batches, 0, width):
            codes, _ = _codes(q, books, width)
            for p in range(n_parts):
                counts[p] += np.bincount(codes[:, p], minlength=n_entries)
                for k in range(width):  # as doubles, which are exact below 2**53
                    sums[p, :, k] += np.bincount(codes[:, p], q[:, p * width + k], n_entries).astype(np.int64)
        part, entry = np.nonzero(counts)
        place = [np.repeat(x, width) for x in (part, entry, counts[part, entry])]
        columns = [place[0], place[1], np.tile(np.arange(width), len(part)), sums[part, entry].reshape(-1), place[2]]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["part", "entry", "k", "total", "n"])

    found = kept.select("embedding").mapInArrow(add, "part long, entry long, k long, total long, n long")
    out = codebooks.copy()
    for r in found.groupBy("part", "entry", "k").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # as many as the codebooks have integers
        out[r["part"], r["entry"], r["k"]] = r["total"] // r["n"]
    return out


def codebooks_digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()


def compress_vectors(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of rows of vec_id, embedding, label.

    Vectors that are null or hold null or non-finite components are dropped. The parts' width follows the longest vector;
    shorter ones, and a length that PARTS doesn't divide, are filled up with zeros; an empty vector is all zeros. Fewer than
    ENTRIES vectors: as many entries. Rows that repeat a vec_id are rows of their own, in the first codebooks by their
    vectors; null vec_ids come last there. Null labels are one label. No rows left: no result. Other columns aren't read.
    """
    kept = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label").where(_usable("embedding"))
    longest = kept.agg(F.max(F.size("embedding")).alias("n")).first()["n"]
    width = max(1, math.ceil((longest or 0) / PARTS))
    codebooks = first_codebooks(kept, width)
    for _ in range(rounds if codebooks.size else 0):
        codebooks = improved(kept, codebooks)

    def assign(batches):
        books = [Codebook(x) for x in codebooks]
        for batch, q in _batches(batches, 1, width):
            codes, error = _codes(q, books, width)
            text = codes.astype(np.uint8).tobytes().hex()
            code = [text[at : at + 2 * PARTS] for at in range(0, len(text), 2 * PARTS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(code), pa.array(error)], names=["vec_id", "label", "code", "error"])

    kinds = dict(kept.dtypes)
    found = kept.mapInArrow(assign, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")
    keys = [F.col("label").isNull().alias("no_label"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("label_text")]
    coded = materialise(found.select("vec_id", "code", "error", *keys), "codes")
    sums = coded.groupBy("no_label", "label_text").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    sums = materialise(sums, "label-errors")
    most = sums.agg(F.max("n")).first()[0] or 0
    joined = join_by_parts(coded, sums.drop("n"), ["no_label", "label_text"], "code", max(1, -(-most // LABEL_ROWS)))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(codebooks)).alias("codebooks_sha256"))


def op11_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """For vectors of 64 components, as the tables have."""
    steps = [
        """kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
          FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "parts AS (SELECT vec_id, label, p, v[4*p+1] AS q1, v[4*p+2] AS q2, v[4*p+3] AS q3, v[4*p+4] AS q4 FROM kept, range(16) AS t(p))",
        """book0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, q1 AS c1, q2 AS c2, q3 AS c3, q4 AS c4 FROM parts
          WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64))""",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"""near{k} AS (SELECT vec_id, label, p, q1, q2, q3, q4, min(((q1-c1)*(q1-c1) + (q2-c2)*(q2-c2) + (q3-c3)*(q3-c3) + (q4-c4)*(q4-c4)) * 64 + e) AS best
          FROM parts JOIN book{k} USING (p) GROUP BY ALL)""")
        if k < ROUNDS:
            means = ", ".join(f"floor(sum(q{j}) / count(*))::BIGINT AS m{j}" for j in range(1, 5))
            entries = ", ".join(f"coalesce(m{j}, c{j}) AS c{j}" for j in range(1, 5))
            steps.append(f"means{k} AS (SELECT p, best % 64 AS e, {means} FROM near{k} GROUP BY ALL)")
            steps.append(f"book{k + 1} AS (SELECT p, e, {entries} FROM book{k} LEFT JOIN means{k} USING (p, e))")
    steps.append(f"""coded AS (SELECT vec_id, label, string_agg(printf('%02x', best % 64), '' ORDER BY p) AS code, sum(best // 64)::BIGINT AS error
      FROM near{ROUNDS} GROUP BY vec_id, label)""")
    return f"""WITH {", ".join(steps)}
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
           (SELECT sha256(string_agg(c1 || ',' || c2 || ',' || c3 || ',' || c4, ',' ORDER BY p, e)) FROM book{ROUNDS}) AS codebooks_sha256
    FROM coded"""


QUERIES = {"op11_code_compression": op11_code_compression}
ORACLE = {"op11_code_compression": _sql()}
