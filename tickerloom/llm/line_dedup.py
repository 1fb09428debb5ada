"""Line dedup by a log-template tree: lines that are one template in several documents stay in the first of them only.

The tree has a fixed depth: a line's number of tokens, then its DEPTH leading tokens, where a token that holds a digit is
a variable field. A leaf holds the lines that agree in these. A token's support is the number of the leaf's documents that
have it at its position. A line's level is the support that LEAST_SHARE of its tokens reach: about the documents of the
lines that are like it. A token is constant if its support is TOKEN_SHARE of its line's level, and what a template needs;
all other tokens, and those with digits, are variable fields. Supports and levels grow alike with the table, so a field
that is told from the constants at one size is told at every size; a rare template in a leaf of a common one has its own
level. The constant tokens and the places of the fields are the template. It recurs if enough documents hold it: as many
as make up TOKENS_SEEN tokens, two at least, so a long line needs two documents and a line of one word many, without a
jump between. Lines that have no level, as most prose that only begins alike, are left alone, and so are blank lines.

1. Each text is split once. What is kept of a line is its place and two 64-bit hashes: of its leaf and of all its tokens,
   which together are its identity from here on.
2. Lines are counted by identity, then by leaf; leaves with lines of one document alone are left out.
3. Of each line that is left one occurrence is fetched from the texts: a Bloom filter of a bounded size, over places of
   occurrences, tells each task which of its lines may be wanted, so no text is shuffled that isn't.
4. Leaves with up to TASK_TOKENS tokens are worked out in tasks of about so many; the tokens of larger ones are counted by
   Spark, as rows of their own, so that no leaf has to fit a task.
5. Templates go back to the places by identity, and what recurs to the texts by doc_id.

Joins on a line, template or leaf that may be hot are by one of many parts of it (join_by_parts).
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm.common import forget, join_by_parts, materialise, table, text_of, trim
from tickerloom.llm.shingles import hash_ranges, mix

DEPTH, LEAST_SHARE = 3, 0.6
#: Of a line's level, the least support of a constant token.
TOKEN_SHARE = 0.05
#: Tokens that a template's documents must hold of it, all together; and documents at least.
TOKENS_SEEN, LEAST_DOCS = 24, 2
#: Tokens of the lines that a task works out at once.
TASK_TOKENS = 600_000
#: Bits of the Bloom filter for each place, and at most.
BLOOM_BITS, MAX_BLOOM_BITS = 16, 1 << 27
#: Rows of a part of a hot key, and parts at least.
PART_ROWS, LEAST_PARTS = 100_000, 64
FIELD = "<*>"
LINES = "doc_id long, place int, size int, leaf long, line long"
_FIELD, _DIGIT = FIELD.encode(), re.compile(rb"[0-9]")


def _tokens(line: bytes) -> list[bytes]:
    tokens = line.split()  # at ASCII white space
    return [_FIELD if _DIGIT.search(t) else t for t in tokens] if _DIGIT.search(line) else tokens


def _identity(tokens: list[bytes]) -> tuple[int, int]:
    """(leaf, line) as signed 64-bit numbers."""
    leaf = xxhash.xxh3_64_intdigest(b"%d %b" % (len(tokens), b" ".join(tokens[:DEPTH])), 1)
    line = xxhash.xxh3_64_intdigest(b" ".join(tokens), 2)
    return leaf - (leaf >> 63 << 64), line - (line >> 63 << 64)


def _needed(size, tokens_seen: int, least_docs: int):
    """Documents that a template of size tokens needs: a Column, or an array."""
    if isinstance(size, Column):
        return F.greatest(F.ceil(tokens_seen / size), F.lit(least_docs))
    return np.maximum(np.ceil(tokens_seen / size), least_docs)


def lines_of(docs: DataFrame) -> DataFrame:
    """LINES of each line that isn't blank, in documents with a doc_id."""
    names = [x.split()[0] for x in LINES.split(", ")]
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())

    def split(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                for place, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
                    if tokens := _tokens(line):
                        rows.append((doc_id, place, len(tokens), *_identity(tokens)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        trim()

    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text").mapInArrow(split, LINES)


def _place_hash(doc_id: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mix(mix(doc_id.astype(np.int64).view(np.uint64), 7) + place.astype(np.uint64), 8)


def _bloom(wanted: DataFrame) -> np.ndarray:
    """A Bloom filter, two bits an entry, of the rows of doc_id, place; its size follows their number up to a bound."""
    bits = 1 << min(max(10, math.ceil(math.log2(max(1, BLOOM_BITS * wanted.count())))), int(math.log2(MAX_BLOOM_BITS)))

    def positions(batches):
        for batch in batches:
            h = _place_hash(*(c.to_numpy() for c in batch.columns))
            at = np.unique(np.concatenate([h & np.uint64(bits - 1), h >> np.uint64(32) & np.uint64(bits - 1)])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.int64(1) << (at & 63))], names=["word", "bit"])

    found = wanted.select("doc_id", "place").mapInArrow(positions, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(bits >> 6, np.int64)
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out


def _fetched(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """leaf, line, value: the tokens, with one space between, of lines at the wanted places (doc_id, place); of others
    too where the filter errs."""
    shared = docs.sparkSession.sparkContext.broadcast(_bloom(wanted))

    def fetch(batches):
        bloom = shared.value
        mask = np.uint64(64 * len(bloom) - 1)
        for batch in batches:
            rows, ids, texts = [], *(c.to_pylist() for c in batch.columns)
            counts = np.array([(t or "").count("\n") + 1 for t in texts], np.int64)
            owner = np.repeat(np.arange(len(texts)), counts)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            h = _place_hash(np.array(ids, np.int64)[owner], place)
            some = np.ones(len(h), bool)
            for at in (h & mask, h >> np.uint64(32) & mask):
                at = at.astype(np.int64)
                some &= (bloom[at >> 6] >> (at & 63) & 1).astype(bool)
            last, lines = -1, []
            for k, at in zip(owner[some].tolist(), place[some].tolist()):
                if k != last:
                    last, lines = k, (texts[k] or "").encode("utf-8", "surrogatepass").split(b"\n")
                if tokens := _tokens(lines[at]):
                    rows.append((*_identity(tokens), b" ".join(tokens)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], names=["leaf", "line", "value"])
        trim()

    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(fetch, "leaf long, line long, value binary")


def _templates(least_share: float, token_share: float, tokens_seen: int, least_docs: int):
    """For applyInArrow: leaf, line, template from rows of leaf, line, size, docs, value; whole leaves."""

    def work(rows: pa.Table) -> pa.Table:
        _, leaf = np.unique(rows["leaf"].to_numpy(), return_inverse=True)
        size, docs = rows["size"].to_numpy().astype(np.int64), rows["docs"].to_numpy()
        data = np.frombuffer(b"\n".join(rows["value"].to_pylist()) + b"\n" + bytes(8), np.uint8)
        ends = np.flatnonzero((data[:-8] == 32) | (data[:-8] == 10))
        token = hash_ranges(data, np.r_[0, ends[:-1] + 1], ends)
        first = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(token)) - first[owner]
        field = token == hash_ranges(np.frombuffer(_FIELD + bytes(8), np.uint8), np.array([0]), np.array([len(_FIELD)]))
        key = mix(mix((leaf[owner] << 32 | at).astype(np.uint64), 9) + token, 10)
        _, same = np.unique(key, return_inverse=True)
        support = np.bincount(same, docs[owner])[same]
        able = np.where(~field & (support >= _needed(size, tokens_seen, least_docs)[owner]), support, 0)
        least = np.ceil(least_share * size).astype(np.int64)
        order = np.lexsort((-able, owner))
        level = able[order][first + least - 1]  # 0 where too few tokens have support
        constant = (able > 0) & (able >= token_share * level[owner])
        template = mix(np.add.reduceat(np.where(constant, key, np.uint64(0)), first), 11)
        kept = pa.array(level > 0)
        return rows.select(["leaf", "line"]).append_column("template", pa.array(template.view(np.int64))).filter(kept)

    return work


def _counted(large: DataFrame, least_share: float, token_share: float, tokens_seen: int, least_docs: int) -> DataFrame:
    """The same for leaves of any size: tokens are rows."""
    line = ["leaf", "line", "size"]
    needed = _needed(F.col("size"), tokens_seen, least_docs)
    tokens = large.select(*line, "docs", F.posexplode(F.split(F.col("value").cast("string"), " ")).alias("at", "token")).where(F.col("token") != FIELD)
    tokens = materialise(tokens.withColumn("token", F.xxhash64("token")), "tokens")
    support = tokens.groupBy("leaf", "at", "token", "size").agg(F.sum("docs").alias("support")).where(F.col("support") >= needed).drop("size")
    parts = max(LEAST_PARTS, -(-tokens.count() // PART_ROWS))
    constant = join_by_parts(tokens, support, ["leaf", "at", "token"], "line", parts)
    made = constant.groupBy(*line).agg(F.collect_list(F.struct("at", "token", "support")).alias("constants"))  # a line's tokens
    least = F.ceil(least_share * F.col("size")).cast("int")
    level = F.element_at(F.sort_array("constants.support", asc=False), least)
    some = F.transform(F.array(level), lambda n: F.filter("constants", lambda c: c["support"] >= token_share * n))[0]
    chosen = F.array_sort(F.transform(some, lambda c: F.struct(c["at"].alias("at"), c["token"].alias("token"))))
    return made.where(F.size("constants") >= least).select("leaf", "line", F.xxhash64(chosen).alias("template"))


def recurring_lines(docs: DataFrame, least_share: float = LEAST_SHARE, token_share: float = TOKEN_SHARE, tokens_seen: int = TOKENS_SEEN, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, place, template of the lines to drop: their template recurs, and a smaller doc_id holds it too."""
    options = (least_share, token_share, tokens_seen, least_docs)
    lines = materialise(lines_of(docs), "lines")
    parts = max(LEAST_PARTS, -(-lines.count() // PART_ROWS))
    each = lines.groupBy("leaf", "line", "size", "doc_id").agg(F.min("place").alias("place"))
    counted = each.groupBy("leaf", "line", "size").agg(F.count("*").alias("docs"), F.min(F.struct("doc_id", "place")).alias("at"), F.max("doc_id").alias("last"))
    counted = materialise(counted, "distinct_lines")
    leaves = counted.groupBy("leaf").agg(F.min("at.doc_id").alias("lo"), F.max("last").alias("hi"), F.sum("size").alias("tokens"))
    # one line alone is its own template, whose count is known; its leaf needs no work if that is too small
    leaves = leaves.where("lo < hi").select("leaf", (F.col("tokens") > TASK_TOKENS).alias("large"), "tokens")
    shared = materialise(join_by_parts(counted, leaves, ["leaf"], "line", parts), "shared_lines")
    texts = _fetched(docs.select("doc_id", "text"), shared.select("at.doc_id", "at.place")).groupBy("leaf", "line").agg(F.first("value").alias("value"))
    full = materialise(shared.join(texts, ["leaf", "line"]).select("leaf", "line", "size", "docs", "large", "value"), "line_texts")
    tasks = max(1, math.ceil((full.where("NOT large").agg(F.sum("size")).first()[0] or 0) / TASK_TOKENS))
    small = full.where("NOT large").withColumn("task", F.pmod(F.xxhash64("leaf"), F.lit(tasks)))
    made = small.groupBy("task").applyInArrow(_templates(*options), "leaf long, line long, template long")
    large = full.where("large")
    if not large.isEmpty():
        made = made.unionByName(_counted(large, *options))
    made = materialise(made, "templates")
    forget(counted, shared, full)
    found = materialise(join_by_parts(lines, made, ["leaf", "line"], "doc_id", parts).select("leaf", "size", "template", "doc_id", "place"), "found_lines")
    forget(lines, made)
    holders = found.select("leaf", "size", "template", "doc_id").distinct().groupBy("leaf", "size", "template").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first"))
    recurring = holders.where(F.col("docs") >= _needed(F.col("size"), tokens_seen, least_docs)).select("leaf", "template", "first")
    return join_by_parts(found, recurring, ["leaf", "template"], "doc_id", parts).where("doc_id > first").select("doc_id", "place", "template")


def drop_lines(docs: DataFrame) -> DataFrame:
    """docs with text less its recurring lines, and n_lines, n_dropped (long).

    Null text stays null (one empty line); so does a text without recurring lines stay as it is. Blank lines, and rows
    without doc_id, are left alone. Rows that repeat a doc_id count as one document and lose the same lines. No rows: no
    result. Columns of docs with the new names are replaced.
    """
    dropped = recurring_lines(docs.select("doc_id", "text")).groupBy("doc_id").agg(F.sort_array(F.collect_set("place")).alias("_dropped"))
    joined = docs.drop("n_lines", "n_dropped").join(dropped, "doc_id", "left")
    n_lines = F.length(text_of()) - F.length(F.replace(text_of(), F.lit("\n"))) + 1

    def kept(lines: Column) -> Column:
        """What lies between the dropped lines."""
        starts = F.concat(F.array(F.lit(0)), F.transform("_dropped", lambda p: p + 1))
        ends = F.concat(F.col("_dropped"), F.array(F.size(lines)))
        return F.array_join(F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a))), "\n")

    # in an array of one, so that a text is split once
    text = F.when(F.col("_dropped").isNull(), F.col("text")).otherwise(F.transform(F.array(F.split("text", "\n")), kept)[0])
    return joined.select(
        *[text.alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped")],
        n_lines.cast("long").alias("n_lines"),
        F.when(F.col("_dropped").isNull(), 0).otherwise(F.size("_dropped")).cast("long").alias("n_dropped"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.length(text_of()).cast("long").alias("kept_chars"), F.sha2(text_of(), 256).alias("kept_sha256"))


QUERIES = {"op7_line_dedup": op7_line_dedup}
ORACLE: dict[str, str] = {}
