"""BPE encoding and decoding by a distinct-word table.

1. Split: a task cuts its texts into words that no token can cross. The distinct words of a block of texts are dealt out
   by hash into buckets.
2. Encode: a bucket gets each block's distinct words once, so the commonest word comes as often as there are blocks.
   It joins them to one table of distinct words, has the library encode each once, and sends the ids to the blocks.
3. Join back: a block puts its words' ids in their places, by position.
4. Decode: a block's ids, document after document, are joined to the table of pieces (id to bytes; as many rows as the
   vocabulary has, a fixed bound) by an Arrow gather; a document's text is what its own ids' pieces make up.

Blocks hold about BLOCK_CHARS characters, so memory is bounded at any size of the corpus. The number of buckets follows
that of distinct words, which is carried on from two samples of documents, so a bucket holds about BUCKET_WORDS of them; the
partitions that blocks meet their words in follow the number of blocks. Texts are shuffled once, compressed by block. A
block's words are found by their own text, so a task that runs again after an executor is lost needn't see its rows in
the same order; a word that its block's table lacks then is encoded where it stands.

The join in step 4 is done inside tasks, since ids as rows of their own would be some 200 million for each GB of text;
decode_documents() does it as a join of rows.
"""

from __future__ import annotations

import functools
import hashlib
import json
import math
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm import words
from tickerloom.llm.common import table, unzipped, zipped

BLOCK_CHARS, BUCKET_WORDS = 20_000_000, 200_000
#: Characters of a block that are joined back at once.
SHARE_CHARS = 2_000_000
#: One document in so many is looked at, and one in so many of these, to tell how distinct words grow.
SAMPLE, SAMPLE_AGAIN = 64, 4
#: What Unicode calls white space. Words are a run of other characters with one blank before it, or a run of
#: white space without the blank that goes to the next word.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORD = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


class _Numbers(dict):
    """The number of each distinct word, given at its first lookup."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


def split_words(text: str, special: re.Pattern | None) -> list[str]:
    """The words of text; special tokens are words of their own."""
    if special is None or not special.search(text):
        return WORD.findall(text)
    return [w for part in special.split(text) if part for w in ([part] if special.fullmatch(part) else WORD.findall(part))]


def _packed(numbers: np.ndarray) -> bytes:
    """Compressed by byte planes: high bytes are mostly zero."""
    return pa.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(n)


def _pattern(tokenizer: str) -> re.Pattern | None:
    special = sorted((t.content for t in words.load(tokenizer).get_added_tokens_decoder().values()), key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None


def _blocks(batches):
    """(block, doc_ids, texts) of a task's rows."""
    block, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
    for batch in batches:
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            ids.append(doc_id)
            texts.append(text or "")
            held += len(text or "")
            if held >= BLOCK_CHARS:
                yield block, ids, texts
                block, ids, texts, held = block + 1, [], [], 0
    if ids:
        yield block, ids, texts


def _texts(docs: DataFrame) -> DataFrame:
    """block, doc_ids, sizes, data: each block's texts, one after the other, compressed."""

    def gather(batches):
        for block, ids, texts in _blocks(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(x) for x in texts]], pa.list_(pa.int64())), pa.array([zipped("".join(texts), 6)], pa.binary())],
                names=["block", "doc_ids", "sizes", "data"],
            )

    return docs.mapInArrow(gather, "block long, doc_ids array<bigint>, sizes array<bigint>, data binary")


def _words(docs: DataFrame, tokenizer: str, buckets: int) -> DataFrame:
    """block, bucket, words: each block's distinct words by bucket."""

    def split(batches):
        special = _pattern(tokenizer)
        for block, _, texts in _blocks(batches):
            by: list[list[str]] = [[] for _ in range(buckets)]
            for word in {w for text in texts for w in split_words(text, special)}:
                by[xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass")) % buckets].append(word)
            rows = [(block, k, zipped(json.dumps(sorted(some), ensure_ascii=False, separators=(",", ":")), 6)) for k, some in enumerate(by) if some]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary()))], names=["block", "bucket", "words"])

    return docs.mapInArrow(split, "block long, bucket int, words binary")


def _encode(split: DataFrame, tokenizer: str) -> DataFrame:
    """block, words, lengths, ids: of each block's words of a bucket, encoded once for all blocks."""

    def encode(bucket: pa.Table) -> pa.Table:
        distinct = _Numbers()  # this bucket's part of the table of distinct words
        held = [np.fromiter(map(distinct.__getitem__, json.loads(unzipped(x.as_py()))), np.int64) for x in bucket["words"]]
        texts, encoded = list(distinct), []
        for at in range(0, len(texts), 20_000):
            encoded += words.encode_words(tokenizer, texts[at : at + 20_000])
        lengths = np.array([len(x) // 4 for x in encoded], np.uint32)
        flat = [np.frombuffer(b"".join([encoded[k] for k in here]), "<u4") for here in held]
        columns = [bucket["block"], bucket["words"], pa.array([_packed(lengths[here]) for here in held], pa.binary()), pa.array([_packed(x) for x in flat], pa.binary()), pa.array([len(x) for x in flat], pa.int64())]
        return pa.Table.from_arrays([c.cast(t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()))], names=["block", "words", "lengths", "ids", "n"])

    return split.groupBy("bucket").applyInArrow(encode, "block long, words binary, lengths binary, ids binary, n long")


@functools.lru_cache(maxsize=2)
def pieces(tokenizer: str) -> pa.Array:
    """The table of pieces: each id's bytes, an id that the vocabulary hasn't: none. In the vocabulary a byte that isn't
    printable Latin-1 stands as a character from 256 on, in order."""
    loaded = words.load(tokenizer)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    added = {k: t.content.encode() for k, t in loaded.get_added_tokens_decoder().items()}
    found = {k: bytes(byte[c] for c in piece) for piece, k in loaded.get_vocab().items() if k not in added} | added
    return pa.array([found.get(k, b"") for k in range(max(found) + 1)], pa.large_binary())


def decoded(ids: list[bytes], tokenizer: str) -> list[bytes]:
    """Each document's bytes, from its ids (little-endian unsigned 32-bit): joined to the table of pieces, all at once."""
    flat = np.frombuffer(b"".join(ids), "<u4")
    if not len(flat):
        return [b""] * len(ids)
    found = pieces(tokenizer).take(pa.array(flat))
    _, offsets, data = found.buffers()
    ends = np.frombuffer(offsets, np.int64)[np.cumsum([0, *[len(x) // 4 for x in ids]])]
    return [data[a:b].to_pybytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _distinct_words(docs: DataFrame, tokenizer: str) -> tuple[int, int]:
    """(estimates of the distinct words of docs, and of its blocks), by how both grow in a sample."""

    def count(batches):
        special = _pattern(tokenizer)
        seen: tuple[set, set] = set(), set()
        for batch in batches:
            for text, again in zip(*(c.to_pylist() for c in batch.columns)):
                found = {xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) >> 1 for w in split_words(text or "", special)}
                seen[0].update(found)
                if again:
                    seen[1].update(found)
        for again, some in enumerate(seen):
            yield pa.RecordBatch.from_arrays([pa.array([bool(again)] * len(some), pa.bool_()), pa.array(list(some), pa.int64())], names=["again", "word"])

    chars, partitions = docs.select(F.length("text").alias("n"), F.spark_partition_id().alias("part")).agg(F.sum("n"), F.max("part") + 1).first()
    blocks = (partitions or 0) + (chars or 0) // BLOCK_CHARS
    draw = F.xxhash64("doc_id", F.length("text"))
    some = docs.where(F.pmod(draw, F.lit(SAMPLE)) == 0).select("text", (F.pmod(draw, F.lit(SAMPLE * SAMPLE_AGAIN)) == 0).alias("again"))
    n = {r["again"]: r["n"] for r in some.mapInArrow(count, "again boolean, word long").groupBy("again").agg(F.countDistinct("word").alias("n")).collect()}
    power = min(1.0, max(0.0, math.log(n[False] / n[True]) / math.log(SAMPLE_AGAIN))) if n.get(True) else 1.0
    return math.ceil(n.get(False, 0) * SAMPLE**power), blocks


def encode_documents(docs: DataFrame, tokenizer: str | None = None, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, and ids (array of int) or, with digests, the ids' and the decoded text's SHA-256.

    Null and empty texts have no ids. Special tokens' strings count as special tokens. Repeated rows are rows of their
    own; null doc_ids stay; no rows, no result. Other columns aren't read.
    """
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    distinct, blocks = _distinct_words(rows, tokenizer)
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * blocks)
    buckets = max(partitions // 4, -(-distinct // BUCKET_WORDS))
    encoded = _encode(_words(rows, tokenizer, buckets), tokenizer)
    more = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>"
    types = [pa.int64(), pa.int64(), *([pa.string(), pa.string()] if digests else [pa.list_(pa.int32())])]
    names = ["doc_id", "n_tokens", *[x.split()[0] for x in more.split(", ")]]

    def join_back(block: pa.Table, encoded: pa.Table) -> pa.Table:
        known = _Known(tokenizer, digests)
        for some, lengths, ids, n in zip(*(encoded[c].to_pylist() for c in ("words", "lengths", "ids", "n"))):
            some = json.loads(unzipped(some))
            known.add(some, np.split(_unpacked(ids, n), np.cumsum(_unpacked(lengths, len(some)), dtype=np.int64)[:-1]))
        special, tables = _pattern(tokenizer), []
        for ids, sizes, data in zip(*(block[c].to_pylist() for c in ("doc_ids", "sizes", "data"))):
            texts, ends = unzipped(data), np.cumsum(sizes).tolist()
            for some in _shares(ends):
                split = [split_words(texts[ends[k] - sizes[k] : ends[k]], special) for k in some]
                tables.append(pa.Table.from_arrays([pa.array(c, t) for c, t in zip([[ids[k] for k in some], *known.columns(split)], types)], names=names))
        return pa.concat_tables(tables) if tables else pa.Table.from_arrays([pa.array([], t) for t in types], names=names)

    texts = _texts(rows).repartition(partitions, "block")
    return texts.groupBy("block").cogroup(encoded.repartition(partitions, "block").groupBy("block")).applyInArrow(join_back, f"doc_id long, n_tokens long, {more}")


def _shares(ends: list[int]) -> Iterator[range]:
    """Runs of a block's documents of about SHARE_CHARS characters together, one document at least."""
    start, before = 0, 0
    for k, end in enumerate(ends):
        if end - before >= SHARE_CHARS or k + 1 == len(ends):
            yield range(start, k + 1)
            start, before = k + 1, end


class _Known(dict):
    """A block's words with (ids, the same in decimal with commas between); without digests the latter is empty."""

    def __init__(self, tokenizer: str, digests: bool):
        super().__init__()
        self.tokenizer, self.digests = tokenizer, digests

    def add(self, some: list[str], ids: list[np.ndarray]) -> None:
        if self.digests:
            self.update((w, (x.tobytes(), ",".join(map(str, x.tolist())).encode())) for w, x in zip(some, ids))
        else:
            self.update((w, (x.tobytes(), b"")) for w, x in zip(some, ids))

    def __missing__(self, word: str) -> tuple[bytes, bytes]:
        self.add([word], [np.frombuffer(x, "<u4") for x in words.encode_words(self.tokenizer, [word])])
        return self[word]

    def columns(self, split: list[list[str]]) -> list[list]:
        """The columns after doc_id, of documents as lists of words."""
        found = [list(map(self.__getitem__, some)) for some in split]
        ids = [b"".join([x[0] for x in some]) for some in found]
        n = [len(x) // 4 for x in ids]
        if not self.digests:
            return [n, [np.frombuffer(x, "<i4") for x in ids]]
        texts = [x.decode("utf-8", "replace").encode("utf-8") for x in decoded(ids, self.tokenizer)]
        return [n, [hashlib.sha256(b",".join([x[1] for x in some])).hexdigest() for some in found], [hashlib.sha256(x).hexdigest() for x in texts]]


def decode_documents(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, text from rows of doc_id, ids, special tokens included; an id that the vocabulary hasn't: no bytes. Null
    ids and no ids: the empty text. Repeated rows are rows of their own.

    Each id is a row of its document and position, joined to the table of pieces by id; that table has as many rows as the
    vocabulary, so it may be broadcast. A document's pieces meet again by a number of its own, in the order of position.
    """
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    spark = encoded.sparkSession
    known = spark.createDataFrame(list(enumerate(pieces(tokenizer).to_pylist())), "id int, piece binary")
    numbered = encoded.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "ids")
    rows = numbered.select("row", "doc_id", F.posexplode_outer("ids").alias("at", "id"))
    joined = rows.join(F.broadcast(known), "id", "left")
    gathered = joined.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("at", F.hex("piece").alias("piece")))).alias("pieces"))
    whole = gathered.select("doc_id", F.unhex(F.array_join(F.transform("pieces", lambda p: p["piece"]), "")).alias("bytes"))

    def text(batches):
        for batch in batches:
            texts = [x.decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return whole.mapInArrow(text, "doc_id long, text string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), digests=True)


QUERIES = {"op1_bpe": op1_bpe}
ORACLE: dict[str, str] = {}
