"""Cross-tokenizer alignment: which tokens of two tokenizers stand on the same bytes of a text.

1. Tokenising (Python, whole blocks of texts at once): a text is cut into units where neither tokenizer can have a token across,
   before a blank that follows something other than white space. A document is the numbers of its units. A row is a block: its
   documents, and of each unit that its task has not met before both tokenizers' ids and its shape, which is where the tokens of
   both end. A task that has met KNOWN_CHARS of units forgets them and begins anew.
2. Groups and links (Spark's higher-order functions only): units share few shapes. Once for
   each shape of a row, the ends that both have, by array_intersect, are the ends of the groups. The bytes get the number of
   their token, so the tokens that meet at a byte are found by place; between two neighbouring ends of either tokenizer lies
   exactly one link. Each unit reads its groups and links off its shape.
3. Documents are put together from their units (Arrow and numpy, in the same task, which keeps the units of its rows): groups are joined
   and hashed, and each id pair of a block is told with the number of the block's documents that hold it. Spark adds these up corpus-wide.
4. Each block's distinct id pairs are joined to these counts, gathered by block, and added up along units and documents.

There are no more id pairs than pairs of pieces, mostly far fewer. They are broadcast only if there are no more than
BROADCAST_PAIRS; otherwise pairs meet their counts in a shuffle, with the same result. Blocks hold about BLOCK_CHARS characters, one document
at least, and work is linear in a unit's bytes, so memory is bounded by the longest text.
"""

from __future__ import annotations

import base64
import contextlib
import functools
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm.common import forget, materialise, table, trim

BLOCK_CHARS = 1_500_000
#: Characters of units after which a task forgets those that it has met.
KNOWN_CHARS = 2_000_000
#: Units that are tokenised at once.
UNITS = 5_000
#: What is sent to Python and back at once.
BATCH_BYTES = "4m"
#: Links' id pairs that are broadcast with their counts: some 100 MB on an executor.
BROADCAST_PAIRS = 2_000_000
#: A blank beside other white space, where a token may reach over the blank.
RUN = re.compile(r"\s ")
#: The same for Arrow, whose \s is ASCII's, and for a blank that begins a text.
ODD = r"^ |[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
#: Before a blank that follows something other than white space (Python's white space has all that Unicode's has).
CUT = re.compile(r"(?<=\S)(?= )")


@functools.lru_cache(maxsize=2)
def _first(path: str):
    """(encoder of lists of units, each id's bytes, how many these are) of the byte-level tokenizer whose ranks are in path."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    lengths = np.array(list(map(len, pieces)), np.int64)

    def encode(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(how many ids each unit has, all ids). No token reaches over the blank that begins a unit, so units go in one
        text, except those that end in white space, where one might."""
        text = "".join(units)
        if not any(x[-1].isspace() for x in units):
            ids = encoding.encode_to_numpy(text).astype(np.int32)
            ends = np.cumsum(lengths[ids])
            stops = np.cumsum(np.fromiter(map(len, map(str.encode, units)), np.int64, len(units)))
            last = np.searchsorted(ends, stops)
            if len(ends) and ends[-1] == stops[-1] and (ends[last] == stops).all():
                return np.diff(last, prepend=-1), ids
        return _flat(list(map(encoding.encode_ordinary, units)))

    return encode, pieces, lengths


@functools.lru_cache(maxsize=2)
def _second(path: str):
    """(encoder of lists of units; each id's bytes, how many these are) of the piece tokenizer in path, which adds a blank before a text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = []
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        pieces.append(bytes([int(piece[3:-1], 16)]) if model.is_byte(k) else piece.replace("▁", " ").encode())
    lengths = np.array(list(map(len, pieces)), np.int64)
    return lambda units: _flat(model.encode([x[1:] for x in units], num_threads=1)), pieces, lengths


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, elements) of lists."""
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    return counts, np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(counts.sum()))


def units_of(text: str) -> list[str]:
    """The units of a text with a blank before it; joined they are the same text."""
    spaced = " " + text
    return CUT.split(spaced) if RUN.search(spaced) or text[:1] == " " else [" " + x for x in text.split(" ")]


class _Tokens:
    """Both tokenizers' ids and ends of some units, flat; usable: the pieces make up the unit."""

    def __init__(self, units: list[str], first, second):
        raw = [x.encode() for x in units]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.usable = np.ones(len(units), bool)
        self.columns = []
        for encode, pieces, of_pieces in (first, second):
            counts, flat = encode(units) if units else _flat([])
            lengths = of_pieces[flat]
            whole = _sums(counts, lengths)
            if (whole != size).any() or b"".join(map(pieces.__getitem__, flat.tolist())) != b"".join(raw):
                self.usable &= np.array([b"".join(map(pieces.__getitem__, x.tolist())) == y for x, y in zip(np.split(flat, np.cumsum(counts)[:-1]), raw)], bool)
            ends = np.cumsum(lengths) - np.repeat(np.cumsum(whole) - whole, counts)
            self.columns.append((counts, flat, ends.astype(np.int32)))

    @classmethod
    def joined(cls, some: list[_Tokens]) -> _Tokens:
        out = cls.__new__(cls)
        out.usable = np.concatenate([x.usable for x in some])
        out.columns = [tuple(map(np.concatenate, zip(*x))) for x in zip(*(x.columns for x in some))]
        return out


class _Known:
    """The units that a task has met: usable ones by number, others as -1. A unit's key is its text after its first blank."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.chars, self.n_tokens = 0, [np.zeros(0, np.int64)] * 2  # of usable units: how many tokens of either tokenizer

    def of(self, keys: list[str], met: list[_Tokens], first, second) -> np.ndarray:
        """The numbers of different keys; the tokens of new ones are added to met."""
        new = [x for x in keys if x not in self.numbers]
        if new:
            tokens = _Tokens.joined([_Tokens([" " + x for x in new[at : at + UNITS]], first, second) for at in range(0, len(new), UNITS)])
            numbers = np.where(tokens.usable, len(self.n_tokens[0]) + np.cumsum(tokens.usable) - 1, -1)
            self.numbers.update(zip(new, numbers.tolist()))
            self.chars += sum(map(len, new))
            self.n_tokens = [np.r_[n, counts[tokens.usable]] for n, (counts, *_) in zip(self.n_tokens, tokens.columns)]
            met.append(tokens)
        return np.fromiter(map(self.numbers.__getitem__, keys), np.int64, len(keys))


def _lists(counts: np.ndarray, flat: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(flat))


def _taken(counts: np.ndarray, flat: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Of lists in flat, counts long, the elements of some."""
    start, own = np.cumsum(counts) - counts, counts[some]
    return flat[np.repeat(start[some] - np.cumsum(own) + own, own) + np.arange(own.sum())]


def _sums(counts: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Of lists in flat, counts long, the sums."""
    return np.add.reduceat(np.r_[flat.astype(np.int64), 0], np.cumsum(counts) - counts) * (counts > 0) if len(counts) else np.zeros(0, np.int64)


def _one(values: pa.Array) -> pa.Array:
    """A list array with values as its only list."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _both(n_a: np.ndarray, a: np.ndarray, n_b: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each unit its elements of a, then those of b."""
    both, of_a = np.empty(len(a) + len(b), np.int32), np.repeat(np.tile([True, False], len(n_a)), np.column_stack([n_a, n_b]).ravel())
    both[of_a], both[~of_a] = a, b
    return both


def _shapes(tokens: _Tokens) -> tuple[np.ndarray, np.ndarray]:
    """(each usable unit's shape, by number; of each shape one unit that has it). A shape is where the tokens of both end."""
    (n_a, _, a), (n_b, _, b) = tokens.columns
    each = np.ones(len(n_a), np.int64)
    told = _both(each, n_a, n_a + n_b, _both(n_a, a, n_b, b))  # how many tokens of a, then the ends of a and those of b
    stops = np.r_[0, 4 * np.cumsum(1 + n_a + n_b)]
    binary = pa.Array.from_buffers(pa.large_binary(), len(n_a), [None, pa.py_buffer(stops.astype(np.int64)), pa.py_buffer(told)])
    units = np.flatnonzero(tokens.usable)
    _, first, shape = np.unique(binary.take(pa.array(units)).dictionary_encode().indices.to_numpy(), return_index=True, return_inverse=True)
    return shape.astype(np.int32), units[first]


def _keys(texts: pa.Array, instead: dict[int, list[str]]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(how many units each text has, each unit by its place in the keys, the distinct keys) of texts cut at each blank, but those in instead."""
    words = pc.split_pattern(texts, " ")
    if instead:
        order, plain = np.zeros(len(texts), np.int64), np.ones(len(texts), bool)
        plain[list(instead)] = False
        order[plain], order[list(instead)] = np.arange(plain.sum()), plain.sum() + np.arange(len(instead))
        words = pa.concat_arrays([words.filter(pa.array(plain)), pa.array(instead.values(), words.type)]).take(pa.array(order))
    coded = words.flatten().dictionary_encode()
    return pc.list_value_length(words).to_numpy().astype(np.int64), coded.indices.to_numpy(), coded.dictionary.to_pylist()


BLOCKS = "block long, known int, doc_ids array<bigint>, n_a array<bigint>, n_b array<bigint>, units array<array<int>>, tokens array<array<int>>, shape array<int>, a_ends array<array<int>>, b_ends array<array<int>>"


def tokenised(docs: DataFrame, ranks: str, pieces: str) -> DataFrame:
    """BLOCKS: documents as numbers of units and of tokens; how many units were known before, and the tokens of those that follow.
    Texts without tokens have no units."""

    def block_row(number: int, ids: pa.Array, texts: pa.Array, known: _Known) -> pa.RecordBatch:
        first, second = _first(ranks), _second(pieces)
        before, met = len(known.n_tokens[0]), [_Tokens([], first, second)]
        odd = pc.or_(pc.equal(texts, ""), pc.match_substring_regex(texts, ODD)).to_numpy(zero_copy_only=False)
        instead = {k: [x[1:] for x in units_of(text)] if (text := texts[k].as_py()) else [] for k in np.flatnonzero(odd).tolist()}
        sizes, flat, keys = _keys(texts, instead)
        numbers = known.of(keys, met, first, second)
        if (numbers < 0).any():  # a text with such a unit is one unit as a whole, and has no tokens if that isn't usable either
            whole = {k: texts[k].as_py() for k in np.flatnonzero(_sums(sizes, numbers[flat] < 0)).tolist()}
            known.of(list(dict.fromkeys(whole.values())), met, first, second)
            sizes, flat, keys = _keys(texts, instead | {k: [x] if known.numbers[x] >= 0 else [] for k, x in whole.items()})
            numbers = known.of(keys, met, first, second)
        units = numbers.astype(np.int32)[flat]
        met = _Tokens.joined(met)
        shapes, samples = _shapes(met)
        (n_a, a, _), (n_b, b, _) = met.columns
        n_both = n_a + n_b
        both = _lists(n_both[met.usable], _both(n_a, a, n_b, b)[np.repeat(met.usable, n_both)])  # of each unit the ids of a, then those of b
        ends = [_one(_lists(counts[samples], _taken(counts, flat, samples))) for counts, _, flat in met.columns]
        columns = [_one(ids), *[_one(pa.array(_sums(sizes, n[units]))) for n in known.n_tokens], _one(_lists(sizes, units)), _one(both), _one(pa.array(shapes)), *ends]
        names = [x.split()[0] for x in BLOCKS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([before], pa.int32()), *columns], names=names)

    def slices(batches):
        """Documents of about BLOCK_CHARS characters, as (doc_ids, texts)."""
        held, chars = [], 0
        for batch in batches:
            ids, texts = batch.column(0), pc.fill_null(batch.column(1), "")
            ends, start = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False)).astype(np.int64), 0
            while start < len(ids):
                before = ends[start - 1] if start else 0
                stop = min(len(ids), int(np.searchsorted(ends, before + BLOCK_CHARS - chars)) + 1)
                held.append((ids.slice(start, stop - start), texts.slice(start, stop - start)))
                chars, start = chars + ends[stop - 1] - before, stop
                if chars >= BLOCK_CHARS:
                    yield tuple(map(pa.concat_arrays, zip(*held)))
                    held, chars = [], 0
        if held:
            yield tuple(map(pa.concat_arrays, zip(*held)))

    def tokenise(batches):
        known = _Known()
        for number, (ids, texts) in enumerate(slices(batches), TaskContext.get().partitionId() << 32):
            if known.chars > KNOWN_CHARS:
                known = _Known()
            yield block_row(number, ids, texts, known)
        del known
        trim()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tokenise, BLOCKS)


def let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def _token_at(ends: Column) -> Column:
    """Of each byte the number of its token."""
    return F.flatten(F.transform(ends, lambda e, i: F.array_repeat(i, e - F.when(i > 0, ends[i - 1]).otherwise(0))))


def _pair(a: Column, b: Column) -> Column:
    return F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long"))


def shape_of(x: Column) -> Column:
    """Of one shape (a_ends, b_ends), a struct of links_a, links_b (each link's token of either side) of order, before: the
    tokens as groups spell them, those of b counted on from a's, and what is written before each; and of n, how many groups. Tokens of b are
    counted on from those of a."""

    def whole(y: Column) -> Column:
        n_a, mark = F.size(x["a_ends"]), lambda text: F.array(F.lit(text))
        start = lambda i: F.when(i > 0, y["common"][i - 1]).otherwise(0)
        commas = lambda at, i, end: F.array_repeat(F.lit(","), at[end - 1] - at[start(i)])
        order = F.transform(y["common"], lambda end, i: F.concat(F.sequence(y["at_a"][start(i)], y["at_a"][end - 1]), F.sequence(y["at_b"][start(i)] + n_a, y["at_b"][end - 1] + n_a)))
        before = F.transform(y["common"], lambda end, i: F.concat(F.when(i > 0, mark(";")).otherwise(mark("")), commas(y["at_a"], i, end), mark("|"), commas(y["at_b"], i, end)))
        links = F.array_union(x["a_ends"], x["b_ends"])
        token = lambda at, shift: F.transform(links, lambda end: at[end - 1] + shift)
        return F.struct(token(y["at_a"], F.lit(0)).alias("links_a"), token(y["at_b"], n_a).alias("links_b"), F.flatten(order).alias("order"), F.flatten(before).alias("before"), F.size(y["common"]).alias("n"))

    return let(F.struct(F.array_intersect(x["a_ends"], x["b_ends"]).alias("common"), _token_at(x["a_ends"]).alias("at_a"), _token_at(x["b_ends"]).alias("at_b")), whole)


def aligned_unit(tokens: Column, shape: Column) -> Column:
    """Of one unit (the ids of a, then those of b) of that shape, a struct of groups (a1,a2|b1;...), their number n, and links (a << 32 | b)."""
    words = tokens.cast("array<string>")
    groups = let(words, lambda words: F.array_join(F.zip_with(shape["before"], shape["order"], lambda mark, k: F.concat(mark, words[k])), ""))
    return F.struct(groups.alias("groups"), F.zip_with(shape["links_a"], shape["links_b"], lambda i, j: _pair(tokens[i], tokens[j])).alias("links"), shape["n"].alias("n"))


def aligned_blocks(blocks: DataFrame) -> DataFrame:
    """block, known, doc_ids, n_a, n_b, units (of each document), aligned (of each new unit: groups, links, n). Where groups and links
    are is told by array_intersect once for each shape, and read off for each unit of it."""
    shapes = F.transform(F.arrays_zip("a_ends", "b_ends"), shape_of)
    units = let(shapes, lambda shapes: F.zip_with("tokens", "shape", lambda tokens, k: let(shapes[k], lambda shape: aligned_unit(tokens, shape))))
    return blocks.select("block", "known", "doc_ids", "n_a", "n_b", "units", units.alias("aligned"))


def _packed(*arrays: np.ndarray) -> bytes:
    """Lists of numbers below 2^31, compressed; the sizes first, since a block's lists have no other use than _unpacked()."""
    planes = [np.ascontiguousarray(x.astype("<i4")).view(np.uint8).reshape(-1, 4).T.tobytes() for x in arrays]
    sizes = np.array([len(arrays), *map(len, arrays)], "<i8").tobytes()
    return sizes + pa.Codec("zstd", 3).compress(b"".join(planes), asbytes=True)


def _unpacked(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    sizes = np.frombuffer(data, "<i8", n, 8)
    planes = np.frombuffer(pa.decompress(memoryview(data)[8 * (n + 1) :], 4 * int(sizes.sum()), "zstd", asbytes=True), np.uint8)
    return [np.ascontiguousarray(x.reshape(4, -1).T).view("<i4").ravel() for x in np.split(planes, 4 * np.cumsum(sizes)[:-1])]


PLACED = "block long, pairs array<bigint>, holders array<int>, doc_ids array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, groups_sha256 array<string>, packed binary"


def _holders(sizes: np.ndarray, units: np.ndarray, n_links: np.ndarray, links: np.ndarray, n: int) -> np.ndarray:
    """How many documents (units of them, sizes long) hold each of n links (of units, n_links long)."""
    found, seen, start = np.zeros(n, np.int32), np.zeros(n, bool), np.cumsum(n_links) - n_links
    for own in np.split(units, np.cumsum(sizes)[:-1]):
        size = n_links[own]
        stop = np.cumsum(size)
        held = links[np.repeat(start[own] - stop + size, size) + np.arange(size.sum())]
        if 8 * len(held) < n:
            found[np.unique(held)] += 1
        else:
            seen[held] = True
            found += seen
            seen[held] = False
    return found


class _Aligned:
    """Groups, their number, and links of the units that a task has met."""

    def __init__(self):
        self.groups: list[bytes] = []
        self.n, self.n_links, self.links = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, aligned: pa.Array) -> None:
        groups, links, n = (pc.struct_field(aligned, k) for k in ("groups", "links", "n"))
        self.groups += groups.cast(pa.binary()).to_pylist()
        self.n = np.r_[self.n, n.to_numpy()]
        self.n_links, self.links = np.r_[self.n_links, pc.list_value_length(links).to_numpy()], np.r_[self.links, links.flatten().to_numpy()]


def placed(aligned: DataFrame) -> DataFrame:
    """PLACED: of each block its distinct id pairs, how many of its documents hold each, its documents without the sums that need
    counts, and packed: units of documents and links of units, as places in pairs. A task's rows come in their order."""

    def row(block: dict[str, pa.Array], known: _Aligned) -> pa.RecordBatch:
        units = block["units"]
        sizes, numbers = pc.list_value_length(units).to_numpy().astype(np.int64), units.flatten().to_numpy()
        some, flat = np.unique(numbers, return_inverse=True)
        n_links, coded = known.n_links[some], pa.array(_taken(known.n_links, known.links, some)).dictionary_encode()
        places = coded.indices.to_numpy()
        joined = (b";".join(map(known.groups.__getitem__, x.tolist())) for x in np.split(numbers, np.cumsum(sizes)[:-1]))
        sha = [hashlib.sha256(x).hexdigest() if x else "" for x in joined]
        held = pa.array(_holders(sizes, flat, n_links, places, len(coded.dictionary)))
        columns = [*map(_one, (coded.dictionary, held, block["doc_ids"], block["n_a"], block["n_b"], pa.array(_sums(sizes, known.n[numbers])), pa.array(sha, pa.string())))]
        return pa.RecordBatch.from_arrays([block["block"], *columns, pa.array([_packed(sizes, flat, n_links, places)], pa.binary())], names=[x.split()[0] for x in PLACED.split(", ")])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Aligned()
        for batch in batches:
            for k in range(batch.num_rows):
                block = {name: x if name in ("block", "known") else x.flatten() for name, x in zip(batch.schema.names, batch.slice(k, 1).columns)}
                if (before := block["known"][0].as_py()) == 0:
                    known = _Aligned()
                if before != len(known.groups):
                    raise RuntimeError(f"a block that follows {before} units came after {len(known.groups)}")
                known.add(block["aligned"])
                yield row(block, known)
        del known
        trim()

    return aligned.mapInArrow(place, PLACED)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, n, best: in how many documents each id pair is linked, and whether that is its first id's highest count."""
    pairs = blocks.select(F.explode(F.arrays_zip("pairs", "holders")).alias("x")).select("x.*")
    counts = materialise(pairs.groupBy(F.col("pairs").alias("pair")).agg(F.sum("holders").alias("n")), "pairs")
    own = F.shiftright("pair", 32).alias("a")
    highest = counts.groupBy(own).agg(F.max("n").alias("highest"))
    found = materialise(counts.select("*", own).join(highest, "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best")), "counts")
    forget(counts)
    return found


@contextlib.contextmanager
def batches_of(spark: SparkSession, size: str) -> Iterator[None]:
    """Meanwhile rows go to Python and back in batches of about that size, each of which is held several times over."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


ROWS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def summed(blocks: DataFrame) -> DataFrame:
    """ROWS of PLACED with facts (an array of at, n, best: of each place in pairs its counts), without pairs and holders."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = {name: x if name in ("block", "packed") else x.flatten() for name, x in zip(batch.schema.names, batch.slice(k, 1).columns)}
                sizes, flat, n_links, places = _unpacked(one["packed"][0].as_py())
                at = pc.struct_field(one["facts"], "at").to_numpy()
                sums = []
                for name in ("best", "n"):
                    by_place = np.empty(len(at), np.int64)
                    by_place[at] = pc.struct_field(one["facts"], name).cast(pa.int64()).to_numpy()
                    sums.append(pa.array(_sums(sizes, _sums(n_links, by_place[places])[flat])))
                n_links = pc.subtract(pc.add(one["n_a"], one["n_b"]), one["n_groups"])  # as many as there are different ends
                columns = [one["doc_ids"], one["n_a"], one["n_b"], one["n_groups"], n_links, *sums, one["groups_sha256"]]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in ROWS.split(", ")])
        trim()

    return blocks.mapInArrow(rows, ROWS)


def align_documents(docs: DataFrame, ranks: str | None = None, pieces: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of doc_id, text.

    Null and empty texts, and those whose tokens' bytes aren't the text's (with a blank before it), have zeros and an empty
    groups_sha256. Equal counts of an id: all are its best. Repeated rows are documents of their own, null doc_ids
    stay; no rows: no result. Other columns aren't read.
    """
    blocks = aligned_blocks(tokenised(docs, ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), pieces or public_tokenizers.path("piece_bpe_32k.model")))
    with batches_of(docs.sparkSession, BATCH_BYTES):
        blocks = materialise(placed(blocks), "aligned")
    counts = pair_counts(blocks)
    known = F.broadcast(counts) if counts.count() <= BROADCAST_PAIRS else counts
    links = blocks.select("block", F.posexplode("pairs").alias("at", "pair")).join(known, "pair")
    facts = links.groupBy("block").agg(F.collect_list(F.struct("at", "n", "best")).alias("facts"))  # a block's pairs: bounded
    return summed(blocks.drop("pairs", "holders").join(facts, "block", "left").withColumn("facts", F.coalesce("facts", F.array().cast("array<struct<at:int,n:bigint,best:boolean>>"))))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op12_token_alignment": op12_token_alignment}
ORACLE: dict[str, str] = {}
