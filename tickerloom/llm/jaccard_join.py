"""N-gram Jaccard join by partitioning the universe: pigeonhole segments, one-deletion neighbourhoods, exact checks.

Let sets of sizes a and b have a Jaccard similarity of 3/4 at least. Then they differ in (a + b) / 7 shingles at most,
so in floor(a / 3) at most, and in 1/4 of either's at most. All that follows loses no such pair.

* Equal sets are one class, by a 128-bit hash of the set; the join is between classes. Members whose words aren't those of
  their class's first are compared with it like any pair.
* Size bands: a band's sizes go from 4**k to 4**(k+1). Its universe, the hash range, is cut into segments. A set emits
  keys in its own band, and in the one below if a partner may be there.
* Common shingles, found in a sample, are left out of the segments. They are those that so many sets of the sample hold, where
  that number is the lowest power of two for which there are no more than MOST_COMMON of them, so their bitmap, of a
  bounded size, is as sparse on a large corpus as on a small one. Whichever shingles are left out, the rest of two
  sets still differs in floor(a / 3) at most.
* A segment of a set is a key by its content; in a band that is allocated neighbourhoods, its content less each one of its
  shingles (if there are two or more) are keys too. Where two sets share no key of a segment that isn't empty, they differ
  in one shingle there at least, in two if it has neighbourhoods and two shingles. A set emits its first segments, until
  these numbers add up to floor(a / 3) + 1. Before the first segment that two partners share a key of, the numbers of either
  add up to no more than they differ in: so both emit that segment.
* A set whose segments don't add up to that is short. It emits all segments with neighbourhoods, and its partners their
  plain contents as before; if that makes up floor(a / 3) + 1, pairs of two short sets are found.
* Sets for which even that doesn't do emit floor(a / 4) + 1 shingles one by one, by rarity, then hash: the prefix filter.

Allocation by cost: for each band, each of OPTIONS (how many segments; with neighbourhoods or not) is tried on the sample.
Its keys, and the pairs of sets that share one, are counted and carried on to all sets; the cheapest option is taken.

Keys are dealt out in buckets whose number follows the number of shingles. Of a key with up to PAIRS_UP_TO sets
all pairs are candidates. Of a larger one, each set is a candidate with the key's first set only. The best candidate of
each set is checked first, then those that this doesn't connect. Keys whose sets aren't all connected then are taken in
blocks of about BLOCK sets and BLOCK_SHINGLES shingles at most, one set at least, so that no task holds more than two blocks, as
hashes; there each set outside the key's largest component is
compared with those of other components, and a link for each of these leaves the task. Keys whose first such set is the same
are one, so that sets don't come once for each key. Nothing is lost, and what is near throughout, as a group of copies mostly is, costs a check for
each set. Whatever belongs to a whole key is joined by the key and one of several parts of it, so a hot key is many tasks'
work. Checks compare whole sets, word by word: hashes only say which words to compare.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm.common import forget, join_by_parts, materialise, table, text_of, trim, unzipped, zipped
from tickerloom.llm.components import components
from tickerloom.llm.shingles import maybe_near, mix, near, shingle_sets, shingles, words_of

PAIRS_UP_TO, BLOCK, BLOCK_SHINGLES = 12, 512, 500_000
BAND = 4
#: Segments for each shingle of a band's largest size, and whether with neighbourhoods.
OPTIONS = ((0.45, False), (0.7, False), (0.2, True), (0.3, True))
#: Of the costs of a key that is shuffled and sorted, that of a candidate pair.
PAIR_COST = 8.0
#: Keys of a bucket on average, and of a task's buffer.
BUCKET_KEYS, FLUSH_KEYS = 800_000, 400_000
#: Bytes of the texts of the pairs that a task checks at once, one pair at least; pairs that it reads at once; texts that are
#: kept taken apart.
CHECKED_BYTES, BATCH_PAIRS, KEPT_SETS = 4_000_000, 500, 32
#: Members of a key's part, on average, where a key has a third of all.
PART_ROWS, LEAST_PARTS = 100_000, 64
#: One in SAMPLE texts is looked at for common shingles: those in LEAST_COMMON of these at least, or as many more as leave no
#: more than MOST_COMMON; and those in RARITY times as many sets, by which rarity is told. Bits of a bitmap of them, each for
#: sixteen times as many. One in KEY_SAMPLE keys is counted for the allocation.
SAMPLE, LEAST_COMMON, MOST_COMMON, RARITY, BITMAP_BITS, KEY_SAMPLE = 16, 4, 1 << 21, (1, 4, 16), 1 << 25, 16


def _binary(x: np.ndarray) -> bytes:
    return x.tobytes()


def _hashes(s: np.ndarray) -> tuple[int, int]:
    return tuple(int(mix(s, k).sum(dtype=np.uint64).view(np.int64)) for k in (1, 2))


def describe_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n, h1, h2, words of every row: the set's size and 128-bit hash, and a digest of the words in order."""

    def describe(batches):
        for batch in batches:
            rows, texts = [], batch.column(1).to_pylist()
            for text, s in zip(texts, shingle_sets(texts)):
                rows.append((len(s), *_hashes(s), hashlib.blake2b(words_of(text), digest_size=16).digest()))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n", "h1", "h2", "words"])
        trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(describe, "doc_id long, n long, h1 long, h2 long, words binary")


def sampled(docs: DataFrame) -> DataFrame:
    """text: one in SAMPLE distinct texts, as often as they come; told before any is taken apart."""
    return docs.select("text").where(F.pmod(F.xxhash64(text_of()), F.lit(SAMPLE)) == 0)


def _distinct_sets(batches):
    """The distinct sets of a task's texts, but for empty ones."""
    seen = set()
    for batch in batches:
        for s in shingle_sets(batch.column(0).to_pylist()):
            if len(s) and (id_ := _hashes(s)) not in seen:
                seen.add(id_)
                yield id_[0], s


def common_shingles(docs: DataFrame) -> np.ndarray:
    """For each number in RARITY the bitmap (64-bit words) of shingles that so many times the least number of sets hold."""

    def count(batches):
        held = [s for _, s in _distinct_sets(batches)]
        if held:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            for at in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 100_000].view(np.int64)), pa.array(n[at : at + 100_000])], names=["shingle", "n"])
        trim()

    counts = sampled(docs).mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    counts = materialise(counts.where(F.col("n") >= LEAST_COMMON), "common")
    times = F.floor(F.log2(F.col("n") / LEAST_COMMON)).cast("int")
    doublings = {r["k"]: r["shingles"] for r in counts.groupBy(times.alias("k")).agg(F.count("*").alias("shingles")).collect()}  # 60 at most
    least, inside = LEAST_COMMON << max(doublings, default=-1) + 1, 0
    for k in sorted(doublings, reverse=True):
        inside += doublings[k]
        if inside > MOST_COMMON:
            break
        least = LEAST_COMMON << k
    own = F.expr("shiftleft(1L, cast(shingle & 63 as int))")
    bits = [F.bit_or(F.when(F.col("n") >= least * more, own).otherwise(F.lit(0).cast("long"))).alias(f"b{k}") for k, more in enumerate(RARITY)]
    place = F.shiftright(F.col("shingle").bitwiseAND(BITMAP_BITS - 1), 6).alias("word")
    words = counts.where(F.col("n") >= least).groupBy(place).agg(*bits).toPandas()  # MOST_COMMON rows at most
    forget(counts)
    bitmaps = np.zeros((len(RARITY), BITMAP_BITS >> 6), np.int64)
    for k in range(len(RARITY)):
        bitmaps[k, words["word"].to_numpy(np.int64)] = words[f"b{k}"].to_numpy(np.int64)
    return bitmaps


def _commonness(s: np.ndarray, bitmaps: np.ndarray) -> np.ndarray:
    """How many of the bitmaps hold each shingle: 0 for a rare one."""
    bit = (s & np.uint64(BITMAP_BITS - 1)).astype(np.int64)
    return sum((b[bit >> 6] >> (bit & 63)) & 1 for b in bitmaps)


def _bands(n: int) -> tuple[int, ...]:
    """The bands that a set of n shingles emits keys in: the own one first."""
    band = 0
    while BAND ** (band + 1) <= n:
        band += 1
    return (band, band - 1) if band and 3 * n < 4 * BAND**band else (band,)


def _band_keys(rest: np.ndarray, n: int, band: int, factor: float, neighbours: bool) -> tuple[list[np.ndarray], bool]:
    """(the keys in a band of a set of n shingles, rest of them rare ones; whether they make up floor(n / 3) + 1)."""
    need, segments = n // 3 + 1, max(4, int(factor * BAND ** (band + 1)))
    if not len(rest):
        return [], False
    segment = (rest >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)
    first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
    sizes, own = np.diff(np.r_[first, len(rest)]), mix(rest, 3)
    content = np.add.reduceat(own, first) + mix(segment[first], 16 + band)

    def less_one(some: int) -> np.ndarray:
        """The first some segments' contents less each one of their shingles."""
        many = np.repeat(sizes[:some], sizes[:some]) >= 2
        return (np.repeat(content[:some], sizes[:some]) - own[: len(many)])[many]

    worth = np.cumsum(1 + (sizes >= 2)) if neighbours else np.arange(1, len(first) + 1)
    out = []
    if worth[-1] >= need:
        some = int(np.searchsorted(worth, need)) + 1
        out.append(mix(content[:some], 4))
        if neighbours:
            out.append(mix(less_one(some), 4))
        return out, True
    out.append(mix(content, 4))
    if not neighbours:
        out.append(mix(content, 5))
        out.append(mix(less_one(len(first)), 5))
    else:
        out.append(mix(less_one(len(first)), 4))
    return out, len(first) + int(np.count_nonzero(sizes >= 2)) >= need


def keys_of(s: np.ndarray, common: np.ndarray, allocation: dict[int, tuple[float, bool]]) -> np.ndarray:
    """The keys that the set s (sorted, not empty) emits. common: how common its shingles are; only rare ones (0) get into
    segments. allocation: each band's option."""
    n, rest, out = len(s), s[common == 0], []
    for band in _bands(n):
        keys, done = _band_keys(rest, n, band, *allocation.get(band, OPTIONS[0]))
        out += keys
        if not done:
            out.append(mix(s[np.argsort(common, kind="stable")[: n // 4 + 1]], 6))
    return np.unique(np.concatenate(out))


def allocate(docs: DataFrame, bitmap) -> dict[int, tuple[float, bool]]:
    """The cheapest option for each band: by the keys of the sample's sets, and the pairs of sets that share one."""

    def count(batches):
        held: dict[tuple[int, int], list[np.ndarray]] = {}
        for _, s in _distinct_sets(batches):
            rest = s[_commonness(s, bitmap.value) == 0]
            for band in _bands(len(s)):
                for k, option in enumerate(OPTIONS):
                    keys, done = _band_keys(rest, len(s), band, *option)
                    if not done:  # the prefix filter's keys, as many
                        keys = [*keys, mix(s[: len(s) // 4 + 1], 6)]
                    held.setdefault((band, k), []).append(np.unique(np.concatenate(keys)))
        for (band, k), parts in held.items():
            keys = np.concatenate(parts)
            some, n = np.unique(keys[keys % np.uint64(KEY_SAMPLE) == 0], return_counts=True)
            columns = [[band] * (len(some) + 1), [k] * (len(some) + 1), [None, *some.view(np.int64).tolist()], [len(keys), *n.tolist()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=["band", "option", "key", "n"])
        trim()

    found = sampled(docs).mapInArrow(count, "band int, option int, key long, n long").groupBy("band", "option", "key").agg(F.sum("n").alias("n"))
    pairs = F.when(F.col("key").isNotNull(), F.col("n") * (F.col("n") - 1) / 2).otherwise(0.0)
    costs = found.groupBy("band", "option").agg(F.sum(F.when(F.col("key").isNull(), F.col("n"))).alias("keys"), F.sum(pairs).alias("pairs")).collect()  # a few for each band
    best: dict[int, tuple[float, int]] = {}
    for r in costs:
        cost = SAMPLE * r["keys"] + PAIR_COST * SAMPLE**2 * KEY_SAMPLE * r["pairs"]
        best[r["band"]] = min(best.get(r["band"], (cost, r["option"])), (cost, r["option"]))
    return {band: OPTIONS[k] for band, (_, k) in best.items()}


def _emit(docs: DataFrame, bitmap, allocation: dict, buckets: int) -> DataFrame:
    """bucket, ids, counts, keys: the keys of every distinct set of a task, packed by bucket."""

    def flush(keys: list[np.ndarray], ids: list[np.uint64]):
        flat, owner = np.concatenate(keys), np.repeat(np.array(ids, np.uint64), [len(k) for k in keys])
        bucket = (flat >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        order = np.argsort(bucket, kind="stable")
        flat, owner, bucket = flat[order], owner[order], bucket[order]
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        rows = []
        for a, b in zip(first, np.r_[first[1:], len(flat)]):
            some = owner[a:b]
            begin = np.flatnonzero(np.r_[True, some[1:] != some[:-1]])
            rows.append((int(bucket[a]), _binary(some[begin]), _binary(np.diff(np.r_[begin, b - a]).astype(np.uint32)), _binary(flat[a:b])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "ids", "counts", "keys"])

    def emit(batches):
        keys, ids, held = [], [], 0
        for id_, s in _distinct_sets(batches):
            keys.append(keys_of(s, _commonness(s, bitmap.value), allocation))
            ids.append(np.int64(id_).view(np.uint64))
            held += len(keys[-1])
            if held >= FLUSH_KEYS:
                yield flush(keys, ids)
                keys, ids, held = [], [], 0
        if keys:
            yield flush(keys, ids)
        trim()

    return docs.select("text").mapInArrow(emit, "bucket int, ids binary, counts binary, keys binary")


def _candidates(packed: pa.Table) -> pa.Table:
    """a, b, grp, n: candidate pairs of set ids and how many keys they share here (grp null); and of a key with many sets,
    each set (b null) and its key."""
    ids = [np.frombuffer(x, np.uint64) for x in packed["ids"].to_pylist()]
    counts = [np.frombuffer(x, np.uint32) for x in packed["counts"].to_pylist()]
    keys = np.concatenate([np.frombuffer(x, np.uint64) for x in packed["keys"].to_pylist()])
    owner = np.concatenate([np.repeat(i, c) for i, c in zip(ids, counts)])
    order = np.lexsort((owner, keys))
    keys, owner = keys[order], owner[order]
    new = np.r_[True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])]
    keys, owner = keys[new], owner[new]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[first, len(keys)])
    left, right = [], []
    for size in range(2, PAIRS_UP_TO + 1):
        at = first[sizes == size]
        for i in range(size) if len(at) else ():
            for j in range(i + 1, size):
                left.append(owner[at + i])
                right.append(owner[at + j])
    large = sizes > PAIRS_UP_TO
    inside = np.repeat(large, sizes)
    lead = np.repeat(owner[first], sizes)[inside]
    member, key = owner[inside], keys[inside]
    left.append(lead[lead != member])
    right.append(member[lead != member])
    one, two = np.concatenate(left), np.concatenate(right)
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    first = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])][: len(one)])
    shared = np.diff(np.r_[first, len(one)])
    one, two = one[first].view(np.int64), two[first].view(np.int64)
    pairs = pa.table({"a": one, "b": two, "grp": pa.nulls(len(one), pa.int64()), "n": shared.astype(np.int64)})
    many = pa.table({"a": member.view(np.int64), "b": pa.nulls(len(member), pa.int64()), "grp": key.view(np.int64), "n": np.ones(len(member), np.int64)})
    return pa.concat_tables([pairs, many])


def _texts(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """doc_id, z: the compressed whole texts of the documents in needed."""

    def compress(batches):
        for batch in batches:
            found = [zipped(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc_id", "z"])
        trim()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(needed, "doc_id", "left_semi")
    return materialise(rows.mapInArrow(compress, "doc_id long, z binary").dropDuplicates(["doc_id"]), "texts")


class _Taken(dict):
    """Compressed texts' sets with their words, the last KEPT_SETS of them."""

    def __missing__(self, z: bytes):
        if len(self) >= KEPT_SETS:
            del self[next(iter(self))]
        self[z] = found = next(shingles([unzipped(z)]))
        return found


def _checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of distinct pairs (a, b) of doc_ids, those whose sets are similar; by the whole sets."""

    def shares(one: list[bytes], two: list[bytes]):
        """Runs of pairs whose texts have about CHECKED_BYTES together."""
        start = size = 0
        for at, (x, y) in enumerate(zip(one, two), 1):
            size += int.from_bytes(x[:8], "little") + int.from_bytes(y[:8], "little")
            if size >= CHECKED_BYTES or at == len(one):
                yield start, at
                start, size = at, 0

    def check(batches):
        held: dict[bytes, np.ndarray] = {}  # the last pairs' sets
        for batch in (whole.slice(at, BATCH_PAIRS) for whole in batches for at in range(0, whole.num_rows, BATCH_PAIRS)):
            ones, twos = (batch.column(k).to_pylist() for k in (2, 3))
            for a, b in shares(ones, twos):
                one, two = ones[a:b], twos[a:b]
                some = [*dict.fromkeys(one + two)]
                new = [z for z in some if z not in held]
                held = {z: held[z] for z in some if z in held}
                held |= zip(new, shingle_sets(map(unzipped, new)))
                # hashes find few pairs too many, and none too few unless a text's own hashes clash; words decide on these
                good, taken = [maybe_near(held[x], held[y]) for x, y in zip(one, two)], _Taken()
                good = [g and near(taken[x], taken[y]) for x, y, g in zip(one, two, good)]
                yield pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in batch.columns[:2]], names=["a", "b"]).filter(pa.array(good, pa.bool_()))
        del held
        trim()

    one, two = (texts.select(F.col("doc_id").alias(c), F.col("z").alias(z)) for c, z in (("a", "one"), ("b", "two")))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "one", "two").mapInArrow(check, "a long, b long")


def _between(pairs: DataFrame, connected: DataFrame) -> DataFrame:
    """The pairs whose two ids aren't connected yet."""
    a, b = (connected.select(F.col("id").alias(c), F.col("component").alias(f"{c}_in")) for c in "ab")
    both = pairs.join(a, "a", "left").join(b, "b", "left")
    return both.where(F.coalesce("a_in", "a") != F.coalesce("b_in", "b")).select(*pairs.columns)


def _apart(members: DataFrame, connected: DataFrame, parts: int) -> DataFrame:
    """grp, id, n, component of the members of groups that aren't connected throughout."""
    labelled = materialise(members.join(connected, "id", "left").select("grp", "id", "n", F.coalesce("component", "id").alias("component")), "labelled")
    open_ = labelled.groupBy("grp").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("grp")
    left = materialise(join_by_parts(labelled, open_, ["grp"], "id", parts), "apart")
    forget(labelled)
    return left


def _clustered(left: DataFrame, parts: int) -> DataFrame:
    """grp, id, n, component, inside: keys whose first set outside their largest component is the same are one, so that a set
    comes once for each such neighbourhood, not for each key; and a neighbourhood is no larger than the keys of one set.
    inside: in the largest component."""

    def largest(rows: DataFrame) -> DataFrame:
        sizes = rows.groupBy("grp", "component").agg(F.count("*").alias("n"))
        return sizes.groupBy("grp").agg(F.max_by("component", F.struct("n", "component")).alias("largest"))

    lead = join_by_parts(left, largest(left), ["grp"], "id", parts).where("component <> largest").groupBy("grp").agg(F.min("id").alias("lead"))
    merged = materialise(join_by_parts(left, lead, ["grp"], "id", parts).select(F.col("lead").alias("grp"), "id", "n", "component").distinct(), "clusters")
    return join_by_parts(merged, largest(merged), ["grp"], "id", parts).select("grp", "id", "n", "component", (F.col("component") == F.col("largest")).alias("inside"))


def _within(left: DataFrame, texts: DataFrame, parts: int) -> DataFrame:
    """a, b: links between components among the members (grp, id, component) of keys, such that all components that a
    set is linked with are. Blocks of sets outside the largest component meet each other and the blocks inside."""
    left = materialise(_clustered(left, parts), "clusters")

    def blocks_of(some: Column) -> Column:
        return F.greatest(F.ceil(F.count_if(some) / BLOCK), F.ceil(F.sum(F.when(some, F.col("n")).otherwise(0)) / BLOCK_SHINGLES), F.lit(1)).cast("int")

    blocks = left.groupBy("grp").agg(blocks_of(~F.col("inside")).alias("outer"), blocks_of(F.col("inside")).alias("inner"))
    sized = join_by_parts(left, blocks, ["grp"], "id", parts)
    own = F.pmod(F.hash("id"), F.when(F.col("inside"), F.col("inner")).otherwise(F.col("outer"))).cast("int")
    place = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    to = lambda n, f: F.transform(F.sequence(F.lit(0), n - 1), f)
    outer = F.concat(to(F.col("outer"), lambda k: place(0, F.least("own", k), F.greatest("own", k))), to(F.col("inner"), lambda k: place(1, F.col("own"), k)))
    inner = to(F.col("outer"), lambda k: place(1, k, F.col("own")))
    each = sized.withColumn("own", own).select("grp", "id", "component", "inside", "own", F.explode(F.when(F.col("inside"), inner).otherwise(outer)).alias("place"))
    placed = each.select("grp", "id", "component", "inside", "own", "place.*")

    def compare(rows: pa.Table) -> pa.Table:
        kind, i, j = (rows[c][0].as_py() for c in ("kind", "i", "j"))
        ids, component, own, inside = (rows[c].to_numpy(zero_copy_only=False) for c in ("id", "component", "own", "inside"))
        z, taken = rows["z"].to_pylist(), _Taken()
        sets = list(shingle_sets(map(unzipped, z)))
        size = np.array([len(x) for x in sets])
        starts = np.cumsum(size) - size
        known, codes = np.unique(np.concatenate(sets), return_inverse=True)
        del sets
        mark, links = np.zeros(len(known), bool), []
        for x in np.flatnonzero(~inside):
            wanted = (component != component[x]) & (4 * size >= 3 * size[x]) & (4 * size[x] >= 3 * size)
            if kind:
                wanted &= inside
            else:
                wanted &= (own != own[x]) if i != j else np.arange(len(ids)) > x
            y = np.flatnonzero(wanted)
            if not len(y):
                continue
            mine = codes[starts[x] : starts[x] + size[x]]
            mark[mine] = True
            shared = np.add.reduceat(mark[codes], starts, dtype=np.int64)[y] + 2  # as maybe_near() does
            mark[mine] = False
            met = set()
            for other in y[100 * shared >= 75 * (size[x] + size[y] + 4 - shared)]:
                if component[other] not in met and near(taken[z[x]], taken[z[other]]):  # one link with a component does
                    met.add(component[other])
                    links.append((min(ids[x], ids[other]), max(ids[x], ids[other])))
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return placed.join(texts.withColumnRenamed("doc_id", "id"), "id").groupBy("grp", "kind", "i", "j").applyInArrow(compare, "a long, b long")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id for each row of doc_id, text.

    class_id is the smallest doc_id with an equal set, component_id the smallest that links reach. Null text, or none
    but white space: n_shingles 0, a component of its own. Rows that repeat a doc_id count as one document if their
    texts are equal, and should not differ. Null doc_ids stay out of the join. An empty table gives an empty result.
    Other columns aren't read. Where two texts' sets have equal hashes though they aren't near (a chance of 2**-128 a
    pair), the larger id is a component of its own.
    """
    spark = docs.sparkSession
    described = materialise(describe_sets(docs), "described")
    variants = described.where("n > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2", "n", "words").agg(F.min("doc_id").alias("id"))
    variants = materialise(variants, "variants")
    classes = materialise(variants.groupBy("h1", "h2", "n").agg(F.min("id").alias("class_id")), "classes")
    shingles_ = classes.agg(F.sum("n")).first()[0] or 0
    bitmap = spark.sparkContext.broadcast(common_shingles(docs))
    allocation = allocate(docs, bitmap)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * shingles_ // (5 * BUCKET_KEYS)))
    packed = _emit(docs, bitmap, allocation, buckets)
    found = materialise(packed.groupBy("bucket").applyInArrow(_candidates, "a long, b long, grp long, n long"), "candidates")
    bitmap.unpersist()
    ids = classes.select(F.col("h1"), F.col("class_id"), "n")
    a, b = (ids.select(F.col("h1").alias(c), F.col("class_id").alias(f"{c}_id"), F.col("n").alias(f"{c}_n")) for c in "ab")
    sums = found.where("grp IS NULL").groupBy("a", "b").agg(F.sum("n").alias("shared"))
    close = sums.join(a, "a").join(b, "b").where("a_id <> b_id AND 4 * a_n >= 3 * b_n AND 4 * b_n >= 3 * a_n")
    pairs = close.groupBy(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")).agg(F.max("shared").alias("shared"))
    pairs = materialise(pairs, "pairs")
    members = found.where("grp IS NOT NULL").select("grp", F.col("a").alias("h1")).join(ids, "h1").select("grp", F.col("class_id").alias("id"), "n")
    members = materialise(members, "members")
    forget(found)
    # equal sets of different words in order: mostly repeats of some of them
    same = materialise(variants.join(classes, ["h1", "h2", "n"]).where("id <> class_id").select(F.col("class_id").alias("a"), F.col("id").alias("b")), "same")
    needed = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).union(members.select("id")).union(same.select("a")).union(same.select("b")).distinct()
    texts = _texts(docs, needed)
    clash = materialise(same.join(_checked(same, texts), ["a", "b"], "left_anti").select(F.col("b").alias("id")), "clash")
    # first each set with the one it shares most keys with; most of what is similar is connected then
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a"))
    first = materialise(_checked(best, texts), "checked")
    connected = components(first)
    rest = materialise(_between(pairs.join(best, ["a", "b"], "left_anti"), connected), "pairs")
    forget(pairs, connected, same)
    links = materialise(first.unionByName(_checked(rest, texts)), "checked")
    connected = components(links)
    forget(first, rest)
    parts = max(LEAST_PARTS, -(-members.count() // PART_ROWS))
    left = _apart(members, connected, parts)
    if not left.isEmpty():
        forget(connected)
        more = materialise(links.unionByName(_within(left, texts, parts)), "checked")
        connected = components(more)
        forget(more)
    forget(left, members, texts, links)
    rows = described.join(classes, ["h1", "h2", "n"], "left")
    if not clash.isEmpty():
        own = variants.join(clash, "id").select("h1", "h2", "n", "words", F.col("id").alias("own_id"))
        rows = rows.join(own, ["h1", "h2", "n", "words"], "left").withColumn("class_id", F.coalesce("own_id", "class_id"))
    rows = rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"))
    component = F.coalesce("component", "class_id").alias("component_id")
    return rows.join(connected.withColumnRenamed("id", "class_id"), "class_id", "left").select("doc_id", "n_shingles", component, "class_id")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that with the smallest doc_id, null ids last; of rows that repeat it, any.

    Each row gets a key of its own, so rows are compared by text whatever their doc_id: rows with null doc_id, and rows
    that repeat one, go if they are copies and stay if they aren't. Rows without shingles stay, but of those that repeat
    a doc_id one.
    """
    keyed = materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "keyed")
    found = jaccard_components(keyed.select(F.col("_row").alias("doc_id"), "text"))
    rows = found.select(F.col("doc_id").alias("_row"), "n_shingles", "component_id").join(keyed.select("_row", "doc_id"), "_row")
    empty = F.col("n_shingles") == 0
    group = F.when(~empty, F.col("component_id")).when(F.col("doc_id").isNull(), F.col("_row")), F.when(empty, F.col("doc_id"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row"))
    keep = rows.groupBy(group[0].alias("component"), group[1].alias("empty_id"), empty.alias("empty")).agg(least["_row"].alias("_row"))
    return keyed.join(keep.select("_row"), "_row", "left_semi").select(*docs.columns)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op2_jaccard_join": op2_jaccard_join}
ORACLE: dict[str, str] = {}
