"""Word shingles as 64-bit hashes, whole batches at a time with numpy; and exact comparisons by the words themselves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

SHINGLE_WORDS = 5
#: Texts are handled in groups of about so many characters.
GROUP_CHARS = 1_000_000
#: Words of more bytes are hashed one by one; ranges of more bytes are compared one by one.
LONG_BYTES = 256

_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))  # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # masks of the first k bytes of eight


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = x + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def words_of(text: str | None) -> bytes:
    """A text's words in lower case, with one space between."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split())


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as a number."""
    return np.ndarray(max(0, len(data) - 7), "<u8", data, strides=(1,))


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each range of bytes (8 bytes must follow the last). Eight bytes at a time are added and mixed, so ranges
    of up to eight bytes and one length have hashes of their own."""
    eights, size = _eights(data), ends - starts
    out = mix(mix(size.astype(np.uint64), 1) + (eights[starts] & _FIRST[np.minimum(size, 8)]), 2)
    more = np.flatnonzero(size > 8)
    for at in range(8, LONG_BYTES, 8):
        if not len(more):
            return out
        left = size[more] - at
        out[more] = mix(out[more] + (eights[starts[more] + at] & _FIRST[np.minimum(left, 8)]), 3)
        more = more[left > 8]
    for k in more:
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes())
    return out


def same_ranges(one: np.ndarray, starts: np.ndarray, ends: np.ndarray, two: np.ndarray, starts2: np.ndarray, ends2: np.ndarray) -> bool:
    """Whether each range of the bytes one is equal to its range of two."""
    size = ends - starts
    if (size != ends2 - starts2).any():
        return False
    a, b = _eights(one), _eights(two)
    for at in range(0, LONG_BYTES, 8):
        left = np.minimum(size - at, 8)
        if ((a[starts + at] ^ b[starts2 + at]) & _FIRST[left]).any():
            return False
        more = size > at + 8
        if not more.all():
            size, starts, starts2 = size[more], starts[more], starts2[more]
        if not len(size):
            return True
    return all(one[s : s + n].tobytes() == two[t : t + n].tobytes() for s, t, n in zip(starts, starts2, size))


class Shingles:
    """A text's sorted distinct shingle hashes; and of each shingle the bytes from data[starts] to data[ends], words in
    lower case with one space between. clash: two different shingles have one hash. words: all bytes of the words."""

    __slots__ = ("hashes", "starts", "ends", "data", "clash", "words")

    def __init__(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray, words: bytes):
        order = np.argsort(hashes, kind="stable")
        hashes, starts, ends = hashes[order], starts[order], ends[order]
        new = np.r_[True, hashes[1:] != hashes[:-1]][: len(hashes)]
        again = np.flatnonzero(~new)
        self.clash = bool(len(again)) and not same_ranges(data, starts[again], ends[again], data, starts[again - 1], ends[again - 1])
        self.hashes, self.starts, self.ends, self.data, self.words = hashes[new], starts[new], ends[new], data, words

    def exactly(self) -> set[bytes]:
        """The set itself, however hashes clash."""
        words = self.words.split(b" ") if self.words else []
        return {b" ".join(words[k : k + SHINGLE_WORDS]) for k in range(max(1, len(words) - SHINGLE_WORDS + 1))} if words else set()


def _near(shared: int, total: int) -> bool:
    return 100 * shared >= 75 * (total - shared)


def near(x: Shingles, y: Shingles) -> bool:
    """Whether the Jaccard similarity is 3/4 at least, by the words: hashes only find which shingles to compare."""
    if not (x.clash or y.clash):
        at = np.searchsorted(y.hashes, x.hashes)
        found = np.flatnonzero(y.hashes[np.minimum(at, len(y.hashes) - 1)] == x.hashes) if len(y.hashes) else at[:0]
        if not len(found) or not _near(len(found), len(x.hashes) + len(y.hashes)):
            return False  # shingles that are equal have equal hashes, so no fewer are shared by hash
        at = at[found]
        if same_ranges(x.data, x.starts[found], x.ends[found], y.data, y.starts[at], y.ends[at]):
            return True
    one, two = x.exactly(), y.exactly()
    return bool(one and two) and _near(len(one & two), len(one) + len(two))


def maybe_near(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets of hashes are near, or so close to it that a text with two shingles of one hash (a chance of 2**-64
    a pair of shingles) might be: that changes sizes by one each."""
    if not len(x) or not len(y) or 4 * len(x) < 3 * len(y) - 8 or 4 * len(y) < 3 * len(x) - 8:
        return False
    both = np.sort(np.concatenate([x, y]))
    return _near(int(np.count_nonzero(both[1:] == both[:-1])) + 2, len(both) + 4)


def _group(texts: list[str], whole: bool) -> Iterator:
    encoded = [x.encode("utf-8", "surrogatepass") for x in texts]
    data = np.frombuffer((b"\n".join(encoded) + b"\n").translate(_FOLD) + bytes(8), np.uint8)
    space = _SPACE[data[:-8]]
    # the words of each text, numbered through
    begins = np.flatnonzero(~space & np.r_[True, space[:-1]])
    first = np.searchsorted(begins, np.cumsum([0, *[len(x) + 1 for x in encoded]]))
    ends = np.flatnonzero(space & np.r_[False, ~space[:-1]])
    words = hash_ranges(data, begins, ends)
    # the runs of five words that begin at each word
    runs = mix(words[: max(0, len(words) - SHINGLE_WORDS + 1)], SHINGLE_WORDS)
    for k in range(1, SHINGLE_WORDS):
        runs = mix(runs + words[k : k + len(runs)], SHINGLE_WORDS)
    if whole:  # one space between words, so that a shingle is a range of bytes
        keep = np.r_[~space | ~np.r_[True, space[:-1]], np.ones(8, bool)]
        moved = np.cumsum(keep) - 1
        begins, ends = moved[begins], moved[ends]
        data = data[keep]
        data[:-8][_SPACE[data[:-8]]] = 32
    for a, b in zip(first[:-1], first[1:]):
        n = max(min(b - a, 1), b - a - SHINGLE_WORDS + 1)
        if b - a >= SHINGLE_WORDS:
            found = runs[a : a + n]
        else:  # fewer words: all as one
            found = mix(words[a : a + n], int(b - a) + 16)
            for k in range(a + 1, b):
                found = mix(found + words[k : k + 1], int(b - a) + 16)
        if whole:
            last = np.arange(a, a + n) + min(b - a, SHINGLE_WORDS) - 1
            yield Shingles(found, begins[a : a + n], ends[last], data, data[begins[a] : ends[b - 1]].tobytes() if n else b"")
        else:
            found = np.sort(found)
            yield found[np.r_[True, found[1:] != found[:-1]][: len(found)]]


def _groups(texts: list[str | None], whole: bool) -> Iterator:
    texts = [x or "" for x in texts]
    start = size = 0
    for at, text in enumerate(texts):
        size += len(text)
        if size >= GROUP_CHARS or at + 1 == len(texts):
            yield from _group(texts[start : at + 1], whole)
            start, size = at + 1, 0


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of five words; with fewer words, of them all as one."""
    return _groups(texts, False)


def shingles(texts: list[str | None]) -> Iterator[Shingles]:
    """The same with the words, for exact comparisons."""
    return _groups(texts, True)
