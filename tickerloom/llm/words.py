"""Encoding by distinct words: a text is split where no token can cross, and each distinct word is encoded once."""

from __future__ import annotations

import functools
import os
import re

import numpy as np

#: Words whose encodings a task keeps; when there are more, it begins anew, so memory stays bounded.
KEPT_WORDS = 1_000_000
#: Texts are handled in groups of about so many characters.
GROUP_CHARS = 2_000_000
#: Tokenizers that drop white space can't have a token across ASCII white space.
WORD = re.compile(r"[^ \t-\r]+")
#: What str.split() takes for white space though Unicode doesn't.
NO_SPACE = re.compile("[\x1c-\x1f]")
#: A line of lower-case Latin letters and of marks that may follow them: two pieces for any tokenizer that parts letters
#: from marks. No apostrophe, which may begin a contraction.
PARTED = re.compile(r"^(?:([a-z\xdf-\xf6\xf8-\xff]+)([!#$%&*+,./:;=?@|)\\\]}-]*)|.*)$", re.MULTILINE)
#: Words of letters that are encoded in one call, with spaces between.
TOGETHER = 100


@functools.lru_cache(maxsize=4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def encode_words(path: str, words: list[str]) -> list[bytes]:
    """Each word's ids as little-endian unsigned 32-bit numbers."""
    tokenizer = load(path)
    encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
    return [np.array(x.ids, "<u4").tobytes() for x in encode(words, add_special_tokens=False)]


@functools.lru_cache(maxsize=4)
def _ends_word(path: str) -> np.ndarray | None:
    """By id, whether its piece ends a word; None for a tokenizer whose pieces don't tell."""
    tokenizer = load(path)
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
    if not suffix:
        return None
    vocabulary = tokenizer.get_vocab()
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    out[[k for piece, k in vocabulary.items() if piece.endswith(suffix)]] = True
    return out


def encode_letters(path: str, words: list[str]) -> list[bytes]:
    """As encode_words, for words of letters alone, each of which is one piece for the tokenizer."""
    tokenizer, last, out = load(path), _ends_word(path), []
    encode = tokenizer.encode_batch if last is None else getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
    for x in encode([" ".join(words[at : at + TOGETHER]) for at in range(0, len(words), TOGETHER)], add_special_tokens=False):
        ids = np.array(x.ids, "<u4")
        data, cut = ids.tobytes(), np.flatnonzero(last[ids]) if last is not None else np.flatnonzero(np.diff(x.word_ids, append=-1))
        ends = (4 * cut + 4).tolist()
        out += [data[a:b] for a, b in zip([0, *ends], ends)]
    return out


def lower_cases(path: str) -> bool:
    """Whether the tokenizer drops white space and tells no upper from lower case, so that encode_texts is right for it."""
    one, two, three = (load(path).encode(x, add_special_tokens=False).ids for x in ("Ab CD, e", "ab cd, e", "ab  cd,\ne"))
    return one == two == three


class Encoder:
    """Encodes texts by their distinct words, for a tokenizer that lower-cases, drops white space, and parts letters
    from marks; other tokenizers are refused. One for each task, so a worker keeps nothing afterwards."""

    def __init__(self, path: str):
        if not lower_cases(path):
            raise ValueError(f"{path} keeps case or white space: its words can't be encoded one by one")
        self.path, self.known = path, {}

    def _add(self, new: list[str]) -> None:
        known, parts = self.known, PARTED.findall("\n".join(new).lower()) if new else []
        letters = list({a for a, _ in parts}.difference(known, ("",)))
        for at in range(0, len(letters), 50_000):
            known.update(zip(letters[at : at + 50_000], encode_letters(self.path, letters[at : at + 50_000])))
        others = list({b for _, b in parts}.union(w for w, (a, _) in zip(new, parts) if not a).difference(known))
        for at in range(0, len(others), 20_000):
            known.update(zip(others[at : at + 20_000], encode_words(self.path, others[at : at + 20_000])))
        known.update((w, known[a] + known[b]) for w, (a, b) in zip(new, parts) if a)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids."""
        split = [WORD.findall(text) if NO_SPACE.search(text) else text.split() for text in texts]
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > KEPT_WORDS:
            self.known.clear()
            new = set().union(*split)
        self._add(list(new))
        return [b"".join(map(self.known.__getitem__, words)) for words in split]


def groups(texts: list[str | None]):
    """Ranges of rows that hold about GROUP_CHARS characters together, one row at least."""
    start = size = 0
    for at, text in enumerate(texts):
        size += len(text or "")
        if size >= GROUP_CHARS:
            yield start, at + 1
            start, size = at + 1, 0
    if start < len(texts):
        yield start, len(texts)
