"""Brute-force versions in plain Python, for small tables."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def same_text(docs: list[dict]) -> dict[int, int]:
    """doc_id to the smallest doc_id with an equal text."""
    groups: dict[str, list[int]] = defaultdict(list)
    for r in docs:
        groups[SPACES.sub(" ", r["text"] or "")].append(r["doc_id"])
    return {i: min(g) for g in groups.values() for i in g}


def shingles(text: str | None) -> frozenset:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def near_components(docs: list[dict]) -> tuple[dict[int, int], dict[int, int]]:
    """doc_id to its set's size, and to its component; all pairs that share a shingle are compared."""
    sets = {r["doc_id"]: shingles(r["text"]) for r in docs}
    holders, parent = defaultdict(list), {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sets.items():
        shared: dict[int, int] = defaultdict(int)
        for x in s:
            for j in holders[x]:
                shared[j] += 1
            holders[x].append(i)
        for j, k in shared.items():
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: len(s) for i, s in sets.items()}, {i: root(i) for i in sets}


BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)


def base_spans(text: str | None) -> list[tuple[int, int, int, str]]:
    """(start, order, end, kind), sorted."""
    return sorted((m.start(), k, m.end(), kind) for k, (kind, p, g, least) in enumerate(BASE) for m in re.finditer(p, text or "") if len(m[g]) >= least)


def packed_pieces(tokenizer, docs: list[dict], capacity: int = 2048) -> dict[tuple[int, int], tuple[int, int, int]]:
    out = {}
    for r in docs:
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            out[r["doc_id"], k] = at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())
    return out


def alignments(docs: list[dict]) -> list[dict]:
    """The rows of op12, each text encoded as a whole."""
    import hashlib

    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in letters} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in letters)}

    def ends(ids: list[int], pieces: list[bytes]) -> list[tuple[int, int, int]]:
        out, at = [], 0
        for k, p in zip(ids, pieces):
            out.append((at, at + len(p), k))
            at += len(p)
        return out

    rows, links, count = [], [], defaultdict(int)
    for r in docs:
        raw = (" " + (r["text"] or "")).encode()
        found = one.encode(" " + (r["text"] or ""), add_special_tokens=False)
        a, a_pieces = found.ids, [bytes(byte[c] for c in p) for p in found.tokens]
        b = two.encode(r["text"] or "")
        b_pieces = [bytes([int(two.id_to_piece(k)[3:-1], 16)]) if two.is_byte(k) else two.id_to_piece(k).replace("▁", " ").encode() for k in b]
        if not r["text"] or b"".join(a_pieces) != raw or b"".join(b_pieces) != raw:
            rows.append({"doc_id": r["doc_id"], "n_a": 0, "n_b": 0, "n_groups": 0, "groups_sha256": ""})
            links.append([])
            continue
        x, y = ends(a, a_pieces), ends(b, b_pieces)
        common = sorted({e for _, e, _ in x} & {e for _, e, _ in y})
        groups = ";".join(",".join(str(k) for s, e, k in x if lo <= s and e <= hi) + "|" + ",".join(str(k) for s, e, k in y if lo <= s and e <= hi) for lo, hi in zip([0, *common], common))
        links.append([(k, m) for s, e, k in x for t, f, m in y if s < f and t < e])
        for pair in set(links[-1]):
            count[pair] += 1
        rows.append({"doc_id": r["doc_id"], "n_a": len(a), "n_b": len(b), "n_groups": len(common), "groups_sha256": hashlib.sha256(groups.encode()).hexdigest()})
    best: dict[int, int] = defaultdict(int)
    for (k, _), n in count.items():
        best[k] = max(best[k], n)
    return [r | {"n_links": len(p), "n_best": sum(count[x] == best[x[0]] for x in p), "count_sum": sum(count[x] for x in p)} for r, p in zip(rows, links)]
