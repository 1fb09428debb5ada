"""Language ID by character language models: interpolated Kneser-Ney, one model per language, in sorted hash arrays.

A text becomes symbols: lower-cased letters (and marks), each run of anything else one space. A gram of up to four
symbols is a 64-bit number, 16 bits a symbol (beyond the Basic Multilingual Plane: hashed into the private-use area),
so a lower order is a mask away. Counting is one Spark aggregation over all training rows; the lower orders'
continuation counts and the discounts follow from all distinct four-grams of all languages. What is broadcast is sorted
arrays of grams, with the log-probabilities of all languages side by side; it grows with the distinct four-grams.

The language with the lowest cross-entropy per symbol wins. A text is rejected if it has no letter, or if it fits its
language no better than texts of other languages do: its cross-entropy is over the mean that training texts have under
the second-best language, and over REJECT_SD standard deviations above the mean under their own; or over that of symbols
drawn at random. The means and deviations are aggregated over all training rows, by the language they are given. Where
those are fewer than LEAST_ROWS, they say little of other texts (a model fits what it was trained on), and only the cost
of symbols drawn at random rejects. A text that mixes two languages stays.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm.common import table

ORDER, BITS = 4, 16
#: The rows that a language's limit is told from, at least; the deviations; texts with fewer letters stay.
LEAST_ROWS, REJECT_SD, LEAST_SD, LEAST_LETTERS = 30, 8.0, 0.1, 20
#: Symbols that count for the score: more don't make it surer.
SCORE_SYMBOLS = 50
#: Texts are handled in groups of about so many characters.
GROUP_CHARS = 500_000


@functools.lru_cache(maxsize=1)
def _symbols() -> tuple[np.ndarray, np.ndarray]:
    """By code point of the BMP: its symbol, and whether it is a letter."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(1 << 16)]
    letter = np.array([k == "L" for k in kinds])
    symbol = np.where(np.array([k in "LM" for k in kinds]), np.arange(1 << 16), 32).astype(np.uint16)
    return symbol, letter


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(four-grams, the number of them by text, the number of letters by text)."""
    lower = [x.lower() for x in texts]
    points = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.array([len(x) for x in lower], np.int64)
    symbol, letter = _symbols()
    high = points >> 16 != 0
    low = np.where(high, 0, points).astype(np.uint16) if high.any() else points.astype(np.uint16)
    symbols, letters = symbol[low], letter[low]
    if high.any():
        kinds = np.array([unicodedata.category(chr(c))[0] for c in points[high]])
        symbols[high] = np.where(np.isin(kinds, ["L", "M"]), 0xE000 + points[high] % 6400, 32)
        letters[high] = kinds == "L"
    text = np.repeat(np.arange(len(texts)), sizes)
    n_letters = np.bincount(text, letters, len(texts)).astype(np.int64)
    space = symbols == 32
    begins = np.ones(len(text), bool)
    begins[1:] = text[1:] != text[:-1]
    before = np.ones(len(text), bool)
    before[1:] = space[:-1]
    keep = ~(space & (before | begins))
    symbols, text = symbols[keep], text[keep]
    counts = np.bincount(text, minlength=len(texts))
    at = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    grams = symbols.astype(np.uint64)
    for back in range(1, ORDER):
        prior = np.full(len(text), 32, np.uint64)
        prior[back:] = np.where(at[back:] >= back, symbols[:-back], 32)
        grams |= prior << np.uint64(BITS * back)
    return grams, counts, n_letters


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _groups(texts: list[str]):
    start = size = 0
    for at, text in enumerate(texts):
        size += len(text)
        if size >= GROUP_CHARS or at + 1 == len(texts):
            yield start, at + 1
            start, size = at + 1, 0


def gram_counts(labelled: DataFrame) -> DataFrame:
    """lang, gram, n over all rows of lang, text (neither null)."""

    def count(batches):
        held: dict[str, list] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in _groups(texts):
                grams, sizes, _ = grams_of(texts[a:b])
                ends = np.cumsum(sizes)
                by: dict[str, list] = {}
                for lang, start, end in zip(langs[a:b], ends - sizes, ends):
                    by.setdefault(lang, []).append(grams[start:end])
                for lang, parts in by.items():
                    some = np.sort(np.concatenate(parts))
                    first = np.flatnonzero(np.r_[True, some[1:] != some[:-1]][: len(some)])
                    held.setdefault(lang, []).append((some[first], np.diff(np.r_[first, len(some)])))
                    if len(held[lang]) > 16:
                        held[lang] = [_summed(*map(np.concatenate, zip(*held[lang])))]
        for lang, parts in held.items():
            keys, n = _summed(*map(np.concatenate, zip(*parts)))
            for at in range(0, len(keys), 50_000):
                k, m = keys[at : at + 50_000].view(np.int64), n[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(m, pa.int64())], names=["lang", "gram", "n"])

    return labelled.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, whether there) of wanted in the sorted keys."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Model:
    """langs; by order: grams and log-probabilities (a column for each language), contexts and log back-off weights."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        self.grams: dict[int, np.ndarray] = {}
        self.logp: dict[int, np.ndarray] = {}
        self.contexts: dict[int, np.ndarray] = {}
        self.weight: dict[int, np.ndarray] = {}
        self.limits: dict[str, float] = {}
        by_order = {lang: self._orders(*counts[lang]) for lang in self.langs}
        symbols = np.unique(np.concatenate([by_order[x][1][0] for x in self.langs])) if self.langs else np.empty(0)
        self.uniform = -np.log(len(symbols) + 1.0)
        for k in range(1, ORDER + 1):
            self._add(k, {lang: by_order[lang][k] for lang in self.langs})

    @staticmethod
    def _orders(keys: np.ndarray, n: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Counts at the highest order; below it, how many distinct symbols come before a gram."""
        out = {ORDER: _summed(keys, n)}
        for k in range(ORDER - 1, 0, -1):
            lower = out[k + 1][0] & np.uint64((1 << BITS * k) - 1)
            out[k] = _summed(lower, np.ones(len(lower), np.int64))
        return out

    def _add(self, k: int, counts: dict) -> None:
        shift = np.uint64(BITS)
        grams = np.unique(np.concatenate([c[0] for c in counts.values()])) if counts else np.empty(0, np.uint64)
        contexts = np.unique(grams >> shift)
        logp, weight = np.empty((len(grams), len(counts))), np.zeros((len(contexts), len(counts)))
        if k > 1:
            at, _ = _find(self.grams[k - 1], grams & np.uint64((1 << BITS * (k - 1)) - 1))
            lower = np.exp(self.logp[k - 1][at])
        else:
            lower = np.full(logp.shape, np.exp(self.uniform))
        for column, (keys, n) in enumerate(counts.values()):
            ones, twos = (n == 1).sum(), (n == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.75
            place, _ = _find(contexts, keys >> shift)
            total, distinct = np.bincount(place, n, len(contexts)), np.bincount(place, minlength=len(contexts))
            share = np.where(total > 0, discount * distinct / np.maximum(total, 1), 1.0)
            weight[:, column] = np.log(share)
            own = np.zeros(len(grams))
            own[_find(grams, keys)[0]] = np.maximum(n - discount, 0)
            context, _ = _find(contexts, grams >> shift)
            logp[:, column] = np.log(own / np.maximum(total[context], 1) + share[context] * lower[:, column])
        self.grams[k], self.contexts[k] = grams, contexts
        self.logp[k], self.weight[k] = logp.astype(np.float32), weight.astype(np.float32)

    def log_probability(self, grams: np.ndarray, k: int = ORDER) -> np.ndarray:
        """A row for each gram, a column for each language; unseen grams back off to the next lower order."""
        if not k:
            return np.full((len(grams), len(self.langs)), self.uniform, np.float32)
        at, there = _find(self.grams[k], grams)
        out = self.logp[k][at]
        if not there.all():
            missed = grams[~there]
            place, known = _find(self.contexts[k], missed >> np.uint64(BITS))
            weight = np.where(known[:, None], self.weight[k][place], 0)
            out[~there] = weight + self.log_probability(missed & np.uint64((1 << BITS * (k - 1)) - 1), k - 1)
        return out

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cross-entropies by text and language, symbols by text, letters by text)."""
        grams, sizes, letters = grams_of(texts)
        if not len(grams) or not self.langs:
            return np.zeros((len(texts), len(self.langs))), sizes, letters
        full = np.flatnonzero(sizes)
        sums = np.zeros((len(texts), len(self.langs)))
        sums[full] = np.add.reduceat(self.log_probability(grams).astype(np.float64), (np.cumsum(sizes) - sizes)[full], axis=0)
        return -sums / np.maximum(sizes, 1)[:, None], sizes, letters


def train(labelled: DataFrame) -> Model:
    """The model of all rows of lang, text where neither is null. No such rows: a model without languages."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = gram_counts(rows).toPandas()
    model = Model({lang: (x["gram"].to_numpy().view(np.uint64), x["n"].to_numpy()) for lang, x in found.groupby("lang")})
    if model.langs:
        scored = identify(rows.select("text"), model).where(F.col("n_letters") >= LEAST_LETTERS)
        own = scored.groupBy("lang_pred").agg(F.count("*").alias("rows"), F.avg("cross_entropy").alias("mean"), F.stddev_pop("cross_entropy").alias("sd"), F.avg("runner_up").alias("other"))
        model.limits = dict.fromkeys(model.langs, -model.uniform)
        for r in own.where(F.col("rows") >= LEAST_ROWS).collect():
            model.limits[r["lang_pred"]] = min(max(r["mean"] + REJECT_SD * max(r["sd"], LEAST_SD), r["other"]), -model.uniform)
    return model


def identify(docs: DataFrame, model: Model, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs less the columns drop, and lang_pred, score, cross_entropy, runner_up (the cross-entropy under the second-best
    language), n_letters, accepted; columns of docs with these names are replaced.

    lang_pred is und (score 0, not accepted) if text is null or has no letter, or the model has no language. Languages
    that tie: the first by name. score is the winner's share of the languages' likelihoods over SCORE_SYMBOLS symbols.
    """
    new = {"lang_pred": "string", "score": "double", "cross_entropy": "double", "runner_up": "double", "n_letters": "long", "accepted": "boolean"}
    docs = docs.select(*[c for c in docs.columns if c not in new])
    kept = [c for c in docs.columns if c not in drop]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        model = shared.value
        names = np.array([*model.langs, "und"], object)
        limits = np.array([model.limits.get(x, -model.uniform) for x in model.langs] + [-np.inf])
        for batch in batches:
            texts = [x or "" for x in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            found = []
            for a, b in _groups(texts):
                entropy, symbols, letters = model.score(texts[a:b])
                known = (letters > 0) & bool(model.langs)
                if model.langs:
                    best = entropy.argmin(axis=1)
                    low = entropy.min(axis=1)
                    second = np.partition(entropy, 1, axis=1)[:, 1] if len(model.langs) > 1 else np.full(b - a, -model.uniform)
                    share = 1 / np.exp(-(entropy - low[:, None]) * np.minimum(symbols, SCORE_SYMBOLS)[:, None]).sum(axis=1)
                else:
                    best, low, second, share = np.zeros(b - a, np.int64), np.zeros(b - a), np.zeros(b - a), np.zeros(b - a)
                best = np.where(known, best, len(names) - 1)
                fits = known & ((low <= limits[best]) | (letters < LEAST_LETTERS))
                found.append(pd.DataFrame({"lang_pred": names[best], "score": np.where(known, share, 0.0), "cross_entropy": low, "runner_up": second, "n_letters": letters, "accepted": fits}))
            more = pa.RecordBatch.from_pandas(pd.concat(found), preserve_index=False) if found else None
            if more is not None:
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *more.columns], names=[*kept, *new])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept]
    return docs.mapInArrow(predict, ", ".join(schema + [f"{k} {v}" for k, v in new.items()]))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def model_of(docs: DataFrame) -> Model:
    """The model of the rows of docs that aren't held out."""
    return train(docs.where(~held_out()).select("lang", "text"))


def accepted_documents(docs: DataFrame) -> DataFrame:
    """docs without the rows that language ID rejects: null texts, texts without a letter, and those that fit no language.

    The columns of docs stay as they are, whatever their names, and so do repeated rows and null doc_ids. Where no row has
    text and lang, there is no language to fit, and only texts with no letter to them could be told: all go. No rows: no
    result.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    return identify(rows, model_of(docs), drop=("text",)).where("accepted").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), model_of(docs), drop=("text",))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")


QUERIES = {"op4_language_id": op4_language_id}
ORACLE: dict[str, str] = {}
