"""Secret scans with DataFrame functions only: patterns, and entropy in sliding windows over candidate strings.

Base spans come from three patterns (assign, access, hex). Added spans come from candidate strings, runs of
ENTROPY_WINDOW or more characters of one character class. Over each a window of that length slides; its Shannon
entropy is kept up to date by counts: one character enters, one leaves, and the sum of c * log2(c) changes by the
terms of these two alone. A candidate is a span where some window reaches its class's threshold, unless the allow-list
knows it or it overlaps a base span. Positions are code points, the end exclusive.

Each row is handled on its own, so no key can be skewed and nothing is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm.common import table, text_of

#: Kinds in the order that spans of one start are listed in.
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_b64")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: A match of at least so many characters (of its value, for assign) counts.
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Cheap tests that hold for every text with a span of the kind.
HINT = {"assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": r"AKIA[A-Z0-9]{16}", "hex": r"(?<![0-9a-f])[0-9a-f]{24}"}
#: Characters of a window; the bits that a window must reach, by class; its alphabet in the order of the counts.
ENTROPY_WINDOW = 20
CLASSES = {"entropy_hex": ("0123456789abcdefABCDEF", 3.0), "entropy_b64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 3.9)}
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
#: Strings of high entropy that are no secrets: placeholders, runs of the alphabet, UUIDs, digests that name themselves.
ALLOW = r"(?i)example|placeholder|changeme|dummy|sample|xxxx|0123456789|1234567890|abcdefghij|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^sha(1|256|384|512)-"

SPAN = "array<struct<start:int,ord:int,end:int>>"


def _no_spans() -> Column:
    return F.array().cast(SPAN)


def _let(x: Column, f) -> Column:
    """f(x), with x worked out once however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _matches(text: Column, pattern: str, group: int, kind_of) -> Column:
    """Spans of the leftmost non-overlapping matches of pattern; kind_of(value) is a span's place in KINDS, or null."""
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    each = F.arrays_zip(whole.alias("whole"), F.transform(value, kind_of).alias("ord"), F.slice(gaps, 1, F.size(whole)).alias("gap"))
    return F.aggregate(
        F.transform(each, lambda m: F.struct(F.length(m["gap"]).alias("gap"), F.length(m["whole"]).alias("size"), m["ord"].alias("ord"))),
        F.struct(F.lit(0).alias("at"), _no_spans().alias("spans")),
        lambda acc, m: F.struct(
            (acc["at"] + m["gap"] + m["size"]).alias("at"),
            F.when(m["ord"].isNotNull(), F.array_append(acc["spans"], F.struct((acc["at"] + m["gap"]).alias("start"), m["ord"].alias("ord"), (acc["at"] + m["gap"] + m["size"]).alias("end"))))
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )


def max_window_entropy(string: Column, alphabet: str, window: int = ENTROPY_WINDOW) -> Column:
    """Bits: the largest Shannon entropy of any window of string, which has window characters at least, all of the
    alphabet. sum holds the sum of c * log2(c) over the window's counts c. A step looks at the window's other characters
    once, for the counts of the one that leaves and the one that enters; so the work is in proportion to the string."""
    change = [(c + 1) * math.log2(c + 1) - (c * math.log2(c) if c else 0.0) for c in range(window + 1)]
    more = F.array(*map(F.lit, change))  # by a count, what one more of it adds to the sum
    count = lambda rest, x: F.size(F.filter(rest, lambda y: y == x))

    def of(codes: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            """i: the 0-based position that enters."""

            def moved(rest: Column) -> Column:
                entered = state["sum"] + F.get(more, count(rest, F.get(codes, i)))
                return F.when(i >= window, entered - F.get(more, count(rest, F.get(codes, i - window)))).otherwise(entered)

            rest = F.slice(codes, F.greatest(i - window + 2, F.lit(1)), F.least(i, F.lit(window - 1)))
            least = lambda total: F.struct(total.alias("sum"), F.when(i >= window - 1, F.least(state["least"], total)).otherwise(state["least"]).alias("least"))
            return _let(_let(rest, moved), least)

        start = F.struct(F.lit(0.0).alias("sum"), F.lit(float("inf")).alias("least"))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda s: F.lit(math.log2(window)) - s["least"] / window)

    # the characters' places in the alphabet; split makes the array of them in one pass
    places = F.transform(F.split(string, ""), lambda c: F.position(c, F.lit(alphabet)))
    return _let(F.filter(places, lambda p: p > 0), of)


def base_spans(text: Column) -> dict[str, Column]:
    """Spans by kind."""

    def spans(kind: str, pattern: str, group: int) -> Column:
        long = lambda value: F.when(F.length(value) >= LEAST[kind], F.lit(KINDS.index(kind)))
        return F.when(text.rlike(HINT[kind]), _matches(text, pattern, group, long)).otherwise(_no_spans())

    return {"assign": spans("assign", ASSIGN, 2), "access": spans("access", ACCESS, 0), "hex": spans("hex", HEX, 0)}


def entropy_spans(text: Column, base: Column) -> Column:
    """Spans of the candidate strings in whose windows the entropy is high, but for allowed ones and those over base spans."""
    (hex_, hex_least), (b64, b64_least) = CLASSES.values()

    def kind_of(string: Column) -> Column:
        mixed = string.rlike("[0-9]") & string.rlike("[A-Za-z]") & ~string.rlike(ALLOW)
        of_hex = F.when(max_window_entropy(string, hex_) >= hex_least, F.lit(KINDS.index("entropy_hex")))
        of_b64 = F.when(max_window_entropy(string, b64) >= b64_least, F.lit(KINDS.index("entropy_b64")))
        return F.when(mixed, F.when(string.rlike(rf"^[{hex_}]+$"), of_hex).otherwise(of_b64))

    found = F.when(text.rlike(CANDIDATE), _matches(text, CANDIDATE, 0, kind_of)).otherwise(_no_spans())
    return F.filter(found, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


def secret_spans(docs: DataFrame) -> DataFrame:
    """docs and: assign, access, hex (arrays of start, ord, end), base (all three, sorted), spans (with the entropy ones).

    Null and empty text: empty arrays. Rows are independent, so ties and repeated rows make no difference; columns of
    docs with these names are replaced.
    """
    kinds = docs.withColumns(base_spans(text_of()))
    base = kinds.withColumn("base", F.sort_array(F.concat(*KINDS[:3])))
    return base.withColumn("spans", F.sort_array(F.concat("base", entropy_spans(text_of(), F.col("base")))))


def span_text(spans: str) -> Column:
    """kind:start:end, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["ord"]), s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with each maximal run of overlapping spans (sorted by start) replaced by mark."""
    done = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.array_append(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(done, ""))


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with the secrets in text replaced, and n_chars (if there is one) counted anew where some were; every row
    stays, and every other column whatever its name. Null text stays null. An empty table gives an empty result."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    found = secret_spans(row)
    new = F.when(F.col("text").isNull(), F.col("text")).otherwise(redact(F.col("text"), F.col("spans")))
    out = found.select("row", new.alias("text"), (F.size("spans") > 0).alias("found"))
    n_chars = F.when(F.col("found"), F.length("text")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None
    return out.select(*[F.col("text") if c == "text" else n_chars.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(span_text("base"), 256).alias("base_sha256"),
        span_text("spans").alias("spans"),
    )


QUERIES = {"op5_secret_scan": op5_secret_scan}
ORACLE: dict[str, str] = {}
