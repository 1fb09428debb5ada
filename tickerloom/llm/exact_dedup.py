"""Exact dedup: skew-safe combining of equal texts, with DataFrame functions only.

Texts are equal when identical after each run of ASCII white space is replaced by one space. Three combining steps,
each grouping by the digest *and* the full normalised text, so that a digest collision can't merge two texts:

1. locally: a salt is told by the input partition, so Spark's partial aggregation joins all equal texts of a partition
   before anything is shuffled;
2. salted: the rest meets in (digest, salt) groups. The number of salts follows the number of rows, so a group that
   holds a third of all rows is split into parts of a bounded size;
3. globally: the winners of the salts, one row for each salt at most, meet by digest. Which winner stays, and how many
   there are, goes back to the salted parts by salt, digest, a second hash and the length, without texts. The first
   id of the winning part is the row that stays.

The lists of ids of a part hold rows of few partitions only, so they are bounded. A text is shuffled twice: when parts are
made, whose shuffle both later uses share, and as its salts' winner.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm.common import table, text_of

#: Mean number of rows that a salt gets of all rows, so the most doc_ids in a list.
ROWS_PER_SALT = 100_000
#: White space runs that aren't one plain space already: a run that starts with a control character, or a space and more.
SPACE_RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normal_form(text: Column) -> Column:
    return F.regexp_replace(text, SPACE_RUN, " ")


def exact_dedup(docs: DataFrame, salts: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as the empty text. Of equal texts the row with the smallest doc_id stays; of rows that repeat
    both doc_id and text one stays; null doc_ids count as largest. An empty table gives an empty result. Other
    columns of docs aren't read, whatever their names.
    """
    salts = salts or max(8, math.ceil(docs.count() / ROWS_PER_SALT))
    id_ = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc_id"))
    rows = docs.select(id_.alias("id"), normal_form(text_of()).alias("content"), F.coalesce(F.pmod(F.spark_partition_id(), F.lit(salts)), F.lit(0)).alias("salt"))
    # keys that can't be null: a join's filter for nulls would go into one use of the parts only, and their shuffle not be shared
    rows = rows.withColumn("digest", F.coalesce(F.sha2(F.col("content").cast("binary"), 256), F.lit("")))
    parts = rows.groupBy("digest", "content", "salt").agg(F.collect_list("id").alias("members"))
    best = F.array_min("members")
    winners = parts.select("digest", "content", "salt", F.struct(best["last"].alias("last"), best["doc_id"].alias("doc_id"), "salt").alias("best"), F.size("members").cast("long").alias("n"))
    merged = winners.groupBy("digest", "content").agg(F.min("best").alias("keep"), F.sum("n").alias("group_size"), F.collect_list("salt").alias("salts"))
    number = F.xxhash64("content").alias("number"), F.length("content").alias("size")
    found = merged.select("digest", *number, "keep", "group_size", F.explode("salts").alias("salt"))
    joined = parts.select("digest", *number, "salt", F.array_sort("members").alias("members")).join(found, ["digest", "number", "size", "salt"])
    each = joined.select("digest", "keep", "group_size", "salt", F.posexplode("members").alias("place", "id"))
    kept = (F.col("place") == 0) & (F.col("salt") == F.col("keep.salt"))
    return each.select("id.doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts: that with the smallest doc_id, null ids last; of rows that repeat
    doc_id and text, the smallest by the other columns. Nothing else goes, so rows with null doc_id stay if no other
    row has their text. The columns of docs must be of types that can be ordered.

    The row itself goes through the combining, so nothing is joined back and the text is shuffled once. Equal texts are
    combined in each input partition first, so of a hot text a task gets a row for each input partition at most.
    """
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.struct(*docs.columns).alias("row"))
    rows = docs.select(normal_form(text_of()).alias("content"), row.alias("best"))
    rows = rows.withColumn("digest", F.sha2(F.col("content").cast("binary"), 256))
    return rows.groupBy("digest", "content").agg(F.min("best").alias("best")).select("best.row.*")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
WITH normal AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS content FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY content) AS keep_id,
       count(*) OVER (PARTITION BY content) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY content) AS kept,
       sha256(content) AS text_sha256
FROM normal
"""

QUERIES = {"op3_exact_dedup": op3_exact_dedup}
ORACLE = {"op3_exact_dedup": SQL}
