"""The parts of exact dedup are shuffled once for both of their uses."""

from tickerloom.llm import exact_dedup as X


def test_parts_are_shuffled_once(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "a  b"), (2, "a b"), (3, None), (4, "")], "doc_id long, text string").write.parquet(path)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = X.exact_dedup(spark.read.parquet(path), 8)
        assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()
        assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in found.collect()) == [(1, 1, 2, True), (2, 1, 2, False), (3, 3, 2, True), (4, 3, 2, False)]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
