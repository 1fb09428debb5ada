"""Sets of several families are scored family by family."""

from pyspark.sql import functions as F
from tickerloom.operators import families as S
from tickerloom.operators.score import Family

TWO = {n: Family(n, lambda q, w=w: q[w] * F.col("x"), {w: (0.0, 2.0)}, {}) for n, w in (("a", "w"), ("b", "v"))}


def test_each_family_by_itself(spark):
    sets = S.sets_table(spark, [("a", 1, 0, {"w": 2.0}), ("b", 1, 0, {"v": 3.0}), ("other", 1, 0, {"w": 5.0})])
    found = S.scores_of(spark.createDataFrame([(1.0,), (10.0,)], "x double"), sets, TWO, [F.col("family"), F.col("x")])
    assert sorted(map(tuple, found.where("score IS NOT NULL").collect())) == [("a", 1.0, 2.0), ("a", 10.0, 20.0), ("b", 1.0, 3.0), ("b", 10.0, 30.0)]
    assert found.where("score IS NULL").select("family", "x").orderBy("x").collect() == [("other", 1.0), ("other", 10.0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Project" in line and "q_w" in line and "q_v" in line and "x#" in line]
