"""What a ranking has in common: contrasts of all features between its thirds, and rules held against it.

Features are unpivoted once, so there is a row for each symbol and feature, and a rule is a row of a table (feature, sign,
threshold, third, least share) that meets them by feature: new rules and features need no new code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.operators.places import placed

RULES = "rule string, feature string, sign string, threshold double, grp string, least double"
SIGNS = ("<", "<=", ">", ">=")


def rules_table(spark: SparkSession, rules: tuple[tuple[str, str, str, float, str, float], ...]) -> DataFrame:
    """RULES. Raises for an unknown sign or third."""
    for rule, _, sign, _, grp, _ in rules:
        if sign not in SIGNS or grp not in ("TOP", "MID", "BOT"):
            raise ValueError(f"rule {rule} has the sign {sign} and the third {grp}")
    return spark.createDataFrame(list(rules), RULES)


def in_thirds(features: DataFrame) -> DataFrame:
    """symbol, grp, feature, value of rows of symbol, true_rank and features, known values alone. TOP and BOT are the first and last
    n // 3 by rank (one at least), MID as many after TOP; what is left over is in none."""
    names = [c for c in features.columns if c not in ("symbol", "true_rank")]
    n = features.agg(F.count("*").alias("_n"), F.greatest(F.floor(F.count("*") / 3), F.lit(1)).alias("_third"))
    rows = placed(features, [F.col("true_rank"), F.col("symbol")], "_place").crossJoin(F.broadcast(n))  # one row
    grp = F.when(F.col("_place") <= F.col("_third"), "TOP").when(F.col("_place") > F.col("_n") - F.col("_third"), "BOT").when(F.col("_place") <= 2 * F.col("_third"), "MID")
    doubles = [F.col(c).cast("double").alias(c) for c in names]
    return rows.select("symbol", grp.alias("grp"), *doubles).unpivot(["symbol", "grp"], names, "feature", "value").where("value IS NOT NULL")


def contrasts(features: DataFrame) -> DataFrame:
    """feature, top, mid, bot (means), contrast (top less bot), shape (rising or falling through the thirds, or neither)."""
    mean = lambda g: F.avg(F.when(F.col("grp") == g, F.col("value")))
    found = in_thirds(features).groupBy("feature").agg(*[mean(g).alias(g.lower()) for g in ("TOP", "MID", "BOT")])
    rising, falling = (F.col("top") > F.col("mid")) & (F.col("mid") > F.col("bot")), (F.col("top") < F.col("mid")) & (F.col("mid") < F.col("bot"))
    return found.select("*", (F.col("top") - F.col("bot")).alias("contrast"), F.when(rising, "rising").when(falling, "falling").otherwise("neither").alias("shape"))


def rule_evidence(features: DataFrame, rules: DataFrame) -> DataFrame:
    """rule, n (symbols with the feature), n_met (its condition is met), n_both (and they are in its third), share (n_both / n_met, 0
    where none is met), base (the third's share of n), holds: the condition is met and share is least or more."""
    met: Column = F.lit(False)
    for sign, test in zip(SIGNS, (F.col("value") < F.col("threshold"), F.col("value") <= F.col("threshold"), F.col("value") > F.col("threshold"), F.col("value") >= F.col("threshold"))):
        met = F.when(F.col("sign") == sign, test).otherwise(met)
    inside = F.coalesce(F.col("grp") == F.col("_wanted"), F.lit(False))
    each = in_thirds(features).join(F.broadcast(rules.withColumnRenamed("grp", "_wanted")), "feature").withColumns({"_met": met, "_inside": inside})  # as many as rules are written
    found = each.groupBy("rule", "least").agg(F.count("*").alias("n"), F.count_if("_met").alias("n_met"), F.count_if(F.col("_met") & F.col("_inside")).alias("n_both"), F.count_if("_inside").alias("n_inside"))
    share = F.col("n_both") / F.greatest(F.col("n_met"), F.lit(1))
    return found.select("rule", "n", "n_met", "n_both", share.alias("share"), (F.col("n_inside") / F.col("n")).alias("base"), ((F.col("n_met") > 0) & (F.round(share, 12) >= F.col("least"))).alias("holds"))
