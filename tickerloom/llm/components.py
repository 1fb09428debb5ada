"""Connected components of links held in a table, by hooking and contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import forget, materialise


def _roots(edges: DataFrame) -> DataFrame:
    """id, root: every id hooks onto its smallest neighbour, and hooks are followed to their roots.

    Hooks only go round in circles of two ids, each the other's smallest neighbour; of these the smaller is a root. Each
    step goes twice as far as the one before, so a path of n hooks takes log2(n) steps.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hooks = materialise(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("up")), "hooks")
    first = True
    while True:
        next_ = hooks.select(F.col("id").alias("up"), F.col("up").alias("next"))
        circle = (F.col("next") == F.col("id")) & (F.col("id") < F.col("up"))
        root = F.when(circle, F.col("id")).otherwise(F.col("up")) if first else F.col("next")
        moved = hooks.join(next_, "up").select("id", root.alias("root"), (root != F.col("up")).alias("moved"))
        found = materialise(moved.select("id", F.col("root").alias("up"), "moved"), "hooks")
        forget(hooks)
        hooks = found
        if not first and hooks.where("moved").isEmpty():
            return hooks.select("id", F.col("up").alias("root")), hooks
        first = False


def components(links: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """id, component (the smallest id it reaches) for every id in links (a, b: not null).

    Each round every id that still has links is hooked onto a neighbour, so what hangs together afterwards is one id for what
    were two at least: the ids that have links are halved at least, whatever the links' shape, and rounds are logarithmic.
    Every step is an aggregation or an equi-join; a centre with very many links is combined before the shuffle, its joins are
    split by AQE. rounds gets the number of ids that each round began with.
    """
    edges = materialise(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    found = None
    while not edges.isEmpty():
        roots, written = _roots(edges)
        if rounds is not None:
            rounds.append(roots.count())
        a, b = (roots.select(F.col("id").alias(c), F.col("root").alias(f"{c}_up")) for c in "ab")
        before = edges, found
        moved = edges.join(a, "a").join(b, "b").where("a_up <> b_up")
        edges = materialise(moved.select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct(), "links")
        if found is None:
            found = materialise(roots.withColumnRenamed("root", "component"), "components")
        else:
            found = found.join(roots.select(F.col("id").alias("component"), "root"), "component", "left").select("id", F.coalesce("root", "component").alias("component"))
            found = materialise(found, "components")
        forget(written, *[x for x in before if x is not None])
    if found is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    least = materialise(found.groupBy("component").agg(F.min("id").alias("least")), "least")
    out = materialise(found.join(least, "component").select("id", F.col("least").alias("component")), "components")
    forget(found, least)
    return out
