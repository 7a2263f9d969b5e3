"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custvalue.functions.materialise import materialise


def components(edges: DataFrame) -> DataFrame:
    """``(id, root)`` for every end of ``edges(a, b)``: root is the smallest id of the component.

    Each round, every vertex points to the vertex among itself and its neighbours that a fresh
    random order puts first, and the edges are redrawn between the targets. A round removes a fixed
    share of the vertices on average, whatever the ids, so long chains need few rounds. Only edges
    between different targets go on; no group is gathered in one task. Each round is a written table:
    checkpoints would carry size estimates along, which grow with every join.
    """
    edges = materialise(edges.where("a <> b").distinct())
    steps = []
    while not edges.isEmpty():
        turn = len(steps)
        step = materialise(_targets(edges, turn))
        steps.append(step)
        for end in ("a", "b"):
            at = step.select(F.col("id").alias(end), F.col("to").alias(f"new_{end}"))
            edges = edges.join(at, end)
        edges = edges.select(F.col("new_a").alias("a"), F.col("new_b").alias("b"))
        edges = materialise(edges.where("a <> b").distinct())
    if not steps:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    labels = steps[0].select("id", F.col("to").alias("root"))
    for step in steps[1:]:
        labels = labels.join(step.select(F.col("id").alias("root"), "to"), "root", "left")
        labels = labels.select("id", F.coalesce("to", "root").alias("root"))
    labels = materialise(labels)
    least = labels.groupBy("root").agg(F.min("id").alias("least"))
    return labels.join(least, "root").select("id", F.col("least").alias("root"))


def _targets(edges: DataFrame, turn: int) -> DataFrame:
    """``(id, to)``: of each vertex and its neighbours, the first in this turn's order."""
    both = edges.union(edges.select("b", "a"))
    placed = both.groupBy("a").agg(F.min(_place("b", turn)).alias("best"))
    return placed.select(F.col("a").alias("id"), F.least("best", _place("a", turn))["to"].alias("to"))


def _place(vertex: str, turn: int):
    return F.struct(F.xxhash64(vertex, F.lit(turn)), F.col(vertex).alias("to"))
