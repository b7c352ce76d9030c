"""Connected components of an edge table, by contraction, without the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of ``edges`` (a, b: long).

    Each round hooks every node to its smallest neighbour if that is smaller
    than itself, follows the hooks to their end by pointer jumping, and
    contracts the edges; a path of n nodes needs about log n rounds. Every
    table is linear in the edges and shuffles on nodes. A loop, a repeated
    edge and both directions of one are harmless; an end that is null drops
    the edge.
    """
    left = written(
        edges.where("a IS NOT NULL AND b IS NOT NULL")
        .select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
        .distinct(),
        "edges",
    )
    labels = left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    left = left.where("a <> b")
    for _ in range(max_rounds):
        if left.isEmpty():
            return labels
        hooks = written(left.groupBy("a").agg(F.min("b").alias("to")), "hooks")
        while True:  # a hook always goes to a smaller node, so this ends
            further = hooks.alias("x").join(hooks.alias("y"), F.col("x.to") == F.col("y.a"), "left")
            moved = written(
                further.select("x.a", F.coalesce("y.to", "x.to").alias("to"), F.col("y.to").isNotNull().alias("moved")),
                "hooks",
            )
            hooks = moved.select("a", "to")
            if moved.where("moved").isEmpty():
                break
        labels = written(
            labels.join(hooks, labels["root"] == hooks["a"], "left").select("node", F.coalesce("to", "root").alias("root")),
            "labels",
        )
        on_a = left.join(hooks, "a", "left").select(F.coalesce("to", "a").alias("a"), "b")
        both = on_a.join(hooks.select(F.col("a").alias("b"), F.col("to").alias("to_b")), "b", "left")
        left = written(
            both.select(F.col("a").alias("x"), F.coalesce("to_b", "b").alias("y"))
            .where("x <> y")
            .select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
            .distinct(),
            "edges",
        )
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
