"""Merging what several sources say about one thing; set and ledger joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def first_writer(facts: list[DataFrame], key: str, labels: list[str]) -> DataFrame:
    """One row per ``key`` from several tables: for each column the first table's non-blank value, and ``sources``.

    Equals a full outer join of all tables with coalesce, in one shuffle:
    tables are stacked by name with their priority, then reduced with min_by,
    which combines before the shuffle.
    """
    stacked = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [f.withColumn("priority_", F.lit(i)).withColumn("source_", F.lit(label)) for i, (f, label) in enumerate(zip(facts, labels, strict=True))],
    )
    columns = [c for c in stacked.columns if c not in (key, "priority_", "source_")]
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.struct("priority_", F.col(c).cast("string")))).alias(c)
    return stacked.groupBy(key).agg(*map(first, columns), F.array_join(F.sort_array(F.collect_set("source_")), ", ").alias("sources"))


def merge_by_name(tables: dict[str, DataFrame], provenance: str = "collection") -> DataFrame:
    """Tables of several collections as one: union by column name, absent columns null, the label first.

    The label's column gets a trailing ``_`` while a table has its name already.
    """
    while any(provenance in t.columns for t in tables.values()):
        provenance += "_"
    labelled = [t.select(F.lit(label).alias(provenance), "*") for label, t in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), labelled)


def unclaimed(files: DataFrame, claims: DataFrame, key: str) -> DataFrame:
    """Rows of ``files`` that no claim names."""
    return files.join(claims.select(key).distinct(), key, "left_anti")


def collapse(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Equal rows as one, with ``occurrences`` and the first ``order``."""
    return rows.groupBy(*keys).agg(F.count("*").alias("occurrences"), F.min(order).alias(f"first_{order}"))


def capped(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each key as a sample, each with the exact ``total`` of its key.

    The total is a grouped count joined back, so the sample's window can be
    limited before its shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    sample = rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= most)
    return sample.join(rows.groupBy(*keys).agg(F.count("*").alias("total")), keys)


def once(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank_", F.row_number().over(w)).where("rank_ = 1").drop("rank_")


def indicator_rollup(observations: DataFrame) -> DataFrame:
    """(value, why, source, ts) to one row per value: distinct reasons and sources, count, first and last."""
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), "; ")
    return observations.where(F.coalesce(F.btrim("value"), F.lit("")) != "").groupBy("value").agg(
        joined("why").alias("why"), joined("source").alias("sources"), F.count("*").alias("count"), F.min("ts").alias("first"), F.max("ts").alias("last")
    )


def tree(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, parent, depth, path, children) of a forest; ``path`` sorts rows into preorder.

    Each node points at an ancestor and has the path up to it; a round joins it
    with that ancestor's own pointer and path, so depth d takes log2(d) rounds.
    A node whose parent is absent is a root. Nodes in a loop or below one meet
    their own path again and come with depth null. Of rows of one node any one stays.
    """
    own = nodes.select(F.col(node).alias("node"), F.col(parent).alias("parent")).dropDuplicates(["node"])
    known = own.select(F.col("node").alias("up"))
    state = own.join(known, F.col("parent") == F.col("up"), "left").select("node", "parent", "up", F.array("node").alias("path"), F.lit(False).alias("lost"))
    while True:
        state = written(_looped(state), "tree")
        if state.where("up IS NOT NULL").isEmpty():
            break
        s, t = state.alias("s"), state.select("node", "up", "path", "lost").alias("t")
        further = F.when(F.col("s.up").isNull(), F.col("s.path")).otherwise(F.concat("t.path", "s.path"))
        lost = F.col("s.lost") | F.coalesce("t.lost", F.lit(False))
        state = s.join(t, F.col("s.up") == F.col("t.node"), "left").select("s.node", "s.parent", "t.up", further.alias("path"), lost.alias("lost"))
    counts = own.groupBy(F.col("parent").alias("p")).agg(F.count("*").alias("children"))
    depth = F.when(~F.col("lost"), F.size("path") - 1).cast("int")
    return state.join(counts, F.col("node") == F.col("p"), "left").select("node", "parent", depth.alias("depth"), "path", F.coalesce("children", F.lit(0)).alias("children"))


def _looped(state: DataFrame) -> DataFrame:
    """Nodes that are lost, or whose path has the ancestor it leads to, point nowhere."""
    lost = F.col("lost") | F.coalesce(F.array_contains("path", F.col("up")), F.lit(False))
    return state.withColumn("lost", lost).withColumn("up", F.when(~F.col("lost"), F.col("up"))).withColumn("path", F.when(F.col("lost"), F.array("node")).otherwise(F.col("path")))


def severity_rank(severity: Column) -> Column:
    """0 for CRITICAL to 4 for INFO; anything else null."""
    order = F.create_map(*[x for i, s in enumerate(SEVERITIES) for x in (F.lit(s), F.lit(i))])
    return F.try_element_at(order, severity)


def worst(severity: Column) -> Column:
    """The worst severity of a group."""
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), F.min(severity_rank(severity)) + 1)


#: Severities, worst first.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
