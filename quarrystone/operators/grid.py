"""The grid's query model: filters, facets, windows, typed sorts, pages; searches over all tables."""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def row_text(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A row as one lower-case text; nulls leave nothing."""
    return F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in columns or df.columns)))


def text_filter(hay: Column, box: str) -> Column:
    """``a|b``: any of the alternatives as a substring, whatever the case; blank: everything."""
    terms = [t.strip().lower() for t in box.split("|") if t.strip()]
    return reduce(lambda a, b: a | b, [hay.contains(t) for t in terms]) if terms else F.lit(True)


def matching(df: DataFrame, box: str = "", columns: dict[str, str] | None = None, ticked: dict[str, list[str]] | None = None, window: Column | None = None, skip: str | None = None) -> DataFrame:
    """Rows that pass the text box, the columns' boxes and ticked values (OR within one, AND between), and the time window.

    ``skip`` leaves one column's ticked values out, as its own facet does.
    """
    tests = [text_filter(row_text(df), box)] if box.strip() else []
    tests += [text_filter(F.lower(F.col(c).cast("string")), b) for c, b in (columns or {}).items() if b.strip()]
    tests += [F.coalesce(F.col(c).cast("string"), F.lit("")).isin(v) for c, v in (ticked or {}).items() if c != skip and v]
    if window is not None:
        tests.append(window)
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def facet(df: DataFrame, column: str, most: int | None = None, **filters) -> DataFrame:
    """(value, n) of a column under the other filters, most frequent first, then by value; with ``most``, so many."""
    own = matching(df, skip=column, **filters)
    value = F.coalesce(F.col(column).cast("string"), F.lit(""))
    counts = own.groupBy(value.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")
    return counts if most is None else counts.limit(most)


def histogram(df: DataFrame, column: str) -> DataFrame:
    """(value, n, distinct): counts of a column's values, each with the number of distinct values."""
    counts = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(df.agg(F.count_distinct(column).alias("distinct"))))  # one row


def overlaps(first: Column, last: Column, low: Column, high: Column) -> Column:
    """Whether [first, last] meets [low, high]; undated rows do not."""
    return (first <= high) & (last >= low)


def parse_when(text: str, newest: datetime, end: bool = False) -> datetime | None:
    """``2024-01-05``, ``... 10:20`` or ``... 10:20:30``, or ``-3h``, ``-2d``, ``-1w`` before ``newest``.

    As the ``end`` of a window, a day or a minute means its last second.
    """
    text = text.strip()
    if m := re.fullmatch(r"-(\d+)([hdw])", text):
        return newest - int(m[1]) * {"h": timedelta(hours=1), "d": timedelta(days=1), "w": timedelta(weeks=1)}[m[2]]
    for pattern, whole in (("%Y-%m-%d %H:%M:%S", timedelta(seconds=1)), ("%Y-%m-%d %H:%M", timedelta(minutes=1)), ("%Y-%m-%d", timedelta(days=1))):
        try:
            at = datetime.strptime(text.replace("T", " "), pattern)
        except ValueError:
            continue
        return at + whole - timedelta(seconds=1) if end else at
    return None


def typed_sort(df: DataFrame, column: str, descending: bool = False, ties: list[str] | None = None) -> DataFrame:
    """Rows by a text column: numbers by value, then words without case; blanks last in both directions."""
    text = F.btrim(F.coalesce(F.col(column).cast("string"), F.lit("")))
    number = text.try_cast("double")
    keys = [number.isNull(), number, F.lower(text)]
    sort = (lambda k: k.desc_nulls_last()) if descending else (lambda k: k.asc_nulls_last())
    return df.orderBy((text == "").asc(), *map(sort, keys), *(ties or []))


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """One page of a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def search_all(tables: dict[str, tuple[DataFrame, str]], term: str, sample: int = 5) -> DataFrame:
    """(table, matches, key, row) of a term in any column of any table: exact counts, and up to ``sample`` rows each.

    ``tables``: name to (table, column that orders it). Each table is scanned
    once; only matching rows are turned to JSON, and written for both uses.
    """
    parts = []
    for name, (df, key) in tables.items():
        hit = df.where(text_filter(row_text(df), term))
        parts.append(hit.select(F.lit(name).alias("table"), F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("row")))
    hits = reduce(DataFrame.unionByName, parts)
    hits = written(hits, "hits")
    w = Window.partitionBy("table").orderBy("key", "row")
    first = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= sample).drop("rank")
    counts = hits.groupBy("table").agg(F.count("*").alias("matches"))
    return first.join(counts, "table").select("table", "matches", "key", "row")


def time_slice(tables: dict[str, tuple[DataFrame, str]], low: datetime, high: datetime, most: int = 40) -> DataFrame:
    """(table, ts, row): up to ``most`` rows of each table between two instants, inclusive."""
    parts = []
    for name, (df, ts) in tables.items():
        inside = df.where(F.col(ts).between(F.lit(low), F.lit(high))).orderBy(ts).limit(most)
        parts.append(inside.select(F.lit(name).alias("table"), F.col(ts).alias("ts"), F.to_json(F.struct(*df.columns)).alias("row")))
    return reduce(DataFrame.unionByName, parts).orderBy("ts", "table")


def relationship_graph(rows: DataFrame, entities: dict[str, str], order: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (kind, id, n) and edges (kind_a, a, kind_b, b, n) of entities that share a row; ``entities``: column to kind."""
    cells = F.filter(F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("id")) for c, kind in entities.items())), lambda x: F.coalesce(x["id"], F.lit("")) != "")
    held = rows.select(F.col(order).alias("o"), F.array_sort(F.array_distinct(cells)).alias("cells"))
    nodes = held.select(F.explode("cells").alias("x")).groupBy("x.kind", "x.id").agg(F.count("*").alias("n"))
    pairs = held.select(F.posexplode("cells").alias("i", "x"), "cells").select("x", F.explode(F.slice("cells", F.col("i") + 2, F.size("cells"))).alias("y"))
    edges = pairs.groupBy(F.col("x.kind").alias("kind_a"), F.col("x.id").alias("a"), F.col("y.kind").alias("kind_b"), F.col("y.id").alias("b")).agg(F.count("*").alias("n"))
    return nodes, edges
