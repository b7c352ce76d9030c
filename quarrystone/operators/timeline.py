"""One timeline of many tables: what happened, where it is written, how serious it is, in one global order.

Each table says by a ``Source`` which of its columns is the time and how a row
reads. All projections are one union; the order is by time, then table, then
key, over the whole of it. Rows are range-partitioned, sorted within their
partitions and numbered from the partitions' sizes: no task sorts everything.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

COLUMNS = ("ts", "table", "key", "host", "event", "detail", "severity")
#: What the order is by: rows that share time, table and key are told apart by what they say.
ORDER = ("ts", "table", "key", "event", "detail", "severity")
_LOCAL = (1 << 33) - 1


@dataclass(frozen=True)
class Source:
    """How a table's rows stand in a timeline. A row without a time has no place in it."""

    time: Column
    key: Column
    event: Column
    detail: Column | None = None
    severity: Column | None = None
    host: Column | None = None


def timeline(tables: dict[str, tuple[DataFrame, list[Source]]]) -> DataFrame:
    """COLUMNS of all dated rows; a table may give several times a row (created, modified), each by a source of its own."""
    blank = F.lit("")
    rows = []
    for name, (df, sources) in tables.items():
        for s in sources:
            cells = (s.time.cast("timestamp"), F.lit(name), s.key.cast("string"), s.host or blank, s.event, s.detail if s.detail is not None else blank, s.severity if s.severity is not None else F.lit("INFO"))
            rows.append(df.select(*(c.alias(n) for c, n in zip(cells, COLUMNS, strict=True))).where("ts IS NOT NULL"))
    return reduce(DataFrame.unionByName, rows)


def numbered(rows: DataFrame, order: tuple[str, ...] = ORDER, parts: int | None = None) -> DataFrame:
    """``rows`` with ``number`` from 1 in the global order of ``order``, which must tell all rows apart but equal ones.

    The sorted rows are written once. A partition's share of the numbers follows
    from the sizes of those before it: one row for each partition.
    """
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()
    sorted_ = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = written(sorted_.withColumn("part_", F.shiftright(place, 33)).withColumn("at_", place.bitwiseAND(F.lit(_LOCAL))), "timeline")
    sizes = placed.groupBy("part_").agg(F.count("*").alias("n_"))
    before = sizes.select("part_", (F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).alias("before_"))
    return placed.join(F.broadcast(before), "part_").withColumn("number", F.col("before_") + F.col("at_") + 1).drop("part_", "at_", "before_")


def page(rows: DataFrame, start: str | None, end: str | None, size: int, after: tuple | None = None, order: tuple[str, ...] = ORDER) -> DataFrame:
    """The first ``size`` rows of [start, end) behind the row ``after`` (its values of ``order``), in order.

    The times prune the scans below the union; what is behind the last page's
    end is found by its values, so a late page costs what the first one does.
    """
    kept = rows
    if start is not None:
        kept = kept.where(F.col(order[0]) >= F.lit(start).cast("timestamp"))
    if end is not None:
        kept = kept.where(F.col(order[0]) < F.lit(end).cast("timestamp"))
    if after is not None:
        types = dict(rows.dtypes)
        kept = kept.where(F.col(order[0]) >= F.lit(after[0]).cast("timestamp")).where(F.struct(*order) > F.struct(*(F.lit(v).cast(types[c]).alias(c) for c, v in zip(order, after, strict=True))))
    return kept.orderBy(*order).limit(size)


def by_severity(rows: DataFrame, unit: str = "day") -> DataFrame:
    """How many rows each table has in each unit of time, by severity: what a timeline shows from afar."""
    return rows.groupBy(F.date_trunc(unit, "ts").alias("at"), "table", "severity").agg(F.count("*").alias("n"))
