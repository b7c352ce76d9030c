"""Exports: CSV, JSON lines, JSON, Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The order in which a row's time is looked for, by use.
EXPORT_TIMES = ("timestamp_utc", "timestamp", "start_utc", "last_utc", "first_utc")
SWEEP_TIMES = (*EXPORT_TIMES, "mtime_utc", "ctime_utc")
EVENT_TIMES = ("timestamp_utc", "timestamp")
TIMELINE_TIMES = ("timestamp_utc", "start_utc", "first_utc")
CONTEXT_TIMES = ("timestamp_utc", "start_utc", "mtime_utc", "when_utc", "first_utc", "last_utc", "dtime_utc", "ctime_utc")


def row_time(df: DataFrame, order: tuple[str, ...]) -> Column:
    """The first of a row's time columns, by ``order``, that is set."""
    own = [F.col(c).try_cast("timestamp") for c in order if c in df.columns]
    return F.coalesce(*own) if own else F.lit(None).cast("timestamp")


def rendered(df: DataFrame) -> DataFrame:
    """Every column as exports show it: times to the second, true as yes, lists joined, null blank."""
    cells = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind == "boolean":
            c = F.when(c, "yes")
        elif kind == "array<string>":
            c = F.array_join(c, ", ")
        elif kind.startswith(("array", "map", "struct")):
            c = F.to_json(c)
        cells.append(F.coalesce(c.cast("string"), F.lit("")).alias(name))
    return df.select(*cells)


def inside(path: str, source: str) -> bool:
    """Whether an output would be written into the evidence."""
    a, b = path.rstrip("/") + "/", source.rstrip("/") + "/"
    return a.startswith(b)


def write_csv(df: DataFrame, path: str) -> None:
    rendered(df).write.mode("overwrite").option("header", True).csv(path)


def write_ndjson(df: DataFrame, path: str, table: str, **more: str) -> None:
    """One JSON object a line, blank fields left out, with the table's name, ``more``, and ``_time`` in epoch seconds."""
    time = F.unix_seconds(row_time(df, EXPORT_TIMES)).alias("_time")
    cells = [F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns]
    stamped = df.select(time, *[F.col(f"`{c}`") for c in df.columns])
    own = rendered(stamped).select(F.col("_time").try_cast("long").alias("_time"), *cells)
    labels = [F.lit(v).alias(k) for k, v in {"triage_table": table, **more}.items()]
    own.select(F.to_json(F.struct(*labels, *own.columns), {"ignoreNullFields": "true"}).alias("value")).write.mode("overwrite").text(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)


def write_any(df: DataFrame, path: str) -> None:
    """By the path's extension: .csv, .ndjson or .jsonl, .json, .parquet."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        write_csv(df, path)
    elif kind in ("ndjson", "jsonl", "json"):
        write_ndjson(df, path, path.rsplit("/", 1)[-1].rsplit(".", 1)[0])
    elif kind == "parquet":
        write_parquet(df, path)
    else:
        raise ValueError(f"no writer for .{kind}")
