"""Collected files as DataFrames: listings, text lines with their numbers, JSON lines, binary login records."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, size, mtime of every file below ``path``, without reading contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def contents(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """path, content of every file; with ``most``, only of files of up to so many bytes, which are pruned before contents are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return (files if most is None else files.where(F.col("length") <= most)).select("path", "content")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no, line of text files of any size; .gz, .bz2 and .zst are expanded by the reader.

    Large files are read in blocks by several tasks. A line's number is its
    place in its block, behind the lines of the blocks before it: rows are
    windowed by block, and only the counts of blocks by file.
    """
    place = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")]
    read = spark.read.text(path, recursiveFileLookup=True).select(*place, F.col("value").alias("line"))
    here = read.withColumn("i", F.monotonically_increasing_id())
    here = here.withColumn("i", F.row_number().over(Window.partitionBy("path", "block").orderBy("i")))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = read.groupBy("path", "block").agg(F.count("*").alias("n")).select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skipped"))
    return here.join(sizes, ["path", "block"]).select("path", (F.col("i") + F.col("skipped")).alias("line_no"), "line")


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line of text files of any size, split within files, without numbers."""
    return spark.read.text(path, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def glob_regex(pattern: str) -> str:
    """A path pattern as a regular expression, any case: ``*`` stops at a slash, ``**`` does not."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or (c if c.isalnum() or c in "/_" else "\\" + c)
            i += 1
    return f"(?i)^{out}$"


def matches_glob(path: Column, patterns: list[str]) -> Column:
    return path.rlike("|".join(glob_regex(p) for p in patterns))


def json_rows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines) of JSON-lines results, columns as found; bad lines are kept with their files."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line")).where(F.btrim("line") != "")
    rows = spark.read.json(path, mode="DROPMALFORMED")
    return rows, raw.where(F.try_parse_json("line").isNull())


def aliased(df: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """One column for each target name: the first of its candidates (any case) that is not blank."""
    low = {c.lower(): c for c in df.columns}
    cells = []
    for target, candidates in names.items():
        own = [F.nullif(F.col(low[c.lower()]).cast("string"), F.lit("")) for c in candidates if c.lower() in low]
        cells.append((F.coalesce(*own) if own else F.lit(None).cast("string")).alias(target))
    return df.select(*cells)


# The layout of a login record, and the names of its types.
RECORD = "<hxxi32s4s32s256shhiii4i20x"
TYPES = {1: "RUN_LVL", 2: "BOOT", 5: "INIT", 6: "LOGIN_PROCESS", 7: "LOGIN", 8: "DEAD"}
RECORD_COLUMNS = "path string, ord long, type string, pid int, line string, user string, host string, ts timestamp, address string"


def login_records(files: DataFrame) -> DataFrame:
    """utmp, wtmp and btmp files (path, content) as RECORD_COLUMNS; a partial record at the end is left out."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        record = struct.Struct(RECORD)  # made here: it cannot be sent to a worker
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                whole = len(content) // record.size * record.size
                for n, r in enumerate(record.iter_unpack(bytes(content[:whole]))):
                    text = [x.split(b"\0")[0].decode("utf-8", "replace") for x in (r[2], r[4], r[5])]
                    v4 = r[11] & 0xFFFFFFFF
                    address = ".".join(str(v4 >> s & 255) for s in (0, 8, 16, 24)) if v4 and not any(r[12:15]) else ""
                    kind = "SHUTDOWN" if r[0] == 1 and text[1] in ("shutdown", "runlevel") else TYPES.get(r[0], str(r[0]))
                    rows.append((path, n, kind, r[1], text[0], text[1], text[2], pd.Timestamp(r[9], unit="s") if r[9] > 0 else pd.NaT, address))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD_COLUMNS.split(", ")])

    return files.select("path", "content").mapInPandas(decode, RECORD_COLUMNS)
