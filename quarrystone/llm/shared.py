"""What the operators of this subpackage share: written intermediate tables, text slices."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of every word count in this subpackage.
WHITE = "\\x20\\x09-\\x0D"
#: The same characters as a literal, for trimming in SQL.
WHITE_CHARS = " \t\n\x0b\x0c\r"
#: Bytes of text that a Python worker turns into numpy arrays at once.
SLICE_BYTES = 1 << 21


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) gets a temporary folder; on a
    cluster that would be invisible to other machines, so it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quarrystone-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Folders of the scopes that are open, outermost first.
_open: list[str] = []


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, and no
    executor's loss takes the rows with it. Within ``scratch`` it is removed at the end of that."""
    return _written(df, "/".join([shared_dir(df.sparkSession), "quarrystone", *_open, f"{tag}-{uuid.uuid4().hex}"]))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this subpackage has written."""
    named = spark._jvm.org.apache.hadoop.fs.Path(path)
    named.getFileSystem(spark._jsc.hadoopConfiguration()).delete(named, True)


class scratch:  # noqa: N801
    """A scope whose written tables are removed at its end, but for the one given to it: ``with scratch(spark) as keep: df = keep(df, tag)``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.name, self.path = spark, f"scratch-{uuid.uuid4().hex}", ""

    def __call__(self, df: DataFrame, tag: str) -> DataFrame:
        self.path = "/".join([shared_dir(self.spark), "quarrystone", *_open[:-1], f"{tag}-{uuid.uuid4().hex}"])
        return _written(df, self.path)

    def __enter__(self) -> scratch:
        _open.append(self.name)
        return self

    def __exit__(self, *_: object) -> None:
        _open.remove(self.name)
        removed(self.spark, "/".join([shared_dir(self.spark), "quarrystone", *_open, self.name]))


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null and blank: empty."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{WHITE}]+"))


def word_count(text: Column) -> Column:
    """How many words a text has, without building them."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WHITE}]+")), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from all learning: crc32(doc_id as text) mod 4 is 2. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


@functools.cache
def punctuation() -> np.ndarray:
    """Which bytes are ASCII punctuation."""
    out = np.zeros(256, bool)
    for c in range(0x21, 0x7F):
        out[c] = not chr(c).isalnum()
    return out


def text_slices(texts: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``max_bytes`` of text; null: empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offs, offs[first] + max_bytes, "right")) - 1)
        yield first, end, raw[offs[first] : offs[end]], offs[first : end + 1] - offs[first]
        first = end
