"""Periodic runs of words: every lag is compared, stretches of equality are run-length coded.

A run is a stretch of consecutive words with smallest period q (words q apart
are the same) and at least max(LEAST_WORDS, REPEATS * q) words, which no
neighbouring word extends keeping period q.

The word-id array of a document is compared with itself at each shift from 1 to
n / REPEATS; a stretch of equal places at shift q is a stretch with period q.
The same stretch shows at multiples of its smallest period too (it is long
enough for the periods to divide each other), so of equal stretches the smallest
shift is kept.

Documents of up to SHORT_BYTES are compared where they are read, those of a
slice together: longest first in one array, so that a shift only touches the
documents that are long enough for it. A longer document's comparisons grow as
the square of its words; its shifts are dealt in ranges of about
RANGE_COMPARISONS to all machines, and the runs of the ranges meet again by
document.

Null, empty and blank texts have no words and no runs. Very long texts are
compared whole, repeated rows and rows with a null doc_id each on their own, an
empty table gives an empty one. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import text_slices, written

LEAST_WORDS = 6
REPEATS = 4
#: Longer texts are compared in ranges of shifts.
SHORT_BYTES = 1 << 18
RANGE_COMPARISONS = 1 << 31

RUN = "struct<start:long,length:long,period:long>"
FOUND = f"doc_id long, n_words long, runs array<{RUN}>, collapsed string"


def word_ids(texts: list[bytes]) -> list[np.ndarray]:
    """Ids of the words ``[^\\x20\\x09-\\x0D]+`` of each text; no id is used in two texts."""
    out, base = [], 0
    for text in texts:
        seen: dict[bytes, int] = {}
        out.append(np.array([seen.setdefault(w, base + len(seen)) for w in text.split()], np.int32))
        base += len(seen)
    return out


def _stretches(ids: np.ndarray, q: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the stretches of at least ``least`` places whose words q apart are the same."""
    equal = np.flatnonzero(ids[: len(ids) - q] == ids[q:])
    if len(equal) < least:
        return equal[:0], equal[:0]
    first = np.flatnonzero(np.concatenate(([True], np.diff(equal) != 1)))
    lengths = np.diff(np.append(first, len(equal)))
    long = lengths >= least
    return equal[first[long]], lengths[long]


def least_words(q: int) -> int:
    return max(LEAST_WORDS, REPEATS * q)


def scan(ids: np.ndarray, lo: int, hi: int, upto: np.ndarray | None = None) -> np.ndarray:
    """(start, length, period) rows of one array of ids at the shifts lo to hi, of equal stretches the smallest shift.

    ``upto[q - lo]``: how many of the first ids belong to documents that are long enough for shift q.
    """
    found = []
    for q in range(lo, hi + 1):
        n = len(ids) if upto is None else int(upto[q - lo])
        if n < least_words(q):
            break
        start, equal = _stretches(ids[:n], q, least_words(q) - q)
        if len(start):
            found.append(np.stack([start, equal + q, np.full(len(start), q)], axis=1))
    return smallest(np.concatenate(found)) if found else np.zeros((0, 3), np.int64)


def smallest(runs: np.ndarray) -> np.ndarray:
    """Of rows with the same start and length the one with the smallest period; by start, then period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[new]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _collapsed(text: bytes, runs: np.ndarray) -> bytes:
    """The words that are no repetition, joined by one space: of a run only the first period stays."""
    words = text.split()
    if not len(runs):
        return b" ".join(words)
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, runs[:, 0] + runs[:, 2], 1)
    np.add.at(covered, runs[:, 0] + runs[:, 1], -1)
    keep = np.flatnonzero(np.cumsum(covered)[:-1] == 0)
    return b" ".join([words[i] for i in keep.tolist()])


def _runs_array(runs: list[np.ndarray]) -> pa.ListArray:
    """Arrays of (start, length, period) rows as a list array of structs."""
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in runs])))
    flat = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
    parts = [pa.array(np.ascontiguousarray(flat[:, i]), pa.int64()) for i in range(3)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(parts, ["start", "length", "period"]))


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FOUND rows of rows (doc_id, text), all shifts of a slice's documents at once."""
    for batch in batches:
        for first, end, raw, offs in text_slices(batch.column(1)):
            texts = [raw[a:b].tobytes() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            ids = word_ids(texts)
            n = np.array([len(x) for x in ids], np.int64)
            order = np.argsort(-n, kind="stable")
            ends = np.cumsum(n[order])
            longest = int(n.max(initial=0)) // REPEATS
            least = np.maximum(LEAST_WORDS, REPEATS * np.arange(1, longest + 1))
            enough = np.searchsorted(-n[order], -least, "right")  # documents with at least so many words
            upto = np.concatenate(([0], ends))[enough]
            runs = scan(np.concatenate([ids[i] for i in order]), 1, longest, upto)
            starts = ends - n[order]
            of = np.searchsorted(ends, runs[:, 0], "right")
            runs[:, 0] -= starts[of]
            cuts = np.searchsorted(of, np.arange(len(order) + 1))
            each: list[np.ndarray] = [runs[:0]] * len(order)
            for place, i in enumerate(order.tolist()):
                each[i] = runs[cuts[place] : cuts[place + 1]]
            said = [_collapsed(t, r).decode("utf-8", "replace") for t, r in zip(texts, each, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, end - first), pa.array(n, pa.int64()), _runs_array(each), pa.array(said, pa.string())], ["doc_id", "n_words", "runs", "collapsed"]
            )


def _ranges(comparisons: int):
    """Rows (key, lo, hi, ids) of rows (key, text): ranges of shifts with about ``comparisons`` comparisons each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = word_ids([(text or "").encode("utf-8", "replace")])[0]
                if len(ids) < LEAST_WORDS:
                    continue
                step = max(1, comparisons // len(ids))
                lo = np.arange(1, max(1, len(ids) // REPEATS) + 1, step)
                hi = np.minimum(lo + step - 1, max(1, len(ids) // REPEATS))
                for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([a], pa.int64()), pa.array([b], pa.int64()), pa.array([ids.tobytes()], pa.binary())], ["key", "lo", "hi", "ids"])

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, start, length, period) of ranges (key, lo, hi, ids)."""
    for batch in batches:
        for row in range(batch.num_rows):
            key, lo, hi, ids = (batch.column(i)[row].as_py() for i in range(4))
            runs = scan(np.frombuffer(ids, np.int32), lo, hi)
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(runs), pa.string()), *(pa.array(np.ascontiguousarray(runs[:, i]), pa.int64()) for i in range(3))], ["key", "start", "length", "period"])


def _long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FOUND rows of rows (doc_id, text, runs)."""
    for batch in batches:
        for row in range(batch.num_rows):
            text = (batch.column(1)[row].as_py() or "").encode("utf-8", "replace")
            flat = batch.column(2).slice(row, 1).flatten()
            runs = np.stack([np.asarray(flat.field(i), np.int64) for i in range(3)], axis=1) if len(flat) else np.zeros((0, 3), np.int64)
            runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(row, 1), pa.array([len(text.split())], pa.int64()), _runs_array([runs]), pa.array([_collapsed(text, runs).decode("utf-8", "replace")], pa.string())], ["doc_id", "n_words", "runs", "collapsed"]
            )


def periodic_runs(docs: DataFrame, short_bytes: int = SHORT_BYTES, comparisons: int = RANGE_COMPARISONS) -> DataFrame:
    """doc_id, n_words, runs (by start, then period), collapsed (the words that repeat no run) of every row."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    short = rows.where(size <= short_bytes).mapInArrow(_short, FOUND)
    long = written(rows.where(size > short_bytes).withColumn("key", F.sha2("text", 256)), "long")
    texts = long.groupBy("key").agg(F.first("text").alias("text"))
    ranges = texts.mapInArrow(_ranges(comparisons), "key string, lo long, hi long, ids binary").repartition("key", "lo")
    runs = ranges.mapInArrow(_compare, "key string, start long, length long, period long").groupBy("key", "start", "length").agg(F.min("period").alias("period"))
    by_key = runs.groupBy("key").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    joined = long.join(by_key, "key", "left").select("doc_id", "text", F.coalesce("runs", F.array().cast(f"array<{RUN}>")).alias("runs"))
    return short.unionByName(joined.mapInArrow(_long, FOUND))


def wound(docs: DataFrame) -> DataFrame:
    """``docs`` with periodic tails: what the query plants. With h = crc32 of the decimal doc_id and g = h // 10,
    where h ends in 0 each word from a = g mod n on becomes word a + (i - a) mod p, p = 1 + (n - a) // (3 + g mod 8).

    Other texts, and those without words, stay as they are; so do rows with a null doc_id.
    """
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return own.mapInArrow(_wound, "doc_id long, text string")


def _wound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        hashes = [zlib.crc32(str(i).encode()) if i is not None else 1 for i in ids]
        turned = [row for row, h in enumerate(hashes) if h % 10 == 0]
        if turned:
            said = batch.column(1).take(pa.array(turned)).to_pylist()
            texts = pa.array([_turned(t, hashes[row] // 10) for row, t in zip(turned, said, strict=True)], pa.string())
            source = np.arange(len(ids))
            source[turned] = len(ids) + np.arange(len(turned))
            batch = pa.RecordBatch.from_arrays([batch.column(0), pa.concat_arrays([batch.column(1).cast(pa.string()), texts]).take(pa.array(source))], ["doc_id", "text"])
        yield batch


def _turned(text: str | None, g: int) -> str | None:
    words = (text or "").encode("utf-8", "replace").split()
    if not words:
        return text
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join([words[i] if i < a else words[a + (i - a) % p] for i in range(n)]).decode("utf-8", "replace")


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period), and hashes of all runs and of the collapsed words."""
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    own = found.select("doc_id", "runs", "collapsed", top.alias("top"))
    return own.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.period")).cast("long").alias("exponent_milli"),
        _sha(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")).alias("runs_sha256"),
        _sha(F.col("collapsed")).alias("collapsed_sha256"),
    )
