"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, everything that is not a letter becomes one space, and
the n-grams of N_GRAMS characters are hashed to BUCKETS. Spark sums the counts
per (language, bucket) over all training documents; the matrix of log
probabilities, languages by buckets, is broadcast. Its size is bounded by
MAX_LANGUAGES * BUCKETS floats; more languages are an error. Languages have
the same prior: what a corpus has most of says little about one more text.

A null text and one without letters are ``und`` with score 0; so is everything
if nothing can be learned. Rows with a null lang teach nothing. Only doc_id,
text and, for learning, lang are read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import held_out, text_slices

N_GRAMS = (1, 2, 3)
BUCKETS = 1 << 16
MAX_LANGUAGES = 256
SMOOTHING = 0.5
#: A text counts as at most so many independent n-grams when its score is made.
EVIDENCE = 60.0
UNKNOWN = "und"
_U = np.uint64


@functools.cache
def _letters() -> np.ndarray:
    """Each code point's lower case if it is a letter, else a space."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x323B0):
        x = chr(c)
        if x.isalpha():
            out[c] = ord(x.lower()[0])
    return out


def grams(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, text by text, and the range of each text's."""
    codes = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    ends = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[offs]
    if ends[-1] != len(codes):  # not valid UTF-8: text by text
        parts = [np.frombuffer(raw[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(offs[:-1], offs[1:], strict=True)]
        codes = np.concatenate([*parts, np.zeros(0, np.uint32)])
        ends = np.cumsum([0, *map(len, parts)])
    c = _letters()[np.minimum(codes, 0x10FFFF)]
    blank = c == 32
    keep = np.ones(len(c), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    firsts = ends[:-1][ends[:-1] < len(c)]
    keep[firsts] = ~blank[firsts]
    bounds = np.concatenate(([0], np.cumsum(keep)))[ends]
    c = c[keep].astype(_U)
    sizes = np.diff(bounds)
    per = [np.maximum(sizes - n + 1, 0) for n in N_GRAMS]
    out_bounds = np.concatenate(([0], np.cumsum(sum(per))))
    out = np.empty(out_bounds[-1], np.int32)
    at = out_bounds[:-1].copy()
    mul = words.constants(max(N_GRAMS), 201) | _U(1)
    for n, count in zip(N_GRAMS, per, strict=True):
        h = np.full(max(len(c) - n + 1, 0), n, _U)
        for j in range(n):
            h += c[j : j + len(h)] * mul[j]
        h = words.mix(h) & _U(BUCKETS - 1)
        starts = words.inner(bounds, n)
        base = np.cumsum(count) - count
        out[np.repeat(at - base, count) + np.arange(len(starts))] = h[starts]
        at += count
    return out, out_bounds


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) of this task's documents."""
    sums: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(v[at])], ["lang", "bucket", "n"])
        sums.clear()

    for batch in batches:
        langs = batch.column(1).to_pylist()
        for first, end, raw, offs in text_slices(batch.column(0)):
            found, bounds = grams(raw, offs)
            own = np.array(langs[first:end], object)
            for lang in sorted(set(langs[first:end])):
                mine = np.repeat(own == lang, np.diff(bounds))
                if lang not in sums:
                    sums[lang] = np.zeros(BUCKETS, np.int64)
                sums[lang] += np.bincount(found[mine], minlength=BUCKETS)
            if len(sums) > 64:
                yield from flush()
    yield from flush()


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages by code point, and log probabilities (language, bucket), from ``docs`` (text, lang)."""
    taught = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = taught.select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(_count, "lang string, bucket int, n long")
    counts = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    languages = sorted(r[0] for r in docs.where("lang IS NOT NULL").select(F.col("lang").cast("string")).distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; the broadcast matrix has no room for them")
    rows = counts.toArrow()
    names = rows["lang"].combine_chunks().dictionary_encode() if rows.num_rows else pa.array([], pa.string()).dictionary_encode()
    own, buckets, n = names.indices.to_numpy(), rows["bucket"].to_numpy(), rows["n"].to_numpy()
    taught_in = names.dictionary.to_pylist()
    languages = [x for x in languages if x in set(taught_in)]
    table = np.full((BUCKETS, len(languages)), SMOOTHING)
    if languages:
        index = {x: i for i, x in enumerate(languages)}
        table[buckets, np.array([index[x] for x in taught_in])[own]] += n
        table = np.log(table / table.sum(axis=0))
    return languages, np.ascontiguousarray(table.T, np.float32)


def identify(docs: DataFrame, languages: list[str], table: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score: one row for each row of ``docs`` (doc_id, text)."""
    model = docs.sparkSession.sparkContext.broadcast((languages, table))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logs = model.value
        for batch in batches:
            for first, end, raw, offs in text_slices(batch.column(1)):
                found, bounds = grams(raw, offs)
                sums = np.zeros((end - first, max(1, len(names))))
                some = np.flatnonzero(np.diff(bounds) > 0) if names else np.zeros(0, np.int64)
                for k in range(len(names) if len(some) else 0):
                    sums[some, k] = np.add.reduceat(logs[k][found], bounds[some], dtype=np.float64)
                n = np.diff(bounds)
                best = sums.argmax(axis=1)
                scaled = (sums - sums.max(axis=1, keepdims=True)) * np.minimum(1, EVIDENCE / np.maximum(n, 1))[:, None]
                score = 1 / np.exp(scaled).sum(axis=1)
                known = np.zeros(end - first, bool)
                known[some] = True
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array([names[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]), pa.array(np.where(known, score, 0.0))],
                    ["doc_id", "lang_pred", "score"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(predict, "doc_id long, lang_pred string, score double")


def held_out_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, learned from the documents that are not held out."""
    languages, table = fit(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, languages, table).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
