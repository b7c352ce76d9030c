"""Document quality by n-gram perplexity, with bands for each language.

The base rules count words, symbols, repeated lines and repeated 3-word
windows. The method is a modified Kneser-Ney model of ORDER code points for
each language (null is one): letters in lower case, digits as 0, white space as
one space. Spark counts in how many documents of a language each n-gram is;
contexts, continuation counts, discounts and probabilities are grouped
aggregations and joins, so the model grows with the corpus and is in no one
task or machine. Every document that is judged is among those counted, so one
document is taken off each count: an n-gram that only the document itself has
is unseen, and junk cannot vouch for itself.

For scoring, the n-grams of most documents, at most HEAD of them, are broadcast
as a sorted hash array with an index of its first bits. The others' hashes
leave the scan with their document and meet the model in a join; where the line
is drawn makes no difference to a score.

A document is rejected if the logarithm of its perplexity is outside its
language's band about the median. A mean over n symbols strays by a spread over
sqrt(n), so the band is BAND robust standard deviations of (log perplexity -
median) * sqrt(n), divided by sqrt(n), and LEAST_BAND at least. A language of
few documents, N of them, knows its band poorly; it is wider by 1 + SMALL / N.

A null or empty text has no words, fails the base rules and has a null
perplexity, as has a text of fewer than ORDER symbols. Rows of repeated or null
doc_ids are documents of their own, equal rows too. Only doc_id, text and lang
are read.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .shared import text_slices, written

MIN_WORDS = 50
REPEAT_WINDOW = 3
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"

ORDER = 5
BAND = 5.0
LEAST_BAND = 0.05
SMALL = 20
#: Bands come from histograms with bins of these widths: of log perplexity, and of its scaled distance from the median.
BIN, AWAY_BIN = 0.001, 0.01
#: n-grams whose probabilities are broadcast.
HEAD = 1 << 21
#: One row for each language goes to every executor while there are at most so many.
BROADCAST_LANGUAGES = 100_000
#: n-grams that a task holds before it sends their counts on.
_HELD = 1 << 20
_INDEX_BITS = 22

STATS = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_grams long, known double, missing array<long>, row long"
_U = np.uint64


# ---- symbols and n-grams ----


@functools.cache
def _folds() -> np.ndarray:
    """Each code point's symbol."""
    out = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x323B0):
        x = chr(c)
        if x.isspace():
            out[c] = 32
        elif x.isdecimal():
            out[c] = 48
        elif len(low := x.lower()) == 1:
            out[c] = ord(low)
    return out


def symbols(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts, and the range of each text's."""
    codes = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    ends = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[offs]
    if ends[-1] != len(codes):  # not valid UTF-8: text by text
        parts = [np.frombuffer(raw[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(offs[:-1], offs[1:], strict=True)]
        codes = np.concatenate([*parts, np.zeros(0, np.uint32)])
        ends = np.cumsum([0, *map(len, parts)])
    c = _folds()[codes]
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    keep[ends[:-1][ends[:-1] < len(c)]] = True
    return c[keep], np.concatenate(([0], np.cumsum(keep)))[ends]


def seed(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode())


def gram_keys(codes: np.ndarray, bounds: np.ndarray, langs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the n-grams within one text each, the text of each, and its hash with the text's language."""
    starts = words.inner(bounds, ORDER)
    owner = np.repeat(np.arange(len(langs)), words.window_counts(bounds, ORDER))
    mul = words.constants(ORDER, 301) | _U(1)
    h = np.zeros(max(len(codes) - ORDER + 1, 0), _U)
    for j in range(ORDER):
        h += codes[j : j + len(h)].astype(_U) * mul[j]
    seeds = np.array([seed(x) for x in langs], _U)
    return starts, owner, words.mix(h[starts] + seeds[owner])


# ---- counting ----


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, key, n): in how many of this task's documents (text, lang) each n-gram is."""
    parts: list[tuple[np.ndarray, ...]] = []
    names: dict[str, int] = {}

    def merged() -> tuple[np.ndarray, ...]:
        key, lang, grams, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        u, first, at = np.unique(key, return_index=True, return_inverse=True)
        return u, lang[first], grams[first], np.bincount(at, n, len(u)).astype(np.int64)

    def flush() -> pa.RecordBatch:
        key, lang, grams, n = merged()
        parts.clear()
        text = grams.astype("<u4").tobytes().decode("utf-32-le", "replace")
        order = list(names)
        return pa.RecordBatch.from_arrays(
            [pa.array([order[i] for i in lang.tolist()], pa.string()), pa.array([text[i : i + ORDER] for i in range(0, len(text), ORDER)], pa.string()), pa.array(key.view(np.int64)), pa.array(n)],
            ["lang", "gram", "key", "n"],
        )

    for batch in batches:
        langs = batch.column(1).to_pylist()
        for first, end, raw, offs in text_slices(batch.column(0)):
            codes, bounds = symbols(raw, offs)
            starts, owner, key = gram_keys(codes, bounds, langs[first:end])
            if not len(starts):
                continue
            once = np.unique(words.mix(key + (owner.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15)), return_index=True)[1]  # each n-gram once a document
            u, at, n = np.unique(key[once], return_index=True, return_counts=True)
            at = once[at]
            own = np.array([names.setdefault(x, len(names)) for x in langs[first:end]])
            parts.append((u, own[owner[at]], codes[starts[at][:, None] + np.arange(ORDER)], n))
        if len(parts) > 16:
            parts = [merged()]
            if len(parts[0][0]) > _HELD:
                yield flush()
    if parts:
        yield flush()


def counted(docs: DataFrame) -> DataFrame:
    """(lang, gram, key, n): in how many documents of ``docs`` (text, lang) each n-gram is, but for one."""
    found = docs.where(F.col("text").isNotNull()).select("text", "lang").mapInArrow(_count, "lang string, gram string, key long, n long")
    return found.groupBy("lang", "gram").agg(F.first("key").alias("key"), (F.sum("n") - 1).alias("n"))


# ---- the model ----


def _by_language(df: DataFrame, each: DataFrame) -> DataFrame:
    """``df`` with the columns of ``each`` (one row for each lang), which is broadcast while it is small."""
    return df.join(F.broadcast(each) if each.count() <= BROADCAST_LANGUAGES else each, "lang", "left")


def _level(grams: DataFrame, lower: DataFrame, order: int) -> DataFrame:
    """(lang, gram, p) of ``grams`` (lang, gram, n) of ``order`` symbols; ``lower`` has p of those of one symbol fewer,
    or, for single symbols, of the language's empty n-gram."""
    grams = grams.withColumn("context", F.substring("gram", 1, order - 1)).withColumn("suffix", F.substring("gram", 2, order - 1))
    at = lambda k: F.greatest(F.count_if(F.col("n") == k), F.lit(1))
    counts = grams.groupBy("lang").agg(*(at(k).alias(f"n{k}") for k in (1, 2, 3, 4)))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    d = [(k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"), 0.05 * k, 0.95 * k) for k in (1, 2, 3)]
    discounts = written(counts.select("lang", *(F.greatest(F.least(x, F.lit(hi)), F.lit(lo)).alias(f"d{k + 1}") for k, (x, lo, hi) in enumerate(d))), "discounts")
    contexts = grams.groupBy("lang", "context").agg(F.sum("n").alias("total"), *(F.count_if(test).alias(f"c{k}") for k, test in ((1, F.col("n") == 1), (2, F.col("n") == 2), (3, F.col("n") >= 3))))
    contexts = _by_language(contexts, discounts)
    mass = F.when(F.col("total") > 0, sum(F.col(f"c{k}") * F.col(f"d{k}") for k in (1, 2, 3)) / F.col("total")).otherwise(1.0)
    contexts = contexts.select("lang", "context", "total", mass.alias("mass"), "d1", "d2", "d3")
    joined = grams.join(contexts, ["lang", "context"]).join(lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below")), ["lang", "suffix"])
    n = F.col("n")
    left = n - F.when(n == 0, 0.0).when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))
    return joined.withColumn("p", F.when(F.col("total") > 0, left / F.col("total")).otherwise(0.0) + F.col("mass") * F.col("below"))


def model(counts: DataFrame) -> DataFrame:
    """(key, n, log_p) of the n-grams of ``counts`` (lang, gram, key, n), by interpolated Kneser-Ney smoothing.

    n-grams with a count of 0 have the probability of what is unseen. Lower
    orders count how many symbols were seen before; the lowest is uniform over
    the symbols of the language and one more.
    """
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        up = levels[k + 1]
        levels[k] = written(up.groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count_if(F.col("n") > 0).alias("n")), f"level{k}")
    lower = levels[1].groupBy("lang").agg((1 / (F.count("*") + 1)).alias("p")).withColumn("gram", F.lit(""))
    for k in range(1, ORDER):
        lower = written(_level(levels[k], lower, k).select("lang", "gram", "p"), f"p{k}")
    return written(_level(counts, lower, ORDER).select("key", "n", F.log("p").cast("float").alias("log_p")), "model")


@dataclass
class Head:
    """Sorted n-gram hashes with log probabilities, and where each value of their first bits begins."""

    keys: np.ndarray
    log_p: np.ndarray

    def __post_init__(self) -> None:
        by = np.argsort(self.keys)
        self.keys, self.log_p = self.keys[by], self.log_p[by]
        self.index = np.searchsorted(self.keys >> _U(64 - _INDEX_BITS), np.arange((1 << _INDEX_BITS) + 1, dtype=_U)).astype(np.int32)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities of ``wanted``, 0 where absent, and which are absent."""
        out = np.zeros(len(wanted))
        bucket = (wanted >> _U(64 - _INDEX_BITS)).astype(np.int64)
        at, stop = self.index[bucket], self.index[bucket + 1]
        left = np.flatnonzero(at < stop)
        absent = np.ones(len(wanted), bool)
        at, stop = at[left], stop[left]
        while len(left):
            hit = self.keys[at] == wanted[left]
            out[left[hit]] = self.log_p[at[hit]]
            absent[left[hit]] = False
            at += 1
            more = ~hit & (at < stop)
            left, at, stop = left[more], at[more], stop[more]
        return out, absent


def head(table: DataFrame) -> Head:
    """The n-grams of most documents, at most HEAD of them: all with counts from a bound on."""
    level = F.floor(F.log2(F.col("n") + 1) * 8)
    sizes = table.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()  # at most 512
    least, room = None, HEAD
    for r in sizes:
        room -= r["count"]
        if room < 0:
            break
        least = r["level"]
    chosen = table.where(level >= least if least is not None else F.lit(False)).select("key", "log_p").toArrow()
    return Head(chosen["key"].to_numpy().view(_U), chosen["log_p"].to_numpy())


# ---- scoring ----


def base_counts(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    w = words.split(raw, offs)
    per = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[offs])
    blank = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
    chars = per(~blank[raw] & ((raw & 0xC0) != 0x80))
    symbols = per(np.isin(np.arange(256), list(SYMBOLS))[raw])
    dup = []
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        lines = [x for x in raw[a:b].tobytes().split(b"\n") if x and not x.isspace()]
        dup.append(len(lines) - len(set(lines)))
    starts = words.inner(w.bounds, REPEAT_WINDOW)
    owner = np.searchsorted(w.bounds, starts, "right") - 1
    keys = words.mix(words.windows(w.hashes, REPEAT_WINDOW)[starts] + owner.astype(_U) * _U(0x9E3779B97F4A7C15))
    by = np.argsort(keys)
    same = np.zeros(len(keys), bool)
    equal = keys[by][1:] == keys[by][:-1]
    same[by[1:]] |= equal
    same[by[:-1]] |= equal
    covered = np.zeros(len(w.hashes) + 1, bool)
    for j in range(REPEAT_WINDOW):
        covered[starts[same] + j] = True
    repeated = np.diff(np.concatenate(([0], np.cumsum(covered)))[w.bounds])
    return w.lengths(), chars, symbols, np.array(dup), repeated


def statistics(docs: DataFrame, known: Head) -> DataFrame:
    """STATS of each row of ``docs`` (doc_id, text, lang): ``known`` is the sum of the log probabilities in the head,
    ``missing`` has the hashes of the other n-grams, ``row`` a number of the row's own."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        row = int.from_bytes(os.urandom(7)) << 7
        for batch in batches:
            langs = batch.column(2).to_pylist()
            for first, end, raw, offs in text_slices(batch.column(1)):
                codes, bounds = symbols(raw, offs)
                _, owner, key = gram_keys(codes, bounds, langs[first:end])
                log_p, absent = table.find(key)
                sums = np.bincount(owner, log_p, minlength=end - first)
                ends = np.concatenate(([0], np.cumsum(np.bincount(owner[absent], minlength=end - first)))).astype(np.int32)
                missing = pa.ListArray.from_arrays(ends, key[absent].view(np.int64))
                counts = words.window_counts(bounds, ORDER)
                rows = np.arange(row, row + end - first)
                row += end - first
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), batch.column(2).slice(first, end - first), *(pa.array(x, pa.int64()) for x in base_counts(raw, offs)), pa.array(counts, pa.int64()), pa.array(sums), missing, pa.array(rows, pa.int64())],
                    [x.split()[0] for x in STATS.split(", ")],
                )

    return docs.select("doc_id", "text", "lang").mapInArrow(score, STATS)


def scored(stats: DataFrame, table: DataFrame) -> DataFrame:
    """``stats`` with ``log_perplexity``, null without n-grams; what the head lacks is looked up in ``table``."""
    total = F.col("known")
    if not stats.where(F.size("missing") > 0).isEmpty():
        asked = stats.select("row", F.explode("missing").alias("key")).groupBy("row", "key").agg(F.count("*").alias("times"))
        found = asked.join(table.select("key", "log_p"), "key").groupBy("row").agg(F.sum(F.col("times") * F.col("log_p").cast("double")).alias("rest"))
        stats = stats.join(found, "row", "left")
        total = total + F.coalesce("rest", F.lit(0.0))
    return stats.withColumn("log_perplexity", F.when(F.col("n_grams") > 0, -total / F.col("n_grams"))).drop("missing", "row", "known", "rest")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def bands(stats: DataFrame) -> DataFrame:
    """(lang, middle, spread) of log perplexity, from the documents that pass the base rules.

    Quantiles come from a histogram, so no task holds a language's documents.
    """

    def median(df: DataFrame, value: str, name: str, width: float) -> DataFrame:
        bins = df.groupBy("lang", F.round(F.col(value) / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))
        w = Window.partitionBy("lang")
        upto = F.sum("n").over(w.orderBy("bin"))
        half = bins.withColumn("upto", upto).withColumn("all", F.sum("n").over(w)).where("2 * upto >= all")
        return half.groupBy("lang").agg((F.min("bin") * width).alias(name), F.max("all").alias("docs"))

    good = stats.where(~base_failed() & F.col("log_perplexity").isNotNull()).select("lang", "log_perplexity", "n_grams")
    middle = written(median(good, "log_perplexity", "middle", BIN), "middle")
    away = _by_language(good, middle).withColumn("away", F.least(F.abs(F.col("log_perplexity") - F.col("middle")) * F.sqrt("n_grams"), F.lit(1e4)))
    wider = 1 + SMALL / F.col("docs")
    return written(middle.join(median(away, "away", "mad", AWAY_BIN).drop("docs"), "lang").select("lang", "middle", wider.alias("wider"), (F.col("mad") * 1.4826 * BAND).alias("spread")), "bands")


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, log_perplexity, kept: one row for each row of ``docs`` (doc_id, text, lang)."""
    lang = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"))
    table = model(written(counted(named), "grams"))
    stats = written(scored(written(statistics(named, head(table)), "statistics"), table), "scored")
    width = F.greatest(F.col("spread") / F.sqrt(F.greatest("n_grams", F.lit(1))), F.lit(LEAST_BAND)) * F.col("wider")
    low, high = F.col("middle") - width, F.col("middle") + width
    inside = F.coalesce(F.col("log_perplexity").between(low, high), F.lit(True))
    return (
        _by_language(stats, bands(stats))
        .withColumn("base_failed", base_failed())
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "log_perplexity", low.alias("low"), high.alias("high"), (~F.col("base_failed") & inside).alias("kept"))
    )
