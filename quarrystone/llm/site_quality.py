"""Document quality with hierarchical empirical Bayes over hosts and paths.

A logistic classifier over FEATURES of the text, fitted on labelled documents,
gives each document its own evidence. Grouped sums turn the evidence into a
posterior for each host and, below it, each path: the mean evidence of a
group, shrunk toward the mean of the level above by a number of pseudo
documents that is estimated from how much the groups differ. Sparse sites stay
near the global mean, large ones are near their own. A document's log-odds are
its own plus what its path's posterior differs from the global mean, times
SITE_WEIGHT; below ACCEPT_FROM it is rejected.

Sums are partial before they shuffle, so a site with a third of all documents
costs what a small one does. The classifier sees at most FIT_ROWS labelled
documents of each class, those with the smallest hash of doc_id; each counts
for all labels of its class, so scores mean the same at every size.

A null or empty text has the features of no words. Null hosts or paths are a
group of their own. Labels that are null teach nothing; of repeated labels the
lowest counts. Without labels of both classes everything is accepted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_lm import base_counts
from .shared import text_slices, written
from .toxicity import bounded, logistic

FIT_ROWS = 10_000
SITE_WEIGHT = 0.5
ACCEPT_FROM = 0.5
#: Pseudo documents of a group are kept between these.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1e4
FEATURES = ("log_words", "few_words", "word_length", "symbols", "exclamations", "bars", "capitals", "digits", "dup_lines", "repeats", "other_punctuation", "no_words")


def features(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """FEATURES of each text, as rows."""
    n, chars, symbols, dup, repeats = (x.astype(float) for x in base_counts(raw, offs))
    table = np.zeros((5, 256), bool)
    for i, of in enumerate((b"!", b"|", bytes(range(65, 91)), b"0123456789", b"#*$%&<>@^~=_{}[]\\/+")):
        table[i, list(of)] = True
    bang, bar, upper, digit, odd = (np.diff(np.concatenate(([0], np.cumsum(t[raw])))[offs]) for t in table)
    words, letters = np.maximum(n, 1), np.maximum(chars, 1)
    lines = np.diff(np.concatenate(([0], np.cumsum(raw == 10)))[offs]) + 1
    share = lambda x, y: np.minimum(x / y, 3.0)
    return np.column_stack([np.log1p(n), n < 50, chars / words / 10, share(symbols, words), share(bang, words), share(bar, words), share(upper, letters), share(digit, letters), share(dup, lines), share(repeats, words), share(odd, words), n == 0])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, raw, offs in text_slices(batch.column(1)):
            f = features(raw, offs)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), *(pa.array(f[:, i], pa.float64()) for i in range(f.shape[1]))], ["label", *FEATURES])


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Means and deviations of the features, and weights (intercept last), from ``labels`` (doc_id, quality)."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("label"))
    few, each = bounded(own, "label", FIT_ROWS)
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(few), "doc_id")
    schema = ", ".join(["label long", *(f"{f} double" for f in FEATURES)])
    rows = np.array(joined.select(F.col("label").cast("long"), "text").mapInArrow(_featured, schema).toPandas(), float).reshape(-1, len(FEATURES) + 1)
    if len(set(rows[:, 0])) < 2:
        return None
    counts = np.where(rows[:, 0] == 1, each[1], each[0])
    mean = np.average(rows[:, 1:], axis=0, weights=counts)
    deviation = np.maximum(np.sqrt(np.average((rows[:, 1:] - mean) ** 2, axis=0, weights=counts)), 1e-6)
    return mean, deviation, logistic((rows[:, 1:] - mean) / deviation, rows[:, 0], ridge=1.0, each=each)


def _scored(docs: DataFrame, host: Column, path: Column, model: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> DataFrame:
    """doc_id, host, path, own: each document's own log-odds of being good."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for first, end, raw, offs in text_slices(batch.column(3)):
                if known is None:
                    own = np.full(end - first, 5.0)
                else:
                    mean, deviation, w = known
                    own = np.clip((features(raw, offs) - mean) / deviation, -8, 8) @ w[:-1] + w[-1]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, end - first) for i in range(3)), pa.array(np.clip(own, -12, 12))], ["doc_id", "host", "path", "own"])

    cols = [F.col("doc_id").cast("long"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col("text").cast("string")]
    return docs.select(*cols).mapInArrow(score, "doc_id long, host string, path string, own double")


def _strength(groups: DataFrame, mean: Column) -> float:
    """Pseudo documents by the method of moments: groups (n, s) of a common Beta law have variance m(1-m)(1/n + ...) about ``mean``.

    With k pseudo documents, a group's mean strays from its parent's by
    m(1-m)(1/(k+1) + (1/n)(k/(k+1))) on average.
    """
    m = mean
    spread = m * (1 - m)
    r = groups.where("n >= 2").agg(
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - m, 2)), F.sum(F.col("n") * spread), F.sum(spread)
    ).first()
    if not r[0] or not r[1]:
        return MOST_STRENGTH
    ratio = r[0] / r[1]  # about 1/(k+1) + (groups per document) * k/(k+1)
    each = r[2] / r[1]
    rho = (ratio - each) / max(1 - each, 1e-9)
    return float(min(max(1 / rho - 1, LEAST_STRENGTH), MOST_STRENGTH)) if rho > 0 else MOST_STRENGTH


def posteriors(scored: DataFrame) -> tuple[float, DataFrame]:
    """The global mean, and (host, path, host_n, path_n, host_mean, path_mean) of all paths, from ``scored`` (host, path, own)."""
    p = 1 / (1 + F.exp(-F.col("own")))
    paths = written(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("s")), "paths")
    total = paths.agg(F.sum("n"), F.sum("s")).first()
    mean = min(max((total[1] or 0.5) / (total[0] or 1), 1e-6), 1 - 1e-6)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    k = _strength(hosts, F.lit(mean))
    hosts = hosts.select(F.col("host").alias("h"), F.col("n").alias("host_n"), ((F.col("s") + k * mean) / (F.col("n") + k)).alias("host_mean"))
    under = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    k = _strength(under, F.col("host_mean"))
    path_mean = (F.col("s") + k * F.col("host_mean")) / (F.col("n") + k)
    return mean, under.select("host", "path", "host_n", F.col("n").alias("path_n"), "host_mean", path_mean.alias("path_mean"))


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None) -> DataFrame:
    """doc_id, host, path, own, host_mean, path_mean, score, kept: one row for each row of ``docs``.

    ``docs`` has doc_id, text and what ``host`` and ``path`` read: by default
    the source is the host and its language the path below it.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    scored = written(_scored(docs, host, path, fit(docs, labels)), "scored")
    mean, sites = posteriors(scored)
    logit = lambda x: F.log(x / (1 - x))
    clip = lambda c: F.least(F.greatest(F.col(c), F.lit(1e-9)), F.lit(1 - 1e-9))
    d, s = scored.alias("d"), sites.alias("s")
    joined = d.join(s, F.col("d.host").eqNullSafe(F.col("s.host")) & F.col("d.path").eqNullSafe(F.col("s.path")))
    total = F.col("own") + SITE_WEIGHT * (logit(clip("path_mean")) - float(np.log(mean / (1 - mean))))
    score = 1 / (1 + F.exp(-total))
    return joined.select("doc_id", F.col("d.host").alias("host"), F.col("d.path").alias("path"), "own", "host_mean", "path_mean", score.alias("score"), (score >= ACCEPT_FROM).alias("kept"))
