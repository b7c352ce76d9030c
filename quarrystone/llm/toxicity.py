"""Toxicity by maximum-scoring segments of token log-odds.

Tokens are words with ASCII punctuation removed and A-Z folded. Their log-odds
between toxic and other labelled documents have a Dirichlet prior, the words'
shares in both together. A lexicon keeps every token whose log-odds are far from
zero on either side; any other token scores the (slightly negative) log-odds of being none of
them. Scores are log likelihood ratios, so a random text's expected score is
below zero and the scale of the extreme-value law is 1.

Every text is scanned once, in linear time, for all its maximal scoring
segments. A segment of score s among n tokens has the expected number
K n exp(-s) by chance, K fitted on labelled documents that are not toxic. A
document's evidence is its best segment's, and all significant segments',
calibrated to a probability by a logistic fit.

Learning uses at most FIT_ROWS labelled documents of each class, those with
the smallest hash of doc_id. In the lexicon's prior and the calibration each
counts for all labels of its class, so scores mean the same at every size. The lexicon is
broadcast as sorted arrays: it has no more entries than those documents have tokens. A null or empty text has no tokens and gets the score
of no evidence. Labels that are null teach nothing; of repeated labels the
highest counts. Only doc_id and text are read of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import held_out, punctuation, text_slices, written

FIT_ROWS = 8_000
#: The weight of the prior, as a share of the toxic class's tokens.
PRIOR_SHARE = 0.2
#: Tokens need so many documents (toxic ones, to speak for toxicity) and so many standard errors to be in the lexicon.
LEAST_DOCUMENTS = 3
LEAST_Z = 2.5
LEAST_LOG_ODDS = 1.0
MAX_LOG_ODDS = 6.0
#: Expected number by chance below which a segment is significant.
SIGNIFICANT = 0.05
TOXIC_FROM = 0.3
_U = np.uint64


def tokens(raw: np.ndarray, offs: np.ndarray) -> words.Words:
    """Tokens of texts; byte positions are those of the texts without punctuation."""
    keep = ~punctuation()[raw]
    return words.split(raw[keep], np.concatenate(([0], np.cumsum(keep)))[offs], fold=True)


@dataclass
class Lexicon:
    """Sorted token hashes with their scores; ``other`` is the score of any other token, ``k`` the extreme-value constant."""

    hashes: np.ndarray
    scores: np.ndarray
    other: float
    k: float = 1.0

    def score(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), self.other)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.scores[at], self.other)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in linear time.

    A run of tokens of one sign is one step of the scan, so its cost follows
    the number of positive runs. Candidates are kept with the cumulative score
    before and after them; a new one is merged into an earlier one over which
    the total still rises.
    """
    up = scores > 0
    turns = np.flatnonzero(np.diff(np.concatenate(([False], up, [False])).astype(np.int8)))
    if not len(turns):
        return []
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    held: list[tuple[int, int, float, float]] = []
    back: list[int] = []  # for each candidate, the nearest earlier one that starts lower
    for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
        start, end, low, high = a, b, float(sums[a]), float(sums[b])
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= low:
                j = back[j]
            if j < 0 or held[j][3] >= high:
                held.append((start, end, low, high))
                back.append(j)
                break
            start, low = held[j][0], held[j][2]
            del held[j:], back[j:]
    return [(s, e, h - lo) for s, e, lo, h in held]


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, toxic, clean, toxic_docs, clean_docs) of this task's labelled documents: occurrences and documents by class."""
    parts: list[tuple[np.ndarray, ...]] = []

    def merged() -> tuple[np.ndarray, ...]:
        h = np.concatenate([p[0] for p in parts])
        u, at = np.unique(h, return_inverse=True)
        return u, *(np.bincount(at, np.concatenate([p[i] for p in parts]), len(u)) for i in (1, 2, 3, 4))

    for batch in batches:
        toxic = np.array(batch.column(1).to_pylist(), np.int64)
        for first, end, raw, offs in text_slices(batch.column(0)):
            w = tokens(raw, offs)
            owner = w.text_of()
            bad = toxic[first:end][owner] == 1
            u, at = np.unique(w.hashes, return_inverse=True)
            documents = [np.bincount(np.unique(at[m] * np.int64(end - first) + owner[m]) // (end - first), minlength=len(u)) for m in (bad, ~bad)]
            parts.append((u, np.bincount(at[bad], minlength=len(u)), np.bincount(at[~bad], minlength=len(u)), *documents))
        if len(parts) > 16:
            parts = [merged()]
    if parts:
        u, *n = merged()
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), *(pa.array(x.astype(np.int64)) for x in n)], ["token", "toxic", "clean", "toxic_docs", "clean_docs"])


def fit_lexicon(labelled: DataFrame, each: tuple[float, float] = (1.0, 1.0)) -> Lexicon:
    """The lexicon from (text, toxic); ``each``: how many documents one of class 0 and 1 stands for."""
    tallies = labelled.select("text", "toxic").mapInArrow(_tallies, "token long, toxic long, clean long, toxic_docs long, clean_docs long")
    tallies = written(tallies.groupBy("token").agg(*(F.sum(c).alias(c) for c in ("toxic", "clean", "toxic_docs", "clean_docs"))), "tallies")
    n1, n0 = (x or 0 for x in tallies.agg(F.sum("toxic"), F.sum("clean")).first())
    if not n1 or not n0:
        return Lexicon(np.zeros(0, _U), np.zeros(0), -1.0)
    weight = PRIOR_SHARE * n1
    prior = F.lit(weight / (each[1] * n1 + each[0] * n0)) * (each[1] * F.col("toxic") + each[0] * F.col("clean"))
    y1, y0 = F.col("toxic") + prior, F.col("clean") + prior
    delta = F.log(y1 / (n1 + weight - y1)) - F.log(y0 / (n0 + weight - y0))
    z = delta / F.sqrt(1 / y1 + 1 / y0)
    enough = F.when(F.col("delta") > 0, F.col("toxic_docs")).otherwise(F.col("clean_docs")) >= LEAST_DOCUMENTS
    far = (F.abs("z") >= LEAST_Z) & (F.abs("delta") >= LEAST_LOG_ODDS)
    chosen = tallies.withColumn("delta", delta).withColumn("z", z).where(enough & far).select("token", "delta", "toxic", "clean").toArrow()
    hashes = chosen["token"].to_numpy().view(_U)
    rate = lambda c, n: (float(chosen[c].to_numpy().sum()) + 0.5) / (n + 1)
    other = min(float(np.log1p(-rate("toxic", n1)) - np.log1p(-rate("clean", n0))), -1e-4)
    by = np.argsort(hashes)
    return Lexicon(hashes[by], np.clip(chosen["delta"].to_numpy(), -MAX_LOG_ODDS, MAX_LOG_ODDS)[by], other)


EVIDENCE = "doc_id long, n_tokens long, n_segments long, best double, n_significant long, significant double"


def evidence(docs: DataFrame, lexicon: Lexicon, keep: tuple[str, ...] = ()) -> DataFrame:
    """EVIDENCE of each row of ``docs`` (doc_id, text), with the long columns ``keep`` passed through."""
    model = docs.sparkSession.sparkContext.broadcast(lexicon)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = model.value
        for batch in batches:
            for first, end, raw, offs in text_slices(batch.column(1)):
                w = tokens(raw, offs)
                scores = lex.score(w.hashes)
                positive = np.concatenate(([0], np.cumsum(scores > 0)))[w.bounds]
                rows = []
                for d, (a, b) in enumerate(zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True)):
                    found = [s for _, _, s in segments(scores[a:b])] if positive[d + 1] > positive[d] else []
                    real = [s for s in found if lex.k * (b - a) * np.exp(-s) <= SIGNIFICANT]
                    rows.append((b - a, len(found), max(found, default=0.0), len(real), sum(real)))
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)), *(batch.column(2 + i).slice(first, end - first) for i in range(len(keep)))],
                    [*(x.split()[0] for x in EVIDENCE.split(", ")), *keep],
                )

    cols = [F.col("doc_id").cast("long"), F.col("text").cast("string"), *(F.col(c).cast("long") for c in keep)]
    return docs.select(*cols).mapInArrow(scan, ", ".join([EVIDENCE, *(f"{c} long" for c in keep)]))


def _features() -> list:
    """What the calibration sees: minus log of the best segment's chance, and the significant segments' number and total."""
    return [F.col("chance"), F.log1p("n_significant"), F.log1p("significant")]


def _with_chance(found: DataFrame, k: float) -> DataFrame:
    expected = F.lit(k) * F.greatest(F.col("n_tokens"), F.lit(1)) * F.exp(-F.col("best"))
    p = -F.expm1(-expected)
    return found.withColumn("chance", F.when(F.col("n_segments") == 0, 0.0).otherwise(-F.log(F.greatest(p, F.lit(1e-12)))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50, each: tuple[float, float] = (1.0, 1.0)) -> np.ndarray:
    """Weights of a logistic regression with an intercept (last), by Newton's method; ``each``: what a row of class 0 and 1 counts."""
    c = np.where(y == 1, each[1], each[0])
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    keep = np.diag([ridge] * (len(w) - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + keep, x.T @ (c * (y - p)) - keep @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def bounded(own: DataFrame, label: str, most: int) -> tuple[DataFrame, tuple[float, float]]:
    """At most ``most`` rows of each class of ``own`` (doc_id, label), by hash of doc_id, and how many rows one of class 0 and 1 stands for."""
    counts = {r[0]: r[1] for r in own.groupBy(label).count().collect()}
    parts = [own.where(F.col(label) == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for k in (0, 1)]
    return parts[0].unionByName(parts[1]), tuple(max(counts.get(k, 0) / most, 1.0) for k in (0, 1))


def bounded_labels(labels: DataFrame, label: str) -> tuple[DataFrame, tuple[float, float]]:
    """``bounded`` (doc_id, label) of at most FIT_ROWS documents of each class that are not held out."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).alias(label))
    return bounded(own, label, FIT_ROWS)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the EVIDENCE: one row for each row of ``docs`` (doc_id, text); ``labels`` has doc_id, toxic."""
    chosen, each = bounded_labels(labels, "toxic")
    taught = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    taught = written(taught, "taught")
    lexicon = fit_lexicon(taught, each)
    seen = evidence(taught, lexicon, ("toxic",))
    clean = seen.where("toxic = 0").agg(F.sum("n_segments"), F.sum("n_tokens")).first()
    above = lexicon.scores[lexicon.scores > 0]
    least = float(above.min()) if len(above) else 1.0
    lexicon.k = max(float((clean[0] or 0) + 0.5) / float((clean[1] or 0) + 1) * np.exp(least), 1e-9)
    rows = np.array(_with_chance(evidence(taught, lexicon, ("toxic",)), lexicon.k).select(*_features(), "toxic").collect(), float).reshape(-1, 4)
    weights = logistic(rows[:, :-1], rows[:, -1], each=each) if len(set(rows[:, -1])) == 2 else np.array([1.0, 0.0, 0.0, -5.0])
    found = _with_chance(evidence(docs, lexicon), lexicon.k)
    logit = F.lit(float(weights[-1]))
    for w, f in zip(weights[:-1], _features(), strict=True):
        logit = logit + F.lit(float(w)) * f
    score = 1 / (1 + F.exp(-logit))
    return found.withColumn("score", score).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), "n_tokens", "n_segments", "best", "n_significant", "significant"
    )
