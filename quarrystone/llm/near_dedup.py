"""MinHash near-duplicate removal with b-bit signatures.

1. One pass over the texts gives each document its exact shingle set's size
   and digest, the b lowest bits of each minimum (packed), and a key for each
   band of full minima.
2. Documents of equal sets are one class; its smallest doc_id stands for it.
3. Band buckets make candidate pairs: everyone with the bucket's leader
   first. Of buckets that the links found leave in several components, those
   of SMALL_BUCKET classes or fewer give all pairs across components. In a
   larger one, the classes outside its commonest component are held against
   all of it, in blocks of BLOCK classes or BLOCK_SHINGLES shingles, of which
   only links between components come out.
4. Everywhere a candidate goes on if its collision-corrected b-bit estimate is
   within MARGIN standard errors of the threshold, and is a link if the full
   sets say so. Blocks try the likeliest pairs first, and are done with pairs
   whose components a link has joined.
5. Links become components; the smallest doc_id of each stays.

Null, empty and blank texts have no shingles and are linked with nothing. A
null doc_id is kept, with a null component. Rows that share a doc_id are one
node. Columns other than doc_id and text are never read.
"""

from __future__ import annotations

import functools
import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .graph import components
from .shared import text_slices, written

SHINGLE_WORDS = 5
THRESHOLD_PERCENT = 75
PERMUTATIONS = 128
BITS = 2
#: Rows of a band; 32 bands of 4 miss a pair of similarity 0.75 five times in a million.
BAND_ROWS = 4
#: Standard errors below the threshold at which an estimate still counts as a candidate.
MARGIN = 5.0
#: Buckets of up to so many classes are compared in full, larger ones in blocks.
SMALL_BUCKET = 24
BLOCK = 256
BLOCK_SHINGLES = 1 << 20
_CHUNK = 1 << 13

SIGNATURE = "doc_id long, n_shingles long, set_id binary, bits array<long>, bands array<long>"
_U = np.uint64


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    return words.constants(PERMUTATIONS, 101) | _U(1), words.constants(PERMUTATIONS, 102)


def shingle_sets(raw: np.ndarray, offs: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; with fewer than SHINGLE_WORDS words, the whole sequence is one."""
    w = words.split(raw, offs, fold=True)
    grams = words.windows(w.hashes, SHINGLE_WORDS)
    for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
        if b - a >= SHINGLE_WORDS:
            yield np.unique(grams[a : b - SHINGLE_WORDS + 1])
        elif b > a:
            yield words.windows(w.hashes[a:b], b - a)
        else:
            yield np.zeros(0, _U)


def _minima(shingles: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    low = np.full(PERMUTATIONS, np.iinfo(_U).max, _U)
    for at in range(0, len(shingles), _CHUNK):
        part = np.multiply.outer(mul, shingles[at : at + _CHUNK])
        part += add[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return low


def _pack(minima: np.ndarray) -> np.ndarray:
    """The lowest BITS bits of the mixed minima, in 64-bit words, for many documents (rows)."""
    low = words.mix(minima) & _U((1 << BITS) - 1)
    per = 64 // BITS
    shifts = (np.arange(per, dtype=_U) * _U(BITS))[None, None, :]
    return np.bitwise_or.reduce(low.reshape(len(minima), -1, per) << shifts, axis=2).view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mul, add = _seeds()
    n_bands = PERMUTATIONS // BAND_ROWS
    band_mul, band_add = words.constants(BAND_ROWS, 103) | _U(1), words.constants(n_bands, 104)
    for batch in batches:
        ids = batch.column(0)
        for first, end, raw, offs in text_slices(batch.column(1)):
            sizes, digests, minima = [], [], np.zeros((end - first, PERMUTATIONS), _U)
            for i, s in enumerate(shingle_sets(raw, offs)):
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                minima[i] = _minima(s, mul, add) if len(s) else 0
            keys = (minima.reshape(len(sizes), n_bands, BAND_ROWS) * band_mul).sum(axis=2, dtype=_U)
            keys = words.mix(keys + band_add).view(np.int64)
            pack = _pack(minima)
            flat = lambda x: pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())
            yield pa.RecordBatch.from_arrays(
                [ids.slice(first, end - first), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), flat(pack), flat(keys)],
                ["doc_id", "n_shingles", "set_id", "bits", "bands"],
            )


def signatures(docs: DataFrame) -> DataFrame:
    """One SIGNATURE row for each document row."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_signatures, SIGNATURE)


def estimate(a: Column, b: Column) -> Column:
    """Jaccard similarity from packed signatures, corrected for b-bit values that agree by chance."""
    if BITS != 2:
        raise ValueError("the bit count below is for 2-bit values")
    differ = F.aggregate(
        F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)),
        F.lit(0),
        lambda n, x: n + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))),
    )
    chance = 1 / (1 << BITS)
    return (1 - differ / F.lit(float(PERMUTATIONS)) - chance) / (1 - chance)


def least_estimate() -> float:
    """An estimate below this is MARGIN standard errors under the threshold."""
    chance, j = 1 / (1 << BITS), THRESHOLD_PERCENT / 100
    p = j + (1 - j) * chance
    return j - MARGIN * math.sqrt(p * (1 - p) / PERMUTATIONS) / (1 - chance)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets have 100 * intersection >= THRESHOLD_PERCENT * union; sets are kept for texts seen lately."""
    kept: OrderedDict[int, np.ndarray] = OrderedDict()
    held = 0

    def full(texts: pa.Array) -> list[int]:
        nonlocal held
        keys: list[int] = []
        for _, _, raw, offs in text_slices(texts):
            cuts = offs.tolist()
            own = [xxhash.xxh3_128_intdigest(raw[x:y].data) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            new = [i for i, k in enumerate(own) if k not in kept]
            parts = [raw[cuts[i] : cuts[i + 1]] for i in new]
            ends = np.cumsum([0, *(len(x) for x in parts)])
            for i, s in zip(new, shingle_sets(np.concatenate([*parts, np.zeros(0, np.uint8)]), ends), strict=True):
                held += len(s) if own[i] not in kept else 0
                kept[own[i]] = s
            keys += own
        return keys

    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            good = []
            for x, y in zip(full(part.column(2)), full(part.column(3)), strict=True):
                both = len(np.intersect1d(kept[x], kept[y], assume_unique=True))
                good.append(100 * both >= THRESHOLD_PERCENT * (len(kept[x]) + len(kept[y]) - both))
            yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(good)), part.column(1).filter(pa.array(good))], ["a", "b"])
            while len(kept) > 1 and held > 1 << 21:
                held -= len(kept.popitem(last=False)[1])


def links(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of class ids that are links: estimated on ``classes`` (rep, bits), confirmed on ``texts`` (rep, text)."""
    x, y = (classes.select(F.col("rep").alias(k), F.col("bits").alias(f"bits_{k}")) for k in "ab")
    near = (
        pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
        .join(x, "a")
        .join(y, "b")
        .where(estimate(F.col("bits_a"), F.col("bits_b")) >= least_estimate())
        .select("a", "b")
    )
    near = written(near, "near")
    s, t = (texts.select(F.col("rep").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")
    return near.join(s, "a").join(t, "b").select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "a long, b long")


def _block_links(key: tuple, xs: pd.DataFrame, ys: pd.DataFrame) -> pd.DataFrame:
    """Links between two blocks of one bucket, as many as join their components: pairs that first collide in this
    bucket, by their estimates and then their full sets."""
    ys = ys.rename(columns=lambda c: c.removesuffix("_y"))
    (bx, by), (sx, sy) = ([np.array(d[c].tolist(), np.int64).reshape(len(d), -1) for d in (xs, ys)] for c in ("bands", "bits"))
    rx, ry = xs["root"].to_numpy(), ys["root"].to_numpy()
    first = np.full((len(xs), len(ys)), -1)
    for j in range(bx.shape[1] - 1, -1, -1):
        first[bx[:, j][:, None] == by[:, j][None, :]] = j
    here = (first >= 0) & (np.take_along_axis(bx, np.maximum(first, 0), 1) == key[0]) & (rx[:, None] != ry[None, :])
    differ = np.zeros(here.shape, np.int64)
    for j in range(sx.shape[1]):
        d = sx[:, j].view(_U)[:, None] ^ sy[:, j].view(_U)[None, :]
        differ += np.bitwise_count((d | d >> _U(1)) & _U(0x5555555555555555))
    chance = 1 / (1 << BITS)
    near = (1 - differ / PERMUTATIONS - chance) / (1 - chance)
    i, j = np.nonzero(here & (near >= least_estimate()))
    order = np.argsort(-near[i, j], kind="stable")

    @functools.cache
    def full(side: int, n: int) -> np.ndarray:
        raw = np.frombuffer((xs, ys)[side]["text"].iloc[n].encode(), np.uint8)
        return next(shingle_sets(raw, np.array([0, len(raw)])))

    above: dict[int, int] = {}

    def top(v: int) -> int:
        while v in above:
            v = above[v]
        return v

    found = []
    for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
        u, v = top(int(rx[x])), top(int(ry[y]))
        if u == v:
            continue
        p, q = full(0, x), full(1, y)
        both = len(np.intersect1d(p, q, assume_unique=True))
        if 100 * both >= THRESHOLD_PERCENT * (len(p) + len(q) - both):
            above[max(u, v)] = min(u, v)
            found.append((int(xs["rep"].iloc[x]), int(ys["rep"].iloc[y])))
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def _rooted(members: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (band, rep, n, n_shingles) with the root of each, in buckets that several roots share; (node, root) of all linked."""
    roots = components(found)
    own = members.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    apart = own.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band")
    return written(own.join(apart, "band"), "apart"), roots


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs`` (doc_id, text)."""
    signed = written(signatures(docs), "signatures")
    named = signed.where("doc_id IS NOT NULL AND set_id IS NOT NULL")
    classes = written(
        named.groupBy("set_id").agg(F.min_by(F.struct("doc_id", "n_shingles", "bits", "bands"), "doc_id").alias("m")).select("set_id", F.col("m.doc_id").alias("rep"), "m.n_shingles", "m.bits", "m.bands"),
        "classes",
    )
    banded = classes.select("rep", "n_shingles", F.explode("bands").alias("band")).distinct()
    shared = banded.groupBy("band").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).where("n > 1")
    members = written(banded.join(shared, "band"), "members")
    wanted = members.select("rep").distinct()
    bits = classes.join(wanted, "rep", "left_semi").select("rep", "bits")
    rows = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    texts = written(rows.where("text IS NOT NULL").join(wanted, "rep", "left_semi"), "texts")

    # Repeated rows of one doc_id with different sets: one node.
    sets = signed.where("doc_id IS NOT NULL").join(classes.select("set_id", "rep"), "set_id", "left").select("doc_id", "rep", "n_shingles")
    twice = sets.where("rep IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("a", "b")
    found = written(links(members.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")), bits, texts).unionByName(twice), "links")
    return _finish(signed, classes, members, bits, texts, found)


def _finish(signed: DataFrame, classes: DataFrame, members: DataFrame, bits: DataFrame, texts: DataFrame, found: DataFrame) -> DataFrame:
    apart, roots = _rooted(members.select("band", "rep", "n", "n_shingles"), found)
    x, y = (apart.where(F.col("n") <= SMALL_BUCKET).select("band", F.col("rep").alias(k), F.col("root").alias(f"root_{k}")) for k in "ab")
    pairs = x.join(y, "band").where("root_a <> root_b AND a < b").select("a", "b")
    more = links(pairs, bits, texts).unionByName(_in_blocks(apart.where(F.col("n") > SMALL_BUCKET), classes, texts))
    more = written(more, "links")
    if not more.isEmpty():
        roots = components(found.unionByName(more))
    by_set = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("set_id", F.coalesce("root", "rep").alias("root"))
    return (
        signed.select("doc_id", "n_shingles", "set_id")
        .join(by_set, "set_id", "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("root", "doc_id")))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )


def _in_blocks(large: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links of what leaders left apart in large buckets: the classes outside a bucket's
    commonest component against all its classes, in blocks."""
    main = large.groupBy("band", "root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    main = main.groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("of_y"), F.sum("s").alias("s_y"))
    out = large.join(main, "band").where("root <> main").groupBy("band").agg(F.count("*").alias("of_x"), F.sum("n_shingles").alias("s_x"))
    blocks = lambda k: F.greatest(F.ceil(F.col(f"of_{k}") / BLOCK), F.ceil(F.col(f"s_{k}") / BLOCK_SHINGLES)).cast("int")
    sized = main.join(out, "band").select("band", "main", blocks("x").alias("nx"), blocks("y").alias("ny"))
    own = large.select("band", "rep", "root").join(sized, "band")
    mine = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    full = classes.select("rep", "bits", "bands").join(texts, "rep")
    xs = own.where("root <> main").withColumn("xb", mine("nx")).withColumn("yb", every("ny")).select("band", "xb", "yb", "rep", "root").join(full, "rep")
    ys = own.withColumn("yb", mine("ny")).withColumn("xb", every("nx")).select("band", "xb", "yb", "rep", "root").join(full, "rep")
    keys = ["band", "xb", "yb"]
    ys = ys.select(*(F.col(c).alias(f"{c}_y") for c in ys.columns))
    return xs.groupBy(*keys).cogroup(ys.groupBy(*(f"{k}_y" for k in keys))).applyInPandas(_block_links, "a long, b long")
