"""Benchmark decontamination by template windows.

Words lose ASCII punctuation; A-Z and the Latin-1 capitals are folded. Runs of numbers, of
capitalised words inside a sentence, and units after numbers become one typed placeholder each;
their own words are its slot. Each text has four templates (VARIANTS): the first; one in which
names stay words, for copies in which case means nothing; one in which capitalised
words that open a sentence are names too; and the words alone. A window is WINDOW
template words (all of a shorter item) with at least LEAST_PLAIN words that are no
placeholders; of the words alone, every window. Windows of documents
meet windows of benchmark items in a hash join; hits of one document and item
at one offset are an occurrence, and so are those at offsets that are at most SHIFT
apart, where words were put in or left out. It counts if it has COVERAGE of the item's
windows, and its slots are a renaming: equal item slots have equal
values. Where names stay words, names do not vouch for this, so different slots need different values
unless every window is there. So a question asked with other
numbers or names is found, and a text that merely has the same shape is not.

Only windows in the benchmark leave the scan of the documents: its window
hashes are broadcast in blocks of at most BLOCK, each with its own scan.
Items of one template and slot pattern are one class, shown by the smallest
item_id; for the words alone, items of the same words. Candidates come from the windows of a class that are rarest among
classes, as many as any occurrence must have one of; then all are counted.

Texts that share an item_id are items of their own, shown by it. Null and empty texts have no windows. An item with fewer
plain words than LEAST_PLAIN is matched by its own words only, and one with fewer words than that makes a document contaminated
only where it has a line to itself, since its words alone are common; in running text it is reported beside. Rows that share a doc_id are judged together;
a null doc_id is never contaminated. Only doc_id, text, item_id are read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .shared import punctuation, text_slices, written

WINDOW = 8
LEAST_PLAIN = 4
COVERAGE = 0.5
SHIFT = 4
BLOCK = 1 << 22
NUMBER, UNIT, NAME = 1, 2, 3
VARIANTS = 4
NAMELESS, LITERAL = 1, 3

# English number words and common units.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split()
UNITS = "mm cm m km inch inches foot feet ft yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres mg g kg gram grams kilogram kilograms ounce ounces pound pounds lb lbs ton tons ml l liter liters litre litres gallon gallons cup cups second seconds minute minutes hour hours day days week weeks month months year years percent degree degrees dollar dollars cent cents euro euros".split()

#: Written with a hyphen, which is punctuation: twentyfive.
NUMBER_WORDS += [tens + ones for tens in NUMBER_WORDS[20:28] for ones in NUMBER_WORDS[1:10]]

HIT = "doc_id long, hash long, pos long, slots array<string>, running boolean"
_U = np.uint64


def _hashes_of(values: list[str]) -> np.ndarray:
    raw = " ".join(values).encode()
    return np.sort(words.split(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), fold=True).hashes)


@functools.cache
def _sets() -> tuple[np.ndarray, np.ndarray]:
    return _hashes_of(NUMBER_WORDS), _hashes_of(UNITS)


@dataclass
class Template:
    """The template words of consecutive texts: kind (0: plain), hash, range of words, and the range of template words of each text."""

    kinds: np.ndarray
    hashes: np.ndarray
    firsts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def _template(w: words.Words, kinds: np.ndarray, opens: np.ndarray) -> Template:
    """Numbers in a row, and names in a row, are one template word; a row ends with the sentence."""
    again = np.zeros(len(kinds), bool)
    again[1:] = (kinds[1:] == kinds[:-1]) & ((kinds[1:] == NUMBER) | (kinds[1:] == NAME)) & ~opens[1:]
    firsts = np.flatnonzero(~again)
    of = kinds[firsts]
    return Template(of, np.where(of > 0, words.mix(of.astype(_U)), w.hashes[firsts]), firsts, np.append(firsts[1:], len(kinds)), np.searchsorted(firsts, w.bounds))


def canonical(raw: np.ndarray, offs: np.ndarray) -> tuple[words.Words, list[Template], np.ndarray, np.ndarray]:
    """Words, their template for each variant, the bytes that positions refer to, and which words begin a line."""
    keep = ~punctuation()[raw]
    kept = raw[keep]
    folded = kept.copy()  # capitals of the Latin-1 letters, which UTF-8 starts with C3
    folded[1:] += np.where((kept[:-1] == 0xC3) & (kept[1:] >= 0x80) & (kept[1:] <= 0x9E) & (kept[1:] != 0x97), 0x20, 0).astype(np.uint8)
    w = words.split(folded, np.concatenate(([0], np.cumsum(keep)))[offs], fold=True)
    n = len(w.hashes)
    if not n:
        return w, [_template(w, np.zeros(0, np.int8), np.zeros(0, bool))] * VARIANTS, kept, np.zeros(0, bool)
    at = np.flatnonzero(keep)
    digits = np.concatenate(([0], np.cumsum((kept >= 48) & (kept <= 57))))
    numbers, units = _sets()
    number = (digits[w.ends] - digits[w.starts] == w.ends - w.starts) | np.isin(w.hashes, numbers)
    lead, after = kept[w.starts], kept[np.minimum(w.starts + 1, len(kept) - 1)]
    upper = ((lead >= 65) & (lead <= 90)) | ((lead == 0xC3) & (after >= 0x80) & (after <= 0x9E))
    marks = np.concatenate(([0], np.cumsum(np.isin(np.arange(256), list(b".!?:\n"))[raw])))
    opens = np.ones(n, bool)
    opens[1:] = marks[at[w.starts[1:]]] > marks[at[w.ends[:-1] - 1]]
    opens[w.bounds[:-1][np.diff(w.bounds) > 0]] = True
    breaks = np.concatenate(([0], np.cumsum(raw == 10)))
    lines = opens.copy()
    lines[1:] &= breaks[at[w.starts[1:]]] > breaks[at[w.ends[:-1] - 1]]
    lines[w.bounds[:-1][np.diff(w.bounds) > 0]] = True
    unit = np.zeros(n, bool)
    unit[1:] = number[:-1] & np.isin(w.hashes[1:], units) & ~number[1:]
    unit[w.bounds[:-1][np.diff(w.bounds) > 0]] = False
    typed = np.where(number, NUMBER, np.where(unit, UNIT, 0)).astype(np.int8)
    named = np.where((typed == 0) & upper, NAME, typed).astype(np.int8)
    return w, [_template(w, k, opens) for k in (np.where(opens, typed, named), typed, named, np.zeros(n, np.int8))], kept, lines


def _windows(template: np.ndarray, k: int, variant: int) -> np.ndarray:
    return words.mix(words.windows(template, k) + _U(variant)).view(np.int64)


def _usable(kinds: np.ndarray, k: int, variant: int) -> np.ndarray:
    """Which windows of k template words count."""
    if len(kinds) < k:
        return np.zeros(0, bool)
    plain = np.concatenate(([0], np.cumsum(kinds == 0)))
    return (plain[k:] - plain[:-k] >= LEAST_PLAIN) | (variant == LITERAL)


def _whole_lines(lines: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Which windows of k words from ``starts`` are a line."""
    ends = np.append(lines, True)
    return lines[starts] & ends[starts + k] & (np.concatenate(([0], np.cumsum(lines)))[starts + k] - np.concatenate(([0], np.cumsum(lines)))[starts] == 1)


def _slots(w: words.Words, t: Template, kept: np.ndarray, a: int, b: int) -> list[str]:
    return [f"{t.kinds[i]}:{' '.join(kept[w.starts[t.firsts[i]] : w.ends[t.ends[i] - 1]].tobytes().decode('utf-8', 'replace').lower().split())}" for i in range(a, b) if t.kinds[i]]


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, text, named, shape, variant, at, hash, slots, words, n_windows) of benchmark items; text, named: digests of the
    words, and of templates and slot patterns; shape: of what makes the class, ``text`` for the words alone."""
    for batch in batches:
        rows = []
        for first, _, raw, offs in text_slices(batch.column(1)):
            w, variants, kept, _ = canonical(raw, offs)
            for d, (a, b) in enumerate(zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True)):
                if b == a:
                    continue
                ranges = [(int(t.bounds[d]), int(t.bounds[d + 1])) for t in variants]
                named = hashlib.sha256()
                for t, (start, end) in zip(variants[:LITERAL], ranges, strict=False):
                    slots = _slots(w, t, kept, start, end)
                    places = {s: n for n, s in enumerate(dict.fromkeys(slots))}
                    named.update(t.hashes[start:end].tobytes() + repr([places[s] for s in slots]).encode())
                text = hashlib.sha256(w.hashes[a:b].tobytes()).digest()
                for variant, (t, (start, end)) in enumerate(zip(variants, ranges, strict=True)):
                    k = min(WINDOW, end - start)
                    good = np.flatnonzero(_usable(t.kinds[start:end], k, variant)).tolist()
                    hashes = _windows(t.hashes[start:end], k, variant)
                    shape = text if variant == LITERAL else named.digest()
                    rows += [(batch.column(0)[first + d].as_py(), text, named.digest(), shape, variant, i, int(hashes[i]), _slots(w, t, kept, start + i, start + i + k), k, len(good)) for i in good]
        if rows:
            kinds_ = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds_, strict=True)], ["item_id", "text", "named", "shape", "variant", "at", "hash", "slots", "words", "n_windows"])


def item_windows(benchmark: DataFrame) -> DataFrame:
    """Windows of one item of each class of ``benchmark`` (item_id, text): shape, item_id, variant, at, hash, slots, words, n_windows.

    A class is its shape, since texts may share an item_id; item_id only shows it.
    """
    rows = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    found = written(rows.mapInArrow(_item_windows, "item_id long, text binary, named binary, shape binary, variant long, at long, hash long, slots array<string>, words long, n_windows long"), "items")
    first = found.groupBy("shape").agg(F.min(F.struct("item_id", "text", "named")).alias("first")).select("shape", F.col("first.text").alias("text"), F.col("first.named").alias("named"))
    shown = found.groupBy("named").agg(F.min("item_id").alias("item_id"))
    once = found.drop("item_id").join(first, ["shape", "text", "named"]).dropDuplicates(["shape", "variant", "at"])
    return once.join(shown, "named").drop("named", "text")


def _hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """HIT rows of all windows of documents that ``windows`` (hash, words) has."""
    lengths = sorted((r[0], r[1]) for r in windows.select("variant", "words").distinct().collect())
    total = windows.select("hash").distinct().count()
    blocks = max(1, -(-total // BLOCK))
    out = None
    for block in range(blocks):
        mine = windows.where(F.pmod("hash", F.lit(blocks)) == block).select("hash").distinct().toArrow()["hash"].to_numpy()
        shared = docs.sparkSession.sparkContext.broadcast(np.sort(mine))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches:
                for first, _, raw, offs in text_slices(batch.column(1)):
                    w, variants, kept, lines = canonical(raw, offs)
                    rows = []
                    for variant, k in lengths if len(known) else ():
                        t = variants[variant]
                        hashes = _windows(t.hashes, k, variant)
                        starts = words.inner(t.bounds, k)
                        own = hashes[starts]
                        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                        good = (known[at] == own) & _usable(t.kinds, k, variant)[starts]
                        running = ~_whole_lines(lines, starts, k) if k < LEAST_PLAIN else np.zeros(len(starts), bool)
                        for i, r in zip(starts[good].tolist(), running[good].tolist(), strict=True):
                            d = int(np.searchsorted(t.bounds, i, "right")) - 1
                            rows.append((batch.column(0)[first + d].as_py(), int(hashes[i]), i - int(t.bounds[d]), _slots(w, t, kept, i, i + k), r))
                    if rows:
                        kinds_ = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.bool_())
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds_, strict=True)], ["doc_id", "hash", "pos", "slots", "running"])

        part = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, HIT)
        out = part if out is None else out.unionByName(part)
    return out


def _renaming(pairs: Column, whole: Column) -> Column:
    """Whether pairs (item slot, document slot) give each item slot one value; unless ``whole``, different slots different ones."""
    n = F.size(F.array_distinct(pairs))
    return (n == F.size(F.array_distinct(F.transform(pairs, lambda p: p["a"])))) & (whole | (n == F.size(F.array_distinct(F.transform(pairs, lambda p: p["b"])))))


def occurrences(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, offset, n_found, n_windows, literal, running) of every occurrence of an item class in a document;
    literal: its slots have the item's own values; running: it has fewer than LEAST_PLAIN words and is not a line."""
    items = written(item_windows(benchmark), "windows")
    hits = written(_hits(docs, items), "hits")
    common = items.groupBy("hash").agg(F.countDistinct("shape").alias("items"))
    rank = F.row_number().over(Window.partitionBy("shape", "variant").orderBy("items", "at"))
    need = F.greatest(F.ceil(F.col("n_windows") * COVERAGE), F.lit(1))
    rare = items.join(common, "hash").withColumn("rank", rank).where(F.col("rank") <= F.col("n_windows") - need + 1).select("hash", "shape").distinct()
    candidates = hits.select("doc_id", "hash").distinct().join(rare, "hash").select("doc_id", "shape").distinct()
    own = items.select("shape", "item_id", "variant", "at", "hash", "n_windows", F.col("slots").alias("own"))
    met = candidates.join(own, "shape").join(hits, ["doc_id", "hash"])
    pairs = F.zip_with("own", "slots", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    keys = ["doc_id", "shape", "item_id", "variant", "n_windows"]
    single = met.groupBy(*keys, (F.col("pos") - F.col("at")).alias("offset")).agg(F.collect_set("at").alias("found"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"), F.bool_and("running").alias("running"))
    ordered = Window.partitionBy(*keys).orderBy("offset")
    far = F.coalesce(F.col("offset") - F.lag("offset").over(ordered) > SHIFT, F.lit(True)).cast("int")
    runs = single.withColumn("far", far).withColumn("run", F.sum("far").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    joined = runs.groupBy(*keys, "run").agg(F.min("offset").alias("offset"), F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"), F.bool_and("running").alias("running"), F.count("*").alias("n"))
    both = single.unionByName(joined.where("n > 1").drop("run", "n")).withColumn("n_found", F.size("found").cast("long"))
    whole = (F.col("variant") != NAMELESS) | (F.col("n_found") == F.col("n_windows"))
    kept = both.where(F.col("n_found") >= need).where(_renaming(F.col("pairs"), whole))
    literal = F.forall("pairs", lambda p: p["a"] == p["b"])
    return kept.select("doc_id", "item_id", "offset", "n_found", "n_windows", literal.alias("literal"), "running")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, reparameterised, n_items, items, short_items: one row for each row of ``docs``.

    ``short_items`` are the items of fewer than LEAST_PLAIN words that occur in running text only. They are common
    words more often than leaks, so they do not make a document contaminated; a caller who thinks otherwise has them here.
    """
    ids = lambda which: F.sort_array(F.collect_set(F.when(which, F.col("item_id"))))
    running = F.col("running")
    own = occurrences(docs, benchmark).groupBy("doc_id", "item_id").agg(F.bool_and("running").alias("running"), F.bool_or(F.col("literal") & ~running).alias("literal"))
    found = own.groupBy("doc_id").agg(ids(~running).alias("items"), ids(running).alias("short_items"), (~F.bool_or("literal")).alias("reparameterised"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(found, "doc_id", "left")
    return rows.select(
        "doc_id",
        F.coalesce(F.size("items") > 0, F.lit(False)).alias("contaminated"),
        F.coalesce((F.size("items") > 0) & F.col("reparameterised"), F.lit(False)).alias("reparameterised"),
        F.coalesce(F.size("items"), F.lit(0)).alias("n_items"),
        F.coalesce("items", F.array().cast("array<long>")).alias("items"),
        F.coalesce("short_items", F.array().cast("array<long>")).alias("short_items"),
    )
