"""Phrases of 2 to 4 words that stick together, counted by automata over what sketches let through.

Texts are split at PIECE_ENDS into pieces and these at spaces and tabs into
words; A-Z count as a-z. Everything is per language (null: ``und``).

1. Every partition counts its words and phrases in a count-min sketch, each in
   one counter. Only the counters in use travel, sorted and packed. Counts stop at
   LEAST, since only whether a sum reaches LEAST matters; summed, they bound each
   count from above, so what has a counter below LEAST is no candidate.
2. The counters that reach LEAST become a filter of bits. What it lets through
   are the candidates: all phrases with LEAST occurrences, all parts of these, for
   they occur as often, and some others.
3. Shards of about SHARD_BYTES of text of one language compile the candidates
   that they have into an automaton and stream their texts through it; all matches
   count, overlapping ones too. Counts are summed by phrase over the shards, and
   the thresholds apply to the sums.

Each step scans the texts once, at any size, and holds no more than a shard: a
shard's automaton has its own candidates only, so none grows with the corpus. A
word is as many letters to an automaton as the shard's vocabulary asks for, the
first of another range than the rest, so that no match begins or ends inside a
word. Candidates are told apart by 64-bit hashes; the automaton's matches must
add up to the candidates' places, and where they don't, two phrases share a hash
and all are told apart by their words.

A sketch has a counter for COUNTER_BYTES of text, in rounds of MOST_COUNTERS at
most, so that it never fills. What is broadcast is bounded: MOST_BITS bits; with
more candidates than they tell apart more is let through and counted, and nothing lost.

Null and empty texts have no words. Every row counts, repeated ones and those
with a null doc_id too; texts of any length are counted whole. An empty table
gives no rows. Only text and lang are read.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .shared import text_slices, written

LEAST = 30
LONGEST = 4
TOP = 2000
COVERED_PERCENT = 80
#: Score of a phrase whose parts only occur in it, times 2.
SCALE = 2_000_000

COUNTER_BYTES = 2
LEAST_COUNTERS, MOST_COUNTERS = 1 << 16, 1 << 26
#: Blocks of counters that travel together, and counters of the largest.
BLOCKS, MOST_BLOCK = 128, 1 << 24
#: Counters that a worker collects before it sorts them.
HELD_COUNTERS = 1 << 22
#: The filter of a sketch: bits for a counter that reaches LEAST, places looked at, bits in all.
FILTER_BITS, PROBES, LEAST_BITS, MOST_BITS = 16, 4, 1 << 16, 1 << 30
SHARD_BYTES = 2_000_000
#: Kinds of a letter in an automaton, where first letters begin, and what no key has.
LETTERS, FIRST_LETTER, NO_LETTER = 64, 128, 255
#: Parts of the phrases by hash, and phrases that a worker holds before it sums them.
PHRASE_PARTS, HELD_PHRASES = 64, 1 << 21

_ENDS = b".,;:!?\n\x0b\x0c\r"
_BREAKS = np.zeros(256, bool)
_BREAKS[list(b" \t" + _ENDS)] = True
_IS_END = np.zeros(256, bool)
_IS_END[list(_ENDS)] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32


def _packed(values: np.ndarray | bytes) -> bytes:
    """An array or text of bytes, compressed: what travels is mostly zeros or alike."""
    return _CODEC.compress(values if isinstance(values, bytes) else values.tobytes(), asbytes=True)


def _unpacked(raw: bytes, size: int) -> bytes:
    return _CODEC.decompress(raw, decompressed_size=size, asbytes=True)


_CODEC = pa.Codec("zstd", compression_level=1)


@functools.lru_cache(1 << 12)
def _lang_seed(lang: str) -> np.uint64:
    raw = np.frombuffer(lang.encode(), np.uint8)
    w = words.split(np.append(np.uint8(33), raw), np.array([0, len(raw) + 1]))
    return np.bitwise_xor.reduce(w.hashes * np.arange(1, 2 * len(w.hashes), 2, dtype=np.uint64))


class _Texts:
    """The words of texts, and the windows of k words that lie within a piece of one text."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray):
        self.raw = raw
        self.words = w = words.split(raw, offs, fold=True, breaks=_BREAKS)
        self.n = len(w.starts)
        piece = np.searchsorted(np.flatnonzero(_IS_END[raw]), w.starts)
        #: Whether a word is the last of its piece.
        self.last = np.ones(self.n, bool)
        if self.n:
            self.last[:-1] = piece[1:] != piece[:-1]
            starts = w.bounds[:-1]
            self.last[starts[starts > 0] - 1] = True

    def hashes(self, k: int, at: np.ndarray, seeds: np.ndarray | np.uint64) -> np.ndarray:
        """Hashes with language of the windows of k words that begin at words ``at``; seeds: for each window, or one."""
        return words.mix(words.windows(self.words.hashes, k)[at] ^ seeds)

    def spelled(self, which: np.ndarray) -> pa.DictionaryArray:
        """The words of a mask, folded, each with its number among the distinct ones."""
        lengths = self.words.ends - self.words.starts
        data = _FOLD[self.raw[~_BREAKS[self.raw]]]
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        said = pa.LargeBinaryArray.from_buffers(pa.large_binary(), self.n, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        return said.filter(pa.array(which)).dictionary_encode()


def _counter(hashes: np.ndarray, counters: int, rounds: int) -> np.ndarray:
    """The counter of each hash: a sketch of ``counters`` for each of ``rounds`` parts of the hashes."""
    at = hashes & np.uint64(counters - 1)
    return at if rounds == 1 else at + (hashes >> np.uint64(32)) % np.uint64(rounds) * np.uint64(counters)


def _block(counters: int, rounds: int) -> int:
    """Counters of a block."""
    return min(MOST_BLOCK, -(-counters * rounds // BLOCKS))


def _sketch(counters: int, rounds: int):
    """(block, n, at, counts): the counters in use of some of a partition's texts, by block: gaps between them, and counts."""
    size = np.uint64(_block(counters, rounds))

    def out(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        at = np.concatenate(held)
        at.sort()
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        counts = np.minimum(np.diff(np.append(first, len(at))), LEAST).astype(np.uint8)
        block, place = np.divmod(at[first], size)
        edges = np.concatenate(([0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            gaps = np.diff(place[a:b], prepend=np.uint64(0)).astype(np.uint32)
            planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T)
            yield pa.RecordBatch.from_arrays([pa.array([block[a]], pa.int32()), pa.array([b - a], pa.int64()), pa.array([_packed(planes)]), pa.array([_packed(counts[a:b])])], ["block", "n", "at", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for first, end, raw, offs in text_slices(batch.column(1)):
                texts = _Texts(raw, offs)
                seeds = np.repeat(np.array([_lang_seed(x) for x in langs[first:end]], np.uint64), texts.words.lengths())
                within = np.ones(texts.n, bool)
                for k in range(1, min(LONGEST, texts.n) + 1):
                    if k > 1:
                        within = within[:-1] & ~texts.last[k - 2 : -1]
                    at = np.flatnonzero(within)
                    held.append(_counter(texts.hashes(k, at, seeds[at]), counters, rounds))
                    n += len(at)
                if n >= HELD_COUNTERS:
                    yield from out(held)
                    held, n = [], 0
        if n:
            yield from out(held)

    return run


def _heavy(size: int):
    """(n, counters): the counters of a block of ``size`` that reach LEAST in all partitions together. The rows come by block; one block's counts are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        this, sums = -1, np.zeros(0, np.uint8)

        def out() -> Iterator[pa.RecordBatch]:
            found = np.flatnonzero(sums >= LEAST).astype(np.int64) + this * size
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array([len(found)], pa.int64()), pa.array([_packed(found)])], ["n", "counters"])

        for batch in batches:
            for block, n, at, counts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if block != this:
                    yield from out()
                    this, sums = block, np.zeros(size, np.uint8)
                gaps = np.ascontiguousarray(np.frombuffer(_unpacked(at, 4 * n), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
                places = np.cumsum(gaps, dtype=np.int64)
                sums[places] = np.minimum(sums[places] + np.frombuffer(_unpacked(counts, n), np.uint8), LEAST)  # each place once
        yield from out()

    return run


def _probe(counters: np.ndarray, i: int, bits: int) -> np.ndarray:
    """The i-th place in a filter of ``bits`` bits that stands for each counter."""
    return (words.mix(counters + np.uint64(i << 56)) & np.uint64(bits - 1)).astype(np.int64)


def sketched(texts: DataFrame, counters: int, rounds: int) -> np.ndarray:
    """The filter of the words and phrases that may have LEAST occurrences in texts (lang, text): MOST_BITS bits at most."""
    size = _block(counters, rounds)
    blocks = texts.mapInArrow(_sketch(counters, rounds), "block int, n long, at binary, counts binary").repartition("block").sortWithinPartitions("block")
    heavy = written(blocks.mapInArrow(_heavy(size), "n long, counters binary"), "heavy")
    n = heavy.agg(F.sum("n")).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (n * FILTER_BITS).bit_length()))
    out = np.zeros(bits // 8, np.uint8)
    for n, found in heavy.toLocalIterator():  # a block's at a time
        mine = np.frombuffer(_unpacked(bytes(found), 8 * n), np.uint64)
        for i in range(PROBES):
            at = _probe(mine, i, bits)
            np.bitwise_or.at(out, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    return out


def _let_through(hashes: np.ndarray, bits: np.ndarray, counters: int, rounds: int) -> np.ndarray:
    """Which hashes a filter lets through."""
    left, counter = np.arange(len(hashes)), _counter(hashes, counters, rounds)
    for i in range(PROBES):
        at = _probe(counter[left], i, 8 * len(bits))
        left = left[(bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
    out = np.zeros(len(hashes), bool)
    out[left] = True
    return out


class _Shard:
    """Texts of one language with the places of their candidates: for each k the words at which candidates of k words begin, and their hashes."""

    def __init__(self, texts: _Texts, lang: str, let_through):
        self.texts, seed = texts, _lang_seed(lang)
        self.places: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.plain = passed = np.zeros(texts.n, bool)
        for k in range(1, min(LONGEST, texts.n) + 1):
            if k == 1:
                at = np.arange(texts.n)
            else:  # both parts of a candidate less a word are candidates
                at = np.flatnonzero(passed[:-1] & passed[1:] & ~texts.last[:-1] if k == 2 else passed[:-1] & passed[1:])
            h = texts.hashes(k, at, seed)
            kept = let_through(h)
            passed = np.zeros(texts.n - k + 1, bool)
            passed[at[kept]] = True
            if k == 1:
                self.plain = passed
            self.places.append((k, at[kept], h[kept]))

    def counted(self) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """(phrases, hashes, counts) of the distinct candidates, from one automaton over all of them."""
        said = self.texts.spelled(self.plain)
        if not len(said):
            return
        number = np.zeros(self.texts.n, np.int64)
        number[self.plain] = said.indices.to_numpy()
        length = 1
        while LETTERS**length < len(said.dictionary):
            length += 1
        letters = np.full((self.texts.n, length + 1), NO_LETTER, np.uint8)
        for i in range(length):
            letters[:, i] = number // LETTERS ** (length - 1 - i) % LETTERS + (0 if i else FIRST_LETTER)
        shown = np.repeat(self.plain[:, None], length + 1, axis=1)
        shown[:, length] = self.texts.last | ~self.plain
        stream = letters[shown].tobytes().decode("latin-1")

        def spelled(k: int, at: np.ndarray) -> Iterator[str]:
            wide = k * length
            text = letters[at[:, None] + np.arange(k), :length].tobytes().decode("latin-1")
            return (text[i : i + wide] for i in range(0, len(text), wide))

        n = sum(len(at) for _, at, _ in self.places)
        by_hash = [(k, *self._first(at, h)) for k, at, h in self.places]
        counts = _matches((x for k, at, _ in by_hash for x in spelled(k, at)), stream)
        if counts.sum() != n:  # phrases that share a hash
            by_hash = []
            for k, at, h in self.places:
                first = np.fromiter({x: i for i, x in enumerate(spelled(k, at))}.values(), np.int64)
                by_hash.append((k, at[first], h[first]))
            counts = _matches((x for k, at, _ in by_hash for x in spelled(k, at)), stream)
        done = 0
        for k, at, h in by_hash:
            parts = [said.dictionary.take(pa.array(number[at + i])) for i in range(k)]
            yield (pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if k > 1 else parts[0]), h, counts[done : done + len(at)]
            done += len(at)

    @staticmethod
    def _first(at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, first = np.unique(h, return_index=True)
        return at[first], h


def _matches(keys: Iterator[str], stream: str) -> np.ndarray:
    """Occurrences of each key in ``stream``, overlapping ones too."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    n = 0
    for key in keys:
        automaton.add_word(key, n)
        n += 1
    automaton.make_automaton()
    return np.bincount(np.fromiter(map(operator.itemgetter(1), automaton.iter(stream)), np.int64), minlength=n)


def _by_language(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(lang, bytes, offsets) of shards of texts of one language."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        of = langs.indices.to_numpy()
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            for _, _, raw, offs in text_slices(batch.column(1).filter(pa.array(of == i)), shard_bytes):
                yield lang, raw, offs


def _counted(lang: str, raw: np.ndarray, offs: np.ndarray, let_through) -> tuple[int, pa.Array, np.ndarray, np.ndarray]:
    """How many words a shard has, its distinct candidates, their hashes and counts."""
    texts = _Texts(raw, offs)
    found = list(_Shard(texts, lang, let_through).counted())
    if not found:
        return texts.n, pa.array([], pa.large_binary()), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return texts.n, pa.concat_arrays([x for x, _, _ in found]), np.concatenate([h for _, h, _ in found]), np.concatenate([x for _, _, x in found])


def _count(sent, counters: int, rounds: int, shard_bytes: int, parts: int):
    """(part, lang, size, phrases, n, counts): a shard's candidates as lines, and how often each occurs there, by part of their hashes; part -1: all words."""

    def row(part: int, lang: str, phrases: bytes, counts: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array([part], pa.int32()), pa.array([lang], pa.string()), pa.array([len(phrases)], pa.int64()), pa.array([_packed(phrases)]), pa.array([len(counts)], pa.int64()), pa.array([_packed(counts.astype(np.int64))])]
        return pa.RecordBatch.from_arrays(columns, ["part", "lang", "size", "phrases", "n", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sent.value, np.uint8)
        for lang, raw, offs in _by_language(batches, shard_bytes):
            n, phrases, hashes, counts = _counted(lang, raw, offs, lambda h: _let_through(h, bits, counters, rounds))
            if n:
                yield row(-1, lang, b"", np.array([n]))
            part = (hashes % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            phrases, counts = phrases.take(pa.array(order)), counts[order]
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            for i in np.flatnonzero(np.diff(edges)).tolist():
                yield row(i, lang, b"\n".join(phrases[edges[i] : edges[i + 1]].to_pylist()), counts[edges[i] : edges[i + 1]])

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, f) of rows of ``_count`` that come by part; a null phrase has all words. One part's phrases are held."""
    this, held, n = None, [], 0

    def summed() -> pa.Table:
        return pa.concat_tables(held).group_by(["lang", "phrase"]).aggregate([("f", "sum")]).rename_columns(["lang", "phrase", "f"])

    for batch in batches:
        for part, lang, size, raw, many, counts in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if part != this and held:
                yield from summed().to_batches()
                held, n = [], 0
            this = part
            phrases = [None] if part < 0 else _unpacked(raw, size).split(b"\n")
            held.append(pa.table({"lang": pa.array([lang] * many, pa.string()), "phrase": pa.array(phrases, pa.binary()), "f": pa.array(np.frombuffer(_unpacked(counts, 8 * many), np.int64))}))
            n += many
            if n >= HELD_PHRASES:
                held = [summed()]
                n = 0
    if held:
        yield from summed().to_batches()


def counted(texts: DataFrame, counters: int, rounds: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, phrase, f): what a sketch of texts (lang, text) lets through, words too, and how often it occurs; a null phrase has the number of all words."""
    sent = texts.sparkSession.sparkContext.broadcast(sketched(texts, counters, rounds).tobytes())
    parts = max(PHRASE_PARTS, rounds)
    rows = texts.mapInArrow(_count(sent, counters, rounds, shard_bytes, parts), "part int, lang string, size long, phrases binary, n long, counts binary").repartition("part").sortWithinPartitions("part")
    return rows.mapInArrow(_sums, "lang string, phrase binary, f long").select("lang", F.col("phrase").cast("string").alias("phrase"), "f")


def sketched_candidates(texts: DataFrame, counters: int, rounds: int) -> DataFrame:
    """Distinct (lang, phrase) that may have LEAST occurrences in texts (lang, text), and all that have."""
    return counted(texts, counters, rounds).where(F.contains("phrase", F.lit(" "))).select("lang", "phrase")


def _whole(x: Column) -> Column:
    """A count as a decimal: products and sums of counts may pass 64 bits."""
    return x.cast("decimal(19,0)")


def _score(a: Column, parts: Column) -> Column:
    """floor(SCALE * a / parts), exact."""
    product = (_whole(a) * F.lit(SCALE).cast("decimal(7,0)")).cast("decimal(28,0)")
    return F.call_function("div", product, parts.cast("decimal(28,0)")).cast("long")


def collocations(docs: DataFrame, counters: int | None = None, rounds: int | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first TOP phrases by the score of their weakest cut.

    Candidates that a longer one holds in COVERED_PERCENT of their occurrences
    are dropped. ``counters`` and ``rounds`` follow the bytes of text if not given.
    """
    texts = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), docs["text"].cast("string").alias("text")).where("text IS NOT NULL")
    if counters is None or rounds is None:
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        counters = min(MOST_COUNTERS, max(LEAST_COUNTERS, 1 << max(0, size // COUNTER_BYTES - 1).bit_length()))
        rounds = -(-max(1, size) // (MOST_COUNTERS * COUNTER_BYTES))
    counts = written(counted(texts, counters, rounds, shard_bytes).where(F.col("f") >= F.when(F.col("phrase").isNull(), 0).otherwise(LEAST)), "counts")
    totals = counts.where("phrase IS NULL").select("lang", F.col("f").alias("n"))
    known = counts.where("phrase IS NOT NULL")
    split = F.split("phrase", " ")
    cand = known.where(F.col("f") >= LEAST).select("lang", "phrase", F.col("f").alias("a"), split.alias("w")).where(F.size("w") > 1)

    inside = cand.where(F.size("w") > 2).select("lang", "a", "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("m"))
    inside = inside.select("lang", "a", "m", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)).alias("at"))
    longer = inside.select("lang", F.array_join(F.slice("w", F.col("at"), F.col("m")), " ").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = cand.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (_whole(F.col("longer")) * 100 < _whole(F.col("a")) * COVERED_PERCENT)).drop("longer")

    cuts = left.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("rest"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    scored = cuts.select("lang", "phrase", "a", "l", "r", "k", _score(F.col("a"), _whole(F.col("l")) + _whole(F.col("r"))).alias("score"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    ranked = lowest.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))).where(F.col("rank") <= TOP)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


ORACLE_SQL = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
s AS (SELECT lang, w, k FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, phrase, k, count(*) AS f FROM (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM s) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
i AS (SELECT lang, a, array_to_string(w[o:o + m - 1], ' ') AS phrase FROM c, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS o) WHERE m < k AND o + m - 1 <= k),
b AS (SELECT lang, phrase, max(a) AS longer FROM i GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN b USING (lang, phrase) WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT),
cut AS (SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS p1, array_to_string(w[j + 1:], ' ') AS p2 FROM kept, (SELECT unnest([1, 2, 3]) AS j) WHERE j < k),
score AS (SELECT c.lang, c.phrase, c.a, j, x.f AS l, y.f AS r, (2000000 * a::HUGEINT) // (x.f::HUGEINT + y.f::HUGEINT) AS score FROM cut c JOIN f x ON x.lang = c.lang AND x.phrase = c.p1 JOIN f y ON y.lang = c.lang AND y.phrase = c.p2),
low AS (SELECT * FROM score QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM low JOIN n USING (lang) QUALIFY rank <= 2000
"""
