"""Removal of passages that repeat across documents, found by sharded Aho-Corasick automata.

A window is WINDOW consecutive words of one document; every word goes that a
window covers whose word sequence also starts in a document with a smaller
doc_id. All windows are judged on the input.

1. Documents with the same word sequence are one class. Only its smallest
   doc_id is searched; of the others all words go, given WINDOW words.
2. Each window elects the phrase of PHRASE words with the smallest hash in it.
   Equal windows elect equal phrases, and few are elected, so counting the
   elected phrases by their smallest and largest doc_id finds every phrase
   that could stand in a repeated window. Its words are taken from the document
   with the smallest doc_id.
3. Documents that elected such a phrase are dealt into shards of about
   SHARD_BYTES of text, and the words of all phrases of a shard's documents go
   there with them. Each shard compiles them into automata over words, of at
   most AUTOMATON_PHRASES each, and streams its documents through; the
   occurrences are what the automata report. No other document can have one, so
   together the shards are all documents, each read once, however many phrases
   there are. The windows that elected an occurrence are counted again by
   smallest doc_id, now whole, by a 64-bit hash of their words.
4. What remains is cut out of the texts.

Null and empty texts have no words. Rows with a null doc_id stay as they are
and remove nothing. Rows that share a doc_id never remove each other's words.
Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import text_slices, words_of, written

WINDOW = 50
#: Words of an elected phrase; a window elects one of WINDOW - PHRASE + 1.
PHRASE = 16

#: Bytes of text that a shard should have, and phrases of one automaton.
SHARD_BYTES = 1 << 21
AUTOMATON_PHRASES = 1 << 15

PROFILE = "doc_id long, n_words long, words_sha binary, phrases array<long>"
EDIT = "doc_id long, words_sha binary, n_removed long, kept_sha256 string, kept_text string"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _elected(w: words.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, the start of the phrase each elects, and all phrase hashes by start."""
    starts = words.inner(w.bounds, WINDOW)
    phrases = words.windows(w.hashes, PHRASE)
    if not len(starts):
        return starts, starts, phrases
    views = np.lib.stride_tricks.sliding_window_view(phrases, WINDOW - PHRASE + 1)
    chosen = np.empty(len(views), np.int64)
    for at in range(0, len(views), 1 << 16):
        chosen[at : at + (1 << 16)] = views[at : at + (1 << 16)].argmin(axis=1)
    return starts, starts + chosen[starts], phrases


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.ListArray:
    """Distinct values of each of n owners (ascending), as a list array."""
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    v, o = v[new], o[new]
    return pa.ListArray.from_arrays(np.searchsorted(o, np.arange(n + 1)).astype(np.int32), v.view(np.int64))


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, raw, offs in text_slices(batch.column(1)):
            w = words.split(raw, offs)
            starts, at, phrases = _elected(w)
            digests = [hashlib.sha256(b" ".join(raw[a:b].tobytes().split())).digest() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            owner = np.searchsorted(w.bounds, starts, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, end - first), pa.array(w.lengths(), pa.int64()), pa.array(digests, pa.binary()), _lists(phrases[at], owner, end - first)],
                ["doc_id", "n_words", "words_sha", "phrases"],
            )


def _phrase_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(phrase, words) of the wanted phrases of texts (text, wanted)."""
    for batch in batches:
        wanted = batch.column(1)
        for first, _, raw, offs in text_slices(batch.column(0)):
            w = words.split(raw, offs)
            phrases = words.windows(w.hashes, PHRASE)
            found: dict[int, bytes] = {}
            for d, (a, b) in enumerate(zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True)):
                mine = np.asarray(wanted[first + d].values.to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
                for i in (a + np.flatnonzero(np.isin(phrases[a : max(a, b - PHRASE + 1)], mine))).tolist():
                    found.setdefault(int(phrases[i].astype(np.int64)), b" ".join(raw[w.starts[i] : w.ends[i + PHRASE - 1]].tobytes().split()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], ["phrase", "words"])


def _automata(phrases: list[bytes], symbols: dict[bytes, int]) -> Iterator[ahocorasick.Automaton]:
    """Automata over words for ``phrases``; ``symbols`` numbers the words, from 1."""
    for at in range(0, len(phrases), AUTOMATON_PHRASES):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
        for phrase in phrases[at : at + AUTOMATON_PHRASES]:
            automaton.add_word(tuple(symbols.setdefault(x, len(symbols) + 1) for x in phrase.split()))
        automaton.make_automaton()
        yield automaton


def _locate(docs: pa.Table, phrases: pa.Table) -> pa.Table:
    """(window, doc_id) for each distinct window of a shard's documents (doc_id, text) that elected an occurrence of a phrase."""
    symbols: dict[bytes, int] = {}
    automata = list(_automata(phrases["words"].to_pylist(), symbols))
    out = []
    docs = docs.combine_chunks()
    for first, end, raw, offs in text_slices(docs["text"]):
        w = words.split(raw, offs)
        starts, at, _ = _elected(w)
        found = np.zeros(len(w.hashes) + 1, bool)
        for d, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
            own = tuple(symbols.get(x, 0) for x in raw[a:b].tobytes().split())
            for automaton in automata:
                last = np.fromiter((i for i, _ in automaton.iter(own)), np.int64)
                found[w.bounds[d] + last - PHRASE + 1] = True
        keep = found[at]
        whole = words.windows(w.hashes, WINDOW)[starts[keep]]
        owner = np.searchsorted(w.bounds, starts[keep], "right") - 1
        lists = _lists(whole, owner, end - first)
        ids = docs["doc_id"].combine_chunks().slice(first, end - first).take(lists.value_parent_indices())
        out.append(pa.table({"window": lists.flatten(), "doc_id": ids}))
    return pa.concat_tables(out) if out else pa.table({"window": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64())})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        gone = batch.column(3)
        for first, _, raw, offs in text_slices(batch.column(2)):
            w = words.split(raw, offs)
            whole = words.windows(w.hashes, WINDOW)
            for d, (a, b) in enumerate(zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True)):
                row = first + d
                covered = np.zeros(b - a + 1, np.int64)
                if b - a >= WINDOW:
                    mine = np.asarray(gone[row].values.to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
                    at = np.flatnonzero(np.isin(whole[a : b - WINDOW + 1], mine))
                    np.add.at(covered, at, 1)
                    np.add.at(covered, at + WINDOW, -1)
                kept = np.cumsum(covered)[:-1] == 0
                steps = np.flatnonzero(np.diff(np.concatenate(([False], kept, [False])).astype(np.int8)))
                runs = [raw[w.starts[a + x] : w.ends[a + y - 1]].tobytes() for x, y in zip(steps[::2].tolist(), steps[1::2].tolist(), strict=True)]
                plain = b" ".join(b" ".join(r.split()) for r in runs)
                out.append((batch.column(0)[row].as_py(), batch.column(1)[row].as_py(), int((~kept).sum()), hashlib.sha256(plain).hexdigest(), b"\n".join(runs).decode("utf-8", "replace")))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["doc_id", "words_sha", "n_removed", "kept_sha256", "kept_text"])


def repeated_passages(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(profile, edits): doc_id, n_words, words_sha of every row; EDIT rows of the (doc_id, words_sha) that lose
    words, with ``mixed``: whether rows of that doc_id have different words."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profile = written(rows.mapInArrow(_profile, PROFILE), "profile")
    long = profile.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= WINDOW))
    first = long.groupBy("words_sha").agg(F.min("doc_id").alias("first_id"))
    copies = (
        long.select("doc_id", "words_sha", "n_words")
        .join(first, "words_sha")
        .where("doc_id > first_id")
        .select("doc_id", "words_sha", F.col("n_words").alias("n_removed"), F.lit(EMPTY_SHA).alias("kept_sha256"), F.lit("").alias("kept_text"))
        .dropDuplicates(["doc_id", "words_sha"])
    )
    # Whether the rows of a doc_id have different texts: then rows are told apart by their words.
    mixed = profile.where("doc_id IS NOT NULL").groupBy("doc_id").agg((F.min("words_sha") != F.max("words_sha")).alias("mixed"))
    elected = long.join(first, "words_sha").where("doc_id = first_id").select("doc_id", "words_sha", F.explode("phrases").alias("phrase"))
    recurring = elected.groupBy("phrase").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("phrase", "lo")
    phrases = elected.join(recurring, "phrase").groupBy("doc_id", "words_sha").agg(F.collect_set("phrase").alias("phrases"), F.collect_set(F.when(F.col("doc_id") == F.col("lo"), F.col("phrase"))).alias("firsts"))
    wanted = phrases.join(mixed, "doc_id")
    shards = written(
        rows.where(F.col("text").isNotNull())
        .join(wanted, "doc_id")
        .where(~F.col("mixed") | (_sha(F.col("text")) == F.col("words_sha")))
        .groupBy("doc_id", "words_sha")
        .agg(F.first("text").alias("text"), F.first("phrases").alias("phrases"), F.first("firsts").alias("firsts"), F.first(F.octet_length("text")).alias("size")),
        "shards",
    )
    n = max(1, -(-(shards.agg(F.sum("size")).first()[0] or 0) // SHARD_BYTES))
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(n)).alias("shard")
    said = shards.where(F.size("firsts") > 0).select("text", "firsts").mapInArrow(_phrase_words, "phrase long, words binary").groupBy("phrase").agg(F.min("words").alias("words"))
    needed = shards.select(shard, F.explode("phrases").alias("phrase")).distinct().join(said, "phrase").select("shard", "words")
    located = written(shards.select(shard, "doc_id", "text").groupBy("shard").cogroup(needed.groupBy("shard")).applyInArrow(_locate, "window long, doc_id long"), "located")
    owners = located.groupBy("window").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").select("window", "owner")
    gone = located.join(owners, "window").where("doc_id > owner").groupBy("doc_id").agg(F.collect_set("window").alias("gone"))
    partial = shards.select("doc_id", "words_sha", "text").join(gone, "doc_id").mapInArrow(_cut, EDIT).where("n_removed > 0")
    return profile.select("doc_id", "n_words", "words_sha"), copies.unionByName(partial).join(mixed, "doc_id")


def _sha(text: Column) -> Column:
    """words_sha of a text, in SQL."""
    return F.unhex(F.sha2(F.array_join(words_of(text), " "), 256))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row for each row of ``docs``."""
    profile, edits = repeated_passages(docs)
    edits = edits.select("doc_id", "words_sha", "n_removed", "kept_sha256")
    return profile.join(edits, ["doc_id", "words_sha"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha256", F.lower(F.hex("words_sha"))).alias("kept_sha256"),
    )


def remove_repeated_passages(docs: DataFrame) -> DataFrame:
    """The rows and columns of ``docs`` with repeated passages cut out of ``text``.

    A text that loses nothing stays byte for byte; one that loses all its words
    becomes empty. The parts that stay are joined by a line end.
    """
    _, edits = repeated_passages(docs)
    edits = edits.select("doc_id", "words_sha", "mixed", F.struct("kept_text").alias("edit")).alias("e")
    own = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"].cast("long").alias("key")).alias("d")
    same = ~F.col("e.mixed") | (F.col("e.words_sha") == _sha(F.col("d.row.text")))
    joined = own.join(edits, (F.col("d.key") == F.col("e.doc_id")) & same, "left")
    text = F.when(F.col("edit").isNull(), F.col("row.text")).otherwise(F.col("edit.kept_text"))
    return joined.select(*(text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
