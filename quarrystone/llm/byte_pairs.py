"""Byte-level BPE: texts to token ids and back, merged through an index from each pair to all its positions.

The texts of a partition are read in slices. A slice's distinct pieces (what
the split pattern leaves) lie in one array of symbols, and each mergeable pair
is mapped to all positions it has there. The ranks that are active are applied
in ascending order, each to all its positions at once (of overlapping ones to
every other from the left); the lists of the pairs that a merge makes take its
position, and a position whose pair has gone is passed over when its turn comes. A vocabulary in which a merge could make a pair of a lower
rank is refused, so one pass in ascending order gives what merging piece by
piece gives. Pieces met before are looked up, within KNOWN_PIECES.

Every row is read and stays one row; columns beside ``text`` are kept. Null and
empty texts have no tokens; null ids decode to an empty text. Texts may be of
any length: a text longer than a slice is a slice of its own. Invalid UTF-8 is
read as U+FFFD. Repeated rows give repeated rows, an empty table an empty one.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import SLICE_BYTES

#: Distinct pieces whose tokens a Python worker keeps.
KNOWN_PIECES = 1 << 19
#: A vocabulary file may have so many bytes; it is sent to the executors.
MOST_FILE_BYTES = 1 << 26
# Fixed value: the split pattern that byte-level vocabularies of this format imply.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class VocabularyError(ValueError):
    """A tokenizer file that this operator cannot apply, with the reason."""


def alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes are themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


#: Stands before an added token among the pieces, of which none has it beside other characters.
_ADDED = " \n "


def _alternate(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of ascending pairs (i, j), whether each is taken if a taken one rules out the pair that begins with its j."""
    linked = np.concatenate(([False], i[1:] == j[:-1]))
    starts = np.flatnonzero(~linked)
    return (np.arange(len(i)) - np.repeat(starts, np.diff(np.append(starts, len(i))))) % 2 == 0


@dataclass
class Vocabulary:
    """A byte-level vocabulary: symbols of single bytes, merges by pair, bytes of each id, strings taken out before the split."""

    of_byte: np.ndarray
    merges: list[tuple[int, int, int]]  # (left, right, result) by rank
    rank: dict[int, int]  # left << 32 | right to rank
    keys: np.ndarray  # the keys of rank, sorted, with ...
    key_ranks: np.ndarray  # ... their ranks
    bytes_of: dict[int, bytes]
    added: list[tuple[str, int]]

    @classmethod
    def parse(cls, text: str) -> Vocabulary:
        d = json.loads(text)
        model, split = d["model"], d.get("pre_tokenizer") or {}
        refused = {
            "a model other than BPE": model.get("type") != "BPE",
            "a split other than the byte-level one": split.get("type") != "ByteLevel" or not split.get("use_regex", True) or split.get("add_prefix_space"),
            "a normalizer": d.get("normalizer") is not None,
            "dropout, affixes, fallback or whole words": any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")),
            "added tokens that take in white space or need whole words": any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in d.get("added_tokens", [])),
        }
        for what, there in refused.items():
            if there:
                raise VocabularyError(f"not supported: {what}")
        byte = alphabet()
        ids: dict[str, int] = model["vocab"]
        missing = [c for c in byte if c not in ids]
        if missing:
            raise VocabularyError(f"{len(missing)} bytes have no symbol")
        of_byte = np.zeros(256, np.int64)
        for c, b in byte.items():
            of_byte[b] = ids[c]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        merges = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
        made: dict[int, int] = {}
        for r, (_, _, new) in enumerate(merges):
            made[new] = r
        for r, (a, b, _) in enumerate(merges):
            if max(made.get(a, -1), made.get(b, -1)) >= r:
                raise VocabularyError(f"merge {r} comes before one that makes its parts")
        rank = {a << 32 | b: r for r, (a, b, _) in reversed(list(enumerate(merges)))}
        keys = np.array(sorted(rank), np.int64)
        added = [(a["content"], a["id"]) for a in d.get("added_tokens", [])]
        bytes_of = {i: bytes(byte[c] for c in s) for s, i in ids.items() if all(c in byte for c in s)}
        bytes_of |= {i: bytes(byte[c] for c in s) if all(c in byte for c in s) else s.encode() for s, i in added}
        return cls(of_byte, merges, rank, keys, np.array([rank[k] for k in keys.tolist()], np.int64), bytes_of, added)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, -1 where it is none."""
        key = left << 32 | right
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[place] == key, self.key_ranks[place], -1)

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece (none is empty), as int32."""
        if not pieces:
            return []
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        firsts = np.cumsum(lengths + 1) - lengths - 1
        s = np.full(int(lengths.sum()) + len(pieces) + 1, -1, np.int64)  # -1 after each piece
        inside = np.ones(len(s), bool)
        inside[-1] = False
        inside[firsts + lengths] = False
        s[inside] = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        if len(self.keys):
            self._apply(s)
        alive = s != -2
        places = np.cumsum(alive) - 1
        raw = s[alive].astype(np.int32).tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(places[firsts].tolist(), places[firsts + lengths].tolist(), strict=True)]

    def _apply(self, s: np.ndarray) -> None:
        """Merges in place; a symbol taken in by the one before it becomes -2."""
        following, before = np.arange(1, len(s) + 1), np.arange(-1, len(s) - 1)
        ranks = self._ranks(s[:-1], s[1:])
        at = np.flatnonzero(ranks >= 0)
        at = at[np.argsort(ranks[at], kind="stable")]
        cuts = np.flatnonzero(np.diff(ranks[at], prepend=-1))
        index = {int(ranks[x[0]]): x.tolist() for x in np.split(at, cuts[1:]) if len(x)}
        active = list(index)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            a, b, new = self.merges[r]
            i = np.unique(index.pop(r))
            j = following[i]
            there = (s[i] == a) & (s[j] == b)
            i, j = i[there], j[there]
            if a == b and len(i) > 1:  # of places that overlap, every other one from the left
                i = i[_alternate(i, j)]
                j = following[i]
            if not len(i):
                continue
            k = following[j]
            s[i], s[j] = new, -2
            following[i], before[k] = k, i
            p = before[i]
            places = np.concatenate((np.maximum(p, 0), i))
            made = self._ranks(np.concatenate((np.where(p < 0, -1, s[p]), s[i])), np.concatenate((s[i], s[k])))
            hit = made >= 0
            for x, place in zip(made[hit].tolist(), places[hit].tolist(), strict=True):
                if x in index:
                    index[x].append(place)
                else:
                    index[x] = [place]
                    heapq.heappush(active, x)

    @functools.cached_property
    def _cut(self) -> regex.Pattern | None:
        words = sorted((w for w, _ in self.added if w), key=len, reverse=True)
        return regex.compile("|".join(map(regex.escape, words))) if words else None

    @functools.cached_property
    def _pieces(self) -> regex.Pattern:
        return regex.compile(PATTERN)

    def encode(self, texts: list[str], known: dict[str, bytes]) -> list[bytes]:
        """The ids of each text as int32; ``known`` holds pieces met before and takes the new ones."""
        added = {w: np.int32(i).tobytes() for w, i in self.added}
        split: list[list[str]] = []
        for text in texts:
            at, parts = 0, []
            for m in self._cut.finditer(text) if self._cut else ():
                parts += self._pieces.findall(text[at : m.start()])
                parts.append(_ADDED + m[0])
                at = m.end()
            parts += self._pieces.findall(text[at:] if at else text)
            split.append(parts)
        if len(known) > KNOWN_PIECES:
            known.clear()
        known.update((_ADDED + w, ids) for w, ids in added.items())
        fresh = list({p for parts in split for p in parts if p not in known})
        known.update(zip(fresh, self.merged([p.encode() for p in fresh]), strict=True))
        return [b"".join(map(known.__getitem__, parts)) for parts in split]

    @functools.cached_property
    def _table(self) -> tuple[np.ndarray, np.ndarray]:
        """All tokens' bytes in a row, and where each id's begin; an unknown id has none."""
        n = max(self.bytes_of, default=-1) + 1
        each = [self.bytes_of.get(i, b"") for i in range(n)]
        return np.frombuffer(b"".join(each), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int64)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Texts of the ids of rows bounds[d]:bounds[d + 1]; ids outside the vocabulary say nothing."""
        data, offsets = self._table
        ids = np.where((ids >= 0) & (ids < len(offsets) - 1), ids, len(offsets) - 1)
        starts = np.concatenate((offsets, offsets[-1:]))[ids]
        lengths = np.concatenate((np.diff(offsets), [0]))[ids]
        ends = np.cumsum(lengths)
        raw = data[np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
        cuts = np.concatenate(([0], ends))[bounds].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@functools.lru_cache(maxsize=2)
def _parsed(text: str) -> Vocabulary:
    return Vocabulary.parse(text)


def _sent(df: DataFrame, vocabulary: str):
    """The file at ``vocabulary``, read on the driver and sent to the executors."""
    with open(vocabulary, encoding="utf-8") as f:
        text = f.read(MOST_FILE_BYTES + 1)
    if len(text) > MOST_FILE_BYTES:
        raise VocabularyError(f"over {MOST_FILE_BYTES} characters")
    Vocabulary.parse(text)  # what is wrong with it is said here, not in a task
    return df.sparkSession.sparkContext.broadcast(text)


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with sizes of about ``most`` together, a row at least."""
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        end = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, "right")))
        yield first, end
        first = end


def _clear(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it until no column has it, case aside."""
    there = {c.lower() for c in df.columns}
    while name.lower() in there:
        name = "_" + name
    return name


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of its column ``text`` in the column ``ids`` (array<int>), which replaces one of that name.

    ``vocabulary``: path of a tokenizer file on the driver. The strings of added
    tokens are found in the text and become their ids; none is put in.
    """
    sent, raw = _sent(docs, vocabulary), _clear(docs, "raw")
    kept = [c for c in docs.columns if c.lower() != ids.lower()]
    own = docs.select(*(docs[c] for c in kept), docs[text].cast("string").cast("binary").alias(raw))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, known = _parsed(sent.value), {}
        for batch in batches:
            texts = batch.column(len(kept))
            lengths = np.asarray(pc.binary_length(texts).fill_null(0), np.int64)
            for first, end in _slices(lengths, 2 * SLICE_BYTES):
                said = [(x or b"").decode("utf-8", "replace") for x in texts.slice(first, end - first).to_pylist()]
                found = v.encode(said, known)
                offsets = np.concatenate(([0], np.cumsum([len(x) >> 2 for x in found])))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, end - first) for i in range(len(kept))), lists], [*kept, ids])

    schema = docs.select(*(docs[c] for c in kept)).schema.add(ids, T.ArrayType(T.IntegerType()))
    return own.mapInArrow(run, schema)


def decode(coded: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``coded`` with the text of its column ``ids`` in the column ``text``, which replaces one of that name.

    Bytes that are no UTF-8 become U+FFFD. Tokens that were put in by no one are
    not skipped; ids that the vocabulary lacks, and null ids, say nothing.
    """
    sent, raw = _sent(coded, vocabulary), _clear(coded, "raw")
    kept = [c for c in coded.columns if c.lower() != text.lower()]
    own = coded.select(*(coded[c] for c in kept), F.coalesce(coded[ids].cast("array<int>"), F.array().cast("array<int>")).alias(raw))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _parsed(sent.value)
        for batch in batches:
            lists = batch.column(len(kept))
            sizes = np.asarray(pc.list_value_length(lists), np.int64)
            for first, end in _slices(sizes, SLICE_BYTES >> 2):
                part = lists.slice(first, end - first)
                flat = part.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                said = v.decode(flat, np.concatenate(([0], np.cumsum(sizes[first:end]))))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, end - first) for i in range(len(kept))), pa.array(said, pa.string())], [*kept, text])

    schema = coded.select(*(coded[c] for c in kept)).schema.add(text, T.StringType())
    return own.mapInArrow(run, schema)


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encoded, and decoded from the ids."""
    coded = encode(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")), vocabulary)
    both = decode(coded.select("doc_id", "ids"), vocabulary)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        _sha(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        _sha(F.col("decoded")).alias("decoded_sha256"),
    )
