"""Collocations, periodic runs and byte pairs against brute force, the tokenizers library and SQL."""

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from quarrystone.llm import byte_pairs, collocations, periodic_runs

from . import brute

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Collocations


def plain_collocations(rows):
    """(lang, rank, phrase, a, l, r, n, score) of rows (lang, text)."""
    f, n = {}, Counter()
    for lang, text in rows:
        mine = f.setdefault(lang or "und", Counter())
        for piece in regex.split("[.,;:!?\n\x0b\x0c\r]", brute.fold(text)):
            w = regex.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                mine.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, mine in f.items():
        cand = {p: a for p, a in mine.items() if len(p) > 1 and a >= 30}
        gone = {p[i : i + m] for p, a in cand.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= 80 * mine[p[i : i + m]]}
        scored = []
        for p, a in cand.items():
            if p not in gone:
                score, k = min((2_000_000 * a // (mine[p[:k]] + mine[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), mine[p[:k]], mine[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(scored)[:2000], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def said():
    rng = random.Random(3)
    vocabulary = ["alpha", "Beta", "g", "é", "\x1cx", "delta", "the", "of"]
    texts = [" ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ".", "\n", ",", "\t"]) for _ in range(rng.randint(0, 90))) for _ in range(120)]
    texts += ["new york city hall " * 40, "New York. City hall; " * 35, "a a a a a a " * 20, None, "", " \t", "...", "x" * 9000, "solid state drive\x0b" * 33]
    return [(rng.choice(["en", "de", None]), t) for t in texts]


def frame(spark, said):
    return spark.createDataFrame([(i, x, t, "clash", 7) for i, (x, t) in enumerate(said)], "doc_id long, lang string, text string, phrase string, n long").repartition(5)


@pytest.mark.parametrize("how", [{}, {"counters": 1 << 16, "rounds": 3, "shard_bytes": 500}])
def test_collocations_are_those_of_plain_counting(spark, said, how):
    got = collocations.collocations(frame(spark, said), **how)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_collocations(said)


def test_collocations_oracle_and_ties(spark, said):
    con = duckdb.connect()
    documents = pd.DataFrame(said * 2, columns=["lang", "text"])
    con.register("documents", documents)
    want = con.sql(collocations.ORACLE_SQL).fetchall()
    got = collocations.collocations(frame(spark, said * 2)).collect()
    assert sorted(map(tuple, got)) == sorted(want) == plain_collocations(said * 2)


def test_a_sketch_bounds_counts_from_above(spark, said):
    texts = spark.createDataFrame([(x or "und", t) for x, t in said if t is not None], "lang string, text string")
    kept = {tuple(r) for r in collocations.sketched_candidates(texts, 1 << 16, 1).collect()}
    heavy = {(x[0], x[2]) for x in plain_collocations(said)}
    assert heavy <= kept
    assert kept <= {(lang, p) for lang, p in kept if len(p.split(" ")) in (2, 3, 4)}


def test_scores_pass_64_bits(spark):
    from pyspark.sql import functions as F

    a, parts = 9 * 10**18, 10**19 + 7
    got = spark.range(1).select(collocations._score(F.lit(a), F.lit(str(parts)).cast("decimal(20,0)"))).first()[0]
    assert got == int(Fraction(2_000_000 * a, parts))


def test_collocations_of_nothing(spark, no_docs, odd_docs):
    assert collocations.collocations(no_docs).count() == 0
    collocations.collocations(odd_docs).count()


# Periodic runs


def smallest_period(w):
    return next((p for p in range(1, len(w)) if all(w[i] == w[i + p] for i in range(len(w) - p))), len(w))


def plain_runs(w):
    """(start, length, period) by definition."""
    found = set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q) and smallest_period(w[i : i + length]) == q:
                found.add((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_wound(i, text):
    w = brute.words(text)
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]


def plain_digest(i, w):
    runs = plain_runs(w)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    first = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (i, len(runs), *first, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


@pytest.fixture(scope="module")
def periodic():
    rng = random.Random(9)
    out = []
    for i in range(160):
        w = [rng.choice("ab") if i % 3 else rng.choice("abcdefgh") for _ in range(rng.randint(0, 60))]
        if i % 4 == 0:
            q = rng.randint(1, 7)
            w += [rng.choice("uvwxyz") for _ in range(q)] * rng.randint(3, 6) + w[:5]
        out.append((i, " ".join(w)))
    return [*out, (160, None), (161, ""), (162, " \n"), (163, "a " * 6), (164, "a " * 5), (165, "a\x1cb " * 30 + "é ü " * 9), (None, "b a " * 20), (0, "c " * 99), (0, "c " * 99)]


@pytest.mark.parametrize("how", [{}, {"short_bytes": 0, "comparisons": 50}, {"short_bytes": 60, "comparisons": 1000}])
def test_periodic_runs_are_those_of_the_definition(spark, periodic, how):
    docs = spark.createDataFrame([(i, t, "clash", 3) for i, t in periodic], "doc_id long, text string, runs string, n_words long").repartition(3)
    got = periodic_runs.periodic_runs(docs, **how)
    want = [(i, len(w := brute.words(t)), plain_runs(w)) for i, t in periodic]
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs]) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_runs_of_wound_documents(spark, periodic):
    docs = spark.createDataFrame(periodic, "doc_id long, text string").repartition(3)
    got = periodic_runs.digest(periodic_runs.periodic_runs(periodic_runs.wound(docs), short_bytes=100, comparisons=400))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [plain_digest(i, plain_wound(i, t)) for i, t in periodic]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert sum(r[1] for r in want) > 40


def test_a_text_of_megabytes_is_compared_in_ranges(spark):
    rng = random.Random(1)
    w = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    text = " ".join(w + w[:7000] * 5)
    assert len(text) > periodic_runs.SHORT_BYTES
    row = periodic_runs.periodic_runs(spark.createDataFrame([(5, text)], "doc_id long, text string"), comparisons=1 << 28).first()
    assert (67_000 - 7000 + 28_000 + 7000 == row.n_words) and [tuple(r) for r in row.runs] == [(60_000, 35_000, 7000)]


def test_periodic_runs_of_nothing(spark, no_docs, odd_docs):
    assert periodic_runs.periodic_runs(no_docs).count() == 0
    assert periodic_runs.periodic_runs(odd_docs).count() == odd_docs.count()


# Byte pairs


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(VOCABULARY)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    parts = ["a", "b", "ab", " ", "  ", "\n", "\t", "'s", "'ll", "<|endoftext|>", "<|endof", "é", "1", "22", "!", "\u0085", "　", "aaaa", "\x00", "\U0001f600", "漢字", "word", " the", "THE"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    out += [chr(c) * 2 + " " + chr(c) for c in range(1, 0x3000, 7)]
    return [*out, None, "", " ", "x" * 100_000, "ab" * 50_000, "<|endoftext|>" * 3]


def test_ids_and_texts_are_those_of_the_library(spark, library, texts):
    docs = spark.createDataFrame([(i % 300, t, "clash", [1]) for i, t in enumerate(texts)], "doc_id long, text string, raw string, ids array<int>").repartition(4)
    coded = byte_pairs.encode(docs, VOCABULARY)
    assert sorted(coded.columns) == ["doc_id", "ids", "raw", "text"]
    for r in byte_pairs.decode(coded, VOCABULARY).collect():
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == want and r.decoded == library.decode(want, skip_special_tokens=False)
    want = []
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i % 300, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, byte_pairs.round_trip(docs, VOCABULARY).collect())) == sorted(want)


def test_any_ids_decode_as_in_the_library(library):
    rng = random.Random(2)
    v = byte_pairs.Vocabulary.parse(open(VOCABULARY).read())
    rows = [[rng.randrange(50257) for _ in range(rng.randint(0, 9))] for _ in range(3000)]
    bounds = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    assert v.decode(np.array([i for r in rows for i in r]), bounds) == [library.decode(r, skip_special_tokens=False) for r in rows]
    assert v.decode(np.array([-1, 10**6, 64]), np.array([0, 2, 3])) == ["", "a"]


def test_vocabularies_that_one_pass_cannot_serve_are_refused():
    symbols = {c: i for i, c in enumerate(byte_pairs.alphabet())} | {"ab": 256, "abc": 257}
    import json

    def file(merges, **more):
        return json.dumps({"added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "ByteLevel"}, "model": {"type": "BPE", "vocab": symbols, "merges": merges} | more})

    assert len(byte_pairs.Vocabulary.parse(file([["a", "b"], ["ab", "c"]])).merges) == 2
    with pytest.raises(byte_pairs.VocabularyError, match="merge 0"):
        byte_pairs.Vocabulary.parse(file([["ab", "c"], ["a", "b"]]))
    with pytest.raises(byte_pairs.VocabularyError, match="dropout"):
        byte_pairs.Vocabulary.parse(file([], dropout=0.1))


def test_byte_pairs_of_nothing(spark, no_docs, odd_docs):
    assert byte_pairs.round_trip(no_docs, VOCABULARY).count() == 0
    assert byte_pairs.round_trip(odd_docs, VOCABULARY).count() == odd_docs.count()
