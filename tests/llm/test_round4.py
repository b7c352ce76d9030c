"""Findings of round 4: how often collocations scan their texts, and phrases that share a hash."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystone.llm import collocations


def test_texts_are_scanned_as_often_with_many_shards_and_rounds(spark):
    rng = random.Random(11)
    texts = [" ".join(rng.choice(["one", "two", "three", "four", "five", "six"]) for _ in range(60)) for _ in range(80)]
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    docs = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string").repartition(4)
    some = collocations.collocations(docs, counters=1 << 16, rounds=1).collect()
    many = collocations.collocations(docs.withColumn("text", seen.asNondeterministic()("text")), counters=1 << 16, rounds=4, shard_bytes=200).collect()
    assert sorted(many) == sorted(some) and len(some) > 40
    assert read.value <= 2 * len(texts)


@pytest.mark.parametrize("kinds", [1, 3, 1 << 40])
def test_phrases_that_share_a_hash_are_counted_apart(monkeypatch, kinds):
    plain = collocations._Texts.hashes
    monkeypatch.setattr(collocations._Texts, "hashes", lambda *x: plain(*x) % np.uint64(kinds))
    rng = random.Random(4)
    said = [" ".join(rng.choice("abcdeFG") * rng.randint(1, 9) + rng.choice(["", "", ".", "\n"]) for _ in range(rng.randint(0, 50))) for _ in range(30)]
    want = Counter()
    for piece in (p for t in said for x in t.lower().split("\n") for p in x.split(".")):
        w = piece.split()
        want.update(" ".join(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    offs = np.cumsum([0, *map(len, said)])
    shard = collocations._Shard(collocations._Texts(np.frombuffer("".join(said).encode(), np.uint8), offs), "en", lambda h: np.ones(len(h), bool))
    got = [(p.decode(), int(n)) for phrases, _, counts in shard.counted() for p, n in zip(phrases.to_pylist(), counts, strict=True)]
    assert len(got) == len(dict(got)) and dict(got) == want
