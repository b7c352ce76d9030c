import random

from quarrystone.llm import graph, near_dedup, passages
from quarrystone.llm.near_dedup import near_duplicates

from . import brute
from .conftest import sentence


def got(df):
    return [tuple(r) for r in df.collect()]


def test_components_of_random_edges(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(5, 5), (None, 3), (400, 401), (401, 400)] + [(i, i + 1) for i in range(1000, 1100)]
    top = {}

    def root(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = root(a), root(b)
            top[max(a, b)] = min(a, b)
    found = dict(got(graph.components(spark.createDataFrame(edges, "a long, b long"))))
    assert found == {x: root(x) for x in top}


def test_near_duplicates_match_brute_force(odd_docs, odd_rows):
    want = brute.components([r for r in odd_rows if r[0] is not None])
    rows = got(near_duplicates(odd_docs))
    assert len(rows) == len(odd_rows)
    for i, n, c, kept in rows:
        if i is None:
            assert c is None and kept
        else:
            assert (n, c) == want[i] and kept == (i == c)


def test_near_duplicates_of_nothing_and_of_repeated_rows(spark, no_docs):
    assert got(near_duplicates(no_docs)) == []
    text = "a b c d e f g h"
    rows = [(4, text), (4, text), (2, "q r s t u v w"), (2, text), (9, "q r s t u v w")]
    assert {r[2] for r in got(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))} == {2}


def test_large_group_that_leaders_do_not_settle(spark):
    """A base, copies that are near it but not each other, and strays near only one of them."""
    rng = random.Random(3)
    base = sentence(rng, 200).split()
    rows = []
    for i in range(90):
        w = list(base)
        for j in rng.sample(range(len(w)), rng.choice([2, 3, 6, 9])):
            w[j] = f"z{rng.random()}"
        rows.append((i, " ".join(w)))
    rows.append((500, " ".join(base)))
    found = {r[0]: (r[1], r[2]) for r in got(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))}
    assert found == brute.components(rows)


def test_estimates_are_close(spark):
    rng = random.Random(8)
    a = sentence(rng, 400).split()
    b = a[:350] + sentence(rng, 50).split()
    docs = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "doc_id long, text string")
    s = near_dedup.signatures(docs).alias("x")
    from pyspark.sql import functions as F

    x, y = s.where("doc_id = 1"), near_dedup.signatures(docs).where("doc_id = 2").select(F.col("bits").alias("other"))
    (e,) = x.crossJoin(y).select(near_dedup.estimate(F.col("bits"), F.col("other"))).first()
    assert abs(e - 346 / 446) < 0.2


def test_passages_match_brute_force(odd_docs, odd_rows):
    key = lambda r: (r[0] is None, r[0] or 0, r)
    assert sorted(got(passages.digests(odd_docs)), key=key) == sorted(brute.passages(odd_rows), key=key)


def test_passages_of_nothing_and_of_repeated_ids(spark, no_docs):
    assert got(passages.digests(no_docs)) == []
    rng = random.Random(9)
    p, q = sentence(rng, 60), sentence(rng, 80)
    rows = [(3, p), (3, p), (3, q), (7, p + " " + q), (1, q + " end"), (7, "x " + p)]
    assert sorted(got(passages.digests(spark.createDataFrame(rows, "doc_id long, text string")))) == sorted(brute.passages(rows))


def test_passages_cut_from_the_texts(odd_docs, odd_rows):
    cut = passages.remove_repeated_passages(odd_docs)
    assert cut.columns == odd_docs.columns
    rows = cut.collect()
    assert len(rows) == len(odd_rows) and {r["kept"] for r in rows} == {"clash"}
    want = {(i, n - gone) for i, n, gone, _ in brute.passages(odd_rows)}
    assert {(r["doc_id"], len(brute.words(r["text"]))) for r in rows} == want
    untouched = {i for i, _, gone, _ in brute.passages(odd_rows) if not gone}
    text = dict(odd_rows)
    assert all(r["text"] == text[r["doc_id"]] for r in rows if r["doc_id"] in untouched and r["doc_id"] is not None)


def test_occurrences_come_from_the_automata(monkeypatch):
    """A shard finds nothing without automata, and the same with one automaton or with one for each phrase."""
    import pyarrow as pa

    rng = random.Random(11)
    shared = sentence(rng, 80)
    texts = [sentence(rng, 30) + " " + shared, shared + "\n" + sentence(rng, 200), sentence(rng, 300)]
    profile = pa.concat_tables([pa.Table.from_batches([b]) for b in passages._profile(iter([pa.record_batch({"doc_id": [1, 2, 3], "text": texts})]))])
    both = set(profile["phrases"][0].as_py()) & set(profile["phrases"][1].as_py())
    assert both
    ((batch),) = passages._phrase_words(iter([pa.record_batch({"text": texts[:1], "wanted": pa.array([list(both)], pa.list_(pa.int64()))})]))
    phrases = pa.table({"words": batch.column(1)})
    assert all(f" {p.decode()} " in f" {shared} " for p in phrases["words"].to_pylist())
    docs = pa.table({"doc_id": [1, 2, 3], "text": texts})
    one = passages._locate(docs, phrases)
    owners: dict = {}
    for r in one.to_pylist():
        owners.setdefault(r["window"], set()).add(r["doc_id"])
    assert sum(v == {1, 2} for v in owners.values()) == 31 and all(3 not in v for v in owners.values())
    monkeypatch.setattr(passages, "AUTOMATON_PHRASES", 1)
    assert passages._locate(docs, phrases).equals(one)
    assert passages._locate(docs, phrases.slice(0, 0)).num_rows == 0
