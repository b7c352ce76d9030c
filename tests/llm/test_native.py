import random

import duckdb
import pytest

from quarrystone.llm import decontamination, licences, mixing, perspectives

from . import brute


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_mix_matches_duckdb(odd_docs, tmp_path):
    path = str(tmp_path / "docs.parquet")
    odd_docs.write.parquet(path)
    found = rows_of(mixing.mix(odd_docs))
    want = duckdb.connect().execute(mixing.ORACLE_SQL.format(docs=f"read_parquet('{path}/*.parquet')")).fetchall()
    assert found == sorted(want, key=repr)
    assert all(taken <= 2 * size for _, size, _, _, taken in found)
    total = sum(r[1] for r in found)
    assert 0 <= total * 1.5 - sum(r[4] for r in found) < 10


def test_mix_of_repeated_rows_meets_its_targets(spark, tmp_path):
    rows = [(1, "w " * 10, "a")] * 100 + [(None, "x y", "b")] * 40 + [(i, "u v w", "b") for i in range(300)] + [(i, "u v w", "c") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.write.parquet(path := str(tmp_path / "docs.parquet"))
    found = rows_of(mixing.mix(docs))
    want = duckdb.connect().execute(mixing.ORACLE_SQL.format(docs=f"read_parquet('{path}/*.parquet')")).fetchall()
    assert found == sorted(want, key=repr) and all(taken <= 2 * size for _, size, _, _, taken in found)
    for size in {r[2] for r in found}:
        own = [r for r in found if r[2] == size]
        assert abs(sum(r[4] for r in own) - own[0][3]) <= 10
    total = sum(r[1] for r in found)
    assert sum(r[4] for r in found) >= total * 1.5 - 10


def test_mix_of_nothing_and_of_empty_texts(spark, no_docs):
    assert mixing.mix(no_docs).collect() == []
    empty = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mix(empty).collect()] == [0, 0]


def test_targets_reshare_what_full_sources_leave(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000)], "source string, source_size long")
    t = {r["source"]: r["target"] for r in mixing.targets(mixing.weigh_sources(sizes)).collect()}
    assert t["a"] == 20 and abs(sum(t.values()) - 3015) < 1e-6
    assert t["b"] == pytest.approx(1996.6666666667) and t["c"] == pytest.approx(998.3333333333)


CHAT = "conv_id long, turn long, role string, text string, part string"


def test_perspectives(spark):
    rows = [(1, 0, "system", "be nice", "x"), (1, 1, "ann", "hi <|turn_end|>", "x"), (1, 2, "bob", "yo", "x"), (1, 3, None, "?", "x"), (2, 0, "system", "alone", "x"), (None, None, "eve", None, "x"), (1, 70, "ann", "later", "x")]
    out = perspectives.rotate(spark.createDataFrame(rows, CHAT)).collect()
    by = {(r["conv_id"], r["perspective"], r["part"]): r for r in out}
    assert set(by) == {(1, "ann", 0), (1, "bob", 0), (1, "ann", 1), (1, "bob", 1), (None, "eve", -1)}
    ann = by[1, "ann", 0]
    assert ann["rendered"] == (
        "<|turn_start|>system\nbe nice<|turn_end|>\n<|turn_start|>assistant\nhi < |turn_end|><|turn_end|>\n<|turn_start|>user name=bob\nyo<|turn_end|>\n<|turn_start|>user name=unknown\n?<|turn_end|>\n"
    )
    assert [ann["rendered"][m["start"] : m["end"]] for m in ann["mask"]] == ["hi < |turn_end|><|turn_end|>"]
    assert by[1, "bob", 1]["mask"] == [] and by[None, "eve", -1]["n_learned"] == 1
    assert perspectives.rotate(spark.createDataFrame([], CHAT)).collect() == []


def test_dialogues_of_any_length_are_whole_and_in_order(spark, tmp_path):
    """A part with 3,000 rows of one turn, one with a row that is there 2,500 times, and a dialogue of 300 turns."""
    rows = [(1, 5, f"p{i % 2}", f"text {i:04d}", "x") for i in range(3000)] + [(2, 0, "ann", "again", "x")] * 2500 + [(None, i, f"p{i % 3}", f"t{i}", "x") for i in range(300)] + [(2, 1, "bob", "é", "x")]
    chat = spark.createDataFrame(rows, CHAT).repartition(7)
    chat.write.parquet(path := str(tmp_path / "chat.parquet"))
    out = perspectives.digest(perspectives.rotate(chat))
    found = rows_of(out)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{path}/*.parquet')")
    names = out.columns
    r = c.execute(perspectives.ORACLE_SQL)
    order = [[d[0] for d in r.description].index(n) for n in names]
    assert found == sorted((tuple(x[i] for i in order) for x in r.fetchall()), key=repr)
    view = sorted((x for x in found if x[0] == 1 and x[1] == "p0"), key=lambda x: (x[2], x[3]))
    whole = "".join(x[names.index("rendered")] for x in view)
    assert len(view) == 3 and [line for line in whole.split("\n") if line.startswith("text")] == [f"text {i:04d}<|turn_end|>" for i in [*range(0, 3000, 2), *range(1, 3000, 2)]]
    spans = [(x[names.index("start")] + int(a), x[names.index("start")] + int(b)) for x in view for a, b in (m.split("-") for m in filter(None, x[names.index("mask")].split(",")))]
    assert [whole[a:b] for a, b in spans] == [f"text {i:04d}<|turn_end|>" for i in range(0, 3000, 2)]


def _template(name, part):
    return next(t for n, p, t in licences.TEMPLATES if (n, p) == (name, part))


def _comment(text, mark):
    words = text.split()
    return "\n".join(f"{mark} {' '.join(words[i : i + 10])}" for i in range(0, len(words), 10))


def test_licences(spark, odd_docs, no_docs, tmp_path):
    mit, gpl, bsd = _template("MIT", "whole"), _template("GPL-3.0", "header"), _template("BSD-3-Clause", "whole")
    rows = [
        (1, "hello\nReleased under the MIT License.\nbye"), (2, "intro\n\n" + mit.replace(", ", ",\n") + "\n\nend"), (3, "nothing of the kind"), (4, None), (5, ""), (None, "Licensed under CC BY-NC 4.0."),
        (6, "Copyright (c) 2020 Foo Ltd. " + mit), (7, _comment(mit, " *")), (8, "#!/bin/sh\n" + _comment(gpl, "#") + "\nset -e"), (9, "/*\n * Copyright X\n *\n" + _comment(bsd.replace("the copyright holder nor", "Foo Ltd nor"), " *") + "\n */"),
        (10, "Copyright (c) 2020 Foo Ltd. Released under the MIT License. See LICENSE for details."), (11, "we say that this is released under the mit license and so on " * 3), (12, "software license " * 400), (6, "Copyright (c) 2020 Foo Ltd. " + mit),
    ]
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id long, text string, w string, grams string").repartition(4)
    out = licences.licence_hits(docs).collect()
    found = {(r["doc_id"], r["licence"], r["part"]) for r in out}
    assert {(1, "MIT", "reference"), (2, "MIT", "whole"), (None, "CC-BY-NC-4.0", "reference"), (6, "MIT", "whole"), (7, "MIT", "whole"), (8, "GPL-3.0", "header"), (9, "BSD-3-Clause", "whole"), (10, "MIT", "reference"), (11, "MIT", "reference")} <= found
    assert not {i for i, *_ in found} & {3, 4, 5, 12}
    assert sum(r["doc_id"] == 6 and (r["unit"], r["licence"], r["part"]) == ("window", "MIT", "whole") for r in out) == 2
    docs.write.parquet(path := str(tmp_path / "docs.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    assert sorted((tuple(r) for r in out), key=repr) == sorted(c.execute(licences.oracle_sql()).fetchall(), key=repr)
    assert licences.licence_hits(odd_docs).collect() == [] and licences.licence_hits(no_docs).collect() == []


def test_a_unit_without_anchors_has_too_few_bigrams():
    for name, part, text in licences.TEMPLATES:
        grams = licences.bigram_set(text)
        left = [g for g in grams if g not in licences.anchors()[name, part]]
        assert 2 * len(left) / (len(left) + len(grams)) < licences.LEAST_DICE


ITEMS = [
    (1, "A train leaves Paris at 9 and travels 120 km in 3 hours. How fast does the train go, and when does it reach Paris again?"),
    (2, "A train leaves Rome at 7 and travels 450 km in 5 hours. How fast does the train go, and when does it reach Rome again?"),
    (3, "Which planet of the solar system has the largest number of moons today?"),
    (4, "too short"),
    (5, "3 + 4 = ?"),
    (None, "Which planet of the solar system has the largest number of moons today?"),
]


def test_decontamination(spark, no_docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    again = ITEMS[0][1].replace("Paris", "Oslo").replace("120", "77").replace("9", "8")
    broken = ITEMS[0][1].replace("reach Paris", "reach Berlin")
    docs = [
        (10, "Some text before. " + ITEMS[0][1] + " And after."), (11, again), (12, broken.replace("120", "9")), (13, "the weather is nice and nothing else happens here today at all"),
        (14, None), (15, ""), (16, ITEMS[2][1].upper()), (None, ITEMS[2][1]), (17, "too short"), (18, "this is too short to tell"), (19, "first\nToo SHORT.\nlast"), (20, "it is\ntoo\nshort"), (21, "What is 3 + 4?"), (22, "a\n\n3 + 4 =\n"),
    ]
    out = {r["doc_id"]: r for r in decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert len(out) == len(docs)
    assert {i for i, r in out.items() if r["contaminated"]} == {10, 11, 16, 17, 19, 22}
    assert {i: r["short_items"] for i, r in out.items() if r["short_items"]} == {18: [4], 20: [4], 21: [5]}
    assert out[10]["items"] == [1, 2] and not out[10]["reparameterised"] and out[11]["reparameterised"] and out[16]["items"] == [3]
    assert decontamination.contamination(no_docs, bench).collect() == []
    assert [r["contaminated"] for r in decontamination.contamination(spark.createDataFrame(docs[:1], "doc_id long, text string"), bench.limit(0)).collect()] == [False]


def test_benchmark_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK", 3)
    bench = spark.createDataFrame(ITEMS[:3], "item_id long, text string")
    docs = spark.createDataFrame([(1, ITEMS[2][1] + " yes"), (2, "no")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["contaminated"]) for r in decontamination.contamination(docs, bench).collect()) == [(1, True), (2, False)]


def test_word_counts_agree(spark):
    from pyspark.sql import functions as F

    from quarrystone.llm.shared import word_count, words_of

    texts = ["a b  c", "", None, " \t", "x\x0by\x1cz w", "\n\na"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(word_count(F.col("t")), words_of(F.col("t"))).collect()
    assert [(n, list(w)) for n, w in rows] == [(len(brute.words(t)), brute.words(t)) for t in texts]


def test_changed_copies_in_prose_are_found_wherever_they_were_changed(spark):
    """Each template with words put in and changed at random, and with its most telling words changed, against all windows."""
    rng, rows = random.Random(4), []
    for n, (name, part, text) in enumerate(licences.TEMPLATES):
        own = licences.template_words(text)
        for turn in range(3):
            w = list(own)
            for i in rng.sample(range(len(w)), len(w) // 14):
                w[i] = "zz" + w[i]
            if turn == 1:
                w.insert(rng.randrange(len(w)), "inserted")
            if turn == 2 and len(own) > 40:  # the words of rare bigrams go first
                rare = sorted(range(len(own)), key=lambda i: (own[i] in licences.COMMON, -len(own[i])))[: len(own) // 14]
                w = [f"q{x}" if i in rare else x for i, x in enumerate(own)]
            rows.append((3 * n + turn, " ".join([*["lorem"] * rng.randrange(9), *w, "ipsum", "dolor"])))

    def best(words, text):
        size, grams, out = len(licences.template_words(text)), set(licences.bigram_set(text)), None
        lo, hi = licences.bounds(len(grams))
        for s in range(len(words)):
            cut = words[s : s + size]
            a = {f"{x} {y}" for x, y in zip(cut, cut[1:], strict=False)}
            if lo <= len(a) <= hi and (d := 2.0 * len(a & grams) / (len(a) + len(grams))) >= licences.LEAST_DICE and (out is None or d > out[0]):
                out = (d, s)
        return out

    want = {(i, n, p): b for i, t in rows for n, p, x in licences.TEMPLATES if (b := best(t.split(), x))}
    found = {(r["doc_id"], r["licence"], r["part"]): (r["dice"], r["unit_no"]) for r in licences.licence_hits(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["unit"] == "window"}
    assert found == want and len(want) > len(licences.TEMPLATES)
