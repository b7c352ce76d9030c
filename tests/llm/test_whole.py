"""Cases in which an operator once did less than the whole job."""

import random

from pyspark.sql import functions as F

from quarrystone.llm import decontamination, site_quality, toxicity

TEXT = "doc_id long, text string"


def judged(spark, docs, items):
    rows = decontamination.contamination(spark.createDataFrame(list(enumerate(docs)), TEXT), spark.createDataFrame(items, "item_id long, text string")).collect()
    return {r["doc_id"]: r for r in rows}


def test_texts_that_share_an_item_id(spark):
    texts = [" ".join(f"{c}{(i * 7 + j) % 23}x{j}" for j in range(14)) for i, c in enumerate("abcdefgh")]
    out = judged(spark, texts, [(0, t) for t in texts])
    assert all(out[i]["contaminated"] and out[i]["items"] == [0] and not out[i]["reparameterised"] for i in range(len(texts)))


TOM = "Tom has 5 apples and buys 3 more. Tom gives 2 to Ann. How many apples does Tom have?"
SUM = "What is 12 times 7?"
TRAIN = "A train leaves Paris at 9 and travels 120 km in 3 hours. How fast does the train go, and when does it reach Paris again?"


def test_reparameterised_items_in_ordinary_forms(spark):
    docs = [
        TOM.replace("Tom", "Mary"),
        TOM.replace("5", "twenty five").replace("Ann", "Mary Ann"),
        TOM.replace("5", "twenty-five").replace("Tom", "Mary Ann"),
        TOM.replace("5", "4").replace("3", "4"),
        TRAIN.replace("How fast", "So how very fast"),
        "He asked: " + SUM + " Nobody knew.",
        "Tom has 5 dogs or sells 3 more. Then takes 2 from Ann. How few dogs might Tom need?",
        SUM.replace("12", "14"),
        TOM,
    ]
    out = judged(spark, docs, [(1, TOM), (2, SUM), (3, TRAIN)])
    assert [out[i]["items"] for i in range(9)] == [[1], [1], [1], [1], [3], [2], [], [], [1]]
    assert [i for i in range(9) if out[i]["reparameterised"]] == [0, 1, 2, 3]


def test_bounded_labels_keep_the_class_shares(spark, monkeypatch):
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice("red green blue grey pink") for _ in range(rng.randint(20, 90))), "s", "en") for i in range(800)]
    labels = [(i, int(i % 6 > 0), int(i % 8 == 0)) for i in range(800)]
    monkeypatch.setattr(site_quality, "FIT_ROWS", 60)
    monkeypatch.setattr(toxicity, "FIT_ROWS", 60)
    docs = spark.createDataFrame(docs, TEXT + ", source string, lang string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    good = site_quality.classify(docs, labels).agg(F.avg("score")).first()[0]
    bad = toxicity.toxicity(docs, labels).agg(F.avg("score")).first()[0]
    assert abs(good - 5 / 6) < 0.1 and abs(bad - 1 / 8) < 0.1
