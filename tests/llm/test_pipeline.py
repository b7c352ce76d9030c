from quarrystone.llm import decontamination, near_dedup, site_quality

from . import brute

SF = "/root/testdata/sf0.001"


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    stages = dict(P.STAGES)
    assert len(P.STAGES) == 5

    def rows(df):
        return {r["doc_id"]: r["text"] for r in df.collect()}

    start = rows(docs)
    one = P.written(stages["quality classifier"](spark, docs, SF), "t")
    judged = {r["doc_id"]: r["kept"] for r in site_quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert one.columns == names and rows(one) == {i: t for i, t in start.items() if judged[i]}

    two = P.written(stages["MinHash near-dedup"](spark, one, SF), "t")
    groups = brute.components(list(rows(one).items()))
    assert two.columns == names and rows(two) == {i: t for i, t in rows(one).items() if groups[i][1] == i}

    three = P.written(stages["substring dedup"](spark, two, SF), "t")
    left = {i: n - gone for i, n, gone, _ in brute.passages(list(rows(two).items()))}
    assert three.columns == names and {i: len(brute.words(t)) for i, t in rows(three).items()} == left

    four = P.written(stages["benchmark decontamination"](spark, three, SF), "t")
    bad = {r["doc_id"] for r in decontamination.contamination(three, spark.read.parquet(f"{SF}/benchmark.parquet")).collect() if r["contaminated"]}
    assert four.columns == names and rows(four) == {i: t for i, t in rows(three).items() if i not in bad}

    last = stages["mixing sources to target weights"](spark, four, SF).collect()
    assert {r["doc_id"]: r["size"] for r in last} == {i: len(brute.words(t)) for i, t in rows(four).items()}
    assert sorted(P.run(spark, SF).collect()) == sorted(last)


def test_rows_that_share_a_doc_id_are_one_document(spark):
    import corpus_pipeline as P

    rows = [(1, "b first text of all", "x"), (1, "a second text of it", "y"), (1, "a second text of it", "w"), (2, "another one here now", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = [sorted(tuple(r) for r in dict(P.STAGES)["MinHash near-dedup"](spark, docs.repartition(n), SF).collect()) for n in (1, 4)]
    assert kept[0] == kept[1] and [r[:2] for r in kept[0]] == [(1, "a second text of it"), (2, "another one here now")]


def test_scratch_tables_go(spark, tmp_path):
    from pathlib import Path

    from quarrystone.llm import shared

    with shared.scratch(spark) as keep:
        shared.written(spark.range(3), "t")
        out = keep(spark.range(5), "kept")
    folder = Path(shared.shared_dir(spark).removeprefix("file:")) / "quarrystone"
    assert out.count() == 5 and not list(folder.glob("scratch-*"))


def test_pipeline_on_odd_rows(spark, odd_docs, no_docs):
    import corpus_pipeline as P

    clashing = odd_docs.selectExpr("*", "1 AS key", "2 AS times", "3 AS stays", "4 AS gone_id", "5 AS row", "6 AS edit", "7 AS words_sha", "8 AS mixed")
    for docs in (odd_docs, no_docs, odd_docs.unionByName(odd_docs), clashing):
        for _, stage in P.STAGES:
            docs = P.written(stage(spark, docs, SF), "t")
        ids = [r["doc_id"] for r in docs.collect() if r["doc_id"] is not None]
        assert len(ids) == len(set(ids))
    assert near_dedup.THRESHOLD_PERCENT == 75
