"""Stages on planted cases, and the whole pipeline."""

import random

import corpus_pipeline
from tests.llm.conftest import DOCUMENTS, SF
from tests.llm.test_sharding_packing import check_packs


def text(seed, n=120):
    rng = random.Random(seed)
    words = [rng.choice("ka lo mi ne su ta ri po".split()) + str(rng.randint(0, 400)) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 20]).capitalize() + "." for i in range(0, n, 20))


def documents(spark):
    shared = text(999, 60).replace("\n", " ")
    line = "Subscribe to our letter for more stories like this"
    rows = [(i, text(i)) for i in range(20)]
    rows += [(100, text(3)), (101, text(5).replace("ka", "KA", 1)), (102, text(50) + "\n" + shared), (103, text(51) + "\n" + shared)]
    rows += [(110 + i, text(60 + i) + "\n" + line) for i in range(4)]
    rows += [(200, ""), (201, None), (None, text(70))]
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCUMENTS).repartition(3)


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "substring dedup", "packing"]


def test_decisions_take_effect(spark):
    docs = documents(spark)
    lines = corpus_pipeline.without_repeated_lines(spark, docs, SF)
    assert lines.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in lines.collect()}
    assert [i for i in range(110, 114) if "Subscribe" in texts[i]] == [113]
    one = corpus_pipeline.without_near_copies(spark, docs, SF)
    kept = {r["doc_id"] for r in one.collect()}
    assert not kept & {100, 101, 201} and kept >= {*range(20), 102, 103, 110, 111, 112, 113, 200, None}
    passages = corpus_pipeline.without_repeated_passages(spark, docs, SF)
    texts = {r["doc_id"]: r["text"] for r in passages.collect()}
    assert texts[102] == text(50) + "\n" + text(999, 60).replace("\n", " ")
    assert texts[103].split() == text(51).split()
    assert texts[7] == text(7)
    for r in passages.collect():
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))


def test_stages_take_odd_and_no_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            rows = out.collect()
            if name != "packing":
                assert out.columns == docs.columns
            if name == "line dedup":
                assert len(rows) == docs.count()
            if docs is no_docs:
                assert rows == []


def test_whole_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows
    check_packs(rows, 1024)
    good = {r["doc_id"] for r in corpus_pipeline.good_documents(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()}
    assert {r["doc_id"] for r in rows} <= good
