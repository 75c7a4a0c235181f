"""The pipeline: each stage on small tables with planted cases, and the whole against its parts."""

import random

import pytest

import corpus_pipeline
from crease.llm import packing, queries

SMALL = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def with_odd_rows(spark, documents):
    odd = [(90_001, None, None, None, None), (90_002, "", "en", "s", 0), (90_003, "12 34 %%%", "en", "s", 9),
           (None, "Was the of and in thing that", None, None, 3), (None, "12 %%", None, None, 3)]
    return documents.limit(40).unionByName(spark.createDataFrame(odd, documents.schema))


def test_language_stage_drops_what_has_no_language(spark, documents):
    docs = with_odd_rows(spark, documents)
    kept = corpus_pipeline.by_language(spark, docs, SMALL)
    assert kept.columns == COLUMNS
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert not {90_001, 90_002, 90_003} & set(ids) and ids.count(None) == 1 and len(ids) == 41


def test_rows_of_one_id_are_judged_one_by_one(spark, documents):
    good = documents.orderBy("doc_id").first()
    rows = [(77, good.text, None, None, None), (77, "12 34 %%%", None, None, None), (78, good.text, None, None, None)]
    kept = corpus_pipeline.by_language(spark, spark.createDataFrame(rows, documents.schema), SMALL).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(77, good.text), (78, good.text)]


def test_quality_stage_keeps_clean_documents(spark, documents):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = corpus_pipeline.by_quality(spark, documents, SMALL)
    assert kept.columns == COLUMNS
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    clean = [i for i, q in labels.items() if q == 1]
    junk = [i for i, q in labels.items() if q == 0]
    assert sum(i in ids for i in clean) >= 0.99 * len(clean) and sum(i in ids for i in junk) <= 0.1 * len(junk)


def test_near_duplicate_stage_leaves_one_of_each_group(spark, documents):
    r = random.Random(7)
    words = [f"word{i}" for i in range(500)]
    base = r.choices(words, k=300)
    near = base[:150] + ["changed"] + base[151:]
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(near)), (4, " ".join(r.choices(words, k=300))),
            (5, None), (6, ""), (7, "twice the same row of one id"), (7, "twice the same row of one id"),
            (8, "one id on two texts, the first"), (8, "and here is quite another text of that id"),
            (8, " ".join(near)), (None, " ".join(base)), (None, "a text of its own without an id")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], documents.schema)
    kept = corpus_pipeline.without_near_duplicates(spark, docs, SMALL)
    assert kept.columns == COLUMNS
    assert sorted(str(x.doc_id) for x in kept.select("doc_id").collect()) == ["1", "4", "5", "6", "7", "8", "8", "None"]
    assert {x.text for x in kept.where("doc_id = 8 OR doc_id IS NULL").collect()} == {rows[8][1], rows[9][1], rows[12][1]}
    assert corpus_pipeline.without_near_duplicates(spark, docs.limit(0), SMALL).count() == 0


def test_stages_pass_on_columns_they_do_not_know(spark, documents):
    more = documents.limit(5).selectExpr("*", "1 AS kept", "'x' AS score", "2 AS component_id")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, more, SMALL).columns == more.columns


def test_run_equals_its_stages(spark, documents):
    found = corpus_pipeline.run(spark, SMALL).collect()
    docs = documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.doc_id for r in found} == kept and len(kept) < documents.count()
    for doc_id in list(kept)[:20]:
        pieces = sorted((r.start, r.length) for r in found if r.doc_id == doc_id)
        assert pieces == packing.decompose(next(r.doc_tokens for r in found if r.doc_id == doc_id))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "packing"]
    assert len(queries.QUERIES) == 13
