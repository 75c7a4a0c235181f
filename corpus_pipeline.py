"""The corpus pipeline: documents by language, quality, near-duplicate removal and packing.

Each stage is ``function(spark, docs, sf_dir) -> DataFrame`` over all that its predecessor kept; it is written as
Parquet and reread as the next one's ``docs``.  All but the last return the columns of documents.

Rows are judged, not ids: a row whose id is null, or is that of other rows too, goes by a number made of its id and text
(``by_row``), so it is kept or rejected for its own text.  Such rows share a number only if they are equal in both.
Other defined cases are those of the operators; columns of ``docs`` that a stage does not know are passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crease.llm import langid, minhash, quality, queries
from crease.llm.storage import filter_by_ids, materialise, scan, shared_folder, small_enough

#: A document is rejected if no language has this share of it.
LEAST_SHARE = 0.4
#: A document is rejected if label 1 is less likely than this.
LEAST_QUALITY = 0.5
#: Numbers of rows without an id of their own begin here, above ids.
MADE = 1 << 62
ROW = "__row"


def by_row(docs: DataFrame) -> DataFrame:
    """``docs`` with ``ROW``: the id, where no other row has it."""
    doc_id = F.col("doc_id").cast("long")
    repeated = materialise(docs.where("doc_id IS NOT NULL").groupBy(doc_id.alias("again")).agg(F.count("*").alias("n"))
                           .where("n > 1").select("again"), "repeated")
    made = F.lit(MADE) + F.pmod(F.xxhash64("doc_id", "text"), F.lit(MADE))
    if repeated.isEmpty():
        return docs.withColumn(ROW, F.coalesce(doc_id, made))
    side = F.broadcast(repeated) if small_enough(repeated) else repeated
    found = docs.join(side, doc_id == F.col("again"), "left")
    return found.withColumn(ROW, F.when(F.col("again").isNull() & doc_id.isNotNull(), doc_id).otherwise(made)).drop("again")


def judged(rows: DataFrame) -> DataFrame:
    """What the operators read."""
    return rows.select(F.col(ROW).alias("doc_id"), "text")


def without(rows: DataFrame, rejected: DataFrame, tag: str) -> DataFrame:
    """``rows`` but for the rejected numbers (``doc_id``).  These are a small part of a corpus, so only they move."""
    ids = materialise(rejected.select(F.col("doc_id").alias(ROW)).distinct(), tag)
    return filter_by_ids(rows, ids, ROW, "left_anti")


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no letter, or none with a share of ``LEAST_SHARE``) go.  The models are learned
    from all labelled documents of the corpus but the held-out fold."""
    rows = by_row(docs)
    found = langid.predict_languages(judged(rows), queries.learn_languages(spark, sf_dir))
    rejected = found.where((F.col("lang_pred") == langid.UNDETERMINED) | (F.col("score") < LEAST_SHARE))
    return without(rows, rejected, "language").select(*docs.columns)


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under ``LEAST_QUALITY`` go."""
    rows = by_row(docs)
    scored = quality.score_quality(judged(rows), queries.learn_quality(spark, sf_dir))
    return without(rows, scored.where(F.col("score") < LEAST_QUALITY), "quality").select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with shingles of five words and a similarity of 0.8 or more, the smallest number stays.
    Of rows with equal id and text one stays."""
    rows = by_row(docs)
    found = materialise(minhash.near_documents(judged(rows), n_words=5).select("doc_id", "kept"), "near")
    single = without(rows, found.where(~F.col("kept")), "copies")
    equal = materialise(found.where(F.col("kept") & (F.col("doc_id") >= MADE)).groupBy("doc_id")
                        .agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(ROW)), "equal")
    if not equal.isEmpty():
        single = filter_by_ids(single, equal, ROW, "left_anti").unionByName(
            filter_by_ids(single, equal, ROW).dropDuplicates([ROW]))
    return single.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their ids."""
    return queries.pack_documents(docs, keep_ids=True)


STAGES = [("language", by_language), ("quality", by_quality), ("near_duplicates", without_near_duplicates),
          ("packing", packed)]

#: SQL cannot express learned models or a tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = scan(spark, sf_dir, "documents", ["*"])
    folder = shared_folder(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
