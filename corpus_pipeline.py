"""The corpus pipeline: toxicity, quality classifier, n-gram Jaccard join, best-fit packing.

Every stage but the last returns the columns of documents for the rows that it keeps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolane.llm import common, jaccard, packing, resample, toxicity
from astrolane.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold of op6, fitted on these documents' labelled rows.

    Null and empty texts have the score that no term speaks for; equal scores and repeated rows fare alike; an empty
    table stays empty.
    """
    scored = toxicity.classify(docs, common.table(spark, sf_dir, "labels"), keep=COLUMNS)
    return scored.where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def draw_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that importance resampling draws.

    Null and empty texts weigh nothing for or against; rows whose key ties with the last one drawn stay with it, so
    repeated rows fare alike; an empty table stays empty.
    """
    drawn = resample.resample(docs, common.table(spark, sf_dir, "labels"), keep=COLUMNS)
    return drawn.select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shingle links join: the one with the smallest id.

    Documents without words link with nothing and stay; so do documents without an id.  Of rows that share an id and
    a text one stays, with the least other values; rows that share an id and have other texts are other documents.
    """
    parts = jaccard.similar_documents(docs)
    first = common.staged(parts.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")), "first-of-group")
    kept = docs.join(first.where("rows = 1").select("doc_id"), "doc_id", "left_semi").select(*COLUMNS)
    shared = first.where("rows > 1").select("doc_id")
    if shared.limit(1).count():
        others = [c for c in COLUMNS if c not in ("doc_id", "text")]
        same = docs.join(shared, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("least"))
        kept = kept.union(same.select("doc_id", "text", *(f"least.{c}" for c in others)).select(*COLUMNS))
    return kept.union(docs.where("doc_id is null").select(*COLUMNS))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all remaining documents with their places in 2048-token sequences.

    A null or empty text is one piece of the end alone; every row is a document; an empty table has no pieces.
    """
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("quality classifier", draw_quality), ("n-gram Jaccard join", drop_near_copies), ("best-fit packing", best_fit_packing)]

ORACLE_SQL = None  # the classifiers cannot be expressed in SQL; tests/llm compares with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, spent = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if spent is not None:
            common.discard(spent)  # the next stage's rows are written
        spent = docs
        common.release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
