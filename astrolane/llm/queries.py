"""One query per operator, at production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import THRESHOLD, classify, held_out

    scored = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resample import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import similar_documents

    return similar_documents(table(spark, sf_dir, "documents"))


def op10_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .katz import score_texts
    from .toxicity import held_out

    scored = score_texts(table(spark, sf_dir, "documents"), ~held_out(parts=5))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .webp import digests, read_media, store_texts

    return digests(read_media(store_texts(table(spark, sf_dir, "documents"))))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive, read_archives

    read = read_archives(archive(table(spark, sf_dir, "pages")))
    return read.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .spm import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op2_token_id_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .coder import read_ids, write_ids

    return read_ids(write_ids(table(spark, sf_dir, "documents"), tokenizer_path())).select("doc_id", "start", "n_tokens", "ids_crc32")


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_PAGES = "(SELECT page_id, coalesce(html, '') AS payload, sha256(coalesce(html, '')) AS digest FROM pages)"
_FIRST = f"(SELECT digest, min(page_id) AS first FROM {_PAGES} WHERE octet_length(encode(payload)) >= 100 AND page_id IS NOT NULL GROUP BY digest)"


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": f"SELECT page_id, octet_length(encode(payload)) AS payload_bytes, p.digest AS payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM {_PAGES} p LEFT JOIN {_FIRST} f ON p.digest = f.digest"}
