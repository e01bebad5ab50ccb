"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrid.llm import byte_bpe, decontamination, divergence, line_dedup, media_source, packing, quality_classifier, quality_rules, simhash, sql, substring_dedup, token_files, toxicity
from lexigrid.llm._shared import documents


def _bpe_digests():
    def run(batches):
        decimal = byte_bpe.Strings([b"%d " % i for i in range(1 << 16)])
        for batch in batches:
            ids, offsets = byte_bpe.id_rows(batch.column(1))
            texts, decoded = decimal.joined_rows(ids, offsets), batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(offsets[1:] - offsets[:-1]),
                    pa.array([hashlib.sha256(x[:-1]).hexdigest() for x in texts], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as audio in archives, read back, with features of the samples."""
    folder, _ = media_source.write_media(documents(spark, sf_dir))
    stored = media_source.read_media(spark, folder).select("doc_id", "media")
    return media_source.decode_media(stored).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents written to coded files, and read back."""
    manifest = token_files.write_ids(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    ids = token_files.read_ids(spark, manifest)
    return ids.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded to ids and decoded again."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = documents(spark, sf_dir).select("doc_id", "text")
    digests = byte_bpe.decoding(path, pattern, T.StructType.fromDDL("doc_id long, ids array<int>"), _bpe_digests)
    return byte_bpe.encode_texts(docs, path, pattern, carry=["doc_id"], then=(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens, piece by piece."""
    pieces = packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the later occurrences of repeated three-line windows removed."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.coalesce("text", F.lit("")).alias("text"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from rows that are not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = quality_classifier.held_out(F.col("doc_id"))
    model = quality_classifier.train(docs, labels, where=~held)
    return quality_classifier.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, rule verdict and posterior of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return quality_rules.judge(docs, carry=("doc_id",)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of near copies of every document."""
    found = simhash.near_groups(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of each toxicity category of every document, by a classifier chain."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    chain = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, chain).select("doc_id", *[f"p_{n}" for n in chain.names], F.col("predicted").alias("toxic"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 20-word windows that start earlier."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return substring_dedup.dedup_substrings(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language lie apart, and the terms that set each of them off."""
    return divergence.audit_sources(documents(spark, sf_dir))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in ten-word windows of benchmark items."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = decontamination.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES = {
    "op3_media": op3_media,
    "op4_token_files": op4_token_files,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_packing": op6_packing,
    "op7_line_dedup": op7_line_dedup,
    "op1_toxicity": op1_toxicity,
    "op2_substring_dedup": op2_substring_dedup,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_quality_rules": op9_quality_rules,
    "op10_simhash": op10_simhash,
    "op11_divergence": op11_divergence,
    "op12_decontamination": op12_decontamination,
}

ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": sql.OP2_SUBSTRING_DEDUP,
    "op7_line_dedup": sql.OP7_LINE_DEDUP,
    "op11_divergence": sql.OP11_DIVERGENCE,
    "op12_decontamination": sql.OP12_DECONTAMINATION,
}
