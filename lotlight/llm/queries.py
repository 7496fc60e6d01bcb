"""The registered queries of this subpackage, one per operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlight.llm import line_dedup as lines
from lotlight.llm import bpe, packing, pii, quality_classifier, quality_rules, simhash, spotsigs, sql, substring_dedup, warc
from lotlight.llm.common import remove_folder, shared_folder, table
from lotlight.llm.tokenizer_files import byte_bpe_files, word_bpe_file


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.line_dedup(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.coalesce(F.length("clean_text"), F.lit(0)).cast("long").alias("clean_chars"), F.md5(F.coalesce("clean_text", F.lit(""))).alias("clean_md5"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.with_digests(substring_dedup.substring_dedup(table(spark, sf_dir, "documents", "doc_id", "text")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"), *byte_bpe_files())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "source", "lang", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.classify(docs, labels, host=F.col("source"), path=F.col("lang"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.with_digests(pii.find_pii(table(spark, sf_dir, "documents", "doc_id", "text")))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = shared_folder(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), where)
    out = warc.read_archives(spark, where)
    remove_folder(spark, where)  # what is read of it is in checkpoints
    return out


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents", "doc_id", "text"), word_bpe_file())


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spotsigs.fingerprint_with_edits(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.withColumn("edited_text", F.sha2("edited_text", 256)).withColumnRenamed("edited_text", "edited_sha256")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_report(table(spark, sf_dir, "documents", "doc_id", "lang", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_ALL = (op1_line_dedup, op2_substring_dedup, op3_packing, op4_quality_classifier, op5_pii, op6_warc, op7_bpe, op8_simhash, op9_spotsigs, op10_quality_rules, pipeline)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {"op1_line_dedup": sql.LINE_DEDUP, "op6_warc": sql.WARC, "op10_quality_rules": sql.quality_rules()}
