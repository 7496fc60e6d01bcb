"""From raw documents to packed training sequences: five stages, each written and read again.

All stages: null texts and empty ones are defined below, very long texts are
handled whole by one task each, of tied or repeated rows each gets the result its
own values give it, empty tables give empty tables, and columns beside those of
`documents` pass through, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlight.llm.common import remove_folder, replace_columns, shared_folder, table
from lotlight.llm.line_dedup import line_dedup
from lotlight.llm.near_texts import near_texts
from lotlight.llm.packing import pack
from lotlight.llm.pii import mask_pii
from lotlight.llm.quality_rules import quality_rules
from lotlight.llm.tokenizer_files import byte_bpe_files


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; a null or empty text has no words and goes."""
    return quality_rules(docs).where("kept").select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that spread over sites; a null text stays null, one of such lines alone becomes empty."""
    out = line_dedup(docs)
    return replace_columns(out, {"text": F.col("clean_text"), "n_chars": F.length("clean_text")}, docs)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of each near-duplicate group that has the least id; texts without words, null ones too, are one group.

    Of rows that share an id one stays, that whose text is judged: the least MD5, then the least hash of the other columns.
    Rows without an id stay, as nothing tells them apart.
    """
    keep = near_texts(docs).where(F.col("doc_id") == F.col("component_id")).select("doc_id")
    kept = docs.join(keep, "doc_id", "left_semi")
    plain = [F.col(f"`{c}`") for c, kind in docs.dtypes if not kind.startswith("map")]
    order = F.struct(F.md5(F.coalesce("text", F.lit(""))), F.xxhash64(*plain))
    one = kept.groupBy("doc_id").agg(F.min_by(F.struct([F.col(f"`{c}`") for c in docs.columns]), order).alias("row"))
    return one.select([F.col("row").getField(c).alias(c) for c in docs.columns]).unionByName(docs.where(F.col("doc_id").isNull()))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked; a null text stays null."""
    out = mask_pii(docs)
    return replace_columns(out, {"n_chars": F.length("text")}, docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two sequences of token ids; a null or empty text has its end id alone."""
    out = pack(docs, *byte_bpe_files())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "ids", "doc_tokens", "sequence_id", "offset", "bucket")


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", copies), ("personal data", personal_data), ("packing", sequences)]

#: Fingerprints and token ids are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what lies between them is Parquet in the shared checkpoint folder, the last of it stays for the result."""
    where = shared_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{k}")
        docs = spark.read.parquet(f"{where}/{k}")
        if k:
            remove_folder(spark, f"{where}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
