"""From raw documents to packed sequences: language ID, quality rules, exact and near copies, packing.

Every stage gets what its predecessor kept, written as Parquet and read again, and works on all of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vignetta.llm import common, crf_langid, exact_dedup, near_texts, packing, quality, queries

#: Documents whose best language has a lower mean posterior go, as do those without a letter.
MIN_LANGUAGE_SCORE = 0.35


def _filtered(docs: DataFrame, judge, verdict) -> DataFrame:
    """Rows of docs whose verdict holds; their own columns are packed away, so a judge's columns can't clash with them."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    judged = judge(docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *rest).alias("_rest"))).filter(verdict)
    return judged.select(*[F.col("_rest")[c].alias(c) if c in rest else F.col(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a recognised language."""
    model = crf_langid.fit_sample(docs.filter(common.split_of("doc_id", 3) != 1))
    known = (F.col("lang_pred") != crf_langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return _filtered(docs, lambda d: crf_langid.label(d, model), known)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that pass the base rules and the likelihood ratio."""
    return _filtered(docs, lambda d: quality.quality(d, common.table(spark, sf_dir, "labels")), F.col("kept"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of every group of equal texts."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of every group of texts of similarity 0.8 or more."""
    return near_texts.drop_near(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the documents that are left."""
    pieces = packing.pack_documents(docs, queries.tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("packing", pack),
]

#: Trained models and hashes stand in the stages; tests hold the rows against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
