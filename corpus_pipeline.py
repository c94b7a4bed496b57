"""A corpus from raw documents: language ID, near-dedup, secrets masked, sources mixed, packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribewell.llm import langid, mixing, packing, secrets, simhash
from scribewell.llm.common import written
from scribewell.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; those without letters and with narrow margins go, so null and blank texts too.

    Of repeated rows all go or stay; without labelled rows there is no language to find, and all go; an empty table gives an empty one; columns beside COLUMNS go.
    """
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.identify(docs.select(*COLUMNS), model).where(~F.col("rejected")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies.

    Groups are linked by fingerprints of two differing bits or fewer, and by five-word shingles of similarity 0.8 or more. Texts without words are
    copies of each other; of repeated rows one stays; an empty table gives an empty one; columns beside COLUMNS go.
    """
    return simhash.keep_one(docs.select(*COLUMNS), similar=(5, 0.8))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with what was found in their texts masked. Null texts stay null, repeated rows are masked each, and an empty table gives an empty one; columns beside COLUMNS go."""
    found = secrets.update(docs, secrets.new_ledger(spark))
    return secrets.mask(docs.select(*COLUMNS), found).withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's budget takes them; the one in which a budget ends is cut.

    Rows without words, null texts among them, stay once; null is a source of its own; repeated rows share a budget that ends in them; an empty table gives an empty one; columns beside COLUMNS go.
    """
    mixed = written(mixing.mix(docs), "mixed")
    return mixing.take(docs.select(*COLUMNS), mixed).withColumn("n_chars", F.length("text").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place. A null text is the empty one, whose piece is the end id alone; repeated rows are packed each; an empty table gives an empty one."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("language_id", language_id), ("simhash_near_dedup", near_dedup), ("secret_scan", secret_scan), ("mixing", mixture), ("best_fit_packing", packing_stage)]

#: Compression, bit operations, scans by code points and tokenizers are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each one's rows written for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
