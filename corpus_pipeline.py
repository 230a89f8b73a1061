"""From raw documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the columns
of documents. Between stages the rows are written as Parquet and read again, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm import decontamination, langid, neardup, packing, pii
from quillrank.llm.storage import Scratch, bounded

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOKENIZER, END_ID = "word_bpe_49k.json", 2
#: Documents whose main language has less than this share of their n-grams are rejected.
LEAST_SHARE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without text or letters and those without a main language; the model learns from docs' own labels.

    lang stays as it is where it was given, and is filled by the prediction where it was null. A null or empty text has no letters and goes. Rows are judged one by
    one: repeated rows and rows without a doc_id stay or go by their own text. Without any labelled row nothing can be told and all rows go. Other
    columns are left out, whatever their names; an empty table stays empty.
    """
    found = langid.identify_by_own_labels(docs)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near-duplicates (five-word shingles, similarity 0.8).

    Rows that repeat a doc_id with the same text are copies as well: one of them stays. A doc_id with several texts counts as one document, and its texts stay or
    go together. Rows without a doc_id, and documents without words (null texts included), are copies of nothing and stay. An empty table stays empty.
    """
    found = neardup.near_duplicates(docs, Scratch(spark, "pipeline-near"), percent=80, k=5)
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    kept = docs.join(bounded(gone), "doc_id", "left_anti").select(*COLUMNS)
    repeated = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    again = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, "doc_id", "left_anti").unionByName(again)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, each row by its own text; null and empty texts, and all rows where there is no benchmark, stay."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.clean_documents(docs, benchmark, Scratch(spark, "pipeline-leaks")).select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by the names of their kinds and counts n_chars anew; keeps all rows.

    A null text stays null, with null n_chars. Repeated rows stay repeated.
    """
    clean = pii.redact(pii.find_pii(docs.select(*COLUMNS))).drop("pii")
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the documents into sequences of power-of-two lengths; one row per sequence, with its ids.

    A null or empty text gives one sequence, its end id. Repeated rows and rows without a doc_id are packed like any others; no document gives no sequence.
    """
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), END_ID, Scratch(spark, "pipeline-pack"))


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("redact", redact),
    ("pack", pack),
]
#: Expectation-maximisation and the tokenizer have no SQL form; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents one after the other, each on the written rows of the one before."""
    scratch = Scratch(spark, "pipeline")
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs, old = scratch.save(docs, name), last
            last = docs
            if old is not None:
                scratch.drop(old)
    return docs
