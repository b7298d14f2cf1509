"""Corpus preparation as stages, each written as Parquet and read again as the next one's documents.

Every stage keeps the columns it gets, however they are called, and gives no rows for an empty
table. Repeated rows are judged one by one, but for ``near_duplicates``, to which rows of one id are
one document. A text is one row in one task in all stages but the last, which cuts long ones.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, neardup, pseudonyms, quality, sentencepieces
from plumbline.llm.common import col, fresh, quoted, read_table
from plumbline.llm.queries import QUERY_KEY, tokenizer
from plumbline.plans.small import written


#: The tokenizer's states that a worker holds here, and only while its task runs: idle workers and earlier stages need the rest.
STATES = 60_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and look like their language.

    Null and empty texts have no words and go; a null language is judged by letters of any script.
    """
    verdict = fresh(docs, "verdict")
    judged = quality.quality(docs, into=verdict)
    return judged.where(f"{quoted(verdict)}.kept").select(*map(col, docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near-copies; rows without an id stay.

    Null texts and texts without words are like nothing and stay. Of rows that share an id, which are one document, the one with the least text stays.
    """
    found = written(neardup.near_duplicates(docs, percent=neardup.LEAST_PERCENT), "near-duplicates")
    names = [col(c) for c in docs.columns]
    gone = found.where(~F.col("kept")).select(F.col("id").alias("doc_id")).distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*names)
    repeated = found.where("id is not null").groupBy(F.col("id").alias("doc_id")).agg(F.count(F.lit(1)).alias("k"))
    repeated = written(repeated.where("k > 1").select("doc_id"), "repeated-ids")
    if repeated.isEmpty():
        return kept
    one = kept.join(repeated, "doc_id", "left_semi").select(*names)
    least = one.groupBy("doc_id").agg(F.min_by(F.struct(*names), F.col("text")).alias("row"), F.first(F.struct(*names)).alias("any"))
    row = F.coalesce("row", "any")
    one = least.select(row.alias("row")).select(*(F.col("row")[c].alias(c) for c in docs.columns))
    return kept.join(repeated, "doc_id", "left_anti").select(*names).unionByName(one)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word of a benchmark passage; null and empty texts have none and stay."""
    found = fresh(docs, "found")
    marked = decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"), into=found)
    return marked.where(f"size({quoted(found)}.spans) = 0").select(*map(col, docs.columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal values replaced by pseudonyms; ``n_chars`` follows where it was the text's length.

    Null texts stay null, empty ones empty. ``PLUMBLINE_KEY`` holds the secret key; without it the key of the registered query is used.
    """
    before = fresh(docs, "before")
    sized = docs.withColumn(before, F.length("text"))
    out = pseudonyms.pseudonymise(sized, os.environ.get("PLUMBLINE_KEY", QUERY_KEY))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new = F.when(F.col("n_chars") == F.col(before), F.length("text").cast(kind)).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", new)
    return out.select(*map(col, docs.columns))


def sentencepiece_codes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, how many there are, and whether decoding them gives the text back.

    Null texts have null ids, no tokens, and are given back; empty texts have no ids. The new columns
    are ``ids``, ``n_tokens`` and ``round_trip``, lengthened by ``_`` where a document has such a column.
    """
    ids, back = fresh(docs, "ids"), fresh(docs, "decoded")
    coded = sentencepieces.encode(docs, tokenizer(), into=ids, decoded=back, states=STATES, held=False)
    same = col(back).eqNullSafe(F.regexp_replace("text", "▁", " "))
    n, trip = fresh(docs, "n_tokens"), fresh(docs, "round_trip")
    return coded.withColumns({n: F.coalesce(F.size(ids), F.lit(0)).cast("long"), trip: same}).drop(back)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("sentencepiece_codes", sentencepiece_codes),
]

#: The stages learn references from the corpus and run a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the given documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
