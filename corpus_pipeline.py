"""The corpus pipeline: quality, line dedup, near duplicates, mixing, encoding.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents.  Stage 4 gives the training order: its files hold the blocks of the mix one after
the other, each in its permutation, and a document stands there once for each pass that uses it.

Defined cases: a null text is empty, and the classifier rejects empty texts; a null id, language or source is a value of its own.  Of rows of equal id and text
the near-duplicate stage keeps one; of a group of near duplicates it keeps the least id.  Columns beyond those of documents are handed on, whatever their names.
No documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnlog.llm.chosen_path import one_of_each
from kilnlog.llm.common import carried, materialise, new_path, restored, scratch, small_side, table
from kilnlog.llm.line_dedup import dedup_lines
from kilnlog.llm.mixing import mix_sources
from kilnlog.llm.quality import keep_good, trusted_ids
from kilnlog.llm.sentencepiece_scan import default_model, encode_documents

#: No source is read more than this often; the budget is the least at which every document is used.
MAX_REPETITION = 2.0


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(spark, docs, trusted_ids(table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more lose all but their first occurrence; n_chars follows the text."""
    kept = dedup_lines(spark, docs, min_docs=10, min_chars=1, keep="first")
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the least id."""
    return one_of_each(spark, docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows in the order of the mix, by block and position; each document as often as the passes over its source use it, at least once."""
    order = mix_sources(spark, docs, max_repetition=MAX_REPETITION, cover=True)
    order = materialise(spark, order.select(F.col("doc_id").alias("_mix_id"), F.col("source").alias("_mix_source"), F.col("block_id").alias("_block"), F.col("position").alias("_position")), "mix-order")
    n_blocks = (order.agg(F.max("_block")).first()[0] or 0) + 1
    parts = min(n_blocks, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = carried(docs, _id=F.col("doc_id"), _source=F.col("source"))
    used = rows.join(small_side(order, 96), F.col("_id").eqNullSafe(F.col("_mix_id")) & F.col("_source").eqNullSafe(F.col("_mix_source")))
    part = F.floor(F.col("_block") * parts / n_blocks).cast("int")
    return restored(used.repartitionById(parts, part).sortWithinPartitions("_block", "_position"), docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids) of every row."""
    coded = encode_documents(spark, docs.select("doc_id", "text"), default_model())
    return coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]

#: Training, chosen paths and encoding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other; what a stage writes besides its result goes when the result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
