"""A training corpus from `documents` in five stages, each one of the operators of cellgrid.llm over all that is left.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents; the last one adds where each
document goes. The driver writes a stage's rows as Parquet and reads them again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellgrid.llm import jaccard_join, mixing, quality_gam, ring_shards, template_decon
from cellgrid.llm.common import in_few_parts, table, written

SHARDS = 24
#: Near duplicates: five words and a similarity of 0.8.
NEAR = jaccard_join.Jaccard(words=5, num=80, den=100)
#: Rows of an Arrow batch.
BATCH_ROWS = 1024
#: Each document is used once at most, and the mixture draws this share of the tokens that are left.
MIX = mixing.Mixture(budget_percent=90, max_epochs=1)


def _small_batches(spark: SparkSession) -> None:
    """Texts go to Python and back a few MB at a time. With Spark's 10,000 rows a task's whole texts are one batch, held by the executor and its worker at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go (op 6); it learns from the labels outside the held-out fold."""
    _small_batches(spark)
    return in_few_parts(quality_gam.keep_good(docs, quality_gam.learn(docs, table(spark, sf_dir, "labels"))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id (op 5)."""
    _small_batches(spark)
    return in_few_parts(jaccard_join.one_of_each(docs, NEAR))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat a benchmark item go (op 7)."""
    _small_batches(spark)
    return in_few_parts(template_decon.without_leaks(docs, table(spark, sf_dir, "benchmark")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the budget of their domain, language and source draws stay (op 1); one that it draws in part stays whole."""
    return in_few_parts(mixing.drawn(docs, MIX))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's shard and its place there (op 3), beside what it holds."""
    return in_few_parts(ring_shards.with_shards(docs, SHARDS))


STAGES = [("quality", quality), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("shards", shards)]

#: The classifier and the components of near duplicates are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the rows of the last one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir).select("doc_id", "lang", "source", "n_chars", "size", "text_crc32", "shard", "slot")
