"""From raw documents to a weighted training mix, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; its result is written as Parquet and read again as the next one's
docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard, mixing, quality, secrets
from tessera.llm.common import small, table, written

#: Near copies share this many hundredths of their shingles of so many words; op5's own values bind op5 alone.
NEAR_WORDS, NEAR_SIMILARITY = 5, 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents inside the border of the labelled good ones; null and empty texts stay."""
    _, keep = quality.select_quality(docs, table(spark, sf_dir, "labels"))
    return keep(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class: that with the lowest id (rows without
    an id come last), of equal ids that with the lowest hash of its text. Rows
    that agree in id and text are one document. Rows without words stay.
    """
    found = written(jaccard.jaccard_classes(docs, n=NEAR_WORDS, similarity=NEAR_SIMILARITY).filter("n_shingles > 0"), "near-classes")
    kept = found.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("first"), F.count(F.lit(1)).alias("rows"))
    kept = written(kept.filter("rows > 1").select("class", F.col("first.doc_id").alias("kept_id"), F.col("first.digest").alias("kept_digest")), "near-kept")
    ours = found.join(kept, "class").select("doc_id", "digest", (F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest"))).alias("is_kept"))
    ours = written(ours.groupBy("doc_id", "digest", "is_kept").count().filter("NOT is_kept OR count > 1"), "near-copies")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("text").alias("digest"))
    marked = ours.select(F.col("doc_id").alias("marked_id"), F.col("digest").alias("marked"), "is_kept")
    same = (F.col("digest") == F.col("marked")) & F.col("row.doc_id").cast("long").eqNullSafe(F.col("marked_id"))
    once = rows.join(small(marked.filter("is_kept")), same, "left_semi")
    once = once.groupBy("digest", F.col("row.doc_id").alias("own_id")).agg(F.min("row").alias("row"))
    return rows.join(small(marked), same, "left_anti").select("row.*").unionByName(once.select("row.*"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item; rows without an id or a text stay."""
    return decontaminate.without_overlaps(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a sign; null and empty texts stay as they are."""
    return secrets.without_secrets(docs, secrets.trained_on(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document; null and empty texts are taken 0 times."""
    return mixing.mix(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("benchmark", drop_benchmark_leaks),
    ("secrets", mask_secrets),
    ("mix", mix_sources),
]

#: Gumbel noise and pivotal draws have no SQL form; tests check each stage's rules instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
