"""The pipeline against its stages' rules, and the queries against their SQL."""

import corpus_pipeline
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard, registry, secrets


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, DATA)
        kept = spark.createDataFrame(kept.collect(), docs.schema)
        assert kept.columns == docs.columns and 0 < kept.count() <= before.count()
        assert kept.select("doc_id").subtract(before.select("doc_id")).count() == 0
    assert jaccard.jaccard_components(kept).filter("doc_id <> component_id").count() == 0
    assert decontaminate.find_overlaps(kept, spark.read.parquet(f"{DATA}/benchmark.parquet")).count() == 0
    assert secrets.find_secrets(kept, secrets.trained_on(kept)).filter("n_hex > 0 OR n_access > 0").count() == 0
    mix = corpus_pipeline.STAGES[-1][1](spark, kept, DATA)
    assert mix.count() == kept.count()
    by_source = mix.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("longest")).collect()
    assert all(abs(r["taken"] - r["target"]) <= r["longest"] for r in by_source)


def test_one_row_of_each_class_stays(spark):
    rows = [(1, "a b c d e", "en", "s", 9), (1, "a b c d e", "en", "s", 9), (2, "A b c d e", "en", "s", 9), (3, "other words stand here now", "en", "s", 26), (3, "and a different text", "en", "s", 20)]
    rows += [(None, "a b c d e", "en", "s", 9), (None, "only without an id", "en", "s", 18), (None, "only without an id", "en", "s", 18), (4, None, "en", "s", 0), (4, "", "en", "s", 0), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("digest", F.lit(1)).withColumn("class", F.lit("x"))
    got = corpus_pipeline.drop_near_copies(spark, df, DATA)
    assert got.columns == df.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str)
    assert kept == sorted([(1, "a b c d e"), (3, "other words stand here now"), (3, "and a different text"), (None, "only without an id"), (4, None), (4, ""), (None, None)], key=str)
    assert corpus_pipeline.drop_near_copies(spark, df.limit(0), DATA).count() == 0


def test_near_copies_link_from_four_fifths_of_five_word_shingles(spark):
    def spoiled(doc, places):
        return " ".join("x" if j in places else f"d{doc}w{j}" for j in range(100))

    # two changed words: 86 of 106 shingles of five words (0.811), but 89 of 105 of four (0.848); three: 81 of 111 (0.730)
    texts = {1: spoiled(1, []), 2: spoiled(1, [30, 60]), 3: spoiled(3, []), 4: spoiled(3, [30, 50, 70])}
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, DATA).collect()) == [1, 3, 4]


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    expected = duck.execute(registry.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    rows = lambda df: sorted(map(str, df[columns].itertuples(index=False, name=None)))
    assert rows(got) == rows(expected)
