"""Every stage of the pipeline, and all of them in turn, on rows that tables should not hold but do."""

import sys

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

import corpus_pipeline

STAGES = dict(corpus_pipeline.STAGES)
SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows(spark):
    """Real documents, one with a clean text under a null id, and nulls, empty and white texts, repeats, one very long text."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    some = docs.select("text").limit(40).collect()
    rng = np.random.default_rng(1)
    long = " ".join(f"w{i}" for i in rng.integers(0, 5000, 60_000))
    rows = [(10_000 + i, r["text"], "en", "s", 5) for i, r in enumerate(some)]
    rows += [(None, some[0]["text"], "en", None, None), (None, None, None, None, None), (1, None, "en", "s", 0), (1, "", "en", "s", 0), (2, " \t\n", None, "s", 3), (3, long, "en", None, 9), (3, long, "en", None, 9), (4, "one two", "en", "t", 7), (4, "one two", "en", "t", 7), (5, "one", "de", "t", 3)]
    return spark.createDataFrame(rows, SHAPE)


@pytest.fixture(scope="module")
def odd(spark):
    return odd_rows(spark).cache()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_take_odd_rows_and_keep_the_columns(spark, odd, name):
    out = STAGES[name](spark, odd, DATA)
    assert out.columns == odd.columns and dict(out.dtypes) == dict(odd.dtypes)
    kept = out.collect()
    if name == "secrets":
        assert len(kept) == odd.count() and {(r["doc_id"], r["source"]) for r in kept} == {(r["doc_id"], r["source"]) for r in odd.collect()}
    else:
        before = [tuple(r) for r in odd.collect()]
        assert all(tuple(r) in before for r in kept)
        assert sum(r["text"] is None for r in kept) == 2 or name == "near_copies"
    if name == "near_copies":
        assert sum(r["doc_id"] == 4 for r in kept) == 1 and sum(r["doc_id"] == 3 for r in kept) == 1


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_take_no_rows_and_clashing_columns(spark, odd, name):
    none = odd.limit(0)
    assert STAGES[name](spark, none, DATA).count() == 0
    clashing = odd.select("*", *[F.lit(i).alias(c) for i, c in enumerate(("class", "digest", "kept_id", "is_kept", "row", "leak_id", "item_id", "size", "taken", "marked", "spans", "score"))])
    out = STAGES[name](spark, clashing, DATA)
    assert out.count() >= 0
    if name != "mix":
        assert out.columns == clashing.columns


def test_mix_of_odd_rows(spark, odd):
    out = STAGES["mix"](spark, odd, DATA).collect()
    assert len(out) == odd.count() and all(r["taken"] <= 3 * r["size"] for r in out)


def test_run_applies_every_stage_to_what_the_one_before_kept(spark, odd, tmp_path):
    """All stages over a folder of odd documents: the same rows as stage by stage."""
    import os

    for table in ("labels", "benchmark"):
        os.symlink(f"{DATA}/{table}.parquet", tmp_path / f"{table}.parquet")
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    whole = corpus_pipeline.run(spark, str(tmp_path))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), "stage")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(whole) == rows(docs) and 0 < whole.count() < odd.count()


def test_entry_lives_without_the_training_part(monkeypatch):
    import __spark_entry__

    monkeypatch.setitem(sys.modules, "tessera.llm.registry", None)
    names = __spark_entry__.queries()
    assert "q_scan_bits" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
    assert not any(n.startswith("op") for n in __spark_entry__.oracle_sql())
