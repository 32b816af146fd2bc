"""Nothing is cut by a share, a prefix or the order of arrival."""

import numpy as np
from pyspark.sql import functions as F

from tidewarden.llm import hilbert, mixing, quality_model


def test_a_corpus_that_meets_its_targets_is_kept_whole(spark):
    tokens = np.full((2, 2, 2), 10.0)
    take, weights = mixing.raked_pair(tokens, [np.array([0.5, 0.5])] * 3, 1.0)
    assert np.allclose(take, tokens) and np.allclose(weights, tokens)
    rows = [(k, "one two three", "en" if k % 2 else "de", "a" if k // 2 % 2 else "b", 13) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = mixing.mixture(docs, {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.5, "de": 0.5}}).collect()
    assert all(r["selected"] and r["probability"] == 1.0 for r in found)


def test_names_are_ranked_whole(spark):
    names = [f"commoncrawl-{2020 + k}" for k in range(4)]
    rows = [(k, "x" * (k % 50), "en", names[k % 4], 1) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    steps = {r["source"]: r["step"] for r in hilbert._value_steps(docs.select("source"), "source").collect()}
    assert [steps[n] for n in names] == [0, 4, 8, 12]
    cells = hilbert.placed(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("cell").agg(F.count_distinct("source").alias("n"))
    assert cells.filter("n > 1").isEmpty()


def test_copies_without_an_id_are_spread(spark):
    rows = [(None if k % 3 else k, "the same text", "en", "s", 13) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    placed = hilbert.placed(docs)
    assert placed.filter("doc_id is null").select("h").distinct().count() == 2000
    counts = hilbert.sharded(docs, 7).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last"), F.count_distinct("slot").alias("slots")).collect()
    assert max(r["n"] for r in counts) - min(r["n"] for r in counts) <= 1 and all(r["n"] == r["last"] + 1 == r["slots"] for r in counts)


def test_repeated_labels_give_the_same_scores_twice(spark, folder, monkeypatch):
    monkeypatch.setattr(quality_model, "MAX_LABELLED", 25)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    several = labels.unionByName(labels).unionByName(labels.withColumn("quality", 1 - F.col("quality")))
    once, again = ({r["doc_id"]: r["score"] for r in quality_model.quality_scores(docs, several.repartition(n)).collect()} for n in (2, 7))
    assert once == again
