"""The classifier's training where documents repeat an id."""

from __future__ import annotations

import numpy as np

from probitas.llm import classifier


def test_repeated_ids_train_as_one_row(spark):
    rng = np.random.default_rng(3)
    text = lambda good: " ".join(rng.choice(["plain", "words", "of", "prose"] if good else ["#$%", "!!", "$$$", "x9x9"], 30))
    rows = [(i, text(i % 2)) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    once = spark.createDataFrame(rows, "doc_id long, text string")
    first = min(i for i, _ in rows if i % 2)
    many = once.union(once.filter(f"doc_id = {first}").crossJoin(spark.range(500)).select("doc_id", "text")).repartition(5)
    assert np.array_equal(classifier.train(once, labels), classifier.train(many, labels))
    other = once.union(once.filter(f"doc_id = {first}").selectExpr("doc_id", "concat(text, ' more')"))
    a, b = classifier.train(other, labels), classifier.train(other.orderBy("text").repartition(3), labels)
    assert np.array_equal(a, b)
