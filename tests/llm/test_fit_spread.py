"""The fit's scan, join and hashing aren't pulled into the one training task."""

from pyspark.sql import DataFrame

from epochlake.llm import quality_model


def test_fit_shuffles_before_its_one_task(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i % 7} text {i % 2}") for i in range(60)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, label int")
    plans = []
    kind = type(docs)
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: plans.append(self._jdf.queryExecution().optimizedPlan().toString()) or collect(self))
    assert quality_model.fit(docs, labels, bits=10)
    assert isinstance(docs, DataFrame) and "Repartition 1, true" in plans[-1] and "Repartition 1, false" not in plans[-1]
