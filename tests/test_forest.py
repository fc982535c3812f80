"""Forests on counted cells: nothing of the size of the rows is kept for the fit."""

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from tarnwork.plans import ml
from tests.test_training import counted


def test_trees_are_fitted_on_cells(spark, monkeypatch):
    rows = spark.range(40_000).select(
        (F.xxhash64("id") % 100_003).cast("double").alias("amount"), (F.col("id") % 5).alias("product_code"), (F.col("id") % 5 >= 2).cast("double").alias("label")
    )
    seen, fit = [], RandomForestClassifier.fit
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, df, *a: (seen.append((df.count(), df.agg(F.sum("__weight")).first()[0])), fit(self, df, *a))[1])
    model = ml.train(ml.forest_pipeline(["amount", "product_code"], trees=6, features_per_split="all"), rows)
    assert len(seen) == 6 and max(n for n, _ in seen) <= 32 * 5
    assert all(abs(w - 40_000) < 1200 for _, w in seen) and len({w for _, w in seen}) > 1  # bootstrap samples of all rows
    assert model.transform(rows).where("prediction <> label").isEmpty()


def test_forest_finds_rare_and_heavy_values(spark):
    """A code that few rows have, and amounts that are zero but for a few rows, decide the class."""
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 40 == 0, F.col("id").cast("double")).otherwise(0.0).alias("amount"),
        F.when(F.col("id") % 2000 == 1, 2).otherwise(F.col("id") % 2).alias("code"),
    )
    for rule in (F.col("code") == 2, F.col("amount") > 0):
        ruled = rows.withColumn("label", rule.cast("double"))
        model = ml.train(ml.forest_pipeline(["amount", "code"], trees=5, features_per_split="all"), ruled)
        assert model.transform(ruled).where("prediction <> label").isEmpty()


def test_forest_on_missing_and_constant_columns(spark, tmp_path):
    rows = spark.createDataFrame([(float(k % 7), 1.0, float(k % 7 > 2) * 3) for k in range(300)], "amount double, same double, label double")
    model = ml.train(ml.forest_pipeline(["amount", "same"], trees=5, features_per_split="all"), rows)
    ml.save_model(model, str(tmp_path / "m"))
    scored = ml.load_model(str(tmp_path / "m")).transform(rows)
    assert scored.where("prediction <> label").isEmpty()
    again = ml.train(ml.forest_pipeline(["amount", "same"], trees=5, features_per_split="all"), rows.repartition(7)).transform(rows)
    assert counted(scored.select("amount", "probability")) == counted(again.select("amount", "probability"))
    for odd in (None, float("nan"), float("inf")):
        missing = rows.limit(1).withColumn("amount", F.lit(odd).cast("double"))
        assert model.transform(missing).count() == 1 and model.transform(missing).first().prediction in (0.0, 3.0)
        with pytest.raises(Exception, match="Vector values"):
            ml.train(ml.forest_pipeline(["amount", "same"], trees=2), rows.union(missing))
    with pytest.raises(Exception, match="Labels"):
        ml.train(ml.forest_pipeline(["amount"], trees=2), rows.withColumn("label", F.when(F.col("label") > 0, F.col("label"))))


def test_many_columns_are_fitted_on_rows(spark):
    rows = spark.range(400).select(*((F.xxhash64("id", F.lit(i)) % 1000).cast("double").alias(f"x{i}") for i in range(4)))
    rows = rows.withColumns({"x0": F.col("x0") % 3, "label": (F.col("x0") % 3 > 0).cast("double")})
    model = ml.train(ml.forest_pipeline(rows.columns[:4], trees=5, features_per_split="all"), rows)
    assert model.transform(rows).where("prediction <> label").isEmpty()
