"""Training, scoring and gating of tabular models with MLlib."""

from __future__ import annotations

import math
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions.hashing import key_hash, SPAN
from tarnwork.operators.keyed import dense_codes, lookup_join
from tarnwork.operators.series import ratio

# ---- fixed values: settings of the two training jobs -----------------------
BASELINE_TREES, BASELINE_DEPTH = 100, 6
FEATURE_TREES, FEATURE_DEPTH = 50, 5
SEED = 42
TEST_FRACTION = 0.2
# ---- what a tree tells apart: MLlib's default number of bins ---------------
BINS = 32
# Cells of bins and classes that the driver holds at most; trees that are fitted at a time.
MOST_CELLS = 1 << 16
FITS = 8
# ---------------------------------------------------------------------------


def encode_labels(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the position of the value in the sorted list of distinct values."""
    return lookup_join(df, dense_codes(df, column, out), [column])


def split_column(key: Column, test_fraction: float = TEST_FRACTION, seed: int = SEED) -> Column:
    """"test" or "train" by key, the same under every partitioning."""
    limit = int(round(test_fraction * SPAN))
    return F.when(key_hash(key, "split", seed) < F.lit(limit), F.lit("test")).otherwise(F.lit("train"))


def split_rows(df: DataFrame, key: str, test_fraction: float = TEST_FRACTION, seed: int = SEED) -> DataFrame:
    return df.withColumn("split", split_column(F.col(key), test_fraction, seed))


def forest_pipeline(
    columns: list[str], *, trees: int = FEATURE_TREES, depth: int = FEATURE_DEPTH, seed: int = SEED, **settings
) -> Pipeline:
    """Bins, feature vector and random forest on plain numbers, with a numeric ``label``.

    Categories come as codes of ``encode_labels``, ordered like any number: as
    many of them as there are, without a list of them on the driver.
    """
    return Pipeline(stages=[BinnedForest(columns, forest(trees, depth, seed, **settings))])


class BinnedForest(Estimator):
    """A random forest that is fitted on counts of rows instead of a stored copy of every row with its draws for every tree.

    A tree compares a number with the limits of its ``BINS`` bins only, so rows
    of the same bins and label are the same to it.  One pass finds the limits,
    one counts the rows of each cell (bins and label).  A tree's bootstrap
    sample takes every row as often as a Poisson number of mean 1 says; for the
    n rows of a cell together that is a Poisson number of mean n, and MLlib fits
    the tree on the cells with these weights.  Nothing of the size of the rows
    is kept in memory or on disk.

    With so many columns that cells could be more than ``MOST_CELLS``, MLlib's
    forest is fitted on the rows.  So it is where a number is missing or
    infinite, which MLlib refuses; a model that is fitted scores such rows.
    """

    def __init__(self, columns: list[str], trees: RandomForestClassifier) -> None:
        super().__init__()
        self.columns, self.trees = columns, trees

    def _fit(self, rows: DataFrame) -> PipelineModel:
        label = self.trees.getLabelCol()
        limits, classes, odd = bin_limits(rows, self.columns, label)
        bins = [f"__bin_{i}" for i in range(len(self.columns))]
        if odd or math.prod(len(x) + 1 for x in limits) * classes > MOST_CELLS:
            features = VectorAssembler(inputCols=self.columns, outputCol=self.trees.getFeaturesCol(), handleInvalid="keep")
            return Pipeline(stages=[features, self.trees]).fit(rows)
        ends = [[-math.inf, *x, math.inf] for x in limits]
        binned = Bucketizer(splitsArray=ends, inputCols=self.columns, outputCols=bins, handleInvalid="keep")
        features = VectorAssembler(inputCols=bins, outputCol=self.trees.getFeaturesCol(), handleInvalid="keep")
        cells = binned.transform(rows).groupBy(*bins, label).agg(F.count(F.lit(1)).alias("__n")).collect()
        cells.sort(key=lambda c: (*c[: len(bins)], c[label] is None, c[label] or 0.0))
        table = {c: pa.array((cell[c] for cell in cells), pa.float64()) for c in bins}
        table[label] = pa.array((cell[label] for cell in cells), pa.float64())
        return PipelineModel([binned, features, self._forest(rows.sparkSession, table, [c["__n"] for c in cells], features, classes)])

    def _forest(self, spark: SparkSession, table: dict[str, pa.Array], counts: list[int], features: VectorAssembler, classes: int):
        label, trees, seed = self.trees.getLabelCol(), self.trees.getNumTrees(), self.trees.getSeed()
        draw, samples = np.random.default_rng(seed), []
        while len(samples) < trees:
            sample = draw.poisson(counts)
            if sample.any():  # a tree of no rows would have no vote
                samples.append(sample)
        # The number of classes is the same for all trees, also for one that has drawn no row of the last class.
        nominal = {"ml_attr": {"type": "nominal", "num_vals": classes}}
        subset = self.trees.getFeatureSubsetStrategy()
        # MLlib has a bin for each number there is, and looks at all cells for them if their number allows so many bins.
        single = {
            "numTrees": 1, "bootstrap": False, "maxBins": max(BINS + 1, math.isqrt(len(counts)) + 1), "weightCol": "__weight",
            "featureSubsetStrategy": "sqrt" if subset == "auto" and trees > 1 else subset,
        }

        def fit(t: int):
            drawn = pa.table(table | {"__weight": pa.array(samples[t], pa.float64())}).filter(pa.array(samples[t] > 0))
            cells = features.transform(spark.createDataFrame(drawn).coalesce(1))
            cells = cells.withColumn(label, F.col(label).alias(label, metadata=nominal))
            tree = self.trees.copy({getattr(self.trees, k): v for k, v in (single | {"seed": seed + t}).items()})
            return tree.fit(cells)._java_obj.trees()[0]

        with ThreadPool(min(FITS, trees)) as pool:
            fitted = pool.map(inheritable_thread_target(spark)(fit), range(trees), chunksize=1)
        java = spark._jvm.org.apache.spark.ml.classification
        array = spark.sparkContext._gateway.new_array(java.DecisionTreeClassificationModel, trees)
        for t, tree in enumerate(fitted):
            array[t] = tree
        model = RandomForestClassificationModel(java.RandomForestClassificationModel(self.trees.uid, array, len(features.getInputCols()), classes))
        for param, value in self.trees.extractParamMap().items():
            if model.hasParam(param.name):
                model.set(model.getParam(param.name), value)
        return model


def bin_limits(rows: DataFrame, columns: list[str], label: str) -> tuple[list[list[float]], int, bool]:
    """Inner limits of the bins of each column, the number of classes, and whether a number is missing or infinite.

    As in MLlib, a column of few values has a bin for each of them, others have
    bins of about equally many rows; there, a value with more rows than that has
    a bin of its own.
    """
    number = {c: F.col(c).cast("double") for c in columns}
    finite = [F.when(~F.isnan(x) & (F.abs(x) != F.lit(math.inf)), x) for x in number.values()]
    ranks = [i / BINS for i in range(BINS)]
    named = lambda made: F.struct(*(c.alias(f"c{i}") for i, c in enumerate(made)))
    classes = F.col(label).cast("double")
    seen = rows.agg(
        F.max(F.when(~F.isnan(classes), classes)).alias("last"),
        named(F.approx_count_distinct(x) for x in finite).alias("distinct"),
        named(F.percentile_approx(x, ranks, 10_000) for x in finite).alias("ranked"),
        named(F.count_if(x.isNull()) for x in finite).alias("odd"),
    ).first()
    few = [i for i, n in enumerate(seen.distinct) if n <= 2 * BINS]
    values = dict(zip(few, map(sorted, rows.agg(*(F.collect_set(finite[i]) for i in few)).first()))) if few else {}
    limits = []
    for i, ranked in enumerate(seen.ranked):
        own = values.get(i)
        if own is not None and len(own) <= BINS:
            inner = [middle if a < (middle := a / 2 + b / 2) <= b else b for a, b in zip(own, own[1:])]
        else:
            above = (math.nextafter(a, math.inf) for a, b in zip(ranked, ranked[1:]) if a == b)
            inner = sorted({*ranked[1:], *above} - {ranked[0]})
        limits.append(inner or [(own or [0.0])[0]])  # one limit at least, for a column that tells nothing
    return limits, int(seen.last or 0) + 1, any(seen.odd)


def forest(
    trees: int = BASELINE_TREES, depth: int = BASELINE_DEPTH, seed: int = SEED, features_per_split: str = "auto"
) -> RandomForestClassifier:
    return RandomForestClassifier(
        featureSubsetStrategy=features_per_split,
        featuresCol="features",
        labelCol="label",
        numTrees=trees,
        maxDepth=depth,
        seed=seed,
        # Statistics of a tree level are gathered per node group of this size.
        maxMemoryInMB=512,
    )


def vector_forest_pipeline(**settings) -> Pipeline:
    """Random forest on a ``features`` vector of any length, with a numeric ``label``."""
    return Pipeline(stages=[forest(**settings)])


def train(pipeline: Pipeline, rows: DataFrame) -> PipelineModel:
    return pipeline.fit(rows)


def score(model: PipelineModel, rows: DataFrame, keep: list[str]) -> DataFrame:
    return model.transform(rows).select(*keep, "prediction")


def binary_metrics(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and F1 of the positive class 1 from one pass of confusion counts."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    counts = predictions.agg(
        F.count_if(y & p).alias("tp"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
        F.count_if(~y & ~p).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        "tp",
        "fp",
        "fn",
        "tn",
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"),
    )


def accuracy(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    hits = F.count_if(F.col(label).cast("double") == F.col(prediction).cast("double"))
    return predictions.agg(F.count(F.lit(1)).alias("rows"), ratio(hits, F.count(F.lit(1))).alias("accuracy"))


def run_record(metrics: DataFrame, run_id: str, params: dict[str, object], training_rows: DataFrame, now: Column) -> DataFrame:
    """One row per run: parameters, metrics and the number of training rows."""
    pairs = [F.lit(str(x)) for item in params.items() for x in item]
    rows = training_rows.agg(F.count(F.lit(1))).scalar()
    return metrics.select(
        F.lit(run_id).alias("run_id"),
        (F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")).alias("params"),
        *metrics.columns,
        rows.alias("training_rows"),
        now.alias("created_at"),
    )


def latest_versions(versions: DataFrame) -> DataFrame:
    """The row with the greatest version number per model; versions are text."""
    rest = [c for c in versions.columns if c != "model_name"]
    return (
        versions.groupBy("model_name")
        .agg(F.max_by(F.struct(*rest), F.col("version").cast("int")).alias("__row"))
        .select("model_name", "__row.*")
    )


def gate(scored: DataFrame, expected_rows: DataFrame, versions: DataFrame, model_name: str) -> DataFrame:
    """Deployment gate: newest version ready, one prediction per input row, all finite.

    A model without a version does not pass.
    """
    p = F.col("prediction")
    finite = p.isNotNull() & ~F.isnan(p) & (F.abs(p) != F.lit(float("inf")))
    result = scored.agg(F.count(F.lit(1)).alias("output_rows"), F.count_if(finite).alias("finite_rows"))
    inputs = expected_rows.agg(F.count(F.lit(1))).scalar()
    newest = latest_versions(versions.where(F.col("model_name") == model_name))
    status = newest.agg(F.max("status")).scalar()
    joined = result.select(inputs.alias("input_rows"), "output_rows", "finite_rows", status.alias("status"))
    ok = (
        (F.col("input_rows") == F.col("output_rows"))
        & (F.col("finite_rows") == F.col("output_rows"))
        & F.col("status").eqNullSafe(F.lit("READY"))
    )
    return joined.withColumn("passed", ok)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
