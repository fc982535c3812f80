"""Feature store and model queries."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.plans import features, ml, quality
from tarnwork.plans.features import CUSTOMER_ORDERS
from tarnwork.session import drop_scratch, scratch_path, shuffles_dropped
from tarnwork.sinks.once import append_once, read_once
from tarnwork.workload import views as v
from tarnwork.workload.registry import VIEW_SQL, hash_sql, query, stored_bytes, stored_input

GATED_MODEL = "Brand#11"
START, MIDDLE, END = "1996-01-01", "1998-06-01", "1999-12-31"


@query("feature_source", "SELECT customer_name, region, product, amount, event_timestamp, order_id FROM v_feature_rows")
def feature_source(spark: SparkSession, sf: str) -> DataFrame:
    return v.feature_rows(spark, sf)


_PIT = """
SELECT s.spine_id, s.customer_name, s.event_timestamp,
       CASE WHEN {alive} THEN f.region END AS region, CASE WHEN {alive} THEN f.product END AS product,
       CASE WHEN {alive} THEN f.amount END AS amount
FROM v_spine s ASOF LEFT JOIN (
    SELECT * FROM v_feature_rows
    QUALIFY row_number() OVER (PARTITION BY customer_name, event_timestamp ORDER BY order_id DESC) = 1) f
ON s.customer_name = f.customer_name AND s.event_timestamp >= f.event_timestamp
"""


@query("pit_features", _PIT.format(alive="s.event_timestamp <= f.event_timestamp + INTERVAL 3650 DAY"))
def pit_features(spark: SparkSession, sf: str) -> DataFrame:
    return features.historical_features(v.spine(spark, sf), v.feature_rows(spark, sf), CUSTOMER_ORDERS)


@query("pit_features_ttl", _PIT.format(alive="s.event_timestamp <= f.event_timestamp + INTERVAL 10 DAY"))
def pit_features_ttl(spark: SparkSession, sf: str) -> DataFrame:
    """A time-to-live shorter than the lag of the spine leaves later orders only."""
    from dataclasses import replace

    view = replace(CUSTOMER_ORDERS, ttl_days=10)
    return features.historical_features(v.spine(spark, sf), v.feature_rows(spark, sf), view)


VIEW_SQL["v_latest"] = f"""
SELECT customer_name, region, product, amount, event_timestamp, order_id FROM v_feature_rows
WHERE event_timestamp BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'
QUALIFY row_number() OVER (PARTITION BY customer_name ORDER BY event_timestamp DESC, order_id DESC) = 1
"""


@query("materialize_latest", "SELECT * FROM v_latest")
def materialize_latest(spark: SparkSession, sf: str) -> DataFrame:
    return features.materialize(v.feature_rows(spark, sf), CUSTOMER_ORDERS, START, END)


@query("materialize_incremental", "SELECT * FROM v_latest")
def materialize_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """A stored snapshot up to the middle, brought up to the end bucket by bucket: same as one full run."""
    source = v.feature_rows(spark, sf)
    store = features.online_store(spark, scratch_path(spark, "online"), source, CUSTOMER_ORDERS, buckets=8)
    features.materialize_into(store, source, CUSTOMER_ORDERS, START, MIDDLE)
    features.materialize_into(store, source, CUSTOMER_ORDERS, MIDDLE, END, after=True)
    return store.read()


@query(
    "online_lookup",
    """SELECT c_name AS customer_name, region, product, amount FROM customer LEFT JOIN v_latest ON c_name = customer_name""",
)
def online_lookup(spark: SparkSession, sf: str) -> DataFrame:
    snapshot = features.materialize(v.feature_rows(spark, sf), CUSTOMER_ORDERS, START, END)
    wanted = v.table(spark, sf, "customer").select(F.col("c_name").alias("customer_name"))
    return features.online_lookup(wanted, snapshot, CUSTOMER_ORDERS)


@query(
    "train_gate",
    """SELECT count(*) AS row_count, count(DISTINCT region) AS class_count,
        count(*) >= 4 AND count(DISTINCT region) >= 2 AS passed FROM v_feature_rows""",
)
def train_gate(spark: SparkSession, sf: str) -> DataFrame:
    return quality.enough_to_train(v.feature_rows(spark, sf), "region")


@query(
    "label_encode",
    """SELECT order_id, customer_name, code AS customer_code FROM v_orders JOIN (
        SELECT customer_name, dense_rank() OVER (ORDER BY customer_name) - 1 AS code
        FROM (SELECT DISTINCT customer_name FROM v_orders)) USING (customer_name)""",
)
def label_encode(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.orders(spark, sf).select("order_id", "customer_name")
    return ml.encode_labels(rows, "customer_name", "customer_code")


@query(
    "binary_metrics",
    """SELECT tp, fp, fn, tn, CAST(tp + tn AS DOUBLE) / nullif(CAST(tp + fp + fn + tn AS DOUBLE), 0) AS accuracy,
        coalesce(CAST(2 * tp AS DOUBLE) / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0) AS f1
    FROM (SELECT count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label <> 1 AND prediction = 1) AS fp,
                 count(*) FILTER (label = 1 AND prediction <> 1) AS fn, count(*) FILTER (label <> 1 AND prediction <> 1) AS tn
          FROM v_predictions)""",
)
def binary_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return ml.binary_metrics(v.predictions(spark, sf))


@query(
    "latest_version",
    """SELECT model_name, version, status FROM v_versions
    QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY CAST(version AS INTEGER) DESC) = 1""",
)
def latest_version(spark: SparkSession, sf: str) -> DataFrame:
    return ml.latest_versions(v.versions(spark, sf))


# -- training: SQL has what is determined: rows, splits, gates; the tests check what is learned

VIEW_SQL["v_training"] = f"SELECT * FROM ({_PIT.format(alive="s.event_timestamp <= f.event_timestamp + INTERVAL 3650 DAY")}) WHERE region IS NOT NULL"


# Orders of so many bytes of Parquet go through the as-of join at a time: its exchanges take many times that on disk.
PART_BYTES = 32 << 20


def _training_rows(orders: DataFrame) -> DataFrame:
    """Historical features of every order with its split."""
    known = features.historical_features(v.spine_of(orders), v.feature_rows_of(orders), CUSTOMER_ORDERS)
    return ml.split_rows(known.where(F.col("region").isNotNull()), "spine_id")


def _store_training_rows(spark: SparkSession, sf: str, path: str, parts: int) -> DataFrame:
    """The training rows, written below ``path`` part by part.

    All orders of a customer are in one part, so each part's features are
    complete; the disk holds the exchanges of one part at a time.
    """
    orders = v.orders(spark, sf)
    part = F.pmod(F.xxhash64(*CUSTOMER_ORDERS.keys), F.lit(parts)).cast("int")
    dealt = orders.withColumn("part", part).sortWithinPartitions("part", *CUSTOMER_ORDERS.keys)
    dealt.write.partitionBy("part").parquet(f"{path}/orders")
    stored = spark.read.schema(dealt.schema).parquet(f"{path}/orders")
    for number in range(parts):
        known = _training_rows(stored.where(F.col("part") == number).drop("part"))
        known.write.mode("append").parquet(f"{path}/known")
    drop_scratch(spark, f"{path}/orders")
    return spark.read.schema(known.schema).parquet(f"{path}/known")


def _trained(spark: SparkSession, sf: str):
    """The region model, trained once for a state of the tables; (folder of the model, its rows).

    Gate, codes and fitting read their rows several times, so the retrieved
    features are written once to the shared folder and read from there.
    """
    tables = [f"{sf}/{name}.parquet" for name in ("orders", "customer", "nation", "region")]

    def build(path: str) -> None:
        parts = 1 + stored_bytes(spark, tables[:1]) // PART_BYTES
        with shuffles_dropped(spark):
            known = quality.require_training(_store_training_rows(spark, sf, path, parts), "region")
            coded = ml.encode_labels(ml.encode_labels(known, "product", "product_code"), "region", "label")
            coded.withColumns({c: F.col(c).cast("double") for c in ("amount", "label")}).write.parquet(f"{path}/rows")
            drop_scratch(spark, f"{path}/known")
        rows = spark.read.parquet(f"{path}/rows")
        pipeline = ml.forest_pipeline(["amount", "product_code"])
        ml.save_model(ml.train(pipeline, rows.where(F.col("split") == "train")), f"{path}/model")

    path = stored_input(spark, "region-model", tables, build)
    return f"{path}/model", spark.read.parquet(f"{path}/rows")


# A class that the product decides: its code, counted from 0 in the order of the names, is 2 or more.
VIEW_SQL["v_ruled"] = """
SELECT t.*, CAST(CASE WHEN p.code >= 2 THEN 1 ELSE 0 END AS DOUBLE) AS label
FROM v_training t JOIN (SELECT product, dense_rank() OVER (ORDER BY product) - 1 AS code FROM (SELECT DISTINCT product FROM v_training)) p
    ON t.product = p.product
"""


@query(
    "rf_train_score",
    "SELECT spine_id, CASE WHEN {h} < 858993459 THEN 'test' ELSE 'train' END AS split, label AS prediction FROM v_ruled".format(
        h=hash_sql("spine_id", "split")
    ),
)
def rf_train_score(spark: SparkSession, sf: str) -> DataFrame:
    """A class that depends on the product, learned from point-in-time features: the prediction for every order."""
    _, rows = _trained(spark, sf)
    ruled = rows.withColumn("label", (F.col("product_code") >= 2).cast("double"))
    pipeline = ml.forest_pipeline(["amount", "product_code"], features_per_split="all")
    model = ml.train(pipeline, quality.require_training(ruled.where(F.col("split") == "train"), "label"))
    return ml.score(model, ruled, ["spine_id", "split"])


@query(
    "rf_vector_score",
    """SELECT vec_id, CAST(CASE WHEN floor(CAST(embedding[1] AS DOUBLE) * 10) >= 1 THEN 1 ELSE 0 END AS DOUBLE) AS prediction
    FROM embeddings WHERE {h} < 858993459""".format(h=hash_sql("vec_id", "split")),
)
def rf_vector_score(spark: SparkSession, sf: str) -> DataFrame:
    """Binary classifier on whole vectors in steps of a tenth, 100 trees of depth 6: predictions on the test part.

    The class depends on the first entry, so what a right fit predicts is known.
    """
    tenths = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * 10).cast("double"))
    rows = ml.split_rows(
        v.table(spark, sf, "embeddings").select("vec_id", tenths.alias("tenths")).select(
            "vec_id",
            array_to_vector("tenths").alias("features"),
            (F.element_at("tenths", 1) >= 1).cast("double").alias("label"),
        ),
        "vec_id",
    )
    training = quality.require_training(rows.where(F.col("split") == "train"), "label")
    model = ml.train(ml.vector_forest_pipeline(features_per_split="all"), training)
    return ml.score(model, rows.where(F.col("split") == "test"), ["vec_id"])


@query(
    "ml_run_row",
    """SELECT run_id, '{{"n_estimators":"{trees}","feature_source":"{source}"}}' AS params, count(*) FILTER ({h} < 858993459) AS test_rows,
        CAST(1 AS DOUBLE) AS accuracy, count(*) FILTER ({h} >= 858993459) AS training_rows, TIMESTAMP '{end}' AS created_at
    FROM v_ruled, (VALUES ('run-1'), ('run-2')) AS r(run_id) GROUP BY run_id""".format(
        h=hash_sql("spine_id", "split"), trees=ml.FEATURE_TREES, source=CUSTOMER_ORDERS.name, end=END
    ),
)
def ml_run_row(spark: SparkSession, sf: str) -> DataFrame:
    """The run table after two runs, the first of them recorded twice: accuracy from the counts of right and wrong predictions."""
    scored = rf_train_score(spark, sf)
    _, rows = _trained(spark, sf)
    truth = rows.select("spine_id", (F.col("product_code") >= 2).cast("double").alias("label"))
    # Each run reads them several times: joined once, they are kept as the columns that are counted.
    path = scratch_path(spark, "judged")
    with shuffles_dropped(spark):
        scored.join(truth, "spine_id").select("split", "label", "prediction").write.parquet(path)
    judged = spark.read.parquet(path)
    test, training = judged.where(F.col("split") == "test"), judged.where(F.col("split") == "train")
    metrics = ml.binary_metrics(test)
    tested = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    params = {"n_estimators": ml.FEATURE_TREES, "feature_source": CUSTOMER_ORDERS.name}
    root = scratch_path(spark, "runs")
    for run in ("run-1", "run-1", "run-2"):
        record = ml.run_record(
            metrics.select(tested.alias("test_rows"), "accuracy"), run, params, training, F.lit(END).cast("timestamp")
        ).withColumn("params", F.to_json("params"))
        append_once(record, root, run, ["run_id"], "created_at")
    return read_once(spark, root, record.schema)


@query(
    "model_gate",
    f"""SELECT count(*) AS input_rows, count(*) AS output_rows, count(*) AS finite_rows, status, status = 'READY' AS passed
    FROM v_training, (SELECT status FROM v_versions WHERE model_name = '{GATED_MODEL}'
        QUALIFY row_number() OVER (ORDER BY CAST(version AS INTEGER) DESC) = 1) GROUP BY status""",
)
def model_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Load the stored model, score everything, check number and finiteness of the results."""
    path, rows = _trained(spark, sf)
    scored = ml.score(ml.load_model(path), rows, ["spine_id"])
    return ml.gate(scored, rows.select("spine_id"), v.versions(spark, sf), GATED_MODEL)
