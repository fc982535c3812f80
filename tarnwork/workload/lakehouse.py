"""Scans, sinks, models, dashboard pages and quality gates."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwork import schemas
from tarnwork.functions.times import retained, retained_day
from tarnwork.plans import catalog, models, quality
from tarnwork.session import scratch_path
from tarnwork.sinks import tables as sinks
from tarnwork.sources import events as event_source
from tarnwork.sources import logs as log_source
from tarnwork.sources import tables as sources
from tarnwork.workload import views as v
from tarnwork.workload.registry import hash_sql, query

SCHEMA = "tarnwork_demo"


def _new_table(spark: SparkSession, stem: str) -> tuple[str, str]:
    """A fresh table name in the demo schema and its location in the shared folder."""
    sinks.create_schema(spark, SCHEMA, scratch_path(spark, SCHEMA))
    return f"{SCHEMA}.{stem}_{uuid.uuid4().hex[:8]}", scratch_path(spark, stem)


# -- sources -----------------------------------------------------------------


@query("scan_count", "SELECT count(*) AS row_count FROM v_orders")
def scan_count(spark: SparkSession, sf: str) -> DataFrame:
    return sources.row_count(v.orders(spark, sf))


@query(
    "sql_passthrough",
    "SELECT region, product, count(*) AS n, CAST(max(amount) AS DOUBLE) AS top FROM v_orders GROUP BY ALL",
)
def sql_passthrough(spark: SparkSession, sf: str) -> DataFrame:
    text = "SELECT region, product, count(*) AS n, max(amount) AS top FROM {orders} GROUP BY region, product"
    return sources.run_sql(spark, text, orders=v.orders(spark, sf))


@query(
    "gen_events",
    f"""SELECT {hash_sql('event_id', 'event_id')} AS event_id,
        'device_id-' || {hash_sql('event_id', 'device_id')} AS device_id,
        'event_type-' || {hash_sql('event_id', 'event_type')} AS event_type,
        {hash_sql('event_id', 'value')} / 4294967296.0::DOUBLE AS value,
        make_timestamp({hash_sql('event_id', 'event_time')} * 1000000) AS event_time
    FROM events""",
)
def gen_events(spark: SparkSession, sf: str) -> DataFrame:
    ids = v.table(spark, sf, "events").select(F.col("event_id").alias("__id"))
    return event_source.synthetic_rows(ids, "__id", schemas.DEVICE_EVENT)


@query(
    "gen_device_stream",
    f"""SELECT event_id, printf('device-%03d', {hash_sql('event_id', 'device')} % 10 + 1) AS device_id,
        (['heartbeat','temperature','humidity','battery','error'])[{hash_sql('event_id', 'type')} % 5 + 1] AS event_type,
        ({hash_sql('event_id', 'value')} % 10001) / 100.0::DOUBLE AS value, ts AS event_time
    FROM events""",
)
def gen_device_stream(spark: SparkSession, sf: str) -> DataFrame:
    return event_source.device_events(v.events(spark, sf), "event_id", F.col("ts"))


@query("json_decode_valid", "SELECT * FROM v_decoded")
def json_decode_valid(spark: SparkSession, sf: str) -> DataFrame:
    return event_source.valid_events(event_source.decode_messages(v.device_json(spark, sf)))


@query(
    "json_decode_quarantine",
    """SELECT CASE WHEN event_id % 97 = 0 THEN 'not json' ELSE 'no event time' END AS reason,
        CASE WHEN event_id % 97 = 0 THEN 'lost message ' || event_id END AS text,
        CASE WHEN event_id % 97 <> 0 THEN CAST(event_id AS VARCHAR) END AS event_id
    FROM events WHERE event_id % 97 = 0 OR event_id % 103 = 0""",
)
def json_decode_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    bad = event_source.quarantined(event_source.decode_messages(v.device_json(spark, sf)))
    not_json = F.col("reason") == "not json"
    return bad.select(
        "reason",
        F.when(not_json, F.col("raw")).alias("text"),
        F.when(~not_json, F.get_json_object("raw", "$.event_id")).alias("event_id"),
    )


@query("csv_grants_load", "SELECT username, table_fqn, security_level, granted_at, expires_at FROM v_grants")
def csv_grants_load(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "grants-csv")
    v.grants(spark, sf).write.option("header", True).csv(path)
    return sources.read_grants(spark, path)


@query("log_relabel", "SELECT namespace, pod, container, job, ts, line FROM v_log_lines")
def log_relabel(spark: SparkSession, sf: str) -> DataFrame:
    return log_source.relabel(v.raw_log_lines(spark, sf))


_RATES = [("1-URGENT", 3), ("2-HIGH", 2), ("3-MEDIUM", 1)]


@query(
    "values_rows",
    """SELECT product, weight, count(*) AS n
    FROM v_orders JOIN (VALUES ('1-URGENT', 3), ('2-HIGH', 2), ('3-MEDIUM', 1)) AS r(product, weight) USING (product)
    GROUP BY ALL""",
)
def values_rows(spark: SparkSession, sf: str) -> DataFrame:
    weights = sources.values_rows(spark, _RATES, "product string, weight int")
    return v.orders(spark, sf).join(weights, "product").groupBy("product", "weight").agg(F.count(F.lit(1)).alias("n"))


# -- sinks -------------------------------------------------------------------


@query("sink_append", "SELECT * FROM v_device_events UNION ALL SELECT * FROM v_device_events")
def sink_append(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs of an append: every row twice."""
    path = scratch_path(spark, "append")
    for _ in range(2):
        sinks.append(v.device_events(spark, sf), path)
    return spark.read.schema(schemas.DEVICE_EVENT).parquet(path)


@query(
    "sink_replace_readback",
    "SELECT region, CAST(sum(amount) AS DOUBLE) AS total_amount FROM v_orders GROUP BY region",
)
def sink_replace_readback(spark: SparkSession, sf: str) -> DataFrame:
    """The table is built from all rows, then replaced by its own totals."""
    name, root = _new_table(spark, "orders_by_region")
    source = quality.require_rows(v.orders(spark, sf), "orders")
    first = sinks.create_or_replace(source.select("region", F.col("amount").cast("decimal(20,2)").alias("amount")), name, root)
    totals = models.orders_by_region(first)
    return sinks.create_or_replace(totals, name, root)


@query(
    "sink_full_refresh",
    """SELECT order_id, customer_name, region, product, CAST(amount AS DOUBLE) AS amount, order_date FROM v_orders""",
)
def sink_full_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs of a refresh: every row once."""
    path = scratch_path(spark, "refresh")
    for _ in range(2):
        sinks.refresh(v.orders(spark, sf), path)
    return sinks.read_snapshot(spark, path)


@query(
    "ddl_create",
    "SELECT order_id, customer_name, region, product, CAST(amount AS DOUBLE) AS amount, order_date FROM v_orders",
)
def ddl_create(spark: SparkSession, sf: str) -> DataFrame:
    name, location = _new_table(spark, "orders")
    for _ in range(2):  # the second time nothing happens
        sinks.create_table(spark, name, schemas.ORDERS, location)
    sinks.insert_into(v.orders(spark, sf), name)
    return spark.table(name)


@query(
    "catalog_inventory",
    """WITH cols(table_name, position, column_name, data_type) AS (VALUES
        ('orders', 1, 'o_orderkey', 'bigint'), ('orders', 2, 'o_custkey', 'bigint'), ('orders', 3, 'o_orderstatus', 'string'),
        ('orders', 4, 'o_totalprice', 'double'), ('orders', 5, 'o_orderdate', 'timestamp_ntz'),
        ('orders', 6, 'o_orderpriority', 'string'),
        ('customer', 1, 'c_custkey', 'bigint'), ('customer', 2, 'c_name', 'string'), ('customer', 3, 'c_nationkey', 'int'),
        ('customer', 4, 'c_acctbal', 'double'), ('customer', 5, 'c_mktsegment', 'string')),
    n AS (SELECT 'orders' AS table_name, count(*) AS row_count FROM orders
          UNION ALL SELECT 'customer', count(*) FROM customer)
    SELECT table_name, CAST(position AS INTEGER) AS position, column_name, data_type, row_count FROM cols JOIN n USING (table_name)""",
)
def catalog_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.inventory({name: v.table(spark, sf, name) for name in ("orders", "customer")})


@query(
    "retention_filter",
    "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 7 DAY",
)
def retention_filter(spark: SparkSession, sf: str) -> DataFrame:
    # The stored column is compared as it is, so the filter reaches the scan.
    rows = v.table(spark, sf, "events").select("event_id", "ts")
    limit = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    return rows.where(retained(F.col("ts"), limit, days=7))


@query(
    "retention_partitions",
    """SELECT event_id, device_id, event_type, value, event_time FROM v_device_events
    WHERE event_time >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 7 DAY""",
)
def retention_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """The same on a table partitioned by day: older days are not opened."""
    path = scratch_path(spark, "by-date")
    sinks.append_by_date(v.device_events(spark, sf), path, "event_time")
    now = "2024-01-30 12:00:00"
    dated = T.StructType(schemas.DEVICE_EVENT.fields + [T.StructField("event_date", T.DateType())])
    rows = spark.read.schema(dated).parquet(path)
    young = rows.where(retained_day(F.col("event_date"), now, 7) & retained(F.col("event_time"), now, 7))
    return young.drop("event_date")


# -- models and pages --------------------------------------------------------


@query(
    "stg_orders",
    "SELECT order_id, customer_name, region, product, CAST(amount AS DOUBLE) AS amount, order_date FROM v_orders",
)
def stg_orders(spark: SparkSession, sf: str) -> DataFrame:
    return models.stg_orders(v.orders(spark, sf))


@query(
    "daily_order_totals",
    """SELECT order_date, region, count(*) AS order_count, CAST(sum(amount) AS DOUBLE) AS total_amount
    FROM v_orders GROUP BY order_date, region""",
)
def daily_order_totals(spark: SparkSession, sf: str) -> DataFrame:
    return models.daily_order_totals(models.stg_orders(v.orders(spark, sf)))


@query(
    "orders_by_region",
    "SELECT region, CAST(sum(amount) AS DOUBLE) AS total_amount FROM v_orders GROUP BY region",
)
def orders_by_region(spark: SparkSession, sf: str) -> DataFrame:
    return models.orders_by_region(v.orders(spark, sf))


@query(
    "region_chart",
    """SELECT region, CAST(sum(amount) AS DOUBLE) AS total_amount FROM v_orders
    GROUP BY region ORDER BY sum(amount) DESC, region LIMIT 100""",
)
def region_chart(spark: SparkSession, sf: str) -> DataFrame:
    """The page of the chart: a limit is its feature."""
    return models.region_chart(v.orders(spark, sf))


@query("region_nunique", "SELECT count(DISTINCT region) AS region_count FROM v_orders")
def region_nunique(spark: SparkSession, sf: str) -> DataFrame:
    return models.distinct_count(v.orders(spark, sf), "region", "region_count")


@query("events_first_100", "SELECT * FROM v_device_events ORDER BY event_id LIMIT 100")
def events_first_100(spark: SparkSession, sf: str) -> DataFrame:
    return models.first_rows(v.device_events(spark, sf), ["event_id"], 100)


@query(
    "sample_5",
    """SELECT order_id, customer_name, region, product, CAST(amount AS DOUBLE) AS amount, order_date
    FROM v_orders ORDER BY order_id LIMIT 5""",
)
def sample_5(spark: SparkSession, sf: str) -> DataFrame:
    return models.first_rows(v.orders(spark, sf), ["order_id"], 5)


# -- quality gates -----------------------------------------------------------


@query("dq_nonempty", "SELECT count(*) AS row_count, count(*) > 0 AS passed FROM v_orders")
def dq_nonempty(spark: SparkSession, sf: str) -> DataFrame:
    return quality.nonempty(v.orders(spark, sf))


@query(
    "dq_group_count",
    "SELECT count(DISTINCT region) AS group_count, count(DISTINCT region) = 5 AS passed FROM v_orders",
)
def dq_group_count(spark: SparkSession, sf: str) -> DataFrame:
    return quality.group_count(v.orders(spark, sf), "region", 5)


@query(
    "dq_columns",
    """SELECT 'part-' || p_partkey AS table_name, column_name FROM part, (VALUES ('qty'), ('price')) AS e(column_name)
    WHERE NOT (column_name = 'qty' AND p_partkey % 3 = 0) AND NOT (column_name = 'price' AND p_size % 2 = 0)""",
)
def dq_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Expected columns that tables lack; every part stands for a table."""
    part = v.table(spark, sf, "part")
    name = F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("table_name")
    expected = part.select(name, F.explode(F.array(F.lit("id"), F.lit("qty"), F.lit("price"))).alias("column_name"))
    has = F.array_compact(
        F.array(
            F.lit("ID"),
            F.when(F.col("p_partkey") % 3 == 0, F.lit("Qty")),
            F.when(F.col("p_size") % 2 == 0, F.lit("PRICE")),
        )
    )
    return quality.missing_columns(expected, part.select(name, F.explode(has).alias("column_name")))


@query(
    "table_names",
    """SELECT id, CASE WHEN n = 3 THEN 'iceberg' END AS catalog, CASE WHEN n = 3 THEN 'demo' END AS "schema",
        CASE WHEN n = 3 THEN 't' || id END AS "table",
        CASE WHEN n = 1 THEN 'wrong number of name parts' WHEN n = 0 THEN 'invalid name part' END AS error
    FROM (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 0 END AS n FROM part)""",
)
def table_names(spark: SparkSession, sf: str) -> DataFrame:
    from tarnwork.functions.names import parse_table_name

    key = F.col("p_partkey")
    text = key.cast("string")
    name = (
        F.when(key % 4 == 0, F.concat(F.lit("  demo.t"), text, F.lit(" ")))
        .when(key % 4 == 1, F.concat(F.lit("iceberg.demo.t"), text))
        .when(key % 4 == 2, F.concat(F.lit("t"), text))
        .otherwise(F.concat(F.lit("demo.t"), text, F.lit("; DROP TABLE x")))
    )
    return v.table(spark, sf, "part").select(key.alias("id"), parse_table_name(name).alias("n")).select("id", "n.*")


@query(
    "split_hash",
    f"""SELECT o_orderkey AS order_id,
        CASE WHEN {hash_sql('o_orderkey', 'split')} < 858993459 THEN 'test' ELSE 'train' END AS split FROM orders""",
)
def split_hash(spark: SparkSession, sf: str) -> DataFrame:
    from tarnwork.plans.ml import split_rows

    return split_rows(v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id")), "order_id")


