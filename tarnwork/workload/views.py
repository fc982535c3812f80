"""The driver tables seen as lake, stream, governance and series tables.

Each view exists twice: as a DataFrame function and as SQL in ``VIEW_SQL``.
All of them are row-wise (or plain joins and aggregates): none needs a global
order or a window to be built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions.times import iso_millis
from tarnwork.plans.features import order_feature_source
from tarnwork.workload.registry import VIEW_SQL, stored_input


# Declared, so that opening a table runs no job to infer it.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf}/{name}.parquet")


def _text(col: str | Column) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("string")


def _iso(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


# -- lake --------------------------------------------------------------------

VIEW_SQL["v_orders"] = """
SELECT o_orderkey AS order_id, c_name AS customer_name, r_name AS region, o_orderpriority AS product,
       CAST(o_totalprice AS DECIMAL(10,2)) AS amount, CAST(o_orderdate AS DATE) AS order_date
FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""


def orders(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda name: table(spark, sf, name)
    return (
        t("orders")
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("o_orderkey").alias("order_id"),
            F.col("c_name").alias("customer_name"),
            F.col("r_name").alias("region"),
            F.col("o_orderpriority").alias("product"),
            F.col("o_totalprice").cast("decimal(10,2)").alias("amount"),
            F.col("o_orderdate").cast("date").alias("order_date"),
        )
    )


VIEW_SQL["v_feature_rows"] = """
SELECT customer_name, region, product, CAST(amount AS DOUBLE) AS amount,
       CAST(order_date AS TIMESTAMP) AS event_timestamp, order_id
FROM v_orders
"""


def feature_rows(spark: SparkSession, sf: str) -> DataFrame:
    return feature_rows_of(orders(spark, sf))


def feature_rows_of(orders: DataFrame) -> DataFrame:
    return order_feature_source(orders).withColumn("amount", F.col("amount").cast("double"))


VIEW_SQL["v_spine"] = """
SELECT order_id AS spine_id, customer_name, CAST(order_date AS TIMESTAMP) + INTERVAL 15 DAY AS event_timestamp
FROM v_orders
"""


def spine(spark: SparkSession, sf: str) -> DataFrame:
    return spine_of(orders(spark, sf))


def spine_of(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("order_id").alias("spine_id"),
        "customer_name",
        (F.col("order_date").cast("timestamp") + F.expr("INTERVAL 15 DAYS")).alias("event_timestamp"),
    )


# -- events ------------------------------------------------------------------

VIEW_SQL["v_device_events"] = """
SELECT event_id, printf('device-%03d', user_id) AS device_id, event_type, value, ts AS event_time FROM events
"""


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def device_events(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(
        "event_id",
        F.format_string("device-%03d", "user_id").alias("device_id"),
        "event_type",
        "value",
        F.col("ts").alias("event_time"),
    )


# Messages of the log: some are no JSON, some have a bad value or a bad time.
VIEW_SQL["v_decoded"] = """
SELECT event_id, device_id, event_type, CASE WHEN event_id % 101 = 0 THEN NULL ELSE value END AS value,
       date_trunc('millisecond', event_time) AS event_time
FROM v_device_events WHERE event_id % 97 <> 0 AND event_id % 103 <> 0
"""


def device_json(spark: SparkSession, sf: str) -> DataFrame:
    rows = device_events(spark, sf)
    iso = iso_millis(F.col("event_time"))
    fields = ["event_id", "device_id", "event_type"]
    number, text_value = F.col("value"), F.lit("n/a")

    def json(value: Column, time: Column) -> Column:
        return F.to_json(F.struct(*fields, value.alias("value"), time.alias("event_time")))

    message = (
        F.when(F.col("event_id") % 97 == 0, F.concat(F.lit("lost message "), _text("event_id")))
        .when(F.col("event_id") % 103 == 0, json(number, F.lit("unknown")))
        .when(F.col("event_id") % 101 == 0, json(text_value, iso))
        .otherwise(json(number, iso))
    )
    # The part of the month in which the device sent the message: the order of the log.
    part = F.floor((F.dayofmonth("event_time") - 1) / 5).cast("int")
    return rows.select("event_id", "event_type", part.alias("part"), F.col("device_id").alias("key"), message.alias("value"))


# -- governance --------------------------------------------------------------

VIEW_SQL["v_employees"] = """
SELECT 'E' || c_custkey AS employee_id, CAST(c_custkey AS VARCHAR) AS username, c_name AS name,
       c_mktsegment AS department,
       CASE WHEN c_custkey = 0 THEN '' WHEN c_custkey % 50 = 7 THEN 'E-none'
            ELSE 'E' || (c_custkey // 10) END AS manager_id
FROM customer
"""


def employees(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    boss = F.expr("concat('E', CAST(c_custkey DIV 10 AS STRING))")
    return table(spark, sf, "customer").select(
        F.concat(F.lit("E"), _text(key)).alias("employee_id"),
        _text(key).alias("username"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("department"),
        F.when(key == 0, F.lit("")).when(key % 50 == 7, F.lit("E-none")).otherwise(boss).alias("manager_id"),
    )


VIEW_SQL["v_table_requests"] = """
SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS username,
       'trino.iceberg.demo.t' || (o_orderkey % 20) AS table_fqn,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(1 + o_orderkey % 3 AS INTEGER) END AS security_level,
       CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN CAST(o_custkey // 10 AS VARCHAR)
            ELSE 'owner' || (o_orderkey % 97) END AS table_owner,
       o_orderdate AS requested_at
FROM orders
"""


def table_requests(spark: SparkSession, sf: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf, "orders").select(
        key.alias("id"),
        _text(cust).alias("username"),
        F.concat(F.lit("trino.iceberg.demo.t"), _text(key % 20)).alias("table_fqn"),
        F.when(key % 11 != 0, (1 + key % 3).cast("int")).alias("security_level"),
        F.when(key % 5 == 0, F.lit(""))
        .when(key % 4 == 1, F.expr("CAST(o_custkey DIV 10 AS STRING)"))
        .otherwise(F.concat(F.lit("owner"), _text(key % 97)))
        .alias("table_owner"),
        F.col("o_orderdate").cast("timestamp").alias("requested_at"),
    )


VIEW_SQL["v_approval_steps"] = """
SELECT request_id || '/' || step_order || '/' || approver_username AS id, request_id, step_order, approver_username,
       CASE WHEN k.flag = 'R' THEN 'rejected'
            WHEN k.flag = 'N' AND step_order % 3 = 0 THEN 'pending_external'
            WHEN k.flag = 'N' THEN 'pending'
            WHEN request_id % 7 = 0 THEN 'escalated' ELSE 'approved' END AS status,
       k.at AS activated_at
FROM (SELECT l_orderkey AS request_id, l_linenumber AS step_order, CAST(l_suppkey AS VARCHAR) AS approver_username,
             min({'at': l_shipdate, 'part': l_partkey, 'flag': l_returnflag}) AS k
      FROM lineitem GROUP BY ALL)
"""


APPROVAL_STEPS = (
    "id string, request_id bigint, step_order int, approver_username string, status string, activated_at timestamp"
)


def approval_steps(spark: SparkSession, sf: str) -> DataFrame:
    """The table of approval steps: derived once per session, then read from the shared folder.

    Jobs on steps read them two or three times; the reduction of all line
    items behind them is not repeated each time.
    """
    return spark.read.schema(APPROVAL_STEPS).parquet(_stored_steps(spark, sf))


def _stored_steps(spark: SparkSession, sf: str) -> str:
    return stored_input(
        spark, "approval-steps", [f"{sf}/lineitem.parquet"], lambda path: derived_steps(spark, sf).write.parquet(path)
    )


def derived_steps(spark: SparkSession, sf: str) -> DataFrame:
    """One row per (request, step, approver) from the line items: the earliest one counts."""
    unique = (
        table(spark, sf, "lineitem")
        .groupBy(
            F.col("l_orderkey").alias("request_id"),
            F.col("l_linenumber").alias("step_order"),
            _text("l_suppkey").alias("approver_username"),
        )
        .agg(F.min(F.struct("l_shipdate", "l_partkey", "l_returnflag")).alias("k"))
    )
    flag = F.col("k.l_returnflag")
    status = (
        F.when(flag == "R", F.lit("rejected"))
        .when((flag == "N") & (F.col("step_order") % 3 == 0), F.lit("pending_external"))
        .when(flag == "N", F.lit("pending"))
        .when(F.col("request_id") % 7 == 0, F.lit("escalated"))
        .otherwise(F.lit("approved"))
    )
    return unique.select(
        F.concat_ws("/", _text("request_id"), _text("step_order"), "approver_username").alias("id"),
        "request_id",
        "step_order",
        "approver_username",
        status.alias("status"),
        F.col("k.l_shipdate").cast("timestamp").alias("activated_at"),
    )


VIEW_SQL["v_grants"] = """
SELECT CAST(user_id AS VARCHAR) AS username, 'demo.t' || (event_id % 20) AS table_fqn,
       CAST(1 + event_id % 3 AS INTEGER) AS security_level,
       strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS granted_at,
       CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 53 = 0 THEN 'soon'
            ELSE strftime(ts + INTERVAL 5 DAY, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' END AS expires_at,
       ts AS granted_ts,
       CASE WHEN event_id % 7 = 0 OR event_id % 53 = 0 THEN NULL ELSE ts + INTERVAL 5 DAY END AS expires_ts
FROM events WHERE event_type = 'signup'
"""


def grants(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("event_id")
    rows = events(spark, sf).where(F.col("event_type") == "signup")
    return rows.select(
        _text("user_id").alias("username"),
        F.concat(F.lit("demo.t"), _text(key % 20)).alias("table_fqn"),
        (1 + key % 3).cast("int").alias("security_level"),
        _iso(F.col("ts")).alias("granted_at"),
        F.when(key % 7 == 0, F.lit(""))
        .when(key % 53 == 0, F.lit("soon"))
        .otherwise(_iso(F.col("ts") + F.expr("INTERVAL 5 DAYS")))
        .alias("expires_at"),
    )


VIEW_SQL["v_access_log"] = """
SELECT event_id, CASE WHEN user_id % 50 = 0 THEN 'superset_service' ELSE CAST(user_id AS VARCHAR) END AS "user",
       user_id % 50 = 1 AS is_admin,
       CASE event_type WHEN 'view' THEN 'SelectFromColumns' WHEN 'purchase' THEN 'InsertIntoTable'
            WHEN 'click' THEN 'ShowTables' ELSE 'ShowCreateTable' END AS operation,
       'trino.iceberg.demo.t' || (event_id % 20) AS table_fqn, 'demo.t' || (event_id % 20) AS short_name, ts
FROM events WHERE event_type <> 'signup'
"""


def access_log(spark: SparkSession, sf: str) -> DataFrame:
    kind, person = F.col("event_type"), F.col("user_id")
    return (
        events(spark, sf)
        .where(kind != "signup")
        .select(
            "event_id",
            F.when(person % 50 == 0, F.lit("superset_service")).otherwise(_text(person)).alias("user"),
            F.array(
                F.when(person % 50 == 1, F.lit("platform-team")).otherwise(F.lit("data-analysts"))
            ).alias("groups"),
            F.when(kind == "view", F.lit("SelectFromColumns"))
            .when(kind == "purchase", F.lit("InsertIntoTable"))
            .when(kind == "click", F.lit("ShowTables"))
            .otherwise(F.lit("ShowCreateTable"))
            .alias("operation"),
            F.concat(F.lit("trino.iceberg.demo.t"), _text(F.col("event_id") % 20)).alias("table_fqn"),
            "ts",
        )
    )


VIEW_SQL["v_group_requests"] = """
SELECT event_id AS id, CAST(user_id AS VARCHAR) AS username, CASE event_id % 5 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'HOUSEHOLD'
           WHEN 2 THEN 'VIEWERS' ELSE 'group-' || (event_id % 7) END AS group_name,
       CASE WHEN event_id % 13 = 0 THEN 'rejected' ELSE 'pending' END AS status, ts AS requested_at,
       CASE WHEN event_id % 13 = 0 THEN 'admin0' END AS decided_by, CASE WHEN event_id % 13 = 0 THEN ts + INTERVAL 1 HOUR END AS decided_at
FROM events WHERE event_type = 'view'
"""
# A third of the requests is approved, a third rejected; some are decided twice.
VIEW_SQL["v_group_decisions"] = """
SELECT event_id AS request_id, CASE event_id % 3 WHEN 0 THEN 'approve' ELSE 'reject' END AS verdict, 'admin' || (event_id % 4) AS decided_by,
       ts + INTERVAL 1 DAY AS decided_at FROM events WHERE event_type = 'view' AND event_id % 3 <> 2
UNION ALL
SELECT event_id, 'reject', 'admin9', ts + INTERVAL 2 DAY FROM events WHERE event_type = 'view' AND event_id % 6 = 0
"""


def group_requests(spark: SparkSession, sf: str) -> DataFrame:
    key, ts, settled = F.col("event_id"), F.col("ts"), F.col("event_id") % 13 == 0
    group = (
        F.when(key % 5 == 0, "BUILDING").when(key % 5 == 1, "HOUSEHOLD").when(key % 5 == 2, "VIEWERS")
        .otherwise(F.concat(F.lit("group-"), _text(key % 7)))
    )
    return events(spark, sf).where("event_type = 'view'").select(
        key.alias("id"),
        _text("user_id").alias("username"),
        group.alias("group_name"),
        F.when(settled, "rejected").otherwise("pending").alias("status"),
        ts.alias("requested_at"),
        F.when(settled, F.lit("admin0")).alias("decided_by"),
        F.when(settled, ts + F.expr("INTERVAL 1 HOUR")).alias("decided_at"),
    )


def group_decisions(spark: SparkSession, sf: str) -> DataFrame:
    key, rows = F.col("event_id"), events(spark, sf).where("event_type = 'view'")
    first = rows.where(key % 3 != 2).select(
        key.alias("request_id"),
        F.when(key % 3 == 0, "approve").otherwise("reject").alias("verdict"),
        F.concat(F.lit("admin"), _text(key % 4)).alias("decided_by"),
        (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("decided_at"),
    )
    again = rows.where(key % 6 == 0).select(
        key.alias("request_id"),
        F.lit("reject").alias("verdict"),
        F.lit("admin9").alias("decided_by"),
        (F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("decided_at"),
    )
    return first.unionByName(again)


VIEW_SQL["v_members_current"] = """
SELECT CAST(c_custkey AS VARCHAR) AS username, c_mktsegment AS "group" FROM customer
"""
VIEW_SQL["v_members_desired"] = """
SELECT CAST(c_custkey AS VARCHAR) AS username, c_mktsegment AS "group" FROM customer WHERE c_acctbal >= 0
UNION ALL
SELECT CAST(c_custkey AS VARCHAR), 'VIEWERS' FROM customer WHERE c_nationkey < 3
"""
VIEW_SQL["v_known_groups"] = """
SELECT DISTINCT c_mktsegment AS "group" FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'
UNION ALL SELECT 'VIEWERS'
"""
VIEW_SQL["v_handover"] = """
SELECT CAST(c_custkey AS VARCHAR) AS from_user, CAST(c_custkey + 1 AS VARCHAR) AS to_user
FROM customer WHERE c_acctbal < 0
"""


def members_current(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        _text("c_custkey").alias("username"), F.col("c_mktsegment").alias("group")
    )


def members_desired(spark: SparkSession, sf: str) -> DataFrame:
    """Customers in debt leave their segment's group; some nations become viewers."""
    groups = F.array(
        F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")), F.when(F.col("c_nationkey") < 3, F.lit("VIEWERS"))
    )
    return table(spark, sf, "customer").select(
        _text("c_custkey").alias("username"), F.explode(F.array_compact(groups)).alias("group")
    )


def known_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Declared groups: one segment is not declared, and one more group is."""
    names = F.explode(F.array(F.col("c_mktsegment"), F.lit("VIEWERS"))).alias("group")
    return table(spark, sf, "customer").select(names).where(F.col("group") != "HOUSEHOLD").distinct()


def handover(spark: SparkSession, sf: str) -> DataFrame:
    """Customers in debt hand over to the next one, who may hand over as well."""
    key = F.col("c_custkey")
    return table(spark, sf, "customer").where(F.col("c_acctbal") < 0).select(
        _text(key).alias("from_user"), _text(key + 1).alias("to_user")
    )


VIEW_SQL["v_contracts"] = r"""
SELECT p_partkey AS id, CASE p_partkey % 8
    WHEN 0 THEN E'id BIGINT\nname VARCHAR(100)\nc' || p_partkey || ' DOUBLE'
    WHEN 1 THEN E'  id bigint\n\n   c' || p_partkey || '   integer  '
    WHEN 2 THEN E'id BIGINT\nbad_line_' || p_partkey
    WHEN 3 THEN p_partkey || 'id BIGINT'
    WHEN 4 THEN E'id BIGINT\n\ndata JSON'
    WHEN 5 THEN E'   \n  \n'
    WHEN 6 THEN E'price VARCHAR(10, 2)\namount decimal(10,2)\ncode char'
    ELSE 'id;DROP_TABLE BIGINT' END AS columns_raw
FROM part
"""


def contracts(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    variants = [
        F.concat(F.lit("id BIGINT\nname VARCHAR(100)\nc"), _text(key), F.lit(" DOUBLE")),
        F.concat(F.lit("  id bigint\n\n   c"), _text(key), F.lit("   integer  ")),
        F.concat(F.lit("id BIGINT\nbad_line_"), _text(key)),
        F.concat(_text(key), F.lit("id BIGINT")),
        F.lit("id BIGINT\n\ndata JSON"),
        F.lit("   \n  \n"),
        F.lit("price VARCHAR(10, 2)\namount decimal(10,2)\ncode char"),
        F.lit("id;DROP_TABLE BIGINT"),
    ]
    return table(spark, sf, "part").select(
        key.alias("id"), F.get(F.array(*variants), (key % 8).cast("int")).alias("columns_raw")
    )


VIEW_SQL["v_entities"] = """
SELECT 'trino.iceberg.s' || (p_partkey % 7) || '.T' || p_partkey AS fqn, 's' || (p_partkey % 7) AS "schema",
       CAST(CASE p_partkey % 4 WHEN 0 THEN (CASE WHEN p_partkey % 8 = 0 THEN 1 END)
            WHEN 1 THEN 1 + p_size % 3 WHEN 2 THEN 2 ELSE 3 END AS INTEGER) AS security_level,
       CASE p_partkey % 3 WHEN 0 THEN 'reg ' || p_brand WHEN 1 THEN 'u' || p_size END AS owner,
       'c1,' || p_type AS column_names
FROM part
"""


def catalog_documents(spark: SparkSession, sf: str) -> DataFrame:
    """JSON text of catalogue entities with tags, owners, extension and columns."""
    key = F.col("p_partkey")
    tag = lambda *names: F.array(*[F.struct(n.alias("tagFQN")) for n in names])
    level = lambda text: F.concat(F.lit("SecurityLevel.Level"), text)
    none = F.from_json(F.lit("[]"), "array<struct<tagFQN:string>>")
    tags = (
        F.when(key % 4 == 0, none)
        .when(key % 4 == 1, tag(level(_text(1 + F.col("p_size") % 3))))
        .when(key % 4 == 2, tag(F.lit("PII.Sensitive"), level(F.lit("2")), level(F.lit("X"))))
        .otherwise(tag(level(F.lit("1")), level(F.lit("3"))))
    )
    person = lambda kind, name: F.struct(F.lit(kind).alias("type"), name.alias("name"))
    owners = (
        F.when(key % 3 == 0, F.array(person("team", F.col("p_brand"))))
        .when(
            key % 3 == 1,
            F.array(person("team", F.col("p_brand")), person("user", F.concat(F.lit("u"), _text("p_size")))),
        )
        .otherwise(F.from_json(F.lit("[]"), "array<struct<type:string,name:string>>"))
    )
    extension = F.struct(
        F.when(key % 8 == 0, F.lit(1)).alias("securityLevel"),
        F.when(key % 3 == 0, F.concat(F.lit("reg "), "p_brand")).alias("registeredOwner"),
    )
    columns = F.array(
        *[F.struct(n.alias("name"), F.lit("VARCHAR").alias("dataType")) for n in (F.lit("c1"), F.col("p_type"))]
    )
    doc = F.to_json(
        F.struct(
            F.concat(F.lit("trino.iceberg.s"), _text(key % 7), F.lit(".T"), _text(key)).alias("fullyQualifiedName"),
            tags.alias("tags"),
            owners.alias("owners"),
            extension.alias("extension"),
            columns.alias("columns"),
        )
    )
    return table(spark, sf, "part").select(key.alias("id"), doc.alias("doc_json"))


VIEW_SQL["v_sinks"] = """
SELECT DISTINCT 'pipe-' || (user_id % 40) AS pipeline_id, 'trino.iceberg.demo.t' || (event_id % 30) AS table_fqn
FROM events WHERE event_type <> 'error'
"""
VIEW_SQL["v_known_tables"] = """
SELECT DISTINCT 'trino.iceberg.demo.t' || (p_partkey % 25) AS table_fqn, 'id-' || (p_partkey % 25) AS table_id FROM part
"""


def job_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Job runs with their JSON configuration; runs of one type have no lake sink."""
    lake = F.struct(
        F.lit("Iceberg").alias("plugin_name"),
        F.lit("demo").alias("namespace"),
        F.concat(F.lit("t"), _text(F.col("event_id") % 30)).alias("table"),
    )
    other = F.struct(
        F.lit("Console").alias("plugin_name"), F.lit("demo").alias("namespace"), F.lit("none").alias("table")
    )
    sinks = F.when(F.col("event_type") == "error", F.array(other)).otherwise(F.array(other, lake))
    return table(spark, sf, "events").select(
        F.concat(F.lit("pipe-"), _text(F.col("user_id") % 40)).alias("pipeline_id"),
        F.to_json(F.struct(sinks.alias("sink"))).alias("config_json"),
    )


def known_tables(spark: SparkSession, sf: str) -> DataFrame:
    number = _text(F.col("p_partkey") % 25)
    return (
        table(spark, sf, "part")
        .select(
            F.concat(F.lit("trino.iceberg.demo.t"), number).alias("table_fqn"),
            F.concat(F.lit("id-"), number).alias("table_id"),
        )
        .distinct()
    )


# -- logs and series ---------------------------------------------------------

VIEW_SQL["v_log_lines"] = """
SELECT 'ns-' || (user_id % 3) AS namespace, 'pod-' || (user_id % 10) AS pod, 'app' AS container,
       'ns-' || (user_id % 3) || '/app' AS job, ts,
       'level=' || CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END || ' msg=' || event_type ||
       ' value=' || printf('%.2f', value) ||
       CASE WHEN event_id % 89 = 0 THEN ' url=http://bob:secret@db' ELSE '' END AS line
FROM events
"""


def raw_log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(path, ts, line) as a collector sees them, before relabelling."""
    person = F.col("user_id")
    path = F.concat(
        F.lit("/var/log/pods/ns-"), _text(person % 3), F.lit("_pod-"), _text(person % 10), F.lit("_u"),
        _text(person), F.lit("/app/0.log"),
    )
    line = F.concat(
        F.lit("level="),
        F.when(F.col("event_type") == "error", F.lit("error")).otherwise(F.lit("info")),
        F.lit(" msg="),
        "event_type",
        F.lit(" value="),
        F.format_string("%.2f", "value"),
        F.when(F.col("event_id") % 89 == 0, F.lit(" url=http://bob:secret@db")).otherwise(F.lit("")),
    )
    return events(spark, sf).select(path.alias("path"), "ts", line.alias("line"))


VIEW_SQL["v_requests_series"] = """
SELECT 'ns-' || (user_id % 2) AS namespace, 'svc-' || (user_id % 3) AS job, event_type AS route,
       CASE WHEN event_type = 'error' OR event_id % 6 = 0 THEN '500' WHEN event_type = 'signup' THEN '404'
            WHEN event_id % 17 = 3 THEN 'success' ELSE '200' END AS status_code,
       CAST(value / 100 AS DECIMAL(18,4)) AS duration, ts, event_id AS tie
FROM events
"""


def requests_series(spark: SparkSession, sf: str) -> DataFrame:
    kind, key = F.col("event_type"), F.col("event_id")
    return events(spark, sf).select(
        *_series_labels(),
        F.when((kind == "error") | (key % 6 == 0), F.lit("500"))
        .when(kind == "signup", F.lit("404"))
        .when(key % 17 == 3, F.lit("success"))
        .otherwise(F.lit("200"))
        .alias("status_code"),
        (F.col("value") / 100).cast("decimal(18,4)").alias("duration"),
        "ts",
        key.alias("tie"),
    )


def _series_labels() -> list[Column]:
    return [
        F.concat(F.lit("ns-"), _text(F.col("user_id") % 2)).alias("namespace"),
        F.concat(F.lit("svc-"), _text(F.col("user_id") % 3)).alias("job"),
        F.col("event_type").alias("route"),
    ]


# A counter that grows with the event number and restarts every 500 events.
VIEW_SQL["v_counter"] = """
SELECT 'ns-' || (user_id % 2) AS namespace, 'svc-' || (user_id % 3) AS job, event_type AS route, ts, event_id AS tie,
       CAST(event_id % 500 AS DOUBLE) AS value
FROM events
"""


def counter(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(
        *_series_labels(), "ts", F.col("event_id").alias("tie"), (F.col("event_id") % 500).cast("double").alias("value")
    )


# Counters of a histogram: one series per pod and bound; each bound starts anew at a time of its own.
BOUNDS = [0.1, 0.5, 1.0, 2.0, 5.0, float("inf")]
VIEW_SQL["v_bucket_counters"] = """
SELECT 'ns-' || (user_id % 2) AS namespace, 'svc-' || (user_id % 3) AS job, event_type AS route, 'pod-' || (user_id % 4) AS pod,
       ts, event_id AS tie, le, CAST((event_id + 7 * i) % 500 * (i + 1 + user_id % 3) AS DOUBLE) AS value
FROM events, (SELECT unnest([0.1::DOUBLE, 0.5, 1, 2, 5, 'Infinity']) AS le, unnest(range(6)) AS i)
"""


def bucket_counters(spark: SparkSession, sf: str) -> DataFrame:
    bounds = F.array(*(F.struct(F.lit(le).alias("le"), F.lit(i).alias("i")) for i, le in enumerate(BOUNDS)))
    rows = events(spark, sf).select("event_id", "user_id", "ts", *_series_labels(), F.inline(bounds))
    value = (F.col("event_id") + 7 * F.col("i")) % 500 * (F.col("i") + 1 + F.col("user_id") % 3)
    return rows.select(
        "namespace", "job", "route", _pod(), "ts", F.col("event_id").alias("tie"), "le", value.cast("double").alias("value")
    )


# The sum and the count counter of the same histogram; eighths of a second keep sums exact.
VIEW_SQL["v_latency_counters"] = """
SELECT 'ns-' || (user_id % 2) AS namespace, 'svc-' || (user_id % 3) AS job, event_type AS route, 'pod-' || (user_id % 4) AS pod,
       ts, event_id AS tie, part, CASE part WHEN 'sum' THEN CAST(event_id % 400 * (1 + user_id % 3) AS DOUBLE) / 8
       ELSE CAST(event_id % 500 AS DOUBLE) END AS value
FROM events, (SELECT unnest(['sum', 'count']) AS part)
"""


def latency_counters(spark: SparkSession, sf: str) -> DataFrame:
    total = (F.col("event_id") % 400 * (1 + F.col("user_id") % 3)).cast("double") / 8
    parts = F.array(
        F.struct(F.lit("sum").alias("part"), total.alias("value")),
        F.struct(F.lit("count").alias("part"), (F.col("event_id") % 500).cast("double").alias("value")),
    )
    return events(spark, sf).select(*_series_labels(), _pod(), "ts", F.col("event_id").alias("tie"), F.inline(parts))


def _pod() -> Column:
    return F.concat(F.lit("pod-"), _text(F.col("user_id") % 4)).alias("pod")


# What each instance of a job that should run once reports.
VIEW_SQL["v_running"] = """
SELECT event_type AS cluster, 'ns-' || (user_id % 3) AS namespace, user_id AS instance, ts,
       CAST(CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS value
FROM events
"""


def running(spark: SparkSession, sf: str) -> DataFrame:
    person = F.col("user_id")
    return events(spark, sf).select(
        F.col("event_type").alias("cluster"),
        F.concat(F.lit("ns-"), _text(person % 3)).alias("namespace"),
        person.alias("instance"),
        "ts",
        F.when(person % 2 == 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("value"),
    )


VIEW_SQL["v_gauge"] = """
SELECT DISTINCT event_type AS cluster, 'ns-' || (user_id % 3) AS namespace, user_id AS instance,
       CAST(CASE WHEN user_id % 5 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS value
FROM events
"""


def gauge(spark: SparkSession, sf: str) -> DataFrame:
    person = F.col("user_id")
    return (
        table(spark, sf, "events")
        .select(
            F.col("event_type").alias("cluster"),
            F.concat(F.lit("ns-"), _text(person % 3)).alias("namespace"),
            person.alias("instance"),
            F.when(person % 5 == 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("value"),
        )
        .distinct()
    )


VIEW_SQL["v_predictions"] = "SELECT doc_id, quality AS label, toxic AS prediction FROM labels"


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select(
        "doc_id", F.col("quality").alias("label"), F.col("toxic").alias("prediction")
    )


VIEW_SQL["v_versions"] = """
SELECT p_brand AS model_name, CAST(p_partkey AS VARCHAR) AS version,
       CASE WHEN p_size % 5 = 0 THEN 'PENDING' ELSE 'READY' END AS status
FROM part
"""


def versions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("model_name"),
        _text("p_partkey").alias("version"),
        F.when(F.col("p_size") % 5 == 0, F.lit("PENDING")).otherwise(F.lit("READY")).alias("status"),
    )


VIEW_SQL["v_scan_before"] = """
SELECT 'demo.t' || p_partkey AS table_name, p_type AS signature FROM part WHERE p_size <> 3
"""
VIEW_SQL["v_scan_after"] = """
SELECT 'demo.t' || p_partkey AS table_name, CASE WHEN p_partkey % 5 = 1 THEN p_type || '+' ELSE p_type END AS signature
FROM part WHERE p_size <> 7
"""


def scan_before(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").where(F.col("p_size") != 3)
    return rows.select(F.concat(F.lit("demo.t"), _text("p_partkey")).alias("table_name"), F.col("p_type").alias("signature"))


def scan_after(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").where(F.col("p_size") != 7)
    changed = F.when(F.col("p_partkey") % 5 == 1, F.concat("p_type", F.lit("+"))).otherwise(F.col("p_type"))
    return rows.select(F.concat(F.lit("demo.t"), _text("p_partkey")).alias("table_name"), changed.alias("signature"))
