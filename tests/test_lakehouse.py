"""Sources, sinks, models, features and quality gates on the demo rows."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tarnwork import schemas
from tarnwork.plans import features, models, quality
from tarnwork.plans.features import CUSTOMER_ORDERS
from tarnwork.session import scratch_path, work_dir
from tarnwork.sinks import tables as sinks
from tarnwork.sources import events as event_source
from tarnwork.sources import logs, tables
from tests.conftest import tuples

TOTALS = {"East": 280.74, "North": 275.50, "South": 280.00, "West": 241.00}


def test_region_totals(orders):
    got = {r: float(t) for r, t in tuples(models.orders_by_region(models.stg_orders(orders)))}
    assert got == TOTALS
    assert quality.group_count(orders, "region", 4).first().passed


def test_chart_page_is_sorted_and_limited(orders):
    assert [r for r, _ in tuples(models.region_chart(orders, row_limit=2))] == ["East", "South"]


def test_daily_totals(orders):
    rows = models.daily_order_totals(orders).where("region = 'East'").orderBy("order_date")
    assert [(d, n, float(a)) for d, _, n, a in tuples(rows)] == [
        (date(2026, 7, 1), 1, 120.5), (date(2026, 7, 5), 1, 60.25), (date(2026, 7, 18), 1, 99.99),
    ]


def test_known_value_online(spark, orders):
    source = features.order_feature_source(orders)
    snapshot = features.materialize(source, CUSTOMER_ORDERS, "2026-01-01", "2026-12-31")
    asked = spark.createDataFrame([("Alice",), ("Bob",), ("Nobody",)], "customer_name string")
    got = {n: (r, p, None if a is None else float(a)) for n, r, p, a in tuples(features.online_lookup(asked, snapshot, CUSTOMER_ORDERS))}
    assert got == {"Alice": ("East", "Widget", 120.5), "Bob": ("West", "Gadget", 85.0), "Nobody": (None, None, None)}


def feature_frame(spark, rows):
    return spark.createDataFrame(
        [(c, "r", p, float(i), datetime(2024, 1, d), i) for c, p, d, i in rows],
        "customer_name string, region string, product string, amount double, event_timestamp timestamp, order_id long",
    )


def test_incremental_materialisation_is_repeatable_and_keeps_newer_rows(spark):
    source = feature_frame(spark, [("a", "p1", 1, 1), ("a", "p2", 5, 2), ("b", "q1", 2, 3), ("b", "q2", 2, 4), ("c", "x", 9, 5)])
    full = features.materialize(source, CUSTOMER_ORDERS, "2024-01-01", "2024-01-08")
    assert dict(tuples(full, "customer_name", "product")) == {"a": "p2", "b": "q2"}
    half = features.materialize(source, CUSTOMER_ORDERS, "2024-01-01", "2024-01-03")
    step = features.materialize_incremental(half, source, CUSTOMER_ORDERS, "2024-01-03", "2024-01-08")
    again = features.materialize_incremental(step, source, CUSTOMER_ORDERS, "2024-01-03", "2024-01-08")
    assert sorted(tuples(step)) == sorted(tuples(full)) == sorted(tuples(again))
    # A late, older row does not replace a newer one.
    old = feature_frame(spark, [("a", "late", 4, 99)])
    kept = features.materialize_incremental(step, old, CUSTOMER_ORDERS, "2024-01-03", "2024-01-08")
    assert sorted(tuples(kept)) == sorted(tuples(full))


def test_gates(spark, orders):
    empty = orders.limit(0)
    with pytest.raises(quality.EmptySource):
        quality.require_rows(empty, "orders")
    assert quality.require_rows(orders, "orders") is orders
    assert tuples(quality.nonempty(empty)) == [(0, False)]
    assert quality.enough_to_train(orders, "region").first().passed
    assert not quality.enough_to_train(orders.limit(3), "region").first().passed
    assert not quality.enough_to_train(orders.where("region = 'East' OR region = 'x'").unionByName(orders.where("region = 'East'")), "region").first().passed
    assert tuples(quality.count_grew(orders.limit(4), orders)) == [(4, 10, True)]
    assert tuples(quality.count_grew(orders, orders)) == [(10, 10, False)]
    upper = tables.describe(orders.withColumnRenamed("region", "REGION").drop("amount"), "o")
    assert tuples(quality.missing_columns(tables.describe(orders, "o"), upper)) == [("o", "amount")]


def test_append_three_runs_and_refresh(spark, orders):
    path, other = scratch_path(spark, "t"), scratch_path(spark, "t")
    for _ in range(3):
        sinks.append(orders, path)
        sinks.full_refresh(orders, other)
    assert spark.read.parquet(path).count() == 30
    assert spark.read.parquet(other).count() == 10


def test_tables_by_name(spark, orders):
    sinks.create_schema(spark, "t_demo", scratch_path(spark, "db"))
    name, location = "t_demo.orders", scratch_path(spark, "orders")
    sinks.create_table(spark, name, schemas.ORDERS, location)
    sinks.create_table(spark, name, schemas.ORDERS, location)
    assert spark.table(name).schema == schemas.ORDERS
    sinks.insert_into(orders.select(*reversed(orders.columns)), name)
    assert sorted(tuples(spark.table(name))) == sorted(tuples(orders))
    replaced = sinks.create_or_replace(models.orders_by_region(orders), "t_demo.by_region", scratch_path(spark, "r"))
    assert replaced.count() == 4
    root = scratch_path(spark, "r")
    for expected in (4, 2, 1):  # the frame reads the table it replaces
        table = spark.table("t_demo.by_region") if expected < 4 else replaced
        again = sinks.create_or_replace(table.orderBy("region").limit(expected), "t_demo.by_region", root)
        assert again.count() == spark.table("t_demo.by_region").count() == expected
    assert tables.scan(spark, name, ["region"]).distinct().count() == 4
    assert tables.run_sql(spark, "SELECT count(*) AS n FROM t_demo.orders").first().n == 10
    inside = tables.run_sql(spark, "SELECT count(*) AS n FROM orders", catalog="spark_catalog", schema="t_demo")
    assert spark.catalog.currentDatabase() == "default" and inside.first().n == 10


def test_snapshots_show_finished_versions_only(spark, orders):
    root = scratch_path(spark, "snap")
    assert sinks.snapshot_versions(spark, root) == []
    with pytest.raises(FileNotFoundError):
        sinks.read_snapshot(spark, root)
    sinks.publish_snapshot(orders.limit(1), root, 9)
    sinks.publish_snapshot(orders, root, 10)
    assert sinks.snapshot_versions(spark, root) == [9, 10]
    assert sinks.read_snapshot(spark, root).count() == 10
    assert sinks.read_snapshot(spark, root, 9).count() == 1
    spark.range(1).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{root}/version=000000000011")
    assert sinks.snapshot_versions(spark, root) == [9, 10]


def test_csv_by_name(spark, tmp_path):
    path = tmp_path / "grants.csv"
    path.write_text("table_fqn,username,security_level,granted_at,expires_at\ndemo.t,u1,2,2026-01-01T00:00:00+00:00,\ndemo.t,u2,1,x,2099-01-01T00:00:00+00:00\n")
    assert tuples(tables.read_grants(spark, str(path)), "username", "table_fqn", "security_level", "expires_at") == [
        ("u1", "demo.t", 2, ""), ("u2", "demo.t", 1, "2099-01-01T00:00:00+00:00"),
    ]
    old = tmp_path / "old.csv"
    old.write_text("username,table_fqn,security_level,granted_at\nu1,demo.t,2,x\n")
    assert tuples(tables.read_grants(spark, str(old)), "username", "expires_at") == [("u1", "")]
    members = tmp_path / "members.csv"
    members.write_text("username,group\n admin , platform-team\n")
    assert tuples(tables.read_memberships(spark, str(members))) == [("admin", "platform-team")]


def test_pod_logs(spark, tmp_path):
    folder = tmp_path / "prod_api-7f_0a1b" / "web"
    folder.mkdir(parents=True)
    (folder / "0.log").write_text("level=info msg=one\nlevel=error msg=two\n")
    got = logs.read_pod_logs(spark, str(tmp_path))
    assert sorted(tuples(got)) == [
        ("prod", "api-7f", "web", "prod/web", "level=error msg=two"), ("prod", "api-7f", "web", "prod/web", "level=info msg=one"),
    ]
    out, ckpt = scratch_path(spark, "logs"), scratch_path(spark, "ckpt")
    stream = logs.read_pod_logs(spark, str(tmp_path), streaming=True)
    stream.writeStream.format("parquet").option("checkpointLocation", ckpt).trigger(availableNow=True).start(out).awaitTermination()
    assert spark.read.parquet(out).count() == 2


MESSAGES = [
    '{"event_id":1,"device_id":"device-001","event_type":"error","value":1.5,"event_time":"2026-08-01T00:00:00.123Z"}',
    '{"event_id":2,"device_id":"device-002","event_type":"error","value":"bad","event_time":"2026-08-01T00:00:01"}',
    '{"event_id":3}',
    "not json",
    "[1]",
    "{}",
    None,
]


def test_tolerant_decoding(spark):
    decoded = event_source.decode_messages(spark.createDataFrame([(m,) for m in MESSAGES], "value string"))
    assert sorted(tuples(event_source.valid_events(decoded), "event_id", "value", "event_time")) == [
        (1, 1.5, datetime(2026, 8, 1, 0, 0, 0, 123000)), (2, None, datetime(2026, 8, 1, 0, 0, 1)),
    ]
    bad = tuples(event_source.quarantined(decoded))
    assert sorted(bad, key=str) == sorted(
        [(MESSAGES[2], "no event time"), ("not json", "not json"), ("[1]", "not json"), ("{}", "no event time"), (None, "not json")], key=str
    )
    assert len(bad) + event_source.valid_events(decoded).count() == len(MESSAGES)


def test_generators_are_repeatable(spark):
    ids = spark.range(500)
    one = event_source.device_events(ids, "id", F.lit("2026-01-01").cast("timestamp"))
    two = event_source.device_events(ids.repartition(7), "id", F.lit("2026-01-01").cast("timestamp"))
    assert sorted(tuples(one)) == sorted(tuples(two))
    assert {d for (d,) in tuples(one, "device_id")} == {f"device-{i:03d}" for i in range(1, 11)}
    assert {t for (t,) in tuples(one, "event_type")} == set(event_source.EVENT_TYPES)
    assert one.where("value < 0 OR value > 100 OR value <> round(value, 2)").count() == 0
    typed = event_source.synthetic_rows(ids, "id", schemas.ORDERS)
    assert [f.dataType for f in typed.schema.fields] == [f.dataType for f in schemas.ORDERS.fields]
    assert typed.count() == 500


def test_messages_round_trip(spark):
    events = event_source.device_events(spark.range(50), "id", F.lit("2026-01-01 10:00:00.5").cast("timestamp"))
    sent = event_source.encode_messages(events)
    back = event_source.valid_events(event_source.decode_messages(sent))
    assert sorted(tuples(back)) == sorted(tuples(events))
    assert tuples(sent, "key") == tuples(events, "device_id")


def test_json_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "sink": [ {"plugin_name": "Iceberg",\n "namespace": "demo", "table": "t"} ]\n}')
    got = tables.read_documents(spark, str(tmp_path), schemas.JOB_CONFIG)
    assert tuples(got.select(F.inline("sink"))) == [("Iceberg", "demo", "t")]


def test_work_folder_is_the_session_setting(spark):
    assert spark.conf.get("spark.checkpoint.dir").rstrip("/") == work_dir(spark)
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_refresh_may_read_the_table_it_replaces(spark, tmp_path):
    from pyspark.sql import functions as F

    from tarnwork.sinks import tables as sinks

    path = str(tmp_path / "t")
    sinks.full_refresh(spark.range(10), path)
    for _ in range(2):
        sinks.full_refresh(spark.read.parquet(path).withColumn("id", F.col("id") + 1), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(2, 12))
    with pytest.raises(Exception):
        sinks.full_refresh(spark.read.parquet(path).withColumn("id", F.raise_error(F.lit("broken")).cast("long")), path)
    assert spark.read.parquet(path).count() == 10
    assert [p.name for p in tmp_path.iterdir() if ".old-" in p.name] == []


def test_unchanged_columns_never_drop_the_table(spark, tmp_path):
    from pyspark.sql import functions as F

    from tarnwork.sinks import tables as sinks

    spark.sql(f"CREATE SCHEMA IF NOT EXISTS keep_demo LOCATION '{tmp_path}/schema'")
    first = spark.range(5).select(F.col("id").alias("n"))  # not nullable
    sinks.create_or_replace(first, "keep_demo.t", str(tmp_path / "rows"))
    spark.sql("ALTER TABLE keep_demo.t SET TBLPROPERTIES ('mark' = 'kept')")
    sinks.create_or_replace(spark.table("keep_demo.t").agg(F.sum("n").alias("n")), "keep_demo.t", str(tmp_path / "rows"))
    assert [r.n for r in spark.table("keep_demo.t").collect()] == [10]
    assert "kept" in str(spark.sql("SHOW TBLPROPERTIES keep_demo.t").collect())


def test_length_out_of_range_is_an_error_of_the_contract(spark):
    from tarnwork.plans import contracts

    df = spark.createDataFrame([(1, "a VARCHAR(9999999999)"), (2, "a VARCHAR(10)"), (3, "a VARCHAR")], "id int, contract string")
    checked = contracts.check_contracts(df, "contract")
    assert {r.id: r.error and r.error.reason for r in checked.collect()} == {1: contracts.BAD_LENGTH, 2: None, 3: None}
