"""Labels, log lines, histograms, series joins and models."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tarnwork.functions import labels
from tarnwork.operators import series
from tarnwork.plans import ml
from tarnwork.plans import observability as obs
from tarnwork.operators.keyed import dense_codes, latest_per_key, rows_in, rows_not_in
from tests.conftest import tuples

T0 = datetime(2024, 1, 1)
INF = float("inf")


def test_label_match_is_anchored(spark):
    df = spark.createDataFrame([("abc",), ("xabc",), (None,), ("",)], "l string")
    assert tuples(df.where(labels.label_matches(F.col("l"), "a.c"))) == [("abc",)]
    assert len(tuples(df.where(labels.label_not_matches(F.col("l"), "a.c")))) == 3
    assert len(tuples(df.where(labels.label_matches(F.col("l"), "")))) == 2
    assert tuples(df.where(labels.label_matches(F.col("l"), "abc|x"))) == [("abc",)]


def test_status_class(spark):
    df = spark.createDataFrame([("200",), ("404",), ("success",), ("1234",), (None,)], "s string")
    assert [r[0] for r in tuples(df.select(obs.status_class(F.col("s"))))] == ["2xx", "4xx", "success", None, None]


def test_label_replace_keeps_unmatched_and_drops_empty(spark):
    df = spark.createDataFrame([("/dev/sda", "t"), ("sda", "t"), ("/dev/", "t")], "s string, t string")
    got = df.select(labels.label_replace(F.col("t"), "$1", F.col("s"), "/dev/(.*)"))
    assert [r[0] for r in tuples(got)] == ["sda", "t", None]


def test_logfmt(spark):
    line = 'level=info msg="two words and \\"quotes\\"" empty= n=1 level=again'
    df = spark.createDataFrame([(line,), ("plain text",)], "line string")
    rows = tuples(df.select(labels.logfmt_fields(F.col("line")), labels.logfmt_value(F.col("line"), "msg"), labels.logfmt_value(F.col("line"), "level")))
    assert rows[0][0] == {"level": "info", "msg": 'two words and "quotes"', "empty": "", "n": "1"}
    assert rows[0][1:] == ('two words and "quotes"', "info")
    assert rows[1] == ({}, None, None)


@pytest.mark.parametrize("q,expected", [(0.5, 0.75), (0.9, 1.8), (0.99, 2.0), (0.25, 0.25), (1.0, 2.0)])
def test_quantile_interpolation(spark, q, expected):
    rows = [("j", 0.5, 2.0), ("j", 1.0, 3.0 + 3.0), ("j", 2.0, 8.0 + 1.0), ("j", INF, 10.0)]
    rows = [("j", 0.5, 5.0), ("j", 1.0, 5.0), ("j", 2.0, 9.5), ("j", INF, 10.0)] if q in (0.25,) else rows
    df = spark.createDataFrame(rows, "job string, le double, count double")
    total, c0, lo = 10.0, 0.0, 0.0
    for _, le, c in sorted(rows, key=lambda r: r[1]):
        if c >= q * total:
            expected = lo if le == INF else lo + (le - lo) * (q * total - c0) / (c - c0)
            break
        c0, lo = c, le
    assert tuples(series.histogram_quantile(df, ["job"], q)) == [("j", expected)]


def test_quantile_of_nothing_is_null(spark):
    df = spark.createDataFrame([("empty", 1.0, 0.0), ("empty", INF, 0.0), ("no inf", 1.0, 3.0)], "job string, le double, count double")
    assert dict(tuples(series.histogram_quantile(df, ["job"], 0.5))) == {"empty": None, "no inf": None}


def test_cumulative_buckets_and_quantile(spark):
    df = spark.createDataFrame([("a", x / 10) for x in range(1, 11)], "l string, v double")
    buckets = series.cumulative_buckets(df, ["l"], value="v", bounds=[0.5, 1.0])
    assert sorted(tuples(buckets)) == [("a", 0.5, 5.0), ("a", 1.0, 10.0), ("a", INF, 10.0)]
    assert tuples(series.histogram_quantile(buckets, ["l"], 0.5)) == [("a", 0.5)]


def test_rule_levels_sum_up(spark):
    rows = [("n1", "j", "r1", T0 + timedelta(seconds=s), s, float(s)) for s in (0, 10, 20, 61)]
    rows += [("n2", "j", "r1", T0 + timedelta(seconds=s), s, float(2 * s)) for s in (0, 30)]
    df = spark.createDataFrame(rows, "namespace string, job string, route string, ts timestamp, tie long, value double")
    got = {(lv, ns, b): r for lv, ns, _, _, b, r in tuples(obs.rate_sums(df, ["namespace", "job", "route"]))}
    minute = T0 + timedelta(minutes=1)
    assert got[("job", None, T0)] == (20 + 60) / 60
    assert got[("namespace_job_route", "n1", minute)] == 41 / 60
    assert got[("job_route", None, minute)] == 41 / 60
    assert len(got) == 3 + 2 + 2


def test_error_percent_alert(spark):
    rows = []
    for minute in range(20):
        bad = minute not in (3,)
        rows += [("n", "j", "r", T0 + timedelta(minutes=minute, seconds=s), "500" if bad and s < 30 else "200") for s in (1, 20, 40, 50)]
    df = spark.createDataFrame(rows, "namespace string, job string, route string, ts timestamp, status_code string")
    runs = obs.error_percent_alert(df, seconds=60, for_seconds=300)
    assert tuples(runs, "active_since", "last_true") == [(T0 + timedelta(minutes=4), T0 + timedelta(minutes=19))]
    quiet = df.withColumn("status_code", F.lit("200"))
    assert obs.error_percent_alert(quiet, seconds=60).count() == 0


def test_log_queries(spark):
    rows = [("ns", "a", T0, "level=error msg=x"), ("ns", "a", T0, "level=info http://u:p@h"), ("kc", "b", T0, "level=info")]
    df = spark.createDataFrame(rows, "namespace string, job string, ts timestamp, line string")
    assert obs.lines_with(df, "level=info", namespace="ns").count() == 1
    assert tuples(obs.credential_leaks(df, ["job"]), "job", "line_count") == [("a", 1)]
    assert tuples(obs.error_line_ratio(df, ["job"]), "job", "error_ratio") == [("a", 0.5)]
    assert sorted(tuples(obs.log_rate_by_level(df), "level", "rate")) == [("error", 1 / 300), ("info", 2 / 300)]


def test_series_joins(spark):
    node = spark.createDataFrame([("n1", "sda1", 5.0), ("n1", "vda", 7.0)], "instance string, device string, value double")
    pods = spark.createDataFrame(
        [("n1", "p1", "/dev/vda"), ("n1", "p2", "/dev/vda"), ("n1", "p1", "/dev/sda1"), ("n2", "p3", "/dev/vda")],
        "instance string, pod string, device string",
    )
    assert sorted(tuples(obs.rate_by_pod(node, pods), "pod", "device", "rate")) == [("p1", "vda", 7.0), ("p2", "vda", 7.0)]
    with pytest.raises(Exception, match="many-to-many"):
        obs.rate_by_pod(node.unionByName(node), pods).collect()
    left = spark.createDataFrame([("a", 10.0), ("b", 4.0)], "tenant string, value double")
    right = spark.createDataFrame([("a", 7.0)], "tenant string, value double")
    assert dict(tuples(obs.high_water_lag(left, right, ["tenant"]))) == {"a": 3.0, "b": 4.0}
    assert tuples(series.keep_if_present(left, right, ["tenant"])) == [("a", 10.0)]


def test_keyed_operators(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, None)], "k string, n int, v string")
    assert sorted(tuples(latest_per_key(df, ["k"], ["n"]))) == [("a", 3, "y"), ("b", 2, None)]
    other = spark.createDataFrame([("a",), ("a",)], "k string")
    assert tuples(rows_not_in(df, other, ["k"]), "k") == [("b",)]
    assert len(tuples(rows_in(df, other, ["k"]))) == 2


@pytest.mark.parametrize("parts", [1, 5])
def test_dense_codes(spark, parts):
    words = [f"w{i:04d}" for i in range(300)]
    df = spark.createDataFrame([(w,) for w in words * 2] + [(None,)], "w string").repartition(parts)
    assert dict(tuples(dense_codes(df, "w"))) == {w: i for i, w in enumerate(words)}


# -- models ------------------------------------------------------------------


def test_split_is_repeatable_and_close_to_its_share(spark):
    ids = spark.range(20_000)
    one = ml.split_rows(ids, "id")
    two = ml.split_rows(ids.repartition(13), "id")
    assert one.exceptAll(two).count() == 0
    assert abs(one.where("split = 'test'").count() / 20_000 - 0.2) < 0.02


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1)] * 3 + [(1, 0)] * 2 + [(0, 1)] + [(0, 0)] * 4, "label int, prediction int")
    assert tuples(ml.binary_metrics(df)) == [(3, 1, 2, 4, 0.7, 6 / 9)]
    none = ml.binary_metrics(df.where("label = 0 AND prediction = 0")).first()
    assert (none.accuracy, none.f1) == (1.0, 0.0)


def test_latest_version_is_numeric(spark):
    df = spark.createDataFrame([("m", "9", "READY"), ("m", "10", "PENDING"), ("n", "1", "READY")], "model_name string, version string, status string")
    assert sorted(tuples(ml.latest_versions(df))) == [("m", "10", "PENDING"), ("n", "1", "READY")]


def test_gate(spark):
    rows = spark.range(4)
    scored = lambda *p: spark.createDataFrame([(float(x) if x is not None else None,) for x in p], "prediction double")
    versions = spark.createDataFrame([("m", "9", "PENDING"), ("m", "10", "READY"), ("n", "1", "PENDING")], "model_name string, version string, status string")
    gate = lambda df, name="m": ml.gate(df, rows, versions, name).first()
    assert gate(scored(0, 1, 2, 0)).passed
    assert not gate(scored(0, 1, 2)).passed
    assert not gate(scored(0, 1, "nan", 2)).passed
    assert not gate(scored(0, 1, "inf", 2)).passed
    assert not gate(scored(0, 1, None, 2)).passed
    assert not gate(scored(0, 1, 2, 0), "n").passed
    assert gate(scored(0, 1, 2, 0), "unknown").passed is False


def test_forest_learns_a_separable_rule(spark, tmp_path):
    rows = spark.range(600).select(
        "id", (F.col("id") % 100).cast("double").alias("amount"), F.when(F.col("id") % 3 == 0, "Gizmo").otherwise("Widget").alias("product"),
    ).withColumn("region", F.when(F.col("amount") > 50, "East").when(F.col("product") == "Gizmo", "North").otherwise("West"))
    coded = ml.encode_labels(ml.encode_labels(rows, "product", "product_code"), "region", "label").withColumn("label", F.col("label").cast("double"))
    split = ml.split_rows(coded, "id")
    model = ml.train(ml.forest_pipeline(["amount", "product_code"], trees=10), split.where("split = 'train'"))
    ml.save_model(model, str(tmp_path / "m"))
    loaded = ml.load_model(str(tmp_path / "m"))
    scored = loaded.transform(split.where("split = 'test'"))
    accuracy = ml.accuracy(scored).first().accuracy
    assert accuracy > 0.9
    record = ml.run_record(ml.accuracy(scored), "r1", {"trees": 10}, split, F.lit(T0)).first()
    assert (record.run_id, record.params, record.training_rows) == ("r1", {"trees": "10"}, 600)


def test_forest_takes_any_number_of_categories(spark):
    rows = spark.range(3000).select(
        "id", (F.col("id") % 7).cast("double").alias("amount"), F.format_string("product %04d", F.col("id") % 1000).alias("product"),
        F.when(F.col("id") % 1000 < 500, 0.0).otherwise(1.0).alias("label"),
    )
    coded = ml.encode_labels(rows, "product", "product_code")
    model = ml.train(ml.forest_pipeline(["amount", "product_code"], trees=5), coded)
    assert ml.accuracy(model.transform(coded)).first().accuracy > 0.95


def test_training_gate_raises(spark):
    from tarnwork.plans import quality

    rows = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "region string")
    assert quality.require_training(rows, "region") is rows
    for bad in (rows.where("region = 'a'"), rows.limit(0)):
        with pytest.raises(quality.NotEnoughRows):
            quality.require_training(bad, "region")


def test_label_replace_groups(spark):
    from tarnwork.functions.labels import label_replace

    row = spark.range(1).select(
        label_replace(F.lit("old"), "${3}-${1}x", F.lit("a b c"), r"(\w) (\w) (\w)").alias("third"),
        label_replace(F.lit("old"), "${last}", F.lit("a b"), r"(\w) (?<last>\w)").alias("named"),
        label_replace(F.lit("old"), "${1}0", F.lit("a"), r"(\w)").alias("digit"),
    ).first()
    assert (row.third, row.named, row.digit) == ("c-ax", "b", "a0")


def test_odd_buckets_keep_short_slices(spark):
    from tarnwork.operators import ordered

    samples = spark.range(2000).select(F.lit("s").alias("s"), F.timestamp_seconds(F.col("id") * 97).alias("ts"), F.col("id").cast("double").alias("value"))
    steps = ordered.bucketed_steps(
        samples, ["s"], time="ts", value="value", tiebreak=[], bucket_seconds=90_000, step=lambda a, b: b - a, out="n"
    )
    plan = steps._jdf.queryExecution().analyzed().toString()
    assert "3600000000" in plan and "90000000000" in plan  # slices of an hour, buckets of 25 hours
    assert steps.agg(F.sum("n")).first()[0] == 1999.0


def test_quantiles_of_counters_that_are_not_monotone(spark):
    """The count of a bound is at least that of smaller bounds."""
    rows = [("a", 1.0, 4.0), ("a", 2.0, 3.0), ("a", float("inf"), 8.0)]
    buckets = spark.createDataFrame(rows, "k string, le double, count double")
    got = series.histogram_quantiles(buckets, ["k"], {"p25": 0.25, "p50": 0.5, "p99": 0.99}, monotone=True)
    assert tuples(got) == [("a", 0.5, 1.0, 2.0)]
    plain = series.histogram_quantiles(buckets, ["k"], {"p50": 0.5})
    assert tuples(plain) == [("a", 1.0)]


def test_counters_of_sum_and_count_with_restarts(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    counts = [("count", at(5), 0, 10.0), ("count", at(30), 1, 4.0), ("count", at(70), 2, 6.0)]
    totals = [("sum", at(5), 0, 3.0), ("sum", at(30), 1, 5.0), ("sum", at(70), 2, 1.0)]
    samples = spark.createDataFrame(
        [("n", "j", "r", "p", *row) for row in counts + totals],
        "namespace string, job string, route string, pod string, part string, ts timestamp, tie int, value double",
    )
    got = obs.mean_from_rates(samples, ["namespace", "job", "route", "pod"], seconds=60).where("level = 'job'")
    rows = {b: (s * 60, c * 60, m) for b, s, c, m in tuples(got, "bucket_start", "sum_rate", "count_rate", "mean_seconds")}
    # 3 to 5 grows by 2 while the other counter starts anew at 4; then the sum starts anew at 1.
    assert rows == {T0: (2.0, 4.0, 0.5), T0 + timedelta(minutes=1): (1.0, 2.0, 0.5)}
