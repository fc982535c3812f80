"""Streams against the batch form of the same computation."""

from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tarnwork.plans import observability, quality
from tarnwork.schemas import DEVICE_EVENT, WINDOW_COUNT
from tarnwork.session import large_state, scratch_path
from tarnwork.sinks.tables import write_messages_in_order
from tarnwork.sources import events as event_source
from tarnwork.streaming import events as streams
from tarnwork.streaming import fanout
from tests.conftest import tuples

T0 = datetime(2026, 8, 1)


def messages(spark, rows):
    """rows: (event id, device, seconds)"""
    events = spark.createDataFrame(
        [(i, d, "error", 1.0, T0 + timedelta(seconds=s)) for i, d, s in rows], DEVICE_EVENT
    )
    return event_source.encode_messages(events).select("value")


def deliver(spark, log, rows):
    messages(spark, rows).coalesce(1).write.mode("append").text(log)


def run(stream, path, checkpoint):
    streams.finish(streams.start_append(stream, path, checkpoint, available_now=True))


def test_windows_equal_the_batch_for_closed_windows(spark):
    log, path = scratch_path(spark, "log"), scratch_path(spark, "w")
    rows = [(i, f"d{i % 3}", i * 7) for i in range(100)]
    deliver(spark, log, rows)
    detail = streams.detail(event_source.read_messages(spark, path=log))
    run(streams.tumbling_counts(detail), path, scratch_path(spark, "c"))
    got = spark.read.schema(WINDOW_COUNT).parquet(path)
    batch = streams.tumbling_counts(event_source.valid_events(event_source.decode_messages(messages(spark, rows))))
    closed = batch.where(F.col("window_end") <= F.lit(T0 + timedelta(seconds=99 * 7 - 10)))
    assert sorted(tuples(got)) == sorted(tuples(closed)) and got.count() > 0


def test_windows_are_half_open(spark):
    rows = [(1, "d", 0), (2, "d", 59), (3, "d", 60)]
    batch = streams.tumbling_counts(event_source.valid_events(event_source.decode_messages(messages(spark, rows))))
    assert sorted(tuples(batch, "window_start", "event_count")) == [(T0, 2), (T0 + timedelta(minutes=1), 1)]


def test_restart_neither_loses_nor_repeats(spark):
    log, path, checkpoint = (scratch_path(spark, n) for n in ("log", "d", "c"))
    for part in range(3):
        deliver(spark, log, [(part * 10 + i, "d", i) for i in range(10)])
        run(streams.detail(event_source.read_messages(spark, path=log)), path, checkpoint)
        assert spark.read.schema(DEVICE_EVENT).parquet(path).count() == 10 * (part + 1)
    run(streams.detail(event_source.read_messages(spark, path=log)), path, checkpoint)
    ids = [i for (i,) in tuples(spark.read.schema(DEVICE_EVENT).parquet(path), "event_id")]
    assert sorted(ids) == list(range(30))


def test_late_rows_are_in_the_detail_table_only(spark):
    log, detail, windows, marks, checkpoint = (scratch_path(spark, n) for n in ("log", "d", "w", "m", "c"))
    for rows in ([(1, "d", 5), (2, "d", 300)], [(3, "d", 10), (4, "d", 295), (5, "d", 600)]):
        deliver(spark, log, rows)
        read = event_source.read_messages(spark, path=log)
        streams.finish(streams.start_two_sinks(read, detail, windows, marks, checkpoint, available_now=True))
    late = streams.window_report(spark, windows, marks)
    got = {s: (d, w, n) for s, d, w, n in tuples(late, "window_start", "detail_count", "window_count", "late_count")}
    # Event 3 came after its window had closed; event 4 within the delay.
    assert got == {T0: (2, 1, 1), T0 + timedelta(minutes=4): (1, 1, 0), T0 + timedelta(minutes=5): (1, 1, 0)}
    assert sorted(tuples(streams.read_detail(spark, detail, marks), "event_id")) == [(i,) for i in range(1, 6)]
    assert sorted(n for (n,) in tuples(streams.read_windows(spark, windows, marks), "event_count")) == [1, 1, 1]


class Broken(RuntimeError):
    pass


@pytest.mark.parametrize("place", ["second sink", "mark"])
def test_a_batch_that_fails_between_its_sinks_runs_again(spark, place, monkeypatch):
    """The batch replaces what it had written, in both sinks; readers never see half of it."""
    log, one, two, marks, checkpoint = (scratch_path(spark, n) for n in ("log", "1", "2", "m", "c"))
    broken = [True]

    def second(rows, _):
        if broken[0] and place == "second sink" and rows.where("event_id >= 10").count():
            raise Broken
        return rows.select("event_id", "late")

    sinks = [fanout.Sink(one, lambda rows, _: rows.select(*DEVICE_EVENT.fieldNames())), fanout.Sink(two, second)]
    written = fanout.folder_of

    def folder(path, number):
        if broken[0] and place == "mark" and path == marks and number == 1:
            raise Broken
        return written(path, number)

    monkeypatch.setattr(fanout, "folder_of", lambda path, number: folder(path, number))

    def go():
        stream = streams.detail(event_source.read_messages(spark, path=log, maxFilesPerTrigger="1"))
        streams.finish(
            fanout.start_fan_out(stream, sinks, marks, checkpoint, time="event_time", delay_seconds=10, trigger={"availableNow": True})
        )

    def seen():
        first = fanout.read_sink(spark, one, marks, DEVICE_EVENT)
        other = fanout.read_sink(spark, two, marks, spark.createDataFrame([], "event_id long, late boolean").schema)
        return sorted(tuples(first, "event_id")), sorted(tuples(other, "event_id"))

    for part in range(3):
        deliver(spark, log, [(part * 10 + i, "d", part * 100 + i) for i in range(5)])
    with pytest.raises(StreamingQueryException):
        go()
    first = [(i,) for i in range(5)]
    assert seen() == (first, first)
    broken[0] = False
    go()
    every = [(part * 10 + i,) for part in range(3) for i in range(5)]
    assert seen() == (every, every)
    marked = sorted(tuples(fanout.read_marks(spark, marks), "batch", "rows", "late_rows"))
    assert marked == [(0, 5, 0), (1, 5, 0), (2, 5, 0)]


def test_nothing_is_seen_before_the_first_mark(spark):
    marks = scratch_path(spark, "m")
    spark.createDataFrame([], fanout.MARK).write.parquet(f"{marks}/batch=0")
    detail = scratch_path(spark, "d")
    spark.createDataFrame([(1, "d", "error", 1.0, T0)], DEVICE_EVENT).write.parquet(f"{detail}/batch=0")
    assert streams.read_detail(spark, detail, marks).count() == 0


@pytest.mark.parametrize("files,late,one_file", [(1, {7, 8}, True), (1, {7, 8}, False), (100, set(), True), (100, set(), False)])
def test_distinct_and_late_sinks_hold_all_events(spark, files, late, one_file):
    """Six files in the order of time, repeats in them and behind them, two events behind the watermark; in many batches and in one."""
    log, on_time, behind, once, marks, checkpoint = (scratch_path(spark, n) for n in ("log", "t", "l", "o", "m", "c"))
    rows = [(i, f"d{i % 2}", i * 60) for i in range(60)]
    for part in range(6):
        own = [r for r in rows[part * 10 : part * 10 + 10] if r[0] not in (7, 8)]
        deliver(spark, log, own + own[:4])
    deliver(spark, log, [rows[7], rows[8], rows[7], rows[3], rows[59]])
    read = event_source.read_messages(spark, path=log, **event_source.admission(files=files))
    for _ in range(2):  # the second run finds nothing new
        kind = {"available_now": True, "one_file": one_file}
        streams.finish(streams.start_split(streams.detail(read), on_time, behind, marks, f"{checkpoint}/s", **kind))
        streams.finish(streams.start_deduplicated(spark, on_time, once, f"{checkpoint}/o", **kind))
    distinct = spark.read.schema(DEVICE_EVENT).parquet(once)
    got = streams.late_events(spark, behind, marks, distinct)
    assert sorted(tuples(distinct, "event_id")) == [(i,) for i in range(60) if i not in late]
    assert {i for (i,) in tuples(got, "event_id")} == late and got.count() == len(late)


def test_log_in_order_is_read_without_late_rows(spark):
    log, path = scratch_path(spark, "log"), scratch_path(spark, "w")
    rows = [(i, f"d{i % 3}", i * 7) for i in range(300)]
    ordered = messages(spark, rows).withColumn("part", F.floor(F.get_json_object("value", "$.event_id").cast("int") / 50))
    write_messages_in_order(ordered.repartition(5), "part", log, scratch_path(spark, "s"))
    read = event_source.read_messages(spark, path=log, **event_source.admission(max_bytes=1))
    with large_state(spark):
        query = streams.start_append(
            streams.tumbling_counts(streams.detail(read)), path, scratch_path(spark, "c"), available_now=True
        )
        streams.finish(query)
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) == 6
    got = spark.read.schema(WINDOW_COUNT).parquet(path)
    batch = streams.tumbling_counts(event_source.valid_events(event_source.decode_messages(messages(spark, rows))))
    closed = batch.where(F.col("window_end") <= F.lit(T0 + timedelta(seconds=299 * 7 - 10)))
    assert sorted(tuples(got)) == sorted(tuples(closed)) and got.count() > 90
    # Windows behind the watermark have left the state.
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 6


def test_large_state_setting_comes_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    with pytest.raises(Broken), large_state(spark):
        assert "RocksDB" in spark.conf.get(name)
        raise Broken
    assert spark.conf.get(name, None) == before


def test_runs_report_what_they_took(spark):
    log, path, checkpoint = (scratch_path(spark, n) for n in ("log", "d", "c"))
    reports = []
    for part in range(2):
        deliver(spark, log, [(part * 10 + i, "d", i) for i in range(10)])
        spark.createDataFrame([("no json",), ("{}",)], "value string").coalesce(1).write.mode("append").text(log)
        read = event_source.read_messages(spark, path=log, maxFilesPerTrigger="1")
        run_ = streams.finish(streams.start_append(streams.audited(read), path, checkpoint, available_now=True))
        reports.append(fanout.progress_counts(run_, streams.AUDIT))
    assert reports == [{"input_rows": 12, "messages": 12, "events": 10}] * 2
    assert spark.read.schema(DEVICE_EVENT).parquet(path).count() == 20
    assert tuples(quality.growth(spark, reports)) == [(10, 20, 24, 4, True)]
    nothing = streams.finish(streams.start_append(streams.audited(read), path, checkpoint, available_now=True))
    reports.append(fanout.progress_counts(nothing, streams.AUDIT))
    assert tuples(quality.growth(spark, reports)) == [(20, 20, 24, 4, False)]


def test_lost_progress_is_an_error(spark):
    class Query:
        recentProgress = [{"batchId": 3, "numInputRows": 1, "observedMetrics": {}}, {"batchId": 5, "numInputRows": 1, "observedMetrics": {}}]
        _jsq = type("Q", (), {"sparkSession": staticmethod(lambda: spark._jsparkSession)})

    with pytest.raises(fanout.ProgressLost):
        fanout.progress_counts(Query())


def test_held_alert_on_a_stream_equals_the_batch(spark):
    """Two jobs; in one the second instance misses an evaluation."""
    path, out, checkpoint = (scratch_path(spark, n) for n in ("g", "o", "c"))
    minutes = lambda *m: [T0 + timedelta(minutes=k, seconds=5) for k in m]
    rows = [("a", i, t, 1.0) for i in (1, 2) for t in minutes(*range(10))]
    rows += [("b", i, t, 1.0) for i in (1, 2) for t in minutes(0, 1, 2, 4, 5, 6)] + [("b", 1, t, 1.0) for t in minutes(3)]
    rows += [("c", i, t, float(i == 1)) for i in (1, 2, 3) for t in minutes(*range(10))] + [("a", 1, t, 0.0) for t in minutes(30)]
    frame = spark.createDataFrame(rows, "job string, instance int, ts timestamp, value double")
    kind = {"time": "ts", "step_seconds": 60, "for_seconds": 120}
    batch = observability.more_than_one_for(frame, ["job"], "instance", **kind)
    expected = [
        ("a", T0, T0 + timedelta(minutes=2), T0 + timedelta(minutes=9), 10),
        ("b", T0, T0 + timedelta(minutes=2), T0 + timedelta(minutes=2), 3),
        ("b", T0 + timedelta(minutes=4), T0 + timedelta(minutes=6), T0 + timedelta(minutes=6), 3),
    ]
    assert sorted(tuples(batch)) == expected
    for low, high in ((0, 3), (3, 6), (6, 40)):
        part = frame.where((F.col("ts") >= F.lit(T0 + timedelta(minutes=low))) & (F.col("ts") < F.lit(T0 + timedelta(minutes=high))))
        part.coalesce(1).write.mode("append").parquet(path)
    live = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", "1").parquet(path).withWatermark("ts", "10 seconds")
    run(observability.more_than_one_for(live, ["job"], "instance", **kind), out, checkpoint)
    assert sorted(tuples(spark.read.schema(batch.schema).parquet(out))) == expected


def test_repeats_are_dropped(spark):
    log, path = scratch_path(spark, "log"), scratch_path(spark, "d")
    deliver(spark, log, [(1, "d", 0), (1, "d", 0), (2, "d", 1)])
    run(streams.deduplicated(streams.detail(event_source.read_messages(spark, path=log))), path, scratch_path(spark, "c"))
    assert sorted(tuples(spark.read.parquet(path), "event_id")) == [(1,), (2,)]


def test_live_generator_has_the_event_schema(spark):
    live = event_source.live_device_events(spark, rows_per_second=50)
    assert live.isStreaming
    assert [(f.name, f.dataType) for f in live.schema.fields] == [(f.name, f.dataType) for f in DEVICE_EVENT.fields]


def test_enrichment_of_a_hot_device(spark):
    rows = [(i, "hot" if i % 4 else f"d{i}", i) for i in range(200)]
    live = streams.detail(messages(spark, rows))
    snapshot = spark.createDataFrame([("hot", "x"), ("d0", "y")], "device_id string, kind string")
    expected = sorted((i, d, {"hot": "x", "d0": "y"}.get(d)) for i, d, _ in rows)
    for salts in (1, 8):
        got = streams.enriched(live, snapshot, salts=salts)
        assert sorted(tuples(got, "event_id", "device_id", "kind"), key=str) == sorted(expected, key=str)


def test_large_state_store_gives_the_same_windows(spark):
    from tarnwork.session import configure

    name = "spark.sql.streaming.stateStore.providerClass"
    log, path = scratch_path(spark, "log"), scratch_path(spark, "w")
    deliver(spark, log, [(i, "d", i * 30) for i in range(20)])
    before = spark.conf.get(name)
    try:
        configure(spark, large_state=True)
        run(streams.tumbling_counts(streams.detail(event_source.read_messages(spark, path=log))), path, scratch_path(spark, "c"))
    finally:
        spark.conf.set(name, before)
    assert [n for (n,) in tuples(spark.read.parquet(path), "event_count")] == [2] * 9


def test_distinct_table_does_not_depend_on_the_cut(spark):
    """Six files that each span the whole time, with repeats across them, one file for each batch."""
    log, path, checkpoint = (scratch_path(spark, n) for n in ("log", "d", "c"))
    rows = [(i, f"d{i % 5}", i * 600) for i in range(300)]
    for part in range(6):
        deliver(spark, log, [r for r in rows if r[0] % 6 == part] + [r for r in rows if r[0] % 7 == part])
    read = event_source.read_messages(spark, path=log, maxFilesPerTrigger="1")
    for _ in range(2):  # the second run finds nothing new
        streams.finish(streams.start_distinct(streams.detail(read), path, checkpoint, available_now=True))
    table = spark.read.schema(DEVICE_EVENT).parquet(path)
    assert sorted(tuples(table, "event_id", "device_id")) == [(i, d) for i, d, _ in rows]
    deliver(spark, log, rows[:10])
    streams.finish(streams.start_distinct(streams.detail(read), path, checkpoint, available_now=True))
    assert spark.read.schema(DEVICE_EVENT).parquet(path).count() == 300
