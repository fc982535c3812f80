"""Feature views: point-in-time retrieval, materialisation, online lookup."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions.times import as_timestamp
from tarnwork.operators.keyed import latest_per_key, lookup_join
from tarnwork.operators.ordered import DAY, MINUTE, as_of_join
from tarnwork.sinks.snapshots import BucketedSnapshot


@dataclass(frozen=True)
class FeatureView:
    """Key, fields, time column and time-to-live of a feature table."""

    name: str
    keys: tuple[str, ...]
    fields: tuple[str, ...]
    time: str = "event_timestamp"
    tiebreak: tuple[str, ...] = ()
    ttl_days: int | None = None

    @property
    def ttl_seconds(self) -> int | None:
        return None if self.ttl_days is None else self.ttl_days * DAY

    @property
    def columns(self) -> list[str]:
        return [*self.keys, *self.fields, self.time, *[c for c in self.tiebreak if c not in self.fields]]


CUSTOMER_ORDERS = FeatureView(
    name="customer_order_features",
    keys=("customer_name",),
    fields=("region", "product", "amount"),
    tiebreak=("order_id",),
    ttl_days=3650,
)


def order_feature_source(orders: DataFrame) -> DataFrame:
    """Order rows as feature rows; the date becomes the event time."""
    return orders.select(
        "customer_name",
        "region",
        "product",
        "amount",
        F.col("order_date").cast("timestamp").alias("event_timestamp"),
        "order_id",
    )


def historical_features(spine: DataFrame, source: DataFrame, view: FeatureView, slice_seconds: int = MINUTE) -> DataFrame:
    """Features as they were known at the time of every spine row."""
    return as_of_join(
        spine,
        source,
        list(view.keys),
        spine_time=view.time,
        feature_time=view.time,
        tiebreak=list(view.tiebreak) or list(view.fields),
        payload=list(view.fields),
        ttl_seconds=view.ttl_seconds,
        slice_seconds=slice_seconds,
    )


def materialize(source: DataFrame, view: FeatureView, start, end) -> DataFrame:
    """Latest feature row per key with start <= time <= end."""
    when = F.col(view.time)
    window = source.where((when >= as_timestamp(start)) & (when <= as_timestamp(end)))
    return _latest(window.select(*view.columns), view)


def materialize_incremental(snapshot: DataFrame, source: DataFrame, view: FeatureView, last_end, end) -> DataFrame:
    """Snapshot brought up to ``end`` with the rows after ``last_end``.

    The latest (time, tiebreak) wins over both, so a second run changes
    nothing and a late older row never replaces a newer one.
    """
    when = F.col(view.time)
    delta = source.where((when > as_timestamp(last_end)) & (when <= as_timestamp(end)))
    # Reduce the new rows first: what meets the snapshot has one row per key.
    changes = _latest(delta.select(*view.columns), view)
    return _latest(snapshot.select(*view.columns).unionByName(changes), view)


def online_store(spark: SparkSession, root: str, source: DataFrame, view: FeatureView, buckets: int = 64) -> BucketedSnapshot:
    """The stored snapshot of a view below ``root``, with the types of its source."""
    schema = source.select(*view.columns).schema
    order = (view.time, *(view.tiebreak or view.fields))
    return BucketedSnapshot(spark, root, schema, view.keys, order, buckets)


def materialize_into(store: BucketedSnapshot, source: DataFrame, view: FeatureView, start, end, *, after: bool = False) -> int:
    """Bring a stored snapshot up to ``end`` with the rows from ``start`` on (``after``: behind it).

    Only the new rows and the buckets they fall into are moved; the latest
    (time, tiebreak) wins, so a second run or a late older row changes nothing.
    """
    when = F.col(view.time)
    begin = when > as_timestamp(start) if after else when >= as_timestamp(start)
    return store.upsert(source.where(begin & (when <= as_timestamp(end))).select(*view.columns))


def _latest(rows: DataFrame, view: FeatureView) -> DataFrame:
    order = [view.time, *(view.tiebreak or view.fields)]
    return latest_per_key(rows, list(view.keys), order)


def online_lookup(requested: DataFrame, snapshot: DataFrame, view: FeatureView) -> DataFrame:
    """Snapshot values for requested keys; unknown keys give nulls."""
    return lookup_join(requested, snapshot.select(*view.keys, *view.fields), list(view.keys))
