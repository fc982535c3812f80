"""A versioned snapshot of one row per key in which an upsert moves the changes only.

The rows are kept in hash buckets of the key, one folder per bucket and version.
A manifest lists the folder of every bucket; a version is there when its
manifest is.  An upsert writes the buckets that its rows fall into, below a new
version, and the next manifest takes all others over.  The buckets are Spark's
own: reading gives a bucketed table, so a join on the key, that of the upsert
included, leaves the stored rows where they are and brings the other side to
them.  Rows without a key have no place in a snapshot and are left out.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwork.operators.keyed import latest_per_key
from tarnwork.sinks.tables import _location, _quoted, publish_snapshot, read_snapshot, snapshot_versions

PART = "snapshot_bucket"
_MANIFEST = T.StructType([T.StructField(PART, T.IntegerType()), T.StructField("path", T.StringType())])
_PARTITIONS_PER_STATEMENT = 200
#: Tables of this process that have all their partitions; making them again changes nothing.
_OPEN: set[tuple[str, str]] = set()


@dataclass(frozen=True)
class BucketedSnapshot:
    """``order`` decides between two rows of a key: the greater one stays, on equal ones the stored one."""

    spark: SparkSession
    root: str
    schema: T.StructType
    keys: tuple[str, ...]
    order: tuple[str, ...]
    buckets: int = 64

    @property
    def _manifests(self) -> str:
        return f"{self.root.rstrip('/')}/manifest"

    def versions(self) -> list[int]:
        return snapshot_versions(self.spark, self._manifests)

    def _keyed(self, rows: DataFrame) -> DataFrame:
        """Rows with a key, and the number of their bucket (the one Spark's bucketed writer gives them)."""
        return rows.select(*self.schema.fieldNames()).dropna(subset=list(self.keys)).withColumn(PART, self._bucket())

    def _bucket(self) -> Column:
        return F.pmod(F.hash(*self.keys), F.lit(self.buckets))

    def publish(self, rows: DataFrame) -> int:
        """A first or a fresh version of all rows, reduced to one per key."""
        versions = self.versions()
        once = latest_per_key(self._keyed(rows), list(self.keys), list(self.order))
        return self._write(once, (versions[-1] if versions else 0) + 1, range(self.buckets), [])

    def upsert(self, changes: DataFrame) -> int:
        """The newest version with some rows added or replaced; a second run with the same rows changes nothing."""
        versions = self.versions()
        if not versions:
            return self.publish(changes)
        once = latest_per_key(self._keyed(changes), list(self.keys), list(self.order)).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            touched = sorted(r[PART] for r in once.select(PART).distinct().collect())  # at most one per bucket
            if not touched:
                return versions[-1]
            old = self._table(versions[-1]).where(F.col(PART).isin(touched))
            return self._write(self._merged(old, once), versions[-1] + 1, touched, self._listed(versions[-1]))
        finally:
            once.unpersist()

    def merge(self, changes: DataFrame) -> DataFrame:
        """What ``upsert`` writes, as a frame: all rows of the buckets that the changes fall into."""
        once = latest_per_key(self._keyed(changes), list(self.keys), list(self.order))
        return self._merged(self._table(self.versions()[-1]), once)

    def _merged(self, old: DataFrame, new: DataFrame) -> DataFrame:
        # A full join on equal keys: the stored side is clustered by them already.
        columns = [*self.schema.fieldNames(), PART]
        o, n = (side.select(*self.keys, F.struct(*columns).alias(name)) for side, name in ((old, "__old"), (new, "__new")))
        both = o.join(n, list(self.keys), "full")
        rank = lambda side: F.struct(*(F.col(f"{side}.{c}") for c in self.order))
        newer = F.col("__old").isNull() | (F.col("__new").isNotNull() & (rank("__new") > rank("__old")))
        return both.select(F.when(newer, F.col("__new")).otherwise(F.col("__old")).alias("__row")).select(
            *(F.col(f"__row.{c}").alias(c) for c in columns)
        )

    def _write(self, rows: DataFrame, version: int, touched: Iterable[int], listed: list) -> int:
        folder = f"{self.root.rstrip('/')}/rows-{version:012d}-{uuid.uuid4().hex[:8]}"
        name = f"tarnwork_write_{uuid.uuid4().hex}"
        clustered = rows.repartition(self.buckets, *self.keys) if not listed else rows
        clustered.write.partitionBy(PART).bucketBy(self.buckets, *self.keys).sortBy(*self.keys).option("path", folder).format(
            "parquet"
        ).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # the table is external: its files stay
        own = {p: f"{folder}/{PART}={p}" for p in touched}
        kept = {r[PART]: r.path for r in listed if r[PART] not in own}
        paths = sorted({**kept, **own}.items())
        publish_snapshot(self.spark.createDataFrame(paths, _MANIFEST).coalesce(1), self._manifests, version)
        return version

    def _listed(self, version: int) -> list:
        """Bucket and folder of a version, one row per bucket."""
        return read_snapshot(self.spark, self._manifests, version).collect()

    def _table(self, version: int) -> DataFrame:
        mark = hashlib.sha256(f"{self.root}|{self.buckets}".encode()).hexdigest()[:16]
        name = f"tarnwork_snapshot_{mark}_{version}"
        if (self.spark.sparkContext.applicationId, name) not in _OPEN:
            parts = [f"PARTITION ({PART}={r[PART]}){_location(r.path)}" for r in self._listed(version)]
            columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in self.schema.fields)
            keys = ", ".join(map(_quoted, self.keys))
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {name} ({columns}, {PART} INT) USING parquet PARTITIONED BY ({PART}) "
                f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS{_location(f'{self.root}/table-{version}')}"
            )
            for at in range(0, len(parts), _PARTITIONS_PER_STATEMENT):
                self.spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {' '.join(parts[at : at + _PARTITIONS_PER_STATEMENT])}")
            _OPEN.add((self.spark.sparkContext.applicationId, name))
        return self.spark.table(name)

    def read(self, version: int | None = None) -> DataFrame:
        """The newest finished version, or a named one; clustered by the key."""
        versions = self.versions()
        if not versions:
            raise FileNotFoundError(f"no finished snapshot in {self.root}")
        return self._table(versions[-1] if version is None else version).select(*self.schema.fieldNames())
