"""What the text operators share: reading, Arrow batches, shipping the package.

Conventions of all operators here.  A null text counts as empty.  A null id is
kept as it is: such a row takes part in everything that looks at one row, and
in nothing that compares rows.  Rows that repeat an id are told apart by their
text.  Extra columns pass through; the columns an operator adds replace columns
of the same name.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.session import configure, shuffles_dropped

ROWS_PER_BATCH = 500
BYTES_PER_BATCH = 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Settings of the library, small Arrow batches (texts can be long), and the package on the workers' path."""
    configure(spark)
    for key, value in {
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(ROWS_PER_BATCH),
        "spark.sql.execution.arrow.maxBytesPerBatch": str(BYTES_PER_BATCH),
    }.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """The frame without columns that an operator is about to add (names compare without case, as in Spark)."""
    taken = {n.lower() for n in names}
    return df.select(*(f"`{c}`" for c in df.columns if c.lower() not in taken))


def texts_of(column: pa.Array) -> list[str]:
    """Texts of a batch, null as empty."""
    return [t or "" for t in column.to_pylist()]


def added(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with further columns behind its own."""
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def with_columns(
    df: DataFrame, added_schema: str, make: Callable[[Iterator[pa.RecordBatch]], Iterator[dict[str, pa.Array]]]
) -> DataFrame:
    """Adds columns batch by batch; ``make`` yields the new columns of each batch it gets."""
    names = [part.strip().split()[0].strip("`") for part in added_schema.split(",")]
    kept = without(df, names)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields] + [added_schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[pa.RecordBatch] = []

        def noted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                seen.append(batch)
                yield batch

        for columns in make(noted()):
            yield added(seen.pop(), columns)

    return kept.mapInArrow(run, schema)


def bounded_sample(df: DataFrame, key: str, bound: int) -> DataFrame:
    """At most ``bound`` rows, the same ones on every run: those with the smallest hashes of the key and the row.

    The rows are counted first, so that about ``bound`` of them pass a filter by
    hash and no task hands on more than its share.
    """
    n = df.count()
    spread = F.xxhash64(F.lit("sample"), *(f"`{c}`" for c in df.columns))
    if n > bound:
        share = min(1.0, (1.2 * bound + 50) / n)
        df = df.where(spread.bitwiseAND(F.lit((1 << 40) - 1)) < F.lit(int(share * (1 << 40))))
    return df.orderBy(spread.bitwiseAND(F.lit((1 << 40) - 1)), spread, f"`{key}`").limit(bound)


def strings(values: Iterable[str | None]) -> pa.Array:
    return pa.array(values, pa.string())


def longs(values) -> pa.Array:
    return pa.array(np.asarray(values, np.int64))


class Hashes(dict):
    """64-bit hashes of words, each computed once; starts anew when it has grown large."""

    LARGEST = 150_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LARGEST:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits (finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words, by its first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        out = hashes[:n].copy()
        for k in range(1, size):
            out *= factor
            out += hashes[k : k + n]
    return mixed(out)
