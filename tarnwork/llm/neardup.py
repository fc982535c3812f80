"""Near-duplicates by HyperMinHash registers, with exact verification.

A document is the set of its distinct five-word shingles (A-Z in lower case;
fewer words: the whole sequence is one shingle).  Documents with equal sets are
one class, and only one of a class goes on, so copies cost nothing.

*Registers.*  For each of ``BANDS * ROWS`` hash functions the least hash of the
set is kept as its number of leading zeros and ``MANTISSA`` bits after the first
one: 16 bits instead of 64.  *Bands.*  ``ROWS`` registers are one key.  Classes
with a common key form a bucket; each is paired with the least one of its bucket,
so a bucket of any size gives as many pairs as members.  A pair's registers
estimate its Jaccard similarity, corrected for the registers that agree by
chance; clear misses are dropped and the rest verified on the full sets.
Where a bucket still has members of different components, these are compared in
blocks, registers first and then full sets: after that every bucket is either one
component or has no unseen link.

A pair with similarity ``LEAST`` is in no common bucket with probability
(1 - 0.75 ** ROWS) ** BANDS, less than one in a million; more similar ones are
missed far more rarely.

Documents without words, and rows with a null id, are linked with nothing.  Rows
that repeat an id are judged by their own texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.common import Hashes, grams, longs, mixed, shuffles_dropped, texts_of
from tarnwork.llm.components import connected
from tarnwork.operators.keyed import lookup_join
from tarnwork.session import cut_lineage, scratch_path

SHINGLE = 5
ROWS = 5
BANDS = 56
MANTISSA = 10
LEAST_PERCENT = 75
BLOCK = 4096
CHANCE = 0.72  # mean width of a register relative to its value, times 2 ** MANTISSA

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def multipliers(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def shingles(text: str, hashes: Hashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    words = hashes.of(text.encode().translate(_LOWER).split())
    if not len(words):
        return np.empty(0, np.uint64)
    if len(words) < size:
        return mixed(grams(words, len(words)) + np.uint64(len(words)))
    return np.unique(grams(words, size))


def fingerprint(own: np.ndarray) -> tuple[int, int]:
    """128 bits of a set as two signed numbers."""
    import xxhash

    value = xxhash.xxh3_128_intdigest(own.tobytes())
    low, high = value & (2**64 - 1), value >> 64
    return high - (1 << 64) * (high >> 63), low - (1 << 64) * (low >> 63)


def registers(own: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa bits of the least hash under each function."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    step = max(1, (1 << 17) // len(factors))
    for k in range(0, len(own), step):
        np.minimum(least, (own[k : k + step, None] * factors[None, :]).min(axis=0), out=least)
    zeros = 63 - np.floor(np.log2(np.maximum(least, 1).astype(np.float64))).astype(np.int64)
    zeros = np.clip(zeros, 0, 63 - MANTISSA)
    shift = (63 - MANTISSA - zeros).astype(np.uint64)
    mantissa = (least >> shift) & np.uint64((1 << MANTISSA) - 1)
    return (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)


def band_keys(own: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of registers."""
    parts = own.reshape(-1, rows).astype(np.uint64)
    key = mixed(np.arange(len(parts), dtype=np.uint64) + np.uint64(0xA0761D6478BD642F))
    for k in range(rows):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, k])
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> float:
    """Jaccard similarity from registers, without those that agree by chance."""
    agree = float((a == b).mean())
    chance = CHANCE / 2**MANTISSA * n_a * n_b / (n_a + n_b) ** 2
    return (agree - chance) / (1 - chance)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact test on sorted sets, in whole numbers."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def sketches(docs: DataFrame, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(doc_id, text_key, n_shingles, f1, f2, keys) of every row; no keys for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, factors = Hashes(), multipliers(rows * bands)
        for batch in batches:
            sizes, first, second, keys = [], [], [], []
            for text in texts_of(batch.column("text")):
                own = shingles(text, hashes)
                f1, f2 = fingerprint(own)
                sizes.append(len(own))
                first.append(f1)
                second.append(f2)
                keys.append(band_keys(registers(own, factors), rows) if len(own) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("text_key"), longs(sizes), longs(first), longs(second),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_key", "n_shingles", "f1", "f2", "keys"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return keyed.mapInArrow(run, f"doc_id {kind}, text_key long, n_shingles long, f1 long, f2 long, keys array<long>")


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs each member of a bucket with the first one; rows come sorted by (key, f1, f2), one bucket after the other."""
    names = ["key", "c1", "c2", "f1", "f2"]
    last: tuple | None = None  # key and first member of the bucket that is open
    seen: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, f1, f2 = (batch.column(c).to_numpy() for c in ("key", "f1", "f2"))
        new = np.concatenate(([last is None or key[0] != last[0]], key[1:] != key[:-1]))
        start = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        c1 = np.where(start >= 0, f1[start], last[1] if last else 0)
        c2 = np.where(start >= 0, f2[start], last[2] if last else 0)
        again = np.concatenate(
            ([seen == (key[0], f1[0], f2[0])], (key[1:] == key[:-1]) & (f1[1:] == f1[:-1]) & (f2[1:] == f2[:-1]))
        )
        kept = ~again & ((c1 != f1) | (c2 != f2))
        last, seen = (key[-1], c1[-1], c2[-1]), (key[-1], f1[-1], f2[-1])
        yield pa.RecordBatch.from_arrays([longs(x[kept]) for x in (key, c1, c2, f1, f2)], names=names)


def buckets(classes: DataFrame) -> DataFrame:
    """(key, c1, c2, f1, f2): every member but the first of each bucket, beside the first one."""
    rows = classes.select(F.explode("keys").alias("key"), "f1", "f2")
    return rows.repartition("key").sortWithinPartitions("key", "f1", "f2").mapInArrow(
        _sorted_runs, "key long, c1 long, c2 long, f1 long, f2 long"
    )


def full_sets(docs: DataFrame, wanted: DataFrame, rows: int, bands: int) -> DataFrame:
    """(f1, f2, shingles, registers) of the wanted classes (f1, f2, doc_id), from the text of one document each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, factors = Hashes(), multipliers(rows * bands)
        for batch in batches:
            out = []
            ids = zip(batch.column("f1").to_pylist(), batch.column("f2").to_pylist(), strict=True)
            for own_id, text in zip(ids, texts_of(batch.column("text")), strict=True):
                own = shingles(text, hashes)
                if fingerprint(own) == own_id:  # not so for another text under the same id
                    out.append((*own_id, own.tobytes(), registers(own, factors).tobytes()))
            f1, f2, sets, regs = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [longs(f1), longs(f2), pa.array(sets, pa.binary()), pa.array(regs, pa.binary())],
                names=["f1", "f2", "shingles", "registers"],
            )

    joined = docs.select("doc_id", "text").join(wanted, "doc_id")
    found = joined.select("f1", "f2", "text").mapInArrow(run, "f1 long, f2 long, shingles binary, registers binary")
    return found.dropDuplicates(["f1", "f2"])


def slack_of(registers_in_all: int) -> float:
    """Six standard deviations of an estimate from so many registers at the threshold."""
    return 6 * (0.25 * 0.75 / registers_in_all) ** 0.5


def verified(pairs: DataFrame, sets: DataFrame, percent: int, registers_in_all: int) -> DataFrame:
    """(c1, c2, f1, f2, linked) of every pair; sets travel with the pairs, so that no class gathers its partners."""
    slack = slack_of(registers_in_all)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for a, ra, b, rb in zip(*(batch.column(c).to_pylist() for c in ("sa", "ra", "sb", "rb")), strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                guess = estimate(np.frombuffer(ra, np.uint16), np.frombuffer(rb, np.uint16), len(x), len(y))
                linked.append(guess >= percent / 100 - slack and similar(x, y, percent))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("c1", "c2", "f1", "f2")), pa.array(linked, pa.bool_())],
                names=["c1", "c2", "f1", "f2", "linked"],
            )

    a = sets.select(F.col("f1"), F.col("f2"), F.col("shingles").alias("sa"), F.col("registers").alias("ra"))
    b = sets.select(F.col("f1").alias("c1"), F.col("f2").alias("c2"), F.col("shingles").alias("sb"), F.col("registers").alias("rb"))
    both = pairs.join(a, ["f1", "f2"]).join(b, ["c1", "c2"])
    return both.mapInArrow(run, "c1 long, c2 long, f1 long, f2 long, linked boolean")


def _node(first: str, second: str) -> Column:
    return F.struct(F.col(first).alias("f1"), F.col(second).alias("f2"))


def _as_links(pairs: DataFrame) -> DataFrame:
    return pairs.select(_node("c1", "c2").alias("u"), _node("f1", "f2").alias("v"))


def _links_between(batches: Iterator[pa.RecordBatch], rows: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links of one block group between different components: registers first, then the full sets.

    Rows come sorted by (key, low, high).  A pair with several common bands is verified in
    the first of them only.  The members of a group are bound by ``BLOCK``.
    """
    names = ["c1", "c2", "f1", "f2"]
    held: list[dict] = []
    group: tuple | None = None

    def pairs() -> pa.RecordBatch:
        out: list[tuple[int, int, int, int]] = []
        _, low, high = group
        regs = np.frombuffer(b"".join(r["registers"] for r in held), np.uint16).reshape(len(held), -1)
        bands = regs.reshape(len(held), -1, rows)
        own = int(np.flatnonzero(band_keys(regs[0], rows) == group[0])[0])
        sets = [np.frombuffer(r["shingles"], np.uint64) for r in held]
        sizes = np.array([len(s) for s in sets], np.float64)
        least = percent / 100 - slack_of(regs.shape[1])
        part = np.unique([(r["component"]["f1"], r["component"]["f2"]) for r in held], axis=0, return_inverse=True)[1].reshape(-1)
        block = np.array([r["block"] for r in held])
        for i in range(len(held) - 1):
            there = np.arange(i + 1, len(held))
            there = there[(part[there] != part[i]) & ((block[there] != block[i]) | (low == high))]
            there = there[100 * np.minimum(sizes[there], sizes[i]) >= percent * np.maximum(sizes[there], sizes[i])]
            if not len(there):
                continue
            equal = bands[there] == bands[i]
            agree = equal.mean(axis=(1, 2))
            chance = CHANCE / 2**MANTISSA * sizes[there] * sizes[i] / (sizes[there] + sizes[i]) ** 2
            near = (agree - chance) / (1 - chance) >= least
            first = equal.all(axis=2).argmax(axis=1)
            for j in there[near & (first == own)].tolist():
                if not similar(sets[i], sets[j], percent):
                    continue
                a, b = ((held[k]["f1"], held[k]["f2"]) for k in (i, j))
                out.append((*min(a, b), *max(a, b)))
        return pa.RecordBatch.from_arrays([longs([o[k] for o in out]) for k in range(4)], names=names)

    for batch in batches:
        for row in batch.to_pylist():
            now = (row["key"], row["low"], row["high"])
            if now != group:
                if len(held) > 1:
                    yield pairs()
                held, group = [], now
            held.append(row)
    if len(held) > 1:
        yield pairs()


def rest_links(own: DataFrame, sets: DataFrame, components: DataFrame, rows: int, percent: int) -> DataFrame:
    """Links that stars have not found: members of one bucket in different components.

    Buckets of one component are left out.  The members of the others meet with
    their registers and sets in groups of two blocks of about ``BLOCK`` members, so
    a large bucket is many groups of bounded size, and only links become rows.
    """
    members = own.select("key", _node("f1", "f2").alias("node")).unionByName(
        own.select("key", _node("c1", "c2").alias("node")).distinct()
    )
    members = lookup_join(members, components, ["node"], "left").withColumn("component", F.coalesce("component", "node"))
    mixed_keys = (
        members.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("least"), F.max("component").alias("most"))
        .where(F.col("least") != F.col("most"))
        .select("key", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("blocks"))
    )
    sized = lookup_join(members, mixed_keys, ["key"], "inner").select(
        "key", "blocks", "node.f1", "node.f2", "component", F.pmod("node.f1", F.col("blocks").cast("long")).cast("int").alias("block")
    )
    met = lookup_join(sized, sets.select("f1", "f2", "registers", "shingles"), ["f1", "f2"], "inner").select(
        "*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("blocks", "other")
    dealt = met.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "f1", "f2")
    return dealt.mapInArrow(lambda batches: _links_between(batches, rows, percent), "c1 long, c2 long, f1 long, f2 long")


def _stored(df: DataFrame, name: str) -> DataFrame:
    """The frame, written to the shared folder and read again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _grouped(docs: DataFrame, percent: int, rows: int, bands: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored sketches, stored classes (f1, f2, doc_id) and components of their nodes."""
    known = _stored(sketches(docs, rows, bands), "sketches")
    usable = known.where("doc_id is not null and n_shingles > 0")
    classes = _stored(usable.groupBy("f1", "f2").agg(F.min("doc_id").alias("doc_id")), "classes")
    # One row for each class: the keys of its least document.
    chosen = usable.join(classes, ["f1", "f2", "doc_id"], "left_semi").dropDuplicates(["f1", "f2"])
    own = _stored(buckets(chosen), "buckets")
    ends = own.select("f1", "f2").unionByName(own.select(F.col("c1").alias("f1"), F.col("c2").alias("f2"))).distinct()
    sets = _stored(full_sets(docs, ends.join(classes, ["f1", "f2"]), rows, bands), "sets")
    stars = cut_lineage(verified(own.select("c1", "c2", "f1", "f2").distinct(), sets, percent, rows * bands))
    components = connected(_as_links(stars.where("linked")))
    if not stars.where(~F.col("linked")).isEmpty():
        more = cut_lineage(rest_links(own, sets, components, rows, percent))
        if not more.isEmpty():
            components = connected(
                components.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(_as_links(more))
            )
    return known, classes, components


def near_duplicates(docs: DataFrame, percent: int = LEAST_PERCENT, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(doc_id, text_key, n_shingles, f1, f2, component_id, kept) for every row of ``docs`` (doc_id, text).

    ``component_id`` is the least id reachable over links, the own id included;
    ``kept`` marks it.  A null id is its own component and kept.
    """
    spark = docs.sparkSession
    with shuffles_dropped(spark):
        known, classes, components = _grouped(docs, percent, rows, bands)
    member = components.select(F.col("node.f1").alias("f1"), F.col("node.f2").alias("f2"), "component")
    with_component = classes.join(member, ["f1", "f2"], "left").withColumn("component", F.coalesce("component", _node("f1", "f2")))
    least = with_component.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = lookup_join(with_component.select("f1", "f2", "component"), least, ["component"], "inner").select("f1", "f2", "component_id")
    found = lookup_join(known.drop("keys"), named, ["f1", "f2"], "left")
    own_id = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.withColumn("component_id", own_id).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def representatives(docs: DataFrame, percent: int = LEAST_PERCENT, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """The rows of ``docs`` that near-duplicate removal keeps: one row of each group, and rows without an id."""
    found = near_duplicates(docs, percent, rows, bands)
    gone = found.where("not kept").select(F.col("doc_id").alias("__gone"), F.col("text_key").alias("__gone_text")).distinct()
    columns = [f"`{c}`" for c in docs.columns]
    # A row is known by its id and its text: another text under the same id is judged by itself.
    keyed = docs.where("doc_id is not null").withColumn("__text", F.xxhash64("text"))
    same = (F.col("doc_id") == F.col("__gone")) & (F.col("__text") == F.col("__gone_text"))
    # Repeated rows of one id meet in the join's partitions already.
    once = keyed.join(gone, same, "left_anti").dropDuplicates(["doc_id", "__text"]).select(*columns)
    return once.unionByName(docs.where("doc_id is null").select(*columns))
