"""Benchmark decontamination by greedy string tiling.

Every run of ``SHORTEST`` words of a test item is a seed.  Documents are joined
with items on shared seeds; for each such pair the longest common run of words
that are not marked yet becomes a tile and is marked, again and again, until no
run of ``SHORTEST`` words is left.  Rolling (Karp-Rabin) hashes of the seeds give
the places where runs can start, and the words themselves are compared after.
The share of an item's words inside tiles is its coverage, whatever order the
tiles stand in.  At ``COVERAGE`` or more the document is contaminated.

The seeds of at most ``ITEMS_PER_PASS`` items at a time go to the tasks; more
items take more passes over the documents.  No document leaves its task, so
neither hot passages nor hot documents matter.

Words are runs of ASCII letters and digits and of characters beyond ASCII, with
A-Z in lower case.  Null and empty texts have none; items with fewer than
``SHORTEST`` words have no seeds and match nothing.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.common import Hashes, grams, longs, texts_of
from tarnwork.llm.licenses import words_of

SHORTEST = 5
COVERAGE = 0.5
ITEMS_PER_PASS = 50_000


@dataclass
class Items:
    """Test items with an index of their seeds: sorted hashes, and the item and place of each."""

    ids: list
    words: list[np.ndarray]
    seeds: np.ndarray
    item: np.ndarray
    place: np.ndarray


def index_items(rows: list[tuple], shortest: int) -> Items:
    hashes = Hashes()
    ids, words = [], []
    for item_id, text in rows:
        own = hashes.of(words_of((text or "").encode()))
        if len(own) >= shortest:
            ids.append(item_id)
            words.append(own)
    seeds = [grams(w, shortest) for w in words]
    flat = np.concatenate(seeds) if seeds else np.empty(0, np.uint64)
    item = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds]) if seeds else np.empty(0, np.int64)
    place = np.concatenate([np.arange(len(s)) for s in seeds]) if seeds else np.empty(0, np.int64)
    order = np.lexsort((place, item, flat))
    return Items(ids, words, flat[order], item[order], place[order])


def tiles(item: np.ndarray, text: np.ndarray, pairs: list[tuple[int, int]], shortest: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of two word sequences from their seeds (place in item, place in text): (item, text, length).

    Seeds on one diagonal that follow each other are one run.  The longest run
    goes first; the parts of a run that earlier tiles have marked are cut off.
    """
    runs: list[tuple[int, int, int]] = []
    for a, b in sorted(pairs, key=lambda p: (p[1] - p[0], p[0])):
        if not np.array_equal(item[a : a + shortest], text[b : b + shortest]):
            continue  # equal hashes of different words
        if runs:
            a0, b0, n = runs[-1]
            if b - a == b0 - a0 and a <= a0 + n - shortest + 1:
                runs[-1] = (a0, b0, a + shortest - a0)
                continue
        runs.append((a, b, shortest))
    waiting = [(-n, a, b) for a, b, n in runs]
    heapq.heapify(waiting)
    in_item, in_text = np.zeros(len(item), bool), np.zeros(len(text), bool)
    found = []
    while waiting:
        n, a, b = heapq.heappop(waiting)
        n = -n
        marked = in_item[a : a + n] | in_text[b : b + n]
        if not marked.any():
            in_item[a : a + n] = in_text[b : b + n] = True
            found.append((a, b, n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([1], marked.astype(np.int8), [1]))))
        for start, stop in zip(edges[::2], edges[1::2], strict=True):
            if stop - start >= shortest:
                heapq.heappush(waiting, (-int(stop - start), a + int(start), b + int(start)))
    return sorted(found)


def covered(texts: list[str], items: Items, hashes: Hashes, shortest: int) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, tiles, item words in tiles) of every pair that shares a seed."""
    if not len(items.seeds):
        return
    for k, text in enumerate(texts):
        words = hashes.of(words_of(text.encode()))
        own = grams(words, shortest)
        first = np.searchsorted(items.seeds, own)
        hit = np.flatnonzero(items.seeds[np.minimum(first, len(items.seeds) - 1)] == own)
        if not len(hit):
            continue
        last = np.searchsorted(items.seeds, own[hit], "right")
        pairs: dict[int, list[tuple[int, int]]] = {}
        for b, low, high in zip(hit.tolist(), first[hit].tolist(), last.tolist(), strict=True):
            for e in range(low, high):
                pairs.setdefault(int(items.item[e]), []).append((int(items.place[e]), b))
        for item in sorted(pairs):
            found = tiles(items.words[item], words, pairs[item], shortest)
            if found:
                yield k, item, len(found), sum(n for _, _, n in found)


def passes(benchmark: DataFrame, shortest: int, items_per_pass: int) -> Iterator[Items]:
    """The benchmark in parts of a bounded number of items."""
    items = benchmark.select("item_id", "text")
    n = items.count()
    parts = -(-n // items_per_pass)
    for part in range(max(1, parts)):
        own = items if parts <= 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        rows = sorted(((r.item_id, r.text) for r in own.collect()), key=lambda r: (r[0] is None, r[0], r[1] or ""))
        yield index_items(rows, shortest)


def coverage(
    docs: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST, items_per_pass: int = ITEMS_PER_PASS
) -> DataFrame:
    """(doc_id, item_id, n_tiles, n_covered, n_item_words, coverage) of every pair that shares a seed."""
    context = docs.sparkSession.sparkContext
    id_kind, item_kind = docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    schema = f"doc_id {id_kind.simpleString()}, item_id {item_kind.simpleString()}, n_tiles long, n_covered long, n_item_words long"
    found = None
    for items in passes(benchmark, shortest, items_per_pass):
        shared = context.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items, hashes = shared.value, Hashes()
            for batch in batches:
                rows = list(covered(texts_of(batch.column("text")), items, hashes, shortest))
                at = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(at),
                        pa.array([items.ids[r[1]] for r in rows]).cast(_arrow(item_kind)),
                        longs([r[2] for r in rows]),
                        longs([r[3] for r in rows]),
                        longs([len(items.words[r[1]]) for r in rows]),
                    ],
                    names=["doc_id", "item_id", "n_tiles", "n_covered", "n_item_words"],
                )

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found.withColumn("coverage", F.col("n_covered") / F.col("n_item_words"))


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = COVERAGE) -> DataFrame:
    """The pairs at or above the threshold."""
    return coverage(docs, benchmark).where(F.col("coverage") >= least)


def clean(
    docs: DataFrame, benchmark: DataFrame, least: float = COVERAGE, shortest: int = SHORTEST, items_per_pass: int = ITEMS_PER_PASS
) -> DataFrame:
    """The documents without any contaminated pair, unchanged."""
    context = docs.sparkSession.sparkContext
    for items in passes(benchmark, shortest, items_per_pass):
        shared = context.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items, hashes = shared.value, Hashes()
            for batch in batches:
                bad = {
                    k for k, item, _, n in covered(texts_of(batch.column("text")), items, hashes, shortest)
                    if n >= least * len(items.words[item]) - 1e-9
                }
                yield batch.filter(pa.array([k not in bad for k in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
