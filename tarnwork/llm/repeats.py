"""Substring dedup: passages of ``WINDOW`` words that also start earlier are removed.

*Shards.*  Among the ``GRAM``-word runs inside a window the one with the least
hash stands for the window (its minimizer).  Windows in a row with one minimizer
are a segment.  Equal windows have equal minimizers, so a shard that holds all
segments of a minimizer sees every occurrence of its windows, and a document
meets only the shards that can match it.

*Copies first.*  Of equal segments only the earliest can hold a first
occurrence; the others are removed as they are, inside an Arrow batch before the
shuffle, and after it in a streaming pass over sorted rows.  What is left is the
distinct segments whose minimizer has other segments too.

*Index.*  Each shard builds compressed FM-indexes (``fmindex``) of such segments
and streams them through backward search.  The interval of a window holds all its
occurrences; the least place among them is its first one.  Any other occurrence
is removed.

*Hot minimizers.*  Where the distinct segments of a minimizer have more than
``WORDS_PER_INDEX`` words, they are taken apart into windows, which are dealt out
by their own hash and streamed in sorted order: the first of equal windows stays.
So an index holds less than twice ``WORDS_PER_INDEX`` words.

Words are runs without ASCII white space, compared as they are (by 64-bit
hashes).  ``doc_id`` names a text: rows that repeat a row are the same places and
keep the same words.  Null ids are compared with nothing, null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.common import Hashes, grams, longs, mixed, strings, texts_of
from tarnwork.llm.fmindex import FMIndex
from tarnwork.operators.keyed import dense_codes, lookup_join
from tarnwork.session import cut_lineage, scratch_path

WINDOW = 20
GRAM = 6
PLACE_BITS = 24  # words of a part that are cut into segments at once
WORDS_PER_PART = 1 << 20
WORDS_PER_INDEX = 400_000
LENGTH_BITS = 6
EARLY = 1 << (LENGTH_BITS - 1)  # marks a segment that is known to be a copy
SEGMENT, SINGLE, KNOWN_COPY = range(3)  # kinds of rows: for an index, one window, one window that is a copy


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(n + 1, base, np.uint64))
        down = np.cumprod(np.full(n + 1, inverse, np.uint64))
    return up, down


class Cutter:
    """Cuts word hashes into segments: (minimizer, content, first window, number of windows)."""

    def __init__(self, window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        self.up, self.down = _factors(1 << 16)

    def cut(self, hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """``ends``: where each document's words end.  Also gives the document of each segment."""
        inside = self.window - self.gram + 1
        n = len(hashes) - self.window + 1
        empty = np.empty(0, np.int64)
        if n <= 0:
            return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty
        own = grams(hashes, self.gram)
        low = np.uint64((1 << PLACE_BITS) - 1)
        least = (own & ~low) | np.arange(len(own), dtype=np.uint64)
        width = 1
        while width * 2 <= inside:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < inside:
            least = np.minimum(least[: len(least) - (inside - width)], least[inside - width :])
        at = (least & low).astype(np.int64)  # the place of the leftmost least run of each window
        starts = np.arange(n)
        document = np.searchsorted(ends, starts, "right")
        valid = starts + self.window <= ends[np.minimum(document, len(ends) - 1)]
        new = np.ones(n, bool)
        new[1:] = (at[1:] != at[:-1]) | (document[1:] != document[:-1])
        head = np.flatnonzero(new & valid)
        if not len(head):
            return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty
        # A segment ends at the next head or where the document's windows end.
        stop = np.minimum(np.append(head[1:], n), ends[document[head]] - self.window + 1)
        size = stop - head
        if len(self.up) <= len(hashes):
            self.up, self.down = _factors(len(hashes))
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * self.up[: len(hashes)], dtype=np.uint64)))
            content = (sums[stop + self.window - 1] - sums[head]) * self.down[head]
            content = mixed(content + size.astype(np.uint64))
        return own[at[head]], content, document[head], head, size


def _parts(texts: list[str], ids: list[int], window: int) -> Iterator[tuple[list[int], list[list[bytes]], list[int]]]:
    """Documents' words in parts of bounded size: ids, words, and the place of the first word in its document."""
    own: tuple[list, list, list] = ([], [], [])
    size = 0
    for text, doc in zip(texts, ids, strict=True):
        words = text.encode().split()
        for at in range(0, max(1, len(words) - window + 1), WORDS_PER_PART):
            piece = words[at : at + WORDS_PER_PART + window - 1] if len(words) > WORDS_PER_PART else words
            if size + len(piece) > WORDS_PER_PART and size:
                yield own
                own, size = ([], [], []), 0
            for target, value in zip(own, (doc, piece, at), strict=True):
                target.append(value)
            size += len(piece)
    if size:
        yield own


def _known_ids(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.filter(batch.column("doc_id").is_valid())


def segments(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(minimizer, content, doc, place): ``place`` holds the first window and, in its last bits, their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, cutter = Hashes(), Cutter(window, gram)
        for batch in batches:
            batch = _known_ids(batch)
            ids = batch.column("doc_id").to_pylist()
            for docs_in, words, firsts in _parts(texts_of(batch.column("text")), ids, window):
                flat = np.concatenate([hashes.of(w) for w in words])
                ends = np.cumsum([len(w) for w in words])
                mini, content, document, head, size = cutter.cut(flat, ends)
                doc = np.array(docs_in, np.int64)[document]
                begin = head - (ends - [len(w) for w in words])[document] + np.array(firsts)[document]
                # Of equal segments in this part only the earliest has to travel to its shard.
                order = np.lexsort((begin, doc, content, mini))
                mini, content, doc, begin, size = (x[order] for x in (mini, content, doc, begin, size))
                same = np.concatenate(([False], (mini[1:] == mini[:-1]) & (content[1:] == content[:-1])))
                first = np.maximum.accumulate(np.where(same, 0, np.arange(len(same)))) if len(same) else order
                copy = same & ((doc != doc[first]) | (begin != begin[first]))
                mini = np.where(copy, mixed(doc.astype(np.uint64) * np.uint64(31) + begin.astype(np.uint64)), mini)
                place = begin << LENGTH_BITS | size | np.where(copy, EARLY, 0)
                yield pa.RecordBatch.from_arrays(
                    [longs(mini.view(np.int64)), longs(content.view(np.int64)), longs(doc), longs(place)],
                    names=["minimizer", "content", "doc", "place"],
                )

    if window - gram + 1 >= EARLY:
        raise ValueError("too many windows for one segment")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, "minimizer long, content long, doc long, place long")


def _sifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies as such (``minimizer`` null), and earliest segments whose minimizer has other segments.

    Rows come sorted by (minimizer, content, doc, place).  The first segment of
    a minimizer waits until the next one shows whether it is alone.
    """
    names = ["minimizer", "doc", "place"]
    last: tuple | None = None  # minimizer, content, doc and place of the earliest of the open group of equal segments
    waiting: tuple | None = None  # the first segment of the open minimizer, while it is alone
    for batch in batches:
        mini, content, doc, place = (batch.column(c).to_numpy() for c in ("minimizer", "content", "doc", "place"))
        early = (place & EARLY) != 0
        gone = [(doc[early], place[early] & ~EARLY)]
        mini, content, doc, place = (x[~early] for x in (mini, content, doc, place))
        kept: list[tuple] = []
        if len(mini):
            if last is not None:
                mini, content, doc, place = (
                    np.concatenate(([x], y)) for x, y in zip(last, (mini, content, doc, place), strict=True)
                )
            new_mini = np.concatenate(([True], mini[1:] != mini[:-1]))
            new = new_mini | np.concatenate(([True], content[1:] != content[:-1]))
            heads = np.flatnonzero(new)
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            copy = ~new & ((doc != doc[first]) | (place != place[first]))
            gone.append((doc[copy], place[copy]))
            # Heads: those that are not the first of their minimizer, and the first ones that are followed by such.
            other = ~new_mini[heads]
            followed = np.concatenate((other[1:], [False]))
            chosen = other | followed
            carried = last is not None
            if carried:
                if waiting is not None and (chosen[0] or followed[0]):
                    kept.append(waiting)
                    waiting = None
                chosen[0] = False  # given out before, or just now
            if heads[-1] > 0 or not carried:
                waiting = None
                if new_mini[heads[-1]]:
                    k = heads[-1]
                    waiting = (mini[k], doc[k], place[k])
            kept += list(zip(*(x[heads[chosen]] for x in (mini, doc, place)), strict=True))
            k = first[-1]
            last = (mini[k], content[k], doc[k], place[k])
        gone_doc, gone_place = (np.concatenate([g[c] for g in gone]) for c in (0, 1))
        arrays = [
            pa.concat_arrays([pa.nulls(len(gone_doc), pa.int64()), longs([x[0] for x in kept])]),
            pa.concat_arrays([longs(gone_doc), longs([x[1] for x in kept])]),
            pa.concat_arrays([longs(gone_place), longs([x[2] for x in kept])]),
        ]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def sifted(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(minimizer, doc, place) of the segments that matter; a null minimizer marks a copy to remove."""
    rows = segments(docs, window, gram).repartition("minimizer").sortWithinPartitions("minimizer", "content", "doc", "place")
    return rows.mapInArrow(_sifted, "minimizer long, doc long, place long")


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, packed): texts compressed for the exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data = [press.compress(t.encode()) for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], names=["doc_id", "packed"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, packed binary")


def _unpacked(column: pa.Array) -> Iterator[bytes]:
    import zstandard

    press = zstandard.ZstdDecompressor()
    for data in column.to_pylist():
        yield press.decompress(data)


def spelled(texts: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(minimizer, doc, start, words) of the wanted segments, words as 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for doc, data, found in zip(
                batch.column("doc").to_pylist(), _unpacked(batch.column("packed")), batch.column("found").to_pylist(), strict=True
            ):
                words = hashes.of(data.split())
                for segment in found:
                    start, size = segment["place"] >> LENGTH_BITS, segment["place"] & (EARLY - 1)
                    own = words[start : start + size + window - 1]
                    for target, value in zip(out, (segment["minimizer"], doc, start, own.tobytes()), strict=True):
                        target.append(value)
            yield pa.RecordBatch.from_arrays(
                [longs(out[0]), longs(out[1]), longs(out[2]), pa.array(out[3], pa.binary())],
                names=["minimizer", "doc", "start", "words"],
            )

    # As many segments as the document has, at most.
    by_doc = wanted.groupBy("doc").agg(F.collect_list(F.struct("minimizer", "place")).alias("found"))
    joined = texts.join(by_doc, F.col("doc_id") == F.col("doc")).select("doc", "packed", "found")
    return joined.mapInArrow(run, "minimizer long, doc long, start long, words binary").dropDuplicates(["minimizer", "doc", "start"])


def shards(texts: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(kind, minimizer, doc, start, words): segments for the indexes, and windows of hot minimizers.

    A window has its own hash as ``minimizer`` and no words.  Of equal windows in
    an Arrow batch only the earliest has to travel to its group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "minimizer", "doc", "start", "words"]
        for batch in batches:
            hot = batch.column("hot").is_valid()
            cold = batch.filter(pa.compute.invert(hot))
            if cold.num_rows:
                kind = pa.array(np.full(cold.num_rows, SEGMENT, np.int32))
                yield pa.RecordBatch.from_arrays([kind, *(cold.column(c) for c in names[1:])], names=names)
            batch = batch.filter(hot)
            if not batch.num_rows:
                continue
            own = [grams(np.frombuffer(w, np.uint64), window) for w in batch.column("words").to_pylist()]
            sizes = np.array([len(x) for x in own])
            ends = np.cumsum(sizes)
            key = np.concatenate(own)
            doc = np.repeat(batch.column("doc").to_numpy(), sizes)
            start = np.repeat(batch.column("start").to_numpy() - (ends - sizes), sizes) + np.arange(len(key))
            order = np.lexsort((start, doc, key))
            key, doc, start = key[order], doc[order], start[order]
            copy = np.concatenate(([False], key[1:] == key[:-1]))
            key = np.where(copy, mixed(doc.astype(np.uint64) * np.uint64(31) + start.astype(np.uint64)), key)
            kind = pa.array(np.where(copy, KNOWN_COPY, SINGLE).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [kind, longs(key.view(np.int64)), longs(doc), longs(start), pa.nulls(len(key), pa.binary())], names=names
            )

    size = F.col("place").bitwiseAND(F.lit(EARLY - 1)) + F.lit(window - 1)
    sizes = wanted.groupBy("minimizer").agg(F.sum(size).alias("n")).where(F.col("n") > WORDS_PER_INDEX)
    # At most one row for each WORDS_PER_INDEX words of the corpus.
    hot = F.broadcast(sizes.select(F.col("minimizer").alias("hot")))
    rows = spelled(texts, wanted, window).join(hot, F.col("minimizer") == F.col("hot"), "left")
    return rows.mapInArrow(run, "kind int, minimizer long, doc long, start long, words binary")


def repeated_windows(doc: np.ndarray, start: np.ndarray, words: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    """(doc, first window, windows) of what also starts earlier among the segments, from one FM-index of them."""
    sequences = [np.frombuffer(w, np.uint64) for w in words]
    lengths = np.array([len(s) for s in sequences])
    _, symbols = np.unique(np.concatenate(sequences), return_inverse=True)
    # Each sequence is followed by a separator.
    ends = np.cumsum(lengths + 1) - 1
    text = np.zeros(int(ends[-1]) + 1, np.int64)
    inside = np.ones(len(text), bool)
    inside[ends] = False
    text[inside] = symbols + 1
    index = FMIndex(text, window)
    sequence = np.repeat(np.arange(len(words)), lengths + 1)
    offset = np.arange(len(text)) - (ends - lengths)[sequence]
    # Places in the order of (doc, word); equal places have one number.
    place_doc, place_word = doc[sequence], start[sequence] + offset
    order = np.lexsort((place_word, place_doc))
    step = (np.diff(place_doc[order]) != 0) | (np.diff(place_word[order]) != 0)
    number = np.empty(len(text), np.int64)
    number[order] = np.concatenate(([0], np.cumsum(step)))
    earliest = index.least(number)
    hits = []
    for _, place, low, _ in index.matching_statistics(text, ends, lengths):
        hits.append(place[earliest[index.group[low]] < number[place]])
    found = np.sort(np.concatenate(hits)) if hits else np.empty(0, np.int64)
    if not len(found):
        return doc[:0], start[:0], start[:0]
    runs = np.flatnonzero(np.concatenate(([True], (np.diff(found) != 1) | (np.diff(sequence[found]) != 0))))
    heads = found[runs]
    sizes = np.diff(np.append(runs, len(found)))
    return place_doc[heads], place_word[heads], sizes


def _searched(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by kind and minimizer: one index after the other, then the windows of hot minimizers.

    A minimizer's segments are in one index.  Of equal windows all but the first are found.
    """
    names = ["doc", "start", "size"]
    last: int | None = None  # the window before
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]] = []
    size = 0

    def search() -> pa.RecordBatch:
        doc, start = (np.concatenate([h[k] for h in held]) for k in (1, 2))
        words = [w for h in held for w in h[3]]
        return pa.RecordBatch.from_arrays([longs(x) for x in repeated_windows(doc, start, words, window)], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        kind, mini, doc, start = (batch.column(c).to_numpy() for c in ("kind", "minimizer", "doc", "start"))
        n = int(np.searchsorted(kind, SINGLE))
        if n < len(kind):
            later = np.concatenate(([mini[n] == last if last is not None else False], mini[n + 1 :] == mini[n:-1]))
            single = kind[n:] == SINGLE
            if single.any():
                last = mini[n:][single][-1]
            gone = np.flatnonzero(later | ~single) + n
            yield pa.RecordBatch.from_arrays([longs(doc[gone]), longs(start[gone]), longs(np.ones(len(gone)))], names=names)
        if not n:
            continue
        mini, doc, start = mini[:n], doc[:n], start[:n]
        words = batch.column("words").slice(0, n).to_pylist()
        edges = [0, *(np.flatnonzero(np.diff(mini)) + 1).tolist(), len(mini)]
        for a, b in zip(edges, edges[1:]):
            if size >= WORDS_PER_INDEX and held[-1][0][-1] != mini[a]:
                yield search()
                held, size = [], 0
            held.append((mini[a:b], doc[a:b], start[a:b], words[a:b]))
            size += sum(len(w) for w in words[a:b]) // 8
    if held:
        yield search()


def repeats(docs: DataFrame, texts: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc, start, size): ``size`` windows from ``start`` on that also start earlier."""
    spark = docs.sparkSession
    path = scratch_path(spark, "segments")
    sifted(docs, window, gram).write.parquet(path)
    known = spark.read.parquet(path)
    wanted = known.where("minimizer is not null")
    rows = shards(texts, wanted, window).repartition("minimizer").sortWithinPartitions("kind", "minimizer", "doc", "start")
    found = rows.mapInArrow(lambda batches: _searched(batches, window), "doc long, start long, size long")
    copies = known.where("minimizer is null").select(
        "doc", F.shiftright("place", LENGTH_BITS).alias("start"), F.col("place").bitwiseAND(F.lit(EARLY - 1)).alias("size")
    )
    return found.unionByName(copies)


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words that no repeated window covers, joined by one blank.

    Places are named by the id.  Where an id has several texts, each (id, text)
    gets a number first, in the order of the ids and then of the texts' hashes.
    """
    named = docs.select("doc_id", "text", F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.xxhash64("text").alias("h"))).alias("__own"))
    several = named.where("doc_id is not null").groupBy("doc_id").agg((F.min("__own.h") != F.max("__own.h")).alias("several"))
    if several.where("several").isEmpty():
        return _without_repeats(docs, window, gram)
    codes = cut_lineage(dense_codes(named, "__own", "__code"))
    numbered = lookup_join(named, codes, ["__own"]).select(F.col("__code").alias("doc_id"), "text")
    found = _without_repeats(numbered, window, gram).withColumnRenamed("doc_id", "__code")
    ids = codes.select("__code", F.col("__own.doc_id").alias("doc_id"))
    return lookup_join(found, ids, ["__code"]).select("doc_id", "n_words", "n_removed", "kept")


def _without_repeats(docs: DataFrame, window: int, gram: int) -> DataFrame:
    texts = packed(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, kept = [], [], []
            for data, found in zip(_unpacked(batch.column("packed")), batch.column("found").to_pylist(), strict=True):
                words = data.split()
                sizes.append(len(words))
                if found:
                    edge = np.zeros(len(words) + 1, np.int64)
                    starts = np.minimum([f["start"] for f in found], len(words))
                    stops = np.minimum([f["start"] + f["size"] + window - 1 for f in found], len(words))
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, stops, -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                removed.append(sizes[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), longs(sizes), longs(removed), strings(kept)],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    by_doc = repeats(docs, texts, window, gram).groupBy("doc").agg(F.collect_list(F.struct("start", "size")).alias("found"))
    joined = texts.join(by_doc, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "packed", "found")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept string")
