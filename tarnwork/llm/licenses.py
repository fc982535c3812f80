"""License scan: fixed phrases, and an exact set-similarity join of text blocks with license notices.

A block is a line of a text, or a window of consecutive words whatever the line
breaks between them; a notice is the set of its words.  Windows are twice as long
as the longest notice and begin every ``step`` words, the length of that notice,
so a notice that is wrapped or stands in a comment block lies in one of them.  A
block matches a notice if it contains at least ``CONTAINMENT`` of the notice's
words.  Words are
ordered by how many texts of the whole corpus have them, rarest first.  A block
that has ``need`` of a notice's ``n`` words has one of its ``n - need + 1``
rarest, so only these are joined on (prefix filter); blocks with too few words
are left out before (length filter); the places of the common word bound how
many more can be common (positional filter); what is left is verified.

Words are runs of ASCII letters and digits and of all characters beyond ASCII,
with A-Z in lower case.  Null and empty texts have no words and no labels.
The list of notices is a parameter; a notice without words matches nothing.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.common import longs, strings, texts_of, with_columns, without

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Short license notices as they stand in texts and files.
NOTICES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

CONTAINMENT = 0.85
LARGEST_BROADCAST = 20_000  # prefix rows of the notices; beyond it the join is shuffled

_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_TABLE).split()


def step_of(notices: list[tuple[str, str]]) -> int:
    """Words of the longest notice: the distance of windows, which are twice as long."""
    return max((len(words_of(text.encode())) for _, text in notices), default=0) or 1


def places(words: list[bytes], phrases: dict[str, str]) -> dict[str, list[int]]:
    """Starts of each phrase."""
    found = {}
    for phrase in phrases:
        own = phrase.encode().split()
        starts, at = [], -1
        try:
            while True:
                at = words.index(own[0], at + 1)
                if words[at : at + len(own)] == own:
                    starts.append(at)
        except ValueError:
            pass
        found[phrase] = starts
    return found


def phrase_places(docs: DataFrame, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """Adds ``n_words``, ``n_base``, ``first_word``, ``last_word`` and ``base_labels``."""
    last = {phrase.encode().split()[-1] for phrase in phrases}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
        for batch in batches:
            sizes, counts, firsts, lasts, labels = [], [], [], [], []
            for text in texts_of(batch.column("text")):
                low = text.encode().translate(_TABLE)
                words = low.split()
                found = places(words, phrases) if any(w in low for w in last) else {}
                starts = [s for own in found.values() for s in own]
                sizes.append(len(words))
                counts.append(len(starts))
                firsts.append(min(starts, default=None))
                lasts.append(max(starts, default=None))
                labels.append(",".join(sorted({phrases[p] for p, own in found.items() if own})))
            yield {
                "n_words": longs(sizes),
                "n_base": longs(counts),
                "first_word": pa.array(firsts, pa.int64()),
                "last_word": pa.array(lasts, pa.int64()),
                "base_labels": strings(labels),
            }

    schema = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string"
    return with_columns(docs, schema, run)


def word_counts(docs: DataFrame, words: set[bytes]) -> dict[bytes, int]:
    """How many texts have each of some words; every task adds up its own texts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in batches:
            for text in texts_of(batch.column(0)):
                total.update(words.intersection(words_of(text.encode())))
        names = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), longs([total[w] for w in names])], names=["word", "n"])

    counts = docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in counts.collect()}  # at most as many rows as the notices have words


def matches(
    docs: DataFrame, notices: list[tuple[str, str]] = NOTICES, containment: float = CONTAINMENT
) -> DataFrame:
    """(doc_id, text_key, notice, containment): every notice that some block of a text contains, with its best block."""
    sets = [(label, set(words_of(text.encode()))) for label, text in notices]
    sets = [(label, own) for label, own in sets if own]
    counts = word_counts(docs, set().union(*(own for _, own in sets)) if sets else set())
    vocabulary = set().union(*(own for _, own in sets)) if sets else set()
    rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    rows, prefix_words, least = [], set(), math.inf
    for k, (label, own) in enumerate(sets):
        ranks = sorted(rank[w] for w in own)
        need = max(1, math.ceil(containment * len(ranks) - 1e-9))
        least = min(least, need)
        for place in range(len(ranks) - need + 1):
            rows.append((k, label, ranks[place], place, ranks, need))
            prefix_words.add(next(w for w, r in rank.items() if r == ranks[place]))
    prefixes = docs.sparkSession.createDataFrame(
        rows, "notice int, label string, word int, place int, words array<int>, need int"
    )
    if len(rows) <= LARGEST_BROADCAST:
        prefixes = F.broadcast(prefixes)
    keys = sorted(prefix_words)
    step = step_of(notices)

    def blocks_of(low: bytes) -> Iterator[set[bytes]]:
        """Sets of words of the lines and windows that hold a word of a prefix."""
        for line in low.split(b"\n"):
            own = set(words_of(line))
            if not prefix_words.isdisjoint(own):
                yield own
        words = words_of(low)
        starts = {k for i, w in enumerate(words) if w in prefix_words for k in (i // step - 1, i // step) if k >= 0}
        for k in sorted(starts):
            yield set(words[k * step : (k + 2) * step])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, blocks = [], []
            for k, text in enumerate(texts_of(batch.column("text"))):
                low = text.encode()
                folded = low.translate(_TABLE)
                if not any(w in folded for w in keys):
                    continue
                # Equal blocks of a text count once; too few words of the notices match none (length filter).
                found = {tuple(sorted(rank[w] for w in own & vocabulary)) for own in blocks_of(low)}
                kept = sorted(b for b in found if len(b) >= least)
                at.extend([k] * len(kept))
                blocks.extend(kept)
            picked = batch.select(["doc_id", "text_key"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*picked.columns, pa.array(blocks, pa.list_(pa.int32()))], names=["doc_id", "text_key", "block"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", "text", key_of_text().alias("text_key"))
    found = source.mapInArrow(run, f"doc_id {kind}, text_key long, block array<int>")
    joined = found.select("*", F.posexplode("block").alias("block_place", "word")).join(prefixes, "word")
    here, there = F.size("block"), F.size("words")
    bound = F.least("place", "block_place") + 1 + F.least(there - F.col("place") - 1, here - F.col("block_place") - 1)
    common = F.size(F.array_intersect("block", "words"))
    return (
        joined.where((here >= F.col("need")) & (bound >= F.col("need")))
        .select("doc_id", "text_key", "notice", "label", (common / there).alias("containment"), (common >= F.col("need")).alias("ok"))
        .where("ok")
        .groupBy("doc_id", "text_key", "notice", "label")
        .agg(F.max("containment").alias("containment"))
    )


def key_of_text() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def scan(docs: DataFrame, notices: list[tuple[str, str]] = NOTICES, containment: float = CONTAINMENT) -> DataFrame:
    """The frame with phrase places, ``labels`` (phrases and notices) and ``score``.

    The score is 1 where a phrase stands, else the greatest containment of a
    matched notice, else 0.
    """
    best = (
        matches(docs, notices, containment).groupBy("doc_id", "text_key")
        .agg(F.collect_set("label").alias("__labels"), F.max("containment").alias("__score"))  # a label for each notice at most
        .select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "__labels", "__score")
    )
    base = phrase_places(without(docs, ["labels", "score"]).withColumn("__text_key", key_of_text()))
    joined = base.join(best, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_key") == F.col("__key")), "left")
    own = F.filter(F.split("base_labels", ","), lambda x: x != "")
    every = F.array_sort(F.array_union(own, F.coalesce("__labels", F.array().cast("array<string>"))))
    return joined.withColumns(
        {
            "labels": F.array_join(every, ","),
            "score": F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("__score", F.lit(0.0))),
        }
    ).drop("__text_key", "__id", "__key", "__labels", "__score")
