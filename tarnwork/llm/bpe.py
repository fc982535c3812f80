"""Byte-level BPE encoding and decoding.

``encode`` cuts each text into the matches of the vocabulary's pattern and has
the ``tokenizers`` library merge each of them separately.  The library works on
characters, so the bytes of a match are written as one character each before
(and read back after) it.  A match's ids do not depend on the text around it,
so each worker merges a distinct match once and keeps the result in a bounded
memory; the ids of a text are the ids of its matches in turn.

``decode`` reverses the table.  A token may hold a part of a character, so it
joins the bytes of the whole text before reading them as UTF-8.

Null and empty texts have no ids.  Ids are kept as little-endian unsigned
32-bit integers in a binary column, the usual layout of token files.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.common import longs, strings, texts_of, with_columns

KEPT_MATCHES = 200_000


def byte_characters() -> str:
    """The character that stands for each byte: printable Latin-1 ones for themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    table = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return "".join(table[b] for b in range(256))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@lru_cache(maxsize=8)
def class_ranges(name: str, end: int) -> str:
    """The code points below ``end`` of a Unicode class such as ``\\p{L}`` or ``\\s``, as ranges of a character class."""
    import regex

    every = "".join(chr(c) for c in range(end) if not 0xD800 <= c < 0xE000)
    runs = [(m.start(), m.end() - 1) for m in regex.finditer(f"(?:{name})+", every)]
    return "".join(f"\\U{ord(every[a]):08x}-\\U{ord(every[b]):08x}" for a, b in runs)


def spelled_out(pattern: str, end: int = 0x110000) -> str:
    """The pattern for the standard ``re``, which lacks Unicode classes, for texts of code points below ``end``."""
    out, inside = [], False
    for part in re.finditer(r"\\[pP]\{\w+\}|\\.|.", pattern, re.DOTALL):
        at = part.group()
        if at == r"\S" and not inside:
            out.append(f"[^{class_ranges(chr(92) + 's', end)}]")
        elif at == r"\s" or at.startswith(r"\p"):
            out.append(class_ranges(at, end) if inside else f"[{class_ranges(at, end)}]")
        elif at in (r"\S", r"\w", r"\W", r"\d", r"\D", r"\b") or at.startswith(r"\P"):
            raise ValueError(f"{at} is not supported in a pattern")
        else:
            inside = at == "[" or (inside and at != "]")
            out.append(at)
    return "".join(out)


class Vocabulary:
    """A rank file as a model of the ``tokenizers`` library, with both byte tables."""

    def __init__(self, path: str, pattern: str):
        from tokenizers.models import BPE

        ranks = read_ranks(path)
        self.find_any = re.compile(spelled_out(pattern)).findall
        self.find_basic = re.compile(spelled_out(pattern, 0x10000)).findall
        self.beyond_basic = re.compile("[\U00010000-\U0010ffff]").search
        self.to_characters = {b: c for b, c in enumerate(byte_characters())}
        spelled = {token: self.spell(token) for token in ranks}
        # Every way to put a token together counts at the token's rank.
        merges = [
            (spelled[token[:k]], spelled[token[k:]])
            for token in sorted(ranks, key=ranks.get)
            for k in range(1, len(token))
            if token[:k] in ranks and token[k:] in ranks
        ]
        self.model = BPE({spelled[t]: r for t, r in ranks.items()}, merges, ignore_merges=True)
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.lengths = np.array([len(b) for b in self.bytes_of] or [0], np.int64)
        self.known: dict[str, bytes] = {}

    def spell(self, token: bytes) -> str:
        return token.decode("latin-1").translate(self.to_characters)

    def find(self, text: str) -> list[str]:
        """The matches of the pattern.  Classes up to U+FFFF are bitmaps in ``re`` and much faster."""
        return self.find_any(text) if self.beyond_basic(text) else self.find_basic(text)

    def learn(self, matches: set[str]) -> None:
        new = [m for m in matches if m not in self.known]
        if len(self.known) + len(new) > KEPT_MATCHES:
            self.known.clear()
            new = list(matches)
        for match in new:
            ids = [token.id for token in self.model.tokenize(self.spell(match.encode()))]
            self.known[match] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        matches = [self.find(t) for t in texts]
        self.learn(set().union(*matches))
        get = self.known.__getitem__
        return [b"".join(map(get, m)) for m in matches]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, text: str, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token and the one behind its last; a split character belongs to each of its tokens."""
        ends = np.cumsum(self.lengths[np.frombuffer(ids, "<u4")]) if ids else np.empty(0, np.int64)
        if not len(ends):
            return ends, ends
        data = np.frombuffer(text.encode(), np.uint8)
        character = np.cumsum((data & 0xC0) != 0x80) - 1
        starts = np.concatenate(([0], ends[:-1]))
        return character[starts], character[ends - 1] + 1


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One per worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    return Vocabulary(path, pattern)


def _slices(texts: list[str], largest: int = 1 << 20) -> Iterator[list[str]]:
    """Texts of about a million characters at a time, so that their matches stay small."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > largest:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", offsets: bool = False) -> DataFrame:
    """Adds ``ids`` (binary) and ``n_tokens``; with ``offsets`` also ``starts`` and ``ends`` in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
        own = vocabulary(path, pattern)
        for batch in batches:
            texts = texts_of(batch.column(text))
            ids = [x for part in _slices(texts) for x in own.encode(part)]
            columns = {"ids": pa.array(ids, pa.binary()), "n_tokens": longs([len(x) // 4 for x in ids])}
            if offsets:
                spans = [own.offsets(t, x) for t, x in zip(texts, ids, strict=True)]
                columns |= {
                    name: pa.array([s[k].tolist() for s in spans], pa.list_(pa.int64()))
                    for k, name in enumerate(("starts", "ends"))
                }
            yield columns

    more = ", starts array<bigint>, ends array<bigint>" if offsets else ""
    return with_columns(docs, "ids binary, n_tokens bigint" + more, run)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", as_text: bool = False) -> DataFrame:
    """Adds ``decoded``: the bytes of the ids, or with ``as_text`` their text (a broken character is replaced)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
        own = vocabulary(path, pattern)
        for batch in batches:
            data = [own.decode(x or b"") for x in batch.column(ids).to_pylist()]
            if as_text:
                yield {"decoded": strings(x.decode("utf-8", "replace") for x in data)}
            else:
                yield {"decoded": pa.array(data, pa.binary())}

    return with_columns(encoded, f"decoded {'string' if as_text else 'binary'}", run)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Lengths and digests of a round trip, a row per document."""
    encoded = encode(docs.select("doc_id", "text"), path, pattern).drop("text")
    return decode(encoded, path, pattern).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
