"""Secret scan: fixed patterns, and a character convolutional network.

``base_spans`` are the patterns' matches, which always stay.  The network reads
every other candidate (a run of key characters with a digit, at least
``SHORTEST`` long) together with the characters around it: one-hot characters,
a convolution over ``WIDTH`` neighbours, the maximum over the places inside the
candidate and over those around it, and a logistic output, all in numpy.  It is
trained on the candidates of all texts, each whole: a candidate is a secret if a
base span covers it.  Equal pictures of candidates (the characters that the
network sees) with the same answer are one example, counted.  By a hash of the
picture a fourth of them is held back, the others are dealt into shards of about
``SHARD``.  A round takes every shard through ``EPOCHS`` epochs from the same
weights and goes on with the mean over the shards.  Then all held-back examples,
as often as they occur, calibrate the output (Platt's scaling) and set the
threshold, which has to find ``RECALL`` of the held-back secrets.  Means are taken
of whole numbers and outputs are read in steps of 1 / ``STEPS``, so the network is
the same however the rows are dealt out.

Candidates are whole; the network sees one longer than ``2 * INSIDE`` characters
in windows of that length, each half over the next, and the best score counts.  Null and empty texts have no spans.  Places are code points,
ends exclusive.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import batched, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.common import longs, shuffles_dropped, strings, texts_of, with_columns
from tarnwork.session import cut_lineage

KINDS = ("assign", "access", "hex")
ADDED = "network"
Span = tuple[int, int, str]

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]+")
_DIGITS = re.compile(r"[0-9]+")
_KEY_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")

SHORTEST = 8
INSIDE = 24
CONTEXT = 16
WIDTH = 5
FILTERS = 16
SHARD = 4096
ROUNDS = 4
EPOCHS = 3
STEPS = 256
RECALL = 0.95
LEAST_PRECISION = 0.98
LEAST_EXAMPLES = 20


def base_spans(text: str) -> list[Span]:
    """Matches of the three patterns, by start and then kind as listed."""
    found: list[Span] = []
    if ":" in text or "=" in text:
        found += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return ordered(found)


def ordered(spans: list[Span]) -> list[Span]:
    rank = {kind: k for k, kind in enumerate((*KINDS, ADDED))}
    return sorted(spans, key=lambda s: (s[0], rank[s[2]], s[1]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Runs of key characters that hold a digit."""
    end = 0
    at = _DIGITS.search(text)
    while at:
        start = at.start()
        while start > end and text[start - 1] in _KEY_CHARACTERS:
            start -= 1
        end = _CANDIDATE.match(text, at.start()).end()
        if end - start >= SHORTEST:
            yield start, end
        at = _DIGITS.search(text, end)


# Characters as the network sees them: letters and digits by themselves, the rest in groups.
_MARKS = "+/_.=-:\"'@ "
OUTSIDE = 0


def _codes() -> np.ndarray:
    codes = np.full(256, 1, np.int64)
    for k in range(26):
        codes[97 + k] = 2 + k
        codes[65 + k] = 28 + k
    for k in range(10):
        codes[48 + k] = 54 + k
    for k, c in enumerate(_MARKS):
        codes[ord(c)] = 64 + k
    return codes


CODES = _codes()
ALPHABET = 64 + len(_MARKS)
LENGTH = CONTEXT + INSIDE * 2 + CONTEXT


def windows(start: int, end: int) -> Iterator[tuple[int, int]]:
    """A candidate, or the windows of a long one."""
    for at in range(start, max(start, end - 2 * INSIDE), INSIDE):
        yield at, at + 2 * INSIDE
    yield max(start, end - 2 * INSIDE), end


def picture(text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Character codes of a candidate (at most ``2 * INSIDE`` long) within its surroundings, and which places are inside."""
    inner = text[start:end]
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    raw = np.frombuffer((before + inner + after).encode("latin-1", "replace"), np.uint8)
    codes = np.full(LENGTH + WIDTH - 1, OUTSIDE, np.int64)
    at = WIDTH // 2 + CONTEXT - len(before)
    codes[at : at + len(raw)] = CODES[raw]
    inside = np.zeros(LENGTH, bool)
    inside[CONTEXT : CONTEXT + len(inner)] = True
    return codes, inside


@dataclass
class Network:
    kernel: np.ndarray  # place in the kernel, character, filter
    bias: np.ndarray
    out: np.ndarray  # two maxima for each filter
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 1.0

    def raw(self, codes: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, tuple]:
        n = len(codes)
        maps = np.zeros((n, LENGTH, FILTERS))
        for k in range(WIDTH):
            maps += self.kernel[k][codes[:, k : k + LENGTH]]
        maps = np.maximum(maps + self.bias, 0.0)
        within = np.where(inside[:, :, None], maps, -1.0)
        around = np.where(inside[:, :, None], -1.0, maps)
        tops = [x.argmax(axis=1) for x in (within, around)]
        values = [np.maximum(np.take_along_axis(x, t[:, None, :], 1)[:, 0], 0) for x, t in zip((within, around), tops, strict=True)]
        pooled = np.concatenate(values, axis=1)
        # Row by row: a matrix product may round a row by where it stands in the batch.
        return (pooled * self.out).sum(axis=1) + self.out_bias, (pooled, tops)

    def gradients(self, codes: np.ndarray, inside: np.ndarray, error: np.ndarray) -> dict[str, np.ndarray]:
        """Of the summed loss, from its derivative by each output."""
        _, (pooled, tops) = self.raw(codes, inside)
        back = error[:, None] * self.out[None, :] * (pooled > 0)
        kernel = np.zeros_like(self.kernel)
        for side, top in enumerate(tops):
            for k in range(WIDTH):
                seen = np.take_along_axis(codes, top + k, 1)
                np.add.at(kernel[k], (seen, np.arange(FILTERS)[None, :]), back[:, side * FILTERS : (side + 1) * FILTERS])
        return {
            "kernel": kernel,
            "bias": back.reshape(-1, 2, FILTERS).sum(axis=(0, 1)),
            "out": pooled.T @ error + 1e-4 * self.out,
            "out_bias": error.sum(),
        }

    def steps(self, codes: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Outputs in whole steps of 1 / ``STEPS``."""
        parts = [self.raw(codes[k : k + 256], inside[k : k + 256])[0] for k in range(0, len(codes), 256)]
        logits = np.concatenate(parts) if parts else np.empty(0)
        return np.rint(np.clip(logits, -40, 40) * STEPS).astype(np.int64)

    def calibrated(self, steps: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * steps / STEPS + self.shift, -40, 40)))

    def scores(self, codes: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        return self.calibrated(self.steps(codes, inside))


def _stacked(pictures: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([p[0] for p in pictures]).reshape(-1, LENGTH + WIDTH - 1), np.array([p[1] for p in pictures]).reshape(-1, LENGTH)


def examples(texts: Iterator[str]) -> Iterator[tuple[bytes, int]]:
    """Pictures of all candidates' windows, written as bytes, and whether a base span overlaps them."""
    for text in texts:
        base = base_spans(text)
        at = 0
        for start, end in (w for c in candidates(text) for w in windows(*c)):
            while at < len(base) and base[at][1] <= start:
                at += 1
            codes, inside = picture(text, start, end)
            yield codes.astype(np.uint8).tobytes() + bytes([inside.sum()]), int(at < len(base) and base[at][0] < end)


def place(seen: bytes) -> int:
    """Where a picture belongs: held back if divisible by four, else the rest decides on the shard."""
    import xxhash

    return xxhash.xxh3_64_intdigest(seen) >> 1


def _read(pictures: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The codes and insides of written pictures."""
    rows = np.frombuffer(b"".join(pictures), np.uint8).reshape(-1, LENGTH + WIDTH).astype(np.int64)
    at = np.arange(LENGTH)[None, :] - CONTEXT
    return rows[:, :-1], (at >= 0) & (at < rows[:, -1:])


_SIZES = (WIDTH * ALPHABET * FILTERS, FILTERS, 2 * FILTERS, 1)
_WHOLE = 1 << 30


def _start() -> np.ndarray:
    """Weights at random, then the sum of their squared gradients: what a round hands on."""
    order = np.random.default_rng(11)
    return np.concatenate(
        [
            order.normal(0, 0.1, _SIZES[0]), np.zeros(FILTERS), order.normal(0, 0.1, 2 * FILTERS), [0.0],
            np.full(sum(_SIZES), 1e-6),
        ]
    )


def _network(state: np.ndarray) -> Network:
    kernel, bias, out, out_bias = np.split(state[: sum(_SIZES)], np.cumsum(_SIZES)[:-1])
    return Network(kernel.reshape(WIDTH, ALPHABET, FILTERS), bias, out, float(out_bias[0]), threshold=2.0)


def lesson(state: np.ndarray, pictures: list[bytes], secret: list[int], share: float, seed: tuple[int, int]) -> np.ndarray:
    """``EPOCHS`` epochs over one shard, as whole numbers; ``share`` is the part of secrets in all shards."""
    order = np.random.default_rng((11, *seed))
    state = state.copy()
    weights, squares = np.split(state, 2)
    codes, inside = _read(pictures)
    y = np.array(secret, float)
    weight = np.where(y > 0, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))
    for _ in range(EPOCHS):
        for part in np.array_split(order.permutation(len(y)), max(1, len(y) // 64)):
            net = _network(state)
            logits, _ = net.raw(codes[part], inside[part])
            error = (1 / (1 + np.exp(-np.clip(logits, -40, 40))) - y[part]) * weight[part] / len(part)
            gradients = net.gradients(codes[part], inside[part], error)
            gradient = np.concatenate([np.ravel(gradients[name]) for name in ("kernel", "bias", "out", "out_bias")])
            squares += np.square(gradient)
            weights -= 0.05 * gradient / np.sqrt(squares)
    return np.rint(state * _WHOLE).astype(np.int64)


def learned(
    counts: dict[tuple[bool, int], int],
    taught: Callable[[np.ndarray, int, int, float], np.ndarray],
    judged: Callable[[Network], list[tuple[int, int, int]]],
) -> Network:
    """The network from the number of examples by (held back, secret).

    ``taught(state, round, shards, share)`` adds up the lessons of all shards;
    ``judged`` counts the held-back occurrences by output (in steps) and answer.
    """
    state = _start()
    secret, other = counts.get((False, 1), 0), counts.get((False, 0), 0)
    if min(secret + counts.get((True, 1), 0), other + counts.get((True, 0), 0)) < LEAST_EXAMPLES or not secret or not other:
        return _network(state)  # too little to learn from: adds nothing
    shards = -(-(secret + other) // SHARD)
    for k in range(ROUNDS):
        state = taught(state, k, shards, secret / (secret + other)) / shards / _WHOLE
    net = _network(state)
    steps, y, times = np.array(sorted(judged(net)), float).reshape(-1, 3).T
    net.scale, net.shift = _platt(steps / STEPS, y, times)
    net.threshold = _threshold(net.calibrated(steps), y, times)
    return net


def train(texts: list[str]) -> Network:
    """What ``fit`` learns, from texts at hand."""
    seen = sorted((place(p), y, p, n) for (p, y), n in Counter(examples(texts)).items())
    held = [row for row in seen if row[0] % 4 == 0]

    def taught(state: np.ndarray, k: int, shards: int, share: float) -> np.ndarray:
        total = 0
        for shard in range(shards):
            rows = [row for row in seen if row[0] % 4 and (row[0] >> 2) % shards == shard]
            if rows:
                total = total + lesson(state, [r[2] for r in rows], [r[1] for r in rows], share, (k, shard))
        return total

    def judged(net: Network) -> list[tuple[int, int, int]]:
        tally: Counter[tuple[int, int]] = Counter()
        for step, (_, y, _, n) in zip(net.steps(*_read([r[2] for r in held])).tolist(), held, strict=True):
            tally[step, y] += n
        return [(step, y, n) for (step, y), n in tally.items()]

    return learned(Counter((row[0] % 4 == 0, row[1]) for row in seen), taught, judged)


def _platt(logits: np.ndarray, y: np.ndarray, times: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through held-back outputs (targets kept off 0 and 1)."""
    secret, other = (times * y).sum(), (times * (1 - y)).sum()
    target = np.where(y > 0, (secret + 1) / (secret + 2), 1 / (other + 2))
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * logits + b, -40, 40)))
        w = times * (p * (1 - p) + 1e-9)
        off = times * (p - target)
        g = np.array([(off * logits).sum(), off.sum()]) + 1e-6 * np.array([a, b])
        h = np.array([[(w * logits**2).sum(), (w * logits).sum()], [(w * logits).sum(), w.sum()]]) + 1e-6 * np.eye(2)
        move = np.linalg.solve(h, g)
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def _threshold(scores: np.ndarray, y: np.ndarray, times: np.ndarray) -> float:
    """Of the thresholds from one half on that find enough of the held-back secrets, the lowest with the best precision.

    2 (nothing is added) if even that precision does not suffice.
    """
    best, at = LEAST_PRECISION, 2.0
    order = np.argsort(scores)
    # How many secrets, and how many candidates, score at least as much.
    secrets, chosen = (np.append(np.cumsum(n[order][::-1])[::-1], 0.0) for n in (times * y, times))
    for t in np.unique(np.concatenate(([0.5], scores[scores > 0.5]))):
        first = np.searchsorted(scores, t, sorter=order)
        if not secrets[0] or secrets[first] < RECALL * secrets[0]:
            break
        precision = float(secrets[first] / chosen[first])
        if precision > best or (precision == best and at == 2.0):
            best, at = precision, float(t)
    return at


def spans_of(texts: list[str], net: Network) -> list[tuple[list[Span], list[Span]]]:
    """(base, base and added) of each text; the candidates of all texts go through the network together."""
    base = [base_spans(t) for t in texts]
    added: list[list[Span]] = [[] for _ in texts]
    waiting: list[tuple[int, int, int]] = []
    pictures: list[tuple[np.ndarray, np.ndarray]] = []

    def judge() -> None:
        for (k, s, e), score in zip(waiting, net.scores(*_stacked(pictures)), strict=True):
            if score >= net.threshold and (s, e, ADDED) not in added[k][-1:]:
                added[k].append((s, e, ADDED))
        waiting.clear()
        pictures.clear()

    for k, text in enumerate(texts):
        at = 0
        taken = base[k]
        for start, end in candidates(text):
            while at < len(taken) and taken[at][1] <= start:
                at += 1
            if any(s < end and start < e for s, e, _ in taken[at : at + 2 * len(KINDS)]):
                continue
            for window in windows(start, end):
                waiting.append((k, start, end))
                pictures.append(picture(text, *window))
                if len(pictures) >= 1024:
                    judge()
    judge()
    return [(b, ordered(b + a) if a else b) for b, a in zip(base, added, strict=True)]


def pictures_of(docs: DataFrame) -> DataFrame:
    """The examples of all texts: ``place``, ``picture``, ``secret`` and how many ``times`` they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batched(examples(t for batch in batches for t in texts_of(batch.column("text"))), 1024):
            pictures, secret = zip(*rows, strict=True)
            columns = [longs([place(p) for p in pictures]), pa.array(pictures, pa.binary()), longs(secret)]
            yield pa.RecordBatch.from_arrays(columns, names=["place", "picture", "secret"])

    texts = docs.select("text").where(F.col("text").rlike("[0-9]"))  # no candidate is without a digit
    found = texts.mapInArrow(run, "place bigint, picture binary, secret bigint")
    return found.groupBy("place", "picture", "secret").agg(F.count("*").alias("times"))


def _taught(dealt: DataFrame, state: np.ndarray, k: int, share: float) -> np.ndarray:
    """The sum of the lessons of all shards, added up in the tasks first; the rows of a shard come one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("shard", "picture", "secret")), strict=True))
        for shard, own in groupby(rows, key=lambda r: r[0]):
            _, pictures, secret = zip(*own, strict=True)
            new = lesson(state, pictures, secret, share, (k, shard))
            total = new if total is None else total + new
        if total is not None:
            yield pa.RecordBatch.from_arrays([longs(np.arange(len(total))), longs(total)], names=["at", "value"])

    sums = dealt.mapInArrow(run, "at bigint, value bigint").groupBy("at").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(len(state), np.int64)
    total[[r["at"] for r in sums]] = [r["value"] for r in sums]
    return total


def _judged(held: DataFrame, net: Network) -> list[tuple[int, int, int]]:
    """How often each output occurs with each answer: at most two rows for each of ``80 * STEPS + 1`` outputs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps = net.steps(*_read(batch.column("picture").to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [longs(steps), batch.column("secret"), batch.column("times")], names=["step", "secret", "times"]
            )

    counted = held.mapInArrow(run, "step bigint, secret bigint, times bigint").groupBy("step", "secret").agg(F.sum("times").alias("times"))
    return [tuple(r) for r in counted.collect()]


def fit(docs: DataFrame) -> Network:
    """Trains, calibrates and sets the threshold on the candidates of all texts."""
    with shuffles_dropped(docs.sparkSession):
        seen = cut_lineage(pictures_of(docs).withColumn("held", F.col("place") % 4 == 0))
    counts = {(r["held"], r["secret"]): r["count"] for r in seen.groupBy("held", "secret").count().collect()}
    dealt: list[DataFrame] = []

    def taught(state: np.ndarray, k: int, shards: int, share: float) -> np.ndarray:
        if not dealt:
            shard = F.shiftright("place", 2) % shards
            rows = seen.where("not held").select(shard.alias("shard"), "place", "secret", "picture")
            # As many partitions as shards: these rows are few bytes and much work.
            rows = rows.repartition(shards, "shard").sortWithinPartitions("shard", "place", "secret", "picture")
            with shuffles_dropped(docs.sparkSession):
                dealt.append(cut_lineage(rows))
        return _taught(dealt[0], state, k, share)

    return learned(counts, taught, lambda net: _judged(seen.where("held"), net))


def find(docs: DataFrame, net: Network) -> DataFrame:
    """Adds counts of the base kinds, and base and all spans as ``kind:start:end`` text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
        for batch in batches:
            both = spans_of(texts_of(batch.column("text")), net)
            counts = {
                f"n_{kind}": pa.array([sum(s[2] == kind for s in base) for base, _ in both], pa.int64()) for kind in KINDS
            }
            yield counts | {
                "base_spans": strings(written(base) for base, _ in both),
                "spans": strings(written(spans) for _, spans in both),
            }

    schema = ", ".join(f"n_{kind} bigint" for kind in KINDS) + ", base_spans string, spans string"
    return with_columns(docs, schema, run)


def redacted(text: str, spans: list[Span], mark: str) -> str:
    """The text with every span (overlapping ones as one) replaced by the mark."""
    out, end = [], 0
    for start, stop, _ in sorted(spans):
        if start >= end:
            out += [text[end:start], mark]
        end = max(end, stop)
    return "".join([*out, text[end:]])


def redact(docs: DataFrame, net: Network, mark: str = "[secret]") -> DataFrame:
    """Replaces ``text`` where it holds a secret; all other texts, null too, stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            both = spans_of([t or "" for t in texts], net)
            new = [redacted(t, spans, mark) if spans else t for t, (_, spans) in zip(texts, both, strict=True)]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), strings(new).cast(batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
