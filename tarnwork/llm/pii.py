"""Personal data: fixed patterns, and a semi-Markov conditional random field.

``base_spans`` are the patterns' matches, which always stay.  The field looks
at *zones*: runs of text around digits and ``@`` (neighbouring chunks joined),
cut into tokens.  A zone is split into segments, each either one token of other
text or an entity of at most ``LONGEST`` tokens.  Features describe a whole
candidate (digit count, Luhn sum, dots, brackets, what stands next to it), so
boundaries and type are chosen jointly by dynamic programming over all
segmentations.  Segments that overlap no base span are added.

The weights maximise the conditional likelihood of zones labelled with the base
spans, with gradients from the forward-backward recursion.  The training zones
come from at most ``TRAIN_DOCUMENTS`` texts, the same ones on every run.

Null and empty texts have no spans.  Places are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.common import bounded_sample, strings, texts_of, with_columns

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never starts inside a run of digits, so the lookbehind changes nothing but the time on long runs.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")

LONGEST = 24
MOST_DIGITS = 20
TRAIN_DOCUMENTS = 600
TRAIN_ZONES = 700
TRAIN_LENGTH = 20_000
ZONE_TOKENS = 160
EPOCHS = 12
MARGIN = 1.0


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            end = match.end()
            yield start, end, "email"
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """Matches of the four patterns, by start and then kind as listed."""
    found: list[Span] = []
    if not _HINT.search(text):
        return found
    if "@" in text:
        found += _emails(text)
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
            found.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37:
            digits = re.sub("[ -]", "", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((*m.span(), "phone"))
    return ordered(found)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


# Zones and candidates

_CHUNK = re.compile(r"[^\s]+")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]")
_SPACE = frozenset(" \t\n\r\x0b\f")


def zones(text: str) -> Iterator[tuple[int, int]]:
    """Chunks with a digit or ``@``, neighbours with one blank between them joined."""
    start = end = -1
    at = _HINT.search(text)
    while at:
        left = at.start()
        while left > max(end, 0) and text[left - 1] not in _SPACE:
            left -= 1
        right = at.end()
        while right < len(text) and text[right] not in _SPACE:
            right += 1
        if start >= 0 and left - end <= 1 and "\n" not in text[end:left]:
            end = right
        else:
            if start >= 0:
                yield start, end
            start, end = left, right
        at = _HINT.search(text, right)
    if start >= 0:
        yield start, end


def tokens(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text, start, end)]


FEATURES = 24


def span_features(text: str, start: int, end: int) -> tuple | None:
    """What a candidate looks like as a whole; None if no entity can look so."""
    span = text[start:end]
    digits = "".join(c for c in span if "0" <= c <= "9")
    n, at = len(digits), span.count("@")
    letters = sum(c.isalpha() for c in span)
    if span[-1] in " (+" or (n < 4 and not at) or (letters and not at):
        return None
    dots, blanks = span.count("."), span.count(" ") + span.count("-")
    brackets = span.count("(") + span.count(")")
    other = len(span) - n - letters - dots - blanks - brackets - at - span.count("+") - span.count("_") - span.count("%")
    parts = span.split(".")
    before, after = text[start - 1 : start], text[end : end + 1]
    return (
        1.0,
        at == 1 and 0 < span.index("@") < len(span) - 1,
        at > 1,
        at == 1 and "." in span[span.index("@") + 2 : -1] and span[span.index("@") + 1].isalnum(),
        letters == 0,
        letters > 0,
        n < 8,
        8 <= n <= 13,
        14 <= n <= 19,
        n > 19,
        n == 10 or n == 11,
        n >= 14 and letters == 0 and luhn(digits),
        span[0] == "+",
        len(parts) == 4 and all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts),
        dots == 0,
        dots > 3,
        span.startswith("(") or (span.count("(") == 1 and span.count(")") == 1),
        span.count("(") != span.count(")"),
        blanks == 0,
        blanks > 5,
        bool(before) and (before.isalnum() or before in "+@.-_%"),
        bool(after) and (after.isalnum() or after in "@-_" or (after == "." and text[end + 1 : end + 2].isalnum())),
        not span[0].isalnum() and span[0] not in "+(",
        other > 0 or not span[-1].isalnum(),
    )


def candidates(text: str, toks: list[tuple[int, int]], first_token: int = 0, stop: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first token, token behind the last) and the features of every possible entity of a zone that starts in a range."""
    places, rows = [], []
    for i in range(first_token, len(toks) if stop is None else min(stop, len(toks))):
        start = toks[i][0]
        if text[start] in " )":
            continue
        letters = digits = at = 0
        for j in range(i, min(len(toks), i + LONGEST)):
            first, last = text[toks[j][0]], toks[j][1] - toks[j][0]
            if "0" <= first <= "9":
                digits += last
            elif first == "@":
                at += 1
            elif first.isalpha():
                letters += last
            if at > 1 or (digits > MOST_DIGITS and not at):
                break
            if not at and (letters or digits < 4):
                continue
            f = span_features(text, start, toks[j][1])
            if f is not None:
                places.append((i, j + 1))
                rows.append(f)
    return np.array(places, np.int64).reshape(-1, 2), np.array(rows, np.float64).reshape(-1, FEATURES)


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + float(np.log(sum(np.exp(v - top) for v in values)))


def _marginals(n: int, places: np.ndarray, scores: np.ndarray) -> tuple[float, np.ndarray]:
    """Log partition sum over all segmentations, and the probability of each (candidate, kind).

    A token of other text scores 0, so only entities have weights.
    """
    every = np.logaddexp.reduce(scores, axis=1) if len(scores) else np.empty(0)
    ends: list[list[int]] = [[] for _ in range(n + 1)]
    starts: list[list[int]] = [[] for _ in range(n + 1)]
    for c, (i, j) in enumerate(places):
        ends[j].append(c)
        starts[i].append(c)
    forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
    for t in range(1, n + 1):
        forward[t] = _log_sum([forward[t - 1], *(forward[places[c][0]] + every[c] for c in ends[t])])
    for t in range(n - 1, -1, -1):
        backward[t] = _log_sum([backward[t + 1], *(backward[places[c][1]] + every[c] for c in starts[t])])
    total = forward[n]
    if not len(places):
        return total, scores
    around = np.array([forward[i] + backward[j] for i, j in places])
    return total, np.exp(scores + around[:, None] - total)


def train(texts: list[str]) -> np.ndarray:
    """Weights (features x kinds) from zones labelled with their base spans."""
    examples = []
    for text in texts:
        spans = {(s, e): KINDS.index(k) for s, e, k in base_spans(text)}
        for start, end in zones(text):
            toks = tokens(text, start, end)
            if len(toks) > ZONE_TOKENS or len(examples) >= TRAIN_ZONES:
                continue
            places, rows = candidates(text, toks)
            if not len(places):
                continue
            truth = np.zeros((len(places), len(KINDS)))
            for c, (i, j) in enumerate(places):
                kind = spans.get((toks[i][0], toks[j - 1][1]))
                if kind is not None:
                    truth[c, kind] = 1.0
            examples.append((len(toks), places, rows, truth))
    weights = np.zeros((FEATURES, len(KINDS)))
    weights[0] = -2.0
    squares = np.full_like(weights, 1e-3)
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for k in order.permutation(len(examples)):
            n, places, rows, truth = examples[k]
            _, expected = _marginals(n, places, rows @ weights)
            gradient = rows.T @ (truth - expected) - 1e-3 * weights
            squares += gradient**2
            weights += 0.5 * gradient / np.sqrt(squares)
    return weights


def decode(text: str, weights: np.ndarray) -> list[Span]:
    """The best segmentation's entities.

    The recursion runs over the whole zone; only the features are computed for
    ``ZONE_TOKENS`` starts at a time, so their memory has a bound.
    """
    found: list[Span] = []
    for start, end in zones(text):
        toks = tokens(text, start, end)
        n = len(toks)
        value, back = [0.0] * (n + 1), [(-1, -1)] * (n + 1)  # start and kind of the best entity that ends here
        ends: dict[int, list[tuple[int, int, float]]] = {}
        for at in range(0, n, ZONE_TOKENS):
            stop = min(n, at + ZONE_TOKENS)
            places, rows = candidates(text, toks, at, stop)
            if len(places):
                scores = rows @ weights - MARGIN
                own = zip(places.tolist(), scores.argmax(axis=1).tolist(), scores.max(axis=1).tolist(), strict=True)
                for (i, j), kind, best in own:
                    ends.setdefault(j, []).append((i, kind, best))
            # What ends up to ``stop`` starts before it.
            for t in range(at + 1, stop + 1):
                value[t] = value[t - 1]
                for i, kind, best in ends.pop(t, ()):
                    score = value[i] + best
                    if score > value[t]:
                        value[t], back[t] = score, (i, kind)
        t = n
        while t > 0:
            i, kind = back[t]
            if i < 0:
                t -= 1
                continue
            found.append((toks[i][0], toks[t - 1][1], KINDS[kind]))
            t = i
    return ordered(found)


def all_spans(text: str, weights: np.ndarray) -> tuple[list[Span], list[Span]]:
    """(base, base and added)."""
    base = base_spans(text)
    if not _HINT.search(text):
        return base, base
    taken = [(s, e) for s, e, _ in base]
    extra = []
    for s, e, kind in decode(text, weights):
        if not any(s < b and a < e for a, b in taken):
            taken.append((s, e))
            extra.append((s, e, kind))
    return base, ordered(base + extra)


def fit(docs: DataFrame, documents: int = TRAIN_DOCUMENTS) -> np.ndarray:
    """Trains on at most ``documents`` texts with a digit or ``@``, chosen by hash."""
    usable = docs.select("doc_id", "text").where(F.col("text").rlike("[0-9@]") & (F.length("text") < TRAIN_LENGTH))
    sample = bounded_sample(usable, "doc_id", documents)
    return train([r.text for r in sample.collect()])


def find(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """Adds counts of the base kinds, and base and all spans as ``kind:start:end`` text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
        for batch in batches:
            both = [all_spans(t, weights) for t in texts_of(batch.column("text"))]
            counts = {
                f"n_{kind}": pa.array([sum(s[2] == kind for s in base) for base, _ in both], pa.int64()) for kind in KINDS
            }
            yield counts | {
                "base_spans": strings(written(base) for base, _ in both),
                "spans": strings(written(spans) for _, spans in both),
            }

    schema = ", ".join(f"n_{kind} bigint" for kind in KINDS) + ", base_spans string, spans string"
    return with_columns(docs, schema, run)
