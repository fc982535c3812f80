"""Toxicity: a noisy-channel reading of disguised words, then a linear score of the restored text.

*Channel.*  Suspicious tokens (digits or marks among letters, letters repeated
three times and more, letters set apart one by one) become lattices: every
character offers the letters it may stand for, and a separator or a repeated
letter may vanish.  Viterbi decoding picks the path that is likeliest under a
character trigram model and the channel's costs, over the whole token however
long.  Where a token has separators a word may end: its parts are read one by
one; letters set apart are also read as a phrase, and any of them may be the
beginning of a word.  The trigrams are counted over
all texts of the corpus; the alphabet is fixed (``LETTERS``), so the model has
at most ``len(LETTERS) ** 3`` numbers however large the corpus is.

*Score.*  Words and word beginnings of the restored text are the features of a
logistic regression.  It is fitted on at most ``TRAIN_PER_CLASS`` labelled texts
of each class whose id is in the training folds, taken by the hash of the id.

Null and empty texts get the score of a text without features.  Nothing but the
text enters a score.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.common import bounded_sample, longs, strings, texts_of, with_columns

LETTERS = " abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
SIZE = len(LETTERS)
_CODE = {c: k for k, c in enumerate(LETTERS)}

# Letters that digits and marks are used for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "*": "aeiou", "#": "aeiou",
}
SWAP_COST = 0.5
DROP_COST = {c: 1.0 if c in "!+*#" else 6.0 for c in STANDS_FOR}
KEEP_REPEAT_COST = 2.0

_MARKS = re.escape("".join(STANDS_FOR))
_HAS_MARK = re.compile(f"[{_MARKS}]")
_LETTER = re.compile(r"[^\W\d_]")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_APART = re.compile(rf"(?<!\w)[^\W_](?:[ ._*\-](?:[^\W_]|[{_MARKS}])){{3,}}(?!\w)")
_WORD = re.compile(r"[^\W\d_]+")
_SEPARATOR = re.compile(rf"(?:[^\w{_MARKS}]|_)+")

PREFIXES = (4, 5, 6, 7, 8)
TRAIN_PER_CLASS = 5000
KNOWN_TOKENS = 100_000
LEAST_TEXTS = 5
LEAST_LEAN = 3.0
STRONGEST = 8
MOST_FEATURES = 50_000
EPOCHS = 10


# The character model

_FOLD = np.zeros(0x10000, np.int64)
for _c in range(0x10000):
    if not 0xD800 <= _c < 0xE000:
        _FOLD[_c] = _CODE.get(chr(_c).lower(), 0)


def folded(texts: list[str]) -> np.ndarray:
    """Letter codes of texts one behind the other, two blanks after each."""
    raw = np.frombuffer("  ".join([*texts, ""]).encode("utf-32-le"), np.uint32)
    return _FOLD[np.where(raw < 0x10000, raw, 0)]


def character_counts(docs: DataFrame) -> DataFrame:
    """(trigram, n) over all texts; every task adds up its own texts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            codes = folded(texts_of(batch.column(0)))
            if len(codes) > 2:
                total += np.bincount((codes[:-2] * SIZE + codes[1:-1]) * SIZE + codes[2:], minlength=SIZE**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([longs(seen), longs(total[seen])], names=["trigram", "n"])

    parts = docs.select("text").mapInArrow(run, "trigram long, n long")
    return parts.groupBy("trigram").agg(F.sum("n").alias("n"))


def language_model(counts: DataFrame) -> np.ndarray:
    """log P(c | a, b) as a table; trigrams blended with bigrams and single letters."""
    table = np.zeros(SIZE**3)
    for row in counts.collect():  # at most SIZE ** 3 rows
        table[row.trigram] = row.n
    three = table.reshape(SIZE, SIZE, SIZE)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + SIZE)
    p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
    p3 = (three + 5 * p2[None]) / (three.sum(axis=2, keepdims=True) + 5)
    return np.log(p3).astype(np.float32)


# The channel


def _offers(token: str, blanks: bool = False) -> Iterator[list[tuple[str, float]]]:
    """For each character of a token what it may stand for, with costs; an empty string: it vanishes.

    With ``blanks`` a separator may also stand for the end of a word.
    """
    last = ""
    for c in token:
        if c in STANDS_FOR:
            options = [(x, SWAP_COST) for x in STANDS_FOR[c]] + [("", DROP_COST[c])]
            if blanks and DROP_COST[c] <= 1.0:
                options.append((" ", DROP_COST[c]))
        elif c in _CODE and c != " ":
            options = [(c, KEEP_REPEAT_COST if c == last else 0.0)]
            if c == last:
                options.append(("", 0.0))
        else:
            options = [("", 0.0 if c in " ._-" else 1.0)]
            if blanks:
                options.append((" ", options[0][1]))
        yield options
        last = c


def _spelled(path: tuple | None) -> str:
    letters = []
    while path:
        path, letter = path
        letters.append(letter)
    return "".join(reversed(letters))


def restore(token: str, model: np.ndarray, blanks: bool = False) -> str:
    """The likeliest word behind a token, or words with a blank between them, by Viterbi decoding over (last two letters)."""
    beams: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for options in _offers(token, blanks):
        following: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, path) in beams.items():
            for letter, own in options:
                if letter:
                    c = _CODE[letter]
                    if not c and not b:
                        continue
                    state, total, longer = (b, c), cost + own - float(model[a, b, c]), (path, letter)
                else:
                    state, total, longer = (a, b), cost + own, path
                if state not in following or total < following[state][0]:
                    following[state] = (total, longer)
        beams = following
    ends = [(cost - (float(model[a, b, 0]) if b else 0.0) if blanks else cost - float(model[a, b, 0]), path) for (a, b), (cost, path) in beams.items()]
    least = min(cost for cost, _ in ends)
    return min(_spelled(path) for cost, path in ends if cost == least)


def _disguised(token: str) -> bool:
    """Marks among letters, a letter three times in turn, or letters set apart."""
    if _HAS_MARK.search(token) and _LETTER.search(token):
        return True
    return bool(_TRIPLE.search(token) or _APART.search(token))


class Restorer:
    """Tokens as they read after decoding; ``model`` holds log P(c | a, b)."""

    def __init__(self, model: np.ndarray):
        self.model = model

    def decoded(self, token: str) -> list[str]:
        """The token read as one word, its parts, and where letters are set apart a phrase and what each may begin."""
        words = [restore(token, self.model)]
        if _APART.search(token):
            words += restore(token, self.model, blanks=True).split()
            words += [words[0][k : k + PREFIXES[-1]] for k in range(1, len(words[0]) - PREFIXES[0] + 1)]
        words += [restore(p, self.model) if _disguised(p) else p for p in _SEPARATOR.split(token) if 1 < len(p) < len(token)]
        return [w for w in dict.fromkeys(words) if w]

    def tokens(self, text: str) -> set[str]:
        """Distinct tokens of a text: chunks between white space, and runs of letters set apart by blanks."""
        low = text.lower()
        chunks = low.split()
        found = set(chunks)
        if sum(map((1).__eq__, map(len, chunks))) >= 4:
            for run in _APART.finditer(low):
                # A word of one letter may stand before or behind the word that is set apart.
                found.update((run.group(), run.group()[2:], run.group()[:-2], run.group()[2:-2]))
        return found

    def words(self, token: str) -> list[str]:
        """Words of a token, and what it reads as if it is disguised."""
        words = _WORD.findall(token)
        return words + self.decoded(token) if _disguised(token) else words

    def text(self, text: str) -> str:
        """The text in lower case with disguised tokens as decoded."""
        read = lambda m: restore(m.group(), self.model, blanks=True).strip()
        low = _APART.sub(read, text.lower())
        return re.sub(r"\S+", lambda m: read(m) if _disguised(m.group()) else m.group(), low)


# The score


def features_of(word: str) -> list[str]:
    return [word + "$", *(word[:n] for n in PREFIXES if len(word) >= n)]


@dataclass
class Scorer:
    model: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0

    def __post_init__(self) -> None:
        self.restorer = Restorer(self.model)
        self.known: dict[str, tuple[str, ...]] = {}

    def __getstate__(self) -> dict:
        return {"model": self.model, "weights": self.weights, "bias": self.bias}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def features(self, token: str) -> tuple[str, ...]:
        if len(self.known) >= KNOWN_TOKENS:
            self.known.clear()
        found = {f for w in self.restorer.words(token) for f in features_of(w) if f in self.weights}
        own = self.known[token] = tuple(sorted(found))
        return own

    def present(self, text: str) -> set[str]:
        known, present = self.known.get, set()
        for token in self.restorer.tokens(text):
            own = known(token)
            present.update(self.features(token) if own is None else own)
        return present

    def score(self, text: str) -> float:
        strongest = heapq.nlargest(STRONGEST, (self.weights[f] for f in self.present(text)))
        total = self.bias + math.fsum(strongest)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, total))))


def telling_features(sample: DataFrame, model: np.ndarray) -> list[str]:
    """Features that lean clearly towards toxic texts, counted by the tasks that hold the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for batch in batches:
            sides = (Counter(), Counter())
            for text, label in zip(texts_of(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
                sides[label].update({f for t in restorer.tokens(text) for w in restorer.words(t) for f in features_of(w)})
            for label, counts in enumerate(sides):
                yield pa.RecordBatch.from_arrays(
                    [strings(counts.keys()), pa.array([label] * len(counts), pa.int64()), longs(list(counts.values()))],
                    names=["feature", "toxic", "n"],
                )

    bad, good = (F.sum(F.when(F.col("toxic") == c, F.col("n")).otherwise(0)) for c in (1, 0))
    counts = sample.mapInArrow(run, "feature string, toxic long, n long").groupBy("feature").agg(bad.alias("bad"), good.alias("good"))
    size = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    p, q = F.col("bad") + 0.5, F.col("good") + 0.5
    lean = (F.log(p / (size.get(1, 0) + 1)) - F.log(q / (size.get(0, 0) + 1))) / F.sqrt(1 / p + 1 / q)
    chosen = counts.where(F.col("bad") >= LEAST_TEXTS).withColumn("lean", lean).where(F.col("lean") > LEAST_LEAN)
    top = chosen.orderBy(F.desc("lean"), "feature").limit(MOST_FEATURES).collect()
    return sorted(r.feature for r in top)


def strongest(found: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A long text has many features by chance; only its strongest ones count."""
    if len(found) <= STRONGEST:
        return found
    return found[np.argsort(-weights[found], kind="stable")[:STRONGEST]]


def train(sample: DataFrame, model: np.ndarray) -> Scorer:
    """Logistic regression on the presence of telling features; ``sample`` has text and toxic (0 or 1)."""
    chosen = telling_features(sample, model)
    blank = Scorer(model, dict.fromkeys(chosen, 0.0))
    index = {f: k for k, f in enumerate(chosen)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(index[f] for f in blank.present(t)) for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.list_(pa.int32())), batch.column("toxic")], names=["found", "toxic"]
            )

    examples = sample.mapInArrow(run, "found array<int>, toxic int").collect()
    examples.sort(key=lambda r: (r.toxic, r.found))  # the same order on every run
    rows = [np.array(r.found, np.int64) for r in examples]
    labels = [int(r.toxic) for r in examples]
    weights, squares = np.zeros(len(chosen)), np.full(len(chosen), 0.1)
    bias, bias_squares = -1.0, 0.1
    order = np.random.default_rng(5)
    for epoch in range(EPOCHS):
        for k in order.permutation(len(rows)):
            at = strongest(rows[k], weights) if epoch >= EPOCHS // 3 else rows[k]
            z = bias + weights[at].sum()
            error = 1 / (1 + math.exp(-max(-40.0, min(40.0, z)))) - labels[k]
            bias_squares += error * error
            bias -= 0.3 * error / math.sqrt(bias_squares)
            gradient = error + 1e-4 * weights[at]
            squares[at] += gradient**2
            weights[at] = np.maximum(weights[at] - 0.3 * gradient / np.sqrt(squares[at]), 0.0)
    bias -= _cut(np.array([bias + weights[strongest(at, weights)].sum() for at in rows]), np.array(labels))
    return Scorer(model, dict(zip(chosen, weights.tolist(), strict=True)), bias)


def _cut(totals: np.ndarray, labels: np.ndarray) -> float:
    """The value between the classes with the fewest errors; the middle of the range where that holds."""
    if not len(totals):
        return 0.0
    values, at = np.unique(totals, return_inverse=True)
    sides = np.bincount(at, labels * 2.0 - 1, len(values))  # toxic less other texts at each value
    gain = np.concatenate(([0.0], np.cumsum(-sides)))  # of calling everything up to a value clean
    best = np.flatnonzero(gain == gain.max())
    low = values[max(best[0] - 1, 0)]
    high = values[min(best[0], len(values) - 1)]
    return float((low + high) / 2) if low < high else 0.0


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo five."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> Scorer:
    """The character model from all texts, the score from a bounded sample of the training folds."""
    model = language_model(character_counts(docs))
    usable = (
        labels.select("doc_id", "toxic").where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
        .dropDuplicates(["doc_id", "toxic"])
    )
    parts = [bounded_sample(usable.where(F.col("toxic") == c), "doc_id", per_class) for c in (0, 1)]
    sample = parts[0].unionByName(parts[1])
    # At most 2 * per_class rows, so the broadcast has a bound.
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    return train(rows.select("text", F.col("toxic").cast("int").alias("toxic")), model)


def score(docs: DataFrame, scorer: Scorer, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the score of each text, from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
        own = shared.value
        for batch in batches:
            yield {out: pa.array([own.score(t) for t in texts_of(batch.column(text))], pa.float64())}
        own.known.clear()  # the worker keeps the scorer for its next tasks, and perhaps another one beside it

    return with_columns(docs, f"`{out}` double", run)
