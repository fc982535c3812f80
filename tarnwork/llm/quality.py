"""Quality rules: distribution divergence beside four counting rules, in DataFrame functions only.

*Counts.*  Characters in words, symbols, repeated lines, and words that stand in
an eight-word window found twice or more in the text.

*Divergence.*  The characters of a document, by class, and its common words are
compared with the sums over all documents of its language by Jensen-Shannon
distance (square root of the divergence in bits, 0 to 1).  Common words are a
fixed list for each language; a language without a list, or an unknown one, is
judged by its characters alone, against all documents of that ``lang`` value
(null is a value of its own).  A document with fewer than ``LEAST_WORDS`` words is
too small to have a distribution and is never rejected for it; for the others the
allowed distance of words is widened by what chance makes of a sample of their
length.  A document is part of its own reference, so in a small language it is
compared with what is partly itself, and a single one is never rejected.

Null and empty texts have no words and fail the base rule.  Nothing here looks
at more than one row but the sums, which have one row for each language.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.functions.once import let, with_once
from tarnwork.llm.common import without
from tarnwork.session import cut_lineage

WINDOW = 8
LEAST_WORDS = 40
MOST_CHARACTER_DISTANCE = 0.25
MOST_WORD_DISTANCE = 0.26

# Character classes.
CLASSES = {"lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "stop": "[.,;:!?'\"()-]", "symbol": "[#*$%&|<>=+/@_~^{}\\[\\]\\\\`]"}

# Common words of some languages.
COMMON_WORDS = {
    "en": "the of and to in is that for it was with on are be this by",
    "de": "der die und in den von zu das mit sich des auf für ist im dem",
    "fr": "de la le et les des en un du une que est pour qui dans sur",
    "es": "de la que el en y a los se del las un por con no una",
}

_SPACE = r"[\x20\x09-\x0D]"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{_SPACE}+"), "")


def _windows(words: Column) -> Column:
    """Hash of the window that starts at each word."""
    return let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda hashes: F.transform(
            F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW)))
        ),
    )


def _covered(windows: Column) -> Column:
    """How many words the windows cover that are found twice or more: the starts in order, each adding what is new."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(own: Column) -> Column:
        return F.filter(
            own,
            lambda x, k: (F.get(own, k - 1)["h"] == x["h"]) & (k > 0) | (F.get(own, k + 1)["h"] == x["h"]),
        )

    starts = F.sort_array(F.transform(let(pairs, lambda own: F.filter(repeated(own), lambda x: x.isNotNull())), lambda x: x["i"]))
    begin = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(
        starts,
        begin,
        lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"), i.alias("last")),
        lambda s: s["n"],
    ).cast("long")


def counted(docs: DataFrame) -> DataFrame:
    """Adds the base counts and the two histograms."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_counts", "word_counts"]
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = with_once(without(docs, [*names, "__words", "__windows"]), "__words", _words(text))
    words = F.col("__words")
    n = F.size(words)
    none = F.array().cast("array<bigint>")
    docs = with_once(docs, "__windows", F.when(n > WINDOW, _windows(words)).otherwise(none))
    windows = F.col("__windows")
    lines = let(
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        lambda own: F.size(own) - F.size(F.array_distinct(own)),
    )
    # Letters come in runs, which are cheaper to cut out than to count one by one.
    char_counts = [F.length(text) - F.length(F.regexp_replace(text, f"{p}+", "")) for p in CLASSES.values()]
    lists = F.create_map(*(x for k, v in COMMON_WORDS.items() for x in (F.lit(k), F.array(*(F.lit(w) for w in v.split())))))
    size = len(next(iter(COMMON_WORDS.values())).split())
    places = F.filter(F.transform(words, lambda w: F.array_position(F.col("__list"), F.lower(w))), lambda p: p > 0)
    word_counts = let(
        places,
        lambda own: F.transform(F.sequence(F.lit(1), F.lit(size)), lambda k: F.size(F.filter(own, lambda p: p == k))),
    )
    docs = docs.withColumn("__list", F.element_at(lists, F.col("lang")))
    return docs.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
            "n_dup_lines": lines.cast("long"),
            "n_repeat_words": F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(_covered(windows)),
            "char_counts": F.array(*(c.cast("double") for c in char_counts)),
            "word_counts": F.when(F.col("__list").isNotNull(), F.transform(word_counts, lambda c: c.cast("double"))),
        }
    ).drop("__words", "__windows", "__list")


def _with_rest(counts: Column, total: Column) -> Column:
    """A histogram as shares, what is in no bucket last."""
    known = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    every = F.concat(counts, F.array(F.greatest(total - known, F.lit(0.0))))
    return F.transform(every, lambda x: x / F.greatest(total, F.lit(1.0)))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    terms = F.zip_with(p, q, lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def references(counts: DataFrame) -> DataFrame:
    """One row for each language: sums of both histograms over its documents."""
    n_chars, n_words = len(CLASSES), len(next(iter(COMMON_WORDS.values())).split())

    def sums(column: str, n: int) -> Column:
        return F.array(*(F.coalesce(F.sum(F.get(column, F.lit(k))), F.lit(0.0)) for k in range(n)))

    return counts.groupBy("lang").agg(
        sums("char_counts", n_chars).alias("__chars"),
        sums("word_counts", n_words).alias("__words"),
        F.sum(F.col("__size").cast("double")).alias("__all_chars"),
        F.sum(F.col("n_words").cast("double")).alias("__all_words"),
    )


def judged(docs: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """Counts, ``char_distance``, ``word_distance`` (null where a guard holds), ``base_failed`` and ``kept``."""
    out = ["char_distance", "word_distance", "base_failed", "kept"]
    counts = counted(without(docs, [*out, "__size"])).withColumn("__size", F.coalesce(F.length("text"), F.lit(0))).drop("text")
    # The counts serve the references and the verdicts; they are a fraction of the text's size.
    counts = cut_lineage(counts)
    refs = references(counts) if refs is None else refs
    refs = refs.withColumnRenamed("lang", "__lang")
    # One row for each language; its size decides how it is joined.
    joined = counts.join(refs, F.col("lang").eqNullSafe(F.col("__lang")), "left")
    enough = F.col("n_words") >= LEAST_WORDS
    chars = distance(
        _with_rest(F.col("char_counts"), F.col("__size").cast("double")), _with_rest(F.col("__chars"), F.col("__all_chars"))
    )
    words = distance(
        _with_rest(F.col("word_counts"), F.col("n_words").cast("double")), _with_rest(F.col("__words"), F.col("__all_words"))
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    # A sample of n words is this far from its own distribution by chance.
    chance = len(next(iter(COMMON_WORDS.values())).split()) / (8 * math.log(2)) / F.greatest(F.col("n_words"), F.lit(1))
    most_words = F.sqrt(MOST_WORD_DISTANCE**2 + chance)
    return joined.withColumns(
        {
            "char_distance": F.when(enough, chars),
            "word_distance": F.when(enough & F.col("word_counts").isNotNull(), words),
            "base_failed": failed,
        }
    ).withColumn(
        "kept",
        ~F.col("base_failed")
        & (F.coalesce("char_distance", F.lit(0.0)) <= MOST_CHARACTER_DISTANCE)
        & (F.coalesce("word_distance", F.lit(0.0)) <= most_words),
    ).drop("__lang", "__chars", "__words", "__all_chars", "__all_words", "__size")
