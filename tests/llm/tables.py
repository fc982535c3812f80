"""Small tables with odd rows for the text queries."""

from __future__ import annotations

import random

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ", score double, kept boolean, ids string, labels string, `n_words` string, spans array<int>, text_key string, found int, place int"
KEY_LINE = 'token = "0641917ea4e9feb9cda83477b57ac2654884f485"'


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    order = random.Random(seed)
    return " ".join(f"{order.choice('bcdfglmnprst')}{order.choice('aeiou')}{order.randrange(vocabulary):x}".translate(str.maketrans("0123456789", "ghijklmnop")) for _ in range(words))


def odd_documents() -> list[tuple]:
    long_text = prose(1, 30_000)
    passage = prose(2, 60)
    texts = [
        None, "", " \t\n ", "one", "a b c", prose(3, 4), prose(4, 5), prose(5, 19), prose(6, 20), prose(7, 200),
        long_text, long_text, "x" * 70_000, "9" * 50_000, "a1" * 20_000, "é\U0001f600 İ K   \x1c \x85" * 50,
        prose(8, 50) + " " + passage + " " + prose(9, 50), passage + " " + prose(10, 80), prose(11, 30) + "\n" + passage,
        KEY_LINE, "mail a.b@c.example.org or +1 (375) 555-4393, 10.2.3.4", "Licensed under the Apache License, Version 2.0.",
        "you m0r0n", "s t u p i d", "null\x00byte", "<b>&amp;</b>",
    ]
    rows = [(k, t, ("en", "de", None)[k % 3], "src", len(t) if t else None) for k, t in enumerate(texts)]
    rows += [(100 + k, prose(20, 120), "en", "hot", 1) for k in range(40)]  # a hot group of copies
    rows += [(200 + k, prose(21, 120) + f" tail{k}", "en", "hot", 1) for k in range(20)]  # and of near copies
    rows += [(None, prose(20, 120), None, None, None), (None, None, None, None, None)]
    rows += [rows[9], rows[9], (10, "another text under a known id", "en", "src", 3)]
    return rows


def odd_vectors() -> list[tuple]:
    order = random.Random(5)
    vector = lambda: [order.gauss(0, 1) for _ in range(6)]
    rows = [(k, vector(), 1) for k in range(150)]
    rows += [(k, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], None) for k in range(200, 310)]  # copies under many ids
    rows += [(k, [1.0 + k * 1e-6, 2.0, 3.0, 4.0, 5.0, 6.0], None) for k in range(400, 460)]  # and near copies
    rows += [(500, None, 1), (501, [], 1), (502, [0.0] * 6, 1), (503, [float("nan")] * 6, 1), (504, [float("inf"), *[1.0] * 5], 1)]
    rows += [(550, [None, *[1.0] * 5], 1), (600, [1.0, 2.0], 1), (None, vector(), 1), (None, None, None)]
    return rows + [rows[50], rows[50], (100, vector(), 3), (650, [1e-30, 2e-30, 0.0, 0.0, 1e-30, 0.0], 3)]


def odd_conversations() -> list[tuple]:
    roles, ends = ("user", "assistant", "system", "tool", "", None), (".", "", "!", " \n", "?\t")
    order = random.Random(6)
    rows = [(c, t, order.choice(roles[: 2 + c % 5]), order.choice("abcd") + order.choice(ends)) for c in range(40) for t in range(order.randrange(9))]
    rows += [(50, t, ("user", "assistant")[t % 2], f"turn {t % 3000}.") for t in range(4000)]  # longer than a block
    rows += [(51, None, "user", "no turn."), (51, None, "assistant", "no turn."), (51, 3, "user", None), (51, 3, "user", None)]
    rows += [(None, 1, "user", "hello?"), (None, None, None, None), (52, 0, "user", "x" * 100_000 + "."), (53, 9, "user", "same.")]
    return rows + [(53, 9, "user", "same.")] * 3000 + [(53, 10, "assistant", "and \u00e9\U0001f600.")]


def write(spark: SparkSession, folder, rows: list[tuple], pages: list[tuple], extra: bool = False) -> str:
    docs = spark.createDataFrame(rows, DOCUMENTS)
    if extra:
        docs = docs.withColumns(
            {
                name: F.lit(None).cast(kind)
                for name, kind in {
                    "score": "double", "kept": "boolean", "ids": "string", "N_WORDS": "string", "spans": "array<int>",
                    "labels": "string", "n_tokens": "string", "found": "int", "component_id": "string", "base_spans": "int",
                }.items()
            }
        )
    ids = sorted({r[0] for r in rows if r[0] is not None})
    labels = [(i, 1, int(i % 4 == 0)) for i in ids if i % 3 == 0] + [(None, None, 1), (9, None, None)][: len(rows)]
    items = [(0, prose(2, 60)), (1, "too short"), (2, None), (None, prose(30, 40))][: len(rows)]
    vectors, talk = odd_vectors(), odd_conversations()
    if not rows:
        vectors, talk = [], []
    vectors = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    talk = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    if extra:
        for name in ("score", "rank", "n", "component", "whitened", "asked", "vector"):
            vectors = vectors.withColumn(name, F.lit("x"))
        for name in ("cost", "audit", "copies", "digest", "conv", "n", "first"):
            talk = talk.withColumn(name, F.lit("x"))
    vectors.write.parquet(f"{folder}/embeddings.parquet")
    talk.write.parquet(f"{folder}/conversations.parquet")
    docs.coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)
