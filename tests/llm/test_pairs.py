"""Repeats, near-duplicates and test items against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from tarnwork.llm import decontaminate, neardup, repeats
from tarnwork.llm.common import prepare
from tarnwork.llm.components import connected
from tarnwork.llm.fmindex import FMIndex
from tarnwork.llm.queries import QUERIES
from tests.llm.tables import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts):
    return prepare(spark).createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)


def mixed_texts(seed):
    """Texts of shared passages, copies, edits, runs of one word and short ones."""
    order = random.Random(seed)
    passages = [prose(seed * 100 + k, order.choice((10, 19, 20, 21, 45, 90))) for k in range(6)]
    texts = {}
    for k in range(60):
        parts = [order.choice([order.choice(passages), prose(order.random(), order.randrange(1, 50)), "aa " * order.randrange(1, 60)]) for _ in range(order.randrange(1, 6))]
        texts[k] = order.choice([" ", "\n"]).join(parts)
    texts |= {60 + k: texts[order.randrange(60)] for k in range(25)}
    words = texts[3].split()
    for k in range(10):
        words[order.randrange(len(words))] = f"edit{k}"
        texts[100 + k] = " ".join(words)
    return texts


def plain_repeats(texts, window=20):
    seen, out = set(), {}
    for doc in sorted(texts):
        words = WORD.findall(texts[doc] or "")
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            own = tuple(words[k : k + window])
            if own in seen:
                gone[k : k + window] = [True] * window
            seen.add(own)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out[doc] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats(spark, seed):
    texts = mixed_texts(seed)
    rows = repeats.without_repeats(frame(spark, texts)).collect()
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in rows}
    assert got == plain_repeats(texts)


def test_repeats_in_many_small_indexes(spark, monkeypatch):
    monkeypatch.setattr(repeats, "WORDS_PER_INDEX", 50)
    monkeypatch.setattr(repeats, "WORDS_PER_PART", 100)
    texts = mixed_texts(4)
    segments = repeats.Cutter().cut  # long documents are cut into parts with common words
    assert segments is not None
    rows = repeats.without_repeats(frame(spark, texts)).collect()
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in rows}
    assert got == plain_repeats(texts)


def test_hot_minimizers_do_not_make_large_indexes(spark, monkeypatch):
    passage = prose(1, 45)
    texts = {k: f"{prose(f'a{k}', 30)} {passage} {prose(f'b{k}', 30)}" for k in range(80)}
    texts[100] = texts[7]
    docs = frame(spark, texts)
    most = 500
    monkeypatch.setattr(repeats, "WORDS_PER_INDEX", most)
    path = repeats.scratch_path(spark, "test-segments")
    repeats.sifted(docs, 20, 6).write.parquet(path)
    wanted = spark.read.parquet(path).where("minimizer is not null")

    def largest(rows):
        sizes = {}
        for r in rows.where("words is not null").collect():
            sizes[r.minimizer] = sizes.get(r.minimizer, 0) + len(r.words) // 8
        return max(sizes.values(), default=0)

    assert largest(repeats.spelled(repeats.packed(docs), wanted, 20)) > most
    assert largest(repeats.shards(repeats.packed(docs), wanted, 20)) <= most
    rows = repeats.without_repeats(docs).collect()
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in rows}
    assert got == plain_repeats(texts)


def test_single_windows_do_not_depend_on_batches():
    import pyarrow as pa

    order = random.Random(8)
    rows = sorted((order.choice((1, 1, 1, 2)), order.randrange(12), k, order.randrange(5)) for k in range(200))
    table = pa.table([pa.array(c, pa.int32() if k == 0 else pa.int64()) for k, c in enumerate(zip(*rows))], names=["kind", "minimizer", "doc", "start"])
    table = table.append_column("words", pa.nulls(len(rows), pa.binary()))
    firsts = {}
    for kind, mini, doc, _ in rows:
        if kind == repeats.SINGLE:
            firsts.setdefault(mini, doc)
    want = {doc for _, _, doc, _ in rows} - set(firsts.values())
    for size in (1, 2, 3, 7, 1000):
        found = [r["doc"] for b in repeats._searched(iter(table.to_batches(max_chunksize=size)), 20) for r in b.to_pylist()]
        assert sorted(found) == sorted(want)


def test_sifting_does_not_depend_on_batches():
    import pyarrow as pa

    order = random.Random(6)
    rows = sorted((order.randrange(30), order.randrange(3), order.randrange(5), order.randrange(4) << 6 | 3) for _ in range(300))
    table = pa.table(dict(zip(("minimizer", "content", "doc", "place"), map(list, zip(*rows)))))

    def run(size):
        out = pa.Table.from_batches(list(repeats._sifted(iter(table.to_batches(max_chunksize=size)))))
        return sorted(map(str, out.to_pylist()))

    whole = run(1000)
    assert all(run(size) == whole for size in (1, 2, 3, 7, 50))


def test_index_finds_every_window():
    order = np.random.default_rng(7)
    for alphabet in (2, 5, 300):
        parts = [order.integers(1, alphabet + 1, n) for n in (30, 4, 50, 7, 64)]
        text = np.concatenate([np.append(p, 0) for p in parts])
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        index = FMIndex(text, 4)
        seen = {}
        for k in range(len(text) - 3):
            if (text[k : k + 4] > 0).all():
                seen.setdefault(tuple(text[k : k + 4]), []).append(k)
        found = {}
        for _, place, low, high in index.matching_statistics(text, ends, np.array([len(p) for p in parts])):
            for p, a, b in zip(place, low, high):
                found[int(p)] = sorted(index.suffixes[a:b].tolist())
        assert found == {k: v for v in seen.values() for k in v}


def plain_components(texts):
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    sets = {}
    for doc, text in texts.items():
        words = (text or "").encode().translate(lower).split()
        sets[doc] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
    top = {d: d for d in texts}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    docs = sorted(texts)
    for k, a in enumerate(docs):
        for b in docs[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {d: (len(sets[d]), find(d)) for d in docs}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    texts = mixed_texts(seed) | {200: "one two", 201: "One  TWO", 202: "one two three", 203: None, 204: ""}
    texts |= {300 + k: " ".join(prose(9, 12).split()[: 8 + k % 4]) for k in range(8)}  # sets of a few shingles
    rows = neardup.near_duplicates(frame(spark, texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == plain_components(texts)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_small_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 3)
    texts = mixed_texts(5)
    rows = neardup.near_duplicates(frame(spark, texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == plain_components(texts)


def test_chain_of_near_duplicates_and_unlinked_bucket_members(spark):
    words = prose(12, 400).split()
    texts = {}
    for k in range(30):  # each is close to the next one only
        words[k * 12 : k * 12 + 9] = [f"w{k}x{i}" for i in range(9)]
        texts[k] = " ".join(words)
    rows = neardup.near_duplicates(frame(spark, texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == plain_components(texts)


def test_estimate_follows_similarity():
    order = np.random.default_rng(3)
    factors = neardup.multipliers(1024)
    for share in (0.2, 0.5, 0.75, 0.95):
        common = int(2000 * share / (1 + share))
        pool = order.integers(0, 2**63, 2000, dtype=np.uint64)
        a, b = pool[: 1000], pool[1000 - common : 2000 - common]
        guess = neardup.estimate(neardup.registers(a, factors), neardup.registers(b, factors), len(a), len(b))
        true = common / (2000 - common)
        assert abs(guess - true) < 0.07, (share, guess, true)


def test_components(spark):
    order = random.Random(8)
    links = [(order.randrange(300), order.randrange(300)) for _ in range(220)] + [(0, 0)] + [(400 + k, 401 + k) for k in range(50)]
    links += [(500, 500 + k) for k in range(1, 200)]  # a hot node
    top = {n: n for n in {x for l in links for x in l}}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    rows = connected(spark.createDataFrame(links, "u long, v long")).collect()
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert {r.node: r.component for r in rows} == {n: find(n) for n in linked}
    assert len(rows) == len(linked)


def test_tiles_are_greedy_and_disjoint():
    item, text = np.arange(20), np.array([*range(10, 20), 99, *range(10), 10, 11, 12, 13, 14, 15, 16])
    pairs = [(a, b) for a in range(16) for b in range(len(text) - 4) if (item[a : a + 5] == text[b : b + 5]).all()]
    found = decontaminate.tiles(item, text, pairs, 5)
    assert found == [(0, 11, 17)] or sum(n for _, _, n in found) <= 20
    covered = [k for a, _, n in found for k in range(a, a + n)]
    assert len(covered) == len(set(covered)) and max(n for _, _, n in found) == 17


def test_decontamination(spark):
    passage = prose(2, 60).split()
    texts = {
        1: prose(3, 100) + " " + " ".join(passage) + " " + prose(4, 100),
        2: " ".join(passage[30:] + prose(5, 20).split() + passage[:30]).upper(),  # two halves the other way round
        3: " ".join(passage[:12]) + " " + prose(6, 80),  # a fifth of it
        4: prose(7, 200),
        5: "",
        6: None,
    }
    items = spark.createDataFrame([(7, " ".join(passage)), (8, prose(8, 40)), (9, "too short")], "item_id long, text string")
    docs = frame(spark, texts)
    rows = {(r.doc_id, r.item_id): r for r in decontaminate.coverage(docs, items).collect()}
    assert set(rows) == {(1, 7), (2, 7), (3, 7)}
    assert rows[1, 7].coverage == 1.0 and rows[1, 7].n_tiles == 1
    assert rows[2, 7].coverage == 1.0 and rows[2, 7].n_tiles == 2
    assert rows[3, 7].n_covered == 12
    assert {r.doc_id for r in decontaminate.contaminated(docs, items).collect()} == {1, 2}
    for size in (1, 2, 100):
        assert {r.doc_id for r in decontaminate.clean(docs, items, items_per_pass=size).collect()} == {3, 4, 5, 6}


def test_coverage_on_whole_table(spark, sf):
    """Every item that stands in a text whole is found, and nothing far from that."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    norm = lambda t: " " + b" ".join(decontaminate.words_of((t or "").encode())).decode() + " "
    texts = {d.doc_id: norm(d.text) for d in docs}
    whole = {(d, i.item_id) for i in items for d, t in texts.items() if norm(i.text) in t}
    found = {(r.doc_id, r.item_id) for r in QUERIES["op4_decontaminate"](spark, sf).collect()}
    assert whole <= found
    grams = {i.item_id: norm(i.text).split() for i in items}
    for d, i in found - whole:
        own = grams[i]
        shared = sum(f" {' '.join(own[k : k + 5])} " in texts[d] for k in range(len(own) - 4))
        assert shared >= 0.3 * len(own)


def test_queries_on_whole_tables(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op1_repeats"](spark, sf).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == plain_repeats(texts)
    rows = QUERIES["op6_neardup"](spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == plain_components(texts)


def test_another_text_under_a_known_id_is_judged_by_itself(spark):
    """Rows are known by id and text: neither operator loses the second text of id 10 with its first."""
    p, q = prose(70, 60), prose(71, 60)
    rows = [(3, p), (10, p), (10, q), (10, q), (None, q)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(map(tuple, neardup.representatives(docs).collect()), key=str)
    assert kept == sorted([(3, p), (10, q), (None, q)], key=str)
    got = sorted((tuple(r) for r in repeats.without_repeats(docs).select("doc_id", "n_words", "n_removed", "kept").collect()), key=str)
    assert got == sorted([(3, 60, 0, p), (10, 60, 60, ""), (10, 60, 0, q), (10, 60, 0, q), (None, 60, 0, q)], key=str)


def greedy_by_all_matches(item, text, shortest):
    """Mark the longest match of words that are not marked yet, again and again; of equal ones the first."""
    in_item, in_text, found = [False] * len(item), [False] * len(text), []
    while True:
        best = (0, 0, 0)
        for a in range(len(item)):
            for b in range(len(text)):
                n = 0
                while a + n < len(item) and b + n < len(text) and item[a + n] == text[b + n] and not in_item[a + n] and not in_text[b + n]:
                    n += 1
                if n >= shortest and (-n, a, b) < best:
                    best = (-n, a, b)
        if not best[0]:
            return sorted(found)
        n, a, b = -best[0], best[1], best[2]
        in_item[a : a + n] = [True] * n
        in_text[b : b + n] = [True] * n
        found.append((a, b, n))


@pytest.mark.parametrize("seed", range(60))
def test_tiles_equal_a_greedy_search_over_all_matches(seed):
    order = random.Random(seed)
    letters = order.choice((2, 3, 6))
    item, text = (np.array([order.randrange(letters) for _ in range(order.randrange(1, 40))]) for _ in range(2))
    shortest = order.choice((2, 3, 5))
    pairs = [
        (a, b) for a in range(len(item) - shortest + 1) for b in range(len(text) - shortest + 1)
        if (item[a : a + shortest] == text[b : b + shortest]).all()
    ]
    order.shuffle(pairs)
    assert decontaminate.tiles(item, text, pairs, shortest) == greedy_by_all_matches(item.tolist(), text.tolist(), shortest)
