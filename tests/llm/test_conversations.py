"""Repair of conversations against a search over all edit lists and a plain dynamic program."""

import hashlib
import heapq
import random
import zlib

import pytest

from tarnwork.llm import conversations as c
from tests.llm import tables

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def after_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(name.encode()) % 20
        text = "" if fate == 1 else "".join(x for x in text if x not in ".!?") if fate == 2 else text
        role = "user" if fate == 4 else role
        mine += [(turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    digest = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r))) for k, v in out.items()}


def fault_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        solid = text.strip(WHITE)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


STEPS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows):
    """Least (cost, audit) by a search that always goes on with the least list of edits, over every edit the rules allow."""
    faults = fault_of(rows)
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, at, state, lines = heapq.heappop(queue)
        if at == len(rows) + 1:
            return cost, audit, "\n".join(lines)
        if (at, state) in done:
            continue
        if at < len(rows):
            done.add((at, state))
        if at == len(rows) and state in ("", "a"):
            heapq.heappush(queue, (cost, audit, at + 1, state, lines))
        for name in ("user", "assistant"):
            to = STEPS.get((state, name[0]))
            if to:
                if audit[-3:] != "III":
                    heapq.heappush(queue, (cost + 5, audit + "I", at, to, (*lines, name + ":")))
                if at < len(rows) and faults[at] not in ("blank", "duplicate"):
                    extra = 5 if faults[at] else 0
                    heapq.heappush(queue, (cost + 1 + extra, audit + "R", at + 1, to, (*lines, f"{name}:{rows[at][2]}")))
        if at < len(rows):
            heapq.heappush(queue, (cost + 2, audit + "D", at + 1, state, lines))
            to = STEPS.get((state, rows[at][1][:1]))
            if to and faults[at] not in ("blank", "duplicate"):
                heapq.heappush(queue, (cost + (5 if faults[at] else 0), audit + "K", at + 1, to, (*lines, f"{rows[at][1]}:{rows[at][2]}")))
    raise AssertionError


def expected(rows):
    out = []
    for conv, mine in after_damage(rows).items():
        faults = fault_of(mine)
        cost, audit, text = cheapest(mine)
        turns = {r[0] for r in mine if r[0] is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(mine, mine[1:])]
        out.append((
            conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def random_rows(seed, conversations, longest=9):
    order = random.Random(seed)
    roles = ("user", "assistant", "system", "tool", "", None)
    return [
        (k, order.randrange(12) if order.random() < 0.9 else None, order.choices(roles, (6, 6, 2, 1, 1, 1))[0], order.choice("abcdefgh") + order.choice((".", ".", "", "!\n")))
        for k in range(conversations) for _ in range(order.randrange(longest))
    ]


@pytest.mark.parametrize("seed", range(3))
def test_repair_equals_a_search_over_all_edits(spark, seed):
    rows = random_rows(seed, 150)
    assert sorted(map(tuple, c.repaired(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == expected(rows)


def test_odd_rows_and_conversations_longer_than_blocks(spark):
    rows = tables.odd_conversations()
    frame = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, c.repaired(frame.repartition(7)).collect()), key=str)
    assert got == expected(rows)
    assert c.repaired(frame.limit(0)).count() == 0


def test_conversation_without_rows_after_damage(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    row = c.repaired(spark.createDataFrame([(gone, 0, "user", "x.")], SCHEMA)).collect()
    assert [tuple(r) for r in row] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def plain(sequence):
    return c.Evaluator([]).products(list(sequence))[-1]


@pytest.mark.parametrize("seed", range(20))
def test_any_grammar_gives_the_matrices_of_the_plain_sequence(seed):
    order = random.Random(seed)
    texts = [bytes(order.choices(range(9), (3, 1, 6, 6, 1, 1, 1, 1, 1), k=order.randrange(1, 40))) for _ in range(30)]
    texts += [bytes([0]) * 37, bytes([2, 3]) * 20, bytes([2, 2, 2])]
    rounds, made = [], 0
    for _ in range(8):
        counts = c.pair_counts(texts, [1] * len(texts), rounds)
        rules = c.chosen([(a, b, n) for (a, b), n in sorted(counts.items(), key=lambda x: (-x[1], x[0])) if n > 1], c.TERMINALS + made, 5)
        made += len(rules)
        rounds += [rules] if rules else []
    own = c.Evaluator(rounds)

    def expand(s):
        return bytes([s]) if s < c.TERMINALS else expand(own.parts[s][0]) + expand(own.parts[s][1])

    for text, symbols in zip(texts, c.compressed(texts, rounds), strict=True):
        assert b"".join(map(expand, symbols.tolist())) == text
        got, want = own.products(symbols.tolist())[-1], plain(text)
        assert got.cost == want.cost and got.rank == want.rank
        for i in range(4):
            for j in range(4):
                if want.cost[i][j] < c.NEVER:
                    assert own.audit(symbols.tolist(), i, j) == c.Evaluator([]).audit(list(text), i, j)
    assert sum(map(len, c.compressed(texts, rounds))) < 0.7 * sum(map(len, texts))


def test_pairs_in_runs_do_not_overlap():
    import numpy as np

    assert c.replaced(np.array([5, 5, 5, 5, 5, -1, 5, 5]), [(5, 5, 9)]).tolist() == [9, 9, 5, -1, 9]
    assert c.pair_counts([bytes([5] * 5)], [3], []) == {(5, 5): 6}
