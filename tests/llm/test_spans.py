"""Personal data and secrets: base patterns against plain regular expressions, and what the models add."""

import hashlib
import random
import re

import numpy as np
import pytest

from tarnwork.llm import pii, secrets
from tarnwork.llm.queries import QUERIES
from tests.llm.tables import prose

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def luhn(digits):
    total = 0
    for k, c in enumerate(digits[::-1]):
        d = int(c) * (1 + k % 2)
        total += d // 10 + d % 10
    return total % 10 == 0


def plain_pii(text):
    found = [(*m.span(), "email") for m in EMAIL.finditer(text)]
    found += [(*m.span(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((*m.span(), "card"))
    found += [(*m.span(), "phone") for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def plain_secrets(text):
    found = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(*m.span(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(*m.span(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[0], secrets.KINDS.index(s[2])))


def noise(pieces, n, seed):
    order = random.Random(seed)
    return ["".join(order.choice(pieces) for _ in range(order.randrange(1, 40))) for _ in range(n)]


def test_base_pii_equals_plain_patterns():
    texts = noise([*"0123456789" * 3, *"..@@++-- ()", "a", "_", "%", "é", "12.3", "4111 1111 1111 1111"], 20_000, 1)
    assert [t for t in texts if pii.base_spans(t) != plain_pii(t)] == []


def test_base_secrets_equals_plain_patterns():
    pieces = ["password", "PassWd", "secret", "token", "api_key", "apikey", "=", ":", " ", '"', "'", "abc123", "AKIA", "ABCD1234EFGH5678", "0f" * 6, "K", "ſecret", "="]
    texts = noise(pieces, 20_000, 2)
    assert [t for t in texts if secrets.base_spans(t) != plain_secrets(t)] == []


@pytest.mark.parametrize("name, plain, written", [("op3_pii", plain_pii, pii.written), ("op8_secrets", plain_secrets, secrets.written)])
def test_queries_on_whole_tables(spark, sf, name, plain, written):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES[name](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(written(base).encode()).hexdigest()
        assert set(filter(None, written(base).split(","))) <= set(r.spans.split(","))
        assert [r[f"n_{k}"] for k in (pii.KINDS if name == "op3_pii" else secrets.KINDS)] == [
            sum(s[2] == k for s in base) for k in (pii.KINDS if name == "op3_pii" else secrets.KINDS)
        ]


def samples(n, seed):
    order = random.Random(seed)
    digits = lambda k: "".join(order.choice("0123456789") for _ in range(k))
    made = [
        lambda: f"{order.choice(['ann', 'bo', 'cy'])}.{digits(2)}@mail{digits(1)}.example.com",
        lambda: ".".join(str(order.randrange(256)) for _ in range(4)),
        lambda: f"+1 ({digits(3)}) 555-{digits(4)}",
        lambda: f"version {digits(1)}.{digits(1)}",
        lambda: f"in {digits(4)}",
    ]
    return [" and ".join(order.choice(made)() for _ in range(4)) for _ in range(n)]


def test_field_learns_spans_and_sums_to_one():
    weights = pii.train(samples(150, 3))
    hit = total = wrong = 0
    for text in samples(60, 4):
        base, found = set(pii.base_spans(text)), set(pii.decode(text, weights))
        hit, total, wrong = hit + len(base & found), total + len(base), wrong + len(found - base)
    assert hit >= 0.9 * total and wrong <= 0.1 * total
    # All segmentations of a short zone, one by one, against the recursion.
    text = "a@b.co 12345678"
    toks = pii.tokens(text, 0, len(text))
    places, rows = pii.candidates(text, toks)
    scores = rows @ weights

    def every(at):
        if at == len(toks):
            yield 0.0
            return
        yield from every(at + 1)
        for c, (i, j) in enumerate(places):
            if i == at:
                for rest in every(j):
                    for s in scores[c]:
                        yield s + rest

    total, _ = pii._marginals(len(toks), places, scores)
    assert np.isclose(total, np.log(np.sum(np.exp(list(every(0))))))


def uncut(text, weights):
    """The best segmentation of a text that is one zone, from all candidates at once."""
    toks = pii.tokens(text, 0, len(text))
    places, rows = pii.candidates(text, toks)
    scores = rows @ weights - pii.MARGIN
    best = [(0.0, ())]
    for t in range(1, len(toks) + 1):
        best.append(best[-1])
        for c in np.flatnonzero(places[:, 1] == t):
            value, spans = best[places[c, 0]]
            if value + scores[c].max() > best[t][0]:
                best[t] = value + scores[c].max(), (*spans, (toks[places[c, 0]][0], toks[t - 1][1], pii.KINDS[scores[c].argmax()]))
    return list(best[-1][1])


def test_entities_at_every_place_of_a_long_zone():
    weights = pii.train(samples(150, 3))
    entity, junk = "ann.42@mail7.example.com", "7;" * 250
    assert len(pii.tokens(junk, 0, len(junk))) == 500 and list(pii.zones(junk)) == [(0, len(junk))]
    for at in range(0, len(junk), 2):
        text = junk[:at] + entity + ";" + junk[at:]
        found = pii.decode(text, weights)
        assert (at, at + len(entity), "email") in found
        if at % 16 == 0:
            assert found == uncut(text, weights)


def test_network_finds_what_the_patterns_miss():
    order = random.Random(5)
    key = lambda n: "".join(order.choice("0123456789abcdef") for _ in range(n))
    texts = [f"{prose(k, 3)} {key(32)} and 20{order.randrange(10, 99)}-01-01T10 more item{order.randrange(10**6)}" for k in range(200)]
    net = secrets.train(texts)
    assert net.threshold <= 1.0
    found = [secrets.spans_of([f"words here {key(22)} ends"], net)[0] for _ in range(40)]
    assert sum(bool(every) for _, every in found) >= 20 and not any(base for base, _ in found)
    assert all(not secrets.spans_of([f"words of 20{k}-01-01T10 only"], net)[0][1] for k in range(10, 60))


def test_network_learns_from_all_texts(spark, monkeypatch):
    order = random.Random(6)
    key = lambda n: "".join(order.choice("0123456789abcdef") for _ in range(n))
    line = lambda k: f"{prose(k, 3)} {key(32)} and 20{order.randrange(10, 99)}-01-01T10 more item{order.randrange(10**6)}"
    frame = lambda texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # Every text counts, copies too, however the rows and the shards are dealt out.
    texts = [line(k) for k in range(1500)]
    texts += [*texts[:40] * 5, None, "", prose(7, 50)]
    monkeypatch.setattr(secrets, "SHARD", 300)
    whole = secrets.train([t or "" for t in texts])
    fewer = secrets.train(texts[:1200])
    assert whole.threshold <= 1.0 and not np.array_equal(whole.kernel, fewer.kernel)
    for parts in (1, 7):
        net = secrets.fit(frame(texts).repartition(parts, "text"))
        assert np.array_equal(net.kernel, whole.kernel) and np.array_equal(net.out, whole.out)
        assert (net.scale, net.shift, net.threshold) == (whole.scale, whole.shift, whole.threshold)
    # Texts of any length.
    long_texts = [" ".join(line(k) for k in range(400)) for _ in range(2)]
    assert min(map(len, long_texts)) > 20_000
    assert secrets.fit(frame(long_texts)).threshold <= 1.0


def test_examples_in_linear_time():
    text = "token=abc123def " * 20_000
    found = list(secrets.examples([text]))
    assert len(found) == 20_000 and all(y for _, y in found)


def test_counted_calibration_equals_repeated_rows():
    order = np.random.default_rng(3)
    logits, y, times = order.normal(0, 3, 60), order.integers(0, 2, 60).astype(float), order.integers(1, 6, 60)
    logits += 4 * y
    one = np.ones(times.sum())
    assert np.allclose(secrets._platt(logits, y, times.astype(float)), secrets._platt(logits.repeat(times), y.repeat(times), one))
    scores = 1 / (1 + np.exp(-logits))
    assert secrets._threshold(scores, y, times.astype(float)) == secrets._threshold(scores.repeat(times), y.repeat(times), one)


def test_network_sees_the_middle_of_long_candidates():
    class Digits:  # in place of a network: a place inside that shows the digit 7
        threshold = 0.5

        def scores(self, codes, inside):
            half = secrets.WIDTH // 2
            return ((codes[:, half : half + secrets.LENGTH] == secrets.CODES[ord("7")]) & inside).any(axis=1).astype(float)

    for size in (20, 48, 49, 95, 96, 97, 300):
        for at in range(size):
            run = "1" + "/" * (size - 1)
            text = "words " + run[:at] + "7" + run[at:] + " ends"
            assert secrets.spans_of([text], Digits())[0][1] == [(6, 7 + size, "network")], (size, at)
    assert len(secrets.spans_of(["7/" * 100_000], Digits())[0][1]) == 1


def test_network_gradient():
    order = np.random.default_rng(1)
    pictures = [secrets.picture("abc def0123456 xyz=1", 4, 14), secrets.picture("key=9a8b7c6d5e", 4, 14)]
    codes, inside = secrets._stacked(pictures)
    net = secrets.Network(
        order.normal(0, 0.3, (secrets.WIDTH, secrets.ALPHABET, secrets.FILTERS)), np.full(secrets.FILTERS, 0.1),
        order.normal(0, 0.3, 2 * secrets.FILTERS), 0.0,
    )
    y = np.array([1.0, 0.0])
    error = 1 / (1 + np.exp(-net.raw(codes, inside)[0])) - y
    loss = lambda: float(np.sum(np.logaddexp(0, net.raw(codes, inside)[0]) - y * net.raw(codes, inside)[0]))
    gradients = net.gradients(codes, inside, error)
    for name, at in (("kernel", (2, 10, 3)), ("bias", (4,)), ("out", (5,)), ("kernel", (0, 54, 1))):
        values = getattr(net, name)
        before = values[at]
        values[at] = before + 1e-6
        up = loss()
        values[at] = before - 1e-6
        down = loss()
        values[at] = before
        assert abs((up - down) / 2e-6 - gradients[name][at]) < 1e-4


def test_redaction():
    assert secrets.redacted("ab cd ef", [(3, 5, "hex"), (4, 8, "assign")], "[x]") == "ab [x]"
    assert secrets.redacted("ab", [], "[x]") == "ab"
