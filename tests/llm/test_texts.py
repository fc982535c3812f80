"""Quality rules, page text, toxicity, licenses and the pipeline."""

import html
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tarnwork.llm import decontaminate, licenses, pagetext, quality, secrets, toxicity
from tarnwork.llm.common import prepare
from tarnwork.llm.queries import QUERIES, SQL
from tests import oracle
from tests.llm.tables import prose


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connection(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, con, name):
    problem = oracle.difference(oracle.spark_rows(QUERIES[name](spark, sf)), oracle.sql_rows(con, SQL[name]))
    assert problem is None, problem


# quality


def test_repeated_windows_against_a_plain_count(spark):
    order = random.Random(2)
    texts = [" ".join(order.choice("ab") for _ in range(order.randrange(0, 60))) for _ in range(150)]
    texts += [f"{prose(3, 12)} x {prose(3, 12)}", prose(4, 8), f"{prose(4, 8)} {prose(4, 8)}", "a\n\na\n \nb\na"]
    docs = prepare(spark).createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    for r in quality.counted(docs).collect():
        words, starts = texts[r.doc_id].split(), {}
        for k in range(len(words) - 7):
            starts.setdefault(tuple(words[k : k + 8]), []).append(k)
        inside = {k + j for own in starts.values() if len(own) > 1 for k in own for j in range(8)}
        assert r.n_repeat_words == len(inside)
        lines = [x for x in texts[r.doc_id].split("\n") if x.split()]
        assert r.n_dup_lines == len(lines) - len(set(lines))


def test_distance_and_guards(spark):
    from pyspark.sql import functions as F

    def js(p, q):
        m = (p + q) / 2
        part = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m) if a > 0)
        return np.sqrt(max((part(p) + part(q)) / 2, 0))

    cases = [(np.array(p, float), np.array(q, float)) for p, q in (([1, 0], [0, 1]), ([0.5, 0.5], [0.5, 0.5]), ([0.2, 0.8, 0], [0.1, 0.4, 0.5]))]
    for p, q in cases:
        got = spark.range(1).select(quality.distance(F.array(*map(F.lit, map(float, p))), F.array(*map(F.lit, map(float, q))))).first()[0]
        assert abs(got - js(p, q)) < 1e-12
    english = "the of and to in is that for it was with on are be this by"
    order = random.Random(1)
    clean = [" ".join(order.choice([*english.split() * 2, *prose(k, 16).split()]) for _ in range(150)) for k in range(60)]
    odd = ["@@ ## $$ %% && " * 30, prose(5, 150), prose(6, 25)]
    docs = prepare(spark).createDataFrame([(k, t, "en") for k, t in enumerate(clean + odd)], "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in quality.judged(docs).collect()}
    assert [kept[k] for k in range(60)] == [True] * 60
    assert not kept[60] and not kept[61] and kept[62]  # the last one is too short to tell
    few = quality.judged(docs.where("doc_id >= 60")).where("base_failed = false and kept = false")
    assert few.count() == 0  # too few documents of the language


def test_quality_has_no_python(spark, sf):
    plan = QUERIES["op5_quality"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    source = open(quality.__file__).read()
    assert "mapInArrow" not in source and "udf" not in source


# page text


def test_articles_of_all_pages(spark, sf):
    rows = QUERIES["op7_pagetext"](spark, sf).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        body = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        parts = [" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h1|br)>", body.replace("<b>", "").replace("</b>", ""))]
        assert r.text == " ".join(p for p in parts if p) and r.n_chars == len(r.text)


WEIGHTS = [0.4, 0.3, -6.0, -1.0, 0.1, 3.0]


@pytest.mark.parametrize(
    "page, text",
    [
        ("<nav><a>x</a></nav><article><p>One&nbsp;two &lt;3</p><p>b</p></article><footer>f</footer>", "One two <3 b"),
        ("<main><h1>T</h1><p>a<b>b</b>c</p><aside>s</aside><form><input value=1>f</form><p>d</p></main>", "T abc d"),
        ('<article><p>text</p><section class="comments"><p>I agree with all of this, really.</p></section></article>', "text"),
        ('<article><p>a > b</p><p title="x > y">c</p><!-- <p>no</p> --><script>"</p>"</script><p>d</article>', "a > b c d"),
        ('<div class="cookie-notice">We use cookies.</div><article><header><h1>Head</h1></header><p>t</p></article>', "Head t"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>x<td>y</table></article>", "one two x y"),
        ('<article><p>t</p><p style="display: none">h</p><div hidden>h</div></article>', "t h h"),
        ("<article><p>We know that <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds in all cases.</p></article>", "We know that x=2 holds in all cases."),
        ("", ""),
        ("<p", ""),
        ("<article>unclosed <p>text", "unclosed text"),
    ],
)
def test_structure(page, text):
    assert pagetext.main_text(page, WEIGHTS) == text


def test_text_without_meaningful_containers():
    long = "This is a long paragraph, with many words in it, and it goes on for a while. It has sentences."
    page = f"<div><a>Home</a> <a>News</a></div><div><h2>Title</h2><p>{long}</p><p>Short.</p><p>{long}</p></div><div><a>About</a></div>"
    assert pagetext.main_text(page, WEIGHTS) == f"Title {long} Short. {long}"


def test_minimum_cut_against_all_labellings():
    order = random.Random(4)
    for _ in range(60):
        n = order.randrange(2, 9)
        lean = [order.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, order.uniform(0, 2)) for a in range(n) for b in range(a + 1, n) if order.random() < 0.5]

        def cost(labels):
            own = sum(max(x, 0) if not keep else max(-x, 0) for x, keep in zip(lean, labels))
            return own + sum(w for a, b, w in edges if labels[a] != labels[b])

        best = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert abs(cost(pagetext.minimum_cut(lean, edges)) - best) < 1e-6


# toxicity


def test_held_out_accuracy_and_disguises(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet") for name in ("documents", "labels"))
    prepare(spark)
    scorer = toxicity.fit(docs.select("doc_id", "text"), labels)
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "toxic").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    said = [scorer.score(r.text or "") >= 0.5 for r in held]
    found = sum(s for s, r in zip(said, held) if r.toxic == 1) / sum(r.toxic == 1 for r in held)
    wrong = sum(s for s, r in zip(said, held) if r.toxic == 0) / sum(r.toxic == 0 for r in held)
    assert found >= 0.88 and wrong <= 0.02, (found, wrong)
    for plain, disguised in (("moron", "m0r0n"), ("stupid", "s t u p i d"), ("stupid", "stuuuupid"), ("pathetic", "p.a.t.h.e.t.i.c"), ("trash", "tr@sh"), ("worthless", "w0rthle$$")):
        assert plain in {w for t in scorer.restorer.tokens(f"so {disguised} yes") for w in scorer.restorer.words(t)}
        assert scorer.score(f"you are {disguised}") > scorer.score("you are here") + 0.2
    assert "stupid" in {w for t in scorer.restorer.tokens("a s t u p i d i") for w in scorer.restorer.words(t)}
    assert scorer.restorer.text("You m0r0n!") != "You m0r0n!"


def test_every_word_of_a_disguised_passage_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    prepare(spark)
    model = toxicity.language_model(toxicity.character_counts(docs))
    weights = {f: 3.0 for w in ("stupid", "moron", "idiot") for f in toxicity.features_of(w)}
    scorer = toxicity.Scorer(model, weights, -2.0)
    spaced = lambda t: " ".join(t.replace(" ", ""))
    for text in ("you stupid", "this is so stupid", "you are a moron", "what an idiot he is"):
        assert scorer.score(f"so {spaced(text)} yes") > 0.5, text
    for at in range(0, 60):  # a word across any place of a long run
        assert scorer.score(spaced("nanu" * 15)[: 2 * at] + spaced("stupid") + " " + spaced("nanu" * 5)) > 0.5, at
    for text in ("foo,m0r0n", "foo/m0r0n/bar", "well-m0r0n"):
        assert scorer.score(text) > 0.5, text
    assert scorer.score(spaced("a walk in the park on a sunny day")) < 0.5


def test_labels_of_the_held_out_fold_change_nothing(spark):
    from pyspark.sql import functions as F

    order = random.Random(1)
    rows = [(k, prose(k, 30) + (" vilewort" if k % 5 == 0 else "")) for k in range(200)]
    docs = prepare(spark).createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(200)], "doc_id long, toxic int")
    flipped = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 0, F.lit(order.randrange(2))).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels).weights == toxicity.fit(docs, flipped).weights != {}


def test_character_counts_are_of_all_texts(spark):
    docs = prepare(spark).createDataFrame([(1, "Ab"), (2, None), (3, "ab ab")], "doc_id long, text string").repartition(3)
    counts = {r.trigram: r.n for r in toxicity.character_counts(docs).collect()}
    code = lambda t: sum(toxicity.LETTERS.index(c) * toxicity.SIZE ** (2 - k) for k, c in enumerate(t))
    assert counts[code("ab ")] == 3


# licenses


def test_notices_against_all_pairs(spark):
    order = random.Random(5)
    words = sorted({w for _, text in licenses.NOTICES for w in re.findall("[a-z0-9]+", text.lower())})
    texts = []
    for k in range(300):
        _, notice = order.choice(licenses.NOTICES)
        own = notice.split()
        own = [w for w in own if order.random() < 0.93] + [order.choice(words) for _ in range(order.randrange(6))]
        order.shuffle(own)
        texts.append(f"{prose(k, 5)}\n{' '.join(own)}\n{prose(k + 1, 5)}")
    docs = prepare(spark).createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.notice): r.containment for r in licenses.matches(docs).collect()}
    expected = {}
    for k, text in enumerate(texts):
        for n, (_, notice) in enumerate(licenses.NOTICES):
            own = set(licenses.words_of(notice.encode()))
            words, step = licenses.words_of(text.encode()), licenses.step_of(licenses.NOTICES)
            windows = [set(words[i : i + 2 * step]) for i in range(0, len(words), step)]
            blocks = [set(licenses.words_of(line.encode())) for line in text.split("\n")] + windows
            share = max(len(own & block) for block in blocks) / len(own)
            if share >= licenses.CONTAINMENT:
                expected[k, n] = share
    assert got == expected and len(expected) > 100


def test_notices_that_are_wrapped(spark):
    """Each notice under every width of wrapping, with and without comment marks, anywhere in a text."""
    import textwrap

    rows = []
    for n, (label, notice) in enumerate(licenses.NOTICES):
        for width in (12, 25, 40, 72, 80):
            for mark in ("", "# ", " * ", "// "):
                for before in (0, 7, 23):
                    lead = " ".join(f"word{k}" for k in range(before))
                    body = "\n".join(mark + line for line in textwrap.wrap(notice, width))
                    rows.append((len(rows), f"{lead}\n{body}\n{prose(n, 30)}", n))
    docs = prepare(spark).createDataFrame(rows, "doc_id long, text string, own int")
    found = {(r.doc_id, r.notice) for r in licenses.matches(docs.drop("own")).collect()}
    assert all((doc, n) in found for doc, _, n in rows)


def test_words_of_a_notice_far_apart_are_none(spark):
    _, notice = licenses.NOTICES[1]
    text = "\n".join(f"{w} {prose(k, 20)}" for k, w in enumerate(notice.split()))
    docs = prepare(spark).createDataFrame([(1, text)], "doc_id long, text string")
    assert licenses.matches(docs).count() == 0


# the pipeline


def test_pipeline_against_its_parts(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = corpus_pipeline.run(spark, sf).collect()
    left = {r.doc_id: r for r in rows}
    assert len(left) == len(rows) and set(left) <= set(docs)
    toxic = {r.doc_id for r in QUERIES["op9_toxicity"](spark, sf).collect() if r.predicted}
    assert not toxic & set(left)
    # Of the texts that are not toxic, each near-duplicate group has one at most, and a group without test items has one.
    from tests.llm.test_pairs import plain_components

    groups = {}
    for doc, (_, top) in plain_components({d: r.text for d, r in docs.items() if d not in toxic}).items():
        groups.setdefault(top, set()).add(doc)
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    bad = {r.doc_id for r in decontaminate.contaminated(spark.read.parquet(f"{sf}/documents.parquet"), items).collect()}
    assert set(left) == {top for top in groups if top not in bad}
    assert bad - toxic
    for doc, r in left.items():
        spans = secrets.base_spans(docs[doc].text)
        assert r.round_trip and r.n_chars == len(r.text) and not any(k != "assign" for _, _, k in secrets.base_spans(r.text))
        if not spans and "[secret]" not in r.text:
            assert r.text == docs[doc].text


def test_stage_functions_keep_the_columns(spark, sf):
    docs = prepare(spark).read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name


@pytest.mark.parametrize("name", sorted(pagetext.EMBEDDED))
def test_an_open_tag_in_a_menu_ends_with_it(name):
    """The page with the tag left open gives the text of the page with the tag closed."""
    page = "<body><nav><{0}><option>en</option>{1}</nav><article><p>One and two.</p>{2}<p>Three.</p></article>{3}</body>"
    closed = pagetext.main_text(page.format(name, f"</{name}>", "", ""), WEIGHTS)
    assert closed == "One and two. Three."
    assert pagetext.main_text(page.format(name, "", "", ""), WEIGHTS) == closed
    other = f"<{name}><p>x</p></{name}>"
    assert pagetext.main_text(page.format(name, "", other, ""), WEIGHTS) == closed
    assert pagetext.main_text(page.format(name, "", "", other), WEIGHTS) == closed


def test_small_languages_are_judged_like_large_ones(spark):
    """One more document of a language does not switch the verdict on."""
    odd = "#$% " * 60
    verdicts = []
    for others in (28, 29, 40):
        docs = [(k, prose(k, 80), "en") for k in range(others)] + [(999, odd.replace("#", "a#b"), "en")]
        row = quality.judged(spark.createDataFrame(docs, "doc_id long, text string, lang string")).where("doc_id = 999").first()
        assert row.char_distance is not None
        verdicts.append(row.kept)
    assert len(set(verdicts)) == 1


def all_readings(token, model, blanks):
    """Every path through the lattice of a token: {reading: least cost}."""
    paths = [("", (0, 0), 0.0)]
    for options in toxicity._offers(token, blanks):
        longer = []
        for read, (a, b), cost in paths:
            for letter, own in options:
                if not letter:
                    longer.append((read, (a, b), cost + own))
                elif toxicity._CODE[letter] or b:
                    c = toxicity._CODE[letter]
                    longer.append((read + letter, (b, c), cost + own - float(model[a, b, c])))
        paths = longer
    out = {}
    for read, (a, b), cost in paths:
        cost -= float(model[a, b, 0]) if b or not blanks else 0.0
        out[read] = min(cost, out.get(read, cost))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_restoring_equals_all_paths_of_the_lattice(seed):
    order = random.Random(seed)
    model = np.log(np.random.default_rng(seed).dirichlet(np.full(toxicity.SIZE, 0.3), (toxicity.SIZE,) * 2) + 1e-9).astype(np.float32)
    token = "".join(order.choice("m0r1n3@$!. -aabs") for _ in range(order.randrange(1, 7)))
    for blanks in (False, True):
        readings = all_readings(token, model, blanks)
        got = toxicity.restore(token, model, blanks)
        assert got in readings and readings[got] <= min(readings.values()) + 1e-6
