"""Every query on tables with nulls, empty and long texts, repeated rows, clashing columns, and on empty tables."""

import pytest

import corpus_pipeline
from tarnwork.llm.queries import QUERIES
from tests.llm import tables

PAGES = [
    (0, "u", None), (1, None, ""), (2, "u", "<p>a" * 2000), (None, "u", "<article><p>text</p></article>"), (2, "u", "<p>a" * 2000),
    (3, "u", "x" * 50_000), (4, "u", "<!-- never closed"),
]
ALL = {**QUERIES, "pipeline": corpus_pipeline.run}


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return tables.write(spark, tmp_path_factory.mktemp("odd"), tables.odd_documents(), PAGES)


@pytest.fixture(scope="module")
def clashing(spark, tmp_path_factory):
    return tables.write(spark, tmp_path_factory.mktemp("clash"), tables.odd_documents(), PAGES, extra=True)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return tables.write(spark, tmp_path_factory.mktemp("empty"), [], [])


def rows(df):
    return sorted((str(tuple(r)) for r in df.collect()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_and_clashing_columns(spark, odd, clashing, name):
    got = rows(ALL[name](spark, odd))
    if not name.startswith(("op4", "op11", "op12", "op13")):
        assert len(got) == len(PAGES if name.startswith("op7") else tables.odd_documents())
    assert rows(ALL[name](spark, clashing)) == got


def test_pipeline_on_odd_rows(spark, odd, clashing):
    got = corpus_pipeline.run(spark, odd)
    ids = [r.doc_id for r in got.select("doc_id").collect()]
    assert got.where("not round_trip").count() == 0
    assert [r.text for r in got.where("doc_id = 19").collect()] == [corpus_pipeline.MARK + '"']
    assert ids.count(None) == 2  # nothing is known against rows without an id
    assert len([i for i in ids if i is not None and 100 <= i < 140]) <= 1
    assert set(corpus_pipeline.run(spark, clashing).columns) >= set(got.columns)


@pytest.mark.parametrize("name", sorted(ALL))
def test_empty_tables(spark, empty, name):
    df = ALL[name](spark, empty)
    assert df.count() == 0 and df.columns
