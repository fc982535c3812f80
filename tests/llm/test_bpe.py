import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwork.llm import bpe
from tarnwork.llm.common import prepare

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
OWN = bpe.vocabulary(PATH, PATTERN)
REFERENCE = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def ids_of(text):
    return np.array(REFERENCE.encode_ordinary(text), "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    (ids,) = OWN.encode([text])
    assert ids == ids_of(text)
    assert OWN.decode(ids) == text.encode()


def test_every_code_point_and_glued_tokens():
    order = random.Random(1)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b {c}{c}1" for c in points[k : k + 300]) for k in range(0, len(points), 300)]
    tokens = list(bpe.read_ranks(PATH))
    texts += [b"".join(order.choice(tokens) for _ in range(4)).decode("utf-8", "ignore") for _ in range(5000)]
    assert [t for t, x in zip(texts, OWN.encode(texts), strict=True) if x != ids_of(t)] == []


def test_registered_query_on_whole_table(spark, sf):
    from tarnwork.llm.queries import QUERIES
    import hashlib

    rows = QUERIES["op2_bpe"](spark, sf).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = ids_of(texts[r.doc_id])
        assert r.n_tokens == len(ids) // 4
        assert r.ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_offsets_and_split_characters(spark):
    prepare(spark)
    texts = ["naïve \U0001f9ff ok", "", None, "ab  cd"]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    rows = bpe.decode(bpe.encode(docs, PATH, PATTERN, offsets=True), PATH, PATTERN, as_text=True).orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        assert r.decoded == (t or "")
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert len(r.starts) == len(r.ends) == len(ids) == r.n_tokens
        for i, a, b in zip(ids, r.starts, r.ends, strict=True):
            # The span covers the characters that the token's bytes belong to.
            assert OWN.bytes_of[i] in (t or "")[a:b].encode()
    assert any(b - a == 1 and c == a for (a, b), c in zip(zip(rows[0].starts, rows[0].ends), rows[0].starts[1:]))


def test_pattern_outside_what_is_supported():
    with pytest.raises(ValueError):
        bpe.spelled_out(r"\w+")
