import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.isdir(bpe.TOKENIZERS), reason="no tokenizers here")


@pytest.fixture(scope="module")
def known():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(), special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60) | st.text("ab \n\t1=-'é中", max_size=80))
def test_same_as_the_merges(text):
    import tiktoken

    e = test_same_as_the_merges.__dict__.setdefault("e", tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(), special_tokens={}))
    assert bpe.encoder().encode(text) == e.encode_ordinary(text)


def test_long_and_special(known):
    for text in ("=" * 5000, " " * 5000, "\n" * 5000, "abc" * 5000, "ａ" * 900, "<|endoftext|> x", "a \n\n b\n \nc\x1c\nd", "x" * 300 + "\n" + "é" * 300):
        assert bpe.encoder().encode(text) == known.encode_ordinary(text)


def test_round_trip(known):
    text = "The glossary was weighed again — 3.14 cm.\n\tdf['année'] = 1"
    assert known.decode(bpe.encoder().encode(text)) == text


def test_frame(spark):
    d = spark.createDataFrame([(1, "", "x"), (2, None, None), (3, "  ", "y"), (None, "a", None), (3, "  ", "y")], "doc_id bigint, text string, ids string")
    got = sorted(((r.doc_id, r.ids) for r in bpe.token_ids(d).collect()), key=str)
    assert (1, []) in got and (2, []) in got and got.count((3, bpe.encoder().encode("  "))) == 2 and (None, bpe.encoder().encode("a")) in got
    assert {r.doc_id: r.n_tokens for r in bpe.token_counts(d).collect()}[2] == 0
    assert bpe.token_ids(d.limit(0)).count() == 0
