import os

import pytest

pytest.importorskip("radveil.llm")

from radveil.llm import bpe as B  # noqa: E402

PATH = f"{B.TOKENIZERS}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")


@pytest.fixture(scope="module")
def library():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=B.PATTERN, mergeable_ranks=ranks, special_tokens={})


CASES = ["", "a", "<|endoftext|> ordinary", "it's we'll 'tis 'S", "x" * 3000 + "é" * 2500, "ab" * 1500, " " * 5000 + "a", "\n\n\t x  y", "🙂👍🏽 কলা", "1234567 12.5%", "a\x00b", " x", "Ünïcödé—“quotes”"]


def test_against_the_library(library, spark, data):
    v = B.Vocabulary(PATH)
    texts = CASES + [r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert [x.tolist() for x in v.encode(texts)] == [library.encode_ordinary(t or "") for t in texts]


def test_random_texts(library):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    v = B.Vocabulary(PATH)

    @settings(max_examples=150, deadline=None)
    @given(st.text(max_size=60))
    def check(t):
        assert v.encode([t])[0].tolist() == library.encode_ordinary(t)

    check()


def test_long_pieces_equal_short_ones(library, monkeypatch):
    monkeypatch.setattr(B, "LONG_PIECE", 3)
    assert [x.tolist() for x in B.Vocabulary(PATH).encode(CASES[:6])] == [library.encode_ordinary(t) for t in CASES[:6]]


def test_table(spark, library):
    df = spark.createDataFrame([(1, "hello world", 0), (2, "", 0), (3, None, 0), (4, "hello world", 0)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in B.encoded(df).collect()}
    assert got == {1: library.encode_ordinary("hello world"), 2: [], 3: [], 4: got[1]}
    assert B.encoded(df.limit(0)).count() == 0
    assert dict(B.encoded(df).dtypes)["ids"] == "array<int>"
