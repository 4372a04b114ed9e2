import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import tokenizer as T

pytestmark = pytest.mark.skipif(not os.path.exists(T.DEFAULT_VOCABULARY), reason="no vocabulary file")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(T.DEFAULT_VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=60))
def test_equals_the_library(library, text):
    text = text.encode("utf-8", "ignore").decode()
    e = T.encoder()
    ids = e.encode(text)
    assert ids == library(text)
    assert "".join(T.decode_stream(ids, e.fst.bytes_of)) == text


@pytest.mark.parametrize("text", ["", " ", "a" * 20000, "ab" * 5000, " \n\t " * 500, "<|endoftext|>", "don't we'll I'M", "👩‍⚕️❤️🔥" * 50, "мг µg ١٢٣ 漢字", "\x00\x7f"])
def test_hard_texts(library, text):
    assert T.encoder().encode(text) == library(text)


def test_random_words(library):
    r = random.Random(2)
    for _ in range(400):
        w = "".join(r.choice("etaoinshrdlu \n019.,éß漢") for _ in range(r.randrange(120)))
        assert T.encoder().encode(w) == library(w)


def test_state_reset_changes_nothing(monkeypatch):
    e = T.Encoder()
    want = e.encode("the quick brown fox jumps over lazy dogs " * 3)
    monkeypatch.setattr(T, "MAX_ARCS", 5)
    monkeypatch.setattr(T, "CACHE_WORDS", 1)
    assert T.Encoder().encode("the quick brown fox jumps over lazy dogs " * 3) == want


def test_utf8_machine():
    r = random.Random(3)
    for _ in range(500):
        raw = bytes(r.choice([r.randrange(256), 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x41]) for _ in range(r.randrange(12)))
        m, out, i = T.Utf8Machine(), "", 0
        while i < len(raw):
            n = r.randrange(1, 4)
            out += m.feed(raw[i : i + n])
            i += n
        assert out + m.end() == raw.decode("utf-8", "replace")


def test_frame(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Hello world", "x"), (3, "Hello world", "y")], "doc_id bigint, text string, ids string")
    got = T.encode_documents(df)
    assert got.columns == ["doc_id", "ids"] and sorted((r.doc_id, len(r.ids)) for r in got.collect()) == [(1, 0), (2, 0), (3, 2), (3, 2)]
    assert T.encode_documents(df.limit(0)).count() == 0
    back = got.select(T.decoded(got["ids"]).alias("t")).collect()
    assert sorted(r.t for r in back) == ["", "", "Hello world", "Hello world"]
