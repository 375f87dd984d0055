import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mhqa.llm import tokenize as T

pytestmark = pytest.mark.skipif(not os.path.exists(T.TOKENIZERS), reason="no tokenizer files")


@pytest.fixture(scope="module")
def encoder():
    return T.Encoder(T.Merges(*T.load(f"{T.TOKENIZERS}/byte_bpe_50k.json")))


@pytest.fixture(scope="module")
def model():
    tokenizers = pytest.importorskip("tokenizers")
    m = tokenizers.Tokenizer.from_file(f"{T.TOKENIZERS}/byte_bpe_50k.json")
    m.encode_special_tokens = True
    return m


FIXED = ["", "aaaa aaaaaaa aaaaa", "<|endoftext|> x", "   \n\n x  ", "👍🏽 zwei", "zzzzzzzzz" * 50, "it's we'll", "Føndel Preltdore为Grosmárn Academy制作了", "١٩٢٣", "\x00\x7f", "a" * 5000]


def test_fixed(encoder, model):
    for text in FIXED:
        assert encoder.encode([text]).to_pylist()[0] == model.encode(text, add_special_tokens=False).ids
    assert encoder.encode(FIXED).to_pylist() == [model.encode(t, add_special_tokens=False).ids for t in FIXED]
    assert encoder.encode([]).to_pylist() == [] and encoder.encode([None, ""]).to_pylist() == [[], []]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text(encoder, model, texts):
    ids = encoder.encode(texts).to_pylist()
    assert ids == [model.encode(t, add_special_tokens=False).ids for t in texts]
    assert [model.decode(i, skip_special_tokens=False) for i in ids] == texts


def test_cache_bound(model):
    small = T.Encoder(T.Merges(*T.load(f"{T.TOKENIZERS}/byte_bpe_50k.json")), cache_words=2)
    for text in ("one two three four", "five six", "one two"):
        assert small.encode([text]).to_pylist()[0] == model.encode(text, add_special_tokens=False).ids


def test_encode(spark, data, model):
    documents = spark.read.parquet(f"{data}/documents.parquet")
    for r in T.encode(documents, "doc_id", "text").join(documents, "doc_id").collect():
        assert r.ids == (model.encode(r.text, add_special_tokens=False).ids if r.text else [])
    clash = spark.createDataFrame([(1, "a", None), (1, None, None)], "doc_id int, text string, ids string")
    assert sorted(r.ids for r in T.encode(clash, "doc_id", "text").collect()) == [[], [64]]
