"""Strings of special tokens in a text, against a tokenizers library left at its default."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from brindle.llm import bpe, queries
from brindle.llm.token_cache import CachedEncoder

WORD, BYTE = (public_tokenizers.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))
TEXTS = ["hello <|endoftext|> world", "<|endoftext|>", "a<|startoftext|>b  \n<|endoftext|><|endoftext|> c", "<|EndOfText|> é<|endoftext|>́ x", "plain", "", None]


@pytest.fixture(scope="module")
def encoders():
    return {p: (Tokenizer.from_file(p), CachedEncoder(p, most_bytes=20_000)) for p in (WORD, BYTE)}, bpe.BpeEncoder(WORD, most_bytes=20_000)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|endof", "text|>", " ", "\n", "  ", "Ab", "it's", "é", "́", "日本", "12"]), max_size=14))
def test_special_strings_give_the_librarys_ids(encoders, parts):
    pairs, own = encoders
    for text in ("".join(parts), *filter(None, TEXTS)):
        for path, (t, e) in pairs.items():
            want = t.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(e.ids(text), "<u4").tolist() == want
            assert path == BYTE or own.encode(text) == want


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("special"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").write.parquet(f"{at}/documents.parquet")
    return at


def test_the_queries_follow_the_library(spark, tables):
    word, byte = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
    ids = [word.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter((i, len(x), sha(" ".join(map(str, x))), sha(word.decode(x, skip_special_tokens=False))) for i, x in enumerate(ids))
    assert Counter(tuple(r) for r in queries.op10_bpe(spark, tables).collect()) == want
    assert {r["doc_id"]: r["n_tokens"] for r in queries.op5_token_records(spark, tables).collect()} == {i: len(x) + 1 for i, x in enumerate(ids)}
    assert {r["doc_id"]: r["doc_tokens"] for r in queries.op8_packing(spark, tables).collect()} == {i: len(byte.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in enumerate(TEXTS)}
