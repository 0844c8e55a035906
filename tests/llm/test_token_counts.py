"""Counts against the tokenizer library."""

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import docs, edge_rows, empty, random_rows
from tokenizers import Tokenizer

from farelens.llm import token_counts as T

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def library(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=20), st.sampled_from(
    ["<|endoftext|>", " the", "'ll", "  ", "\n\n", "　", "123", "aaaa", "é", "🎉", "<|endof"])), max_size=8).map("".join))
def test_any_text(text):
    assert T._counter("byte_bpe_50k.json").count(text) == library(text)


def test_documents(spark):
    rows = random_rows(1, 60) + edge_rows() + [(900, "a<|endoftext|>b " * 3)]
    out = T.token_counts(docs(spark, rows, clash=True)).collect()
    want = sorted((i, len((t or "").encode()), library(t)) for i, t in rows if i is not None)
    assert sorted((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in out) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in out)
    assert T.token_counts(empty(spark)).count() == 0


def test_other_kinds_of_files_are_refused():
    with pytest.raises(ValueError):
        T._counter("word_bpe_49k.json")


def test_a_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(T, "CACHE_PIECES", 3)
    counter = T._counter("byte_bpe_50k.json")
    text = " ".join(f"word{i}" for i in range(50))
    assert counter.count(text) == library(text) and len(counter.seen) <= 3
