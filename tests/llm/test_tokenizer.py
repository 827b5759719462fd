import os

import pytest

from graphloom.llm import tokenizer as tk

pytestmark = pytest.mark.skipif(not os.path.exists(f"{tk.TOKENIZER_DIR}/byte_bpe_50k.json"), reason="no vocabulary files")

TEXTS = ["", " ", "a", "Hello, world!", "déjà vu 日本語 🙂", "aaaaaaaaaaaaaaaaaaaaaaaaab", "tabs\t\tand\r\n\r\nlines  ", "<|endoftext|>", "it's we'll 'tis 12345 ____ ----", "\x00\x01", "x" * 3000, "ab" * 2000]


def reference():
    import base64

    tiktoken = pytest.importorskip("tiktoken")
    with open(f"{tk.TOKENIZER_DIR}/byte_bpe_50k.tiktoken", "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=tk.SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_reference_and_round_trip():
    hypothesis = pytest.importorskip("hypothesis")
    own, other = tk.encoder(), reference()
    for text in TEXTS:
        assert own.encode(text).tolist() == other.encode_ordinary(text)
        assert own.decode(own.encode(text)).decode() == text

    @hypothesis.settings(max_examples=300, deadline=None)
    @hypothesis.given(hypothesis.strategies.text(max_size=80))
    def check(text):
        text = text.encode("utf-8", "ignore").decode()
        assert own.encode(text).tolist() == other.encode_ordinary(text)
        assert own.decode(own.encode(text)).decode() == text

    check()


def test_corpus(frame):
    rows = tk.encode_corpus(frame([(1, None, "x"), (2, "", "x"), (3, "ab", "x"), (3, "ab", "x")], "doc_id long, text string, ids string")).collect()
    assert sorted((r.doc_id, len(r.ids)) for r in rows) == [(1, 0), (2, 0), (3, 1), (3, 1)]
    assert tk.encode_corpus(frame([], "doc_id long, text string")).count() == 0
