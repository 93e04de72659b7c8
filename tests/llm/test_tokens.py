"""Encoding, decoding and counting against the tokenizers library."""

import random
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wayline.llm import bpe, tokencount

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def library(path):
    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    return tok


def test_encode_and_decode(docs, pairs):
    tok = library(BYTE)
    want = []
    for d, t in pairs:
        ids = tok.encode(t, add_special_tokens=False).ids
        want.append((d, len(ids), np.array(ids, "<u4").tobytes(), tok.decode(ids, skip_special_tokens=False)))
    found = bpe.decode(bpe.encode(docs, BYTE, leaf_chars=64, piece_chars=5000), BYTE)
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in found.collect()) == Counter(want)


def test_encode_empty_table(empty):
    assert bpe.decode(bpe.encode(empty, BYTE), BYTE).count() == 0


@pytest.fixture(scope="module")
def small_leaves():
    return bpe.TreeEncoder(BYTE, leaf_chars=6), library(BYTE)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'stlvreéß漢😀 \n\t1.-_́ "), max_size=120))
def test_joined_halves_are_exact(small_leaves, text):
    tree, tok = small_leaves
    assert tree.encode(text).tolist() == tok.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, " \n\t  \n" * 160_000, (" " * 99_999 + "x") * 10, " " * 300_000 + "<|endoftext|>" + "\n" * 200_000, "x" * 1_000_000], ids=["spaces", "lines", "blanks", "gaps", "special", "letters"])
def test_long_runs_take_linear_time(text):
    """Each took minutes when joins walked white space a token at a time."""
    tree = bpe.TreeEncoder(BYTE)
    began = time.process_time()
    found = tree.encode(text)
    pieces = [text[i : i + bpe.PIECE_CHARS] for i in range(0, len(text), bpe.PIECE_CHARS)]
    joined = bpe.join_pieces(tree, pieces, [tree.tree(x) for x in pieces]) if "<" not in text else found
    assert time.process_time() - began < 4
    want = library(BYTE).encode(text, add_special_tokens=False).ids
    assert found.tolist() == want and joined.tolist() == want


def test_a_special_string_over_a_piece(spark):
    text = "a b\n" * 1249 + "xy <|endoftext|> it's" + "  \n" * 3000
    done = bpe.decode(bpe.encode(spark.createDataFrame([(1, text)], "doc_id int, text string"), BYTE, piece_chars=5003), BYTE).first()
    assert np.frombuffer(done.ids, "<u4").tolist() == library(BYTE).encode(text, add_special_tokens=False).ids and done.decoded == text


def test_counts_of_long_words():
    rng = random.Random(4)
    texts = ["x" * 20_000, "".join(rng.choice("abcdefghijklmnop") for _ in range(20_000)), "é漢" * 3000, " ".join("a" * n for n in (255, 256, 257, 511, 513, 1025)), "!?" * 900, "<|" * 700]
    want = [len(library(WORD).encode(t, add_special_tokens=False).ids) for t in texts]
    own = tokencount.TokenCounter(WORD)
    assert own.count(texts).tolist() == want
    own.transducer.clear()
    own.transducer.most_states = 500  # less than the words need
    assert own.count(texts).tolist() == want and len(own.transducer.states) <= 500


def test_counts(docs, pairs):
    tok = library(WORD)
    want = Counter((d, len(t.encode()), len(tok.encode(t, add_special_tokens=False).ids)) for d, t in pairs)
    assert Counter(tuple(r) for r in tokencount.count_tokens(docs, WORD).collect()) == want


def test_count_empty_table(empty):
    assert tokencount.count_tokens(empty, WORD).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("abthe'stlvreéİß漢ｋ😀 \n1²-_́  "), max_size=80))
def test_counts_of_odd_texts(text):
    assert tokencount.counter(WORD).count([text])[0] == len(library_words().encode(text, add_special_tokens=False).ids)


_words = []


def library_words():
    if not _words:
        _words.append(library(WORD))
    return _words[0]
