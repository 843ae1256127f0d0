"""Splitting, hashing and merging against the libraries and plain Python."""

import base64
import random

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from folioforge.llm.bpe import vocabulary
from folioforge.llm.textnum import HashIndex, cut_at_spaces, word_hashes
from folioforge.llm.tokens import library

ALPHABET = "ab e's 'tre'll  \n\t\r1٣é漢字!?.,'　​ \x1c\x85😀𝒳_-"
EDGES = ["", " ", "\n\n", "I'll we've they're don't 's 'sabc '' 'll", "a" * 700, "ab" * 400 + " x'll", " " * 900, "aaaa'S"]


def texts(n=1500, seed=2):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(40))) for _ in range(n)] + EDGES


def test_bpe_equals_tiktoken_and_round_trips():
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ours = vocabulary(path)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for t in texts():
        ids = ours.encode(t)
        assert ids == theirs.encode_ordinary(t)
        assert ours.decode(ids) == t.encode()


def test_library_ids_with_special_strings():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    cases = texts(400) + ["a<|endoftext|>b", "<|endoftext|>", " <|endoftext|> x<|endoftext|><|endoftext|>"]
    ids, off = library(path, True).ids(cases)
    for k, x in enumerate(cases):
        assert ids[off[k] : off[k + 1]].tolist() == t.encode(x, add_special_tokens=False).ids


def test_hash_index_finds_what_was_added():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    index = HashIndex(4)
    index.add(keys[:2000], np.arange(2000))
    index.add(keys[2000:], np.arange(2000, len(keys)))
    assert (index.find(keys) == np.arange(len(keys))).all()
    assert (index.find(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()


def test_pieces_join_to_the_text_and_words_are_equal():
    t = "word  other\n" * 50
    pieces = cut_at_spaces(t, 17)
    assert "".join(pieces) == t and max(map(len, pieces)) < 40
    h, off = word_hashes(["Alpha beta", "beta ALPHA x", ""])
    assert off.tolist() == [0, 2, 5, 5]
    assert h[0] == h[3] and h[1] == h[2] and h[4] not in h[:4]
