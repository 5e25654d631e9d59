"""Counts against the library's unigram search over the same pieces and scores."""

import math
import random
import struct

import public_tokenizers
import pytest
import sentencepiece

from quern.llm.piece_model import PieceModel, fields
from quern.llm.token_counts import TokenCounter
from tests.llm.test_sentencepiece import TEXTS, _random_texts

PATH = public_tokenizers.path("piece_bpe_32k.model")


def _var(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes((*out, n))


def _unigram(score, fallback: bool = True) -> bytes:
    """The public model's pieces as a unigram vocabulary (trainer field 3 = 1) with scores by a rule."""
    with open(PATH, "rb") as f:
        data = f.read()
    out, k = bytearray(), 0
    for n, v in fields(data):
        if n == 1:
            piece = dict(fields(v))
            if piece.get(3, 1) == 1:
                v += bytes((2 << 3 | 5,)) + struct.pack("<f", score(k, struct.unpack("<f", piece[2])[0]))
            elif piece[3] == 6 and not fallback:
                v += bytes((3 << 3, 5))
            k += 1
        elif n == 2:
            v += bytes((3 << 3, 1)) + (b"" if fallback else _var(35 << 3) + b"\0")
        out += _var(n << 3 | 2) + _var(len(v)) + v
    return bytes(out)


RULES = [lambda k, s: -math.log(k + 2), lambda k, s: max(-40_000.0, s), lambda k, s: -float(k % 7)]  # the last ties often


@pytest.mark.parametrize("rule", range(3))
@pytest.mark.parametrize("fallback", [True, False])
def test_counts_match_the_library(rule, fallback):
    model = _unigram(RULES[rule], fallback)
    lib = sentencepiece.SentencePieceProcessor(model_proto=model)
    own = TokenCounter(PieceModel.parse(model))
    for t in TEXTS + _random_texts(300):
        assert own.count(t) == len(lib.encode(t)), t
    assert own.count(None) == 0


def test_long_text_matches_the_library():
    model = _unigram(RULES[1])
    lib = sentencepiece.SentencePieceProcessor(model_proto=model)
    own = TokenCounter(PieceModel.parse(model))
    rng = random.Random(8)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it"]
    t = " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 6))) for _ in range(20_000))
    assert own.count(t) == len(lib.encode(t))
