"""The codec against the sentencepiece library: exact ids, text and source spans."""

import random

import public_tokenizers
import pytest
import sentencepiece

from quern.llm.piece_model import PieceModel, fields
from quern.llm.sentencepiece_codec import Codec

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", " ", "  ", "a", " a", "a ", "a  b   c", "\ta\nb\r\n", "▁x", "x▁ ▁y", "é́ﬁ ２０２４ ＡＢＣ", "\x00a", "　全角　空白 text",
    "a\xa0b", "naïve café 😀 👩‍👩‍👧", "hello world " * 50, "x" * 3000, "ab" * 400, "the​zero", "Ⅳ ½ ㌔", "한국어 텍스트",
    "‮right‬", "&lt;s&gt; <s> </s> <unk> <0x41>", "日本語のテキスト", "1234567890 12,345.67", "\U0010ffff", "ạ́",
]


def _swap(data: bytes, number: int, value: bytes) -> bytes:
    """The model with field ``number`` (a message) replaced."""
    out, at = bytearray(), 0

    def var(n):
        b = bytearray()
        while n > 127:
            b.append(n & 127 | 128)
            n >>= 7
        b.append(n)
        return bytes(b)

    for n, v in fields(data):
        v = value if n == number else v
        out += var(n << 3 | 2) + var(len(v)) + v
    return bytes(out)


def _settings(data: bytes, **flags) -> bytes:
    """Normaliser settings of the model with other flags (numbers of varint fields)."""
    return data + b"".join(bytes((n << 3, v)) for n, v in flags.items())


def _random_texts(n, seed=5):
    rng = random.Random(seed)
    chars = "abcdefgh   \n\t▁éñüß日本語😀́ﬁＡ０1.,'\"<>" + "e" * 5 + " " * 5
    return ["".join(rng.choice(chars) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


def _check(data: bytes, texts):
    lib = sentencepiece.SentencePieceProcessor(model_proto=data)
    own = Codec(PieceModel.parse(data))
    for t in texts:
        ids, starts, ends = own.encode(t, eos=False)
        assert ids.tolist() == lib.encode(t), t
        assert own.decode(ids) == lib.decode(lib.encode(t)), t
        assert own.decode([*ids.tolist(), own.model.eos_id]) == lib.decode([*lib.encode(t), lib.eos_id()]), t
        size = len(t.encode())
        assert all(0 <= a <= b <= size for a, b in zip(starts, ends))
        assert all(x <= y for x, y in zip(starts[:-1], starts[1:]))


def test_public_model_matches_library():
    with open(PATH, "rb") as f:
        _check(f.read(), TEXTS + _random_texts(400))


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("flags", [(1, 1), (1, 0), (0, 1), (0, 0)])
def test_character_maps_match_library(rule, flags):
    """The same vocabulary behind the library's compiled character maps."""
    with open(PATH, "rb") as f:
        data = f.read()
    norm = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=bool(flags[0]), remove_extra_whitespaces=bool(flags[1]), escape_whitespaces=True)
    spec = next(v for n, v in fields(norm.serialized_model_proto()) if n == 3)
    _check(_swap(data, 3, spec), TEXTS + _random_texts(150))


def test_spans_cover_the_source():
    """Without a character map every source byte lies in exactly one piece."""
    own = Codec(PieceModel.read(PATH))
    for t in TEXTS + _random_texts(200, 9):
        ids, starts, ends = own.encode(t, eos=False)
        raw, at = t.encode(), 0
        for k, (i, a, b) in enumerate(zip(ids, starts, ends)):
            if (a, b) == (starts[k - 1], ends[k - 1]) and k and own.model.pieces[i].startswith("<0x") and own.model.pieces[ids[k - 1]].startswith("<0x") and a < at:
                continue  # a further byte of the same character
            assert a == at
            at = b
            if not own.model.pieces[i].startswith("<0x"):
                marked = raw[a:b].decode().replace(" ", "▁")
                assert own.model.pieces[i] == marked or a == 0 and own.model.pieces[i] == "▁" + marked
        assert at == len(raw)


def test_invalid_bytes_decode_like_the_library():
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    own = Codec(PieceModel.read(PATH))
    rng = random.Random(3)
    for _ in range(300):
        ids = [rng.randrange(3, 259) if rng.random() < 0.6 else rng.randrange(259, 32000) for _ in range(rng.randrange(0, 12))]
        assert own.decode(ids) == lib.decode(ids), ids
    assert own.encode(None)[0].tolist() == [2]


def test_batched_merges_agree_with_single_ones():
    one, many = Codec(PieceModel.read(PATH)), Codec(PieceModel.read(PATH))
    texts = TEXTS + _random_texts(500, 21)
    many.learn(texts)
    assert len(many._known) > 500
    for chunk, ids in many._known.items():
        assert one._chunk(chunk) == ids, chunk


def test_round_trip_is_told_without_the_text(spark, monkeypatch):
    from quern.llm import sentencepiece_codec
    from quern.llm.queries import tokenizer_path
    from quern.llm.sentencepiece_codec import _cuts, encode

    docs = spark.createDataFrame([(1, "two  words\n"), (2, None), (3, ""), (4, "� á \U0001f600"), (5, " lead")], "doc_id long, text string")
    both = {r["doc_id"]: r for r in encode(docs, tokenizer_path(), decoded=True).collect()}
    told = encode(docs, tokenizer_path(), round_trip=True)
    assert told.columns == ["doc_id", "ids", "starts", "ends", "round_trip"]
    for r in told.collect():
        b = both[r["doc_id"]]
        assert (r["ids"], r["starts"], r["ends"], r["round_trip"]) == (b["ids"], b["starts"], b["ends"], b["decoded"] == (b["text"] or ""))
    monkeypatch.setattr(sentencepiece_codec, "BYTES_AT_ONCE", 10)
    monkeypatch.setattr(sentencepiece_codec, "TEXTS_AT_ONCE", 3)
    assert list(_cuts([0, 0, 0, 0, 30, 4, 6, 1])) == [(0, 3), (3, 4), (4, 5), (5, 7), (7, 8)] and not list(_cuts([]))
