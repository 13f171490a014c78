import random

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from weftgraph.llm import pieces


def model(prefix=True, fallback=True):
    """The default model, without its prefix, or without byte pieces to fall back on."""
    m = pb.ModelProto()
    with open(pieces.default_model(), "rb") as f:
        m.ParseFromString(f.read())
    m.normalizer_spec.add_dummy_prefix = prefix
    if not fallback:
        m.trainer_spec.byte_fallback = False
        kept = [p for p in m.pieces if p.type != pieces.BYTE]
        del m.pieces[:]
        m.pieces.extend(kept)
    return m.SerializeToString()


def odd_texts():
    r = random.Random(3)
    parts = ["ab", "word", "The", " ", " ", " ", "  ", "▁", "\n", "é", "日", "🙂", "\u0000", "<s>", "<0x41>", "x" * 70, ".", "12"]
    return ["", None, " ", "   ", "a ", " a", "a  b ", "▁▁", *("".join(r.choice(parts) for _ in range(r.randrange(60))) for _ in range(600))]


def test_short_words_go_to_the_library_many_in_one_string():
    c = pieces.Codec(model(), 1)
    strings, ids = [], c._ids
    c._ids = lambda texts: strings.extend(texts) or ids(texts)
    words = [f"{a}{b}{d}" for a in "bcdfgklm" for b in ("an", "ero", "ity", "ong") for d in ("t", "s.", "ly,", "al")]
    text = " ".join(words)
    assert c.encode([text, text]) == sentencepiece.SentencePieceProcessor(model_proto=model()).encode([text, text], num_threads=1)
    assert len(strings) <= len(set(words)) // 10


@pytest.mark.parametrize("prefix", [True, False])
@pytest.mark.parametrize("fallback", [True, False])
def test_joined_words_get_the_librarys_ids(prefix, fallback):
    data = model(prefix, fallback)
    c, texts = pieces.Codec(data, 1), odd_texts()
    assert c.joins
    assert c.encode(texts) == sentencepiece.SentencePieceProcessor(model_proto=data).encode([t or "" for t in texts], num_threads=1)


def test_small_store_of_words_changes_nothing(monkeypatch):
    data, texts = model(), odd_texts()
    whole = pieces.Codec(data, 1).encode(texts)
    monkeypatch.setattr(pieces, "_KNOWN", 20)
    monkeypatch.setattr(pieces, "_RUNS", 7)
    c = pieces.Codec(data, 1)
    assert [x for k in range(0, len(texts), 5) for x in c.encode(texts[k : k + 5])] == whole
    assert len(c.known) < 300


@pytest.mark.parametrize("prefix", [True, False])
def test_comes_back_says_what_decoding_says(prefix):
    c, texts = pieces.Codec(model(prefix), 1), odd_texts()
    ids, ends = c.encode_in_a_row(texts)
    same = c.comes_back(texts, ids, ends)
    assert same == [(t or "") == d for t, d in zip(texts, c.decode(c.encode(texts)))]
    assert True in same and False in same
    ids[-3] = (ids[-3] + 1) % len(c.pieces)  # another id in the last text
    assert c.comes_back(texts, ids, ends)[:-1] == same[:-1] and not c.comes_back(texts, ids, ends)[-1]
