import random

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from weftgraph.llm import pieces


def model(fallback=True, user=()):
    """A unigram model built by hand, with every kind of piece."""
    m = pb.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = 1, fallback
    n = m.normalizer_spec
    n.name, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces = "identity", True, False, True
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    rows += [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)] if fallback else []
    rows += [(u, 0.0, 4) for u in user]
    rows += [("never", -1.0, 5), ("▁", -2.0, 1), ("▁he", -3.0, 1), ("llo", -4.0, 1), ("▁hello", -9.5, 1), ("ne", -4.5, 1), ("<", -7.0, 1), (">", -7.0, 1), ("s", -5.5, 1), ("/", -6.0, 1), ("0x4", -6.5, 1), ("1", -6.0, 1)]
    rows += [(c, -5.0 - i / 10, 1) for i, c in enumerate("helontrv")]
    for p, s, t in rows:
        x = m.pieces.add()
        x.piece, x.score, x.type = p, s, t
    return m.SerializeToString()


@pytest.mark.parametrize("fallback", [True, False])
def test_ids_equal_the_librarys_whatever_the_text_holds(fallback):
    data = model(fallback)
    c, whole = pieces.Codec(data, 1), sentencepiece.SentencePieceProcessor(model_proto=data)
    r = random.Random(1)
    parts = ["hello", "never", "</s>", "<s>", "<unk>", "<0x41>", " ", "  ", "é", "日本", "🙂", "lo", "x", "A", "▁", "\n", "1", "0x4", "r"]
    texts = ["", *parts, *("".join(r.choice(parts) for _ in range(r.randrange(1, 12))) for _ in range(400))]
    assert c.encode(texts) == whole.encode(texts, num_threads=1)
    if fallback:
        c.verify(data)
        assert [d for d in c.decode(c.encode(texts))] == [t.replace("▁", " ") for t in texts]


def test_user_defined_pieces_come_first():
    data = model(user=("<tag>", "ello"))
    c, whole = pieces.Codec(data, 1), sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = ["hello", "a<tag>b", "<tag><tag>", "hell <tag> ello"]
    assert c.encode(texts) == whole.encode(texts, num_threads=1)


def test_ids_of_the_given_documents_equal_the_librarys(spark):
    """Parity over whole texts of a table, not only round trips."""
    with open(pieces.default_model(), "rb") as f:
        data = f.read()
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    assert pieces.Codec(data, 2).encode(texts) == sentencepiece.SentencePieceProcessor(model_proto=data).encode(texts, num_threads=2)
