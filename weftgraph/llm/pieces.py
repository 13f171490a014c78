"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed; its normaliser, metaspace marker, scores, byte
fallback, and for BPE models the merges that the scores imply, are rebuilt as a
tokenizers pipeline. Batches are encoded by several threads. Each task first
checks the rebuilt pipeline against the sentencepiece library on probe texts and
fails if any id differs.

Where no piece has the marker after another character, no merge crosses a
word's start; then the library encodes each new word once, and a text's ids
are its words' ids in a row, with the same result and little memory for long texts.
For the same reason short words go to a BPE model many in one string, which
spares most of the library's work for each; the ids fall apart again before markers.

Defined cases: null and empty texts have no ids and decode to the empty text;
texts that the model's normaliser changes (or with the marker itself) do not
come back unchanged, which `round_trip` says (null text: true); repeated rows
are encoded each; a null doc_id is kept.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm._base import map_texts, table

#: The marker of SentencePiece, and the piece kinds of its model format.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Stands around the numbers of pieces that no text may match: private and non-characters in a row.
_HIDDEN = "\uf8ff\U0010fffe\ue000\U0010ffff"
#: Texts on which a task compares both libraries.
PROBES = ["", " ", "a", "Hello world", "  two  spaces ", "tab\tline\n\n", "über naïve ça ñ", "▁x", "日本語 🙂 \u0000", "<s> </s> <0x0A> <unk>", " " * 37 + "x", "http://a.b/c?d=1&e=%20", "A" * 300, "1234567890 12.5e-3", "The quick brown fox; 'jumps' over \"it\"."]
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Words whose ids a task keeps, and ids in all; they bound its memory.
_KNOWN, _KNOWN_IDS = 400_000, 3_200_000
#: Characters of a word that may share a string with others, and words of such a string.
_SHORT, _JOINED = 64, 64
#: Runs laid in a row at a time; bounds what that needs beside its result.
_RUNS = 1 << 16


class _Words(dict):
    """Numbers of words in the order they were met; the words not encoded yet wait in `new`."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at


def _grown(old: np.ndarray, size: int) -> np.ndarray:
    """old with room for size values at least."""
    return old if size <= len(old) else np.concatenate([old, np.zeros(max(size, 2 * len(old)) - len(old), old.dtype)])


def _in_a_row(pool: np.ndarray, start: np.ndarray, length: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs of pool that `at` names, by their starts and lengths, one after another."""
    out = [pool[:0]]
    for k in range(0, len(at), _RUNS):
        n = length[part := at[k : k + _RUNS]]
        end = np.cumsum(n)
        out.append(pool[np.repeat(start[part] - (end - n), n) + np.arange(end[-1])])
    return np.concatenate(out)


class Codec:
    """encode and decode lists of texts by a .model file's contents."""

    def __init__(self, model: bytes, threads: int = 2):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        from sentencepiece import sentencepiece_model_pb2 as pb
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        self.pieces = [(p.piece, p.score, p.type) for p in proto.pieces]
        kind, norm = proto.trainer_spec.model_type, proto.normalizer_spec
        fallback = proto.trainer_spec.byte_fallback
        unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        if kind == BPE:
            model_ = models.BPE(vocab={p[0]: i for i, p in enumerate(self.pieces)}, merges=self._merges(), unk_token=self.pieces[unknown][0], fuse_unk=True, byte_fallback=fallback)
        elif kind == UNIGRAM:
            model_ = models.Unigram(self._surfaces(), unk_id=unknown, byte_fallback=False)
        else:
            raise ValueError(f"model type {kind} has no counterpart")
        steps = [normalizers.Precompiled(norm.precompiled_charsmap)] if norm.precompiled_charsmap else []
        if norm.remove_extra_whitespaces:
            steps += [normalizers.Strip(left=True, right=True), normalizers.Replace(Regex(" {2,}"), " ")]
        if norm.add_dummy_prefix:
            steps.append(normalizers.Prepend(MARK))
        self.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
        # With nothing but the marker to put in, plain string functions do the same, much faster.
        self.plain = len(steps) == int(norm.add_dummy_prefix)
        self.prefix = MARK if norm.add_dummy_prefix else ""
        # A piece with the marker inside would be cut apart at words' starts.
        self.apart = not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, t in self.pieces if t in (NORMAL, USER))
        # A unigram's unknown runs are spelled out here, since its byte pieces are no surfaces to match.
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == BYTE} if kind == UNIGRAM and fallback else {}
        self.unknown = unknown
        self.core = Tokenizer(model_)
        # The ids of a string of several words fall apart where a piece begins with the marker and the one before is no run of markers.
        named = [p if t in (NORMAL, USER, UNUSED) else "<>" for p, _, t in self.pieces]
        self.joins = kind == BPE and MARK in named and not any(re.search(f"[^{MARK}]{MARK}", p) for p in named)
        self.marked = np.array([p.startswith(MARK) for p in named])
        self.blank = np.array([not p.strip(MARK) for p in named])
        self._forget()
        self.spelled = [bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(MARK, " ").encode() for p, _, t in self.pieces]
        self.letters = np.frombuffer(b"".join(self.spelled), np.uint8)
        self.n_letters = np.array([len(x) for x in self.spelled])
        self.letters_at = np.cumsum(self.n_letters) - self.n_letters
        strip = [decoders.Strip(" ", 1, 0)] if norm.add_dummy_prefix else []
        # Decoding goes by the pieces' own names.
        self.back = Tokenizer(models.BPE(vocab={p[0]: i for i, p in enumerate(self.pieces)}, merges=[])) if kind == UNIGRAM else self.core
        self.back.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])

    def _merges(self) -> list[tuple[str, str]]:
        """Each split of a piece into two pieces, best score first, as the scores rank the merged piece."""
        score = {p: (-s, i) for i, (p, s, t) in enumerate(self.pieces) if t in (NORMAL, USER, UNUSED)}
        found = [(*score[p], score[a][1], score[b][1], a, b) for p in score for k in range(1, len(p)) if (a := p[:k]) in score and (b := p[k:]) in score]
        return [(a, b) for *_, a, b in sorted(found)]

    def _surfaces(self) -> list[tuple[str, float]]:
        """Surfaces and scores of a unigram's pieces: only normal and user-defined ones can be matched in a text.

        A user-defined piece scores its bytes times the best score, which counts as a tenth at least, less a tenth.
        Others keep their ids under a surface that no text holds, with a score that leaves the least one as it is.
        """
        best = max((s for _, s, t in self.pieces if t == NORMAL), default=0.0)
        out = []
        for i, (p, s, t) in enumerate(self.pieces):
            out.append((p, s) if t == NORMAL else (p, len(p.encode()) * max(best, 0.1) - 0.1) if t == USER else (f"{_HIDDEN}{i}{_HIDDEN}", best))
        return out

    def _ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of normalised texts; runs of unknown characters as bytes where the model has them."""
        if not self.bytes:
            return [e.ids for e in self.core.encode_batch_fast(texts, add_special_tokens=False)]
        out = []
        for text, e in zip(texts, self.core.encode_batch(texts, add_special_tokens=False)):
            ids = e.ids
            if self.unknown in ids:
                spans = zip(ids, e.offsets)
                ids = list(chain.from_iterable([self.bytes[x] for x in text[a:b].encode()] if i == self.unknown else (i,) for i, (a, b) in spans))
            out.append(ids)
        return out

    def normalize(self, text: str | None) -> str:
        if not text:
            return ""
        return self.prefix + text.replace(" ", MARK) if self.plain else self.normalizer.normalize_str(text)

    def encode(self, texts: list) -> list[list[int]]:
        ids, ends = self.encode_in_a_row(texts)
        return [x.tolist() for x in np.split(ids, ends[:-1])] if texts else []

    def encode_in_a_row(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's end."""
        if not self.apart:
            return self._flat([self.normalize(t) for t in texts])
        return self._encode_words(texts)

    def _flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._ids(texts)
        ends = np.cumsum([len(x) for x in ids], dtype=np.int64)
        return np.fromiter(chain.from_iterable(ids), np.int32, ends[-1] if len(ends) else 0), ends

    def _words(self, text: str) -> list[str]:
        """Words of a normalised text, each with the markers before it."""
        if not text or MARK + MARK in text:
            return _WORDS.findall(text)
        words = text.replace(MARK, " " + MARK).split(" ")  # a normalised text has no spaces
        return words if words[0] else words[1:]

    def _encode_words(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Each word not met lately is encoded once, all of a batch's in one call; a text's ids are its words' in a row."""
        if len(self.known) > _KNOWN or self.used > _KNOWN_IDS:
            self._forget()
        words = [self._words(self.normalize(t)) for t in texts]
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.int64, ends[-1] if len(ends) else 0)
        if self.known.new:
            self._learn(self.known.new)
        n = np.concatenate([[0], np.cumsum(self.length[at])])
        return _in_a_row(self.pool, self.start, self.length, at), n[ends]

    def _forget(self) -> None:
        self.known, self.used = _Words(), 0
        self.start, self.length, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _learn(self, new: list[str]) -> None:
        """Put the ids of new words, which are the last of the known ones, behind the others."""
        short = [self.joins and len(w) <= _SHORT and w[0] == MARK and w[-1] != MARK for w in new]
        order = np.argsort(~np.array(short), kind="stable")
        words = [new[i] for i in order.tolist()]
        n_short = sum(short)
        ids, ends = (np.concatenate(x) for x in zip(self._joined(words[:n_short]), self._flat(words[n_short:])))
        ends[n_short:] += ends[n_short - 1] if n_short else 0
        size, used = len(self.known), self.used + len(ids)
        self.start, self.length, self.pool = _grown(self.start, size), _grown(self.length, size), _grown(self.pool, used)
        starts = np.concatenate([[0], ends[:-1]])
        self.start[size - len(new) + order] = self.used + starts
        self.length[size - len(new) + order] = ends - starts
        self.pool[self.used : used] = ids
        self.used = used
        new.clear()

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that begin, but do not end, with the marker, many in one string, and where each word's end."""
        ids, _ = self._flat(["".join(words[k : k + _JOINED]) for k in range(0, len(words), _JOINED)])
        first = self.marked[ids]
        first[1:] &= ~self.blank[ids[:-1]]
        starts = np.flatnonzero(first)
        if len(starts) != len(words):
            raise ValueError(f"{len(words)} words came back as {len(starts)}")
        return ids, np.append(starts[1:], len(ids)) if words else starts

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts of ids: the pieces' bytes in a row. What is no UTF-8 goes to the library, which marks the odd bytes."""
        out = []
        for x in ids:
            try:
                text = b"".join(map(self.spelled.__getitem__, x)).decode("utf-8")
            except UnicodeDecodeError:
                text = self.back.decode(x, skip_special_tokens=False)
            else:
                text = text[1:] if self.prefix and text.startswith(" ") else text
            out.append(text)
        return out

    def comes_back(self, texts: list, ids: np.ndarray, ends: np.ndarray) -> list[bool]:
        """Whether the ids decode to the texts. Bytes are compared first; decode() has the word on those that differ."""
        n = np.concatenate([[0], np.cumsum(self.n_letters[ids])])[ends].tolist()
        data = _in_a_row(self.letters, self.letters_at, self.n_letters, ids).tobytes()
        out, a, i = [], 0, 0
        for text, b, j in zip(texts, n, ends.tolist()):
            text, cut = text or "", a + bool(self.prefix and data.startswith(b" ", a, b))
            out.append(data[cut:b] == text.encode() or self.decode([ids[i:j].tolist()])[0] == text)
            a, i = b, j
        return out

    def verify(self, model: bytes, probes: list[str] = PROBES) -> None:
        """Raise if an id differs from the sentencepiece library's."""
        import sentencepiece

        whole = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = self.encode(probes)
        for text, mine, theirs in zip(probes, ids, whole.encode(probes, num_threads=1)):
            if mine != theirs:
                raise ValueError(f"ids of {text[:40]!r} differ: {mine[:12]} and {theirs[:12]}")
        for x, mine, theirs in zip(ids, self.decode(ids), self.back.decode_batch(ids, skip_special_tokens=False)):
            if mine != theirs:
                raise ValueError(f"texts of {x[:12]} differ: {mine[:40]!r} and {theirs[:40]!r}")


@lru_cache(maxsize=2)
def codec(model: bytes, threads: int) -> Codec:
    c = Codec(model, threads)
    c.verify(model)
    return c


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, keep: list[str], model_path: str | None = None, threads: int = 2) -> DataFrame:
    """keep columns, n_tokens, ids and round_trip. The model (its size is checked) travels with the tasks."""
    with open(model_path or default_model(), "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError("a model of over 64 MB is not sent to every task")
    model = docs.sparkSession.sparkContext.broadcast(data)

    def run(texts: list) -> list[pa.Array]:
        c = codec(model.value, threads)
        ids, ends = c.encode_in_a_row(texts)
        same = c.comes_back(texts, ids, ends)
        starts = np.concatenate([[0], ends])
        lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))
        return [pa.array(np.diff(starts), pa.int64()), lists, pa.array(same, pa.bool_())]

    return map_texts(docs, keep, "text", "n_tokens bigint, ids array<int>, round_trip boolean", run, rows=64)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", F.col("text")), ["doc_id"])
