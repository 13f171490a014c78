"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are folded to lower-case letters, all else to a space; bigrams and
trigrams inside words are hashed into buckets. The log-probability matrix is
broadcast; a batch is scored by gathering its buckets' rows and summing them
for each document.

Defined cases: null text, or text without a letter: `und`, score 0; without a
row to learn from, every text is `und`, score 0; null langs and null doc_ids
are never learned from; a null doc_id is scored and reported as held out;
languages with equal scores: the first in code point order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm._base import held_out, map_texts, table

BITS = 15
#: Code points worked on at once; bounds memory on very long texts.
_PIECE = 1 << 20
_FOLD: np.ndarray | None = None


def _letter(c: str) -> int:
    return ord(c.lower()[0]) if c.isalpha() else 0


def _codes(text: str) -> np.ndarray:
    """Lower-case letters, 0 for all else."""
    global _FOLD
    if _FOLD is None:
        _FOLD = np.array([_letter(chr(i)) for i in range(1 << 16)], dtype=np.uint32)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out = _FOLD[np.minimum(c, 0xFFFF)]
    if (high := c > 0xFFFF).any():
        for x in np.unique(c[high]):
            out[c == x] = _letter(chr(x))
    return out


def _grams(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and position of every bigram and trigram of letters and word edges."""
    a, b, d = c[:-2], c[1:-1], c[2:]
    two = np.flatnonzero((a | b) != 0)
    three = np.flatnonzero((b != 0) & ((a | d) != 0))
    h2 = a[two] * np.uint32(0x9E3779B1) ^ (b[two] * np.uint32(0x85EBCA77) + np.uint32(17))
    h3 = (a[three] * np.uint32(0x9E3779B1) + b[three]) * np.uint32(0x85EBCA77) ^ d[three] * np.uint32(0xC2B2AE3D)
    mix = lambda h: ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)
    return np.concatenate([mix(h2), mix(h3)]), np.concatenate([two, three])


def _pieces(texts: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of each text, its codes) for whole texts, in runs of about _PIECE code points."""
    rows, codes, size = [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, len(t or ""), _PIECE):
            # The last two letters of a piece begin the next one, so each n-gram counts once.
            part = t[max(0, at - 2) : at + _PIECE]
            edge = (np.zeros(2 if at == 0 else 0, dtype=np.uint32), np.zeros(2 if at + _PIECE >= len(t) else 0, dtype=np.uint32))
            c = np.concatenate([edge[0][:1], _codes(part), edge[1]])
            rows.append(i)
            codes.append(c)
            size += len(c)
            if size >= _PIECE:
                yield rows, codes
                rows, codes, size = [], [], 0
    if rows:
        yield rows, codes


def _buckets(texts: list) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of the texts, then for every n-gram its bucket and its place in that list of rows."""
    for rows, codes in _pieces(texts):
        h, at, letters = [], [], []
        for k, c in enumerate(codes):
            letters.append(bool(c.any()))
            g = _grams(c)[0] if len(c) > 2 else np.zeros(0, dtype=np.uint32)
            h.append(g)
            at.append(len(g))
        yield rows, np.concatenate(h), np.array(at), np.array(letters)


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, docs: np.ndarray, smooth: float):
        self.langs = langs
        total = counts.sum(1, keepdims=True)
        self.log_p = np.log((counts + smooth) / (total + smooth * counts.shape[1])).astype(np.float32)
        self.prior = np.log(docs / docs.sum())

    def score(self, texts: list) -> tuple[list, np.ndarray]:
        n, langs = len(texts), len(self.langs)
        total, letters = np.zeros((n, langs)), np.zeros(n, dtype=bool)
        for rows, h, sizes, has in _buckets(texts):
            rows = np.array(rows)
            np.logical_or.at(letters, rows, has)
            some = sizes > 0
            if langs and some.any():
                starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
                for j in range(langs):
                    np.add.at(total[:, j], rows[some], np.add.reduceat(self.log_p[j][h], starts, dtype=np.float64))
        if not langs:
            return ["und"] * n, np.zeros(n)
        z = total + self.prior
        best = z.argmax(1)
        p = 1.0 / np.exp(z - z.max(1, keepdims=True)).sum(1)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, letters)], np.where(letters, p, 0.0)


def fit(train: DataFrame, sample: int = 20000, smooth: float = 0.1, most: int = 1000) -> Model:
    """train (doc_id, text, lang). About `sample` rows, drawn by a hash of the id, the same number of each language
    (all of a language with fewer), are learned from, each as a whole; priors are of all rows.

    What reaches the driver is one count per language and bucket; more than `most` languages are an error, since the
    matrix of their log probabilities goes to every task.
    """
    rows = {r.lang: r["count"] for r in train.groupBy(F.col("lang").cast("string").alias("lang")).count().limit(most + 1).collect()}
    if len(rows) > most:
        raise ValueError(f"more than {most} languages: their matrix would be over {most * (1 << BITS) * 4 >> 20} MB")
    if rows:
        each = F.create_map(*[x for lang, n in rows.items() for x in (F.lit(lang), F.lit(min(1.0, sample / len(rows) / n)))])
        draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(10)), F.lit(1 << 30))
        train = train.where(draw < F.lit(1 << 30) * F.element_at(each, F.col("lang").cast("string")))

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                langs, texts = part.column("lang").to_pylist(), part.column("text").to_pylist()
                for lang in langs:
                    docs[lang] = docs.get(lang, 0) + 1
                for rows, h, sizes, _ in _buckets(texts):
                    ends = np.cumsum(sizes)
                    for r, end, size in zip(rows, ends, sizes):
                        c = counts.setdefault(langs[r], np.zeros(1 << BITS, dtype=np.int64))
                        np.add.at(c, h[end - size : end], 1)
        for lang, k in docs.items():
            c = counts.get(lang, np.zeros(1 << BITS, dtype=np.int64))
            i = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(i) + 1)), pa.array(np.append(i, -1), pa.int32()), pa.array(np.append(c[i], k), pa.int64())], ["lang", "i", "n"])

    sums = train.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(run, "lang string, i int, n long").groupBy("lang", "i").agg(F.sum("n").alias("n")).toArrow()
    lang, i, k = (sums.column(c).to_numpy() for c in ("lang", "i", "n"))
    langs = sorted(set(lang.tolist()))
    row = np.array([langs.index(x) for x in lang], dtype=int) if langs else np.zeros(0, dtype=int)
    counts, docs = np.zeros((len(langs), 1 << BITS)), np.array([float(rows[x]) for x in langs])
    counts[row[i >= 0], i[i >= 0]] = k[i >= 0]
    return Model(langs, counts, docs, smooth)


def identify(docs: DataFrame, sample: int = 20000) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs (doc_id, text, lang)."""
    out = held_out("doc_id", 5, 0)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.where(~out & F.col("lang").isNotNull()), sample))

    def run(texts: list) -> list[pa.Array]:
        lang, score = model.value.score(texts)
        return [pa.array(lang, pa.string()), pa.array(score)]

    return map_texts(docs.withColumn("held_out", out), ["doc_id", "held_out"], "text", "lang_pred string, score double", run, rows=256)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
