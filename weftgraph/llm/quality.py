"""Quality classifier: regularised quadratic discriminant over document statistics.

Each class gets a Gaussian over transformed statistics of the whole text. Its
covariance is shrunk towards the pooled one and towards a scaled identity; the
score is the Mahalanobis log-density difference, with Cholesky factors computed
once on the driver, passed through a logistic fit of the same difference.

Defined cases: a null text counts as empty; an empty text has all statistics
zero and is scored like any other; without labels of both classes every score is
0.5; a null doc_id is scored, reported as held out and never learned from; ids
labelled both ways are not learned from; repeated rows are scored each.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm._base import cut, held_out, labels_of, map_texts, platt, sigmoid, table

#: The byte sets counted as features.
GROUPS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "stop": b".,;:?'\"()-",
    "bang": b"!",
    "pipe": b"|",
    "symbol": b"#$%&*<>=@[]\\^_`{}~+/",
    "line": b"\n",
}
_MASK = np.zeros((256, len(GROUPS)), dtype=np.float64)
for _j, _g in enumerate(GROUPS.values()):
    _MASK[list(_g), _j] = 1.0
NAMES = ["log_words", "word_length", "distinct", "top_word", "adjacent", "ends_symbol", *GROUPS]
P = len(NAMES)


def _statistics(raw: bytes | None) -> np.ndarray:
    x = np.zeros(P)
    if not raw:
        return x
    words = raw.split()
    n = len(words)
    hist = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    share = hist @ _MASK / len(raw)
    x[6:] = np.log(share + 1e-3) - np.log(1e-3)
    if n:
        seen = Counter(words)
        x[0] = np.log1p(n)
        x[1] = np.log(len(raw) / n)
        # Distinct words against what a text of this length has at most: near 0 for ordinary prose.
        x[2] = np.log(len(seen) + 1.0) / np.log(n + 1.0)
        x[3] = np.sqrt(max(seen.values()) / n) if n > 1 else 0.0
        x[4] = np.sqrt(sum(map(eq, words, words[1:])) / n)
        x[5] = np.sqrt(sum(c for w, c in seen.items() if w[-1] in b"#$%&*!|") / n)
    return x


def features(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep columns and `_x`, the transformed statistics of the whole text."""

    def run(texts: list) -> list[pa.Array]:
        m = np.stack([_statistics(t) for t in texts]) if texts else np.zeros((0, P))
        return [pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * P, pa.array(m.ravel()))]

    return map_texts(df, keep, text, "_x array<double>", run, as_bytes=True)


def _moments(batches):
    """Per label and task: count, sums and products of the statistics, packed in one array."""
    acc = {}
    for b in batches:
        y = b.column("_y").to_numpy(zero_copy_only=False)
        x = b.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(-1, P)
        z = np.hstack([np.ones((len(x), 1)), x])
        for c in np.unique(y):
            m = z[y == c]
            acc[int(c)] = acc.get(int(c), 0) + m.T @ m
    if acc:
        yield pa.RecordBatch.from_arrays([pa.array(list(acc), pa.int32()), pa.array([v.ravel().tolist() for v in acc.values()], pa.list_(pa.float64()))], ["y", "m"])


class Model:
    """Means, inverse Cholesky factors, log determinants and the calibration line."""

    def __init__(self, moments: dict[int, np.ndarray], shrink: float, ridge: float):
        self.line = (1.0, 0.0)
        self.ok = len(moments) == 2 and min(m[0, 0] for m in moments.values()) > 1
        if not self.ok:
            return
        n = {c: m[0, 0] for c, m in moments.items()}
        mean = {c: m[0, 1:] / n[c] for c, m in moments.items()}
        cov = {c: m[1:, 1:] / n[c] - np.outer(mean[c], mean[c]) for c, m in moments.items()}
        pooled = sum(cov[c] * n[c] for c in cov) / sum(n.values())
        self.mean, self.inv, self.const = mean, {}, {}
        for c in cov:
            s = (1 - shrink) * cov[c] + shrink * pooled
            s = (1 - ridge) * s + ridge * np.diag(np.diag(pooled)) + 1e-4 * np.eye(P)
            low = np.linalg.cholesky(s)
            self.inv[c] = np.linalg.inv(low)
            self.const[c] = -np.log(np.diag(low)).sum() + np.log(n[c] / sum(n.values()))

    def difference(self, x: np.ndarray) -> np.ndarray:
        if not self.ok:
            return np.zeros(len(x))
        d = [self.const[c] - 0.5 * (((x - self.mean[c]) @ self.inv[c].T) ** 2).sum(1) for c in (0, 1)]
        return np.clip(d[1] - d[0], -60, 60)

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.line[0] * self.difference(x) + self.line[1]) if self.ok else np.full(len(x), 0.5)


def fit(train: DataFrame, shrink: float = 0.1, ridge: float = 0.02) -> Model:
    """train has _x and _y (0/1). All its rows count: only class moments and a 241-bin histogram reach the driver."""
    sums = train.select("_y", "_x").mapInArrow(_moments, "y int, m array<double>").select("y", F.posexplode("m").alias("i", "v")).groupBy("y", "i").agg(F.sum("v").alias("v"))
    moments: dict[int, np.ndarray] = {}
    for r in sums.collect():
        moments.setdefault(r.y, np.zeros((P + 1) ** 2))[r.i] = r.v
    model = Model({c: m.reshape(P + 1, P + 1) for c, m in moments.items()}, shrink, ridge)
    if model.ok:

        def bins(batches):
            h = np.zeros((2, 241), dtype=np.int64)
            for b in batches:
                x = b.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(-1, P)
                d = np.rint(model.difference(x) * 2).astype(int) + 120
                np.add.at(h, (b.column("_y").to_numpy(zero_copy_only=False), d), 1)
            y, d = np.nonzero(h)
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(d, pa.int32()), pa.array(h[y, d], pa.int64())], ["y", "d", "n"])

        h = np.zeros((2, 241))
        for r in train.select("_y", "_x").mapInArrow(bins, "y int, d int, n long").groupBy("y", "d").agg(F.sum("n").alias("n")).collect():
            h[r.y, r.d] = r.n
        model.line = platt((np.arange(241) - 120) / 2.0, h[1], h[0])
    return model


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text); texts are read once."""
    x = cut(features(docs, ["doc_id"]).withColumn("held_out", held_out("doc_id", 4, 2)))
    train = cut(x.where(~F.col("held_out")).join(labels_of(labels, "quality"), F.col("doc_id") == F.col("_id")).select("_x", "_y"))
    model = fit(train)

    def run(batches):
        for b in batches:
            s = model.score(b.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(-1, P))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return x.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with their columns, that the classifier does not reject."""
    x = features(docs.where(~held_out("doc_id", 4, 2)), ["doc_id"])
    model = fit(cut(x.join(labels_of(labels, "quality"), F.col("doc_id") == F.col("_id")).select("_x", "_y")))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                texts = part.column("text").to_pylist()
                x = np.stack([_statistics(t.encode("utf-8", "replace") if t else None) for t in texts])
                yield part.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
