"""Toxicity: a weighted finite-state pattern grammar over the clauses of a text.

A lexicon transducer turns tokens into classes (insult, threat, target,
negation, reporting verb, quote, clause end, other, and two classes of hostile
words, strong and weak, learned as word beginnings from the class rates over
all labelled rows of the training fold). Three small transducers,
negation, reported speech and target, each rewrite the classes of insults,
threats and learned words by what stands before them in the clause; composed, they are one
deterministic machine whose output symbols are kinds of matched clauses. How
many clauses of each kind a text has decides its score; the weights of the
output symbols are learned from labels, on rows whose own labels did not choose
the word beginnings used on them.

Defined cases: null text counts as empty; a text without a match, and so an
empty text, gets the score of texts without matches; without labels of both
classes the score is the share of toxic labels (0.5 without any); a null doc_id
is scored, reported as held out and never learned from; ids labelled both ways
are not learned from; repeated rows are scored each; a curly apostrophe counts
as a straight one.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm._base import cut, held_out, labels_of, map_texts, sigmoid, table

#: The lexicon, by class, in English, German, French and Spanish.
LEXICON = {
    "I": "idiot idiots idiotic moron morons stupid dumb fool fools loser losers clown clowns scum trash garbage pathetic disgusting worthless useless ugly jerk jerks creep vermin filth imbecile cretin bastard bastards bitch asshole assholes idiotin dummkopf trottel abschaum widerlich wertlos dumm arschloch imbécile crétin crétine ordure débile dégoûtant minable connard salaud estúpido estúpida imbécil basura asqueroso asquerosa inútil patético patética payaso escoria",
    "T": "kill murder hurt destroy stab shoot strangle beat burn crush hang töten umbringen verletzen vernichten erschießen tuer détruire blesser frapper brûler matar destruir herir golpear quemar",
    "Y": "you your yours you're youre u ur he she him his they them their du dich dir dein deine ihr euch sie tu toi vous ton ta votre tú te usted ustedes tus",
    "N": "not never no isn't aren't don't doesn't didn't wasn't won't nobody nicht kein keine nie niemals pas jamais aucun aucune nunca jamás ningún ninguna",
    "R": "said says say called calls claimed claims wrote writes quoted shouted sagte sagt nannte schrieb dit disait appelle écrit dijo dice llamó escribió",
}
CLASS = {w: c for c, words in LEXICON.items() for w in words.split()}
_WORD = re.compile(r"[^\W\d_]+")
_QUOTES = "\"“”«»"
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”«»]")
_CLAUSE = re.compile(r"[.!?;\n]")
#: Words whose class a task keeps; bounds its memory.
_KNOWN = 1 << 18
SYMBOLS = "OITYNRQBSW"
#: Classes a negation or a report turns: insult, threat, strong and weak learned words; and the same aimed at someone.
HOSTILE, AIMED = "ITSW", {"I": "J", "T": "U", "S": "X", "W": "V"}
#: Word beginnings that are counted, the parts that choose them for each other, and the most that are kept.
LENGTHS, PARTS, KEPT = (6, 5, 4, 3), 3, 20_000


class Machine:
    """A deterministic transducer: (state, symbol) to (next state, output symbol)."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def compose(self, other: Machine) -> Machine:
        """self's output is other's input."""

        def step(state, symbol):
            one, mid = self.step(state[0], symbol)
            two, out = other.step(state[1], mid)
            return (one, two), out

        return Machine((self.start, other.start), step)

    def compile(self, symbols: str) -> tuple[dict, dict]:
        """Tables over the reachable states, numbered."""
        number, todo, go, out = {self.start: 0}, [self.start], {}, {}
        while todo:
            s = todo.pop()
            for c in symbols:
                t, o = self.step(s, c)
                if t not in number:
                    number[t] = len(number)
                    todo.append(t)
                go[number[s], c], out[number[s], c] = number[t], o
        return go, out


def _negation(left: int, c: str):
    """Within three words after a negation an insult or threat is a negated one."""
    if c == "B":
        return 0, c
    if c == "N":
        return 3, c
    if c in HOSTILE and left:
        return 0, "n"
    return max(0, left - 1), c


def _report(state: int, c: str):
    """After a reporting verb, and within quotes, up to the clause's end: reported."""
    if c == "B":
        return 0, c
    if c == "R":
        return state | 1, c
    if c == "Q":
        return state ^ 2, c
    return state, "r" if c in HOSTILE and state else c


def _target(left: int, c: str):
    """Within five words after a person an insult or threat is aimed at someone."""
    if c == "B":
        return 0, c
    if c == "Y":
        return 5, c
    if c in HOSTILE and left:
        return left, AIMED[c]
    return max(0, left - 1), c


GO, OUT = Machine(0, _negation).compose(Machine(0, _report)).compose(Machine(0, _target)).compile(SYMBOLS)
#: Kinds of clauses: insult, aimed insult, threat, aimed threat, negated, reported, strong and weak learned words and the same aimed.
KINDS = "IJTUnrSXWV"


def beginnings(text: str | None) -> set[str]:
    return {w[:k] for w in set(_WORD.findall(text.lower())) if w not in CLASS for k in LENGTHS if len(w) >= k} if text else set()


class Arcs(dict):
    """The lexicon transducer's class of each word met lately: fixed words first, else the longest learned beginning."""

    def __init__(self, learned: dict[str, str] | None = None):
        super().__init__()
        self.learned = learned or {}

    def __missing__(self, word: str) -> str:
        if len(self) >= _KNOWN:
            self.clear()
        c = CLASS.get(word) or next((self.learned[word[:k]] for k in LENGTHS if len(word) >= k and word[:k] in self.learned), "O")
        self[word] = c
        return c

    def __reduce__(self):
        return Arcs, (self.learned,)


def choose(counts: np.ndarray, base: np.ndarray) -> np.ndarray:
    """S, W or nothing for beginnings standing in (toxic, other) texts, of base texts in all: by rate, where chance is ruled out."""
    pos, neg = counts[:, 0].astype(float), counts[:, 1].astype(float)
    if not base.all():
        return np.full(len(counts), "")
    n, share = np.maximum(pos + neg, 1), base[0] / base.sum()
    rate = pos / n
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = 2 * (np.where(pos > 0, pos * np.log(rate / share), 0) + np.where(neg > 0, neg * np.log((1 - rate) / (1 - share)), 0))
    sure = (rate > share) & (gain > 16)
    return np.where(sure & (rate >= 0.85), "S", np.where(sure & (rate >= 0.5), "W", ""))


def learn(known: DataFrame) -> list[dict[str, str]]:
    """Beginnings and their classes from all rows of known (_part, _y, text): from every part but each one, and last from all."""
    base = np.zeros((PARTS, 2), np.int64)
    for r in known.groupBy("_part", "_y").count().collect():
        base[r._part, 1 - r._y] = r["count"]
    if not base.sum(0).all():
        return [{}] * (PARTS + 1)
    kinds = [(part, y) for part in range(PARTS) for y in (1, 0)]
    src = known.select("_part", "_y", "text")

    def run(batches):
        for batch in batches:
            total: dict[str, list[int]] = {}
            for part, y, text in zip(*(c.to_pylist() for c in batch.columns)):
                at = kinds.index((part, y))
                for b in beginnings(text):
                    total.setdefault(b, [0] * len(kinds))[at] += 1
            cols = list(zip(*total.values())) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), *(pa.array(c, pa.int64()) for c in cols)], ["b", *(f"c{i}" for i in range(len(kinds)))])

    names = [f"c{i}" for i in range(len(kinds))]
    sums = src.mapInArrow(run, "b string, " + ", ".join(f"{c} bigint" for c in names)).groupBy("b").agg(*(F.sum(c).alias(c) for c in names))
    pos, neg = (sum((F.col(c) for c in names[i::2]), F.lit(0)) for i in (0, 1))
    top = sums.where((pos >= 3) & (pos >= 0.4 * (pos + neg))).orderBy((pos - neg).desc(), "b").limit(KEPT).collect()
    counts = np.array([list(r)[1:] for r in top], np.int64).reshape(-1, PARTS, 2)
    out = []
    for part in range(PARTS + 1):
        rest = [i for i in range(PARTS) if i != part]
        out.append({r.b: str(c) for r, c in zip(top, choose(counts[:, rest].sum(1), base[rest].sum(0))) if c})
    return out


def events(text: str | None, arcs: Arcs | dict[str, str] | None = None) -> list[int]:
    """How many clauses of each kind the whole text has; a clause counts once per kind.

    The machine is in its start state at every clause's start, so that clauses without a hostile word need no walk.
    """
    counts = [0] * len(KINDS)
    if not text:
        return counts
    arcs = arcs if isinstance(arcs, Arcs) else Arcs(arcs)
    low = text.lower().replace("’", "'")
    hostile = [w for w in set(_WORD.findall(low)) if arcs[w] in HOSTILE]
    if not hostile:
        return counts
    seen = Counter()
    for clause in _CLAUSE.split(low):
        if not any(w in clause for w in hostile):
            continue
        state, found = 0, set()
        for t in _TOKEN.findall(clause):
            c = "Q" if t in _QUOTES else arcs[t]
            found.add(OUT[state, c])
            state = GO[state, c]
        seen.update(found)
    return [seen[k] for k in KINDS]


def _design(steps: np.ndarray) -> np.ndarray:
    """Intercept, then for each kind whether it occurs and the doublings of its count beyond once, from quarters of log2(1 + count)."""
    return np.hstack([np.ones((len(steps), 1)), steps > 0, np.maximum(steps / 4 - 1, 0)]).astype(float)


def fit(counts: list[tuple[list[int], int, int]], ridge: float = 0.05) -> np.ndarray:
    """Weights by ridge logistic regression on (steps of each kind, label, rows); steps of counts keep the table small."""
    w = np.zeros(1 + 2 * len(KINDS))
    if not counts:
        return w
    steps, y, n = (np.array(v, dtype=float) for v in zip(*counts))
    x = _design(steps)
    pen = np.full(len(w), ridge)
    pen[0] = 1e-6
    if y.min() == y.max():
        w[0] = 8.0 if y[0] else -8.0
        return w
    for _ in range(100):
        p = sigmoid(x @ w)
        h = (x * (n * p * (1 - p) + 1e-12)[:, None]).T @ x + np.diag(pen)
        step = np.linalg.solve(h, x.T @ (n * (y - p)) - pen * w)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text)."""

    lab = labels_of(labels, "toxic").where(~held_out("_id", 5, 0))
    # Texts are moved once, and labelled ones kept; ids are hashed partition by partition.
    known = docs.select("doc_id", "text").where(~held_out("doc_id", 5, 0)).join(lab.hint("shuffle_hash"), F.col("doc_id") == F.col("_id"))
    known = cut(known.select("_y", F.pmod(F.xxhash64("_id"), F.lit(PARTS)).cast("int").alias("_part"), "text"))
    *parts, learned = learn(known)

    def counted(rows: DataFrame, keep: list[str], by: dict[str, str]) -> DataFrame:
        arcs = Arcs(by)
        return map_texts(rows, keep, "text", "_counts array<int>", lambda texts: [pa.array([events(t, arcs) for t in texts], pa.list_(pa.int32()))])

    seen = reduce(DataFrame.union, [counted(known.where(F.col("_part") == i), ["_y"], by) for i, by in enumerate(parts)])
    seen = seen.select("_y", F.transform("_counts", lambda c: F.round(4 * F.log2(1 + c)).cast("int")).alias("_steps"))
    w = fit([(r._steps, r._y, r.n) for r in seen.groupBy("_steps", "_y").agg(F.count("*").alias("n")).orderBy("_steps", "_y").collect()])
    x = cut(counted(docs, ["doc_id"], learned).withColumn("held_out", held_out("doc_id", 5, 0)))
    # The learned arc weights, as an expression over the clause counts.
    z = F.lit(float(w[0]))
    for i in range(len(KINDS)):
        e = F.col("_counts")[i]
        z = z + F.when(e > 0, float(w[1 + i])).otherwise(0.0) + float(w[1 + len(KINDS) + i]) * F.greatest(F.log2(1 + e) - 1, F.lit(0.0))
    s = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    return x.select("doc_id", "held_out", s.alias("score"), (s >= threshold).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
