"""Pairs of texts whose sets of word shingles are alike, found exactly by prefix filtering.

All shingles stand in one order over the whole corpus, seldom ones first. Two
sets of Jaccard similarity t or more share a shingle among the first
n - ceil(t n) + 1 of each, so only those are dealt out as keys. Any order gives
the same pairs; repetitions met within batches of the whole corpus only keep
common passages out of the keys.

The rows of a key are first compared with one of them (stars), which joins large
groups of near copies without their pairs. What the components then leave open
are pairs of different components under one key: the rows outside a key's
largest component against all of its rows, ruled out by size, position and a
parity bitmap of the set (its distance never exceeds the sets' difference), and
compared on the whole sets only when neither rules them out. A key of many comparisons
is split by the next shingle that a pair must share as well (it stands within
the first n - ceil(t n) + 2), where that makes fewer of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._base import cut, drop_cut, map_texts
from weftgraph.llm._graph import components

#: The most counts of common shingles kept for the order, which decides the work, not the result.
COMMON = 100_000
#: A key of more comparisons than the square of this may be split by a further shingle.
SPLIT = 256
#: 64-bit words of a set's parity bitmap.
BITS = 8
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
#: Bytes that are hashed at once; longer texts are cut between words.
_PIECE = 1 << 16
#: For each byte, lower-cased: whether it is white space, and a random number.
_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_RANDOM = np.random.default_rng(11).integers(0, 1 << 64, 256, np.uint64)
_RANDOM[ord("A") : ord("Z") + 1] = _RANDOM[ord("a") : ord("z") + 1]
_RANDOM[_SPACE] = 0
_BASE, _INVERSE = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)


@lru_cache(maxsize=None)
def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _ODD[1]
    return h ^ (h >> np.uint64(32))


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word (between ASCII white space, A-Z lower-cased), and where each starts.

    A word's hash is its bytes' polynomial, a difference of the buffer's running sums brought back to its start.
    """
    b = np.frombuffer(raw, np.uint8)
    size = 1 << max(16, len(b).bit_length())
    gap = np.r_[True, _SPACE[b], True]
    start, end = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    sums = np.r_[np.uint64(0), np.cumsum(_RANDOM[b] * _powers(_BASE, size)[: len(b)])]
    return _mixed((sums[end] - sums[start]) * _powers(_INVERSE, size)[start]), start


def _pieces(raw: bytes) -> Iterator[bytes]:
    """raw cut between words into pieces of about _PIECE bytes."""
    at = 0
    while len(raw) - at > _PIECE:
        end = at + _PIECE
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        yield raw[at:end]
        at = end
    yield raw[at:]


def _shingles(v: np.ndarray, words: int) -> np.ndarray:
    """A hash of each run of so many word hashes."""
    h = np.full(len(v) - words + 1, words, np.uint64)
    for j in range(words):
        h = (h ^ (h >> np.uint64(31))) * _ODD[j % len(_ODD)] + v[j : len(v) - words + 1 + j]
    return _mixed(h).view(np.int64)


def hashes(texts: list[bytes | None], words: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles: words as in simhash.fingerprint; a shorter text is one shingle."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
    todo: list[int] = []

    def flush() -> None:
        v, start = _words(b" ".join(texts[i] for i in todo))
        ends = np.cumsum([len(texts[i]) + 1 for i in todo])
        cut_at = np.r_[0, np.searchsorted(start, ends)]
        every = _shingles(v, words) if len(v) >= words else None
        for i, a, b in zip(todo, cut_at[:-1], cut_at[1:]):
            if b - a >= words:
                out[i] = np.unique(every[a : b - words + 1])
            elif b > a:
                out[i] = _shingles(v[a:b], int(b - a))

    size = 0
    for i, t in enumerate(texts):
        if t and len(t) > _PIECE:
            v = np.concatenate([_words(p)[0] for p in _pieces(t)])
            out[i] = np.unique(_shingles(v, min(words, len(v)))) if len(v) else out[i]
        elif t:
            if todo and size + len(t) > _PIECE:
                flush()
                todo, size = [], 0
            todo.append(i)
            size += len(t)
    if todo:
        flush()
    return out


def set_id(h: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), seed=7)).view(np.int64))


def least_common(n: int, similarity: float) -> int:
    """Shingles that a set of n must share with any set of the similarity."""
    return int(np.ceil(similarity * n - 1e-9))


def prefix(h: np.ndarray, similarity: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of h in the corpus order (by count, then by hash), with one more for split keys."""
    if not len(h):
        return h
    n = len(h) - least_common(len(h), similarity) + 2
    if not len(common):
        return h[:n]
    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
    return h[np.lexsort((h, np.where(common[at] == h, counts[at], 0)))[:n]]


def parity(h: np.ndarray) -> np.ndarray:
    """A bitmap that each shingle flips one bit of."""
    hit = np.bincount((h.view(np.uint64) >> np.uint64(20)).astype(np.int64) % (64 * BITS), minlength=64 * BITS) & 1
    return np.packbits(hit.astype(np.uint8), bitorder="little").view(np.int64)


def _common(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that different sets of a batch share, over all batches of the corpus, ascending, and how often."""
    src = docs.select(F.col("text").cast("string").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = {set_id(h): h for h in hashes(batch.column(0).to_pylist(), words)}
            h, n = np.unique(np.concatenate([np.zeros(0, np.int64), *sets.values()]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h[n > 1]), pa.array(n[n > 1])], ["h", "n"])

    top = src.mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(COMMON).toArrow().sort_by("h")
    return top["h"].to_numpy(), top["n"].to_numpy()


def sets(docs: DataFrame, keep: list[str], words: int, similarity: float | None = None, also: tuple[str, Callable[[list], pa.Array]] | None = None) -> DataFrame:
    """keep columns and `_fp`, the id of the text's set; with a similarity also its size `_n`, the long `_prefix` and the bitmap `_bits`, and a column `also` of the texts."""
    if similarity is None:
        return map_texts(docs, keep, "text", "_fp bigint", lambda texts: [pa.array([set_id(h) for h in hashes(texts, words)], pa.int64())], as_bytes=True)
    common, counts = _common(docs, words)

    def run(texts: list) -> list[pa.Array]:
        h = hashes(texts, words)
        longs = pa.list_(pa.int64())
        return [
            pa.array([set_id(x) for x in h], pa.int64()), pa.array([len(x) for x in h], pa.int32()),
            pa.array([prefix(x, similarity, common, counts) for x in h], longs), pa.array([parity(x) for x in h], longs),
            *([also[1](texts)] if also else []),
        ]

    schema = "_fp bigint, _n int, _prefix array<bigint>, _bits array<bigint>"
    return map_texts(docs, keep, "text", f"{schema}, {also[0]}" if also else schema, run, as_bytes=True)


def _least_common(n: Column, similarity: float) -> Column:
    return F.ceil(F.lit(similarity) * n - 1e-9).cast("int")


def _met(entries: DataFrame) -> DataFrame:
    """The entries (key, _fp, pos) whose key several sets have, with one set's id as `lead`.

    That is the one with the fewest seldom shingles before the key: most likely the text that others are copies of. Rows come sorted and are looked at in a stream, so that a key may have any number of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, pos = (np.zeros(0, np.int64) for _ in range(3))
        lead, joined = 0, False  # of the row held back
        for batch in batches:
            if not batch.num_rows:
                continue
            key, fp, pos = (np.concatenate([a, batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64)]) for i, a in enumerate((key, fp, pos)))
            held = len(key) > batch.num_rows
            first = np.r_[True, key[1:] != key[:-1]]
            start = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
            leads = fp[start]
            if held:
                leads[start == 0] = lead
            before = ~first
            before[0] = joined
            keep = before | np.r_[~first[1:], False]
            keep[-1] = False
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, fp, leads)] + [pa.array(pos[keep].astype(np.int32))], ["key", "_fp", "lead", "pos"])
            lead, joined = int(leads[-1]), bool(before[-1])
            key, fp, pos = key[-1:], fp[-1:], pos[-1:]
        if joined:
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp), pa.array([lead]), pa.array(pos.astype(np.int32))], ["key", "_fp", "lead", "pos"])

    dealt = entries.select("key", "_fp", "pos").repartition("key").sortWithinPartitions("key", "pos", "_fp")
    return dealt.mapInArrow(run, "key bigint, _fp bigint, lead bigint, pos int")


def _alike(common: Column, a: Column, b: Column, similarity: float) -> Column:
    """Whether sets of a and b members with so many in common, at the most or exactly, have the similarity."""
    return common >= similarity * (a + b - common) - 1e-9


def _apart(a: Column, b: Column, m: Column, n: Column, similarity: float) -> Column:
    """Whether the bitmaps, or the sizes, rule out that sets of m and n members have the similarity."""
    differ = sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(BITS)), F.lit(0))
    most = F.floor((m + n - differ) / 2)
    return ~_alike(F.least(most, m, n), m, n, similarity)


def _verified(pairs: DataFrame, distinct: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b), each once, whose whole sets have the similarity."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("_fp")).distinct())
    names = distinct.join(ids, "_fp", "left_semi").select(F.col("_least").alias("_id")).distinct()
    # The texts that the sets are of; of a repeated id the odd ones go by the set's id.
    some = docs.select("doc_id", "text").join(names.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    longs = pa.list_(pa.int64())

    def run(texts: list) -> list[pa.Array]:
        h = hashes(texts, words)
        return [pa.array([set_id(x) for x in h], pa.int64()), pa.array(h, longs)]

    whole = map_texts(some, [], "text", "_fp bigint, _h array<bigint>", run, as_bytes=True)
    whole = cut(whole.join(ids, "_fp", "left_semi").dropDuplicates(["_fp"]))
    both = pairs.join(whole.toDF("a", "x"), "a").join(whole.toDF("b", "y"), "b")
    out = cut(both.where(_alike(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"), similarity)).select("a", "b"))
    drop_cut(whole)
    drop_cut(ids)
    return out


def _likely(pairs: DataFrame, distinct: DataFrame, similarity: float) -> DataFrame:
    """The distinct pairs (a, b) that neither size nor bitmap rules out."""
    at = distinct.select("_fp", "_n", "_bits")
    both = pairs.distinct().join(at.toDF("a", "m", "x"), "a").join(at.toDF("b", "n", "y"), "b")
    return cut(both.where(~_apart(F.col("x"), F.col("y"), F.col("m"), F.col("n"), similarity)).select("a", "b"))


def _open(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) of different components."""
    both = pairs.join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left")
    return cut(both.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b"))


def _parts(rows: DataFrame, by: list[str]) -> DataFrame:
    """For keys whose rows are of several components: the largest one (`main`) and the work of comparing the others' rows with all."""
    parts = rows.groupBy(*by, "root").agg(F.count("*").alias("n")).groupBy(*by).agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("rows"))
    return parts.where(F.col("rows") > F.col("most.n")).select(*by, F.col("most.root").alias("main"), ((F.col("rows") - F.col("most.n")) * F.col("rows")).alias("work"))


def _across(met: DataFrame, roots: DataFrame, distinct: DataFrame, similarity: float) -> DataFrame:
    """Likely pairs (a, b) of different components under one key; a key of many rows is split where that makes less work."""
    rows = met.join(roots, met["_fp"] == roots["node"], "left").select("key", "_fp", "pos", F.coalesce("root", "_fp").alias("root"))
    rows = cut(rows.join(_parts(rows, ["key"]), "key"))
    hot = cut(rows.where(F.col("work") > SPLIT**2).join(distinct.select("_fp", "_n", "_prefix"), "_fp"))
    # A pair's next common shingle stands behind this one, within one place more of either prefix.
    end = F.col("_n") - _least_common(F.col("_n"), similarity) + 2
    deeper = hot.withColumn("at", F.explode(F.filter(F.sequence(F.col("pos") + 1, F.col("pos") + F.size("_prefix")), lambda i: i < F.least(end, F.size("_prefix")))))
    deeper = cut(deeper.select("key", "work", F.element_at("_prefix", F.col("at") + 1).alias("next"), "_fp", "root"))
    parts = cut(_parts(deeper, ["key", "next"]))
    cost = deeper.groupBy("key").agg(F.count("*").alias("more"), F.first("work").alias("work")).join(parts.groupBy("key").agg(F.sum("work").alias("then")), "key", "left")
    split = cut(cost.where(F.coalesce("then", F.lit(0)) + F.col("more") < F.col("work")).select("key"))
    # Sets so small that a pair of them may share no further shingle stay under the key.
    small = hot.where(_least_common(F.col("_n"), similarity) <= 1).join(split, "key", "left_semi")
    whole = rows.join(split, "key", "left_anti").unionByName(small.select(*rows.columns))
    under = whole.select("key", F.lit(0).cast("long").alias("next"), "_fp", "root", "main")
    under = under.unionByName(deeper.join(split, "key", "left_semi").join(parts, ["key", "next"]).select("key", "next", "_fp", "root", "main"))
    under = cut(under.join(distinct.select("_fp", "_n", "_bits"), "_fp"))
    left = under.where("root <> main").select("key", "next", "main", F.col("_fp").alias("a"), F.col("root").alias("ra"), F.col("_n").alias("m"), F.col("_bits").alias("x"))
    right = under.select("key", "next", F.col("_fp").alias("b"), F.col("root").alias("rb"), F.col("_n").alias("n"), F.col("_bits").alias("y"))
    # Each pair once for each key that it shares.
    once = (F.col("ra") != F.col("rb")) & ((F.col("rb") == F.col("main")) | (F.col("a") < F.col("b")))
    pairs = left.join(right, (left["key"] == right["key"]) & (left["next"] == right["next"]) & once & ~_apart(F.col("x"), F.col("y"), F.col("m"), F.col("n"), similarity))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "m", "n", left["next"].alias("next"))
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.max(F.col("next") != 0).alias("split"), F.min(F.least("m", "n")).alias("m"), F.max(F.greatest("m", "n")).alias("n"))
    # Common shingles that are keys of neither stand behind the keys of the set whose keys end first. A split key
    # without a next common shingle, the last one of a pair if any, is missing in the count: hence no less one here.
    most = F.col("shared") + F.greatest(_least_common(F.col("m"), similarity), _least_common(F.col("n"), similarity))
    out = cut(pairs.where(F.col("split") | _alike(F.least(most, "m"), F.col("m"), F.col("n"), similarity)).select("a", "b"))
    for old in (rows, hot, deeper, parts, split, under):
        drop_cut(old)
    return out


def links(distinct: DataFrame, docs: DataFrame, words: int, similarity: float, first: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of sets with the similarity.

    distinct has each set once, as of sets(), with the id `_least` of a text of docs (doc_id, text) that it is of. Pairs
    `first` (a, b), found another way, are verified before any other; then only what they leave open is looked for.
    """
    near = None
    if first is not None:
        near = _verified(_likely(first, distinct, similarity), distinct, docs, words, similarity)
        roots = cut(components(near))
    keys = F.slice("_prefix", F.lit(1), F.col("_n") - _least_common(F.col("_n"), similarity) + 1)
    met = cut(_met(distinct.where("_n > 0").select("_fp", F.posexplode(keys).alias("pos", "key"))))
    stars = _likely(met.where("_fp <> lead").select(F.col("lead").alias("a"), F.col("_fp").alias("b")), distinct, similarity)
    stars = _verified(stars if near is None else _open(stars, roots), distinct, docs, words, similarity)
    near = stars if near is None else near.unionByName(stars)
    roots = cut(components(near))
    far = _verified(_across(met, roots, distinct, similarity), distinct, docs, words, similarity)
    drop_cut(met)
    return near.unionByName(far)
