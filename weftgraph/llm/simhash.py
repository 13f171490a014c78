"""SimHash near-dedup by multi-index hashing.

A 64-bit fingerprint holds one vote of every word shingle per bit. Fingerprints
are cut into segments. Two of them within a reach of k bits differ by at most
k // segments bits in one segment, so each fingerprint stands in a table of
every segment under its value there, looks up the small Hamming ball around
that value, and meets its candidates, whose whole distance is verified.

A value that too many fingerprints have is a hot bucket: its rows are keyed
again by that value together with a segment of the remaining bits, cut into
k + 1 parts, one of which a pair within reach has in common exactly; and so on
until no bucket is large (k + 1 bits or fewer left over hold few fingerprints by
themselves). No link is lost to it and no bucket's pairs grow with the square of
a group of copies.

With a similarity (keep_one), the fingerprints' reach is wide and the pairs they
find are verified on whole sets of shingles. There the ball is dealt to both
sides: each fingerprint stands in the table under all values of a ball of half
the radius, and each row of a bucket is linked with the closest one before it.
What no reach bounds, pairs of that similarity whose fingerprints lie further
apart, is found by an exact pass (shingles.links) between the components that
the fingerprints leave open.

Defined cases: null text counts as empty; an empty text has fingerprint zero
and links like any other; repeated rows link with each other; a null doc_id
takes part, but is never a component's name unless all its members lack one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import shingles
from weftgraph.llm._base import cut, map_texts, table
from weftgraph.llm._graph import components

_HASH = partial(xxhash.xxh64_intdigest, seed=42)
#: Shingles hashed at once; bounds memory on very long texts.
_PIECE = 1 << 16


def fingerprint(raw: bytes | None, words: int = 3) -> int:
    """Unsigned fingerprint of UTF-8 bytes: A-Z lower-cased, words between ASCII white space, shingles with repeats."""
    w = raw.lower().split() if raw else []
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _PIECE):
        part = w[at : at + _PIECE + words - 1]
        each = map(b" ".join, zip(*(part[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
        h = np.fromiter(map(_HASH, each), dtype="<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def _longs(texts: list[bytes | None], words: int) -> pa.Array:
    return pa.array(np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, keep: list[str], words: int = 3) -> DataFrame:
    """keep columns and `_fp`, the fingerprint's 64 bits as a long."""

    return map_texts(docs, keep, "text", "_fp bigint", lambda texts: [_longs(texts, words)], as_bytes=True)


def cuts(bits: list[int], parts: int) -> list[list[int]]:
    """Positions of bits dealt into as many runs of nearly equal length."""
    parts = min(parts, len(bits))
    at = [len(bits) * i // parts for i in range(parts + 1)]
    return [bits[a:b] for a, b in zip(at, at[1:])]


def _mask(bits: list[int]) -> int:
    """The bits as a signed long."""
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def keys(segments: int, reach: int) -> list[tuple[list[int], list[int]]]:
    """For each segment its bits, and the flips (as masks) of the ball that is looked up around a value."""
    return [(bits, [_mask(list(c)) for d in range(reach // segments + 1) for c in combinations(bits, d)]) for bits in cuts(list(range(64)), segments)]


def links(distinct: DataFrame, segments: int = 3, reach: int = 2, bucket: int = 64) -> DataFrame:
    """Edges (a, b), a < b, between the distinct fingerprints `_fp` within reach of each other."""
    plan = {(i,): bits for i, (bits, _) in enumerate(keys(segments, reach))}
    row = lambda i, flip, asks: F.struct(F.lit(str(i)).alias("path"), F.col("_fp").bitwiseXOR(F.lit(flip)).bitwiseAND(F.lit(_mask(plan[i,]))).alias("v"), F.lit(asks).alias("asks"))
    rows = [row(i, f, True) for i, (_, ball) in enumerate(keys(segments, reach)) for f in ball] + [row(i, 0, False) for i in range(segments)]
    # One row asks and one stands in the table, dealt out evenly before they multiply.
    entries = distinct.select("_fp").repartition("_fp").select("_fp", F.inline(F.array(*rows)))
    found = None
    while True:
        asks, held = entries.where("asks").select("path", "v", F.col("_fp").alias("a")), entries.where("not asks").select("path", "v", F.col("_fp").alias("b"))
        full = cut(held.groupBy("path", "v").agg(F.count("*").alias("n")).where(F.col("n") > bucket).select("path", "v"))
        final = [p for p, bits in plan.items() if 64 - len(bits) <= reach + 1]
        wide = full.where(~F.col("path").isin(["-".join(map(str, p)) for p in final])) if final else full
        near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= reach
        pairs = asks.join(wide, ["path", "v"], "left_anti").join(held, ["path", "v"]).where((F.col("a") != F.col("b")) & near)
        pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        found = pairs if found is None else found.unionByName(pairs)
        hot = {tuple(map(int, r.path.split("-"))) for r in wide.select("path").distinct().collect()}  # a few paths, however many buckets
        if not hot:
            return found.distinct()
        next_plan, again = {}, []
        for p in sorted(hot):
            for j, bits in enumerate(cuts([b for b in range(64) if b not in plan[p]], reach + 1)):
                next_plan[p + (j,)] = plan[p] + bits
                again.append(F.struct(F.lit("-".join(map(str, p))).alias("was"), F.lit("-".join(map(str, p + (j,)))).alias("to"), F.lit(_mask(bits)).alias("mask")))
        deeper = entries.join(wide, ["path", "v"], "left_semi").withColumn("s", F.explode(F.array(*again))).where("s.was = path")
        entries = cut(deeper.select("_fp", F.col("s.to").alias("path"), F.col("v").bitwiseOR(F.col("_fp").bitwiseAND(F.col("s.mask"))).alias("v"), "asks"))
        plan = next_plan


def closest(distinct: DataFrame, segments: int = 4, reach: int = 11, rows: int = 4096) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct fingerprints `_fp`: each with the closest one before it in every bucket, if that is within reach.

    Two within reach meet in a bucket: they differ by at most reach // segments bits in one segment, and both stand under
    the values of a ball of half that radius. A row is compared with at most so many rows before it; so neither the work
    nor the pairs of a bucket grow with its square.
    """
    half = (reach // segments + 1) // 2
    # A segment's number stands above its value, which has 32 bits at most if there are several.
    value = lambda bits, flip: F.shiftrightunsigned(F.col("_fp").bitwiseAND(F.lit(_mask(bits))).bitwiseXOR(F.lit(flip)), bits[0])
    values = [value(bits, f).bitwiseOR(F.lit(i << 32)) for i, (bits, ball) in enumerate(keys(segments, half * segments)) for f in ball]
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Dealt out evenly before the rows multiply.
    entries = distinct.select("_fp").repartition(parts, "_fp").select(F.explode(F.array(*values)).alias("v"), "_fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)  # the last bucket's rows so far
        for batch in batches:
            if not batch.num_rows:
                continue
            held = len(v)
            v, fp = (np.concatenate([x, batch.column(i).to_numpy().view(x.dtype)]) for i, x in enumerate((v, fp)))
            at = np.arange(len(v))
            start = np.maximum.accumulate(np.where(np.r_[True, v[1:] != v[:-1]], at, 0))
            back = np.minimum(at - start, rows)
            back[:held] = 0
            best, mate = np.full(len(v), reach + 1, np.uint8), np.zeros(len(v), np.uint64)
            some = np.flatnonzero(back)
            d = 1
            while len(some):
                if 2 * len(some) > len(v) - d:
                    apart = np.bitwise_count(fp[d:] ^ fp[:-d])
                    to = np.flatnonzero((apart < best[d:]) & (back[d:] >= d))
                    best[to + d], mate[to + d] = apart[to], fp[to]
                else:
                    apart = np.bitwise_count(fp[some] ^ fp[some - d])
                    to = apart < best[some]
                    best[some[to]], mate[some[to]] = apart[to], fp[some[to] - d]
                d += 1
                some = some[back[some] >= d]
            met = best <= reach
            a, b = fp[met].view(np.int64), mate[met].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
            keep = max(int(start[-1]), len(v) - rows)
            v, fp = v[keep:], fp[keep:]

    dealt = entries.repartition("v").sortWithinPartitions("v", "_fp")
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def alike(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of the sets `_fp` that are not empty, by their fingerprints `_print`: one set stands for those of the same fingerprint."""
    some = distinct.where("_n > 0").select("_fp", "_print")
    leads = cut(some.groupBy("_print").agg(F.min("_fp").alias("lead")))
    pairs = closest(leads.select(F.col("_print").alias("_fp")))
    pairs = pairs.toDF("x", "y").join(leads.toDF("x", "a"), "x").join(leads.toDF("y", "b"), "y").select("a", "b")
    return pairs.unionByName(some.join(leads, "_print").where("_fp <> lead").select(F.col("lead").alias("a"), F.col("_fp").alias("b")))


def groups(prints: DataFrame, edges: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(_fp, component_id) for the rows (doc_id, _fp, ...), by edges, or else links(): exact copies are one fingerprint before any pair is formed."""
    more = [c for c in prints.columns if c not in ("doc_id", "_fp")]
    distinct = cut(prints.groupBy("_fp").agg(F.min("doc_id").alias("_least"), *(F.first(c).alias(c) for c in more)))
    roots = components((edges or links)(distinct)).select(F.col("node").alias("_fp"), F.col("root").alias("_root"))
    rooted = cut(distinct.select("_fp", "_least").join(roots, "_fp", "left").withColumn("_root", F.coalesce("_root", "_fp")))
    names = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    return rooted.join(names, "_root").select("_fp", "component_id")


def near_groups(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs (doc_id, text)."""
    prints = cut(fingerprints(docs, ["doc_id"], words))
    named = cut(groups(prints))
    return prints.join(named, "_fp").select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 3, similarity: float | None = None) -> DataFrame:
    """docs with one row of each group: the one with the smallest doc_id (of a repeated id, one row for each fingerprint).

    With a similarity the groups join all texts whose sets of shingles have that Jaccard similarity: those that their fingerprints
    find first, then those of the components left open. Texts of one set of shingles are one row, with the set's id as `_fp`.
    """
    texts = docs.select("doc_id", "text")
    if similarity is None:
        prints = cut(fingerprints(texts, ["doc_id"], words))
        named = cut(groups(prints))
    else:
        prints = cut(shingles.sets(texts, ["doc_id"], words, similarity, ("_print bigint", lambda t: _longs(t, words))))
        named = cut(groups(prints, lambda distinct: shingles.links(distinct, texts, words, similarity, alike(distinct))))
    kept = prints.select("doc_id", "_fp").join(named, "_fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    ids = cut(kept.groupBy("doc_id").agg(F.count("*").alias("_n")))
    # The same plan at every size: ids are hashed partition by partition, texts are moved once and not sorted.
    out = docs.join(ids.select(F.col("doc_id").alias("weft·kept")).hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("`weft·kept`")), "left_semi")
    if ids.where("_n > 1").limit(1).count():  # an id that stands on several rows
        names = [f"weft·{i}" for i in range(len(docs.columns))]
        at = {c: F.col(f"`{n}`") for c, n in zip(docs.columns, names)}
        again = fingerprints if similarity is None else shingles.sets
        prints = again(out.toDF(*names).withColumn("text", at["text"]), names, words)
        out = prints.dropDuplicates([names[docs.columns.index("doc_id")], "_fp"]).select(*[F.col(f"`{n}`") for n in names]).toDF(*docs.columns)
    return out


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
