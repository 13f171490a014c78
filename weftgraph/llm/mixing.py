"""Mixing sources to target weights by Sainte-Lague apportionment.

The mix is as large as the corpus. Each source's share is filled up to three
times its size, the rest reshared by weight. The total is cut into equal blocks
of words; sources, and within a source its shards, get whole numbers of blocks by
the highest quotients size / (2 * seats + 1). Within a shard the documents stand
in a seeded order, and its quota is a run of blocks from a seeded start, round
and round, so no document is passed more than three times.

Only DataFrame functions are used. A source's number of shards grows with the
square root of its rows, so neither a shard nor a source's list of shards is
large, whatever share of all rows a source has.

Defined cases: null text has size 0; documents without words take nothing; a
null source is a source, last in order; a null doc_id stands in the order by its
source and size; repeated rows are documents of their own; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.llm._base import cut, table

WEIGHTS = (5, 2, 1)
MOST = 3


def _near(number: Column) -> Column:
    return F.floor(number + F.lit(0.5)).cast("long")


def apportion(rows: DataFrame, group: list[str], key: str, weight: str, seats: str, most: str) -> DataFrame:
    """Give each group's `seats` to its rows by the highest weight / (2 * k + 1); ties to the smaller key.

    No row gets more than `most`. Adds the column `quota`. Rounding every share
    gives all seats but a few; only the quotients around those roundings are
    compared, at most two for each row and seat in question.
    """
    w = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    total = F.sum(weight).over(w)
    share = F.when(total > 0, F.col(weight) / total * F.col(seats)).otherwise(0.0)
    base = rows.withColumn("_base", F.least(_near(share), F.col(most)))
    base = base.withColumn("_open", F.col(seats) - F.sum("_base").over(w)).withColumn("_n", F.when(total > 0, F.ceil(2 * F.abs("_open") * F.col(weight) / total) + 2).otherwise(0))
    # Seats to add: the next quotients; seats to take back: the last ones given.
    up = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n")), lambda i: F.col("_base") + i)
    down = F.transform(F.sequence(F.lit(1).cast("long"), F.greatest("_n", F.lit(1).cast("long"))), lambda i: F.col("_base") - i)
    steps = base.where("_open <> 0").select(*group, key, "_open", weight, most, "_base", F.explode(F.when(F.col("_open") > 0, up).otherwise(down)).alias("_k")).where(f"_k >= 0 and (_open < 0 or _k < {most})")
    steps = steps.withColumn("_q", F.col(weight) / (2 * F.col("_k") + 1))
    order = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    ranked = steps.withColumn("_r", F.row_number().over(order.orderBy(F.when(F.col("_open") > 0, -F.col("_q")).otherwise(F.col("_q")), F.when(F.col("_open") > 0, F.col(key)).otherwise(-F.col(key)), "_k")))
    change = ranked.where("_r <= abs(_open)").groupBy(*group, key).agg(F.sum(F.signum("_open")).cast("long").alias("_change"))
    return base.join(change, [*group, key], "left").withColumn("quota", F.col("_base") + F.coalesce("_change", F.lit(0))).drop("_base", "_open", "_n", "_change")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sources (source, source_size, one row each) with their place `src`, weight and target.

    With targets min(most * size, level * weight), the sources fill up in order
    of size / weight; the level follows from those that are full.
    """
    every = W.partitionBy(F.lit(0))
    src = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sources.withColumn("src", src).withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("src", F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("_cap", (most * F.col("source_size")).cast("double")).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    before = every.orderBy("_ratio", "src").rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("source_size").over(every)
    s = s.withColumn("_total", total).withColumn("_left", total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))).withColumn("_w", F.sum("weight").over(every.orderBy("_ratio", "src").rowsBetween(0, W.unboundedFollowing)))
    # The first source in this order that the level does not fill sets the level.
    s = s.withColumn("_level", F.min(F.when(F.col("_left") / F.col("_w") <= F.col("_ratio"), F.struct("_ratio", "src", (F.col("_left") / F.col("_w")).alias("level")))).over(every)["level"])
    return s.withColumn("target", F.least("_cap", F.col("_level") * F.col("weight"))).drop("_cap", "_ratio", "_left", "_w", "_level")


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"))


def mix(sized: DataFrame, seed: int = 17, block: int = 1, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sized (doc_id, source, size) with source_size, target and taken.

    `block` words are a block at every size of the corpus; a source's taken words
    differ from its target by less than a block for each of its shards, and with
    blocks of one word by less than a word.
    """
    sized = cut(sized.select("doc_id", "source", "size"))
    # First by part of a source, so that a source with a third of all rows is summed in many tasks.
    by_source = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), weights, most).withColumn("shards", F.ceil(F.sqrt("rows")).cast("long")))
    by_source = by_source.withColumn("block", F.lit(block).cast("long"))
    by_source = by_source.withColumn("blocks", F.floor(F.col("_total") / F.col("block"))).withColumn("cap", F.ceil(most * F.col("source_size") / F.col("block")))
    quotas = cut(apportion(by_source, [], "src", "target", "blocks", "cap").withColumnRenamed("quota", "source_quota"))

    head = F.broadcast(quotas.select(F.col("source").alias("_source"), "src", "shards", "source_size", "target")) if _small(quotas) else quotas.select(F.col("source").alias("_source"), "src", "shards", "source_size", "target")
    placed = sized.join(head, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # The shard, and the place in it, come from seeded hashes of the row.
    placed = placed.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "source", "size")).withColumn("shard", F.pmod("_h", "shards")).withColumn("_o", F.xxhash64(F.lit(seed + 1), "doc_id", "size"))
    layout = W.partitionBy("src", "shard").orderBy("_o", F.col("doc_id"))
    placed = cut(placed.withColumn("_end", F.sum("size").over(layout.rowsBetween(W.unboundedPreceding, 0))).select("doc_id", "source", "size", "src", "shard", "source_size", "target", "_end"))
    shards = placed.groupBy("src", "shard").agg(F.sum("size").alias("words"))
    shards = shards.join(quotas.select("src", "source_quota", "block"), "src").withColumn("cap", F.ceil(most * F.col("words") / F.col("block")))
    given = apportion(cut(shards), ["src"], "shard", "words", "source_quota", "cap")
    # Words of the quota; a last, partly filled block of a shard ends with the shard.
    given = given.select("src", "shard", "words", F.least(F.col("quota") * F.col("block"), most * F.col("words")).alias("_q"), (F.pmod(F.xxhash64(F.lit(seed + 2), "src", "shard"), F.greatest(F.ceil(F.col("words") / F.col("block")), F.lit(1))) * F.col("block")).alias("_at"))
    given = cut(given)
    x = placed.join(given.withColumn("words", F.greatest("words", F.lit(1).cast("long"))), ["src", "shard"])
    # The run [_at, _at + _q) on the endless repetition of the shard, counted over the document's own words.
    upto = lambda p: F.floor(p / F.col("words")) * F.col("size") + F.least(F.greatest(F.pmod(p, F.col("words")) - (F.col("_end") - F.col("size")), F.lit(0)), F.col("size"))
    taken = F.when(F.col("size") > 0, upto(F.col("_at") + F.col("_q")) - upto(F.col("_at"))).otherwise(0)
    return x.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def _small(quotas: DataFrame, most: int = 10000) -> bool:
    """Whether a table of one row per source may be broadcast: its rows are counted."""
    return quotas.limit(most + 1).count() <= most


def mix_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """docs with each row as often as the mix takes it: its taken words, in whole copies, rounded to the nearest."""
    taken = mix(sizes(docs), seed)
    times = cut(taken.where("size > 0").groupBy("doc_id", "size").agg(F.sum("taken").alias("_t"), F.count("*").alias("_n")))
    own = times.select(F.col("doc_id").alias("weft·id"), F.col("size").alias("weft·size"), F.floor(F.col("_t") / (F.col("_n") * F.col("size")) + 0.5).cast("int").alias("weft·times"))
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    # The same plan at every size: texts are moved once and not sorted.
    out = docs.join(own.where("`weft·times` > 0").hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("`weft·id`")) & (words == F.col("`weft·size`")))
    return out.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("`weft·times`"))).alias("weft·copy")).select(*docs.columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(sizes(table(spark, sf_dir, "documents"))).drop("source")
