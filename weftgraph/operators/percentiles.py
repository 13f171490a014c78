"""Percentiles by rank, of any number of rows in a group.

Equal values are counted together and dealt to parts by their order. The sums of the parts tell which part holds a
place, so only the rows of that part are ranked: no task sorts a whole group.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions import values as V
from weftgraph.functions.values import DOUBLE, Val
from weftgraph.session import settle

#: Different values of a part, about; the number of parts grows with the input.
PART = 500_000


def percentiles(rows: DataFrame, value: Val, name: str, discrete: bool, part: int | None = None) -> DataFrame:
    """(by ..., name): of rows (by ..., value, share) the percentile of each group that has a value.

    The share of a group's first row counts. Discrete: the value at round(share * (n - 1)), from 0; else between two
    values in proportion.
    """
    by = [f"`{c}`" for c in rows.columns if c not in ("value", "share")]
    value = value if discrete else Val(F.col("value").cast("double"), DOUBLE)
    key = V.order_key(F.col("value"), value.type) if discrete else value.col
    shares = rows.groupBy(*by).agg(F.first("share").alias("share"), F.count("value").alias("n"))
    plain = not (V.has_variant(value.type) or isinstance(value.type, T.MapType))  # the key is the value itself
    counted = rows.where(F.col("value").isNotNull()).select(*by, key.alias("key"), *([] if plain else ["value"]))
    counted = counted.groupBy(*by, "key").agg(F.count(F.lit(1)).alias("times"), *([] if plain else [F.first("value").alias("value")]))
    counted = settle(counted)
    parts = max(1, -(-counted.count() // (part or PART)))
    order = [*[F.col(c) for c in by], F.col("key").asc_nulls_last()]
    dealt = settle(counted.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())) if parts > 1 else counted.withColumn("part", F.lit(0))
    sums = dealt.groupBy(*by, "part").agg(F.sum("times").alias("rows"))
    before = F.coalesce(F.sum("rows").over(W.partitionBy(*by).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    last = F.col("n") - 1
    place = F.least(F.greatest(F.col("share").cast("double"), F.lit(0.0)), F.lit(1.0)) * last
    low, high = (F.floor(F.col("share") * last + 0.5),) * 2 if discrete else (F.floor(place), F.ceil(place))
    wanted = shares.where("n > 0").select(*[F.col(c).alias(f"{c.strip('`')}'") for c in by], low.cast("long").alias("low"), high.cast("long").alias("high"), (F.lit(0.0) if discrete else place - low).alias("rest"))
    same = lambda a, b: reduce(and_, [F.col(c).eqNullSafe(F.col(f"`{c.strip('`')}'`")) for c in by], F.lit(True))
    covers = lambda start, many: ((F.col("low") >= start) & (F.col("low") < start + many)) | ((F.col("high") >= start) & (F.col("high") < start + many))
    sums = sums.withColumn("before", before).join(wanted, same(sums, wanted)).where(covers(F.col("before"), F.col("rows")))
    sums = sums.select(*[F.col(c).alias(f"{c.strip('`')}'") for c in by], F.col("part").alias("_part"), "before", "low", "high", "rest")
    near = dealt.join(sums, same(dealt, sums) & (F.col("part") == F.col("_part")))
    start = F.col("before") + F.sum("times").over(W.partitionBy(*by, "part").orderBy(F.col("key").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)) - F.col("times")
    near = near.withColumn("start", start).where(covers(F.col("start"), F.col("times")))
    at = lambda x: (F.col(x) >= F.col("start")) & (F.col(x) < F.col("start") + F.col("times"))
    out = F.col("key") if plain else F.col("value")
    a, b = (F.first(F.when(at(x), out), ignorenulls=True) for x in ("low", "high"))
    return near.groupBy(*by).agg((a if discrete else a + F.max("rest") * (b - a)).alias(name))
