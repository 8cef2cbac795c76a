"""Exact ranks of columns of any size, without a task that holds a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wellspring.tables import cut


def quantiles(rows: DataFrame, value: Column | str, shares: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., p): the exact quantiles of a value, linear between neighbours, as an array
    in the order of the shares, per key or of all rows.

    Equal values are counted first, by value, so that copies and hot keys are spread. The
    counts are range-sorted by key and value; sums per partition and key give where each
    partition begins, and only values at a wanted rank go on. No values of a key: no row,
    or one of null where there is no key. Nulls do not count, NaN is greater than all.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    v = F.col(value) if isinstance(value, str) else value
    keys = [f"_k{i}" for i in range(len(by))]
    counts = rows.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], v.alias("_v")).where("_v is not null").groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    ordered = cut(counts.repartitionByRange(n, *keys, "_v")).withColumn("_p", F.spark_partition_id())
    parts = ordered.groupBy("_p", *keys).agg(F.sum("_n").alias("_n"))
    # one row a partition and key: no more than keys and partitions together
    within = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))
    starts = parts.select("_p", *keys, (F.sum("_n").over(within.orderBy("_p")) - F.col("_n")).alias("_start"), F.sum("_n").over(within).alias("_total"))
    placed = ordered.join(starts.withColumnsRenamed({k: f"{k}s" for k in keys}).withColumnRenamed("_p", "_ps"), [F.col("_p") == F.col("_ps"), *[F.col(k).eqNullSafe(F.col(f"{k}s")) for k in keys]])
    last = F.sum("_n").over(W.partitionBy("_p", *keys).orderBy("_v")) + F.col("_start")
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(q)) * (F.col("_total") - 1)).alias("r")) for i, q in enumerate(shares)]))
    hit = placed.withColumn("_last", last).select(*keys, "_v", F.col("_last"), (F.col("_last") - F.col("_n")).alias("_first"), at.alias("q"))
    low, high = F.floor("q.r"), F.ceil("q.r")
    hit = hit.where((low < F.col("_last")) & (high >= F.col("_first")))
    ends = hit.groupBy(*keys, F.col("q.i").alias("i"), F.col("q.r").alias("r")).agg(F.min(F.when(low >= F.col("_first"), F.col("_v"))).alias("a"), F.max(F.when(high < F.col("_last"), F.col("_v"))).alias("b"))
    share = F.col("r") - F.floor("r")
    one = ends.select(*keys, "i", F.when(share == 0, F.col("a")).otherwise(F.col("a") * (1 - share) + F.col("b") * share).cast("double").alias("x"))
    out = one.groupBy(*keys) if keys else one
    return out.agg(F.when(F.count("*") > 0, F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])).alias("p")).withColumnsRenamed(dict(zip(keys, by)))
