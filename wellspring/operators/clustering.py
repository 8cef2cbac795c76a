"""Grouping rows by their features: scaling, K-means, self-organising line,
silhouette, ranking and comparison of groupings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wellspring.operators.ranks import quantiles
from wellspring.tables import cut


def standardised(rows: DataFrame, key: str, names: list[str]) -> DataFrame:
    """MDL18: z-scores (population deviation, 1 where there is none) as one array;
    mean and deviation over known values, unknown ones take the median."""
    middle = quantiles(rows.select(*names).unpivot([], names, "feature", "value"), "value", [0.5], ("feature",))
    m = middle.agg(*[F.max(F.when(F.col("feature") == n, F.col("p")[0])).alias(f"m_{n}") for n in names])
    s = rows.agg(*[F.avg(n).alias(f"a_{n}") for n in names], *[F.stddev_pop(n).alias(f"s_{n}") for n in names]).crossJoin(m)  # one row each
    z = lambda n: (F.coalesce(F.col(n), F.col(f"m_{n}")) - F.col(f"a_{n}")) / F.when(F.col(f"s_{n}") > 0, F.col(f"s_{n}")).otherwise(1.0)
    return rows.crossJoin(s).select(key, F.array(*[z(n) for n in names]).alias("v"))  # one row of statistics


def _numbered(v: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre (the lowest of equal ones) and squared distance."""
    d = np.stack([((v - c) ** 2).sum(axis=1) for c in centres], axis=1)
    n = d.argmin(axis=1)
    return n, d[np.arange(len(v)), n]


def nearest(rows: DataFrame, centres: list[list[float]]) -> DataFrame:
    """Rows (..., v) with the number of the nearest centre and its squared distance."""
    at = np.array(centres, float)

    @F.pandas_udf("cluster int, near2 double")
    def one(v: pd.Series) -> pd.DataFrame:
        n, d = _numbered(np.array(v.tolist(), float).reshape(len(v), -1), at)
        return pd.DataFrame({"cluster": n, "near2": d})

    return rows.withColumn("_n", one("v")).select("*", "_n.cluster", "_n.near2").drop("_n")


def _sums(rows: DataFrame, centres: list[list[float]]) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Per centre the number and sum of the rows nearest to it, and the sums of squared
    and plain distances, in one scan; a row a partition and centre reaches the driver."""
    at = np.array(centres, float)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, e, d = np.zeros(len(at), np.int64), np.zeros(at.shape), 0.0, 0.0
        for b in batches:
            v = np.array(b["v"].tolist(), float).reshape(len(b), -1)
            if len(v):
                c, near = _numbered(v, at)
                np.add.at(n, c, 1)
                np.add.at(total, c, v)
                e, d = e + near.sum(), d + np.sqrt(near).sum()
        yield pd.DataFrame({"pid": [TaskContext.get().partitionId()], "n": [n.tolist()], "s": [total.ravel().tolist()], "e": [e], "d": [d]})

    got = sorted(rows.select("v").mapInPandas(scan, "pid int, n array<long>, s array<double>, e double, d double").collect(), key=lambda r: r["pid"])
    return sum(np.array(r["n"]) for r in got), sum(np.array(r["s"]).reshape(at.shape) for r in got), sum(r["e"] for r in got), sum(r["d"] for r in got)


def farthest_centres(rows: DataFrame, key: str, k: int) -> list[list[float]]:
    """Seeds: the row of least component sum, then each time the row farthest from
    the seeds so far; ties go to the lowest key. One aggregation per seed."""
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    first = rows.agg(F.min_by("v", F.struct(total, key)).alias("v")).first()["v"]
    centres = [list(first)] if first else []
    while first and len(centres) < k:
        far = nearest(rows, centres).agg(F.min_by("v", F.struct(-F.col("near2"), F.col(key))).alias("v")).first()["v"]
        centres.append(list(far))
    return centres


def kmeans(rows: DataFrame, key: str, k: int, most: int = 100) -> tuple[DataFrame, list[list[float]], list[float]]:
    """MDL19: Lloyd's iterations from farthest seeds over rows (key, v) until the
    centres repeat; an empty cluster keeps its centre. Every iteration is one
    scan with sums per partition; only those reach the driver. Gives the rows with
    their cluster, the centres and the inertia of each round. An empty table has no
    centres and gives no rows."""
    kept = cut(rows.select(key, "v"))
    centres, history = farthest_centres(kept, key, k), []
    if not centres:
        return kept.withColumn("cluster", F.lit(0)), [], []
    for _ in range(most):
        n, total, e, _ = _sums(kept, centres)
        history.append(round(e, 6))
        new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
        if np.allclose(new, centres, rtol=0, atol=1e-12):
            break
        centres = new.tolist()
    return nearest(kept, centres).select(key, "v", "cluster"), centres, history


def _schedule(epoch: int, epochs: int, k: int, rate: float, radius: float | None) -> tuple[float, float]:
    """Rate and radius of an epoch: both fall by e to the third; the radius to .15 at least."""
    fall = np.exp(-3.0 * epoch / max(1, epochs - 1))
    return max(0.01, min(1.0, rate)) * fall, max(0.15, max(0.5, max(1.0, k / 2) if radius is None else radius) * fall)


def _influence(k: int, radius: float, ring: bool) -> np.ndarray:
    """How far a row of one neuron moves each neuron."""
    d = np.abs(np.arange(k)[:, None] - np.arange(k)[None, :])
    d = np.minimum(d, k - d) if ring else d
    return np.exp(-(d**2) / (2 * radius * radius))


def som(rows: DataFrame, key: str, k: int, epochs: int = 20, ring: bool = False, radius: float | None = None) -> tuple[DataFrame, list[list[float]], list[float]]:
    """MDL20: one-dimensional self-organising map in its batch form: each epoch (5 to
    500) moves every neuron to the mean of all rows, weighted by the influence of their
    winners. One scan an epoch; the result does not depend on partitions or the order of
    rows. Gives rows with their cluster, the neurons and the mean distance of each epoch.
    online_som is the form that moves row by row."""
    kept = cut(rows.select(key, "v"))
    centres, history, epochs = farthest_centres(kept, key, k), [], max(5, min(epochs, 500))
    if not centres:
        return kept.select(key, F.lit(0).alias("cluster")), [], []
    n, total, _, _ = _sums(kept, centres)
    for e in range(epochs):
        h = _influence(k, _schedule(e, epochs, k, 1.0, radius)[1], ring)
        weight = h.T @ n
        centres = np.where(weight[:, None] > 1e-300, (h.T @ total) / np.maximum(weight, 1e-300)[:, None], centres).tolist()
        n, total, _, d = _sums(kept, centres)
        history.append(round(d / max(1, n.sum()), 6))
    return nearest(kept, centres).select(key, "cluster"), centres, history


def online_som(rows: DataFrame, key: str, k: int, epochs: int = 20, ring: bool = False, rate: float = 0.45, radius: float | None = None) -> tuple[DataFrame, list[list[float]], list[float]]:
    """MDL20: the map that moves after every row, in the order of the key. Every row
    depends on the one before, so the rows stream through the driver, a partition at a
    time, once an epoch: for tables of a size a person would train on."""
    kept = cut(rows.select(key, "v").orderBy(key))
    seeds, history, epochs = farthest_centres(kept, key, k), [], max(5, min(epochs, 500))
    if not seeds:
        return kept.select(key, F.lit(0).alias("cluster")), [], []
    at = np.array(seeds, float)
    for e in range(epochs):
        speed, reach = _schedule(e, epochs, k, rate, radius)
        h = _influence(k, reach, ring)
        for row in kept.select("v").toLocalIterator():
            v = np.array(row["v"], float)
            at += speed * h[int(((at - v) ** 2).sum(axis=1).argmin())][:, None] * (v - at)
        n, _, _, d = _sums(kept, at.tolist())
        history.append(round(d / max(1, n.sum()), 6))
    return nearest(kept, at.tolist()).select(key, "cluster"), at.tolist(), history


def silhouette(rows: DataFrame, key: str, part: int = 1000) -> DataFrame:
    """MDL21: mean silhouette over all rows (key, v, cluster), each against all
    others; a lone row has 0. Parts of about `part` rows, by the hash of the key,
    meet part by part, and give one sum a row and cluster."""
    kept = rows.select(key, "v", "cluster")
    parts = -(-kept.count() // part) or 1
    number = lambda n: F.lit(n).cast("long")  # noqa: E731  one type on both sides, else equal parts hash to different partitions and never meet
    split = kept.withColumn("p", F.pmod(F.xxhash64(key), number(parts)))
    met = lambda s, o: split.select("*", F.explode(F.sequence(number(0), number(parts - 1))).alias("o")).select(F.col("p").alias(s), F.col("o").alias(o), key, "v", "cluster")
    shape = f"a {kept.schema[key].dataType.simpleString()}, ca int, cb int, s double, n long"

    def sums(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = []
        va, ka = np.array(x["v"].tolist(), dtype=float), x[key].to_numpy()
        # a part may be empty, as a hash spreads few rows unevenly
        for cluster, other in y.groupby("cluster") if len(x) else ():
            total, vb = np.zeros(len(x)), np.array(other["v"].tolist(), dtype=float)
            for v in vb:
                total += np.sqrt(((va - v) ** 2).sum(axis=1))
            # a row is none of its own neighbours; its distance to itself is 0
            n = len(other) - np.isin(ka, other[key].to_numpy())
            out.append(pd.DataFrame({"a": ka, "ca": x["cluster"], "cb": cluster, "s": total, "n": n}))
        return pd.concat(out) if out else pd.DataFrame({"a": x[key][:0], "ca": [], "cb": [], "s": [], "n": []})

    cells = met("p", "q").groupBy("p", "q").cogroup(met("q", "p").groupBy("p", "q")).applyInPandas(sums, shape)
    mean = cells.groupBy("a", "ca", "cb").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("d"))
    per = mean.groupBy("a", "ca").agg(F.min(F.when(F.col("ca") == F.col("cb"), F.col("d"))).alias("own"), F.min(F.when(F.col("ca") != F.col("cb"), F.col("d"))).alias("other"))
    value = F.when(F.col("own").isNull() | F.col("other").isNull(), 0.0).otherwise((F.col("other") - F.col("own")) / F.nullif(F.greatest("own", "other"), F.lit(0.0)))
    return per.agg(F.round(F.avg(value), 4).alias("silhouette"), F.count("*").alias("n"))


def ranked(rows: DataFrame, centres: list[list[float]], directions: list[int]) -> DataFrame:
    """MDL23: rank of each cluster by its centre along the directions, best first."""
    score = [sum(x * s for x, s in zip(c, directions)) for c in centres]
    order = sorted(range(len(score)), key=lambda i: (-score[i], i))
    ranks = F.create_map(*[F.lit(x) for i, c in enumerate(order) for x in (c, i + 1)])
    return rows.withColumn("rank", ranks[F.col("cluster")])


def profiles(rows: DataFrame, names: list[str]) -> DataFrame:
    """MDL23, AGG35: quartiles of each feature per cluster."""
    long = rows.unpivot("cluster", names, "feature", "value")
    n = long.groupBy("cluster", "feature").agg(F.count("value").alias("n"))
    p = quantiles(long, "value", [0.25, 0.5, 0.75], ("cluster", "feature"))
    return n.join(p, ["cluster", "feature"], "left").select("cluster", "feature", "n", *[F.col("p")[i].alias(x) for i, x in enumerate(("q1", "q2", "q3"))])


def group_statistics(members: DataFrame, value: str) -> DataFrame:
    """AGG35, SET06: per group distinct members, repeats and P10, P50, P90."""
    n = members.groupBy("grp", "well").agg(F.count("*").alias("n")).groupBy("grp").agg(F.count("well").alias("wells"), (F.sum("n") - F.count("well")).alias("repeats"))
    return n.join(quantiles(members, value, [0.1, 0.5, 0.9], ("grp",)), "grp", "left").select("grp", "wells", "repeats", *[F.col("p")[i].alias(x) for i, x in enumerate(("p10", "p50", "p90"))])


def plan_agreement(plans: DataFrame) -> DataFrame:
    """MDL25: of wells (plan, well, rank, k) in all plans the spread of their rank
    position (P90 - P10), reliability and whether it is stable."""
    all_ = plans.agg(F.countDistinct("plan").alias("plans"))
    pos = F.col("rank") / F.nullif(F.col("k"), F.lit(0))
    per = plans.groupBy("well").agg(F.countDistinct("plan").alias("n"), F.percentile(pos, [0.1, 0.9]).alias("p")).crossJoin(all_).where("n = plans")
    spread = F.col("p")[1] - F.col("p")[0]
    return per.select("well", spread.alias("spread"), F.greatest(F.lit(0.0), 1 - spread).alias("reliability"), (spread <= 0.2).alias("stable"))


def jaccard_by_rank(plans: DataFrame, a: str, b: str) -> DataFrame:
    """SET07: shared wells of two plans' groups of the same rank over all of both."""
    x, y = (plans.where(F.col("plan") == p).select("rank", "well").distinct().withColumn(s, F.lit(1)) for p, s in ((a, "x"), (b, "y")))
    return x.join(y, ["rank", "well"], "full").groupBy("rank").agg((F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()) / F.count("*")).alias("jaccard"))


def parallel_axis(rows: DataFrame, name: str, higher_is_better: bool = True) -> DataFrame:
    """MDL26: a feature between its 2nd and 98th percentile as 0 to 1, clamped,
    turned round where lower is better."""
    p = quantiles(rows, name, [0.02, 0.98]).select(F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"))
    x = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(name) - F.col("lo")) / (F.col("hi") - F.col("lo"))))).otherwise(0.5)
    return rows.crossJoin(p).withColumn("axis", x if higher_is_better else 1 - x).drop("lo", "hi")


def class_links(rows: DataFrame) -> DataFrame:
    """JOIN23: rows (id, key) with the class they share a key with (its least id) and
    their number of links, instead of all pairs of a class."""
    c = rows.groupBy("key").agg(F.min("id").alias("class_id"), (F.count("*") - 1).alias("links"))
    return rows.join(c, "key").select("id", "class_id", "links")


def weighted_rates(rows: DataFrame) -> DataFrame:
    """AGG34: total volume, and volume over days as the rate, falling back to the
    mean of the wells' rates where no days are known."""
    s = rows.agg(F.sum("oil_volume").alias("oil_volume"), F.sum("days").alias("days"), F.avg("mean_rate").alias("mean_rate"))
    return s.select("oil_volume", "days", F.coalesce(F.col("oil_volume") / F.nullif("days", F.lit(0.0)), "mean_rate").alias("rate"))


def evenly_spaced(rows: DataFrame, order: list[str], k: int) -> DataFrame:
    """WIN22: k rows at evenly spaced places of an order, first and last included.
    Places come from counts per range partition, not from one ordered task."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = cut(rows.repartitionByRange(n, *order).sortWithinPartitions(*order)).withColumn("pid", F.spark_partition_id())
    counts = {r["pid"]: r["n"] for r in by.groupBy("pid").agg(F.count("*").alias("n")).collect()}  # one per partition
    total, start, at = sum(counts.values()), {}, 0
    for pid in sorted(counts):
        start[pid], at = at, at + counts[pid]
    wanted = sorted({round(i * (total - 1) / max(k - 1, 1)) for i in range(k)}) if total > k else list(range(total))
    base = F.create_map(*[F.lit(x) for kv in start.items() for x in kv]) if start else F.create_map(F.lit(0), F.lit(0))
    place = F.row_number().over(W.partitionBy("pid").orderBy(*order)) - 1 + base[F.col("pid")]
    return by.withColumn("place", place).where(F.col("place").isin(wanted)).drop("pid")
