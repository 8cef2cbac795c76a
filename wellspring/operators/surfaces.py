"""Polygons, grids and surfaces."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wellspring.operators.ranks import quantiles
from wellspring.functions.scalars import BARRELS_PER_M3


def edges(rings: DataFrame) -> DataFrame:
    """Edges (polygon, ring, x0, y0, x1, y1) of ring points (polygon, ring, seq, x, y);
    rings close by themselves."""
    w = W.partitionBy("polygon", "ring").orderBy("seq")
    back = F.first(F.struct("x", "y")).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    nxt = F.coalesce(F.lead(F.struct("x", "y")).over(w), back)
    return rings.select("polygon", "ring", F.col("x").alias("x0"), F.col("y").alias("y0"), nxt.alias("n")).select("polygon", "ring", "x0", "y0", F.col("n.x").alias("x1"), F.col("n.y").alias("y1"))


def polygon_areas(rings: DataFrame) -> DataFrame:
    """GEO02, GEO03, ING13: shoelace area of the first ring less the others, not
    below zero, and the bounding box."""
    e = edges(rings)
    ring = e.groupBy("polygon", "ring").agg(F.abs(F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")) / 2).alias("a"), F.min("x0").alias("xa"), F.max("x0").alias("xb"), F.min("y0").alias("ya"), F.max("y0").alias("yb"), F.count("*").alias("n"))
    signed = F.when(F.col("ring") == 0, F.col("a")).otherwise(-F.col("a"))
    return ring.where("n >= 3").groupBy("polygon").agg(F.greatest(F.lit(0.0), F.sum(signed)).alias("area"), F.min("xa").alias("min_x"), F.max("xb").alias("max_x"), F.min("ya").alias("min_y"), F.max("yb").alias("max_y"))


def points_in_polygons(points: DataFrame, rings: DataFrame, cell: float, boundary: bool = True) -> DataFrame:
    """FLT02, FLT03, JOIN15: (id, polygon) of points (id, x, y) inside a polygon with
    holes; its boundary belongs to it unless asked otherwise. Points meet polygons in the grid
    cells of their bounding boxes; the exact test counts crossed edges."""
    e = edges(rings)
    box = e.groupBy("polygon").agg(F.min("x0").alias("xa"), F.max("x0").alias("xb"), F.min("y0").alias("ya"), F.max("y0").alias("yb"))
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    cells = box.withColumn("cx", span("xa", "xb")).withColumn("cy", span("ya", "yb"))
    p = points.where("x is not null and y is not null").select("id", "x", "y", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    near = p.join(cells, ["cx", "cy"]).where("x between xa and xb and y between ya and yb").select("id", "x", "y", "polygon")
    j = near.join(e, "polygon")
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    crosses = ((F.col("y0") > F.col("y")) != (F.col("y1") > F.col("y"))) & (F.col("x") < F.col("x0") + dx * (F.col("y") - F.col("y0")) / F.nullif(dy, F.lit(0.0)))
    off = F.abs(dx * (F.col("y") - F.col("y0")) - dy * (F.col("x") - F.col("x0")))
    within = F.col("x").between(F.least("x0", "x1") - 1e-9, F.greatest("x0", "x1") + 1e-9) & F.col("y").between(F.least("y0", "y1") - 1e-9, F.greatest("y0", "y1") + 1e-9)
    on_edge = within & (off <= 1e-9 * F.greatest(F.lit(1.0), F.abs(dx) + F.abs(dy)))
    hit = j.groupBy("id", "polygon").agg(F.count_if(crosses).alias("n"), F.bool_or(F.coalesce(on_edge, F.lit(False))).alias("edge"))
    return hit.where((F.col("n") % 2 == 1) | (F.col("edge") & F.lit(boundary))).select("id", "polygon")


def grid_mask(nodes: DataFrame, rings: DataFrame, x0: float, y0: float, dx: float, dy: float) -> DataFrame:
    """FLT04: nodes (row, col, value) with whether each is inside any polygon: by crossed
    edges alone, without a tolerance at the boundary. Null values are never inside."""
    p = nodes.select(F.struct("row", "col").alias("id"), (x0 + F.col("col") * dx).alias("x"), (y0 + F.col("row") * dy).alias("y"))
    inside = points_in_polygons(p, rings, 16 * max(dx, dy), boundary=False).select("id.row", "id.col").distinct().withColumn("in", F.lit(True))
    return nodes.join(inside, ["row", "col"], "left").select("row", "col", "value", (F.coalesce("in", F.lit(False)) & F.col("value").isNotNull()).alias("inside"))


def node_of(points: DataFrame, x0: float, y0: float, dx: float, dy: float) -> DataFrame:
    """JOIN18: row and column of the nearest node, half rounded to even."""
    return points.withColumns({"col": F.bround((F.col("x") - x0) / dx).cast("int"), "row": F.bround((F.col("y") - y0) / dy).cast("int")})


def sampled(points: DataFrame, nodes: DataFrame, x0: float, y0: float, dx: float, dy: float, rows: int, cols: int) -> DataFrame:
    """MDL31: value of the nearest node for points (id, x, y), with a status and the
    distance to the node: an equality join on the node."""
    at = node_of(points, x0, y0, dx, dy)
    j = at.join(nodes.select("row", "col", "value"), ["row", "col"], "left")
    inside = F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1)
    status = F.when(F.col("x").isNull() | F.col("y").isNull(), "no_coordinates").when(~inside, "outside").when(F.col("value").isNull(), "missing").otherwise("ok")
    gap = F.hypot(F.col("x") - (x0 + F.col("col") * dx), F.col("y") - (y0 + F.col("row") * dy))
    return j.select("id", status.alias("status"), F.when(inside, F.col("value")).alias("value"), F.when(inside, gap).alias("distance"))


def resampled(nodes: DataFrame, source: tuple, target: tuple) -> DataFrame:
    """MDL27: a grid on the nodes of another (x0, y0, dx, dy, rows, cols), nearest
    node, null outside."""
    x0, y0, dx, dy, rows, cols = target
    spark = nodes.sparkSession
    t = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("trow"), (F.col("id") % cols).cast("int").alias("tcol"))
    p = t.select("trow", "tcol", (x0 + F.col("tcol") * dx).alias("x"), (y0 + F.col("trow") * dy).alias("y"))
    return node_of(p, *source[:4]).join(nodes.select("row", "col", "value"), ["row", "col"], "left").select(F.col("trow").alias("row"), F.col("tcol").alias("col"), "value")


def quality(nodes: DataFrame) -> DataFrame:
    """MDL30: nodes, share missing, percentiles and values beyond three quartile ranges."""
    s = nodes.agg(F.count("*").alias("n"), F.count("value").alias("valid"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")).crossJoin(quantiles(nodes, "value", [0.05, 0.25, 0.5, 0.75, 0.95]))  # one row each
    low, high = F.col("p")[1] - 3 * (F.col("p")[3] - F.col("p")[1]), F.col("p")[3] + 3 * (F.col("p")[3] - F.col("p")[1])
    out = nodes.crossJoin(s.select(low.alias("low"), high.alias("high"))).agg(F.count_if((F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))).alias("outliers"))  # one row
    return s.crossJoin(out).select("n", "valid", ((F.col("n") - F.col("valid")) / F.col("n") * 100).alias("missing_pct"), *[F.col("p")[i].alias(x) for i, x in enumerate(("p05", "p25", "p50", "p75", "p95"))], "mean", "std", "outliers")


def missing_map(nodes: DataFrame, rows: int, cols: int, blocks: int = 16) -> DataFrame:
    """MDL30: share missing in blocks x blocks parts, larger parts first, north on top."""
    def part(i: Column, n: int) -> Column:
        q, r = divmod(n, blocks)
        return F.when(i < r * (q + 1), F.floor(i / (q + 1))).otherwise(r + F.floor((i - r * (q + 1)) / max(q, 1))).cast("int")

    north = F.lit(rows - 1) - F.col("row")
    return nodes.groupBy(part(north, rows).alias("block_row"), part(F.col("col"), cols).alias("block_col")).agg((F.count_if(F.col("value").isNull()) / F.count("*") * 100).alias("missing_pct"))


def trapezoid(rows: int, cols: int) -> Column:
    """Quadrature weight of a node: a half at edges, a quarter at corners."""
    edge = lambda c, n: F.when(F.col(c).isin(0, n - 1), 0.5).otherwise(1.0)
    return edge("row", rows) * edge("col", cols)


def volumes(nodes: DataFrame, rows: int, cols: int, dx: float, dy: float, parameters: dict[str, float]) -> DataFrame:
    """MDL28: bulk, pore, oil in place and recoverable volumes of a thickness grid
    (value, metres) with constant parameters; shares above 1 are per cent."""
    p = {k: v / 100 if k in ("net", "porosity", "saturation", "recovery") and v > 1 else v for k, v in parameters.items()}
    good = nodes.where("value is not null and value > 0").withColumn("w", trapezoid(rows, cols))
    bulk = F.sum(F.col("value") * F.col("w")) * dx * dy
    out = good.agg(F.count("*").alias("nodes"), F.sum(F.col("w") * dx * dy).alias("area"), bulk.alias("bulk"))
    pore = F.col("bulk") * p["net"] * p["porosity"]
    oil = pore * p["saturation"] / p["volume_factor"]
    return out.select("nodes", "area", "bulk", pore.alias("pore"), oil.alias("in_place"), (oil * p["recovery"]).alias("recoverable"), (oil * BARRELS_PER_M3).alias("in_place_bbl"), (oil * p["gas_oil_ratio"]).alias("gas"))


def preview(nodes: DataFrame, rows: int, cols: int, most: int = 180) -> DataFrame:
    """MDL29: every n-th row and column so that at most `most` are left."""
    r, c = -(-rows // most), -(-cols // most)
    return nodes.where((F.col("row") % r == 0) & (F.col("col") % c == 0))


def correlations(nodes: DataFrame, surfaces: list[str], least: int = 10) -> DataFrame:
    """MDL32: Pearson correlation of every two surfaces over nodes valid in all."""
    wide = nodes.where(F.col("surface").isin(surfaces)).groupBy("row", "col").agg(*[F.max(F.when(F.col("surface") == s, F.col("value"))).alias(f"s{i}") for i, s in enumerate(surfaces)])
    good = wide.dropna()
    pairs = [(i, j) for i in range(len(surfaces)) for j in range(i + 1, len(surfaces))]
    one = good.agg(F.count("*").alias("n"), *[F.corr(f"s{i}", f"s{j}").alias(f"r{i}_{j}") for i, j in pairs])
    return one.select("n", F.explode(F.array(*[F.struct(F.lit(surfaces[i]).alias("a"), F.lit(surfaces[j]).alias("b"), F.round(f"r{i}_{j}", 4).alias("r")) for i, j in pairs])).alias("p")).where(F.col("n") >= least).select("p.a", "p.b", "p.r", (F.abs("p.r") >= 0.9).alias("strong"))


def principal_shares(vectors: DataFrame, column: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """MDL22, MDL32: share of variance and axes of a table of k-vectors; second
    moments come from one aggregation, the k by k problem is solved here. The
    largest loading of an axis is positive."""
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = vectors.agg(F.count("*").alias("n"), *[F.sum(F.col(column)[i] * F.col(column)[j]).alias(f"m{i}_{j}") for i, j in pairs]).first()
    m = np.zeros((k, k))
    for i, j in pairs:
        m[i, j] = m[j, i] = (row[f"m{i}_{j}"] or 0.0) / max(row["n"], 1)
    values, axes = np.linalg.eigh(m)
    values, axes = values[::-1], axes[:, ::-1]
    sign = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(k)])
    return values / max(values.sum(), 1e-300), axes * np.where(sign == 0, 1, sign)


def nearest_nodes(points: DataFrame, nodes: DataFrame, cell: float, tolerance: float) -> DataFrame:
    """JOIN17: nearest scattered node (x, y, z) of points (id, x, y) within the
    tolerance: nodes and points meet in cells as wide as the tolerance."""
    size = max(cell, tolerance)
    n = nodes.select(F.col("x").alias("nx"), F.col("y").alias("ny"), "z", F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    q = points.select("id", "x", "y", around.alias("a")).select("id", "x", "y", (F.floor(F.col("x") / size) + F.col("a.i")).alias("cx"), (F.floor(F.col("y") / size) + F.col("a.j")).alias("cy"))
    d = F.hypot(F.col("x") - F.col("nx"), F.col("y") - F.col("ny"))
    return q.join(n, ["cx", "cy"]).withColumn("d", d).where(F.col("d") <= tolerance).groupBy("id").agg(F.min(F.struct("d", "nx", "ny", "z")).alias("b")).select("id", F.col("b.z").alias("z"), F.col("b.d").alias("distance"))


def surface_hits(path: DataFrame, nodes: DataFrame, grid: tuple) -> DataFrame:
    """MDL07: depth where each path (well, md, x, y, tvdss) first reaches a regular
    surface; of both row orders the one that puts more stations on valid nodes."""
    from wellspring.operators.trajectory import first_crossing

    x0, y0, dx, dy, rows, cols = grid
    at = node_of(path, x0, y0, dx, dy)
    v = nodes.where("value is not null and abs(value) < 1e29").select("row", "col", "value")
    up = at.join(v, ["row", "col"], "left")
    both = up.join(v.select((rows - 1 - F.col("row")).alias("row"), "col", F.col("value").alias("flipped")), ["row", "col"], "left")
    better = both.agg((F.count("flipped") > F.count("value")).alias("flip"))  # one row
    diff = F.col("tvdss") - F.when(F.col("flip"), F.col("flipped")).otherwise(F.col("value"))
    return first_crossing(both.crossJoin(better).select("well", "md", diff.alias("diff")))


def plane_fit(traces: DataFrame) -> DataFrame:
    """MDL10: coordinates as affine functions of line numbers (inline, crossline, x, y),
    by the normal equations from one aggregation, solved in closed form."""
    i, c, x, y = (F.col(n) for n in ("inline", "crossline", "x", "y"))
    mean = traces.agg(*[F.avg(n).alias(f"m_{n}") for n in ("inline", "crossline", "x", "y")], F.count("*").alias("n"))
    d = traces.crossJoin(mean)  # one row
    di, dc, dx, dy = (F.col(n) - F.col(f"m_{n}") for n in ("inline", "crossline", "x", "y"))
    s = d.agg(F.sum(di * di).alias("ii"), F.sum(di * dc).alias("ic"), F.sum(dc * dc).alias("cc"), F.sum(di * dx).alias("ix"), F.sum(dc * dx).alias("cx"), F.sum(di * dy).alias("iy"), F.sum(dc * dy).alias("cy"), *[F.first(f"m_{n}").alias(f"m_{n}") for n in ("inline", "crossline", "x", "y")], F.first("n").alias("n"))
    det = F.nullif(F.col("ii") * F.col("cc") - F.col("ic") * F.col("ic"), F.lit(0.0))
    s = s.select("*", ((F.col("ix") * F.col("cc") - F.col("cx") * F.col("ic")) / det).alias("x_inline"), ((F.col("cx") * F.col("ii") - F.col("ix") * F.col("ic")) / det).alias("x_crossline"), ((F.col("iy") * F.col("cc") - F.col("cy") * F.col("ic")) / det).alias("y_inline"), ((F.col("cy") * F.col("ii") - F.col("iy") * F.col("ic")) / det).alias("y_crossline"))
    return s.select("n", "x_inline", "x_crossline", (F.col("m_x") - F.col("x_inline") * F.col("m_inline") - F.col("x_crossline") * F.col("m_crossline")).alias("x_0"), "y_inline", "y_crossline", (F.col("m_y") - F.col("y_inline") * F.col("m_inline") - F.col("y_crossline") * F.col("m_crossline")).alias("y_0"))
