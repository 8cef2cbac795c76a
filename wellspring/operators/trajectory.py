"""Well trajectories: minimum curvature, interpolation at depths, comparison, thinning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wellspring.functions.scalars import signed_angle, whole_angle

RAD = 3.141592653589793 / 180


def stations(rows: DataFrame) -> DataFrame:
    """Valid stations (well, md, inc, azi): depth not negative, inclination from 0
    to 180; of equal depths the last by id."""
    good = rows.where("md >= 0 and inc between 0 and 180 and azi is not null")
    return good.groupBy("well", "md").agg(F.max_by(F.struct("inc", "azi"), "id").alias("s")).select("well", "md", "s.inc", "s.azi")


def minimum_curvature(rows: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """MDL01: tvd and offsets by minimum curvature; the part above the first
    station is straight at its angles. With heads (well, kb) also tvdss = tvd - kb,
    null for wells without one. A window adds up the segments of a well, of which a
    survey has as many as stations."""
    w = W.partitionBy("well").orderBy("md")
    lag = lambda c, first: F.coalesce(F.lag(c).over(w), first)
    s = stations(rows).withColumns({"md0": lag("md", F.lit(0.0)), "i0": lag("inc", F.col("inc")) * RAD, "a0": lag("azi", F.col("azi")) * RAD, "i1": F.col("inc") * RAD, "a1": F.col("azi") * RAD})
    cosd = F.cos(F.col("i1") - F.col("i0")) - F.sin("i0") * F.sin("i1") * (1 - F.cos(F.col("a1") - F.col("a0")))
    s = s.withColumn("dog", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosd))))
    half = (F.col("md") - F.col("md0")) / 2 * F.when(F.col("dog") < 1e-10, 1.0).otherwise(2 / F.col("dog") * F.tan(F.col("dog") / 2))
    s = s.withColumns({"dn": half * (F.sin("i0") * F.cos("a0") + F.sin("i1") * F.cos("a1")), "de": half * (F.sin("i0") * F.sin("a0") + F.sin("i1") * F.sin("a1")), "dv": half * (F.cos("i0") + F.cos("i1"))})
    run = lambda c: F.sum(c).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    out = s.select("well", "md", "inc", "azi", (F.col("dog") / RAD).alias("dogleg"), run("dn").alias("north"), run("de").alias("east"), run("dv").alias("tvd"))
    return out if heads is None else out.join(heads.select("well", "kb"), "well", "left").withColumn("tvdss", F.col("tvd") - F.col("kb")).drop("kb")


def absolute(path: DataFrame, heads: DataFrame) -> DataFrame:
    """MDL02: offsets to coordinates and elevation from the heads (well, x, y, kb)."""
    return path.join(heads, "well").select("well", "md", (F.col("x") + F.col("east")).alias("x"), (F.col("y") + F.col("north")).alias("y"), (F.col("kb") - F.col("tvd")).alias("z"))


def rebuilt_angles(points: DataFrame, per: float = 30.0) -> DataFrame:
    """WIN16, MDL03: inclination, azimuth and dogleg per length from points
    (well, md, x, y, z); azimuth carries on where there is no horizontal step."""
    w = W.partitionBy("well").orderBy("md")
    d = points.withColumns({c: F.col(n) - F.lag(n).over(w) for c, n in (("dx", "x"), ("dy", "y"), ("dz", "z"), ("dm", "md"))})
    flat = F.hypot("dx", "dy")
    inc = F.degrees(F.atan2(flat, F.abs("dz")))
    azi = F.when(flat > 1e-9, whole_angle(F.degrees(F.atan2("dx", "dy"))))
    d = d.withColumns({"inc": inc, "azi": F.last(azi, True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))})
    turn = signed_angle(F.col("azi") - F.lag("azi").over(w)) * F.sin(F.radians("inc"))
    bend = F.hypot(F.col("inc") - F.lag("inc").over(w), turn)
    return d.select("well", "md", "inc", "azi", (bend / F.nullif("dm", F.lit(0.0)) * per).alias("severity"))


def at_depths(path: DataFrame, depths: DataFrame, columns: tuple[str, ...], bucket: float = 100.0) -> DataFrame:
    """JOIN14: columns of a path (well, md, ...) at depths (well, md), linear
    between the stations on both sides, null outside. Segments and depths meet
    in depth buckets: an equality join, spread for wells of many depths."""
    w = W.partitionBy("well").orderBy("md")
    lead = F.lead(F.struct("md", *columns)).over(w).alias("n")
    seg = path.select("well", F.col("md").alias("md0"), *[F.col(c).alias(f"{c}_0") for c in columns], lead).where("n is not null and n.md > md0")
    seg = seg.withColumn("bk", F.explode(F.sequence(F.floor(F.col("md0") / bucket), F.floor(F.col("n.md") / bucket))))
    ask = depths.select("well", "md").distinct().withColumn("bk", F.floor(F.col("md") / bucket))
    hit = ask.join(seg, ["well", "bk"]).where("md between md0 and n.md")
    t = (F.col("md") - F.col("md0")) / (F.col("n.md") - F.col("md0"))
    value = F.struct(*[(F.col(f"{c}_0") + (F.col(f"n.{c}") - F.col(f"{c}_0")) * t).alias(c) for c in columns])
    best = hit.groupBy("well", "md").agg(F.min_by(value, "md0").alias("v"))
    return ask.select("well", "md").join(best, ["well", "md"], "left").select("well", "md", *[F.col(f"v.{c}").alias(c) for c in columns])


def compared(a: DataFrame, b: DataFrame, samples: int = 100) -> DataFrame:
    """MDL04, MDL05: mean and greatest distance of two paths (well, md, x, y, z) at
    samples + 1 depths of their common range, in four classes."""
    span = lambda df, s: df.groupBy("well").agg(F.min("md").alias(f"{s}0"), F.max("md").alias(f"{s}1"))
    both = span(a, "a").join(span(b, "b"), "well").select("well", F.greatest("a0", "b0").alias("lo"), F.least("a1", "b1").alias("hi")).where("hi > lo")
    ask = both.select("well", F.explode(F.transform(F.sequence(F.lit(0), F.lit(samples)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / samples)).alias("md"))
    pa, pb = at_depths(a, ask, ("x", "y", "z")), at_depths(b, ask, ("x", "y", "z"))
    j = pa.join(pb.select("well", "md", *[F.col(c).alias(f"{c}b") for c in "xyz"]), ["well", "md"])
    d = F.sqrt(sum(F.pow(F.col(c) - F.col(f"{c}b"), F.lit(2.0)) for c in "xyz"))
    out = j.groupBy("well").agg(F.avg(d).alias("mean_distance"), F.max(d).alias("max_distance"))
    m = F.col("max_distance")
    return out.withColumn("class", F.when(m <= 1e-6, "identical").when(m <= 2, "close").when(m <= 10, "near").otherwise("different"))


def copies(files: DataFrame) -> DataFrame:
    """MDL06: groups of paths (path_id, md, x, y, z) with the same stations to 1e-7."""
    key = F.concat_ws("|", *[F.format_number(c, 7) for c in ("md", "x", "y", "z")])
    sig = files.groupBy("path_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(key)), ";"), 256).alias("signature"), F.count("*").alias("n"))
    return sig.groupBy("signature").agg(F.min("path_id").alias("first"), F.count("*").alias("copies"), F.first("n").alias("stations")).select("first", "copies", "stations")


def first_crossing(sampled: DataFrame) -> DataFrame:
    """WIN17: depth where a path (well, md, diff) first reaches diff >= 0, linear
    from the sampled station before."""
    w = W.partitionBy("well").orderBy("md")
    s = sampled.where("diff is not null").withColumns({"m0": F.lag("md").over(w), "d0": F.lag("diff").over(w)})
    cross = F.when(F.col("m0").isNull() | (F.col("d0") >= 0), F.col("md")).otherwise(F.col("m0") + (F.col("md") - F.col("m0")) * (-F.col("d0")) / (F.col("diff") - F.col("d0")))
    return s.where("diff >= 0").groupBy("well").agg(F.min_by(cross, "md").alias("md"))


def layer_segments(picks: DataFrame) -> DataFrame:
    """WIN18, WIN19: from each pick (well, layer, md, x, y, z) to the next deeper one:
    thickness along hole and vertical, horizontal displacement."""
    w = W.partitionBy("well").orderBy("md", "layer")
    n = picks.withColumn("n", F.lead(F.struct("layer", "md", "x", "y", "z")).over(w)).where("n is not null")
    return n.select("well", "layer", F.col("n.layer").alias("next_layer"), (F.col("n.md") - F.col("md")).alias("md_thickness"), F.abs(F.col("n.z") - F.col("z")).alias("vertical"), F.hypot(F.col("n.x") - F.col("x"), F.col("n.y") - F.col("y")).alias("displacement"))


def thinned(rows: DataFrame, by: str, order: str, stride: int) -> DataFrame:
    """WIN21: every stride-th row of a path, and its last."""
    w = W.partitionBy(by)
    return rows.withColumns({"rn": F.row_number().over(w.orderBy(order)), "n": F.count("*").over(w)}).where(((F.col("rn") - 1) % stride == 0) | (F.col("rn") == F.col("n"))).drop("rn", "n")


def bottoms(path: DataFrame) -> DataFrame:
    """HLP16: bottom of each path and its distance from the top."""
    ends = path.groupBy("well").agg(F.max_by(F.struct("md", "x", "y", "z"), "md").alias("b"), F.min_by(F.struct("x", "y"), "md").alias("t"))
    return ends.select("well", F.col("b.md").alias("md"), F.col("b.x").alias("x"), F.col("b.y").alias("y"), F.col("b.z").alias("z"), F.hypot(F.col("b.x") - F.col("t.x"), F.col("b.y") - F.col("t.y")).alias("reach"))


def best_path(paths: DataFrame) -> DataFrame:
    """SRT08: of several paths of a well (well, path_id, md) the one of most stations."""
    n = paths.groupBy("well", "path_id").agg(F.count("md").alias("n"))
    return n.groupBy("well").agg(F.min_by("path_id", F.struct((-F.col("n")).alias("m"), "path_id")).alias("path_id"), F.max("n").alias("stations"))
