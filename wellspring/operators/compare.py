"""Comparison of several wells and of several layers of a well."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wellspring.operators.curves import overlaps
from wellspring.operators.trajectory import at_depths


def _known(c: str):
    return F.when(F.col(c).isNotNull() & ~F.isnan(c), F.col(c))


def compared_wells(asked: DataFrame, wells: DataFrame, bottoms: DataFrame) -> DataFrame:
    """MDL42: for each question (q, well) of two to four wells every two of them with the
    distance of their heads and bottoms and how much it changes on the way down. wells:
    well, x, y; bottoms: well, x, y. A well named twice counts once, wells unknown or
    without a place have null distances, and questions of other sizes are left out."""
    named = asked.where("well is not null").select("q", "well").distinct().join(wells.select("well", _known("x").alias("x"), _known("y").alias("y")).dropDuplicates(["well"]), "well")
    size = named.groupBy("q").agg(F.count("*").alias("wells")).where("wells between 2 and 4")
    low = bottoms.select("well", F.col("x").alias("bx"), F.col("y").alias("by")).dropDuplicates(["well"])
    rows = named.join(size, "q").join(low, "well", "left")
    # of a question there are four wells at most, so six pairs
    side = lambda s: rows.select("q", *[F.col(c).alias(f"{s}_{c}") for c in ("well", "x", "y", "bx", "by")])
    both = side("a").join(side("b"), "q").where("a_well < b_well")
    head, base = F.hypot(F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")), F.hypot(F.col("a_bx") - F.col("b_bx"), F.col("a_by") - F.col("b_by"))
    return both.select("q", F.col("a_well").alias("left_well"), F.col("b_well").alias("right_well"), head.alias("head_distance"), base.alias("bottom_distance"), (base - head).alias("separation_change"))


def shared_items(asked: DataFrame, items: DataFrame) -> DataFrame:
    """MDL42: for each question (q, well) the curves or layers (well, item) of its wells:
    in how many of them each is, and whether in all that have any."""
    named = asked.where("well is not null").select("q", "well").distinct()
    rows = named.join(items.select("well", "item").distinct(), "well")
    total = rows.groupBy("q").agg(F.countDistinct("well").alias("of"))
    return rows.groupBy("q", "item").agg(F.count("*").alias("wells")).join(total, "q").select("q", "item", "wells", (F.col("wells") == F.col("of")).alias("common"))


def resolved_layers(asked: DataFrame, tops: DataFrame, hits: DataFrame) -> DataFrame:
    """MDL43: for each layer asked for (q, well, layer, place) its depth: the first of the
    well's tops (well, layer, md, file) by file and depth, else the first surface hit (well,
    layer, md, hit, computed), and how it was found: resolved, not_intersected,
    not_computed or missing; with the number of versions and the spread of their depths."""
    t = tops.groupBy("well", "layer").agg(F.min_by("md", F.when(F.col("md").isNotNull(), F.struct("file", "md"))).alias("top_md"), F.countDistinct("file").alias("files"), (F.max("md") - F.min("md")).alias("spread"))
    h = hits.groupBy("well", "layer").agg(F.min(F.when(F.col("hit"), F.col("md"))).alias("hit_md"), F.bool_or("computed").alias("computed"), F.count("*").alias("surfaces"))
    j = asked.join(t, ["well", "layer"], "left").join(h, ["well", "layer"], "left")
    by_top = F.col("files").isNotNull()
    status = F.when(by_top | F.col("hit_md").isNotNull(), "resolved").when(F.col("computed"), "not_intersected").when(F.col("surfaces") > 0, "not_computed").otherwise("missing")
    return j.select(
        "q", "well", "layer", "place", status.alias("status"), F.when(by_top, "well top").when(F.col("hit_md").isNotNull(), "surface").alias("evidence"), F.when(by_top, F.col("top_md")).otherwise(F.col("hit_md")).alias("md"),
        F.coalesce(F.when(by_top, F.col("files")), "surfaces", F.lit(0)).alias("versions"), F.when(by_top, F.col("spread")).alias("md_spread"),
    )


def layer_intervals(layers: DataFrame, path: DataFrame, curves: DataFrame, perforations: DataFrame) -> DataFrame:
    """MDL43, WIN23: the segments between neighbouring resolved layers (q, well, layer,
    place, md) of a question by depth: thickness along hole and vertical, horizontal
    displacement, curves that cover a segment whole or in part, perforations and their
    length in it, and whether the layers were asked for in another order. path: well, md,
    x, y, tvd; curves: well, id, mnemonic, top, base; perforations: well, id, top, base."""
    known = layers.where("md is not null")
    by = W.partitionBy("q").orderBy("md", "place")
    asked = W.partitionBy("q").orderBy("place", "md")
    rows = known.withColumns({"deep": F.row_number().over(by), "said": F.row_number().over(asked)})
    rows = rows.withColumn("reordered", F.max(F.col("deep") != F.col("said")).over(W.partitionBy("q")))
    at = at_depths(path, rows.select("well", "md").distinct(), ("x", "y", "tvd"))
    rows = rows.join(at, ["well", "md"], "left").withColumn("n", F.lead(F.struct("layer", "md", "x", "y", "tvd")).over(by)).where("n is not null")
    seg = rows.select("q", "well", F.col("layer").alias("top_layer"), F.col("n.layer").alias("base_layer"), F.col("md").alias("top"), F.col("n.md").alias("base"), (F.col("n.md") - F.col("md")).alias("md_thickness"), (F.col("n.tvd") - F.col("tvd")).alias("tvd_thickness"), F.hypot(F.col("n.x") - F.col("x"), F.col("n.y") - F.col("y")).alias("displacement"), "reordered")
    seg = seg.withColumn("id", F.xxhash64("q", "well", "top", "base"))
    a = seg.select("well", "id", "top", "base").where("base > top").distinct()
    c = overlaps(a, curves.select("well", "id", "top", "base"), "well", 500.0).join(curves.select("well", F.col("id").alias("b_id"), "mnemonic"), ["well", "b_id"])
    found = c.groupBy(F.col("a_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("covered"), F.col("mnemonic")))), ",").alias("full_curves"), F.array_join(F.array_sort(F.collect_set(F.when(~F.col("covered"), F.col("mnemonic")))), ",").alias("partial_curves"))
    p = overlaps(a, perforations.select("well", "id", "top", "base"), "well", 500.0).groupBy(F.col("a_id").alias("id")).agg(F.count("*").alias("perforations"), F.sum("shared").alias("perforated"))
    out = seg.join(found, "id", "left").join(p, "id", "left").drop("id")
    return out.withColumns({"full_curves": F.coalesce("full_curves", F.lit("")), "partial_curves": F.coalesce("partial_curves", F.lit("")), "perforations": F.coalesce("perforations", F.lit(0)), "perforated": F.coalesce("perforated", F.lit(0.0))})


# fixed values: checks of a project's data, their weights, and the kinds of files they look for
CHECKS = (("well heads", 8, "well_head"), ("trajectories", 12, "deviation"), ("logs", 12, "well_log"), ("well tops", 8, "well_top"), ("3D seismic", 16, "seismic"), ("horizons", 14, "horizon"), ("faults", 10, "fault"), ("polygons", 8, "polygon"), ("production", 8, "production"))
COVERED = {"trajectories": "deviation", "logs": "well_log"}  # checks that count by the share of head wells they cover


def quality_checks(kinds: DataFrame, coverage: DataFrame) -> DataFrame:
    """MDL12: nine checks of a catalogue: whether there are files (kind, files) of a kind,
    its weight, and the factor it counts by: the share of head wells covered (kind, share)
    for trajectories and logs, else one or nothing."""
    spark = kinds.sparkSession
    listed = spark.createDataFrame([(n, w, k, COVERED.get(n)) for n, w, k in CHECKS], "name string, weight int, kind string, covers string")
    j = listed.join(kinds.groupBy("kind").agg(F.sum("files").alias("files")), "kind", "left").join(coverage.select(F.col("kind").alias("covers"), "share"), "covers", "left")
    passed = F.coalesce(F.col("files") > 0, F.lit(False))
    factor = F.when(F.col("covers").isNotNull(), F.coalesce("share", F.lit(0.0))).otherwise(F.when(passed, 1.0).otherwise(0.0))
    return j.select("name", passed.alias("passed"), "weight", F.greatest(F.lit(0.0), F.least(F.lit(1.0), factor)).alias("factor"))


def quality_grade(checks: DataFrame) -> DataFrame:
    """MDL12: whole score, its grade, and the alerts for thin coverage."""
    share = lambda n: F.max(F.when(F.col("name") == n, F.col("factor")))
    s = checks.agg(F.bround(F.sum(F.col("weight") * F.col("factor"))).cast("int").alias("score"), share("logs").alias("logs"), share("trajectories").alias("paths"), share("faults").alias("faults"))
    alerts = F.array_compact(F.array(F.when(F.col("logs") < 0.8, "few head wells have logs"), F.when(F.col("paths") < 0.8, "few head wells have trajectories"), F.when(F.col("faults") <= 0, "no fault model")))
    return s.select("score", F.when(F.col("score") >= 85, "complete").when(F.col("score") >= 70, "mostly complete").otherwise("to be completed").alias("grade"), F.array_join(alerts, "; ").alias("alerts"))


def merged_wells(children: DataFrame, merges: DataFrame) -> DataFrame:
    """ING12: rows (well_id, ...) of wells that were merged (merged_id, into_id) under the
    well that stays; a merge into a well that was merged itself goes to the last one."""
    from wellspring.operators.wells import transitive

    ends = transitive(merges.select(F.col("merged_id").cast("string").alias("alias"), F.col("into_id").cast("string").alias("canonical")))
    to = ends.select(F.col("alias").cast("long").alias("well_id"), F.col("canonical").cast("long").alias("_into"))
    return children.join(to, "well_id", "left").withColumn("well_id", F.coalesce("_into", "well_id")).drop("_into")


def with_mention(mentions: DataFrame, new: DataFrame, sources: DataFrame) -> DataFrame:
    """HLP01: preferred attributes of the wells that new mentions name, over all of their
    mentions, the new ones among them."""
    from wellspring.operators.wells import preferred_attributes

    touched = new.where("well_id is not null").select("well_id").distinct()
    cols = ["id", "well_id", "source_id", "uwi", "x", "y", "kb_elevation", "total_depth"]
    return preferred_attributes(mentions.select(*cols).join(touched, "well_id", "left_semi").unionByName(new.select(*cols)), sources)


def hits_by_kind(path: DataFrame, kind: str, nodes: DataFrame, grid: tuple | None = None, cell: float | None = None) -> DataFrame:
    """HLP09: where paths reach a surface, by its kind: regular grids by node, scattered
    points by the nearest within two and a half cells; other kinds are none to compute."""
    from wellspring.operators.ingest import scattered_hits
    from wellspring.operators.surfaces import surface_hits

    if kind == "regular_surface":
        return surface_hits(path, nodes, grid)
    if kind in ("xyz_surface", "zmap_grid"):
        return scattered_hits(path, nodes, cell)
    raise ValueError(f"surfaces of kind {kind} cannot be computed")
