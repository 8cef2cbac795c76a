"""Ingest transforms and small state: imports, exported tables, filters, inventories."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wellspring.functions.scalars import extension, file_kind, is_time_depth
from wellspring.functions.text import clean_text, finite
from wellspring.operators.ranks import quantiles

# fixed values: interpretation attributes by their spellings, exact or contained
ATTRIBUTES = (("porosity", "phi|por|porosity|孔隙度"), ("permeability", "perm|k|permeability|渗透率"), ("saturation", "sw|so|saturation|饱和度"), ("facies", "facies|lithology|岩性"), ("shale", "vsh|vcl|shale"))
PERFORATION_WORDS = "perf|complet|open.?hole|射孔"
EXTENSION_ORDER = ("las", "dev", "csv", "xlsx", "txt", "sgy", "segy", "shp", "geojson")


def import_file(spark: SparkSession, name: str, handler: Callable[[], DataFrame], target: str, log: str) -> str:
    """ING01: run a handler, write its rows as one partition of the target and its
    outcome to the log; a failed import leaves a row in the log and nothing else."""
    try:
        rows = handler()
        rows.withColumn("source", F.lit(name)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(target)
        status, warning = "ready", None
    except Exception as e:  # noqa: BLE001 - whatever a handler raises becomes the audit row
        status, warning = "failed", str(e).splitlines()[0][:500]
    spark.createDataFrame([(name, status, warning)], "name string, status string, warning string").withColumn("imported_at", F.current_timestamp()).write.mode("append").parquet(log)
    return status


def head_import(heads: DataFrame) -> DataFrame:
    """ING04: heads read, located, and without coordinates."""
    located = F.col("x").isNotNull() & ~F.isnan("x") & F.col("y").isNotNull() & ~F.isnan("y")
    return heads.agg(F.count("*").alias("n"), F.count_if(located).alias("located"), F.count_if(~located).alias("missing"))


def with_aliases(aliases: DataFrame, new: DataFrame) -> DataFrame:
    """ING11: alias rules with newer ones taking over. Rows: alias, canonical, saved_at."""
    both = aliases.unionByName(new)
    return both.groupBy("alias").agg(F.max_by("canonical", F.struct("saved_at", "canonical")).alias("canonical"))


def las_import(curves: DataFrame) -> DataFrame:
    """ING06: curve rows of LAS headers (mnemonic, ...) without the depth curve."""
    return curves.where(~F.upper(F.trim("mnemonic")).isin("DEPT", "DEPTH", "MD", "TDEP"))


def production_basis(rows: DataFrame) -> DataFrame:
    """ING15: daily tables give volume = rate x days, monthly ones rate = volume / days;
    liquid and water cut where both phases are known. Rows: daily, days, oil, water."""
    days = F.nullif("days", F.lit(0.0))
    rate = lambda c: F.when(F.col("daily"), F.col(c)).otherwise(F.col(c) / days)
    volume = lambda c: F.when(F.col("daily"), F.col(c) * F.col("days")).otherwise(F.col(c))
    out = rows.withColumns({"oil_rate": rate("oil"), "water_rate": rate("water"), "oil_volume": volume("oil"), "water_volume": volume("water")})
    liquid = F.when(F.col("oil_volume").isNotNull() | F.col("water_volume").isNotNull(), F.coalesce("oil_volume", F.lit(0.0)) + F.coalesce("water_volume", F.lit(0.0)))
    return out.withColumns({"liquid": liquid, "cut": F.col("water_volume") / F.nullif(liquid, F.lit(0.0)) * 100})


def perforation_rows(equipment: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """ING16: equipment rows whose words tell of perforation or completion."""
    return equipment.where(F.lower(F.concat_ws(" ", *columns)).rlike(PERFORATION_WORDS))


def first_filled(*columns: str) -> Column:
    """ING18: first of the columns that is not empty."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def with_context(wells: DataFrame, classes: DataFrame) -> DataFrame:
    """ING17: wells (key, field) with the field of the classification where given."""
    return wells.join(classes.select("key", F.col("field").alias("f2")), "key", "left").withColumn("field", F.coalesce(first_filled("f2"), "field")).drop("f2")


def catalogued_sources(sources: DataFrame, found: DataFrame) -> DataFrame:
    """ING19: imported sources as catalogue rows, size 0 where the file is missing; the
    latest import of a path counts."""
    last = sources.where("file_path is not null").groupBy("file_path").agg(F.max_by("id", F.struct("imported_at", "id")).alias("id"))
    return last.join(found.select(F.col("path").alias("file_path"), "size"), "file_path", "left").select(F.col("file_path").alias("path"), "id", F.coalesce("size", F.lit(0)).alias("size"))


def exported_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """SRC31, ING14: tables exported from a database file as parquet under their names;
    those that are missing are left out."""
    out = {}
    for n in names:
        try:
            out[n] = spark.read.parquet(f"{folder}/{n}.parquet")
        except Exception:  # noqa: BLE001 - a table that is not there
            continue
    return out


def table_by_signature(tables: dict[str, list[str]], needs: set[str]) -> str | None:
    """SRC32: name of the table that has all columns needed, the smallest of them."""
    fit = [(len(c), n) for n, c in tables.items() if needs <= {x.lower() for x in c}]
    return min(fit)[1] if fit else None


def table_category(name: str, columns: list[str]) -> str:
    """HLP14: category of an exported table by its name, then by its columns."""
    low = name.lower()
    for kind, words in (("production", ("prod", "monthly")), ("injection", ("inj",)), ("deviation", ("dev", "survey")), ("marker", ("marker", "top")), ("well", ("well", "master"))):
        if any(w in low for w in words):
            return kind
    have = {c.lower() for c in columns}
    return "deviation" if {"md", "inc"} <= have else "production" if {"date", "oil"} <= have else "other"


def case_folded(df: DataFrame) -> DataFrame:
    """HLP23: columns under lower-case names; of names that then clash the first stays."""
    seen: set[str] = set()
    keep = [F.col(f"`{c}`").alias(c.lower()) for c in df.columns if not (c.lower() in seen or seen.add(c.lower()))]
    return df.select(*keep)


def attribute_type(name: Column) -> Column:
    """SC11: interpretation type of an attribute: 0.92 by equality, 0.72 by containment
    of at least three letters, else none; in the order of the list."""
    low = F.lower(F.trim(name))
    c = F.when(F.lit(False), F.struct(F.lit("").alias("type"), F.lit(0.0).alias("confidence")))
    for t, words in ATTRIBUTES:
        c = c.when(low.isin(*words.split("|")), F.struct(F.lit(t).alias("type"), F.lit(0.92).alias("confidence")))
    for t, words in ATTRIBUTES:
        c = c.when(low.rlike("|".join(w for w in words.split("|") if len(w) >= 3)), F.struct(F.lit(t).alias("type"), F.lit(0.72).alias("confidence")))
    return c


def extension_rank(path: Column) -> Column:
    """SC26: place of a file ending in the order of preference."""
    c = F.when(F.lit(False), 0)
    for i, e in enumerate(EXTENSION_ORDER):
        c = c.when(extension(path) == e, i)
    return c.otherwise(len(EXTENSION_ORDER))


def profile_statistics(curves: DataFrame) -> DataFrame:
    """AGG05: per mnemonic the wells, samples and range over the wells' own totals."""
    per = curves.where("well_id is not null").groupBy(F.upper(F.trim("mnemonic")).alias("mnemonic"), "well_id").agg(F.sum("sample_count").alias("samples"), F.min(finite(F.col("value_min"))).alias("low"), F.max(finite(F.col("value_max"))).alias("high"), F.count("*").alias("files"))
    return per.groupBy("mnemonic").agg(F.count("*").alias("wells"), F.sum("samples").alias("samples"), F.max("files").alias("most_files"), F.min("low").alias("low"), F.max("high").alias("high"))


def curve_filter(typed: DataFrame, mnemonics: list[str] | None = None, types: list[str] | None = None, how: str = "all", wells: list | None = None) -> DataFrame:
    """FLT06, FLT07, HLP03: typed curves by mnemonics, types, classification (all,
    classified, confirmed, automatic, unclassified) and wells; unknown words fail."""
    if how not in ("all", "classified", "confirmed", "automatic", "unclassified"):
        raise ValueError(f"unknown classification: {how}")
    test = F.lit(True)
    if mnemonics:
        test = test & F.upper(F.trim("mnemonic")).isin([m.strip().upper() for m in mnemonics])
    if types:
        test = test & F.col("curve_type").isin(types)
    if wells:
        test = test & F.col("well_id").isin(wells)
    if how != "all":
        test = test & ((F.col("how") != "unclassified") if how == "classified" else (F.col("how") == how))
    return typed.where(test)


def found_in(df: DataFrame, columns: tuple[str, ...], text: str) -> DataFrame:
    """FLT14: rows with the text in any of the columns, case aside."""
    test = F.lit(False)
    for c in columns:
        test = test | F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False))
    return df.where(test)


def corrected_or_original(original: DataFrame, corrected: DataFrame | None) -> DataFrame:
    """FLT17: the corrected rows where a run is there, else the original ones."""
    return original if corrected is None else corrected


def time_depth_inventory(curves: DataFrame, sources: DataFrame) -> DataFrame:
    """AGG24, FLT10, FLT16: files, wells and curves of time-depth mnemonics of ready sources."""
    ready = sources.where("status = 'ready'").select(F.col("id").alias("source_id"))
    rows = curves.where(is_time_depth(F.col("mnemonic"))).join(ready, "source_id", "left_semi")
    return rows.groupBy(F.upper("mnemonic").alias("mnemonic")).agg(F.countDistinct("las_file_id").alias("files"), F.countDistinct("well_id").alias("wells"), F.count("*").alias("curves"))


def filter_options(curves: DataFrame, typed: DataFrame) -> DataFrame:
    """HLP02: mnemonics with their type and how it was found."""
    return typed.select(F.upper(F.trim("mnemonic")).alias("mnemonic"), "curve_type", "how").distinct()


def hull(points: set) -> list[tuple[float, float]]:
    """Corners of the convex hull, counter-clockwise (monotone chain)."""
    pts = sorted(points)

    def half(seq) -> list:
        out: list = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    return pts if len(pts) < 3 else half(pts)[:-1] + half(reversed(pts))[:-1]


def convex_hulls(points: DataFrame) -> DataFrame:
    """GEO01: hull of each survey (survey, x, y). Every partition reduces its points to
    hulls first, so only corners are shuffled."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[str, list] = {}
        for b in batches:
            for name, g in b.groupby("survey"):
                kept[name] = hull(set(kept.get(name, ())) | set(zip(g["x"], g["y"])))
        rows = [(n, x, y) for n, ring in kept.items() for x, y in ring]
        yield pd.DataFrame(rows, columns=["survey", "x", "y"])

    def final(p: pd.DataFrame) -> pd.DataFrame:
        ring = hull(set(zip(p["x"], p["y"])))
        return pd.DataFrame({"survey": p["survey"].iloc[0], "seq": range(len(ring)), "x": [q[0] for q in ring], "y": [q[1] for q in ring]})

    good = points.where("survey is not null and x is not null and y is not null").select("survey", "x", "y")
    corners = good.mapInPandas(partial, "survey string, x double, y double")
    return corners.groupBy("survey").applyInPandas(final, "survey string, seq int, x double, y double")


def newest_survey(stations: DataFrame, sources: DataFrame) -> DataFrame:
    """WIN20: stations of each well's newest survey (well, source_id, ...)."""
    when = sources.select(F.col("id").alias("source_id"), F.coalesce(F.unix_micros("imported_at"), F.lit(0)).alias("at"))
    pick = stations.select("well", "source_id").distinct().join(when, "source_id").groupBy("well").agg(F.max_by("source_id", F.struct("at", "source_id")).alias("source_id"))
    return stations.join(pick, ["well", "source_id"], "left_semi")


def order_changed(layers: DataFrame) -> DataFrame:
    """WIN23: whether layers (q, place, md) asked for in an order lie in another by depth."""
    by = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(F.col(c).alias("o"), F.col("place").alias("p")))), lambda x: x["p"])
    return layers.groupBy("q").agg((by("place") != by("md")).alias("changed"))


def seeded_sample(rows: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """SRT07: k rows chosen by a seeded hash of their key; the same rows every time. A
    sampling operator."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(k)


def clustering_method(name: str) -> tuple[str, str | None]:
    """MDL24: method that runs for a name, and a note where it is another one: hierarchical
    grouping is accepted and runs as K-means; unknown names fail."""
    known = {"kmeans": "kmeans", "som": "som", "hierarchical": "kmeans"}
    if name not in known:
        raise ValueError(f"unknown method: {name}")
    return known[name], "hierarchical grouping runs as K-means" if name == "hierarchical" else None


def training_set(features: DataFrame, names: list[str], k: int) -> tuple[DataFrame, str | None]:
    """MDL17: rows of at least three records with half of the features known, and
    why they do not suffice for k groups, if so; only K-means and maps are methods."""
    known = sum(F.when(F.col(n).isNotNull(), 1).otherwise(0) for n in names)
    rows = features.where((F.col("records") >= 3) & (known >= F.lit(len(names) / 2)))
    n = rows.count()
    why = "too few features" if len(names) < 2 else f"{n} rows for {k} groups" if n < max(3, k) else None
    return rows, why


def map_layers(path: DataFrame, perforations: DataFrame, stride: int) -> DataFrame:
    """MDL47, HLP19: every stride-th station of a path (well, md, x, y), and all inside
    perforations (well, p_top, p_base)."""
    w = W.partitionBy("well").orderBy("md")
    rows = path.withColumn("rn", F.row_number().over(w) - 1)
    inside = path.join(perforations, "well").where("md between p_top and p_base").select("well", "md").distinct().withColumn("perforated", F.lit(True))
    return rows.join(inside, ["well", "md"], "left").where((F.col("rn") % stride == 0) | F.col("perforated")).select("well", "md", "x", "y", F.coalesce("perforated", F.lit(False)).alias("perforated"))


def scattered_hits(path: DataFrame, nodes: DataFrame, cell: float) -> DataFrame:
    """MDL08: first depth where a path (well, md, x, y, tvdss) reaches a scattered surface
    (x, y, z) within two and a half cells; a surface of negative median is elevation."""
    from wellspring.operators.surfaces import nearest_nodes
    from wellspring.operators.trajectory import first_crossing

    sign = quantiles(nodes, "z", [0.5]).select(F.when(F.col("p")[0] < 0, -1.0).otherwise(1.0).alias("sign"))  # one row
    pts = path.withColumn("id", F.struct("well", "md"))
    near = nearest_nodes(pts.select("id", "x", "y"), nodes, cell, 2.5 * cell).crossJoin(sign)
    return first_crossing(pts.join(near, "id").select("well", "md", (F.col("tvdss") - F.col("z") * F.col("sign")).alias("diff")))


def preflight(files: DataFrame, ignored: tuple[str, ...] = (".git", "__pycache__", "node_modules")) -> DataFrame:
    """SRC35: predicted kinds of files (path, size) with their number and size, ignored
    folders left out."""
    keep = ~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(i) for i in ignored]))
    return files.where(keep).groupBy(file_kind(F.col("path")).alias("kind")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def fingerprint(files: DataFrame, whole: int = 2_000_000) -> DataFrame:
    """SRC19: fingerprint: SHA-1 of small files (path, content), of head, tail and size of large ones."""
    part = F.concat(F.substring("content", 1, whole // 2), F.expr(f"substring(content, -{whole // 2}, {whole // 2})"), F.length("content").cast("string").cast("binary"))
    return files.select("path", F.sha1(F.when(F.length("content") <= whole, F.col("content")).otherwise(part)).alias("sha1"))


def rings_from_rows(rows: DataFrame) -> DataFrame:
    """SRC24: ring points of polygons given as rows (name, row_no, x, y) in row order."""
    seq = F.row_number().over(W.partitionBy("name").orderBy("row_no")) - 1
    return rows.where("x is not null and y is not null").select(F.col("name").alias("polygon"), F.lit(0).alias("ring"), seq.alias("seq"), "x", "y")


def undecoded(files: DataFrame) -> DataFrame:
    """SRC30: volumes of a format without a decoder: their place with null metadata."""
    return files.where(extension(F.col("path")) == "zgy").select("path", F.lit(None).cast("long").alias("traces"), F.lit("no decoder for this format").alias("warning"))


def surface_inventory(catalog: DataFrame, imported: DataFrame) -> DataFrame:
    """HLP10, HLP18: grids of the catalogue by ending and the imported ones, the latter winning."""
    grids = catalog.where(extension(F.col("path")).isin("grd", "zmap", "xyz")).select("path", F.lit("catalog").alias("origin"))
    own = imported.select("path", F.lit("imported").alias("origin"))
    return own.unionByName(grids.join(own.select("path"), "path", "left_anti"))


def survey_row(traces: DataFrame) -> DataFrame:
    """HLP21: one row per seismic file from its traces: counts, ranges, dimension."""
    return traces.groupBy("path").agg(F.count("*").alias("traces"), F.countDistinct("inline").alias("inlines"), F.countDistinct("crossline").alias("crosslines"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y")).withColumn("dimension", F.when((F.col("inlines") > 1) & (F.col("crosslines") > 1), "3d").otherwise("2d"))


def delivery(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """SNK08: manifest of files to hand over for wanted (well_key, kind): the best
    ending of each, and what is missing."""
    best = files.groupBy("well_key", "kind").agg(F.min_by("path", F.struct(extension_rank(F.col("path")).alias("r"), F.col("path"))).alias("path"), F.count("*").alias("candidates"))
    return wanted.join(best, ["well_key", "kind"], "left").withColumn("missing", F.col("path").isNull())


def cleaned(df: DataFrame) -> DataFrame:
    """SC02, SC03: null tokens of every text column, NaN of every number, become null."""
    out = {}
    for c, t in df.dtypes:
        if t == "string":
            out[c] = clean_text(F.col(c))
        elif t == "double":
            out[c] = finite(F.col(c))
    return df.withColumns(out) if out else df
