"""File catalogue, facets, coverage and names of layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wellspring.functions.scalars import extension, file_kind, file_well_key, layer_key


def catalogued(files: DataFrame) -> DataFrame:
    """SRC34, SC18: kind, ending, folder and well key of files (path, size)."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return files.select("path", "size", extension(F.col("path")).alias("ext"), file_kind(F.col("path")).alias("kind"), folder.alias("folder"), file_well_key(F.col("path")).alias("well_key"))


def composition(catalog: DataFrame) -> DataFrame:
    """AGG15, AGG36: files, distinct wells and repeated well keys of each kind."""
    per = catalog.groupBy("kind", "well_key").agg(F.count("*").alias("n"))
    return per.groupBy("kind").agg(F.sum("n").alias("files"), F.count("*").alias("keys"), F.count_if(F.col("n") > 1).alias("repeated"))


def overlapping_categories(catalog: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """AGG16: files and bytes of categories that may overlap, in one pass."""
    one = catalog.agg(*[F.struct(F.lit(k).alias("category"), F.count_if(p).alias("files"), F.coalesce(F.sum(F.when(p, F.col("size"))), F.lit(0)).alias("bytes")).alias(f"c{i}") for i, (k, p) in enumerate(predicates.items())])
    return one.select(F.explode(F.array(*one.columns)).alias("c")).select("c.*")


def folders(catalog: DataFrame, top: int = 8) -> DataFrame:
    """AGG17, AGG20: files of each folder with its most frequent endings, ties by name."""
    n = catalog.groupBy("folder", "ext").agg(F.count("*").alias("n"))
    return n.groupBy("folder").agg(F.sum("n").alias("files"), F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "ext"))), 1, top).alias("e")).select("folder", "files", F.array_join(F.transform("e", lambda x: F.concat(x["ext"], F.lit(":"), (-x["m"]).cast("string"))), ",").alias("endings"))


def facets(catalog: DataFrame, top: int = 80) -> DataFrame:
    """AGG19: files per kind and of the largest folders (a report of the top)."""
    kinds = catalog.groupBy(F.lit("kind").alias("facet"), F.col("kind").alias("value")).agg(F.count("*").alias("n"))
    fold = catalog.groupBy(F.lit("folder").alias("facet"), F.col("folder").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(top)
    return kinds.unionByName(fold)


def coverage(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """AGG18, SET05: sizes of sets of keys, of their intersections and the union."""
    names = list(sets)
    flags = None
    for n in names:
        s = sets[n].select(key).distinct().withColumn("s", F.lit(n))
        flags = s if flags is None else flags.unionByName(s)
    per = flags.groupBy(key).agg(*[F.bool_or(F.col("s") == n).alias(n) for n in names])
    both = [F.count_if(F.col(a) & F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(names) for b in names[i + 1 :]]
    every = F.lit(True)
    for n in names:
        every = every & F.col(n)
    return per.agg(*[F.count_if(F.col(n)).alias(n) for n in names], *both, F.count_if(every).alias("every"), F.count("*").alias("any"))


def live_overlay(taxonomy: DataFrame, catalog: DataFrame) -> DataFrame:
    """AGG21, AGG22: count of each listed kind (kind), 0 where there are no files."""
    n = catalog.groupBy("kind").agg(F.count("*").alias("n"))
    return taxonomy.join(n, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("missing"))


def representative(catalog: DataFrame) -> DataFrame:
    """SRT06: one file per folder: of the most frequent ending (ties by name) the
    one of lower-median size, found by its rank in (size, path) order."""
    n = catalog.groupBy("folder", "ext").agg(F.count("*").alias("n"))
    best = n.groupBy("folder").agg(F.min(F.struct((-F.col("n")).alias("m"), "ext")).alias("b")).select("folder", F.col("b.ext").alias("ext"), (-F.col("b.m")).alias("n"))
    w = W.partitionBy("folder").orderBy("size", "path")
    rows = catalog.join(best, ["folder", "ext"]).withColumn("rn", F.row_number().over(w) - 1)
    return rows.where(F.col("rn") == F.floor((F.col("n") - 1) / 2)).select("folder", "path", "size")


def page(df: DataFrame, order: list[Column], number: int, per_page: int) -> DataFrame:
    """SRT03, SRC33: rows of a page in a total order."""
    per_page = min(500, max(20, per_page))
    return df.orderBy(*order).offset((max(1, number) - 1) * per_page).limit(per_page)


def anti_catalog(sources: DataFrame, catalog: DataFrame) -> DataFrame:
    """JOIN04, ING20: sources whose path, case aside, is not in the catalogue."""
    c = catalog.select(F.lower("path").alias("p")).distinct()
    return sources.where("file_path is not null").join(c, F.lower("file_path") == F.col("p"), "left_anti")


def tiers(names: DataFrame, query: str) -> DataFrame:
    """MDL44, FLT15: names (id, name) that hold the query, 1.0, or hold it without
    separators, 0.94."""
    bare = lambda c: F.regexp_replace(F.upper(c), "[^0-9A-Z一-鿿]", "")
    q = query.upper()
    key = "".join(ch for ch in q if ch.isalnum())
    return names.select("id", "name", F.when(F.upper("name").contains(q), 1.0).when((F.lit(key) != "") & bare(F.col("name")).contains(key), 0.94).alias("score")).where("score is not null")


def layer_registry(aliases: DataFrame) -> DataFrame:
    """AGG27, JOIN09: layer keys of alias names with their projects and entry."""
    rows = aliases.select(layer_key(F.col("alias_name")).alias("layer"), "project_root", "canonical_key")
    return rows.groupBy("layer").agg(F.count("*").alias("names"), F.countDistinct("project_root").alias("projects"), F.min("canonical_key").alias("canonical"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """SNK15: newest version of each key, by aggregation; META tables are appended
    to and read through this."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def core_photos(images: DataFrame, wells: DataFrame) -> DataFrame:
    """MDL45: well of each image path: the deepest folder that is a well key, else
    the longest well key its name begins with (found by its prefixes, an
    equality join)."""
    key = lambda c: F.regexp_replace(F.upper(c), "[^0-9A-Z]", "")
    parts = F.split("path", "/")
    name = key(F.regexp_replace(F.element_at(parts, -1), r"\.[A-Za-z0-9]+$", ""))
    rows = images.select("path", parts.alias("p"), name.alias("n"))
    folder = rows.select("path", F.posexplode(F.slice("p", 1, F.size("p") - 1)).alias("i", "f")).select("path", (F.col("i") + 1000).alias("rank"), key(F.col("f")).alias("well_key"))
    prefix = rows.where("length(n) >= 3").select("path", F.explode(F.sequence(F.lit(3), F.length("n"))).alias("rank"), "n").select("path", F.least("rank", F.lit(999)).alias("rank"), F.substring("n", F.lit(1), F.col("rank")).alias("well_key"))
    hit = folder.unionByName(prefix).join(wells.select("well_key").distinct(), "well_key")
    return images.select("path").join(hit.groupBy("path").agg(F.max_by("well_key", "rank").alias("well_key")), "path", "left")


def header_profile(headers: DataFrame, failed: DataFrame) -> DataFrame:
    """HLP05: profile of all log headers (path, well, mnemonic, unit, start, stop): per well
    and mnemonic the files, units and depth range, and how many files could not be read."""
    errors = failed.agg(F.count("*").alias("errors"))  # one row
    rows = headers.where("mnemonic is not null").groupBy("well", F.upper(F.trim("mnemonic")).alias("mnemonic"))
    return rows.agg(F.countDistinct("path").alias("files"), F.array_join(F.array_sort(F.collect_set("unit")), ",").alias("units"), F.min("start").alias("start"), F.max("stop").alias("stop")).crossJoin(errors)


def signature(files: DataFrame) -> DataFrame:
    """HLP05: one row that changes when a file (path, size) does: their number, bytes and
    the sum of their hashes, so no task sorts them."""
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.xxhash64("path", "size").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("mark"))


def is_current(saved: DataFrame, files: DataFrame) -> bool:
    """HLP05: whether a profile saved under a signature is that of these files."""
    old, now = saved.first(), signature(files).first()
    return old is not None and tuple(old) == tuple(now)


def saved_plans(texts: DataFrame) -> DataFrame:
    """HLP12: plans of other runs from JSON texts (path, content): id, name, method, number
    of groups, when saved, and one row a well with its group; texts that are no plans give
    no rows, a plan saved twice counts by its later text."""
    schema = "plan_id string, name string, method string, k int, saved_at string, members array<struct<well:string, cluster:int>>"
    p = texts.select(F.from_json("content", schema).alias("p"), "path").where("p.plan_id is not null")
    last = p.groupBy("p.plan_id").agg(F.max_by("p", F.struct("p.saved_at", "path")).alias("p"))
    return last.select("p.plan_id", "p.name", "p.method", "p.k", "p.saved_at", F.explode_outer("p.members").alias("m")).select("plan_id", "name", "method", "k", "saved_at", "m.well", "m.cluster")
