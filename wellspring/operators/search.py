"""Searches and comparisons composed of the other operators, and horizon views."""

from __future__ import annotations

import bisect
import itertools
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wellspring.functions.scalars import layer_key, listed, overlap_area
from wellspring.functions.text import name_key
from wellspring.operators.wells import _skeleton, digit_groups, distinct_wells, identity_similarity, identity_similarity_udf, multi_key_pairs, well_match_score, without_vowels

# fixed values: evidence words of time-depth data and the seismic context that excludes them
TIME_DEPTH_WORDS = (("checkshot", "check.?shot"), ("time_depth", "time.?depth|t-d"), ("vsp", r"\bvsp\b"), ("velocity", "velocity"))
SEISMIC_CONTEXT = "stack|migrat|cube|volume"
# fixed values: rules of model items, first match wins
MODEL_ITEMS = (
    ("horizon", "horizon|surface"), ("fault", "fault"), ("well", "well"), ("log", r"\blog|\.las"), ("polygon", "polygon|boundary"), ("grid", "grid|zmap"), ("seismic", "seis|segy|sgy"), ("velocity", "veloc"), ("marker", "marker|top"), ("production", "prod"),
    ("core", "core"), ("interpretation", "interp"), ("deviation", "dev|survey"), ("document", "pdf|doc|report"),
)


def time_depth_evidence(path: Column) -> Column:
    """SC19: evidence kinds told by a path, none in a seismic context."""
    low = F.lower(path)
    return F.when(low.rlike(SEISMIC_CONTEXT), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*[F.when(low.rlike(p), n) for n, p in TIME_DEPTH_WORDS])))


def model_item(path: Column) -> Column:
    """SC21: kind of a model item by ordered rules."""
    low, c = F.lower(path), F.when(F.lit(False), F.lit(""))
    for name, pattern in MODEL_ITEMS:
        c = c.when(low.rlike(pattern), name)
    return c.otherwise("other")


def volume_semantics(name: Column) -> Column:
    """SC22: domain, attribute and dimension a seismic file name tells."""
    low = F.lower(name)
    domain = F.when(low.rlike(r"depth|psdm|\btvd"), "depth").otherwise("time")
    attribute = F.when(low.rlike("coher|semblance"), "coherence").when(low.rlike("imped"), "impedance").when(low.rlike("phase"), "phase").otherwise("amplitude")
    return F.struct(domain.alias("domain"), attribute.alias("attribute"), F.when(low.rlike("line|2d"), "2d").otherwise("3d").alias("dimension"))


def translated(name: Column, glossary: dict[str, str]) -> Column:
    """SC24: words of a name replaced by a small glossary, the others kept."""
    m = F.create_map(*[F.lit(x) for kv in glossary.items() for x in kv])
    return F.array_join(F.transform(F.split(F.lower(name), r"[\s_\-]+"), lambda w: F.coalesce(F.try_element_at(m, w), w)), " ")


def layer_coverage(curves: DataFrame, hits: DataFrame) -> DataFrame:
    """AGG29, JOIN13: per layer and mnemonic the wells whose curve (well, mnemonic, start,
    stop) spans the layer's depth (well, layer, md)."""
    j = hits.join(curves, "well").where(F.col("md").between(F.col("start"), F.col("stop")))
    return j.groupBy("layer", "mnemonic").agg(F.countDistinct("well").alias("wells"))


def horizon_workbench(picks: DataFrame, hard_wells: DataFrame) -> DataFrame:
    """AGG25, AGG27: per layer the names in use (most frequent, first of equals), wells,
    wells with hard evidence, files and depth range. picks: well, name, file, md."""
    rows = picks.withColumn("layer", layer_key(F.col("name")))
    modes = rows.groupBy("layer", "name").agg(F.count("*").alias("n")).groupBy("layer").agg(F.min_by("name", F.struct((-F.col("n")).alias("m"), "name")).alias("name"), F.count("*").alias("spellings"))
    hard = hard_wells.select("well").distinct().withColumn("hard", F.lit(True))
    out = rows.join(hard, "well", "left").groupBy("layer").agg(F.countDistinct("well").alias("wells"), F.countDistinct(F.when(F.col("hard"), F.col("well"))).alias("hard_wells"), F.countDistinct("file").alias("files"), F.min("md").alias("top_md"), F.max("md").alias("base_md"))
    return out.join(modes, "layer")


def version_comparison(versions: DataFrame) -> DataFrame:
    """AGG26: each version (layer, version, nodes, low, high) against the layer's
    representative, the one of most nodes, ties by name."""
    base = versions.groupBy("layer").agg(F.min_by(F.struct("version", "nodes", "low", "high"), F.struct((-F.col("nodes")).alias("n"), "version")).alias("b"))
    j = versions.join(base, "layer")
    return j.select("layer", "version", (F.col("version") == F.col("b.version")).alias("representative"), (F.col("nodes") - F.col("b.nodes")).alias("more_nodes"), (F.col("low") - F.col("b.low")).alias("low_off"), (F.col("high") - F.col("b.high")).alias("high_off"))


def hit_coverage(hits: DataFrame) -> DataFrame:
    """AGG28, HLP04: wells computed and hit per layer (layer, well, hit, md)."""
    return hits.groupBy("layer").agg(F.count("*").alias("computed"), F.count_if(F.col("hit") & F.col("md").isNotNull()).alias("hits"))


def horizon_detail(hits: DataFrame, perforations: DataFrame, bottoms: DataFrame) -> DataFrame:
    """MDL09: per hit well (well, layer, md) the layer below, the perforated length
    inside and the length drilled below it."""
    w = W.partitionBy("well").orderBy("md", "layer")
    seg = hits.withColumn("next_md", F.lead("md").over(w)).join(bottoms.select("well", F.col("md").alias("bottom")), "well", "left").withColumn("base", F.coalesce("next_md", "bottom"))
    p = seg.join(perforations, "well", "left").withColumn("in", F.when(F.col("p_top").isNotNull() & F.col("base").isNotNull(), F.greatest(F.lit(0.0), F.least("base", "p_base") - F.greatest("md", "p_top"))))
    return p.groupBy("well", "layer", "md", "bottom").agg(F.coalesce(F.sum("in"), F.lit(0.0)).alias("perforated")).select("well", "layer", "md", "perforated", (F.col("bottom") - F.col("md")).alias("drilled_below"))


def project_identity(wells: DataFrame, threshold: float = 0.76, top: int = 150) -> DataFrame:
    """MDL38: pairs of wells (id, name, key, x, y) by similarity of their names, with
    floors for equal keys without vowels .86, equal digit groups .78, places within one
    .98 and five .92 units. Rows alike in all of these are one, under their least id. A
    report of the top pairs."""
    rows = distinct_wells(wells, "name", "key", "x", "y")
    side = lambda s: rows.select(F.col("id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("name", "key", "x", "y")])
    j = multi_key_pairs(rows).join(side("a"), "a").join(side("b"), "b")
    far = F.hypot(F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y"))
    bare, digits = without_vowels(F.col("a_key")), digit_groups(F.col("a_key"))
    floor = F.greatest(F.when(far <= 1, 0.98).when(far <= 5, 0.92).otherwise(0.0), F.when((bare == without_vowels(F.col("b_key"))) & (bare != ""), 0.86).otherwise(0.0), F.when(digits == digit_groups(F.col("b_key")), 0.78).otherwise(0.0))
    score = F.round(F.greatest(floor, identity_similarity_udf("a_name", "b_name")), 6)
    return j.select("a", "b", score.alias("score")).where(F.col("score") >= threshold).orderBy(F.desc("score"), "a", "b").limit(top)


def strong_trajectories(suggestions: DataFrame, compared: DataFrame) -> DataFrame:
    """MDL39: suggested pairs (a, b) whose trajectories (a, b, max_distance) lie within ten."""
    return suggestions.join(compared.where("max_distance <= 10"), ["a", "b"])


def _six(x: float) -> float:
    """x to six places, halves up, as round() of SQL gives it."""
    return float(Decimal(repr(x)).quantize(Decimal("1e-6"), ROUND_HALF_UP))


class _Letters:
    """Normalised names to score against many others: what they have in common as letters,
    whatever their order, is the most that their matching blocks can hold."""

    def __init__(self, texts: Iterable[str | None]) -> None:
        self.texts = list(texts)
        keys = [name_key(t) for t in self.texts]
        self.length = np.array([len(k) for k in keys], float)
        numbers = [re.findall(r"\d+", k) for k in keys]
        self.digits = np.array(["-".join(d) for d in numbers], object)
        bare = [_skeleton(k) for k in keys]
        self.bare, self.initial = np.array(bare, object), np.array([x[:1] for x in bare], object)
        # of a letter that a key has three times the first, second and third
        self.units = [[(c, i) for c, n in Counter(k).items() for i in range(n)] for k in keys]

    def table(self, columns: dict[tuple[str, int], int], rows: slice) -> np.ndarray:
        out = np.zeros((len(self.units[rows]), len(columns)), np.float32)
        for i, u in enumerate(self.units[rows]):
            out[i, [columns[x] for x in u if x in columns]] = 1
        return out


def _bounds(left: _Letters, right: _Letters, match: bool, rows: int = 64) -> Iterator[tuple[int, np.ndarray]]:
    """(i, bound): of every left text the most its scores with the right texts can be: of
    identity_similarity, or with `match` of well_match_score."""
    columns = {x: k for k, x in enumerate(sorted({x for u in right.units for x in u}))}
    there = right.table(columns, slice(None)).T.copy()
    same: dict[str, np.ndarray] = {d: np.array(k) for d, k in pd.Series(range(len(right.texts))).groupby(right.digits).indices.items() if d}
    for at in range(0, len(left.texts), rows):
        common = left.table(columns, slice(at, at + rows)) @ there
        for i, shared in enumerate(common.astype(float), at):
            both = left.length[i] + right.length
            bound = 2.0 * shared / np.where(both > 0, both, 1)
            bound[both == 0] = 1.0  # two empty names are equal
            if len(k := same.get(left.digits[i], ())):
                least = np.where(shared[k] == np.minimum(left.length[i], right.length[k]), 0.90, 0.78)
                if match and left.bare[i]:
                    least = np.maximum(least, np.where(right.bare[k] == left.bare[i], 0.96, np.where(right.initial[k] == left.initial[i], 0.88, 0.0)))
                bound[k] = np.maximum(bound[k], least)
            if match and not left.length[i]:
                bound[:] = 0.0
            yield i, bound


def _above(bound: np.ndarray, score: Callable[[int], float], place: np.ndarray, top: int, least: float = 0.0) -> list[tuple[float, int]]:
    """(score, k) of the `top` columns by rounded score, then least place: columns are scored
    in the order of their bounds until no bound left reaches the last of the top. A bound of
    0 is a score of 0."""
    slack = 1e-6  # scores are compared as rounded
    best: list[tuple[float, int, int]] = []  # (score, -place, k) in order, the last first

    def add(x: float, k: int) -> None:
        bisect.insort(best, (x, -int(place[k]), int(k)))
        if len(best) > top:
            best.pop(0)

    done, size = np.zeros(len(bound), bool), 64
    while True:
        low = max(least, best[0][0]) if len(best) >= top else least
        left = np.flatnonzero(~done & (bound > 0) & (bound >= low - slack))
        if not len(left):
            break
        if len(left) > size:
            left = left[np.argpartition(-bound[left], size)[:size]]
        for k in left[np.argsort(-bound[left], kind="stable")]:
            done[k] = True
            if len(best) < top or bound[k] >= best[0][0] - slack:
                if (x := _six(score(k))) >= least:
                    add(x, k)
        size *= 2
    if least <= 0 and (len(best) < top or best[0][0] == 0):
        none = np.flatnonzero(bound == 0)
        for k in none[np.argsort(place[none], kind="stable")][:top]:
            add(0.0, k)
    return [(x, k) for x, _, k in reversed(best)]


def number_suggestions(names: DataFrame, wells: DataFrame, least: float = 0.78) -> DataFrame:
    """JOIN22: for names (q, text) the well (id, name) most alike of those that share a
    digit group, if alike enough; ties go to the lower id. Equal texts and equal names
    are compared once, and a hot digit group in parts; of the names that share a group
    those whose letters cannot give the best score are not scored."""
    said = names.where("text is not null").select("text").distinct()
    known = wells.groupBy("name").agg(F.min("id").alias("id"))
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)))
    n = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def parts(rows: DataFrame, size: int) -> DataFrame:
        return rows.groupBy("t").agg((1 + F.floor(F.count("*") / size)).alias("parts"))

    left = said.select("text", F.explode(tokens(F.col("text"))).alias("t"))
    right = known.select("id", "name", F.explode(tokens(F.col("name"))).alias("t"))
    spread = parts(left, 2000).withColumnRenamed("parts", "lp").join(parts(right, 10_000).withColumnRenamed("parts", "rp"), "t")
    span = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    part = lambda by, c: F.pmod(F.xxhash64(by), F.col(c))
    # a given number of partitions: by their small input they would be merged to one
    left = left.join(spread, "t").select("t", part("text", "lp").alias("p"), span("rp").alias("r"), "text").repartition(n, "t", "p", "r")
    right = right.join(spread, "t").select("t", span("lp").alias("p"), part("id", "rp").alias("r"), "id", "name").repartition(n, "t", "p", "r")

    def best(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(x) and len(y):
            ids, names_, texts = y["id"].to_numpy(), y["name"].tolist(), x["text"].tolist()
            for i, bound in _bounds(_Letters(texts), _Letters(names_), match=False):
                out += [(texts[i], ids[k], s) for s, k in _above(bound, lambda k, t=texts[i]: identity_similarity(t, names_[k]), ids, 1, least)]
        return pd.DataFrame(out, columns=["text", "id", "score"])

    shape = f"text string, id {known.schema['id'].dataType.simpleString()}, score double"
    each = left.groupBy("t", "p", "r").cogroup(right.groupBy("t", "p", "r")).applyInPandas(best, shape)
    top = each.groupBy("text").agg(F.max(F.struct("score", (-F.col("id")).alias("i"))).alias("b"))
    return names.join(top, "text").select("q", (-F.col("b.i")).alias("id"), F.col("b.score").alias("score"))


def best_wells(queries: DataFrame, wells: DataFrame, top: int = 6, block: int = 500, part: int = 20_000) -> DataFrame:
    """HLP15: for query names (q, text) the `top` wells (id, name, key, sources) by match
    score of name or key, then number of sources, then id. Every query meets every well,
    in blocks of `block` queries and about `part` wells; equal texts are scored once, wells
    of equal name and key too, and wells whose letters cannot give a score among the best
    are not scored."""
    first = F.slice(F.array_sort(F.collect_list(F.struct("n", "id"))), 1, top).alias("w")
    # the best of each part of the wells of a name first, so that no task holds all of them
    few = wells.select("name", "key", "id", (-F.col("sources")).alias("n")).groupBy("name", "key", F.pmod("id", F.lit(64))).agg(first).select("name", "key", F.inline("w")).groupBy("name", "key").agg(first)
    said = queries.where("text is not null").select("text").distinct()
    number = lambda n: F.lit(n).cast("long")  # noqa: E731  one type on both sides: equal numbers of two types hash to different partitions
    blocks, parts = max(1, -(-said.count() // block)), max(1, -(-few.count() // part))
    n = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    span = lambda m: F.explode(F.sequence(number(0), number(m - 1)))
    # a given number of partitions: by their small input they would be merged to one
    left = said.select(F.pmod(F.xxhash64("text"), number(blocks)).alias("p"), span(parts).alias("r"), "text").repartition(n, "p", "r")
    right = few.select(F.pmod(F.xxhash64("name", "key"), number(parts)).alias("r"), span(blocks).alias("p"), "name", "key", F.col("w.n").alias("ns"), F.col("w.id").alias("ids")).repartition(n, "p", "r")

    def best(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(x) and len(y):
            order = sorted(range(len(y)), key=lambda k: (y["ns"].iat[k][0], y["ids"].iat[k][0]))
            y = y.iloc[order].reset_index(drop=True)
            texts, names, keys, place = x["text"].tolist(), y["name"].tolist(), y["key"].tolist(), np.arange(len(y))
            mine, by_name = _Letters(texts), _Letters(names)
            # where both say the same, one is enough
            other = [b if name_key(a) != name_key(b) else None for a, b in zip(names, keys)]
            by_key = _Letters(other) if any(other) else None
            bounds = _bounds(mine, by_name, match=True)
            for (i, bound), more in zip(bounds, _bounds(mine, by_key, match=True) if by_key else itertools.repeat(None)):
                if more is not None:
                    bound = np.maximum(bound, more[1])

                def score(k: int, t: str = texts[i]) -> float:
                    return max(well_match_score(t, names[k]), well_match_score(t, other[k]) if other[k] else 0.0)

                out += [(texts[i], s, y["ns"][k], y["ids"][k]) for s, k in _above(bound, score, place, top)]
        return pd.DataFrame(out, columns=["text", "score", "ns", "ids"])

    kind = {c: right.schema[c].dataType.simpleString() for c in ("ns", "ids")}
    each = left.groupBy("p", "r").cogroup(right.groupBy("p", "r")).applyInPandas(best, f"text string, score double, ns {kind['ns']}, ids {kind['ids']}")
    ranked = each.select("text", (-F.col("score")).alias("s"), F.inline(F.arrays_zip(F.col("ns").alias("n"), F.col("ids").alias("id"))))
    most = ranked.groupBy("text").agg(F.slice(F.array_sort(F.collect_list(F.struct("s", "n", "id"))), 1, top).alias("b"))
    placed = queries.join(most, "text").select("q", F.posexplode("b").alias("place", "r"))
    return placed.select("q", (F.col("place") + 1).alias("place"), "r.id", (-F.col("r.s")).alias("score"))


def relationship_search(text: DataFrame, wells: DataFrame, curve_types: DataFrame, layers: DataFrame) -> DataFrame:
    """MDL41: roles of the parts of a search text (q, text): well, curve or layer,
    by equality of keys. wells: key; curve_types: key; layers: key."""
    key = lambda c: F.regexp_replace(F.upper(c), "[^0-9A-Z一-鿿]", "")
    parts = text.select("q", F.explode(listed(F.col("text"))).alias("part")).withColumn("key", key(F.col("part")))
    for role, df in (("well", wells), ("curve", curve_types), ("layer", layers)):
        parts = parts.join(df.select("key").distinct().withColumn(role, F.lit(True)), "key", "left")
    return parts.select("q", "part", F.when(F.col("well"), "well").when(F.col("curve"), "curve").when(F.col("layer"), "layer").otherwise("unknown").alias("role"))


def unified_wells(heads: DataFrame, logs: DataFrame, tops: DataFrame, production: DataFrame) -> DataFrame:
    """MDL40: one row per well key from all evidence, the first non-null place by the
    fixed order of kinds. heads: key, x, y; the others: key."""
    blank = lambda df, kind, prio: df.select("key", F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.lit(kind).alias("kind"), F.lit(prio).alias("prio"))
    rows = heads.select("key", "x", "y", F.lit("head").alias("kind"), F.lit(1).alias("prio"))
    for i, (kind, df) in enumerate((("log", logs), ("top", tops), ("production", production))):
        rows = rows.unionByName(blank(df, kind, i + 2))
    rows = rows.where("key is not null and key <> ''").groupBy("key", "kind", "prio").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("prio"))).alias(c)
    return rows.groupBy("key").agg(first("x"), first("y"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


def seismic_inventory(files: DataFrame) -> DataFrame:
    """AGG23: copies of a volume under its canonical name (name, size)."""
    base = F.trim(F.regexp_replace(F.upper(F.regexp_replace("name", r"\.[A-Za-z0-9]+$", "")), r"[\s_\-]*(COPY|BACKUP|V\d+|\(\d+\))$", ""))
    return files.groupBy(base.alias("volume")).agg(F.count("*").alias("copies"), F.max("size").alias("size"))


def nearest_trace(points: DataFrame, traces: DataFrame, tolerance: float) -> DataFrame:
    """JOIN19: distance of each point (id, x, y) to the nearest trace (x, y)
    within the tolerance, through shared cells."""
    from wellspring.operators.surfaces import nearest_nodes

    return nearest_nodes(points, traces.withColumn("z", F.lit(0.0)), tolerance, tolerance).select("id", "distance")


def surface_over_seismic(surfaces: DataFrame, volumes: DataFrame, tolerance: float = 0.05, finish: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """MDL11: surfaces (surface, x0, y0, x1, y1, dx, dy) over volumes (volume, x0, y0, x1, y1,
    inline_spacing, crossline_spacing) whose boxes meet: share of the volume covered, share
    of the surface over it, and whether the surface is sampled finer than the traces by more
    than the tolerance. Boxes meet in cells as wide as the widest surface is on average, so
    the join is one of equality; a pair counts in the cell of the lower corner of what it
    shares, so no pairs are held to be made distinct. Equal boxes are compared once, a
    thousand of them or so at a time; `finish` is applied to the figures of two boxes, before
    they are repeated for their ids."""
    size = surfaces.agg(F.greatest(F.avg(F.col("x1") - F.col("x0")), F.avg(F.col("y1") - F.col("y0")), F.lit(1.0)).alias("size")).first()["size"] or 1.0
    n = int(surfaces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cell = lambda c: F.floor(F.col(c) / size)

    def side(df: DataFrame, name: str, s: str) -> DataFrame:
        shape = [c for c in df.columns if c != name]
        kept = df.distinct().withColumn("h", F.xxhash64(*shape))
        many = kept.groupBy("h").agg((1 + F.floor(F.count("*") / 1000)).alias("parts")).where("parts > 1")
        part = F.pmod(F.xxhash64(name), F.coalesce("parts", F.lit(1)))
        boxes = kept.join(many, "h", "left").groupBy(*shape, part.alias("part")).agg(F.collect_list(name).alias(name))
        in_x = boxes.withColumn("cx", F.explode(F.sequence(cell("x0"), cell("x1"))))
        in_cells = in_x.withColumn("cy", F.explode(F.sequence(cell("y0"), cell("y1"))))
        # a given number of partitions: by their small input they would be merged to few
        return in_cells.select("cx", "cy", name, *[F.col(c).alias(f"{s}_{c}") for c in shape]).repartition(n, "cx", "cy")

    both = side(surfaces, "surface", "s").join(side(volumes, "volume", "v"), ["cx", "cy"])
    low = lambda c: F.floor(F.greatest(f"s_{c}", f"v_{c}") / size)
    both = both.where((low("x0") == F.col("cx")) & (low("y0") == F.col("cy")))
    shared = overlap_area(*[tuple(F.col(f"{s}_{c}") for c in ("x0", "y0", "x1", "y1")) for s in "sv"])
    area = lambda s: F.nullif((F.col(f"{s}_x1") - F.col(f"{s}_x0")) * (F.col(f"{s}_y1") - F.col(f"{s}_y0")), F.lit(0.0))
    finer = F.least("s_dx", "s_dy") < F.least("v_inline_spacing", "v_crossline_spacing") * (1 - tolerance)
    met = both.withColumn("shared", shared).where("shared > 0").select("surface", "volume", (F.col("shared") / area("v") * 100).alias("volume_pct"), (F.col("shared") / area("s") * 100).alias("surface_pct"), finer.alias("resampled_finer"))
    return finish(met).withColumn("surface", F.explode("surface")).withColumn("volume", F.explode("volume"))


def seismic_detail(scans: DataFrame) -> DataFrame:
    """HLP08: per scanned volume (path, inline_min, ..., end_ms_max, trace_count) the numbers
    of lines, the trace grid as text, whether every place of it has a trace, and the vertical
    extent in milliseconds."""
    n = lambda c: F.col(f"{c}_max") - F.col(f"{c}_min") + 1
    out = scans.select("path", "trace_count", n("inline").alias("inlines"), n("crossline").alias("crosslines"), (F.col("end_ms_max") - F.col("delay_ms_min")).alias("extent_ms"))
    known = F.col("inlines").isNotNull() & F.col("crosslines").isNotNull()
    return out.withColumns({"grid": F.when(known, F.concat(F.col("inlines"), F.lit(" x "), F.col("crosslines"))).otherwise("line"), "full": F.when(known, F.col("trace_count") >= F.col("inlines") * F.col("crosslines"))})


def preview_section(traces: DataFrame, inline: int, width: int = 240) -> DataFrame:
    """MDL33: traces of the inline nearest to the one asked for, by crossline, at most
    `width` of them evenly spaced. One line of a survey is its unit."""
    near = traces.agg(F.min_by("inline", F.struct(F.abs(F.col("inline") - inline), "inline")).alias("pick"))  # one row
    line = traces.crossJoin(near).where(F.col("inline") == F.col("pick")).drop("pick")
    w = W.partitionBy("inline").orderBy("crossline", "trace")
    ranked = line.withColumns({"rn": F.row_number().over(w) - 1, "n": F.count("*").over(W.partitionBy("inline"))})
    step = F.greatest(F.lit(1.0), F.col("n") / width)
    return ranked.where((F.floor(F.col("rn") / step) != F.floor((F.col("rn") - 1) / step)) | (F.col("rn") == 0)).drop("rn", "n")


def quantised(values: pd.Series, limit: float) -> pd.Series:
    """MDL33: amplitudes clipped at a limit as int8, null as -128."""
    q = (values / limit * 127).clip(-127, 127).round()
    return q.fillna(-128).astype("int8")
