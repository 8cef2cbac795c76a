"""Best representative of each duplicate group.

Fields that depend on each other form bundles, and a bundle survives whole from
one record. Per group the records of each bundle are ordered by trust; bundles
are chosen together by branch and bound, maximising trust under functional
dependencies (records that state different values of a determinant's dependent
may not be mixed). Before the search, of the records of a bundle that state the
same dependent values only the most trusted is kept: it dominates the others.
That reduction is an aggregation with map-side combining, so a group of any
size reaches the search as one candidate per stated value.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: figures that stand for "not known"
PLACEHOLDERS = (0.0, -1.0, -99.0, -999.0, -999.25, -9999.0, -9999.25, -99999.0, 9999.0, 99999.0, 999999.0)
# fixed values: how free-entered data types name a trusted type, in this order
TYPE_WORDS = {
    "well_head": r"well[\s_-]*head|井头|井口",
    "deviation": r"\bdev|devn|deviation|井斜",
    "core": r"core|岩心",
    "las": r"\blas\b|\.las|well log|测井",
    "interpretation": r"interp|解释",
    "production": r"prod|产量|生产",
    "other": r".*\S.*",
}


def source_type(text: Column) -> Column:
    """Trusted type meant by a free-entered data type; null and blank are null."""
    low = F.lower(F.trim(text))
    c = F.when(F.lit(False), F.lit(""))
    for name, words in TYPE_WORDS.items():
        c = c.when(low.rlike(words), name)
    return c


def best_bundles(candidates: dict[str, list[tuple[tuple, dict]]]) -> dict[str, int]:
    """Choose one candidate per bundle, trust maximal, dependencies kept.

    candidates: per bundle (trust, stated values of determinants), greater
    trust better. Trust is compared bundle by bundle in the order given, an
    unfilled bundle being worst. Returns the index chosen for each bundle.
    """
    names = list(candidates)
    order = {b: sorted(range(len(candidates[b])), key=lambda i: candidates[b][i][0], reverse=True) for b in names}
    # bound: the best trust each remaining bundle could have
    top = [(1, candidates[b][order[b][0]][0]) if candidates[b] else (0, ()) for b in names]
    best: list = [None, {}]

    def branch(at: int, trust: tuple, stated: dict, chosen: dict) -> None:
        if best[0] is not None and trust + tuple(top[at:]) <= best[0]:
            return
        if at == len(names):
            best[:] = [trust, chosen]
            return
        b = names[at]
        for i in order[b]:
            t, says = candidates[b][i]
            if all(stated.get(k, v) == v for k, v in says.items()):
                branch(at + 1, (*trust, (1, t)), {**stated, **says}, {**chosen, b: i})
        branch(at + 1, (*trust, (0, ())), stated, chosen)

    branch(0, (), {}, {})
    return best[1]


_CHOICE = T.ArrayType(T.StructType([T.StructField("bundle", T.StringType()), T.StructField("record_id", T.LongType())]))


@F.pandas_udf(_CHOICE)
def _choose(groups: pd.Series) -> pd.Series:
    out = []
    for rows in groups:
        by: dict[str, list] = {}
        for r in sorted(rows, key=lambda r: r["priority"]):
            says = {k: v for k, v in zip(r["determinants"], r["stated"]) if v is not None}
            by.setdefault(r["bundle"], []).append(((-r["rank"], r["recency"], r["record_id"]), says, r["record_id"]))
        chosen = best_bundles({b: [(t, s) for t, s, _ in c] for b, c in by.items()})
        out.append([{"bundle": b, "record_id": by[b][i][2]} for b, i in chosen.items()])
    return pd.Series(out)


def survivors(candidates: DataFrame, determinants: tuple[str, ...] = ()) -> DataFrame:
    """(entity, bundle, record_id): the record each bundle survives from.

    candidates: entity, bundle, priority int (order of bundles), record_id,
    rank int (1 is most trusted), recency long (later is better), and string
    columns named in determinants; a null there states nothing. Ties go to the
    higher record_id. Repeated records change nothing; entities without any
    candidate give no rows; an empty input gives no rows.
    """
    said = [F.col(c) for c in determinants]
    best = F.max_by(F.struct("priority", "rank", "recency", "record_id"), F.struct(-F.col("rank"), F.col("recency"), F.col("record_id"))).alias("b")
    frontier = candidates.where("entity is not null").groupBy("entity", "bundle", *said).agg(best)
    row = F.struct("bundle", "b.priority", "b.rank", "b.recency", "b.record_id", F.array(*[F.lit(c) for c in determinants]).cast("array<string>").alias("determinants"), F.array(*said).cast("array<string>").alias("stated"))
    groups = frontier.groupBy("entity").agg(F.collect_list(row).alias("rows"))
    return groups.select("entity", F.explode(_choose("rows")).alias("c")).select("entity", "c.bundle", "c.record_id")


def _trusted_mentions(mentions: DataFrame, sources: DataFrame, trust: DataFrame) -> DataFrame:
    """Mentions of wells with the state and trust of their import.
    Sources join by equality; the trust list is fixed (one row a type)."""
    imports = sources.select(F.col("id").alias("source_id"), "status", F.unix_micros("imported_at").alias("recency"), source_type(F.col("data_type")).alias("type"))
    imports = imports.join(F.broadcast(trust.select(F.col("data_type").alias("type"), "trust_rank")), "type", "left")
    rows = mentions.where("well_id is not null").join(imports, "source_id", "left")
    return rows.withColumns(
        {"rank": F.coalesce("trust_rank", F.lit(1 << 20)), "recency": F.coalesce("recency", F.lit(-(1 << 62))), "ready": F.coalesce(F.col("status") == "ready", F.lit(False))}
    )


def _middles(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """rows with the number of their well's mentions and the middle of each field over
    the well's values that are no placeholders, as <field>_mid, in one aggregation."""
    good = {c: F.when(~F.isnan(c) & ~F.col(c).isin(*PLACEHOLDERS), F.col(c)) for c in fields}
    return rows.join(rows.groupBy("well_id").agg(F.count("*").alias("mentions"), *[F.percentile(good[c], 0.5).alias(f"{c}_mid") for c in fields]), "well_id")


def _usable(field: str) -> Column:
    """Present, no placeholder, and within a fifth of the middle."""
    mid = F.col(f"{field}_mid")
    return F.coalesce(F.col("ready") & ~F.isnan(field) & ~F.col(field).isin(*PLACEHOLDERS) & (F.abs(F.col(field) - mid) <= F.abs(mid) * 0.2 + 1e-9), F.lit(False))


def _offer(bundle: str, priority: int, usable: Column, **stated: Column) -> Column:
    """A candidate of a bundle with what it states, or null where it is not usable."""
    said = [(stated[d] if d in stated else F.lit(None)).cast("string").alias(d) for d in DETERMINANTS]
    return F.when(usable, F.struct(F.lit(bundle).alias("bundle"), F.lit(priority).alias("priority"), *said))


# what candidates state: the imports that elevation and depth come from, and the identifier
DETERMINANTS = ("kb_import", "td_import", "uwi_key")


def _offered(rows: DataFrame, offers: list[Column]) -> DataFrame:
    each = rows.select(F.col("well_id").alias("entity"), F.col("id").alias("record_id"), "rank", "recency", F.explode(F.array_compact(F.array(*offers))).alias("o"))
    return each.select("entity", "record_id", "rank", "recency", "o.*")


def _measured() -> list[Column]:
    """Candidates of elevation, depth and the preferred source. The preferred source
    depends on the other two: it states the import that one of them must come from, and
    within an import a mention usable for that field is the one that field survives from."""
    kb, td, at = _usable("kb_elevation"), _usable("total_depth"), F.col("source_id")
    return [
        _offer("kb_elevation", 1, kb, kb_import=at), _offer("total_depth", 2, td, td_import=at),
        _offer("preferred_source_id", 3, kb, kb_import=at), _offer("preferred_source_id", 3, td, td_import=at),
    ]


def well_survivors(mentions: DataFrame, sources: DataFrame, trust: DataFrame) -> DataFrame:
    """p2_found: well_id, field_name, mention_id of kb_elevation, total_depth and
    preferred_source_id of every well with at least two mentions. The search chooses the
    three together: the preferred source under the dependency that its mention is one
    that elevation or depth survives from."""
    rows = _trusted_mentions(mentions.select("id", "well_id", "source_id", "kb_elevation", "total_depth"), sources, trust)
    rows = _middles(rows, ("kb_elevation", "total_depth"))
    chosen = survivors(_offered(rows.where("mentions >= 2"), _measured()), DETERMINANTS)
    return chosen.select(F.col("entity").alias("well_id"), F.col("bundle").alias("field_name"), F.col("record_id").alias("mention_id"))


def golden_wells(mentions: DataFrame, sources: DataFrame, trust: DataFrame) -> DataFrame:
    """One surviving record per well with several mentions: kb_elevation, total_depth
    and the preferred source as in well_survivors, identity (uwi, raw_name) and place
    (x, y, crs) as bundles; the place must not come from a mention of another uwi than
    the identity states. Wells without any usable value have no row."""
    cols = ["id", "well_id", "source_id", "raw_name", "uwi", "x", "y", "crs", "kb_elevation", "total_depth"]
    rows = _middles(_trusted_mentions(mentions.select(*cols), sources, trust), ("kb_elevation", "total_depth"))
    uwi = F.nullif(F.rpad(F.regexp_replace("uwi", "[^0-9]", ""), 13, "0"), F.lit("0" * 13))
    located = F.coalesce(F.col("ready") & F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"), F.lit(False))
    offers = [*_measured(), _offer("identity", 4, F.col("ready") & uwi.isNotNull(), uwi_key=uwi), _offer("place", 5, located, uwi_key=uwi)]
    chosen = survivors(_offered(rows.where("mentions >= 2"), offers), DETERMINANTS)
    said = mentions.select(F.col("id").alias("record_id"), *cols[2:]).dropDuplicates(["record_id"])
    of = lambda bundle, c: F.max(F.when(F.col("bundle") == bundle, F.col(c))).alias(c)
    fields = {"identity": ("raw_name", "uwi"), "place": ("x", "y", "crs"), "kb_elevation": ("kb_elevation",), "total_depth": ("total_depth",), "preferred_source_id": ("source_id",)}
    wide = chosen.join(said, "record_id").groupBy(F.col("entity").alias("well_id")).agg(*[of(b, c) for b, cs in fields.items() for c in cs])
    return wide.withColumnRenamed("source_id", "preferred_source_id")
