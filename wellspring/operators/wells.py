"""Well identity: resolution, preferred attributes, evidence, joins and near pairs."""

from __future__ import annotations

import difflib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellspring.functions.scalars import identity_class_score
from wellspring.functions.text import name_key
from wellspring.tables import cut

# fixed values: how far a kind of source is preferred
PRIORITY = {"well_head": 90, "deviation": 76, "las": 62, "core": 54, "interpretation": 48, "production": 44}
OTHER_PRIORITY = 30


def kind_of(data_type: Column) -> Column:
    """Kind of a source from its free-entered type."""
    t = F.lower(F.coalesce(data_type, F.lit("")))
    return (
        F.when(t.rlike("well.?head|井头"), "well_head").when(t.rlike("dev|井斜"), "deviation").when(t.rlike("core"), "core").when(t.rlike("las"), "las")
        .when(t.rlike("interp"), "interpretation").when(t.rlike("prod"), "production").otherwise("other")
    )


def priority(kind: Column) -> Column:
    c = F.when(F.lit(False), 0)
    for k, p in PRIORITY.items():
        c = c.when(kind == k, p)
    return c.otherwise(OTHER_PRIORITY)


def resolve_wells(mentions: DataFrame, aliases: DataFrame, wells: DataFrame) -> DataFrame:
    """ING02: well of a mention (id, key, uwi) by alias rule, then key, then uwi.
    aliases: alias, canonical keys; wells: id, key, uwi (key unique)."""
    m = mentions.join(aliases.select(F.col("alias").alias("key"), "canonical"), "key", "left").withColumn("known", F.coalesce("canonical", "key"))
    by_key = wells.select(F.col("key").alias("known"), F.col("id").alias("by_key"))
    by_uwi = wells.where("uwi is not null").groupBy("uwi").agg(F.min("id").alias("by_uwi"))
    found = m.join(by_key, "known", "left").join(by_uwi, "uwi", "left")
    how = F.when(F.col("by_key").isNotNull(), F.when(F.col("canonical").isNotNull(), "alias").otherwise("key")).when(F.col("by_uwi").isNotNull(), "uwi").otherwise("new")
    return found.select("id", F.coalesce("by_key", "by_uwi").alias("well_id"), how.alias("how"))


def preferred_attributes(mentions: DataFrame, sources: DataFrame) -> DataFrame:
    """ING03: per well the first non-null of each attribute by source priority,
    then lower id, and a confidence score, as one aggregation."""
    kinds = sources.select(F.col("id").alias("source_id"), kind_of(F.col("data_type")).alias("kind"))
    rows = mentions.where("well_id is not null").join(kinds, "source_id").withColumn("prio", priority(F.col("kind")))
    order = F.struct("prio", (-F.col("id")).alias("i"))
    pick = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull() & ~F.isnan(c) if c != "uwi" else F.col(c).isNotNull(), order)).alias(c)
    out = rows.groupBy("well_id").agg(*[pick(c) for c in ("uwi", "x", "y", "kb_elevation", "total_depth")], F.max("prio").alias("top"), F.countDistinct("kind").alias("kinds"))
    flag = lambda c, n: F.when(c, n).otherwise(0)
    score = F.col("top") + flag(F.col("uwi").isNotNull(), 5) + flag(F.col("x").isNotNull() & F.col("y").isNotNull(), 3) + F.least(F.lit(4), 2 * (F.col("kinds") - 1))
    return out.select("well_id", "uwi", "x", "y", "kb_elevation", "total_depth", F.least(F.lit(100), score).cast("int").alias("confidence"))


def source_breakdown(mentions: DataFrame, sources: DataFrame) -> DataFrame:
    """AGG02: files, records and distinct wells by kind of source; children are
    aggregated before the join."""
    src = sources.where("status = 'ready'").select("id", kind_of(F.col("data_type")).alias("kind"), "record_count")
    files = src.groupBy("kind").agg(F.count("*").alias("files"), F.sum("record_count").alias("records"))
    wells = mentions.join(src.select(F.col("id").alias("source_id"), "kind"), "source_id").groupBy("kind").agg(F.countDistinct("well_id").alias("wells"))
    return files.join(wells, "kind", "left").withColumn("wells", F.coalesce("wells", F.lit(0)))


def evidence_matrix(mentions: DataFrame, sources: DataFrame) -> DataFrame:
    """AGG31: per well the number of distinct sources of each kind."""
    src = sources.select(F.col("id").alias("source_id"), kind_of(F.col("data_type")).alias("kind"))
    kinds = ["well_head", "deviation", "las", "core", "interpretation", "production", "other"]
    rows = mentions.where("well_id is not null").join(src, "source_id").groupBy("well_id", "source_id", "kind").agg(F.lit(1).alias("one"))
    return rows.groupBy("well_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])


def coordinate_spread(mentions: DataFrame) -> DataFrame:
    """SC08: diagonal of the box of a well's coordinates."""
    good = mentions.where("well_id is not null and x is not null and y is not null and not isnan(x) and not isnan(y)")
    return good.groupBy("well_id").agg(F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("spread"), F.count("*").alias("n"))


def identity_classes(mentions: DataFrame, sources: DataFrame) -> DataFrame:
    """SC09: score of each well from hard evidence (head, deviation, logs) and spread."""
    src = sources.select(F.col("id").alias("source_id"), kind_of(F.col("data_type")).alias("kind"))
    kinds = mentions.where("well_id is not null").join(src, "source_id").groupBy("well_id").agg(F.collect_set(F.when(F.col("kind").isin("well_head", "deviation", "las"), F.col("kind"))).alias("hard"))
    return kinds.join(coordinate_spread(mentions), "well_id", "left").select("well_id", identity_class_score(F.col("hard"), F.col("spread")).cast("int").alias("score"))


def coordinate_overlaps(heads: DataFrame) -> DataFrame:
    """AGG30: coordinates (2 decimals) shared by several wells."""
    xy = [F.round("x", 2).alias("x"), F.round("y", 2).alias("y")]
    rows = heads.where("x is not null and y is not null and not isnan(x) and not isnan(y)").groupBy(*xy).agg(F.countDistinct("well").alias("wells"))
    return rows.where("wells > 1")


def in_box(df: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """FLT01: rows whose coordinates lie in a box."""
    return df.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def merged(imported: DataFrame, scanned: DataFrame, key: str) -> DataFrame:
    """JOIN24, SET10: both sets, the imported ones winning."""
    return imported.unionByName(scanned.join(imported.select(key), key, "left_anti"))


def transitive(aliases: DataFrame, depth: int = 8) -> DataFrame:
    """JOIN08: canonical end of alias chains; a chain that runs into a circle, or
    is longer than 2**depth steps, ends where it has come. Pointer doubling: each
    round joins the map with itself, so depth rounds follow 2**depth steps."""
    at = aliases.groupBy("alias").agg(F.min("canonical").alias("canonical")).where("alias <> canonical")
    for _ in range(depth):
        nxt = at.select(F.col("alias").alias("canonical"), F.col("canonical").alias("further"))
        at = at.join(nxt, "canonical", "left").select("alias", F.coalesce(F.when(F.col("further") != F.col("alias"), F.col("further")), "canonical").alias("canonical"))
    return at


def next_in_order(rows: DataFrame, order: list[str], size: int, within: str | None = None) -> DataFrame:
    """(a, b): every id with the next `size` ids in the order of all rows, or those
    of them with an equal value in the string column `within`, the first of the
    order. The rows are range-sorted, so no group of equal values fills a task;
    partitions hand their first rows to the partition before."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = F.col(within) if within else F.lit("")
    by = cut(rows.select(*order, "id", group.alias("_g")).repartitionByRange(n, *order, "id").sortWithinPartitions(*order, "id").select("_g", "id"))

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, groups = [], []
        for b in batches:
            more = size - len(ids)
            ids += b["id"].tolist()[:more]
            groups += b["_g"].tolist()[:more]
        yield pd.DataFrame({"pid": [TaskContext.get().partitionId()], "ids": [ids], "groups": [groups]})

    after: dict[int, list] = {}
    carry: list = []
    # the first rows of each partition, whatever the data
    for r in sorted(by.mapInPandas(first, "pid int, ids array<long>, groups array<string>").collect(), key=lambda r: -r["pid"]):
        after[r["pid"]] = carry
        carry = (list(zip(r["ids"], r["groups"])) + carry)[:size]

    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, groups = np.zeros(0, np.int64), np.zeros(0, object)
        tail = after.get(TaskContext.get().partitionId(), [])
        end = pd.DataFrame({"id": pd.Series([i for i, _ in tail], dtype="int64"), "_g": pd.Series([g for _, g in tail], dtype=object)})
        for last, b in itertools.chain(((False, b) for b in batches), [(True, end)]):
            kept, ids, groups = len(ids), np.concatenate([ids, b["id"].to_numpy()]), np.concatenate([groups, b["_g"].to_numpy()])
            for k in range(1, size + 1):
                # pairs that end in this batch; of the neighbour's rows only those that begin here
                start = max(kept - k, 0)
                stop = min(len(ids) - k, kept) if last else len(ids) - k
                if stop > start:
                    same = groups[start:stop] == groups[start + k : stop + k]
                    yield pd.DataFrame({"a": ids[start:stop][same], "b": ids[start + k : stop + k][same]})
            ids, groups = ids[-size:], groups[-size:]

    own = by.mapInPandas(pair, "a long, b long")
    return own.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def pairs_sharing(rows: DataFrame, part: int = 500) -> DataFrame:
    """(a, b): every two ids of rows (id, key) with a key in common. A block of more
    than `part` rows is cut into parts by the hash of the id and every two parts
    meet by themselves, so no task holds the pairs of a hot key."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / part).alias("parts"))
    cut_ = rows.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    met = cut_.select("key", "id", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    met = met.select("key", "id", "part", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))
    # a given number of partitions: by their small input they would be merged to one
    side = lambda s, c: met.where(F.col("part") == F.col(c)).select("key", "p", "q", F.col("id").alias(s)).repartition(n, "key", "p", "q")
    both = side("a", "p").join(side("b", "q"), ["key", "p", "q"]).where("p < q or a < b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def digit_groups(c: Column) -> Column:
    """The digit groups of a key, joined; null where it has none."""
    found = F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1))
    return F.when(F.size(found) > 0, F.array_join(found, "-"))


def without_vowels(c: Column) -> Column:
    return F.regexp_replace(c, "[AEIOU]", "")


def _near_name_block(key: Column) -> Column:
    digits = digit_groups(key)
    return F.coalesce(F.concat(F.lit("N:"), digits), F.concat(F.lit("P:"), F.substring(key, 1, 4)))


def near_names(names: DataFrame) -> DataFrame:
    """JOIN20: (id, class_id, links) of names (id, key): the least id of the block of
    equal digit groups, or of equal first four letters where there are none, and the
    number of other rows the row is compared with: all of its block, and the next three
    on either side in the order of all keys. Links are counted, not expanded, so a block
    of any size costs one aggregation; near_name_pairs gives them as pairs. Rows of a
    null key have no links and are left out; ids are unique."""
    rows = names.where("key is not null").select("id", "key", _near_name_block(F.col("key")).alias("block"))
    blocks_ = rows.groupBy("block").agg(F.min("id").alias("class_id"), (F.count("*") - 1).alias("within"))
    near = next_in_order(rows.select("id", "key"), ["key"], 3)
    ends = near.join(rows.select(F.col("id").alias("a"), F.col("block").alias("block_a")), "a").join(rows.select(F.col("id").alias("b"), F.col("block").alias("block_b")), "b").where("block_a <> block_b")
    beyond = ends.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("beyond"))
    return rows.join(blocks_, "block").join(beyond, "id", "left").select("id", "class_id", (F.col("within") + F.coalesce("beyond", F.lit(0))).alias("links"))


def _block_pairs(rows: DataFrame, most: int, order: list[str]) -> DataFrame:
    """Pairs within blocks of rows (id, key, block, ...): all in blocks of `most` rows at
    most, else those next to each other, six apart at most, in each of the orders."""
    sizes = rows.groupBy("block").agg(F.count("*").alias("n"))
    sized = rows.join(sizes, "block")
    out = pairs_sharing(sized.where(F.col("n") <= most).select("id", F.col("block").alias("key")))
    large = sized.where(F.col("n") > most)
    for column in order:
        out = out.unionByName(next_in_order(large.select("id", "block", column), ["block", column], 6, within="block"))
    return out


def near_name_pairs(names: DataFrame, most: int = 200) -> DataFrame:
    """JOIN20: (a, b) of names (id, key) to compare: all in a block of `most` rows at
    most, the next six of a larger block in the order of keys, of reversed keys and of
    keys without vowels, and the next three in the order of all keys. near_names counts
    what blocks hold whatever their size."""
    rows = names.where("key is not null").select("id", "key", _near_name_block(F.col("key")).alias("block"), F.reverse("key").alias("backward"), without_vowels(F.col("key")).alias("bare"))
    within = _block_pairs(rows, most, ["key", "backward", "bare"])
    return within.unionByName(next_in_order(rows.select("id", "key"), ["key"], 3)).distinct()


def _keyed(wells: DataFrame) -> DataFrame:
    """(id, digits, bare, place): the three keys of wells (id, key, x, y)."""
    bare = without_vowels(F.col("key"))
    located = F.col("x").isNotNull() & ~F.isnan("x") & F.col("y").isNotNull() & ~F.isnan("y")
    place = F.when(located, F.concat_ws("|", F.bround("x").cast("long"), F.bround("y").cast("long")))
    return wells.select("id", digit_groups(F.col("key")).alias("digits"), F.when(F.length(bare) >= 3, bare).alias("bare"), place.alias("place"))


def multi_key_links(wells: DataFrame) -> DataFrame:
    """JOIN21: (id, digits_class, bare_class, place_class, links) of wells (id, key, x, y):
    the least id of each block the well is in, by digit groups, by the key without vowels
    (three letters at least) and by the place in whole units, and the number of other
    wells that share a block with it. The number comes from the sizes of the blocks and
    of their intersections, so no pairs are made and no block is too large. Nulls are in
    no block; a well in none has no class and no links; ids are unique."""
    rows = _keyed(wells)
    names = ("digits", "bare", "place")
    out = rows
    for some in itertools.chain.from_iterable(itertools.combinations(names, k) for k in (1, 2, 3)):
        known = rows.where(" and ".join(f"{c} is not null" for c in some))
        least = [F.min("id").alias(f"{some[0]}_class")] if len(some) == 1 else []
        out = out.join(known.groupBy(*some).agg((F.count("*") - 1).alias("_".join(("n", *some))), *least), list(some), "left")
    size = lambda *some: F.coalesce(F.col("_".join(("n", *some))), F.lit(0))
    links = size("digits") + size("bare") + size("place") - size("digits", "bare") - size("digits", "place") - size("bare", "place") + size(*names)
    return out.select("id", *[f"{c}_class" for c in names], links.alias("links"))


def multi_key_pairs(wells: DataFrame, most: int = 100) -> DataFrame:
    """JOIN21: (a, b) of wells (id, key, x, y) to compare: all that share a block of
    `most` wells at most; of larger blocks the next six by key, by reversed key and by
    place. multi_key_links counts what blocks hold whatever their size."""
    rows = _keyed(wells).join(wells.select("id", "key", F.coalesce("x", F.lit(0.0)).alias("x")), "id")
    keys = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}:"), c)) for c in ("digits", "bare", "place")]))
    each = rows.select("id", "key", F.reverse("key").alias("backward"), "x", F.explode(keys).alias("block"))
    return _block_pairs(each, most, ["key", "backward", "x"]).distinct()


def identity_similarity(a: str | None, b: str | None) -> float:
    """SC06: matching-blocks ratio of two normalised names, 1 for equal ones; equal
    digit groups give at least 0.78, and if one name begins with the other 0.90."""
    left, right = name_key(a), name_key(b)
    if left == right:
        return 1.0
    score = difflib.SequenceMatcher(None, left, right).ratio()
    digits = re.findall(r"\d+", left)
    if digits and digits == re.findall(r"\d+", right):
        score = max(score, 0.90 if left.startswith(right) or right.startswith(left) else 0.78)
    return score


def _scores(score, a: pd.Series, b: pd.Series) -> pd.Series:
    """Each distinct pair of texts is scored once."""
    both = pd.DataFrame({"a": a, "b": b}).astype(object)
    both = both.where(both.notna(), None)
    codes, pairs = pd.factorize(pd.Series(list(zip(both["a"], both["b"])), dtype=object))
    return pd.Series(np.array([score(x, y) for x, y in pairs], float)[codes] if len(pairs) else [], dtype=float)


@F.pandas_udf(T.DoubleType())
def identity_similarity_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return _scores(identity_similarity, a, b)


# fixed values: endings of well names that tell of a batch, not of the well
BATCH_ENDING = "(EXP|DEV|LOGS?|TZ)$"


def _skeleton(key: str) -> str:
    letters = re.sub(BATCH_ENDING, "", re.sub(r"\d+", "", key))
    return re.sub("[AEIOU]", "", letters) or letters


def well_match_score(a: str | None, b: str | None) -> float:
    """SC07: identity similarity, 0 for an empty name; with equal digit groups an equal
    skeleton (letters without batch endings and vowels) gives at least 0.96, an equal
    first letter of it at least 0.88."""
    left, right = name_key(a), name_key(b)
    if not left or not right:
        return 0.0
    score = identity_similarity(left, right)
    digits = re.findall(r"\d+", left)
    if digits and digits == re.findall(r"\d+", right):
        one, other = _skeleton(left), _skeleton(right)
        if one and one == other:
            score = max(score, 0.96)
        elif one[:1] and one[:1] == other[:1]:
            score = max(score, 0.88)
    return score


@F.pandas_udf(T.DoubleType())
def well_match_score_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return _scores(well_match_score, a, b)


def distinct_wells(wells: DataFrame, *said: str) -> DataFrame:
    """Rows that say the same become one, under their least id."""
    return wells.groupBy(*said).agg(F.min("id").alias("id"))


def identity_suggestions(wells: DataFrame, threshold: float = 0.72, top: int = 100) -> DataFrame:
    """MDL37: pairs of wells (id, name, key, uwi, x, y) that may be one: similarity of
    the names, 1.0 for equal uwi, 0.08 more within five units. Rows that are alike in all
    of these are one, under their least id. A report of the top pairs."""
    rows = distinct_wells(wells, "name", "key", "uwi", "x", "y")
    side = lambda s: rows.select(F.col("id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("name", "uwi", "x", "y")])
    both = near_name_pairs(rows.select("id", "key")).join(side("a"), "a").join(side("b"), "b")
    near = F.hypot(F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")) <= 5
    base = F.when((F.col("a_uwi") == F.col("b_uwi")) & (F.col("a_uwi") != ""), 1.0).otherwise(identity_similarity_udf("a_name", "b_name"))
    score = F.least(F.lit(1.0), base + F.when(near, 0.08).otherwise(0.0))
    return both.select("a", "b", F.round(score, 6).alias("score")).where(F.col("score") >= threshold).orderBy(F.desc("score"), "a", "b").limit(top)


def nearest_same_formation(wells: DataFrame) -> DataFrame:
    """JOIN16: distance of each well (id, x, y, formation) to the nearest of its
    formation, else to the nearest of all; null where there is no other well. Cells are
    joined with their eight neighbours until a distance no greater than a cell is found,
    which then is the least; cells start at about one well each and grow fourfold until
    one covers all wells, so every distance is proven. Wells of one place and formation are one row with a count."""
    good = wells.where("x is not null and y is not null and not isnan(x) and not isnan(y)").select("id", "x", "y", F.coalesce("formation", F.lit("")).alias("formation"))
    box = good.agg((F.max("x") - F.min("x")).alias("x"), (F.max("y") - F.min("y")).alias("y"), F.count("*").alias("n")).first()
    reach = max(box["x"] or 0.0, box["y"] or 0.0)
    sizes = [max(1.0, (box["x"] or 0.0) * (box["y"] or 0.0) / max(1, box["n"])) ** 0.5]
    while sizes[-1] < reach:
        sizes.append(sizes[-1] * 4)
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    out = good
    for name, keys in (("same", ["formation"]), ("any", [])):
        places = cut(good.groupBy("x", "y", *keys).agg(F.count("*").alias("n")))
        found = places.where("n > 1").select("x", "y", *keys, F.lit(0.0).alias(name))
        left = places.where("n = 1").count()
        for size in sizes:
            if not left:
                break
            c = [F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy")]
            open_ = places.where("n = 1").join(found.select("x", "y", *keys), ["x", "y", *keys], "left_anti")
            q = open_.select(F.col("x").alias("qx"), F.col("y").alias("qy"), *keys, *c, near.alias("n")).select("qx", "qy", *keys, (F.col("cx") + F.col("n.i")).alias("cx"), (F.col("cy") + F.col("n.j")).alias("cy"))
            d = q.join(places.select("x", "y", *keys, *c), [*keys, "cx", "cy"]).where("x <> qx or y <> qy").groupBy(F.col("qx").alias("x"), F.col("qy").alias("y"), *keys).agg(F.min(F.hypot(F.col("x") - F.col("qx"), F.col("y") - F.col("qy"))).alias(name))
            done = cut(d.where(F.col(name) <= size))
            found, left = found.unionByName(done), left - done.count()
        out = out.join(found, ["x", "y", *keys], "left")
    return out.select("id", F.coalesce("same", "any").alias("distance"))
