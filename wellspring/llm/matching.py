"""Matching entities across sources without keys.

Sorted neighbourhood: mentions and entities are sorted together under several
composite keys built from partial, noisy attributes; every mention is compared
with the nearest entities on both sides in each order, by weighted similarities
of its fields. The window counts entities, not rows, so any number of copies of
a mention cannot push an entity out of it. The global sort is a range-sort,
which spreads a hot key over partitions; each partition hands on its outermost
entities only, and a second scan of the checkpointed partitions emits the pairs.

The assignment is one-to-one between the descriptions of one source and the
entities, maximising total confidence: a source names an entity once, in as many
rows as it likes. Rows of a source that state the same name and fit the same
entity best are one description. Several sources may name one entity.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellspring.tables import cut

WINDOW = 4  # entities compared on each side, in each order, if no other window is asked for
LEAST = 0.5  # confidence below which a mention describes no entity, if no other is asked for
DENSE = 1_000_000  # cells of a component's confidence matrix up to which one task assigns it
STEP = 0.01  # least raise of a bid, for larger components

# fixed values: letters that scanning confuses with digits
_AS_DIGIT = str.maketrans("OQDILSZB", "00011528")
_SIDETRACK = re.compile(r"(?:(?<![A-Z])|(?<=\d/[A-Z]{3})|(?=侧))[\s\-_.]*(?:S/?T|SIDETRACK|侧钻?)[\s\-_.#]*0*(\d{1,2})\s*$")
_NAME = T.StructType([T.StructField("letters", T.StringType()), T.StructField("number", T.IntegerType()), T.StructField("side", T.IntegerType())])


def parse_name(name: str | None) -> tuple[str | None, int | None, int | None]:
    """Letters, number and sidetrack (0: none) of a well name, remarks aside."""
    t = unicodedata.normalize("NFKC", name or "").upper()
    t = re.sub(r"[(\[{].*?[)\]}]", " ", t)
    t = re.sub(r"^\s*WELL\b|\bOLD\s*$|\bNO\.?(?=[\s\d])", " ", t).strip()
    side = 0
    if m := _SIDETRACK.search(t):
        side, t = int(m[1]), t[: m.start()]
    letters = number = None
    for token in re.split(r"[^0-9A-Z]+", t):
        if not token:
            continue
        if m := re.fullmatch(r"([A-Z]{3,}?)([0-9OQDILSZB]*\d[0-9OQDILSZB]*)", token):
            letters, number = letters or m[1], m[2] if number is None else number
        elif re.search(r"\d", token) and re.fullmatch(r"[0-9OQDILSZB]+", token):
            number = token if number is None else number
        elif letters is None:
            letters = token
        elif number is None and re.fullmatch(r"[OQDILSZB]{2,4}", token):
            number = token
    digits = (number or "").translate(_AS_DIGIT)
    return letters, int(digits) if 0 < len(digits) < 9 else None, side


@F.pandas_udf(_NAME)
def _parsed(names: pd.Series) -> pd.DataFrame:
    rows = [parse_name(n) for n in names]
    return pd.DataFrame({"letters": pd.Series([r[0] for r in rows], dtype=object), "number": pd.Series([r[1] for r in rows], dtype="Int32"), "side": pd.Series([r[2] for r in rows], dtype="Int32")})


def _uwi_key(c: str) -> Column:
    """Digits of a well identifier, a missing sidetrack group read as 00."""
    d = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.length(d) >= 8, F.when(F.length(d) == 11, F.concat(d, F.lit("00"))).otherwise(d))


def _features(rows: DataFrame, name: str, *more: Column) -> DataFrame:
    """Comparable attributes; coordinates swapped or in kilometres are put right."""
    good = lambda c: F.when(~F.isnan(c) & (F.col(c) != 0), F.col(c))
    x, y = good("x"), good("y")
    big = lambda c: F.when(F.abs(c) < 10_000, c * 1000).otherwise(c)
    x, y = big(x), big(y)
    swapped = x > y
    return rows.select("id", _parsed(name).alias("n"), _uwi_key("uwi").alias("uwi"), F.when(swapped, y).otherwise(x).alias("x"), F.when(swapped, x).otherwise(y).alias("y"), *more).select(
        "n.letters", "n.number", "n.side", "*"
    ).drop("n")


def _codes(letters: DataFrame, known: DataFrame, least_share: float) -> DataFrame:
    """(letters, codes): entity codes that written letters stand for.

    Learned from pairs (letters, code, n) of mentions with a known entity, where
    a code counts that makes up `least_share` of a spelling's pairs; a spelling
    never seen there takes the codes of the seen spellings one edit apart, found
    through shared deletions, not by comparing all with all. Spellings of up to
    three letters have too many neighbours; they take those of the same letters
    in another order."""
    learned = known.groupBy("letters", "code").agg(F.sum("n").alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy("letters"))
    seen = learned.select("letters", "code", share.alias("share")).where(F.col("share") >= least_share)
    full = cut(seen.groupBy("letters").agg(F.collect_set("code").alias("codes")))
    cuts = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
    keys = lambda c: F.explode(F.when(F.length(c) > 3, F.array_distinct(F.array_append(cuts(c), c))).otherwise(F.array(F.array_join(F.array_sort(F.split(c, "")), ""))))
    new = letters.select("letters").distinct().join(full, "letters", "left_anti").where("letters <> ''")
    a = new.select("letters", keys(F.col("letters")).alias("cut"))
    b = full.where("letters <> ''").select(F.col("letters").alias("like"), "codes", keys(F.col("letters")).alias("cut"))
    alike = (F.levenshtein("letters", "like") <= 2) & ((F.length("letters") > 3) == (F.length("like") > 3))
    near = a.join(b, "cut").where(alike).groupBy("letters").agg(F.array_distinct(F.flatten(F.collect_set("codes"))).alias("codes"))
    return full.unionByName(near)


def _orders(f: DataFrame, codes: Column, is_entity: bool) -> DataFrame:
    """One row per composite sort key of a record: key text and a number within."""
    number = F.lpad(F.col("number").cast("string"), 6, "0")
    x = F.coalesce("x", F.lit(0.0))
    key = lambda c, sub: F.when(c.isNotNull(), F.struct(c.alias("key"), sub.alias("sub")))
    named = F.transform(F.coalesce(codes, F.array().cast("array<string>")), lambda c: F.struct(F.concat(F.lit("2|"), c, F.lit("|"), number, F.lit("|"), F.col("side")).alias("key"), x.alias("sub")))
    located = F.col("x").isNotNull()
    keys = F.array(
        key(F.concat(F.lit("1|"), F.col("uwi")), F.lit(0.0)),
        key(F.when(located, F.concat(F.lit("3|"), number)), x),
        key(F.when(located & F.col("y").isNotNull(), F.concat(F.lit("4|"), F.lpad(F.floor(x / 250).cast("string"), 8, "0"))), F.coalesce("y", F.lit(0.0))),
    )
    every = F.array_compact(F.concat(keys, F.when(F.col("number").isNotNull(), named).otherwise(F.array().cast("array<struct<key:string,sub:double>>"))))
    return f.select(F.col("id"), F.lit(is_entity).alias("entity"), F.explode(every).alias("k")).select("k.key", "k.sub", "entity", "id")


def neighbours(orders: DataFrame, partitions: int | None = None, window: int = WINDOW) -> DataFrame:
    """(mention_id, entity_id) of rows (key, sub, entity, id) whose sort places
    are at most `window` entities apart, keys of other kinds apart."""
    n = partitions or int(orders.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = cut(orders.where("key is not null").repartitionByRange(n, "key", "sub", "entity", "id").sortWithinPartitions("key", "sub", "entity", "id"))

    def block(batches: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
        parts = [b for b in batches if len(b)]
        return pd.concat(parts, ignore_index=True) if parts else None

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = block(batches)
        if b is not None:
            e = b[b["entity"]]
            kind = e["key"].str[0].tolist()
            yield pd.DataFrame({"pid": [TaskContext.get().partitionId()], "ids": [e["id"].tolist()[:window] + e["id"].tolist()[-window:]], "kinds": ["".join(kind[:window] + kind[-window:])], "n": [min(len(e), window)]})

    # the outermost entities of each partition, whatever the data
    outer = sorted(by.mapInPandas(edges, "pid int, ids array<long>, kinds string, n int").collect(), key=lambda r: r["pid"])
    before: dict[int, list] = {}
    after: dict[int, list] = {}
    carry: list = []
    for r in outer:
        before[r["pid"]] = carry
        carry = (carry + list(zip(r["ids"], r["kinds"]))[len(r["ids"]) - r["n"] :])[-window:]
    carry = []
    for r in reversed(outer):
        after[r["pid"]] = carry
        carry = (list(zip(r["ids"], r["kinds"]))[: r["n"]] + carry)[:window]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = block(batches)
        if b is None:
            return
        pid = TaskContext.get().partitionId()
        head, tail = before.get(pid, []), after.get(pid, [])
        is_e = b["entity"].to_numpy(bool)
        kinds, ids = b["key"].str[0].to_numpy(), b["id"].to_numpy()
        e_ids = np.array([i for i, _ in head] + ids[is_e].tolist() + [i for i, _ in tail], np.int64)
        e_kinds = np.array([k for _, k in head] + kinds[is_e].tolist() + [k for _, k in tail], object)
        place = (np.cumsum(is_e) + len(head))[~is_e]
        m_ids, m_kinds = ids[~is_e], kinds[~is_e]
        for k in range(-window, window):
            at = place + k
            ok = (at >= 0) & (at < len(e_ids))
            at = at[ok]
            same = e_kinds[at] == m_kinds[ok] if len(at) else np.zeros(0, bool)
            yield pd.DataFrame({"mention_id": m_ids[ok][same], "entity_id": e_ids[at][same]})

    return by.mapInPandas(scan, "mention_id long, entity_id long").distinct()


def _confidence(pairs: DataFrame) -> Column:
    """Weighted similarities of name, identifier and place, 0 to 1.

    What is missing on either side neither helps nor harms; a different
    sidetrack or a place far away speaks against the pair. Another number under
    the right letters may be a slip: identifier and place together outweigh it,
    neither does alone."""
    known = F.array_contains(F.col("m_codes"), F.col("e_letters"))
    swapped = F.array_sort(F.split("m_letters", "")) == F.array_sort(F.split("e_letters", ""))
    letters = F.when(F.coalesce(known, F.lit(False)), 1.0).when(F.coalesce(swapped, F.lit(False)), 0.6).otherwise(0.0)
    same_no = F.coalesce(F.col("m_number") == F.col("e_number"), F.lit(False))
    uwi_off = F.levenshtein("m_uwi", "e_uwi")
    uwi = F.when(uwi_off.isNull(), 0.0).when(uwi_off == 0, 1.0).when(uwi_off <= 2, 0.2).otherwise(-0.6)
    apart = F.hypot(F.col("m_x") - F.col("e_x"), F.col("m_y") - F.col("e_y"))
    one = F.coalesce(F.abs(F.col("m_x") - F.col("e_x")), F.abs(F.col("m_y") - F.col("e_y")))
    place = F.when(apart.isNotNull(), F.when(apart <= 150, 1.0).when(apart <= 300, 0.4).otherwise(F.greatest(F.lit(-1.0), -apart / 1500))).when(one > 600, -0.7).otherwise(0.0)
    side = F.when(F.coalesce(F.col("m_side"), F.lit(0)) == F.coalesce(F.col("e_side"), F.lit(0)), 0.0).otherwise(-1.0)
    name = F.when(same_no, 0.30 + 0.30 * letters).otherwise(0.1 * letters - F.when(F.col("m_number").isNull(), 0.0).otherwise(0.1))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), name + 0.35 * uwi + 0.30 * place + side))


def best_assignment(confidence: np.ndarray) -> list[int]:
    """Column of each row, or -1, of the one-to-one assignment of greatest total.

    Shortest augmenting paths with potentials; every row may also stay without
    a column at no gain. NaN cells are no pairs."""
    n, m = confidence.shape
    cost = np.hstack([np.where(np.isnan(confidence), 1.0, -np.nan_to_num(confidence)), np.zeros((n, n))])
    u, v = np.zeros(n), np.zeros(m + n)
    owner = np.full(m + n, -1)
    for row in range(n):
        far, came, seen = np.full(m + n, np.inf), np.full(m + n, -1), np.zeros(m + n, bool)
        at, reached, via = row, 0.0, -1
        while True:
            step = reached + cost[at] - u[at] - v
            shorter = ~seen & (step < far)
            far[shorter], came[shorter] = step[shorter], via
            via = int(np.argmin(np.where(seen, np.inf, far)))
            reached = far[via]
            seen[via] = True
            if owner[via] < 0:
                break
            at = owner[via]
        held = seen & (owner >= 0)
        u[row] += reached
        u[owner[held]] += reached - far[held]
        v[seen] += far[seen] - reached
        while via >= 0:
            back = came[via]
            owner[via] = row if back < 0 else owner[back]
            via = back
    out = [-1] * n
    for column in range(m):
        if owner[column] >= 0 and not np.isnan(confidence[owner[column], column]):
            out[owner[column]] = column
    return out


def _solved(pairs: DataFrame) -> DataFrame:
    """Assignment of components (component, part, entity_id, confidence), each in a task."""

    def solve(b: pd.DataFrame) -> pd.DataFrame:
        parts, i = np.unique(b["part"].to_numpy(), return_inverse=True)
        entities, j = np.unique(b["entity_id"].to_numpy(), return_inverse=True)
        matrix = np.full((len(parts), len(entities)), np.nan)
        matrix[i, j] = b["confidence"]
        chosen = best_assignment(matrix)
        return pd.DataFrame([(parts[r], entities[c]) for r, c in enumerate(chosen) if c >= 0], columns=["part", "entity_id"]).astype("int64")

    return pairs.groupBy("component").applyInPandas(solve, "part long, entity_id long")


def _auctioned(pairs: DataFrame, step: float = STEP) -> DataFrame:
    """Assignment of pairs (part, scope, entity_id, confidence) of any number, by an
    auction of joins and aggregations: parts without an entity bid for the one that
    profits them most, the highest bid holds it. The total is short of the greatest
    by `step` for each part at most."""
    held = cut(pairs.select("scope", "entity_id", F.col("part").alias("holder"), F.lit(0.0).alias("price")).limit(0))
    while True:
        offers = pairs.join(held, ["scope", "entity_id"], "left").join(held.select(F.col("holder").alias("part")).distinct(), "part", "left_anti")
        offers = offers.select("part", "scope", "entity_id", (F.col("confidence") - F.coalesce("price", F.lit(0.0))).alias("profit"), F.coalesce("price", F.lit(0.0)).alias("price")).where("profit > 0")
        first = offers.groupBy("part").agg(F.max_by(F.struct("scope", "entity_id", "profit", "price"), F.struct("profit", (-F.col("entity_id")).alias("e"))).alias("f"))
        second = offers.join(first, "part").where(F.col("entity_id") != F.col("f.entity_id")).groupBy("part").agg(F.max("profit").alias("next"))
        bids = first.join(second, "part", "left").select("part", "f.scope", "f.entity_id", (F.col("f.price") + F.col("f.profit") - F.coalesce("next", F.lit(0.0)) + step).alias("price"))
        won = cut(bids.groupBy("scope", "entity_id").agg(F.max(F.struct("price", (-F.col("part")).alias("p"))).alias("b")).select("scope", "entity_id", (-F.col("b.p")).alias("holder"), "b.price"))
        if won.isEmpty():
            return held.select(F.col("holder").alias("part"), "entity_id")
        held = cut(held.join(won, ["scope", "entity_id"], "left_anti").unionByName(won))


def assign(pairs: DataFrame, dense: int = DENSE) -> DataFrame:
    """(part, entity_id) of rows (part, scope, entity_id, confidence > 0): within a scope
    every part gets one entity at most and every entity one part at most, so that the
    total confidence is greatest. A part nobody contends with for its best entity has
    it; the others are assigned by connected component, in a task where the component's
    matrix has `dense` cells at most, else by an auction without such a bound."""
    best = F.max_by("entity_id", F.struct("confidence", (-F.col("entity_id")).alias("e")))
    claims = pairs.groupBy("scope", "entity_id").agg(F.count("*").alias("claims"))
    wanted = pairs.groupBy("part", "scope").agg(best.alias("entity_id")).join(claims, ["scope", "entity_id"])
    free = wanted.where("claims = 1").select("part", "entity_id")
    rest = cut(pairs.join(wanted.where("claims > 1").select("part"), "part", "left_semi"))
    if rest.isEmpty():
        return free
    labelled = rest.withColumn("component", F.col("part"))
    while True:
        by_entity = labelled.groupBy("scope", "entity_id").agg(F.min("component").alias("low"))
        by_part = labelled.select("part", "scope", "entity_id").join(by_entity, ["scope", "entity_id"]).groupBy("part").agg(F.min("low").alias("low"))
        now = cut(labelled.join(by_part, "part").withColumn("moved", F.col("low") < F.col("component")).withColumn("component", F.col("low")).drop("low"))
        labelled = now.drop("moved")
        if now.where("moved").isEmpty():
            break
    size = labelled.groupBy("component").agg((F.countDistinct("part") * (F.countDistinct("part") + F.countDistinct("entity_id"))).alias("cells"))
    sized = labelled.join(size, "component")
    out = free.unionByName(_solved(sized.where(F.col("cells") <= dense)))
    large = sized.where(F.col("cells") > dense)
    return out if large.isEmpty() else out.unionByName(_auctioned(cut(large.select("part", "scope", "entity_id", "confidence"))))


def match(mentions: DataFrame, entities: DataFrame, known: DataFrame, window: int = WINDOW, least: float = LEAST, least_share: float = 0.1) -> DataFrame:
    """(mention_id, entity_id, confidence) of mentions (id, name, uwi, x, y and, if
    there are several sources, scope) and the entity (id, name, uwi, x, y) each
    describes; known pairs (name, entity_id) teach how letters are written.
    Mentions of no entity, or of one that a better description of the same scope
    takes, give no row. Nulls in any column, repeated rows and empty tables are
    fine; ties go to the lower entity id; other columns are ignored.
    """
    scope = F.coalesce(F.col("scope").cast("string"), F.lit("")) if "scope" in mentions.columns else F.lit("")
    m, e = cut(_features(mentions, "name", scope.alias("scope"))), cut(_features(entities, "name").dropDuplicates(["id"]))
    taught = known.select(F.col("entity_id").alias("id"), _parsed("name").alias("k")).join(e.select("id", F.col("letters").alias("code")), "id")
    taught = taught.where("k.letters is not null and code is not null").groupBy(F.col("k.letters").alias("letters"), "code").agg(F.count("*").alias("n"))
    itself = e.where("letters is not null").groupBy("letters").agg(F.count("*").alias("n")).select("letters", F.col("letters").alias("code"), "n")
    codes = _codes(m.where("letters is not null"), taught.unionByName(itself), least_share)
    m = cut(m.join(codes, "letters", "left"))
    pairs = neighbours(_orders(m, F.col("codes"), False).unionByName(_orders(e, F.array("letters"), True)), window=window)
    left = m.select(F.col("id").alias("mention_id"), "scope", *[F.col(c).alias(f"m_{c}") for c in ("letters", "number", "side", "uwi", "x", "y", "codes")])
    right = e.select(F.col("id").alias("entity_id"), *[F.col(c).alias(f"e_{c}") for c in ("letters", "number", "side", "uwi", "x", "y")])
    scored = pairs.join(right, "entity_id").join(left.dropDuplicates(["mention_id"]), "mention_id")
    said = F.struct(F.coalesce(F.array_min("m_codes"), "m_letters"), "m_number", "m_side", F.when(F.col("m_number").isNull(), F.struct("m_uwi", "m_x", "m_y")))
    scored = scored.select("mention_id", "scope", said.alias("said"), "entity_id", F.round(_confidence(scored), 6).alias("confidence"))
    scored = cut(scored.where(F.col("confidence") >= least))
    best = scored.groupBy("mention_id").agg(F.max(F.struct("confidence", (-F.col("entity_id")).alias("e"))).alias("b")).select("mention_id", F.col("b.e").alias("best"))
    scored = cut(scored.join(best, "mention_id").withColumn("part", F.xxhash64("scope", "said", "best")).drop("said", "best"))
    given = assign(scored.groupBy("part", "scope", "entity_id").agg(F.max("confidence").alias("confidence")))
    return scored.join(given, ["part", "entity_id"]).select("mention_id", "entity_id", "confidence")


def well_matches(well_sources: DataFrame, wells: DataFrame) -> DataFrame:
    """Mentions without a well_id matched to the wells table, one-to-one within each source."""
    named = lambda df, n, *more: df.select("id", F.col(n).alias("name"), "uwi", "x", "y", *more)
    known = well_sources.where("well_id is not null").select(F.col("raw_name").alias("name"), F.col("well_id").alias("entity_id"))
    return match(named(well_sources.where("well_id is null"), "raw_name", F.col("source_id").alias("scope")), named(wells, "canonical_name"), known)
