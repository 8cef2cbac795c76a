"""Mixing sources to target weights.

Every source gets a copy rate that makes its share of all tokens meet its
target; a document of rate f appears floor(f) times, and once more with
probability f - floor(f). Which ones do is decided by pivotal dependent
rounding: the fractional probabilities of two documents are paired and mass is
moved between them at random, keeping their expected tokens, until one is whole.
So a source's tokens meet their goal up to about one document.

Pairs are formed along each partition, which leaves at most one fractional
document per source and partition; these residuals are combined in a reduction
tree of fixed fan-in until one per source is left, which is rounded by itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.llm.tokenizing import VOCABULARY, token_counts
from wellspring.tables import cut

FAN_IN = 32
_WHOLE = 1e-9


@dataclass(frozen=True)
class Rate:
    """Plan of one source: copies per document on average."""

    source: str
    target: float
    max_repeats: int
    tokens: int
    rate: float


def plan(sizes: list[tuple[str, float, int, int]], total: float | None = None) -> list[Rate]:
    """Rates of sources (source, target share, cap, tokens).

    Without a total, the mix is the largest in which every source that has
    tokens meets its share of the targets exactly, no cap exceeded. With a
    total, a source that cannot fill its share within its cap gives all it may,
    and the rest is shared by the others in proportion to their targets.
    """
    live = [s for s in sizes if s[3] > 0 and s[1] > 0 and s[2] > 0]
    weight = sum(s[1] for s in live)
    if not live:
        return [Rate(s[0], s[1], s[2], s[3], 0.0) for s in sizes]
    if total is None:
        total = min(s[3] * s[2] * weight / s[1] for s in live)
    goal: dict[str, float] = {}
    open_, left = list(live), float(total)
    while open_:
        w = sum(s[1] for s in open_)
        full = [s for s in open_ if left * s[1] / w > s[3] * s[2] * (1 + 1e-12)]
        if not full:
            goal |= {s[0]: left * s[1] / w for s in open_}
            break
        for s in full:
            goal[s[0]] = float(s[3] * s[2])
            open_.remove(s)
        left -= sum(goal[s[0]] for s in full)
    return [Rate(s[0], s[1], s[2], s[3], min(goal.get(s[0], 0.0) / s[3], float(s[2])) if s[3] else 0.0) for s in sizes]


def _chance(seed: int, a: int, b: int) -> float:
    """A number from 0 to 1 that a pair of documents always gets again."""
    return xxhash.xxh64_intdigest(f"{seed}|{a}|{b}".encode()) / 2.0**64


def pivot(p: float, a: float, q: float, b: float, chance: float) -> tuple[float, float]:
    """Move mass between probabilities p, q of sizes a, b until one is whole;
    a*p + b*q stays, and so do p and q on average."""
    up = min(1 - p, q * b / a)
    down = min(p, (1 - q) * b / a)
    p, q = (p + up, q - up * a / b) if chance * (up + down) < down else (p - down, q + down * a / b)
    whole = lambda x: 0.0 if x < _WHOLE else 1.0 if x > 1 - _WHOLE else x
    return whole(p), whole(q)


def _pairing(seed: int):
    """Round along a partition: yields every row, its last fractional one per
    source still fractional."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        active: dict[str, list] = {}
        for b in batches:
            out = []
            for doc, source, n, base, p in zip(b["doc_id"].tolist(), b["source"].tolist(), b["n_tokens"].tolist(), b["base"].tolist(), b["p"].tolist()):
                row = [doc, source, n, base, p]
                if 0.0 < p < 1.0:
                    other = active.pop(source, None)
                    if other is not None:
                        other[4], row[4] = pivot(other[4], other[2], p, n, _chance(seed, other[0], doc))
                        if 0.0 < other[4] < 1.0:
                            other, row = row, other
                        out.append(other)
                    if 0.0 < row[4] < 1.0:
                        active[source] = row
                        continue
                out.append(row)
            yield pd.DataFrame(out, columns=["doc_id", "source", "n_tokens", "base", "p"])
        if active:
            yield pd.DataFrame(list(active.values()), columns=["doc_id", "source", "n_tokens", "base", "p"])

    return run


_ROWS = "doc_id long, source string, n_tokens long, base long, p double"


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 17, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The mix (doc_id, source, n_tokens, copies) and the shares reached.

    Documents of no token, of no source or of a source without a target are not
    mixed. Shares: source, target_share, max_repeats, available_tokens,
    mixed_tokens, most_copies, reached_share; a source that has no documents
    reaches 0. Of a source listed twice the greater target counts; repeated
    rows are documents of their own; empty tables give an empty mix.
    """
    wanted = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max_by("max_repeats", "target_share").alias("max_repeats"))
    # a list of sources to mix; it joins by equality
    kept = documents.where("source is not null").select("doc_id", "source", "text").join(wanted.select("source"), "source", "left_semi")
    sized = cut(token_counts(kept, ("doc_id", "source"), vocabulary))
    sizes = wanted.join(sized.groupBy("source").agg(F.sum("n_tokens").alias("n")), "source", "left").collect()  # one row per target
    rates = plan([(r["source"], float(r["target_share"] or 0), int(r["max_repeats"] or 0), int(r["n"] or 0)) for r in sorted(sizes, key=lambda r: r["source"])], total)
    spark = documents.sparkSession
    rate = spark.createDataFrame([(r.source, r.target, r.max_repeats, r.tokens, r.rate) for r in rates], "source string, target_share double, max_repeats long, available_tokens long, rate double")
    fraction = F.col("rate") - F.floor("rate")
    p = F.when(fraction < _WHOLE, 0.0).when(fraction > 1 - _WHOLE, 1.0).otherwise(fraction)
    units = sized.where("n_tokens > 0").join(F.broadcast(rate), "source").select("doc_id", "source", "n_tokens", F.floor("rate").alias("base"), p.alias("p"))
    done = []
    level = cut(units.mapInPandas(_pairing(seed), _ROWS))
    parts = level.rdd.getNumPartitions()
    while True:
        done.append(level.where("p = 0 or p = 1"))
        open_ = level.where("p > 0 and p < 1")
        if parts <= 1:
            # the root: one document per source at most, rounded to the nearer side
            last = [(r["doc_id"], r["source"], r["n_tokens"], r["base"], float(r["p"] >= 0.5)) for r in open_.collect()]
            done.append(spark.createDataFrame(last, _ROWS))
            break
        parts = math.ceil(parts / FAN_IN)
        level = cut(open_.coalesce(parts).mapInPandas(_pairing(seed + len(done)), _ROWS))
    rows = done[0]
    for d in done[1:]:
        rows = rows.unionByName(d)
    mixed = rows.select("doc_id", "source", "n_tokens", (F.col("base") + F.col("p").cast("long")).alias("copies")).where("copies > 0")
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    whole = got.agg(F.sum("mixed_tokens").alias("all_tokens"))
    shares = rate.join(got, "source", "left").join(whole).select(
        "source", "target_share", "max_repeats", "available_tokens", F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.coalesce(F.try_divide("mixed_tokens", "all_tokens"), F.lit(0.0)).alias("reached_share"),
    )
    return mixed, shares
