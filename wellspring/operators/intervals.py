"""Overlapping and gapped intervals: covered spans and the gaps between them.

The rows are range-sorted globally by (entity, start), so one hot entity
spreads over many partitions. A first scan leaves one summary per partition
(its last entity, the start and the largest end of that entity's open island);
the summaries, one small row per partition, are prefix-combined in order, and a
second scan of the same partitions carries the combined state in, labelling
islands and emitting gaps without ever holding an entity in one place. The
sorted rows are checkpointed between the scans: range bounds come from a
sample, so only a written result has the same partitions twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.functions.text import nfkc_key_udf
from wellspring.tables import cut

_STEP = np.int64(1) << 42  # further apart than any two ends of one entity


def _islands(keys: np.ndarray, tops: np.ndarray, bases: np.ndarray, carry: tuple | None):
    """Labels of sorted rows. Gives for each row whether it opens an island and
    the running end before it (of the same entity, -1 where there is none),
    and the state after the last row: (entity, island start, running end)."""
    change = np.r_[True, keys[1:] != keys[:-1]]
    code = np.cumsum(change).astype(np.int64)
    same = carry is not None and keys[0] == carry[0]
    first = carry[2] + code[0] * _STEP if same else np.int64(-1)
    run = np.maximum.accumulate(np.r_[first, bases + code * _STEP])
    before = run[:-1] - code * _STEP
    known = ~change
    known[0] = same
    before = np.where(known, before, -1)
    opens = ~known | (tops > before)
    at = np.maximum.accumulate(np.where(opens, np.arange(len(tops)), -1))
    start = np.where(at >= 0, tops[np.maximum(at, 0)], carry[1] if same else 0)
    return opens, before, start, (keys[-1], int(start[-1]), int(run[-1] - code[-1] * _STEP))


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    carry, rows = None, 0
    for b in batches:
        if len(b):
            rows += len(b)
            *_, carry = _islands(b["entity"].to_numpy(), b["top"].to_numpy(), b["base"].to_numpy(), carry)
    if rows:
        pid = TaskContext.get().partitionId()
        yield pd.DataFrame({"pid": [pid], "entity": [carry[0]], "start": [carry[1]], "end": [carry[2]]})


def _combine(summaries: list) -> dict[int, tuple]:
    """State that reaches each partition, by a prefix scan over the summaries."""
    into, carry = {}, None
    for s in sorted(summaries, key=lambda r: r["pid"]):
        if carry is not None:
            into[s["pid"]] = carry
        if carry is not None and carry[0] == s["entity"]:
            joined = carry[2] >= s["start"]
            carry = (s["entity"], carry[1] if joined else s["start"], max(carry[2], s["end"]))
        else:
            carry = (s["entity"], s["start"], s["end"])
    return into


def spans_and_gaps(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """Covered spans and gaps of (entity, top, base) with whole-number ends.

    Result: entity, kind ('span' or 'gap'), top, base. Swapped ends are put
    right; rows with a null entity or end, a negative end or no length do not
    count; touching intervals make one span; repeated rows change nothing; an
    empty input gives no rows. Other columns of the input are ignored.
    """
    spark = rows.sparkSession
    usable = "entity is not null and top is not null and base is not null and top >= 0 and base >= 0 and top <> base"
    ends = F.least("top", "base").alias("top"), F.greatest("top", "base").alias("base")
    good = rows.select("entity", "top", "base").where(usable).select("entity", *ends).distinct()
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = cut(good.repartitionByRange(n, "entity", "top").sortWithinPartitions("entity", "top", "base"))
    # one row per partition, whatever the data
    into = _combine(by.mapInPandas(_summaries, "pid int, entity string, start long, end long").collect())

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry = into.get(TaskContext.get().partitionId())
        for b in batches:
            if not len(b):
                continue
            keys, tops, bases = b["entity"].to_numpy(), b["top"].to_numpy(), b["base"].to_numpy()
            opens, before, start, carry = _islands(keys, tops, bases, carry)
            spans = pd.DataFrame({"entity": keys, "kind": "span", "top": start, "base": bases})
            yield spans.groupby(["entity", "kind", "top"], as_index=False)["base"].max()
            hole = opens & (before >= 0)
            if hole.any():
                yield pd.DataFrame({"entity": keys[hole], "kind": "gap", "top": before[hole], "base": tops[hole]})

    labelled = by.mapInPandas(scan, "entity string, kind string, top long, base long")
    return labelled.groupBy("entity", "kind", "top").agg(F.max("base").alias("base"))


def interpretation_spans(interpretation: DataFrame) -> DataFrame:
    """Spans and gaps of each well in whole centimetres (p7_found)."""
    cm = lambda c: F.round(F.when(~F.isnan(c) & (F.abs(c) < 1e12), F.col(c)) * 100).cast("long")
    rows = interpretation.select(nfkc_key_udf("well").alias("entity"), cm("top_md").alias("top"), cm("base_md").alias("base"))
    found = spans_and_gaps(rows.where("entity <> ''"))
    return found.select(F.col("entity").alias("well_key"), "kind", F.col("top").alias("top_cm"), F.col("base").alias("base_cm"))
