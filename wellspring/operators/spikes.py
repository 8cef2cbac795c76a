"""Implausible readings of a source against its own normal behaviour.

Phase-space thresholding: of each source's detrended series the value, its
first and its second difference span a space in which normal readings fill
ellipsoids of robust (median absolute deviation) axes scaled by the universal
threshold; what lies outside is a spike candidate, is replaced by the local
level, and the ellipsoids are built again until nothing new falls out. An exact
test against the level just before and after follows. Runs of one value and
physical bounds catch the other faults.

Readings are range-sorted by (source, time), so a hot source spreads over many
partitions; each partition leaves the few last and first readings that its
neighbours need (see _edges), these are combined in partition order, and a
second scan of the checkpointed partitions does the work.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspring.tables import cut

SIDE = 3  # readings on either side that make the level
RUN = 6  # dates in a row with one value that make a stuck sensor
_ROUNDS = 8  # rebuilding the ellipsoids; stops earlier when nothing new falls out


@dataclass(frozen=True)
class Field:
    """One measured column: how far from the level is implausible."""

    name: str
    ratio: float | None = None  # more than so many times above or below the level
    points: float | None = None  # more than so far from the level


def _first_of(mask: np.ndarray, src: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positions of the first masked row of each (source, time); rows sorted."""
    i = np.flatnonzero(mask)
    if not len(i):
        return i
    new = np.r_[True, (src[i][1:] != src[i][:-1]) | (at[i][1:] != at[i][:-1])]
    return i[new]


def _series(b: dict, field: str) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per source and time one reading: 'run' of all readings, 'level' of those
    that may make a level (possible, not shut in)."""
    v = b[field]
    out = {}
    for kind, mask in (("run", ~np.isnan(v)), ("level", ~np.isnan(v) & ~b["shut"] & ~b[f"bad_{field}"])):
        i = _first_of(mask, b["src"], b["at"])
        out[kind] = (b["src"][i], b["at"][i], v[i])
    return out


def _medians_by(code: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Median of each code's values, given back per row; codes ascending from 0."""
    n = code[-1] + 1
    order = np.lexsort((v, code))
    count = np.bincount(code, minlength=n)
    start = np.r_[0, np.cumsum(count)[:-1]]
    s = v[order]
    return ((s[start + (count - 1) // 2] + s[start + count // 2]) / 2)[code]


def _shift(v: np.ndarray, code: np.ndarray, k: int) -> np.ndarray:
    """The reading k places later of the same source, NaN where there is none."""
    out = np.full(len(v), np.nan)
    if abs(k) < len(v):
        a, b = (slice(None, -k), slice(k, None)) if k > 0 else (slice(-k, None), slice(None, k))
        out[a] = np.where(code[a] == code[b], v[b], np.nan)
    return out


def _level(v: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Median of up to SIDE readings before and SIDE after each reading."""
    m = np.sort(np.stack([_shift(v, code, k) for k in range(-SIDE, SIDE + 1) if k]), axis=0)
    n = (~np.isnan(m)).sum(axis=0)
    j = np.arange(len(v))
    mid = (m[np.maximum(n - 1, 0) // 2, j] + m[np.minimum(n // 2, 2 * SIDE - 1), j]) / 2
    return np.where(n > 0, mid, np.nan)


def phase_space_candidates(v: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Readings outside the ellipsoids of value, first and second difference."""
    found = np.zeros(len(v), bool)
    if not len(v):
        return found
    count = np.bincount(code)[code]
    lam2 = 2 * np.log(np.maximum(count, 2))
    clean = v.copy()
    for _ in range(_ROUNDS):
        level = _level(clean, code)
        level = np.where(np.isnan(level), clean, level)
        u = np.where(found, 0.0, v - level)
        before, after = _shift(u, code, -1), _shift(u, code, 1)
        before, after = np.where(np.isnan(before), 0, before), np.where(np.isnan(after), 0, after)
        du, d2u = (after - before) / 2, after - 2 * u + before
        axes = []
        for x in (u, du, d2u):
            x = x - _medians_by(code, x)
            mad = 1.4826 * _medians_by(code, np.abs(x))
            axes.append(x**2 / np.maximum(mad**2 * lam2, 1e-18))
        outside = np.zeros(len(v), bool)
        for a, b in ((0, 1), (0, 2), (1, 2)):
            outside |= axes[a] + axes[b] > 1
        # too few readings for an ellipsoid: all are candidates
        new = (outside | (count < 2 * SIDE)) & ~found
        if not new.any():
            break
        found |= new
        clean = np.where(found, level, v)
    return found


def _stuck(v: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Readings in runs of one non-zero value over at least RUN times."""
    if not len(v):
        return np.zeros(0, bool)
    new = np.r_[True, (v[1:] != v[:-1]) | (code[1:] != code[:-1])]
    run = np.cumsum(new) - 1
    return (np.bincount(run)[run] >= RUN) & (v != 0)


def _codes(src: np.ndarray) -> np.ndarray:
    return np.cumsum(np.r_[True, src[1:] != src[:-1]]) - 1 if len(src) else np.zeros(0, int)


def _judge(b: dict, field: Field, head: dict, tail: dict) -> np.ndarray:
    """Flags of the rows of one block, given its neighbours' edge readings."""
    flags = b[f"bad_{field.name}"].copy()
    own = _series(b, field.name)

    def around(kind: str):
        parts = [p for p in (head.get((field.name, kind)), own[kind], tail.get((field.name, kind))) if p is not None]
        src, at, v = (np.concatenate(x) for x in zip(*parts))
        skip = len(head[(field.name, kind)][0]) if (field.name, kind) in head else 0
        return _codes(src), v, slice(skip, skip + len(own[kind][0]))

    def to_rows(kind: str, marks: np.ndarray, values: np.ndarray):
        """Marks and values of (source, time) spread to the block's rows."""
        key = b["slot"]
        size = key[-1] + 1 if len(key) else 0
        at = _first_of(~np.isnan(b[field.name]) if kind == "run" else ~np.isnan(b[field.name]) & ~b["shut"] & ~b[f"bad_{field.name}"], b["src"], b["at"])
        m, x = np.zeros(size, bool), np.full(size, np.nan)
        m[key[at]], x[key[at]] = marks, values
        return m[key], x[key]

    code, v, mine = around("run")
    m, x = to_rows("run", _stuck(v, code)[mine], v[mine])
    with np.errstate(invalid="ignore"):
        flags |= m & (b[field.name] == x)
    if field.ratio or field.points:
        code, v, mine = around("level")
        space = np.log(np.maximum(v, 1e-6)) if field.ratio else v
        candidate = phase_space_candidates(space, code)[mine]
        m, x = to_rows("level", candidate, _level(v, code)[mine])
        y = b[field.name]
        with np.errstate(invalid="ignore"):
            far = (y > field.ratio * x) | (y * field.ratio < x) if field.ratio else np.abs(y - x) > field.points
            # further readings of a time (copies, revisions) are judged by the same level
            flags |= far & ~b["shut"] & (m | b["again"])
    return flags


def _block(batches: Iterator[pd.DataFrame], fields: list[Field]) -> dict | None:
    parts = [b for b in batches if len(b)]
    if not parts:
        return None
    p = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]
    b = {"id": p["id"].to_numpy(), "src": p["src"].to_numpy(), "at": p["at"].to_numpy(), "shut": p["shut"].to_numpy(bool)}
    for f in fields:
        b[f.name], b[f"bad_{f.name}"] = p[f.name].to_numpy(float), p[f"bad_{f.name}"].to_numpy(bool)
    new = np.r_[True, (b["src"][1:] != b["src"][:-1]) | (b["at"][1:] != b["at"][:-1])]
    b["slot"], b["again"] = np.cumsum(new) - 1, ~new
    return b


def _edges(b: dict, fields: list[Field]) -> list[dict]:
    """The first and last readings that neighbours need: at most RUN per field."""
    rows = []
    for f in fields:
        for kind, (src, at, v) in _series(b, f.name).items():
            for side, who in (("first", b["src"][0]), ("last", b["src"][-1])):
                i = np.flatnonzero(src == who)
                i = i[:RUN] if side == "first" else i[-RUN:]
                rows.append({"field": f.name, "kind": kind, "side": side, "src": who, "at": at[i].tolist(), "v": v[i].tolist(), "whole": bool(b["src"][0] == b["src"][-1])})
    return rows


def _neighbours(edges: list) -> tuple[dict, dict]:
    """Readings before and after each partition, combined over partitions: where
    a partition lies wholly inside one source with fewer readings than needed,
    those of the partition beyond it are added."""
    heads: dict[int, dict] = {}
    tails: dict[int, dict] = {}
    for side, into, forward in (("last", heads, True), ("first", tails, False)):
        carry: dict = {}
        rows: dict[int, list] = {}
        for e in edges:
            if e["side"] == side:
                rows.setdefault(e["pid"], []).append(e)
        begins = {e["pid"]: e["src"] for e in edges if e["side"] == ("first" if forward else "last")}
        for pid in sorted(rows, reverse=not forward):
            into[pid] = {k: (np.array([c[0]] * len(c[1]), object), np.array(c[1]), np.array(c[2])) for k, c in carry.items() if c[0] == begins[pid] and c[1]}
            for e in rows[pid]:
                k = (e["field"], e["kind"])
                at, v = list(e["at"]), list(e["v"])
                if e["whole"] and k in carry and carry[k][0] == e["src"]:
                    at, v = (carry[k][1] + at, carry[k][2] + v) if forward else (at + carry[k][1], v + carry[k][2])
                carry[k] = (e["src"], at[-RUN:], v[-RUN:]) if forward else (e["src"], at[:RUN], v[:RUN])
    return heads, tails


def implausible(rows: DataFrame, fields: list[Field], impossible: dict[str, Column], shut: Column, partitions: int | None = None) -> DataFrame:
    """(row_id, field_name) of implausible readings of rows (id, src, at, fields).

    at is a whole number (time); impossible gives each field's physical bounds,
    shut the readings to leave out of levels. Null and NaN readings are never
    flagged and pass through runs; a source without neighbours is only tested
    for bounds; repeated rows are flagged alike; rows with a null source or
    time do not count; an empty input gives no rows.
    """
    spark = rows.sparkSession
    names = [f.name for f in fields]
    flag = lambda c: F.coalesce(c, F.lit(False))
    slim = rows.where("src is not null and at is not null").select(
        "id", "src", "at", *[F.col(n).cast("double") for n in names], flag(shut).alias("shut"),
        *[(flag(impossible[n]) & ~F.isnan(n)).alias(f"bad_{n}") for n in names],
    )
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = cut(slim.repartitionByRange(n, "src", "at").sortWithinPartitions("src", "at", "id"))

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = _block(batches, fields)
        if b:
            yield pd.DataFrame(_edges(b, fields)).assign(pid=TaskContext.get().partitionId())

    # a few readings per partition, whatever the data
    heads, tails = _neighbours(by.mapInPandas(edges, "field string, kind string, side string, src string, at array<long>, v array<double>, whole boolean, pid int").collect())

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = _block(batches, fields)
        if not b:
            return
        pid = TaskContext.get().partitionId()
        for f in fields:
            bad = _judge(b, f, heads.get(pid, {}), tails.get(pid, {}))
            yield pd.DataFrame({"row_id": b["id"][bad], "field_name": f.name})

    return by.mapInPandas(scan, "row_id long, field_name string")


PRODUCTION_FIELDS = [Field("oilrate", ratio=3.0), Field("watercutpct", points=30.0), Field("dayson")]


def production_spikes(units: DataFrame) -> DataFrame:
    """Implausible oilrate, watercutpct and dayson of the production table with
    its units (columns wellkey, productiondate, loaded_at, dayson, watercutpct,
    oil_m3d): p6_found. Readings with an unusable date do not count."""
    date = F.col("productiondate")
    dated = units.where(date.isNotNull() & (date >= F.lit("1950-01-01").cast("timestamp")) & (date <= F.col("loaded_at")))
    rows = dated.select("id", F.col("wellkey").alias("src"), F.unix_micros(date).alias("at"), F.col("oil_m3d").alias("oilrate"), "watercutpct", "dayson", F.day(F.last_day(date)).alias("month_days"))
    oil, cut_, days = F.col("oilrate"), F.col("watercutpct"), F.col("dayson")
    impossible = {"oilrate": oil < 0, "watercutpct": (cut_ < 0) | (cut_ > 100), "dayson": (days < 0) | (days > F.col("month_days"))}
    return implausible(rows, PRODUCTION_FIELDS, impossible, (oil == 0) & (F.coalesce(days, F.lit(0.0)) == 0))
