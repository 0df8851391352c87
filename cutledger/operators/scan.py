"""Ordered operators that stay parallel inside one hot key.

A plain window sends every row of a key to one task. Here a key is cut into blocks along its order
(hours, id ranges, size classes): each block is scanned on its own, the block totals are scanned in
turn, and the carry of all earlier blocks is joined back on (key, block). Several block levels, fine
to coarse, keep the scan over totals small as well.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000


@dataclass(frozen=True)
class Running:
    """One running measure: kind is sum, max, min or last (latest non-null value)."""

    name: str
    kind: str
    value: Column
    inclusive: bool = True


def time_block(ts: Column, width_us: int = HOUR_US) -> Column:
    """Number of the fixed-width time slice holding ``ts``; non-decreasing in ``ts``."""
    return F.floor(F.unix_micros(ts) / F.lit(width_us))


def id_block(value: Column, size: int = 65_536) -> Column:
    """Number of the id range holding ``value``."""
    return F.floor(value / F.lit(size))


_TOTAL = {"sum": F.sum, "max": F.max, "min": F.min}


def _over(kind: str, value: Column, window) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True).over(window)
    return _TOTAL[kind](value).over(window)


def _merge(kind: str, carry: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))
    if kind == "max":
        return F.greatest(carry, local)
    if kind == "min":
        return F.least(carry, local)
    return F.coalesce(local, carry)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    blocks: list[Column],
    measures: list[Running],
    level: int = 0,
) -> DataFrame:
    """Add one column per measure, computed per key along ``order`` (all ascending).

    ``blocks`` go from fine to coarse; each must be non-decreasing along the order, and a coarser one
    a function of the finer. Key columns must not be NULL. An exclusive sum starts at 0; an exclusive
    max, min or last starts at NULL.
    """
    o = [f"_o{level}_{i}" for i in range(len(order))]
    m = [f"_m{level}_{i}" for i in range(len(measures))]
    b = [f"_b{level}_{i}" for i in range(len(blocks))]
    c = [f"_c{level}_{i}" for i in range(len(measures))]
    base = df.withColumns(
        dict(zip(o, order)) | dict(zip(m, (x.value for x in measures))) | dict(zip(b, blocks))
    )
    part = keys + b[:1]
    upto = Window.partitionBy(*part).orderBy(*o)
    frames = {
        True: upto.rowsBetween(Window.unboundedPreceding, 0),
        False: upto.rowsBetween(Window.unboundedPreceding, -1),
    }
    if not blocks:
        out = base.withColumns(
            {x.name: _over(x.kind, F.col(v), frames[x.inclusive]) for x, v in zip(measures, m)}
        )
        zero = {x.name: F.coalesce(x.name, F.lit(0)) for x in measures if x.kind == "sum"}
        return out.withColumns(zero).drop(*o, *m)

    place = F.struct(*o)
    totals = base.groupBy(*part).agg(
        *[
            F.max_by(v, F.when(F.col(v).isNotNull(), place)).alias(v)
            if x.kind == "last"
            else _TOTAL[x.kind](v).alias(v)
            for x, v in zip(measures, m)
        ],
        *[F.min(v).alias(v) for v in b[1:]],
    )
    carry = running(
        totals,
        keys,
        [F.col(b[0])],
        [F.col(v) for v in b[1:]],
        [Running(name, x.kind, F.col(v), False) for name, x, v in zip(c, measures, m)],
        level + 1,
    ).select(*part, *c)
    out = base.join(carry, part, "left")
    out = out.withColumns(
        {
            x.name: _merge(x.kind, F.col(c[i]), _over(x.kind, F.col(m[i]), frames[x.inclusive]))
            for i, x in enumerate(measures)
        }
    )
    return out.drop(*o, *m, *b, *c)


def top_one(df: DataFrame, keys: list[str], order: list[Column], lowest: bool = False) -> DataFrame:
    """The row with the greatest (or least) order key per group, combined map-side before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if lowest else F.max_by
    best = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.`{c}`").alias(c) for c in rest])


def page_of(df: DataFrame, order: list[Column], page: int, per: int) -> DataFrame:
    """One page of a total order (a bounded top-k, not a full sort)."""
    page = max(int(page), 1)
    return df.orderBy(*order).offset((page - 1) * per).limit(per)


def any_of(conditions: list[Column]) -> Column:
    """OR of a list of conditions."""
    return reduce(lambda a, c: a | c, conditions)


def error_list(rules: list[tuple[Column, str]]) -> Column:
    """Names of the rules whose (failing) condition is true."""
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in rules]))
