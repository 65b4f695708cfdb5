"""Per-key results when a few keys hold most records.

Every aggregate here is algebraic: Spark builds a bounded hash table of partial
states in each map task (spilling when it is full) and only one compact state
per key and task is shuffled. The task that finishes a hot key therefore merges
as many states as there are map tasks, not as many as there are rows. Exact
distinct counts, which are not algebraic, are taken in two algebraic steps: the
first groups by key *and* value, which spreads a hot key, the second sums.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.session import require

#: Aggregates whose partial states merge in constant space.
_ALGEBRAIC = {
    "count": lambda c: F.count(c),
    "sum": lambda c: F.sum(c),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
    "avg": lambda c: F.avg(c),
    "approx_distinct": lambda c: F.approx_count_distinct(c),
}


def per_key(df: DataFrame, key: str, results: Mapping[str, tuple[str, str | Column]] | None = None, distinct: Mapping[str, str] | None = None) -> DataFrame:
    """One row for each value of ``key``: ``n_rows`` and the named results.

    ``results`` maps an output name to (aggregate, column); the aggregates are
    count, sum, min, max, avg and approx_distinct. ``distinct`` maps an output
    name to a column whose exact number of distinct non-null values is wanted.

    NULL and ``""`` are keys of their own. Nulls in other columns are skipped
    as SQL aggregates do. Repeated rows count each time. An empty table gives
    an empty result. Other columns are ignored, whatever their names; an output
    name may not be used twice or equal the key.
    """
    results, distinct = dict(results or {}), dict(distinct or {})
    names = [key, "n_rows", *results, *distinct]
    if len({n.lower() for n in names}) < len(names):
        raise ValueError("output names must differ from each other and from the key")
    require(df, key, *distinct.values(), *(c for _, c in results.values() if isinstance(c, str)))
    unknown = {kind for kind, _ in results.values()} - set(_ALGEBRAIC)
    if unknown:
        raise ValueError(f"not algebraic: {', '.join(sorted(unknown))}")
    out = df.groupBy(F.col(f"`{key}`").alias(key)).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *(_ALGEBRAIC[kind](F.col(f"`{c}`") if isinstance(c, str) else c).alias(n) for n, (kind, c) in results.items()),
    )
    for name, column in distinct.items():
        values = df.select(F.col(f"`{key}`").alias("__k"), F.col(f"`{column}`").alias("__v")).distinct()
        counts = values.groupBy("__k").agg(F.count("__v").alias(name))
        out = out.join(counts, F.col(f"`{key}`").eqNullSafe(F.col("__k")), "left").drop("__k")
    return out


def heavy_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """The values of ``key``, neither NULL nor empty, that hold more than
    ``share`` of all rows, with ``n_rows``.

    All rows count for the total, also those without key. At most ``1 / share``
    rows come out; an empty table gives none. Ties do not matter: every key
    above the share is returned.
    """
    if not 0 <= share < 1:
        raise ValueError("share must be in [0, 1)")
    counts = per_key(df, key)
    total = counts.agg(F.sum("n_rows").alias("total"))
    return counts.where((F.col(f"`{key}`") != "") & (F.col("n_rows") > F.lit(share) * total.scalar()))
