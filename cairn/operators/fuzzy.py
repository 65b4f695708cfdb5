"""Fuzzy matching of strings and of address fields.

Candidates within one or two edits come from an equality join on deletion
neighbourhoods: two strings within k edits, exchanges of neighbours included,
share a string that is left when at most k characters are deleted from either.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.distance import osa, osa_up_to
from cairn.functions.phonetic import is_ordinal_key, ordinal_neighbors
from cairn.functions.text import FLAT, PLACE
from cairn.session import parallelism, require, shuffled

#: Largest distances of a field, unless given.
DEFAULT_LIMITS: dict[str, float] = {f: 0.0 for f in FLAT} | {"street_name": 1.0}

#: A block with at most so many values of ``y`` is compared whole: the some 70
#: keys that a value has for two edits would be more work, and much more to shuffle.
WHOLE_BLOCK = 1000


def deletions(c: str, k: int) -> Column:
    """The string and what is left of it after up to ``k`` deletions (k <= 2)."""
    once = lambda s: F.when(F.length(s) < 1, F.array(s)).otherwise(F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s)))))
    col = F.col(c)
    if k < 1:
        return F.array(col)
    first = F.array_distinct(F.concat(F.array(col), once(col)))
    if k == 1:
        return first
    return F.array_distinct(F.concat(first, F.flatten(F.transform(once(col), once))))


def _by_segments(x: DataFrame, y: DataFrame, k: int, by: list[str]) -> DataFrame:
    """``by, xv, yv`` that may be within ``k`` edits, for any ``k``.

    Cut ``yv`` into 2k + 1 segments: an edit changes one of them, an exchange of
    neighbours two, so one is left unchanged, at most k characters from its
    place. A ``yv`` too short for that is compared with the ``xv`` that are not
    more than k longer.
    """
    m = 2 * k + 1
    long = y.where(F.length("yv") >= m).withColumn("size", F.length("yv"))
    cut = lambda d: d.withColumn("seg", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).withColumns({"from": F.expr(f"seg * size div {m}"), "to": F.expr(f"(seg + 1) * size div {m}")})
    pieces = cut(long).select(*by, "yv", "size", "seg", F.expr("substr(yv, from + 1, to - from)").alias("piece"))
    probes = cut(x.withColumn("size", F.explode(F.sequence(F.greatest(F.length("xv") - k, F.lit(m)), F.greatest(F.length("xv") + k, F.lit(m))))))
    probes = probes.withColumn("at", F.explode(F.sequence(F.col("from") - k, F.col("from") + k))).where("at >= 0 and at + to - from <= length(xv)")
    probes = probes.select(*by, "xv", "size", "seg", F.expr("substr(xv, at + 1, to - from)").alias("piece")).distinct()
    found = probes.join(shuffled(pieces), [*by, "size", "seg", "piece"]).select(*by, "xv", "yv")
    brief = x.where(F.length("xv") < m + k).withColumn("size", F.explode(F.sequence(F.greatest(F.length("xv") - k, F.lit(0)), F.length("xv") + k)))
    short = brief.join(y.where(F.length("yv") < m).withColumn("size", F.length("yv")), [*by, "size"]).select(*by, "xv", "yv")
    return found.unionByName(short)


def close_pairs(x: DataFrame, y: DataFrame, limit: float, by: Sequence[str] = ()) -> DataFrame:
    """``by, xv, yv, dist`` for all distinct values ``xv`` of ``x`` and ``yv`` of
    ``y`` (lower case already) with equal ``by`` and distance up to ``limit``.

    Candidates come from equality joins: on deletion neighbourhoods up to two
    edits (for two, only in blocks of over ``WHOLE_BLOCK`` values), on segments
    beyond. NULL matches nothing.
    """
    by, k = list(by), int(limit) if limit >= 1 else 0
    x, y = x.where("xv is not null").select(*by, "xv"), y.where("yv is not null").select(*by, "yv")
    if k < 1:
        return x.distinct().join(shuffled(y.distinct().withColumn("xv", F.col("yv"))), [*by, "xv"]).select(*by, "xv", "yv", F.lit(0).alias("dist"))
    if by:  # what has no partner in its block needs no keys
        x = x.join(y.select(*by).distinct(), by, "left_semi")
    n = parallelism(x.sparkSession)
    x, y = x.repartition(n, *by, "xv").distinct(), y.repartition(n, *by, "yv").distinct()
    whole = None
    if by and k == 2:
        y = y.withColumn("in_block", F.count(F.lit(1)).over(Window.partitionBy(*by)))
        whole = x.join(shuffled(y.where(F.col("in_block") <= WHOLE_BLOCK).drop("in_block")), by).where(F.levenshtein("xv", "yv", 2 * k) >= 0).select(*by, "xv", "yv")
        y = y.where(F.col("in_block") > WHOLE_BLOCK).drop("in_block")
        x = x.join(y.select(*by).distinct(), by, "left_semi")
    if k <= 2:
        found = x.withColumn("k", F.explode(deletions("xv", k))).join(shuffled(y.withColumn("k", F.explode(deletions("yv", k)))), [*by, "k"]).select(*by, "xv", "yv")
    else:
        found = _by_segments(x, y, k, by)
    found = found.distinct() if whole is None else found.distinct().unionByName(whole)
    return found.withColumn("dist", osa_up_to("xv", "yv", k)).where("dist is not null")


def nearest_pairs(x: DataFrame, y: DataFrame, limit: float, by: Sequence[str] = ()) -> DataFrame:
    """Of ``close_pairs`` those at the least distance of each ``xv``."""
    pairs = close_pairs(x, y, limit, by)
    least = F.min("dist").over(Window.partitionBy(*by, "xv"))
    return pairs.withColumn("least", least).where("dist = least").drop("least")


def fuzzy_match(x: DataFrame, y: DataFrame, x_id: str, y_id: str, column: str, limit: float = 1.0, phonetic: bool = False) -> DataFrame:
    """``x_id, y_id, dist``: for each row of ``x`` all rows of ``y`` at the least
    distance, if that is at most ``limit``; letter case does not count.

    An infinite limit joins every row with every row, as it says. NULL in ``x``
    matches nothing (with an infinite limit: all); NULL in ``y`` nothing. With
    ``phonetic`` only values of ``y`` that share a street key with some value of
    ``x`` take part, which is quicker and may lose matches.
    """
    require(x, x_id, column)
    require(y, y_id, column)
    xs, ys = x.select(F.col(x_id).alias("x_id"), F.lower(column).alias("xv")), y.select(F.col(y_id).alias("y_id"), F.lower(column).alias("yv"))
    if math.isinf(limit):
        return xs.crossJoin(ys).select("x_id", "y_id", osa("xv", "yv").alias("dist"))
    if phonetic:
        from cairn.functions.phonetic import street_key

        keys = xs.select(street_key(F.col("xv")).alias("key")).distinct()
        ys = ys.withColumn("key", street_key(F.col("yv"))).join(keys, "key", "left_semi").drop("key")
    near = nearest_pairs(xs, ys, limit)
    return xs.join(near, "xv").join(ys, "yv").select("x_id", "y_id", "dist")


def match_phonetic_keys(x: DataFrame, y: DataFrame, x_id: str, y_id: str, column: str, limit: float = 1.0) -> DataFrame:
    """``x_id, y_id`` for tables of phonetic street keys: for ordinal keys of
    ``x`` all keys of ``y`` that neighbour them, if ``limit`` is at least 1; for
    other keys those at the least distance up to ``limit``. NULL matches nothing."""
    require(x, x_id, column)
    require(y, y_id, column)
    ordinal = is_ordinal_key(F.col(column))
    words = fuzzy_match(x.where(~ordinal), y, x_id, y_id, column, limit).select("x_id", "y_id")
    if limit < 1:
        return words
    near = x.where(ordinal).select(F.col(x_id).alias("x_id"), F.explode(ordinal_neighbors(F.col(column))).alias("key"))
    return words.unionByName(near.join(y.select(F.col(y_id).alias("y_id"), F.col(column).alias("key")), "key").select("x_id", "y_id"))


def resolve_limits(limits: Mapping[str, float] | None) -> dict[str, float]:
    out = dict(DEFAULT_LIMITS)
    for name, v in (limits or {}).items():
        if name not in out:
            raise ValueError(f"unknown address field: {name}")
        if v is None or v != v or v < 0:
            raise ValueError("limits must be 0 or more")
        out[name] = float(v)
    return out


def fuzzy_match_address(x: DataFrame, y: DataFrame, x_id: str, y_id: str, limits: Mapping[str, float] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``x_id, y_id``: rows whose every field is among the nearest of its kind.

    For each of the twelve fields the values of ``y`` (with equal ``by``) at the
    least distance within the field's limit qualify; rows of ``y`` that qualify in
    all fields come out. A limit of 0 is equality, infinity no condition.
    """
    limits = resolve_limits(limits)
    require(x, x_id, *FLAT)
    require(y, y_id, *FLAT)
    by = list(by)
    low = lambda d, i, n: d.select(F.col(i).alias(n), *by, *(F.lower(f).alias(f) for f in FLAT if f not in by))
    xs, ys = low(x, x_id, "x_id"), low(y, y_id, "y_id")
    same = [f for f in FLAT if f not in by and limits[f] == 0]
    near = [f for f in FLAT if f not in by and 0 < limits[f] < math.inf]
    out = xs.select("x_id", *by, *same, *near)
    for f in near:
        pairs = nearest_pairs(xs.select(*by, F.col(f).alias("xv")), ys.select(*by, F.col(f).alias("yv")), limits[f], by)
        out = out.withColumnRenamed(f, "xv").join(pairs.drop("dist"), [*by, "xv"]).withColumnRenamed("yv", f).drop("xv")
    keys = [*by, *same, *near]
    return out.join(ys.select("y_id", *keys), keys).select("x_id", "y_id").distinct() if keys else out.crossJoin(ys.select("y_id")).select("x_id", "y_id")


def fuzzy_left_join(x: DataFrame, y: DataFrame, x_id: str, y_id: str, limits: Mapping[str, float] | None = None) -> DataFrame:
    """``x_id, y_id``: all rows of ``x`` with all their candidates of equal ZIP
    (``y_id`` NULL without any). Place fields other than the ZIP do not count;
    a missing ZIP matches nothing."""
    free = resolve_limits(limits) | {f: math.inf for f in PLACE}
    pairs = fuzzy_match_address(x.where("place_zipcode is not null"), y.where("place_zipcode is not null"), x_id, y_id, free, ["place_zipcode"])
    return x.select(F.col(x_id).alias("x_id")).join(pairs, "x_id", "left").select("x_id", "y_id")
