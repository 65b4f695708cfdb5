"""ZIP variants and the choice among known ZIPs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.distance import osa
from cairn.functions.text import valid_zip

VARIANTS = ("minus1", "plus1", "sub5", "sub4", "swap")


def check_variants(variants: Sequence[str]) -> list[str]:
    bad = [v for v in variants if v not in VARIANTS]
    if bad or not variants:
        raise ValueError(f"variants must be some of {', '.join(VARIANTS)}")
    return list(dict.fromkeys(variants))


def _made(z: Column, kind: str) -> Column:
    """Array of the raw variants of one kind."""
    pad = lambda n: F.lpad(n.cast("string"), 5, "0")
    n = z.try_cast("int")
    if kind == "minus1":
        return F.array(pad(n - 1))
    if kind == "plus1":
        return F.array(F.when(n < 99999, pad(n + 1)).otherwise("100000"))
    if kind == "sub5":
        return F.array(*(F.concat(F.substring(z, 1, 4), F.lit(str(d))) for d in range(10)))
    if kind == "sub4":
        return F.array(*(F.concat(F.substring(z, 1, 3), F.lit(str(d)), F.substring(z, 5, 1)) for d in range(10)))
    return F.array(F.concat(F.substring(z, 1, 1), F.substring(z, 3, 1), F.substring(z, 2, 1), F.substring(z, 4, 2)))


def zip_variants(z: Column, variants: Sequence[str] = VARIANTS) -> Column:
    """Ordered variants without the ZIP itself, repetitions and invalid ones.
    NULL (also for an invalid ZIP) gives NULL, ``""`` gives ``[""]``."""
    every = F.array_distinct(F.concat(*(_made(z, v) for v in check_variants(variants))))
    found = F.filter(every, lambda v: (v != z) & valid_zip(v))
    return F.when(z == "", F.array(F.lit(""))).when(valid_zip(z), found)


def zip_candidates(zips: DataFrame, zip_col: str, variants: Sequence[str] | None = VARIANTS) -> DataFrame:
    """``source_zip, source_zip_variant, source_zip_variant_rank, zip`` of the
    distinct usable ZIPs: themselves (rank 0) and their variants."""
    usable = zips.where(valid_zip(F.col(zip_col))).select(F.col(zip_col).alias("source_zip")).distinct()
    exact = usable.select("source_zip", F.lit("exact").alias("source_zip_variant"), F.lit(0).alias("source_zip_variant_rank"), F.col("source_zip").alias("zip"))
    if not variants:
        return exact
    kinds = F.array(*(F.struct(F.lit(v).alias("v"), F.lit(i).alias("r"), zip_variants(F.col("source_zip"), [v]).alias("z")) for i, v in enumerate(check_variants(variants), 1)))
    more = usable.select("source_zip", F.explode(kinds).alias("k")).select("source_zip", F.col("k.v").alias("source_zip_variant"), F.col("k.r").alias("source_zip_variant_rank"), F.explode("k.z").alias("zip"))
    return exact.unionByName(more)


def choose_zips(x: DataFrame, x_zip: str, y: DataFrame, y_zip: str, variants: Sequence[str] | None = VARIANTS) -> DataFrame:
    """``source_zip, zip``: for each distinct usable ZIP of ``x`` the ZIP of ``y``
    that it means: itself, else the nearest variant (by difference, then
    alignment distance, then value). ZIPs that find none are left out."""
    there = y.where(valid_zip(F.col(y_zip))).select(F.col(y_zip).alias("zip")).distinct()
    found = zip_candidates(x, x_zip, variants).select("source_zip", "zip").distinct().join(there, "zip")
    order = Window.partitionBy("source_zip").orderBy(F.when(F.col("zip") == F.col("source_zip"), 0).otherwise(1), F.abs(F.col("source_zip").cast("int") - F.col("zip").cast("int")), osa("source_zip", "zip"), F.col("zip").cast("int"))
    return found.withColumn("r", F.row_number().over(order)).where("r = 1").select("source_zip", "zip")
