"""Diagnostics of matching and mapping."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.dicts import dictionary, strip
from cairn.functions.text import NUMBER, STREET, format_address, format_number, format_parts
from cairn.operators.match import AddressIndex, match_addresses, match_stage


def unmapped_words(df: DataFrame, column: str, kind: str) -> DataFrame:
    """``word, n``: non-empty values that the dictionary does not know."""
    known = df.sparkSession.createDataFrame([(w,) for w in dictionary(kind)], "known string")
    words = df.select(strip(F.col(column)).alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.join(known, F.lower("word") == F.col("known"), "left_anti")


def problem_examples(df: DataFrame, column: str, n: int = 5, width: int = 120) -> str:
    """The first ``n`` values of a column (in their order) as one text, line ends
    as spaces and long ones cut, and how many more there are."""
    values = df.select(F.col(column).cast("string").alias("v"))
    total = values.count()
    shown = [re.sub(r"[\r\n\t]+", " ", r["v"]) if r["v"] is not None else "<NA>" for r in values.orderBy("v").limit(n).collect()]
    text = ", ".join(f'"{v if len(v) <= width else v[: width - 3] + "..."}"' for v in shown)
    return text + (f", ... and {total - n} more" if total > n else "")


def explain_match(x: DataFrame, y: DataFrame, x_id: str = "x_id", y_ord: str = "y_ord", **options) -> DataFrame:
    """For each row of ``x`` its stage and the sizes of the pools it was sought
    in: addresses of the matched ZIP, streets there, numbers on the street."""
    index = AddressIndex(y, y_ord)
    found = match_addresses(x, index, x_id, **options)
    zips, streets = _pools(index)
    return found.withColumn("stage", match_stage(strict=False)).join(zips, "place_zipcode", "left").join(streets, ["place_zipcode", *STREET], "left").select("x_id", "stage", "zip_addresses", "zip_streets", "street_numbers")


def _pools(index: AddressIndex) -> tuple[DataFrame, DataFrame]:
    zips = index.rows.groupBy("place_zipcode").agg(F.count(F.lit(1)).alias("zip_addresses"), F.count_distinct(*STREET).alias("zip_streets"))
    streets = index.rows.groupBy("place_zipcode", *STREET).agg(F.count(F.lit(1)).alias("street_addresses"), F.count_distinct("number_digits").alias("street_numbers"))
    return zips, streets


def stage_table(x: DataFrame, y: DataFrame, x_id: str = "x_id", y_ord: str = "y_ord", **options) -> DataFrame:
    """Four rows for each row of ``x``, one a stage: ``x_id, position, stage``
    (zip, street, number, final), ``status, input, matched, candidates`` (the
    addresses, for the street also the streets, among which was sought).

    A stage is ``skipped`` if the one before found nothing, ``no match``, or
    says how it matched: ``exact``, ``variant``, ``fuzzy_or_phonetic``,
    ``fuzzy``; the final one says how far the match came."""
    index = AddressIndex(y, y_ord)
    found = match_addresses(x, index, x_id, **options)
    zips, streets = _pools(index)
    m = found.withColumn("stage", match_stage(strict=False)).join(zips, "place_zipcode", "left").join(streets, ["place_zipcode", *STREET], "left")
    given = x.select(F.col(x_id).alias("x_id"), F.struct(F.coalesce("place_zipcode", F.lit("")).alias("zip"), format_parts(*(F.col(c) for c in STREET)).alias("street"), format_number(*(F.col(c) for c in NUMBER)).alias("number"), format_address().alias("final")).alias("g"))
    got = F.struct(F.coalesce("place_zipcode", F.lit("")).alias("zip"), format_parts(*(F.col(c) for c in STREET)).alias("street"), format_number(*(F.col(c) for c in NUMBER)).alias("number"), format_address().alias("final"))
    both = m.withColumn("m", got).join(given, "x_id")
    at = F.array_position(F.array(*(F.lit(s) for s in ("none", "zip", "street", "number"))), F.col("stage"))
    how = lambda part, need, other: F.when(at < need - 1, "skipped").when(at < need, "no match").when(F.col(f"g.{part}") == F.col(f"m.{part}"), "exact").otherwise(other)
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    rows = [
        ("zip", how("zip", 2, "variant"), count("zip_addresses")),
        ("street", how("street", 3, "fuzzy_or_phonetic"), F.when(at < 2, "0").otherwise(F.concat(count("zip_streets"), F.lit(" streets / "), count("zip_addresses"), F.lit(" addresses")))),
        ("number", how("number", 4, "fuzzy"), F.when(at < 3, "0").otherwise(count("street_addresses"))),
        ("final", F.col("stage"), F.when(at == 4, "1 best match").when(at == 3, "street-only result").when(at == 2, "zip-only result").otherwise("no result")),
    ]
    stages = F.array(*(F.struct(F.lit(i).alias("position"), F.lit(s).alias("stage"), status.alias("status"), F.col(f"g.{s}").alias("input"), F.col(f"m.{s}").alias("matched"), c.alias("candidates")) for i, (s, status, c) in enumerate(rows, 1)))
    return both.select("x_id", F.explode(stages).alias("s")).select("x_id", "s.*")
