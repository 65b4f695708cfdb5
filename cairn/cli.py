"""``python -m cairn.cli INPUT RANGES``: geocodes the ``address`` column of a CSV
or Parquet file along street ranges and writes ``INPUT-stem__cairn-vX__geocoded``."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn import __version__
from cairn.functions.cells import cell
from cairn.functions.tagger import parse_addresses
from cairn.functions.text import STREET, format_parts
from cairn.operators.geocode import geocode
from cairn.operators.spatial import parse_point
from cairn.session import clear_stages, shuffled


def output_path(source: str) -> str:
    p = Path(source)
    return str(p.with_name(f"{p.stem}__cairn-v{__version__}__geocoded{p.suffix}"))


def geocode_table(df: DataFrame, ranges: DataFrame, column: str = "address", offset: float = 10.0) -> DataFrame:
    """The input with six ``addr_*`` columns."""
    if column not in df.columns:
        raise ValueError(f"no column {column}")
    rows = df.withColumn("__row", F.xxhash64(column))  # one lookup for each text
    parsed = parse_addresses(rows.select("__row", column).distinct(), column)
    found = geocode(parsed, ranges, "__row", offset=offset).withColumn("p", parse_point("matched_geography"))
    flat = found.select(F.col("x_id").alias("__row"), F.col("geocode_stage").alias("addr_geocode_stage"), F.col("matched_zipcode").alias("addr_matched_zipcode"), format_parts(*(F.col(f"matched_{c}") for c in STREET)).alias("addr_matched_street"), F.col("p.lon").alias("addr_longitude"), F.col("p.lat").alias("addr_latitude"))
    return rows.join(shuffled(flat), "__row", "left").drop("__row").withColumn("addr_s2_cell", cell(F.col("addr_longitude"), F.col("addr_latitude")))


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("source")
    parser.add_argument("ranges")
    parser.add_argument("--column", default="address")
    parser.add_argument("--offset", type=float, default=10.0)
    a = parser.parse_args(args)
    if Path(a.source).suffix not in (".csv", ".parquet"):
        parser.error("the input must be CSV or Parquet")
    spark = SparkSession.builder.getOrCreate()
    df = spark.read.csv(a.source, header=True) if a.source.endswith(".csv") else spark.read.parquet(a.source)
    out = geocode_table(df, spark.read.parquet(a.ranges), a.column, a.offset)
    target = output_path(a.source)
    if target.endswith(".csv"):
        out.write.mode("overwrite").option("header", True).option("nullValue", "").csv(target)
    else:
        out.write.mode("overwrite").parquet(target)
    clear_stages(spark)
    print(target)


if __name__ == "__main__":
    main()
