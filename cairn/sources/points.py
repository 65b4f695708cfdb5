"""Address points of the national schema as address records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.dicts import map_direction, map_post_type, map_pre_type, map_state
from cairn.functions.phonetic import map_ordinal
from cairn.session import require


def read_points(raw: DataFrame, county: str | None = None, state: str | None = None) -> DataFrame:
    """Flat address, attributes and coordinates of raw address points.

    Filters on county and state reach the scan. Points whose ZIP is not of five
    characters are left out (NULL stays); NULL parts become ``""``.
    """
    require(raw, "add_number", "st_name", "zip_code", "uuid")
    if state is not None:
        raw = raw.where(F.col("state") == state)
    if county is not None:
        raw = raw.where(F.col("county") == county)
    raw = raw.where("zip_code is null or length(zip_code) = 5")
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    return raw.select(
        e("addnum_pre").alias("number_prefix"), F.coalesce(F.col("add_number").cast("string"), F.lit("")).alias("number_digits"), e("addnum_suf").alias("number_suffix"),
        map_direction(e("st_predir")).alias("street_predirectional"), e("st_premod").alias("street_premodifier"), map_pre_type(e("st_pretyp")).alias("street_pretype"), map_ordinal(e("st_name")).alias("street_name"),
        map_post_type(e("st_postyp")).alias("street_posttype"), map_direction(e("st_posdir")).alias("street_postdirectional"),
        e("post_city").alias("place_name"), map_state(e("state")).alias("place_state"), e("zip_code").alias("place_zipcode"),
        "subaddress", "uuid", F.col("dateupdate").cast("date").alias("date_update"), F.col("natgrid").alias("national_grid"), "placement", F.col("addrclass").alias("address_class"), F.col("addr_type").alias("address_type"), "parcel_id", "longitude", "latitude",
    )
