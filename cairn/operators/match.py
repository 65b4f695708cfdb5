"""Staged matching of addresses: ZIP, then street within the ZIP, then number
within the street. Every stage is an equality join on a block, and one candidate
wins by a total order that ends in ``y_ord``, the position of a reference row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.distance import osa
from cairn.functions.phonetic import is_ordinal, ordinal_neighbors, street_key
from cairn.functions.text import FLAT, NUMBER, STREET, format_number, to_int
from cairn.functions.zips import VARIANTS, choose_zips
from cairn.operators.fuzzy import close_pairs, nearest_pairs
from cairn.session import materialize, require, shuffled

TYPE_MODES = ("exact", "swap", "compatible", "ignore")
DIRECTION_MODES = ("exact", "swap", "ignore")


def _token(c: str) -> Column:
    return F.lower(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("<empty>")))


def _pair_variants(a: str, b: str, mode: str) -> Column:
    """array<struct<key, rank>> of a pair of components."""
    x, y = _token(a), _token(b)
    none = (x == "<empty>") & (y == "<empty>")
    one = F.struct(F.concat_ws("|", x, y).alias("key"), F.when(none, 2).otherwise(0).alias("rank"))
    if mode in ("ignore", "compatible"):
        return F.array(F.struct(F.lit("*").alias("key"), F.lit(0).alias("rank")))
    if mode == "exact":
        return F.array(one)
    two = F.struct(F.concat_ws("|", y, x).alias("key"), F.when(none, 2).otherwise(1).alias("rank"))
    return F.when(x == y, F.array(one)).otherwise(F.array(one, two))


def compatible_rank(p: str, q: str) -> Column:
    """Agreement of pre-types and post-types of two streets (column prefixes):
    0 a part equal in its place, 1 only across places, 2 one side blank, NULL
    for a conflict."""
    e = lambda c: F.nullif(F.lower(F.col(c)), F.lit(""))
    a1, a2, b1, b2 = e(f"{p}street_pretype"), e(f"{p}street_posttype"), e(f"{q}street_pretype"), e(f"{q}street_posttype")
    eq = lambda u, v: F.coalesce(u == v, F.lit(False))
    ne = lambda u, v: F.coalesce(u != v, F.lit(False))
    typed = (a1.isNotNull() | a2.isNotNull()) & (b1.isNotNull() | b2.isNotNull())
    straight, crossed = eq(a1, b1) | eq(a2, b2), eq(a1, b2) | eq(a2, b1)
    return F.when(ne(a1, b1) | ne(a2, b2), F.lit(None).cast("int")).when(straight, 0).when(typed & crossed, 1).when(typed, F.lit(None).cast("int")).otherwise(2)


def match_streets(x: DataFrame, y: DataFrame, x_id: str, y_ord: str, by: Sequence[str] = (), phonetic: float = 1, fuzzy: float = 2, types: str = "exact", directions: str = "exact") -> DataFrame:
    """``x_id, y_ord, how``: for each row of ``x`` the street of ``y`` it means.

    Exact readings first (pre-modifier, name, type and direction under the
    modes), else within equal type and direction the nearest names up to
    ``fuzzy`` edits, and names of equal phonetic key; ordinal names instead take
    neighbouring ordinals if ``phonetic`` is at least 1. The winner has the best
    component rank, then a name before a phonetic hit, then the lowest
    ``y_ord``. Rows without a street name match nothing.
    """
    if types not in TYPE_MODES or directions not in DIRECTION_MODES:
        raise ValueError("unknown matching mode")
    require(x, x_id, *by, *STREET)
    require(y, y_ord, *by, *STREET)
    by = list(by)
    usable = "street_name is not null and street_name <> ''"
    xs = x.where(usable).select(F.col(x_id).alias("x_id"), *by, *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in STREET))
    ys = y.where(usable).groupBy(*by, *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in STREET)).agg(F.min(y_ord).alias("y_ord")).withColumn("yv", F.lower("street_name")).withColumn("key", street_key(F.col("yv")))
    # stage boundaries: both sides are read several times below
    xs, ys = materialize(xs, "x_streets"), materialize(ys, "y_streets")
    forms = xs.select(*by, *STREET).distinct()

    def keyed(d: DataFrame) -> DataFrame:
        d = d.withColumn("tv", F.explode(_pair_variants("street_pretype", "street_posttype", types))).withColumn("dv", F.explode(_pair_variants("street_predirectional", "street_postdirectional", directions)))
        return d.withColumns({"bucket": F.concat_ws("/", "tv.key", "dv.key"), "t_rank": F.col("tv.rank"), "d_rank": F.col("dv.rank")}).drop("tv", "dv")

    kept = [c for c in STREET if c in ("street_pretype", "street_posttype")]
    a = keyed(forms).select(*by, *STREET, "bucket", F.col("t_rank").alias("xt"), F.col("d_rank").alias("xd"))
    b = keyed(ys).select(*by, "y_ord", "bucket", "yv", "key", F.col("t_rank").alias("yt"), F.col("d_rank").alias("yd"), *(F.col(c).alias(f"y_{c}") for c in ("street_premodifier", "street_name", *kept)))
    t_rank = compatible_rank("", "y_") if types == "compatible" else F.col("xt") + F.col("yt")
    on = [*by, "bucket", "m", "n"]
    exact = a.withColumns({"m": _token("street_premodifier"), "n": _token("street_name")}).join(shuffled(b.drop("yv", "key").withColumns({"m": _token("y_street_premodifier"), "n": _token("y_street_name")})), on)
    exact = exact.withColumns({"t": t_rank, "d": F.col("xd") + F.col("yd")}).where("t is not null")
    key = [*by, *STREET]
    first = exact.groupBy(*key).agg(F.min(F.struct((F.col("t") + F.col("d")).alias("c"), "t", "d", "y_ord")).alias("best")).select(*key, F.col("best.y_ord").alias("y_ord"), F.lit("exact").alias("how"))
    first = materialize(first, "exact_streets")
    # phonetic keys are written too, so that each plan below stays small
    rest = materialize(a.join(shuffled(first), key, "left_anti").withColumn("xv", F.lower("street_name")).withColumn("x_key", street_key(F.col("xv"))), "other_streets")
    block = [*by, "bucket"]
    ykeys = materialize(b.select(*block, "key", "yv").distinct(), "y_keys")
    yb = b.drop("key")
    pairs = materialize(nearest_pairs(rest.select(*block, "xv"), ykeys.select(*block, "yv"), fuzzy, block).drop("dist"), "pairs")
    # an ordinal whose number is not in the bucket takes no name that only looks alike
    ordinal = rest.where(is_ordinal(F.col("xv"))).select(*block, "xv", F.col("x_key").alias("key")).distinct()
    absent = ordinal.join(shuffled(ykeys.select(*block, "key").distinct()), [*block, "key"], "left_anti").select(*block, "xv")
    named = pairs.join(shuffled(absent), [*block, "xv"], "left_anti").withColumn("name_rank", F.lit(0))
    words = rest.where(~is_ordinal(F.col("xv"))).select(*block, "xv", F.col("x_key").alias("key")).where("key is not null and key not in ('', '0000')").distinct()
    heard = words.join(shuffled(ykeys), [*block, "key"]).select(*block, "xv", "yv")
    if phonetic >= 1:
        near = ordinal.select(*block, "xv", F.explode(ordinal_neighbors(F.col("key"))).alias("key"))
        heard = heard.unionByName(near.join(shuffled(ykeys), [*block, "key"]).select(*block, "xv", "yv"))
    names = materialize(named.unionByName(heard.withColumn("name_rank", F.lit(1))).groupBy(*block, "xv", "yv").agg(F.min("name_rank").alias("name_rank")), "names")
    second = rest.join(shuffled(names), [*block, "xv"]).join(shuffled(yb), [*block, "yv"]).withColumns({"t": t_rank, "d": F.col("xd") + F.col("yd")}).where("t is not null")
    second = second.groupBy(*key).agg(F.min(F.struct((F.col("t") + F.col("d")).alias("c"), "name_rank", "y_ord")).alias("best")).select(*key, F.col("best.y_ord").alias("y_ord"), F.when(F.col("best.name_rank") == 0, "name").otherwise("phonetic").alias("how"))
    return xs.join(shuffled(first.unionByName(second)), key).select("x_id", "y_ord", "how")


def match_numbers(x: DataFrame, y: DataFrame, x_id: str, y_ord: str, by: Sequence[str] = (), fuzzy: float = 1) -> DataFrame:
    """``x_id, y_ord``: for each row of ``x`` the first row of ``y`` (within ``by``)
    with the same number as text, else the nearest within ``fuzzy`` edits: by
    difference of digits, distance, then ``y_ord``. Rows without digits match
    nothing; NULL prefix and suffix are empty ones."""
    require(x, x_id, *by, *NUMBER)
    require(y, y_ord, *by, *NUMBER)
    by = list(by)
    text = F.lower(format_number(*(F.col(c) for c in NUMBER)))
    usable = "number_digits is not null and number_digits <> ''"
    xs = x.where(usable).select(F.col(x_id).alias("x_id"), *by, text.alias("xv"), to_int(F.col("number_digits")).alias("xn"))
    ys = y.where(usable).select(F.col(y_ord).alias("y_ord"), *by, text.alias("yv"), to_int(F.col("number_digits")).alias("yn")).groupBy(*by, "yv").agg(F.min("y_ord").alias("y_ord"), F.min_by("yn", "y_ord").alias("yn"))
    xs, ys = materialize(xs, "x_numbers"), materialize(ys, "y_numbers")
    exact = xs.join(ys.withColumnRenamed("yv", "xv"), [*by, "xv"]).select("x_id", "y_ord", F.lit("exact").alias("how"))
    if fuzzy < 1:
        return exact
    rest = xs.join(exact, "x_id", "left_anti")
    pairs = close_pairs(rest.select(*by, "xv"), ys.select(*by, "yv"), fuzzy, by)
    near = rest.join(pairs, [*by, "xv"]).join(ys, [*by, "yv"])
    near = near.groupBy("x_id").agg(F.min(F.struct(F.abs(F.col("xn") - F.col("yn")).alias("gap"), "dist", "y_ord")).alias("best")).select("x_id", F.col("best.y_ord").alias("y_ord"), F.lit("fuzzy").alias("how"))
    return exact.unionByName(near)


def unique_addresses(df: DataFrame, ordinal: str) -> DataFrame:
    """One row for each formatted text, the first by ``ordinal``."""
    from cairn.functions.text import format_address

    w = Window.partitionBy(format_address()).orderBy(ordinal)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


class AddressIndex:
    """Reference addresses made ready: NULL fields as empty ones, one row for each text."""

    def __init__(self, y: DataFrame, y_ord: str):
        require(y, y_ord, *FLAT)
        rows = y.select(F.col(y_ord).alias("y_ord"), *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in FLAT))
        self.rows = materialize(unique_addresses(rows, "y_ord"), "index")

    def summary(self) -> DataFrame:
        """``place_zipcode, n_addresses, n_streets`` of the index."""
        return self.rows.groupBy("place_zipcode").agg(F.count(F.lit(1)).alias("n_addresses"), F.count_distinct(*STREET).alias("n_streets"))


def match_addresses(x: DataFrame, y: DataFrame | AddressIndex, x_id: str = "x_id", y_ord: str = "y_ord", zip_variants: Sequence[str] | None = VARIANTS, phonetic: float = 2, fuzzy: float = 1, number_fuzzy: float = 1, types: str = "exact", directions: str = "exact") -> DataFrame:
    """One row for each row of ``x``: ``x_id``, the twelve fields of its match and
    ``y_ord`` of the matched row (NULL unless the number matched too).

    Partial matches have the ZIP, or ZIP and street, and NULL elsewhere.
    """
    index = y if isinstance(y, AddressIndex) else AddressIndex(y, y_ord)
    require(x, x_id, *FLAT)
    xs = materialize(x.select(F.col(x_id).alias("x_id"), *FLAT), "x")
    ref = index.rows
    zips = choose_zips(xs, "place_zipcode", ref, "place_zipcode", zip_variants)
    placed = materialize(xs.join(zips.select(F.col("source_zip").alias("place_zipcode"), F.col("zip").alias("at_zip")), "place_zipcode"), "placed")
    yz = ref.withColumnRenamed("place_zipcode", "at_zip")
    street = match_streets(placed, yz, "x_id", "y_ord", ["at_zip"], phonetic, fuzzy, types, directions).drop("how")
    chosen = materialize(street.join(yz.select("y_ord", *(F.col(c).alias(f"s_{c}") for c in STREET)), "y_ord").drop("y_ord"), "streets")
    at = placed.select("x_id", "at_zip", *NUMBER).join(chosen, "x_id")
    pool = yz.select("y_ord", "at_zip", *NUMBER, *(F.col(c).alias(f"s_{c}") for c in STREET))
    number = match_numbers(at, pool, "x_id", "y_ord", ["at_zip", *(f"s_{c}" for c in STREET)], number_fuzzy).drop("how")
    full = number.join(ref.select("y_ord", *(F.col(c).alias(f"m_{c}") for c in FLAT)), "y_ord")
    out = xs.select("x_id").join(placed.select("x_id", "at_zip"), "x_id", "left").join(chosen, "x_id", "left").join(full, "x_id", "left")
    cols = [F.coalesce(F.col(f"m_{c}"), F.col(f"s_{c}") if c in STREET else F.col("at_zip") if c == "place_zipcode" else F.lit(None).cast("string")).alias(c) for c in FLAT]
    return out.select("x_id", *cols, "y_ord")


def match_stage(strict: bool = True) -> Column:
    """none, zip, street or number of a match result (flat columns); ``strict``
    raises an error on a row that no match can give."""
    has = lambda cs: F.greatest(*(F.col(c).isNotNull().cast("int") for c in cs)) == 1
    z, s, n = F.col("place_zipcode").isNotNull(), F.col("street_name").isNotNull(), F.col("number_digits").isNotNull()
    stage = F.when(n, "number").when(s, "street").when(z, "zip").otherwise("none")
    if not strict:
        return stage
    other = has(["place_name", "place_state"])
    good = ~has(FLAT) | (z & ~has(STREET) & ~has(NUMBER) & ~other) | (z & s & ~has(NUMBER) & ~other) | (z & s & n)
    return F.when(good, stage).otherwise(F.raise_error(F.lit("not the result of a match")).cast("string"))


def same_index(index: AddressIndex, y: DataFrame, y_ord: str) -> bool:
    """Whether an index holds the addresses of ``y``: the same distinct twelve fields."""
    mine, theirs = index.rows.select(*FLAT).distinct(), AddressIndex(y, y_ord).rows.select(*FLAT).distinct()
    return not mine.exceptAll(theirs).take(1) and not theirs.exceptAll(mine).take(1)


def address_left_join(x: DataFrame, y: DataFrame, x_id: str, y_ord: str, suffix: tuple[str, str] = ("_x", "_y"), by: tuple[str, str] = ("", ""), prepared: AddressIndex | None = None, **options) -> DataFrame:
    """All rows of ``x`` with all rows of ``y`` whose twelve fields equal those of
    its match, NULL as an empty one; without a match once with NULL.

    ``by`` has the prefixes of the twelve columns on both sides. Columns of both
    sides: the address of ``x`` keeps its names, that of ``y`` gets the second
    suffix; other shared names get both. A ``prepared`` index of ``y`` saves its
    preparation; one of other addresses raises ``ValueError``."""
    a, b = ([p + c for c in FLAT] for p in by)
    require(x, x_id, *a)
    require(y, y_ord, *b)
    xs, ys = x.select(x_id, *(F.col(n).alias(c) for n, c in zip(a, FLAT))), y.select(y_ord, *(F.col(n).alias(c) for n, c in zip(b, FLAT)))
    if prepared is not None and not same_index(prepared, ys, y_ord):
        raise ValueError("the prepared index does not hold the addresses of y")
    found = match_addresses(xs, ys if prepared is None else prepared, x_id, y_ord, **options).where("y_ord is not null")
    shared = (set(x.columns) & set(y.columns)) - set(a) - set(b)
    rows = y.select(*(F.coalesce(F.col(n), F.lit("")).alias(f"__k_{c}") for n, c in zip(b, FLAT)), *(F.col(c).alias(c + suffix[1] if c in shared or c in b else c) for c in y.columns))
    on = [F.col(f"__k_{c}") == F.col(f"__m_{c}") for c in FLAT]
    pairs = found.select(F.col("x_id").alias("__x"), *(F.col(c).alias(f"__m_{c}") for c in FLAT)).join(rows, on).drop(*(f"__k_{c}" for c in FLAT), *(f"__m_{c}" for c in FLAT))
    left = x.select(F.col(x_id).alias("__id"), *(F.col(c).alias(c + suffix[0] if c in shared else c) for c in x.columns))
    return left.join(pairs, left["__id"] == pairs["__x"], "left").drop("__id", "__x")
