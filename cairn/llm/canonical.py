"""Freely entered values mapped to the entries of a reference list.

SQL only. Every reference string is cut into k + 1 segments; a value within k
edits holds one of them unchanged, at a position that differs by at most a few
characters, so equality joins on positional substrings find all candidates.
The built-in Levenshtein function and the alignment distance verify them, and
what finds no entry is reported through an anti-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.dicts import POST_TYPES, dictionary, entries
from cairn.functions.distance import osa_sql
from cairn.llm.address import typed_spellings
from cairn.session import materialize, parallelism, require

# Short and long forms of words in place names.
PLACE_WORDS = {"ft": "fort", "frt": "fort", "mt": "mount", "mnt": "mount", "st": "saint", "ste": "saint", "snt": "saint", "n": "north", "no": "north", "nth": "north", "s": "south", "so": "south", "jct": "junction", "junc": "junction", "jnc": "junction", "junct": "junction", "jctn": "junction", "ldg": "landing", "lndg": "landing", "lg": "landing", "lndng": "landing", "hts": "heights", "hgts": "heights", "ht": "heights", "spgs": "springs", "spr": "springs", "sprs": "springs", "spg": "springs", "fls": "falls", "fl": "falls", "nw": "new"}
TYPE_WORDS = {"vue": "Vw", "rn": "Run", "trial": "Trl"}
STATE_CODES = sorted({v.lower() for v in dictionary("state").values()})
STATE_WORDS = (*sorted({w.lower() for w in dictionary("state")} | set(STATE_CODES), key=len, reverse=True), "usa", "us")


def place_sql(c: str) -> str:
    """A place name in plain form, without spaces: lower case, no accents, no
    decoration (town, state and ZIP words), misread digits as letters, short
    words written out, inverted forms put straight."""
    out = f"translate(lower({c}), 'áàâäéèêëíìîïóòôöúùûüñç', 'aaaaeeeeiiiioooouuuunc')"
    out = f"regexp_replace({out}, '\\\\(.*?\\\\)', ' ')"
    out = f"regexp_replace({out}, '[, ]+[0-9]{{5}}(-?[0-9]{{4}})?\\\\s*$', ' ')"
    out = f"regexp_replace(trim({out}), '[,. ]+({'|'.join(STATE_WORDS)})[.]?$', '')"
    out = f"regexp_replace(trim({out}), '^([^,]+), *([^,]+)$', '$2 $1')"
    out = f"translate({out}, '0158', 'olsb')"
    out = f"concat(' ', trim(regexp_replace({out}, '[^a-z]+', ' ')), ' ')"
    for form in (r"^ (city|town|village|twp|township) of ", r" (city|town|village|twp|township) $"):
        out = f"regexp_replace({out}, '{form}', ' ')"
    for short, long in PLACE_WORDS.items():
        out = f"replace({out}, ' {short} ', ' {long} ')"
    return f"trim({out})"


def zip_sql(c: str) -> str:
    """A ZIP in plain form: misread letters as digits, labels, decimals and the
    four-digit part cut, a lost leading zero put back."""
    out = f"regexp_replace(upper({c}), '^\\\\s*(ZIP( *CODE)?|[A-Z]{{2}})[: ]+|[#\\\\s]', '')"
    out = f"regexp_replace({out}, '[.]0+$', '')"
    out = f"translate({out}, 'OQILSBZG', '00115826')"
    out = f"CASE WHEN {out} RLIKE '^[0-9]{{5}}-?[0-9]{{4}}$' THEN substr({out}, 1, 5) ELSE regexp_replace({out}, '-', '') END"
    return f"CASE WHEN length({out}) = 4 AND {out} RLIKE '^[0-9]+$' THEN concat('0', {out}) ELSE {out} END"


def type_sql(c: str) -> str:
    return f"regexp_replace(translate(lower({c}), '015', 'ols'), '[^a-z]+', '')"


def segments(ref: DataFrame) -> DataFrame:
    """``ref`` (``field, text, k``) cut into k + 1 segments as even as can be:
    adds ``size, seg, pos`` (1-based), ``len`` and ``piece``."""
    cut = ref.withColumn("size", F.length("text")).withColumn("seg", F.explode(F.sequence(F.lit(1), F.col("k") + 1)))
    base, more = F.expr("size div (k + 1)"), F.expr("size % (k + 1)")
    # the last segments are the longer ones
    short = F.col("k") + 1 - more
    cut = cut.withColumn("len", base + F.when(F.col("seg") > short, 1).otherwise(0))
    cut = cut.withColumn("pos", (F.col("seg") - 1) * base + F.greatest(F.col("seg") - 1 - short, F.lit(0)) + 1)
    return cut.withColumn("piece", F.expr("substr(text, pos, len)"))


def near_strings(values: DataFrame, ref: DataFrame) -> DataFrame:
    """``field, value, text, dist`` for all pairs of equal field with at most
    ``k`` edits (Levenshtein), where ``k`` belongs to the reference string.

    ``values`` has ``field, value``; ``ref`` has ``field, text, k``. NULL and
    empty strings match nothing; a reference string not longer than k is
    compared as if k were one less than its length.
    """
    ref = ref.where("text is not null and text <> ''").select("field", "text", F.least("k", F.length("text") - 1).alias("k")).distinct()
    cut = segments(ref)
    shapes = cut.select("field", "k", "size", "seg", "pos", "len").distinct()
    reach = ref.groupBy("field").agg(F.max("k").alias("most"))
    spread = values.where("value is not null and value <> ''").select("field", "value").repartition(parallelism(values.sparkSession), "field", "value").distinct()
    sized = spread.join(F.broadcast(reach), "field")  # one row for each field of the list
    sized = sized.withColumn("size", F.explode(F.sequence(F.greatest(F.length("value") - F.col("most"), F.lit(1)), F.length("value") + F.col("most"))))
    shaped = sized.join(shapes, ["field", "size"]).withColumn("delta", F.length("value") - F.col("size")).where(F.abs("delta") <= F.col("k"))
    # where the segment may start if it is the first one left unchanged (seen from either end)
    low = F.greatest(F.lit(1), F.col("pos") - (F.col("seg") - 1), F.col("pos") + F.col("delta") - (F.col("k") + 1 - F.col("seg")))
    high = F.least(F.length("value") - F.col("len") + 1, F.col("pos") + (F.col("seg") - 1), F.col("pos") + F.col("delta") + (F.col("k") + 1 - F.col("seg")))
    starts = shaped.withColumns({"low": low, "high": high}).where("low <= high").withColumn("at", F.explode(F.sequence("low", "high")))
    probes = starts.select("field", "value", "k", "size", "seg", F.expr("substr(value, at, len)").alias("piece"))
    pairs = probes.join(cut.select("field", "k", "size", "seg", "piece", "text"), ["field", "k", "size", "seg", "piece"]).select("field", "value", "text", "k").distinct()
    return pairs.withColumn("dist", F.expr("levenshtein(value, text, k)")).where("dist >= 0").select("field", "value", "text", "dist")


LONG_NAME, SHORT_NAME, LONG_TYPE = 8, 5, 4  # letters from which a name may have two slips, a name one and its exchange, a street type one


def edits_allowed(field: Column, size: Column) -> Column:
    """Levenshtein edits within which an entry is sought: twice the slips, since an exchange of neighbours counts two."""
    return F.when(field == "name", F.when(size >= LONG_NAME, 4).when(size >= SHORT_NAME, 2).otherwise(1)).when(field == "zipcode", 2).otherwise(F.when(size >= LONG_TYPE, 2).otherwise(0))


def references(canon: DataFrame) -> DataFrame:
    """The reference strings: plain forms of the entries, for street types also
    their usual spellings. ``field, text, canon_id, k``."""
    spelling = canon.sparkSession.createDataFrame([(k, v.lower()) for k, v in (typed_spellings(entries(POST_TYPES)) | entries(POST_TYPES) | TYPE_WORDS).items()], "spelling string, canonical string")
    name = canon.where("field = 'name'").select("field", F.expr(f"replace({place_sql('canonical')}, ' ', '')").alias("text"), "canon_id")
    code = canon.where("field = 'zipcode'").select("field", F.expr(zip_sql("canonical")).alias("text"), "canon_id")
    kind = canon.where("field = 'posttype'").select("field", F.expr(type_sql("canonical")).alias("text"), "canon_id")
    more = kind.join(spelling, kind["text"] == spelling["canonical"]).select("field", F.expr(type_sql("spelling")).alias("text"), "canon_id")
    size = F.length("text")
    k = edits_allowed(F.col("field"), size)
    return name.unionByName(code).unionByName(kind).unionByName(more).where("text <> ''").groupBy("field", "text").agg(F.min("canon_id").alias("canon_id")).withColumn("k", k)


def values_of(entries: DataFrame) -> DataFrame:
    """``id, field, given`` of every non-empty value, ``entries`` being wide."""
    stacked = entries.select(F.col("intake_id").alias("id"), F.expr("stack(3, 'name', name, 'posttype', posttype, 'zipcode', zipcode) as (field, given)"))
    return stacked.where("given is not null and trim(given) <> ''").distinct()


def plain_sql() -> str:
    return f"CASE field WHEN 'name' THEN {place_sql('given')} WHEN 'zipcode' THEN {zip_sql('given')} ELSE {type_sql('given')} END"


def candidates(values: DataFrame, canon: DataFrame) -> DataFrame:
    """``field, given, canon_id, dist``: for each distinct value the entries at
    most two slips away (one for ZIPs and street types), by the least distance.

    Where an edge word may be decoration (a town word or a state, itself
    misspelt), the value without it is tried too.
    """
    given = materialize(values.select("field", "given").distinct().withColumn("plain", F.expr(plain_sql())), "given")
    solid = given.select("field", "given", F.expr("replace(plain, ' ', '')").alias("value"))
    words = "split(plain, ' ')"
    tail = given.where(f"field = 'name' and size({words}) >= 2 and (least(levenshtein(element_at({words}, -1), 'city'), levenshtein(element_at({words}, -1), 'usa'), levenshtein(element_at({words}, -1), 'twp')) <= 2 or length(element_at({words}, -1)) <= 3)")
    tail = tail.select("field", "given", F.expr(f"array_join(slice({words}, 1, size({words}) - 1), '')").alias("value"))
    # "city of", misspelt
    head = given.where("field = 'name' and length(plain) >= 12 and levenshtein(substr(plain, 1, 8), 'city of ', 3) >= 0").select("field", "given", F.expr("regexp_replace(regexp_replace(plain, '^\\\\S+ \\\\S+ ', ''), ' ', '')").alias("value"))
    edge = f"^cityof|(city|usa|{'|'.join(STATE_CODES)})$"
    glued = given.where(f"field = 'name' and replace(plain, ' ', '') rlike '{edge}'").select("field", "given", F.expr(f"regexp_replace(replace(plain, ' ', ''), '{edge}', '')").alias("value"))
    forms = solid.unionByName(tail).unionByName(head).unionByName(glued).where("value <> ''").distinct()
    forms = materialize(forms, "value_forms")
    ref = materialize(references(canon), "references")
    near = near_strings(forms, ref)
    near = near.withColumn("slips", F.when(F.col("dist") <= 1, F.col("dist")).otherwise(F.expr(osa_sql("value", "text"))))
    limit = F.when(F.col("field") == "name", F.when(F.length("text") >= LONG_NAME, 2).otherwise(1)).otherwise(1)
    found = forms.join(near.where(F.col("slips") <= limit), ["field", "value"]).join(ref.select("field", "text", "canon_id"), ["field", "text"])
    return found.groupBy("field", "given", "canon_id").agg(F.min("slips").alias("dist"))


def mapped_values(entries: DataFrame, canon: DataFrame) -> DataFrame:
    """``id, field, given, canon_id``: ``map_entries`` with the value as given."""
    require(entries, "intake_id", "name", "posttype", "zipcode")
    require(canon, "canon_id", "field", "canonical")
    values = materialize(values_of(entries), "values")
    return _choose(values, materialize(candidates(values, canon), "near"))


def map_entries(entries: DataFrame, canon: DataFrame) -> DataFrame:
    """``intake_id, field, canon_id``: the entry of ``canon`` that each value of
    ``entries`` (``intake_id, name, posttype, zipcode``) means.

    The nearest entry wins. Among equally near ones the other fields of the
    record decide: a name and a ZIP belong together if they stand together in
    ``TOGETHER_SHARE`` of the records that have either exactly. A ZIP one slip away is not taken when the record's place is
    known and has no such ZIP, nor a name two slips away when the ZIP is known
    and belongs elsewhere. What remains tied goes to the entry exactly entered
    more often, then to the lowest ``canon_id``. NULL, empty and placeholder
    values give no row (see ``unmatched``), repeated records one row, empty
    tables an empty result; extra columns are ignored.
    """
    return mapped_values(entries, canon).select(F.col("id").alias("intake_id"), "field", "canon_id").distinct()


#: Of the records in which a name, or a ZIP, stands exactly beside an exact ZIP or name: the part in which a pair belongs together.
TOGETHER_SHARE = 0.02


def _choose(values: DataFrame, near: DataFrame) -> DataFrame:
    """The entry of each value of each record, among those ``near`` it."""
    options = materialize(values.join(near, ["field", "given"]).select("id", "field", "given", "canon_id", "dist"), "options")
    exact = options.where("dist = 0").select("id", "field", "canon_id").distinct()
    usual = exact.groupBy("field", "canon_id").agg(F.count(F.lit(1)).alias("n"))
    names, codes = (exact.where(F.col("field") == f).select("id", F.col("canon_id").alias(f"{f}_id")) for f in ("name", "zipcode"))
    # a table of names by ZIPs, however many records there are
    both = materialize(names.join(codes, "id").groupBy("name_id", "zipcode_id").agg(F.count(F.lit(1)).alias("both")), "both")
    of = lambda c: F.sum("both").over(Window.partitionBy(c))
    together = materialize(both.withColumn("least", TOGETHER_SHARE * F.greatest(of("name_id"), of("zipcode_id"))).where("both >= least").select("name_id", "zipcode_id"), "together")
    sure = lambda f: options.where((F.col("field") == f) & (F.col("dist") <= (1 if f == "name" else 0))).groupBy("id").agg(F.min("canon_id").alias(f"{f}_id"), F.max("canon_id").alias("high")).where(f"{f}_id = high").drop("high")
    by_name = sure("name").join(together, "name_id").select("id", F.lit("zipcode").alias("field"), F.col("zipcode_id").alias("canon_id"), F.lit(1).alias("fits"))
    by_code = sure("zipcode").join(together, "zipcode_id").select("id", F.lit("name").alias("field"), F.col("name_id").alias("canon_id"), F.lit(1).alias("fits"))
    fits = by_name.unionByName(by_code)
    known = fits.select("id", "field").distinct().withColumn("known", F.lit(1))
    judged = options.join(fits, ["id", "field", "canon_id"], "left").join(known, ["id", "field"], "left").join(usual, ["field", "canon_id"], "left")
    strange = F.col("known").isNotNull() & F.col("fits").isNull()
    judged = judged.where(~(strange & (((F.col("field") == "zipcode") & (F.col("dist") >= 1)) | ((F.col("field") == "name") & (F.col("dist") >= 2)))))
    judged = judged.withColumn("rank", F.col("dist") + F.when(strange, 0.5).otherwise(0.0))
    order = Window.partitionBy("id", "field", "given").orderBy("rank", F.coalesce("n", F.lit(0)).desc(), "canon_id")
    best = judged.withColumn("r", F.row_number().over(order)).where("r = 1")
    return best.select("id", "field", "given", F.col("canon_id").cast("int").alias("canon_id"))


def unmatched(entries: DataFrame, canon: DataFrame, mapped: DataFrame | None = None) -> DataFrame:
    """``field, given, n_records``: the values of records that found no entry,
    also where the record has another value of the field that did.
    ``mapped`` is the result of ``mapped_values``, if there is one already."""
    mapped = mapped_values(entries, canon) if mapped is None else mapped
    left = values_of(entries).join(mapped.select("id", "field", "given"), ["id", "field", "given"], "left_anti")
    return left.groupBy("field", "given").agg(F.count_distinct("id").alias("n_records"))
