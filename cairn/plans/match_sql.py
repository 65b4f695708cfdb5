"""SQL of the staged matching, for the comparison of results.

It states the stages over whole blocks, without any index: every pair of names
in a block is measured.
"""

from __future__ import annotations

from cairn.functions.text import FLAT, NUMBER, STREET


def empty(c: str) -> str:
    return f"lower(coalesce(nullif({c}, ''), '<empty>'))"


def is_ordinal(c: str) -> str:
    return f"regexp_full_match(lower({c}), '[0-9]+(st|nd|rd|th)')"


def soundex(c: str) -> str:
    """H and W do not separate equal codes, vowels do."""
    letters = f"regexp_replace(upper({c}), '[^A-Z]', '', 'g')"
    no_hw = f"(substr({letters}, 1, 1) || regexp_replace(substr({letters}, 2), '[HW]', '', 'g'))"
    codes = f"translate({no_hw}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202')"
    for digit in "123456":
        codes = f"regexp_replace({codes}, '{digit}+', '{digit}', 'g')"
    rest = f"replace(substr({codes}, 2), '0', '')"
    return f"CASE WHEN {c} IS NULL THEN NULL WHEN {letters} = '' THEN '0000' ELSE substr({letters}, 1, 1) || rpad(substr({rest}, 1, 3), 3, '0') END"


def mapped_key(c: str) -> str:
    """Phonetic key of a name whose ordinal words are numbers already."""
    return f"CASE WHEN {is_ordinal(c)} THEN '#' || lpad(regexp_extract({c}, '^[0-9]+'), 4, '0') ELSE {soundex(c)} END"


#: Ordinal keys with their neighbours.
NEIGHBORS = """ok AS (SELECT CAST(i AS VARCHAR) AS sig, '#' || lpad(CAST(i AS VARCHAR), 4, '0') AS key FROM range(1, 10000) t(i)),
  neighbors AS (SELECT DISTINCT key, neighbor FROM (SELECT key, '#' || rpad(lpad(sig, CAST(length(sig) + p AS INT), '0'), 4, '0') AS neighbor FROM ok, range(4) t(p) WHERE length(sig) + p <= 4
    UNION ALL SELECT key, '#' || lpad(substr(sig, 1, CAST(p - 1 AS INT)) || d || substr(sig, CAST(p + 1 AS INT)), 4, '0') AS neighbor FROM ok, range(1, 5) t(p), range(10) u(d) WHERE p <= length(sig) AND NOT (p = 1 AND d = 0)) q WHERE neighbor <> key)"""


def _variants(first: str, second: str, mode: str) -> str:
    x, y = empty(first), empty(second)
    none = f"({x} = '<empty>' AND {y} = '<empty>')"
    if mode in ("ignore", "compatible"):
        return "[{'k': '*', 'r': 0}]"
    one = f"{{'k': {x} || '|' || {y}, 'r': CASE WHEN {none} THEN 2 ELSE 0 END}}"
    if mode == "exact":
        return f"[{one}]"
    return f"CASE WHEN {x} = {y} THEN [{one}] ELSE [{one}, {{'k': {y} || '|' || {x}, 'r': CASE WHEN {none} THEN 2 ELSE 1 END}}] END"


def _compatible(a: str, b: str) -> str:
    v = [f"nullif(lower({s}.{c}), '')" for s in (a, b) for c in ("street_pretype", "street_posttype")]
    a1, a2, b1, b2 = v
    typed = f"(({a1} IS NOT NULL OR {a2} IS NOT NULL) AND ({b1} IS NOT NULL OR {b2} IS NOT NULL))"
    return f"CASE WHEN coalesce({a1} <> {b1}, false) OR coalesce({a2} <> {b2}, false) THEN NULL WHEN coalesce({a1} = {b1}, false) OR coalesce({a2} = {b2}, false) THEN 0 WHEN {typed} AND (coalesce({a1} = {b2}, false) OR coalesce({a2} = {b1}, false)) THEN 1 WHEN {typed} THEN NULL ELSE 2 END"


def streets(x: str, y: str, types: str = "exact", directions: str = "exact", phonetic: float = 1, fuzzy: float = 1, p: str = "s") -> str:
    """CTEs up to ``{p}_found`` (``zip``, street parts of ``x``, ``y_ord, how``). ``x`` and
    ``y`` are relations with ``zip`` and the street parts, ``y`` also ``y_ord``; prefixed names keep several uses apart."""
    parts = ", ".join(STREET)
    side = lambda t: f"SELECT *, tv.k || '/' || dv.k AS bucket, tv.r AS tr, dv.r AS dr, lower(street_name) AS low FROM (SELECT *, unnest({_variants('street_pretype', 'street_posttype', types)}) AS tv, unnest({_variants('street_predirectional', 'street_postdirectional', directions)}) AS dv FROM {t}) q"
    if types == "swap" or directions == "swap":  # two lists of different lengths: one after the other
        side = lambda t: f"SELECT *, tv.k || '/' || dv.k AS bucket, tv.r AS tr, dv.r AS dr, lower(street_name) AS low FROM (SELECT *, unnest({_variants('street_predirectional', 'street_postdirectional', directions)}) AS dv FROM (SELECT *, unnest({_variants('street_pretype', 'street_posttype', types)}) AS tv FROM {t}) q0) q"
    rank = _compatible("a", "b") if types == "compatible" else "a.tr + b.tr"
    same = " AND ".join(f"h.{c} = a.{c}" for c in ("zip", *STREET))
    near = f"""{p}_near AS (SELECT zip, bucket, xv, yv FROM (SELECT *, min(d) OVER (PARTITION BY zip, bucket, xv) AS m FROM (SELECT r.zip, r.bucket, r.low AS xv, b.low AS yv, damerau_levenshtein(r.low, b.low) AS d
      FROM (SELECT DISTINCT zip, bucket, low FROM {p}_rest) r JOIN (SELECT DISTINCT zip, bucket, low FROM {p}_b) b ON r.zip = b.zip AND r.bucket = b.bucket AND abs(length(r.low) - length(b.low)) <= {int(fuzzy)}) q WHERE d <= {int(fuzzy)}) w WHERE d = m)"""
    ordinal = f"UNION ALL SELECT o.zip, o.bucket, o.low, k.low, 1 FROM {p}_ordinal o JOIN neighbors n ON n.key = o.key JOIN {p}_keys k ON k.zip = o.zip AND k.bucket = o.bucket AND k.key = n.neighbor" if phonetic >= 1 else ""
    return f"""{p}_xs AS (SELECT DISTINCT zip, {parts} FROM {x} WHERE street_name <> ''), {p}_ys AS (SELECT zip, {parts}, min(y_ord) AS y_ord FROM {y} WHERE street_name <> '' GROUP BY ALL), {p}_a AS ({side(p + "_xs")}), {p}_b AS ({side(p + "_ys")}),
      {p}_hits AS (SELECT a.zip, {", ".join("a." + c for c in STREET)}, b.y_ord, {rank} AS t, a.dr + b.dr AS d FROM {p}_a a JOIN {p}_b b ON a.zip = b.zip AND a.bucket = b.bucket AND a.low = b.low AND {empty("a.street_premodifier")} = {empty("b.street_premodifier")}),
      {p}_first AS (SELECT zip, {parts}, y_ord, 'exact' AS how FROM (SELECT *, row_number() OVER (PARTITION BY zip, {parts} ORDER BY t + d, t, d, y_ord) AS k FROM {p}_hits WHERE t IS NOT NULL) q WHERE k = 1),
      {p}_rest AS (SELECT * FROM {p}_a a WHERE NOT EXISTS (SELECT 1 FROM {p}_first h WHERE {same})),
      {p}_keys AS (SELECT DISTINCT zip, bucket, low, {mapped_key("low")} AS key FROM {p}_b), {near},
      {p}_ordinal AS (SELECT DISTINCT zip, bucket, low, {mapped_key("low")} AS key FROM {p}_rest WHERE {is_ordinal("low")}),
      {p}_absent AS (SELECT * FROM {p}_ordinal o WHERE NOT EXISTS (SELECT 1 FROM {p}_keys k WHERE k.zip = o.zip AND k.bucket = o.bucket AND k.key = o.key)),
      {p}_words AS (SELECT DISTINCT zip, bucket, low, {mapped_key("low")} AS key FROM {p}_rest WHERE NOT {is_ordinal("low")}),
      {p}_names AS (SELECT zip, bucket, xv, yv, min(r) AS r FROM (SELECT zip, bucket, xv, yv, 0 AS r FROM {p}_near n WHERE NOT EXISTS (SELECT 1 FROM {p}_absent o WHERE o.zip = n.zip AND o.bucket = n.bucket AND o.low = n.xv)
        UNION ALL SELECT w.zip, w.bucket, w.low, k.low, 1 FROM {p}_words w JOIN {p}_keys k ON k.zip = w.zip AND k.bucket = w.bucket AND k.key = w.key WHERE w.key NOT IN ('', '0000') {ordinal}) q GROUP BY ALL),
      {p}_late AS (SELECT a.zip, {", ".join("a." + c for c in STREET)}, b.y_ord, n.r, {rank} AS t, a.dr + b.dr AS d FROM {p}_rest a JOIN {p}_names n ON n.zip = a.zip AND n.bucket = a.bucket AND n.xv = a.low JOIN {p}_b b ON b.zip = n.zip AND b.bucket = n.bucket AND b.low = n.yv),
      {p}_second AS (SELECT zip, {parts}, y_ord, CASE WHEN r = 0 THEN 'name' ELSE 'phonetic' END AS how FROM (SELECT *, row_number() OVER (PARTITION BY zip, {parts} ORDER BY t + d, r, y_ord) AS k FROM {p}_late WHERE t IS NOT NULL) q WHERE k = 1),
      {p}_found AS (SELECT * FROM {p}_first UNION ALL SELECT * FROM {p}_second)"""


def numbers(x: str, y: str, by: list[str], p: str = "n") -> str:
    """CTEs up to ``{p}_found`` (``x_id, y_ord``): the same number as text, else the nearest one edit away."""
    text = "lower(trim(regexp_replace(concat_ws('', nullif(number_prefix, ''), nullif(number_digits, ''), nullif(number_suffix, '')), ' +', ' ', 'g')))"
    keys = ", ".join(by)
    on = " AND ".join(f"a.{c} = b.{c}" for c in by)
    return f"""{p}_x AS (SELECT x_id, {keys}, {text} AS t, CAST(number_digits AS INT) AS n FROM {x} WHERE number_digits <> ''),
      {p}_y AS (SELECT {keys}, t, min(y_ord) AS y_ord, arg_min(n, y_ord) AS n FROM (SELECT y_ord, {keys}, {text} AS t, CAST(number_digits AS INT) AS n FROM {y} WHERE number_digits <> '') q GROUP BY {keys}, t),
      {p}_hits AS (SELECT a.x_id, b.y_ord, 0 AS far, 0 AS gap FROM {p}_x a JOIN {p}_y b ON {on} AND a.t = b.t UNION ALL SELECT a.x_id, b.y_ord, 1, abs(a.n - b.n) FROM {p}_x a JOIN {p}_y b ON {on} AND a.t <> b.t AND abs(length(a.t) - length(b.t)) <= 1 AND damerau_levenshtein(a.t, b.t) = 1),
      {p}_found AS (SELECT x_id, y_ord FROM (SELECT *, row_number() OVER (PARTITION BY x_id ORDER BY far, gap, y_ord) AS k FROM {p}_hits) q WHERE k = 1)"""


def staged(x: str, y: str, choices: str) -> str:
    """CTEs up to ``m`` (``x_id``, twelve fields, ``y_ord``) for ``x`` (``x_id`` and twelve fields, none NULL), the
    reference ``y`` (``y_ord`` too, one row for each text) and ``choices`` (``source_zip, zip``)."""
    parts = ", ".join(STREET)
    pool = f"m_y AS (SELECT y_ord, place_zipcode AS zip, {parts}, {', '.join(NUMBER)} FROM {y}), m_x AS (SELECT x_id, c.zip, {parts}, {', '.join(NUMBER)} FROM {x} JOIN {choices} c ON c.source_zip = place_zipcode)"
    same = " AND ".join(f"f.{c} = a.{c}" for c in ("zip", *STREET))
    street = ", ".join(f"y.{c} AS s_{c}" for c in STREET)
    keys = ["zip", *(f"s_{c}" for c in STREET)]
    at = f"m_at AS (SELECT a.x_id, a.zip, {street}, {', '.join('a.' + c for c in NUMBER)} FROM m_x a JOIN s_found f ON {same} JOIN {y} y ON y.y_ord = f.y_ord), m_pool AS (SELECT y_ord, zip, {', '.join(f'{c} AS s_{c}' for c in STREET)}, {', '.join(NUMBER)} FROM m_y)"
    out = ", ".join(f"coalesce(r.{c}, {'t.s_' + c if c in STREET else 'a.zip' if c == 'place_zipcode' else 'NULL'}) AS {c}" for c in FLAT)
    return f"{pool}, {NEIGHBORS}, {streets('m_x', 'm_y', phonetic=2, fuzzy=1)}, {at}, {numbers('m_at', 'm_pool', keys)}, m AS (SELECT x.x_id, {out}, n.y_ord FROM {x} x LEFT JOIN m_x a ON a.x_id = x.x_id LEFT JOIN m_at t ON t.x_id = x.x_id LEFT JOIN n_found n ON n.x_id = x.x_id LEFT JOIN {y} r ON r.y_ord = n.y_ord)"


STAGE = "CASE WHEN number_digits IS NOT NULL THEN 'number' WHEN street_name IS NOT NULL THEN 'street' WHEN place_zipcode IS NOT NULL THEN 'zip' ELSE 'none' END"
