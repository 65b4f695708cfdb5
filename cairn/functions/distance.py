"""Edit distances as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def osa_sql(a: str, b: str) -> str:
    """SQL text of the optimal string alignment distance of two expressions:
    unit costs, and exchanging two neighbouring characters costs one.

    Two rolling rows of the alignment matrix are folded over the characters;
    each argument is bound once, through a lambda.
    """
    body = """CASE WHEN p.a = '' THEN length(p.b) WHEN p.b = '' THEN length(p.a) ELSE
      aggregate(sequence(1, length(p.a)), named_struct('before', array(0), 'last', sequence(0, length(p.b))),
        (s, i) -> named_struct('before', s.last, 'last', aggregate(sequence(1, length(p.b)), array(i),
          (r, j) -> array_append(r, least(get(s.last, j) + 1, get(r, j - 1) + 1,
            get(s.last, j - 1) + if(substr(p.a, i, 1) = substr(p.b, j, 1), 0, 1),
            if(i > 1 AND j > 1 AND substr(p.a, i, 1) = substr(p.b, j - 1, 1) AND substr(p.a, i - 1, 1) = substr(p.b, j, 1), get(s.before, j - 2) + 1, 1000000))))),
        s -> get(s.last, length(p.b))) END"""
    return f"element_at(transform(array(named_struct('a', {a}, 'b', {b})), p -> {body}), 1)"


def osa(a: str, b: str) -> Column:
    """Distance of two columns (by name); NULL if either is NULL."""
    return F.when(F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull(), F.expr(osa_sql(f"`{a}`", f"`{b}`")))


def osa_up_to(a: str, b: str, k: int) -> Column:
    """Distance of two columns if it is at most ``k``, else NULL.

    The built-in Levenshtein distance, never more than twice the other, decides
    nearly all pairs. It differs only where neighbours are exchanged: a distance
    of 2 can be 1 only if both texts have the same letters. The fold runs over
    what is left.
    """
    x, y = F.col(f"`{a}`"), F.col(f"`{b}`")
    if k < 1:
        return F.when(x == y, 0)
    near = F.levenshtein(x, y, 2 * k)
    letters = lambda c: F.sort_array(F.split(c, ""))
    same = letters(x) == letters(y)
    out = F.when(near < 0, F.lit(None).cast("int")).when(near <= 1, near)
    # with t exchanges and e other edits: distance t + e, near at most 2t + e, and the letters differ by e at most
    out = out.when((near == 2) & ~same, F.lit(2 if k >= 2 else None).cast("int")).when((near == 2 * k) & ~same, F.lit(None).cast("int"))
    full = osa(a, b)
    return out.otherwise(F.when(full <= k, full))
