"""Texts of varying length packed into containers of fixed capacity.

Sizes are whole numbers up to the capacity, so an instance is known by how many
items it has of each size: a table no longer than the capacity, however many
documents there are. The packing is worked out on that table, by patterns used
many times over, and then carried to the documents by their rank among items
of equal size; ranks come from counts and are never taken over a whole size at
once.

First the dominance reduction of Martello and Toth: the largest size is fixed
with a partner for good where no other filling can be better. What remains is
filled best-fit, largest size first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm.tokens import VOCABULARY, with_tokens
from cairn.session import materialize, require


class _Counts:
    """Multiset of sizes with quick search for the largest size up to a limit."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 2, dtype=np.int64)
        for s, c in counts.items():
            self.n[s] = c

    def below(self, limit: int) -> int:
        """The largest size present that is at most ``limit``; 0 if none."""
        if limit < 1:
            return 0
        at = np.flatnonzero(self.n[1 : limit + 1])
        return int(at[-1]) + 1 if len(at) else 0

    def smallest(self, k: int) -> list[int]:
        """The k smallest items (sizes with repetition)."""
        out: list[int] = []
        for s in np.flatnonzero(self.n[: len(self.n)]):
            out += [int(s)] * int(min(self.n[s], k - len(out)))
            if len(out) == k:
                break
        return out


def _best_pair(c: _Counts, room: int) -> int:
    """The largest sum of two items that fits into ``room``; 0 if no two fit."""
    best = 0
    for s in np.flatnonzero(c.n[1 : room + 1]) + 1:
        t = c.below(min(int(s), room - int(s)))
        if t == s and c.n[s] < 2:
            t = c.below(int(s) - 1)
        if t:
            best = max(best, int(s) + t)
    return best


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[list[int], int]], dict[int, int]]:
    """(fixed patterns with multiplicity, remaining counts).

    For the largest size w with room r = capacity - w the container is fixed
    * alone, if nothing fits beside w;
    * with the largest fitting item k, if k fills the room exactly, or no two
      items fit into the room, or no two fitting items are together larger
      than k, and no three items fit.
    In each case any optimal packing can be changed into one that has this
    container, so nothing is lost. Sizes for which that cannot be shown are
    passed over, down to half the capacity; passes end when one fixes nothing.
    """
    c = _Counts(counts, capacity)
    fixed: list[tuple[list[int], int]] = []
    changed = True
    while changed:
        changed = False
        for w in (np.flatnonzero(c.n)[::-1]).tolist():
            # beside the last item of a size w there may be no other w
            while c.n[w] > 0:
                room = capacity - w
                c.n[w] -= 1
                k = c.below(room)
                small = c.smallest(3)
                pair_fits = len(small) >= 2 and small[0] + small[1] <= room
                triple_fits = len(small) == 3 and sum(small) <= room
                sure = k == 0 or k == room or not pair_fits or (not triple_fits and _best_pair(c, room) <= k)
                c.n[w] += 1
                if not sure:
                    break
                if k == 0:
                    m, items = int(c.n[w]), [w]
                elif k == w:
                    m, items = int(c.n[w]) // 2, [w, w]
                else:
                    # taking items away makes none of the conditions false
                    m, items = int(min(c.n[w], c.n[k])), [w, k]
                for s in items:
                    c.n[s] -= m
                fixed.append((items, m))
                changed = True
            if w <= capacity // 2 and not changed:
                break
    return fixed, {int(s): int(c.n[s]) for s in np.flatnonzero(c.n)}


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns, each with its multiplicity: the items, largest first, each go
    into the open container with the least sufficient room, or a new one.

    Items of one size that follow each other fill one container after another,
    so they are dealt to all containers of a pattern at once, and a size adds at
    most two patterns."""
    rooms: list[list[tuple[list[int], int]]] = [[] for _ in range(capacity + 1)]  # open patterns by room left
    for s in sorted((s for s, n in counts.items() if n > 0), reverse=True):
        n, room = counts[s], s
        while n > 0:
            while room <= capacity and not rooms[room]:
                room += 1
            if room > capacity:
                # none has room: a new pattern
                rooms[capacity].append(([], -(-n // (capacity // s))))
                room = capacity
            items, m = rooms[room].pop()
            k = min(room // s, n)
            full = min(m, n // k)
            n -= k * full
            rooms[room - k * s].append((items + [s] * k, full))
            if m > full:
                rooms[room].append((items, m - full))
    return [p for open_ in rooms for p in open_]


def plan_containers(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    fixed, rest = reduce_instance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def rank_within(df: DataFrame, key: str, order: list[str], out: str, chunk: int = 100_000) -> DataFrame:
    """Adds the 0-based rank of a row within ``key``, in a fixed but arbitrary
    order. A key with many rows is ranked in chunks by hash, whose offsets come
    from counts, so no task sees a whole hot key."""
    sizes = df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).cast("int").alias("__parts"))
    parted = df.join(sizes, key).withColumn("__part", F.pmod(F.xxhash64(*order), "__parts")).drop("__parts")
    counts = parted.groupBy(key, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    local = F.row_number().over(Window.partitionBy(key, "__part").orderBy(*order)) - 1
    return parted.withColumn("__local", local).join(offsets, [key, "__part"]).withColumn(out, F.col("__offset") + F.col("__local")).drop("__part", "__local", "__offset")


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """``container_id, doc_id, piece, n_tokens`` for ``items`` of ``doc_id, n_tokens``.

    Every item with a positive size stands in exactly one container, except
    that one larger than the capacity is split into pieces of the capacity and
    a rest (``piece`` counts from 0). Items without size (0, negative or NULL)
    are left out. Repeated rows are items of their own; ties in size are broken
    by document number and hash. An empty table gives an empty result; extra
    columns are ignored. ``capacity`` must be positive.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    require(items, "doc_id", "n_tokens")
    sized = items.where("n_tokens > 0").select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"))
    sized = sized.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "n_tokens").orderBy("doc_id")))
    whole = F.expr(f"cast((n_tokens - 1) div {capacity} as int)")
    pieces = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), whole)))
    pieces = pieces.select("doc_id", "copy", "piece", F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - F.col("piece").cast("long") * capacity).alias("size"))
    pieces = materialize(pieces, "pieces")
    # at most ``capacity`` rows
    counts = {int(r["size"]): int(r["n"]) for r in pieces.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    patterns = plan_containers(counts, capacity)
    slots: dict[int, list[tuple[int, int, int]]] = {}  # size -> (first rank, items a container, first container)
    taken: dict[int, int] = {}
    base = 0
    for sizes, m in patterns:
        for s, u in sorted({s: sizes.count(s) for s in sizes}.items()):
            slots.setdefault(s, []).append((taken.get(s, 0), u, base))
            taken[s] = taken.get(s, 0) + u * m
        base += m
    tables = {s: tuple(np.array(v) for v in zip(*rows)) for s, rows in slots.items()}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size, rank = b["size"].to_numpy(), b["rank"].to_numpy()
            container = np.zeros(len(b), dtype=np.int64)
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                first, uses, start = tables[int(s)]
                i = np.searchsorted(first, rank[at], side="right") - 1
                container[at] = start[i] + (rank[at] - first[i]) // uses[i]
            yield pd.DataFrame({"container_id": container, "doc_id": b["doc_id"], "piece": b["piece"], "n_tokens": size})

    ranked = rank_within(pieces, "size", ["doc_id", "piece", "copy"], "rank")
    kind = dict(items.dtypes)["doc_id"]
    return ranked.select("size", "rank", "doc_id", "piece").mapInPandas(place, f"container_id long, doc_id {kind}, piece int, n_tokens long")


def pack_documents(documents: DataFrame, capacity: int = 2048, vocabulary: str = VOCABULARY) -> DataFrame:
    """Documents packed by the tokens of their text; NULL and empty texts have none."""
    return pack(with_tokens(documents, "text", vocabulary=vocabulary, keep=["doc_id"]), capacity)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, the least number of containers conceivable, and the share of space filled."""
    total = packed.agg(F.count_distinct("container_id").alias("n_containers"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))
    return total.select("n_containers", "n_tokens", F.ceil(F.col("n_tokens") / capacity).cast("long").alias("least_containers"), F.when(F.col("n_containers") > 0, F.col("n_tokens") / (F.col("n_containers") * capacity)).alias("filled"))
