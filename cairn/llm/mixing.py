"""Records of several sources mixed to target shares of the total size.

A source contributes complete epochs first, every record once more each time,
and then a fraction of an epoch. The fraction is a weighted sample without
replacement (Efraimidis and Spirakis): each record draws an exponential key with
its quality as rate, and the records with the least keys are taken until the
budget is used up. The prefix sums are taken over buckets of keys; only the
bucket in which the budget ends is sorted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm.tokens import VOCABULARY, n_tokens
from cairn.session import broadcast_if_small, materialize, require

_WORD = re.compile(r"\w+")


def quality(text: str | None) -> float:
    """A weight in [0.05, 1]: texts with words, little repetition and few marks score high."""
    if not text:
        return 0.05
    words = _WORD.findall(text.lower())
    letters = sum(ch.isalpha() or ch.isspace() for ch in text) / len(text)
    variety = len(set(words)) / len(words) if words else 0.0
    return max(0.05, min(1.0, letters * (0.3 + 0.7 * min(1.0, variety * 1.6)) * min(1.0, 0.3 + len(words) / 40)))


def measured(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, source, n_tokens, weight`` of documents, from their whole texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["doc_id", "source"]].assign(n_tokens=[n_tokens(t, vocabulary) for t in b["text"]], weight=[quality(t) for t in b["text"]])

    kinds = dict(documents.dtypes)
    return documents.select("doc_id", "source", "text").mapInPandas(run, f"doc_id {kinds['doc_id']}, source {kinds['source']}, n_tokens long, weight double")


def exponential_key(weight: str, *ids: str, seed: int = 1) -> Column:
    """-ln(u) / weight with u drawn from the identifier, so that it can be repeated."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *ids), 11).cast("double") + 0.5) / float(2**53)
    return -F.log(u) / F.col(weight)


def mix(records: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 1, bucket_rows: int = 50_000) -> DataFrame:
    """``doc_id, source, repeats, n_tokens``: how often each record is used.

    ``records`` has ``doc_id, source, n_tokens, weight``; ``targets`` has
    ``source, target_share, max_repeat``. ``total`` is the size of the mixture;
    by default the largest for which every source still reaches its share. A
    source that cannot reach its share of a larger total is used ``max_repeat``
    times, which the report shows. A source without records, or never to be
    used, limits nothing: the report shows that it gave nothing, and the others
    keep their proportions.

    Records without a listed source, without size, or never used do not come
    out. A weight that is NULL or not positive counts as 0.05. Repeated rows are
    records of their own; ties in the key go by ``doc_id``. A source listed
    twice raises ``ValueError``, as does a negative share; shares are scaled to
    the sum of 1. Without records or targets the result is empty. The fraction
    of an epoch ends at the record that brings the size nearest to the budget.
    """
    require(records, "doc_id", "source", "n_tokens", "weight")
    require(targets, "source", "target_share", "max_repeat")
    # the targets are a short configuration table
    rows = targets.where("source is not null").collect()
    wanted = {r["source"]: (float(r["target_share"] or 0.0), max(0, int(r["max_repeat"] or 0))) for r in rows}
    if len(wanted) < len(rows):
        raise ValueError("a source is listed twice")
    if any(s < 0 for s, _ in wanted.values()):
        raise ValueError("shares must not be negative")
    known = records.where("n_tokens > 0").join(targets.select("source"), "source", "left_semi").select("doc_id", "source", F.col("n_tokens").cast("long").alias("n_tokens"), F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.05).alias("weight"))
    known = materialize(known.withColumn("key", exponential_key("weight", "doc_id", "source", seed=seed)), "keys")
    have = {r["source"]: (int(r["size"]), int(r["n"]), float(r["rate"])) for r in known.groupBy("source").agg(F.sum("n_tokens").alias("size"), F.count(F.lit(1)).alias("n"), F.avg("weight").alias("rate")).collect()}
    scale = sum(s for s, _ in wanted.values())
    shares = {s: share / scale for s, (share, _) in wanted.items() if share > 0} if scale > 0 else {}
    reach = [most / share for s, share in shares.items() if (most := wanted[s][1] * have.get(s, (0,))[0]) > 0]
    budget = float(total) if total is not None else min(reach, default=0.0)
    parts = []
    for s, (size, n, rate) in have.items():
        want = min(shares.get(s, 0.0) * budget, float(wanted[s][1] * size))
        epochs = min(int(want // size), wanted[s][1])
        parts.append((s, epochs, want - epochs * size if epochs < wanted[s][1] else 0.0, max(1, -(-n // bucket_rows)), rate))
    spark = records.sparkSession
    budgets = spark.createDataFrame(parts, "source string, epochs int, rest double, buckets int, rate double")
    # 1 - exp(-rate * key) rises with the key and is about even over (0, 1)
    spread = known.join(F.broadcast(budgets), "source")  # one row for each listed source
    spread = spread.withColumn("bucket", F.least(F.floor((1 - F.exp(-F.col("rate") * F.col("key"))) * F.col("buckets")), F.col("buckets") - 1).cast("int"))
    sums = spread.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each ``bucket_rows`` records
    spread = spread.join(broadcast_if_small(materialize(sums.withColumn("before", before), "before")), ["source", "bucket"])
    inside, out = F.col("before") + F.col("size") <= F.col("rest"), F.col("before") >= F.col("rest")
    sure = spread.where(inside | out).select("doc_id", "source", "n_tokens", (F.col("epochs") + F.when(inside, 1).otherwise(0)).alias("repeats"))
    upto = F.sum("n_tokens").over(Window.partitionBy("source", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    edge = spread.where(~(inside | out)).withColumn("first", F.col("before") + F.coalesce(upto, F.lit(0)))
    edge = edge.select("doc_id", "source", "n_tokens", (F.col("epochs") + F.when(F.col("first") + F.col("n_tokens") / 2 <= F.col("rest"), 1).otherwise(0)).alias("repeats"))
    return sure.unionByName(edge).where("repeats > 0").select("doc_id", "source", F.col("repeats").cast("int").alias("repeats"), "n_tokens")


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target: ``source, target_share, actual_share, n_tokens,
    n_records, most_repeats``. A source that gave nothing has zeros."""
    used = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("n_tokens"), F.count(F.lit(1)).alias("n_records"), F.max("repeats").alias("most_repeats"))
    joined = targets.select("source", "target_share").join(used, "source", "left").na.fill(0, ["n_tokens", "n_records", "most_repeats"])
    total = F.sum("n_tokens").over(Window.partitionBy())  # one row for each listed source
    return joined.select("source", "target_share", F.when(total > 0, F.col("n_tokens") / total).otherwise(0.0).alias("actual_share"), "n_tokens", "n_records", "most_repeats")
