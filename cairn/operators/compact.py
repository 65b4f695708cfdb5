"""Consolidation of very many small files into few well-sized ones.

The steps: (1) keep one row of each group of rows that are equal outside the
identifying columns; (2) assign the files, longest first, to a fixed number of
output groups with a heap of the least loaded group; (3) stream every group
through a Parquet writer; (4) verify what was written against what was planned
and publish a manifest by one atomic rename. Readers use only files named in
the manifest, so files of lost or repeated tasks are never seen.
"""

from __future__ import annotations

import heapq
import json
import math
import os
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.session import broadcast_if_small, materialize, require, shared_path

_MANIFEST = "out_group long, path string, n_rows long, n_bytes long, check decimal(38,0)"


def longest_first(sizes: Sequence[int], groups: int) -> list[int]:
    """The group of each item: items in falling order of size, each to the
    group with the least load so far (lowest number on ties)."""
    heap = [(0, g) for g in range(groups)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, g = heap[0]
        heapq.heapreplace(heap, (load + sizes[i], g))
        out[i] = g
    return out


def assign_files(files: DataFrame, target_bytes: int, shard_files: int = 50_000) -> DataFrame:
    """``file_id, out_group`` for a table of ``file_id, shard_key, n_bytes``.

    Files are scheduled in shards of files with equal ``shard_key``, so that no
    task, nor the driver, ever holds the list of all files: a key with more than
    about ``shard_files`` files is split by a hash of the file, and keys that
    hold less than ``target_bytes`` share shards. Each shard has
    ``ceil(bytes / target_bytes)`` groups of its own.
    """
    files = files.select("file_id", F.coalesce("n_bytes", F.lit(0)).cast("long").alias("n_bytes"), F.coalesce("shard_key", F.lit("")).alias("shard_key"))
    keys = materialize(files.groupBy("shard_key").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_bytes").alias("key_bytes")).withColumn("small", F.col("key_bytes") < target_bytes), "keys")
    # two numbers: shards for the small keys, of about eight output files or shard_files input files each
    few = keys.where("small").agg(F.coalesce(F.sum("n_files"), F.lit(0)), F.coalesce(F.sum("key_bytes"), F.lit(0))).first()
    mixed = max(1, -(-int(few[0]) // shard_files), -(-int(few[1]) // (8 * target_bytes)))
    # the small keys are one shard after another of their own name, so that the hash cannot be one of a key
    shard = F.when(F.col("small"), F.struct(F.lit(None).cast("string").alias("key"), F.pmod(F.xxhash64("shard_key"), F.lit(mixed)).alias("part"))).otherwise(F.struct(F.col("shard_key").alias("key"), F.pmod(F.xxhash64("file_id"), F.ceil(F.col("n_files") / F.lit(shard_files))).alias("part")))
    sharded = files.join(keys, "shard_key").select("file_id", "n_bytes", shard.alias("s")).select("file_id", "n_bytes", "s.key", "s.part")

    def schedule(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["n_bytes", "file_id"], ascending=[False, True], kind="stable")
        groups = max(1, math.ceil(int(shard["n_bytes"].sum()) / target_bytes))
        return pd.DataFrame({"file_id": shard["file_id"], "key": shard["key"], "part": shard["part"], "slot": longest_first(shard["n_bytes"].tolist(), groups)})

    planned = sharded.groupBy("key", "part").applyInPandas(schedule, f"file_id {dict(files.dtypes)['file_id']}, key string, part long, slot long")
    return planned.select("file_id", F.xxhash64(F.coalesce("key", F.lit("small keys")), F.col("key").isNull(), "part", "slot").alias("out_group"))


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri))


def _writer(folder: str, schema: pa.Schema):
    """A function for mapInArrow: rows arrive sorted by group; one file for each group."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _filesystem(folder)
        group, sink, path, rows, total = None, None, "", 0, 0
        out = pa.schema([("out_group", pa.int64()), ("path", pa.string()), ("n_rows", pa.int64()), ("n_bytes", pa.int64()), ("check", pa.decimal128(38, 0))])

        def close() -> pa.RecordBatch:
            sink.close()
            return pa.RecordBatch.from_pydict({"out_group": [group], "path": [path], "n_rows": [rows], "n_bytes": [store.get_file_info(f"{base}/{path}").size], "check": [total]}, schema=out)

        try:
            for batch in batches:
                groups = batch.column("__group").to_numpy(zero_copy_only=False)
                checks = batch.column("__check").to_pylist()
                cuts = [0, *(i for i in range(1, len(groups)) if groups[i] != groups[i - 1]), len(groups)]
                data = batch.select(schema.names).cast(schema)
                for a, b in zip(cuts, cuts[1:]):
                    if a == b:
                        continue
                    if sink is None or groups[a] != group:
                        if sink is not None:
                            yield close()
                        group, rows, total = int(groups[a]), 0, 0
                        path = f"part-{uuid.uuid4().hex}.parquet"
                        sink = pq.ParquetWriter(f"{base}/{path}", schema, filesystem=store, compression="snappy")
                    sink.write_batch(data.slice(a, b - a))
                    rows += b - a
                    total += sum(checks[a:b])
            if sink is not None:
                yield close()
                sink = None
        finally:
            if sink is not None:
                sink.close()

    return write


LOOSE_BYTES = 100  # what a row weighs whose file the inventory does not list


def compact(rows: DataFrame, files: DataFrame, out: str, id_col: str, file_col: str, shard_col: str, ignore: Sequence[str] = (), target_bytes: int = 128 << 20, shard_files: int = 50_000) -> DataFrame:
    """Writes each distinct row of ``rows`` once to well-sized files under ``out``.

    ``rows`` is the content of the files, ``file_col`` names the file of a row;
    ``files`` is the inventory (``file_col, n_bytes``). Two rows are the same if
    they agree in all columns other than ``id_col``, ``file_col`` and ``ignore``
    (NULL equals NULL); the one with the smallest ``id_col`` is kept, with the
    smallest file on ties. Files stay whole, except for what deduplication
    takes out; files of one ``shard_col`` value share output groups, those of
    values with little content also with one another.

    Rows whose file is missing from the inventory (or NULL) are kept and weigh
    ``LOOSE_BYTES`` each; those without file are spread over as many groups as
    that makes. Empty files vanish; an inventory that lists a file twice counts
    its largest entry. An empty table gives an empty manifest. Any extra column
    is carried along. Returns the manifest, ``out_group, path, n_rows, n_bytes,
    check``.

    Duplicates are found from digests. Where the lists of repeated contents and
    of files are short enough to be broadcast, which is counted, content is
    shuffled once only, to its output group. What was
    planned, what was streamed to the files, and what is read back from them
    must agree in rows and in the sum of their hashes, else ``RuntimeError``
    and nothing is published.
    """
    spark = rows.sparkSession
    require(rows, id_col, file_col, shard_col)
    require(files, file_col, "n_bytes")
    # a digest stands for the content; 128 bits leave no room for chance
    content = [c for c in rows.columns if c not in {id_col, file_col, *ignore}]
    whole = F.to_json(F.struct(*(F.col(f"`{c}`") for c in content)), {"ignoreNullFields": "false"})
    digest = F.unhex(F.md5(whole))
    digested = rows.withColumn("__digest", digest)
    small = digested.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{file_col}`").alias("file_id"), F.col(f"`{shard_col}`").cast("string").alias("shard_key"), F.col("__digest").alias("digest"))
    kept = small.groupBy("digest").agg(F.min(F.struct("id", "file_id", "shard_key")).alias("k"), F.count(F.lit(1)).alias("copies")).select("k.*", "copies", "digest")
    kept = materialize(kept, "kept")
    known = files.groupBy(F.col(f"`{file_col}`").alias("file_id")).agg(F.max("n_bytes").alias("known_bytes"))
    used = kept.groupBy("file_id").agg(F.min("shard_key").alias("shard_key"), F.count(F.lit(1)).alias("n"))
    sized = used.where("file_id is not null").join(known, "file_id", "left").select("file_id", "shard_key", F.coalesce("known_bytes", F.col("n") * LOOSE_BYTES).alias("n_bytes"))
    groups = broadcast_if_small(materialize(assign_files(sized, target_bytes, shard_files), "groups"))
    loose_parts = max(1, -(-kept.where("file_id is null").count() * LOOSE_BYTES // target_bytes))

    placed = groups.select(F.col("file_id").alias("__file"), F.col("out_group").alias("__group"))

    def grouped(d: DataFrame, digest: str, file: str) -> DataFrame:
        loose = F.xxhash64(F.lit("no file"), F.pmod(F.xxhash64(digest), F.lit(loose_parts)))
        return d.join(placed, d[f"`{file}`"] == F.col("__file"), "left").withColumn("__group", F.coalesce("__group", loose)).drop("__file")

    expected = materialize(grouped(kept, "digest", "file_id").groupBy(F.col("__group").alias("out_group")).agg(F.count(F.lit(1)).alias("expected"), F.sum(_check(F.col("digest"))).alias("sum")), "expected")
    # rows that are alone in their content pass; of the others those that are kept, exact repetitions once
    several = broadcast_if_small(materialize(kept.where("copies > 1").select(F.col("digest").alias("__digest"), F.col("id").alias("__id"), F.col("file_id").alias("__keep")), "several"))
    alone = digested.join(several.select("__digest"), "__digest", "left_anti")
    chosen = digested.join(several, "__digest").where(F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & F.col(f"`{file_col}`").eqNullSafe(F.col("__keep"))).drop("__id", "__keep").dropDuplicates(["__digest"])
    tagged = grouped(alone.unionByName(chosen), "__digest", file_col).withColumn("__check", _check(F.col("__digest")))
    schema = _arrow_schema(rows)
    uri = out if "://" in out else "file://" + os.path.abspath(out)
    store, base = _filesystem(uri)
    store.create_dir(base, recursive=True)
    lanes = max(1, min(expected.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    written = tagged.drop("__digest").repartition(lanes, "__group").sortWithinPartitions("__group", F.col(f"`{id_col}`")).mapInArrow(_writer(uri, schema), _MANIFEST)
    manifest = materialize(written, "manifest")
    wrong = manifest.groupBy("out_group").agg(F.sum("n_rows").alias("n"), F.sum("check").alias("streamed"), F.count(F.lit(1)).alias("files")).join(expected, "out_group", "full").where("n is null or expected is null or n <> expected or streamed <> sum or files <> 1")
    if wrong.take(1):
        raise RuntimeError("the written groups do not hold the planned rows")
    if manifest.take(1):
        _read_back(spark.read.schema(rows.schema), uri, manifest, digest)
    publish(manifest, uri)
    return manifest


def _check(digest: Column) -> Column:
    """A number from a digest, of which sums are compared."""
    return F.conv(F.hex(F.substring(digest, 1, 7)), 16, 10).cast("decimal(38,0)")


def _read_back(reader, uri: str, manifest: DataFrame, digest) -> None:
    """Compares what the files hold with what was streamed to them."""
    held = reader.parquet(f"{uri}/part-*.parquet").select(F.regexp_extract(F.input_file_name(), "[^/]+$", 0).alias("path"), _check(digest).alias("c"))
    held = held.groupBy("path").agg(F.count(F.lit(1)).alias("held"), F.sum("c").alias("sum"))
    # a lost or repeated task may have left files that the manifest does not name
    if manifest.join(held, "path", "left").where("held is null or held <> n_rows or sum <> check").take(1):
        raise RuntimeError("the files do not hold what was written to them")


def _arrow_schema(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)


def publish(manifest: DataFrame, out: str) -> None:
    """Writes the manifest beside the files by one rename."""
    store, base = _filesystem(out)
    with store.open_output_stream(f"{base}/_manifest.tmp") as f:
        for row in manifest.orderBy("path").toLocalIterator():
            f.write((json.dumps({k: str(v) if k == "check" else v for k, v in row.asDict().items()}) + "\n").encode())
    store.move(f"{base}/_manifest.tmp", f"{base}/_manifest.jsonl")


def read_compacted(spark: SparkSession, out: str, verify: bool = True) -> DataFrame:
    """The rows of the files that the published manifest names.

    With ``verify`` every listed file must still have its published size.
    """
    store, base = _filesystem(out)
    with store.open_input_stream(f"{base}/_manifest.jsonl") as f:
        listed = [json.loads(x) for x in f.read().decode().splitlines()]
    if verify:
        sizes = {i.path.rsplit("/", 1)[-1]: i.size for i in store.get_file_info(fs.FileSelector(base))}
        bad = [x["path"] for x in listed if sizes.get(x["path"]) != x["n_bytes"]]
        if bad:
            raise RuntimeError(f"{len(bad)} published files are missing or changed, such as {bad[0]}")
    root = out if "://" in out else "file://" + os.path.abspath(out)
    return spark.read.parquet(*(f"{root}/{x['path']}" for x in listed)) if listed else None


def compact_taf(spark: SparkSession, taf: DataFrame, taf_file: DataFrame) -> tuple[DataFrame, str]:
    """Consolidates the street ranges; returns the manifest and the folder."""
    out = shared_path(spark, "compacted")
    return compact(taf, taf_file, out, "taf_id", "file_id", "zip3"), out


def duplicate_ids(spark: SparkSession, taf: DataFrame, taf_file: DataFrame) -> DataFrame:
    """``taf_id`` of the rows that consolidation left out as repeated."""
    _, out = compact_taf(spark, taf, taf_file)
    kept = read_compacted(spark, out)
    return taf.select("taf_id").distinct() if kept is None else taf.select("taf_id").join(kept.select("taf_id"), "taf_id", "left_anti").distinct()
