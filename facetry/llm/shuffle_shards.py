"""Sharding by a two-pass external shuffle.

Pass 1 scatters records uniformly into buckets by a seeded hash of id, text and the
record's number among equal records where these hold more than a part (``SHARE``) of a
bucket's bytes, so that neither an id nor a record that repeats without bound meets in
one bucket; the number of buckets follows the bytes, so a bucket
fits in a task's memory (with its longest text, which isn't cut). Pass 2 sorts a
bucket canonically, shuffles it by Fisher-Yates with a generator seeded by
(seed, bucket), and writes it. A record's place in the whole order is its
bucket's offset plus its place in the bucket; place p goes to shard p mod n,
slot p div n, so shard counts differ by one at most and slots have no gap.

A bucket's offset is the sum of the counts before it, a window over one row a bucket
(six million at 100 TB) in one task.

Edge cases: an empty table gives an empty result; a null text has no bytes; rows
without an id scatter by text and number; repeated rows are kept, each with its own
place (equal rows may swap places, which the result can't show). Extra columns
are carried along; columns named ``shard`` and ``slot`` give way to the new ones.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_type, number_repeats, shuffle_partitions

#: Text bytes of a bucket that a task holds while it shuffles.
BUCKET_BYTES = 16 << 20
#: Equal records of more than a bucket's bytes divided by this are scattered one by one.
SHARE = 8
#: Offsets (three numbers a bucket) are broadcast up to so many buckets.
BROADCAST_BUCKETS = 1 << 20
SHARDS = 8
SEED = 20240607


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A permutation of 0..n-1: each i from the end swaps with a j <= i."""
    generator = np.random.Generator(np.random.PCG64([seed, bucket]))
    order = list(range(n))
    picks = generator.integers(0, np.arange(n, 0, -1)).tolist() if n else []
    for i, j in zip(range(n - 1, 0, -1), picks, strict=False):
        order[i], order[j] = order[j], order[i]
    return np.array(order, dtype=np.int64)


def scatter_hash(key: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")), "__text", "__nth")


def shuffle_into_shards(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """``docs`` with ``shard`` (int, from 0) and ``slot`` (long, from 0 in each shard)."""
    docs = docs.drop("shard", "slot")
    spark = docs.sparkSession
    hashed = F.col("__order")
    total = docs.agg(F.sum(F.octet_length(text) + F.lit(64))).first()[0] or 0
    buckets = max(-(-total // bucket_bytes), shuffle_partitions(spark))
    bucket = F.pmod(hashed, F.lit(buckets)).alias("__bucket")
    # the record travels as one column, so that no name of its own can clash
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    packed = docs.select(row.alias("__row"), F.col(f"`{key}`").alias("__id"), F.xxhash64(F.col(f"`{text}`")).alias("__text"))
    packed = packed.withColumn("__bytes", F.coalesce(F.octet_length(F.col("__row").getField(text)), F.lit(0)) + 64)
    marked = number_repeats(packed, ["__id", "__text"], F.sum("__bytes") > bucket_bytes // SHARE).select("__row", scatter_hash("__id", seed).alias("__order"))
    offsets = marked.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))
    running = F.sum("n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = offsets.select("__bucket", F.coalesce(running, F.lit(0)).alias("__offset"))
    if buckets <= BROADCAST_BUCKETS:
        offsets = F.broadcast(offsets)
    placed = marked.select("__row", bucket, "__order").join(offsets, "__bucket")
    schema = T.StructType([*docs.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    out = arrow_type(schema)
    names = docs.columns

    def shuffled(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        columns = dict(zip(names, pa.chunked_array(group["__row"]).combine_chunks().flatten()))
        # canonical order first, so that the result doesn't depend on how rows arrived
        sorting = pa.table([group["__order"], columns[key], columns[text]], names=["order", "key", "text"])
        canonical = pc.sort_indices(sorting, [("order", "ascending"), ("key", "ascending"), ("text", "ascending")])
        at = int(group["__bucket"][0].as_py())
        place = int(group["__offset"][0].as_py()) + np.arange(group.num_rows)
        order = canonical.take(pa.array(fisher_yates(group.num_rows, seed, at)))
        made = [columns[n].take(order).cast(out.field(n).type) for n in names]
        return pa.table([*made, pa.array((place % shards).astype(np.int32)), pa.array(place // shards)], schema=out)

    return placed.groupBy("__bucket").applyInArrow(shuffled, schema)


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write each bucket where it was shuffled: one folder a shard, whose files hold runs of
    slots in order and no slot twice."""
    shuffle_into_shards(docs, **options).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_digest(docs: DataFrame) -> DataFrame:
    """Contract of op3: law ``rows``."""
    placed = shuffle_into_shards(docs.select("doc_id", "text"))
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return placed.select(
        "doc_id",
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


