"""Sharding by extendible hashing.

A document belongs to the bucket of its first d hash bits. Starting from the whole table, a bucket that exceeds
the byte limit is split on one more bit, and no other bucket is; the directory of buckets is computed from
sums over hash prefixes instead of splitting step by step. Keys that share all bits are dealt to numbered pages.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, table

#: Bytes of text that a shard may hold.
LIMIT = 1 << 20
HASH_BITS = 32
#: Bits by which the first look at prefixes goes beyond an even split.
EXTRA_BITS = 6
#: Bits of prefixes that are looked at together: a bucket of the directory is summed from 2^STEP rows at most.
STEP = 6
#: Bytes of text in a shard that is written, where nothing else is asked for: files far smaller than this cost more than they hold.
WRITTEN = 1 << 28


def hash_bits(column: str = "doc_id") -> Column:
    """The first 32 bits of the key's MD5, as a long from 0 on."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(column).cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def prefixes_within(leaves: DataFrame, low: int, bits: int, limit: int) -> DataFrame:
    """leaf, depth, bytes, n: for each leaf (a prefix of `bits` bits), the least depth from `low` on at which its bucket
    is within the limit. Only leaves that share `low` bits, 2^(bits - low) at most, meet anywhere. Leaves without such a depth are left out."""
    levels = leaves.select("leaf", "bytes", "n", F.explode(F.sequence(F.lit(low), F.lit(bits))).alias("depth"))
    levels = levels.withColumn("prefix", F.expr(f"shiftright(leaf, {bits} - depth)"))
    buckets = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).where(F.col("bytes") <= limit)
    return levels.select("leaf", "depth", "prefix").join(buckets, ["depth", "prefix"]).groupBy("leaf").agg(F.min(F.struct("depth", "bytes", "n")).alias("b")).select("leaf", "b.depth", "b.bytes", "b.n")


def directory(leaves: DataFrame, bits: int, limit: int) -> DataFrame:
    """leaf, depth, shard_bytes, shard_docs of each leaf (a prefix of `bits` bits, with bytes and n): the least depth
    at which its bucket is within the limit; depth is null where even the leaf exceeds it.

    Depths are looked at STEP bits at a time, from the leaves upward: what shares the first bits becomes one leaf of the
    next look, so no bucket gathers more than 2^STEP rows, the whole table's neither."""
    low = max(0, bits - STEP)
    own = prefixes_within(leaves, low, bits, limit)
    if low:
        stems = leaves.groupBy(F.shiftright("leaf", bits - low).alias("leaf")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        upper = directory(checkpoint(stems), low, limit).where("depth is not null").select(F.col("leaf").alias("stem"), *[F.col(c).alias(f"u_{c}") for c in ("depth", "shard_bytes", "shard_docs")])
        found = leaves.select("leaf").join(own, "leaf", "left").join(upper, F.shiftright("leaf", bits - low) == F.col("stem"), "left")
        return found.select("leaf", *[F.coalesce(f"u_{c}", d).alias(c) for c, d in (("depth", "depth"), ("shard_bytes", "bytes"), ("shard_docs", "n"))])
    return leaves.select("leaf").join(own, "leaf", "left").select("leaf", "depth", F.col("bytes").alias("shard_bytes"), F.col("n").alias("shard_docs"))


def label(bits: int) -> Column:
    """The bucket's bits as text; the bucket of depth 0 is the empty text."""
    return F.expr(f"substring(lpad(bin(leaf), {bits}, '0'), 1, depth)")


def assign(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, depth, shard, shard_bytes and shard_docs of every row of docs.

    Null ids hash like the empty text and null texts have 0 bytes. Rows that share all hash bits (repeated ids)
    and exceed the limit together are dealt to pages `bits#k`, each within the limit; a single text larger than
    the limit has a page of its own, the only shards that exceed it. An empty table gives an empty result.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), hash_bits().alias("h"))
    return placed(checkpoint(rows.withColumn("at", F.monotonically_increasing_id())), limit).drop("at")


def placed(rows: DataFrame, limit: int) -> DataFrame:
    """assign for rows of doc_id, n_bytes, h and at, a number of each row, which stays."""
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    bits = min(HASH_BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + EXTRA_BITS)
    out, todo = [], rows
    for level in dict.fromkeys((bits, HASH_BITS)):
        keyed = todo.withColumn("leaf", F.shiftright("h", HASH_BITS - level))
        leaves = checkpoint(keyed.groupBy("leaf").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n")))
        found = checkpoint(directory(leaves, level, limit) if todo is rows else directory(leaves, level, limit).where(f"depth is null or depth > {bits}"))
        joined = keyed.join(found, "leaf")
        out.append(joined.where("depth is not null").select("at", "doc_id", "n_bytes", "depth", label(level).alias("shard"), "shard_bytes", "shard_docs"))
        if not found.where("depth is null").head(1):
            break
        todo = joined.where("depth is null").select("at", "doc_id", "n_bytes", "h")
    else:
        out.append(pages(todo, limit))
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def pages(rows: DataFrame, limit: int) -> DataFrame:
    """Rows whose hash bits are all the same and too large together: small rows fill pages one after the other,
    rows of more than half the limit have a page each. A page takes the small rows whose running sum starts
    within one half of the limit, so it holds at most the limit."""
    rows = checkpoint(rows)
    rows = rows.withColumn("part", F.expr("shiftright(at, 20)")).withColumn("big", F.col("n_bytes") * 2 > limit)
    step = F.when(F.col("big"), F.lit(1)).otherwise(F.col("n_bytes"))
    rows = rows.withColumn("step", step)
    sums = rows.groupBy("h", "big", "part").agg(F.sum("step").alias("in_part"))
    up_to = Window.partitionBy("h", "big").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("in_part").over(up_to), F.lit(0))).drop("in_part")
    own = Window.partitionBy("h", "big", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("step").over(own), F.lit(0))).join(offsets, ["h", "big", "part"])
    half = max(1, limit // 2)
    page = F.when(F.col("big"), F.concat(F.lit("big"), F.col("before") + F.col("offset"))).otherwise(F.expr(f"string((before + offset) div {half})"))
    rows = rows.select("at", "doc_id", "n_bytes", F.lit(HASH_BITS).alias("depth"), F.concat(F.expr(f"lpad(bin(h), {HASH_BITS}, '0')"), F.lit("#"), page).alias("shard"))
    held = rows.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_docs"))
    return rows.join(held, "shard").select("at", "doc_id", "n_bytes", "depth", "shard", "shard_bytes", "shard_docs")


def shard_directory(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """shard, depth, shard_bytes, shard_docs: the directory that extendible hashing ends with, one row per bucket that holds a
    document. Buckets are named by their hash-prefix bits; no bucket's bits begin another's, pages apart."""
    return assign(docs, limit).select("shard", "depth", "shard_bytes", "shard_docs").distinct()


def write_shards(docs: DataFrame, path: str, limit: int = WRITTEN) -> None:
    """docs as Parquet, a folder with one file per shard. Rows that repeat a doc_id are written as often as they occur."""
    rows = checkpoint(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("at")))
    own = rows.select("at", F.col("row.doc_id").alias("doc_id"), F.coalesce(F.octet_length("row.text"), F.lit(0)).cast("long").alias("n_bytes"))
    shards = placed(checkpoint(own.withColumn("h", hash_bits())), limit).select("at", F.col("shard").alias("shard_key"))
    rows.join(shards, "at").select("row.*", "shard_key").repartition("shard_key").write.partitionBy("shard_key").parquet(path)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))


OP9_SQL = f"""
with rows_ as (
  select doc_id, coalesce(strlen(text), 0) as n_bytes,
         cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) as h from documents),
levels as (select doc_id, n_bytes, h, d, h >> ({HASH_BITS} - d) as prefix from rows_, (select unnest(range(0, {HASH_BITS + 1})) as d)),
buckets as (select d, prefix, sum(n_bytes) as bytes, count(*) as n from levels group by d, prefix having sum(n_bytes) <= {LIMIT}),
fits as (select l.doc_id, min(l.d) as depth from levels l join buckets b on l.d = b.d and l.prefix = b.prefix group by l.doc_id)
select l.doc_id, l.n_bytes, cast(l.d as integer) as depth, substr(lpad(bin(l.h), {HASH_BITS}, '0'), 1, cast(l.d as integer)) as shard,
       cast(b.bytes as bigint) as shard_bytes, b.n as shard_docs
from levels l join fits f on l.doc_id = f.doc_id and l.d = f.depth join buckets b on b.d = l.d and b.prefix = l.prefix
"""
