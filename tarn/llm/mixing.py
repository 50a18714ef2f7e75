"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash and passed over at most twice. An item (document, pass) gets the
virtual finish time: cumulative words of its source, divided by the source's target. All items in the order of
their finish times, as far as the total budget reaches, are the mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
#: Times that a document may occur in the mix.
PASSES = 2
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"
#: Items of one range of the global order, about, and ranges at most.
ITEMS, RANGES = 20_000, 20_000


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target, place of every source: a table with one row per source, made in one task.

    A source's target is its weight's part of the budget, but at most PASSES times its size; what it can't
    take is dealt to the others by weight, until none is above. Sources are in the order of their code points, null last.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("place", F.row_number().over(order))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("place") - 1) % len(WEIGHTS) + 1).cast("int")).cast("double")
    rows = rows.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(PASSES)).withColumn("budget", F.sum("source_size").over(Window.partitionBy()) * SHARE)
    by = Window.orderBy(F.col("cap") / F.col("w"), "place")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("rest", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("rest_w", F.sum("w").over(after))
    rows = rows.withColumn("full", F.col("cap") * F.col("rest_w") <= F.col("w") * F.col("rest"))
    every = Window.partitionBy()
    left = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0.0))
    open_w = F.sum(F.when(~F.col("full"), F.col("w"))).over(every)
    return rows.select("source", "source_size", "place", "budget", F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * left / open_w).alias("target"))


def shuffle_key(seed: int) -> Column:
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}")))


def queue(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, place, h and cum (words of the source up to and with this document), per row.

    The running sum is taken in two steps, inside buckets of the hash and over the buckets' totals, so the
    largest source is spread over as many tasks as the others.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sizes = checkpoint(docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), shuffle_key(seed).alias("h")))
    sizes = sizes.withColumn("bucket", F.substring("h", 1, 3))
    per_source = targets(sizes)
    totals = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("offset", F.coalesce(F.sum("in_bucket").over(up_to), F.lit(0))).drop("in_bucket")
    own = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = sizes.withColumn("inner", F.sum("size").over(own)).alias("r")
    rows = rows.join(offsets.alias("o"), F.col("r.source").eqNullSafe(F.col("o.source")) & (F.col("r.bucket") == F.col("o.bucket")))
    rows = rows.join(per_source.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
    return rows.select("r.doc_id", "r.size", "s.source_size", "s.target", "s.place", "s.budget", "r.h", (F.col("inner") + F.col("offset")).alias("cum"))


def finish(k: int) -> Column:
    """Virtual finish time of the document's k-th pass; null for a source without a target."""
    return F.when(F.col("target") > 0, (F.col("cum") + k * F.col("source_size")).cast("double") / F.col("target"))


def last_within(items: DataFrame, order: list[str], budget: float) -> Row | None:
    """The last item, in the order, up to which the sizes add up to at most the budget; null if the first is too large.

    All items are sorted by ranges of the order, about ITEMS of them in each (ranges get larger only beyond RANGES).
    The ranges' sums tell the range in which the budget ends, and a running sum over that one range the item.
    """
    ranges = max(1, min(RANGES, -(-items.count() // ITEMS)))
    ordered = checkpoint(items.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()))
    held = {r["range"]: r["words"] for r in ordered.groupBy("range").agg(F.sum("size").alias("words")).collect()}
    before = 0
    for at in sorted(held):
        if before + held[at] > budget:
            break
        before += held[at]
    else:
        return ordered.agg(F.max(F.struct(*order)).alias("last")).first()["last"]
    running = F.sum("size").over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = ordered.where(F.col("range") == at).withColumn("running", running + F.lit(before)).where(F.col("running") <= budget)
    found = cut.agg(F.max(F.struct(*order)).alias("last")).first()["last"]
    return found or ordered.where(F.col("range") < at).agg(F.max(F.struct(*order)).alias("last")).first()["last"]


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken of every row of docs (copies: 0 to PASSES).

    size counts words (null text: 0). Rows of equal doc_id and size that are taken differently are exchangeable.
    Null sources are a source of their own; documents without words are never taken; an empty table gives
    an empty result; other columns of docs are not looked at.
    """
    rows = checkpoint(queue(docs, seed))
    first = rows.select("budget").head()
    budget = float(first[0]) if first else 0.0
    order = ["v", "place", "pass", "h", "doc_id"]
    entries = [F.struct(F.lit(k).alias("pass"), finish(k).alias("v")) for k in range(PASSES)]
    items = rows.where("size > 0 and target > 0").select("size", "place", "h", "doc_id", F.explode(F.array(*entries)).alias("i")).select("i.v", "place", "i.pass", "h", "doc_id", "size")
    last = last_within(items, order, budget)

    def taken_in(k: int) -> Column:
        if last is None:
            return F.lit(0)
        own = F.struct(finish(k), F.col("place"), F.lit(k), F.col("h"), F.col("doc_id"))
        inside = own <= F.struct(*[F.lit(last[c]).cast(t) for c, t in zip(order, ("double", "int", "int", "string", dict(rows.dtypes)["doc_id"]))])
        return F.when((F.col("size") > 0) & F.coalesce(inside, F.lit(False)), 1).otherwise(0)

    copies = sum((taken_in(k) for k in range(1, PASSES)), taken_in(0))
    return rows.withColumn("copies", copies).select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of docs that the mix takes, with all their columns, each as often as it is taken.

    Rows that agree in doc_id must agree in their words (repeated rows do): how often is looked up by doc_id and
    size, and rows that share both are taken equally often, as often as the most taken of them.
    """
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    often = mix(docs, seed).groupBy("doc_id", "size").agg(F.max("copies").alias("copies")).where("copies > 0").alias("m")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), size.alias("own_size"))
    rows = rows.join(often, F.col("own_id").eqNullSafe(F.col("m.doc_id")) & (F.col("own_size") == F.col("m.size")))
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = rf"""
with sizes as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as bigint) as size,
         md5(coalesce(cast(doc_id as varchar), 'null') || ':{SEED}') as h
  from documents),
per_source as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) as place from sizes group by source),
weighed as (
  select *, cast(case (place - 1) % 3 when 0 then {WEIGHTS[0]} when 1 then {WEIGHTS[1]} else {WEIGHTS[2]} end as double) as w,
         source_size * {float(PASSES)}::double as cap, cast(sum(source_size) over () as double) * {SHARE}::double as budget from per_source),
dealt as (
  select *, budget - coalesce(sum(cap) over (order by cap / w, place rows between unbounded preceding and 1 preceding), 0) as rest,
         sum(w) over (order by cap / w, place rows between current row and unbounded following) as rest_w from weighed),
marked as (select *, cap * rest_w <= w * rest as is_full from dealt),
aims as (
  select source, source_size, place, budget,
         case when is_full then cap else w * (budget - coalesce(sum(case when is_full then cap end) over (), 0)) / sum(case when not is_full then w end) over () end as target
  from marked),
placed as (
  select s.doc_id, s.size, s.h, a.source_size, a.place, a.budget, a.target,
         sum(s.size) over (partition by s.source order by s.h, s.doc_id, s.size rows unbounded preceding) as cum
  from sizes s join aims a on s.source is not distinct from a.source),
items as (
  select *, k, cast(cum + k * source_size as double) / target as v from placed, (select unnest([0, 1]) as k) where target > 0 and size > 0),
running as (select *, sum(size) over (order by v, place, k, h, doc_id, size rows unbounded preceding) as used from items),
taken as (select doc_id, cast(sum(size) as bigint) as taken from running where used <= budget group by doc_id)
select p.doc_id, p.size, p.source_size, p.target, coalesce(t.taken, 0) as taken from placed p left join taken t using (doc_id)
"""
