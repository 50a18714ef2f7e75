"""Other tables as candidate pools."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of the folder; workers find this package where the driver does."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_pools(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Samples are the benchmark's items; every document is dealt to one of them, and is gold if it contains the item's text."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("comment"))
    n = items.agg(F.count("*").alias("items"))
    samples = items.select(F.col("item_id").cast("string").alias("sample_id"), "comment")
    docs = table(spark, sf_dir, "documents").crossJoin(F.broadcast(n)).withColumn("sample_id", F.pmod("doc_id", "items").cast("string"))
    joined = docs.join(samples, "sample_id")
    text = F.concat(F.lit("path: "), F.col("source"), F.lit("/"), F.col("lang"), F.lit(".txt\n"), F.col("text"))
    pos = F.row_number().over(Window.partitionBy("sample_id").orderBy("doc_id"))
    rows = joined.select("sample_id", pos.alias("pos"), F.col("doc_id").cast("string").alias("context_id"), F.concat_ws("/", "source", F.concat("lang", F.lit(".txt"))).alias("path"), "source", "lang", text.alias("text"), F.col("text").contains(F.col("comment")).alias("is_gold"))
    return samples, rows


def conversation_pools(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Samples are conversations, asked by their first turn; the later turns are the candidates, and the next turn is gold."""
    turns = table(spark, sf_dir, "conversations").withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    samples = turns.where("k = 1").select(F.col("conv_id").cast("string").alias("sample_id"), F.col("text").alias("comment"))
    rows = turns.where("k > 1").select(F.col("conv_id").cast("string").alias("sample_id"), (F.col("k") - 1).alias("pos"), F.concat_ws("::hunk_", "role", F.col("turn").cast("string")).alias("context_id"), F.col("role").alias("path"), F.col("role").alias("source"), "text", (F.col("k") == 2).alias("is_gold"))
    return samples, rows


ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")


#: Rows of a task, where a table's pools are sorted: the tasks grow in number, and not in size, with the table.
ROWS = 150_000


def dealt(rows: DataFrame, n: int, key: str) -> DataFrame:
    """The n rows by the key in as many tasks as they need, so that the windows over the key hold no more of a larger table."""
    return rows if n <= ROWS else rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS)), key)


def lineitem_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pools of their lines: scores a (price) and b (quantity), path (return flag), hunk, is_gold (a large discount)."""
    lines = table(spark, sf_dir, "lineitem")
    pos = F.row_number().over(Window.partitionBy("sample_id").orderBy(*ORDER))
    own = dealt(lines.select(F.col("l_orderkey").alias("sample_id"), *ORDER, "l_returnflag", "l_discount"), lines.count(), "sample_id")
    rows = own.select("sample_id", pos.alias("pos"), "l_linenumber", F.col("l_extendedprice").alias("a"), F.col("l_quantity").alias("b"), F.col("l_returnflag").alias("path"), F.col("l_linenumber").alias("hunk"), (F.col("l_discount") >= 0.08).alias("is_gold"))
    return rows.withColumn("context_id", F.concat(F.lit("c"), F.col("pos").cast("string")))
