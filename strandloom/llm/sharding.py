"""Contiguous shards of nearly equal bytes by global prefix sums. DataFrame functions only.

Rows are sorted into ranges of doc_id; each range's total is known after one pass, and totals before a range plus the running sum
inside it are the global prefix sum. A row goes to the shard that holds its middle byte, so shards are contiguous in doc_id and
their sizes differ from the target by one row at most. Offsets are one row a range, shard starts one row a shard.

Defined results: null text is empty (size 1); rows of one doc_id stand in order of their checksum and size; null doc_ids come first; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import stored

ORDER = ("doc_id", "text_crc32", "size")


def byte_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of `docs`."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")), "sizes")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(rows.repartitionByRange(ranges, *ORDER).withColumn("part", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), F.sum("bytes").over(every).alias("all_bytes"))
    inside = Window.partitionBy("part").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        ranged.withColumn("sum_to", F.sum("size").over(inside))
        .withColumn("row_to", F.row_number().over(Window.partitionBy("part").orderBy(*ORDER)))
        .join(F.broadcast(offsets), "part")
        .select("doc_id", "size", "text_crc32", (F.col("rows_before") + F.col("row_to") - 1).alias("place"), F.expr(f"cast(least({shards - 1}, (2 * (bytes_before + sum_to) - size) * {shards} div (2 * all_bytes)) as int)").alias("shard"))
    )
    placed = stored(placed, "placed")
    starts = placed.groupBy("shard").agg(F.min("place").alias("start"))
    return placed.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
