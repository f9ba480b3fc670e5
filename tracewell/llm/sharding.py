"""Sharding by a two-pass external shuffle.

Pass 1 scatters rows uniformly into buckets by a seeded hash; there are as many buckets as keep each within BUCKET_BYTES and BUCKET_ROWS.
The scattered rows are written, so both readers of pass 2 see the same buckets. Pass 2 shuffles each bucket by Fisher-Yates (Spark's array shuffle
draws that way) and numbers it on from the buckets before it. A shard is a run of numbers, so shard sizes differ by one row at most, whatever the
buckets' sizes, and a bucket's rows go to one shard or two: they are written from where they were shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.store import discard, shuffle_partitions, written

SHARDS = 24
BUCKET_BYTES = 32 << 20
BUCKET_ROWS = 50_000
#: Buckets that are numbered in one task.
RUN = 4096


def shuffled(rows: DataFrame, size: str, shards: int = SHARDS, seed: int = 1) -> DataFrame:
    """rows with shard (0 to shards - 1) and slot (gapless from 0), in uniformly random order.

    `size` names the column that holds a row's bytes. The scatter hashes the row's place in the input with the seed, not its content, so
    repeated rows, null keys and equal texts spread like all others. Columns of rows named shard or slot are replaced; others stay,
    whatever their names. An empty table gives an empty table.
    """
    rows = rows.drop("shard", "slot")
    held = rows.agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).first()
    buckets = max(shuffle_partitions(rows.sparkSession), -(-(held["bytes"] or 0) // BUCKET_BYTES), -(-held["n"] // BUCKET_ROWS))
    place = F.xxhash64(F.lit(seed), F.monotonically_increasing_id())
    scattered = rows.select(F.pmod(place, F.lit(buckets)).alias("bucket"), place.alias("place"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
    scattered = written(scattered, "scattered", "zstd")
    counts = scattered.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("run", F.floor(F.col("bucket") / RUN))
    before = lambda over, by: F.coalesce(F.sum("n").over(over.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row a run of buckets
    runs = counts.groupBy("run").agg(F.sum("n").alias("n")).select("run", before(Window.partitionBy(), "run").alias("earlier"))
    counts = counts.select("bucket", "run", before(Window.partitionBy("run"), "bucket").alias("inside")).join(runs, "run").select("bucket", (F.col("earlier") + F.col("inside")).alias("before"))
    whole = scattered.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("place", "row"))).alias("all"))
    drawn = whole.select("bucket", F.posexplode(F.shuffle("all", F.lit(seed))).alias("at", "one"))
    number = F.col("before") + F.col("at")
    # the first shards hold one row more
    least, more = divmod(held["n"], shards)
    edge = more * (least + 1)
    longer, shorter = F.floor(number / (least + 1)), F.floor((number - edge) / max(1, least))
    shard = F.when(number < edge, longer).otherwise(shorter + more)
    slot = F.when(number < edge, number - longer * (least + 1)).otherwise(number - edge - shorter * least)
    out = drawn.join(counts.hint("merge"), "bucket").select("one.row.*", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))
    out._tracewell_path = scattered._tracewell_path
    return out


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, the rows of each file in slot order. The buckets that sharded still reads are removed."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path, compression="zstd")
    discard(sharded)
