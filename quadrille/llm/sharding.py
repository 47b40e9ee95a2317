"""Sharding: rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadrille.llm.common import table
from quadrille.plans.stages import stored

SHARDS = 24
#: Rows of a shard that one window numbers, about.
NUMBERED = 200_000


def chosen_shard(key: str | Column, weights: Sequence[float]) -> Column:
    """The shard with the least -ln(u)/weight, u being a hash of key and shard number in (0, 1).

    A key's values for the other shards don't change when a shard comes or goes, so a new shard
    takes rows only into itself, and a shard of weight w gets w's part of the keys. Equal values
    go to the lower number. All null keys share one shard.
    """
    key = F.col(key) if isinstance(key, str) else key
    draws = []
    for n, weight in enumerate(weights):
        if weight <= 0:
            raise ValueError("a shard's weight must be positive")
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(n)), 11).cast("double") + 0.5) * 2.0**-53
        draws.append(F.struct((-F.log(u) / float(weight)).alias("value"), F.lit(n).alias("shard")))
    return F.array_min(F.array(*draws))["shard"] if len(draws) > 1 else F.lit(0)


def shard(df: DataFrame, key: str, weights: Sequence[float], text: str = "text", added: float = 1.0) -> DataFrame:
    """Key, size, text_crc32, law, shard, slot and grown_shard of every row.

    size is the text's UTF-8 bytes plus 8; a null text has no bytes and the checksum of an empty
    one. slot numbers a shard's rows from 0 without gaps. grown_shard is the shard with one more
    of the weight `added`. Repeated rows get slots of their own. Other columns are left out.

    A shard can hold any part of the rows, so its rows are numbered in buckets of a hash of the stored row's
    number, as many as the rows need: rows of one id, or without any, are dealt apart, even if they are
    equal in all. The buckets' counts give where each bucket begins.
    """
    rows = df.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        chosen_shard(key, weights).cast("int").alias("shard"),
        chosen_shard(key, [*weights, added]).cast("int").alias("grown_shard"),
    )
    rows = stored(rows.withColumn("row_id", F.monotonically_increasing_id()), "sharded")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("row_id"), F.lit(rows.count() // NUMBERED + 1)))
    within = Window.partitionBy("shard", "bucket").orderBy("row_id")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    return (
        rows.withColumn("place", F.row_number().over(within) - 1)
        .join(starts, ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                (F.col("start") + F.col("place")).cast("long").alias("slot"), "grown_shard")
    )


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), "doc_id", [1.0] * SHARDS)
