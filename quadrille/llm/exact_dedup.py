"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadrille.llm.common import given_back, table
from quadrille.plans.stages import stored

#: A chunk ends at the first of these marks after 512 characters, or else after 4096.
CHUNK = r"(?s).{512,4096}?[.!?;:|]|(?s).{1,4096}"


def normalised(text: str):
    """The text with each run of white space as one space; null counts as empty."""
    runs = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"  # one space alone needs no change
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), runs, " ")


def recipes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, collisions): each row's ordered chunk hashes, and the chunks whose hash other chunks share.

    The chunk table holds each chunk once, however many documents have it; a hash is verified as
    an identifier when the table has one chunk under it. For the others the table gives the
    chunk's rank under its hash as the identifier's second part.
    """
    base = df.select("doc_id", normalised("text").alias("norm"))
    chunks = F.regexp_extract_all("norm", F.lit(CHUNK), F.lit(0))
    rows = stored(
        base.select(
            F.monotonically_increasing_id().alias("row_id"), "doc_id",
            F.sha2("norm", 256).alias("text_sha256"),
            F.transform(chunks, lambda c: F.xxhash64(c)).alias("recipe"),
        ),
        "recipes",
    )
    distinct = base.select(F.explode(chunks).alias("chunk")).select(F.xxhash64("chunk").alias("hash"), "chunk").distinct()
    shared = stored(distinct.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"), "shared-hashes")
    if shared.isEmpty():
        return rows, shared
    rank = F.row_number().over(Window.partitionBy("hash").orderBy("chunk"))
    named = distinct.join(shared, "hash", "left_semi").withColumn("rank", rank)
    places = base.select(F.sha2("norm", 256).alias("text_sha256"), F.posexplode(chunks).alias("at", "chunk")).withColumn("hash", F.xxhash64("chunk"))
    ranks = (
        places.join(named, ["hash", "chunk"]).select("text_sha256", F.struct("at", "rank").alias("x")).distinct()
        .groupBy("text_sha256").agg(F.array_sort(F.collect_list("x")).alias("ranks"))
    )  # one entry for each chunk of a text that has a shared hash: far below the text's own size
    return stored(rows.join(ranks, "text_sha256", "left"), "verified-recipes"), shared


def exact_dedup(df: DataFrame) -> DataFrame:
    """One row for each row of df(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, row_id.

    Texts are equal when their normalised forms are; the row with the smallest doc_id stays. Of
    repeated rows with that doc_id just one is kept. A null text counts as empty, all empty texts
    are one group, a null doc_id comes after all others. Further columns of df are ignored.

    Documents move as recipes, 8 bytes for each chunk of over 512 characters, and are compared by
    these ordered identifiers alone; the digest is for the result. A group may hold any part of the
    rows: groups are summed before the shuffle, and the outcome of groups with copies is joined back
    in parts; a row without copies needs only its own values.
    """
    rows, _ = recipes(df)
    key = ["recipe"]
    if "ranks" in rows.columns:
        rows, key = rows.withColumn("ranks", F.coalesce("ranks", F.array().cast(rows.schema["ranks"].dataType))), ["recipe", "ranks"]
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_id")
    groups = stored(rows.groupBy(*key).agg(F.min(order).alias("first"), F.count("*").alias("group_size")).filter("group_size > 1"), "copies")
    joined = given_back(rows, groups, key, "row_id")
    return joined.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (F.col("group_size").isNull() | (F.col("first.row_id") == F.col("row_id"))).alias("kept"),
        "text_sha256",
    )


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size, text_sha256
  FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents))
"""
