"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of white space between words.
WHITE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: str | Column, by: int) -> Column:
    """crc32 of the id's decimal text modulo by; a null id counts as an empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % by


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until no column of df has them (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows of one group are dealt to so many join keys.
SALTS = 32


def given_back(rows: DataFrame, groups: DataFrame, key: list[str], row_id: str) -> DataFrame:
    """rows left-joined with groups, of which there is one row for each key, though a group may hold any part of the rows.

    A group's row is repeated for those of its SALTS parts that rows lie in, never more often than it has rows.
    """
    (salt,) = fresh(rows, "__salt")
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(row_id), F.lit(SALTS)).cast("int"))
    parts = salted.select(*key, salt).distinct().join(groups, key)
    return salted.join(parts, [*key, salt], "left").drop(salt)


def flat_words(texts: pa.Array, lower: bool = True):
    """All words of the texts in one array, A-Z lower-cased if asked, and the offsets of each text's words."""
    import numpy as np

    texts = pc.fill_null(texts, "").take(pa.array(np.arange(len(texts))))  # a copy: casts of slices go wrong in pyarrow
    texts = texts.cast(pa.large_string())
    words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts) if lower else texts))
    flat = words.flatten()
    offsets = words.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = offsets - offsets[0]
    blank = pc.equal(flat, "")
    if pc.any(blank).as_py():  # an empty text is split into one empty word
        full = ~blank.to_numpy(zero_copy_only=False)
        before = np.concatenate([[0], np.cumsum(full)])
        flat, offsets = flat.filter(pa.array(full)), before[offsets]
    return flat, offsets


def slices(batch: pa.RecordBatch, rows: int = 1000):
    """Bounded parts of a record batch."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
