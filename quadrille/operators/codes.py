"""Terms of several vocabularies: strings by source, related concepts, and code mapping, over rows of a service's answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merged_sources(atoms: DataFrame) -> DataFrame:
    """(name, sources): the distinct sources that have each string, of atoms(name, source)."""
    return atoms.filter("name IS NOT NULL").groupBy("name").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def related(relations: DataFrame, names: DataFrame) -> DataFrame:
    """(id, label, name) of relations(id, label, related), with the related concept's name(id, name) where it has one."""
    other = names.select(F.col("id").alias("related"), "name")
    return relations.join(other, "related", "left").select("id", "label", F.coalesce("name", "related").alias("name"))


def value_sets(rows: DataFrame, key: str) -> DataFrame:
    """The distinct values of a column, each with the number of its rows."""
    return rows.groupBy(F.col(key).alias("value")).agg(F.count("*").alias("n"))


def mentioned(texts: DataFrame, text: str, pattern: str) -> DataFrame:
    """(match, n): all distinct matches in the texts, and how many rows mention each."""
    return texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))).alias("match")).groupBy("match").agg(F.count("*").alias("n"))


def trailing_code(url: Column) -> Column:
    return F.regexp_extract(url, r"([^/]+)/?$", 1)


def mapped_codes(atoms: DataFrame, source: str, target: str) -> DataFrame:
    """(code, mapped): codes of two sources that share a concept, of atoms(concept, source, code). A code that is told of a concept many
    times is paired once: only distinct ones of a concept meet."""
    own = atoms.filter(F.col("source") == source).select("concept", F.col("code").alias("code")).distinct()
    other = atoms.filter(F.col("source") == target).select("concept", F.col("code").alias("mapped")).distinct()
    return own.join(other, "concept").select("code", "mapped").distinct()


def unambiguous(mapping: DataFrame) -> DataFrame:
    """The mappings of codes that have just one."""
    one = mapping.groupBy("code").agg(F.count_distinct("mapped").alias("n")).filter("n = 1")
    return mapping.join(one.select("code"), "code", "left_semi").distinct()


def labelled_codes(names: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, code) for labels(label): by the whole label, or else by the label without its last parenthesis."""
    bare = F.trim(F.regexp_replace("label", r"\s*\([^()]*\)\s*$", ""))
    whole = labels.join(names.select(F.col("name").alias("label"), "code"), "label")
    rest = labels.join(whole.select("label"), "label", "left_anti").withColumn("__bare", bare)
    again = rest.join(names.select(F.col("name").alias("__bare"), "code"), "__bare").select("label", "code")
    return whole.select("label", "code").unionByName(again).distinct()
