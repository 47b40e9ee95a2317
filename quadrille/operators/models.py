"""Tuple models: relations of any arity as facts(pred, args)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadrille.functions.strings import natural_key


def facts_of(df: DataFrame, pred: str, *args: Column) -> DataFrame:
    return df.select(F.lit(pred).alias("pred"), F.array(*[a.cast("string") for a in args]).alias("args")).filter(~F.exists("args", lambda a: a.isNull()))


def keep(facts: DataFrame, *preds: str) -> DataFrame:
    return facts.filter(F.col("pred").isin(list(preds)))


def discard(facts: DataFrame, *preds: str) -> DataFrame:
    return facts.filter(~F.col("pred").isin(list(preds)))


def of_arity(facts: DataFrame, n: int) -> DataFrame:
    return facts.filter(F.size("args") == n)


def domain(facts: DataFrame) -> DataFrame:
    return facts.select(F.explode("args").alias("element")).distinct()


def statistics(facts: DataFrame) -> DataFrame:
    """(pred, arity, n, n_elements) of each relation."""
    rows = facts.select("pred", F.size("args").alias("arity"), "args")
    sizes = rows.groupBy("pred", "arity").agg(F.count("*").alias("n"))
    elements = rows.select("pred", "arity", F.explode("args").alias("x")).groupBy("pred", "arity").agg(F.count_distinct("x").alias("n_elements"))
    return sizes.join(elements, ["pred", "arity"])


def inequalities(elements: DataFrame) -> DataFrame:
    """Unordered pairs of different elements of small sets(group, element), within each group."""
    other = elements.withColumnRenamed("element", "other")
    return elements.join(other, "group").filter("element < other")


def ordered_by(facts: DataFrame, position: int) -> DataFrame:
    return facts.orderBy("pred", natural_key(F.get("args", F.lit(position))), "args")


def numbered(facts: DataFrame, position: int) -> DataFrame:
    """facts with their place, from 1, in the order of `ordered_by`: numbers within ranges of the order, and where each range begins."""
    from quadrille.plans.stages import stored

    keyed = facts.withColumn("__key", natural_key(F.get("args", F.lit(position))))
    parts = stored(keyed.repartitionByRange("pred", "__key", "args").withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("__part").agg(F.count("*").alias("n"))
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))  # one row for each partition
    own = F.row_number().over(Window.partitionBy("__part").orderBy("pred", "__key", "args"))
    return parts.withColumn("__n", own).join(F.broadcast(before), "__part").select(*facts.columns, (F.col("__n") + F.col("__before")).cast("long").alias("place"))


def relabelled(facts: DataFrame, pred: str, position: int, prefix: str) -> DataFrame:
    """The elements at a place of a relation named prefix1, prefix2, ... wherever they stand.

    Numbers follow from the elements' ranks within ranges, so that no single task sees all of them.
    """
    from quadrille.plans.stages import stored

    elements = facts.filter(F.col("pred") == pred).select(F.get("args", F.lit(position)).alias("x")).filter("x IS NOT NULL").distinct()
    parts = stored(elements.repartitionByRange("x").withColumn("__part", F.spark_partition_id()), "elements")
    sizes = parts.groupBy("__part").agg(F.count("*").alias("n"))
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    named = parts.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy("x"))).join(F.broadcast(before), "__part").select("x", F.concat(F.lit(prefix), (F.col("__n") + F.col("__before")).cast("string")).alias("name"))
    rows = facts.withColumn("__id", F.monotonically_increasing_id())
    rows = stored(rows, "facts")
    cells = rows.select("__id", "pred", F.posexplode("args").alias("at", "x")).join(named, "x", "left").select("__id", "pred", F.struct("at", F.coalesce("name", "x").alias("x")).alias("c"))
    return cells.groupBy("__id", "pred").agg(F.array_sort(F.collect_list("c")).alias("c")).select("pred", F.transform("c", lambda c: c["x"]).alias("args"))


def in_time(facts: DataFrame, time: int) -> DataFrame:
    """facts in the order of the time at a place of theirs (numbers or dates as texts), then by name: those without come last."""
    at = F.get("args", F.lit(time))
    return facts.orderBy(F.coalesce(at.try_cast("double"), F.unix_timestamp(at.try_cast("timestamp")).cast("double")).asc_nulls_last(), "pred", "args")


def first_of_each(rows: DataFrame, group: str, order: Column, n: int) -> DataFrame:
    """The first n rows of each group; Spark keeps n rows of a group in each task before it deals them."""
    own = Window.partitionBy(group).orderBy(order, *[c for c in rows.columns if c != group])
    return rows.withColumn("__n", F.row_number().over(own)).filter(F.col("__n") <= n).drop("__n")
