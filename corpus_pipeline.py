"""The corpus pipeline: five stages over the table documents, each written as Parquet and read again.

Quality classifier, exact dedup, MinHash near-dedup, mixing to target weights, best-fit packing.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import exact_dedup, mixing, near_dedup, packing, quality
from quadrille.llm.common import fresh, table
from quadrille.plans.stages import stored

#: No stage that learns, and no stage that packs, can be said in SQL.
ORACLE_SQL = None
#: Stages on word shingles link documents of a similarity of 0.8 or more.
NEAR_PERCENT = 80


def _keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with two columns that tell rows by doc_id, a null one included, and their names, which docs hasn't."""
    missing, known = fresh(docs, "__null", "__id")
    return docs.withColumn(missing, F.col("doc_id").isNull()).withColumn(known, F.coalesce("doc_id", F.lit(0))), [missing, known]


def _of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is among those of chosen(doc_id); a null one equals a null one."""
    keyed, names = _keyed(docs)
    other = chosen.select(F.col("doc_id").isNull().alias(names[0]), F.coalesce("doc_id", F.lit(0)).alias(names[1]))
    return keyed.join(other, names, "left_semi").select([F.col(f"`{c}`") for c in docs.columns])


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. A null or empty text has a score as any other; repeated rows stay or go together."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    (score,) = fresh(docs, "__score")
    return docs.withColumn(score, quality.scored(model)).filter(F.col(score) >= quality.THRESHOLD).drop(score)


def first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays; of its repeated rows one. All null and empty texts are one group."""
    rows = stored(exact_dedup.exact_dedup(docs).select(F.col("doc_id").isNull().alias("k0"), F.coalesce("doc_id", F.lit(0)).alias("k1"), "kept", F.col("text_sha256").alias("k2")), "exact")
    keyed, names = _keyed(docs)
    (digest,) = fresh(keyed, "__sha")
    key = [*names, digest]
    rows = rows.select(F.col("k0").alias(key[0]), F.col("k1").alias(key[1]), F.col("k2").alias(key[2]), "kept")
    kept, gone = rows.filter("kept").drop("kept"), rows.filter("NOT kept").drop("kept")
    named = keyed.withColumn(digest, F.sha2(exact_dedup.normalised("text"), 256))
    out = named.join(kept, key, "left_semi")
    again = stored(kept.join(gone.distinct(), key, "left_semi"), "repeated-rows")
    if not again.isEmpty():
        once = out.join(again, key, "left_semi")
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        once = once.groupBy(*key).agg(F.first(whole).alias("row")).select("row.*")
        out = out.join(again, key, "left_anti").drop(*key).unionByName(once)
    return out.select([F.col(f"`{c}`") for c in docs.columns])


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays. Texts without words link with nothing and stay; rows of one doc_id stay or go together."""
    return _of(docs, near_dedup.near_duplicates(docs, percent=NEAR_PERCENT).filter("kept").select("doc_id"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn, each once at most, with the rates at which the domains' tokens come nearest to the target weights.

    A domain below its target keeps all it has. A text without tokens is drawn with the rate of the prior; rows of one doc_id stay or go together.
    """
    classifier = mixing.fit_classifier(docs, table(spark, sf_dir, "labels"))
    rows = stored(mixing.measured(docs.select("doc_id", "text"), classifier).drop("text"), "posteriors")
    steps, _, _ = mixing.fit_rates(rows, mixing.WEIGHTS, repeat=False)
    return _of(docs, rows.withColumn("rate", mixing.rate_of(steps, repeat=False)).filter(mixing.copies_of() > 0).select("doc_id"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; a null or empty text is the end id alone."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", good_documents),
    ("exact_dedup", first_copies),
    ("minhash_near_dedup", near_copies_out),
    ("mixing", mixed),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
