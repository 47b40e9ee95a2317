"""Streams of triples: exact sets by micro-batch, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.operators.update import GraphStore, key_of


def ingest(stream: DataFrame, store: GraphStore, name: str, checkpoint: str):
    """Adds each micro-batch's new quads to the named store; a batch that is played again changes nothing, for the
    store is a set. Only what a batch adds is written, as a part of the current version; `GraphStore.compact`
    joins the parts. Returns the started query; only what is available is read, then it ends."""

    def add(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates(key_of(batch))
        if store.exists(name):
            known = store.read(name)
            cond = F.lit(True)
            for c in [c for c in key_of(batch) if c in known.columns]:
                cond = cond & fresh[c].eqNullSafe(known[c])
            fresh = fresh.join(known, cond, "left_anti")
        store.append(name, fresh)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, key, n) of tumbling windows; events later than `late` behind the newest are left out."""
    if events.isStreaming:
        events = events.withWatermark(time, late)
    return events.groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
