"""Benchmark decontamination by winnowing: fingerprints of texts and items meet, and hits are extended to whole windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import flat_words, slices, table
from quadrille.llm.near_dedup import mixed
from quadrille.plans.stages import free, stored

#: Words of a window, and of the grams that fingerprints are made of.
WINDOW, GRAM = 10, 5
#: Bits of the filter that the texts' fingerprints pass first: a fixed size, whatever the benchmark's.
FILTER = 2**26
PRINT = "struct<hash: bigint, at: int, before: array<string>, after: array<string>>"
PRINTS = pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int32()), ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))]))


def _seen():
    """What each byte is read as: A-Z in lower case, other ASCII characters than letters and digits as a space."""
    import numpy as np

    out = np.full(256, 32, np.uint8)
    for a, b in (("0", "9"), ("a", "z")):
        out[ord(a) : ord(b) + 1] = np.arange(ord(a), ord(b) + 1)
    out[ord("A") : ord("Z") + 1] = out[ord("a") : ord("z") + 1]
    out[128:] = np.arange(128, 256)
    return out


def words_of(texts: pa.Array):
    """(all words of the texts, their 64-bit hashes, the offsets of each text's words). A null text has none."""
    import numpy as np
    import xxhash

    texts = texts.fill_null("").take(pa.array(np.arange(len(texts)))).cast(pa.large_string())
    data = _seen()[np.frombuffer(texts.buffers()[2] or b"", np.uint8)]
    plain = pa.LargeStringArray.from_buffers(len(texts), texts.buffers()[1], pa.py_buffer(data))
    words, offsets = flat_words(plain, lower=False)
    named = words.dictionary_encode()
    each = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in named.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(named.dictionary))
    return words, each[named.indices.to_numpy()], offsets


def fingerprints(hashes, offsets, window: int, gram: int):
    """(places, hashes) of the grams that some window selects: of its grams the one of the least hash, the last of equals.

    Equal windows select the same place in themselves, so two texts that share a window share a fingerprint in it.
    """
    import numpy as np

    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = np.full(len(hashes) - gram + 1, window * 1_000_003, np.uint64)
    for i in range(gram):
        grams = mixed(grams + hashes[i : len(hashes) - gram + 1 + i] + np.uint64(i + 1))
    least, place = grams[:n].copy(), np.arange(n)
    for i in range(1, window - gram + 1):
        better = np.flatnonzero(grams[i : n + i] <= least)
        least[better], place[better] = grams[i : n + i][better], better + i
    ends = np.repeat(offsets[1:], np.diff(offsets))[:n]
    places = np.unique(place[ends >= np.arange(n) + window])  # of windows that lie in one text
    return places, grams[places]


def prints(words, hashes, offsets, window: int, gram: int, wanted: Callable) -> list[list[dict]]:
    """For each text its wanted fingerprints: hash, place, and the words that a window around it may hold, before it (from it outwards) and from it on."""
    import numpy as np

    out: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
    at, h = fingerprints(hashes, offsets, window, gram)
    kept = wanted(h)
    at, h = at[kept], h[kept].astype(np.int64)
    texts = np.searchsorted(offsets, at, "right") - 1
    lows, highs = np.maximum(offsets[texts], at - (window - gram)), np.minimum(offsets[texts + 1], at + window)
    for text, place, code, low, high in zip(texts.tolist(), at.tolist(), h.tolist(), lows.tolist(), highs.tolist(), strict=True):
        near = words.slice(low, high - low).to_pylist()
        out[text].append({"hash": code, "at": place - int(offsets[text]), "before": near[: place - low][::-1], "after": near[place - low :]})
    return out


def item_prints(items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """item, window, hash, before, after of each fingerprint of items(item_id, text).

    An item of fewer words than the window is one window, which is its own gram. An item without words has no fingerprints.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for part in slices(batch):
                lengths = np.minimum(np.diff(words_of(part["text"])[2]), window)
                for length in sorted(set(lengths.tolist()) - {0}):
                    own = part.filter(pa.array(lengths == length))
                    made = prints(*words_of(own["text"]), length, min(length, gram) if length == window else length, lambda h: np.ones(len(h), bool))
                    yield pa.RecordBatch.from_arrays([own["item"], pa.array([length] * len(made), pa.int32()), pa.array(made, PRINTS)], names=["item", "window", "prints"])

    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    rows = named.mapInArrow(mark, f"item string, window int, prints array<{PRINT}>")
    return rows.select("item", "window", F.explode("prints").alias("p")).select("item", "window", "p.hash", "p.before", "p.after")


def _passes(hashes: DataFrame):
    """The filter of hashes(hash) as 64-bit words: at most FILTER bits come to the driver, summed by Spark."""
    import numpy as np

    bits = np.zeros(FILTER // 64, np.uint64)
    place = F.col("hash").bitwiseAND(F.lit(FILTER - 1))
    words = hashes.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(hash & 63 AS INT))")).alias("bits")).toArrow()
    bits[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return bits


def _alike(a: str, b: str) -> Column:
    """How many first elements two arrays have in common."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differ > 0, differ - 1).otherwise(F.greatest(F.size(a), F.size(b))).cast("int")


def _merged(spans: str) -> Column:
    """Sorted spans (start, stop) with those that touch made one."""

    def add(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))))
        return F.when(last["stop"] >= s["start"], longer).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.col(spans), F.array().cast("array<struct<start: int, stop: int>>"), add)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, spans, items of every row of docs(doc_id, text), for items(item_id, text).

    spans are the places of words (start, stop) that lie in an occurrence of a window of an item, in order and apart;
    items are the ids, as text and sorted, of the items with such windows. A null, empty or wordless text has no words and
    no spans; repeated rows are marked each; repeated item ids are one item, a null one has the empty id. Without items,
    or documents, nothing is marked. Further columns are ignored.

    A text sends only fingerprints that pass the items' filter, with the few words around them. Fingerprints of items
    with equal surroundings are one, however many items share a passage; the join is by hash, and whether a
    fingerprint is real, and how far the texts agree around it, is decided by the words themselves.
    """
    spark = docs.sparkSession
    of_items = stored(item_prints(items, window, gram), "item-prints")
    look = ["window", "hash", "before", "after"]
    known = stored(of_items.select(*look).distinct().withColumn("print", F.monotonically_increasing_id()), "prints")
    of = stored(of_items.join(known, look).select("print", "item").distinct(), "items-of-prints")
    lengths = sorted(r.window for r in known.select("window").distinct().collect())  # at most as many as the window has words
    bits = spark.sparkContext.broadcast(_passes(known.select("hash")))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def wanted(h):
            return bits.value[(h % np.uint64(FILTER)) >> np.uint64(6)] >> (h & np.uint64(63)) & np.uint64(1) == 1

        for batch in batches:
            for part in slices(batch, 500):
                text = words_of(part["text"])
                made: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for length in lengths:
                    for own, more in zip(made, prints(*text, length, gram if length == window else length, wanted), strict=True):
                        own += more
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(np.diff(text[2]), pa.int64()), pa.array(made, PRINTS)], names=["doc_id", "n_words", "prints"])

    marked = stored(docs.select("doc_id", "text").mapInArrow(mark, f"doc_id long, n_words long, prints array<{PRINT}>").withColumn("row_id", F.monotonically_increasing_id()), "marked")
    hits = marked.select("row_id", F.explode("prints").alias("p")).select("row_id", "p.hash", "p.at", F.col("p.before").alias("ahead"), F.col("p.after").alias("behind"))
    met = hits.join(known, "hash").withColumn("left", _alike("ahead", "before")).withColumn("right", _alike("behind", "after"))
    found = stored(
        met.filter(F.col("left") + F.col("right") >= F.col("window")).select("row_id", "print", (F.col("at") - F.col("left")).alias("start"), (F.col("at") + F.col("right")).alias("stop")),
        "occurrences",
    )
    free(of_items, known)
    spans = found.groupBy("row_id").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans")).select("row_id", _merged("spans").alias("spans"))
    named = found.select("row_id", "print").distinct().join(of, "print").groupBy("row_id").agg(F.array_sort(F.collect_set("item")).alias("items"))
    rows = marked.select("row_id", "doc_id", "n_words").join(spans, "row_id", "left").join(named, "row_id", "left")
    return rows.select("doc_id", "n_words", F.coalesce("spans", F.array().cast("array<struct<start: int, stop: int>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op13_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    rows = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["stop"] - s["start"]))
    return rows.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE {_WORDS} END AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
iw AS MATERIALIZED (SELECT DISTINCT item_id, m, array_to_string(w[p:p + m - 1], ' ') AS x FROM (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, m, p, array_to_string(w[p:p + m - 1], ' ') AS x FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m)),
h AS MATERIALIZED (SELECT DISTINCT doc_id, p, dw.m AS m, item_id FROM dw JOIN iw ON dw.m = iw.m AND dw.x = iw.x),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM h) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN g ON g.doc_id = d.doc_id
"""
