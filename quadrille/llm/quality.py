"""Quality classifier: random Fourier features, ridge regression, isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import flat_words, remainder, table
from quadrille.plans.stages import free, stored

#: Random features; the normal equations have WIDTH squared entries whatever the input.
WIDTH = 320
#: Frequencies of the features, in units of one over a standardised statistic: a wide kernel.
SPREAD = 0.3
#: Standardised statistics beyond this are cut.
CLIP = 6
RIDGE = 1e-5
#: Bins of raw scores that the calibration counts.
BINS = 2000
THRESHOLD = 0.3
HELD_OUT = 5
#: Labelled rows that the classifier learns from at most (those with the smallest hashes of their ids).
LABELLED = 100_000

#: Byte classes whose shares are statistics.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "blank": b" \t\n\v\f\r",
    "stop": b".",
    "comma": b",;:",
    "loud": b"!?",
    "bar": b"|",
    "sign": b"#$%&*+<=>@^_~\\/",
    "bracket": b"()[]{}",
    "quote": b"\"'`",
}
STATISTICS = [
    *CLASSES, "other", "log_bytes", "log_words", "word_length", "word_spread", "distinct_words", "top_word", "run_words",
    "distinct_pairs", "log_lines", "distinct_lines",
]


def statistics(texts: pa.Array):
    """A row of STATISTICS for each whole text; a null or empty text has zeros."""
    import numpy as np

    table_ = np.full(256, len(CLASSES), np.uint8)
    for k, chars in enumerate(CLASSES.values()):
        table_[list(chars)] = k
    out = np.zeros((len(texts), len(STATISTICS)))
    words, offsets = flat_words(texts)
    named = words.dictionary_encode()
    code = named.indices.to_numpy().astype(np.int64)
    length = pc.binary_length(named.dictionary).to_numpy(zero_copy_only=False)[code]
    for k, text in enumerate(texts.to_pylist()):
        if not text:
            continue
        raw = text.encode()
        shares = np.bincount(table_[np.frombuffer(raw, np.uint8)], minlength=len(CLASSES) + 1) / len(raw)
        row = [*shares, np.log1p(len(raw))]
        own = code[offsets[k] : offsets[k + 1]]
        if n := len(own):
            counts = np.unique(own, return_counts=True)[1]
            pairs = len(np.unique(own[:-1] * (len(named.dictionary) + 1) + own[1:])) / max(1, n - 1)
            spread = length[offsets[k] : offsets[k + 1]]
            row += [np.log1p(n), np.log1p(spread.mean()), np.log1p(spread.std()), len(counts) / n, counts.max() / n, (own[:-1] == own[1:]).sum() / n, pairs]
        else:
            row += [0.0] * 7
        lines = text.split("\n")
        row += [np.log1p(len(lines)), len(set(lines)) / len(lines)]
        out[k] = row
    return out


@dataclass(frozen=True)
class Model:
    mean: "object"
    scale: "object"
    weights: "object"
    shift: "object"
    ridge: "object"
    steps: "object"  # raw scores, ascending
    values: "object"  # calibrated scores at the steps

    def features(self, x):
        import numpy as np

        z = np.cos(((x - self.mean) / self.scale).clip(-CLIP, CLIP) @ self.weights + self.shift) * (2 / self.weights.shape[1]) ** 0.5
        return np.hstack([z, np.ones((len(x), 1))])

    def raw(self, x):
        return self.features(x) @ self.ridge

    def score(self, x):
        import numpy as np

        return np.interp(self.raw(x), self.steps, self.values).clip(0, 1)


def _as_array(column: pa.Array):
    import numpy as np

    return np.array(column.to_pylist(), dtype=float).reshape(len(column), len(STATISTICS))


def _summed(df: DataFrame, rows, width: int):
    """Sums over all rows of vectors of fixed width: each task gives one vector, Spark adds them by place."""
    import numpy as np

    def part(batches):
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += rows(_as_array(batch["x"]), batch["y"].to_numpy(zero_copy_only=False).astype(float))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["at", "value"])

    got = df.select("x", "y").mapInArrow(part, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(width)
    for r in got:
        out[r["at"]] = r["value"]
    return out


def isotonic(sums, counts):
    """Least-squares nondecreasing means (pool adjacent violators) of bins with rows."""
    blocks: list[list[float]] = []
    for s, n in zip(sums, counts, strict=True):
        blocks.append([s, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, n2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + n2, blocks[-1][2] + k2]
    return [s / n for s, n, k in blocks for _ in range(k)]


def measured(col: str | Column) -> Column:
    @F.arrow_udf("array<double>")
    def stats(texts: pa.Array) -> pa.Array:
        parts = [statistics(texts.slice(k, 1000)) for k in range(0, len(texts), 1000)]
        return pa.concat_arrays([pa.array(p.tolist(), pa.list_(pa.float64())) for p in parts]) if parts else pa.array([], pa.list_(pa.float64()))

    return stats(col)


def fit(docs: DataFrame, labels: DataFrame, width: int = WIDTH, seed: int = 7, bound: int = LABELLED) -> Model | None:
    """Learns from at most `bound` rows of labels(doc_id, quality) outside the held-out fifth.

    The documents meet the labels first, so only texts that teach something are measured; the labels,
    of bounded number, go to every task, and no text moves.

    Moments, normal equations and calibration counts are sums over the partitions, of a size that
    depends on width and BINS alone. Rows with a null id or another quality than 0 and 1 are left
    out; a document that comes or is labelled more than once counts each time. None without rows.
    """
    import numpy as np

    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (remainder("doc_id", HELD_OUT) != 0))
    some = known.select("doc_id", F.col("quality").cast("double").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(bound)
    taught = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    train = stored(taught.select(measured("text").alias("x"), "y"), "quality-train")
    p = len(STATISTICS)
    moments = _summed(train, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x**2).sum(0)]), 1 + 2 * p)
    n = moments[0]
    if not n:
        return None
    mean = moments[1 : p + 1] / n
    scale = np.sqrt(np.maximum(moments[p + 1 :] / n - mean**2, 0))
    scale[scale < 1e-9] = 1.0
    rng = np.random.default_rng(seed)
    weights, shift = rng.normal(size=(p, width)) * SPREAD / p**0.5, rng.uniform(0, 2 * np.pi, width)
    bare = Model(mean, scale, weights, shift, None, None, None)

    def normal(x, y):
        z = bare.features(x)
        return np.concatenate([(z.T @ z)[upper], z.T @ y])

    upper = np.triu_indices(width + 1)
    sums = _summed(train, normal, len(upper[0]) + width + 1)
    gram, right = np.zeros((width + 1, width + 1)), sums[len(upper[0]) :]
    gram[upper] = sums[: len(upper[0])]
    gram += np.triu(gram, 1).T
    ridge = np.linalg.solve(gram / n + RIDGE / width * np.eye(width + 1), right / n)
    linear = Model(mean, scale, weights, shift, ridge, None, None)

    def binned(x, y):
        at = (linear.raw(x).clip(-0.5, 1.499999) + 0.5) * (BINS / 2)
        return np.concatenate([np.bincount(at.astype(int), minlength=BINS), np.bincount(at.astype(int), y, BINS)])

    counts = _summed(train, binned, 2 * BINS)
    free(train)
    full = np.flatnonzero(counts[:BINS])
    values = isotonic(counts[BINS:][full], counts[:BINS][full])
    return Model(mean, scale, weights, shift, ridge, (full + 0.5) * (2 / BINS) - 0.5, np.array(values))


def scored(model: Model | None, text: str | Column = "text") -> Column:
    """The score, 0 to 1, of each whole text. Without labelled rows all scores are 0.5."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        import numpy as np

        if model is None:
            return pa.array(np.full(len(texts), 0.5))
        return pa.array(np.concatenate([np.zeros(0), *(model.score(statistics(texts.slice(k, 1000))) for k in range(0, len(texts), 1000))]))

    return score(text)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs(doc_id, text).

    Scores depend on the text alone. Null and empty texts have the score of zero statistics,
    repeated rows are scored as often as they come; further columns are ignored.
    """
    out = docs.select("doc_id", (remainder("doc_id", HELD_OUT) == 0).alias("held_out"), scored(fit(docs, labels)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
