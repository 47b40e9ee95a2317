"""Vector codes: product quantisation whose codebooks come of Lloyd rounds with bounds kept for each part."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import given_back, table
from quadrille.plans.stages import free, stored

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Units of a component.
SCALE = 256
#: Integer components up to which squared distances, and their sums over a vector, fit 64 bits.
PEAK = 2**26
STATE = "vec_id long, label string, x array<int>, code binary, upper binary, lower binary"
CODED = "vec_id long, label string, code binary, error long"


def squared(x, centers):
    """Squared distances of the rows of x to all centers, exact: in doubles where they hold them, else in integers."""
    import numpy as np

    small = max(np.abs(x).max(initial=0), np.abs(centers).max(initial=0)) ** 2 * 8 * max(1, x.shape[1]) < 2**53
    a, b = (m.astype(np.float64 if small else np.int64) for m in (x, centers))
    return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)


def above(x):
    """The number as a 32-bit float that is not less."""
    import numpy as np

    return np.nextafter(np.asarray(x).astype(np.float32), np.float32(np.inf))


def below(x):
    """The number as a 32-bit float that is not greater."""
    import numpy as np

    return np.nextafter(np.asarray(x).astype(np.float32), np.float32(-np.inf))


def drifts(old, new):
    """(how far each entry went, how far the others went at most), for one part's codebook."""
    import numpy as np

    moved = np.sqrt(((new - old) ** 2).sum(axis=1).astype(np.float64))
    order = np.argsort(-moved, kind="stable")
    others = np.full(len(moved), moved[order[0]])
    others[order[0]] = moved[order[1]] if len(order) > 1 else 0.0
    return moved, others


def nearest(x, centers, code=None, upper=None, lower=None, old=None):
    """(code, upper, lower, scanned) of one part of many vectors: the nearest entry, ties to the lower index.

    upper is at least the distance to the own entry, lower at most the distance to the second nearest. Where the
    entries have moved from `old`, the bounds are widened by what they moved. Where upper < lower then
    holds strictly (or upper < half the way to the next entry), no other entry is as near. Otherwise upper becomes the
    exact distance; only if the test fails again are all entries scanned, in integers.
    """
    import numpy as np

    if code is None:
        code, upper, lower = np.zeros(len(x), np.uint8), np.full(len(x), np.inf, np.float32), np.zeros(len(x), np.float32)
        open_ = np.arange(len(x))
    else:
        code, upper, lower = code.copy(), upper.copy(), lower.copy()
        moved, others = drifts(old, centers)
        upper, lower = above(upper.astype(np.float64) + moved[code]), below(lower.astype(np.float64) - others[code])
        apart = np.sqrt(squared(centers, centers).astype(np.float64))
        np.fill_diagonal(apart, np.inf)
        bound = np.maximum(lower, below(apart.min(axis=1, initial=np.inf) / 2)[code])
        open_ = np.flatnonzero(~(upper < bound))
        own = ((x[open_] - centers[code[open_]]) ** 2).sum(axis=1)
        upper[open_] = above(np.sqrt(own.astype(np.float64)))
        open_ = open_[~(upper[open_] < bound[open_])]
    if len(open_):
        far = squared(x[open_], centers)
        code[open_] = far.argmin(axis=1)
        upper[open_] = above(np.sqrt(far.min(axis=1).astype(np.float64)))
        two = np.partition(far, 1, axis=1)[:, 1].astype(np.float64) if far.shape[1] > 1 else np.full(len(open_), np.inf)
        lower[open_] = below(np.sqrt(two))
    return code, upper, lower, len(open_)


def _matrix(batch: pa.RecordBatch):
    import numpy as np

    return batch["x"].flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)


def _of_bytes(column: pa.Array, kind):
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _as_bytes(rows) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _assign(df: DataFrame, centers, old, last: bool) -> DataFrame:
    """All parts assigned to the entries of centers[part]; with the bounds of the last round where old is given."""
    import numpy as np

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, parts = _matrix(batch), len(centers)
            if np.abs(x).max(initial=0) > PEAK:
                raise ValueError(f"a component is over {PEAK // SCALE}: squared distances would not fit")
            width = x.shape[1] // parts
            known = None if old is None else [_of_bytes(batch[c], t) for c, t in (("code", np.uint8), ("upper", np.float32), ("lower", np.float32))]
            made = []
            for p in range(parts):
                kept = () if known is None else (*(k[:, p] for k in known), old[p])
                made.append(nearest(x[:, p * width : (p + 1) * width], centers[p], *kept)[:3])
            code, upper, lower = (np.stack(m, axis=1) for m in zip(*made, strict=True))
            if last:
                own = np.concatenate([centers[p][code[:, p]] for p in range(parts)], axis=1)
                columns = [batch["vec_id"], batch["label"], _as_bytes(code), pa.array(((x - own) ** 2).sum(axis=1), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error"])
            else:
                columns = [batch["vec_id"], batch["label"], batch["x"], _as_bytes(code), _as_bytes(upper), _as_bytes(lower)]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "x", "code", "upper", "lower"])

    return df.mapInArrow(assign, CODED if last else STATE)


def _moved(state: DataFrame, centers):
    """The codebooks with each entry at the floor of its parts' mean; an entry without parts stays."""
    import numpy as np

    parts, entries, width = centers.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            if batch.num_rows:
                code, at = _of_bytes(batch["code"], np.uint8), np.arange(parts)[None, :]
                np.add.at(n, (at, code), 1)
                np.add.at(sums, (at, code), _matrix(batch).reshape(len(code), parts, width))
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    each = state.select("x", "code").mapInArrow(add, "part int, entry int, n long, sums array<long>")
    means = each.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
    out = centers.copy()
    for r in means.collect():  # one row for each entry of a codebook
        out[r.part, r.entry] = [s // r.n for s in r.sums]
    return out


def whole(vector: str | Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    col = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return col.isNotNull() & ~F.coalesce(bad, F.lit(True))


def compress(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS):
    """(coded rows, codebooks) of df(vec_id, embedding, label).

    Coded rows: vec_id, label as text, code (one byte a part), error (squared distances to the own entries,
    summed). Codebooks: integers by part, entry, place. Components count in units of 1/SCALE, rounded down. The
    codebooks begin as the parts of the vectors with the smallest vec_ids (a null one comes last; of repeated ids
    the smaller vector comes first); fewer vectors than entries make smaller codebooks.

    Vectors that are null or hold a null or non-finite component are left out, and so are those of another length than most
    have (ties: the longer). A length that parts doesn't divide, or a component over 2^18, is an error. Repeated
    rows count as often as they come; an empty table has no rows and empty codebooks.

    Only sums move: a task sends one row for each entry that it met. The bounds of each part are
    stored with the row that they belong to, so nothing is dealt, and a lost executor costs the tasks that it ran.
    """
    import numpy as np

    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte")
    ints = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    kept = df.filter(whole("embedding")).select("vec_id", F.col("label").cast("string").alias("label"), ints.alias("x"))
    most = kept.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    length = most.n if most else 0
    if length % parts:
        raise ValueError(f"{length} components can't be cut into {parts} equal parts")
    kept = kept.filter(F.size("x") == length)
    if not length:
        return kept.select("vec_id", "label", F.lit("").cast("binary").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    starts = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    centers = np.array([r.x for r in starts], np.int64).reshape(len(starts), parts, -1).transpose(1, 0, 2)
    limited = F.transform("x", lambda v: F.least(F.greatest(v, F.lit(-PEAK - 1)), F.lit(PEAK + 1)).cast("int"))  # beyond PEAK it is an error anyway
    state, old = kept.withColumn("x", limited), None
    for _ in range(rounds):
        before, state = state, stored(_assign(state, centers, old, last=False), "bounds")
        free(before)
        old, centers = centers, _moved(state, centers)
    coded = stored(_assign(state, centers, old, last=True), "codes")
    free(state)
    return coded, centers


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    coded, codebooks = compress(table(spark, sf_dir, "embeddings"))
    numbers = ",".join(str(v) for v in codebooks.ravel().tolist())
    rows = coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", F.col("label").isNull().alias("no"), F.coalesce("label", F.lit("")).alias("label"), F.struct("vec_id", "code").alias("row"))
    sums = rows.groupBy("no", "label").agg(F.sum("error").alias("label_error"))
    return given_back(rows, sums, ["no", "label"], "row").select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(numbers.encode()).hexdigest()).alias("codebooks_sha256"))


def _assigned_sql(entries: str) -> str:
    far = "list_sum(list_transform(list_zip(p.x, e.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    return (
        f"SELECT vec_id, label, part, x, min(d * 64 + e) % 64 AS e, (min(d * 64 + e) - min(d * 64 + e) % 64) // 64 AS d FROM"
        f" (SELECT p.*, e.e, {far}::BIGINT AS d FROM p JOIN {entries} e ON e.part = p.part) GROUP BY vec_id, label, part, x"
    )


def _means_sql(assigned: str, entries: str) -> str:
    return (
        f"SELECT part, e, list(floor(s / n)::BIGINT ORDER BY j) AS c FROM (SELECT part, e, j, sum(v) AS s, count(*) AS n FROM"
        f" (SELECT part, e, unnest(x) AS v, unnest(range(len(x))) AS j FROM {assigned}) GROUP BY part, e, j) GROUP BY part, e"
        f" UNION ALL SELECT part, e, c FROM {entries} WHERE (part, e) NOT IN (SELECT (part, e) FROM {assigned})"
    )


OP11_SQL = f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, part, v[part * len(v) // 16 + 1:(part + 1) * len(v) // 16] AS x FROM k, (SELECT unnest(range(16)) AS part)),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 64)),
a0 AS MATERIALIZED ({_assigned_sql("c0")}), c1 AS MATERIALIZED ({_means_sql("a0", "c0")}),
a1 AS MATERIALIZED ({_assigned_sql("c1")}), c2 AS MATERIALIZED ({_means_sql("a1", "c1")}),
a2 AS MATERIALIZED ({_assigned_sql("c2")}),
b AS (SELECT sha256(string_agg(v, ',' ORDER BY part, e, j)) AS h FROM (SELECT part, e, unnest(c)::VARCHAR AS v, unnest(range(len(c))) AS j FROM c2)),
r AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id, label)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM r, b
"""
