"""Exact top-k inner-product search by multi-resolution segment statistics."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadrille.llm.common import table

TOP = 5
#: Segments of each resolution, coarse to fine.
LEVELS = (4, 16)
#: Rows of a block of candidates and of a block of queries, about.
CANDIDATES, QUERIES = 16_384, 2_048


def summary(x, segments: int):
    """Means (times the root of the length) and deviations of each segment.

    The products of two summaries are at least the inner product of the vectors: a segment gives
    length * mean * mean, plus at most deviation * deviation, which turns the lower-bound
    distance of the two into an upper-bound score.
    """
    import numpy as np

    out = []
    for part in np.array_split(x, min(segments, x.shape[1]), axis=1):
        mean = part.mean(axis=1, keepdims=True)
        out += [mean * part.shape[1] ** 0.5, np.sqrt(((part - mean) ** 2).sum(axis=1, keepdims=True))]
    return np.hstack(out)


#: Products of two norms from which a double may not hold a score.
WIDE = 2.0**52
LONG = 2**63


def by_variance(q, c):
    """Both with their places in the order of the candidates' variance: segments then hold places that vary alike. Products stay."""
    import numpy as np

    order = np.argsort(-c.var(axis=0), kind="stable")
    return q[:, order], c[:, order]


def survivors(q, c, k: int, own, norms, levels=LEVELS):
    """(pairs that may be among the k best, the bound that each query's k best reach): coarse segments rule out candidates before fine ones are asked."""
    import numpy as np

    slack = 1 + 1e-9 * np.sqrt((q**2).sum(axis=1))[:, None] * norms[None, :]  # rounding of the bounds
    bound = summary(q, levels[0]) @ c[levels[0]].T + slack
    bound[own] = -np.inf
    floor = np.full(bound.shape[0], -np.inf)
    if bound.shape[1] > k:  # exact scores of the k highest bounds: the k-th best is no less
        first = np.argpartition(-bound, k - 1, axis=1)[:, :k]
        exact = np.einsum("ijk,ik->ij", c["all"][first], q)
        exact[np.take_along_axis(own, first, axis=1)] = -np.inf
        floor = exact.min(axis=1)
    alive = (bound >= floor[:, None]) & ~own
    for n in levels[1:]:
        some = np.flatnonzero(alive.any(axis=0))
        alive[:, some] &= summary(q, n) @ c[n][some].T + slack[:, some] >= floor[:, None]
    return alive


def best(q, c, c_ids, q_ids, k: int, levels=LEVELS, chunk: int = 128):
    """(query's place, candidate's place, score) of each query's k best in the block of candidates.

    Scores are whole numbers: those that a double holds come from it, others from Python's integers.
    """
    import numpy as np

    if not len(c):
        return
    most = np.abs(c).max(axis=1) * c.shape[1] ** 0.5  # no less than the norms, and safe from overflow
    reach = (np.abs(q).max() if len(q) else 0.0) * c.shape[1] ** 0.5
    with np.errstate(over="ignore"):
        holds = most * reach < WIDE
    wide, plain = np.flatnonzero(~holds), np.flatnonzero(holds)
    q2, c2 = by_variance(q, c[plain]) if len(plain) else (q, c[plain])
    norms = np.sqrt((c2**2).sum(axis=1))
    levelled = {"all": c2} | {n: summary(c2, n) for n in levels} if len(plain) else {}
    whole = [[int(x) for x in row] for row in c[wide]]
    for at in range(0, len(q), chunk):
        rows = slice(at, at + chunk)
        hits: list[list[tuple]] = [[] for _ in range(len(q[rows]))]
        if len(plain):
            own = q_ids[rows, None] == c_ids[plain][None, :]
            alive = survivors(q2[rows], levelled, k, own, norms, levels)
            i, j = np.nonzero(alive)
            if len(i) * 4 < alive.size:  # few pairs are left: each is scored alone
                scores = np.concatenate([np.einsum("ij,ij->i", q2[rows][i[a : a + 65536]], c2[j[a : a + 65536]]) for a in range(0, len(i), 65536)] or [np.zeros(0)])
            else:
                scores = (q2[rows] @ c2.T)[i, j]
            ends = np.searchsorted(i, np.arange(len(alive) + 1))
            for n, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                line, where = scores[a:b], j[a:b]
                if len(line) > k:
                    near = line >= np.partition(line, len(line) - k)[len(line) - k]
                    line, where = line[near], where[near]
                hits[n] += [(-int(x), c_ids[plain[w]], plain[w]) for x, w in zip(line, where, strict=True)]
        for n, query in enumerate(q[rows] if len(wide) else ()):
            own_row = [int(x) for x in query]
            hits[n] += [(-max(-LONG, min(LONG - 1, sum(x * y for x, y in zip(own_row, row, strict=True)))), c_ids[w], w) for w, row in zip(wide, whole, strict=True) if c_ids[w] != q_ids[at + n]]
        for n, found in enumerate(hits):
            for score, _, where in sorted(found)[:k]:
                yield at + n, where, -score


def search_block(block: pa.Table, k: int) -> pa.Table:
    import numpy as np

    ids = block["vec_id"].to_numpy()
    dim = block["dim"][0].as_py()
    vectors = block["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(float)
    asks = block["is_query"].to_numpy(zero_copy_only=False)
    q_at, c_at = np.flatnonzero(asks), np.flatnonzero(~asks)
    hits = list(best(vectors[q_at], vectors[c_at], ids[c_at], ids[q_at], k)) if len(q_at) and len(c_at) else []
    qs, cs, scores = zip(*hits, strict=True) if hits else ((), (), ())
    picked = q_at[np.array(qs, dtype=int)]
    return pa.table({
        "query_id": pa.array(ids[picked], pa.int64()),
        "query_row": pa.array(block["row_hash"].to_numpy()[picked], pa.int64()),
        "vec_id": pa.array(ids[c_at[np.array(cs, dtype=int)]], pa.int64()),
        "score": pa.array(list(scores), pa.int64()),
    })


def top_k(df: DataFrame, queries, k: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products.

    df(vec_id, embedding); queries: the column that tells which rows are queries. Components are
    floor(256 * x). A vector that is null, empty, holds a null or a non-finite component, or has a
    null vec_id takes no part; only vectors of equal length are compared. Candidates are all rows
    but those with the query's vec_id; a candidate row that comes twice counts twice, equal query
    rows are one query. Ties go to the smaller vec_id. Scores are exact for all finite components (256 times
    one must be finite too, else the vector takes no part); one beyond a long is the nearest long.

    The query set meets all rows in blocks of bounded size, dealt by hashes: each pair of blocks is
    one group, and gives k rows for each of its queries. Segments bound the scores from above; what
    they rule out depends on the vectors: nearly nothing for independent places of like variance.
    """
    n, asks = df.agg(F.count("*"), F.count_if(queries)).first()
    c_blocks, q_blocks = max(1, -(-n // CANDIDATES)), max(1, -(-asks // QUERIES))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * 256) == float("inf")))
    scaled = lambda x: x.cast("double") * 256
    rows = (
        df.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad)
        .select("vec_id", F.size("embedding").alias("dim"), queries.alias("is_query"),
                F.transform("embedding", lambda x: F.when(F.abs(scaled(x)) < WIDE, F.floor(scaled(x)).cast("double")).otherwise(scaled(x))).alias("vector"))
        .withColumn("row_hash", F.xxhash64("vec_id", "vector"))
    )
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n: F.pmod("row_hash", F.lit(n)).cast("int")
    columns = ["dim", "q_block", "c_block", "vec_id", "row_hash", "is_query", "vector"]
    asked = rows.filter("is_query").dropDuplicates(["vec_id", "row_hash"]).withColumn("q_block", deal(q_blocks)).withColumn("c_block", every(c_blocks))
    given = rows.withColumn("is_query", F.lit(False)).withColumn("c_block", F.pmod(F.xxhash64("row_hash", F.monotonically_increasing_id()), F.lit(c_blocks)).cast("int")).withColumn("q_block", every(q_blocks))
    found = (
        asked.select(columns).unionByName(given.select(columns)).groupBy("dim", "q_block", "c_block")
        .applyInArrow(lambda block: search_block(block, k), "query_id long, query_row long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_exact_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP5_SQL = """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
