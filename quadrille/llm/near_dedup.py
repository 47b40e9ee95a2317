"""Near-duplicate detection by min-max hashing of word shingles, with links confirmed on full sets."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import flat_words, given_back, table
from quadrille.plans.stages import free, stored

WORDS = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Permutations; each gives a minimum and a maximum, so a signature has twice as many values.
PERMUTATIONS = 144
#: The chance that a pair at the threshold may share no band: 1.06e-5 at 0.85, in bands of 8 values.
MISS = 1.1e-5
#: Bits of each value in the sketch that pairs are first compared by.
SKETCH_BITS = 4
#: Standard deviations by which a sketch may fall short of a link's expected agreement.
SLACK = 4.8
#: Members of a band that are compared with all others of the band in one group.
BLOCK = 2_000


def mixed(x):
    """A bijection of 64-bit numbers that spreads their bits (splitmix64's finaliser)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array):
    """64-bit hashes of all lower-cased words of the texts, and the offsets of each text's words."""
    import numpy as np
    import xxhash

    words, offsets = flat_words(texts)
    named = words.dictionary_encode()
    each = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in named.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(named.dictionary))
    return each[named.indices.to_numpy()], offsets


def shingle_sets(texts: pa.Array, k: int = WORDS) -> list:
    """For each text the sorted distinct hashes of its k-word shingles.

    With fewer words the whole sequence is the only shingle; without words the set is empty.
    """
    import numpy as np

    words, offsets = word_hashes(texts)
    n = len(words)
    rolled = np.zeros(max(0, n - k + 1), np.uint64)
    for i in range(k):
        rolled = mixed(rolled + words[i : n - k + 1 + i] + np.uint64(i + 1)) if len(rolled) else rolled
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            h = np.zeros(1, np.uint64)
            for i in range(a, b):
                h = mixed(h + words[i : i + 1] + np.uint64(i - a + 1))
            out.append(mixed(h + np.uint64(0x5EED + b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list, permutations: int = PERMUTATIONS):
    """Low halves of the minimum and the maximum of each set under each permutation; rows of empty sets are 0."""
    import numpy as np

    out = np.zeros((len(sets), 2 * permutations), np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    sizes = np.array([len(sets[i]) for i in full])
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    every = np.concatenate([sets[i] for i in full])
    rng = np.random.default_rng(20)
    keys = rng.integers(0, 2**64, (permutations, 2), np.uint64)
    low = np.uint64(0xFFFFFFFF)
    for p, (add, times) in enumerate(keys):
        moved = (every ^ add) * (times | np.uint64(1))
        moved ^= moved >> np.uint64(29)
        out[full, 2 * p] = np.minimum.reduceat(moved, begins) & low
        out[full, 2 * p + 1] = np.maximum.reduceat(moved, begins) & low
    return out


def rows_of(percent: int) -> int:
    """Values in a band: as many as leave a pair at the threshold a chance of at most MISS to share no band.

    Two sets of similarity s share no band of r values with (1 - s**r)**(2 * PERMUTATIONS / r). All values
    are used, so r divides their number: 8 (36 bands, 1.06e-5) at 0.85, 6 (48 bands, 5e-7) at 0.80.
    """
    values, s = 2 * PERMUTATIONS, percent / 100
    fit = [r for r in range(1, values + 1) if values % r == 0 and (1 - s**r) ** (values // r) <= MISS]
    if not fit:
        raise ValueError(f"{PERMUTATIONS} permutations can't find pairs of similarity {s}")
    return max(fit)


SIGNED = "doc_id long, row_key long, n_shingles long, digest binary, bands array<long>, sketch array<long>"


def _signed(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    import numpy as np
    import xxhash

    mix = mixed(np.arange(1, rows + 1, dtype=np.uint64))
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            sets = shingle_sets(part["text"])
            sig = signatures(sets)
            bands = mixed((sig.astype(np.uint64).reshape(len(sets), -1, rows) * mix).sum(axis=2) + np.arange(1, sig.shape[1] // rows + 1, dtype=np.uint64))
            bits = np.unpackbits(sig.astype(np.uint8)[:, :, None], axis=2, bitorder="little")[:, :, :SKETCH_BITS].reshape(len(sets), -1)
            sketch = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
            yield pa.RecordBatch.from_arrays([
                part["doc_id"], part["row_key"], pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array(list(bands.view(np.int64)), pa.list_(pa.int64())), pa.array(list(sketch), pa.list_(pa.int64())),
            ], names=["doc_id", "row_key", "n_shingles", "digest", "bands", "sketch"])


def alike(a: str, b: str, percent: int) -> Column:
    """Whether two sketches may be those of a link: by the number of their values that differ in some bit."""
    values, words = 2 * PERMUTATIONS, 2 * PERMUTATIONS * SKETCH_BITS // 64
    same = percent / 100 + (1 - percent / 100) / 2**SKETCH_BITS
    most = int(values * (1 - same + SLACK * math.sqrt(same * (1 - same) / values)))
    mask = F.lit(int("1" * (64 // SKETCH_BITS), 2**SKETCH_BITS))
    differing = F.lit(0)
    for i in range(words):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        any_ = x
        for k in range(1, SKETCH_BITS):
            any_ = any_.bitwiseOR(F.shiftrightunsigned(x, k))
        differing = differing + F.bit_count(any_.bitwiseAND(mask))
    return differing <= most


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of edges(a, b): root is the smallest node that can be reached.

    Each round joins every root to its smallest neighbouring root and shortens the chains that
    arise by doubling, so rounds grow as the logarithm of a component's width. All tables stay
    distributed; each round is written to the shared folder.
    """
    pairs = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    open_ = stored(pairs(edges), "edges")
    labels = stored(open_.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "labels")
    while True:
        parents = stored(open_.groupBy(F.col("b").alias("root")).agg(F.min("a").alias("parent")), "parents")
        if parents.isEmpty():
            free(open_, parents)
            return labels
        while True:
            above = parents.select(F.col("root").alias("parent"), F.col("parent").alias("over"))
            shorter = stored(parents.join(above, "parent", "left").select("root", F.coalesce("over", "parent").alias("parent"), F.col("over").isNotNull().alias("moved")), "parents")
            free(parents)
            parents = shorter
            if parents.filter("moved").isEmpty():
                break
            parents = stored(shorter.drop("moved"), "parents")
            free(shorter)
        renamed = stored(labels.join(parents, "root", "left").select("node", F.coalesce("parent", "root").alias("root")), "labels")
        a = parents.select(F.col("root").alias("a"), F.col("parent").alias("pa"))
        b = parents.select(F.col("root").alias("b"), F.col("parent").alias("pb"))
        left = open_.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"))
        left = stored(pairs(left), "open-edges")
        free(open_, parents, labels)
        labels, open_ = renamed, left


#: Lets Spark drop, by a filter of bounded size, rows of the larger side of a join before they are dealt.
PREFILTER = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "10g",
}


@contextmanager
def session_with(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _confirmed(group: pa.Table, percent: int) -> pa.Table:
    """Of one center's candidates, those whose full sets are similar enough."""
    import numpy as np

    sets = dict(zip(group["node"].to_pylist(), group["set"].to_pylist(), strict=True))
    center = group["center"][0].as_py()
    own = np.frombuffer(sets.get(center, b""), np.uint64)
    found = []
    for node, raw in sets.items():
        if node != center and len(own):
            other = np.frombuffer(raw, np.uint64)
            small, large = (own, other) if len(own) < len(other) else (other, own)
            if 100 * len(small) < percent * len(large):
                continue
            at = np.searchsorted(large, small)
            both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
            if 100 * both >= percent * (len(own) + len(other) - both):
                found.append(node)
    return pa.table({"a": pa.array([center] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})


#: Candidates of one center that a task confirms together.
TOGETHER = 256


def links(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those that full sets confirm. Each pair moves b's set; a's moves once for TOGETHER pairs."""
    counts = near.groupBy("a").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("salts"))
    salted = given_back(near, counts, ["a"], "b").select(F.col("a").alias("center"), F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"), F.col("b").alias("node"))
    centers = counts.select(F.col("a").alias("center"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("node"))
    asked = stored(salted.unionByName(centers), "asked")
    with session_with(near.sparkSession, PREFILTER):  # sets grow with the input: they are dealt by node at every size
        out = stored(
            asked.filter("node >= 0").join(sets.hint("merge"), "node").groupBy("center", "salt")
            .applyInArrow(lambda g: _confirmed(g.select(["center", "node", "set"]), percent), "a long, b long"), "links",
        )
    free(asked)
    return out


#: The owner of a shingle that several nodes of one batch have: these know it, others learn that it is shared.
SEVERAL = 0xFFFF


def shared_mass(sets: DataFrame, buckets: int) -> DataFrame:
    """(node, mass): how many of a node's shingles at least one other node of sets(node, set) has.

    Shingles are dealt to buckets of their hash as packed arrays; a bucket's tasks count, and give
    back sums for the nodes of each batch, by their places in it: the batch's nodes are sent once, and
    a row to a bucket holds at least one shingle, so what is sent grows with the shingles. A shingle that several nodes of a batch have
    counts for them at once and is sent on once, so one that very many nodes have fills no bucket.
    """
    import numpy as np

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["bucket", "batch", "nodes", "keys", "owner", "mass"], (pa.int32(), pa.int64(), *[pa.binary()] * 4)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                raw = [np.frombuffer(s, np.uint64) for s in part["set"].to_pylist()]
                every = np.concatenate(raw)
                owner = np.repeat(np.arange(len(raw), dtype=np.uint16), [len(r) for r in raw])
                keys, first, back, times = np.unique(every, return_index=True, return_inverse=True, return_counts=True)
                known = np.bincount(owner[times[back] > 1], minlength=len(raw)).astype(np.uint32)
                owners = np.where(times > 1, np.uint16(SEVERAL), owner[first])
                bucket = (keys >> np.uint64(33)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                there, begin = np.unique(bucket[order], return_index=True)
                rows = [(int(k), number, None, keys[order[a:b]].tobytes(), owners[order[a:b]].tobytes(), None) for k, a, b in zip(there, begin, [*begin[1:], len(keys)], strict=True)]
                rows.append((int(number % buckets), number, part["node"].to_numpy().tobytes(), b"", b"", known.tobytes()))
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def count(group: pa.Table) -> pa.Table:
        rows = group.select(["batch", "nodes", "keys", "owner", "mass"]).to_pylist()
        out = [(r["batch"], r["nodes"], None, r["mass"]) for r in rows if r["nodes"] is not None]
        rows = [r for r in rows if r["nodes"] is None]
        if rows:
            keys = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in rows])
            place = np.concatenate([np.frombuffer(r["owner"], np.uint16) for r in rows])
            _, back = np.unique(keys, return_inverse=True)
            seen = np.bincount(back, 1 + (place == SEVERAL))
            hit, at = (seen[back] > 1) & (place != SEVERAL), 0
            for r in rows:
                stop = at + len(r["keys"]) // 8
                own, mass = np.unique(place[at:stop][hit[at:stop]], return_counts=True)
                at = stop
                if len(own):
                    out.append((r["batch"], None, own.tobytes(), mass.astype(np.uint32).tobytes()))
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), *[pa.binary()] * 3))], names=["batch", "nodes", "owner", "mass"])

    def add(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        first = next(r for r in rows if r["nodes"] is not None)
        mass = np.frombuffer(first["mass"], np.uint32).astype(np.int64)
        for r in rows:
            if r["nodes"] is None:
                mass[np.frombuffer(r["owner"], np.uint16)] += np.frombuffer(r["mass"], np.uint32)
        return pa.table({"node": pa.array(np.frombuffer(first["nodes"], np.int64)), "mass": pa.array(mass)})

    return (
        sets.mapInArrow(deal, "bucket int, batch long, nodes binary, keys binary, owner binary, mass binary").groupBy("bucket").applyInArrow(count, "batch long, nodes binary, owner binary, mass binary")
        .groupBy("batch").applyInArrow(add, "node long, mass long").groupBy("node").agg(F.sum("mass").alias("mass")).filter("mass > 0")
    )


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs(doc_id, text).

    Rows with equal shingle sets are one class; classes whose signatures share a band are
    candidates, and a candidate pair is linked when its full sets (64-bit hashes of the shingles)
    confirm it. component_id is the smallest doc_id that links reach, of the row itself at least;
    kept tells the row with that doc_id. Repeated rows with one doc_id are one document: all of
    them are kept or none. A null, empty or blank text has an empty set and its own id as
    component. A null doc_id is never a component's id unless it has no other. Further columns
    are ignored.

    A band that many classes share isn't expanded into all pairs. The class that shares most is
    compared with all others first. Where a band then still holds classes of several components, classes
    outside its largest component are compared with classes of other components, if their sizes
    and their shared masses allow a link: a class of n shingles, m of which occur in other classes
    of such bands, has at most similarity m / (n + n2 - m) with a class of n2. So heavily edited
    copies, which link with nothing, meet next to no others, and no link between two classes of
    one band is lost. Pairs are compared by sketches within the join, before any row is made.
    """

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seen: set[int] = set()  # of repeated rows one is enough
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                fresh = [n not in seen and not seen.add(n) for n in part["node"].to_pylist()]
                part = part.filter(pa.array(fresh, pa.bool_()))
                made = [s.tobytes() for s in shingle_sets(part["text"])]
                same = pa.array([xxhash.xxh3_128_digest(s) == d for s, d in zip(made, part["digest"].to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part["node"], pa.array(made, pa.binary())], names=["node", "set"]).filter(same)

    spark, key, width = docs.sparkSession, F.xxhash64("doc_id", "text").alias("row_key"), rows_of(percent)
    signed = stored(docs.select("doc_id", "text", key).mapInArrow(lambda batches: _signed(batches, width), SIGNED).withColumn("row_id", F.monotonically_increasing_id()), "signed")
    # a class moves with one row's bands and sketch; nothing wide is dealt again but for nodes that share a band
    look = F.min_by(F.struct("row_key", "n_shingles", "bands", "sketch"), "row_id").alias("look")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_id")).alias("first")
    classes = stored(
        signed.filter("digest IS NOT NULL").groupBy("digest").agg(first, F.count("*").alias("n"), look)
        .select(F.col("first.row_id").alias("node"), F.col("first.doc_id").alias("doc_id"), "digest", "n", "look.*"), "classes",
    )
    bands = classes.select("node", F.explode("bands").alias("band"))
    shared = stored(bands.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"), "shared-bands")
    members = stored(bands.join(shared.hint("merge"), "band"), "members")
    with session_with(spark, PREFILTER):
        weights = stored(members.groupBy("node").agg(F.sum("n").alias("weight")), "weights")
        nodes = stored(classes.join(weights.filter("weight > 0").select("node"), "node", "left_semi").select("node", "row_key", "digest", "n_shingles", "bands", "sketch"), "nodes")
        wanted = nodes.filter("row_key IS NOT NULL AND node >= 0").select("row_key", "node", "digest")
        sets = stored(docs.select(key, "text").join(wanted, "row_key").mapInArrow(sets_of, "node long, set binary"), "sets")
    # a band's center is the class that shares most with others: of edited copies, the least edited one
    centers = members.join(weights, "node").groupBy("band").agg(F.max(F.struct("weight", "node")).alias("top")).select("band", F.col("top.node").alias("center"))

    looks = nodes.select("node", F.col("n_shingles").alias("size"), "sketch")
    size_fits = (100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b"))
    side = lambda x: looks.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    # a band, and a center, may have any part of the members: what they have in common comes back to them in parts
    star = given_back(members, centers, ["band"], "node").filter("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    star = given_back(star.join(side("b"), "b"), side("a"), ["a"], "b")
    near = stored(star.filter(size_fits & alike("sketch_a", "sketch_b", percent)).select("a", "b"), "near-pairs")
    found = links(near, sets, percent)
    labels = components(found)
    free(shared, weights, near)

    # bands with classes of several components, and their members outside the largest one
    placed = stored(members.select("band", "node").join(labels, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root")), "placed")
    sizes = placed.groupBy("band", "root").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("band").agg(F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("roots"), F.sum("n").alias("n")).filter("roots > 1 AND n > 2").select("band", F.col("top.root").alias("top"), "n")
    open_ = stored(placed.join(largest, "band"), "open-bands")
    some = stored(open_.select("node").distinct(), "open-nodes")
    with session_with(spark, PREFILTER):
        mass = stored(shared_mass(sets.join(some.filter("node >= 0"), "node", "left_semi"), some.count() // 2000 + 1), "shared-mass")
    # the largest partner that the shared mass allows; one that is too small for the class itself rules it out
    limit = F.floor(F.col("mass") * (100 + percent) / percent - F.col("n_shingles") + 1e-6)
    able = stored(
        nodes.join(mass, "node").withColumn("limit", limit.cast("long")).filter(100 * F.col("limit") >= percent * F.col("n_shingles"))
        .select("node", F.col("n_shingles").alias("size"), "limit", "sketch", F.transform("bands", lambda x: F.pmod(x, F.lit(2147483647)).cast("int")).alias("bands")), "able",
    )
    # a band of many members is cut into blocks; each block meets all members in a group of its own
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = open_.join(able, "node")
    mine = rows.filter("root <> top").withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    others = rows.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    one = lambda x, df: df.select("band", "block", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "root", "size", "limit", "sketch", "bands")])
    # a pair is made in the first band that both share, counted from the front
    first_band = F.expr("array_position(zip_with(bands_a, bands_b, (x, y) -> x = y), true) = array_position(bands_a, CAST(pmod(band, 2147483647L) AS INT))")
    both = one("a", mine).join(one("b", others), ["band", "block"]).filter(
        (F.col("root_a") != F.col("root_b")) & (F.col("size_b") <= F.col("limit_a")) & (F.col("size_a") <= F.col("limit_b")) & size_fits
        & alike("sketch_a", "sketch_b", percent) & first_band
    )
    near = stored(both.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct(), "near-pairs")
    more = links(near, sets, percent)
    if not more.isEmpty():
        old, labels = labels, components(found.unionByName(more))
        free(old)
    free(members, nodes, sets, placed, open_, some, mass, able, near, found, more)

    smallest = classes.select("digest", "n", "node", "doc_id").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    roots = smallest.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.sum("n").alias("rows")).filter("rows > 1").drop("rows")
    named = stored(smallest.join(roots, "root").select("digest", "component_id"), "named")
    free(classes, labels)
    rows = given_back(signed.select("doc_id", "n_shingles", "digest", "row_id"), named, ["digest"], "row_id")
    return rows.select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("component_id").eqNullSafe(F.col("doc_id")) | F.col("component_id").isNull(), F.lit(True)).alias("kept"),
    )


def op7_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] ELSE [array_to_string(w, ' ')] END) AS x FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS c FROM d UNION SELECT e.b, r.c FROM r JOIN e ON r.v = e.a)
SELECT v AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(c) AS component_id, v = min(c) AS kept FROM r LEFT JOIN n ON n.doc_id = v GROUP BY v
"""
