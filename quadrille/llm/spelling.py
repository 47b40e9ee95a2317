"""Spelling variants: words one edit apart, met by bands of letter-parity masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import table
from quadrille.plans.stages import free, stored

#: Code points and occurrences of a word, at least, and how many times as frequent its form is.
LEAST, OCCURS, TIMES = 7, 2, 10
#: One run in so many loses a letter, by the contract of the query.
LOSES = 31
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters in the order in which bands take them in turn: frequent ones first, so that each band tells words apart.
DEALT = "etaoinshrdlcumwfgypbvkjxqz"
#: Bits of a mask: those of DEALT, then all other characters by their code points.
BITS = 63
BANDS = [sum(1 << bit for bit in range(BITS) if bit % 3 == b) for b in range(3)]


def runs(docs: DataFrame, least: int = LEAST, loses: int = LOSES) -> DataFrame:
    """word of each run of letters of docs(doc_id, text) that has at least `least` code points; A-Z are lower-cased.

    Where `loses` divides the crc32 of "<doc_id>:<run>", the run has lost the code point at that number modulo its
    length. A null text has no runs, a null doc_id counts as an empty one, repeated rows count as often as they
    come. Further columns are ignored.
    """
    found = F.regexp_extract_all("text", F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least},}}"), F.lit(0))  # a match ends where its run ends
    rows = docs.select("doc_id", F.explode(found).alias("run")).select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    rows = rows.withColumn("h", F.crc32(named.cast("binary"))).withColumn("at", (F.col("h") % F.char_length("run")).cast("int"))
    short = F.expr("concat(substring(run, 1, at), substring(run, at + 2))")
    return rows.select(F.when(F.col("h") % loses == 0, short).otherwise(F.col("run")).alias("word")).filter(F.char_length("word") >= least)


def counted(words: DataFrame, occurs: int = OCCURS) -> DataFrame:
    """(word, n) of the distinct words that occur often enough; tasks count before words move."""
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= occurs)


def parity(word: str) -> Column:
    """A bit for each letter, set where the word has the letter an odd number of times. One edit flips at most two bits."""

    def bit(c: Column) -> Column:
        at = F.instr(F.lit(DEALT), c)
        place = F.when(at > 0, at - 1).otherwise(len(DEALT) + F.ascii(c) % (BITS - len(DEALT)))
        return F.when(c == "", F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int")))

    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda acc, c: acc.bitwiseXOR(bit(c)))


def _half(word: str | Column, side: int, length: Column) -> Column:
    word, n = F.col(word) if isinstance(word, str) else word, F.floor(length / 2).cast("int")
    return F.left(word, n) if side == 0 else F.right(word, n)


def _keys(words: DataFrame, lengths: list[Column]) -> DataFrame:
    """A row for each band and half of each word, and each length of the shorter word of a pair."""
    keys = [
        F.struct(F.lit(2 * b + side).alias("k"), F.xxhash64(F.lit(2 * b + side), length, F.col("mask").bitwiseAND(F.lit(band)), _half("word", side, length)).alias("key"))
        for length in lengths for b, band in enumerate(BANDS) for side in (0, 1)
    ]
    return words.select("word", "mask", F.explode(F.array(*keys)).alias("at")).select("word", "mask", "at.*")


def one_edit_apart(words: DataFrame) -> DataFrame:
    """(a, b) of the distinct words(word) that differ by one inserted, deleted or replaced code point; each pair once.

    At most two bits of the masks differ, so one of three bands is equal; the edit is in one half of the shorter word's
    length, so the words begin or end alike. Words meet by the hash of an equal band, the equal half and the shorter length:
    frequent bands alone would hold a part of all words, and pairs would grow with its square. The masks are compared
    first, then the words themselves.
    """
    known = words.select("word", parity("word").alias("mask"))
    length = F.char_length("word")
    left = _keys(known, [length]).select("k", "key", F.col("word").alias("a"), F.col("mask").alias("mask_a"))
    right = _keys(known, [length, length - 1]).select("k", "key", F.col("word").alias("b"), F.col("mask").alias("mask_b"))
    flipped = F.col("mask_a").bitwiseXOR(F.col("mask_b"))
    first = F.when(flipped.bitwiseAND(F.lit(BANDS[0])) == 0, 0).when(flipped.bitwiseAND(F.lit(BANDS[1])) == 0, 2).otherwise(4)
    least, more = F.char_length("a"), F.char_length("b") - F.char_length("a")
    alike = [_half("a", side, least) == _half("b", side, least) for side in (0, 1)]
    # a pair is made once: by its first equal band, and by its beginning if that is equal
    once = F.when(alike[0], F.col("k") == first).otherwise(alike[1] & (F.col("k") == first + 1))
    near = left.join(right, ["k", "key"]).filter(
        (F.bit_count(flipped) <= 2) & ((more == 1) | ((more == 0) & (F.col("a") < F.col("b")))) & once & (F.levenshtein("a", "b", 1) == 1)
    )
    return near.select("a", "b")


def groups(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of the distinct words(word, n).

    n_near counts the words one edit apart. form is the one of them with the largest n, the smallest in code-point
    order among equals, if its n is at least `times` that of the word; form_n is its n. root follows forms to
    the last. As n grows at each step, forms make no cycle; paths are doubled until none grows. An empty table has no rows.
    """
    words = stored(words.select("word", "n"), "words")
    pairs = stored(one_edit_apart(words), "one-edit")
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other")), F.struct(F.col("b").alias("word"), F.col("a").alias("other")))).alias("p")).select("p.*")
    others = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = both.join(others, "other").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))).alias("best"))
    known = words.join(best, "word", "left")
    is_form = -F.col("best.n") >= times * F.col("n")
    known = stored(
        known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n")),
        "forms",
    )
    free(words, pairs)
    paths = stored(known.filter("form IS NOT NULL").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "paths")
    while not paths.filter("moved").isEmpty():
        ahead = paths.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = stored(paths.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "paths")
        free(paths)
        paths = longer
    roots = paths.select("word", "root")
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return groups(counted(runs(table(spark, sf_dir, "documents"))))


OP12_SQL = rf"""
WITH RECURSIVE t AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{UPPER}', '{LOWER}') AS run FROM documents),
u AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY ALL),
y AS (SELECT run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, ord(c)::BIGINT - 64] END)) AS bytes FROM u),
h AS (SELECT run, n, xor(list_reduce(bytes, lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM y, t),
w AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM h)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
e AS (SELECT a.word AS word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN w b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM cut a JOIN w b ON a.rest = b.word),
x AS (SELECT word, count(*) AS n_near, max(other_n) AS best_n FROM e GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * w.n THEN best_n END AS form_n,
  CASE WHEN best_n >= 10 * w.n THEN (SELECT min(other) FROM e WHERE e.word = w.word AND other_n = best_n) END AS form FROM w LEFT JOIN x ON x.word = w.word),
s AS (SELECT word, word AS at FROM f UNION ALL SELECT s.word, f.form FROM s JOIN f ON f.word = s.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, s.at AS root, f.n, f.n_near, f.form_n FROM f JOIN s ON s.word = f.word JOIN f l ON l.word = s.at AND l.form IS NULL
"""
