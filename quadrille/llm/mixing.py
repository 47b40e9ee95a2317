"""Mixing to target weights: learned domain posteriors and projected-gradient rates, in DataFrame functions only."""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import table
from quadrille.plans.stages import free, stored

DOMAINS = ("clean", "low", "toxic")
WEIGHTS = {"clean": 0.90, "low": 0.07, "toxic": 0.03}
#: Labelled rows that the classifier learns from at most (those with the smallest hashes of their ids).
LABELLED = 20_000
#: Telling words of each domain.
LEXICON = 150
#: How much likelier a telling word must be in its domain than in the others: weaker ones add up by chance in long texts.
LEAST_ODDS = 30
#: Rounds of the projected gradient, and the part of the total by which targets may be missed.
ROUNDS, NEAR = 60, 1e-6
#: A domain with a smaller share of the tokens than this counts as absent.
LEAST_SHARE = 1e-9


def domain_of(quality: str = "quality", toxic: str = "toxic") -> Column:
    return F.when(F.col(toxic) == 1, "toxic").when(F.col(quality) == 0, "low").when(F.col(quality) == 1, "clean")


def words_of(text: str | Column) -> Column:
    col = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.filter(F.split(F.lower(col), r"[\s.,]+"), lambda w: w != "")


def shapes(text: str | Column, words: Column) -> Column:
    """Classes of a text's make-up, as words that no text has: shares of marks, of capitals and of distinct words."""
    col = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    size = F.greatest(F.length(col), F.lit(1))
    share = lambda drop: (F.length(col) - F.length(F.translate(col, drop, ""))) / size
    step = lambda name, x, n: F.concat(F.lit(f" {name} "), F.floor(F.least(x, F.lit(0.999)) * n).cast("string"))
    return F.array(
        step("marks", share("!?#$%&*|+<=>@^_~"), 25),
        step("capitals", share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), 10),
        step("distinct", F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1)), 10),
    )


@dataclass(frozen=True)
class Classifier:
    prior: list[float]
    lexicon: dict[str, list[str]]  # telling words by domain; a word tells of one domain only
    classes: dict[str, list[float]]  # log-probability of each class of make-up in each domain

    def make_up(self, text: str, words: Column) -> Column:
        """The text's classes: shapes, and for each domain the magnitude of its telling words' number in the text.

        All words meet the lexicons once, as one set; what they have in common is short. A number above
        all that the labelled rows have falls into their highest class.
        """
        if not any(self.lexicon.values()):
            return shapes(text, words)
        every = F.array(*[F.lit(w) for own in self.lexicon.values() for w in own])

        def hits(told: Column, d: str) -> Column:
            own = F.array(*[F.lit(w) for w in self.lexicon[d]])
            size = F.ceil(F.log2(F.size(F.array_intersect(told, own)) + F.lit(1.0))).cast("int")
            top = [int(k.rsplit(" ", 1)[1]) for k in self.classes if k.startswith(f" {d} ")]
            return F.concat(F.lit(f" {d} "), (F.least(size, F.lit(max(top))) if top else size).cast("string"))

        # an array of one element binds what was told once
        found = F.transform(F.array(F.array_intersect(words, every)), lambda told: F.array(*[hits(told, d) for d, own in self.lexicon.items() if own]))[0]
        return F.concat(shapes(text, words), found)

    def posteriors(self, text: str, words: Column) -> Column:
        """The text's posterior of each domain, as a struct: naive Bayes over the classes of its make-up."""
        logs = F.struct(*[F.lit(float(p)).alias(d) for d, p in zip(DOMAINS, self.prior, strict=True)])
        if self.classes:
            of = F.create_map(*[x for w, v in self.classes.items() for x in (F.lit(w), F.array(*[F.lit(float(o)) for o in v]))])
            known = F.filter(F.transform(self.make_up(text, words), lambda c: F.try_element_at(of, c)), lambda v: v.isNotNull())
            logs = F.aggregate(known, logs, lambda s, v: F.struct(*[(s[d] + v[i]).alias(d) for i, d in enumerate(DOMAINS)]))
        top = lambda s: F.greatest(*[s[d] for d in DOMAINS])
        # an array of one element binds the sums once
        return F.transform(F.array(logs), lambda s: F.struct(*[(F.exp(s[d] - top(s)) / sum((F.exp(s[e] - top(s)) for e in DOMAINS), F.lit(0.0))).alias(d) for d in DOMAINS]))[0]


def _counted(rows: DataFrame, values: Column) -> DataFrame:
    """(value, n of each domain): rows(domain, ...) that have each of the values."""
    return rows.select("domain", F.explode(values).alias("value")).groupBy("value").agg(*[F.count(F.when(F.col("domain") == d, 1)).alias(d) for d in DOMAINS])


def fit_classifier(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> Classifier:
    """Learns from at most `bound` labelled rows; counts are summed by Spark.

    A domain's telling words are those with the largest (rows with the word) times log-odds
    against the other domains, among those in one row of 100 that are LEAST_ODDS times likelier
    there; the clean domain has none. Without labelled rows all texts are clean.
    """
    known = labels.select("doc_id", domain_of().alias("domain")).filter("doc_id IS NOT NULL AND domain IS NOT NULL")
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(bound)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # bound rows of an id and a short name
    words = words_of("text")
    seen = stored(rows.select("domain", "text", words.alias("words")), "labelled")
    totals = dict(seen.groupBy("domain").count().collect())
    n = [totals.get(d, 0) for d in DOMAINS]
    whole = sum(n)
    if not whole:
        return Classifier([0.0, -50.0, -50.0], {}, {})
    counts = stored(_counted(seen, F.array_distinct("words")), "word-counts")
    lexicon: dict[str, list[str]] = {}
    for i, d in enumerate(DOMAINS[1:], 1):
        others = sum((F.col(e) for e in DOMAINS if e != d), F.lit(0))
        odds = F.log((F.col(d) + 0.5) / (n[i] + 1)) - F.log((others + 0.5) / (whole - n[i] + 1))
        telling = counts.filter((F.col(d) * 100 >= n[i]) & (F.col(d) >= 3) & (odds > math.log(LEAST_ODDS)))
        lexicon[d] = [r["value"] for r in telling.orderBy(F.desc(F.col(d) * odds), "value").limit(LEXICON).collect()]
    draft = Classifier([], lexicon, {})
    classes = {r["value"]: [math.log((r[d] + 0.5) / (n[i] + 5)) for i, d in enumerate(DOMAINS)] for r in _counted(seen, draft.make_up("text", F.col("words"))).collect()}
    free(seen, counts)
    return Classifier([math.log((x + 0.5) / (whole + 1.5)) for x in n], lexicon, classes)


def solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """The solution of a small linear system, by elimination with pivots."""
    rows = [[*r, b] for r, b in zip(matrix, right, strict=True)]
    n = len(rows)
    for i in range(n):
        p = max(range(i, n), key=lambda k: abs(rows[k][i]))
        rows[i], rows[p] = rows[p], rows[i]
        for k in range(n):
            if k != i and rows[i][i]:
                f = rows[k][i] / rows[i][i]
                rows[k] = [x - f * y for x, y in zip(rows[k], rows[i], strict=True)]
    return [rows[i][n] / rows[i][i] if rows[i][i] else 0.0 for i in range(n)]


def rate_of(steps: list[list[float]], repeat: bool = True) -> Column:
    """A row's rate after the steps: from 1, each takes off the posteriors' part of it and stops at 0 (without repeat, at 1 as well)."""
    if not steps:
        return F.lit(1.0)
    history = F.array(*[F.array(*[F.lit(x) for x in s]) for s in steps])
    high = (lambda x: x) if repeat else (lambda x: F.least(F.lit(1.0), x))
    return F.aggregate(history, F.lit(1.0), lambda r, s: high(F.greatest(F.lit(0.0), r - sum((F.col(f"p_{d}") * s[i] for i, d in enumerate(DOMAINS)), F.lit(0.0)))))


def fit_rates(rows: DataFrame, weights: Mapping[str, float], repeat: bool = True) -> tuple[list[list[float]], dict[str, float], dict[str, float]]:
    """(steps, targets, reached) for rows(tokens, p_...): rates r >= 0 with sums of r * tokens * p at the targets.

    The total is that at which the first domain's tokens all stay; a domain that has less than its
    target is repeated, or without `repeat` keeps what it has, and no rate is over 1. Domains without tokens can't be in the mix: the others share their weight. Each
    round sums the present totals over all rows, and steps along the gradient of their squared distance
    from the targets, in the metric of the domains' moments (sums of tokens * p * p) in which a step of
    1 is right. A round's state is the list of steps, some numbers a round; a row's rate follows from it.
    Where no rates meet the targets (all rows alike, say) the nearest found are given, with a warning.
    """
    p = [F.col(f"p_{d}") for d in DOMAINS]
    moments = rows.agg(
        *[F.sum(F.col("tokens") * x).alias(f"t{i}") for i, x in enumerate(p)],
        *[F.sum(F.col("tokens") * p[i] * p[j]).alias(f"m{i}{j}") for i in range(len(p)) for j in range(i, len(p))],
    ).first()
    now = [moments[f"t{i}"] or 0.0 for i in range(len(p))]
    total = sum(now)
    if not total:
        return [], dict.fromkeys(DOMAINS, 0.0), dict.fromkeys(DOMAINS, 0.0)
    shares = [weights[d] if t > LEAST_SHARE * total else 0.0 for d, t in zip(DOMAINS, now, strict=True)]
    whole = now[0] / shares[0] * sum(shares) if shares[0] else total
    targets = [s / sum(shares) * whole for s in shares]
    if not repeat:
        targets = [min(x, t) for x, t in zip(targets, now, strict=True)]
    matrix = [[(moments[f"m{min(i, j)}{max(i, j)}"] or 0.0) + (1e-9 * total if i == j else 0) for j in range(len(p))] for i in range(len(p))]
    steps: list[list[float]] = []
    best: list[list[float]] = []
    reached, least = now, max(abs(a - b) for a, b in zip(now, targets, strict=True))
    nearest = now
    while least > NEAR * whole and len(steps) < (ROUNDS if repeat else 8):
        steps.append(solve(matrix, [a - b for a, b in zip(reached, targets, strict=True)]))
        got = rows.select("tokens", *[f"p_{d}" for d in DOMAINS], rate_of(steps, repeat).alias("rate")).agg(*[F.sum(F.col("rate") * F.col("tokens") * x) for x in p]).first()
        reached = [x or 0.0 for x in got]
        if (gap := max(abs(a - b) for a, b in zip(reached, targets, strict=True))) < least:
            least, best, nearest = gap, [*steps], reached
    if least > (NEAR if repeat else 0.02) * whole:  # with all rates at 1 at most, soft rows leave a small gap
        warnings.warn(f"the mix misses its targets {targets} by {least:.3g} of {whole:.6g} tokens: {nearest}", stacklevel=2)
    return best, dict(zip(DOMAINS, targets, strict=True)), dict(zip(DOMAINS, nearest, strict=True))


def measured(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """docs with tokens and the posteriors p_clean, p_low, p_toxic."""
    words = words_of("text")
    out = docs.withColumn("__words", words).withColumn("__p", classifier.posteriors("text", F.col("__words"))).withColumn("__n", F.size("__words"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("__n").cast("long").alias("tokens"), *[F.col("__p")[d].alias(f"p_{d}") for d in DOMAINS])


def copies_of(rate: str = "rate") -> Column:
    """How often a row is drawn: its rate rounded down, and once more with the probability of the rest, by a
    hash of the id: the same in every run, and the rate on average."""
    draw = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("mix")), 11).cast("double") + 0.5) * 2.0**-53
    whole = F.floor(F.col(rate))
    return (whole + (draw < F.col(rate) - whole).cast("int")).cast("int")


def mix(docs: DataFrame, labels: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """doc_id, tokens, p_clean, p_low, p_toxic, rate, copies of each row of docs(doc_id, text).

    Sums of copies * tokens * p are expected at the targets: a rate over 1 means more than one copy.
    A null or empty text has no tokens: its rate follows from the prior and moves no total.
    Repeated rows each have their rate, and are kept or left out together. Labels that are null or
    neither 0 nor 1 teach nothing; further columns are ignored.
    """
    rows = stored(measured(docs.select("doc_id", "text"), fit_classifier(docs, labels)).drop("text"), "posteriors")
    steps, _, _ = fit_rates(rows, weights)
    return rows.withColumn("rate", rate_of(steps)).withColumn("copies", copies_of())


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
