"""Fixpoints over DataFrames: transitive closure and Horn rules, by semi-naive rounds."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.plans.stages import Rounds, free, stored


def transitive_closure(edges: DataFrame, by: Sequence[str] = (), reflexive: bool = False) -> DataFrame:
    """Pairs (a, b) with a path of one or more edges from a to b; a set, safe on cycles.

    `by`: columns whose values keep closures apart, as the property of each edge. With reflexive,
    each node of the edges also reaches itself. Rounds double the path length: the pairs found
    last are joined with all pairs known, so a chain of n edges takes log2(n) rounds.
    """
    key = [*by, "a", "b"]
    base = edges.select(*key).filter("a IS NOT NULL AND b IS NOT NULL").distinct()
    if reflexive:
        nodes = base.select(*by, F.explode(F.array("a", "b")).alias("a")).distinct()
        base = base.unionByName(nodes.withColumn("b", F.col("a"))).distinct()
    rounds = Rounds(base, "closure")
    while True:
        known = rounds.all()
        ahead = known.select(*by, F.col("a").alias("b"), F.col("b").alias("__c"))
        if rounds.add(rounds.last().join(ahead, [*by, "b"]).select(*by, "a", F.col("__c").alias("b")).distinct().join(known, key, "left_anti")).isEmpty():
            return known


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Pairs (a, b): what each of seeds(a) reaches by one or more edges. A search from the seeds: only pairs of
    the result are ever made, one round for each step of distance, each written once."""
    links = stored(edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL").distinct(), "links")
    step = links.select(F.col("a").alias("b"), F.col("b").alias("__c"))
    rounds = Rounds(links.join(seeds.select("a").distinct(), "a", "left_semi"), "reached")
    while True:
        known = rounds.all()
        if rounds.add(rounds.last().join(step, "b").select("a", F.col("__c").alias("b")).distinct().join(known, ["a", "b"], "left_anti")).isEmpty():
            free(links)
            return known


def bounded_paths(edges: DataFrame, least: int, most: int) -> DataFrame:
    """Pairs (a, b) with a path of `least` to `most` edges, as a set. least 0 includes each node itself."""
    base = edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL").distinct()
    step, out = None, []
    if least == 0:
        nodes = base.select(F.explode(F.array("a", "b")).alias("a")).distinct()
        out.append(nodes.withColumn("b", F.col("a")))
    for n in range(1, most + 1):
        ahead = base.select(F.col("a").alias("b"), F.col("b").alias("__c"))
        step = base if step is None else step.join(ahead, "b").select("a", F.col("__c").alias("b")).distinct()
        if n >= least:
            out.append(step)
    return reduce(DataFrame.unionByName, out).distinct()


@dataclass(frozen=True)
class Rule:
    """head if all of body and tests, and none of unless. Atoms are (predicate, argument...); arguments that begin with ? are variables.

    tests: conditions on the bindings of the body, as functions of a mapping from the variables' names to columns.
    """

    head: tuple[str, ...]
    body: tuple[tuple[str, ...], ...]
    unless: tuple[tuple[str, ...], ...] = ()
    label: str = ""
    tests: tuple[Callable[[Mapping[str, Column]], Column], ...] = ()

    def __post_init__(self) -> None:
        bound = {x for atom in self.body for x in atom[1:] if x.startswith("?")}
        for atom in (self.head, *self.unless):
            if free := {x for x in atom[1:] if x.startswith("?")} - bound:
                raise ValueError(f"{self.label or self.head[0]}: {sorted(free)} not bound by the body")


def atom_rows(facts: DataFrame, atom: tuple[str, ...]) -> DataFrame:
    """Bindings of an atom's variables over facts(pred, args): constants filter, a repeated variable means equality."""
    pred, *args = atom
    rows = facts.filter((F.col("pred") == pred) & (F.size("args") == len(args)))
    seen: dict[str, int] = {}
    for i, x in enumerate(args):
        here = F.col("args")[i]
        if not x.startswith("?"):
            rows = rows.filter(here == x)
        elif x in seen:
            rows = rows.filter(here == F.col("args")[seen[x]])
        else:
            seen[x] = i
    return rows.select(*[F.col("args")[i].alias(x[1:]) for x, i in seen.items()])


#: Rows of a side of a product that are sent to all tasks, at most; larger sides are paired block by block.
SMALL = 10_000


def product(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """All combinations, which the caller asks for. A side that is counted to be small goes to the other's tasks."""
    small = lambda df: df.limit(SMALL + 1).count() <= SMALL
    if small(right):
        return left.join(F.broadcast(right), F.lit(True), how)
    if how == "inner" and small(left):
        return right.join(F.broadcast(left), F.lit(True)).select(*left.columns, *right.columns)
    return left.crossJoin(right) if how == "inner" else left.join(right, F.lit(True), how)


def _joined(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    shared = [c for c in left.columns if c in right.columns]
    if shared:
        return left.join(right, shared, how)
    if how == "left_anti":
        return left.filter(F.lit(right.isEmpty()))
    return product(left, right)


#: A join of two atoms that could make more pairs has its keys counted; keys that make more than BLOCK x BLOCK are paired block by block.
PAIRS, BLOCK = 20_000_000, 1_000
#: Pairs that a task of such a join makes, about.
TASK_PAIRS = 4_000_000


def crowded_keys(left: DataFrame, right: DataFrame) -> DataFrame | None:
    """The shared columns' values that many rows of both sides have, with __l and __r, their numbers; None if there are none."""
    shared = [c for c in left.columns if c in right.columns]
    count = lambda df, n: df.groupBy(*shared).agg(F.count("*").alias(n))
    keys = stored(count(left, "__l").join(count(right, "__r"), shared).filter(F.col("__l") * F.col("__r") > BLOCK**2), "crowded")
    if keys.isEmpty():
        free(keys)
        return None
    return keys


def joined_in_blocks(left: DataFrame, right: DataFrame, keys: DataFrame) -> DataFrame:
    """left.join(right) by their shared columns. A row of a crowded key falls into a block of its side and meets the other's blocks one by one,
    so that no task gets all the pairs of a key, and the number of tasks follows that of the pairs."""
    shared = [c for c in left.columns if c in right.columns]
    parts = keys.agg(F.sum(F.col("__l").cast("double") * F.col("__r"))).first()[0] // TASK_PAIRS + 1

    def dealt(df: DataFrame, own: str, own_block: str, other: str, other_block: str) -> DataFrame:
        blocks = lambda n: F.coalesce(F.ceil(F.col(n) / BLOCK), F.lit(1))
        rows = df.join(keys, shared, "left").withColumn(own_block, F.pmod(F.xxhash64(*df.columns), blocks(own)))
        rows = rows.withColumn(other_block, F.explode(F.sequence(F.lit(0).cast("long"), blocks(other).cast("long") - 1)))
        return rows.select(*df.columns, "__i", "__j").repartition(int(parts), *shared, "__i", "__j")

    rows = dealt(left, "__l", "__i", "__r", "__j").join(dealt(right, "__r", "__j", "__l", "__i"), [*shared, "__i", "__j"])
    return rows.drop("__i", "__j")


def conjunction(sources: Sequence[tuple[DataFrame, tuple[str, ...]]]) -> DataFrame:
    """Bindings of a conjunction of atoms, each over its own facts, joined in an order in which neighbours share variables."""
    (facts, atom), *rest = sources
    out = atom_rows(facts, atom)
    while rest:
        at = next((k for k, (_, a) in enumerate(rest) if set(out.columns) & {x[1:] for x in a[1:]}), 0)
        facts, atom = rest.pop(at)
        rows = atom_rows(facts, atom)
        out = _joined(out, rows, "inner") if rows.columns else out.filter(F.lit(not rows.isEmpty()))
    return out


def _head(rule: Rule, rows: DataFrame) -> DataFrame:
    args = [F.col(x[1:]) if x.startswith("?") else F.lit(x) for x in rule.head[1:]]
    return rows.select(F.lit(rule.head[0]).alias("pred"), F.array(*args).alias("args"))


def _settled(rule: Rule, rows: Sequence[DataFrame]) -> bool:
    """Whether different bindings of the body, whose atoms have these rows, are sure to give different heads: what the head leaves out
    follows, in an atom, from what it keeps."""
    kept = {x[1:] for x in rule.head[1:] if x.startswith("?")}
    lost = {c for df in rows for c in df.columns} - kept
    for df in rows if lost else ():
        if lost <= set(df.columns) and (own := [c for c in df.columns if c in kept]):
            if df.groupBy(*own).agg(F.count("*").alias("__n")).filter("__n > 1").isEmpty():
                return True
    return not lost


def saturate(facts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The least set of facts(pred, args) that holds the given ones and all that the rules derive.

    Each round one atom of a body is matched against the last round's new facts and the others
    against all facts. Rules with `unless` need predicates that no rule of the same call derives;
    call again with the outcome for the next stratum. Pairs of crowded keys that no rule reads aren't written:
    they are made when the outcome is read.
    """
    derived = {r.head[0] for r in rules}
    for r in rules:
        if late := {a[0] for a in r.unless} & derived:
            raise ValueError(f"{r.label or r.head[0]}: {sorted(late)} is derived in the same stratum")
    # facts lie apart by predicate, so an atom reads those of its own only; a round is one write and one look at what it wrote
    rounds = Rounds(facts.select("pred", "args").distinct(), "facts", by="pred")

    def bindings(rule: Rule, new: int | None, known: DataFrame, last: DataFrame) -> DataFrame:
        order = sorted(enumerate(rule.body), key=lambda x: x[0] != new)
        sides = [atom_rows(last if k == new else known, a) for k, a in order]
        keys = None
        if len(sides) == 2 and set(sides[0].columns) & set(sides[1].columns) and there[rule.body[0][0]] * there[rule.body[1][0]] > PAIRS:
            keys = crowded_keys(*sides)
        if keys is not None:
            rows = joined_in_blocks(*sides, keys)
            crowded.append(rule)
            settled.extend([rule] if _settled(rule, sides) else [])
        else:
            rows = conjunction([(last if k == new else known, a) for k, a in order])
        for test in rule.tests:
            rows = rows.filter(test({c: F.col(c) for c in rows.columns}))
        for a in rule.unless:
            rows = _joined(rows, atom_rows(known, a), "left_anti")
        return _head(rule, rows)

    # in the first round all facts are new; later a rule starts only where an atom of its body has new facts, and if the others have any
    read = {a[0] for rule in rules for a in rule.body}
    counts = lambda df: {r.pred: r.n for r in df.groupBy("pred").agg(F.count("*").alias("n")).collect()}
    given = counts(rounds.all())
    there, known_heads = {pred: n for pred, n in given.items() if pred in read}, derived & set(given)
    able = lambda r: {a[0] for a in r.body} <= set(there)
    starts: list[tuple[Rule, int | None]] = [(r, None) for r in rules if able(r)]
    while starts:
        known, last, heads = rounds.all(), rounds.last(), sorted({r.head[0] for r, _ in starts})
        crowded, settled = [], []
        made = reduce(DataFrame.unionByName, [bindings(r, i, known, last) for r, i in starts])
        if len(starts) > 1 or not settled:
            made = made.distinct()
        if known_heads & set(heads):
            made = made.join(known.filter(F.col("pred").isin(heads)), ["pred", "args"], "left_anti")
        if crowded and not read & set(heads):
            return known.unionByName(made)
        new = rounds.add(made)
        fresh = counts(new)  # of the rules' heads
        known_heads |= set(fresh)
        there |= {pred: there.get(pred, 0) + n for pred, n in fresh.items()}
        starts = [(r, i) for r in rules if able(r) for i, a in enumerate(r.body) if a[0] in fresh]
    return rounds.all()


def strata(rules: Sequence[Rule]) -> list[list[Rule]]:
    """The rules in layers: what a rule asks to be absent is derived in layers before its own. A predicate that
    depends on its own absence is an error."""
    level = {r.head[0]: 0 for r in rules}
    for _ in range(len(level) + 1):
        moved = False
        for r in rules:
            least = max([level.get(a[0], 0) for a in r.body] + [level[a[0]] + 1 for a in r.unless if a[0] in level], default=0)
            if least > level[r.head[0]]:
                level[r.head[0]], moved = least, True
        if not moved:
            return [[r for r in rules if level[r.head[0]] == n] for n in sorted(set(level.values()))]
    raise ValueError(f"absence in a cycle: {sorted(p for p, n in level.items() if n > len(level) - 1)}")


def saturate_layers(facts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The facts and all that the rules derive, layer by layer, in the order that their absences ask for."""
    for layer in strata(rules):
        facts = saturate(facts, layer)
    return facts


def _variables(terms: Sequence[str]) -> set[str]:
    return {x for x in terms if x.startswith("?")}


def goal_rules(rules: Sequence[Rule], goal: tuple[str, ...]) -> tuple[list[Rule], tuple[str, ...] | None, str]:
    """(rules, seed fact, predicate of answers): the rules rewritten so that they derive only what the goal asks for.

    A derived predicate is told apart by which of its arguments are bound when it is asked, and gets a predicate of
    the questions asked of it (magic sets): a rule starts from its questions, and its atoms, from left to right, ask theirs.
    """
    derived = {r.head[0] for r in rules}

    def named(atom: tuple[str, ...], bound: set[str]) -> tuple[str, str]:
        pattern = "".join("b" if not x.startswith("?") or x in bound else "f" for x in atom[1:])
        return f"{atom[0]}/{pattern}", pattern

    def question(name: str, pattern: str, atom: tuple[str, ...]) -> tuple[str, ...] | None:
        args = [x for x, how in zip(atom[1:], pattern, strict=True) if how == "b"]
        return (f"?{name}", *args) if args else None

    top, pattern = named(goal, set())
    out: list[Rule] = []
    waiting, seen = [(goal[0], pattern)], {(goal[0], pattern)}
    while waiting:
        pred, pattern = waiting.pop()
        name = f"{pred}/{pattern}"
        given = tuple(f"?g{i}" for i in range(len(pattern)))
        asked = question(name, pattern, (pred, *given))
        out.append(Rule((name, *given), (*([asked] if asked else []), (pred, *given))))  # what is given as a fact
        for r in rules:
            if r.head[0] != pred or len(r.head) - 1 != len(pattern):
                continue
            if late := {a[0] for a in r.unless} & derived:
                raise ValueError(f"{sorted(late)} has to be derived before a goal that asks for its absence")
            asked = question(name, pattern, r.head)
            bound = _variables(asked[1:]) if asked else set()
            body: list[tuple[str, ...]] = [asked] if asked else []
            for atom in r.body:
                if atom[0] in derived:
                    own, how = named(atom, bound)
                    ask = question(own, how, atom)
                    if ask and body and (ask,) != tuple(body):
                        out.append(Rule(ask, tuple(body)))
                    elif ask and not body:
                        raise ValueError("a rule that begins with a bound atom of an unbound goal: put an atom of facts first")
                    if (atom[0], how) not in seen:
                        seen.add((atom[0], how))
                        waiting.append((atom[0], how))
                    atom = (own, *atom[1:])
                body.append(atom)
                bound |= _variables(atom[1:])
            out.append(Rule((name, *r.head[1:]), tuple(body), r.unless, r.label, r.tests))
    return list(dict.fromkeys(out)), question(top, named(goal, set())[1], goal), top


def answers(facts: DataFrame, rules: Sequence[Rule], goal: tuple[str, ...], store: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Bindings of the goal's variables that the facts and rules give. Only what the goal asks for is derived: facts that are stored
    grow with the questions and answers, not with all that the rules could derive.

    store: is given all stored facts, questions and steps included (for tests).
    """
    made, seed, top = goal_rules(rules, goal)
    used = {a[0] for r in made for a in (*r.body, *r.unless)}
    rows = facts.select("pred", "args").filter(F.col("pred").isin(sorted(used)))
    if seed:
        rows = rows.unionByName(facts.sparkSession.createDataFrame([(seed[0], list(seed[1:]))], "pred string, args array<string>"))
    full = saturate(rows, made)
    if store:
        store(full)
    return atom_rows(full, (top, *goal[1:])).distinct()


def _least(sets: str) -> Column:
    """Of an array of sets those without a proper subset among them."""
    within = lambda v, w: (F.size(v) < F.size(w)) & (F.size(F.array_except(v, w)) == 0)
    return F.filter(F.col(sets), lambda w: ~F.exists(F.col(sets), lambda v: within(v, w)))


def proofs(facts: DataFrame, rules: Sequence[Rule], most: int = 16) -> DataFrame:
    """(pred, args, why, whole) of the facts(pred, args, why) and all that the rules derive: each minimal set of reasons of each fact.

    why of a given fact is the set of its reasons' ids; a derived fact has the union of those that it came of. A set that holds
    another of the same fact goes. A fact keeps the `most` smallest sets; whole tells whether it, and all that its sets
    came of, had no more. Rounds go on until no set is new or smaller.
    """
    key = ["pred", "args"]
    known = stored(facts.select(*key, F.array_sort(F.array_distinct("why")).alias("why"), F.lit(True).alias("whole")).distinct(), "proofs")
    delta = known

    def rows_of(source: DataFrame, atom: tuple[str, ...], k: int) -> DataFrame:
        pred, *args = atom
        rows = source.filter((F.col("pred") == pred) & (F.size("args") == len(args)))
        first: dict[str, int] = {}
        for i, x in enumerate(args):
            here = F.get("args", F.lit(i))
            rows = rows.filter(here == (F.get("args", F.lit(first[x])) if x in first else F.lit(x))) if x in first or not x.startswith("?") else rows
            first.setdefault(x, i)
        return rows.select(*[F.get("args", F.lit(i)).alias(x[1:]) for x, i in first.items() if x.startswith("?")], F.col("why").alias(f"__w{k}"), F.col("whole").alias(f"__v{k}"))

    def derived(rule: Rule, new: int) -> DataFrame:
        waiting = [(delta if k == new else known, a, k) for k, a in sorted(enumerate(rule.body), key=lambda x: x[0] != new)]
        out = rows_of(*waiting.pop(0))
        while waiting:
            at = next((i for i, (_, a, _) in enumerate(waiting) if {x[1:] for x in _variables(a[1:])} & set(out.columns)), 0)
            out = _joined(out, rows_of(*waiting.pop(at)))
        for test in rule.tests:
            out = out.filter(test({c: F.col(c) for c in out.columns}))
        why = F.array_sort(F.array_distinct(F.concat(*[F.col(f"__w{k}") for k in range(len(rule.body))])))
        whole = reduce(Column.__and__, [F.col(f"__v{k}") for k in range(len(rule.body))])
        args = [F.col(x[1:]) if x.startswith("?") else F.lit(x) for x in rule.head[1:]]
        return out.select(F.lit(rule.head[0]).alias("pred"), F.array(*args).alias("args"), why.alias("why"), whole.alias("whole"))

    if any(r.unless for r in rules):
        raise ValueError("reasons of an absence aren't kept")
    there: set[str] = set()
    while True:
        preds = {r.pred for r in delta.select("pred").distinct().collect()}
        there |= preds
        steps = [derived(r, i) for r in rules if {a[0] for a in r.body} <= there for i, a in enumerate(r.body) if a[0] in preds]
        if not steps:
            return known
        made = stored(reduce(DataFrame.unionByName, steps).distinct(), "proof-steps")
        touched = made.select(*key).distinct()
        both = known.join(touched, key, "left_semi").unionByName(made).groupBy(*key).agg(F.collect_set("why").alias("sets"), F.min("whole").alias("whole"))
        both = both.withColumn("sets", F.array_sort(F.transform(_least("sets"), lambda w: F.struct(F.size(w).alias("n"), w.alias("why")))))
        both = both.select(*key, F.explode(F.slice("sets", 1, most)).alias("s"), (F.col("whole") & (F.size("sets") <= most)).alias("whole")).select(*key, "s.why", "whole")
        merged = stored(both.join(known.withColumn("old", F.lit(True)), [*key, "why", "whole"], "left"), "proofs")
        fresh, before = merged.filter("old IS NULL").drop("old"), (made, known)
        if fresh.isEmpty():
            free(made, merged)
            return known
        known = stored(known.join(touched, key, "left_anti").unionByName(merged.drop("old")), "proofs")
        free(*before)
        delta = fresh
