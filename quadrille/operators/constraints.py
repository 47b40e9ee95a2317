"""Closed-world checks of formulas over finite models: facts(pred, args)."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.operators.trees import nodes
from quadrille.plans.fixpoint import Rule, atom_rows, product, saturate
from quadrille.plans.stages import stored

#: A formula is a nested tuple: ("fact", pred, term...), ("=", a, b), ("and", f...), ("or", f...), ("not", f),
#: ("implies", f, g), ("iff", f, g), ("exists", vars, f) or ("forall", vars, f). Terms that begin with ? are variables.
Formula = tuple


def free_variables(formula: Formula) -> set[str]:
    op, *rest = formula
    if op in ("fact", "="):
        return {x for x in (rest[1:] if op == "fact" else rest) if x.startswith("?")}
    if op in ("exists", "forall"):
        return free_variables(rest[1]) - set(rest[0])
    return set().union(*map(free_variables, rest))


def symbols(formula: Formula) -> dict[str, set[str]]:
    """The predicates, constants and variables of a formula."""
    op, *rest = formula
    out: dict[str, set[str]] = {"predicates": set(), "constants": set(), "variables": set()}
    if op in ("fact", "="):
        if op == "fact":
            out["predicates"].add(rest[0])
        for x in rest[1:] if op == "fact" else rest:
            out["variables" if x.startswith("?") else "constants"].add(x)
        return out
    if op in ("exists", "forall"):
        out["variables"] |= set(rest[0])
        rest = rest[1:]
    for part in rest:
        for k, v in symbols(part).items():
            out[k] |= v
    return out


#: Operators of formulas' text forms.
OPERATORS = ("and", "or", "not", "implies", "iff", "exists", "forall", "=")


def symbols_of(formulas: DataFrame) -> DataFrame:
    """(name, kind, symbol) of formulas(name, sexpr) in text form, (forall (?x) (implies (p ?x k) (q ?x))): predicates, constants and variables."""
    rows = nodes(formulas.select("name", "sexpr"))
    kind = F.when(F.col("head").startswith("?"), "variable").when(F.col("leaf"), "constant").when(~F.col("head").isin(*OPERATORS), "predicate")
    return rows.select("name", kind.alias("kind"), F.col("head").alias("symbol")).filter("kind IS NOT NULL").distinct()


def negated(formula: Formula) -> Formula:
    """The negation, moved inward to the facts."""
    op, *rest = formula
    if op == "not":
        return inward(rest[0])
    if op in ("and", "or"):
        return ("or" if op == "and" else "and", *map(negated, rest))
    if op == "implies":
        return ("and", inward(rest[0]), negated(rest[1]))
    if op == "iff":
        return ("or", ("and", inward(rest[0]), negated(rest[1])), ("and", negated(rest[0]), inward(rest[1])))
    if op in ("exists", "forall"):
        return ("forall" if op == "exists" else "exists", rest[0], negated(rest[1]))
    return ("not", formula)


def inward(formula: Formula) -> Formula:
    """The formula with negations at facts only, without implications and equivalences."""
    op, *rest = formula
    if op == "not":
        return negated(rest[0])
    if op in ("and", "or"):
        return (op, *map(inward, rest))
    if op == "implies":
        return ("or", negated(rest[0]), inward(rest[1]))
    if op == "iff":
        return ("and", ("or", negated(rest[0]), inward(rest[1])), ("or", negated(rest[1]), inward(rest[0])))
    if op in ("exists", "forall"):
        return (op, rest[0], inward(rest[1]))
    return formula


def _true(df: DataFrame) -> bool:
    return not df.isEmpty()


def universe_of(facts: DataFrame, formula: Formula = ("and",)) -> DataFrame:
    """(c): the constants of the facts and of a formula, over which its variables range."""
    named = sorted(symbols(formula)["constants"])
    return facts.select(F.explode("args").alias("c")).unionByName(facts.sparkSession.createDataFrame([(x,) for x in named], "c string")).distinct()


class _Model:
    """Facts and the universe over which variables range that no fact binds; it is stored when the first of them asks for it."""

    def __init__(self, facts: DataFrame, formula: Formula, universe: DataFrame | None):
        self.facts, self.formula, self.given, self.kept = facts, formula, universe, None

    def universe(self, name: str) -> DataFrame:
        if self.kept is None:
            self.kept = stored(universe_of(self.facts, self.formula) if self.given is None else self.given.select("c").distinct(), "universe")
        return self.kept.select(F.col("c").alias(name))

    def widened(self, rows: DataFrame | None, names: set[str]) -> DataFrame | None:
        """The rows with each of the variables at each value of the universe."""
        for v in sorted(names):
            rows = self.universe(v[1:]) if rows is None else product(rows, self.universe(v[1:]))
        return rows


def satisfying(formula: Formula, facts: DataFrame, universe: DataFrame | None = None) -> DataFrame | bool:
    """The bindings of the formula's free variables under which it holds, or its truth if it has none.

    Variables range over the universe(c), without one over the constants of the facts and the formula. Conjunctions join their
    positive parts and take the rest away by anti joins; a universal part is what has no counterexample. The universe is paired only
    with variables that no positive part of the formula binds: their complements can't be smaller. Names are unique: = compares them.
    """
    return _satisfying(inward(formula), _Model(facts, formula, universe))


def _satisfying(formula: Formula, model: _Model) -> DataFrame | bool:
    op, *rest = formula
    loose = free_variables(formula)
    if op == "fact":
        rows = atom_rows(model.facts, tuple(rest))
        return rows.distinct() if rows.columns else _true(model.facts.filter((F.col("pred") == rest[0]) & (F.col("args") == F.array(*[F.lit(x) for x in rest[1:]]))))
    if op == "=":
        if not loose:
            return rest[0] == rest[1]
        if len(loose) == 1 and rest[0] != rest[1]:  # the constant itself, if it is in the universe
            name, value = (rest[0], rest[1]) if rest[0].startswith("?") else (rest[1], rest[0])
            return model.universe(name[1:]).filter(F.col(name[1:]) == value)
        rows = model.universe(rest[0][1:])
        return rows if len(loose) == 1 else rows.withColumn(rest[1][1:], F.col(rest[0][1:]))
    if op == "exists":
        rows = _satisfying(rest[1], model)
        if isinstance(rows, bool):  # its variables don't occur: there has to be some value
            return rows and _true(model.universe("c"))
        kept = [c for c in rows.columns if f"?{c}" not in rest[0]]
        return rows.select(kept).distinct() if kept else _true(rows)
    if op == "or":
        return _disjunction(rest, loose, model)
    if op == "and":
        return _conjunction(rest, model)
    inner = ("exists", rest[0], negated(rest[1])) if op == "forall" else rest[0]
    if not loose:
        return not _satisfying(inner, model)
    return _tested(model.widened(None, loose), formula, model)


def _disjunction(parts: list[Formula], loose: set[str], model: _Model) -> DataFrame | bool:
    found = [_satisfying(f, model) for f in parts]
    if not loose:
        return any(p if isinstance(p, bool) else _true(p) for p in found)
    rows = []
    for p in found:
        if p is not False:
            p = None if p is True else p
            rows.append(model.widened(p, loose - {f"?{c}" for c in (p.columns if p is not None else [])}))
    return reduce(DataFrame.unionByName, rows).distinct() if rows else model.widened(None, loose).limit(0)


def _binds(part: Formula) -> set[str]:
    """The free variables that the positive facts of a part bind."""
    op, *rest = part
    if op == "fact":
        return free_variables(part)
    if op == "exists":
        return _binds(rest[1]) - set(rest[0])
    if op == "and":
        return set().union(*map(_binds, rest))
    if op == "or":
        return set.intersection(*map(_binds, rest)) if rest else set()
    return set()


def _conjunction(parts: list[Formula], model: _Model) -> DataFrame | bool:
    flat: list[Formula] = []
    for p in parts:
        flat += p[1:] if p[0] == "and" else [p]
    # parts whose facts bind all their variables come first; the others only test what these bind, where they can
    waiting = [p for p in flat if p[0] in ("fact", "exists", "or") and _binds(p) == free_variables(p)]
    late = [p for p in flat if p not in waiting]
    rows: DataFrame | None = None
    while waiting:
        names = set() if rows is None else {f"?{c}" for c in rows.columns}
        at = next((k for k, p in enumerate(waiting) if rows is None or names & free_variables(p) or not free_variables(p)), 0)
        got = _satisfying(waiting.pop(at), model)
        if isinstance(got, bool):
            if not got:
                return _nothing(parts, model)
            continue
        shared = [] if rows is None else [c for c in rows.columns if c in got.columns]
        rows = got if rows is None else rows.join(got, shared) if shared else product(rows, got)
    for part in sorted(late, key=lambda p: len(free_variables(p) - ({f"?{c}" for c in rows.columns} if rows is not None else set()))):
        if rows is None:
            got = _satisfying(part, model)
            if got is False:
                return _nothing(parts, model)
            rows = None if got is True else got
        else:
            rows = _tested(rows, part, model)
    return True if rows is None else rows


def _nothing(parts: list[Formula], model: _Model) -> DataFrame | bool:
    loose = free_variables(("and", *parts))
    return model.widened(None, loose).limit(0) if loose else False


def _tested(rows: DataFrame, part: Formula, model: _Model) -> DataFrame:
    """Of the bindings, widened by the part's other variables, those under which the part holds."""
    bound = {f"?{c}" for c in rows.columns}
    if loose := free_variables(part) - bound:
        if _binds(part) >= loose and part[0] not in ("not", "forall"):
            got = _satisfying(part, model)
            shared = [c for c in rows.columns if c in got.columns]
            return rows.join(got, shared) if shared else product(rows, got)
        rows = model.widened(rows, loose)
    op, *rest = part
    term = lambda x: F.col(x[1:]) if x.startswith("?") else F.lit(x)
    if op == "=":
        return rows.filter(term(rest[0]) == term(rest[1]))
    if op == "not" and rest[0][0] == "=":
        return rows.filter(term(rest[0][1]) != term(rest[0][2]))
    if op == "and":
        return reduce(lambda r, f: _tested(r, f, model), rest, rows)
    if op == "or" and _binds(part) != free_variables(part):
        return reduce(DataFrame.unionByName, [_tested(rows, f, model).select(rows.columns) for f in rest]).distinct() if rest else rows.limit(0)
    if op == "forall" or (op == "exists" and _binds(part) != free_variables(part)):
        # witnesses and counterexamples are looked for among the rows only
        keys = rows.select([c for c in rows.columns if f"?{c}" in free_variables(part)]).distinct()
        if not keys.columns:
            return rows.filter(F.lit(bool(_satisfying(part, model))))
        found = _tested(keys, negated(rest[1]) if op == "forall" else rest[1], model).select(keys.columns).distinct()
        return rows.join(found, keys.columns, "left_anti" if op == "forall" else "left_semi")
    got = _satisfying(rest[0] if op == "not" else part, model)
    if isinstance(got, bool):
        return rows.filter(F.lit(got != (op == "not")))
    return rows.join(got, [c for c in rows.columns if c in got.columns], "left_anti" if op == "not" else "left_semi")


def holds(formula: Formula, facts: DataFrame, universe: DataFrame | None = None) -> bool:
    """The truth of a closed formula."""
    if loose := free_variables(formula):
        raise ValueError(f"free variables: {sorted(loose)}")
    got = satisfying(formula, facts, universe)
    return got if isinstance(got, bool) else _true(got)


def counterexamples(formula: Formula, facts: DataFrame) -> DataFrame | bool:
    """The bindings of the outer universal variables under which the rest fails (False: there are none and no variables)."""
    op, *rest = formula
    if op != "forall":
        return not holds(formula, facts)
    return satisfying(negated(rest[1]), facts)


def check(formulas: Mapping[str, Formula], facts: DataFrame) -> DataFrame:
    """(name, holds, n_counterexamples) of named formulas, in one plan for those with rows."""
    spark, out = facts.sparkSession, []
    for name, formula in formulas.items():
        found = counterexamples(formula, facts)
        n = spark.createDataFrame([(int(found),)], "n long") if isinstance(found, bool) else found.agg(F.count("*").alias("n"))
        out.append(n.select(F.lit(name).alias("name"), (F.col("n") == 0).alias("holds"), F.col("n").alias("n_counterexamples")))
    return reduce(DataFrame.unionByName, out)


def missing(antecedent: DataFrame, consequent: DataFrame, on: list[str]) -> DataFrame:
    """Counterexamples of a rule between tables: rows without a partner."""
    return antecedent.join(consequent.select(*on).distinct(), on, "left_anti")


def differing(first: DataFrame, second: DataFrame, on: list[str]) -> DataFrame:
    """(on..., side): keys on one side only: counterexamples of an equivalence between tables."""
    a, b = first.select(*on).distinct().withColumn("__a", F.lit(1)), second.select(*on).distinct().withColumn("__b", F.lit(1))
    return a.join(b, on, "full_outer").filter("__a IS NULL OR __b IS NULL").select(*on, F.when(F.col("__b").isNull(), "first").otherwise("second").alias("side"))


def expectation(facts: DataFrame, rules: list[Rule], expected: DataFrame, unexpected: DataFrame) -> DataFrame:
    """(kind, pred, args): expected propositions that the saturated seed lacks, and unexpected ones that it has."""
    all_facts = saturate(facts, rules)
    lacking = expected.join(all_facts, ["pred", "args"], "left_anti").select(F.lit("missing").alias("kind"), "pred", "args")
    there = unexpected.join(all_facts, ["pred", "args"], "left_semi").select(F.lit("unexpected").alias("kind"), "pred", "args")
    return lacking.unionByName(there)


def rules_of(formula: Formula, label: str = "") -> list[Rule]:
    """The Horn rules of a universal formula: one for each disjunct of a body and each fact of a head.

    Clauses with other than one positive literal, and rules whose head isn't bound by the body,
    are left out, as are tautologies.
    """
    while formula[0] == "forall":
        formula = formula[2]
    out: list[Rule] = []
    for clause in _clauses(inward(formula)):
        heads = [c for c in clause if c[0] == "fact"]
        body = [c[1] for c in clause if c[0] == "not" and c[1][0] == "fact"]
        if len(heads) != 1 or len(heads) + len(body) != len(clause) or not body:
            continue
        head = heads[0][1:]
        if set(x for x in head[1:] if x.startswith("?")) <= set().union(*(free_variables(b) for b in body)) and heads[0] not in body:
            rule = Rule(tuple(head), tuple(tuple(b[1:]) for b in body), label=label)
            if rule not in out:
                out.append(rule)
    return out


def _clauses(formula: Formula, most: int = 100_000) -> list[list[Formula]]:
    """The conjuncts of the formula's clausal form; over `most` of them raise an error."""
    op, *rest = formula
    if op == "and":
        return [c for part in rest for c in _clauses(part, most)]
    if op == "forall":
        return _clauses(rest[1], most)
    if op == "or":
        out: list[list[Formula]] = [[]]
        for part in rest:
            out = [a + b for a in out for b in _clauses(part, most)]
            if len(out) > most:
                raise ValueError(f"more than {most} clauses")
        return out
    return [[formula]]


#: Rules of axiom types over named terms, by the arguments of the axiom.
AXIOM_RULES = {
    "SubClassOf": lambda a, b: [Rule((b, "?x"), ((a, "?x"),))], "EquivalentClasses": lambda a, b: [Rule((b, "?x"), ((a, "?x"),)), Rule((a, "?x"), ((b, "?x"),))],
    "SubObjectPropertyOf": lambda a, b: [Rule((b, "?x", "?y"), ((a, "?x", "?y"),))], "InverseObjectProperties": lambda a, b: [Rule((b, "?y", "?x"), ((a, "?x", "?y"),)), Rule((a, "?y", "?x"), ((b, "?x", "?y"),))],
    "ObjectPropertyDomain": lambda p, c: [Rule((c, "?x"), ((p, "?x", "?y"),))], "ObjectPropertyRange": lambda p, c: [Rule((c, "?y"), ((p, "?x", "?y"),))],
    "SymmetricObjectProperty": lambda p: [Rule((p, "?y", "?x"), ((p, "?x", "?y"),))], "TransitiveObjectProperty": lambda p: [Rule((p, "?x", "?z"), ((p, "?x", "?y"), (p, "?y", "?z")))],
}


def axiom_rules(axioms: list[tuple[str, ...]]) -> list[Rule]:
    """Rules of axioms (type, term...); a type without rules raises an error."""
    out: list[Rule] = []
    for kind, *terms in axioms:
        if kind not in AXIOM_RULES:
            raise ValueError(f"{kind} has no rules")
        out += AXIOM_RULES[kind](*terms)
    return out


def closure_axiom(propositions: list[tuple[str, ...]]) -> Formula:
    """The formula that only the given ground propositions (pred, constant...) hold of their predicates: for each predicate and arity,
    what it holds of is one of its tuples. For models small enough to be written as a formula."""
    kinds: dict[tuple[str, int], list[tuple[str, ...]]] = {}
    for pred, *args in propositions:
        kinds.setdefault((pred, len(args)), []).append(tuple(args))
    parts: list[Formula] = []
    for (pred, n), rows in kinds.items():
        names = [f"?v{i}" for i in range(n)]
        same = [("and", *[("=", v, x) for v, x in zip(names, row, strict=True)]) if n > 1 else ("=", names[0], row[0]) for row in rows]
        parts.append(("forall", names, ("implies", ("fact", pred, *names), ("or", *same) if len(same) > 1 else same[0])))
    return ("and", *parts) if len(parts) != 1 else parts[0]


def class_formula(expression: str | tuple, x: str, depth: int = 0) -> Formula:
    """That x is in a class: a name, ("and", ...), ("or", ...), ("not", c), ("some", p, c), ("all", p, c), ("value", p, i), ("self", p),
    ("one", i...), ("min", n, p, c), ("max", n, p, c) or ("exactly", n, p, c). A property ("inverse", p) turns its link."""
    if isinstance(expression, str):
        return ("fact", expression, x)
    op, *rest = expression
    y = f"?{op}{depth}"
    link = lambda p, a, b: ("fact", p[1], b, a) if isinstance(p, tuple) else ("fact", p, a, b)
    if op in ("and", "or"):
        return (op, *[class_formula(e, x, depth + 1) for e in rest])
    if op == "not":
        return ("not", class_formula(rest[0], x, depth + 1))
    if op == "some":
        return ("exists", [y], ("and", link(rest[0], x, y), class_formula(rest[1], y, depth + 1)))
    if op == "all":
        return ("forall", [y], ("implies", link(rest[0], x, y), class_formula(rest[1], y, depth + 1)))
    if op == "value":
        return link(rest[0], x, rest[1])
    if op == "self":
        return link(rest[0], x, x)
    if op == "one":
        return ("or", *[("=", x, i) for i in rest]) if len(rest) > 1 else ("=", x, rest[0])
    n, p, c = rest
    if op == "exactly":
        return ("and", class_formula(("min", n, p, c), x, depth + 1), class_formula(("max", n, p, c), x, depth + 2))
    count = n if op == "min" else n + 1
    names = [f"{y}n{i}" for i in range(count)]
    inside = [part for v in names for part in (link(p, x, v), class_formula(c, v, depth + 1))]
    apart = [("not", ("=", a, b)) for i, a in enumerate(names) for b in names[i + 1 :]]
    there = ("exists", names, ("and", *inside, *apart))
    return there if op == "min" else ("not", there)


def axiom_formula(kind: str, *args) -> Formula:
    """The closed formula of an axiom over class expressions, properties and individuals."""
    x, y, z = "?x", "?y", "?z"
    of = lambda c, v=x: class_formula(c, v)
    pairs = lambda xs: [(a, b) for i, a in enumerate(xs) for b in xs[i + 1 :]]
    every = lambda names, f: ("forall", names, f)
    both = lambda fs: fs[0] if len(fs) == 1 else ("and", *fs)
    link = lambda p, a, b: ("fact", p[1], b, a) if isinstance(p, tuple) else ("fact", p, a, b)
    forms = {
        "SubClassOf": lambda a, b: every([x], ("implies", of(a), of(b))),
        "EquivalentClasses": lambda *cs: both([every([x], ("iff", of(a), of(b))) for a, b in zip(cs, cs[1:], strict=False)]),
        "DisjointClasses": lambda *cs: both([every([x], ("not", ("and", of(a), of(b)))) for a, b in pairs(cs)]),
        "DisjointUnion": lambda c, *cs: both([axiom_formula("EquivalentClasses", c, ("or", *cs)), axiom_formula("DisjointClasses", *cs)]),
        "SubObjectPropertyOf": lambda p, q: every([x, y], ("implies", link(p, x, y), link(q, x, y))),
        "SubObjectPropertyOfChain": lambda q, *ps: every([f"?c{i}" for i in range(len(ps) + 1)], ("implies", both([link(p, f"?c{i}", f"?c{i + 1}") for i, p in enumerate(ps)]), link(q, "?c0", f"?c{len(ps)}"))),
        "EquivalentObjectProperties": lambda *ps: both([every([x, y], ("iff", link(a, x, y), link(b, x, y))) for a, b in zip(ps, ps[1:], strict=False)]),
        "DisjointObjectProperties": lambda *ps: both([every([x, y], ("not", ("and", link(a, x, y), link(b, x, y)))) for a, b in pairs(ps)]),
        "InverseObjectProperties": lambda p, q: every([x, y], ("iff", link(p, x, y), link(q, y, x))),
        "ObjectPropertyDomain": lambda p, c: every([x, y], ("implies", link(p, x, y), of(c))),
        "ObjectPropertyRange": lambda p, c: every([x, y], ("implies", link(p, x, y), of(c, y))),
        "FunctionalObjectProperty": lambda p: every([x, y, z], ("implies", ("and", link(p, x, y), link(p, x, z)), ("=", y, z))),
        "InverseFunctionalObjectProperty": lambda p: every([x, y, z], ("implies", ("and", link(p, y, x), link(p, z, x)), ("=", y, z))),
        "TransitiveObjectProperty": lambda p: every([x, y, z], ("implies", ("and", link(p, x, y), link(p, y, z)), link(p, x, z))),
        "SymmetricObjectProperty": lambda p: every([x, y], ("implies", link(p, x, y), link(p, y, x))),
        "AsymmetricObjectProperty": lambda p: every([x, y], ("not", ("and", link(p, x, y), link(p, y, x)))),
        "IrreflexiveObjectProperty": lambda p: every([x], ("not", link(p, x, x))),
        "ClassAssertion": lambda c, i: of(c, i), "ObjectPropertyAssertion": lambda p, a, b: link(p, a, b), "NegativeObjectPropertyAssertion": lambda p, a, b: ("not", link(p, a, b)),
        "SameIndividual": lambda *xs: both([("=", a, b) for a, b in zip(xs, xs[1:], strict=False)]), "DifferentIndividuals": lambda *xs: both([("not", ("=", a, b)) for a, b in pairs(xs)]),
        "HasKey": lambda c, *ps: every([x, y, *[f"?k{i}" for i in range(len(ps))]], ("implies", both([of(c), of(c, y), *[part for i, p in enumerate(ps) for part in (link(p, x, f"?k{i}"), link(p, y, f"?k{i}"))]]), ("=", x, y))),
    }
    if kind not in forms:
        raise ValueError(f"{kind} has no formula")
    return forms[kind](*args)
