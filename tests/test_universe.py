"""Formulas over the finite universe, against plain evaluation."""

import itertools
import random

import pytest

from quadrille.operators import constraints as co

FACTS = {"p": {("a", "b"), ("b", "c"), ("c", "c")}, "q": {("a",), ("b",)}, "r": {("d", "a")}, "zero": set()}
UNIVERSE = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def model(spark):
    return spark.createDataFrame([(p, list(t)) for p, rows in FACTS.items() for t in rows], "pred string, args array<string>")


def truth(f, env):
    op, *rest = f
    at = lambda x: env[x] if x.startswith("?") else x
    if op == "fact":
        return tuple(map(at, rest[1:])) in FACTS[rest[0]]
    if op == "=":
        return at(rest[0]) == at(rest[1])
    if op == "not":
        return not truth(rest[0], env)
    if op in ("and", "or"):
        return (all if op == "and" else any)(truth(g, env) for g in rest)
    if op == "implies":
        return not truth(rest[0], env) or truth(rest[1], env)
    if op == "iff":
        return truth(rest[0], env) == truth(rest[1], env)
    ways = (truth(rest[1], {**env, **dict(zip(rest[0], vs, strict=True))}) for vs in itertools.product(UNIVERSE, repeat=len(rest[0])))
    return any(ways) if op == "exists" else all(ways)


def agrees(f, model):
    free = sorted(co.free_variables(f))
    got = co.satisfying(f, model)
    want = sorted(vs for vs in itertools.product(UNIVERSE, repeat=len(free)) if truth(f, dict(zip(free, vs, strict=True))))
    if not free:
        return (got if isinstance(got, bool) else not got.isEmpty()) == bool(want)
    return sorted(tuple(r[v[1:]] for v in free) for r in got.collect()) == want


P, Q, R = (lambda *t, n=n: ("fact", n, *t) for n in "pqr")


@pytest.mark.parametrize(
    "f",
    [
        ("forall", ["?x"], ("exists", ["?y"], P("?x", "?y"))),
        ("forall", ["?x"], ("exists", ["?y"], ("or", P("?x", "?y"), R("?x", "?y")))),
        ("exists", ["?x"], ("forall", ["?y"], ("not", P("?y", "?x")))),
        ("not", Q("?x")),
        ("forall", ["?y"], ("implies", P("?x", "?y"), Q("?y"))),
        ("iff", Q("?x"), ("forall", ["?y"], ("implies", P("?x", "?y"), Q("?y")))),
        ("or", ("=", "?x", "a"), Q("?y")),
        ("and", Q("?x"), ("not", ("=", "?x", "?y")), ("not", P("?x", "?y"))),
        ("=", "?x", "?y"),
        ("exists", ["?x"], ("and", Q("?x"), ("exists", ["?x"], R("?x", "a")))),
        ("forall", ["?x", "?y"], ("or", P("?x", "?y"), P("?y", "?x"), ("=", "?x", "?y"))),
        ("implies", ("fact", "zero", "?x"), Q("?x")),
        ("exists", ["?z"], Q("a")),
        ("and", Q("?x"), ("exists", ["?y"], ("not", P("?x", "?y")))),
    ],
)
def test_universe(model, f):
    assert agrees(f, model)


def test_random_formulas(model):
    rng = random.Random(11)

    def made(depth, names):
        kind = rng.choice(["fact", "fact", "="] if depth == 0 else ["and", "or", "not", "implies", "exists", "forall", "fact"])
        term = lambda: rng.choice([*names, *names, "a", "c"])
        if kind == "fact":
            p = rng.choice("pqr")
            return ("fact", p, *[term() for _ in range(1 if p == "q" else 2)])
        if kind == "=":
            return ("=", term(), term())
        if kind == "not":
            return ("not", made(depth - 1, names))
        if kind in ("exists", "forall"):
            v = rng.choice(["?x", "?y", "?z"])
            return (kind, [v], made(depth - 1, sorted({*names, v})))
        return (kind, made(depth - 1, names), made(depth - 1, names))

    for _ in range(25):
        f = made(3, ["?x", "?y"])
        assert agrees(f, model), f


def test_expressions_over_the_universe(model):
    """One-of below a class, a class equal to a universal restriction, and a counterexample of each."""
    assert not co.holds(co.axiom_formula("SubClassOf", ("one", "a", "c"), "q"), model)
    assert co.holds(co.axiom_formula("SubClassOf", ("one", "a", "b"), "q"), model)
    assert not co.holds(co.axiom_formula("EquivalentClasses", "q", ("all", "p", "q")), model)
    assert sorted(r.x for r in co.counterexamples(co.axiom_formula("EquivalentClasses", "q", ("all", "p", "q")), model).collect()) == ["b", "d"]
    assert not co.holds(co.axiom_formula("SubClassOf", "q", ("max", 0, "p", "q")), model)
