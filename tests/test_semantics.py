import pytest
from pyspark.sql import functions as F

from quadrille.functions.builtins import BUILTINS
from quadrille.functions.terms import DOMAIN, LABEL, OWL, RANGE, SUBCLASS, SUBPROPERTY, TYPE, abbreviated, call, order_keys
from quadrille.operators import axioms, constraints, entailment, hierarchy, models, patterns, update
from quadrille.plans.fixpoint import Rule, bounded_paths, saturate, transitive_closure
from quadrille.sources.graphs import abox
from quadrille.streaming.ingest import ingest


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def facts(spark, *rows):
    return spark.createDataFrame([(p, list(a)) for p, *a in rows], "pred string, args array<string>")


def edges(spark, *rows):
    return spark.createDataFrame(list(rows), "a string, b string")


def test_closure_is_safe_on_cycles_and_empty(spark):
    e = edges(spark, ("x", "y"), ("y", "z"), ("z", "x"), ("z", "w"), ("x", "y"))
    assert len(pairs(transitive_closure(e))) == 12
    assert pairs(transitive_closure(e.limit(0))) == []
    assert ("w", "w") in pairs(transitive_closure(e, reflexive=True))
    long = edges(spark, *[(f"{i:03}", f"{i + 1:03}") for i in range(40)])
    assert transitive_closure(long).count() == 40 * 41 // 2


def test_bounded_paths(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "d"))
    assert pairs(bounded_paths(e, 2, 2)) == [("a", "c"), ("b", "d")]
    assert len(pairs(bounded_paths(e, 0, 1))) == 7


def test_saturation(spark):
    got = saturate(facts(spark, ("p", "x"), ("q", "x"), ("s", "y")), [Rule(("r", "?a"), (("p", "?a"), ("q", "?a")))])
    assert ("r", ["x"]) in pairs(got) and got.count() == 4
    with pytest.raises(ValueError, match="not bound"):
        Rule(("r", "?b"), (("p", "?a"),))
    with pytest.raises(ValueError, match="same stratum"):
        saturate(facts(spark, ("p", "x")), [Rule(("r", "?a"), (("p", "?a"),), (("r", "?a"),))])


@pytest.mark.parametrize(("rows", "want"), [([("f", "a"), ("g", "a")], True), ([("g", "a")], True), ([("f", "a")], False), ([], True)])
def test_formula_truth(spark, rows, want):
    formula = ("forall", ["?x"], ("implies", ("fact", "f", "?x"), ("fact", "g", "?x")))
    df = facts(spark, *rows) if rows else spark.createDataFrame([], "pred string, args array<string>")
    assert constraints.holds(formula, df) is want


def test_formulas(spark):
    m = facts(spark, ("r", "a", "b"), ("r", "b", "c"), ("s", "a"), ("s", "b"), ("t", "c"))
    fact = lambda *x: ("fact", *x)
    assert constraints.holds(("exists", ["?x", "?y"], ("and", fact("r", "?x", "?y"), fact("s", "?y"))), m)
    assert constraints.holds(("forall", ["?x", "?y"], ("implies", fact("r", "?x", "?y"), ("or", fact("s", "?y"), fact("t", "?y")))), m)
    assert not constraints.holds(("forall", ["?x", "?y"], ("implies", fact("r", "?x", "?y"), fact("s", "?y"))), m)
    assert pairs(constraints.counterexamples(("forall", ["?x", "?y"], ("implies", fact("r", "?x", "?y"), fact("s", "?y"))), m).select("x", "y")) == [("b", "c")]
    assert constraints.holds(("forall", ["?x"], ("iff", fact("s", "?x"), ("exists", ["?y"], fact("r", "?x", "?y")))), m)
    assert constraints.holds(("forall", ["?x", "?y"], ("implies", fact("r", "?x", "?y"), ("not", ("=", "?x", "?y")))), m)
    assert constraints.holds(("and", fact("s", "a"), ("not", fact("s", "c"))), m)
    assert pairs(constraints.satisfying(("not", fact("s", "?x")), m)) == [("c",)]  # over the constants a, b, c
    assert constraints.symbols(("exists", ["?x"], fact("r", "?x", "k"))) == {"predicates": {"r"}, "constants": {"k"}, "variables": {"?x"}}


def test_expectations(spark):
    rules = [Rule(("y", "?a"), (("x", "?a"),))]
    got = constraints.expectation(facts(spark, ("x", "a"), ("y", "c")), rules, facts(spark, ("y", "a"), ("y", "q")), facts(spark, ("y", "c")))
    assert pairs(got.select("kind", F.col("args")[0])) == [("missing", "q"), ("unexpected", "c")]


def test_hierarchy(spark):
    c = hierarchy.subsumptions(edges(spark, ("a", "b"), ("b", "c"), ("a", "c"), ("d", "c")))
    assert pairs(hierarchy.children(c, "c")) == [("b",), ("d",)]
    assert pairs(hierarchy.parents(c, "a")) == [("b",)]
    assert pairs(hierarchy.ancestors(c, "a")) == [("b",), ("c",)]
    assert hierarchy.is_subclass(c, "a", "c") and not hierarchy.is_subclass(c, "c", "a")
    assert hierarchy.depth(edges(spark, ("b", "a"), ("c", "b"), ("d", "b"))) == 2
    rows = hierarchy.tree_rows(edges(spark, ("b", "a"), ("c", "b"), ("d", "b")), "a")
    assert sorted((r.node, r.depth) for r in rows.collect()) == [("a", 0), ("b", 1), ("c", 2), ("d", 2)]


def test_inconsistency(spark):
    closure = hierarchy.subsumptions(edges(spark, ("c", "a"), ("c", "b")))
    disjoint = edges(spark, ("a", "b"))
    assert pairs(hierarchy.unsatisfiable(closure, disjoint)) == [("c",)]
    types = spark.createDataFrame([("h", "a"), ("h", "b"), ("k", "a")], "i string, c string")
    assert pairs(hierarchy.inconsistent_individuals(types, closure, disjoint)) == [("h",)]


def test_nearest_base(spark):
    # d is in f2 of g2, in f1 of g1, in a; c is in a and d in c: the first base terms above d are c and a
    e = edges(spark, ("d", "r2"), ("r2", "r1"), ("r1", "a"), ("c", "a"), ("d", "c"))
    base = spark.createDataFrame([("a",), ("c",), ("d",)], "node string")
    assert ("d", "c") in pairs(hierarchy.nearest_base(e, base)) and ("d", "a") in pairs(hierarchy.nearest_base(e, base))


def test_preferred_labels(spark):
    rows = [(t, p, r, lang, f"{p}-{t}-{lang or 'no-lang'}") for t in "ab" for r, p in enumerate(("rdfs", "skos")) for lang in (None, "en", "fr")]
    rows = [r for r in rows if not (r[0] == "a" and r[1] == "skos" and r[3] == "fr")]
    df = spark.createDataFrame(rows, "iri string, prop string, prop_rank int, lang string, label string")
    assert pairs(hierarchy.preferred_labels(df, "en").select("label")) == [("rdfs-a-en",), ("rdfs-b-en",)]
    turned = df.withColumn("prop_rank", 1 - F.col("prop_rank"))
    assert pairs(hierarchy.preferred_labels(turned, "fr").select("label")) == [("skos-a-no-lang",), ("skos-b-fr",)]


def test_entailment(spark):
    g = abox(spark, [("a", SUBCLASS, "b"), ("b", SUBCLASS, "c"), ("p", SUBPROPERTY, "q"), ("q", DOMAIN, "a"), ("q", RANGE, "d"), ("x", "p", "y")])
    got = set(pairs(entailment.rdfs(g)))
    assert {("x", "q", "y"), ("x", TYPE, "a"), ("x", TYPE, "c"), ("y", TYPE, "d"), ("a", SUBCLASS, "c")} <= got
    plus = abox(spark, [("p", f"{OWL}inverseOf", "q"), ("x", "p", "y"), ("k", f"{OWL}equivalentClass", "m"), ("i", TYPE, "m")])
    assert {("y", "q", "x"), ("i", TYPE, "k")} <= set(pairs(entailment.rdfs_plus(plus)))
    assert pairs(entailment.inferred_axioms(g, "SubClassOf")) == [("a", SUBCLASS, "c")]
    assert [tuple(r) for r in entailment.why_subclass(g, "a", "c").orderBy("step").collect()] == [(1, "a", "b"), (2, "b", "c")]
    with pytest.raises(ValueError, match="isn't among"):
        entailment.entailed(g, "owl-dl")


def test_minus_and_unbound(spark):
    left = spark.createDataFrame([("a", "1"), ("b", None)], "x string, y string")
    right = spark.createDataFrame([("1", "k"), (None, "m")], "y string, z string")
    assert patterns.minus(left, right.select("z")).count() == 2  # no shared variable: nothing goes
    assert pairs(patterns.minus(left, right.select("y"), unbound=["y"])) == [("b", None)]
    assert patterns.natural_join(left, right, unbound=["y"]).count() == 4
    with pytest.raises(ValueError, match="without a shared variable"):
        patterns.natural_join(left.select("x"), right.select("z"))


def test_patterns(spark):
    g = abox(spark, [("a", "p", "a"), ("a", "p", "b"), ("b", "q", "c"), ("c", LABEL, "sea")])
    assert pairs(patterns.bgp(g, ("?x", "p", "?x"))) == [("a",)]
    assert pairs(patterns.bgp(g, ("?x", patterns.iri("p") / "q", "?y"))) == [("a", "c")]
    assert pairs(patterns.with_labels(patterns.bgp(g, ("?x", "q", "?y")), g, "y").select("x", "y_label")) == [("b", "sea")]
    made = patterns.construct(patterns.bgp(g, ("?x", "p", "?y")), ("?x", "made", "_:n"), ("_:n", "of", "?y"))
    assert made.count() == 4 and made.select("o").filter("o LIKE 'urn:blank:%'").distinct().count() == 2
    assert patterns.ask(patterns.bgp(g, ("?x", "q", "c"))) and not patterns.ask(patterns.bgp(g, ("?x", "q", "a")))


def test_term_order_and_functions(spark):
    df = spark.createDataFrame([(2, "10", "http://www.w3.org/2001/XMLSchema#integer"), (2, "9", "http://www.w3.org/2001/XMLSchema#integer"), (0, "urn:a", None), (1, "b0", None), (None, None, None)], "kind int, lex string, dt string")
    assert [r.lex for r in df.orderBy(*order_keys(F.col("kind"), F.col("lex"), F.col("dt"))).collect()] == [None, "b0", "urn:a", "9", "10"]
    assert spark.range(1).select(abbreviated(F.lit(f"{OWL}Class")), call("strafter", F.lit("a-b"), "-")).first()[:] == ("owl:Class", "b")
    with pytest.raises(ValueError):
        call("no-such-function")
    assert len(BUILTINS) > 70


def test_updates(spark):
    store = abox(spark, [("a", "p", "b")]).select("s", "p", "o").withColumn("g", F.lit(None).cast("string"))
    grown = update.insert(store, store.drop("g"), "urn:g")
    assert grown.count() == 2 and update.insert(grown, store).count() == 2
    assert pairs(update.clear(grown, "urn:g").select("s")) == [("a",)]
    assert update.clear(grown, which="all").count() == 0
    assert pairs(update.move(grown, "urn:g", "urn:h").filter("g IS NOT NULL").select("g")) == [("urn:h",)]


def test_store_and_stream(spark, tmp_path):
    quads = abox(spark, [("a", "p", "b"), ("a", "p", "c")]).select("s", "p", "o").withColumn("g", F.lit(None).cast("string"))
    store = update.GraphStore(spark, str(tmp_path / "stores"))
    store.write("x", quads)
    quads.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(quads.schema).parquet(str(tmp_path / "in"))
    ingest(stream, store, "x", str(tmp_path / "check")).awaitTermination(120)
    assert store.count("x") == 2 and store.names() == ["x"]
    store.drop("x")
    with pytest.raises(ValueError, match="no store"):
        store.read("x")


def test_axioms_and_models(spark):
    rows = axioms.axiom_rows(spark.createDataFrame([("a", "b")], "a string, b string"), "TransitiveObjectProperty", F.col("a"))
    assert pairs(axioms.to_triples(rows)) == [("a", TYPE, f"{OWL}TransitiveProperty")]
    with pytest.raises(ValueError, match="no axiom types"):
        axioms.of_types(rows, "NoSuchAxiom")
    m = facts(spark, ("r", "z", "y"), ("r", "x", "y"), ("s", "z"))
    assert pairs(models.relabelled(m, "r", 0, "n")) == [("r", ["n1", "y"]), ("r", ["n2", "y"]), ("s", ["n2"])]
    assert pairs(models.domain(m)) == [("x",), ("y",), ("z",)]
    hit, rest = axioms.split_by(spark.range(4), F.col("id") > 2)
    assert (hit.count(), rest.count()) == (1, 3)


def test_direct_links_equal_those_of_the_closure(spark):
    import random

    from quadrille.operators import hierarchy as hi
    from quadrille.plans.fixpoint import transitive_closure as closed

    r = random.Random(4)
    for _ in range(3):
        edges = spark.createDataFrame([(str(r.randint(0, 9)), str(r.randint(0, 9))) for _ in range(13)], "a string, b string")
        assert pairs(hi.direct_links(edges)) == pairs(hi.direct(closed(edges)))


def test_terms_across_solutions(spark):
    from quadrille.functions.terms import Literal

    rows = [("x", "p", "1", 2, "http://www.w3.org/2001/XMLSchema#integer", None), ("y", "q", "1", 2, None, None), ("z", "q", "1", 0, None, None), ("w", "q", "1", 2, "http://www.w3.org/2001/XMLSchema#integer", None)]
    g = spark.createDataFrame(rows, "s string, p string, o string, o_kind tinyint, o_dt string, o_lang string")
    a, b = patterns.bgp(g, ("?s", "p", "?v"), terms=True), patterns.bgp(g, ("?t", "q", "?v"), terms=True)
    assert [r.t for r in patterns.natural_join(a, b).collect()] == ["w"]
    assert sorted(r.t for r in patterns.minus(b, a.drop("s", "__t_s")).collect()) == ["y", "z"]
    assert sorted(r.t for r in patterns.optional(b, a).filter("s IS NULL").collect()) == ["y", "z"]
    assert sorted(r.s for r in patterns.bgp(g, ("?s", "q", Literal("1"))).collect()) == ["y"]
    assert sorted(r.s for r in patterns.bgp(g, ("?s", patterns.iri("p") | "q", Literal("1", "xsd:integer"))).collect()) == ["w", "x"]


def test_rounds_meet_only_news(spark):
    """Inverse, symmetric and subproperties in turn: what rounds over the new triples alone find is what rounds over all do."""
    iri = lambda x: f"{OWL}{x}"
    rows = [("p", SUBPROPERTY, "q"), ("q", iri("inverseOf"), "r"), ("r", SUBPROPERTY, "t"), ("t", TYPE, iri("SymmetricProperty")), ("t", DOMAIN, "c"), ("c", SUBCLASS, "d"), ("x", "p", "y"), ("z", "r", "x")]
    g = abox(spark, rows)
    base = entailment._seed(g)
    present = entailment.rs.present(base)
    assert entailment._fixed_schema(base, present) and not entailment._fixed_schema(base, {*present, iri("TransitiveProperty")})
    assert not entailment._fixed_schema(entailment._seed(abox(spark, [("p", SUBPROPERTY, SUBCLASS)])), present)
    assert pairs(entailment.rdfs_plus(g)) == pairs(entailment._fixpoint(base, entailment._plus))
    assert ("y", "r", "x") in pairs(entailment.rdfs_plus(g)) and ("x", TYPE, "d") in pairs(entailment.rdfs_plus(g))
