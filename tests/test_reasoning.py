"""Axiom trees, completion, explanations, goals."""

import pytest
from pyspark.sql import functions as F

from quadrille.operators import axioms as ax
from quadrille.operators import completion as cm
from quadrille.operators import trees
from quadrille.plans import fixpoint
from quadrille.plans.fixpoint import Rule, answers, proofs, saturate, saturate_layers, strata


def onto(spark, *texts):
    rows = [(f"a{i}", t[1:].split(" ")[0], t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "axiom_id string, axiom_type string, sexpr string")


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def facts(spark, *rows):
    return spark.createDataFrame([(p, list(a)) for p, *a in rows], "pred string, args array<string>")


def test_nodes(spark):
    text = '(SubClassOf A  (ObjectSomeValuesFrom p (ObjectIntersectionOf B "x (y) \\" z"@en)))'
    rows = trees.nodes(onto(spark, text, "(Broken", "", "name")).filter("axiom_id = 'a0'").orderBy("node").collect()
    assert [(r.node, r.parent, r.place, r["head"], r.leaf) for r in rows] == [
        (0, -1, 0, "SubClassOf", False), (1, 0, 1, "A", True), (2, 0, 2, "ObjectSomeValuesFrom", False), (3, 2, 1, "p", True), (4, 2, 2, "ObjectIntersectionOf", False),
        (5, 4, 1, "B", True), (6, 4, 2, '"x (y) \\" z"@en', True),
    ]
    assert rows[0].text == text.replace("  ", " ") and rows[2].args == ["p", '(ObjectIntersectionOf B "x (y) \\" z"@en)']
    assert sorted({r.axiom_id for r in trees.nodes(onto(spark, text, "(Broken", ")", "", "name")).collect()}) == ["a0", "a4"]


NESTED = "(SubClassOf A (ObjectSomeValuesFrom p (ObjectIntersectionOf B (ObjectAllValuesFrom q (ObjectUnionOf C D E)))))"


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        ("(SubClassOf ?a (ObjectSomeValuesFrom ?p ?f))", [("A", "p", "(ObjectIntersectionOf B (ObjectAllValuesFrom q (ObjectUnionOf C D E)))")]),
        ("(SubClassOf ?a (ObjectSomeValuesFrom ?p (ObjectIntersectionOf ?b (ObjectAllValuesFrom ?q ?f))))", [("A", "p", "B", "q", "(ObjectUnionOf C D E)")]),
        ("(?op ?a ?_)", [("SubClassOf", "A"), ("SubClassOf", "X")]),
        ("(SubClassOf ?a ?a)", [("X",)]),
        ("(EquivalentClasses ?a ?*rest)", [("K", "L M N")]),
        ("(EquivalentClasses ?*rest N)", [("K L M",)]),
        ("(EquivalentClasses K ?*mid N)", [("L M",)]),
        ("(EquivalentClasses K L M N ?*none)", [("",)]),
        ("(SubClassOf (?is ?a short) (?not (ObjectSomeValuesFrom ?p ?f)))", [("X",)]),
        ("(?or (SubClassOf ?a ?a) (EquivalentClasses ?a ?b ?*c))", [("K", "L", "M N"), ("X", None, None)]),
        ("(SubClassOf ?a (?and ?b (ObjectSomeValuesFrom ?p ?_)) (?if differ))", [("A", "(ObjectSomeValuesFrom p (ObjectIntersectionOf B (ObjectAllValuesFrom q (ObjectUnionOf C D E))))", "p")]),
        ("(SubClassOf ?a ?b ?c)", []),
    ],
)
def test_patterns(spark, pattern, want):
    df = onto(spark, NESTED, "(SubClassOf X X)", "(EquivalentClasses K L M N)", "(Broken")
    tests = {"short": lambda t: F.length(t) == 1, "differ": lambda b: b["a"] != b["b"]}
    got = trees.matching(df, pattern, tests).drop("axiom_id", "axiom_type", "sexpr")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_patterns_anywhere(spark):
    got = trees.matching(onto(spark, NESTED), "(ObjectUnionOf ?a ?*b)", anywhere=True)
    assert [(r.part, r.a, r.b) for r in got.collect()] == [("(ObjectUnionOf C D E)", "C", "D E")]
    with pytest.raises(ValueError):
        trees.matching(onto(spark, NESTED), "(ObjectUnionOf ?*a ?*b)")


def test_shapes_of_capitalised_names(spark):
    df = onto(spark, "(SubClassOf Person Agent)", "(SubClassOf a B)", "(SubClassOf A (ObjectMinCardinality 2 P Q))", '(AnnotationAssertion label Person "A (b) c"@en)')
    assert sorted((r["shape"], r.n) for r in ax.shapes(df).collect()) == [("(AnnotationAssertion _ _ _)", 1), ("(SubClassOf _ (ObjectMinCardinality 2 _ _))", 1), ("(SubClassOf _ _)", 2)]


def test_unsatisfiable_conjunction(spark):
    df = onto(spark, "(DisjointClasses a b)", "(EquivalentClasses c (ObjectIntersectionOf a b))", "(SubClassOf d (ObjectSomeValuesFrom p c))")
    full = cm.completed(df)
    assert pairs(cm.unsatisfiable(df, full)) == [("c",), ("d",)]
    assert pairs(cm.inconsistent(df, full)) == []
    assert pairs(cm.inconsistent(df.unionByName(onto(spark, "(ClassAssertion d i)").withColumn("axiom_id", F.lit("z"))))) == [("i",)]


def test_equal_classes_have_one_name(spark):
    """A class of many equal names, and restrictions to them, cost a row each: no pairs of names are made."""
    made = [f"(EquivalentClasses c{i:03} (ObjectIntersectionOf a b))" for i in range(200)] + [f"(SubClassOf d{i:03} (ObjectSomeValuesFrom p c{i:03}))" for i in range(200)]
    nested = [f"(EquivalentClasses e{i} (ObjectIntersectionOf c00{i} k (ObjectSomeValuesFrom p c00{i})) f{i})" for i in range(5)]
    df = onto(spark, "(DisjointClasses a b)", "(SubClassOf a k)", "(ClassAssertion k i)", *made, *nested)
    facts, names = cm.by_one_name(cm.normal_form(df))
    assert facts.filter("pred IN ('told', 'both', 'some')").count() < 250
    assert names.filter("node RLIKE '^[a-z]'").groupBy("root").count().agg(F.sum("count")).first()[0] == 210
    assert cm._closed(facts).count() < 2500
    assert {r.node for r in cm.unsatisfiable(df).collect()} == {*[f"c{i:03}" for i in range(200)], *[f"d{i:03}" for i in range(200)], *[f"e{i}" for i in range(5)], *[f"f{i}" for i in range(5)]}


def test_one_name_finds_what_all_names_do(spark):
    df = onto(
        spark, "(EquivalentClasses a b c)", "(DisjointClasses c d)", "(SubClassOf x (ObjectIntersectionOf b d))", "(EquivalentClasses y (ObjectSomeValuesFrom p x))", "(SubClassOf z (ObjectSomeValuesFrom p y))",
        "(EquivalentClasses e http://www.w3.org/2002/07/owl#Nothing)", "(ClassAssertion e i)", "(SameIndividual i j)", "(EquivalentClasses f p)", "(ObjectPropertyDomain p f)",
        "(EquivalentClasses g (ObjectIntersectionOf k l m))", "(EquivalentClasses k k2)", "(EquivalentClasses h (ObjectIntersectionOf k2 l m))", "(DisjointClasses g h)", "(SubClassOf s h)",
    )
    full = cm.completed(df)
    assert pairs(cm.unsatisfiable(df)) == pairs(cm.unsatisfiable(df, full)) != [] and pairs(cm.inconsistent(df)) == pairs(cm.inconsistent(df, full)) != []


def test_union_and_complement(spark):
    assert pairs(cm.subsumptions(onto(spark, "(EquivalentClasses c (ObjectUnionOf a b))"))) == [("a", "c"), ("b", "c")]
    assert pairs(cm.unsatisfiable(onto(spark, "(SubClassOf a b)", "(EquivalentClasses b (ObjectComplementOf a))"))) == [("a",)]


def test_classified_by_restrictions(spark):
    df = onto(
        spark, "(EquivalentClasses a (ObjectSomeValuesFrom p b))", "(SubClassOf x (ObjectSomeValuesFrom q y))", "(SubClassOf y b)", "(SubObjectPropertyOf q p)",
        "(SubObjectPropertyOf (ObjectPropertyChain p r s) p)", "(SubClassOf u (ObjectSomeValuesFrom p v))", "(SubClassOf v (ObjectSomeValuesFrom r w))", "(SubClassOf w (ObjectSomeValuesFrom s y))",
        "(ObjectPropertyDomain q k)", "(EquivalentClasses m (ObjectIntersectionOf k (ObjectSomeValuesFrom p b) a))", "(EquivalentClasses l (ObjectMinCardinality 1 q y))",
    )
    full = cm.completed(df)
    got = set(pairs(cm.subsumptions(df, full)))
    assert got == {("x", "a"), ("u", "a"), ("x", "k"), ("x", "m"), ("y", "b"), ("l", "a"), ("l", "k"), ("l", "m"), ("x", "l"), ("m", "a"), ("m", "k")}
    assert {("p", "x", "b"), ("p", "u", "b"), ("q", "x", "y"), ("p", "u", "y")} <= set(pairs(cm.class_links(df, full)))


def test_individuals(spark):
    df = onto(
        spark, "(ClassAssertion a i)", "(ObjectPropertyAssertion p i j)", "(ObjectPropertyRange p b)", "(InverseObjectProperties p q)", "(EquivalentClasses c (ObjectHasValue q i))",
        "(DisjointClasses a b)", "(SubClassOf d a)", "(SubClassOf e b)", "(EquivalentClasses f a)",
    )
    got = {tuple(r) for r in cm.inferred(df).collect()}
    assert {("ClassAssertion", "b", "j", None), ("ClassAssertion", "c", "j", None), ("ClassAssertion", "f", "i", None), ("ObjectPropertyAssertion", "q", "j", "i"), ("DisjointClasses", "d", "e", None)} <= got
    assert ("EquivalentClasses", "a", "f", None) in got and ("SubClassOf", "d", "f", None) in got
    assert ("ClassAssertion", "b", "i", None) not in got
    broken = df.unionByName(onto(spark, "(NegativeObjectPropertyAssertion q j i)").withColumn("axiom_id", F.lit("z")))
    assert "j" in {r.node for r in cm.inconsistent(broken).collect()}


def test_names_with_marks(spark):
    """Names may hold a number sign; the steps of a long chain aren't told as properties."""
    df = onto(spark, "(SubObjectPropertyOf (ObjectPropertyChain http://x#p http://x#q http://x#r) http://x#s)", *[f"(ObjectPropertyAssertion http://x#{p} i{k} i{k + 1})" for k, p in enumerate("pqr")])
    got = {tuple(r) for r in cm.inferred(df).filter("axiom_type = 'ObjectPropertyAssertion'").select("a", "b", "c").collect()}
    assert got == {("http://x#p", "i0", "i1"), ("http://x#q", "i1", "i2"), ("http://x#r", "i2", "i3"), ("http://x#s", "i0", "i3")}


def sets_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.explanation, set()).add(r.axiom_id)
        assert r.whole
    return sorted(map(sorted, out.values()))


def test_explanations(spark):
    df = onto(spark, "(SubClassOf a b)", "(EquivalentClasses b (ObjectComplementOf a))", "(SubClassOf z y)")
    assert sets_of(cm.explanations(df, "a")) == [["a0", "a1"]]
    thing, nothing = cm.THING, cm.NOTHING
    assert sets_of(cm.explanations(onto(spark, f"(SubClassOf a {nothing})", f"(SubClassOf {thing} a)", "(SubClassOf b c)"), thing)) == [["a0", "a1"]]


def test_two_explanations(spark):
    df = onto(spark, "(SubClassOf a b)", "(SubClassOf b c)", "(SubClassOf a (ObjectIntersectionOf c d))", "(SubClassOf a d)", "(SubClassOf d b)", "(SubClassOf q a)")
    assert sets_of(cm.explanations(df, "a", "c")) == [["a0", "a1"], ["a1", "a3", "a4"], ["a2"]]
    assert cm.explanations(df, "b", "a").count() == 0
    few = cm.explanations(df, "a", "c", most=1).collect()
    assert {r.axiom_id for r in few} == {"a2"} and not any(r.whole for r in few)


def test_proofs_absorb(spark):
    given = spark.createDataFrame([("e", ["1", "2"], ["x"]), ("e", ["2", "3"], ["y"]), ("e", ["1", "3"], ["z"]), ("e", ["1", "3"], ["z", "w"]), ("e", ["3", "1"], ["v"])], "pred string, args array<string>, why array<string>")
    got = proofs(given, [Rule(("r", "?a", "?b"), (("e", "?a", "?b"),)), Rule(("r", "?a", "?c"), (("r", "?a", "?b"), ("e", "?b", "?c")))])
    rows = sorted((tuple(r.args), tuple(r.why)) for r in got.filter("pred = 'r'").collect())
    assert [w for a, w in rows if a == ("1", "3")] == [("x", "y"), ("z",)]
    assert [w for a, w in rows if a == ("1", "1")] == [("v", "x", "y"), ("v", "z")]


def test_strata(spark):
    rules = [Rule(("c", "?x"), (("n", "?x"),), (("b", "?x"),)), Rule(("b", "?x"), (("n", "?x"),), (("a", "?x"),)), Rule(("a", "?x"), (("e", "?x"),)), Rule(("d", "?x"), (("c", "?x"), ("n", "?x")))]
    assert [[r.head[0] for r in layer] for layer in strata(rules)] == [["a"], ["b"], ["c", "d"]]
    got = saturate_layers(facts(spark, ("n", "1"), ("n", "2"), ("e", "1")), rules)
    assert pairs(got.filter("pred = 'd'")) == [("d", ["1"])] and pairs(got.filter("pred = 'b'")) == [("b", ["2"])]
    with pytest.raises(ValueError, match="cycle"):
        strata([Rule(("a", "?x"), (("n", "?x"),), (("b", "?x"),)), Rule(("b", "?x"), (("n", "?x"),), (("a", "?x"),))])


def test_goals(spark):
    base = facts(spark, ("p", "x"), ("q", "x"), ("s", "y"))
    rule = Rule(("r", "?a"), (("p", "?a"), ("q", "?a")))
    assert pairs(answers(base, [rule], ("r", "?z"))) == [("x",)] and answers(base, [rule], ("r", "x")).count() == 1 and answers(base, [rule], ("r", "y")).count() == 0
    edges = facts(spark, *[("e", f"{c}{i}", f"{c}{i + 1}") for c in "abc" for i in range(12)])
    path = [Rule(("t", "?x", "?y"), (("e", "?x", "?y"),)), Rule(("t", "?x", "?z"), (("e", "?x", "?y"), ("t", "?y", "?z")))]
    kept = []
    got = pairs(answers(edges, path, ("t", "a8", "?y"), kept.append))
    assert got == [("a10",), ("a11",), ("a12",), ("a9",)]
    assert kept[0].filter(F.col("pred").startswith("t/")).count() == 10  # of 234 that all would be
    assert pairs(answers(edges, path, ("t", "?x", "b2"))) == [("b0",), ("b1",)]
    same = [Rule(("sg", "?x", "?y"), (("up", "?x", "?u"), ("sg", "?u", "?v"), ("down", "?v", "?y"))), Rule(("sg", "?x", "?y"), (("flat", "?x", "?y"),))]
    tree = facts(spark, ("up", "a", "e"), ("up", "b", "e"), ("flat", "e", "f"), ("down", "f", "c"), ("down", "f", "d"), ("up", "z", "y"), ("flat", "y", "y"), ("down", "y", "z"))
    want = sorted(r["args"][1] for r in saturate(tree, same).filter("pred = 'sg' AND args[0] = 'a'").collect())
    assert [r.y for r in sorted(answers(tree, same, ("sg", "a", "?y")).collect())] == want == ["c", "d"]


def test_bodies_without_a_shared_variable(spark):
    got = saturate(facts(spark, ("p", "1"), ("p", "2"), ("q", "3")), [Rule(("r", "?a", "?b"), (("p", "?a"), ("q", "?b")))])
    assert pairs(got.filter("pred = 'r'")) == [("r", ["1", "3"]), ("r", ["2", "3"])]


def test_products_of_large_sides(spark, monkeypatch):
    monkeypatch.setattr(fixpoint, "SMALL", 2)
    a, b = spark.range(5).toDF("a"), spark.range(4).toDF("b")
    assert fixpoint.product(a, b).count() == 20
