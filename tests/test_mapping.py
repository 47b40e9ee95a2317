"""Axioms to triples and back."""

import pytest

from quadrille.functions.terms import OWL, SUBCLASS, TYPE
from quadrille.operators import mapping as mp

EVERY = [
    "(Declaration (Class a))", "(Declaration (DataProperty d))", "(Declaration (DataProperty e))", "(Declaration (AnnotationProperty note))", "(Declaration (ObjectProperty p))", "(Declaration (Datatype mine))",
    "(SubClassOf a a)", "(SubClassOf a (ObjectSomeValuesFrom p (ObjectIntersectionOf b (ObjectAllValuesFrom (ObjectInverseOf q) (ObjectUnionOf c (ObjectComplementOf d1) e1)))))",
    "(SubClassOf (ObjectMinCardinality 2 p) (ObjectMaxCardinality 3 p b))", "(SubClassOf (ObjectExactCardinality 1 p) (ObjectExactCardinality 0 p b))", "(SubClassOf (ObjectHasSelf p) (ObjectHasValue p i))",
    "(SubClassOf (ObjectOneOf i j k) (DataSomeValuesFrom d (DataOneOf \"1\" \"two words\"@en)))", "(SubClassOf x (DataMinCardinality 2 d mine))", "(SubClassOf y (DataAllValuesFrom d (DataComplementOf mine)))",
    "(SubClassOf z (DataHasValue d \"v\"))", "(EquivalentClasses a (ObjectIntersectionOf b c))", "(DisjointClasses a b)", "(DisjointClasses a b (ObjectComplementOf c))", "(DisjointUnion a b c d2)",
    "(SubObjectPropertyOf p q)", "(SubDataPropertyOf d e)", "(SubObjectPropertyOf (ObjectPropertyChain p q r) s)", "(EquivalentObjectProperties p q)", "(DisjointObjectProperties p q r)", "(DisjointDataProperties d e)",
    "(InverseObjectProperties p q)", "(ObjectPropertyDomain p (ObjectUnionOf a b))", "(DataPropertyRange d mine)", "(ObjectPropertyRange p b)", "(FunctionalObjectProperty p)", "(FunctionalDataProperty d)", "(TransitiveObjectProperty p)",
    "(HasKey a p d)", "(SameIndividual i j)", "(DifferentIndividuals i j k)", "(DifferentIndividuals i k)", "(ClassAssertion (ObjectSomeValuesFrom p a) i)", "(ClassAssertion a i)", "(ObjectPropertyAssertion p i i)",
    "(NegativeObjectPropertyAssertion p i j)", "(NegativeDataPropertyAssertion d i \"3\")", "(DataPropertyAssertion d i \"4\")", "(AnnotationAssertion note i \"text\"@en)",
]


def onto(spark, *texts):
    return spark.createDataFrame([(f"a{i}", t) for i, t in enumerate(texts)], "axiom_id string, sexpr string")


def test_every_construct_comes_back(spark):
    triples = mp.triples_of(onto(spark, *EVERY))
    rows = triples.collect()
    assert all(r.s and r.p and r.o for r in rows)
    got = sorted(r.sexpr for r in mp.axioms_of(triples).collect())
    assert got == sorted(EVERY)


def test_members_of_equivalences_stay(spark):
    triples = mp.triples_of(onto(spark, "(EquivalentClasses A B C)", "(SubClassOf A A)"))
    assert sorted(map(tuple, triples.collect())) == sorted([("A", f"{OWL}equivalentClass", "B"), ("A", SUBCLASS, "A"), ("B", f"{OWL}equivalentClass", "C")])
    assert sorted(r.sexpr for r in mp.axioms_of(triples).collect()) == ["(EquivalentClasses A B)", "(EquivalentClasses B C)", "(SubClassOf A A)"]


def test_unqualified_cardinalities_have_their_own_predicate(spark):
    ps = {r.p for r in mp.triples_of(onto(spark, "(SubClassOf a (ObjectMinCardinality 2 p))")).collect()}
    assert ps == {SUBCLASS, TYPE, f"{OWL}onProperty", f"{OWL}minCardinality"}


def test_what_has_no_form_is_an_error(spark):
    with pytest.raises(Exception, match="no triples for Unheard"):
        mp.triples_of(onto(spark, "(Unheard a b)")).collect()
    with pytest.raises(ValueError, match="hold themselves"):
        mp.axioms_of(spark.createDataFrame([("urn:blank:x", f"{OWL}complementOf", "urn:blank:x"), ("a", SUBCLASS, "urn:blank:x")], "s string, p string, o string"))
