"""Profiles: each kind of violation by an axiom of its own, and axioms that fit."""

import pytest

from quadrille.functions.terms import OWL, RDFS, XSD
from quadrille.operators import profiles as pr

DECLARED = [f"(Declaration (Class {c}))" for c in "ABC"] + [f"(Declaration (ObjectProperty {p}))" for p in ("p", "q", "r", "t")] + ["(Declaration (DataProperty d))", "(Declaration (Datatype D))", "(Declaration (Datatype E))", "(Declaration (AnnotationProperty note))"]


def found(spark, *texts, profile="dl", absolute=False, declared=True):
    every = [*(DECLARED if declared else []), *texts]
    rows = [(str(i), t.split(" ")[0].strip("()"), t) for i, t in enumerate(every)]
    df = spark.createDataFrame(rows, "axiom_id string, axiom_type string, sexpr string")
    return {(r.violation, every[int(r.axiom_id)]) for r in pr.violations(df, profile, absolute).collect()}


def test_dl(spark):
    bad = [
        ("undeclared class", "(SubClassOf A X)"), ("undeclared object property", "(SubClassOf A (ObjectSomeValuesFrom x B))"), ("undeclared data property", "(SubClassOf A (DataHasValue x \"1\"))"), ("undeclared datatype", "(DataPropertyRange d X)"),
        ("undeclared annotation property", "(AnnotationAssertion x A \"text\")"), ("reserved name of a class", f"(Declaration (Class {OWL}Kind))"), ("reserved name of a object property", f"(Declaration (ObjectProperty {OWL}has))"),
        ("reserved name of a data property", f"(Declaration (DataProperty {XSD}has))"), ("reserved name of a annotation property", f"(Declaration (AnnotationProperty {RDFS}has))"), ("reserved name of a individual", f"(Declaration (NamedIndividual {OWL}me))"),
        ("built-in datatype defined", f"(DatatypeDefinition {XSD}integer D)"), ("defined datatype restricted", f"(DataPropertyRange d (DatatypeRestriction E {XSD}minInclusive \"1\"))"), ("unknown datatype", f"(DataPropertyRange d {XSD}none)"),
        ("cycle of datatypes", "(DatatypeDefinition D (DataComplementOf E))"), ("cycle of datatypes", "(DatatypeDefinition E (DataUnionOf D))"), ("illegal facet", f"(DataPropertyRange d (DatatypeRestriction {XSD}integer {XSD}most \"1\"))"),
        ("lexical form", f"(SubClassOf A (DataHasValue d \"one\"^^{XSD}integer))"), ("top data property below another", f"(SubDataPropertyOf {OWL}topDataProperty d)"), ("illegal axiom", "(SubClassOf A"), ("illegal axiom", "(Rule A B)"),
        ("illegal class expression", "(SubClassOf A (Some p B))"), ("illegal data range", "(DataPropertyRange d (DataSome D))"), ("class and datatype", "(Declaration (Datatype A))"),
    ]
    good = ["(SubClassOf A (ObjectMaxCardinality 1 p (ObjectUnionOf B (ObjectComplementOf C))))", f"(DataPropertyRange d (DatatypeRestriction {XSD}integer {XSD}minInclusive \"1\"^^{XSD}integer))", f"(SubClassOf A {OWL}Thing)", "(AnnotationAssertion note A \"text\")"]
    assert found(spark, *[t for _, t in bad], *good) == set(bad)


def test_simple_properties_and_regular_order(spark):
    bad = [
        ("not simple in a cardinality", "(SubClassOf A (ObjectMinCardinality 2 (ObjectInverseOf q) B))"), ("not simple in a restriction to self", "(SubClassOf A (ObjectHasSelf t))"), ("not simple in a functional property", "(FunctionalObjectProperty t)"),
        ("not simple in an inverse functional property", "(InverseFunctionalObjectProperty t)"), ("not simple in an irreflexive property", "(IrreflexiveObjectProperty q)"), ("not simple in an asymmetric property", "(AsymmetricObjectProperty t)"), ("not simple in disjoint properties", "(DisjointObjectProperties t p)"),
    ]
    good = ["(TransitiveObjectProperty t)", "(SubObjectPropertyOf t q)", "(FunctionalObjectProperty p)", "(SubObjectPropertyOf (ObjectPropertyChain t t) t)", "(SubObjectPropertyOf (ObjectPropertyChain t p) t)", "(SubObjectPropertyOf (ObjectPropertyChain p t) t)"]
    assert found(spark, *[t for _, t in bad], *good) == set(bad)
    turns = ["(SubObjectPropertyOf (ObjectPropertyChain p q) r)", "(SubObjectPropertyOf (ObjectPropertyChain r q) p)"]
    middle, ends = "(SubObjectPropertyOf (ObjectPropertyChain p t p) t)", "(SubObjectPropertyOf (ObjectPropertyChain q r q) q)"
    assert found(spark, *turns) == {("cycle through a chain", t) for t in turns}
    assert found(spark, middle, ends) == {("cycle through a chain", middle), ("cycle through a chain", ends)}


def test_el(spark):
    bad = [
        ("illegal axiom", "(SymmetricObjectProperty p)"), ("illegal class expression", "(SubClassOf A (ObjectSomeValuesFrom p (ObjectIntersectionOf B (ObjectUnionOf A C))))"), ("inverse property", "(SubClassOf A (ObjectSomeValuesFrom (ObjectInverseOf p) B))"),
        ("several individuals", "(SubClassOf A (ObjectOneOf i j))"), ("several literals", "(DataPropertyRange d (DataOneOf \"1\" \"2\"))"), ("anonymous individual", "(ClassAssertion A _:i)"), ("illegal data range", f"(DataPropertyRange d {XSD}double)"),
        ("range of a chain", "(SubObjectPropertyOf (ObjectPropertyChain p q) r)"),
    ]
    good = ["(ObjectPropertyRange r A)", "(SubClassOf A (ObjectOneOf i))", "(SubClassOf A (ObjectSomeValuesFrom p (ObjectHasSelf q)))", "(ReflexiveObjectProperty p)", "(HasKey A p d)", "(ClassAssertion A i)"]
    assert found(spark, *[t for _, t in bad], *good, profile="el") == set(bad)
    assert ("range of a chain", bad[-1][1]) not in found(spark, bad[-1][1], good[0], "(ObjectPropertyRange q A)", profile="el")


def test_ql_and_rl(spark):
    some, deep, both = "(SubClassOf (ObjectSomeValuesFrom p A) B)", "(SubClassOf A (ObjectSomeValuesFrom p (ObjectIntersectionOf B C)))", "(EquivalentClasses A (ObjectSomeValuesFrom p B))"
    thing, top = f"(SubClassOf (ObjectSomeValuesFrom p {OWL}Thing) B)", f"(SubClassOf {OWL}Thing A)"
    fact, many, every = "(ClassAssertion (ObjectSomeValuesFrom p B) i)", "(SubClassOf A (ObjectMaxCardinality 2 p B))", "(SubClassOf A (ObjectAllValuesFrom p (ObjectComplementOf (ObjectUnionOf B C))))"
    assert found(spark, some, deep, thing, fact, "(TransitiveObjectProperty t)", profile="ql") == {("not a subclass expression", some), ("not an atomic class", deep), ("not an atomic class", fact), ("illegal axiom", "(TransitiveObjectProperty t)")}
    want = {("not a superclass expression", deep), ("not an equivalent class expression", both), ("not a subclass expression", top), ("not a superclass expression", many), ("not a superclass expression", fact)}
    assert found(spark, some, deep, both, thing, top, fact, many, every, profile="rl") == want


def test_names_and_profiles(spark):
    assert found(spark, "(SubClassOf urn:a b)", absolute=True, declared=False) == {("undeclared class", "(SubClassOf urn:a b)"), ("name not absolute", "(SubClassOf urn:a b)")}
    with pytest.raises(ValueError):
        found(spark, "(SubClassOf A B)", profile="full")
