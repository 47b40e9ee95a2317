"""Bundles of rules over lists, keys, cardinalities and equals, and what can't be."""

import pytest

from quadrille.functions.terms import DOMAIN, IRI, LITERAL, OWL, RANGE, RDF, SUBCLASS, SUBPROPERTY, TYPE
from quadrille.operators import entailment as en

SAME = f"{OWL}sameAs"


def graph(spark, *triples):
    return spark.createDataFrame(list(triples), "s string, p string, o string")


def items(name, *members):
    cells = [f"urn:blank:{name}{i}" for i in range(len(members))] + [f"{RDF}nil"]
    return cells[0], [t for i, m in enumerate(members) for t in ((cells[i], f"{RDF}first", m), (cells[i], f"{RDF}rest", cells[i + 1]))]


def owned(owner, predicate, name, *members):
    head, cells = items(name, *members)
    return [(owner, f"{OWL}{predicate}", head), *cells]


def restriction(v, kind, value, p, *more):
    return [(v, f"{OWL}onProperty", p), (v, f"{OWL}{kind}", value), *more]


def closed(spark, rows, bundle="owl2-rl"):
    return {tuple(r) for r in en.entailed(graph(spark, *rows), bundle).select("s", "p", "o").collect()}


def test_lists_of_classes(spark):
    rows = owned("AB", "intersectionOf", "i", "A", "B", "A") + owned("U", "unionOf", "u", "A", "C") + owned("E", "oneOf", "e", "n1", "n2")
    got = closed(spark, rows + [("x", TYPE, "A"), ("x", TYPE, "B"), ("y", TYPE, "A"), ("z", TYPE, "AB")])
    types = {(s, o) for s, p, o in got if p == TYPE}
    assert types == {("x", "A"), ("x", "B"), ("x", "AB"), ("x", "U"), ("y", "A"), ("y", "U"), ("z", "AB"), ("z", "A"), ("z", "B"), ("z", "U"), ("n1", "E"), ("n2", "E")}


def test_chains_of_several_lengths(spark):
    rows = owned("far", "propertyChainAxiom", "c", "r", "r", "t") + owned("far", "propertyChainAxiom", "d", "q") + owned("again", "propertyChainAxiom", "f", "far", "far")
    got = closed(spark, rows + [("a", "r", "b"), ("b", "r", "c"), ("c", "t", "d"), ("d", "q", "e")])
    assert {(s, o) for s, p, o in got if p == "far"} == {("a", "d"), ("d", "e")}
    assert {(s, o) for s, p, o in got if p == "again"} == {("a", "e")}  # a chain of what a chain has made


def test_keys_make_one_individual_and_pairs_only_in_the_output(spark):
    rows = owned("P", "hasKey", "k", "name", "born") + [(x, TYPE, "P") for x in "abcd"]
    rows += [("a", "name", "n"), ("a", "born", "y"), ("b", "name", "n"), ("b", "name", "m"), ("b", "born", "y"), ("c", "name", "m"), ("c", "born", "y"), ("d", "name", "n"), ("d", "born", "z"), ("o", "name", "n"), ("o", "born", "y"), ("c", "owns", "w")]
    whole = en.Closed(graph(spark, *rows), "owl2-rl")
    assert {tuple(r) for r in whole.equals.collect()} == {("a", "a"), ("b", "a"), ("c", "a")}
    assert {tuple(r) for r in whole.graph.filter("p = 'owns'").select("s", "o").collect()} == {("a", "w")}
    got = {tuple(r) for r in whole.triples().collect()}
    assert {(x, "owns", "w") for x in "abc"} <= got and {(x, SAME, y) for x in "abc" for y in "abc" if x != y} == {t for t in got if t[1] == SAME}


def test_literals_are_never_equal_individuals(spark):
    rows = [("f", TYPE, f"{OWL}FunctionalProperty", IRI), ("x", "f", "1", LITERAL), ("x", "f", "2", LITERAL), ("1", "f", "2", IRI), ("1", "f", "3", IRI)]
    df = spark.createDataFrame(rows, "s string, p string, o string, o_kind int")
    whole = en.Closed(df, "horst")
    assert {tuple(r) for r in whole.equals.collect()} == {("2", "2"), ("3", "2")}
    assert {(r.o, r.thing) for r in whole.graph.filter("s = 'x'").collect()} == {("1", False), ("2", False)}


def test_maximum_cardinalities(spark):
    rows = restriction("v", "maxCardinality", '"1"^^http://www.w3.org/2001/XMLSchema#nonNegativeInteger', "p") + restriction("w", "maxQualifiedCardinality", "1", "q", ("w", f"{OWL}onClass", "C"))
    rows += [("x", TYPE, "v"), ("x", "p", "m"), ("x", "p", "l"), ("y", "p", "m"), ("y", "p", "k"), ("x", TYPE, "w"), ("x", "q", "g"), ("x", "q", "h"), ("x", "q", "i"), ("g", TYPE, "C"), ("i", TYPE, "C")]
    assert {t for t in closed(spark, rows) if t[1] == SAME} == {("l", SAME, "m"), ("m", SAME, "l"), ("g", SAME, "i"), ("i", SAME, "g")}


def test_equals_found_in_rounds(spark):
    """A name that becomes equal makes its values equal, and these theirs."""
    rows = [("f", TYPE, f"{OWL}FunctionalProperty"), ("a", SAME, "b"), ("a", "f", "c"), ("b", "f", "d"), ("c", "f", "e"), ("d", "f", "g"), ("g", SAME, "aa")]
    whole = en.Closed(graph(spark, *rows), "owl2-rl")
    assert {tuple(r) for r in whole.equals.collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("e", "aa"), ("g", "aa"), ("aa", "aa")}


def test_schema_rules(spark):
    rows = [("A", SUBCLASS, "B"), ("B", SUBCLASS, "A"), ("p", SUBPROPERTY, "q"), ("q", DOMAIN, "A"), ("q", RANGE, "B")]
    rows += restriction("v1", "someValuesFrom", "A", "p") + restriction("v2", "someValuesFrom", "C", "p") + restriction("a1", "allValuesFrom", "A", "p") + restriction("a2", "allValuesFrom", "A", "q") + [("A", SUBCLASS, "C")]
    got = closed(spark, rows)
    assert {("A", f"{OWL}equivalentClass", "B"), ("B", f"{OWL}equivalentClass", "A"), ("p", DOMAIN, "A"), ("q", DOMAIN, "C"), ("p", RANGE, "B")} <= got
    assert ("v1", SUBCLASS, "v2") in got and ("v2", SUBCLASS, "v1") not in got and ("a2", SUBCLASS, "a1") in got and ("a1", SUBCLASS, "a2") not in got


def test_bundles_differ(spark):
    rows = [("t", TYPE, f"{OWL}TransitiveProperty"), ("a", "t", "b"), ("b", "t", "c"), ("i", f"{OWL}inverseOf", "t")] + restriction("v", "someValuesFrom", f"{OWL}Thing", "t") + [("v", SUBCLASS, "Holder")]
    ql, rl = closed(spark, rows, "owl2-ql"), closed(spark, rows)
    assert ("a", "t", "c") not in ql and ("a", "t", "c") in rl
    assert ("a", TYPE, "Holder") in ql and ("a", TYPE, "Holder") in rl and ("b", "i", "a") in ql
    most = restriction("m", "maxCardinality", "1", "f") + [(f"{OWL}Thing", SUBCLASS, "m"), ("g", f"{OWL}inverseOf", "f")] + restriction("n", "minCardinality", "1", "f") + [("x", "f", "y"), ("x", "f", "z")]
    strong = closed(spark, most, "owl-max")
    assert {("f", TYPE, f"{OWL}FunctionalProperty"), ("g", TYPE, f"{OWL}InverseFunctionalProperty"), ("x", TYPE, "n"), ("y", SAME, "z")} <= strong
    with pytest.raises(ValueError):
        en.entailed(graph(spark, *rows), "owl2-el")


def test_contradictions(spark):
    rows = [("a", SAME, "b"), ("b", f"{OWL}differentFrom", "a"), ("irr", TYPE, f"{OWL}IrreflexiveProperty"), ("a", "irr", "b"), ("asy", TYPE, f"{OWL}AsymmetricProperty"), ("c", "asy", "d"), ("d", "asy", "c"), ("e", "asy", "c")]
    rows += [("p", f"{OWL}propertyDisjointWith", "q"), ("c", "p", "d"), ("c", "q", "d"), ("c", "q", "e"), ("x", TYPE, f"{OWL}Nothing"), ("A", f"{OWL}disjointWith", "B"), ("y", TYPE, "A"), ("y", TYPE, "B"), ("A", f"{OWL}complementOf", "N"), ("z", TYPE, "A"), ("z", TYPE, "N")]
    rows += [("n", f"{OWL}sourceIndividual", "c"), ("n", f"{OWL}assertionProperty", "p"), ("n", f"{OWL}targetIndividual", "d")] + restriction("zero", "maxCardinality", "0", "p") + [("c", TYPE, "zero")]
    rows += [("all", TYPE, f"{OWL}AllDisjointClasses"), *owned("all", "members", "m", "F", "G", "H"), ("w", TYPE, "F"), ("w", TYPE, "H"), ("v", TYPE, "G")]
    rows += [("diff", TYPE, f"{OWL}AllDifferent"), *owned("diff", "members", "g", "k1", "k2", "k3"), ("k1", SAME, "k3")]
    rows += [("props", TYPE, f"{OWL}AllDisjointProperties"), *owned("props", "members", "h", "r", "s", "t"), ("f", "r", "h"), ("f", "t", "h"), ("f", "s", "i")]
    got = {tuple(r) for r in en.Closed(graph(spark, *rows), "owl2-rl").contradictions().collect()}
    assert got == {
        ("different equals", "a", f"{OWL}differentFrom", "a"), ("irreflexive", "a", "irr", "a"), ("asymmetric", "c", "asy", "d"), ("asymmetric", "d", "asy", "c"), ("disjoint properties", "c", "p", "d"),
        ("in nothing", "x", TYPE, f"{OWL}Nothing"), ("disjoint classes", "y", TYPE, "A"), ("complement", "z", TYPE, "A"), ("denied", "c", "p", "d"), ("above the maximum", "c", "p", "d"),
        ("disjoint classes", "w", TYPE, "F"), ("different equals", "k1", f"{OWL}differentFrom", "k1"), ("disjoint properties", "f", "r", "h"),
    }


def test_empty_graph(spark):
    whole = en.Closed(spark.createDataFrame([], "s string, p string, o string"), "owl2-rl")
    assert whole.graph.count() == 0 and whole.contradictions().count() == 0 and whole.triples().count() == 0
