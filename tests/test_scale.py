"""Queries over tables whose rows share few values: pairs of rows must not be made."""

import pytest

from quadrille import queries_ontology, queries_reasoning, queries_rules, queries_terms  # noqa: F401  (they register their queries)
from quadrille.functions.terms import DOMAIN, RANGE, SUBCLASS, SUBPROPERTY, TYPE
from quadrille.operators import axioms as ax
from quadrille.operators import entailment as en
from quadrille.operators import patterns as pa
from quadrille.plans import fixpoint as fp
from quadrille.queries import QUERIES, class_edges


@pytest.fixture(scope="module")
def alike(spark, tmp_path_factory):
    """A folder with 200,000 parts of one size, brand and type."""
    path = str(tmp_path_factory.mktemp("alike"))
    columns = ["id AS p_partkey", "'a' AS p_name", "'Brand#3' AS p_brand", "'PROMO' AS p_type", "30 AS p_size", "1.0 AS p_retailprice"]
    spark.range(200_000).selectExpr(*columns).write.parquet(f"{path}/part.parquet")
    return path


def test_codes_of_a_crowded_concept(spark, alike):
    assert [tuple(r) for r in QUERIES["src28_mapped_codes"](spark, alike).collect()] == [("3", "PROMO")]


def test_solutions_of_a_crowded_value_are_counted(spark, alike):
    assert [tuple(r) for r in QUERIES["q17_join_by_datatype"](spark, alike).collect()] == [(30, 2 * 100_000**2)]


@pytest.mark.parametrize("by", [(), ("x",), ("x", "z"), ("a",)])
def test_counts_are_those_of_the_solutions(spark, by):
    rows = [("a", "p", "1"), ("b", "p", "1"), ("b", "p", "2"), ("c", "q", "1"), ("c", "q", "2"), ("d", "q", "2"), ("d", "q", "3"), ("c", "r", "z"), ("c", "r", "w"), ("d", "r", "z")]
    g = spark.createDataFrame(rows, "s string, p string, o string")
    patterns = [("?a", "p", "?x"), ("?z", "r", "?w"), ("?z", "q", "?x"), ("d", "r", "z")]
    want = pa.bgp(g, *patterns).groupBy(*by).count()
    assert sorted(map(tuple, pa.bgp_counts(g, *patterns, by=by).collect())) == sorted(map(tuple, want.collect()))
    none = pa.bgp_counts(g, ("?a", "p", "?x"), ("?a", "absent", "?x"), by=by[:1])
    assert [tuple(r) for r in none.collect()] == ([] if by else [(0,)])
    with pytest.raises(ValueError, match="not bound"):
        pa.bgp_counts(g, ("?a", "p", "?x"), by=["y"])


def test_parts_not_axioms_are_made_distinct(spark):
    """The distinct rows hold two names: nothing of the axioms' width goes through the shuffle."""
    df = ax.simplified_equivalents(spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c"), ("a", None)], "a string, b string"))
    assert sorted(r.sexpr for r in df.collect()) == ["(SubClassOf a b)", "(SubClassOf a c)", "(SubClassOf a)"]
    assert "sha1" not in df.select("sexpr")._jdf.queryExecution().optimizedPlan().toString()


def test_links_are_made_of_distinct_parts(spark, alike):
    """Names and ids of axioms come of few rows, however often a plan reads the edges."""
    plan = class_edges(spark, alike)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [p_brand" in plan[plan.index("Generate explode"):]
    assert {tuple(r) for r in class_edges(spark, alike).collect()} == {("Brand#3", "Group3"), ("Group3", "Brand"), ("Brand#3", "Brand"), ("PROMO", "Type"), ("Brand", "Top"), ("Type", "Top")}


def test_triples_meet_the_schema_in_parts_of_one_size(spark, monkeypatch):
    """A property that most triples share doesn't gather them: the schema goes to the triples, which lie in parts by their number."""
    monkeypatch.setattr(en, "TASK_TRIPLES", 50, raising=False)
    links = [(f"x{i}", "p", f"y{i % 7}") for i in range(120)]
    schema = [("p", SUBPROPERTY, "q"), ("q", DOMAIN, "a"), ("q", RANGE, "b"), ("a", SUBCLASS, "c")]
    got = en.rdfs(spark.createDataFrame(links + schema, "s string, p string, o string"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 2 and "RepartitionByExpression [s#" in plan
    want = {*links, *schema, *((s, "q", o) for s, _, o in links), *((s, TYPE, c) for s, _, _ in links for c in "ac"), *((o, TYPE, "b") for _, _, o in links)}
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("twice", [False, True])
def test_pairs_of_a_crowded_key_are_made_in_blocks(spark, monkeypatch, twice):
    """No task makes all the pairs of a key that all rows share; with a second key in common, a pair is there once."""
    for name, n in (("PAIRS", 1_000), ("BLOCK", 10), ("TASK_PAIRS", 1_000)):
        monkeypatch.setattr(fp, name, n, raising=False)
    rows = [("in", [f"s{i}", "n0"]) for i in range(90)] + [("in", ["t", "n1"])] + ([("in", [f"s{i}", "n1"]) for i in range(5)] if twice else [])
    rule = fp.Rule(("near", "?a", "?b"), (("in", "?a", "?n"), ("in", "?b", "?n")), tests=(lambda v: v["a"] != v["b"],))
    got = fp.saturate(spark.createDataFrame(rows, "pred string, args array<string>"), [rule]).filter("pred = 'near'")
    want = {(a, b) for _, (a, n) in rows for _, (b, m) in rows if n == m and a != b}
    assert sorted(tuple(r["args"]) for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "__i" in plan and "__j" in plan and ("Aggregate" in plan) == twice
    if not twice:
        parts = [len(p) for p in got.rdd.glom().collect()]
        assert max(parts) < sum(parts) / 2
