"""Locality modules, updates of whole terms, datasets and escapes."""

import pytest

from quadrille.functions.terms import Iri, Literal, call
from quadrille.operators import patterns as pa
from quadrille.operators import update as up
from quadrille.operators.modules import locality_module
from quadrille.sources.graphs import bad_lines, read_ntriples


def onto(spark, *texts):
    return spark.createDataFrame([(f"a{i}", t[1:].split(" ")[0], t) for i, t in enumerate(texts)], "axiom_id string, axiom_type string, sexpr string")


def seeds(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "iri string")


def texts(df):
    return sorted(r.sexpr for r in df.collect())


def test_module_of_an_existential(spark):
    """Declarations and annotations of names outside the signature go."""
    df = onto(
        spark, "(Declaration (Class a))", "(Declaration (Class b))", "(Declaration (Class c))", "(Declaration (ObjectProperty p1))", "(Declaration (ObjectProperty p2))",
        '(AnnotationAssertion label p1 "p1")', '(AnnotationAssertion label p2 "p2")', "(SubClassOf a (ObjectSomeValuesFrom p1 b))",
    )
    want = ["(AnnotationAssertion label p1 \"p1\")", "(Declaration (Class a))", "(Declaration (Class b))", "(Declaration (ObjectProperty p1))", "(SubClassOf a (ObjectSomeValuesFrom p1 b))"]
    assert texts(locality_module(df, seeds(spark, "a", "b", "p1"), "star")) == want


AXIOMS = [
    "(SubClassOf a (ObjectIntersectionOf b (ObjectSomeValuesFrom p c)))", "(SubClassOf b d)", "(EquivalentClasses e (ObjectUnionOf a f))", "(SubClassOf g a)", "(DisjointClasses h k)", "(ObjectPropertyDomain p b)",
    "(TransitiveObjectProperty q)", "(SubClassOf http://www.w3.org/2002/07/owl#Thing m)", "(DifferentIndividuals i j)",
]
ALWAYS = {AXIOMS[7], AXIOMS[8]}


def test_bottom_and_top(spark):
    df = onto(spark, *AXIOMS)
    assert set(texts(locality_module(df, seeds(spark, "a"), "bottom"))) == {*AXIOMS[:3], AXIOMS[5]} | ALWAYS
    # from the top nothing tells two classes of all things apart, so that they are disjoint says something
    assert set(texts(locality_module(df, seeds(spark, "d"), "top"))) == {AXIOMS[0], AXIOMS[1], AXIOMS[3], AXIOMS[4], AXIOMS[5], AXIOMS[8]}
    star = set(texts(locality_module(df, seeds(spark, "a", "d"), "star")))
    assert star >= {AXIOMS[0], AXIOMS[1]} and AXIOMS[4] not in star
    with pytest.raises(ValueError):
        locality_module(df, seeds(spark, "a"), "middle")


QUADS = "s string, p string, o string, o_kind tinyint, o_dt string, o_lang string, g string"


def test_whole_terms_in_templates(spark):
    store = spark.createDataFrame([("x", "label", "chat", 2, None, "en", None), ("x", "label", "chat", 2, None, "fr", None), ("x", "size", "3", 2, "http://www.w3.org/2001/XMLSchema#integer", None, None), ("x", "knows", "y", 0, None, None, None)], QUADS)
    where = pa.bgp(up.in_using(store), ("?x", "label", Literal("chat", lang="en")), terms=True)
    gone = up.modify(store, where, [("?x", "label", Literal("chat", lang="EN"))])
    assert sorted((r.o, r.o_lang) for r in gone.filter("p = 'label'").collect()) == [("chat", "fr")]
    every = pa.bgp(up.in_using(store), ("?x", "?p", "?v"), terms=True)
    assert up.modify(store, every, (), [("?x", "?p", "?v")]).count() == 4
    copied = up.modify(store, every, (), [("?x", "copy", "?v"), ("?v", "of", "?x")])
    assert sorted((r.o, r.o_kind, r.o_lang) for r in copied.filter("p = 'copy'").collect()) == [("3", 2, None), ("chat", 2, "en"), ("chat", 2, "fr"), ("y", 0, None)]
    assert [r.s for r in copied.filter("p = 'of'").collect()] == ["y"]
    assert pa.construct(every, ("?x", "a", Iri("ex:T"))).collect()[0].o == "http://example.org/T"


def test_dataset(spark):
    data = up.Dataset.of(spark.createDataFrame([("x", "p", "y", "http://example.org/g")], "s string, p string, o string, g string"))
    data = data.create("ex:empty").copy("ex:g", "ex:h").drop("ex:g")
    assert sorted(r.g for r in data.graphs.collect()) == ["http://example.org/empty", "http://example.org/h"] and data.quads.count() == 1
    assert data.clear("ex:h").has("ex:h") and data.clear(which="all").quads.count() == 0
    for broken in (lambda: data.create("ex:h"), lambda: data.drop("ex:g"), lambda: data.move("ex:g", "ex:h"), lambda: up.update(data, "drop", source="ex:h")):
        with pytest.raises(ValueError):
            broken()
    assert data.drop("ex:g", silent=True).quads.count() == 1


def test_escapes(spark, tmp_path):
    (tmp_path / "x.nt").write_text('<http://x/caf\\u00E9> <p> "caf\\u00e9 \\b\\f\\\\u0041 \\U0001F600 \\\\n" .\n# note\n\nbroken line\n')
    (row,) = read_ntriples(spark, str(tmp_path)).collect()
    assert row.s == "http://x/café" and row.o == "café \b\f\\u0041 \U0001f600 \\n"
    assert [r.value for r in bad_lines(spark, str(tmp_path)).collect()] == ["broken line"]


def test_functions(spark):
    from pyspark.sql import functions as F

    (row,) = spark.range(1).select(call("round", F.lit(-2.5)).alias("r"), call("substr", F.lit("hello"), 3).alias("s"), call("substr", F.lit("hello"), 2, 3).alias("t")).collect()
    assert (row.r, row.s, row.t) == (-2, "llo", "ell")


def test_times_of_the_day(spark):
    from pyspark.sql import functions as F

    from quadrille.functions.builtins import builtin

    late, early, hour = builtin("time", F.lit(23), F.lit(30), F.lit(1.5)), builtin("time", F.lit(0), F.lit(10), F.lit(0)), F.expr("INTERVAL '1' HOUR")
    made = [builtin("subtractTimes", late, early), builtin("addDayTimeDurationToTime", late, hour), builtin("subtractDayTimeDurationFromTime", early, hour)]
    (row,) = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(made)]).collect()
    assert [x.total_seconds() for x in row] == [23 * 3600 + 20 * 60 + 1.5, 30 * 60 + 1.5, 23 * 3600 + 10 * 60]
    assert spark.range(1).select((builtin("multiplyYearMonthDuration", F.expr("INTERVAL '1' YEAR"), F.lit(3)) == F.expr("INTERVAL '3' YEAR")).alias("x")).first().x


def test_entailment_leaves_only_its_result(spark):
    """Closures, schemas and rounds that others replace are deleted."""
    from quadrille.functions.terms import SUBCLASS, TYPE
    from quadrille.operators.entailment import rdfs_plus
    from quadrille.plans import stages

    before = len(stages._written)
    out = rdfs_plus(spark.createDataFrame([("a", SUBCLASS, "b"), ("b", SUBCLASS, "c"), ("x", TYPE, "a")], "s string, p string, o string"))
    assert out.count() == 6 and len(stages._written) == before + 1


def test_parsers_by_kind(spark):
    from pyspark.sql import functions as F

    from quadrille.sources.databases import Connections
    from quadrille.sources.files import parsed_rows

    rows = spark.createDataFrame([("n", "1"), ("t", "x"), ("z", "?"), (None, "!")], "kind string, text string")
    out = parsed_rows(rows, "kind", {"n": lambda df: df.select(F.col("text").cast("int").alias("n")), "t": lambda df: df.select("text")}).collect()
    assert sorted((r.n or 0, r.text or "", r.error or "") for r in out) == [(0, "", "no parser for a row without a kind"), (0, "", "no parser for z"), (0, "x", ""), (1, "", "")]
    both = Connections(a=lambda s, q: rows.filter(q))
    assert both.read(spark, "a", "kind = 'n'").count() == 1 and both.named("b", lambda s, q: rows).read(spark, "b", "").count() == 4
    with pytest.raises(ValueError):
        both.read(spark, "b", "")


def test_one_name_for_equals(spark):
    from quadrille.functions.terms import OWL, TYPE
    from quadrille.operators.entailment import canonical, equal_individuals, same_individuals
    from quadrille.plans.components import representatives

    chain = spark.createDataFrame([(f"n{(7 * i) % 61:02}", f"n{(7 * i + 7) % 61:02}") for i in range(60)] + [("x", "y"), ("z", "z")], "a string, b string")
    got = {r.node: r.root for r in representatives(chain).collect()}
    assert got == {**{f"n{i:02}": "n00" for i in range(61)}, "x": "x", "y": "x"} and representatives(chain.limit(0)).count() == 0
    rows = [("a", f"{OWL}sameAs", "b"), ("f", TYPE, f"{OWL}FunctionalProperty"), ("b", "f", "u"), ("a", "f", "w"), ("u", "f", "p1"), ("w", "f", "p2"), ("p2", "q", "end"), ("c", "f", "d")]
    g = spark.createDataFrame(rows, "s string, p string, o string")
    assert {(r.node, r.root) for r in equal_individuals(g).collect()} == {("a", "a"), ("b", "a")}
    assert sorted(map(tuple, same_individuals(g).collect())) == [("a", "b"), ("b", "a")]
    # a and b being one, u and w are, and then p1 and p2
    assert {tuple(r) for r in canonical(g).select("s", "p", "o").collect()} == {("f", TYPE, f"{OWL}FunctionalProperty"), ("a", "f", "u"), ("u", "f", "p1"), ("p1", "q", "end"), ("c", "f", "d")}


def test_trees_of_a_batch_take_little_memory():
    """A batch of axioms is never whole in Python values."""
    import tracemalloc

    import pyarrow as pa

    from quadrille.operators.modules import _speaking
    from quadrille.operators.trees import _trees

    texts = pa.array([f"(SubClassOf supplier{i} (ObjectIntersectionOf Supplier (ObjectSomeValuesFrom basedIn nation{i % 25})))" for i in range(5000)] + [None, "(broken"])
    known = pa.array([["Supplier"] if i % 2 else None for i in range(len(texts) - 2)], pa.list_(pa.string()))
    tracemalloc.start()
    trees = _trees(texts)
    said = _speaking(trees.slice(0, 5000), known, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    print("peak MB", peak / 1e6)
    assert peak < 5e6 and len(trees) == 5002 and trees.null_count == 2 and said.to_pylist() == [False] * 5000
    assert len(_trees(texts.slice(0, 0))) == 0
