"""Registered queries on class expressions, explanations, modules, goals, formulas over the finite universe, axiom trees and updates of whole terms."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quadrille.functions.terms import OWL, SUBCLASS, TYPE, XSD, Iri, Literal
from quadrille.operators import completion as cm
from quadrille.operators import constraints as co
from quadrille.operators import entailment as en
from quadrille.operators import mapping as mp
from quadrille.operators import modules as md
from quadrille.operators import patterns as pa
from quadrille.operators import trees as tr
from quadrille.operators import update as up
from quadrille.plans.fixpoint import Rule, answers, saturate, saturate_layers
from quadrille.plans.stages import scratch_dir
from quadrille.queries import CLASSES, EX, class_edges, nation_graph, node, order_facts, query, table
from quadrille.queries_terms import literals
from quadrille.sources import graphs as gr


def forms(df, text):
    """Axioms of text forms, one for each row."""
    return df.select(text.alias("sexpr")).select(F.sha1("sexpr").alias("axiom_id"), F.regexp_extract("sexpr", r"^\((\S+)", 1).alias("axiom_type"), "sexpr").distinct()


def fixed(s, *texts):
    return forms(s.createDataFrame([(t,) for t in texts], "t string"), F.col("t"))


def place_axioms(s, d):
    """Nations in regions, suppliers based in nations, classes of what is in a region, and that who is based in a nation is based in its region."""
    n, r, u = table(s, d, "nation"), table(s, d, "region"), table(s, d, "supplier")
    return (
        forms(n, F.format_string("(SubClassOf nation%d (ObjectSomeValuesFrom inRegion region%d))", "n_nationkey", "n_regionkey"))
        .unionByName(forms(r, F.format_string("(EquivalentClasses Located%d (ObjectSomeValuesFrom inRegion region%d))", "r_regionkey", "r_regionkey")))
        .unionByName(forms(u, F.format_string("(SubClassOf supplier%d (ObjectIntersectionOf Supplier (ObjectSomeValuesFrom basedIn nation%d)))", "s_suppkey", "s_nationkey")))
        .unionByName(forms(r, F.format_string("(EquivalentClasses SupplierOf%d (ObjectIntersectionOf Supplier (ObjectSomeValuesFrom basedIn region%d)))", "r_regionkey", "r_regionkey")))
        .unionByName(fixed(s, "(SubObjectPropertyOf (ObjectPropertyChain basedIn inRegion) basedIn)"))
    )


BASED = "supplier JOIN nation ON n_nationkey = s_nationkey"


@query(f"""SELECT 'nation' || n_nationkey AS a, 'Located' || n_regionkey AS b FROM nation UNION ALL SELECT 'supplier' || s_suppkey, 'Supplier' FROM supplier
UNION ALL SELECT 'supplier' || s_suppkey, 'SupplierOf' || n_regionkey FROM {BASED} UNION ALL SELECT 'SupplierOf' || r_regionkey, 'Supplier' FROM region""")
def o01_classes_by_expressions(s, d):
    """Subsumptions that follow from restrictions, conjunctions and a chain of properties."""
    return cm.subsumptions(place_axioms(s, d))


@query(f"""SELECT p, a, b FROM (SELECT 'inRegion' AS p, 'nation' || n_nationkey AS a, 'region' || n_regionkey AS b FROM nation UNION ALL SELECT 'basedIn', 'supplier' || s_suppkey, 'nation' || s_nationkey FROM supplier
UNION ALL SELECT 'basedIn', 'supplier' || s_suppkey, 'region' || n_regionkey FROM {BASED} UNION ALL SELECT 'basedIn', 'supplier' || s_suppkey, 'Located' || n_regionkey FROM {BASED}
UNION ALL SELECT 'inRegion', 'Located' || r_regionkey, 'region' || r_regionkey FROM region UNION ALL SELECT 'basedIn', 'SupplierOf' || r_regionkey, 'region' || r_regionkey FROM region)""")
def o24_links_of_classes(s, d):
    return cm.class_links(place_axioms(s, d))


@query("SELECT 'part' || p_partkey AS node FROM part WHERE p_type = 'PROMO' AND p_brand = 'Brand#3' UNION ALL SELECT 'kit' || p_partkey FROM part WHERE p_type = 'PROMO' AND p_brand = 'Brand#3' AND p_size > 25")
def o11_unsatisfiable_expressions(s, d):
    """Parts that are equal to the intersection of two disjoint classes, and kits that would hold such a part."""
    p = table(s, d, "part")
    own = forms(p.filter("p_type IS NOT NULL"), F.format_string("(EquivalentClasses part%d (ObjectIntersectionOf %s %s))", "p_partkey", "p_type", "p_brand"))
    kits = forms(p.filter("p_size > 25"), F.format_string("(SubClassOf kit%d (ObjectSomeValuesFrom holds part%d))", "p_partkey", "p_partkey"))
    return cm.unsatisfiable(own.unionByName(kits).unionByName(fixed(s, "(DisjointClasses PROMO Brand#3)")))


@query("""SELECT axiom_type, a, b, c FROM (SELECT 'ClassAssertion' AS axiom_type, 'Nation' AS a, 'nation' || n_nationkey AS b, NULL AS c FROM nation UNION ALL SELECT 'ClassAssertion', 'Region', 'region' || r_regionkey, NULL FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)
UNION ALL SELECT 'ClassAssertion', v.c, 'nation' || n_nationkey, NULL FROM nation, (VALUES ('Asian'), ('Place'), ('Spot')) v(c) WHERE n_regionkey = 2
UNION ALL SELECT 'ObjectPropertyAssertion', 'inRegion', 'nation' || n_nationkey, 'region' || n_regionkey FROM nation UNION ALL SELECT 'ObjectPropertyAssertion', 'has', 'region' || n_regionkey, 'nation' || n_nationkey FROM nation
UNION ALL SELECT 'SubClassOf', x, y, NULL FROM (VALUES ('Asian', 'Place'), ('Asian', 'Spot'), ('Place', 'Spot'), ('Spot', 'Place')) v(x, y) UNION ALL SELECT 'EquivalentClasses', 'Place', 'Spot', NULL UNION ALL SELECT 'DisjointClasses', 'Nation', 'Region', NULL)""")
def o19_inferred_over_expressions(s, d):
    """Axioms of five types that follow, rows and not counts."""
    n = table(s, d, "nation")
    facts = forms(n, F.format_string("(ClassAssertion Nation nation%d)", "n_nationkey")).unionByName(forms(n, F.format_string("(ObjectPropertyAssertion inRegion nation%d region%d)", "n_nationkey", "n_regionkey")))
    schema = fixed(s, "(ObjectPropertyRange inRegion Region)", "(InverseObjectProperties inRegion has)", "(EquivalentClasses Asian (ObjectHasValue inRegion region2))", "(DisjointClasses Nation Region)", "(SubClassOf Asian Place)", "(EquivalentClasses Place Spot)")
    return cm.inferred(facts.unionByName(schema))


@query(f"""WITH RECURSIVE {CLASSES}, w AS (SELECT a, b, [a, b] AS path FROM c WHERE a = 'Brand#7' UNION ALL SELECT w.a, c.b, list_append(path, c.b) FROM w JOIN c ON c.a = w.b WHERE NOT list_contains(path, c.b)),
f AS (SELECT row_number() OVER (ORDER BY len(path), path) AS n, path FROM w WHERE b = 'Top')
SELECT len(path) - 1 AS size, '(SubClassOf ' || path[i] || ' ' || path[i + 1] || ')' AS sexpr, true AS whole FROM (SELECT n, path, unnest(range(1, len(path))) AS i FROM f)""")
def o20_minimal_explanations(s, d):
    """All minimal sets of axioms by which a brand is below the top, two here."""
    axioms = forms(class_edges(s, d), F.format_string("(SubClassOf %s %s)", "a", "b"))
    rows = cm.explanations(axioms, "Brand#7", "Top")
    sizes = rows.groupBy("explanation").agg(F.count("*").alias("size"))
    return rows.join(sizes, "explanation").join(axioms, "axiom_id").select("size", "sexpr", "whole")


MODULE = f"""WITH x AS (SELECT s_suppkey, s_nationkey, n_regionkey FROM {BASED} WHERE s_suppkey = (SELECT min(s_suppkey) FROM supplier))
SELECT sexpr FROM (SELECT '(SubClassOf supplier' || s_suppkey || ' (ObjectIntersectionOf Supplier (ObjectSomeValuesFrom basedIn nation' || s_nationkey || ')))' AS sexpr FROM x
UNION ALL SELECT '(SubClassOf nation' || s_nationkey || ' (ObjectSomeValuesFrom inRegion region' || n_regionkey || '))' FROM x UNION ALL SELECT '(SubObjectPropertyOf (ObjectPropertyChain basedIn inRegion) basedIn)' FROM x
UNION ALL SELECT '(EquivalentClasses SupplierOf' || n_regionkey || ' (ObjectIntersectionOf Supplier (ObjectSomeValuesFrom basedIn region' || n_regionkey || ')))' FROM x
UNION ALL SELECT '(EquivalentClasses Located' || n_regionkey || ' (ObjectSomeValuesFrom inRegion region' || n_regionkey || '))' FROM x)"""


def _first_supplier(s, d):
    return table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).orderBy("s_suppkey").limit(1)


@query(MODULE)
def o21_bottom_module(s, d):
    seeds = _first_supplier(s, d).select(F.format_string("supplier%d", "s_suppkey").alias("iri"))
    return md.locality_module(place_axioms(s, d), seeds, "bottom").select("sexpr")


@query("SELECT '(SubClassOf Kind' || r_regionkey || ' Area)' AS sexpr FROM region UNION ALL SELECT '(SubClassOf nation' || n_nationkey || ' Kind' || n_regionkey || ')' FROM nation")
def o21_top_module(s, d):
    """What is below a name, not what is above it."""
    n, r = table(s, d, "nation"), table(s, d, "region")
    axioms = forms(n, F.format_string("(SubClassOf nation%d Kind%d)", "n_nationkey", "n_regionkey")).unionByName(forms(r, F.format_string("(SubClassOf Kind%d Area)", "r_regionkey")))
    axioms = axioms.unionByName(forms(r, F.format_string("(SubClassOf Area Above%d)", "r_regionkey")))
    return md.locality_module(axioms, s.createDataFrame([("Area",)], "iri string"), "top").select("sexpr")


@query(MODULE)
def o21_star_module(s, d):
    """Bottom and top in turn, for a supplier and the class that it falls in."""
    seeds = _first_supplier(s, d).select(F.explode(F.array(F.format_string("supplier%d", "s_suppkey"), F.format_string("SupplierOf%d", "n_regionkey"))).alias("iri"))
    return md.locality_module(place_axioms(s, d), seeds, "star").select("sexpr")


# ---- rules ----


@query("WITH RECURSIVE t AS (SELECT n_name AS x, 'ASIA' AS y FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' UNION ALL SELECT 'ASIA', 'WORLD' UNION SELECT x, 'WORLD' FROM t) SELECT DISTINCT s_name AS x FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' UNION SELECT x FROM t WHERE y = 'ASIA'")
def l08_goal_directed(s, d):
    """What lies in a region, at any depth: only what the question asks for is derived."""
    n, r, u = table(s, d, "nation"), table(s, d, "region"), table(s, d, "supplier")
    pair = lambda a, b: (F.lit("part").alias("pred"), F.array(a, b).alias("args"))
    facts = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(*pair("n_name", "r_name")).unionByName(u.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(*pair("s_name", "n_name"))).unionByName(r.select(*pair("r_name", F.lit("WORLD"))))
    rules = [Rule(("in", "?x", "?y"), (("part", "?x", "?y"),)), Rule(("in", "?x", "?z"), (("part", "?y", "?z"), ("in", "?x", "?y")))]
    return answers(facts, rules, ("in", "?x", "ASIA"))


@query("SELECT c_custkey::VARCHAR AS c FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'F')")
def l10_layers(s, d):
    """Customers without open orders: layers come from the rules themselves, given in any order."""
    rules = [Rule(("idle", "?c"), (("customer", "?c"),), (("busy", "?c"),)), Rule(("busy", "?c"), (("open", "?o"), ("by", "?o", "?c"))), Rule(("open", "?o"), (("by", "?o", "?c"),), (("done", "?o"),))]
    return saturate_layers(order_facts(s, d), rules).filter("pred = 'idle'").select(F.col("args")[0].alias("c"))


@query("SELECT r_name AS a, n_name AS b FROM region, nation")
def j17_bodies_without_shared_variables(s, d):
    facts = table(s, d, "region").select(F.lit("r").alias("pred"), F.array("r_name").alias("args")).unionByName(table(s, d, "nation").select(F.lit("n").alias("pred"), F.array("n_name").alias("args")))
    return saturate(facts, [Rule(("both", "?a", "?b"), (("r", "?a"), ("n", "?b")))]).filter("pred = 'both'").select(F.col("args")[0].alias("a"), F.col("args")[1].alias("b"))


# ---- formulas over the finite universe ----

UNIVERSE = "u AS (SELECT o_orderkey::VARCHAR AS x FROM orders UNION SELECT o_custkey::VARCHAR FROM orders UNION SELECT c_custkey::VARCHAR FROM customer UNION SELECT c_nationkey::VARCHAR FROM customer)"


@query(f"WITH {UNIVERSE} SELECT x FROM u WHERE x NOT IN (SELECT c_custkey::VARCHAR FROM customer)")
def l11_every_thing_has_some(s, d):
    """Counterexamples of: everything is in something."""
    return co.counterexamples(("forall", ["?x"], ("exists", ["?y"], ("fact", "in", "?x", "?y"))), order_facts(s, d))


@query("SELECT c_custkey::VARCHAR AS x FROM customer WHERE c_custkey IN (7, 10, 20, 33) AND c_custkey % 10 = 0")
def l18_some_named_ones(s, d):
    """Counterexamples of: the named ones are customers."""
    return co.counterexamples(co.axiom_formula("SubClassOf", ("one", "7", "10", "20", "33"), "customer"), order_facts(s, d))


@query(f"WITH {UNIVERSE}, bad AS (SELECT o_orderkey::VARCHAR AS x FROM orders WHERE o_custkey % 10 = 0), f AS (SELECT o_orderkey::VARCHAR AS x FROM orders WHERE o_orderstatus = 'F') SELECT x FROM u WHERE (x IN (SELECT x FROM f)) <> (x NOT IN (SELECT x FROM bad))")
def l12_class_equal_to_a_universal(s, d):
    """Counterexamples of: what is done is what is by customers only."""
    return co.counterexamples(co.axiom_formula("EquivalentClasses", "done", ("all", "by", "customer")), order_facts(s, d))


# ---- axiom trees ----


def nested_axioms(s, d):
    text = "(SubClassOf Nation%d (ObjectSomeValuesFrom in (ObjectIntersectionOf Region (ObjectAllValuesFrom near (ObjectUnionOf R%d S%d T)))))"
    return forms(table(s, d, "nation"), F.format_string(text, "n_nationkey", "n_regionkey", "n_nationkey"))


@query("SELECT 'Nation' || n_nationkey AS a, 'near' AS p, 'R' || n_regionkey AS first, 'S' || n_nationkey || ' T' AS rest FROM nation")
def x02_deep_fillers(s, d):
    pattern = "(SubClassOf ?a (ObjectSomeValuesFrom ?_ (ObjectIntersectionOf ?_ (ObjectAllValuesFrom ?p (ObjectUnionOf ?first ?*rest)))))"
    return tr.matching(nested_axioms(s, d), pattern).select("a", "p", "first", "rest")


@query("SELECT '(ObjectUnionOf R' || n_regionkey || ' S' || n_nationkey || ' T)' AS part, 'R' || n_regionkey AS x FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT '(ObjectIntersectionOf Region (ObjectAllValuesFrom near (ObjectUnionOf R' || n_regionkey || ' S' || n_nationkey || ' T)))', 'Region' FROM nation")
def x02_parts_anywhere(s, d):
    """Unions whose first part isn't R1, and conjunctions, wherever they are in an axiom."""
    pattern = "(?or (ObjectUnionOf (?and ?x (?not R1)) ?*more) (ObjectIntersectionOf ?x (ObjectAllValuesFrom ?p ?f)))"
    return tr.matching(nested_axioms(s, d), pattern, anywhere=True).select("part", "x")


@query("SELECT 'Nation' || n_nationkey AS name, 5 AS depth FROM nation WHERE n_nationkey % 2 = 0 AND n_regionkey < 3")
def x02_tests_in_patterns(s, d):
    even = lambda t: F.regexp_extract(t, r"(\d+)$", 1).try_cast("int") % 2 == 0
    low = lambda b: F.regexp_extract(b["r"], r"(\d+)$", 1).cast("int") < 3
    hit = tr.matching(nested_axioms(s, d), "(SubClassOf (?is ?name even) (ObjectSomeValuesFrom ?_ (ObjectIntersectionOf ?_ (ObjectAllValuesFrom ?_ (ObjectUnionOf ?r ?*more (?if low))))))", {"even": even, "low": low})
    rows = tr.nodes(hit.select("axiom_id", "sexpr", "name"))
    depth = F.max(F.size(F.regexp_extract_all("text", F.lit(r"(\()"), F.lit(1))))
    return rows.filter("node = 0").groupBy("name").agg(depth.cast("int").alias("depth"))


@query("SELECT 'Nation' || n_nationkey AS a, 'in' AS p, 'near' AS q, 'R' || n_regionkey || ' S' || n_nationkey || ' T' AS members FROM nation")
def x10_nested_triples(s, d):
    """The parts of nested expressions, read from the triples that they become: restrictions, and lists in their order."""
    t = mp.triples_of(nested_axioms(s, d))
    of = lambda p, a, b: t.filter(F.col("p") == p).select(F.col("s").alias(a), F.col("o").alias(b))
    lists = mp.list_members(t)
    outer = of(SUBCLASS, "a", "r").join(of(f"{OWL}onProperty", "r", "p"), "r").join(of(f"{OWL}someValuesFrom", "r", "f"), "r").join(of(f"{OWL}intersectionOf", "f", "head"), "f").join(lists, "head")
    inner = of(f"{OWL}onProperty", "r2", "q").join(of(f"{OWL}allValuesFrom", "r2", "u"), "r2").join(of(f"{OWL}unionOf", "u", "head2"), "u").join(lists.select(F.col("head").alias("head2"), F.array_join("items", " ").alias("members")), "head2")
    return outer.select("a", "p", F.get("items", F.lit(1)).alias("r2")).join(inner, "r2").select("a", "p", "q", "members")


@query("SELECT sexpr FROM (SELECT '(SubClassOf Nation' || n_nationkey || ' (ObjectSomeValuesFrom in (ObjectIntersectionOf Region (ObjectAllValuesFrom near (ObjectUnionOf R' || n_regionkey || ' S' || n_nationkey || ' T)))))' AS sexpr FROM nation UNION ALL SELECT '(SubClassOf (ObjectMinCardinality ' || n_regionkey || ' p) (ObjectMaxCardinality ' || n_nationkey || ' p K' || n_nationkey || '))' FROM nation UNION ALL SELECT '(DifferentIndividuals n' || n_nationkey || ' a b)' FROM nation UNION ALL SELECT '(HasKey K' || n_nationkey || ' p q)' FROM nation)")
def x12_triples_back(s, d):
    """Axioms to triples and back: none is lost, none is another."""
    n = table(s, d, "nation")
    more = [F.format_string("(SubClassOf (ObjectMinCardinality %d p) (ObjectMaxCardinality %d p K%d))", "n_regionkey", "n_nationkey", "n_nationkey"), F.format_string("(DifferentIndividuals n%d a b)", "n_nationkey"), F.format_string("(HasKey K%d p q)", "n_nationkey")]
    axioms = nested_axioms(s, d)
    for text in more:
        axioms = axioms.unionByName(forms(n, text))
    return mp.axioms_of(mp.triples_of(axioms)).select("sexpr")


# ---- updates of whole terms ----


def spoken(s, d):
    """Nations by name in two languages, and with a datatype, in the default graph."""
    n, of = table(s, d, "nation"), node("nation", "n_nationkey")
    rows = literals(n, of, f"{EX}label", F.col("n_name"), lang="en").unionByName(literals(n, of, f"{EX}label", F.col("n_name"), lang="fr"))
    return rows.unionByName(literals(n, of, f"{EX}code", F.col("n_regionkey"), dt=f"{XSD}integer")).withColumn("g", F.lit(None).cast("string"))


SPOKEN = f"(SELECT '{EX}nation/' || n_nationkey AS s, '{EX}label' AS p, n_name AS o, NULL AS o_dt, l AS o_lang, n_regionkey FROM nation, (VALUES ('en'), ('fr')) v(l) UNION ALL SELECT '{EX}nation/' || n_nationkey, '{EX}code', n_regionkey::VARCHAR, '{XSD}integer', NULL, n_regionkey FROM nation)"


@query(f"SELECT s, p, o, o_dt, o_lang FROM {SPOKEN} WHERE NOT coalesce(o_lang = 'en' AND n_regionkey = 2, false)")
def up3_delete_one_language(s, d):
    """A template deletes the English name and leaves the French one of the same text."""
    store = spoken(s, d)
    graph = up.in_using(store)
    where = pa.bgp(graph, ("?n", "ex:label", "?x"), ("?n", "ex:code", Literal("2", "xsd:integer")), terms=True)
    english = where.filter(F.col(f"{pa.TAG}x") == Literal("", lang="en").tag)
    return up.modify(store, english, [("?n", "ex:label", "?x")]).select("s", "p", "o", "o_dt", "o_lang")


@query(f"SELECT s, '{EX}said' AS p, o, o_dt, o_lang FROM {SPOKEN} UNION ALL SELECT s, '{EX}note', 'seen', '{EX}kind', NULL FROM {SPOKEN} WHERE p = '{EX}code'")
def up4_insert_typed_terms(s, d):
    """Bound literals keep datatype and language, and a template's constant its own."""
    store = spoken(s, d)
    where = pa.union(*[pa.bgp(up.in_using(store), ("?n", f"ex:{p}", "?x"), terms=True) for p in ("label", "code")])
    out = up.modify(store, where, [("?n", "ex:label", "?x"), ("?n", "ex:code", "?x")], [("?n", "ex:said", "?x"), ("?n", "ex:note", Literal("seen", "ex:kind"))])
    return out.select("s", "p", "o", "o_dt", "o_lang")


@query(f"SELECT s, p, o, o_dt, o_lang, count(*) AS n FROM {SPOKEN} GROUP BY ALL")
def up1_insert_again(s, d):
    """What is there already isn't added a second time, whatever the template and the case of its languages."""
    store = spoken(s, d)
    where = pa.bgp(up.in_using(store), ("?n", "?p", "?x"), terms=True)
    out = up.insert(up.modify(store, where, (), [("?n", "?p", "?x")]), spoken(s, d).drop("g").withColumn("o_lang", F.upper("o_lang")))
    return out.groupBy("s", "p", "o", "o_dt", "o_lang").agg(F.count("*").alias("n"))


@query(f"SELECT '{EX}nation/' || n_nationkey AS s, '{EX}linked' AS p, '{EX}region/' || n_regionkey AS o FROM nation")
def q15_no_literal_subjects(s, d):
    """A literal bound to a subject makes no triple."""
    rows = pa.bgp(nation_graph(s, d), ("?n", "ex:inRegion", "?r"), ("?n", "ex:name", "?x"), terms=True)
    made = pa.construct(rows, ("?n", "ex:linked", "?r"), ("?x", "ex:of", "?n"))
    return made.select("s", "p", "o")


@query(f"SELECT '{EX}b' AS g, count(*) AS n FROM nation UNION ALL SELECT '{EX}c', count(*) FROM region UNION ALL SELECT '{EX}empty', 0 UNION ALL SELECT 'errors', 4")
def up10_updates_by_name(s, d):
    """Graphs are created, loaded, moved and dropped by name; four updates that can't be done are errors."""
    names = nation_graph(s, d).filter(F.col("p") == f"{EX}name").select("s", "p", "o")
    data = up.Dataset.of(names.withColumn("g", F.lit(f"{EX}a")))
    regions = table(s, d, "region").select(node("region", "r_regionkey").alias("s"), F.lit(f"{EX}name").alias("p"), F.col("r_name").alias("o"))
    for operation, more in (("create", {"graph": "ex:empty"}), ("move", {"source": "ex:a", "target": "ex:b"}), ("load", {"triples": regions, "graph": "ex:c"}), ("create", {"graph": "ex:gone"}), ("drop", {"graph": "ex:gone"}), ("drop", {"graph": "ex:never", "silent": True})):
        data = up.update(data, operation, **more)
    errors = 0
    for operation, more in (("clear", {"source": "ex:a"}), ("create", {"graph": "ex:b"}), ("drop", {"graph": "ex:gone"}), ("copy", {"source": "ex:a", "target": "ex:z"})):
        try:
            up.update(data, operation, **more)
        except ValueError:
            errors += 1
    n = data.graphs.join(data.quads.groupBy("g").agg(F.count("*").alias("n")), "g", "left").select("g", F.coalesce("n", F.lit(0)).alias("n"))
    return n.unionByName(s.createDataFrame([("errors", errors)], "g string, n long"))


@query(f"SELECT '{EX}café/' || n_nationkey AS s, 'café ' || n_name || ' \U0001f600 it''s' || chr(8) || chr(10) AS o, 'fr' AS o_lang FROM nation UNION ALL SELECT 'bad', count(*)::VARCHAR, NULL FROM nation")
def src01_escapes(s, d):
    """Escapes of names and texts are read, and lines that aren't triples are told."""
    path = f"{scratch_dir(s)}/escapes-{uuid.uuid4().hex}"
    n = table(s, d, "nation")
    good = F.concat(F.lit(f"<{EX}caf\\u00E9/"), F.col("n_nationkey").cast("string"), F.lit(f"> <{EX}name> \"caf\\u00e9 "), F.col("n_name"), F.lit(" \\U0001F600 it\\'s\\b\\n\"@fr ."))
    n.select(F.explode(F.array(good, F.concat(F.lit("no triple "), F.col("n_name")))).alias("value")).write.text(path)
    bad = gr.bad_lines(s, path).agg(F.count("*").cast("string").alias("o"))
    return gr.read_ntriples(s, path).select("s", "o", "o_lang").unionByName(bad.select(F.lit("bad").alias("s"), "o", F.lit(None).cast("string").alias("o_lang")))


@query(f"SELECT '{EX}nation/' || n_nationkey AS x FROM nation WHERE n_regionkey = 3")
def q15_constants_of_templates(s, d):
    """Iri and Literal constants in a template; what comes of them is found as such again."""
    rows = pa.bgp(nation_graph(s, d), ("?n", "ex:inRegion", Iri("ex:region/3")), terms=True)
    made = pa.construct(rows, ("?n", "a", Iri("ex:Third")), ("?n", "ex:mark", Literal("3", "xsd:integer")))
    return pa.bgp(made, ("?x", "a", "ex:Third"), ("?x", "ex:mark", Literal("3", "xsd:integer")))


# ---- one name for equals ----

CLUSTERS = f"k AS (SELECT '{EX}supplier/' || s_suppkey AS x, s_nationkey AS n, s_name FROM supplier), r AS (SELECT n, min(x) AS root FROM k GROUP BY n)"


def equal_suppliers(s, d):
    """Suppliers' names, and that all suppliers of a nation are one: by an inverse functional property."""
    u = table(s, d, "supplier")
    names = u.select(node("supplier", "s_suppkey").alias("s"), F.lit(f"{EX}name").alias("p"), F.col("s_name").alias("o"))
    seats = u.select(node("supplier", "s_suppkey").alias("s"), F.lit(f"{EX}seat").alias("p"), node("nation", "s_nationkey").alias("o"))
    return names.unionByName(seats).unionByName(gr.abox(s, [(f"{EX}seat", TYPE, f"{OWL}InverseFunctionalProperty")]).select("s", "p", "o"))


@query(f"WITH {CLUSTERS} SELECT root AS s, '{EX}name' AS p, s_name AS o FROM k JOIN r ON r.n = k.n UNION SELECT root, '{EX}seat', '{EX}nation/' || n FROM r")
def o30_one_name_for_equals(s, d):
    return en.canonical(equal_suppliers(s, d)).filter(F.col("p").isin(f"{EX}name", f"{EX}seat")).select("s", "p", "o")


@query(f"WITH {CLUSTERS} SELECT x AS iri, x = root AS canonical FROM k JOIN r ON r.n = k.n")
def q24_canonical_terms(s, d):
    terms = table(s, d, "supplier").select(node("supplier", "s_suppkey").alias("iri"))
    return en.is_canonical(terms, en.equal_individuals(equal_suppliers(s, d))).select("iri", "canonical")
