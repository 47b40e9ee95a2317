"""Registered queries on ontologies: lookups, entailment by type, profiles, releases, changes, shapes and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille.functions.terms import LABEL, OWL, RDFS, SUBCLASS, SUBPROPERTY, TYPE
from quadrille.operators import axioms as ax
from quadrille.operators import codes as cd
from quadrille.operators import constraints as co
from quadrille.operators import entailment as en
from quadrille.operators import hierarchy as hi
from quadrille.operators import ontology as on
from quadrille.operators import trees as tr
from quadrille.queries import CLASS_CLOSURE, CLASSES, EX, class_edges, node, order_facts, order_links, part_axioms, query, table
from quadrille.sources import graphs as gr


def triples(df, s, p, o):
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(text(s).alias("s"), text(p).alias("p"), text(o).alias("o"))


def class_graph(s, d):
    """The classes of parts as subclass links, with labels in lower case and declarations."""
    e = class_edges(s, d)
    nodes = e.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    return triples(e, F.col("a"), SUBCLASS, F.col("b")).unionByName(triples(nodes, F.col("c"), LABEL, F.lower("c"))).unionByName(triples(nodes, F.col("c"), TYPE, f"{OWL}Class"))


NODES = f"WITH {CLASSES}, n AS (SELECT a AS c FROM c UNION SELECT b FROM c)"


@query(f"{NODES} SELECT c AS iri, '{LABEL}' AS prop, lower(c) AS value FROM n UNION SELECT c, '{EX}note', 'n' || length(c) FROM n WHERE c LIKE 'Brand%'")
def o16_annotations(s, d):
    g = class_graph(s, d)
    brands = g.filter((F.col("p") == LABEL) & F.col("s").startswith("Brand"))
    notes = triples(brands, F.col("s"), f"{EX}note", F.concat(F.lit("n"), F.length("s").cast("string")))
    return on.annotations(g.unionByName(notes).unionByName(gr.abox(s, [(f"{EX}note", TYPE, f"{OWL}AnnotationProperty")]).select("s", "p", "o"))).select("iri", "prop", "value")


@query(f"{NODES} SELECT b AS c, a AS sub FROM c UNION SELECT '{OWL}Thing', 'Top'")
def o16_asserted_subclasses(s, d):
    return on.asserted_subclasses(class_graph(s, d))


@query("SELECT p_type AS c, count(*) AS n FROM part GROUP BY p_type")
def o16_asserted_instances(s, d):
    g = triples(table(s, d, "part"), node("part", "p_partkey"), TYPE, F.col("p_type")).unionByName(class_graph(s, d))
    return on.asserted_instances(g).groupBy("c").agg(F.count("*").alias("n"))


@query(f"""{NODES} SELECT section, count(*) AS n FROM (SELECT 'annotation' AS section, c, lower(c) AS v FROM n UNION ALL SELECT 'states', a, b FROM c UNION ALL SELECT 'states', c, 'class' FROM n UNION ALL SELECT 'mentioned', b, a FROM c UNION ALL SELECT 'mentioned', 'class', c FROM n) GROUP BY section""")
def o31_described(s, d):
    return on.described(class_graph(s, d)).groupBy("section").agg(F.count("*").alias("n"))


@query(f"{NODES} SELECT c AS iri FROM n")
def o14_signature(s, d):
    return hi.signature(class_graph(s, d), f"{OWL}Class")


@query(f"{NODES} SELECT c AS iri, '{OWL}Class {OWL}NamedIndividual' AS types FROM n WHERE c LIKE 'Group%'")
def o15_punned(s, d):
    g = class_graph(s, d)
    more = triples(g.filter(F.col("s").startswith("Group") & (F.col("p") == TYPE)), F.col("s"), TYPE, f"{OWL}NamedIndividual")
    return hi.punned(g.unionByName(more)).select("iri", F.concat_ws(" ", "types").alias("types"))


FLAGS = [("p1", "Asymmetric"), ("p1", "Symmetric"), ("p2", "Transitive"), ("p2", "Functional"), ("p3", "Symmetric"), ("p3", "Transitive"), ("p4", "Irreflexive")]


@query(f"SELECT n_name || p AS iri, '{OWL}' || a AS first, '{OWL}' || b AS second FROM nation, (VALUES ('p1', 'AsymmetricProperty', 'SymmetricProperty'), ('p2', 'FunctionalProperty', 'TransitiveProperty')) v(p, a, b)")
def o18_forbidden_characteristics(s, d):
    flags = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(f"{OWL}{k}Property").alias("k")) for p, k in FLAGS])).alias("f")
    return hi.forbidden_characteristics(table(s, d, "nation").select("n_name", flags).select(F.concat("n_name", "f.p").alias("s"), F.lit(TYPE).alias("p"), F.col("f.k").alias("o")))


@query("SELECT 'ordered' AS kind, o_orderkey::VARCHAR AS o FROM orders WHERE o_orderkey = 7 UNION ALL SELECT 'related', o_orderkey::VARCHAR FROM orders WHERE o_orderkey = 7")
def o08_individual_properties(s, d):
    g = triples(table(s, d, "orders"), node("order", "o_orderkey"), "ordered", F.col("o_orderkey").cast("string"))
    return hi.individual_properties(g, f"{EX}order/7", s.createDataFrame([("ordered", "related")], "a string, b string")).select(F.col("p").alias("kind"), "o")


@query("SELECT 'a' AS test, true AS yes UNION ALL SELECT 'b', false UNION ALL SELECT 'c', true UNION ALL SELECT 'd', (SELECT count(*) > 0 FROM part WHERE p_type = 'PROMO')")
def o09_subclass_tests(s, d):
    c = hi.subsumptions(class_edges(s, d))
    tests = {"a": ("Group1", "Top"), "b": ("Top", "Group1"), "c": ("Type", "Type"), "d": ("PROMO", "Top")}
    return s.createDataFrame([(k, hi.is_subclass(c, *v)) for k, v in tests.items()], "test string, yes boolean")


@query(f"SELECT p_partkey AS i FROM part WHERE regexp_extract(p_brand, '\\d+')::INT % 5 = 2")
def o10_inconsistent(s, d):
    types = table(s, d, "part").select(F.col("p_partkey").alias("i"), F.explode(F.array("p_brand", "p_type")).alias("c"))
    return hi.inconsistent_individuals(types, hi.subsumptions(class_edges(s, d)), s.createDataFrame([("Group2", "Type")], "a string, b string"))


@query(f"""{CLASS_CLOSURE}, d AS (SELECT p, c FROM (VALUES ('made', 'Brand'), ('kept', 'Type'), ('free', 'Top')) v(p, c)), r AS (SELECT p, c FROM (VALUES ('made', 'Type'), ('kept', 'Brand'), ('free', 'Top')) v(p, c))
SELECT d.p FROM d JOIN r ON d.p = r.p WHERE (d.c = 'Group1' OR d.c IN (SELECT b FROM t WHERE a = 'Group1')) AND (r.c = 'PROMO' OR r.c IN (SELECT b FROM t WHERE a = 'PROMO'))""")
def o13_applicable(s, d):
    rows = lambda *x: s.createDataFrame(list(x), "p string, c string")
    return hi.applicable(rows(("made", "Brand"), ("kept", "Type"), ("free", "Top")), rows(("made", "Type"), ("kept", "Brand"), ("free", "Top")), hi.subsumptions(class_edges(s, d)), "Group1", "PROMO")


@query(f"{CLASS_CLOSURE} SELECT 'SubClassOf' AS type, a AS s, '{SUBCLASS}' AS p, b AS o FROM t EXCEPT SELECT 'SubClassOf', a, '{SUBCLASS}', b FROM c")
def o19_inferred_subclasses(s, d):
    return on.inferred(class_graph(s, d), ["SubClassOf"], "rdfs")


@query(f"""SELECT 'ClassAssertion' AS type, count(*) AS n FROM (SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey FROM orders UNION ALL SELECT DISTINCT o_custkey FROM orders UNION ALL SELECT DISTINCT o_custkey FROM orders)
UNION ALL SELECT 'PropertyAssertion', count(*) * 3 FROM orders UNION ALL SELECT 'InverseObjectProperties', 1 UNION ALL SELECT 'ObjectPropertyCharacteristic', 1 UNION ALL SELECT 'SubObjectPropertyOf', 1""")
def o19_inferred_by_type(s, d):
    full = lambda x: f"{EX}{x}"
    more = gr.abox(s, [
        (full("orderedBy"), f"{OWL}inverseOf", full("ordered")), (full("involves"), TYPE, f"{OWL}FunctionalProperty"), (full("orderedBy"), TYPE, f"{OWL}ObjectProperty"),
        (full("involves"), TYPE, f"{OWL}ObjectProperty"), (full("orderedBy"), SUBPROPERTY, full("middle")), (full("middle"), SUBPROPERTY, full("related")), (full("middle"), TYPE, f"{OWL}AnnotationProperty"),
    ])
    g = order_links(s, d).unionByName(more)
    out = on.inferred(g, ["ClassAssertion", "InverseObjectProperties", "ObjectPropertyCharacteristic", "SubObjectPropertyOf", "PropertyAssertion"])
    # links of orders: involves, middle, related and the inverse one, of which the stated graph has none
    return out.filter(f"p <> '{EX}related'").groupBy("type").agg(F.count("*").alias("n"))


@query(f"""{CLASS_CLOSURE}, w AS (SELECT a, b, [a, b] AS path FROM c WHERE a = 'Group3' UNION ALL SELECT w.a, c.b, list_append(path, c.b) FROM w JOIN c ON c.a = w.b WHERE NOT list_contains(path, c.b)),
f AS (SELECT path FROM w WHERE b = 'Top' ORDER BY len(path), path LIMIT 1) SELECT (i - 1)::INT AS step, path[i - 1] AS a, path[i] AS b FROM (SELECT path, unnest(range(2, len(path) + 1)) AS i FROM f)""")
def o20_explanation(s, d):
    return en.why_subclass(class_graph(s, d), "Group3", "Top")


@query(f"{NODES}, v AS (SELECT 'undeclared property' AS violation, 'madeOf' AS iri UNION ALL SELECT 'not simple in a cardinality', 'partOf' UNION ALL SELECT 'not simple in a characteristic', 'under' UNION ALL SELECT 'class and datatype', 'Brand' UNION ALL SELECT 'anonymous individual', 'urn:blank:i' UNION ALL SELECT 'undeclared property', 'partOf' UNION ALL SELECT 'cycle of datatypes', 'd1' UNION ALL SELECT 'cycle of datatypes', 'd2' UNION ALL SELECT 'ontology name not absolute', 'mine' UNION ALL SELECT 'reserved ontology name', '{OWL}x') SELECT violation, iri FROM v")
def o22_profile_kinds(s, d):
    rows = [
        ("urn:blank:r", f"{OWL}onProperty", "madeOf"), ("urn:blank:q", f"{OWL}onProperty", "partOf"), ("urn:blank:q", f"{OWL}maxCardinality", "1"), ("hasPart", TYPE, f"{OWL}TransitiveProperty"), ("hasPart", SUBPROPERTY, "partOf"),
        ("hasPart", SUBPROPERTY, "under"), ("under", TYPE, f"{OWL}FunctionalProperty"), ("Brand", TYPE, f"{RDFS}Datatype"), ("urn:blank:i", TYPE, "Brand"), ("d1", TYPE, f"{RDFS}Datatype"), ("d2", TYPE, f"{RDFS}Datatype"),
        ("d1", f"{OWL}equivalentClass", "d2"), ("d2", f"{OWL}equivalentClass", "d1"), ("mine", TYPE, f"{OWL}Ontology"), ("urn:o", f"{OWL}versionIRI", f"{OWL}x"),
    ]
    return ax.profile_violations(class_graph(s, d).unionByName(s.createDataFrame(rows, "s string, p string, o string")))


def part_links(s, d):
    return table(s, d, "part").select(F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("x"), F.lit("madeBy").alias("p"), F.col("p_brand").alias("c"))


@query(f"""{CLASS_CLOSURE}, used AS (SELECT DISTINCT p_brand AS c FROM part), every AS (SELECT c FROM used UNION SELECT b FROM used JOIN t ON c = a),
d AS (SELECT a, b FROM t EXCEPT SELECT x.a, y.b FROM t x JOIN t y ON x.b = y.a)
SELECT 'class' AS kind, count(*) * 4 AS n FROM every UNION ALL SELECT 'link', (SELECT count(*) FROM every JOIN d ON c = a) + (SELECT count(*) FROM part)""")
def o24_relonomy(s, d):
    out = on.relonomy(part_links(s, d), hi.subsumptions(class_edges(s, d)))
    return out.filter(f"p <> '{OWL}onProperty'").groupBy(F.when(F.col("p") == SUBCLASS, "link").otherwise("class").alias("kind")).agg(F.count("*").alias("n"))


@query(f"{CLASS_CLOSURE}, l AS (SELECT p_partkey, p_brand AS c FROM part UNION SELECT p_partkey, b FROM part JOIN t ON p_brand = a) SELECT 'madeBy' AS p, (SELECT count(*) FROM part) AS n_stated, (SELECT count(*) FROM l) AS n_pairs, (SELECT count(*) FROM part) AS n_subjects, (SELECT count(DISTINCT c) FROM l) AS n_objects")
def a04_relation_counts(s, d):
    return on.relation_counts(part_links(s, d), hi.subsumptions(class_edges(s, d)))


@query(f"{CLASS_CLOSURE} SELECT b AS node, count(*) AS n FROM t GROUP BY b")
def a04_descendant_counts(s, d):
    return on.descendant_counts(hi.subsumptions(class_edges(s, d)))


@query("SELECT p_type AS key, list_sort(list(DISTINCT p_brand))::VARCHAR AS brands, count(*) AS n FROM part GROUP BY p_type")
def a03_grouped_values(s, d):
    return table(s, d, "part").groupBy(F.col("p_type").alias("key")).agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_set("p_brand")), ", "), F.lit("]")).alias("brands"), F.count("*").alias("n"))


@query("SELECT p_size::VARCHAR AS value, count(*) AS n FROM part GROUP BY p_size")
def a03_value_sets(s, d):
    return cd.value_sets(table(s, d, "part").select(F.col("p_size").cast("string").alias("x")), "x")


@query(f"WITH RECURSIVE {CLASSES}, p AS (SELECT 'Top' AS node, 'Top' AS path, 0 AS depth UNION ALL SELECT c.a, path || '/' || c.a, depth + 1 FROM p JOIN c ON c.b = p.node) SELECT node, path, depth FROM p")
def snk07_tree(s, d):
    return hi.tree_rows(class_edges(s, d), "Top").select("node", F.array_join("path", "/").alias("path"), "depth")


@query(f"{NODES} SELECT 'node' AS kind, c AS a, lower(c) AS b FROM n UNION ALL SELECT 'edge', a, b FROM c")
def snk08_graph_tables(s, d):
    g = class_graph(s, d)
    nodes, edges = on.graph_tables(class_edges(s, d), hi.levels(class_edges(s, d)), g.filter(F.col("p") == LABEL).select(F.col("s").alias("iri"), F.col("o").alias("label")))
    return nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("label").alias("b")).unionByName(edges.select(F.lit("edge").alias("kind"), F.col("from").alias("a"), F.col("to").alias("b")))


@query("SELECT 'part' || p_partkey AS a, p_brand AS b FROM part WHERE p_size > 25")
def x02_matched_shapes(s, d):
    return tr.matching(part_axioms(s, d), "(EquivalentClasses ?a ?b)").select("a", "b")


@query("SELECT n_name AS a, 'in' AS p, 'R' || n_regionkey AS b FROM nation")
def x02_nested_shapes(s, d):
    text = F.format_string("(SubClassOf %s (ObjectSomeValuesFrom in R%d))", "n_name", "n_regionkey")
    return tr.matching(table(s, d, "nation").select(text.alias("sexpr")), "(SubClassOf ?a (ObjectSomeValuesFrom ?p ?b))").select("a", "p", "b")


@query("SELECT axiom_type, count(*) AS n FROM (SELECT 'SubClassOf' AS axiom_type FROM part UNION ALL SELECT 'Declaration' FROM part WHERE p_size < 10 UNION ALL SELECT 'DisjointClasses' FROM part WHERE p_size < 10) GROUP BY axiom_type")
def x08_changes(s, d):
    now = ax.without_types(part_axioms(s, d), "EquivalentClasses")
    gone = ax.of_types(part_axioms(s, d, "p_size >= 10"), "Declaration").withColumn("change", F.lit("remove"))
    p = table(s, d, "part").filter("p_size < 10")
    new = ax.axiom_rows(p, "DisjointClasses", F.concat(F.lit("part"), F.col("p_partkey").cast("string")), F.lit("Other")).withColumn("change", F.lit("add"))
    return on.changed(on.changed(now, gone.unionByName(new)), new).groupBy("axiom_type").agg(F.count("*").alias("n"))


@query(f"SELECT '{OWL}versionIRI' AS p, 'v2' AS o UNION ALL SELECT '{OWL}imports', 'other' UNION ALL SELECT '{TYPE}', '{OWL}Ontology'")
def x08_header(s, d):
    g = on.with_header(class_graph(s, d), "mine", version="v1")
    return on.with_header(g, "mine", ["other"], "v2").filter("s = 'mine'").select("p", "o")


@query("SELECT DISTINCT p_brand AS s, lower(p_brand) AS o FROM part")
def x07_copied_annotations(s, d):
    target = triples(table(s, d, "part"), node("part", "p_partkey"), TYPE, F.col("p_brand"))
    return on.copied_annotations(class_graph(s, d), target).filter(F.col("p") == LABEL).select("s", "o")


@query("SELECT side, count(*) AS n FROM (SELECT CASE WHEN p_type = 'PROMO' THEN 'old' ELSE 'rest' END AS side FROM part UNION ALL SELECT 'rest' FROM part UNION ALL SELECT 'rest' FROM part WHERE p_size > 25) GROUP BY side")
def x07_split_deprecated(s, d):
    flag = s.createDataFrame([("PROMO", f"{OWL}deprecated", "true")], "s string, p string, o string")
    old, rest = ax.split_deprecated(part_axioms(s, d), flag)
    return old.select(F.lit("old").alias("side")).unionByName(rest.select(F.lit("rest").alias("side"))).groupBy("side").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN p_size > 25 THEN 'hit' ELSE 'miss' END AS side, count(*) AS n FROM (SELECT p_size FROM part UNION ALL SELECT NULL) GROUP BY 1")
def u06_split(s, d):
    hit, miss = ax.split_by(table(s, d, "part").select("p_size").unionByName(s.createDataFrame([(None,)], "p_size int")), F.col("p_size") > 25)
    return hit.agg(F.count("*").alias("n")).select(F.lit("hit").alias("side"), "n").unionByName(miss.agg(F.count("*").alias("n")).select(F.lit("miss").alias("side"), "n"))


@query("SELECT 'only first' AS op, count(*) AS n FROM part WHERE p_size < 10 UNION ALL SELECT 'both', count(*) FROM part WHERE p_size BETWEEN 10 AND 39 UNION ALL SELECT 'either', count(*) FROM part")
def u02_set_operations(s, d):
    a, b = (ax.of_types(part_axioms(s, d, w), "Declaration").select("axiom_id") for w in ("p_size < 40", "p_size >= 10"))
    parts = {"only first": a.subtract(b), "both": a.intersect(b), "either": a.union(b).distinct()}
    out = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("op"), "n") for k, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT n_name AS label, CASE WHEN n_nationkey < 5 THEN 'only_1' WHEN n_nationkey < 20 THEN 'both' ELSE 'only_2' END AS side FROM nation")
def u05_compared_labels(s, d):
    n = table(s, d, "nation")
    return ax.diff(n.filter("n_nationkey < 20").select(F.col("n_name").alias("label")), n.filter("n_nationkey >= 5").select(F.col("n_name").alias("label")), ["label"])


@query("SELECT 'main' AS ont, count(*) AS n FROM (SELECT 1 FROM part UNION ALL SELECT 1 FROM part WHERE p_size > 25 UNION ALL SELECT 1 FROM part) UNION ALL SELECT 'base', count(*) FROM (SELECT 1 FROM part WHERE p_size < 5 UNION ALL SELECT 1 FROM part WHERE p_size < 5)")
def src07_imports_closure(s, d):
    every = part_axioms(s, d).unionByName(part_axioms(s, d, "p_size < 5", "base")).unionByName(part_axioms(s, d, "p_size < 9", "unused"))
    return ax.imports_closure(every, s.createDataFrame([("main", "base"), ("base", "root"), ("main", "root")], "a string, b string"), "main").groupBy("ont").agg(F.count("*").alias("n"))


@query("SELECT 'nation' || n_nationkey AS s, 'source' AS prop, 'R' || n_regionkey AS value FROM nation")
def x11_reified(s, d):
    n = table(s, d, "nation")
    key = F.concat(F.lit("nation"), F.col("n_nationkey").cast("string"))
    stated = triples(n, key, "named", F.col("n_name"))
    notes = n.select(key.alias("s"), F.lit("named").alias("p"), F.col("n_name").alias("o"), F.lit("source").alias("prop"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("value"))
    return on.statement_annotations(on.reified(stated, notes)).select("s", "prop", "value")


@query("SELECT 'u' || r_regionkey AS head, n_name AS item FROM region JOIN nation ON n_regionkey = r_regionkey")
def x10_lists(s, d):
    n = table(s, d, "nation")
    own = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("args")).select(F.concat(F.lit("u"), F.col("n_regionkey").cast("string")).alias("id"), F.lit("or").alias("op"), F.lit(None).cast("string").alias("prop"), "args")
    made = on.expression_triples(own)
    lists = made.filter(F.col("p") == f"{OWL}unionOf").select(F.col("s").alias("id"), F.col("o").alias("head"))
    return gr.list_items(made, on.RDF_FIRST, on.RDF_REST, on.RDF_NIL).join(lists, "head").select(F.col("id").alias("head"), "item")


@query(f"SELECT p, count(*) AS n FROM (SELECT unnest(['{TYPE}', '{OWL}onProperty', '{OWL}someValuesFrom']) AS p FROM nation UNION ALL SELECT unnest(['{TYPE}', '{OWL}onProperty', '{OWL}minQualifiedCardinality', '{OWL}onClass']) FROM region) GROUP BY p")
def x10_restrictions(s, d):
    some = table(s, d, "nation").select(F.concat(F.lit("x"), "n_name").alias("id"), F.lit("some").alias("op"), F.lit("in").alias("prop"), F.array("n_name").alias("args"))
    least = table(s, d, "region").select(F.concat(F.lit("y"), "r_name").alias("id"), F.lit("min").alias("op"), F.lit("has").alias("prop"), F.array(F.lit("2"), "r_name").alias("args"))
    return on.expression_triples(some.unionByName(least)).groupBy("p").agg(F.count("*").alias("n"))


@query(f"{NODES} SELECT 'inconsistent' AS \"check\", (SELECT count(*) FROM part WHERE regexp_extract(p_brand, '\\d+')::INT % 5 = 4) AS n UNION ALL SELECT 'unsatisfiable', 0 UNION ALL SELECT 'profile: undeclared class', 1")
def o33_release_report(s, d):
    p = table(s, d, "part")
    facts = triples(p, node("part", "p_partkey"), TYPE, F.col("p_brand")).unionByName(triples(p, node("part", "p_partkey"), TYPE, F.col("p_type")))
    rules = s.createDataFrame([("Group4", f"{OWL}disjointWith", "Type"), ("Top", SUBCLASS, "Over")], "s string, p string, o string")
    return on.release({"classes": class_graph(s, d), "facts": facts, "rules": rules}).report


@query(f"{CLASS_CLOSURE} SELECT count(*) AS n FROM (SELECT a, b FROM t EXCEPT SELECT a, b FROM c)")
def o33_release_inferred(s, d):
    return on.release({"classes": class_graph(s, d)}).inferred.agg(F.count("*").alias("n"))


@query("""SELECT name, kind, symbol FROM (SELECT 'n' || n_nationkey AS name, k AS kind, v AS symbol FROM nation, (VALUES ('predicate', 'in'), ('predicate', 'customer'), ('variable', '?x'), ('variable', '?y')) t(k, v)
UNION ALL SELECT 'n' || n_nationkey, 'constant', 'nation' || n_nationkey FROM nation UNION ALL SELECT 'n' || n_nationkey, 'constant', n_name FROM nation)""")
def l03_formula_symbols(s, d):
    text = F.format_string('(forall (?x) (implies (in ?x nation%d) (exists (?y) (and (customer ?y) (not (= ?x %s))))))', "n_nationkey", "n_name")
    n = table(s, d, "nation")
    return co.symbols_of(n.select(F.format_string("n%d", "n_nationkey").alias("name"), text.alias("sexpr")))


@query("SELECT c_custkey::VARCHAR AS c FROM customer WHERE c_custkey % 10 <> 0 AND c_nationkey <> 3 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def l04_negation_inward(s, d):
    o = table(s, d, "orders").filter("o_orderstatus = 'P'")
    facts = order_facts(s, d).unionByName(o.select(F.lit("open").alias("pred"), F.array(F.col("o_custkey").cast("string")).alias("args")).distinct())
    either = ("or", ("fact", "in", "?c", "3"), ("fact", "open", "?c"))
    return co.satisfying(("and", ("fact", "customer", "?c"), ("not", either)), facts)


@query("SELECT DISTINCT l_orderkey::VARCHAR AS o, l_linenumber::VARCHAR AS l FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def l11_forall_formula(s, d):
    line = table(s, d, "lineitem").select(F.lit("line").alias("pred"), F.array(F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("args"))
    closed = table(s, d, "orders").filter("o_orderstatus <> 'P'").select(F.lit("closed").alias("pred"), F.array(F.col("o_orderkey").cast("string")).alias("args"))
    return co.counterexamples(("forall", ["?o", "?l"], ("implies", ("fact", "line", "?o", "?l"), ("fact", "closed", "?o"))), line.unionByName(closed)).select("o", "l")


@query("SELECT c_custkey::VARCHAR AS c FROM customer WHERE (c_custkey % 10 <> 0) <> (c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'))")
def l12_iff_formula(s, d):
    formula = ("forall", ["?c"], ("iff", ("fact", "customer", "?c"), ("exists", ["?o"], ("and", ("fact", "by", "?o", "?c"), ("fact", "done", "?o")))))
    return co.counterexamples(formula, order_facts(s, d))


@query("SELECT 'closed' AS name, true AS holds UNION ALL SELECT 'one more', false")
def l17_closure_axiom(s, d):
    facts = table(s, d, "region").select(F.lit("region").alias("pred"), F.array("r_name").alias("args"))
    axiom = co.closure_axiom([("region", r["r_name"]) for r in table(s, d, "region").select("r_name").collect()])
    more = facts.unionByName(s.createDataFrame([("region", ["NOWHERE"])], "pred string, args array<string>"))
    return s.createDataFrame([("closed", co.holds(axiom, facts)), ("one more", co.holds(axiom, more))], "name string, holds boolean")


@query("SELECT name, n FROM (SELECT 'each order has a customer' AS name, count(*) AS n FROM orders WHERE o_custkey % 10 = 0 UNION ALL SELECT 'each customer is in 3', count(*) FROM customer WHERE c_custkey % 10 <> 0 AND c_nationkey <> 3) ORDER BY n DESC LIMIT 1")
def s04_worst_formulas(s, d):
    every = {
        "each order has a customer": ("forall", ["?o", "?c"], ("implies", ("fact", "by", "?o", "?c"), ("fact", "customer", "?c"))),
        "each customer is in 3": ("forall", ["?c"], ("implies", ("fact", "customer", "?c"), ("fact", "in", "?c", "3"))),
    }
    return co.check(every, order_facts(s, d)).select("name", F.col("n_counterexamples").alias("n")).orderBy(F.desc("n")).limit(1)


@query("SELECT DISTINCT p_partkey AS code, min(p_type) AS mapped FROM part GROUP BY p_partkey HAVING count(DISTINCT p_type) = 1")
def src28_unambiguous(s, d):
    rows = table(s, d, "part").select(F.col("p_partkey").alias("code"), F.col("p_type").alias("mapped"))
    twice = table(s, d, "nation").select((F.col("n_nationkey") + 10_000_000).cast("long").alias("code"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("mapped"))
    return cd.unambiguous(rows.withColumn("code", F.col("code").cast("long")).unionByName(twice))


@query("SELECT n_name AS name, 'label ' || n_name AS x, 1::BIGINT AS n FROM nation")
def e03_label_functions(s, d):
    labels = table(s, d, "nation").select(F.col("n_name").alias("iri"), F.col("n_name").alias("label"))
    shown = lambda c: F.concat(F.lit("label "), c)
    return hi.labels_or_terms(labels.select(F.col("iri").alias("name")), labels, "name").select("name", shown(F.col("name")).alias("x"), F.lit(1).cast("long").alias("n"))


@query("SELECT o_orderkey, o_custkey * 2 AS y FROM orders")
def e02_rows_by_callback(s, d):
    def double(batches):
        import pyarrow as arrow
        import pyarrow.compute as pc

        for b in batches:
            yield arrow.RecordBatch.from_arrays([b["o_orderkey"], pc.multiply(b["o_custkey"], 2)], names=["o_orderkey", "y"])

    o = table(s, d, "orders")
    return o.select("o_orderkey", "o_custkey").mapInArrow(double, f"o_orderkey {dict(o.dtypes)['o_orderkey']}, y {dict(o.dtypes)['o_custkey']}")


@query("SELECT DISTINCT n_name || ' (' || r_name || ')' AS value FROM nation JOIN region ON n_regionkey = r_regionkey")
def x18_labelled_lines(s, d):
    lines = table(s, d, "nation").select(F.format_string("%s in <ex:R%d>", "n_name", "n_regionkey").alias("line"))
    labels = table(s, d, "region").select(F.format_string("ex:R%d", "r_regionkey").alias("iri"), F.col("r_name").alias("label"))
    return on.commented(lines, "line", labels).select(F.concat(F.split("line", " ")[0], F.lit(" ("), F.array_join("labels", ","), F.lit(")")).alias("value"))
