"""Registered queries on rules with built-ins, further entailment, formulas of axioms, weakened axiom sets and databases."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadrille.functions import builtins as bu
from quadrille.functions import strings as st
from quadrille.functions import terms as te
from quadrille.functions.terms import OWL, RDFS, SUBCLASS, SUBPROPERTY, TYPE
from quadrille.operators import axioms as ax
from quadrille.operators import constraints as co
from quadrille.operators import entailment as en
from quadrille.operators import hierarchy as hi
from quadrille.operators import models as mo
from quadrille.operators import patterns as pa
from quadrille.plans.fixpoint import Rule, saturate
from quadrille.queries import AXIOMS, CLASS_CLOSURE, EX, class_edges, nation_graph, node, order_facts, part_axioms, places, query, table
from quadrille.sources import databases as db


@query("SELECT c_custkey::VARCHAR AS c FROM customer WHERE c_acctbal > 5000 AND c_nationkey <> 3")
def x13_rule_with_builtins(s, d):
    c = table(s, d, "customer")
    facts = mo.facts_of(c, "has", F.col("c_custkey"), F.col("c_acctbal")).unionByName(mo.facts_of(c, "in", F.col("c_custkey"), F.col("c_nationkey")))
    rule = Rule(("rich", "?c"), (("has", "?c", "?b"), ("in", "?c", "?n")), tests=(bu.test("greaterThan", "?b", 5000), bu.test("notEqual", "?n", 3)))
    return saturate(facts, [rule]).filter("pred = 'rich'").select(F.col("args")[0].alias("c"))


@query("SELECT DISTINCT a.s_suppkey::VARCHAR AS a, b.s_suppkey::VARCHAR AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey")
def x13_rule_different_from(s, d):
    facts = mo.facts_of(table(s, d, "supplier"), "in", F.col("s_suppkey"), F.col("s_nationkey"))
    rule = Rule(("neighbour", "?a", "?b"), (("in", "?a", "?n"), ("in", "?b", "?n")), tests=(bu.test("notEqual", "?a", "?b", numeric=False),))
    return saturate(facts, [rule]).filter("pred = 'neighbour'").select(F.col("args")[0].alias("a"), F.col("args")[1].alias("b"))


@query(f"SELECT '{EX}a/' || n_nationkey AS a, '{EX}b/' || n_nationkey AS b FROM nation UNION ALL SELECT '{EX}b/' || n_nationkey, '{EX}a/' || n_nationkey FROM nation")
def o06_same_individuals(s, d):
    n = table(s, d, "nation")
    link = lambda kind: n.select(node(kind, "n_nationkey").alias("s"), F.lit(f"{EX}code").alias("p"), node("code", "n_nationkey").alias("o"))
    flag = s.createDataFrame([(f"{EX}code", TYPE, f"{OWL}InverseFunctionalProperty")], "s string, p string, o string")
    return en.same_individuals(link("a").unionByName(link("b")).unionByName(flag))


@query(f"SELECT s FROM (SELECT '{EX}a/' || n_nationkey AS s FROM nation UNION ALL SELECT '{EX}b/' || n_nationkey FROM nation)")
def o30_horst_equal_individuals(s, d):
    """Of two names of each nation one is in a class; its type, by the equality, holds of the other too, and by a restriction of the code's holder."""
    n = table(s, d, "nation")
    same = n.select(node("a", "n_nationkey").alias("s"), F.lit(f"{OWL}sameAs").alias("p"), node("b", "n_nationkey").alias("o"))
    links = n.select(node("a", "n_nationkey").alias("s"), F.lit(f"{EX}near").alias("p"), node("sea", "n_regionkey").alias("o"))
    seas = n.select(node("sea", "n_regionkey").alias("s"), F.lit(TYPE).alias("p"), F.lit(f"{EX}Sea").alias("o")).distinct()
    rules = [("urn:blank:r", f"{OWL}onProperty", f"{EX}near"), ("urn:blank:r", f"{OWL}someValuesFrom", f"{EX}Water"), ("urn:blank:r", SUBCLASS, f"{EX}Coastal"), (f"{EX}Sea", SUBCLASS, f"{EX}Water")]
    g = same.unionByName(links).unionByName(seas).unionByName(s.createDataFrame(rules, "s string, p string, o string"))
    return en.entailed(g, "horst").filter((F.col("p") == TYPE) & (F.col("o") == f"{EX}Coastal")).select("s")


@query(f"SELECT '{EX}nation/' || n_nationkey AS s, '{EX}Place' AS o FROM nation UNION ALL SELECT '{EX}region/' || r_regionkey, '{EX}Area' FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)")
def o30_horst_restrictions(s, d):
    """hasValue gives the type, and allValuesFrom the type of what a member is linked to."""
    low = nation_graph(s, d).filter(F.col("p") == f"{EX}inRegion").select("s", "p", "o")
    kind = low.select("s", F.lit(f"{EX}kind").alias("p"), F.lit(f"{EX}k").alias("o"))
    rules = [("urn:blank:v", f"{OWL}onProperty", f"{EX}kind"), ("urn:blank:v", f"{OWL}hasValue", f"{EX}k"), ("urn:blank:v", SUBCLASS, f"{EX}Place"), ("urn:blank:w", f"{OWL}onProperty", f"{EX}inRegion"), ("urn:blank:w", f"{OWL}allValuesFrom", f"{EX}Area"), (f"{EX}Place", SUBCLASS, "urn:blank:w")]
    out = en.entailed(low.unionByName(kind).unionByName(s.createDataFrame(rules, "s string, p string, o string")), "horst")
    return out.filter((F.col("p") == TYPE) & F.col("o").isin(f"{EX}Place", f"{EX}Area")).select("s", "o")


@query("SELECT name, n FROM (SELECT 'some' AS name, count(*) AS n FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT 'functional', 0 UNION ALL SELECT 'range', count(*) FROM orders WHERE o_custkey % 10 = 0 UNION ALL SELECT 'disjoint', 0)")
def l18_axiom_formulas(s, d):
    facts = order_facts(s, d)
    every = {
        "some": co.axiom_formula("SubClassOf", "customer", ("some", ("inverse", "by"), "done")), "functional": co.axiom_formula("FunctionalObjectProperty", "in"),
        "range": co.axiom_formula("ObjectPropertyRange", "by", "customer"), "disjoint": co.axiom_formula("DisjointClasses", "customer", "nobody"),
    }
    return co.check(every, facts).select("name", F.col("n_counterexamples").alias("n"))


@query("SELECT c_custkey::VARCHAR AS x FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' WHERE c_custkey % 10 <> 0 GROUP BY c_custkey HAVING count(o_orderkey) < 2")
def l18_minimum_cardinality(s, d):
    return co.counterexamples(co.axiom_formula("SubClassOf", "customer", ("min", 2, ("inverse", "by"), "done")), order_facts(s, d))


@query(f"WITH {AXIOMS} SELECT x AS sexpr FROM a WHERE x NOT LIKE '(Equiv%' UNION ALL SELECT '(SubClassOf ' || n_name || ' (ObjectHasValue in R' || n_regionkey || '))' FROM nation")
def x05_subclasses_and_values(s, d):
    n = table(s, d, "nation")
    text = F.format_string("(SubClassOf %s (ObjectHasValue in R%d))", "n_name", "n_regionkey")
    value = n.select(F.lit("main").alias("ont"), F.sha1(text).alias("axiom_id"), F.lit("SubClassOf").alias("axiom_type"), F.lit(True).alias("is_logical"), text.alias("sexpr"), F.array("n_name").alias("symbols"))
    return ax.subclasses_and_values(part_axioms(s, d).unionByName(value)).select("sexpr")


@query(f"{CLASS_CLOSURE} SELECT '(SubClassOf ' || a || ' ' || b || ')' AS sexpr FROM c WHERE a IN (SELECT a FROM t WHERE b = 'Brand')")
def x05_branch(s, d):
    rows = ax.axiom_rows(class_edges(s, d), "SubClassOf", F.col("a"), F.col("b"))
    return ax.branch(rows, hi.below(class_edges(s, d), "Brand")).select("sexpr")


@query(f"WITH {AXIOMS} SELECT 'simple' AS kind, count(*) AS n FROM a WHERE x LIKE '(Equiv%' UNION ALL SELECT 'weak', count(*) FROM a WHERE x NOT LIKE '(Equiv%' UNION ALL SELECT 'none', 0")
def x06_weakened(s, d):
    rows = part_axioms(s, d)
    count = lambda df, k: df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
    complex_ = rows.limit(1).withColumns({"axiom_type": F.lit("SubClassOf"), "sexpr": F.lit("(SubClassOf a (ObjectMinCardinality 2 p))")})
    return count(ax.is_simple(rows, "EquivalentClasses"), "simple").unionByName(count(ax.weakened(rows.unionByName(complex_)), "weak")).unionByName(count(ax.without_cardinality(complex_), "none"))


@query(f"SELECT '{EX}nation/' || n_nationkey AS s, '{RDFS}seeAlso' AS p, '{EX}region/' || n_regionkey AS o FROM nation")
def snk04_keywords(s, d):
    rows = table(s, d, "nation").select(node("nation", "n_nationkey").alias("s"), F.lit(":see").alias("p"), node("region", "n_regionkey").alias("o"))
    return ax.with_keywords(rows, {"see": f"{RDFS}seeAlso", "none": f"{EX}none"})


@query(f"SELECT '{EX}customer/' || c_custkey AS c FROM customer WHERE c_nationkey = 7")
def q29_nicknames(s, d):
    te.nickname("inside", "ex:inNation")
    te.nickname("seven", "ex:nation/7")
    return pa.bgp(places(s, d), ("?c", te.resolved_term(":inside"), te.resolved_term(":seven")), ("?c", "a", "ex:Customer")).select("c")


@query("SELECT 'yes' AS test, count(*) > 0 AS found FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'no', false")
def q16_ask(s, d):
    g = places(s, d)
    return s.createDataFrame([("yes", pa.ask(pa.bgp(g, ("?c", "ex:segment", "BUILDING")))), ("no", pa.ask(pa.bgp(g, ("?c", "ex:segment", "NO SUCH"))))], "test string, found boolean")


@query("SELECT DISTINCT event_type AS node FROM events UNION SELECT 'event' UNION SELECT DISTINCT event_type || '/' || user_id % 10 FROM events")
def o05_annotation_properties_below(s, d):
    """Kinds of events, and those of groups of users, as annotation properties below a note."""
    e = table(s, d, "events")
    own = F.concat("event_type", F.lit("/"), (F.col("user_id") % 10).cast("string"))
    links = e.select(F.explode(F.array(F.struct(own.alias("a"), F.col("event_type").alias("b")), F.struct(F.col("event_type").alias("a"), F.lit("event").alias("b")))).alias("l")).select("l.*").distinct()
    return hi.below(links.unionByName(s.createDataFrame([("event", "note")], "a string, b string")), "note")


@query(f"""{CLASS_CLOSURE}, w AS (SELECT a, b, [a, b] AS path FROM c WHERE a = 'Brand#3' UNION ALL SELECT w.a, c.b, list_append(path, c.b) FROM w JOIN c ON c.a = w.b WHERE NOT list_contains(path, c.b)),
f AS (SELECT path FROM w WHERE b = 'Top' ORDER BY len(path), path LIMIT 1) SELECT (i - 1)::INT AS step, path[i - 1] AS a, path[i] AS b FROM (SELECT path, unnest(range(2, len(path) + 1)) AS i FROM f)""")
def o20_property_explanation(s, d):
    """One shortest chain of property links."""
    g = class_edges(s, d).select(F.col("a").alias("s"), F.lit(SUBPROPERTY).alias("p"), F.col("b").alias("o"))
    return en.why_subclass(g, "Brand#3", "Top", SUBPROPERTY)


@query("SELECT p_partkey, regexp_replace(p_name, '(^| )([a-z])', '\\1<\\2>', 'g') AS text FROM part WHERE regexp_matches(p_name, '^[a-z]+( [a-z]+)*$')")
def f03_replaced_by_function(s, d):
    name = F.col("p_name")
    changed = st.replaced_by(name, r"\b[a-z]", lambda x: F.concat(F.lit("<"), x, F.lit(">")))
    return table(s, d, "part").filter(name.rlike("^[a-z]+( [a-z]+)*$")).select("p_partkey", changed.alias("text"))


@query("SELECT o_orderkey, place FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders) WHERE place <= 25")
def s03_order_in_time(s, d):
    facts = mo.facts_of(table(s, d, "orders"), "at", F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), F.col("o_orderkey"))
    first = mo.in_time(facts, 1).limit(25).select(F.col("args")[1].cast("long").alias("o_orderkey"))
    return first.select("o_orderkey", F.row_number().over(Window.orderBy("o_orderkey")).cast("long").alias("place"))


@query("SELECT n_nationkey::INT AS \"NationKey\", n_name AS \"Name\" FROM nation WHERE n_nationkey > 5")
def src11_database(s, d):
    """A table written to a database in memory and read back by a query in parallel parts, over a named connection."""
    url = f"jdbc:derby:memory:q{uuid.uuid4().hex};create=true"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    n = table(s, d, "nation").select(F.col("n_nationkey").cast("int").alias("NationKey"), F.col("n_name").alias("Name"))
    n.coalesce(1).write.jdbc(url, "nations", properties=options)
    db.connect("nations", url, **options)
    return db.sql_query(s, db.quoted_capitals("SELECT NationKey, Name FROM nations WHERE NationKey > 5"), "nations", partition=("NationKey", 0, 25, 3))


@query("SELECT 'c' AS table_name, 'key' AS column_name")
def src15_comment_search(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("key", metadata={"comment": "the number of a customer"}), F.col("c_name").alias("name"))
    return db.catalog_search(db.columns_catalog({"c": c, "n": table(s, d, "nation")}), "NUMBER of", "comment").select("table_name", "column_name")


@query(f"{CLASS_CLOSURE}, r AS (SELECT DISTINCT p_type AS x, p_brand AS c FROM part) SELECT 'madeBy' AS p, (SELECT count(*) FROM r) AS n, (SELECT count(*) FROM (SELECT c FROM r UNION SELECT b FROM r JOIN t ON r.c = t.a)) AS targets")
def o27_relation_targets(s, d):
    links = table(s, d, "part").select(F.col("p_type").alias("x"), F.lit("madeBy").alias("p"), F.col("p_brand").alias("c")).distinct()
    found = hi.some_restrictions(hi.restriction_triples(links))
    up_ = hi.restrictions_up(found, s.createDataFrame([], "a string, b string"), hi.subsumptions(class_edges(s, d)))
    return found.groupBy("p").agg(F.count("*").alias("n")).join(up_.groupBy("p").agg(F.count_distinct("c").alias("targets")), "p")


@query("SELECT p_type AS kind, p_partkey AS x FROM (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS n FROM part) WHERE n <= 3")
def s05_examples_by_group(s, d):
    from quadrille.functions.strings import natural_key

    rows = table(s, d, "part").select(F.col("p_type").alias("kind"), F.col("p_partkey").alias("x"))
    return mo.first_of_each(rows, "kind", natural_key(F.col("x").cast("string")), 3)


@query("SELECT DISTINCT o_custkey::VARCHAR AS c FROM orders WHERE o_orderstatus = 'F'")
def e05_own_axiom_rule(s, d):
    co.AXIOM_RULES["FinishedBy"] = lambda p, q, c: [Rule((c, "?x"), ((p, "?o", "?x"), (q, "?o")))]
    rules = co.axiom_rules([("FinishedBy", "by", "done", "finisher")])
    return saturate(order_facts(s, d), rules).filter("pred = 'finisher'").select(F.col("args")[0].alias("c"))
