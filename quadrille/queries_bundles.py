"""Registered queries on the bundles of rules, the profiles of axioms and paged sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quadrille.functions.terms import OWL, RDF, SUBCLASS, TYPE
from quadrille.operators import entailment as en
from quadrille.operators import profiles as pr
from quadrille.plans.stages import scratch_dir
from quadrille.queries import EX, node, query, table
from quadrille.queries_reasoning import fixed, forms
from quadrille.sources import pages as pg


def _schema(s, *rows):
    return s.createDataFrame(list(rows), "s string, p string, o string")


def _list(owner, predicate, *members):
    """The triples of a list that a predicate leads to."""
    cells = [f"urn:blank:{owner}/{i}" for i in range(len(members))] + [f"{RDF}nil"]
    return [(owner, f"{OWL}{predicate}", cells[0]), *[t for i, m in enumerate(members) for t in ((cells[i], f"{RDF}first", m), (cells[i], f"{RDF}rest", cells[i + 1]))]]


def _restriction(v, kind, value, p):
    return [(v, f"{OWL}onProperty", p), (v, f"{OWL}{kind}", value)]


def _part_types(s, d):
    p = table(s, d, "part")
    types = F.explode(F.array(F.concat(F.lit(EX), "p_type"), F.concat(F.lit(EX), "p_brand"))).alias("o")
    return p.select(node("part", "p_partkey").alias("s"), F.lit(TYPE).alias("p"), types).filter("o IS NOT NULL")


def _based(s, d):
    u, n = table(s, d, "supplier"), table(s, d, "nation")
    link = lambda df, a, ak, p, b, bk: df.select(node(a, ak).alias("s"), F.lit(f"{EX}{p}").alias("p"), node(b, bk).alias("o"))
    return link(u, "supplier", "s_suppkey", "basedIn", "nation", "s_nationkey").unionByName(link(n, "nation", "n_nationkey", "inRegion", "region", "n_regionkey"))


@query(f"SELECT '{EX}part/' || p_partkey AS s, o FROM part, (VALUES ('{EX}Offer'), ('{EX}Listed')) v(o) WHERE p_type = 'PROMO' AND p_brand = 'Brand#3'")
def o30_rl_intersections(s, d):
    """Parts that are in both members of an intersection are in it, and in the union of which it is a member."""
    g = _part_types(s, d).unionByName(_schema(s, *_list(f"{EX}Offer", "intersectionOf", f"{EX}PROMO", f"{EX}Brand#3"), *_list(f"{EX}Listed", "unionOf", f"{EX}Offer", f"{EX}Other")))
    return en.Closed(g, "owl2-rl").graph.filter((F.col("p") == TYPE) & F.col("o").isin(f"{EX}Offer", f"{EX}Listed")).select("s", "o")


@query(f"SELECT '{EX}supplier/' || s_suppkey AS s, '{EX}region/' || n_regionkey AS o FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def o30_rl_chains(s, d):
    """Who is based in a nation that is in a region is within the region: a chain of two properties."""
    g = _based(s, d).unionByName(_schema(s, *_list(f"{EX}within", "propertyChainAxiom", f"{EX}basedIn", f"{EX}inRegion")))
    return en.Closed(g, "owl2-rl").graph.filter(F.col("p") == f"{EX}within").select("s", "o")


@query(f"""WITH g AS (SELECT c_nationkey, c_mktsegment, min('{EX}customer/' || c_custkey) AS root FROM customer GROUP BY 1, 2)
SELECT '{EX}customer/' || c_custkey AS node, root FROM customer JOIN g USING (c_nationkey, c_mktsegment) WHERE (SELECT count(*) FROM customer x WHERE x.c_nationkey = customer.c_nationkey AND x.c_mktsegment = customer.c_mktsegment) > 1""")
def o30_rl_keys(s, d):
    """With nation and segment as the key of customers, all customers of one nation and segment are one: a row for each, no pairs."""
    c = table(s, d, "customer")
    row = lambda p, o: c.select(node("customer", "c_custkey").alias("s"), F.lit(p).alias("p"), o.alias("o")).filter("o IS NOT NULL")
    g = row(TYPE, F.lit(f"{EX}Customer")).unionByName(row(f"{EX}of", node("nation", "c_nationkey"))).unionByName(row(f"{EX}segment", F.concat(F.lit(f"{EX}segment/"), "c_mktsegment")))
    return en.Closed(g.unionByName(_schema(s, *_list(f"{EX}Customer", "hasKey", f"{EX}of", f"{EX}segment"))), "owl2-rl").equals


@query(f"SELECT x AS node, '{EX}area/' || r_regionkey AS root FROM region, (VALUES ('area'), ('region')) k(k), (SELECT 1) o, LATERAL (SELECT '{EX}' || k || '/' || r_regionkey AS x) WHERE r_regionkey IN (SELECT n_regionkey FROM nation)")
def o30_rl_maximum(s, d):
    """Nations are in at most one place, so the two names of a nation's region are of one individual."""
    n = table(s, d, "nation")
    at = lambda k: n.select(node("nation", "n_nationkey").alias("s"), F.lit(f"{EX}in").alias("p"), node(k, "n_regionkey").alias("o"))
    kind = n.select(node("nation", "n_nationkey").alias("s"), F.lit(TYPE).alias("p"), F.lit(f"{EX}Nation").alias("o"))
    g = at("area").unionByName(at("region")).unionByName(kind)
    return en.Closed(g.unionByName(_schema(s, *_restriction("urn:blank:most", "maxCardinality", "1", f"{EX}in"), (f"{EX}Nation", SUBCLASS, "urn:blank:most"))), "owl2-rl").equals


@query(f"""SELECT 'disjoint classes' AS rule, '{EX}part/' || p_partkey AS s, '{TYPE}' AS p, '{EX}Brand#3' AS o FROM part WHERE p_type = 'PROMO' AND p_brand = 'Brand#3'
UNION ALL SELECT 'irreflexive', '{EX}nation/' || n_nationkey, '{EX}near', '{EX}nation/' || n_nationkey FROM nation UNION ALL SELECT 'denied', '{EX}nation/' || n_nationkey, '{EX}inRegion', '{EX}region/' || n_regionkey FROM nation
UNION ALL SELECT 'different equals', '{EX}area/' || n_regionkey, '{OWL}differentFrom', '{EX}area/' || n_regionkey FROM (SELECT DISTINCT n_regionkey FROM nation)""")
def o30_rl_contradictions(s, d):
    """Parts in two of three classes that exclude each other, links of a nation to itself along a symmetric and transitive property that may have none,
    what is stated and denied, and different names that turn out to be of one individual."""
    n = table(s, d, "nation")
    nation, region, area = node("nation", "n_nationkey"), node("region", "n_regionkey"), node("area", "n_regionkey")
    row = lambda a, p, b: n.select(a.alias("s"), F.lit(p).alias("p"), b.alias("o"))
    denial = F.concat(F.lit("urn:blank:no/"), F.col("n_nationkey").cast("string"))
    facts = [
        row(nation, f"{EX}near", region), row(nation, f"{EX}inRegion", region), row(denial, f"{OWL}sourceIndividual", nation), row(denial, f"{OWL}assertionProperty", F.lit(f"{EX}inRegion")), row(denial, f"{OWL}targetIndividual", region),
        row(area, f"{OWL}sameAs", F.concat(F.lit(f"{EX}zone/"), F.col("n_regionkey").cast("string"))), row(F.concat(F.lit(f"{EX}zone/"), F.col("n_regionkey").cast("string")), f"{OWL}differentFrom", area),
    ]
    g = _part_types(s, d)
    for rows in facts:
        g = g.unionByName(rows)
    schema = _schema(
        s, *_list(f"{EX}apart", "members", f"{EX}PROMO", f"{EX}Brand#3", f"{EX}Nothing"), (f"{EX}apart", TYPE, f"{OWL}AllDisjointClasses"),
        (f"{EX}near", TYPE, f"{OWL}IrreflexiveProperty"), (f"{EX}near", TYPE, f"{OWL}SymmetricProperty"), (f"{EX}near", TYPE, f"{OWL}TransitiveProperty"),
    )
    return en.Closed(g.unionByName(schema), "owl2-rl").contradictions().filter(~F.col("s").startswith(f"{EX}region/"))


@query(f"SELECT '{EX}supplier/' || s_suppkey AS s, '{EX}Based' AS o FROM supplier WHERE s_nationkey IS NOT NULL UNION ALL SELECT DISTINCT '{EX}nation/' || s_nationkey, '{EX}Host' FROM supplier WHERE s_nationkey IS NOT NULL")
def o30_ql_some_values(s, d):
    """Who has a value of a property, or of its inverse, is in the class of those that have some."""
    schema = _schema(
        s, (f"{EX}hosts", f"{OWL}inverseOf", f"{EX}basedIn"), *_restriction("urn:blank:b", "someValuesFrom", f"{OWL}Thing", f"{EX}basedIn"), ("urn:blank:b", SUBCLASS, f"{EX}Based"),
        *_restriction("urn:blank:h", "someValuesFrom", f"{OWL}Thing", f"{EX}hosts"), ("urn:blank:h", f"{OWL}equivalentClass", f"{EX}Host"),
    )
    out = en.entailed(_based(s, d).unionByName(schema), "owl2-ql")
    return out.filter((F.col("p") == TYPE) & F.col("o").isin(f"{EX}Based", f"{EX}Host")).select("s", "o")


@query(f"""SELECT '{EX}code/' || n_nationkey AS s, '{OWL}sameAs' AS p, '{EX}number/' || n_nationkey AS o FROM nation UNION ALL SELECT '{EX}number/' || n_nationkey, '{OWL}sameAs', '{EX}code/' || n_nationkey FROM nation
UNION ALL SELECT '{EX}nation/' || n_nationkey, '{TYPE}', '{EX}Coded' FROM nation""")
def o30_max_characteristics(s, d):
    """All things have at most one code, so the property is functional and a nation's two codes are equal; who has one is coded."""
    n = table(s, d, "nation")
    at = lambda k: n.select(node("nation", "n_nationkey").alias("s"), F.lit(f"{EX}hasCode").alias("p"), node(k, "n_nationkey").alias("o"))
    schema = _schema(s, *_restriction("urn:blank:m", "maxCardinality", "1", f"{EX}hasCode"), (f"{OWL}Thing", SUBCLASS, "urn:blank:m"), *_restriction("urn:blank:n", "minCardinality", "1", f"{EX}hasCode"), ("urn:blank:n", SUBCLASS, f"{EX}Coded"))
    out = en.entailed(at("code").unionByName(at("number")).unionByName(schema), "owl-max")
    return out.filter((F.col("p") == f"{OWL}sameAs") | ((F.col("p") == TYPE) & (F.col("o") == f"{EX}Coded"))).select("s", "p", "o")


# ---- profiles ----


def _region_axioms(s, d):
    """For each nation an axiom to a union, one to an inverse, one to a nested restriction, and one that has all of its suppliers in it; for each region an enumeration."""
    n, r = table(s, d, "nation"), table(s, d, "region")
    made = [
        F.format_string("(SubClassOf nation%d (ObjectSomeValuesFrom in (ObjectUnionOf region%d other)))", "n_nationkey", "n_regionkey"), F.format_string("(SubClassOf nation%d (ObjectSomeValuesFrom (ObjectInverseOf has) region%d))", "n_nationkey", "n_regionkey"),
        F.format_string("(SubClassOf (ObjectSomeValuesFrom in region%d) nation%d)", "n_regionkey", "n_nationkey"), F.format_string("(SubClassOf nation%d (ObjectAllValuesFrom has (ObjectIntersectionOf supplier region%d)))", "n_nationkey", "n_regionkey"),
    ]
    out = fixed(s, *[f"(Declaration (ObjectProperty {p}))" for p in ("in", "has")], "(Declaration (Class other))", "(Declaration (Class supplier))")
    for text in made:
        out = out.unionByName(forms(n, text))
    classes = forms(n, F.format_string("(Declaration (Class nation%d))", "n_nationkey")).unionByName(forms(r, F.format_string("(Declaration (Class region%d))", "r_regionkey")))
    return out.unionByName(classes).unionByName(forms(r, F.format_string("(EquivalentClasses region%d (ObjectOneOf a%d b%d))", "r_regionkey", "r_regionkey", "r_regionkey")))


UNION, INVERSE = "'(ObjectUnionOf region' || n_regionkey || ' other)'", "'(ObjectInverseOf has)'"
ALL = "'(ObjectAllValuesFrom has (ObjectIntersectionOf supplier region' || n_regionkey || '))'"
ONE_OF = "'(ObjectOneOf a' || r_regionkey || ' b' || r_regionkey || ')'"


def _kinds(s, d, profile):
    return pr.violations(_region_axioms(s, d), profile).groupBy("violation", "text").agg(F.count("*").alias("n"))


@query(f"""SELECT 'illegal class expression' AS violation, {UNION} AS text, count(*) AS n FROM nation GROUP BY n_regionkey UNION ALL SELECT 'inverse property', {INVERSE}, count(*) FROM nation
UNION ALL SELECT 'illegal class expression', {ALL}, count(*) FROM nation GROUP BY n_regionkey UNION ALL SELECT 'several individuals', {ONE_OF}, 1 FROM region""")
def o22_profile_el(s, d):
    return _kinds(s, d, "el")


@query(f"""SELECT 'not an atomic class' AS violation, {UNION} AS text, count(*) AS n FROM nation GROUP BY n_regionkey UNION ALL SELECT 'not a superclass expression', {ALL}, count(*) FROM nation GROUP BY n_regionkey
UNION ALL SELECT 'not a subclass expression', 'region' || n_regionkey, count(*) FROM nation GROUP BY n_regionkey UNION ALL SELECT 'not a subclass expression', {ONE_OF}, 1 FROM region""")
def o22_profile_ql(s, d):
    return _kinds(s, d, "ql")


@query(f"""SELECT 'not a superclass expression' AS violation, '(ObjectSomeValuesFrom in ' || {UNION} || ')' AS text, count(*) AS n FROM nation GROUP BY n_regionkey
UNION ALL SELECT 'not a superclass expression', '(ObjectSomeValuesFrom ' || {INVERSE} || ' region' || n_regionkey || ')', count(*) FROM nation GROUP BY n_regionkey UNION ALL SELECT 'not an equivalent class expression', {ONE_OF}, 1 FROM region""")
def o22_profile_rl(s, d):
    return _kinds(s, d, "rl")


@query("""WITH s AS (SELECT DISTINCT p_type AS t, p_brand AS b FROM part WHERE p_type IS NOT NULL AND p_brand IS NOT NULL)
SELECT DISTINCT 'not simple in a cardinality' AS violation, 'has' || b AS text FROM s WHERE t = 'PROMO' UNION ALL SELECT 'cycle through a chain', 'of' || n_nationkey FROM nation WHERE n_nationkey % 2 = 0""")
def o22_property_order(s, d):
    """Properties above a transitive one in a cardinality; every second nation's chain is made of a property that is itself made of the chain's."""
    n = table(s, d, "nation")
    kinds = table(s, d, "part").select("p_type", "p_brand").distinct().filter("p_type IS NOT NULL AND p_brand IS NOT NULL")
    up = forms(kinds, F.format_string("(SubObjectPropertyOf of%s has%s)", "p_type", "p_brand"))
    count = forms(kinds, F.format_string("(SubClassOf %s (ObjectMaxCardinality 2 has%s))", "p_brand", "p_brand"))
    chain = forms(n, F.format_string("(SubObjectPropertyOf (ObjectPropertyChain on%d at%d) of%d)", "n_nationkey", "n_nationkey", "n_nationkey"))
    back = forms(n.filter("n_nationkey % 2 = 0"), F.format_string("(SubObjectPropertyOf of%d on%d)", "n_nationkey", "n_nationkey"))
    out = pr.violations(up.unionByName(count).unionByName(chain).unionByName(back).unionByName(fixed(s, "(TransitiveObjectProperty ofPROMO)")))
    return out.filter(~F.col("violation").startswith("undeclared")).select("violation", "text")


# ---- pages ----


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_custkey > 10")
def src10_numbered_pages(s, d):
    """Orders as a service's pages of about 500 rows, read by planned partitions, with filters that reach the reader."""
    o = table(s, d, "orders")
    n = o.count() // 500 + 1
    row = F.struct(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_custkey").cast("long").alias("o_custkey"), "o_orderstatus")
    pages = o.select((F.pmod(F.xxhash64("o_orderkey"), F.lit(n)) + 1).alias("page"), row.alias("r")).groupBy("page").agg(F.collect_list("r").alias("result"))
    pages = s.range(1, n + 1).withColumnRenamed("id", "page").join(pages, "page", "left")  # a page of no rows is a page too
    at = f"{scratch_dir(s)}/pages-{uuid.uuid4().hex}"
    pages.select("page", F.to_json(F.struct(F.lit(n).alias("pageCount"), "result")).alias("value")).write.partitionBy("page").text(at)
    out = pg.numbered_pages(s, f"{at}/page=%d", "page int, o_orderkey long, o_custkey long, o_orderstatus string")
    return out.filter("o_orderstatus = 'F' AND o_custkey > 10").drop("page")
