"""Registered queries on terms, named graphs, patterns without shared variables, updates and functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille.functions import strings as st
from quadrille.functions import terms as te
from quadrille.functions.builtins import builtin
from quadrille.functions.terms import DOMAIN, LABEL, RDF, SUBCLASS, SUBPROPERTY, XSD, Iri, Literal, call, number
from quadrille.operators import hierarchy as hi
from quadrille.operators import patterns as pa
from quadrille.operators import update as up
from quadrille.queries import EX, nation_graph, node, order_graph, part_of, places, query, table
from quadrille.sources import graphs as gr


def literals(df, subject, predicate, text, lang=None, dt=None):
    """Triples of literals, one for each row."""
    none = F.lit(None).cast("string")
    return df.select(
        subject.alias("s"), F.lit(predicate).alias("p"), text.cast("string").alias("o"), F.lit(2).cast("tinyint").alias("o_kind"),
        (F.lit(dt) if isinstance(dt, str) else none if dt is None else dt).alias("o_dt"), (F.lit(lang) if isinstance(lang, str) else none if lang is None else lang).alias("o_lang"),
    ).filter("o IS NOT NULL")


def resources(df, subject, predicate, target):
    none = F.lit(None).cast("string")
    return df.select(subject.alias("s"), F.lit(predicate).alias("p"), target.alias("o"), F.lit(0).cast("tinyint").alias("o_kind"), none.alias("o_dt"), none.alias("o_lang"))


def named_nations(s, d):
    """Each nation's name as an English label, and as an alias that is English for even numbers and French for odd ones."""
    n = table(s, d, "nation")
    even = F.when(F.col("n_nationkey") % 2 == 0, "en").otherwise("fr")
    return literals(n, node("nation", "n_nationkey"), LABEL, F.col("n_name"), "en").unionByName(literals(n, node("nation", "n_nationkey"), f"{EX}alias", F.col("n_name"), even))


@query(f"SELECT '{EX}nation/' || n_nationkey AS a, '{EX}nation/' || n_nationkey AS b FROM nation WHERE n_nationkey % 2 = 0")
def q17_join_by_language(s, d):
    return pa.bgp(named_nations(s, d), ("?a", "rdfs:label", "?x"), ("?b", "ex:alias", "?x")).select("a", "b")


@query(f"SELECT '{EX}nation/' || n_nationkey AS a FROM nation WHERE n_nationkey % 2 = 1")
def q17_language_constant(s, d):
    g = named_nations(s, d)
    hit = [pa.bgp(g, ("?a", "ex:alias", Literal(f"NATION_{k}", lang="FR"))) for k in (0, 1)]
    one = hit[0].unionByName(hit[1])
    return one.unionByName(pa.bgp(g, ("?a", "ex:alias", "?x"), terms=True).filter(call("lang", F.col("__t_x")) == "fr").select("a")).distinct()


def sizes(s, d):
    """Sizes of parts: as integers for even part numbers, else as plain texts."""
    p = table(s, d, "part")
    even = F.col("p_partkey") % 2 == 0
    return literals(p, node("part", "p_partkey"), f"{EX}size", F.col("p_size"), dt=F.when(even, f"{XSD}integer"))


@query(f"SELECT '{EX}part/' || p_partkey AS x, CASE WHEN p_partkey % 2 = 0 THEN 'number' ELSE 'text' END AS kind FROM part WHERE p_size = 5")
def q17_datatype_constants(s, d):
    g = sizes(s, d)
    a, b = pa.bgp(g, ("?x", "ex:size", Literal("5", "xsd:integer"))), pa.bgp(g, ("?x", "ex:size", Literal("5")))
    return a.withColumn("kind", F.lit("number")).unionByName(b.withColumn("kind", F.lit("text")))


@query("SELECT p_size AS size, count(*) FILTER (p_partkey % 2 = 0) * count(*) FILTER (p_partkey % 2 = 0) + count(*) FILTER (p_partkey % 2 = 1) * count(*) FILTER (p_partkey % 2 = 1) AS n FROM part GROUP BY p_size")
def q17_join_by_datatype(s, d):
    g = sizes(s, d)
    return pa.bgp_counts(g, ("?a", "ex:size", "?x"), ("?b", "ex:size", "?x"), by=["x"]).groupBy(F.col("x").cast("int").alias("size")).agg(F.sum("n").alias("n"))


@query(f"SELECT '{EX}customer/' || c_custkey AS x, '{EX}nation/' || c_nationkey AS n FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT '{EX}customer/' || c_custkey, NULL FROM customer WHERE c_nationkey = 3 AND c_custkey % 2 = 0")
def q17_iri_and_literal(s, d):
    c = table(s, d, "customer")
    even = c.filter("c_custkey % 2 = 0")
    g = resources(even, node("customer", "c_custkey"), f"{EX}at", node("nation", "c_nationkey")).unionByName(literals(c.filter("c_custkey % 2 = 1"), node("customer", "c_custkey"), f"{EX}at", node("nation", "c_nationkey")))
    one = pa.bgp(g, ("?x", "ex:at", Iri("ex:nation/3"))).withColumn("n", F.lit(None).cast("string"))
    return pa.bgp(g.unionByName(nation_graph(s, d)), ("?x", "ex:at", "?n"), ("?n", "a", "ex:Nation")).unionByName(one)


@query(f"SELECT n_name AS text, 2::INT AS kind, CASE WHEN lang = '' THEN '{XSD}string' ELSE '{RDF}langString' END AS datatype, lang FROM (SELECT n_name, unnest(['en', CASE WHEN n_nationkey % 2 = 0 THEN 'en' ELSE 'fr' END]) AS lang FROM nation)")
def q14_explicit_literals(s, d):
    rows = pa.bgp(named_nations(s, d), ("?a", "?p", "?x"), terms=True)
    return pa.terms_of(rows, "x").select("x.text", "x.kind", "x.datatype", "x.lang")


@query("SELECT o_orderkey::VARCHAR AS x FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 3")
def q09_numeric_order(s, d):
    o = table(s, d, "orders")
    g = literals(o, node("order", "o_orderkey"), f"{EX}number", F.col("o_orderkey"), dt=f"{XSD}integer")
    return pa.ordered(pa.bgp(g, ("?o", "ex:number", "?x"), terms=True), "x").offset(3).limit(7).select("x")


@query(f"SELECT '{EX}nation/' || k AS x FROM (SELECT n_nationkey::VARCHAR AS k FROM nation ORDER BY k LIMIT 6)")
def q09_resources_before_literals(s, d):
    n = table(s, d, "nation")
    g = resources(n, node("nation", "n_nationkey"), f"{EX}is", node("nation", "n_nationkey")).unionByName(literals(n, node("nation", "n_nationkey"), f"{EX}is", F.col("n_name")))
    return pa.ordered(pa.bgp(g, ("?a", "ex:is", "?x"), terms=True), "x").limit(6).select("x")


@query(f"SELECT '{EX}nation/' || n_nationkey AS a, CASE WHEN n_nationkey % 2 = 0 THEN 'en' ELSE 'fr' END AS lang, n_nationkey % 2 = 0 AS english FROM nation")
def q24_language_functions(s, d):
    rows = pa.bgp(named_nations(s, d), ("?a", "ex:alias", "?x"), terms=True)
    lang = call("lang", F.col("__t_x"))
    return rows.select("a", lang.alias("lang"), call("langMatches", lang, "EN").alias("english"))


@query(f"SELECT '{EX}customer/' || c_custkey AS x FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 AND c_mktsegment <> 'BUILDING' UNION SELECT '{EX}nation/' || n_nationkey FROM nation WHERE n_regionkey = 2")
def q26_class_expression(s, d):
    near = ("value", "ex:inRegion", "ex:region/1")
    return pa.expression_instances(places(s, d), ("or", ("and", "ex:Customer", ("some", "ex:inNation", near), ("not", ("value", "ex:segment", "BUILDING"))), ("value", "ex:inRegion", "ex:region/2")))


@query(f"SELECT '{EX}nation/' || c_nationkey AS x FROM customer GROUP BY c_nationkey HAVING count(*) >= 3")
def q26_minimum_cardinality(s, d):
    g = places(s, d)
    turned = g.filter(F.col("p") == f"{EX}inNation").filter(F.col("s").startswith(f"{EX}customer")).select(F.col("o").alias("s"), F.lit(f"{EX}has").alias("p"), F.col("s").alias("o"), "o_kind", "o_dt", "o_lang")
    return pa.expression_instances(turned, ("min", 3, "ex:has", "owl:Thing"))


@query("SELECT count(DISTINCT c_nationkey) AS n FROM customer WHERE c_mktsegment = 'BUILDING'")
def q01_select_count_distinct(s, d):
    return pa.select(places(s, d), [("?c", "ex:segment", "BUILDING"), ("?c", "ex:inNation", "?n")], ["n"], distinct=True, count=True)


@query(f"SELECT '{EX}region/' || r_regionkey AS value FROM region UNION ALL SELECT r_name FROM region")
def q01_select_flatten_backend(s, d):
    only = lambda g: g.filter(F.col("s").startswith(f"{EX}region"))
    return pa.select(places(s, d), [("?r", "ex:name", "?x")], backend=only, flatten=True)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > (SELECT max(o_orderkey) FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 40)) ORDER BY o_orderkey LIMIT 40")
def src10_second_page(s, d):
    rows = table(s, d, "orders").select("o_orderkey", "o_custkey")
    last = pa.paged(rows, ["o_orderkey"], 40).agg(F.max("o_orderkey")).first()[0]
    return pa.paged(rows, ["o_orderkey"], 40, after=[last])


def split_graphs(s, d):
    """Links of customers to nations in one graph, of nations to regions in another."""
    links = part_of(s, d).filter(F.col("p") == f"{EX}partOf")
    return links.withColumn("g", F.when(F.col("s").startswith(f"{EX}customer"), f"{EX}g1").otherwise(f"{EX}g2"))


@query(f"SELECT '{EX}customer/' || c_custkey AS x, '{EX}nation/' || c_nationkey AS y FROM customer")
def q23_path_in_graph(s, d):
    return pa.bgp(split_graphs(s, d), ("?x", pa.iri("ex:partOf").plus(), "?y"), graph="ex:g1")


@query(f"""SELECT '{EX}g1' AS g, '{EX}customer/' || c_custkey AS x, '{EX}nation/' || c_nationkey AS y FROM customer UNION SELECT '{EX}g2', '{EX}nation/' || n_nationkey, '{EX}region/' || n_regionkey FROM nation
UNION SELECT '{EX}g2', '{EX}' || a, '{EX}' || b FROM (VALUES ('x'), ('y'), ('z')) v(a), (VALUES ('x'), ('y'), ('z')) w(b)""")
def q23_path_by_graph(s, d):
    return pa.bgp(split_graphs(s, d), ("?x", pa.iri("ex:partOf").plus(), "?y"), graph="?g").select("g", "x", "y")


@query("SELECT r_name AS a FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey > 20)")
def j05_exists_unshared(s, d):
    left = table(s, d, "region").select(F.col("r_name").alias("a"))
    empty = pa.exists(left, table(s, d, "nation").filter("n_nationkey > 1000").select(F.col("n_name").alias("b")))
    return pa.exists(left, table(s, d, "nation").filter("n_nationkey > 20").select(F.col("n_name").alias("b"))).unionByName(empty)


@query("SELECT r_name AS a FROM region WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey > 1000)")
def j05_not_exists_unshared(s, d):
    left = table(s, d, "region").select(F.col("r_name").alias("a"))
    some = pa.not_exists(left, table(s, d, "nation").select(F.col("n_name").alias("b")))
    return pa.not_exists(left, table(s, d, "nation").filter("n_nationkey > 1000").select(F.col("n_name").alias("b"))).unionByName(some)


@query("SELECT r_name AS a, n_name AS b FROM region LEFT JOIN (SELECT n_name FROM nation WHERE n_nationkey < 2) ON true UNION ALL SELECT r_name, NULL FROM region")
def j02_optional_unshared(s, d):
    left, n = table(s, d, "region").select(F.col("r_name").alias("a")), table(s, d, "nation")
    right = lambda f: n.filter(f).select(F.col("n_name").alias("b"))
    return pa.optional(left, right("n_nationkey < 2"), allow_product=True).unionByName(pa.optional(left, right("n_nationkey > 1000"), allow_product=True))


@query("SELECT r_name AS r, n_name AS n FROM region, nation")
def j01_disconnected_patterns(s, d):
    g = places(s, d)
    return pa.bgp(g, ("?a", "a", "ex:Region"), ("?a", "ex:name", "?r"), ("?b", "a", "ex:Nation"), ("?b", "ex:name", "?n"), allow_product=True).select("r", "n")


@query(f"SELECT '{EX}nation/' || c_nationkey AS y FROM customer WHERE c_custkey = 7 UNION SELECT '{EX}region/' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 7")
def j11_path_from_constant(s, d):
    return pa.bgp(part_of(s, d), ("ex:customer/7", pa.iri("ex:partOf").plus(), "?y"))


@query(f"SELECT '{EX}nation/' || n_nationkey AS x FROM nation WHERE n_regionkey = 2 UNION SELECT '{EX}customer/' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 UNION SELECT '{EX}region/2'")
def j11_path_to_constant(s, d):
    return pa.bgp(part_of(s, d), ("?x", pa.iri("ex:partOf").star(), "ex:region/2"))


# ---- updates ----


def variants(s, d):
    n = table(s, d, "nation")
    rows = [literals(n, node("nation", "n_nationkey"), LABEL, F.col("n_name"), x) for x in ("en", "fr")]
    return rows[0].withColumn("g", F.lit(None).cast("string")), rows[1]


@query(f"SELECT '{EX}nation/' || n_nationkey AS s, n_name AS o, unnest(['en', 'fr']) AS o_lang FROM nation")
def up1_language_variants(s, d):
    store, more = variants(s, d)
    return up.insert(up.insert(store, more), more).select("s", "o", "o_lang")


@query(f"SELECT '{EX}nation/' || n_nationkey AS s, n_name AS o, 'en' AS o_lang FROM nation")
def up2_delete_one_variant(s, d):
    store, more = variants(s, d)
    return up.delete(up.insert(store, more), more).select("s", "o", "o_lang")


@query(f"SELECT '{EX}nation/' || n_nationkey AS s, '{EX}known' AS p, n_name AS o FROM nation WHERE n_nationkey < 12")
def up5_using(s, d):
    n = nation_graph(s, d).filter(F.col("p") == f"{EX}name")
    low = F.regexp_extract("s", r"(\d+)$", 1).cast("int")
    store = n.withColumn("g", F.when(low < 12, f"{EX}a").otherwise(f"{EX}b"))
    where = pa.bgp(up.in_using(store, ["ex:a"]), ("?n", "ex:name", "?x"))
    return up.modify(store, where, insert_template=[("?n", "ex:known", "?x")], graph="ex:c").filter(F.col("g") == f"{EX}c").select("s", "p", "o")


@query("SELECT 'all' AS which, 0::BIGINT AS n UNION ALL SELECT 'default', count(*) FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'named', count(*) FROM supplier WHERE s_suppkey % 2 = 1 UNION ALL SELECT 'graph', count(*) FROM supplier WHERE s_suppkey % 2 = 1")
def up9_clear_kinds(s, d):
    names = literals(table(s, d, "supplier"), node("supplier", "s_suppkey"), LABEL, F.col("s_name"))
    store = names.withColumn("g", F.when(F.regexp_extract("s", r"(\d+)$", 1).cast("int") % 2 == 0, f"{EX}even"))
    out = [up.clear(store, "ex:even" if which == "graph" else None, which).agg(F.count("*").alias("n")).select(F.lit(which).alias("which"), "n") for which in ("all", "default", "named", "graph")]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


# ---- functions ----


@query("SELECT p_partkey, string_split(rtrim(p_name || ',,', ','), ' ') [1] AS first, regexp_matches(p_brand || '.x', 'Brand#\\d+\\.x') AS plain FROM part")
def f01_split_and_quote(s, d):
    name = F.concat("p_name", F.lit(",,"))
    return table(s, d, "part").select("p_partkey", F.split(F.concat_ws(",", st.split_at(name, ",")), " ")[0].alias("first"), F.concat("p_brand", F.lit(".x")).rlike(r"Brand#\d+" + st.quoted(".x")).alias("plain"))


@query("SELECT n_nationkey, array_to_string([n_name, n_comment], '|') AS joined FROM (SELECT n_nationkey, n_name, 'c' || n_regionkey AS n_comment FROM nation)")
def f05_joined(s, d):
    return table(s, d, "nation").select("n_nationkey", F.array_join(F.array("n_name", F.concat(F.lit("c"), F.col("n_regionkey").cast("string"))), "|").alias("joined"))


@query("SELECT DISTINCT p_name AS name, lower(split_part(p_name, ' ', 1)) || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || lower(substr(split_part(p_name, ' ', 2), 2)) AS camel, lower(p_name) AS back FROM part WHERE regexp_matches(p_name, '^[a-z]+ [a-z]+$')")
def f06_camel_case(s, d):
    name = F.col("p_name")
    return table(s, d, "part").filter(name.rlike("^[a-z]+ [a-z]+$")).select(name.alias("name"), st.camel_case(name).alias("camel"), st.spaced(st.camel_case(name)).alias("back")).distinct()


@query("SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS text, CASE WHEN length(url) > 12 THEN substr(url, 1, 12) || '...' ELSE url END AS short FROM pages")
def f07_quoted_markup(s, d):
    return table(s, d, "pages").select("page_id", st.xml_quoted(F.col("html")).alias("text"), st.truncated(F.col("url"), 12).alias("short"))


@query("SELECT c_custkey, url_encode(c_name || ' é') AS enc, c_name || ' é' AS dec FROM customer")
def f08_url_coding(s, d):
    text = F.concat("c_name", F.lit(" é"))
    return table(s, d, "customer").select("c_custkey", call("encode_for_uri", text).alias("enc"), F.url_decode(call("encode_for_uri", text)).alias("dec"))


@query("SELECT n_nationkey, 'ex:nation/' || n_nationkey AS short, n_nationkey::VARCHAR AS tail, 'http://base.org/' || n_name AS full FROM nation")
def f09_prefixes_and_tails(s, d):
    name = node("nation", "n_nationkey")
    return table(s, d, "nation").select("n_nationkey", te.abbreviated(name).alias("short"), te.tail(name).alias("tail"), te.resolved(F.col("n_name"), "http://base.org/").alias("full"))


@query("""SELECT o_orderkey, CASE WHEN t = 0 THEN '0 seconds' ELSE array_to_string(list_filter([CASE WHEN t // 86400 > 0 THEN (t // 86400) || CASE WHEN t // 86400 = 1 THEN ' day' ELSE ' days' END END,
CASE WHEN t % 86400 // 3600 > 0 THEN (t % 86400 // 3600) || CASE WHEN t % 86400 // 3600 = 1 THEN ' hour' ELSE ' hours' END END, CASE WHEN t % 3600 // 60 > 0 THEN (t % 3600 // 60) || CASE WHEN t % 3600 // 60 = 1 THEN ' minute' ELSE ' minutes' END END,
CASE WHEN t % 60 > 0 THEN (t % 60) || CASE WHEN t % 60 = 1 THEN ' second' ELSE ' seconds' END END], lambda x: x IS NOT NULL), ', ') END AS span FROM (SELECT o_orderkey, o_orderkey * 37 % 200000 AS t FROM orders)""")
def f12_interval_text(s, d):
    return table(s, d, "orders").select("o_orderkey", st.interval_text(F.col("o_orderkey") * 37 % 200000).alias("span"))


@query("SELECT l_orderkey, l_linenumber, format('{:,.2f}', l_extendedprice) AS price FROM lineitem")
def f12_number_text(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.format_number("l_extendedprice", 2).alias("price"))


@query("SELECT n_nationkey, regexp_replace(trim(n_name), '\\s+', ' ', 'g') AS plain, list_transform(string_split_regex(n_name || '; ' || n_regionkey || ', x', '[;,]'), lambda x: trim(x)) ::VARCHAR AS parts FROM nation")
def f14_synonyms(s, d):
    text = F.concat("n_name", F.lit("; "), F.col("n_regionkey").cast("string"), F.lit(", x"))
    return table(s, d, "nation").select("n_nationkey", st.normal_space(F.concat(F.lit(" "), "n_name", F.lit("  "))).alias("plain"), F.concat(F.lit("["), F.concat_ws(", ", st.synonyms(text)), F.lit("]")).alias("parts"))


@query("SELECT l_orderkey, l_linenumber, floor(-l_extendedprice + 0.5)::BIGINT AS r, l_orderkey % 5 - 3 AS h FROM lineitem WHERE true")
def x13_rounding(s, d):
    half = builtin("round", F.col("l_orderkey") % 5 - F.lit(3.5))
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", builtin("round", -F.col("l_extendedprice")).cast("long").alias("r"), half.cast("long").alias("h"))


@query("SELECT o_orderkey, (datediff('month', DATE '1998-12-01', date_trunc('month', o_orderdate::DATE)::DATE))::INT AS months FROM orders")
def x13_month_difference(s, d):
    first = F.trunc(F.col("o_orderdate").cast("date"), "month")
    return table(s, d, "orders").select("o_orderkey", builtin("subtractDateTimesYieldingYearMonthDuration", first, F.lit("1998-12-01").cast("date")).alias("months"))


@query("SELECT DISTINCT 'ex:' || kind AS t, regexp_matches(kind, '^[A-Z]') AS upper FROM (VALUES ('Customer'), ('Nation'), ('Region'), ('Supplier')) v(kind)")
def q11_prefix_names(s, d):
    kinds = pa.bgp(places(s, d), ("?x", "a", "?t")).select("t").distinct()
    short = te.abbreviated(F.col("t"))
    return kinds.select(short.alias("t"), call("regex", te.tail(F.col("t")), "^[A-Z]").alias("upper"))


@query(f"SELECT '{EX}nation/' || n_nationkey AS term, '{EX}asked' AS p, CASE WHEN n_nationkey < 10 THEN 'first' ELSE 'other' END AS o FROM nation UNION ALL SELECT '{EX}region/' || r_regionkey, '{EX}asked', 'region' FROM region")
def q30_external_terms(s, d):
    one = F.col("n_nationkey") < 10
    terms = table(s, d, "nation").select(node("nation", "n_nationkey").alias("term"), F.when(one, "urn:low").otherwise("urn:high").alias("ontology")).unionByName(table(s, d, "region").select(node("region", "r_regionkey").alias("term"), F.lit("urn:region").alias("ontology")))
    templates = s.createDataFrame([("^urn:l", "first"), ("high$", "other"), ("region", "region"), ("none", "x")], "pattern string, template string")
    return pa.external_terms(terms, templates, lambda rows: rows.select("term", F.lit(f"{EX}asked").alias("p"), F.col("template").alias("o")))


@query("SELECT c_custkey, upper(c_name) AS name, c_acctbal * 2 AS twice FROM customer")
def e01_function_by_name(s, d):
    te.REGISTRY[f"{EX}double"] = lambda x: x * 2
    return table(s, d, "customer").select("c_custkey", call("ucase", F.col("c_name")).alias("name"), call(f"{EX}double", F.col("c_acctbal")).alias("twice"))


@query(f"SELECT 'ex:orderedBy' AS node UNION ALL SELECT 'ex:soldTo'")
def o04_properties_below(s, d):
    g = gr.abox(s, [(f"{EX}orderedBy", SUBPROPERTY, f"{EX}involves"), (f"{EX}soldTo", SUBPROPERTY, f"{EX}orderedBy"), (f"{EX}involves", SUBPROPERTY, f"{EX}related")]).unionByName(order_graph(s, d))
    return hi.below(hi.edges_of(g, SUBPROPERTY), f"{EX}involves").select(te.abbreviated(F.col("node")).alias("node"))


@query("SELECT o_orderstatus AS status, round(sum(o_totalprice), 2) AS total, round(exp(avg(ln(o_totalprice))), 4) AS middle FROM orders GROUP BY o_orderstatus")
def e06_own_aggregate(s, d):
    price = number(F.col("o_totalprice").cast("string"))
    return table(s, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.round(F.sum(price), 2).alias("total"), F.round(st.geometric_mean(price), 4).alias("middle"))


@query(f"SELECT DISTINCT '{EX}did/' || event_type AS p, c FROM events, (VALUES ('{EX}User'), ('{EX}Agent')) v(c) UNION SELECT '{EX}did', c FROM (VALUES ('{EX}User'), ('{EX}Agent')) v(c)")
def o13_declared_domains(s, d):
    """Domains that the properties of all kinds of events have from the one above them, and the classes above these."""
    kinds = table(s, d, "events").select(F.concat(F.lit(f"{EX}did/"), "event_type").alias("s")).distinct().select("s", F.lit(SUBPROPERTY).alias("p"), F.lit(f"{EX}did").alias("o"))
    g = gr.abox(s, [(f"{EX}did", DOMAIN, f"{EX}User"), (f"{EX}User", SUBCLASS, f"{EX}Agent")])
    return hi.domains_and_ranges(kinds.unionByName(g.select("s", "p", "o")), DOMAIN)
