"""Registered queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import strings as st
from quadrille.functions.builtins import builtin
from quadrille.functions.terms import DOMAIN, OWL, PREFIXES, RANGE, SUBCLASS, SUBPROPERTY, TYPE, call, number
from quadrille.operators import axioms as ax
from quadrille.operators import codes as cd
from quadrille.operators import constraints as co
from quadrille.operators import entailment as en
from quadrille.operators import hierarchy as hi
from quadrille.operators import models as mo
from quadrille.operators import patterns as pa
from quadrille.operators import update as up
from quadrille.operators.modules import locality_module
from quadrille.plans.fixpoint import Rule, saturate, transitive_closure
from quadrille.sources import databases as db
from quadrille.sources import files as fi
from quadrille.sources import graphs as gr
from quadrille.streaming.ingest import windowed_counts

EX = PREFIXES["ex"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers the function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node(kind: str, column: str):
    return F.concat(F.lit(f"{EX}{kind}/"), F.col(column).cast("string"))


def region_graph(s, d):
    return gr.direct_mapping(table(s, d, "region"), node("region", "r_regionkey"), f"{EX}Region", {"r_name": f"{EX}name"})


def nation_graph(s, d):
    return gr.direct_mapping(table(s, d, "nation"), node("nation", "n_nationkey"), f"{EX}Nation", {"n_name": f"{EX}name"}, {f"{EX}inRegion": node("region", "n_regionkey")})


def customer_graph(s, d):
    return gr.direct_mapping(table(s, d, "customer"), node("customer", "c_custkey"), f"{EX}Customer", {"c_name": f"{EX}name", "c_acctbal": f"{EX}balance", "c_mktsegment": f"{EX}segment"}, {f"{EX}inNation": node("nation", "c_nationkey")})


def supplier_graph(s, d):
    return gr.direct_mapping(table(s, d, "supplier"), node("supplier", "s_suppkey"), f"{EX}Supplier", {"s_name": f"{EX}name", "s_acctbal": f"{EX}balance"}, {f"{EX}inNation": node("nation", "s_nationkey")})


def order_graph(s, d):
    return gr.direct_mapping(table(s, d, "orders"), node("order", "o_orderkey"), f"{EX}Order", {"o_totalprice": f"{EX}total", "o_orderstatus": f"{EX}status"}, {f"{EX}orderedBy": node("customer", "o_custkey")})


def places(s, d):
    """Triples of regions, nations, customers and suppliers: rows are unique, so their union is a set."""
    return region_graph(s, d).unionByName(nation_graph(s, d)).unionByName(customer_graph(s, d)).unionByName(supplier_graph(s, d))


# ---- graph patterns ----


@query(f"""SELECT '{EX}customer/' || c_custkey AS c, c_name AS name, c_acctbal AS balance FROM customer
WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000 AND c_nationkey IS NOT NULL""")
def q17_bgp_star(s, d):
    rows = pa.bgp(places(s, d), *pa.about("?c", ("a", "ex:Customer"), ("ex:segment", "BUILDING"), ("ex:name", "?name"), ("ex:balance", "?bal"), ("ex:inNation", "?n")))
    return rows.select("c", "name", number(F.col("bal")).alias("balance")).filter("balance > 5000")


@query("""SELECT r_name AS region, count(*) AS n_customers FROM customer JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 5000 GROUP BY r_name""")
def q17_bgp_chain_group(s, d):
    rows = pa.bgp(places(s, d), ("?c", "a", "ex:Customer"), ("?c", "ex:balance", "?bal"), ("?c", "ex:inNation", "?n"), ("?n", "ex:inRegion", "?r"), ("?r", "ex:name", "?region"))
    return rows.filter(number(F.col("bal")) > 5000).groupBy("region").agg(F.count("*").alias("n_customers"))


@query(f"""SELECT '{EX}customer/' || c_custkey AS c, '{EX}order/' || o_orderkey AS o FROM customer
LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000""")
def j02_optional_orders(s, d):
    customers = pa.bgp(customer_graph(s, d), ("?c", "a", "ex:Customer"))
    orders = pa.bgp(order_graph(s, d), ("?o", "ex:orderedBy", "?c"), ("?o", "ex:total", "?t")).filter(number(F.col("t")) > 400000).drop("t")
    return pa.optional(customers, orders)


@query(f"""SELECT '{EX}customer/' || c_custkey AS c, o.k AS x FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey::VARCHAR AS k FROM orders WHERE o_totalprice > 400000) o ON o_custkey = c_custkey
WHERE o.k IS NULL OR o.k LIKE '%1' """)
def j03_unbound_compatible(s, d):
    left = j02_optional_orders(s, d).select("c", F.regexp_extract("o", r"(\d+)$", 1).alias("x"))
    right = pa.bgp(order_graph(s, d), ("?o", "ex:orderedBy", "?c")).select("c").distinct()
    right = right.unionByName(left.select("c")).distinct().withColumn("x", F.lit(None).cast("string"))
    return pa.natural_join(left, right, unbound=["x"]).filter("x IS NULL OR x LIKE '%1'")


@query(f"""SELECT '{EX}customer/' || c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)""")
def j04_minus_inactive(s, d):
    big = pa.bgp(order_graph(s, d), ("?o", "ex:orderedBy", "?c"), ("?o", "ex:total", "?t")).filter(number(F.col("t")) > 300000).select("c")
    return pa.minus(pa.bgp(customer_graph(s, d), ("?c", "a", "ex:Customer")), big)


@query(f"""SELECT '{EX}supplier/' || s_suppkey AS s FROM supplier WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_mktsegment = 'MACHINERY' AND c_acctbal > 9000)""")
def j05_exists_filter(s, d):
    g = places(s, d)
    rich = pa.bgp(g, ("?c", "ex:inNation", "?n"), ("?c", "ex:segment", "MACHINERY"), ("?c", "ex:balance", "?bal")).filter(number(F.col("bal")) > 9000)
    return pa.exists(pa.bgp(g, ("?s", "a", "ex:Supplier"), ("?s", "ex:inNation", "?n")), rich.select("n")).select("s")


@query(f"""SELECT '{EX}nation/' || n_nationkey AS n FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000)""")
def j05_not_exists(s, d):
    g = places(s, d)
    rich = pa.bgp(g, ("?s", "a", "ex:Supplier"), ("?s", "ex:inNation", "?n"), ("?s", "ex:balance", "?bal")).filter(number(F.col("bal")) > 5000)
    return pa.not_exists(pa.bgp(g, ("?n", "a", "ex:Nation")), rich.select("n"))


@query(f"""SELECT '{EX}customer/' || c_custkey AS c, '{EX}supplier/' || s_suppkey AS s FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal < s_acctbal WHERE c_acctbal > 9000""")
def j06_theta_balance(s, d):
    g = places(s, d)
    a = pa.bgp(g, ("?c", "a", "ex:Customer"), ("?c", "ex:inNation", "?n"), ("?c", "ex:balance", "?cb")).withColumn("cb", number(F.col("cb"))).filter("cb > 9000")
    b = pa.bgp(g, ("?s", "a", "ex:Supplier"), ("?s", "ex:inNation", "?n"), ("?s", "ex:balance", "?sb")).withColumn("sb", number(F.col("sb")))
    return pa.theta(a, b, "n", F.col("cb") < F.col("sb")).select("c", "s")


@query("""SELECT c_name AS name, c_mktsegment AS segment, NULL AS balance FROM customer WHERE c_acctbal < 0
UNION ALL SELECT s_name, NULL, s_acctbal::VARCHAR FROM supplier WHERE s_acctbal < 0""")
def u01_union_parties(s, d):
    g = places(s, d)
    a = pa.bgp(g, ("?x", "ex:segment", "?segment"), ("?x", "ex:name", "?name"), ("?x", "ex:balance", "?bal")).filter(number(F.col("bal")) < 0).select("name", "segment")
    b = pa.bgp(g, ("?x", "a", "ex:Supplier"), ("?x", "ex:name", "?name"), ("?x", "ex:balance", "?balance")).filter(number(F.col("balance")) < 0).select("name", "balance")
    return pa.union(a, b)


NODE_PATH = f"SELECT '{EX}customer/' || c_custkey AS x, '{EX}region/' || n_regionkey AS y FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT '{EX}supplier/' || s_suppkey, '{EX}region/' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey"


@query(NODE_PATH)
def j07_path_sequence(s, d):
    return pa.bgp(places(s, d), ("?x", pa.iri("ex:inNation") / "ex:inRegion", "?y"))


@query(f"""SELECT '{EX}nation/' || n_nationkey AS x, n_name AS y FROM nation UNION ALL SELECT '{EX}nation/' || n_nationkey, '{EX}region/' || n_regionkey FROM nation""")
def j08_path_alternative(s, d):
    return pa.bgp(nation_graph(s, d), ("?x", pa.iri("ex:name") | "ex:inRegion", "?y"))


@query(f"SELECT '{EX}region/' || n_regionkey AS x, '{EX}nation/' || n_nationkey AS y FROM nation")
def j09_path_inverse(s, d):
    return pa.bgp(nation_graph(s, d), ("?x", ~pa.iri("ex:inRegion"), "?y"))


@query(f"""SELECT '{EX}nation/' || n_nationkey AS x, '{EX}region/' || n_regionkey AS y FROM nation""")
def j10_negated_properties(s, d):
    return pa.bgp(nation_graph(s, d), ("?x", pa.none_of("a", "ex:name"), "?y"))


CYCLE = [("x", "y"), ("y", "z"), ("z", "x")]


def part_of(s, d):
    """Links of customers, nations and regions to what they are in, and a cycle of three."""
    links = places(s, d).filter(F.col("p").isin(f"{EX}inNation", f"{EX}inRegion")).withColumn("p", F.lit(f"{EX}partOf"))
    return links.filter(F.col("s").startswith(f"{EX}customer") | F.col("s").startswith(f"{EX}nation")).unionByName(gr.abox(s, [(EX + a, f"{EX}partOf", EX + b) for a, b in CYCLE]))


EDGES = f"""e AS (SELECT '{EX}customer/' || c_custkey AS a, '{EX}nation/' || c_nationkey AS b FROM customer UNION SELECT '{EX}nation/' || n_nationkey, '{EX}region/' || n_regionkey FROM nation
UNION VALUES ('{EX}x', '{EX}y'), ('{EX}y', '{EX}z'), ('{EX}z', '{EX}x'))"""
CLOSED = f"WITH RECURSIVE {EDGES}, t AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a)"


@query(f"{CLOSED} SELECT a AS x, b AS y FROM t")
def j11_path_plus(s, d):
    return pa.bgp(part_of(s, d), ("?x", pa.iri("ex:partOf").plus(), "?y"))


@query(f"{CLOSED} SELECT a AS x, b AS y FROM t UNION SELECT a, a FROM e UNION SELECT b, b FROM e")
def j11_path_star(s, d):
    return pa.bgp(part_of(s, d), ("?x", pa.iri("ex:partOf").star(), "?y"))


@query(f"WITH {EDGES} SELECT a AS x, b AS y FROM e UNION SELECT a, a FROM e UNION SELECT b, b FROM e")
def j12_path_maybe(s, d):
    return pa.bgp(part_of(s, d), ("?x", pa.iri("ex:partOf").maybe(), "?y"))


@query(f"WITH {EDGES} SELECT e.a AS x, f.b AS y FROM e JOIN e f ON e.b = f.a UNION SELECT e.a, g.b FROM e JOIN e f ON e.b = f.a JOIN e g ON f.b = g.a")
def j13_path_range(s, d):
    return pa.bgp(part_of(s, d), ("?x", pa.iri("ex:partOf").times(2, 3), "?y"))


@query(f"{CLOSED} SELECT DISTINCT e.a AS x, t.b AS y FROM e JOIN t ON e.b = t.a")
def j13_path_two_or_more(s, d):
    return pa.bgp(part_of(s, d), ("?x", pa.iri("ex:partOf").times(2), "?y"))


@query(f"""SELECT '{EX}order/' || o_orderkey AS o, CASE WHEN o_totalprice > 250000 THEN 'big' ELSE 'small' END AS size, coalesce(CASE WHEN o_orderstatus = 'F' THEN 'done' END, o_orderstatus) AS state,
CASE WHEN instr(o_orderpriority, '-') > 0 THEN substr(o_orderpriority, instr(o_orderpriority, '-') + 1) ELSE '' END AS level FROM orders""")
def q22_bind_if_coalesce(s, d):
    o = table(s, d, "orders")
    return o.select(
        node("order", "o_orderkey").alias("o"), call("if", F.col("o_totalprice") > 250000, F.lit("big"), F.lit("small")).alias("size"),
        call("coalesce", F.when(F.col("o_orderstatus") == "F", "done"), F.col("o_orderstatus")).alias("state"), call("strafter", F.col("o_orderpriority"), "-").alias("level"),
    )


@query(f"SELECT '{EX}part/' || p_partkey AS x, p_name AS name FROM part WHERE regexp_matches(p_name, '(?i)^(small|RED) ')")
def q24_regex_filter(s, d):
    g = gr.direct_mapping(table(s, d, "part"), node("part", "p_partkey"), f"{EX}Part", {"p_name": f"{EX}name"})
    return pa.bgp(g, ("?x", "ex:name", "?name")).filter(call("regex", F.col("name"), "^(small|RED) ", "i"))


@query("SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n FROM events GROUP BY event_type")
def a01_distinct_count(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("n"))


@query("""SELECT n_name AS nation, count(*) AS n, min(c_acctbal) AS low, max(c_acctbal) AS high, round(sum(c_acctbal), 2) AS total,
list_aggregate(list_sort(list(DISTINCT c_mktsegment)), 'string_agg', ',') AS segments FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(*) > 3""")
def a02_group_aggregates(s, d):
    rows = pa.bgp(places(s, d), ("?c", "ex:balance", "?bal"), ("?c", "ex:segment", "?segment"), ("?c", "ex:inNation", "?n"), ("?n", "ex:name", "?nation")).withColumn("bal", number(F.col("bal")))
    out = rows.groupBy("nation").agg(F.count("*").alias("n"), F.min("bal").alias("low"), F.max("bal").alias("high"), F.round(F.sum("bal"), 2).alias("total"), F.concat_ws(",", F.array_sort(F.collect_set("segment"))).alias("segments"))
    return out.filter("n > 3")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def s01_order_limit_offset(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(5).limit(20)


def quads(s, d):
    a, b = customer_graph(s, d).withColumn("g", F.lit(f"{EX}customers")), supplier_graph(s, d).withColumn("g", F.lit(f"{EX}suppliers"))
    return a.unionByName(b).unionByName(nation_graph(s, d).withColumn("g", F.lit(None).cast("string")))


@query("SELECT c_name AS name FROM customer WHERE c_nationkey = 3")
def q07_from_graph(s, d):
    return pa.bgp(pa.in_graphs(quads(s, d), "ex:customers"), ("?x", "ex:inNation", "ex:nation/3"), ("?x", "ex:name", "?name")).select("name")


@query(f"SELECT '{EX}customers' AS g, c_name AS name FROM customer WHERE c_nationkey = 3 UNION ALL SELECT '{EX}suppliers', s_name FROM supplier WHERE s_nationkey = 3")
def q23_graph_variable(s, d):
    return pa.bgp(quads(s, d), ("?x", "ex:inNation", "ex:nation/3"), ("?x", "ex:name", "?name"), graph="?g").select("g", "name")


@query(f"""SELECT '{EX}nation/' || n_nationkey AS s, '{EX}label' AS p, n_name AS o FROM nation UNION SELECT '{EX}region/' || n_regionkey, '{EX}has', '{EX}nation/' || n_nationkey FROM nation""")
def q15_construct(s, d):
    rows = pa.bgp(nation_graph(s, d), ("?n", "ex:name", "?name"), ("?n", "ex:inRegion", "?r"))
    return pa.construct(rows, ("?n", "ex:label", "?name"), ("?r", "ex:has", "?n"))


@query(f"SELECT '{EX}nation/' || n_nationkey AS n, '{EX}region/' || n_regionkey AS r, r_name AS r_label FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name < 'B'")
def q12_labels_for(s, d):
    labels = region_graph(s, d).filter(F.col("p") == f"{EX}name").filter("o < 'B'").withColumn("p", F.lit("http://www.w3.org/2000/01/rdf-schema#label"))
    return pa.with_labels(pa.bgp(nation_graph(s, d), ("?n", "ex:inRegion", "?r")), labels, "r")


@query(f"SELECT n_name AS value FROM nation UNION ALL SELECT '{EX}region/' || n_regionkey FROM nation")
def q13_flatten(s, d):
    return pa.flattened(pa.bgp(nation_graph(s, d), ("?n", "ex:name", "?name"), ("?n", "ex:inRegion", "?r")).select("name", "r"))


@query(f"SELECT s, p, o FROM (SELECT '{EX}nation/7' AS s, '{TYPE}' AS p, '{EX}Nation' AS o UNION SELECT '{EX}nation/7', '{EX}name', n_name FROM nation WHERE n_nationkey = 7 UNION SELECT '{EX}nation/7', '{EX}inRegion', '{EX}region/' || n_regionkey FROM nation WHERE n_nationkey = 7 UNION SELECT '{EX}customer/' || c_custkey, '{EX}inNation', '{EX}nation/7' FROM customer WHERE c_nationkey = 7 UNION SELECT '{EX}supplier/' || s_suppkey, '{EX}inNation', '{EX}nation/7' FROM supplier WHERE s_nationkey = 7)")
def q16_describe(s, d):
    return pa.describe(places(s, d), "ex:nation/7").select("s", "p", "o")


@query(f"SELECT DISTINCT '{EX}region/' || n_regionkey AS r FROM nation")
def q18_hidden_variable(s, d):
    return pa.bgp(nation_graph(s, d), ("_:n", "ex:inRegion", "?r")).distinct()


ROOTS = "SELECT DISTINCT b AS node FROM c WHERE b NOT IN (SELECT a FROM c)"


# ---- updates ----

NATION_QUADS = f"SELECT '{EX}nation/' || n_nationkey AS s, '{EX}name' AS p, n_name AS o, NULL::VARCHAR AS g FROM nation"


def nation_names(s, d):
    return nation_graph(s, d).filter(F.col("p") == f"{EX}name").select("s", "p", "o").withColumn("g", F.lit(None).cast("string"))


@query(f"{NATION_QUADS} UNION SELECT '{EX}nation/' || n_nationkey, '{EX}name', n_name, '{EX}named' FROM nation WHERE n_nationkey < 5")
def up1_insert(s, d):
    return up.insert(nation_names(s, d), nation_names(s, d).drop("g").filter(st.all_matches(F.col("s"), r"\d+$")[0].cast("int") < 5), "ex:named")


@query(f"SELECT * FROM ({NATION_QUADS}) WHERE o NOT LIKE '%1'")
def up2_delete(s, d):
    return up.delete(nation_names(s, d), nation_names(s, d).drop("g").filter("o LIKE '%1'"))


@query(f"SELECT s, CASE WHEN o LIKE '%1' THEN '{EX}label' ELSE p END AS p, o, g FROM ({NATION_QUADS})")
def up4_modify(s, d):
    store = nation_names(s, d)
    where = pa.bgp(store, ("?n", "ex:name", "?x")).filter("x LIKE '%1'")
    return up.modify(store, where, [("?n", "ex:name", "?x")], [("?n", "ex:label", "?x")])


@query(f"SELECT '{EX}customers' AS g, count(*) AS n FROM (SELECT unnest([1, 2, 3, 4, 5]) FROM supplier) UNION ALL SELECT '{EX}copy', count(*) FROM (SELECT unnest([1, 2, 3, 4]) FROM supplier)")
def up6_move_copy(s, d):
    store = quads(s, d).select("s", "p", "o", "g")
    store = up.copy(store, "ex:suppliers", "ex:copy")
    store = up.move(up.clear(store, "ex:customers"), "ex:suppliers", "ex:customers")
    store = up.clear(store, which="default")
    extra = store.filter(F.col("g") == f"{EX}customers").select("s").distinct().select("s", F.lit(f"{EX}seen").alias("p"), F.lit("yes").alias("o"))
    return up.insert(store, extra, "ex:customers").groupBy("g").agg(F.count("*").alias("n"))


# ---- hierarchies ----

CLASSES = f"""c AS (SELECT DISTINCT p_brand AS a, 'Group' || (regexp_extract(p_brand, '\\d+')::INT % 5) AS b FROM part UNION SELECT DISTINCT 'Group' || (regexp_extract(p_brand, '\\d+')::INT % 5), 'Brand' FROM part
UNION SELECT DISTINCT p_brand, 'Brand' FROM part UNION SELECT DISTINCT p_type, 'Type' FROM part UNION VALUES ('Brand', 'Top'), ('Type', 'Top'))"""
CLASS_CLOSURE = f"WITH RECURSIVE {CLASSES}, t AS (SELECT a, b FROM c UNION SELECT t.a, c.b FROM t JOIN c ON t.b = c.a)"


def class_edges(s, d):
    p = table(s, d, "part").select("p_brand", "p_type").distinct()  # few; nothing of the links is made of each part
    group = F.concat(F.lit("Group"), (F.regexp_extract("p_brand", r"\d+", 0).cast("int") % 5).cast("string"))
    links = F.array(F.struct(F.col("p_brand").alias("a"), group.alias("b")), F.struct(group.alias("a"), F.lit("Brand").alias("b")), F.struct(F.col("p_brand").alias("a"), F.lit("Brand").alias("b")), F.struct(F.col("p_type").alias("a"), F.lit("Type").alias("b")))
    top = s.createDataFrame([("Brand", "Top"), ("Type", "Top")], "a string, b string")
    return p.select(F.explode(links).alias("e")).select("e.a", "e.b").distinct().unionByName(top)


@query(f"{CLASS_CLOSURE} SELECT a, b FROM t EXCEPT SELECT x.a, y.b FROM t x JOIN t y ON x.b = y.a")
def o01_direct_parents(s, d):
    return hi.direct_links(class_edges(s, d))


@query(f"{CLASS_CLOSURE} SELECT a AS node FROM t WHERE b = 'Brand'")
def o02_descendants(s, d):
    return hi.descendants(hi.subsumptions(class_edges(s, d)), "Brand")


@query(f"{CLASS_CLOSURE}, i AS (SELECT p_partkey AS k, p_brand AS c FROM part UNION SELECT p_partkey, p_type FROM part) SELECT c AS class, count(*) AS n FROM (SELECT k, c FROM i UNION SELECT k, b FROM i JOIN t ON i.c = t.a) GROUP BY c")
def o03_instances(s, d):
    types = table(s, d, "part").select(F.col("p_partkey").alias("i"), F.explode(F.array("p_brand", "p_type")).alias("c"))
    return hi.instances(types, hi.subsumptions(class_edges(s, d))).groupBy(F.col("c").alias("class")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS i, p_brand AS c FROM part UNION SELECT p_partkey, p_type FROM part")
def o03_direct_types(s, d):
    closure = hi.subsumptions(class_edges(s, d))
    types = table(s, d, "part").select(F.col("p_partkey").alias("i"), F.explode(F.array("p_brand", "p_type", F.lit("Brand"), F.lit("Top"))).alias("c"))
    return hi.most_specific(types, closure)


@query(f"WITH {CLASSES} SELECT DISTINCT a AS node FROM c WHERE a NOT IN (SELECT b FROM c)")
def o07_leaves(s, d):
    return hi.leaves(class_edges(s, d))


@query(f"WITH {CLASSES} {ROOTS}")
def q31_roots(s, d):
    return hi.roots(class_edges(s, d))


@query(f"{CLOSED} SELECT x.a AS a, x.b AS b FROM t x JOIN t y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b")
def o06_equivalents(s, d):
    return hi.equivalents(transitive_closure(hi.edges_of(part_of(s, d), f"{EX}partOf")))


@query(f"WITH {CLASSES} SELECT a, b FROM c EXCEPT SELECT DISTINCT p_brand, 'Brand' FROM part")
def o23_necessary_links(s, d):
    return hi.necessary_links(class_edges(s, d))


@query(f"WITH {CLASSES} SELECT node, CASE WHEN node = 'Top' THEN 0 WHEN node IN ('Brand', 'Type') THEN 1 WHEN node LIKE 'Group%' OR node IN (SELECT p_type FROM part) THEN 2 ELSE 3 END::INT AS level FROM (SELECT a AS node FROM c UNION SELECT b FROM c)")
def o28_levels(s, d):
    return hi.levels(class_edges(s, d))


@query(f"{CLASS_CLOSURE}, u AS (SELECT 'Group1' AS a, 'Type' AS b) SELECT node FROM (SELECT DISTINCT p_brand AS node FROM part WHERE regexp_extract(p_brand, '\\d+')::INT % 5 = 1 UNION SELECT 'Group1' FROM part WHERE regexp_extract(p_brand, '\\d+')::INT % 5 = 1)")
def o11_unsatisfiable(s, d):
    edges = class_edges(s, d)
    return hi.unsatisfiable(hi.subsumptions(edges), s.createDataFrame([("Group1", "Brand")], "a string, b string"))


SCHEMA = [("ex:orderedBy", SUBPROPERTY, "ex:involves"), ("ex:involves", DOMAIN, "ex:Deal"), ("ex:involves", RANGE, "ex:Party"), ("ex:Deal", SUBCLASS, "ex:Event"), ("ex:Party", SUBCLASS, "ex:Agent")]


def order_links(s, d):
    links = order_graph(s, d).filter(F.col("p") == f"{EX}orderedBy")
    full = lambda x: x.replace("ex:", EX)
    return links.unionByName(gr.abox(s, [(full(a), p, full(b)) for a, p, b in SCHEMA]))


@query(f"""SELECT '{EX}order/' || o_orderkey AS s, '{EX}involves' AS p, '{EX}customer/' || o_custkey AS o FROM orders UNION SELECT '{EX}order/' || o_orderkey, '{TYPE}', unnest(['{EX}Deal', '{EX}Event']) FROM orders
UNION SELECT '{EX}customer/' || o_custkey, '{TYPE}', unnest(['{EX}Party', '{EX}Agent']) FROM orders""")
def o19_rdfs_entailed(s, d):
    g = order_links(s, d)
    return en.entailed(g, "rdfs").join(g.select("s", "p", "o"), ["s", "p", "o"], "left_anti")


@query(f"SELECT '{EX}' || p AS p, '{EX}' || c AS c FROM (VALUES ('involves', 'Deal'), ('involves', 'Event'), ('orderedBy', 'Deal'), ('orderedBy', 'Event')) v(p, c)")
def o12_domains(s, d):
    return hi.domains_and_ranges(order_links(s, d), DOMAIN)


@query(f"""WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey + 5) % 25 AS b FROM nation), y AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
t AS (SELECT a, b FROM y UNION SELECT t.a, y.b FROM t JOIN y ON t.b = y.a) SELECT '{EX}nation/' || a AS s, '{EX}near' AS p, '{EX}nation/' || b AS o FROM t""")
def o30_symmetric_transitive(s, d):
    n = table(s, d, "nation")
    links = n.select(node("nation", "n_nationkey").alias("s"), F.lit(f"{EX}near").alias("p"), F.concat(F.lit(f"{EX}nation/"), ((F.col("n_nationkey") + 5) % 25).cast("string")).alias("o"))
    flags = s.createDataFrame([(f"{EX}near", TYPE, f"{OWL}SymmetricProperty"), (f"{EX}near", TYPE, f"{OWL}TransitiveProperty")], "s string, p string, o string")
    return en.rdfs_plus(links.unionByName(flags)).filter(F.col("p") == f"{EX}near")


@query(f"""{CLASS_CLOSURE}, r AS (SELECT DISTINCT p_type AS x, 'madeBy' AS p, p_brand AS c FROM part), q AS (SELECT x, p, c FROM r UNION SELECT x, 'relatedTo', c FROM r) SELECT x, p, c FROM q UNION SELECT x, p, b FROM q JOIN t ON c = a""")
def o26_restrictions_up(s, d):
    links = table(s, d, "part").select(F.col("p_type").alias("x"), F.lit("madeBy").alias("p"), F.col("p_brand").alias("c")).distinct()
    props = s.createDataFrame([("madeBy", "relatedTo")], "a string, b string")
    return hi.restrictions_up(links, props, hi.subsumptions(class_edges(s, d)))


@query("SELECT DISTINCT p_brand AS node, CASE WHEN regexp_extract(p_brand, '\\d+')::INT % 5 < 2 THEN 'Group' || (regexp_extract(p_brand, '\\d+')::INT % 5) ELSE 'Brand' END AS base FROM part UNION SELECT DISTINCT 'Group' || (regexp_extract(p_brand, '\\d+')::INT % 5), 'Brand' FROM part")
def o25_nearest_base(s, d):
    edges = class_edges(s, d).filter("NOT (a LIKE 'Brand#%' AND b = 'Brand') AND b <> 'Type' AND b <> 'Top'")
    return hi.nearest_base(edges, s.createDataFrame([("Group0",), ("Group1",), ("Brand",)], "node string"))


@query(f"{CLASS_CLOSURE}, l AS (SELECT 'Group2' AS a, 'Type' AS b), w AS (SELECT a, b FROM l UNION SELECT t.a, l.b FROM t JOIN l ON t.b = l.a) SELECT a, b FROM w UNION SELECT w.a, t.b FROM w JOIN t ON w.b = t.a")
def j16_cross_reach(s, d):
    return hi.cross_reach(hi.subsumptions(class_edges(s, d)), s.createDataFrame([("Group2", "Type")], "a string, b string"))


@query("""SELECT iri, label, lang FROM (SELECT 'term' || (doc_id % 100) AS iri, text AS label, lang,
row_number() OVER (PARTITION BY doc_id % 100 ORDER BY (doc_id % 2), (lang IS NULL), text) AS n FROM documents WHERE lang = 'en') WHERE n = 1""")
def a09_preferred_label(s, d):
    docs = table(s, d, "documents").select(F.concat(F.lit("term"), (F.col("doc_id") % 100).cast("string")).alias("iri"), F.lit("p").alias("prop"), (F.col("doc_id") % 2).alias("prop_rank"), "lang", F.col("text").alias("label"))
    return hi.preferred_labels(docs, "en").select("iri", "label", "lang")


@query("SELECT coalesce(n_name, 'x' || c_nationkey) AS nation, count(*) AS n FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 2 = 0 GROUP BY 1")
def j14_labels_or_terms(s, d):
    labels = table(s, d, "nation").filter("n_nationkey % 2 = 0").select(F.concat(F.lit("x"), F.col("n_nationkey").cast("string")).alias("iri"), F.col("n_name").alias("label"))
    rows = table(s, d, "customer").select(F.concat(F.lit("x"), F.col("c_nationkey").cast("string")).alias("nation"))
    return hi.labels_or_terms(rows, labels, "nation").groupBy("nation").agg(F.count("*").alias("n"))


@query("SELECT p_name AS label, count(DISTINCT p_partkey) AS n FROM part GROUP BY p_name HAVING count(DISTINCT p_partkey) > 1")
def o32_ambiguous_labels(s, d):
    return hi.ambiguous_labels(table(s, d, "part").select(F.col("p_partkey").alias("iri"), F.col("p_name").alias("label")))


# ---- rules, constraints and models ----


def order_facts(s, d):
    o, c = table(s, d, "orders"), table(s, d, "customer")
    return mo.facts_of(o, "by", F.col("o_orderkey"), F.col("o_custkey")).unionByName(mo.facts_of(o.filter("o_orderstatus = 'F'"), "done", F.col("o_orderkey"))).unionByName(mo.facts_of(c.filter("c_custkey % 10 <> 0"), "customer", F.col("c_custkey"))).unionByName(mo.facts_of(c, "in", F.col("c_custkey"), F.col("c_nationkey")))


@query(f"{CLOSED} SELECT a, b FROM t")
def l07_transitive_rule(s, d):
    facts = part_of(s, d).select(F.lit("in").alias("pred"), F.array("s", "o").alias("args"))
    rule = Rule(("in", "?x", "?z"), (("in", "?x", "?y"), ("in", "?y", "?z")))
    return saturate(facts, [rule]).select(F.col("args")[0].alias("a"), F.col("args")[1].alias("b"))


@query("SELECT DISTINCT o_custkey::VARCHAR AS c, c_nationkey::VARCHAR AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND c_custkey % 10 <> 0")
def l08_rule_chain(s, d):
    rules = [Rule(("active", "?c"), (("by", "?o", "?c"), ("done", "?o"), ("customer", "?c"))), Rule(("served", "?c", "?n"), (("active", "?c"), ("in", "?c", "?n")))]
    return saturate(order_facts(s, d), rules).filter("pred = 'served'").select(F.col("args")[0].alias("c"), F.col("args")[1].alias("n"))


@query("SELECT c_custkey::VARCHAR AS c FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def l10_negation_as_failure(s, d):
    big = mo.facts_of(table(s, d, "orders").filter("o_totalprice > 300000"), "big", F.col("o_orderkey"))
    facts = saturate(order_facts(s, d).unionByName(big), [Rule(("ordered", "?c"), (("by", "?o", "?c"), ("big", "?o")))])
    return saturate(facts, [Rule(("idle", "?c"), (("customer", "?c"),), (("ordered", "?c"),))]).filter("pred = 'idle'").select(F.col("args")[0].alias("c"))


EVERY_ORDER_HAS_CUSTOMER = ("forall", ["?o", "?c"], ("implies", ("fact", "by", "?o", "?c"), ("fact", "customer", "?c")))
DONE_IFF_LOW = ("forall", ["?c"], ("implies", ("fact", "customer", "?c"), ("exists", ["?o"], ("and", ("fact", "by", "?o", "?c"), ("fact", "done", "?o")))))


@query("SELECT o_orderkey::VARCHAR AS o, o_custkey::VARCHAR AS c FROM orders WHERE o_custkey % 10 = 0")
def l14_counterexamples(s, d):
    return co.counterexamples(EVERY_ORDER_HAS_CUSTOMER, order_facts(s, d)).select("o", "c")


@query("""SELECT 'each order has a customer' AS name, count(*) = 0 AS holds, count(*) AS n_counterexamples FROM orders WHERE o_custkey % 10 = 0
UNION ALL SELECT 'each customer has a finished order', count(*) = 0, count(*) FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def l13_check_formulas(s, d):
    return co.check({"each order has a customer": EVERY_ORDER_HAS_CUSTOMER, "each customer has a finished order": DONE_IFF_LOW}, order_facts(s, d))


@query("SELECT o_custkey, CASE WHEN l_ok THEN 'first' ELSE 'second' END AS side FROM (SELECT c_custkey AS o_custkey, true AS l_ok FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, false FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))")
def l12_iff_constraint(s, d):
    return co.differing(table(s, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")), table(s, d, "orders"), ["o_custkey"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def l11_forall_constraint(s, d):
    orders = table(s, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return co.missing(table(s, d, "lineitem").select("l_orderkey", "l_linenumber"), orders, ["l_orderkey"])


@query("SELECT 'missing' AS kind, 'seen' AS pred, '999999999' AS arg UNION ALL SELECT 'unexpected', 'seen', min(o_custkey)::VARCHAR FROM orders")
def l15_expectations(s, d):
    facts = order_facts(s, d)
    low = table(s, d, "orders").agg(F.min("o_custkey").cast("string").alias("x"))
    unexpected = low.select(F.lit("seen").alias("pred"), F.array("x").alias("args"))
    expected = s.createDataFrame([("seen", ["999999999"])], "pred string, args array<string>")
    return co.expectation(facts, [Rule(("seen", "?c"), (("by", "?o", "?c"),))], expected, unexpected).select("kind", "pred", F.col("args")[0].alias("arg"))


@query("""SELECT 'by' AS pred, 2::INT AS arity, count(*) AS n, (SELECT count(DISTINCT x) FROM (SELECT o_orderkey AS x FROM orders UNION ALL SELECT o_custkey FROM orders)) AS n_elements FROM orders
UNION ALL SELECT 'done', 1, count(*), count(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'customer', 1, count(*), count(*) FROM customer WHERE c_custkey % 10 <> 0
UNION ALL SELECT 'in', 2, count(*), (SELECT count(DISTINCT x) FROM (SELECT c_custkey AS x FROM customer UNION ALL SELECT c_nationkey FROM customer)) FROM customer""")
def l16_model_statistics(s, d):
    return mo.statistics(order_facts(s, d))


@query("SELECT a.n_regionkey AS \"group\", a.n_name AS element, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name")
def j18_inequalities(s, d):
    return mo.inequalities(table(s, d, "nation").select(F.col("n_regionkey").alias("group"), F.col("n_name").alias("element")))


@query("SELECT DISTINCT o_custkey::VARCHAR AS c FROM orders WHERE o_orderstatus = 'F'")
def j17_conjunctive_query(s, d):
    return co.satisfying(("exists", ["?o"], ("and", ("fact", "by", "?o", "?c"), ("fact", "done", "?o"))), order_facts(s, d))


# ---- axioms ----


def part_axioms(s, d, where="true", ont="main"):
    p = table(s, d, "part").filter(where)
    name = F.concat(F.lit("part"), F.col("p_partkey").cast("string"))
    sub = ax.axiom_rows(p, "SubClassOf", name, F.col("p_type"), ont=ont)
    return sub.unionByName(ax.axiom_rows(p.filter("p_size > 25"), "EquivalentClasses", name, F.col("p_brand"), ont=ont)).unionByName(ax.axiom_rows(p, "Declaration", name, ont=ont))


AXIOMS = """a AS (SELECT '(SubClassOf part' || p_partkey || ' ' || p_type || ')' AS x, p_size, p_partkey FROM part UNION ALL SELECT '(EquivalentClasses part' || p_partkey || ' ' || p_brand || ')', p_size, p_partkey FROM part WHERE p_size > 25
UNION ALL SELECT '(Declaration part' || p_partkey || ')', p_size, p_partkey FROM part)"""


@query(f"WITH {AXIOMS} SELECT side, count(*) AS n FROM (SELECT CASE WHEN p_size >= 10 AND p_size < 40 THEN 'both' WHEN p_size < 40 THEN 'only_1' ELSE 'only_2' END AS side FROM a) GROUP BY side")
def u03_axiom_diff(s, d):
    return ax.diff(part_axioms(s, d, "p_size < 40"), part_axioms(s, d, "p_size >= 10")).groupBy("side").agg(F.count("*").alias("n"))


@query(f"WITH {AXIOMS} SELECT DISTINCT x AS sexpr FROM a WHERE x NOT LIKE '(Equiv%'")
def x05_only_subclasses(s, d):
    return ax.only_subclasses(part_axioms(s, d)).select("sexpr").distinct()


@query(f"WITH {AXIOMS} SELECT replace(x, 'EquivalentClasses', 'SubClassOf') AS sexpr FROM a")
def x06_equivalents_to_subclasses(s, d):
    return ax.equivalents_to_subclasses(part_axioms(s, d)).select("sexpr")


@query("SELECT '(SubClassOf part' || p_partkey || ' ' || p_type || ')' AS sexpr FROM part WHERE p_partkey < 100 AND p_type = 'PROMO' UNION ALL SELECT '(Declaration part' || p_partkey || ')' FROM part WHERE p_partkey < 100")
def j15_within_signature(s, d):
    terms = table(s, d, "part").filter("p_partkey < 100").select(F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("iri")).unionByName(s.createDataFrame([("PROMO",)], "iri string"))
    return ax.within_signature(part_axioms(s, d), terms).select("sexpr")


@query("SELECT '(EquivalentClasses part' || p_partkey || ' ' || p_brand || ')' AS sexpr FROM part WHERE p_size > 25 AND p_brand = 'Brand#3'")
def o17_referencing(s, d):
    return ax.referencing(part_axioms(s, d), s.createDataFrame([("Brand#3",)], "iri string")).select("sexpr")


@query("SELECT '(SubClassOf _ _)' AS shape, count(*) AS n FROM part WHERE p_type IS NOT NULL UNION ALL SELECT '(EquivalentClasses _ _)', count(*) FROM part WHERE p_size > 25 UNION ALL SELECT '(Declaration _)', count(*) FROM part")
def a06_shapes(s, d):
    return ax.shapes(part_axioms(s, d)).select("shape", "n")


@query(f"SELECT coalesce('{EX}new/' || CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey END, '{EX}nation/' || n_nationkey) AS s, '{EX}calls' AS p, n_name AS o FROM nation")
def x09_rewrite_iris(s, d):
    n = table(s, d, "nation")
    mapping = n.filter("n_nationkey % 3 = 0").select(node("nation", "n_nationkey").alias("iri"), node("new", "n_nationkey").alias("new")).unionByName(s.createDataFrame([(f"{EX}name", f"{EX}calls")], "iri string, new string"))
    return ax.rewritten_iris(nation_graph(s, d).filter(F.col("p") == f"{EX}name").select("s", "p", "o"), mapping)


@query(f"SELECT '{EX}nation/' || n_nationkey AS iri, '{EX}id_' || lpad((41 + row_number() OVER (ORDER BY '{EX}nation/' || n_nationkey))::VARCHAR, 7, '0') AS new FROM nation")
def x09_minted_iris(s, d):
    terms = table(s, d, "nation").select(node("nation", "n_nationkey").alias("iri"))
    return ax.minted(terms, s.createDataFrame([(f"{EX}id_0000041",)], "iri string"), f"{EX}id_")


@query(f"SELECT 'part' || p_partkey AS s, '{SUBCLASS}' AS p, p_type AS o FROM part UNION SELECT 'part' || p_partkey, '{OWL}equivalentClass', p_brand FROM part WHERE p_size > 25")
def x10_axioms_to_triples(s, d):
    return ax.to_triples(part_axioms(s, d))


@query(f"{CLASS_CLOSURE} SELECT '(SubClassOf ' || a || ' ' || b || ')' AS sexpr FROM c WHERE a = 'Group3' OR a IN (SELECT b FROM t WHERE a = 'Group3')")
def o21_module(s, d):
    rows = ax.axiom_rows(class_edges(s, d), "SubClassOf", F.col("a"), F.col("b"))
    return locality_module(rows, s.createDataFrame([("Group3",)], "iri string")).select("sexpr")


@query(f"WITH {CLASSES} SELECT 'undeclared class' AS violation, node AS iri FROM (SELECT a AS node FROM c UNION SELECT b FROM c) WHERE node NOT IN (SELECT p_type FROM part)")
def o22_profile(s, d):
    edges = class_edges(s, d)
    g = edges.select(F.col("a").alias("s"), F.lit(SUBCLASS).alias("p"), F.col("b").alias("o"))
    declared = table(s, d, "part").select(F.col("p_type").alias("s"), F.lit(TYPE).alias("p"), F.lit(f"{OWL}Class").alias("o")).distinct()
    return ax.profile_violations(g.unionByName(declared))


# ---- functions ----


@query("SELECT c_custkey, regexp_replace(c_name, '#0*', '#') AS short, CASE WHEN c_custkey = 0 THEN '' ELSE lpad(regexp_extract(c_name, '\\d+'), 20, '0') END AS number FROM customer")
def s02_natural_key(s, d):
    c = table(s, d, "customer")
    short = st.replace_first(F.col("c_name"), "#0*", "#")
    return c.select("c_custkey", short.alias("short"), F.regexp_extract(st.natural_key(short), r"(\d{20})$", 1).alias("number"))


@query("SELECT p_partkey, regexp_extract_all(p_name, '[a-z]+')[2] AS second, length(p_name) - length(replace(p_name, ' ', '')) AS blanks, upper(substr(p_name, 1, 1)) AS initial FROM part")
def f04_matches(s, d):
    return table(s, d, "part").select("p_partkey", F.get(st.all_matches(F.col("p_name"), "[a-z]+"), F.lit(1)).alias("second"), (F.size(F.split("p_name", " ")) - 1).cast("bigint").alias("blanks"), F.upper(F.substring("p_name", 1, 1)).alias("initial"))


@query("""SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, CASE WHEN l_tax = 0 THEN NULL ELSE round(l_discount / l_tax, 6) END AS ratio, (l_quantity::BIGINT // 7) AS sevens, ceil(l_extendedprice)::BIGINT AS up FROM lineitem""")
def x13_rule_math(s, d):
    return table(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(builtin("multiply", F.col("l_extendedprice"), builtin("subtract", F.lit(1), F.col("l_discount"))), 4).alias("net"),
        F.round(builtin("divide", F.col("l_discount"), F.col("l_tax")), 6).alias("ratio"), builtin("integerDivide", F.col("l_quantity").cast("long"), F.lit(7)).alias("sevens"), builtin("ceiling", F.col("l_extendedprice")).cast("long").alias("up"),
    )


@query("""SELECT p_partkey, split_part(p_name, ' ', 1) AS before, CASE WHEN instr(p_name, ' ') > 0 THEN substr(p_name, instr(p_name, ' ') + 1) ELSE '' END AS after, contains(lower(p_name), 'ring') AS ring, upper(p_type) = upper('promo') AS promo, length(p_brand) AS n FROM part WHERE instr(p_name, ' ') > 0""")
def x13_rule_strings(s, d):
    name = F.col("p_name")
    return table(s, d, "part").filter(F.instr(name, " ") > 0).select(
        "p_partkey", builtin("substringBefore", name, F.lit(" ")).alias("before"), builtin("substringAfter", name, F.lit(" ")).alias("after"), builtin("containsIgnoreCase", name, F.lit("RING")).alias("ring"),
        builtin("stringEqualIgnoreCase", F.col("p_type"), F.lit("promo")).alias("promo"), builtin("stringLength", F.col("p_brand")).cast("long").alias("n"),
    )


@query("SELECT o_orderkey, (o_orderdate::DATE + INTERVAL 3 MONTH)::DATE::VARCHAR AS later, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS days FROM orders")
def x13_rule_dates(s, d):
    day = F.col("o_orderdate").cast("date")
    return table(s, d, "orders").select("o_orderkey", builtin("addYearMonthDurationToDate", day, 3).cast("string").alias("later"), builtin("subtractDates", day, F.lit("1995-01-01").cast("date")).cast("long").alias("days"))


@query("SELECT event_type, sum(json_extract(props, '$.k')::INT)::BIGINT AS k FROM events GROUP BY event_type")
def f15_json_value(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.sum(st.json_value(F.col("props"), "$.k", "int")).alias("k"))


@query(f"SELECT '<{EX}nation/' || n_nationkey || '> <{EX}name> \"' || n_name || '\" .' AS value FROM nation UNION SELECT '<{EX}nation/' || n_nationkey || '> <{EX}inRegion> <{EX}region/' || n_regionkey || '> .' FROM nation UNION SELECT '<{EX}nation/' || n_nationkey || '> <{TYPE}> <{EX}Nation> .' FROM nation")
def snk01_ntriples(s, d):
    return gr.ntriples_lines(nation_graph(s, d))


# ---- sources ----


@query("SELECT * FROM (SELECT 'region' AS table_name, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'lineitem', count(*) FROM lineitem)")
def src14_table_counts(s, d):
    return db.table_counts({t: table(s, d, t) for t in ("region", "nation", "lineitem")})


@query("SELECT table_name, column_name FROM information_schema.columns WHERE table_name IN ('customer', 'nation', 'supplier', 'region') AND column_name LIKE '%nationkey'")
def src15_catalog_search(s, d):
    return db.catalog_search(db.columns_catalog({t: table(s, d, t) for t in ("customer", "nation", "supplier", "region")}), "nationkey").select("table_name", "column_name")


@query("SELECT n_nationkey, n_name AS name, 'R' || n_regionkey AS region FROM nation")
def src21_xpath(s, d):
    xml = F.format_string("<n id='%d'><name>%s</name><in>R%d</in></n>", "n_nationkey", "n_name", "n_regionkey")
    rows = table(s, d, "nation").select("n_nationkey", xml.alias("x"))
    return rows.select("n_nationkey", F.xpath_string("x", F.lit("/n/name")).alias("name"), F.xpath_string("x", F.lit("/n/in")).alias("region"))


@query("SELECT tag, count(*) AS n FROM (SELECT DISTINCT page_id, lower(unnest(regexp_extract_all(html, '<([A-Za-z][\\w\\-]*)', 1))) AS tag FROM pages) GROUP BY tag")
def src22_tags(s, d):
    return table(s, d, "pages").select(F.explode(fi.tags_of(F.col("html"))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("SELECT 'Term' AS stanza, 'N:' || n_nationkey AS id, 'name' AS tag, n_name AS value FROM nation UNION ALL SELECT 'Term', 'N:' || n_nationkey, 'part_of', 'R:' || n_regionkey FROM nation UNION ALL SELECT 'Term', 'N:' || n_nationkey, 'id', 'N:' || n_nationkey FROM nation")
def src23_obo(s, d):
    text = F.format_string("[Term]\nid: N:%d\nname: %s\nrelationship: part_of R:%d ! a region", "n_nationkey", "n_name", "n_regionkey")
    return fi.obo_rows(table(s, d, "nation").select(text.alias("value"))).select("stanza", "id", "tag", "value")


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'urn:n' || n_nationkey END AS iri FROM nation")
def src09_sparql_results(s, d):
    even = F.when(F.col("n_nationkey") % 2 == 0, F.format_string("<binding name='iri'><uri>urn:n%d</uri></binding>", "n_nationkey")).otherwise("")
    text = F.concat(F.lit("<sparql><results><result>"), F.format_string("<binding name='name'><literal>%s</literal></binding>", "n_name"), even, F.lit("</result></results></sparql>"))
    return fi.sparql_results(table(s, d, "nation").select(text.alias("xml")), "xml", ["name", "iri"])


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windowed_counts(s, d):
    return windowed_counts(table(s, d, "events"), "ts", "event_type")


# ---- codes, further rules, labels and axioms ----


@query("SELECT p_name AS name, list_sort(list(DISTINCT p_type))::VARCHAR AS sources FROM part GROUP BY p_name")
def src27_merged_sources(s, d):
    rows = cd.merged_sources(table(s, d, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("source")))
    return rows.select("name", F.concat(F.lit("["), F.concat_ws(", ", "sources"), F.lit("]")).alias("sources"))


@query("SELECT c_custkey::VARCHAR AS id, 'in' AS label, coalesce(n_name, 'n' || c_nationkey) AS name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20")
def src27_related(s, d):
    links = table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.lit("in").alias("label"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("related"))
    names = table(s, d, "nation").filter("n_nationkey < 20").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"))
    return cd.related(links, names)


@query("SELECT match, count(*) AS n FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"/[A-Za-z]+\"')) AS match FROM pages) GROUP BY match")
def src27_mentioned(s, d):
    return cd.mentioned(table(s, d, "pages"), "html", 'href="/[A-Za-z]+"')


PART_ATOMS = "a AS (SELECT p_size AS concept, 'brand' AS source, regexp_extract(p_brand, '\\d+') AS code FROM part UNION ALL SELECT p_size, 'type', p_type FROM part)"


@query(f"WITH {PART_ATOMS} SELECT DISTINCT x.code, y.code AS mapped FROM a x JOIN a y ON x.concept = y.concept AND x.source = 'brand' AND y.source = 'type'")
def src28_mapped_codes(s, d):
    p = table(s, d, "part")
    brand = p.select(F.col("p_size").alias("concept"), F.lit("brand").alias("source"), F.regexp_extract("p_brand", r"\d+", 0).alias("code"))
    return cd.mapped_codes(brand.unionByName(p.select(F.col("p_size").alias("concept"), F.lit("type").alias("source"), F.col("p_type").alias("code"))), "brand", "type")


@query("SELECT 'name (of ' || n_nationkey || ')' AS label, n_nationkey::VARCHAR AS code FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'NATION_4 (thing)', '4' UNION ALL SELECT 'NATION_5', '5'")
def src28_labelled_codes(s, d):
    names = table(s, d, "nation").select(F.when(F.col("n_nationkey") == 3, "name (of 3)").otherwise(F.col("n_name")).alias("name"), F.col("n_nationkey").cast("string").alias("code"))
    return cd.labelled_codes(names, s.createDataFrame([("name (of 3)",), ("NATION_4 (thing)",), ("NATION_5",), ("none (here)",)], "label string"))


@query("SELECT DISTINCT o_custkey::VARCHAR AS c FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 10 <> 0 UNION SELECT c_custkey::VARCHAR FROM customer WHERE c_nationkey = 3 AND c_custkey % 10 <> 0")
def l05_generated_rules(s, d):
    fact = lambda *x: ("fact", *x)
    formula = ("forall", ["?o", "?c"], ("implies", ("and", fact("customer", "?c"), ("or", fact("by", "?o", "?c"), fact("in", "?c", "3"))), fact("known", "?c")))
    return saturate(order_facts(s, d), co.rules_of(formula)).filter("pred = 'known'").select(F.col("args")[0].alias("c"))


@query(f"""SELECT 'Event' AS class, count(*) AS n FROM orders UNION ALL SELECT 'Party', count(DISTINCT o_custkey) FROM orders""")
def l18_axiom_rules(s, d):
    facts = order_facts(s, d).filter("pred = 'by'")
    rules = co.axiom_rules([("ObjectPropertyDomain", "by", "Deal"), ("ObjectPropertyRange", "by", "Party"), ("SubClassOf", "Deal", "Event")])
    return saturate(facts, rules).filter("pred IN ('Event', 'Party')").groupBy(F.col("pred").alias("class")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS place FROM customer")
def s03_model_order(s, d):
    facts = mo.facts_of(table(s, d, "customer"), "customer", F.concat(F.lit("c"), F.col("c_custkey").cast("string")))
    return mo.numbered(facts, 0).select(F.substring(F.col("args")[0], F.lit(2), F.lit(20)).cast("long").alias("c_custkey"), "place")


@query(f"WITH {AXIOMS} SELECT count(DISTINCT x) AS n FROM a")
def u04_merged(s, d):
    return ax.merged(part_axioms(s, d, "p_size < 40", "one"), part_axioms(s, d, "p_size >= 10", "two")).agg(F.count("*").alias("n"))


@query("SELECT axiom_type, n FROM (SELECT 'SubClassOf' AS axiom_type, count(*) AS n FROM part UNION ALL SELECT 'EquivalentClasses', count(*) FROM part WHERE p_size > 25)")
def x01_axiom_types(s, d):
    return ax.of_types(part_axioms(s, d), "SubClassOf", "EquivalentClasses").groupBy("axiom_type").agg(F.count("*").alias("n"))


@query("SELECT '(SubClassOf part' || p_partkey || ' ' || p_brand || ')' AS sexpr FROM part UNION SELECT '(SubClassOf part' || p_partkey || ' ' || p_type || ')' FROM part")
def x04_simplified_equivalents(s, d):
    p = table(s, d, "part").select(F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("a"), F.explode(F.array("p_brand", "p_type")).alias("b"))
    return ax.simplified_equivalents(p).select("sexpr")


@query("SELECT 'undeclared class' AS violation, min(node) AS iri, count(*) AS n FROM (SELECT DISTINCT p_brand AS node FROM part UNION SELECT 'Group' || (regexp_extract(p_brand, '\\d+')::INT % 5) FROM part UNION VALUES ('Brand'), ('Type'), ('Top'))")
def a07_exemplars(s, d):
    return ax.exemplars(o22_profile(s, d))


@query(f"WITH RECURSIVE {CLASSES}, w AS (SELECT DISTINCT b AS node, 0 AS n FROM c WHERE b NOT IN (SELECT a FROM c) UNION SELECT c.a, n + 1 FROM w JOIN c ON c.b = w.node) SELECT max(n)::INT AS depth FROM w")
def a05_depth(s, d):
    return hi.levels(class_edges(s, d)).agg(F.max("level").cast("int").alias("depth"))


@query(f"{CLASS_CLOSURE}, r AS (SELECT DISTINCT p_type AS x, 'madeBy' AS p, p_brand AS c FROM part) SELECT x, p, c FROM r UNION SELECT 'SUB_' || x, p, c FROM r")
def o24_inherited_restrictions(s, d):
    links = table(s, d, "part").select(F.col("p_type").alias("x"), F.lit("madeBy").alias("p"), F.col("p_brand").alias("c")).distinct()
    below = links.select(F.concat(F.lit("SUB_"), "x").alias("a"), F.col("x").alias("b")).distinct()
    return hi.inherited_restrictions(links, below)


@query(f"""SELECT p_type AS s, '{SUBCLASS}' AS p, count(DISTINCT p_brand) AS n FROM part GROUP BY p_type""")
def snk06_restriction_triples(s, d):
    links = table(s, d, "part").select(F.col("p_type").alias("x"), F.lit("ex:madeBy").alias("p"), F.col("p_brand").alias("c")).distinct()
    made = hi.restriction_triples(links)
    found = hi.some_restrictions(made)
    return found.groupBy(F.col("x").alias("s")).agg(F.count("*").alias("n")).select("s", F.lit(SUBCLASS).alias("p"), "n")


@query("SELECT n_name AS iri FROM nation WHERE n_nationkey % 4 <> 0")
def o32_without_deprecated(s, d):
    n = table(s, d, "nation")
    flags = n.select(F.col("n_name").alias("s"), F.lit(f"{OWL}deprecated").alias("p"), F.when(F.col("n_nationkey") % 4 == 0, "true").otherwise("false").alias("o"))
    return hi.without_deprecated(n.select(F.col("n_name").alias("iri")), flags)


@query("SELECT s_name AS label FROM supplier WHERE regexp_matches(s_name, '(?i)supplier#0+[13]$')")
def o32_labels_matching(s, d):
    return hi.labels_matching(table(s, d, "supplier").select(F.col("s_name").alias("label")), "SUPPLIER#0+[13]$")
