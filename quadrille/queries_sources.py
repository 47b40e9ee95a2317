"""Registered queries that write and read files, stores and streams in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quadrille.functions.terms import RDFS, TYPE, tail
from quadrille.operators.update import GraphStore
from quadrille.plans.stages import scratch_dir, stored
from quadrille.queries import EX, nation_graph, node, query, region_graph, table
from quadrille.sources import databases as db
from quadrille.sources import files as fi
from quadrille.sources import graphs as gr
from quadrille.streaming.ingest import ingest, windowed_counts


def place(s, name: str) -> str:
    """A new folder's path in the shared folder."""
    return f"{scratch_dir(s)}/{name}-{uuid.uuid4().hex}"


NATION_TRIPLES = f"SELECT '{EX}nation/' || n_nationkey AS s, '{EX}name' AS p, n_name AS o FROM nation UNION ALL SELECT '{EX}nation/' || n_nationkey, '{EX}inRegion', '{EX}region/' || n_regionkey FROM nation UNION ALL SELECT '{EX}nation/' || n_nationkey, '{TYPE}', '{EX}Nation' FROM nation"


@query(NATION_TRIPLES)
def src04_ntriples_file(s, d):
    path = place(s, "ntriples")
    gr.write_ntriples(nation_graph(s, d), path)
    return gr.read_ntriples(s, path).select("s", "p", "o")


@query(f"SELECT *, '{EX}' || CASE WHEN p = '{EX}name' THEN 'names' ELSE 'links' END AS g FROM ({NATION_TRIPLES})")
def src01_nquads_gzip(s, d):
    path = place(s, "nquads")
    gr.write_ntriples(nation_graph(s, d).withColumn("g", F.when(F.col("p") == f"{EX}name", f"{EX}names").otherwise(f"{EX}links")), path, "gzip")
    return gr.read_ntriples(s, path, quads=True).select("s", "p", "o", "g")


@query(f"{NATION_TRIPLES} UNION SELECT '{EX}region/' || r_regionkey, '{EX}name', r_name FROM region UNION SELECT '{EX}region/' || r_regionkey, '{TYPE}', '{EX}Region' FROM region")
def src05_union_graph(s, d):
    return gr.union_graph(nation_graph(s, d), region_graph(s, d), nation_graph(s, d)).select("s", "p", "o")


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 100.5 GROUP BY c_mktsegment")
def src11_sql_query(s, d):
    table(s, d, "customer").createOrReplaceTempView("q_customer")
    return db.sql_query(s, "SELECT c_mktsegment, count(*) AS n FROM q_customer WHERE c_acctbal > :least GROUP BY c_mktsegment", least=100.5)


KEYS = "(VALUES ('nation', 'n_regionkey', 'region', 'r_regionkey'), ('customer', 'c_nationkey', 'nation', 'n_nationkey'), ('supplier', 's_nationkey', 'nation', 'n_nationkey'), ('orders', 'o_custkey', 'customer', 'c_custkey')) k(table_name, column_name, ref_table, ref_column)"


def foreign_keys(s):
    rows = [("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey")]
    return s.createDataFrame(rows, "table_name string, column_name string, ref_table string, ref_column string")


def _fits(t, c, rt, rc):
    return f"NOT EXISTS (SELECT 1 FROM {t} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {rc} FROM {rt} WHERE {rc} IS NOT NULL)) AND (SELECT count({rc}) = count(DISTINCT {rc}) FROM {rt})"


#: Columns that may refer to a key, right and wrong ones.
MAYBE = [
    ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("nation", "n_nationkey", "region", "r_regionkey"), ("orders", "o_custkey", "supplier", "s_nationkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
]


@query(" UNION ALL ".join(f"SELECT 'in' AS way, '{t}' AS table_name WHERE {_fits(t, c, rt, rc)}" for t, c, rt, rc in MAYBE if rt == "nation") + " UNION ALL " + " UNION ALL ".join(f"SELECT 'out', '{rt}' WHERE {_fits(t, c, rt, rc)}" for t, c, rt, rc in MAYBE if t == "orders"))
def src16_references(s, d):
    """What refers to nations and what orders refer to, by keys that the tables' rows allow."""
    keys = db.inclusions({t: table(s, d, t) for t in ("region", "nation", "customer", "supplier", "orders", "lineitem")}, MAYBE)
    return db.references(keys, "nation", incoming=True).select(F.lit("in").alias("way"), "table_name").unionByName(db.references(keys, "orders").select(F.lit("out").alias("way"), F.col("ref_table").alias("table_name")))


@query("SELECT 'nation' AS table_name WHERE (SELECT count(*) FROM nation) <> greatest((SELECT count(DISTINCT n_nationkey) FROM nation), (SELECT count(DISTINCT n_name) FROM nation), (SELECT count(DISTINCT n_regionkey) FROM nation)) UNION ALL SELECT 'labels' WHERE (SELECT count(*) FROM labels) <> greatest((SELECT count(DISTINCT doc_id) FROM labels), (SELECT count(DISTINCT quality) FROM labels), (SELECT count(DISTINCT toxic) FROM labels)) UNION ALL SELECT 'lineitem' WHERE (SELECT count(*) FROM lineitem) <> greatest((SELECT count(DISTINCT l_orderkey) FROM lineitem), (SELECT count(DISTINCT l_partkey) FROM lineitem))")
def src17_tables_without_key(s, d):
    """Tables none of whose columns is unique, by their rows."""
    tables = {"nation": table(s, d, "nation"), "labels": table(s, d, "labels"), "lineitem": table(s, d, "lineitem").select("l_orderkey", "l_partkey")}
    return db.without_unique_key(db.columns_catalog(tables), db.unique_keys(tables))


@query("SELECT least(20, count(*))::BIGINT AS n, least(20, count(DISTINCT o_orderkey))::BIGINT AS known, count(*) > 0 AS same FROM orders")
def src18_row_sample(s, d):
    o = table(s, d, "orders")
    a, b = db.row_sample(o, 20, seed=3), db.row_sample(o, 20, seed=3)
    known = a.select("o_orderkey").join(o.select("o_orderkey").distinct(), "o_orderkey", "left_semi").count()
    return a.agg(F.count("*").alias("n")).select("n", F.lit(known).cast("long").alias("known"), F.lit(a.exceptAll(b).isEmpty()).alias("same"))


@query("SELECT 'cities' AS sheet, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::BIGINT AS row, n_nationkey::VARCHAR AS \"the key\", n_name AS \"Column-2\" FROM nation")
def src19_sheets(s, d):
    """A CSV file for each region, each with its own header of which one is blank."""
    path = place(s, "sheets")
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("the  key"), F.col("n_name").alias(" "), "n_regionkey")
    n.repartition("n_regionkey").sortWithinPartitions("n_regionkey", "the  key").write.partitionBy("n_regionkey").option("header", True).csv(path)
    return fi.sheet(s, f"{path}/*/*.csv", sheet_name="cities")


@query("SELECT r_name AS sheet, 1::BIGINT AS block, n_nationkey::VARCHAR AS key, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey")
def src20_blocks(s, d):
    rows = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    text = lambda *x: F.array(*[F.lit(v) for v in x])
    cells = rows.select(F.col("r_name").alias("sheet"), (F.col("n_nationkey") + 10).cast("long").alias("row"), F.array(F.col("n_nationkey").cast("string"), "n_name").alias("values"))
    region = table(s, d, "region").select(F.col("r_name").alias("sheet"))
    extra = [region.select("sheet", F.lit(n).cast("long").alias("row"), v.alias("values")) for n, v in ((1, text("note", "x")), (2, text("", "")), (3, text("Key", "Name")), (100, text("", "")), (101, text("after", "it")))]
    for e in extra:
        cells = cells.unionByName(e)
    return fi.blocks(cells, ["key"]).select("sheet", "block", F.col("values")[0].alias("key"), F.col("values")[1].alias("name"))


@query("SELECT n_nationkey, unnest(['N' || n_nationkey, 'M' || n_nationkey]) AS name FROM nation")
def src21_xpath_rows(s, d):
    xml = F.format_string("<l><n>N%d</n><o>no</o><n>M%d</n></l>", "n_nationkey", "n_nationkey")
    return fi.xpath_rows(table(s, d, "nation").select("n_nationkey", xml.alias("x")), "x", "/l/n/text()", "name")


@query("""SELECT attribute, count(*) AS n FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(tag, '[\\s]([A-Za-z_:][\\w\\-:.]*)\\s*=', 1)) AS attribute FROM
(SELECT page_id, unnest(regexp_extract_all(html, '<[A-Za-z][^<>]*>')) AS tag FROM pages)) WHERE attribute IN ('class', 'id', 'href') GROUP BY attribute""")
def src22_attributes(s, d):
    rows = table(s, d, "pages").select(F.explode(fi.attributes_of("html")).alias("attribute"))
    return rows.filter("attribute IN ('class', 'id', 'href')").groupBy("attribute").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey AS id, n_name AS name FROM nation")
def src26_paged_json(s, d):
    path = place(s, "pages")
    item = F.format_string('{"id": %d, "name": "%s"}', "n_nationkey", "n_name")
    pages = table(s, d, "nation").groupBy("n_regionkey").agg(F.concat(F.lit('{"page": 1, "result": ['), F.array_join(F.collect_list(item), ","), F.lit("]}")).alias("value"))
    pages.select("value", "n_regionkey").write.partitionBy("n_regionkey").text(path)
    return fi.paged_json(s, path).select("id", "name")


@query("SELECT 'first' AS what, count(*) AS n FROM nation UNION ALL SELECT 'second', count(*) FROM region UNION ALL SELECT 'names', 1")
def src29_graph_store(s, d):
    store = GraphStore(s, place(s, "store"))
    plain = lambda g: g.select("s", "p", "o").filter(F.col("p") == f"{EX}name").withColumn("g", F.lit(None).cast("string"))
    store.write("main", plain(nation_graph(s, d)))
    first = stored(store.read("main"), "first")
    store.write("main", plain(region_graph(s, d)))
    store.write("other", plain(region_graph(s, d)))
    store.drop("other")
    row = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return row(first, "first").unionByName(row(store.read("main"), "second")).unionByName(s.createDataFrame([("names", len(store.names()))], "what string, n long"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def snk12_saved_table(s, d):
    path = place(s, "saved")
    table(s, d, "orders").select("o_orderkey", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    return s.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query(f"SELECT '{EX}customer/' || c_custkey AS s, '{RDFS}label' AS p, c_name AS o, CASE WHEN c_nationkey < 10 THEN '{EX}low' END AS g FROM customer")
def snk09_bulk_customers(s, d):
    from quadrille.operators import update as up

    c = table(s, d, "customer").select(node("customer", "c_custkey").alias("s"), F.lit(f"{RDFS}label").alias("p"), F.col("c_name").alias("o"), F.when(F.col("c_nationkey") < 10, f"{EX}low").alias("g"))
    return up.insert(c.limit(0), c.unionByName(c))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_counts_by_window(s, d):
    """A stream of the table's events, counted by windows in complete mode; the last batch's outcome is the result."""
    source, sink, at = place(s, "events"), place(s, "counts"), place(s, "progress")
    events = table(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    events.write.parquet(source)
    stream = s.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(source)
    last: list[int] = []

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{sink}/{number}")
        last.append(number)

    windowed_counts(stream, "ts", "event_type").writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{sink}/{max(last)}").withColumn("start", F.col("start").cast(dict(table(s, d, "events").dtypes)["ts"]))


@query("SELECT 'nation ' || n_name AS o, NULL::VARCHAR AS g FROM nation UNION SELECT 'region ' || r_name, NULL FROM region")
def stream_ingested_quads(s, d):
    """Quads come in as a stream of files, some of them twice; the store stays a set, and a second run adds nothing."""
    source, store = place(s, "quads"), GraphStore(s, place(s, "stores"))
    made = lambda t, c: table(s, d, t).select(F.lit("s").alias("s"), F.lit("p").alias("p"), F.concat(F.lit(f"{t} "), c).alias("o"), F.lit(None).cast("string").alias("g"))
    rows = made("nation", "n_name").unionByName(made("region", "r_name"))
    for part in (rows, rows.filter("o LIKE 'region%'")):
        part.write.mode("append").parquet(source)
    stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    ingest(stream, store, "main", place(s, "seen")).awaitTermination()
    ingest(stream, store, "main", place(s, "again")).awaitTermination()
    store.compact("main")
    return store.read("main").select("o", "g")


@query("SELECT DISTINCT regexp_extract(url, '([^/#]*)$', 1) AS tail FROM pages")
def f10_url_tails(s, d):
    return table(s, d, "pages").select(tail(F.col("url")).alias("tail")).distinct()


@query("SELECT event_type AS kind, CASE WHEN event_type = 'click' THEN value END AS amount, CASE WHEN event_type = 'view' THEN length(props)::INT END AS size, CASE WHEN event_type NOT IN ('click', 'view') THEN 'no parser for ' || event_type END AS error FROM events WHERE event_type IN ('click', 'view') UNION ALL SELECT NULL, NULL, NULL, 'no parser for ' || event_type FROM events WHERE event_type NOT IN ('click', 'view')")
def e04_parsers_by_kind(s, d):
    """Rows are read by the parser that is given for their kind, over a named connection; others are told."""
    sources = db.Connections(local=lambda spark, name: table(spark, d, name)).named("none", lambda spark, name: table(spark, d, name).limit(0))
    parsers = {"click": lambda df: df.select(F.col("event_type").alias("kind"), F.col("value").alias("amount")), "view": lambda df: df.select(F.col("event_type").alias("kind"), F.length("props").alias("size"))}
    return fi.parsed_rows(sources.read(s, "local", "events"), "event_type", parsers).select("kind", "amount", "size", "error")
