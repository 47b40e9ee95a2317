import json
import zipfile

from pyspark.sql import functions as F

from quadrille.functions.strings import camel_case, serial_date, spaced, split_at, synonyms
from quadrille.sources import databases, files, graphs
from quadrille.sources.graphs import BNODE, IRI, LITERAL, SCHEMA, list_items, read_ntriples, write_ntriples


def test_ntriples_round_trip(spark, tmp_path):
    rows = [
        ("urn:a", "urn:p", 'a "quoted"\nline\\end \\n', LITERAL, None, None), ("urn:a", "urn:p", "5", LITERAL, "urn:int", None),
        ("urn:a", "urn:p", "bonjour", LITERAL, None, "fr"), ("urn:a", "urn:p", "urn:b", IRI, None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    write_ntriples(df, str(tmp_path / "g"), "gzip")
    assert sorted(map(str, read_ntriples(spark, str(tmp_path / "g")).collect())) == sorted(map(str, df.collect()))


def test_ntriples_blank_nodes_and_quads(spark, tmp_path):
    (tmp_path / "q.nq").write_text('_:x <urn:p> _:y <urn:g> .\n# comment\n<urn:a> <urn:p> "v" .\nnot a triple\n')
    got = {(r.s, r.o, r.o_kind, r.g) for r in read_ntriples(spark, str(tmp_path / "q.nq"), "f", quads=True).collect()}
    assert got == {("urn:blank:f:x", "urn:blank:f:y", BNODE, "urn:g"), ("urn:a", "v", LITERAL, None)}


def test_rdf_list(spark):
    g = graphs.abox(spark, [("l1", "first", "a"), ("l1", "rest", "l2"), ("l2", "first", "b"), ("l2", "rest", "l3"), ("l3", "first", "c"), ("l3", "rest", "nil"), ("m", "first", "z"), ("m", "rest", "nil")])
    got = sorted((r.head, r.idx, r["item"]) for r in list_items(g, "first", "rest", "nil").collect())
    assert got == [("l1", 0, "a"), ("l1", 1, "b"), ("l1", 2, "c"), ("m", 0, "z")]


def test_obo(spark, tmp_path):
    (tmp_path / "x.obo").write_text("format-version: 1.2\n\n[Term]\nid: X:1\nname: one ! a comment\nis_a: X:2 {source=\"y\", n=\"1\"} ! two\nrelationship: part_of X:3\n\n[Typedef]\nid: part_of\n")
    got = {(r.stanza, r.id, r.tag, r.value, tuple(r.modifiers)) for r in files.read_obo(spark, str(tmp_path / "x.obo")).collect()}
    assert ("header", "", "format-version", "1.2", ()) in got
    assert ("Term", "X:1", "name", "one", ()) in got
    assert ("Term", "X:1", "is_a", "X:2", ('source="y"', 'n="1"')) in got
    assert ("Term", "X:1", "part_of", "X:3", ()) in got
    assert ("Typedef", "part_of", "id", "part_of", ()) in got


def test_sheet_and_blocks(spark, tmp_path):
    (tmp_path / "s.csv").write_text("title,,\nid,,name\n1,x,a\n2,y,b\n")
    got = files.sheet(spark, str(tmp_path / "s.csv"), skip=1)
    assert got.columns == ["sheet", "row", "id", "Column-2", "name"]
    assert [(r.row, r.id, r["Column-2"]) for r in got.orderBy("row").collect()] == [(1, "1", "x"), (2, "2", "y")]
    cells = spark.createDataFrame([("s", i, v) for i, v in enumerate([["junk"], ["Name", "n"], ["a", "1"], ["b", "2"], [None, ""], ["late"], ["Name", "m"], ["c", "3"]])], "sheet string, row int, values array<string>")
    got = [(r.block, r.header, r["values"]) for r in files.blocks(cells, ["name"]).orderBy("row").collect()]
    assert got == [(1, ["Name", "n"], ["a", "1"]), (1, ["Name", "n"], ["b", "2"]), (2, ["Name", "m"], ["c", "3"])]


def test_archives_and_pages(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.jar", "w") as z:
        z.writestr("x/one.txt", "hello there")
        z.writestr("x/two.xml", "<a/>")
    got = files.archive_entries(spark, str(tmp_path / "a.jar"), r"\.txt$", "hello").collect()
    assert [(r.entry, r.text) for r in got] == [("x/one.txt", "hello there")]
    for k in (1, 2):
        (tmp_path / f"page{k}.json").write_text(json.dumps({"page": k, "result": [{"ui": f"C{k}"}, {"ui": "C0"}]}))
    assert sorted(r.ui for r in files.paged_json(spark, str(tmp_path / "page*.json")).collect()) == ["C0", "C0", "C1", "C2"]


def test_catalog(spark, sf):
    keys = spark.createDataFrame([("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey")], "table_name string, column_name string, ref_table string, ref_column string")
    assert [r.table_name for r in databases.references(keys, "customer", incoming=True).collect()] == ["orders"]
    assert databases.references(keys, "customer").count() == 1
    nation = spark.read.parquet(f"{sf}/nation.parquet")
    assert databases.row_sample(nation, 5).count() == 5
    assert sorted(map(str, databases.row_sample(nation, 5).collect())) == sorted(map(str, databases.row_sample(nation, 5).collect()))


def test_strings(spark):
    row = spark.createDataFrame([("some_long name", "HTMLPageTitle", "a,b,,", "x; y,z", 44197)], "a string, b string, c string, d string, n int").select(
        camel_case(F.col("a")).alias("a"), spaced(F.col("b")).alias("b"), split_at(F.col("c"), ",").alias("c"), synonyms(F.col("d")).alias("d"), serial_date(F.col("n")).cast("string").alias("n")
    ).first()
    assert tuple(row) == ("someLongName", "html page title", ["a", "b"], ["x", "y", "z"], "2021-01-01")
