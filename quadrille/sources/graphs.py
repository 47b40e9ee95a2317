"""Triples from tables and files, and back."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.terms import BNODE, IRI, LITERAL, TYPE, XSD

COLUMNS = ["s", "p", "o", "o_kind", "o_dt", "o_lang"]
SCHEMA = "s string, p string, o string, o_kind tinyint, o_dt string, o_lang string"
DATATYPES = {"bigint": "integer", "int": "integer", "smallint": "integer", "tinyint": "integer", "double": "double", "float": "float", "boolean": "boolean", "timestamp": "dateTime", "date": "date"}


def direct_mapping(df: DataFrame, subject: Column, kind: str, columns: Mapping[str, str], links: Mapping[str, Column] | None = None) -> DataFrame:
    """One triple for the type of each row, for each non-null column and for each link to another row.

    columns: predicate IRI by column; links: the object's IRI by predicate. All come from one scan.
    """
    types = dict(df.dtypes)
    made = [F.struct(F.lit(TYPE).alias("p"), F.lit(kind).alias("o"), F.lit(IRI).cast("tinyint").alias("o_kind"), F.lit(None).cast("string").alias("o_dt"))]
    for column, predicate in columns.items():
        dt = XSD + DATATYPES[types[column]] if types[column] in DATATYPES else None
        made.append(F.struct(F.lit(predicate).alias("p"), F.col(column).cast("string").alias("o"), F.lit(LITERAL).cast("tinyint").alias("o_kind"), F.lit(dt).cast("string").alias("o_dt")))
    for predicate, target in (links or {}).items():
        made.append(F.struct(F.lit(predicate).alias("p"), target.alias("o"), F.lit(IRI).cast("tinyint").alias("o_kind"), F.lit(None).cast("string").alias("o_dt")))
    rows = df.select(subject.alias("s"), F.explode(F.array(*made)).alias("t"))
    return rows.select("s", "t.p", "t.o", "t.o_kind", "t.o_dt", F.lit(None).cast("string").alias("o_lang")).filter("s IS NOT NULL AND o IS NOT NULL")


def union_graph(*graphs: DataFrame) -> DataFrame:
    """The merge of graphs: a set of triples."""
    out = graphs[0]
    for g in graphs[1:]:
        out = out.unionByName(g, allowMissingColumns=True)
    return out.distinct()


LINE = r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z0-9\-]+)?)\s*(<[^>]*>|_:\S+)?\s*\.\s*(?:#.*)?$'


def _plain(term: Column, source: str) -> Column:
    return F.when(term.startswith("<"), _unescaped(F.substring(term, F.lit(2), F.length(term) - 2))).when(term.startswith("_:"), F.concat(F.lit(f"urn:blank:{source}:"), F.substring(term, F.lit(3), F.length(term))))


#: N-Triples escapes, as fixed by the format.
ESCAPES = [("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('\\"', '"')]
READ_ONLY = [("\\b", "\b"), ("\\f", "\f"), ("\\'", "'"), ("\\\\", "\\")]


def _unescaped(text: Column) -> Column:
    parts = F.regexp_extract_all(text, F.lit(r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+|\\"), F.lit(0))

    def char(x: Column) -> Column:
        out = F.when(x.rlike(r"^\\[uU]."), F.decode(F.unhex(F.lpad(F.substring(x, F.lit(3), F.lit(8)), 8, "0")), "UTF-32"))
        for mark, char in (*ESCAPES, *READ_ONLY):
            out = out.when(x == mark, F.lit(char))
        return out.otherwise(x)

    return F.when(text.contains("\\"), F.array_join(F.transform(parts, char), "")).otherwise(text)


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) of the lines of N-Triples or N-Quads files that read_ntriples leaves out: neither a triple, nor a comment, nor blank."""
    return spark.read.text(path).filter(~F.col("value").rlike(LINE) & ~F.col("value").rlike(r"^\s*(?:#.*)?$"))


def read_ntriples(spark: SparkSession, path: str, source: str = "file", quads: bool = False) -> DataFrame:
    """Triples (with quads, and their graph) of N-Triples or N-Quads files; lines that aren't triples are left out,
    and bad_lines tells which.

    Blank nodes are kept apart by `source`.
    """
    rows = spark.read.text(path).filter(F.col("value").rlike(LINE))
    part = lambda n: F.regexp_extract("value", LINE, n)
    o = part(3)
    literal = o.startswith('"')
    none = F.lit(None).cast("string")
    lex = _unescaped(F.regexp_extract(o, r'^"((?:[^"\\]|\\.)*)"', 1))
    dt, lang = F.regexp_extract(o, r'"\^\^<([^>]*)>$', 1), F.regexp_extract(o, r'"@([A-Za-z0-9\-]+)$', 1)
    columns = [
        _plain(part(1), source).alias("s"), _plain(part(2), source).alias("p"), F.when(literal, lex).otherwise(_plain(o, source)).alias("o"),
        F.when(literal, LITERAL).when(o.startswith("_:"), BNODE).otherwise(IRI).cast("tinyint").alias("o_kind"),
        F.when(literal & (dt != ""), dt).otherwise(none).alias("o_dt"), F.when(literal & (lang != ""), lang).otherwise(none).alias("o_lang"),
    ]
    if quads:
        columns.append(F.when(part(4) != "", _plain(part(4), source)).alias("g"))
    return rows.select(columns).distinct()


def _written(iri: Column) -> Column:
    return F.when(iri.startswith("urn:blank:"), F.concat(F.lit("_:"), F.regexp_replace(F.substring(iri, F.lit(11), F.length(iri)), r"[^A-Za-z0-9]", "x"))).otherwise(F.concat(F.lit("<"), iri, F.lit(">")))


def ntriples_lines(triples: DataFrame) -> DataFrame:
    """The triples (quads, if there is a column g) as lines of text in the column `value`."""
    text = F.col("o")
    for char, mark in [("\\", "\\\\"), *[(c, m) for m, c in ESCAPES]]:
        text = F.replace(text, F.lit(char), F.lit(mark))
    literal = F.concat(F.lit('"'), text, F.lit('"'), F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), F.col("o_lang"))).when(F.col("o_dt").isNotNull(), F.concat(F.lit("^^<"), F.col("o_dt"), F.lit(">"))).otherwise(F.lit("")))
    o = F.when(F.col("o_kind") == LITERAL, literal).otherwise(_written(F.col("o")))
    graph = [F.when(F.col("g").isNotNull(), _written(F.col("g")))] if "g" in triples.columns else []
    return triples.select(F.concat_ws(" ", _written(F.col("s")), _written(F.col("p")), o, *graph, F.lit(".")).alias("value"))


def write_ntriples(triples: DataFrame, path: str, compression: str = "none") -> None:
    ntriples_lines(triples).write.option("compression", compression).text(path)


def abox(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """A small graph of IRIs given inline."""
    return spark.createDataFrame([(s, p, o, IRI, None, None) for s, p, o in rows], SCHEMA)


def list_items(triples: DataFrame, first: str, rest: str, nil: str) -> DataFrame:
    """(head, idx, item) of all RDF collections, from the closure of their links: cycle-safe, logarithmic in length."""
    from quadrille.plans.fixpoint import transitive_closure

    nexts = triples.filter((F.col("p") == rest) & (F.col("o") != nil)).select(F.col("s").alias("a"), F.col("o").alias("b"))
    values = triples.filter(F.col("p") == first).select(F.col("s").alias("b"), F.col("o").alias("item"))
    cells = triples.filter(F.col("p") == first).select(F.col("s").alias("a"), F.col("s").alias("b"))
    reach = transitive_closure(nexts).unionByName(cells).distinct()
    heads = cells.select("a").join(nexts.select(F.col("b").alias("a")), "a", "left_anti")
    # a cell's place is the number of cells before it that the head reaches
    before = reach.filter("a <> b").groupBy(F.col("b").alias("cell")).agg(F.count_distinct("a").alias("idx"))
    return (
        reach.join(heads, "a").select(F.col("a").alias("head"), F.col("b").alias("cell")).join(before, "cell", "left")
        .join(values.withColumnRenamed("b", "cell"), "cell").select("head", F.coalesce("idx", F.lit(0)).alias("idx"), "item")
    )
