"""Rows from spreadsheets, stanza files, query results in XML, paged JSON and archives."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_obo(spark: SparkSession, path: str) -> DataFrame:
    """(stanza, id, tag, value, modifiers) of OBO files; the lines before the first stanza have the type `header`.

    Trailing modifiers in braces and comments after ! are cut off a value; escapes are read;
    `relationship: part_of X` becomes the tag part_of with the value X.
    """
    blocks = spark.read.option("lineSep", "\n\n").text(path)
    return obo_rows(blocks)


def obo_rows(blocks: DataFrame) -> DataFrame:
    kind = F.regexp_extract("value", r"(?m)^\[(\w+)\]", 1)
    rows = blocks.select(
        F.when(kind == "", "header").otherwise(kind).alias("stanza"), F.regexp_extract("value", r"(?m)^id:\s*(\S+)", 1).alias("id"),
        F.explode(F.split("value", r"\r?\n")).alias("line"),
    ).filter(F.col("line").rlike(r"^[\w\-]+:"))
    raw = F.regexp_extract("line", r"^[\w\-]+:\s*(.*)$", 1)
    cut = F.rtrim(F.regexp_replace(F.regexp_replace(raw, r"(?<!\\)\s!.*$", ""), r"\s*(?<!\\)\{[^}]*\}\s*$", ""))
    rows = rows.select("stanza", "id", F.regexp_extract("line", r"^([\w\-]+):", 1).alias("tag"), F.regexp_replace(F.regexp_replace(cut, r"\\n", "\n"), r"\\(.)", "$1").alias("value"), F.regexp_extract(raw, r"\{([^}]*)\}\s*(?:!.*)?$", 1).alias("m"))
    link = (F.col("tag") == "relationship") & F.col("value").rlike(r"^\S+\s+\S+")
    return rows.select(
        "stanza", "id", F.when(link, F.regexp_extract("value", r"^(\S+)", 1)).otherwise(F.col("tag")).alias("tag"),
        F.when(link, F.regexp_extract("value", r"^\S+\s+(.*)$", 1)).otherwise(F.col("value")).alias("value"),
        F.when(F.col("m") == "", F.array().cast("array<string>")).otherwise(F.split("m", r"\s*,\s*")).alias("modifiers"),
    )


def sparql_results(rows: DataFrame, xml: str, variables: list[str]) -> DataFrame:
    """One row for each result element of the column `xml` (SPARQL results in XML), a column for each variable.

    IRIs and literals are their text, blank nodes are kept apart under urn:blank:, a variable
    without a binding is NULL.
    """
    results = F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<result>(.*?)</result>"), F.lit(1))
    one = rows.select(F.posexplode(results).alias("place", "r")).select("place", F.concat(F.lit("<r>"), "r", F.lit("</r>")).alias("r"))

    def value(name: str) -> Column:
        at = lambda kind: F.get(F.xpath("r", F.lit(f"/r/binding[@name='{name}']/{kind}/text()")), F.lit(0))
        return F.coalesce(at("uri"), F.concat(F.lit("urn:blank:"), at("bnode")), at("literal")).alias(name)

    return one.select(*[value(v) for v in variables])


def xpath_rows(rows: DataFrame, xml: str, path: str, name: str = "node") -> DataFrame:
    """One row for each text that the path selects, with the row's other columns."""
    return rows.select(*[c for c in rows.columns if c != xml], F.explode(F.xpath(F.col(xml), F.lit(path))).alias(name))


def tags_of(text: Column) -> Column:
    """The distinct element names of markup, in order of their first appearance; well-formed or not."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"<([A-Za-z][\w\-]*)"), F.lit(1)), F.lower))


def attributes_of(text: Column) -> Column:
    inside = F.array_join(F.regexp_extract_all(text, F.lit(r"<[A-Za-z][\w\-]*((?:\s+[\w\-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?)*)"), F.lit(1)), " ")
    return F.array_distinct(F.regexp_extract_all(inside, F.lit(r"([\w\-]+)\s*="), F.lit(1)))


def sheet(spark: SparkSession, path: str, skip: int = 0, limit: int | None = None, sheet_name: str = "sheet") -> DataFrame:
    """Rows of a CSV sheet with a header: its columns, the sheet's name and each row's number from 1.

    A blank header is named Column-n. A path of several files is one sheet for each: rows are numbered, and
    the header left out, file by file; the first file's header names the columns. Each file is read whole by one task.
    """
    lines = spark.read.option("multiLine", True).csv(path)
    places = lines.select(*lines.columns, F.col("_metadata.file_path").alias("__file"), F.monotonically_increasing_id().alias("__at"))
    begins = places.groupBy("__file").agg(F.min("__at").alias("__begin"))
    numbered = places.join(begins, "__file").withColumn("__row", F.col("__at") - F.col("__begin") - skip)
    first = numbered.filter("__row = 0").orderBy("__file").first()
    if first is None:
        raise ValueError(f"{path} has no header")
    names = [re.sub(r"\s+", " ", first[c].strip()) if first[c] and first[c].strip() else f"Column-{i}" for i, c in enumerate(lines.columns, 1)]
    body = numbered.filter("__row > 0")
    out = body.select(F.lit(sheet_name).alias("sheet"), F.col("__row").alias("row"), *[F.col(c).alias(n) for c, n in zip(lines.columns, names, strict=True)])
    return out if limit is None else out.filter(F.col("row") <= limit)


def blocks(cells: DataFrame, headers: list[str]) -> DataFrame:
    """Blocks of cells(sheet, row, values): a header row, then rows up to an empty one or the next header.

    Gives sheet, block (number in the sheet), header and the row's values. Each sheet is one
    window; sheets are small and many.
    """
    key = F.lower(F.trim(F.get("values", F.lit(0))))
    is_head = key.isin([h.lower() for h in headers])
    empty = F.forall("values", lambda v: v.isNull() | (F.trim(v) == ""))
    order = Window.partitionBy("sheet").orderBy("row")
    marked = cells.withColumn("__head", is_head).withColumn("__empty", empty)
    marked = marked.withColumn("block", F.count(F.when(F.col("__head"), 1)).over(order))
    in_block = Window.partitionBy("sheet", "block").orderBy("row")
    ended = F.count(F.when(F.col("__empty"), 1)).over(in_block) > 0
    header = F.first("values").over(in_block)
    return marked.withColumn("header", header).withColumn("__ended", ended).filter((F.col("block") > 0) & ~F.col("__head") & ~F.col("__ended")).select("sheet", "block", "row", "header", "values")


def paged_json(spark: SparkSession, path: str, items: str = "result") -> DataFrame:
    """The items of all pages of a service's answers, stored as JSON files: pages merge by being read together."""
    pages = spark.read.option("multiLine", True).json(path)
    return pages.select(F.explode(F.col(items)).alias("__i")).select("__i.*")


def archive_entries(spark: SparkSession, path: str, name_matches: str = ".*", text_matches: str | None = None) -> DataFrame:
    """(archive, entry, text) of the entries of zip and jar files whose name, and text, match.

    Each archive is opened by the task that reads it; one entry's text is held at a time.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = re.compile(name_matches)
        for batch in batches:
            for archive, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        if not info.is_dir() and wanted.search(info.filename):
                            text = z.read(info).decode("utf-8", "replace")
                            yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([info.filename]), pa.array([text])], names=["archive", "entry", "text"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    out = files.mapInArrow(read, "archive string, entry string, text string")
    return out if text_matches is None else out.filter(F.col("text").rlike(text_matches))


def parsed_rows(rows: DataFrame, by: str, parsers: Mapping[str, Callable[[DataFrame], DataFrame]], default: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows read by the parser that is given for their kind, the value of the column `by`: a function of the rows of that kind to a
    table. The tables are put together by name. Rows of a kind without a parser go to the default, or else, with a null kind too, become rows
    of the column `error` alone, so that none is lost.
    """
    known = F.coalesce(F.col(by).isin(*parsers), F.lit(False)) if parsers else F.lit(False)
    made = [parse(rows.filter(F.col(by) == kind)) for kind, parse in parsers.items()]
    rest = rows.filter(~known)
    if default:
        made.append(default(rest))
    else:
        made.append(rest.select(F.concat(F.lit("no parser for "), F.coalesce(F.col(by).cast("string"), F.lit("a row without a kind"))).alias("error")))
    out = made[0]
    for df in made[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
