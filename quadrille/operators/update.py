"""Updates of a store of quads(s, p, o, ..., g): each gives the new store and leaves the old one as it is."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions.terms import expanded
from quadrille.operators.patterns import construct, object_tag

#: What tells quads apart: where a store has kinds, datatypes and languages of objects, these too.
KEY, TERM = ["s", "p", "o", "g"], ["o_kind", "o_dt", "o_lang"]


def key_of(store: DataFrame) -> list[str]:
    return KEY + [c for c in TERM if c in store.columns]


def _graph(name: str | None):
    return F.lit(expanded(name) if name else None).cast("string")


def _keyed(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """The rows with what tells their quads apart: texts, and where kinds, datatypes and languages are told, the object's term."""
    typed = "o_kind" in rows.columns
    return (rows.withColumn("__term", object_tag(rows)) if typed else rows), KEY + ["__term"] * typed


def _missing_from(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Of the rows those whose quads others hasn't: by whole terms where both tell them, else by texts."""
    (keyed, key), (other, other_key) = _keyed(rows), _keyed(others)
    key = [c for c in key if c in other_key]
    other = other.select([F.col(c).alias(f"__o_{c}") for c in key]).distinct()
    cond = F.lit(True)
    for c in key:
        cond = cond & keyed[c].eqNullSafe(other[f"__o_{c}"])
    return keyed.join(other, cond, "left_anti").drop("__term")


def insert(store: DataFrame, triples: DataFrame, graph: str | None = None) -> DataFrame:
    """The store with the triples in a graph (the default graph without a name). What is there already stays as it is."""
    fresh = triples if "g" in triples.columns else triples.withColumn("g", _graph(graph))
    keyed, key = _keyed(fresh)
    return store.unionByName(_missing_from(keyed.dropDuplicates(key).drop("__term"), store), allowMissingColumns=True)


def delete(store: DataFrame, triples: DataFrame, graph: str | None = None) -> DataFrame:
    """The store without the triples: whole terms where both sides tell kinds, datatypes and languages, else texts."""
    return _missing_from(store, triples if "g" in triples.columns else triples.withColumn("g", _graph(graph)))


def modify(store: DataFrame, solutions: DataFrame, delete_template: Sequence[tuple] = (), insert_template: Sequence[tuple] = (), graph: str | None = None) -> DataFrame:
    """Templates filled by the solutions, which the caller got from the old store: deletes come before inserts.

    Over a store that tells kinds, datatypes and languages, solutions with tags (bgp with terms=True) delete and insert whole terms.
    """
    if delete_template:
        store = delete(store, construct(solutions, *delete_template), graph)
    return insert(store, construct(solutions, *insert_template), graph) if insert_template else store


def _in(graph: str | None):
    return F.col("g").eqNullSafe(_graph(graph))


def in_using(store: DataFrame, graphs: Sequence[str] = ()) -> DataFrame:
    """What the patterns of an update read: the merge of the graphs USING names, or the default graph without any."""
    rows = store.filter(F.col("g").isin([expanded(g) for g in graphs])) if graphs else store.filter("g IS NULL")
    rows = rows.drop("g")
    return rows.dropDuplicates([c for c in key_of(store) if c != "g"])


def clear(store: DataFrame, graph: str | None = None, which: str = "graph") -> DataFrame:
    """Without a graph's quads; which: graph, default, named or all."""
    if which == "all":
        return store.limit(0)
    if which == "named":
        return store.filter("g IS NULL")
    if which == "default":
        return store.filter("g IS NOT NULL")
    if which != "graph":
        raise ValueError(f"{which} is neither graph, default, named nor all")
    return store.filter(~_in(graph))


def add(store: DataFrame, source: str | None, target: str | None) -> DataFrame:
    return insert(store, store.filter(_in(source)).withColumn("g", _graph(target)))


def copy(store: DataFrame, source: str | None, target: str | None) -> DataFrame:
    moved = store.filter(_in(source)).withColumn("g", _graph(target))
    return store if source == target else insert(clear(store, target), moved)


def move(store: DataFrame, source: str | None, target: str | None) -> DataFrame:
    return store if source == target else clear(copy(store, source, target), source)


class GraphStore:
    """Named stores of quads as versioned Parquet folders under one root; a pointer file tells the current one."""

    def __init__(self, spark, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.prefixes: dict[str, str] = {}

    def _versions(self, name: str) -> list[int]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = [f.getPath().getName() for f in fs.listStatus(path)]
        return sorted(int(x[1:]) for x in found if x[:1] == "v" and x[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/{x}/_SUCCESS")))

    def names(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []

    def write(self, name: str, quads: DataFrame) -> None:
        """A new version, read only once it is whole; a plan that reads the last one isn't disturbed."""
        version = max(self._versions(name), default=0) + 1
        quads.write.parquet(f"{self.root}/{name}/v{version}")

    def exists(self, name: str) -> bool:
        return bool(self._versions(name))

    def append(self, name: str, quads: DataFrame) -> None:
        """Adds quads to the current version (the first, where there is none); each call is one atomic commit of files."""
        version = max(self._versions(name), default=1)
        quads.write.mode("append").parquet(f"{self.root}/{name}/v{version}")

    def compact(self, name: str) -> None:
        """A new version of the same quads in fewer files."""
        self.write(name, self.read(name))

    def read(self, name: str) -> DataFrame:
        versions = self._versions(name)
        if not versions:
            raise ValueError(f"there is no store named {name}")
        return self.spark.read.parquet(f"{self.root}/{name}/v{versions[-1]}")

    def count(self, name: str) -> int:
        return self.read(name).count()

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@dataclass(frozen=True)
class Dataset:
    """Quads and the names of graphs (g), which exist with or without quads. Each change gives a new dataset."""

    quads: DataFrame
    graphs: DataFrame

    @classmethod
    def of(cls, quads: DataFrame) -> Dataset:
        """A dataset whose graphs are those of the quads."""
        return cls(quads, quads.select("g").filter("g IS NOT NULL").distinct())

    def has(self, graph: str | None) -> bool:
        return graph is None or not self.graphs.filter(F.col("g") == expanded(graph)).isEmpty()

    def _there(self, graph: str | None, silent: bool) -> None:
        if not silent and not self.has(graph):
            raise ValueError(f"there is no graph {graph}")

    def _with(self, quads: DataFrame, *graphs: str | None) -> Dataset:
        named = [(expanded(g),) for g in graphs if g]
        more = self.graphs.unionByName(quads.sparkSession.createDataFrame(named, "g string")).distinct() if named else self.graphs
        return Dataset(quads, more)

    def create(self, graph: str, silent: bool = False) -> Dataset:
        """With a new graph without quads; one that is there is an error unless silent."""
        if not silent and self.has(graph):
            raise ValueError(f"there is a graph {graph}")
        return self._with(self.quads, graph)

    def drop(self, graph: str | None = None, which: str = "graph", silent: bool = False) -> Dataset:
        """Without a graph's quads and its name; which: graph, default, named or all."""
        if which == "graph":
            self._there(graph, silent)
        gone = {"graph": F.col("g") == (expanded(graph) if graph else None), "default": F.lit(False)}.get(which, F.lit(True))
        return Dataset(clear(self.quads, graph, which), self.graphs.filter(~F.coalesce(gone, F.lit(False))))

    def clear(self, graph: str | None = None, which: str = "graph", silent: bool = False) -> Dataset:
        """Without a graph's quads; its name stays."""
        if which == "graph":
            self._there(graph, silent)
        return Dataset(clear(self.quads, graph, which), self.graphs)

    def load(self, triples: DataFrame, graph: str | None = None) -> Dataset:
        """With the triples of a source, read by any reader, in a graph."""
        return self._with(insert(self.quads, triples, graph), graph)

    def insert(self, triples: DataFrame, graph: str | None = None) -> Dataset:
        return self.load(triples, graph)

    def delete(self, triples: DataFrame, graph: str | None = None) -> Dataset:
        return Dataset(delete(self.quads, triples, graph), self.graphs)

    def modify(self, solutions: DataFrame, delete_template: Sequence[tuple] = (), insert_template: Sequence[tuple] = (), graph: str | None = None) -> Dataset:
        out = modify(self.quads, solutions, delete_template, insert_template, graph)
        return self._with(out, graph) if insert_template else Dataset(out, self.graphs)

    def add(self, source: str | None, target: str | None, silent: bool = False) -> Dataset:
        self._there(source, silent)
        return self._with(add(self.quads, source, target), target)

    def copy(self, source: str | None, target: str | None, silent: bool = False) -> Dataset:
        self._there(source, silent)
        return self._with(copy(self.quads, source, target), target)

    def move(self, source: str | None, target: str | None, silent: bool = False) -> Dataset:
        """copy, and then without the source, its name included."""
        out = self.copy(source, target, silent)
        return out if source == target else out.drop(source, "graph" if source else "default", silent=True)


#: Updates by name, with the qualifiers that each has.
OPERATIONS = {
    "insert": {"triples", "graph"}, "delete": {"triples", "graph"}, "modify": {"solutions", "delete_template", "insert_template", "graph"}, "load": {"triples", "graph"},
    "clear": {"graph", "which", "silent"}, "drop": {"graph", "which", "silent"}, "create": {"graph", "silent"}, "add": {"source", "target", "silent"},
    "copy": {"source", "target", "silent"}, "move": {"source", "target", "silent"},
}


def update(store: DataFrame | Dataset, operation: str, **qualifiers) -> DataFrame | Dataset:
    """One update by name; a qualifier that the operation doesn't use is an error. Of a dataset it gives a dataset, of quads quads: these
    have a graph only as long as it has quads."""
    if operation not in OPERATIONS:
        raise ValueError(f"no update: {operation}")
    if unused := set(qualifiers) - OPERATIONS[operation]:
        raise ValueError(f"{operation} doesn't use {sorted(unused)}")
    if isinstance(store, Dataset):
        return getattr(store, operation)(**qualifiers)
    return getattr(Dataset.of(store), operation)(**qualifiers).quads
