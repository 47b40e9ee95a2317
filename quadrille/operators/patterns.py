"""Graph patterns over triples: each gives a DataFrame of solutions, one column a variable, unbound as NULL."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.terms import BNODE, IRI, LABEL, LITERAL, PREFIXES, TYPE, XSD, Iri, Literal, datatype_of_tag, expanded, lang_of_tag, order_keys
from quadrille.plans.fixpoint import bounded_paths, product, reachable, transitive_closure

Triple = tuple["str | Iri", "str | Path", "str | Iri | Literal"]
#: Begins the name of the column that tells a variable's term from others of the same text.
TAG = "__t_"
RESOURCE = "r"


class Path:
    """A property path: built from predicates by / (sequence), | (alternative), ~ (inverse) and the methods below."""

    def __truediv__(self, other: Path | str) -> Path:
        return _Sequence(self, iri(other))

    def __or__(self, other: Path | str) -> Path:
        return _Alternative(self, iri(other))

    def __invert__(self) -> Path:
        return _Inverse(self)

    def plus(self) -> Path:
        return _Closure(self, False)

    def star(self) -> Path:
        return _Closure(self, True)

    def times(self, least: int, most: int | None = None) -> Path:
        """At least `least` and at most `most` steps; without `most`, any number from `least` on."""
        if most is None:
            return self.star() if least == 0 else (self.plus() if least == 1 else _Sequence(_Bounded(self, least - 1, least - 1), self.plus(), True))
        return _Bounded(self, least, most)

    def maybe(self) -> Path:
        return _Bounded(self, 0, 1)

    def pairs(self, triples: DataFrame) -> DataFrame:
        """The pairs (a, b) that the path connects: a set for closures and counted paths, else a bag."""
        raise NotImplementedError

    def between(self, triples: DataFrame, start: str | None, end: str | None) -> DataFrame:
        """The pairs with the given ends (None: any). Closures search from a bound end alone."""
        rows = self.pairs(triples)
        rows = rows if start is None else rows.filter(F.col("a") == start)
        return rows if end is None else rows.filter(F.col("b") == end)


class _Predicate(Path):
    def __init__(self, name: str):
        self.name = TYPE if name == "a" else expanded(name)

    def pairs(self, triples: DataFrame) -> DataFrame:
        return triples.filter(F.col("p") == self.name).select(F.col("s").alias("a"), F.col("o").alias("b"))


class _Sequence(Path):
    def __init__(self, left: Path, right: Path, as_set: bool = False):
        self.left, self.right, self.as_set = left, right, as_set

    def pairs(self, triples: DataFrame) -> DataFrame:
        ahead = self.right.pairs(triples).select(F.col("a").alias("b"), F.col("b").alias("__c"))
        out = self.left.pairs(triples).join(ahead, "b").select("a", F.col("__c").alias("b"))
        return out.distinct() if self.as_set else out

    def between(self, triples: DataFrame, start: str | None, end: str | None) -> DataFrame:
        ahead = self.right.between(triples, None, end).select(F.col("a").alias("b"), F.col("b").alias("__c"))
        out = self.left.between(triples, start, None).join(ahead, "b").select("a", F.col("__c").alias("b"))
        return out.distinct() if self.as_set else out


class _Alternative(Path):
    def __init__(self, left: Path, right: Path):
        self.left, self.right = left, right

    def pairs(self, triples: DataFrame) -> DataFrame:
        return self.left.pairs(triples).unionByName(self.right.pairs(triples))

    def between(self, triples: DataFrame, start: str | None, end: str | None) -> DataFrame:
        return self.left.between(triples, start, end).unionByName(self.right.between(triples, start, end))


class _Inverse(Path):
    def __init__(self, path: Path):
        self.path = path

    def pairs(self, triples: DataFrame) -> DataFrame:
        return self.path.pairs(triples).select(F.col("b").alias("a"), F.col("a").alias("b"))

    def between(self, triples: DataFrame, start: str | None, end: str | None) -> DataFrame:
        return self.path.between(triples, end, start).select(F.col("b").alias("a"), F.col("a").alias("b"))


class _Closure(Path):
    def __init__(self, path: Path, reflexive: bool):
        self.path, self.reflexive = path, reflexive

    def pairs(self, triples: DataFrame) -> DataFrame:
        out = transitive_closure(self.path.pairs(triples))
        if self.reflexive:
            nodes = triples.select(F.explode(F.array("s", "o")).alias("a")).distinct()
            out = out.unionByName(nodes.withColumn("b", F.col("a"))).distinct()
        return out

    def between(self, triples: DataFrame, start: str | None, end: str | None) -> DataFrame:
        if start is None and end is None:
            return self.pairs(triples)
        edges, bound = self.path.pairs(triples), start if start is not None else end
        if start is None:  # from the end, backwards
            edges = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
        found = reachable(edges, triples.sparkSession.createDataFrame([(bound,)], "a string"))
        if self.reflexive:
            found = found.unionByName(triples.sparkSession.createDataFrame([(bound, bound)], "a string, b string")).distinct()
        if start is None:
            return found.select(F.col("b").alias("a"), F.col("a").alias("b"))
        return found if end is None else found.filter(F.col("b") == end)


class _Bounded(Path):
    def __init__(self, path: Path, least: int, most: int):
        self.path, self.least, self.most = path, least, most

    def pairs(self, triples: DataFrame) -> DataFrame:
        out = bounded_paths(self.path.pairs(triples), max(self.least, 1), self.most) if self.most else None
        if self.least == 0:
            nodes = triples.select(F.explode(F.array("s", "o")).alias("a")).distinct()
            same = nodes.withColumn("b", F.col("a"))
            out = same if out is None else out.unionByName(same).distinct()
        return out


class _Except(Path):
    def __init__(self, names: Sequence[str]):
        self.names = [TYPE if n == "a" else expanded(n) for n in names]

    def pairs(self, triples: DataFrame) -> DataFrame:
        return triples.filter(~F.col("p").isin(self.names)).select(F.col("s").alias("a"), F.col("o").alias("b"))


def iri(name: str | Path) -> Path:
    return name if isinstance(name, Path) else _Predicate(name)


def none_of(*names: str) -> Path:
    """Any predicate but those named."""
    return _Except(names)


def is_variable(term: object) -> bool:
    return isinstance(term, str) and term.startswith("?")


def is_hidden(term: object) -> bool:
    """Blank nodes of a pattern join like variables but aren't part of a solution."""
    return isinstance(term, str) and term.startswith("_:")


def object_tag(triples: DataFrame) -> Column:
    """What tells an object from others of the same text: r of IRIs and blank nodes; of literals a quote and their language or datatype.

    Languages don't depend on case, and xsd:string is the same as no datatype.
    """
    none = F.lit(None).cast("string")
    lang = F.col("o_lang") if "o_lang" in triples.columns else none
    dt = F.col("o_dt") if "o_dt" in triples.columns else none
    literal = F.concat(F.lit('"'), F.when(lang.isNotNull(), F.concat(F.lit("@"), F.lower(lang))).when(dt != f"{XSD}string", F.concat(F.lit("^"), dt)).otherwise(F.lit("")))
    return F.when(F.col("o_kind") == LITERAL, literal).otherwise(F.lit(RESOURCE))


def _resource(name: str) -> bool:
    head, mark, _ = name.partition(":")
    return bool(mark) and (head in PREFIXES or head in ("urn", "http", "https", "mailto", "file", "_"))


def constant(term: str | Literal | Iri) -> tuple[str, tuple[str, ...]]:
    """Text and possible tags of a pattern's constant. A text that looks like an IRI or a prefixed name is a resource;
    any other may be a resource or a plain literal, which Iri and Literal tell apart."""
    if isinstance(term, (Literal, Iri)):
        return term.text, (term.tag,)
    return (expanded(term), (RESOURCE,)) if _resource(term) else (term, (RESOURCE, '"'))


#: Keep the parts of a node's name apart while paths are followed.
GRAPH_END, TAG_END = "\x1d", "\x1f"


def _after(text: Column, mark: str) -> Column:
    return F.substring(text, F.instr(text, F.lit(mark)) + 1, F.length(text))


def _path_rows(triples: DataFrame, triple: Triple, graph: str | None) -> DataFrame:
    """Solutions of a path pattern. A path never leaves its graph, and ends at a literal only as the same term."""
    s, path, o = triple
    typed, rows = "o_kind" in triples.columns, triples
    by_graph = is_variable(graph)
    if graph is not None:
        rows = rows.filter("g IS NOT NULL") if by_graph else rows.filter(F.col("g") == expanded(graph))
    node = F.when(F.col("o_kind") == LITERAL, F.concat(object_tag(triples), F.lit(TAG_END), F.col("o"))).otherwise(F.col("o")) if typed else F.col("o")
    inside = (lambda x: F.concat(F.col("g"), F.lit(GRAPH_END), x)) if by_graph else (lambda x: x)
    rows = rows.select(inside(F.col("s")).alias("s"), "p", inside(node).alias("o"))

    def bound(term) -> str | None:
        if is_variable(term) or is_hidden(term):
            return None
        text, tags = constant(term)
        return text if not typed or RESOURCE in tags else f"{tags[0]}{TAG_END}{text}"

    start, end = bound(s), bound(o)
    pairs = path.pairs(rows) if by_graph else path.between(rows, start, end)
    if by_graph:
        pairs = pairs.select(F.substring_index("a", GRAPH_END, 1).alias("g"), _after(F.col("a"), GRAPH_END).alias("a"), _after(F.col("b"), GRAPH_END).alias("b"))
        for column, value in (("a", start), ("b", end)):
            pairs = pairs if value is None else pairs.filter(F.col(column) == value)
    if s == o and start is None:
        pairs = pairs.filter("a = b")
    out = []
    for column, term in (("a", s), ("b", o)) if s != o else (("a", s),):
        if is_variable(term) or is_hidden(term):
            name, literal = _name(term), F.instr(F.col(column), F.lit(TAG_END)) > 0
            out.append((F.when(literal, _after(F.col(column), TAG_END)).otherwise(F.col(column)) if typed else F.col(column)).alias(name))
            if typed:
                out.append(F.when(literal, F.substring_index(column, TAG_END, 1)).otherwise(F.lit(RESOURCE)).alias(TAG + name))
    if by_graph:
        out.append(F.col("g").alias(graph[1:]))
        out += [F.lit(RESOURCE).alias(TAG + graph[1:])] if typed else []
    return pairs.select(out)


def _name(term: str) -> str:
    return term[1:] if is_variable(term) else "__blank" + term[2:]


def triple_rows(triples: DataFrame, triple: Triple, graph: str | None = None) -> DataFrame:
    """Solutions of one triple pattern. Constants filter the scan; a repeated variable means equality.

    Where the triples tell kinds, datatypes and languages of objects (o_kind, o_dt, o_lang), terms are
    compared whole: each variable has a column TAG + its name beside it.
    """
    s, p, o = triple
    if isinstance(p, Path):
        return _path_rows(triples, triple, graph)
    typed, rows = "o_kind" in triples.columns, triples
    tags = {"o": object_tag(triples) if typed else None}
    places = [("s", s), ("p", TYPE if p == "a" else p), ("o", o)]
    if graph is not None:
        places.append(("g", graph))
        rows = rows.filter("g IS NOT NULL") if is_variable(graph) else rows
    names: dict[str, str] = {}
    for column, term in places:
        if not (is_variable(term) or is_hidden(term)):
            text, fits = constant(term)
            rows = rows.filter(F.col(column) == text)
            rows = rows.filter(tags["o"].isin(list(fits))) if column == "o" and typed else rows
        elif term in names:
            rows = rows.filter(F.col(column) == F.col(names[term]))
            rows = rows.filter(tags["o"] == RESOURCE) if typed and "o" in (column, names[term]) else rows
        else:
            names[term] = column
    out = [F.col(c).alias(_name(t)) for t, c in names.items()]
    if typed:
        out += [(tags["o"] if c == "o" else F.lit(RESOURCE)).alias(TAG + _name(t)) for t, c in names.items()]
    return rows.select(out)


def untagged(solutions: DataFrame) -> DataFrame:
    """Solutions without the columns that tell terms of one text apart."""
    return solutions.drop(*[c for c in solutions.columns if c.startswith(TAG)])


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner", unbound: Sequence[str] = (), on: Column | None = None, allow_product: bool = False) -> DataFrame:
    """Joins on all shared variables. Those in `unbound` may be NULL on a side, which fits any value.

    Without shared variables EXISTS asks whether right has any row; joins are products, and have to be allowed.
    """
    shared = [c for c in left.columns if c in right.columns]
    loose = [c for c in shared if c in unbound or c.removeprefix(TAG) in unbound]
    if not shared and on is None:
        if how in ("left_semi", "left_anti"):
            return left if right.isEmpty() == (how == "left_anti") else left.filter(F.lit(False))
        if not allow_product:
            raise ValueError("patterns without a shared variable: give a condition (theta), or allow a product")
        return product(left, right, how)
    other = right.withColumnsRenamed({c: f"__r_{c}" for c in shared})
    fits = F.lit(True)
    for c in shared:
        same = F.col(c) == F.col(f"__r_{c}")
        fits = fits & ((same | F.col(c).isNull() | F.col(f"__r_{c}").isNull()) if c in loose else same)
    out = left.join(other, fits if on is None else fits & on, how)
    if how in ("left_semi", "left_anti"):
        return out
    kept = [F.coalesce(c, f"__r_{c}").alias(c) if c in loose else F.col(c) for c in left.columns]
    return out.select(*kept, *[c for c in right.columns if c not in shared])


def bgp(triples: DataFrame, *patterns: Triple, graph: str | None = None, keep_hidden: bool = False, terms: bool = False, allow_product: bool = False) -> DataFrame:
    """Solutions of a basic graph pattern: patterns joined on all variables that they share, in the order
    in which neighbours share some; Catalyst picks and reorders the physical joins.

    With `terms` the solutions keep their tags, so that joins with other solutions compare whole terms too.
    """
    left = [*patterns]
    out = triple_rows(triples, left.pop(0), graph)
    while left:
        names = set(out.columns)
        rows = [triple_rows(triples, t, graph) for t in left]
        at = next((i for i, r in enumerate(rows) if names & set(r.columns)), 0)
        out = natural_join(out, rows[at], allow_product=allow_product) if rows[at].columns else out.filter(F.lit(not rows[at].isEmpty()))
        left.pop(at)
    out = out if keep_hidden else out.drop(*[c for c in out.columns if c.removeprefix(TAG).startswith("__blank")])
    return out if terms else untagged(out)


def bgp_counts(triples: DataFrame, *patterns: Triple, by: Sequence[str] = (), graph: str | None = None, allow_product: bool = False) -> DataFrame:
    """(by..., n): how many solutions of a basic graph pattern each binding of the variables `by` has; n is all of them without `by`.

    Solutions are never made: each pattern is counted by those of its variables that others share or `by` names before it meets them, so
    k triples of one value are one row. Counts multiply where patterns meet.
    """
    every = [triple_rows(triples, t, graph) for t in patterns]
    left = [r for r in every if r.columns]
    if not left or (missing := set(by) - {c for r in left for c in r.columns}):
        raise ValueError(f"not bound by the patterns: {sorted(missing) if left else list(patterns)}")

    def counted(rows: DataFrame, n: Column, others: Sequence[DataFrame]) -> DataFrame:
        wanted = {*by, *(c for r in others for c in r.columns)}
        return rows.groupBy(*[c for c in rows.columns if c in wanted]).agg(F.sum(n).alias("__n")).filter("__n IS NOT NULL")

    first = left.pop(0)
    out = counted(first, F.lit(1), left)
    while left:
        at = next((i for i, r in enumerate(left) if set(out.columns) & set(r.columns)), 0)
        rows = left.pop(at)
        more = counted(rows, F.lit(1), [out, *left]).withColumnRenamed("__n", "__m")
        met = natural_join(out, more, allow_product=allow_product)
        out = counted(met, F.col("__n") * F.col("__m"), left)
    for rows in every:
        out = out if rows.columns else out.filter(F.lit(not rows.isEmpty()))
    out = out.groupBy(*by).agg(F.sum("__n").alias("n"))
    return out if by else out.select(F.coalesce("n", F.lit(0)).alias("n"))


def about(subject: str, *pairs: tuple[str | Path, str]) -> list[Triple]:
    """Patterns with one subject."""
    return [(subject, p, o) for p, o in pairs]


def optional(left: DataFrame, right: DataFrame, on: Column | None = None, unbound: Sequence[str] = (), allow_product: bool = False) -> DataFrame:
    """Left join; a filter within the optional part belongs to the condition `on`."""
    return natural_join(left, right, "left", unbound, on, allow_product)


def minus(left: DataFrame, right: DataFrame, unbound: Sequence[str] = ()) -> DataFrame:
    """Rows of left that no row of right fits with at least one shared bound variable."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        return left
    loose = [c for c in shared if c in unbound or c.removeprefix(TAG) in unbound]
    if not loose:
        return natural_join(left, right, "left_anti")
    other = right.withColumnsRenamed({c: f"__r_{c}" for c in shared})
    fits, some = F.lit(True), F.lit(False)
    for c in shared:
        same = F.coalesce(F.col(c) == F.col(f"__r_{c}"), F.lit(False))
        fits, some = fits & ((same | F.col(c).isNull() | F.col(f"__r_{c}").isNull()) if c in loose else same), some | same
    return left.join(other, fits & some, "left_anti")


def exists(left: DataFrame, right: DataFrame) -> DataFrame:
    return natural_join(left, right, "left_semi")


def not_exists(left: DataFrame, right: DataFrame) -> DataFrame:
    return natural_join(left, right, "left_anti")


def union(*solutions: DataFrame) -> DataFrame:
    """Bag union; variables that a part lacks are unbound in its rows."""
    out = solutions[0]
    for s in solutions[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def theta(left: DataFrame, right: DataFrame, key: str, condition: Column) -> DataFrame:
    """Inner join on a shared variable and a further comparison across the patterns. Without the shared one a side has to be small."""
    return natural_join(left, right, "inner", (), condition) if key in left.columns and key in right.columns else product(left, right).filter(condition)


def values(spark, rows: Sequence[Mapping[str, str | None]]) -> DataFrame:
    names = sorted({k for r in rows for k in r})
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"{n} string" for n in names))


def in_graphs(quads: DataFrame, *graphs: str) -> DataFrame:
    """The merge of the named graphs, as a set of triples."""
    return quads.filter(F.col("g").isin([expanded(g) for g in graphs])).drop("g").distinct()


def flattened(solutions: DataFrame, name: str = "value") -> DataFrame:
    """All values of all rows in one column."""
    return solutions.select(F.explode(F.array(*[F.col(c).cast("string") for c in solutions.columns])).alias(name))


def with_labels(solutions: DataFrame, triples: DataFrame, *variables: str, suffix: str = "_label") -> DataFrame:
    """An inner join with rdfs:label: rows without a label go, rows with several multiply."""
    for v in variables:
        labels = triples.filter(F.col("p") == LABEL).select(F.col("s").alias(v), F.col("o").alias(v + suffix))
        solutions = solutions.join(labels, v)
    return solutions


def construct(solutions: DataFrame, *template: Triple) -> DataFrame:
    """Triples of a template for each solution, as a set. Incomplete ones are left out; a blank node of the
    template is a new one for each distinct solution.

    From solutions with tags (terms=True) triples keep whole terms, with o_kind, o_dt and o_lang; those with a literal as
    subject or predicate are left out. Constants may be Literal or Iri.
    """
    typed = any(c.startswith(TAG) for c in solutions.columns)
    new = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(solutions.columns)])

    def term(t: str | Literal | Iri, place: str = "") -> tuple[Column, Column]:
        if is_variable(t):
            return F.col(t[1:]).cast("string"), F.col(TAG + t[1:]) if TAG + t[1:] in solutions.columns else F.lit(RESOURCE)
        if is_hidden(t):
            return F.concat(F.lit("urn:blank:"), F.sha1(F.concat(F.lit(t), new))), F.lit(RESOURCE)
        if t == "a" and place == "p":
            return F.lit(TYPE), F.lit(RESOURCE)
        text, tags = constant(t)
        return F.lit(text if typed or not isinstance(t, str) else expanded(t)), F.lit(tags[-1] if place == "o" else RESOURCE)

    def triple(s, p, o) -> Column:
        (s, s_tag), (p, p_tag), (o, o_tag) = term(s), term(p, "p"), term(o, "o")
        columns = [s.alias("s"), p.alias("p"), o.alias("o")]
        if typed:
            blank = o.startswith("urn:blank:") | o.startswith("_:")
            kind = F.when(o_tag != RESOURCE, LITERAL).when(blank, BNODE).otherwise(IRI).cast("tinyint")
            lang, dt = F.nullif(lang_of_tag(o_tag), F.lit("")), F.when(o_tag.startswith('"^'), datatype_of_tag(o_tag))
            columns += [kind.alias("o_kind"), dt.alias("o_dt"), lang.alias("o_lang"), ((s_tag == RESOURCE) & (p_tag == RESOURCE)).alias("fits")]
        return F.struct(*columns)

    rows = solutions.select(F.explode(F.array(*[triple(*t) for t in template])).alias("t")).select("t.*").dropna(subset=["s", "p", "o"])
    return (rows.filter("fits").drop("fits") if typed else rows).distinct()


def describe(triples: DataFrame, resource: str) -> DataFrame:
    name = expanded(resource)
    return triples.filter((F.col("s") == name) | (F.col("o") == name))


def ask(solutions: DataFrame) -> bool:
    return not solutions.isEmpty()


def ordered(solutions: DataFrame, variable: str, descending: bool = False) -> DataFrame:
    """SPARQL's order of terms, by the variable's tag; without one, all bound terms are IRIs."""
    text, tag = F.col(variable), TAG + variable
    if tag in solutions.columns:
        blank = text.startswith("urn:blank:") | text.startswith("_:")
        kind = F.when(text.isNull(), None).when(F.col(tag) != RESOURCE, LITERAL).when(blank, BNODE).otherwise(IRI)
        keys = order_keys(kind, text, datatype_of_tag(F.col(tag)))
        keys.append(F.coalesce(lang_of_tag(F.col(tag)), F.lit("")))
    else:
        keys = order_keys(F.when(text.isNotNull(), F.lit(IRI)), text, F.lit(None).cast("string"))
    return solutions.orderBy(*[F.desc(k) if descending else F.asc(k) for k in keys])


def terms_of(solutions: DataFrame, *variables: str) -> DataFrame:
    """The variables as structs of text, kind, datatype and language, from solutions with tags."""
    out = solutions
    for v in variables:
        tag = F.col(TAG + v)
        kind = F.when(tag != RESOURCE, LITERAL).when(F.col(v).startswith("urn:blank:"), BNODE).otherwise(IRI)
        out = out.withColumn(v, F.when(F.col(v).isNotNull(), F.struct(F.col(v).alias("text"), kind.alias("kind"), datatype_of_tag(tag).alias("datatype"), lang_of_tag(tag).alias("lang"))))
    return untagged(out)


def select(
    triples: DataFrame, where: Sequence[Triple] | Callable[[DataFrame], DataFrame], variables: Sequence[str] = (), backend: Callable[[DataFrame], DataFrame] | None = None,
    distinct: bool = False, count: bool = False, flatten: bool = False, order: str | None = None, limit: int | None = None, offset: int = 0,
) -> DataFrame:
    """One query: patterns (or a function of the graph) over what the backend makes of the triples, as entailments.

    variables: the columns to return, all without. Then in this order: distinct, order by a variable, offset
    and limit; `count` gives the number of rows instead, `flatten` one column of all values.
    """
    graph = backend(triples) if backend else triples
    out = where(graph) if callable(where) else bgp(graph, *where, terms=True)
    if variables:
        out = out.select(*[c for v in variables for c in (v, TAG + v) if c in out.columns])
    out = out.distinct() if distinct else out
    out = ordered(out, order) if order else out
    out = untagged(out)
    out = out.offset(offset) if offset else out
    out = out if limit is None else out.limit(limit)
    if count:
        return out.agg(F.count("*").alias("n"))
    return flattened(out) if flatten else out


def expression_instances(triples: DataFrame, expression: tuple | str) -> DataFrame:
    """The stated instances (x) of a class expression: a name, ("and", ...), ("or", ...), ("not", e) within an "and",
    ("some", property, e), ("value", property, individual), ("min", n, property, e) or ("one", individual, ...)."""
    if isinstance(expression, str):
        return bgp(triples, ("?x", "a", expression)).distinct()
    op, *rest = expression
    if op == "one":
        return values(triples.sparkSession, [{"x": expanded(r)} for r in rest]).distinct()
    if op == "value":
        return bgp(triples, ("?x", rest[0], rest[1])).distinct()
    if op in ("some", "min"):
        p, inner = (rest[0], rest[1]) if op == "some" else (rest[1], rest[2])
        links = bgp(triples, ("?x", p, "?y"))
        links = links if inner in ("owl:Thing", None) else links.join(expression_instances(triples, inner).withColumnRenamed("x", "y"), "y", "left_semi")
        return links.select("x").distinct() if op == "some" else links.groupBy("x").agg(F.count_distinct("y").alias("n")).filter(F.col("n") >= rest[0]).select("x")
    if op == "or":
        out = expression_instances(triples, rest[0])
        for e in rest[1:]:
            out = out.unionByName(expression_instances(triples, e))
        return out.distinct()
    if op == "and":
        first, *others = sorted(rest, key=lambda e: e[0] == "not")
        out = expression_instances(triples, first)
        for e in others:
            negative = e[0] == "not"
            out = out.join(expression_instances(triples, e[1] if negative else e), "x", "left_anti" if negative else "left_semi")
        return out
    raise ValueError(f"{op} needs a positive expression beside it" if op == "not" else f"no class expression: {op}")


def external_terms(terms: DataFrame, templates: DataFrame, query: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """terms(term, ontology) under the templates(pattern, template) whose pattern their ontology matches,
    in one query. The templates, a handful by nature, are checked to be few and go to all tasks."""
    return query(product(terms, templates).filter(F.expr("ontology RLIKE pattern")))


def paged(solutions: DataFrame, keys: Sequence[str], size: int, after: Sequence[str] | None = None) -> DataFrame:
    """The next `size` rows in the order of keys, which tell rows apart, after the last page's last key: no page is read twice
    and none is missed, whatever the layout."""
    rows = solutions
    if after is not None:
        later, same = F.lit(False), F.lit(True)
        for k, v in zip(keys, after, strict=True):
            later, same = later | (same & (F.col(k) > v)), same & (F.col(k) == v)
        rows = rows.filter(later)
    return rows.orderBy(*keys).limit(size)
