"""Axiom sets as rows (ont, axiom_id, axiom_type, is_logical, sexpr, symbols): filters, rewrites, diffs, modules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadrille.functions.terms import OWL, RDFS, SUBCLASS, SUBPROPERTY, TYPE
from quadrille.operators.mapping import triples_of
from quadrille.operators.trees import shape
from quadrille.plans.fixpoint import transitive_closure
from quadrille.plans.stages import stored

SCHEMA = "ont string, axiom_id string, axiom_type string, is_logical boolean, sexpr string, symbols array<string>"
#: Axiom types that carry no logic.
ANNOTATION_TYPES = ("Declaration", "AnnotationAssertion", "SubAnnotationPropertyOf", "AnnotationPropertyDomain", "AnnotationPropertyRange")
TYPES = (
    *ANNOTATION_TYPES, "SubClassOf", "EquivalentClasses", "DisjointClasses", "DisjointUnion", "SubObjectPropertyOf", "EquivalentObjectProperties", "DisjointObjectProperties",
    "InverseObjectProperties", "ObjectPropertyDomain", "ObjectPropertyRange", "FunctionalObjectProperty", "InverseFunctionalObjectProperty", "ReflexiveObjectProperty",
    "IrreflexiveObjectProperty", "SymmetricObjectProperty", "AsymmetricObjectProperty", "TransitiveObjectProperty", "SubDataPropertyOf", "EquivalentDataProperties",
    "DisjointDataProperties", "DataPropertyDomain", "DataPropertyRange", "FunctionalDataProperty", "DatatypeDefinition", "HasKey", "SameIndividual", "DifferentIndividuals",
    "ClassAssertion", "ObjectPropertyAssertion", "NegativeObjectPropertyAssertion", "DataPropertyAssertion", "NegativeDataPropertyAssertion", "Rule",
)


def axiom_rows(df: DataFrame, kind: Column | str, *args: Column, ont: str = "main") -> DataFrame:
    """Axioms of a type with one or two terms each, from the rows of a table."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    text = F.concat(F.lit("("), F.concat_ws(" ", kind, *args), F.lit(")"))
    return df.select(
        F.lit(ont).alias("ont"), F.sha1(text).alias("axiom_id"), kind.alias("axiom_type"), (~kind.isin(list(ANNOTATION_TYPES))).alias("is_logical"),
        text.alias("sexpr"), F.array_distinct(F.array(*args)).alias("symbols"),
    )


def of_types(axioms: DataFrame, *types: str) -> DataFrame:
    if unknown := set(types) - set(TYPES):
        raise ValueError(f"no axiom types: {sorted(unknown)}")
    return axioms.filter(F.col("axiom_type").isin(list(types)))


def imports_closure(axioms: DataFrame, imports: DataFrame, ont: str) -> DataFrame:
    """Axioms of an ontology and all that it imports; imports: the closed (a, b)."""
    inside = imports.filter(F.col("a") == ont).select(F.col("b").alias("ont"))
    return axioms.filter(F.col("ont") == ont).unionByName(axioms.join(inside, "ont", "left_semi").select(axioms.columns))


def only_subclasses(axioms: DataFrame) -> DataFrame:
    """Simple subclass axioms (two named classes), declarations and annotations."""
    simple = (F.col("axiom_type") == "SubClassOf") & F.col("sexpr").rlike(r"^\(SubClassOf [^\s()]+ [^\s()]+\)$")
    return axioms.filter(simple | F.col("axiom_type").isin("Declaration", "AnnotationAssertion"))


def is_simple(axioms: DataFrame, kind: str) -> DataFrame:
    """Axioms of the kind (SubClassOf, EquivalentClasses) that relate two named classes."""
    return axioms.filter((F.col("axiom_type") == kind) & F.col("sexpr").rlike(rf"^\({kind} [^\s()]+ [^\s()]+\)$"))


def subclasses_and_values(axioms: DataFrame) -> DataFrame:
    """Simple subclass axioms, declarations and annotations, and subclass axioms of a named class and a hasValue restriction."""
    value = (F.col("axiom_type") == "SubClassOf") & F.col("sexpr").rlike(r"^\(SubClassOf [^\s()]+ \((?:Object|Data)HasValue [^()]*\)\)$")
    return only_subclasses(axioms).unionByName(axioms.filter(value))


def branch(axioms: DataFrame, nodes: DataFrame) -> DataFrame:
    """Axioms about a branch's nodes(node), those whose first symbol is among them."""
    return axioms.join(nodes.select(F.col("node").alias("__h")).distinct(), F.get("symbols", F.lit(0)) == F.col("__h"), "left_semi")


def weakened(axioms: DataFrame, keep_assertions: bool = True) -> DataFrame:
    """Simple subclass axioms, declarations and annotations, with class assertions unless they are to go."""
    out = only_subclasses(axioms)
    return out.unionByName(of_types(axioms, "ClassAssertion")) if keep_assertions else out


def without_types(axioms: DataFrame, *types: str) -> DataFrame:
    return axioms.filter(~F.col("axiom_type").isin(list(types)))


def equivalents_to_subclasses(axioms: DataFrame) -> DataFrame:
    """Each EquivalentClasses of two named classes as a SubClassOf of the first in the second; others stay."""
    pair = r"^\(EquivalentClasses ([^\s()]+) ([^\s()]+)\)$"
    hit = (F.col("axiom_type") == "EquivalentClasses") & F.col("sexpr").rlike(pair)
    text = F.when(hit, F.regexp_replace("sexpr", pair, "(SubClassOf $1 $2)")).otherwise(F.col("sexpr"))
    return axioms.withColumns({"axiom_type": F.when(hit, "SubClassOf").otherwise(F.col("axiom_type")), "axiom_id": F.when(hit, F.sha1(text)).otherwise(F.col("axiom_id")), "sexpr": text})


def simplified_equivalents(parts: DataFrame) -> DataFrame:
    """For A = (B and C and ...) as parts(a, b), one SubClassOf for each part. Parts, not the wider axioms, are made distinct: a row of
    an axiom tells its two parts."""
    return axiom_rows(parts.select("a", "b").distinct(), "SubClassOf", F.col("a"), F.col("b"))


def without_cardinality(axioms: DataFrame) -> DataFrame:
    return axioms.filter(~F.col("sexpr").rlike(r"\((?:Object|Data)(?:Min|Max|Exact)Cardinality\b"))


def within_signature(axioms: DataFrame, terms: DataFrame) -> DataFrame:
    """Axioms all of whose symbols are among terms(iri)."""
    used = axioms.select("axiom_id", F.explode("symbols").alias("iri"))
    outside = used.join(terms, "iri", "left_anti").select("axiom_id").distinct()
    return axioms.join(outside, "axiom_id", "left_anti")


def with_keywords(triples: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Triples with :keywords replaced by their IRIs; a keyword without one fails the job that writes the triples."""
    known = F.create_map(*[F.lit(x) for k, v in names.items() for x in (f":{k}", v)]) if names else None
    out = triples
    for c in ("s", "p", "o"):
        missing = F.raise_error(F.concat(F.lit("unresolved keyword "), F.col(c))).cast("string")
        named = missing if known is None else F.coalesce(F.try_element_at(known, F.col(c)), missing)
        out = out.withColumn(c, F.when(F.col(c).rlike(r"^:[^:/\s]+$"), named).otherwise(F.col(c)))
    return out


def referencing(axioms: DataFrame, terms: DataFrame) -> DataFrame:
    """Axioms that mention one of terms(iri)."""
    used = axioms.select("axiom_id", F.explode("symbols").alias("iri")).join(terms, "iri", "left_semi").select("axiom_id").distinct()
    return axioms.join(used, "axiom_id", "left_semi")


def split_by(rows: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Rows for which the condition holds, and all others (also where it is NULL)."""
    hit = F.coalesce(condition, F.lit(False))
    return rows.filter(hit), rows.filter(~hit)


def split_deprecated(axioms: DataFrame, triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = triples.filter((F.col("p") == f"{OWL}deprecated") & (F.col("o") == "true")).select(F.col("s").alias("iri"))
    hit = referencing(axioms, gone)
    return hit, axioms.join(hit.select("axiom_id"), "axiom_id", "left_anti")


def merged(*ontologies: DataFrame, ont: str = "merged") -> DataFrame:
    out = ontologies[0]
    for o in ontologies[1:]:
        out = out.unionByName(o)
    return out.withColumn("ont", F.lit(ont)).dropDuplicates(["axiom_id"])


def diff(first: DataFrame, second: DataFrame, key: Sequence[str] = ("axiom_id",)) -> DataFrame:
    """(key..., side): only_1, only_2 or both, from one full outer join of the key sets."""
    a, b = first.select(*key).distinct().withColumn("__a", F.lit(True)), second.select(*key).distinct().withColumn("__b", F.lit(True))
    side = F.when(F.col("__b").isNull(), "only_1").when(F.col("__a").isNull(), "only_2").otherwise("both")
    return a.join(b, list(key), "full_outer").select(*key, side.alias("side"))


def shapes(axioms: DataFrame, examples: int = 3) -> DataFrame:
    """(shape, n, examples): axioms with their names replaced by place holders, and the first texts of each shape.

    A name is what doesn't begin a form, however it is spelt. First texts are chosen in each task before a shape's rows meet.
    """
    rows = axioms.select(shape("sexpr").alias("shape"), "sexpr")
    first = rows.distinct().withColumn("part", F.pmod(F.xxhash64("sexpr"), F.lit(64)))
    for key in (["shape", "part"], ["shape"]):
        first = first.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("sexpr"))).filter(F.col("n") <= examples)
    texts = first.groupBy("shape").agg(F.array_sort(F.collect_list("sexpr")).alias("examples"))
    return rows.groupBy("shape").agg(F.count("*").alias("n")).join(texts, "shape")


def rewritten_iris(triples: DataFrame, mapping: DataFrame, columns: Sequence[str] = ("s", "p", "o")) -> DataFrame:
    """Subjects, predicates and objects replaced through mapping(iri, new); others stay. AQE broadcasts a small map."""
    out = triples
    for c in columns:
        named = mapping.select(F.col("iri").alias(c), F.col("new").alias("__new"))
        out = out.join(named, c, "left").withColumn(c, F.coalesce("__new", c)).drop("__new")
    return out.select(triples.columns)


def minted(terms: DataFrame, taken: DataFrame, base: str, width: int = 7) -> DataFrame:
    """(iri, new): numbered IRIs for terms(iri), in their order, that collide with none of taken(iri)."""
    used = taken.filter(F.col("iri").startswith(base)).select(F.regexp_extract("iri", r"(\d+)$", 1).try_cast("long").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("last"))
    ranges = stored(terms.select("iri").distinct().repartitionByRange("iri").withColumn("__part", F.spark_partition_id()), "minting")
    place = F.row_number().over(Window.partitionBy("__part").orderBy("iri"))
    sizes = ranges.groupBy("__part").agg(F.count("*").alias("n"))
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))  # one row for each partition
    last = used.first()["last"]
    return ranges.withColumn("__n", place).join(F.broadcast(before), "__part").select("iri", F.concat(F.lit(base), F.lpad((F.col("__n") + F.col("__before") + last).cast("string"), width, "0")).alias("new"))


#: Names that ontologies may not declare.
RESERVED = ("http://www.w3.org/2002/07/owl#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2001/XMLSchema#")


KINDS = ("Class", "ObjectProperty", "DatatypeProperty", "AnnotationProperty", "NamedIndividual")
#: Properties of these characteristics, and those in these axioms, have to be simple: neither transitive nor above a transitive one.
SIMPLE_ONLY = ("FunctionalProperty", "InverseFunctionalProperty", "IrreflexiveProperty", "AsymmetricProperty")
CARDINALITIES = [f"{OWL}{n}" for n in ("minCardinality", "maxCardinality", "cardinality", "minQualifiedCardinality", "maxQualifiedCardinality", "qualifiedCardinality")]


def profile_violations(triples: DataFrame) -> DataFrame:
    """(violation, iri), of the kinds that triples of named terms tell: undeclared classes and properties, names of several kinds
    or of a class and a datatype, reserved names, names that aren't absolute, properties that have to be simple and aren't,
    anonymous individuals, the top data property below another, cycles of datatype definitions."""
    p, o = F.col("p"), F.col("o")
    declared = triples.filter((p == TYPE) & o.isin([f"{OWL}{k}" for k in KINDS])).select(F.col("s").alias("iri"), F.col("o").alias("kind")).distinct()
    of = lambda k: declared.filter(F.col("kind") == f"{OWL}{k}").select("iri")
    anonymous = lambda c: F.col(c).startswith("urn:blank:")
    reserved = lambda c: F.coalesce(F.array_max(F.array(*[F.col(c).startswith(r) for r in RESERVED])), F.lit(False))
    found: list[tuple[str, DataFrame]] = []
    classes = triples.filter(p == SUBCLASS).select(F.explode(F.array("s", "o")).alias("iri")).distinct()
    found.append(("undeclared class", classes.filter(~anonymous("iri") & ~reserved("iri")).join(of("Class"), "iri", "left_anti")))
    properties = of("ObjectProperty").unionByName(of("DatatypeProperty")).unionByName(of("AnnotationProperty"))
    used = triples.filter(p == f"{OWL}onProperty").select(o.alias("iri")).distinct()
    found.append(("undeclared property", used.filter(~reserved("iri") & ~anonymous("iri")).join(properties, "iri", "left_anti")))
    found.append(("several kinds", declared.groupBy("iri").agg(F.count("*").alias("n")).filter("n > 1").select("iri")))
    found.append(("reserved name", declared.filter(reserved("iri")).select("iri").distinct()))
    datatypes = triples.filter((p == TYPE) & (o == f"{RDFS}Datatype")).select(F.col("s").alias("iri")).distinct()
    found.append(("class and datatype", datatypes.join(of("Class"), "iri", "left_semi")))
    headers = triples.filter((p == TYPE) & (o == f"{OWL}Ontology")).select(F.col("s").alias("iri")).unionByName(triples.filter(p == f"{OWL}versionIRI").select(o.alias("iri"))).distinct()
    found.append(("ontology name not absolute", headers.filter(~F.col("iri").rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"))))
    found.append(("reserved ontology name", headers.filter(reserved("iri"))))
    transitive = triples.filter((p == TYPE) & (o == f"{OWL}TransitiveProperty")).select(F.col("s").alias("iri")).distinct()
    above = transitive_closure(triples.filter(p == SUBPROPERTY).select(F.col("s").alias("a"), o.alias("b")))
    composed = transitive.unionByName(above.join(transitive.select(F.col("iri").alias("a")), "a", "left_semi").select(F.col("b").alias("iri"))).distinct()
    flagged = triples.filter((p == TYPE) & o.isin([f"{OWL}{k}" for k in SIMPLE_ONLY])).select(F.col("s").alias("iri"))
    counted = triples.filter(p.isin(CARDINALITIES)).select("s").join(triples.filter(p == f"{OWL}onProperty").select("s", o.alias("iri")), "s").select("iri")
    apart = triples.filter(p == f"{OWL}propertyDisjointWith").select(F.explode(F.array("s", "o")).alias("iri"))
    for name, rows in (("not simple in a characteristic", flagged), ("not simple in a cardinality", counted), ("not simple in a disjointness", apart)):
        found.append((name, rows.distinct().join(composed, "iri", "left_semi")))
    structural = triples.filter((p == TYPE) & o.startswith(OWL)).select("s").distinct()
    found.append(("anonymous individual", triples.filter((p == TYPE) & anonymous("s") & ~reserved("o")).select("s").distinct().join(structural, "s", "left_anti").select(F.col("s").alias("iri"))))
    found.append(("top data property below another", triples.filter((p == SUBPROPERTY) & (F.col("s") == f"{OWL}topDataProperty") & (o != f"{OWL}topDataProperty")).select(F.col("s").alias("iri")).distinct()))
    defined = triples.filter(p == f"{OWL}equivalentClass").join(datatypes.withColumnRenamed("iri", "s"), "s", "left_semi").select(F.col("s").alias("a"), o.alias("b"))
    found.append(("cycle of datatypes", transitive_closure(defined).filter("a = b").select(F.col("a").alias("iri"))))
    return reduce(DataFrame.unionByName, [rows.select(F.lit(name).alias("violation"), "iri") for name, rows in found])


def exemplars(violations: DataFrame) -> DataFrame:
    """One row for each kind of violation, and their number."""
    return violations.groupBy("violation").agg(F.min("iri").alias("iri"), F.count("*").alias("n"))


def to_triples(axioms: DataFrame) -> DataFrame:
    """(s, p, o) of axioms, of nested expressions too (see mapping.triples_of). Declarations that name no kind say nothing."""
    return triples_of(axioms.filter((F.col("axiom_type") != "Declaration") | F.col("sexpr").contains(" (")))
