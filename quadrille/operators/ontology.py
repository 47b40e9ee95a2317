"""Composed jobs over an ontology's triples and axioms: lookups, descriptions, changes, releases, shapes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.terms import DOMAIN, LABEL, OWL, RANGE, RDFS, SUBCLASS, SUBPROPERTY, TYPE
from quadrille.operators import axioms as ax
from quadrille.operators.entailment import entailed
from quadrille.operators.hierarchy import NOTHING, THING, cross_reach, direct, edges_of, inconsistent_individuals, some_restrictions, unsatisfiable
from quadrille.plans.fixpoint import transitive_closure
from quadrille.plans.stages import stored

#: Annotation properties that need no declaration, as fixed by OWL 2.
BUILT_IN = [LABEL, *[f"{RDFS}{n}" for n in ("comment", "seeAlso", "isDefinedBy")], *[f"{OWL}{n}" for n in ("deprecated", "versionInfo", "priorVersion", "backwardCompatibleWith", "incompatibleWith")]]


def _language(triples: DataFrame) -> Column:
    return F.col("o_lang") if "o_lang" in triples.columns else F.lit(None).cast("string")


def annotations(triples: DataFrame) -> DataFrame:
    """(iri, prop, value, lang) of all entities: values of built-in and of declared annotation properties."""
    declared = triples.filter((F.col("p") == TYPE) & (F.col("o") == f"{OWL}AnnotationProperty")).select(F.col("s").alias("p")).distinct()
    own = triples.join(declared, "p", "left_semi").select(triples.columns).unionByName(triples.filter(F.col("p").isin(BUILT_IN)))
    return own.select(F.col("s").alias("iri"), F.col("p").alias("prop"), F.col("o").alias("value"), _language(triples).alias("lang")).distinct()


def annotation_values(triples: DataFrame, prop: str) -> DataFrame:
    """(iri, value) of one annotation property."""
    return triples.filter(F.col("p") == prop).select(F.col("s").alias("iri"), F.col("o").alias("value")).distinct()


def asserted_instances(triples: DataFrame) -> DataFrame:
    """(c, i) as stated, without declarations of entities."""
    return triples.filter((F.col("p") == TYPE) & ~F.col("o").startswith(OWL)).select(F.col("o").alias("c"), F.col("s").alias("i")).distinct()


def asserted_subclasses(triples: DataFrame) -> DataFrame:
    """(c, sub) as stated; owl:Thing has the declared classes that no stated link leads up from."""
    links = edges_of(triples).select(F.col("b").alias("c"), F.col("a").alias("sub"))
    classes = triples.filter((F.col("p") == TYPE) & (F.col("o") == f"{OWL}Class")).select(F.col("s").alias("sub")).distinct()
    return links.unionByName(classes.join(links.select("sub"), "sub", "left_anti").select(F.lit(THING).alias("c"), "sub")).distinct()


def described(triples: DataFrame) -> DataFrame:
    """(iri, section, prop, value): all that is stated of each entity: annotations, links out and in, restrictions."""
    notes = annotations(triples)
    known = notes.select("prop").distinct()
    links = triples.join(known.withColumnRenamed("prop", "p"), "p", "left_anti").select("s", "p", "o")
    some = some_restrictions(triples.select("s", "p", "o"))
    return (
        notes.select("iri", F.lit("annotation").alias("section"), "prop", "value")
        .unionByName(links.filter(~F.col("o").startswith("urn:blank:")).select(F.col("s").alias("iri"), F.lit("states").alias("section"), F.col("p").alias("prop"), F.col("o").alias("value")))
        .unionByName(links.filter(~F.col("s").startswith("urn:blank:")).select(F.col("o").alias("iri"), F.lit("mentioned").alias("section"), F.col("p").alias("prop"), F.col("s").alias("value")))
        .unionByName(some.select(F.col("x").alias("iri"), F.lit("restriction").alias("section"), F.col("p").alias("prop"), F.col("c").alias("value"))).distinct()
    )


def relation_counts(restrictions: DataFrame, classes: DataFrame) -> DataFrame:
    """(p, n_stated, n_pairs, n_subjects, n_objects) of each relation of restrictions(x, p, c): what is stated, and what follows
    for the classes below the subjects and above the objects. classes: the closure."""
    stated = restrictions.groupBy("p").agg(F.count_distinct("x", "c").alias("n_stated"))
    down, up = classes.select(F.col("a").alias("__d"), F.col("b").alias("x")), classes.select(F.col("a").alias("c"), F.col("b").alias("__u"))
    low = restrictions.select("x", "p", "c").unionByName(restrictions.join(down, "x").select(F.col("__d").alias("x"), "p", "c")).distinct()
    all_ = low.unionByName(low.join(up, "c").select("x", "p", F.col("__u").alias("c"))).distinct()
    return stated.join(all_.groupBy("p").agg(F.count("*").alias("n_pairs"), F.count_distinct("x").alias("n_subjects"), F.count_distinct("c").alias("n_objects")), "p")


def descendant_counts(closure: DataFrame) -> DataFrame:
    """(node, n) of nodes below each node."""
    return closure.filter("a <> b").groupBy(F.col("b").alias("node")).agg(F.count("*").alias("n"))


def relonomy(restrictions: DataFrame, classes: DataFrame, base: str = "urn:relonomy:") -> DataFrame:
    """Triples of a taxonomy for each property of restrictions(x, p, c): a defined class `p some c` for each c that occurs and each class
    above it, directly below those of the classes directly above c, and each x directly below its most specific ones. classes: the closure."""
    used = restrictions.select("p", "c").distinct()
    every = used.unionByName(used.join(classes.select(F.col("a").alias("c"), F.col("b").alias("__u")), "c").select("p", F.col("__u").alias("c"))).distinct()
    name = lambda p, c: F.concat(F.lit(base), F.sha1(F.concat_ws(" ", p, c)))
    node = F.concat(F.lit("urn:blank:"), F.sha1(F.concat_ws(" ", "p", "c")))
    own = name(F.col("p"), F.col("c"))
    made = F.array(
        F.struct(own.alias("s"), F.lit(TYPE).alias("p"), F.lit(f"{OWL}Class").alias("o")), F.struct(own.alias("s"), F.lit(f"{OWL}equivalentClass").alias("p"), node.alias("o")),
        F.struct(node.alias("s"), F.lit(TYPE).alias("p"), F.lit(f"{OWL}Restriction").alias("o")), F.struct(node.alias("s"), F.lit(f"{OWL}onProperty").alias("p"), F.col("p").alias("o")),
        F.struct(node.alias("s"), F.lit(f"{OWL}someValuesFrom").alias("p"), F.col("c").alias("o")),
    )
    defined = every.select(F.explode(made).alias("t")).select("t.*")
    over = direct(classes).select(F.col("a").alias("c"), F.col("b").alias("d"))
    ordered = every.join(over, "c").select(own.alias("s"), F.lit(SUBCLASS).alias("p"), name(F.col("p"), F.col("d")).alias("o"))
    # x belongs below p some c unless it has, or inherits, one with a class strictly below c
    up = classes.select(F.col("a").alias("__x"), F.col("b").alias("x"))
    own_links = restrictions.select("x", "p", "c").distinct()
    inherited = own_links.unionByName(restrictions.join(up, "x").select(F.col("__x").alias("x"), "p", "c")).distinct()
    strict = classes.join(classes.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti").filter("a <> b")
    implied = inherited.join(strict.select(F.col("a").alias("c"), F.col("b").alias("__u")), "c").select("x", "p", F.col("__u").alias("c"))
    placed = inherited.join(implied, ["x", "p", "c"], "left_anti").select(F.col("x").alias("s"), F.lit(SUBCLASS).alias("p"), own.alias("o"))
    return defined.unionByName(ordered).unionByName(placed).distinct()


# ---- changes ----


def added(axioms: DataFrame, new: DataFrame) -> DataFrame:
    """The axioms and the new ones; one that an ontology has already is not added again."""
    return axioms.unionByName(new).dropDuplicates(["ont", "axiom_id"])


def removed(axioms: DataFrame, gone: DataFrame) -> DataFrame:
    return axioms.join(gone.select("ont", "axiom_id").distinct(), ["ont", "axiom_id"], "left_anti").select(axioms.columns)


def changed(axioms: DataFrame, changes: DataFrame) -> DataFrame:
    """All changes(change, ont, axiom_id, ...) at once: removals ("remove") first, then additions ("add")."""
    parts = {k: changes.filter(F.col("change") == k).drop("change") for k in ("add", "remove")}
    return added(removed(axioms, parts["remove"]), parts["add"])


def with_header(triples: DataFrame, ontology: str, imports: Sequence[str] = (), version: str | None = None) -> DataFrame:
    """The triples with the ontology's header: its type, imports, and its version in place of another."""
    spark = triples.sparkSession
    rows = [(ontology, TYPE, f"{OWL}Ontology"), *[(ontology, f"{OWL}imports", i) for i in imports]] + ([(ontology, f"{OWL}versionIRI", version)] if version else [])
    kept = triples.filter(~((F.col("s") == ontology) & (F.col("p") == f"{OWL}versionIRI"))) if version else triples
    return kept.select("s", "p", "o").unionByName(spark.createDataFrame(rows, "s string, p string, o string")).distinct()


def copied_annotations(source: DataFrame, target: DataFrame) -> DataFrame:
    """The target's triples and the source's annotations of entities that the target mentions."""
    there = target.select(F.explode(F.array("s", "p", "o")).alias("iri")).distinct()
    notes = annotations(source).join(there, "iri", "left_semi").select(F.col("iri").alias("s"), F.col("prop").alias("p"), F.col("value").alias("o"))
    return target.select("s", "p", "o").unionByName(notes).distinct()


# ---- axioms as triples ----


def reified(triples: DataFrame, notes: DataFrame) -> DataFrame:
    """Triples of annotated statements: for notes(s, p, o, prop, value) on the stated triples an owl:Axiom that points at each
    statement, and the notes on it. A statement has one such node, named by its hash, however many notes it has."""
    on = notes.join(triples.select("s", "p", "o").distinct(), ["s", "p", "o"], "left_semi")
    node = F.concat(F.lit("urn:blank:"), F.sha1(F.concat_ws(" ", "s", "p", "o")))
    pair = lambda p, o: F.struct(node.alias("s"), p.alias("p"), o.alias("o"))
    made = F.array(pair(F.lit(TYPE), F.lit(f"{OWL}Axiom")), *[pair(F.lit(f"{OWL}annotated{n}"), F.col(c)) for n, c in (("Source", "s"), ("Property", "p"), ("Target", "o"))], pair(F.col("prop"), F.col("value")))
    return triples.select("s", "p", "o").unionByName(on.select(F.explode(made).alias("t")).select("t.*")).distinct()


def statement_annotations(triples: DataFrame) -> DataFrame:
    """(s, p, o, prop, value): the notes on statements, read back."""
    axioms = triples.filter((F.col("p") == TYPE) & (F.col("o") == f"{OWL}Axiom")).select(F.col("s").alias("n"))
    at = {c: triples.filter(F.col("p") == f"{OWL}annotated{n}").select(F.col("s").alias("n"), F.col("o").alias(c)) for n, c in (("Source", "s"), ("Property", "p"), ("Target", "o"))}
    fixed = [TYPE, *[f"{OWL}annotated{n}" for n in ("Source", "Property", "Target")]]
    notes = triples.filter(~F.col("p").isin(fixed)).select(F.col("s").alias("n"), F.col("p").alias("prop"), F.col("o").alias("value"))
    return axioms.join(at["s"], "n").join(at["p"], "n").join(at["o"], "n").join(notes, "n").select("s", "p", "o", "prop", "value").distinct()


#: The predicate that leads from a restriction to its filler, and the one that leads from a Boolean class to its list.
FILLERS = {"some": f"{OWL}someValuesFrom", "all": f"{OWL}allValuesFrom", "value": f"{OWL}hasValue"}
LISTED = {"and": f"{OWL}intersectionOf", "or": f"{OWL}unionOf", "one": f"{OWL}oneOf"}
RDF_FIRST, RDF_REST, RDF_NIL = (f"http://www.w3.org/1999/02/22-rdf-syntax-ns#{n}" for n in ("first", "rest", "nil"))


def expression_triples(expressions: DataFrame) -> DataFrame:
    """Triples of class expressions, one level a row: expressions(id, op, prop, args) with ids or names as args.

    some, all and value have a property and one arg, self a property alone; min, max and exactly have the number first and
    perhaps a class; other operators are an error; and, or and one
    have any number of args, as a list; not has one. Nested expressions refer to each other's id.
    """
    rows = expressions.select("id", "op", "prop", "args")
    row = lambda s, p, o: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    cell = lambda i: F.when(i == 0, F.concat("id", F.lit("/list"))).otherwise(F.concat(F.col("id"), F.lit("/list"), i.cast("string")))
    none = F.array().cast("array<struct<s:string,p:string,o:string>>")
    out = none
    for op, p in FILLERS.items():
        out = F.when(F.col("op") == op, F.array(row(F.col("id"), TYPE, F.lit(f"{OWL}Restriction")), row(F.col("id"), f"{OWL}onProperty", F.col("prop")), row(F.col("id"), p, F.col("args")[0]))).otherwise(out)
    for op, (plain, qualified) in {"min": ("minCardinality", "minQualifiedCardinality"), "max": ("maxCardinality", "maxQualifiedCardinality"), "exactly": ("cardinality", "qualifiedCardinality")}.items():
        on = F.array(row(F.col("id"), TYPE, F.lit(f"{OWL}Restriction")), row(F.col("id"), f"{OWL}onProperty", F.col("prop")))
        number = F.get("args", F.lit(0))
        filled = F.concat(on, F.array(row(F.col("id"), f"{OWL}{qualified}", number), row(F.col("id"), f"{OWL}onClass", F.get("args", F.lit(1)))))
        out = F.when((F.col("op") == op) & (F.size("args") > 1), filled).when(F.col("op") == op, F.concat(on, F.array(row(F.col("id"), f"{OWL}{plain}", number)))).otherwise(out)
    out = F.when(F.col("op") == "self", F.array(row(F.col("id"), TYPE, F.lit(f"{OWL}Restriction")), row(F.col("id"), f"{OWL}onProperty", F.col("prop")), row(F.col("id"), f"{OWL}hasSelf", F.lit("true")))).otherwise(out)
    items = F.flatten(F.transform("args", lambda a, i: F.array(row(cell(i), RDF_FIRST, a), row(cell(i), RDF_REST, F.when(i + 1 < F.size("args"), cell(i + 1)).otherwise(F.lit(RDF_NIL))))))
    for op, p in LISTED.items():
        out = F.when(F.col("op") == op, F.concat(F.array(row(F.col("id"), TYPE, F.lit(f"{OWL}Class")), row(F.col("id"), p, F.when(F.size("args") > 0, cell(F.lit(0))).otherwise(F.lit(RDF_NIL)))), items)).otherwise(out)
    out = F.when(F.col("op") == "not", F.array(row(F.col("id"), TYPE, F.lit(f"{OWL}Class")), row(F.col("id"), f"{OWL}complementOf", F.col("args")[0]))).otherwise(out)
    known = [*FILLERS, *LISTED, "min", "max", "exactly", "self", "not"]
    out = F.when(F.col("op").isin(known), out).otherwise(F.raise_error(F.concat(F.lit("no triples for "), F.col("op"))).cast("array<struct<s:string,p:string,o:string>>"))
    return rows.select(F.explode(out).alias("t")).select("t.*").distinct()


def all_different(lists: DataFrame, kind: str = "AllDisjointClasses") -> DataFrame:
    """Triples of an n-ary axiom for each of lists(id, members): AllDisjointClasses, AllDisjointProperties or AllDifferent, with its list."""
    member = f"{OWL}{'distinctMembers' if kind == 'AllDifferent' else 'members'}"
    made = expression_triples(lists.select("id", F.lit("or").alias("op"), F.lit(None).cast("string").alias("prop"), F.col("members").alias("args")))
    return made.withColumn("p", F.when(F.col("p") == LISTED["or"], member).otherwise(F.col("p"))).withColumn("o", F.when((F.col("p") == TYPE), F.lit(f"{OWL}{kind}")).otherwise(F.col("o")))


# ---- inferred axioms ----

CHARACTERISTICS = [f"{OWL}{k}Property" for k in ("Functional", "InverseFunctional", "Symmetric", "Asymmetric", "Transitive", "Reflexive", "Irreflexive")]
#: Types of inferred axioms, named by their form; a characteristic is any of CHARACTERISTICS.
INFERRED_TYPES = (
    "SubClassOf", "EquivalentClasses", "DisjointClasses", *(form.format(k) for k in ("Object", "Data") for form in ("Sub{}PropertyOf", "Equivalent{}Properties", "{}PropertyCharacteristic")),
    "InverseObjectProperties", "ClassAssertion", "PropertyAssertion",
)


def inferred(triples: DataFrame, types: Sequence[str] = INFERRED_TYPES, bundle: str = "rdfs-plus") -> DataFrame:
    """(type, s, p, o): entailed axioms that aren't stated, of the types asked for.

    Beside the bundle's own rules: classes (properties) that reach each other are equivalent; classes below disjoint ones are
    disjoint; a property below a functional one is functional, one below an inverse-functional one likewise; equivalent and
    inverse properties share symmetry and transitivity; an inverse holds both ways.
    """
    if unknown := set(types) - set(INFERRED_TYPES):
        raise ValueError(f"no types of inferred axioms: {sorted(unknown)}")
    base = stored(triples.select("s", "p", "o").distinct(), "stated")
    full = stored(entailed(triples, bundle), "entailed")
    kind = lambda k: base.filter((F.col("p") == TYPE) & (F.col("o") == f"{OWL}{k}")).select(F.col("s").alias("iri")).distinct()
    link = lambda p: full.filter((F.col("p") == p) & (F.col("s") != F.col("o"))).select("s", "o")
    turned = lambda df: df.select(F.col("o").alias("s"), F.col("s").alias("o"))
    of = lambda df, k: df.join(kind(k).select(F.col("iri").alias("s")), "s", "left_semi")
    named = lambda df, p: df.select("s", F.lit(p).alias("p"), "o")
    subclass, subproperty = link(SUBCLASS), link(SUBPROPERTY)
    both = lambda df: df.join(turned(df), ["s", "o"], "left_semi")
    made: dict[str, DataFrame] = {}
    if "SubClassOf" in types:
        made["SubClassOf"] = named(subclass, SUBCLASS)
    if "EquivalentClasses" in types:
        made["EquivalentClasses"] = named(both(subclass), f"{OWL}equivalentClass")
    if "DisjointClasses" in types:
        apart = base.filter(F.col("p") == f"{OWL}disjointWith").select("s", "o")
        apart = apart.unionByName(turned(apart)).distinct()
        reach = subclass.unionByName(apart.select("s", F.col("s").alias("o"))).distinct()
        low = apart.join(reach.select(F.col("s").alias("__d"), F.col("o").alias("s")), "s").select(F.col("__d").alias("s"), "o")
        made["DisjointClasses"] = named(low.join(reach.select(F.col("s").alias("__d"), "o"), "o").select("s", F.col("__d").alias("o")).filter("s <> o"), f"{OWL}disjointWith")
    for k, name in (("ObjectProperty", "Object"), ("DatatypeProperty", "Data")):
        if f"Sub{name}PropertyOf" in types:
            made[f"Sub{name}PropertyOf"] = named(of(subproperty, k), SUBPROPERTY)
        if f"Equivalent{name}Properties" in types:
            made[f"Equivalent{name}Properties"] = named(of(both(subproperty), k), f"{OWL}equivalentProperty")
        if f"{name}PropertyCharacteristic" in types:
            flags = base.filter((F.col("p") == TYPE) & F.col("o").isin(CHARACTERISTICS)).select("s", "o")
            passed = [f"{OWL}FunctionalProperty", f"{OWL}InverseFunctionalProperty"]
            down = subproperty.join(flags.filter(F.col("o").isin(passed)).select(F.col("s").alias("__q"), F.col("o").alias("__k")), F.col("o") == F.col("__q")).select("s", F.col("__k").alias("o"))
            inverse = base.filter(F.col("p") == f"{OWL}inverseOf").select("s", "o")
            same = both(subproperty).unionByName(inverse).unionByName(turned(inverse)).distinct().withColumnRenamed("o", "__q")
            shared = [f"{OWL}{x}Property" for x in ("Symmetric", "Transitive", "Asymmetric", "Reflexive", "Irreflexive")]
            along = same.join(flags.filter(F.col("o").isin(shared)).withColumnRenamed("s", "__q"), "__q").select("s", "o")
            made[f"{name}PropertyCharacteristic"] = named(of(down.unionByName(along), k), TYPE)
    if "InverseObjectProperties" in types:
        made["InverseObjectProperties"] = named(turned(base.filter(F.col("p") == f"{OWL}inverseOf")), f"{OWL}inverseOf")
    if "ClassAssertion" in types:
        made["ClassAssertion"] = full.filter((F.col("p") == TYPE) & ~F.col("o").startswith(OWL)).select("s", "p", "o")
    if "PropertyAssertion" in types:
        fixed = [TYPE, SUBCLASS, SUBPROPERTY, DOMAIN, RANGE]
        made["PropertyAssertion"] = full.filter(~F.col("p").isin(fixed) & ~F.col("p").startswith(OWL) & ~F.col("p").startswith(RDFS)).select("s", "p", "o")
    rows = [df.distinct().select(F.lit(t).alias("type"), "s", "p", "o") for t, df in made.items()]
    return reduce(DataFrame.unionByName, rows).join(base, ["s", "p", "o"], "left_anti").select("type", "s", "p", "o")


# ---- release ----


@dataclass(frozen=True)
class Release:
    merged: DataFrame
    inferred: DataFrame
    report: DataFrame

    @property
    def ready(self) -> bool:
        """Whether no individual is inconsistent and no class unsatisfiable."""
        return self.report.filter("check IN ('inconsistent', 'unsatisfiable') AND n > 0").isEmpty()


def release(graphs: Mapping[str, DataFrame], types: Sequence[str] = ("SubClassOf",), bundle: str = "rdfs", path: str | None = None) -> Release:
    """Merges the graphs, infers axioms and checks the outcome; written under `path`, if given, as merged, inferred and report.

    report(check, n): inconsistent individuals, unsatisfiable classes and each kind of profile violation.
    """
    merged = stored(reduce(DataFrame.unionByName, [g.select("s", "p", "o") for g in graphs.values()]).distinct(), "merged")
    closure = transitive_closure(edges_of(merged))
    apart = merged.filter(F.col("p") == f"{OWL}disjointWith").select(F.col("s").alias("a"), F.col("o").alias("b"))
    facts = asserted_instances(merged).select("i", "c")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
    report = count(inconsistent_individuals(facts, closure, apart), "inconsistent").unionByName(count(unsatisfiable(closure, apart).filter(F.col("node") != NOTHING), "unsatisfiable"))
    report = report.unionByName(ax.profile_violations(merged).groupBy(F.concat(F.lit("profile: "), "violation").alias("check")).agg(F.count("*").alias("n")))
    out = Release(merged, inferred(merged, types, bundle), report)
    if path:
        for name in ("merged", "inferred", "report"):
            getattr(out, name).write.parquet(f"{path}/{name}")
    return out


def graph_tables(edges: DataFrame, levels: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes(id, label, level), edges(from, to)) for a drawing: nodes of edges(a, b) with their labels(iri, label), or else names."""
    nodes = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    named = labels.groupBy(F.col("iri").alias("id")).agg(F.min("label").alias("label"))
    nodes = nodes.join(named, "id", "left").join(levels.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("label", "id").alias("label"), "level")
    return nodes, edges.filter("a <> b").select(F.col("a").alias("from"), F.col("b").alias("to")).distinct()


def pairs_across(links: DataFrame, closure: DataFrame) -> DataFrame:
    """(a, b, n_stated): the pairs that links(a, b) give for descendants and ancestors, with 1 where a pair is stated."""
    return cross_reach(closure, links).join(links.select("a", "b", F.lit(1).alias("n_stated")).distinct(), ["a", "b"], "left").fillna(0, ["n_stated"])


def commented(lines: DataFrame, text: str, labels: DataFrame) -> DataFrame:
    """lines with the array `labels` of the labels(iri, label) of all <IRIs> in their text, in the order of the IRIs."""
    rows = stored(lines.withColumn("__id", F.monotonically_increasing_id()), "lines")
    used = rows.select("__id", F.posexplode(F.regexp_extract_all(text, F.lit("<([^>]+)>"), F.lit(1))).alias("at", "iri"))
    found = used.join(labels, "iri").groupBy("__id").agg(F.array_sort(F.collect_list(F.struct("at", "label"))).alias("__l"))
    return rows.join(found, "__id", "left").withColumn("labels", F.coalesce(F.transform("__l", lambda x: x["label"]), F.array().cast("array<string>"))).drop("__id", "__l")
