"""Axioms over nested expressions as triples, and back, by the mapping of OWL 2 to RDF graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.terms import DOMAIN, OWL, RANGE, RDF, RDFS, SUBCLASS, SUBPROPERTY, TYPE, XSD
from quadrille.operators.trees import with_trees
from quadrille.plans.stages import free, stored

FIRST, REST, NIL = f"{RDF}first", f"{RDF}rest", f"{RDF}nil"
BLANK = "urn:blank:"
#: Fixed values of the mapping. Expressions whose parts are a list: their type and the predicate to it.
LISTS = {
    "ObjectIntersectionOf": (f"{OWL}Class", f"{OWL}intersectionOf"), "ObjectUnionOf": (f"{OWL}Class", f"{OWL}unionOf"), "ObjectOneOf": (f"{OWL}Class", f"{OWL}oneOf"),
    "DataIntersectionOf": (f"{RDFS}Datatype", f"{OWL}intersectionOf"), "DataUnionOf": (f"{RDFS}Datatype", f"{OWL}unionOf"), "DataOneOf": (f"{RDFS}Datatype", f"{OWL}oneOf"),
}
#: Expressions of one part.
SINGLE = {"ObjectComplementOf": (f"{OWL}Class", f"{OWL}complementOf"), "DataComplementOf": (f"{RDFS}Datatype", f"{OWL}datatypeComplementOf"), "ObjectInverseOf": (None, f"{OWL}inverseOf")}
#: Restrictions of a property and a filler, and of a number, a property and perhaps a filler.
FILLED = {f"{k}{n}": f"{OWL}{p}" for k in ("Object", "Data") for n, p in (("SomeValuesFrom", "someValuesFrom"), ("AllValuesFrom", "allValuesFrom"), ("HasValue", "hasValue"))}
COUNTED = {f"{k}{n}Cardinality": p for k in ("Object", "Data") for n, p in (("Min", "min"), ("Max", "max"), ("Exact", ""))}
#: Axioms that are one triple of their two parts, chains of such triples, or lists of members; and characteristics.
LINKS = {"SubClassOf": SUBCLASS, "SubObjectPropertyOf": SUBPROPERTY, "SubDataPropertyOf": SUBPROPERTY, "ObjectPropertyDomain": DOMAIN, "DataPropertyDomain": DOMAIN, "ObjectPropertyRange": RANGE, "DataPropertyRange": RANGE, "InverseObjectProperties": f"{OWL}inverseOf", "DatatypeDefinition": f"{OWL}equivalentClass"}
CHAINS = {"EquivalentClasses": f"{OWL}equivalentClass", "EquivalentObjectProperties": f"{OWL}equivalentProperty", "EquivalentDataProperties": f"{OWL}equivalentProperty", "SameIndividual": f"{OWL}sameAs"}
APART = {
    "DisjointClasses": (f"{OWL}disjointWith", f"{OWL}AllDisjointClasses", f"{OWL}members"), "DisjointObjectProperties": (f"{OWL}propertyDisjointWith", f"{OWL}AllDisjointProperties", f"{OWL}members"),
    "DisjointDataProperties": (f"{OWL}propertyDisjointWith", f"{OWL}AllDisjointProperties", f"{OWL}members"), "DifferentIndividuals": (f"{OWL}differentFrom", f"{OWL}AllDifferent", f"{OWL}distinctMembers"),
}
OWNED = {"DisjointUnion": f"{OWL}disjointUnionOf", "HasKey": f"{OWL}hasKey"}
FLAGS = {f"{k}ObjectProperty": f"{OWL}{k}Property" for k in ("Functional", "InverseFunctional", "Reflexive", "Irreflexive", "Symmetric", "Asymmetric", "Transitive")} | {"FunctionalDataProperty": f"{OWL}FunctionalProperty"}
DECLARED = {"Class": f"{OWL}Class", "ObjectProperty": f"{OWL}ObjectProperty", "DataProperty": f"{OWL}DatatypeProperty", "AnnotationProperty": f"{OWL}AnnotationProperty", "NamedIndividual": f"{OWL}NamedIndividual", "Datatype": f"{RDFS}Datatype"}
TRIPLE = "struct<s: string, p: string, o: string>"


def _row(s, p, o) -> Column:
    col = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(col(s).alias("s"), col(p).alias("p"), col(o).alias("o"))


def _list(owner: Column, predicate: str, items: Column, cells: Column) -> Column:
    """The link to a list, and its cells; an empty list is nil."""
    cell = lambda i: F.concat(cells, F.lit("/"), i.cast("string"))
    rest = F.flatten(F.transform(items, lambda x, i: F.array(_row(cell(i), FIRST, x), _row(cell(i), REST, F.when(i + 1 < F.size(items), cell(i + 1)).otherwise(F.lit(NIL))))))
    return F.concat(F.array(_row(owner, predicate, F.when(F.size(items) > 0, cell(F.lit(0))).otherwise(F.lit(NIL)))), rest)


def _whole_number(text: Column) -> Column:
    return F.concat(F.lit('"'), text, F.lit(f'"^^{XSD}nonNegativeInteger'))


def _expression(head: Column, me: Column, args: Column) -> Column:
    arg = lambda i: F.get(args, F.lit(i))
    typed = lambda t: F.array(_row(me, TYPE, t)) if t else F.array().cast(f"array<{TRIPLE}>")
    restriction = F.array(_row(me, TYPE, f"{OWL}Restriction"), _row(me, f"{OWL}onProperty", arg(0)))
    out = F.when(head == "ObjectHasSelf", F.concat(restriction, F.array(_row(me, f"{OWL}hasSelf", f'"true"^^{XSD}boolean'))))
    for name, (kind, p) in LISTS.items():
        out = out.when(head == name, F.concat(typed(kind), _list(me, p, args, me)))
    for name, (kind, p) in SINGLE.items():
        out = out.when(head == name, F.concat(typed(kind), F.array(_row(me, p, arg(0)))))
    for name, p in FILLED.items():
        out = out.when(head == name, F.concat(restriction, F.array(_row(me, p, arg(1)))))
    for name, p in COUNTED.items():
        on = f"{OWL}{'onClass' if name.startswith('Object') else 'onDataRange'}"
        plain, qualified = (f"{OWL}{p}{'C' if p else 'c'}ardinality", f"{OWL}{p}{'Q' if p else 'q'}ualifiedCardinality")
        parts = F.array(_row(me, TYPE, f"{OWL}Restriction"), _row(me, f"{OWL}onProperty", arg(1)))
        number = _whole_number(arg(0))
        more = F.when(F.size(args) > 2, F.array(_row(me, qualified, number), _row(me, on, arg(2)))).otherwise(F.array(_row(me, plain, number)))
        out = out.when(head == name, F.concat(parts, more))
    return out


def _axiom(head: Column, me: Column, args: Column, chain: Column) -> Column:
    """Triples of an axiom: of its parts' names, and those of the parts of a property chain."""
    arg = lambda i: F.get(args, F.lit(i))
    steps = lambda p: F.transform(F.slice(args, F.lit(1), F.size(args) - 1), lambda x, i: _row(x, p, F.get(args, i + 1)))
    negative = F.array(_row(me, TYPE, f"{OWL}NegativePropertyAssertion"), _row(me, f"{OWL}sourceIndividual", arg(1)), _row(me, f"{OWL}assertionProperty", arg(0)))
    out = F.when((head == "SubObjectPropertyOf") & chain.isNotNull(), _list(arg(1), f"{OWL}propertyChainAxiom", chain, me))
    for name, p in LINKS.items():
        out = out.when(head == name, F.array(_row(arg(0), p, arg(1))))
    for name, p in CHAINS.items():
        out = out.when(head == name, steps(p))
    for name, (p, kind, members) in APART.items():
        out = out.when((head == name) & (F.size(args) == 2), F.array(_row(arg(0), p, arg(1)))).when(head == name, F.concat(F.array(_row(me, TYPE, kind)), _list(me, members, args, me)))
    for name, p in OWNED.items():
        out = out.when(head == name, _list(arg(0), p, F.slice(args, 2, F.size(args)), me))
    for name, flag in FLAGS.items():
        out = out.when(head == name, F.array(_row(arg(0), TYPE, flag)))
    return (
        out.when(head == "ClassAssertion", F.array(_row(arg(1), TYPE, arg(0)))).when(head.isin("ObjectPropertyAssertion", "DataPropertyAssertion", "AnnotationAssertion"), F.array(_row(arg(1), arg(0), arg(2))))
        .when(head == "NegativeObjectPropertyAssertion", F.concat(negative, F.array(_row(me, f"{OWL}targetIndividual", arg(2))))).when(head == "NegativeDataPropertyAssertion", F.concat(negative, F.array(_row(me, f"{OWL}targetValue", arg(2)))))
    )


def triples_of(axioms: DataFrame) -> DataFrame:
    """(s, p, o) of axioms(axiom_id, sexpr), of nested expressions too: a blank node for each expression and each axiom of several
    triples, lists cell by cell. Declarations name their kind: (Declaration (Class a)). A form without a template is an error.

    Each node of an axiom's tree becomes its own triples, from one scan without a shuffle but for the last distinct.
    """
    rows = with_trees(axioms.select("axiom_id", "sexpr")).filter("tree IS NOT NULL")
    node = lambda k: F.concat(F.lit(BLANK), F.sha1(F.concat("axiom_id", F.lit(":"), k.cast("string"))))
    name = lambda k: F.when(F.get("tree", k)["leaf"], F.get("tree", k)["text"]).otherwise(node(k))
    first = F.get("tree", F.get("n.kids", F.lit(0)))
    rows = rows.select("axiom_id", "tree", F.posexplode("tree").alias("at", "n")).filter("NOT n.leaf")
    rows = rows.select(
        "at", F.col("n.head").alias("head"), F.col("n.parent").alias("parent"), node(F.col("at")).alias("me"), F.transform("n.kids", name).alias("args"), F.get("tree", F.col("n.parent"))["head"].alias("above"),
        F.when(first["head"] == "ObjectPropertyChain", F.transform(first["kids"], name)).alias("chain"), F.when(~first["leaf"], first["head"]).alias("kind"), F.get("tree", F.get(first["kids"], F.lit(0)))["text"].alias("declared"),
    )
    kinds = F.create_map(*[F.lit(x) for kv in DECLARED.items() for x in kv])
    none = F.array().cast(f"array<{TRIPLE}>")
    unknown = F.raise_error(F.concat(F.lit("no triples for "), F.col("head"))).cast(f"array<{TRIPLE}>")
    root = F.when(F.col("head") == "Declaration", F.array(_row(F.col("declared"), TYPE, F.try_element_at(kinds, F.col("kind"))))).otherwise(F.coalesce(_axiom(F.col("head"), F.col("me"), F.col("args"), F.col("chain")), unknown))
    inner = F.when((F.col("head") == "ObjectPropertyChain") | (F.col("above") == "Declaration"), none).otherwise(F.coalesce(_expression(F.col("head"), F.col("me"), F.col("args")), unknown))
    return rows.select(F.explode(F.when(F.col("at") == 0, root).otherwise(inner)).alias("t")).select("t.*").distinct()


def list_members(triples: DataFrame) -> DataFrame:
    """(head, items) of the lists of triples: by doubling pointers to the cells before, so rounds grow with the logarithm of a list's length."""
    first = triples.filter(F.col("p") == FIRST).select(F.col("s").alias("cell"), F.col("o").alias("item"))
    before = triples.filter((F.col("p") == REST) & (F.col("o") != NIL)).select(F.col("o").alias("cell"), F.col("s").alias("to"))
    now = stored(first.select("cell").join(before, "cell", "left").select("cell", F.coalesce("to", "cell").alias("to"), F.when(F.col("to").isNull(), 0).otherwise(1).alias("n"), F.lit(True).alias("moved")), "cells")
    while True:
        ahead = now.select(F.col("cell").alias("to"), F.col("to").alias("next"), F.col("n").alias("more"))
        longer = stored(now.join(ahead, "to").select("cell", F.col("next").alias("to"), (F.col("n") + F.col("more")).alias("n"), (F.col("more") > 0).alias("moved")), "cells")
        free(now)
        now = longer
        if now.filter("moved").isEmpty():
            break
    items = now.join(first, "cell").groupBy(F.col("to").alias("head")).agg(F.array_sort(F.collect_list(F.struct("n", "item"))).alias("items"))
    return items.select("head", F.transform("items", lambda x: x["item"]).alias("items"))


def _form(op, args: Column) -> Column:
    head = F.lit(op) if isinstance(op, str) else op
    return F.concat(F.lit("("), F.concat_ws(" ", head, F.array_join(args, " ")), F.lit(")"))


def axioms_of(triples: DataFrame) -> DataFrame:
    """(axiom_id, axiom_type, sexpr) of triples(s, p, o): expressions are folded back from their blank nodes, the inmost first, one
    round for each level of nesting. n equal classes come back as n - 1 axioms of two. Properties declared as datatype properties
    make data forms. A blank node that is no known expression, or a part of itself, is an error, not a loss.
    """
    triples = triples.select("s", "p", "o").distinct()
    members = stored(list_members(triples), "lists")
    data = stored(triples.filter((F.col("p") == TYPE) & (F.col("o") == f"{OWL}DatatypeProperty")).select(F.col("s").alias("prop")).distinct(), "data-properties")
    blank = lambda c: F.col(c).startswith(BLANK)
    wanted = [f"{OWL}{n}" for n in ("onProperty", "someValuesFrom", "allValuesFrom", "hasValue", "hasSelf", "onClass", "onDataRange", "intersectionOf", "unionOf", "oneOf", "complementOf", "datatypeComplementOf", "inverseOf")]
    wanted += [f"{OWL}{p}{q}" for p in ("min", "max", "") for q in ((f"{'C' if p else 'c'}ardinality"), (f"{'Q' if p else 'q'}ualifiedCardinality"))]
    short = lambda p: p[len(OWL) :]
    rows = triples.filter(blank("s")).groupBy(F.col("s").alias("id")).agg(
        *[F.max(F.when(F.col("p") == p, F.col("o"))).alias(short(p)) for p in wanted], F.max((F.col("p") == TYPE) & (F.col("o") == f"{RDFS}Datatype")).alias("range"), F.max(F.col("p").isin(FIRST, REST)).alias("cell"),
    )
    rows = rows.filter(~F.coalesce("cell", F.lit(False))).join(data.select(F.col("prop").alias("onProperty"), F.lit("Data").alias("kind")), "onProperty", "left")
    rows = rows.withColumn("list", F.coalesce("intersectionOf", "unionOf", "oneOf")).join(members.withColumnRenamed("head", "list"), "list", "left")
    side = F.coalesce("kind", F.when(F.col("range"), F.lit("Data")), F.lit("Object"))
    number = lambda c: F.regexp_extract(c, r'^"(\d+)"', 1)
    form = lambda name, *args: F.struct(F.concat(side, F.lit(name)).alias("op"), F.array(*[F.col(a) if isinstance(a, str) else a for a in args]).alias("args"))
    none = F.array().cast("array<string>")
    made = F.when(F.col("hasSelf").isNotNull(), form("HasSelf", "onProperty"))
    for p, name in (("someValuesFrom", "SomeValuesFrom"), ("allValuesFrom", "AllValuesFrom"), ("hasValue", "HasValue")):
        made = made.when(F.col(p).isNotNull(), form(name, "onProperty", p))
    for p, name in (("min", "Min"), ("max", "Max"), ("", "Exact")):
        plain, qualified = (f"{p}{'C' if p else 'c'}ardinality", f"{p}{'Q' if p else 'q'}ualifiedCardinality")
        made = made.when(F.col(qualified).isNotNull(), form(f"{name}Cardinality", number(qualified), "onProperty", F.coalesce("onClass", "onDataRange"))).when(F.col(plain).isNotNull(), form(f"{name}Cardinality", number(plain), "onProperty"))
    for p, name in (("intersectionOf", "IntersectionOf"), ("unionOf", "UnionOf"), ("oneOf", "OneOf")):
        made = made.when(F.col(p).isNotNull(), F.struct(F.concat(side, F.lit(name)).alias("op"), F.coalesce("items", none).alias("args")))
    made = made.when(F.col("complementOf").isNotNull(), form("ComplementOf", "complementOf")).when(F.col("datatypeComplementOf").isNotNull(), F.struct(F.lit("DataComplementOf").alias("op"), F.array("datatypeComplementOf").alias("args")))
    made = made.when(F.col("inverseOf").isNotNull(), form("InverseOf", "inverseOf"))
    open_ = stored(rows.select("id", made.alias("f")).filter("f IS NOT NULL").select("id", "f.op", "f.args"), "expressions")
    known: DataFrame | None = None
    while True:
        parts = open_.select("id", "op", F.posexplode_outer("args").alias("at", "arg"))
        texts = parts.withColumn("text", F.when(~blank("arg"), F.col("arg"))) if known is None else parts.join(known.select(F.col("id").alias("arg"), F.col("text").alias("t")), "arg", "left").withColumn("text", F.when(~blank("arg"), F.col("arg")).otherwise(F.col("t")))
        grouped = texts.groupBy("id", "op").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("parts"), F.sum((F.col("arg").isNotNull() & F.col("text").isNull()).cast("int")).alias("waits"))
        ready = stored(grouped.filter("waits = 0").select("id", _form(F.col("op"), F.transform(F.filter("parts", lambda x: x["text"].isNotNull()), lambda x: x["text"])).alias("text")), "folded")
        if ready.isEmpty():
            break
        known = ready if known is None else known.unionByName(ready)
        rest = stored(open_.join(ready, "id", "left_anti"), "expressions")
        free(open_)
        open_ = rest
    if not open_.isEmpty():
        raise ValueError("expressions that hold themselves, or parts without a form")
    texts = stored(triples.sparkSession.createDataFrame([], "id string, text string") if known is None else known, "texts")
    return _axiom_rows(triples, members, data, texts)


def _resolved(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """rows(op, args, chain) with the texts of the expressions at blank nodes; one that has no text is an error. Of a chain the first args become one form."""
    rows = stored(rows.distinct().withColumn("row", F.monotonically_increasing_id()), "axioms")
    parts = rows.select("row", "op", "chain", F.posexplode("args").alias("at", "arg")).join(texts.select(F.col("id").alias("arg"), "text"), "arg", "left")
    missing = F.raise_error(F.concat(F.lit("no expression at "), F.col("arg"))).cast("string")
    parts = parts.withColumn("arg", F.when(F.col("arg").startswith(BLANK), F.coalesce("text", missing)).otherwise(F.col("arg")))
    out = parts.groupBy("row", "op", "chain").agg(F.array_sort(F.collect_list(F.struct("at", "arg"))).alias("args")).withColumn("args", F.transform("args", lambda x: x["arg"]))
    whole = _form("ObjectPropertyChain", F.slice("args", F.lit(1), F.greatest("chain", F.lit(0))))
    return out.select("op", F.when(F.col("chain") > 0, F.array(whole, F.element_at("args", -1))).otherwise(F.col("args")).alias("args"))


def _axiom_rows(triples: DataFrame, members: DataFrame, data: DataFrame, texts: DataFrame) -> DataFrame:
    blank = lambda c: F.col(c).startswith(BLANK)
    items = lambda df, column: df.join(members.select(F.col("head").alias(column), F.col("items").alias("m")), column)
    of = lambda p: triples.filter(F.col("p") == p).select("s", "o")
    data_ids = data.select(F.col("prop").alias("s"), F.lit(True).alias("is_data"))
    nodes = triples.filter(blank("s") & (F.col("p") == f"{OWL}inverseOf")).select("s")
    made: list[DataFrame] = []
    both = lambda df, op: df.select(F.array("s", "o").alias("args"), op.alias("op") if isinstance(op, Column) else F.lit(op).alias("op"))
    by_kind = lambda obj, dat: F.when(F.col("is_data"), dat).otherwise(F.lit(obj))
    ranges = triples.filter((F.col("p") == TYPE) & (F.col("o") == f"{RDFS}Datatype") & ~blank("s")).select("s", F.lit(True).alias("is_data"))
    made.append(both(of(SUBCLASS), "SubClassOf"))
    made.append(both(of(f"{OWL}equivalentClass").join(ranges, "s", "left"), by_kind("EquivalentClasses", "DatatypeDefinition")))
    made.append(both(of(f"{OWL}disjointWith"), "DisjointClasses"))
    for p, obj, dat in ((SUBPROPERTY, "SubObjectPropertyOf", "SubDataPropertyOf"), (f"{OWL}equivalentProperty", "EquivalentObjectProperties", "EquivalentDataProperties"), (f"{OWL}propertyDisjointWith", "DisjointObjectProperties", "DisjointDataProperties"), (DOMAIN, "ObjectPropertyDomain", "DataPropertyDomain"), (RANGE, "ObjectPropertyRange", "DataPropertyRange")):
        made.append(both(of(p).join(data_ids, "s", "left"), by_kind(obj, dat)))
    made.append(both(of(f"{OWL}inverseOf").join(nodes, "s", "left_anti"), "InverseObjectProperties"))
    made += [both(of(f"{OWL}sameAs"), "SameIndividual"), both(of(f"{OWL}differentFrom"), "DifferentIndividuals")]
    for name, p in OWNED.items():
        made.append(items(of(p), "o").select(F.concat(F.array("s"), "m").alias("args"), F.lit(name).alias("op")))
    chains = items(of(f"{OWL}propertyChainAxiom"), "o").select(F.concat("m", F.array("s")).alias("args"), F.lit("SubObjectPropertyOf").alias("op"), F.size("m").alias("chain"))
    for kind, p in ((f"{OWL}AllDisjointClasses", f"{OWL}members"), (f"{OWL}AllDisjointProperties", f"{OWL}members"), (f"{OWL}AllDifferent", f"{OWL}distinctMembers")):
        rows = items(of(p).join(triples.filter((F.col("p") == TYPE) & (F.col("o") == kind)).select("s"), "s", "left_semi"), "o")
        if kind.endswith("Properties"):
            rows = rows.withColumn("p0", F.get("m", F.lit(0))).join(data.select(F.col("prop").alias("p0"), F.lit(True).alias("is_data")), "p0", "left")
            made.append(rows.select(F.col("m").alias("args"), by_kind("DisjointObjectProperties", "DisjointDataProperties").alias("op")))
        else:
            made.append(rows.select(F.col("m").alias("args"), F.lit("DisjointClasses" if kind.endswith("Classes") else "DifferentIndividuals").alias("op")))
    types = of(TYPE)
    for name, flag in FLAGS.items():
        rows = types.filter(F.col("o") == flag).join(data_ids, "s", "left_semi" if name == "FunctionalDataProperty" else "left_anti")
        made.append(rows.select(F.array("s").alias("args"), F.lit(name).alias("op")))
    for name, kind in DECLARED.items():
        made.append(types.filter((F.col("o") == kind) & ~blank("s")).select(F.array(_form(name, F.array("s"))).alias("args"), F.lit("Declaration").alias("op")))
    reserved = F.col("o").startswith(OWL) | F.col("o").startswith(RDFS)
    made.append(types.filter(~reserved & ~blank("s")).select(F.array("o", "s").alias("args"), F.lit("ClassAssertion").alias("op")))
    negative = of(f"{OWL}assertionProperty").withColumnRenamed("o", "p").join(of(f"{OWL}sourceIndividual").withColumnRenamed("o", "a"), "s")
    for p, name in ((f"{OWL}targetIndividual", "NegativeObjectPropertyAssertion"), (f"{OWL}targetValue", "NegativeDataPropertyAssertion")):
        made.append(negative.join(of(p), "s").select(F.array("p", "a", "o").alias("args"), F.lit(name).alias("op")))
    fixed = F.col("p").startswith(OWL) | F.col("p").isin(TYPE, SUBCLASS, SUBPROPERTY, DOMAIN, RANGE, FIRST, REST)
    notes = triples.filter((F.col("p") == TYPE) & (F.col("o") == f"{OWL}AnnotationProperty")).select(F.col("s").alias("p"), F.lit("AnnotationAssertion").alias("note"))
    facts = triples.filter(~fixed & ~blank("s")).join(notes, "p", "left").join(data.select(F.col("prop").alias("p"), F.lit("DataPropertyAssertion").alias("dat")), "p", "left")
    made.append(facts.select(F.array("p", "s", "o").alias("args"), F.coalesce("note", F.when(F.col("p").startswith(RDFS), F.lit("AnnotationAssertion")), "dat", F.lit("ObjectPropertyAssertion")).alias("op")))
    text = _form(F.col("op"), F.col("args"))
    rows = reduce(DataFrame.unionByName, [m.select("op", "args", F.lit(0).alias("chain")) for m in made]).unionByName(chains)
    return _resolved(rows, texts).select(F.sha1(text).alias("axiom_id"), F.col("op").alias("axiom_type"), text.alias("sexpr")).distinct()
