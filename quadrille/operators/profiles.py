"""Checks of axioms (text forms) against the profiles DL, EL, QL and RL: grammars over expression trees and conditions over whole axiom sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.terms import OWL, RDFS, XSD
from quadrille.operators.axioms import RESERVED
from quadrille.operators.trees import with_trees
from quadrille.plans.fixpoint import transitive_closure
from quadrille.plans.stages import stored

THINGS, NOTHINGS = (f"{OWL}Thing", "owl:Thing"), (f"{OWL}Nothing", "owl:Nothing")

# A grammar gives, for a role and a head that may stand there, the roles of the parts; the last is that of all further parts.
_N = ("number", "prop", "class")
_DN = ("number", "dprop", "data")
_FILLED = {f"Object{k}ValuesFrom": ("prop", "class") for k in ("Some", "All")} | {f"Data{k}ValuesFrom": ("dprop", "data") for k in ("Some", "All")}
_VALUED = {"ObjectHasValue": ("prop", "ind"), "DataHasValue": ("dprop", "lit")}
_FACETS = {"DatatypeRestriction": ("restricted", "facet")}
DL = {
    "class": {
        "ObjectIntersectionOf": ("class",), "ObjectUnionOf": ("class",), "ObjectComplementOf": ("class",), "ObjectOneOf": ("ind",), "ObjectHasSelf": ("selfprop",), **_FILLED, **_VALUED,
        **{f"Object{k}Cardinality": ("number", "countprop", "class") for k in ("Min", "Max", "Exact")}, **{f"Data{k}Cardinality": _DN for k in ("Min", "Max", "Exact")},
    },
    "data": {"DataIntersectionOf": ("data",), "DataUnionOf": ("data",), "DataComplementOf": ("data",), "DataOneOf": ("lit",), **_FACETS},
    "prop": {"ObjectInverseOf": ("prop",)}, "countprop": {"ObjectInverseOf": ("countprop",)}, "selfprop": {"ObjectInverseOf": ("selfprop",)}, "chain": {"ObjectInverseOf": ("prop",), "ObjectPropertyChain": ("prop",)},
}
EL = {
    "class": {"ObjectIntersectionOf": ("class",), "ObjectOneOf": ("ind",), "ObjectSomeValuesFrom": ("prop", "class"), "ObjectHasSelf": ("prop",), "DataSomeValuesFrom": ("dprop", "data"), **_VALUED},
    "data": {"DataIntersectionOf": ("data",), "DataOneOf": ("lit",)}, "prop": {}, "chain": {"ObjectPropertyChain": ("prop",)},
}
QL = {
    "sub": {"ObjectSomeValuesFrom": ("prop", "thing"), "DataSomeValuesFrom": ("dprop", "data")}, "atom": {}, "thing": {},
    "super": {"ObjectIntersectionOf": ("super",), "ObjectComplementOf": ("sub",), "ObjectSomeValuesFrom": ("prop", "atom"), "DataSomeValuesFrom": ("dprop", "data")},
    "data": {"DataIntersectionOf": ("data",)}, "prop": {"ObjectInverseOf": ("prop",)}, "chain": {"ObjectInverseOf": ("prop",)},
}
RL = {
    "sub": {"ObjectIntersectionOf": ("sub",), "ObjectUnionOf": ("sub",), "ObjectOneOf": ("ind",), "ObjectSomeValuesFrom": ("prop", "filler"), "DataSomeValuesFrom": ("dprop", "data"), **_VALUED},
    "super": {
        "ObjectIntersectionOf": ("super",), "ObjectComplementOf": ("sub",), "ObjectAllValuesFrom": ("prop", "super"), "DataAllValuesFrom": ("dprop", "data"), **_VALUED,
        "ObjectMaxCardinality": ("few", "prop", "filler"), "DataMaxCardinality": ("few", "dprop", "data"),
    },
    "equiv": {"ObjectIntersectionOf": ("equiv",), **_VALUED}, "data": {"DataIntersectionOf": ("data",)},
    "prop": {"ObjectInverseOf": ("prop",)}, "chain": {"ObjectInverseOf": ("prop",), "ObjectPropertyChain": ("prop",)},
}
RL["filler"] = RL["sub"]


def _axiom_roles(sub: str, sup: str, equiv: str, atom: str, without: tuple[str, ...]) -> dict[str, tuple[str, ...]]:
    """The roles of the parts of each axiom type that a profile has."""
    props = {k: ("prop",) for k in ("EquivalentObjectProperties", "InverseObjectProperties", "ReflexiveObjectProperty", "SymmetricObjectProperty", "TransitiveObjectProperty")}
    simple = {"DisjointObjectProperties": "apart", "FunctionalObjectProperty": "one", "InverseFunctionalObjectProperty": "invone", "IrreflexiveObjectProperty": "never", "AsymmetricObjectProperty": "oneway"}
    data = {k: ("dprop",) for k in ("SubDataPropertyOf", "EquivalentDataProperties", "DisjointDataProperties", "FunctionalDataProperty")}
    facts = {f"{n}ObjectPropertyAssertion": ("prop", "ind", "ind") for n in ("", "Negative")} | {f"{n}DataPropertyAssertion": ("dprop", "ind", "lit") for n in ("", "Negative")}
    out = {
        "SubClassOf": (sub, sup), "EquivalentClasses": (equiv,), "DisjointClasses": (sub,), "DisjointUnion": ("name", "class"), "SubObjectPropertyOf": ("chain", "prop"), "ObjectPropertyDomain": ("prop", sup),
        "ObjectPropertyRange": ("prop", sup), "DataPropertyDomain": ("dprop", sup), "DataPropertyRange": ("dprop", "data"), "HasKey": (sub, "anyprop"), "DatatypeDefinition": ("defined", "data"), "ClassAssertion": (atom, "ind"),
        "SameIndividual": ("ind",), "DifferentIndividuals": ("ind",), "Declaration": ("skip",), "AnnotationAssertion": ("aprop", "skip"), "SubAnnotationPropertyOf": ("aprop",), "AnnotationPropertyDomain": ("aprop", "skip"),
        "AnnotationPropertyRange": ("aprop", "skip"), **props, **{k: ("prop",) for k in simple}, **data, **facts,
    }
    return {k: v for k, v in out.items() if k not in without}


DL["axiom"] = _axiom_roles("class", "class", "class", "class", ())
EL["axiom"] = _axiom_roles("class", "class", "class", "class", (
    "DisjointUnion", "DisjointObjectProperties", "DisjointDataProperties", "InverseObjectProperties", "FunctionalObjectProperty", "InverseFunctionalObjectProperty", "IrreflexiveObjectProperty",
    "SymmetricObjectProperty", "AsymmetricObjectProperty",
))
QL["axiom"] = _axiom_roles("sub", "super", "sub", "atom", (
    "DisjointUnion", "TransitiveObjectProperty", "FunctionalObjectProperty", "InverseFunctionalObjectProperty", "FunctionalDataProperty", "HasKey", "SameIndividual",
    "NegativeObjectPropertyAssertion", "NegativeDataPropertyAssertion",
))
RL["axiom"] = _axiom_roles("sub", "super", "equiv", "super", ("DisjointUnion", "ReflexiveObjectProperty"))
PROFILES = {"dl": DL, "el": EL, "ql": QL, "rl": RL}
#: What an expression at a role's place isn't.
MISPLACED = {
    "class": "illegal class expression", "sub": "not a subclass expression", "filler": "not a subclass expression", "super": "not a superclass expression", "equiv": "not an equivalent class expression", "atom": "not an atomic class",
    "thing": "not a subclass expression", "data": "illegal data range", "prop": "inverse property", "chain": "illegal property expression", "few": "not a superclass expression", "axiom": "illegal axiom",
}
#: Datatypes of DL, those that EL and QL leave out, and facets. Fixed values.
DATATYPES = [
    *(f"{XSD}{t}" for t in (
        "decimal", "integer", "nonNegativeInteger", "nonPositiveInteger", "positiveInteger", "negativeInteger", "long", "int", "short", "byte", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte", "double", "float",
        "string", "normalizedString", "token", "language", "Name", "NCName", "NMTOKEN", "boolean", "hexBinary", "base64Binary", "anyURI", "dateTime", "dateTimeStamp",
    )),
    f"{RDFS}Literal", f"{OWL}real", f"{OWL}rational", "http://www.w3.org/1999/02/22-rdf-syntax-ns#PlainLiteral", "http://www.w3.org/1999/02/22-rdf-syntax-ns#XMLLiteral",
]
NOT_IN_EL_QL = [f"{XSD}{t}" for t in (
    "nonPositiveInteger", "positiveInteger", "negativeInteger", "long", "int", "short", "byte", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte", "double", "float", "boolean", "language",
)]
FACETS = [f"{XSD}{t}" for t in ("minInclusive", "maxInclusive", "minExclusive", "maxExclusive", "length", "minLength", "maxLength", "pattern")] + ["http://www.w3.org/1999/02/22-rdf-syntax-ns#langRange"]
LEXICAL = {f"{XSD}integer": r"[+-]?\d+", f"{XSD}nonNegativeInteger": r"\+?\d+|-0+", f"{XSD}int": r"[+-]?\d+", f"{XSD}long": r"[+-]?\d+", f"{XSD}decimal": r"[+-]?(\d+(\.\d*)?|\.\d+)", f"{XSD}boolean": "true|false|1|0"}
KINDS = {"class": "class", "prop": "object property", "dprop": "data property", "aprop": "annotation property", "data": "datatype"}
DECLARED = {"Class": "class", "ObjectProperty": "prop", "DataProperty": "dprop", "AnnotationProperty": "aprop", "Datatype": "data", "NamedIndividual": "ind"}


def _roles(grammar: dict) -> Column:
    """For each node of a tree its role, from its parent's role and head and its place: one fold over the nodes, parents first."""
    table = {}
    for role, heads in grammar.items():
        for head, parts in heads.items():
            table |= {f"{role} {head} {i}": r for i, r in enumerate(parts, 1)} | {f"{role} {head} *": parts[-1]}
    known = F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv])

    def step(roles: Column, n: Column) -> Column:
        key = F.concat_ws(" ", F.get(roles, n["parent"]), F.get(F.col("tree"), n["parent"])["head"])
        at = lambda place: F.try_element_at(known, F.concat_ws(" ", key, place))
        role = F.when(n["parent"] < 0, F.lit("axiom")).otherwise(F.coalesce(at(n["place"].cast("string")), at(F.lit("*")), F.lit("skip")))
        return F.array_append(roles, role)

    return F.aggregate("tree", F.array().cast("array<string>"), step)


def labelled(axioms: DataFrame, profile: str = "dl") -> DataFrame:
    """(axiom_id, axiom_type, node, role, head, leaf, text, n_parts, parent_head) of all nodes, each with its role in a profile; what lies below a form that the
    profile doesn't have is skipped."""
    rows = axioms if "tree" in axioms.columns else with_trees(axioms)
    each = rows.withColumn("__roles", _roles(PROFILES[profile])).select("axiom_id", "axiom_type", "tree", "__roles", F.posexplode("tree").alias("node", "n"))
    above = F.get("tree", F.when(F.col("n.parent") >= 0, F.col("n.parent")))["head"]
    return each.select("axiom_id", "axiom_type", "node", F.get("__roles", "node").alias("role"), "n.head", "n.leaf", "n.text", F.size("n.kids").alias("n_parts"), above.alias("parent_head"))


def _found(rows: DataFrame, violation: Column | str, text: str = "text") -> DataFrame:
    return rows.select((F.lit(violation) if isinstance(violation, str) else violation).alias("violation"), "axiom_id", F.col(text).alias("text")).filter("violation IS NOT NULL")


def _misplaced(nodes: DataFrame, grammar: dict) -> Column:
    """The violation of a node by its role, head and number of parts; null for what fits."""
    head, role = F.col("head"), F.col("role")
    out = F.when(role == "skip", None)
    for name, heads in grammar.items():
        if name in MISPLACED:
            out = out.when(~F.col("leaf") & (role == name) & ~(head.isin(*heads) if heads else F.lit(False)), F.lit(MISPLACED[name]))
    if grammar is EL:
        out = out.when(~F.col("leaf") & (head == "ObjectOneOf") & (F.col("n_parts") > 1), "several individuals").when(~F.col("leaf") & (head == "DataOneOf") & (F.col("n_parts") > 1), "several literals")
    if grammar is QL:
        out = out.when(F.col("leaf") & (role == "thing") & ~head.isin(*THINGS), F.lit(MISPLACED["thing"]))
    if grammar is RL:
        out = out.when(F.col("leaf") & role.isin("sub", "super", "equiv") & head.isin(*THINGS), F.concat(F.lit("not a "), F.when(role == "sub", "subclass").when(role == "super", "superclass").otherwise("equivalent class"), F.lit(" expression")))
        out = out.when((role == "few") & ~head.isin("0", "1"), F.lit(MISPLACED["few"]))
    if grammar in (EL, QL):
        out = out.when((role == "ind") & head.startswith("_:"), "anonymous individual").when(F.col("leaf") & (role == "data") & head.isin(*NOT_IN_EL_QL), "illegal data range")
    return out


def _names(nodes: DataFrame) -> DataFrame:
    """(axiom_id, axiom_type, kind, name) of the names that stand for a class, property, datatype or individual."""
    kind = F.when(F.col("role").isin("class", "name"), "class").when(F.col("role").isin("prop", "countprop", "selfprop", "chain"), "prop").when(F.col("role").isin("data", "restricted"), "data")
    kind = kind.when(F.col("role").isin("dprop", "aprop", "ind", "anyprop", "defined"), F.col("role"))
    return nodes.filter("leaf").select("axiom_id", "axiom_type", "parent_head", "role", kind.alias("kind"), F.col("head").alias("name")).filter("kind IS NOT NULL")


def _reserved(name: Column) -> Column:
    return reduce(Column.__or__, [name.startswith(r) for r in (*RESERVED, "owl:", "rdf:", "rdfs:", "xsd:")])


def _whole_set(axioms: DataFrame, nodes: DataFrame, absolute: bool) -> list[DataFrame]:
    """Conditions of DL that more than one node, or axiom, tell."""
    col, out = F.col, []
    names = _names(nodes)
    declared = nodes.filter((col("axiom_type") == "Declaration") & col("leaf")).select(col("parent_head").alias("k"), col("head").alias("name"))
    declared = declared.select(F.try_element_at(F.create_map(*[F.lit(x) for kv in DECLARED.items() for x in kv]), F.col("k")).alias("kind"), "name").filter("kind IS NOT NULL").distinct()
    built_in = _reserved(col("name"))
    for kind, what in KINDS.items():
        used = names.filter((col("kind") == kind) & ~built_in).select("axiom_id", col("name").alias("text"))
        out.append(_found(used.join(declared.filter(col("kind") == kind).select(col("name").alias("text")), "text", "left_anti"), f"undeclared {what}"))
    subjects = nodes.filter((col("axiom_type") == "Declaration") & col("leaf")).select("axiom_id", col("parent_head").alias("k"), col("head").alias("name"))
    kinds = F.try_element_at(F.create_map(*[F.lit(x) for k, v in DECLARED.items() if v != "data" for x in (k, KINDS.get(v, "individual"))]), col("k"))
    known = col("name").isin(*THINGS, *NOTHINGS) | col("name").rlike(r"(owl#|owl:)(top|bottom)(Object|Data)Property$") | col("name").rlike(r"(rdf-schema#|rdfs:)(label|comment|seeAlso|isDefinedBy)$")
    out.append(_found(subjects.filter(built_in & ~known), F.concat(F.lit("reserved name of a "), kinds), "name"))
    both = declared.filter("kind = 'class'").select("name").join(declared.filter("kind = 'data'").select("name"), "name", "left_semi")
    out.append(_found(subjects.filter("k = 'Datatype'").join(both, "name", "left_semi"), "class and datatype", "name"))
    defined = names.filter("kind = 'defined'")
    out.append(_found(defined.filter(built_in), "built-in datatype defined", "name"))
    out.append(_found(names.filter("role = 'restricted'").join(defined.filter(~built_in).select("name"), "name", "left_semi"), "defined datatype restricted", "name"))
    out.append(_found(names.filter((col("kind") == "data") & built_in & ~col("name").isin(*DATATYPES)), "unknown datatype", "name"))
    uses = defined.select("axiom_id", col("name").alias("a")).join(names.filter("kind = 'data' AND axiom_type = 'DatatypeDefinition'").select("axiom_id", col("name").alias("b")), "axiom_id")
    round_ = transitive_closure(uses).filter("a = b").select("a")
    out.append(_found(uses.join(round_, "a", "left_semi").select("axiom_id", "a").distinct(), "cycle of datatypes", "a"))
    facet = nodes.filter((col("role") == "facet") & col("leaf") & ~col("head").startswith('"') & ~col("head").isin(*FACETS))
    out.append(_found(facet, "illegal facet"))
    literal = nodes.filter(col("leaf") & col("head").startswith('"')).withColumn("__d", F.regexp_extract("head", r'\^\^<?([^<>]+)>?$', 1)).withColumn("__v", F.regexp_extract("head", r'^"((?:[^"\\]|\\.)*)"', 1))
    wrong = reduce(Column.__or__, [(col("__d") == d) & ~col("__v").rlike(f"^({form})$") for d, form in LEXICAL.items()])
    out.append(_found(literal.filter(wrong), "lexical form"))
    if absolute:
        out.append(_found(names.filter(~col("name").rlike(r"^(_:|[A-Za-z][A-Za-z0-9+.\-]*:)")), "name not absolute", "name"))
    top = nodes.filter((col("axiom_type") == "SubDataPropertyOf") & col("leaf")).groupBy("axiom_id").agg(F.min_by("head", "node").alias("text"), F.max_by("head", "node").alias("__b"))
    is_top = lambda c: col(c).isin(f"{OWL}topDataProperty", "owl:topDataProperty")
    out.append(_found(top.filter(is_top("text") & ~is_top("__b")), "top data property below another"))
    return out + _property_order(axioms, nodes, names)


def _property_order(axioms: DataFrame, nodes: DataFrame, names: DataFrame) -> list[DataFrame]:
    """Properties that have to be simple and aren't, chains whose order goes round, and ranges that a chain doesn't keep."""
    col, out = F.col, []
    parts = nodes.filter("axiom_type = 'SubObjectPropertyOf' AND leaf AND role IN ('prop', 'chain')").groupBy("axiom_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "head", "parent_head"))), lambda x: x["head"]).alias("names"))
    chained = nodes.filter("head = 'ObjectPropertyChain' AND NOT leaf").select("axiom_id").distinct().withColumn("chain", F.lit(True))
    links = stored(parts.join(chained, "axiom_id", "left").select("axiom_id", F.slice("names", 1, F.greatest(F.size("names") - 1, F.lit(0))).alias("low"), F.element_at("names", -1).alias("high"), F.coalesce("chain", F.lit(False)).alias("chain")), "properties")
    plain = links.filter("NOT chain").select(F.get("low", F.lit(0)).alias("a"), col("high").alias("b"))
    equal = names.filter("axiom_type = 'EquivalentObjectProperties'").select("axiom_id", col("name").alias("a"))
    ring = equal.groupBy("axiom_id").agg(F.min("a").alias("b")).join(equal, "axiom_id").filter("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(col("b").alias("a"), col("a").alias("b")))).alias("t")).select("t.*")
    above = transitive_closure(plain.unionByName(ring))
    start = names.filter("axiom_type = 'TransitiveObjectProperty'").select(col("name").alias("a")).unionByName(links.filter("chain").select(col("high").alias("a"))).distinct()
    composite = start.unionByName(above.join(start, "a", "left_semi").select(col("b").alias("a"))).distinct().withColumnRenamed("a", "name")
    places = {"FunctionalObjectProperty": "a functional property", "InverseFunctionalObjectProperty": "an inverse functional property", "IrreflexiveObjectProperty": "an irreflexive property", "AsymmetricObjectProperty": "an asymmetric property", "DisjointObjectProperties": "disjoint properties"}
    where = F.when(col("role") == "countprop", "a cardinality").when(col("role") == "selfprop", "a restriction to self")
    for kind, what in places.items():
        where = where.when(col("axiom_type") == kind, what)
    out.append(_found(names.filter("kind = 'prop'").withColumn("__w", where).filter("__w IS NOT NULL").join(composite, "name", "left_semi"), F.concat(F.lit("not simple in "), col("__w")), "name"))
    n = F.size("low")
    chains = links.filter("chain").select("axiom_id", "high", "low", F.posexplode("low").alias("i", "part"))
    both = (n == 2) & (F.get("low", F.lit(0)) == col("high")) & (F.get("low", F.lit(1)) == col("high"))
    own = (col("part") == col("high")) & (both | ((col("i") == 0) & (F.element_at("low", -1) != col("high"))) | ((col("i") == n - 1) & (F.get("low", F.lit(0)) != col("high"))))
    strict = stored(chains.filter(~own).select("axiom_id", col("part").alias("a"), col("high").alias("b")), "order")
    order = transitive_closure(strict.select("a", "b").unionByName(plain).unionByName(ring))
    back = order.select(col("b").alias("a"), col("a").alias("b")).unionByName(strict.filter("a = b").select("a", "b")).distinct()
    out.append(_found(strict.join(back, ["a", "b"], "left_semi").select("axiom_id", "b").distinct(), "cycle through a chain", "b"))
    return out


def _chain_ranges(nodes: DataFrame) -> DataFrame:
    """EL: a range of what a chain makes has to be one of its last property too."""
    ranges = nodes.filter("axiom_type = 'ObjectPropertyRange'")
    of = ranges.filter("role = 'prop'").select("axiom_id", F.col("head").alias("p")).join(ranges.filter("role = 'class' AND parent_head = 'ObjectPropertyRange'").select("axiom_id", F.col("text").alias("c")), "axiom_id").select("p", "c").distinct()
    ends = nodes.filter("axiom_type = 'SubObjectPropertyOf' AND leaf").select("axiom_id", "node", "head", (F.col("parent_head") == "ObjectPropertyChain").alias("inside"))
    pair = ends.groupBy("axiom_id").agg(F.max_by("head", F.when(F.col("inside"), F.col("node"))).alias("last"), F.max(F.when(~F.col("inside"), F.col("head"))).alias("p"), F.max("inside").alias("chain")).filter("chain")
    missing = pair.join(of, "p").join(of.select(F.col("p").alias("last"), "c"), ["last", "c"], "left_anti")
    return _found(missing, "range of a chain", "last")


def violations(axioms: DataFrame, profile: str = "dl", absolute: bool = False) -> DataFrame:
    """(violation, axiom_id, text): what keeps axioms (axiom_id, axiom_type, sexpr) out of a profile, with the part or name that does.

    Each axiom's expressions are labelled by the profile's grammar in one scan; declared names, the order of properties and cycles are joins
    and closures over the names, which grow with the schema. Every profile has DL's conditions too. With `absolute`, names have to be absolute
    IRIs. An axiom without one whole form is an illegal axiom.
    """
    if profile not in PROFILES:
        raise ValueError(f"{profile} isn't among {tuple(PROFILES)}")
    trees = stored(with_trees(axioms.select("axiom_id", "axiom_type", "sexpr")), "trees")
    whole = stored(labelled(trees), "nodes")
    own = whole if profile == "dl" else stored(labelled(trees, profile), "nodes")
    found = [_found(trees.filter("tree IS NULL"), "illegal axiom", "sexpr"), _found(own, _misplaced(own, PROFILES[profile])), *_whole_set(axioms, whole, absolute)]
    if profile == "el":
        found.append(_chain_ranges(whole))
    return reduce(DataFrame.unionByName, found).distinct()
