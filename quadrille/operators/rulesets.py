"""Rules of bundles beyond RDFS-plus: restrictions, lists, keys, cardinalities, schemas, and contradictions.

A rule is a function of a graph (s, p, o, thing) and the lists of its schema to the triples, or the links between
equal individuals, that follow in one step. `thing` tells whether the object is none but a literal.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.terms import DOMAIN, OWL, RANGE, SUBCLASS, SUBPROPERTY, TYPE
from quadrille.operators.mapping import list_members
from quadrille.plans.stages import stored

SAME, THING, NOTHING = f"{OWL}sameAs", f"{OWL}Thing", f"{OWL}Nothing"
ONE, ZERO = r'^"?0*1"?(\^\^.*)?$', r'^"?0+"?(\^\^.*)?$'


def _triples(df: DataFrame, s: Column | str, p: Column | str, o: Column | str, thing: Column | None = None) -> DataFrame:
    """Triples of columns (a text is a column's name)."""
    col = lambda x: F.col(x) if isinstance(x, str) else x
    return df.select(col(s).alias("s"), col(p).alias("p"), col(o).alias("o"), (F.lit(True) if thing is None else thing).alias("thing"))


def _pairs(full: DataFrame, p: str, s: str, o: str) -> DataFrame:
    return full.filter(F.col("p") == p).select(F.col("s").alias(s), F.col("o").alias(o))


def _types(full: DataFrame, x: str = "x", c: str = "c") -> DataFrame:
    return _pairs(full, TYPE, x, c)


def _flagged(full: DataFrame, kind: str) -> DataFrame:
    return full.filter((F.col("p") == TYPE) & (F.col("o") == f"{OWL}{kind}")).select(F.col("s").alias("p"))


def _restrictions(full: DataFrame, kind: str) -> DataFrame:
    """(v, w, p): the restrictions v of a kind, with filler w, on property p."""
    return _pairs(full, f"{OWL}{kind}", "v", "w").join(_pairs(full, f"{OWL}onProperty", "v", "p"), "v")


class Lists:
    """The lists of a schema, read once: rules make no new ones."""

    def __init__(self, base: DataFrame):
        members = list_members(base)
        owned = base.join(members, base["o"] == members["head"]).select(F.col("s").alias("owner"), "p", "head", "items")
        self.rows = stored(owned, "lists")

    def of(self, predicate: str, distinct: bool = True) -> DataFrame:
        """(owner, head, size, place, item) of the lists that a predicate leads to."""
        items = F.array_distinct("items") if distinct else F.col("items")
        rows = self.rows.filter(F.col("p") == f"{OWL}{predicate}").select("owner", "head", items.alias("items"))
        return rows.select("owner", "head", F.size("items").alias("size"), F.posexplode("items").alias("place", "item"))

    def longest(self, predicate: str) -> int:
        """The number of items of a predicate's longest list, a number of the schema."""
        return self.rows.filter(F.col("p") == f"{OWL}{predicate}").agg(F.coalesce(F.max(F.size("items")), F.lit(0)).alias("n")).first()["n"]


#: What rules look for: properties, and kinds of properties. A rule of whose names a graph has none is left out of the round's plan.
TRIGGERS = (
    SUBCLASS, SUBPROPERTY, DOMAIN, RANGE, SAME,
    *(f"{OWL}{n}" for n in ("inverseOf", "SymmetricProperty", "TransitiveProperty", "FunctionalProperty", "InverseFunctionalProperty")),
    *(f"{OWL}{n}" for n in ("onProperty", "intersectionOf", "propertyChainAxiom", "hasKey", "maxCardinality", "cardinality", "maxQualifiedCardinality", "qualifiedCardinality")),
)


def present(graph: DataFrame) -> set[str]:
    """Those of TRIGGERS that a graph uses: a set of at most that many names."""
    used = F.when(F.col("p") == TYPE, F.col("o")).otherwise(F.col("p"))
    return {r["n"] for r in graph.select(used.alias("n")).filter(F.col("n").isin(*TRIGGERS)).distinct().collect()}


def needs(*names: str):
    """Marks a rule with the names without which it makes nothing."""

    def mark(rule):
        rule.needs = {n if ":" in n else f"{OWL}{n}" for n in names}
        return rule

    return mark


# ---- what lists say once, before any round ----


def list_seeds(lists: Lists) -> DataFrame:
    """Intersections are below their members, members of unions below the union; what is enumerated is a member."""
    union = lists.of("unionOf").unionByName(lists.of("disjointUnionOf"))
    made = _triples(lists.of("intersectionOf"), "owner", F.lit(SUBCLASS), "item")
    return made.unionByName(_triples(union, "item", F.lit(SUBCLASS), "owner")).unionByName(_triples(lists.of("oneOf"), "item", F.lit(TYPE), "owner"))


# ---- rules that make triples ----


@needs("onProperty")
def restrictions(full: DataFrame, lists: Lists) -> DataFrame:
    """hasValue, someValuesFrom and allValuesFrom from triples to types and, for all and value, back."""
    types = _types(full)
    value, some, every = _restrictions(full, "hasValue"), _restrictions(full, "someValuesFrom"), _restrictions(full, "allValuesFrom")
    valued = full.filter((F.col("p") == f"{OWL}hasValue")).select(F.col("s").alias("v"), F.col("o").alias("w"), F.col("thing").alias("__t")).join(_pairs(full, f"{OWL}onProperty", "v", "p"), "v")
    holders = full.join(value.withColumnRenamed("w", "o"), ["p", "o"])
    made = _triples(holders, "s", F.lit(TYPE), "v").unionByName(_triples(types.join(valued, types["c"] == valued["v"]), "x", "p", "w", F.col("__t")))
    met = full.join(some, "p").join(types, (F.col("o") == F.col("x")) & (F.col("w") == F.col("c")))
    owners = types.join(every, types["c"] == every["v"]).select(F.col("x").alias("s"), "p", "w")
    return made.unionByName(_triples(met, "s", F.lit(TYPE), "v")).unionByName(_triples(full.filter("thing").join(owners, ["s", "p"]), "o", F.lit(TYPE), "w"))


@needs("onProperty")
def some_things(full: DataFrame, lists: Lists) -> DataFrame:
    """Whoever has a value at all is in the restriction to some value of any kind."""
    some = _restrictions(full, "someValuesFrom").filter(F.col("w") == THING)
    return _triples(full.join(some, "p"), "s", F.lit(TYPE), "v")


@needs("onProperty")
def some_values(full: DataFrame, lists: Lists) -> DataFrame:
    """Whoever has a value is in the restriction to at least one."""
    least = _restrictions(full, "minCardinality").filter(F.col("w").rlike(ONE))
    return _triples(full.join(least, "p"), "s", F.lit(TYPE), "v")


@needs("intersectionOf")
def intersections(full: DataFrame, lists: Lists) -> DataFrame:
    """What is in all members of an intersection is in it: the members that each name matches are counted against the list."""
    members = lists.of("intersectionOf").select("owner", "size", F.col("item").alias("c"))
    matched = _types(full).join(members, "c").groupBy("x", "owner", "size").agg(F.count("*").alias("n")).filter("n = size")
    return _triples(matched, "x", F.lit(TYPE), "owner")


@needs("propertyChainAxiom")
def chains(full: DataFrame, lists: Lists) -> DataFrame:
    """Paths along a property chain are links of the property: one join for each place of the longest chain."""
    places, depth = lists.of("propertyChainAxiom", distinct=False), lists.longest("propertyChainAxiom")
    if not depth:
        return full.limit(0)
    links = full.select("s", F.col("p").alias("item"), F.col("o").alias("__o"), F.col("thing").alias("__t"))
    at = lambda k: places.filter(F.col("place") == k).select("owner", "head", "size", "item")
    now = links.join(at(0), "item").select("owner", "head", "size", F.col("s").alias("x"), F.col("__o").alias("y"), F.col("__t").alias("t"))
    done = now.filter("size = 1")
    for k in range(1, depth):
        ahead = now.filter((F.col("size") > k) & F.col("t")).join(at(k), ["owner", "head", "size"])
        now = ahead.join(links.withColumnRenamed("s", "y"), ["item", "y"]).select("owner", "head", "size", "x", F.col("__o").alias("y"), F.col("__t").alias("t"))
        done = done.unionByName(now.filter(F.col("size") == k + 1))
    return _triples(done, "x", "owner", "y", F.col("t"))


@needs("maxCardinality", "FunctionalProperty", "InverseFunctionalProperty")
def characteristics(full: DataFrame, lists: Lists) -> DataFrame:
    """A property of which everything has at most one value is functional; inverses of functional ones are inverse functional, and so round."""
    most = _restrictions(full, "maxCardinality").filter(F.col("w").rlike(ONE))
    always = _pairs(full, SUBCLASS, "__t", "v").filter(F.col("__t") == THING)
    made = _triples(most.join(always, "v"), "p", F.lit(TYPE), F.lit(f"{OWL}FunctionalProperty"))
    inverse = _pairs(full, f"{OWL}inverseOf", "a", "b")
    inverse = inverse.unionByName(inverse.select(F.col("b").alias("a"), F.col("a").alias("b")))
    for one, other in (("FunctionalProperty", "InverseFunctionalProperty"), ("InverseFunctionalProperty", "FunctionalProperty")):
        turned = inverse.join(_flagged(full, one).withColumnRenamed("p", "a"), "a")
        made = made.unionByName(_triples(turned, "b", F.lit(TYPE), F.lit(f"{OWL}{other}")))
    return made


@needs(SUBCLASS, SUBPROPERTY)
def schemas(full: DataFrame, lists: Lists) -> DataFrame:
    """Equivalences of what is below each other; domains and ranges upwards and of properties below; restrictions below each other."""
    sub, prop = _pairs(full, SUBCLASS, "a", "b"), _pairs(full, SUBPROPERTY, "a", "b")
    made = []
    for links, p in ((sub, "equivalentClass"), (prop, "equivalentProperty")):
        back = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
        made.append(_triples(links.join(back, ["a", "b"], "left_semi").filter("a <> b"), "a", F.lit(f"{OWL}{p}"), "b"))
    for p in (DOMAIN, RANGE):
        own = _pairs(full, p, "q", "c")
        made.append(_triples(own.join(sub.withColumnRenamed("a", "c"), "c"), "q", F.lit(p), "b"))
        made.append(_triples(own.join(prop.withColumnRenamed("b", "q"), "q"), "a", F.lit(p), "c"))
    for kind in ("someValuesFrom", "allValuesFrom", "hasValue"):
        low = _restrictions(full, kind).select(F.col("v").alias("low"), F.col("w").alias("lw"), F.col("p").alias("lp"))
        high = _restrictions(full, kind).select(F.col("v").alias("high"), F.col("w").alias("hw"), F.col("p").alias("hp"))
        if kind != "hasValue":
            fillers = low.join(sub, F.col("lw") == F.col("a")).join(high, (F.col("b") == F.col("hw")) & (F.col("lp") == F.col("hp")))
            made.append(_triples(fillers, "low", F.lit(SUBCLASS), "high"))
        along = low.join(prop, F.col("lp") == F.col("a")).join(high, (F.col("b") == F.col("hp")) & (F.col("lw") == F.col("hw")))
        made.append(_triples(along, *(("high", F.lit(SUBCLASS), "low") if kind == "allValuesFrom" else ("low", F.lit(SUBCLASS), "high"))))
    return reduce(DataFrame.unionByName, made)


# ---- rules that link equal individuals: of those that are equal, each with the smallest ----


def _to_smallest(rows: DataFrame, *key: str) -> DataFrame:
    """(a, b) of rows (key..., a): never pairs of a group."""
    return rows.join(rows.groupBy(*key).agg(F.min("a").alias("b")), list(key)).select("a", "b").filter("a <> b")


@needs(SAME)
def same_stated(full: DataFrame, lists: Lists) -> DataFrame:
    return _pairs(full, SAME, "a", "b").filter("a <> b")


@needs("FunctionalProperty", "InverseFunctionalProperty")
def same_by_function(full: DataFrame, lists: Lists) -> DataFrame:
    """The values of a functional property, and the holders of one value of an inverse functional one."""
    things = full.filter("thing")
    made = [_to_smallest(things.join(_flagged(full, kind), "p").select("p", F.col(key).alias("k"), F.col(value).alias("a")), "p", "k") for kind, key, value in (("FunctionalProperty", "s", "o"), ("InverseFunctionalProperty", "o", "s"))]
    return reduce(DataFrame.unionByName, made)


@needs("hasKey")
def same_by_key(full: DataFrame, lists: Lists) -> DataFrame:
    """Members of a class that share a value of each property of its key; values of several properties are combined, members are not."""
    places, depth = lists.of("hasKey"), lists.longest("hasKey")
    if not depth:
        return full.select(F.col("s").alias("a"), F.col("o").alias("b")).limit(0)
    at = lambda k: places.filter(F.col("place") == k).select("owner", "head", "size", "item")
    values = full.select(F.col("s").alias("a"), F.col("p").alias("item"), F.concat(F.col("thing").cast("string"), F.lit(" "), F.col("o")).alias("__v"))
    now = _types(full, "a", "owner").join(at(0), "owner").join(values, ["a", "item"]).select("owner", "head", "size", "a", F.array("__v").alias("k"))
    done = now.filter("size = 1")
    for i in range(1, depth):
        ahead = now.filter(F.col("size") > i).join(at(i), ["owner", "head", "size"]).join(values, ["a", "item"])
        now = ahead.select("owner", "head", "size", "a", F.array_append("k", F.col("__v")).alias("k"))
        done = done.unionByName(now.filter(F.col("size") == i + 1))
    return _to_smallest(done.select("owner", "head", "k", "a"), "owner", "head", "k")


def _counted(full: DataFrame, number: str, plain: tuple[str, ...], qualified: tuple[str, ...]) -> DataFrame:
    """(x, v, p, y): the values, of the class that the restriction names, of the members of restrictions to at most a number."""
    most = lambda kinds: reduce(DataFrame.unionByName, [_restrictions(full, k) for k in kinds]).filter(F.col("w").rlike(number)).drop("w")
    held = lambda own: _types(full, "s", "v").join(own, "v").join(full.filter("thing").select("s", "p", F.col("o").alias("y")), ["s", "p"])
    of = held(most(qualified)).join(_pairs(full, f"{OWL}onClass", "v", "c"), "v")
    fits = of.filter(F.col("c") == THING).drop("c").unionByName(of.join(_types(full, "y", "c"), ["y", "c"], "left_semi").select("v", "s", "p", "y"), allowMissingColumns=True)
    return held(most(plain)).select("s", "v", "p", "y").unionByName(fits.select("s", "v", "p", "y")).distinct().withColumnRenamed("s", "x")


@needs("maxCardinality", "cardinality", "maxQualifiedCardinality", "qualifiedCardinality")
def same_by_maximum(full: DataFrame, lists: Lists) -> DataFrame:
    """The values that a restriction allows one of."""
    rows = _counted(full, ONE, ("maxCardinality", "cardinality"), ("maxQualifiedCardinality", "qualifiedCardinality"))
    return _to_smallest(rows.select("x", "v", "p", F.col("y").alias("a")), "x", "v", "p")


#: Bundles: whether transitive properties are closed, the rules that make triples, those that link equals.
RULESETS = {
    "horst": (True, (restrictions,), (same_stated, same_by_function)),
    "owl2-ql": (False, (some_things, schemas), (same_stated,)),
    "owl2-rl": (True, (restrictions, some_things, intersections, chains, schemas), (same_stated, same_by_function, same_by_key, same_by_maximum)),
    "owl-max": (True, (restrictions, some_things, some_values, intersections, characteristics), (same_stated, same_by_function, same_by_maximum)),
}
#: Bundles that read lists.
WITH_LISTS = ("owl2-rl", "owl-max")


# ---- contradictions ----


def contradictions(full: DataFrame, equals: DataFrame, lists: Lists) -> DataFrame:
    """(rule, s, p, o) for all that can't be, in a closed graph of one name for equals: for a rule on two individuals o is the other; on a class, p is rdf:type.

    Members of a list that exclude each other are counted for each individual, not paired.
    """
    types, col = _types(full), F.col
    found: list[tuple[str, DataFrame]] = []
    row = lambda df, s, p, o: df.select(s.alias("s"), p.alias("p"), o.alias("o")).distinct()
    plain = full.select("s", "p", "o")
    found.append(("different equals", plain.filter((col("p") == f"{OWL}differentFrom") & (col("s") == col("o")))))
    for predicate in ("members", "distinctMembers"):
        listed = lists.of(predicate).join(_types(full, "owner", "__k").filter(col("__k") == f"{OWL}AllDifferent"), "owner")
        named = listed.join(equals.select(col("node").alias("item"), "root"), "item", "left").select("owner", "item", F.coalesce("root", "item").alias("name"))
        found.append(("different equals", row(named.groupBy("owner", "name").agg(F.count("*").alias("n")).filter("n > 1"), col("name"), F.lit(f"{OWL}differentFrom"), col("name"))))
    found.append(("irreflexive", row(full.filter("s = o").join(_flagged(full, "IrreflexiveProperty"), "p", "left_semi"), col("s"), col("p"), col("o"))))
    one_way = full.filter("thing").join(_flagged(full, "AsymmetricProperty"), "p", "left_semi").select("s", "p", "o")
    found.append(("asymmetric", one_way.join(one_way.select(col("o").alias("s"), "p", col("s").alias("o")), ["s", "p", "o"], "left_semi")))
    apart = _pairs(full, f"{OWL}propertyDisjointWith", "p", "q")
    both = full.join(apart, "p").join(full.select("s", col("p").alias("q"), "o", "thing"), ["s", "q", "o", "thing"], "left_semi")
    found.append(("disjoint properties", row(both, col("s"), col("p"), col("o"))))
    listed = lists.of("members").join(_types(full, "owner", "__k").filter(col("__k") == f"{OWL}AllDisjointProperties"), "owner").select("owner", col("item").alias("p"))
    several = full.join(listed, "p").groupBy("owner", "s", "o", "thing").agg(F.count("*").alias("n"), F.min("p").alias("p")).filter("n > 1")
    found.append(("disjoint properties", row(several, col("s"), col("p"), col("o"))))
    denied = _pairs(full, f"{OWL}sourceIndividual", "n", "s").join(_pairs(full, f"{OWL}assertionProperty", "n", "p"), "n")
    for target, thing in (("targetIndividual", True), ("targetValue", False)):
        said = denied.join(_pairs(full, f"{OWL}{target}", "n", "o"), "n").select("s", "p", "o", F.lit(thing).alias("thing"))
        found.append(("denied", full.join(said, ["s", "p", "o", "thing"], "left_semi").select("s", "p", "o")))
    found.append(("in nothing", row(types.filter(col("c") == NOTHING), col("x"), F.lit(TYPE), col("c"))))
    for predicate, name in (("complementOf", "complement"), ("disjointWith", "disjoint classes")):
        pair = types.join(_pairs(full, f"{OWL}{predicate}", "c", "__d"), "c").join(types.select("x", col("c").alias("__d")), ["x", "__d"], "left_semi")
        found.append((name, row(pair, col("x"), F.lit(TYPE), col("c"))))
    listed = lists.of("members").join(_types(full, "owner", "__k").filter(col("__k") == f"{OWL}AllDisjointClasses"), "owner").select("owner", col("item").alias("c"))
    listed = listed.unionByName(lists.of("disjointUnionOf").select("owner", col("item").alias("c")))
    several = types.join(listed, "c").groupBy("owner", "x").agg(F.count("*").alias("n"), F.min("c").alias("c")).filter("n > 1")
    found.append(("disjoint classes", row(several, col("x"), F.lit(TYPE), col("c"))))
    none = _counted(full, ZERO, ("maxCardinality", "cardinality"), ("maxQualifiedCardinality", "qualifiedCardinality"))
    found.append(("above the maximum", row(none, col("x"), col("p"), col("y"))))
    return reduce(DataFrame.unionByName, [rows.select(F.lit(name).alias("rule"), "s", "p", "o") for name, rows in found]).distinct()


def expanded(triples: DataFrame, equals: DataFrame) -> DataFrame:
    """(s, p, o) with every name of a class of equals in place of its one name, and sameAs between all of them: for output, since it grows
    with the square of a class."""
    names = equals.select(F.col("node").alias("__n"), F.col("root").alias("__r"))
    out = triples
    for c in ("s", "o"):
        on = (F.col(c) == F.col("__r")) & (F.lit(True) if c == "s" else F.col("thing"))
        out = out.join(names, on, "left").withColumn(c, F.coalesce("__n", c)).drop("__n", "__r")
    other = names.select(F.col("__n").alias("o"), "__r")
    same = names.join(other, "__r").filter(F.col("__n") != F.col("o")).select(F.col("__n").alias("s"), F.lit(SAME).alias("p"), "o")
    return out.select("s", "p", "o").unionByName(same).distinct()
