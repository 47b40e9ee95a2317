"""Class and property hierarchies, instances, restrictions and labels, over edges and triples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadrille.functions.terms import DOMAIN, LABEL, OWL, RANGE, SUBCLASS, SUBPROPERTY, TYPE
from quadrille.plans.fixpoint import reachable, transitive_closure
from quadrille.plans.stages import Rounds, free, stored

NOTHING, THING = f"{OWL}Nothing", f"{OWL}Thing"


def edges_of(triples: DataFrame, predicate: str = SUBCLASS) -> DataFrame:
    return triples.filter(F.col("p") == predicate).select(F.col("s").alias("a"), F.col("o").alias("b")).distinct()


def subsumptions(edges: DataFrame) -> DataFrame:
    """The closure of sub -> super, each node with itself left out unless a cycle leads back."""
    return transitive_closure(edges)


def equivalents(closure: DataFrame) -> DataFrame:
    """(a, b) of different nodes that reach each other."""
    back = closure.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return closure.filter("a <> b").join(back, ["a", "b"], "left_semi")


def direct(closure: DataFrame) -> DataFrame:
    """The direct links of a closure: strict ones without a node strictly between. Nodes that reach each
    other count as one, so all members of a class of equivalents keep the links of the class."""
    strict = closure.join(closure.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti").filter("a <> b")
    between = strict.join(strict.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")).distinct()
    return strict.join(between, ["a", "b"], "left_anti")


def direct_links(edges: DataFrame) -> DataFrame:
    """The direct links of edges(a, b), as `direct` gives them from the closure. A direct link is a stated one (between classes of nodes
    that reach each other), so only stated links are tested: one that another stated link followed by a path replaces goes."""
    closure = transitive_closure(edges)
    ring = closure.join(closure.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_semi")
    names = stored(ring.groupBy("a").agg(F.min("b").alias("name")), "rings")

    def named(rows: DataFrame) -> DataFrame:
        for c in ("a", "b"):
            own = names.select(F.col("a").alias(c), F.col("name").alias("__name"))
            rows = rows.join(own, c, "left").withColumn(c, F.coalesce("__name", c)).drop("__name")
        return rows.select("a", "b").filter("a <> b").distinct()

    links, paths = named(edges), named(closure)
    around = links.join(paths.select(F.col("a").alias("b"), F.col("b").alias("__c")), "b").select("a", F.col("__c").alias("b"))
    out = links.join(around, ["a", "b"], "left_anti")
    for c in ("a", "b"):
        members = names.select(F.col("name").alias(c), F.col("a").alias("__m"))
        out = out.join(members, c, "left").withColumn(c, F.coalesce("__m", c)).drop("__m")
    return out.select("a", "b")


def children(closure: DataFrame, node: str) -> DataFrame:
    return direct(closure).filter(F.col("b") == node).select(F.col("a").alias("node"))


def parents(closure: DataFrame, node: str) -> DataFrame:
    return direct(closure).filter(F.col("a") == node).select(F.col("b").alias("node"))


def descendants(closure: DataFrame, node: str) -> DataFrame:
    return closure.filter((F.col("b") == node) & (F.col("a") != node) & (F.col("a") != NOTHING)).select(F.col("a").alias("node"))


def ancestors(closure: DataFrame, node: str) -> DataFrame:
    return closure.filter((F.col("a") == node) & (F.col("b") != node)).select(F.col("b").alias("node"))


def below(edges: DataFrame, node: str) -> DataFrame:
    """The descendants of one node, by a search down from it: nothing else is closed."""
    down = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    found = reachable(down, edges.sparkSession.createDataFrame([(node,)], "a string"))
    return found.filter((F.col("b") != node) & (F.col("b") != NOTHING)).select(F.col("b").alias("node"))


def above(edges: DataFrame, node: str) -> DataFrame:
    """The ancestors of one node, by a search up from it."""
    found = reachable(edges, edges.sparkSession.createDataFrame([(node,)], "a string"))
    return found.filter(F.col("b") != node).select(F.col("b").alias("node"))


def leaves(edges: DataFrame) -> DataFrame:
    """Nodes that no other than owl:Nothing is below."""
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().filter(F.col("node") != NOTHING)
    return nodes.join(edges.filter((F.col("a") != NOTHING) & (F.col("a") != F.col("b"))).select(F.col("b").alias("node")), "node", "left_anti")


def roots(edges: DataFrame) -> DataFrame:
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return nodes.join(edges.filter("a <> b").select(F.col("a").alias("node")), "node", "left_anti")


def instances(types: DataFrame, closure: DataFrame) -> DataFrame:
    """All (i, c): types(i, c) and the classes above them."""
    above = types.join(closure.select(F.col("a").alias("c"), F.col("b").alias("__up")), "c").select("i", F.col("__up").alias("c"))
    return types.select("i", "c").unionByName(above).distinct()


def most_specific(types: DataFrame, closure: DataFrame) -> DataFrame:
    """The types of an individual that none of its other types is strictly below."""
    strict = closure.join(closure.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
    above = types.join(strict.select(F.col("a").alias("c"), F.col("b").alias("__up")), "c").select("i", F.col("__up").alias("c"))
    return types.select("i", "c").distinct().join(above, ["i", "c"], "left_anti")


def is_subclass(closure: DataFrame, sub: str, sup: str) -> bool:
    return sub == sup or sup == THING or not closure.filter((F.col("a") == sub) & (F.col("b") == sup)).isEmpty()


def domains_and_ranges(triples: DataFrame, which: str = DOMAIN) -> DataFrame:
    """(p, c): declared domains (or ranges) of a property and of those above it, and the classes above them."""
    if which not in (DOMAIN, RANGE):
        raise ValueError("which: rdfs:domain or rdfs:range")
    declared = triples.filter(F.col("p") == which).select(F.col("s").alias("q"), F.col("o").alias("c"))
    up = transitive_closure(edges_of(triples, SUBPROPERTY))
    own = declared.withColumnRenamed("q", "p")
    inherited = up.select(F.col("a").alias("p"), F.col("b").alias("q")).join(declared, "q").select("p", "c")
    known = own.unionByName(inherited).distinct()
    above = known.join(transitive_closure(edges_of(triples)).select(F.col("a").alias("c"), F.col("b").alias("__up")), "c").select("p", F.col("__up").alias("c"))
    return known.unionByName(above).distinct()


def unsatisfiable(closure: DataFrame, disjoint: DataFrame) -> DataFrame:
    """Classes below both of a disjoint pair(a, b), or below owl:Nothing."""
    self_ = closure.select(F.explode(F.array("a", "b")).alias("a")).distinct()
    reach = closure.unionByName(self_.withColumn("b", F.col("a"))).distinct()
    left = disjoint.join(reach.select(F.col("a").alias("node"), F.col("b").alias("a")), "a").select("node", "b")
    both = left.join(reach.select(F.col("a").alias("node"), "b"), ["node", "b"]).select("node")
    empty = closure.filter(F.col("b") == NOTHING).select(F.col("a").alias("node"))
    return both.unionByName(empty).distinct()


def inconsistent_individuals(types: DataFrame, closure: DataFrame, disjoint: DataFrame) -> DataFrame:
    """Individuals of an unsatisfiable class or of two disjoint ones; none: consistent, as far as these rules tell."""
    every = instances(types, closure)
    pair = disjoint.select(F.col("a").alias("c"), F.col("b").alias("d"))
    two = every.join(pair, "c").join(every.select("i", F.col("c").alias("d")), ["i", "d"]).select("i")
    bottom = every.join(unsatisfiable(closure, disjoint).withColumnRenamed("node", "c"), "c").select("i")
    return two.unionByName(bottom).distinct()


def signature(triples: DataFrame, kind: str) -> DataFrame:
    """Entities declared with a type, as owl:Class."""
    return triples.filter((F.col("p") == TYPE) & (F.col("o") == kind)).select(F.col("s").alias("iri")).distinct()


def punned(triples: DataFrame) -> DataFrame:
    """(iri, types) of the IRIs declared as entities of more than one type."""
    return triples.filter((F.col("p") == TYPE) & F.col("o").startswith(OWL)).groupBy(F.col("s").alias("iri")).agg(F.array_sort(F.collect_set("o")).alias("types")).filter(F.size("types") > 1)


#: Characteristics that no property may have together, as OWL 2 fixes for object properties.
FORBIDDEN = [("AsymmetricProperty", "SymmetricProperty"), ("AsymmetricProperty", "ReflexiveProperty"), ("IrreflexiveProperty", "ReflexiveProperty"), ("AsymmetricProperty", "TransitiveProperty"), ("FunctionalProperty", "TransitiveProperty"), ("InverseFunctionalProperty", "TransitiveProperty"), ("IrreflexiveProperty", "TransitiveProperty")]


def forbidden_characteristics(triples: DataFrame) -> DataFrame:
    pairs = triples.sparkSession.createDataFrame([(OWL + a, OWL + b) for a, b in FORBIDDEN], "first string, second string")
    own = triples.filter(F.col("p") == TYPE).select(F.col("s").alias("iri"), F.col("o").alias("first"))
    return own.join(F.broadcast(pairs), "first").join(own.select("iri", F.col("first").alias("second")), ["iri", "second"]).select("iri", "first", "second")


def levels(edges: DataFrame) -> DataFrame:
    """(node, level): the longest path from a root; nodes on or below a cycle have none."""
    level = 0
    rounds = Rounds(roots(edges).withColumn("level", F.lit(0)), "levels")
    now = rounds.last()
    open_ = stored(edges.filter("a <> b").distinct(), "open-edges")
    while True:
        # a node's level is known once all nodes above it have theirs: the last of its links has just gone
        gone = open_.join(now.select(F.col("node").alias("b")), "b", "left_semi").select(F.col("a").alias("node")).distinct()
        rest = stored(open_.join(now.select(F.col("node").alias("b")), "b", "left_anti"), "open-edges")
        level += 1
        now = rounds.add(gone.join(rest.select(F.col("a").alias("node")), "node", "left_anti").withColumn("level", F.lit(level)))
        free(open_)
        if now.isEmpty():
            free(rest)
            return rounds.all()
        open_ = rest


def depth(edges: DataFrame) -> int:
    return levels(edges).agg(F.max("level")).first()[0] or 0


def necessary_links(edges: DataFrame) -> DataFrame:
    """Asserted links without those that follow from others (transitive reduction); equivalents keep theirs."""
    closure = transitive_closure(edges)
    around = edges.filter("a <> b").join(closure.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").filter("b <> c AND a <> b")
    cyclic = equivalents(closure)
    through = around.join(cyclic.select("a", "b"), ["a", "b"], "left_anti").join(cyclic.select("b", F.col("a").alias("c")), ["b", "c"], "left_anti").select("a", F.col("c").alias("b")).distinct()
    return edges.filter("a <> b").distinct().join(through, ["a", "b"], "left_anti")


def restrictions_up(restrictions: DataFrame, properties: DataFrame, classes: DataFrame) -> DataFrame:
    """Of restrictions(x, p, c): all (x, p2, c2) with p2 p or above and c2 c or above it, as a set."""
    up = restrictions.join(properties.select(F.col("a").alias("p"), F.col("b").alias("__p")), "p").select("x", F.col("__p").alias("p"), "c")
    both = restrictions.select("x", "p", "c").unionByName(up).distinct()
    higher = both.join(classes.select(F.col("a").alias("c"), F.col("b").alias("__c")), "c").select("x", "p", F.col("__c").alias("c"))
    return both.unionByName(higher).distinct()


def inherited_restrictions(restrictions: DataFrame, classes: DataFrame) -> DataFrame:
    """(x, p, c) that x has itself or from a class above it."""
    below = classes.select(F.col("a").alias("__x"), F.col("b").alias("x")).join(restrictions, "x").select(F.col("__x").alias("x"), "p", "c")
    return restrictions.select("x", "p", "c").unionByName(below).distinct()


def nearest_base(edges: DataFrame, base: DataFrame) -> DataFrame:
    """(node, base) of the first base nodes above each node: paths end at the base nodes they meet."""
    stop = base.select(F.col("node").alias("b"))
    # links that go on: their upper end is no base node
    on = edges.join(stop, "b", "left_anti")
    last = edges.join(stop, "b", "left_semi")
    reach = transitive_closure(on).unionByName(edges.select(F.col("a"), F.col("a").alias("b")).distinct()).distinct()
    return reach.join(last.select(F.col("a").alias("b"), F.col("b").alias("base")), "b").select(F.col("a").alias("node"), "base").distinct()


def cross_reach(closure: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b): descendants of a link's subject with ancestors of its object, both ends included."""
    down = closure.select(F.col("a").alias("__d"), F.col("b").alias("a"))
    low = links.select("a", "b").unionByName(links.join(down, "a").select(F.col("__d").alias("a"), "b")).distinct()
    up = closure.select(F.col("a").alias("b"), F.col("b").alias("__u"))
    return low.unionByName(low.join(up, "b").select("a", F.col("__u").alias("b"))).distinct()


def restriction_triples(links: DataFrame) -> DataFrame:
    """OWL triples of links(x, p, c) as x subClassOf (p some c), with a blank node named by the link's hash."""
    node = F.concat(F.lit("urn:blank:"), F.sha1(F.concat_ws(" ", "p", "c")))
    made = F.array(
        F.struct(F.col("x").alias("s"), F.lit(SUBCLASS).alias("p"), node.alias("o")), F.struct(node.alias("s"), F.lit(TYPE).alias("p"), F.lit(f"{OWL}Restriction").alias("o")),
        F.struct(node.alias("s"), F.lit(f"{OWL}onProperty").alias("p"), F.col("p").alias("o")), F.struct(node.alias("s"), F.lit(f"{OWL}someValuesFrom").alias("p"), F.col("c").alias("o")),
    )
    return links.select(F.explode(made).alias("t")).select("t.*").distinct()


def some_restrictions(triples: DataFrame) -> DataFrame:
    """(x, p, c) of all subClassOf links to restrictions with someValuesFrom."""
    on = triples.filter(F.col("p") == f"{OWL}onProperty").select(F.col("s").alias("r"), F.col("o").alias("p"))
    some = triples.filter(F.col("p") == f"{OWL}someValuesFrom").select(F.col("s").alias("r"), F.col("o").alias("c"))
    return edges_of(triples).select(F.col("a").alias("x"), F.col("b").alias("r")).join(on, "r").join(some, "r").select("x", "p", "c")


def term_labels(triples: DataFrame, properties: Sequence[str] = (LABEL,)) -> DataFrame:
    """(iri, prop, prop_rank, lang, label); the rank is the property's place in the list."""
    rank = None
    for i, p in enumerate(properties):
        rank = F.when(F.col("p") == p, i) if rank is None else rank.when(F.col("p") == p, i)
    return triples.filter(F.col("p").isin(list(properties))).select(F.col("s").alias("iri"), F.col("p").alias("prop"), rank.alias("prop_rank"), F.col("o_lang").alias("lang"), F.col("o").alias("label"))


def preferred_labels(labels: DataFrame, lang: str) -> DataFrame:
    """One label for each IRI: by the property's rank, then one in the language before one without any; ties by text."""
    fits = labels.filter(F.col("lang").isNull() | (F.col("lang") == lang))
    order = Window.partitionBy("iri").orderBy("prop_rank", F.col("lang").isNull(), "label")
    return fits.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def labels_or_terms(terms: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """The column's IRIs replaced by their labels(iri, label); those without one stay."""
    named = labels.select(F.col("iri").alias(column), F.col("label").alias("__label"))
    return terms.join(named, column, "left").withColumn(column, F.coalesce("__label", column)).drop("__label").select(terms.columns)


def without_deprecated(rows: DataFrame, triples: DataFrame, column: str = "iri") -> DataFrame:
    gone = triples.filter((F.col("p") == f"{OWL}deprecated") & (F.col("o") == "true")).select(F.col("s").alias(column))
    return rows.join(gone, column, "left_anti")


def ambiguous_labels(labels: DataFrame) -> DataFrame:
    """Labels that more than one IRI has."""
    return labels.groupBy("label").agg(F.count_distinct("iri").alias("n")).filter("n > 1")


def labels_matching(labels: DataFrame, pattern: str) -> DataFrame:
    return labels.filter(F.col("label").rlike(f"(?i){pattern}"))


def tree_rows(edges: DataFrame, root: str, most: int | None = None) -> DataFrame:
    """(node, path, depth) of all paths down from a root, for a tree view; no path repeats a node, so they end.

    most: levels to stop after, if asked.
    """
    rounds = Rounds(edges.sparkSession.createDataFrame([(root, [root], 0)], "node string, path array<string>, depth int"), "tree")
    while most is None or rounds.n <= most:
        down = edges.select(F.col("b").alias("node"), F.col("a").alias("__n")).join(rounds.last(), "node").filter(~F.array_contains("path", F.col("__n")))
        if rounds.add(down.select(F.col("__n").alias("node"), F.concat("path", F.array("__n")).alias("path"), (F.col("depth") + 1).alias("depth"))).isEmpty():
            break
    return rounds.all()


def individual_properties(triples: DataFrame, individual: str, properties: DataFrame) -> DataFrame:
    """(p, o) stated of an individual, and with the properties above p."""
    own = triples.filter(F.col("s") == individual).select("p", "o")
    up = own.join(properties.select(F.col("a").alias("p"), F.col("b").alias("__p")), "p").select(F.col("__p").alias("p"), "o")
    return own.unionByName(up).distinct()


def applicable(domain: DataFrame, range_: DataFrame, classes: DataFrame, sub: str, obj: str) -> DataFrame:
    """Properties whose known domains and ranges(p, c) all hold, by the closure, of two classes; without any, they fit."""
    def unfit(known: DataFrame, cls: str) -> DataFrame:
        up = classes.filter(F.col("a") == cls).select(F.col("b").alias("c"))
        own = known.sparkSession.createDataFrame([(cls,), (THING,)], "c string").unionByName(up)
        return known.join(own, "c", "left_anti").select("p").distinct()

    every = domain.select("p").unionByName(range_.select("p")).distinct()
    return every.join(unfit(domain, sub), "p", "left_anti").join(unfit(range_, obj), "p", "left_anti")

