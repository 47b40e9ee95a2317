"""Entailed triples for named rule bundles, and inferred axioms by type."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions.terms import DOMAIN, IRI, LITERAL, OWL, RANGE, RDF, RDFS, SUBCLASS, SUBPROPERTY, TYPE
from quadrille.operators import rulesets as rs
from quadrille.operators.hierarchy import edges_of
from quadrille.plans.components import representatives
from quadrille.plans.fixpoint import SMALL, transitive_closure
from quadrille.plans.stages import Rounds, free, stored

#: Bundles by name; `none` is the stated graph.
BUNDLES = ("none", "rdfs", "rdfs-plus", *rs.RULESETS)


def _plain(triples: DataFrame) -> DataFrame:
    return triples.select("s", "p", "o")


def _sets(closure: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): the set of nodes above each node, a schema's size."""
    return closure.groupBy(F.col("a").alias(key)).agg(F.collect_set("b").alias(name))


def rdfs(triples: DataFrame) -> DataFrame:
    """(s, p, o): subproperties, subclasses, domains and ranges followed to the end; a literal has no type."""
    return _derived(_spread(_told(triples)).distinct(), set(rs.TRIGGERS))[0].select("s", "p", "o").distinct()


def _told(triples: DataFrame) -> DataFrame:
    """(s, p, o, thing): whether the object is none but a literal."""
    thing = (F.coalesce(F.col("o_kind"), F.lit(IRI)) != LITERAL) if "o_kind" in triples.columns else F.lit(True)
    return triples.select("s", "p", "o", thing.alias("thing"))


def _things(triples: DataFrame) -> DataFrame:
    return _told(triples).distinct()


#: Triples that one task meets the schema with: several follow from each, and a task holds them until they are distinct.
TASK_TRIPLES = 200_000


def _spread(triples: DataFrame) -> DataFrame:
    """The triples, counted, in as many parts as keep a task's share of one size, however many they are."""
    parts = triples.count() // TASK_TRIPLES + 1
    return triples.repartition(parts, "s", "p", "o") if parts > 1 else triples


def _rdfs(base: DataFrame, present: set[str]) -> tuple[DataFrame, list[DataFrame]]:
    """(s, p, o, thing) of a stored base, and the stored tables that it reads: subproperties, subclasses, domains and ranges followed to the end."""
    if not present & {SUBCLASS, SUBPROPERTY, DOMAIN, RANGE}:
        return base, []
    out, before = _derived(_spread(base), present)
    return out.distinct(), before


def _sent(rules: DataFrame, *sets: str) -> DataFrame:
    """The schema's sets by key, sent to all tasks where they are counted to be small: triples then stay where they are."""
    n = rules.agg(*[F.sum(F.greatest(F.size(c), F.lit(1))) for c in sets]).first()
    return F.broadcast(rules) if sum(x or 0 for x in n) <= SMALL else rules


def _derived(base: DataFrame, present: set[str]) -> tuple[DataFrame, list[DataFrame]]:
    """What _rdfs gives, a triple as often as it follows.

    The schema's closures come first, and give for each property the properties above it and its
    domains and ranges. Then each triple meets the schema once, and all that follows from it comes of
    one row: its properties, the types of its ends and the classes above them. A literal has no type.
    present: the names of rulesets.TRIGGERS that the graph uses.
    """
    schema = stored(base.filter(F.col("p").isin(SUBCLASS, SUBPROPERTY, DOMAIN, RANGE)), "schema")
    properties, classes = (transitive_closure(edges_of(schema, p)) if p in present else edges_of(schema, p) for p in (SUBPROPERTY, SUBCLASS))
    above = properties.unionByName(schema.filter(F.col("p").isin(DOMAIN, RANGE)).select(F.col("s").alias("a"), F.col("s").alias("b"))).distinct()
    ends = {}
    for which, name in ((DOMAIN, "__domains"), (RANGE, "__ranges")):
        own = schema.filter(F.col("p") == which).select(F.col("s").alias("b"), F.col("o").alias("__c"))
        ends[name] = above.join(own, "b").groupBy(F.col("a").alias("p")).agg(F.collect_set("__c").alias(name))
    rules = _sets(properties, "p", "__above").join(ends["__domains"], "p", "full_outer").join(ends["__ranges"], "p", "full_outer")
    none = F.array().cast("array<string>")
    row = lambda x, p, o, thing: F.struct(x.alias("s"), p.alias("p"), o.alias("o"), thing.alias("thing"))
    yes, s, o = F.lit(True), F.col("s"), F.col("o")
    made = F.concat(
        F.array(row(s, F.col("p"), o, F.col("thing"))),
        F.transform(F.coalesce("__above", none), lambda p: row(s, p, o, F.col("thing"))),
        F.transform(F.coalesce("__domains", none), lambda c: row(s, F.lit(TYPE), c, yes)),
        F.transform(F.when(F.col("thing"), F.coalesce("__ranges", none)).otherwise(none), lambda c: row(o, F.lit(TYPE), c, yes)),
    )
    out = base.join(_sent(rules, "__above", "__domains", "__ranges"), "p", "left").select(F.explode(made).alias("t")).select("t.*")
    up = _sets(classes, "__c", "__up")
    out = out.withColumn("__c", F.when(F.col("p") == TYPE, F.col("o"))).join(_sent(up, "__up"), "__c", "left")
    out = out.select("s", "p", F.explode(F.concat(F.array("o"), F.coalesce("__up", none))).alias("o"), "thing")
    closed = [classes.select(F.col("a").alias("s"), F.lit(SUBCLASS).alias("p"), F.col("b").alias("o")), properties.select(F.col("a").alias("s"), F.lit(SUBPROPERTY).alias("p"), F.col("b").alias("o"))]
    for rows in closed:
        out = out.unionByName(rows.withColumn("thing", F.lit(True)))
    return out, [schema, properties, classes]


def _flagged(base: DataFrame, kind: str) -> DataFrame:
    return base.filter((F.col("p") == TYPE) & (F.col("o") == OWL + kind)).select(F.col("s").alias("p")).distinct()


def _seed(triples: DataFrame) -> DataFrame:
    """(s, p, o, thing) with equivalences of classes and properties as links both ways."""
    base = _things(triples)
    turn = F.explode(F.array(F.struct("s", "o"), F.struct(F.col("o").alias("s"), F.col("s").alias("o")))).alias("t")
    both = lambda p, q: base.filter(F.col("p") == OWL + p).select(turn).select("t.s", F.lit(q).alias("p"), "t.o", F.lit(True).alias("thing"))
    return base.unionByName(both("equivalentClass", SUBCLASS)).unionByName(both("equivalentProperty", SUBPROPERTY)).distinct()


def _fixed_schema(base: DataFrame, present: set[str]) -> bool:
    """Whether rounds can add nothing to the schema: nothing is said of the vocabulary's own names, and no property is transitive."""
    if f"{OWL}TransitiveProperty" in present:
        return False
    own = lambda c: F.col(c).startswith(OWL) | F.col(c).startswith(RDFS) | F.col(c).startswith(RDF)
    schema = F.col("p").isin(SUBCLASS, SUBPROPERTY, DOMAIN, RANGE, f"{OWL}inverseOf")
    return base.filter((own("s") & (schema | (F.col("p") == TYPE))) | (schema & own("o"))).isEmpty()


def _plus_by_news(base: DataFrame, present: set[str]) -> DataFrame:
    """(s, p, o) of RDFS and of inverse and symmetric properties over a stored (s, p, o, thing) with a fixed schema: after the first
    round only triples that are new meet the schema, and only they are turned."""
    key = ["s", "p", "o", "thing"]
    used = base.filter(F.col("p").isin(SUBCLASS, SUBPROPERTY, DOMAIN, RANGE))
    flags = stored(base.filter((F.col("p") == f"{OWL}inverseOf") | ((F.col("p") == TYPE) & (F.col("o") == f"{OWL}SymmetricProperty"))).select("s", "p", "o"), "flags")
    inverse = flags.filter(F.col("p") == f"{OWL}inverseOf")
    turns = inverse.select(F.col("s").alias("p"), F.col("o").alias("__q")).unionByName(inverse.select(F.col("o").alias("p"), F.col("s").alias("__q")))
    turns = stored(turns.unionByName(flags.filter(F.col("p") == TYPE).select(F.col("s").alias("p"), F.col("s").alias("__q"))).distinct(), "turns")
    free(flags)

    def turned(rows: DataFrame) -> DataFrame:
        return rows.filter("thing").join(turns, "p").select(F.col("o").alias("s"), F.col("__q").alias("p"), F.col("s").alias("o"), "thing")

    made, before = _rdfs(base, present)
    known = Rounds(made, "entailed")
    free(*before)
    fresh = known.add(turned(known.all()).distinct().join(known.all(), key, "left_anti"))
    while not fresh.isEmpty():
        made, before = _rdfs(fresh.unionByName(used), present)
        step = stored(made, "step")
        free(*before)
        fresh = known.add(step.unionByName(turned(step)).distinct().join(known.all(), key, "left_anti"))
        free(step)
    free(turns)
    return known.all()


def _plus(now: DataFrame, present: set[str], transitive: bool = True) -> DataFrame:
    """One round of RDFS and of inverse, symmetric and, unless told otherwise, transitive properties over (s, p, o, thing)."""
    made, before = _rdfs(now, present)
    full = stored(made, "entailed")
    free(*before)
    things = full.filter("thing")
    turn = F.explode(F.array(F.struct("s", "o"), F.struct(F.col("o").alias("s"), F.col("s").alias("o")))).alias("t")
    new = []
    if f"{OWL}inverseOf" in present:
        inverse = full.filter(F.col("p") == f"{OWL}inverseOf").select(turn).select(F.col("t.s").alias("p"), F.col("t.o").alias("q")).distinct()
        new.append(things.join(inverse, "p").select(F.col("o").alias("s"), F.col("q").alias("p"), F.col("s").alias("o")))
    if f"{OWL}SymmetricProperty" in present:
        new.append(things.join(_flagged(full, "SymmetricProperty"), "p").select(F.col("o").alias("s"), "p", F.col("s").alias("o")))
    new = [rows.withColumn("thing", F.lit(True)) for rows in new]
    chained = None
    if transitive and f"{OWL}TransitiveProperty" in present:
        links = reduce(DataFrame.unionByName, [things, *new])
        chained = transitive_closure(links.join(_flagged(full, "TransitiveProperty"), "p").select("p", F.col("s").alias("a"), F.col("o").alias("b")), by=["p"])
        new.append(chained.select(F.col("a").alias("s"), "p", F.col("b").alias("o"), F.lit(True).alias("thing")))
    if not new:
        return full
    after = stored(reduce(DataFrame.unionByName, [full, *new]).distinct(), "entailed")
    free(full, chained)
    return after


def _fixpoint(now: DataFrame, step) -> DataFrame:
    """(s, p, o) when a step adds nothing. It ends: steps make no new names, so triples are finitely many."""
    now = stored(now, "entailed")
    while True:
        after = step(now, rs.present(now))
        ended = after.join(now, ["s", "p", "o"], "left_anti").isEmpty()
        free(now)
        now = after
        if ended:
            return now.select("s", "p", "o").distinct()


def rdfs_plus(triples: DataFrame) -> DataFrame:
    """RDFS with inverse, symmetric and transitive properties and equivalent classes and properties."""
    base = stored(_seed(triples), "seed")
    present = rs.present(base)
    if not _fixed_schema(base, present):
        return _fixpoint(base, _plus)
    full = _plus_by_news(base, present)
    free(base)
    # a triple comes twice only where its object is told as a literal and as a thing
    return full.select("s", "p", "o").distinct() if "o_kind" in triples.columns else full.select("s", "p", "o")


SAME = rs.SAME


def _equal_links(triples: DataFrame) -> DataFrame:
    """(a, b): individuals that are stated equal, or are by functional and inverse functional properties: of the values of one key each with the smallest."""
    flag = lambda k: triples.filter((F.col("p") == TYPE) & (F.col("o") == f"{OWL}{k}")).select(F.col("s").alias("p")).distinct()
    things = triples.filter(F.coalesce(F.col("o_kind"), F.lit(IRI)) != LITERAL) if "o_kind" in triples.columns else triples
    links = edges_of(triples, SAME)
    for kind, key, value in (("FunctionalProperty", "s", "o"), ("InverseFunctionalProperty", "o", "s")):
        rows = things.join(flag(kind), "p").select("p", F.col(key).alias("k"), F.col(value).alias("a")).distinct()
        links = links.unionByName(rows.join(rows.groupBy("p", "k").agg(F.min("a").alias("b")), ["p", "k"]).select("a", "b"))
    return links.filter("a <> b")


def equal_individuals(triples: DataFrame) -> DataFrame:
    """(node, root) of the individuals that are equal to others: root is the smallest name of its class. A row for each, however large the class."""
    return representatives(_equal_links(triples))


def same_individuals(triples: DataFrame) -> DataFrame:
    """(a, b) of different individuals that are the same: all pairs of each class, which grow with the square of its size.
    equal_individuals tells the same by one row for each individual."""
    known = equal_individuals(triples)
    return known.select(F.col("node").alias("a"), "root").join(known.select(F.col("node").alias("b"), "root"), "root").filter("a <> b").select("a", "b")


def canonical(triples: DataFrame, equals: DataFrame | None = None) -> DataFrame:
    """The triples with one name for equal individuals, the class's smallest: what holds of one holds of all, said once.

    Names that become equal make further ones equal by functional properties, so rounds go on until none does. sameAs is left out.
    """
    known = None if equals is None else stored(equals, "equals")
    base = triples
    while True:
        more = equal_individuals(base) if known is None or equals is None else known
        found = not more.isEmpty()
        for c in ("s", "o"):
            thing = F.lit(True) if c == "s" or "o_kind" not in base.columns else F.coalesce(F.col("o_kind"), F.lit(IRI)) != LITERAL
            roots = more.select(F.col("node").alias("__n"), F.col("root").alias("__r"))
            base = base.join(roots, thing & (F.col(c) == F.col("__n")), "left").withColumn(c, F.coalesce("__r", c)).drop("__n", "__r")
        base = stored(base.filter(F.col("p") != SAME).distinct(), "canonical")
        free(more)
        if not found or equals is not None:
            return base


def is_canonical(terms: DataFrame, equals: DataFrame, column: str = "iri") -> DataFrame:
    """terms with a column canonical: whether a name stands for itself among equals(node, root)."""
    known = equals.filter("node <> root").select(F.col("node").alias(column), F.lit(False).alias("__c"))
    return terms.join(known, column, "left").withColumn("canonical", F.coalesce("__c", F.lit(True))).drop("__c")


class Closed:
    """A graph with all that a bundle's rules add to it.

    graph: (s, p, o, thing) with one name for equal individuals, the class's smallest; equals: (node, root), a row for each name that has
    equals. Rules run on one name, so a class of k names costs k rows, no pairs, and what is found of one is found of all.
    """

    def __init__(self, triples: DataFrame, bundle: str):
        transitive, rules, links = rs.RULESETS[bundle]
        now = _seed(triples)
        self.lists = rs.Lists(_things(triples)) if bundle in rs.WITH_LISTS else None
        if self.lists:
            now = now.unionByName(rs.list_seeds(self.lists)).distinct()
        now, self.equals = stored(now, "entailed"), triples.sparkSession.createDataFrame([], "node string, root string")
        while True:
            present = rs.present(now)
            full = _plus(now, present, transitive)
            pairs = [rule(full, self.lists).select("a", "b") for rule in links if rule.needs & present]
            more = representatives(reduce(DataFrame.unionByName, pairs)) if pairs else None
            found = more is not None and not more.isEmpty()
            made = reduce(DataFrame.unionByName, [full, *[rule(full, self.lists) for rule in rules if rule.needs & present]]).filter(F.col("p") != SAME)
            if found:
                made = _renamed(made, more)
                self.equals = stored(_over(self.equals, more), "equals")
            after = stored(made.distinct(), "entailed")
            ended = not found and after.join(now, ["s", "p", "o", "thing"], "left_anti").isEmpty()
            free(full, now, more)
            now = after
            if ended:
                break
        self.graph = now

    def contradictions(self) -> DataFrame:
        """(rule, s, p, o): see rulesets.contradictions."""
        if self.lists is None:
            raise ValueError("contradictions are told by the bundles that read lists")
        return rs.contradictions(self.graph, self.equals, self.lists)

    def triples(self) -> DataFrame:
        """(s, p, o) by all names."""
        return rs.expanded(self.graph, self.equals)


def _renamed(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Triples (s, p, o, thing) by the roots of roots(node, root)."""
    names = roots.select(F.col("node").alias("__n"), F.col("root").alias("__r"))
    for c in ("s", "o"):
        on = (F.col(c) == F.col("__n")) & (F.lit(True) if c == "s" else F.col("thing"))
        rows = rows.join(names, on, "left").withColumn(c, F.coalesce("__r", c)).drop("__n", "__r")
    return rows


def _over(equals: DataFrame, more: DataFrame) -> DataFrame:
    """equals(node, root) whose roots became equal to others, and the names that more(node, root) adds."""
    up = more.select(F.col("node").alias("root"), F.col("root").alias("__r"))
    return equals.join(up, "root", "left").select("node", F.coalesce("__r", "root").alias("root")).unionByName(more.join(equals, "node", "left_anti").select("node", "root"))


def horst(triples: DataFrame) -> DataFrame:
    """RDFS-plus with equal individuals, which share all their triples, and the restrictions some, all and value followed from triples
    to types and, for all and value, back."""
    return Closed(triples, "horst").triples()


def entailed(triples: DataFrame, bundle: str = "rdfs") -> DataFrame:
    """The graph that a query runs on: stated (none) or with a bundle's entailments; others raise an error.

    horst: restrictions and equal individuals. owl2-ql: no transitive properties, restrictions to some value of any kind. owl2-rl: also lists
    (intersections, unions, enumerations, property chains, keys), maximum cardinalities, schema rules. owl-max: lists of classes,
    cardinalities, characteristics that follow. No rule makes new individuals. Closed gives the same by one name for equals, and contradictions.
    """
    if bundle not in BUNDLES:
        raise ValueError(f"{bundle} isn't among {BUNDLES}: no answer rather than a wrong one")
    if bundle == "none":
        return _plain(triples).distinct()
    if bundle in rs.RULESETS:
        return Closed(triples, bundle).triples()
    return {"rdfs": rdfs, "rdfs-plus": rdfs_plus}[bundle](triples)


#: Inferred axioms by type: the predicate, and whether both ends are classes.
INFERRED = {"SubClassOf": SUBCLASS, "SubPropertyOf": SUBPROPERTY, "ClassAssertion": TYPE}


def inferred_axioms(triples: DataFrame, kind: str, bundle: str = "rdfs") -> DataFrame:
    """Entailed links of a kind that aren't stated."""
    p = INFERRED[kind]
    return entailed(triples, bundle).filter((F.col("p") == p) & (F.col("s") != F.col("o"))).join(_plain(triples), ["s", "p", "o"], "left_anti")


def why_subclass(triples: DataFrame, sub: str, sup: str, predicate: str = SUBCLASS) -> DataFrame:
    """(step, a, b): the links of one shortest chain from sub up to sup (by another predicate, of properties, say); none if there is no chain."""
    edges = stored(edges_of(triples, predicate), "edges")
    spark = triples.sparkSession
    now = spark.createDataFrame([(sub, [sub])], "node string, path array<string>")
    seen = now.select("node")
    while True:
        up = edges.select(F.col("a").alias("node"), F.col("b").alias("__b")).join(now, "node").select(F.col("__b").alias("node"), F.concat("path", F.array("__b")).alias("path"))
        now = stored(up.groupBy("node").agg(F.min("path").alias("path")).join(seen, "node", "left_anti"), "chains")
        if now.isEmpty():
            return spark.createDataFrame([], "step int, a string, b string")
        hit = now.filter(F.col("node") == sup)
        if not hit.isEmpty():
            steps = hit.select(F.posexplode("path").alias("step", "b"), "path").filter("step > 0")
            return steps.select(F.col("step").cast("int").alias("step"), F.get("path", F.col("step") - 1).alias("a"), "b")
        seen = seen.unionByName(now.select("node"))
