"""Reasoning over class expressions: the completion rules of EL with complements and unions where they follow at once,
over axioms as trees; explanations as minimal axiom sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.terms import OWL
from quadrille.operators.trees import nodes
from quadrille.plans.components import representatives
from quadrille.plans.fixpoint import Rule, proofs, saturate, transitive_closure
from quadrille.plans.stages import free, stored

THING, NOTHING = f"{OWL}Thing", f"{OWL}Nothing"
#: Tells the steps of a whole from names, which have no space.
STEP = " #"
#: sub(x, c): x is below c. link(p, x, y): each x is linked by p to some y. The other predicates are the axioms in normal form.
RULES = [
    Rule(("sub", "?x", "?d"), (("sub", "?x", "?c"), ("told", "?c", "?d"))),
    Rule(("sub", "?x", "?z"), (("sub", "?x", "?a"), ("both", "?a", "?b", "?z"), ("sub", "?x", "?b"))),
    Rule(("link", "?p", "?x", "?c"), (("sub", "?x", "?e"), ("some", "?e", "?p", "?c"))),
    Rule(("link", "?q", "?x", "?y"), (("link", "?p", "?x", "?y"), ("role", "?p", "?q"))),
    Rule(("link", "?r", "?x", "?z"), (("link", "?p", "?x", "?y"), ("chain", "?p", "?q", "?r"), ("link", "?q", "?y", "?z"))),
    Rule(("sub", "?x", "?e"), (("link", "?p", "?x", "?y"), ("some", "?e", "?p", "?c"), ("sub", "?y", "?c"))),
    Rule(("sub", "?x", NOTHING), (("link", "?p", "?x", "?y"), ("sub", "?y", NOTHING))),
    Rule(("sub", "?x", "?d"), (("link", "?p", "?x", "?y"), ("domain", "?p", "?d"))),
    Rule(("sub", "?y", "?d"), (("link", "?p", "?x", "?y"), ("range", "?p", "?d"), ("individual", "?y"))),
    Rule(("link", "?q", "?y", "?x"), (("link", "?p", "?x", "?y"), ("inverse", "?p", "?q"), ("individual", "?x"), ("individual", "?y"))),
    Rule(("sub", "?x", NOTHING), (("link", "?p", "?x", "?y"), ("never", "?p", "?x", "?y"))),
]
#: The parts of forms that are classes; of others all are.
CLASS_PARTS = {
    "SubClassOf": None, "EquivalentClasses": None, "DisjointClasses": None, "DisjointUnion": None, "ObjectIntersectionOf": None, "ObjectUnionOf": None, "ObjectComplementOf": None,
    "ClassAssertion": (1,), "ObjectPropertyDomain": (2,), "ObjectPropertyRange": (2,), "ObjectSomeValuesFrom": (2,), "ObjectAllValuesFrom": (2,),
    "ObjectMinCardinality": (3,), "ObjectMaxCardinality": (3,), "ObjectExactCardinality": (3,), "HasKey": (1,),
}


def _fact(pred: str, *args: Column) -> Column:
    return F.struct(F.lit(pred).alias("pred"), F.array(*args).alias("args"))


def _arg(i: int) -> Column:
    return F.get("args", F.lit(i))


def _none() -> Column:
    return F.array().cast("array<struct<pred: string, args: array<string>>>")


def _pairwise(args: Column, bottom: str) -> Column:
    """What disjoint parts say: no two of them hold together."""
    return F.flatten(F.transform(args, lambda a, i: F.transform(F.slice(args, i + 2, F.size(args)), lambda b: _fact("both", a, b, F.lit(bottom)))))


def _ring(pred: str) -> Column:
    """Equal parts as links from each to the next, from the last to the first, and back."""
    after = lambda i: F.get("args", (i + 1) % F.size("args"))
    return F.concat(F.transform("args", lambda a, i: _fact(pred, a, after(i))), F.transform("args", lambda a, i: _fact(pred, after(i), a)))


def _stepwise(pred: str, args: Column, text: Column) -> Column:
    """A whole of n parts by n - 1 wholes of two, named by how far they have come."""
    name = lambda i: F.when(i == F.size(args) - 1, text).otherwise(F.concat(text, F.lit(STEP), i.cast("string")))
    before = lambda i: F.when(i == 1, F.get(args, F.lit(0))).otherwise(F.concat(text, F.lit(STEP), (i - 1).cast("string")))
    return F.transform(F.sequence(F.lit(1), F.size(args) - 1), lambda i: _fact(pred, before(i), F.get(args, i), name(i)))


def _of_expression() -> Column:
    """What an expression means by itself, as facts: of rows (head, text, args)."""
    text, n = F.col("text"), F.size("args")
    some = lambda p, c: F.array(_fact("some", text, p, c))
    filler = F.coalesce(_arg(2), F.lit(THING))
    least = F.array(_fact("told", text, F.concat(F.lit("(ObjectSomeValuesFrom "), _arg(1), F.lit(" "), filler, F.lit(")"))), _fact("some", F.concat(F.lit("(ObjectSomeValuesFrom "), _arg(1), F.lit(" "), filler, F.lit(")")), _arg(1), filler))
    again = F.array(_fact("told", F.concat(F.lit("(ObjectSomeValuesFrom "), _arg(1), F.lit(" "), filler, F.lit(")")), text))
    counted = _arg(0).try_cast("int")
    parts = F.transform("args", lambda a: _fact("told", text, a))
    whole = F.when(n == 1, F.array(_fact("told", _arg(0), text))).when(n > 1, _stepwise("both", F.col("args"), text)).otherwise(_none())
    return (
        F.when(F.col("head") == "ObjectIntersectionOf", F.concat(parts, whole))
        .when(F.col("head").isin("ObjectUnionOf", "ObjectOneOf"), F.transform("args", lambda a: _fact("told", a, text)))
        .when(F.col("head") == "ObjectComplementOf", F.array(_fact("both", _arg(0), text, F.lit(NOTHING))))
        .when(F.col("head").isin("ObjectSomeValuesFrom", "ObjectHasValue"), some(_arg(0), _arg(1)))
        .when((F.col("head") == "ObjectMinCardinality") & (counted == 1), F.concat(least, again))
        .when(F.col("head").isin("ObjectMinCardinality", "ObjectExactCardinality") & (counted >= 1), least)
        .otherwise(_none())
    )


def _of_axiom() -> Column:
    """What an axiom says, as facts: of rows (head, args), and chain, the parts of a first part that is a property chain."""
    kind = F.col("head")
    is_one = lambda i: _fact("individual", _arg(i))
    link, sub = _fact("link", _arg(0), _arg(1), _arg(2)), _fact("told", _arg(0), _arg(1))
    of_chain = F.when(F.size("chain") == 1, F.array(_fact("role", F.get("chain", F.lit(0)), _arg(1)))).otherwise(_stepwise("chain", F.col("chain"), _arg(1)))
    return (
        F.when(kind == "SubClassOf", F.array(sub)).when(kind == "EquivalentClasses", _ring("told")).when(kind.isin("DisjointClasses", "DifferentIndividuals"), _pairwise(F.col("args"), NOTHING))
        .when(kind == "SameIndividual", F.concat(_ring("told"), F.transform("args", lambda a: _fact("individual", a))))
        .when(kind == "DisjointUnion", F.concat(F.transform(F.slice("args", 2, F.size("args")), lambda a: _fact("told", a, _arg(0))), _pairwise(F.slice("args", 2, F.size("args")), NOTHING)))
        .when((kind == "SubObjectPropertyOf") & F.col("chain").isNotNull(), of_chain).when(kind == "SubObjectPropertyOf", F.array(_fact("role", _arg(0), _arg(1))))
        .when(kind == "EquivalentObjectProperties", _ring("role")).when(kind == "TransitiveObjectProperty", F.array(_fact("chain", _arg(0), _arg(0), _arg(0))))
        .when(kind == "ObjectPropertyDomain", F.array(_fact("domain", _arg(0), _arg(1)))).when(kind == "ObjectPropertyRange", F.array(_fact("range", _arg(0), _arg(1))))
        .when(kind == "InverseObjectProperties", F.array(_fact("inverse", _arg(0), _arg(1)), _fact("inverse", _arg(1), _arg(0)))).when(kind == "SymmetricObjectProperty", F.array(_fact("inverse", _arg(0), _arg(0))))
        .when(kind == "ClassAssertion", F.array(_fact("told", _arg(1), _arg(0)), is_one(1))).when(kind == "ObjectPropertyAssertion", F.array(link, is_one(1), is_one(2)))
        .when(kind == "NegativeObjectPropertyAssertion", F.array(_fact("never", _arg(0), _arg(1), _arg(2)), is_one(1), is_one(2)))
        .otherwise(_none())
    )


def normal_form(axioms: DataFrame) -> DataFrame:
    """(pred, args, why) of axioms(axiom_id, sexpr): facts that axioms say (why holds their id), that their expressions mean, and
    sub(x, x) and sub(x, Thing) of each class, individual and filler that can be below others.

    Expressions are named by their text. Ranges, inverses and symmetry are followed between individuals only. Axioms and expressions
    beyond this (universal restrictions, maximum cardinalities, data properties, keys) say nothing here.
    """
    rows = stored(nodes(axioms.select("axiom_id", "sexpr")), "nodes")
    roots = rows.filter("node = 0 AND NOT leaf")
    chains = rows.filter((F.col("head") == "ObjectPropertyChain") & (F.col("parent") == 0)).select("axiom_id", F.col("args").alias("chain"))
    said = roots.join(chains, "axiom_id", "left").select(F.explode(_of_axiom()).alias("f"), F.array("axiom_id").alias("why")).select("f.*", "why")
    meant = rows.filter("node > 0 AND NOT leaf").select("head", "text", "args").distinct().select(F.explode(_of_expression()).alias("f")).select("f.*", F.array().cast("array<string>").alias("why"))
    above = rows.filter("NOT leaf").select("axiom_id", F.col("node").alias("parent"), F.col("head").alias("form"), F.col("args").alias("parts"))
    of_class = F.lit(False)
    for form, places in CLASS_PARTS.items():
        of_class = of_class | ((F.col("form") == form) & (F.col("place").isin(*places) if places else F.lit(True)))
    names = rows.filter("node > 0 AND leaf").join(above, ["axiom_id", "parent"]).filter(of_class).select(F.col("text").alias("x"))
    fillers = meant.filter("pred = 'some'").select(F.get("args", F.lit(2)).alias("x"))
    ones = said.filter("pred = 'individual'").select(F.get("args", F.lit(0)).alias("x"))
    starts = reduce(DataFrame.unionByName, [names, fillers, ones]).distinct()
    starts = starts.select(F.explode(F.array(_fact("sub", F.col("x"), F.col("x")), _fact("sub", F.col("x"), F.lit(THING)))).alias("f")).select("f.*", F.array().cast("array<string>").alias("why"))
    out = stored(reduce(DataFrame.unionByName, [said, meant, starts]).distinct(), "normal-form")
    free(rows)
    return out


#: Where facts of the normal form name classes; sub is renamed by its first argument.
CLASS_ARGS = {"told": (0, 1), "both": (0, 1, 2), "some": (0, 2), "link": (1, 2), "never": (1, 2), "domain": (1,), "range": (1,)}


def _equal_classes(facts: DataFrame) -> DataFrame:
    """(a, b): classes and expressions that are equal: told below each other, or the same restriction or conjunction of the same parts, each
    with the smallest. Individuals, Thing and Nothing keep their names."""
    arg = lambda pred, *cols: facts.filter(F.col("pred") == pred).select(*[F.get("args", F.lit(i)).alias(c) for i, c in enumerate(cols)])
    told = arg("told", "a", "b").distinct()
    links = told.join(told.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_semi").filter("a < b")
    some = arg("some", "a", "p", "c")
    whole = arg("both", "x", "y", "a").filter(F.col("a") != NOTHING).select(F.least("x", "y").alias("p"), F.greatest("x", "y").alias("c"), "a")
    for rows in (some, whole):
        first = rows.groupBy("p", "c").agg(F.min("a").alias("b"), F.max("a").alias("__last")).filter("b <> __last").drop("__last")
        links = links.unionByName(rows.join(first, ["p", "c"]).filter("a <> b").select("a", "b"))
    kept = arg("individual", "a").distinct()
    links = links.filter(~F.col("a").isin(THING, NOTHING) & ~F.col("b").isin(THING, NOTHING))
    return links.join(kept, "a", "left_anti").join(kept.withColumnRenamed("a", "b"), "b", "left_anti").select("a", "b").distinct()


def _by_roots(facts: DataFrame, roots: DataFrame) -> DataFrame:
    """The facts with classes named by roots(node, root)."""
    names = roots.filter("node <> root").select(F.col("node").alias("__n"), F.col("root").alias("__r"))

    def named(rows: DataFrame, *places: int) -> DataFrame:
        for i in places:
            here = F.get("args", F.lit(i))
            new = F.transform("args", lambda x, k: F.when(k == i, F.coalesce(F.col("__r"), x)).otherwise(x))  # noqa: B023
            rows = rows.join(names, here == F.col("__n"), "left").select("pred", new.alias("args"))
        return rows

    own = facts.filter("pred = 'sub'").select("pred", "args", (_arg(0) == _arg(1)).alias("__same")).join(names, _arg(0) == F.col("__n"), "left")
    first = F.coalesce(F.col("__r"), _arg(0))
    parts = [facts.filter(~F.col("pred").isin("sub", *CLASS_ARGS)), own.select("pred", F.array(first, F.when(F.col("__same"), first).otherwise(_arg(1))).alias("args"))]
    for places in sorted(set(CLASS_ARGS.values())):
        parts.append(named(facts.filter(F.col("pred").isin([p for p, at in CLASS_ARGS.items() if at == places])), *places))
    return reduce(DataFrame.unionByName, parts).filter((F.col("pred") != "told") | (_arg(0) != _arg(1))).distinct()


def by_one_name(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, names): the normal form facts(pred, args) with one name for equal classes, and names(node, root) of those that have another.

    Names that become equal make expressions of them equal, so rounds go on until none does: as many as expressions are nested.
    A class of k equal names then costs k rows, no pairs.
    """
    facts, names = stored(facts.select("pred", "args"), "facts"), None
    while True:
        links = stored(_equal_classes(facts), "equal")
        if links.isEmpty():
            free(links)
            return facts, facts.sparkSession.createDataFrame([], "node string, root string") if names is None else names
        roots = representatives(links)
        before = (facts, names, links)
        facts = stored(_by_roots(facts, roots), "facts")
        if names is None:
            names = roots
        else:
            up = names.join(roots.select(F.col("node").alias("root"), F.col("root").alias("__r")), "root", "left").select("node", F.coalesce("__r", "root").alias("root"))
            names = stored(up.unionByName(roots.join(names, "node", "left_anti")), "names")
            free(roots)
        free(*before)


def _closed(facts: DataFrame) -> DataFrame:
    """(pred, args): all that follows from a normal form."""
    told = facts.filter("pred = 'told'").select(F.get("args", F.lit(0)).alias("a"), F.get("args", F.lit(1)).alias("b"))
    closed = transitive_closure(told).select(F.lit("told").alias("pred"), F.array("a", "b").alias("args"))
    role = facts.filter("pred = 'role'").select(F.get("args", F.lit(0)).alias("a"), F.get("args", F.lit(1)).alias("b"))
    above = transitive_closure(role).select(F.lit("role").alias("pred"), F.array("a", "b").alias("args"))
    return saturate(facts.filter("pred NOT IN ('told', 'role')").select("pred", "args").unionByName(closed).unionByName(above), RULES)


def completed(axioms: DataFrame) -> DataFrame:
    """(pred, args): all that follows, sub and link among it. What is told is closed first, by doubling, so that rounds
    grow with the nesting of expressions and not with the depth of the hierarchy. By all names: pairs of equal classes grow with the square of
    their number."""
    return _closed(normal_form(axioms))


def _pairs(facts: DataFrame) -> DataFrame:
    return facts.filter("pred = 'sub'").select(F.get("args", F.lit(0)).alias("a"), F.get("args", F.lit(1)).alias("b")).distinct()


def subsumptions(axioms: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(a, b): the named classes b that each named class a is below, itself and Thing left out. An unsatisfiable class is below Nothing alone."""
    facts = completed(axioms) if facts is None else facts
    ones = facts.filter("pred = 'individual'").select(F.get("args", F.lit(0)).alias("a"))
    rows = _pairs(facts).filter(~F.col("a").startswith("(") & ~F.col("b").startswith("(") & (F.col("a") != F.col("b")) & (F.col("b") != THING) & (F.col("a") != NOTHING))
    rows = stored(rows.join(ones, "a", "left_anti"), "subsumptions")
    none = rows.filter(F.col("b") == NOTHING)
    return rows.join(none.select("a"), "a", "left_anti").unionByName(none)


def _empty(axioms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a) of all names, expressions and individuals that are below Nothing, and (a) of the individuals, by one name for equal classes while rules run."""
    normal = normal_form(axioms)
    facts, names = by_one_name(normal)
    full = _closed(facts)
    rows = _pairs(full).filter(F.col("b") == NOTHING).select("a")
    rows = stored(rows.unionByName(names.join(rows.withColumnRenamed("a", "root"), "root", "left_semi").select(F.col("node").alias("a"))).distinct(), "empty")
    ones = stored(full.filter("pred = 'individual'").select(F.get("args", F.lit(0)).alias("a")).distinct(), "individuals")
    free(normal, facts, names, full)
    return rows, ones


def unsatisfiable(axioms: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(node): the named classes that can have no instances."""
    if facts is not None:
        return subsumptions(axioms, facts).filter(F.col("b") == NOTHING).select(F.col("a").alias("node"))
    rows, ones = _empty(axioms)
    return rows.filter(~F.col("a").startswith("(") & (F.col("a") != NOTHING)).join(ones, "a", "left_anti").select(F.col("a").alias("node"))


def inconsistent(axioms: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(node): individuals, or Thing, that would be in Nothing: if there is a row, no model is left."""
    if facts is None:
        rows, ones = _empty(axioms)
    else:
        rows, ones = _pairs(facts).filter(F.col("b") == NOTHING).select("a"), facts.filter("pred = 'individual'").select(F.get("args", F.lit(0)).alias("a")).distinct()
    thing = rows.filter(F.col("a") == THING)
    return rows.join(ones, "a", "left_semi").unionByName(thing).select(F.col("a").alias("node")).distinct()


def inferred(axioms: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(axiom_type, a, b, c) of named terms that follow: SubClassOf, EquivalentClasses (a < b), DisjointClasses (a < b), ClassAssertion(class,
    individual), ObjectPropertyAssertion(property, individual, individual); stated ones among them."""
    facts = stored(completed(axioms) if facts is None else facts, "completed")
    below = stored(subsumptions(axioms, facts), "below")
    none = F.lit(None).cast("string").alias("c")
    row = lambda df, kind, *cols: df.select(F.lit(kind).alias("axiom_type"), *cols)
    a, b = F.col("a"), F.col("b")
    both = below.join(below.select(b.alias("a"), a.alias("b")), ["a", "b"], "left_semi").filter(a < b)
    ones = facts.filter("pred = 'individual'").select(F.get("args", F.lit(0)).alias("x")).distinct()
    apart = facts.filter((F.col("pred") == "both") & (F.get("args", F.lit(2)) == NOTHING)).select(F.get("args", F.lit(0)).alias("u"), F.get("args", F.lit(1)).alias("v")).distinct()
    up = _pairs(facts).filter(~a.startswith("(") & (a != THING) & (a != NOTHING)).join(ones, a == F.col("x"), "left_anti")
    dead = below.filter(b == NOTHING).select("a")
    up = up.join(dead, "a", "left_anti")
    disjoint = up.select(a, b.alias("u")).join(apart, "u").join(up.select(a.alias("b"), b.alias("v")), "v").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    types = _pairs(facts).join(ones, a == F.col("x"), "left_semi").filter(~b.startswith("(") & (b != THING)).join(ones.withColumnRenamed("x", "b"), "b", "left_anti")
    links = facts.filter("pred = 'link'").select(*[F.get("args", F.lit(i)).alias(n) for i, n in enumerate("abc")]).distinct()
    links = links.filter(~a.startswith("(") & ~a.contains(STEP)).join(ones.select(F.col("x").alias("b")), "b", "left_semi").join(ones.select(F.col("x").alias("c")), "c", "left_semi")
    made = [
        row(below.filter(b != NOTHING), "SubClassOf", "a", "b", none), row(both, "EquivalentClasses", "a", "b", none), row(disjoint, "DisjointClasses", "a", "b", none),
        row(types, "ClassAssertion", b.alias("a"), a.alias("b"), none), row(links, "ObjectPropertyAssertion", "a", "b", "c"),
    ]
    return reduce(DataFrame.unionByName, made)


def class_links(axioms: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(p, a, b): each a is linked by p to some b, of named classes, with all that follows on both sides: the relonomies' links."""
    facts = stored(completed(axioms) if facts is None else facts, "completed")
    links = facts.filter("pred = 'link'").select(*[F.get("args", F.lit(i)).alias(n) for i, n in enumerate(("p", "a", "y"))])
    up = _pairs(facts).select(F.col("a").alias("y"), "b")
    named = lambda c: ~F.col(c).startswith("(") & (F.col(c) != THING)
    return links.filter(named("a") & ~F.col("p").contains(STEP)).join(up, "y").filter(named("b")).select("p", "a", "b").distinct()


def explanations(axioms: DataFrame, sub: str, sup: str = NOTHING, most: int = 16) -> DataFrame:
    """(explanation, axiom_id, whole): the minimal sets of axioms from which it follows that sub is below sup, numbered from the
    smallest (ties: by their ids). sup Nothing asks why a class is unsatisfiable; with sub Thing, or an individual, why there is no model.

    Only axioms that sub and sup reach by shared symbols take part. `most` bounds the sets kept for each fact; whole
    tells whether there may be no more. The completion rules decide what follows.
    """
    near = stored(connected(axioms, [sub, sup]).select("axiom_id", "sexpr"), "near")  # rounds read it, not what axioms come of
    facts = normal_form(near)
    seed = axioms.sparkSession.createDataFrame([("sub", [sub, sub]), ("sub", [sub, THING])], "pred string, args array<string>").withColumn("why", F.array().cast("array<string>"))
    rows = proofs(facts.unionByName(seed), RULES, most)
    found = rows.filter((F.col("pred") == "sub") & (F.get("args", F.lit(0)) == sub) & F.get("args", F.lit(1)).isin(sup, NOTHING)).select("why", "whole")
    every = found.agg(F.collect_set("why").alias("sets"), F.min("whole").alias("whole"))  # at most twice `most` sets
    least = F.filter("sets", lambda w: ~F.exists(F.col("sets"), lambda v: (F.size(v) < F.size(w)) & (F.size(F.array_except(v, w)) == 0)))
    ordered = F.array_sort(F.transform(least, lambda w: F.struct(F.size(w).alias("n"), w.alias("why"))))
    out = every.select(F.posexplode(ordered).alias("explanation", "s"), "whole")
    return out.select((F.col("explanation") + 1).alias("explanation"), F.explode("s.why").alias("axiom_id"), "whole")


def connected(axioms: DataFrame, terms: list[str]) -> DataFrame:
    """The axioms that can matter to what follows of terms: those whose names are reached from them by axioms, whatever the side."""
    rows = stored(nodes(axioms.select("axiom_id", "sexpr")).filter("leaf").select("axiom_id", F.col("text").alias("name")).distinct(), "names")
    spark = axioms.sparkSession
    known = spark.createDataFrame([(t,) for t in terms + [THING, NOTHING]], "name string")
    fresh, reached = known, None
    while True:
        hit = rows.join(fresh, "name", "left_semi").select("axiom_id").distinct()
        hit = stored(hit if reached is None else hit.join(reached, "axiom_id", "left_anti"), "reached")
        if hit.isEmpty():
            break
        reached = hit if reached is None else reached.unionByName(hit)
        fresh = stored(rows.join(hit, "axiom_id", "left_semi").select("name").distinct().join(known, "name", "left_anti"), "names")
        known = known.unionByName(fresh)
    return axioms.limit(0) if reached is None else axioms.join(reached, "axiom_id", "left_semi")
