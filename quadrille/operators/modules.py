"""Modules of axiom sets by syntactic locality: bottom, top, and the two in turn."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions.terms import OWL
from quadrille.operators.trees import NODE, with_trees
from quadrille.plans.stages import Rounds, free, stored

KINDS = ("bottom", "top", "star")
TOPS = (f"{OWL}Thing", f"{OWL}topObjectProperty", f"{OWL}topDataProperty")
BOTTOMS = (f"{OWL}Nothing", f"{OWL}bottomObjectProperty", f"{OWL}bottomDataProperty")
#: Axioms without logic belong to no module by themselves.
SILENT = ("Declaration", "AnnotationAssertion", "SubAnnotationPropertyOf", "AnnotationPropertyDomain", "AnnotationPropertyRange")


def _expression(op: str, args: list[tuple[bool, bool]], number: int) -> tuple[bool, bool]:
    """(empty, full): whether an expression has to be empty, or hold all, given that of its parts."""
    bot, top = [a[0] for a in args], [a[1] for a in args]
    kind = op.removeprefix("Object").removeprefix("Data")
    if kind == "IntersectionOf":
        return any(bot), all(top)
    if kind == "UnionOf":
        return all(bot), any(top)
    if kind == "ComplementOf":
        return top[0], bot[0]
    if kind in ("SomeValuesFrom", "HasValue", "HasSelf"):
        filler = args[1] if kind == "SomeValuesFrom" else (False, True)
        return bot[0] or filler[0], top[0] and filler[1]
    if kind == "AllValuesFrom":
        return top[0] and bot[1], bot[0] or top[1]
    if kind in ("MinCardinality", "MaxCardinality", "ExactCardinality"):
        p, c = args[1], args[2] if len(args) > 2 else (False, True)
        none, one = p[0] or c[0], p[1] and c[1]  # no links at all; a link of everything to everything
        least = (none and number > 0, number == 0 or (one and number == 1))
        most = (one and number == 0, none)
        return least if kind[1] == "i" else most if kind[1] == "a" else (least[0] or most[0], least[1] and most[1])
    if kind == "InverseOf":
        return args[0]
    if kind == "PropertyChain":
        return any(bot), all(top)
    return kind == "OneOf" and not args, False


def _axiom(kind: str, args: list[tuple[bool, bool]]) -> bool:
    """Whether an axiom says nothing, given which of its parts are empty or hold all."""
    bot, top = [a[0] for a in args], [a[1] for a in args]
    if kind in ("SubClassOf", "SubObjectPropertyOf", "SubDataPropertyOf", "ObjectPropertyDomain", "ObjectPropertyRange", "DataPropertyDomain"):
        return bot[0] or top[1]
    if kind == "DataPropertyRange":
        return bot[0]
    if kind.startswith("Equivalent") or kind == "InverseObjectProperties":
        return all(bot) or all(top)
    if kind.startswith("Disjoint") and kind != "DisjointUnion":
        return sum(not b for b in bot) <= 1
    if kind == "DisjointUnion":
        return all(bot) or (top[0] and sum(top[1:]) == 1 and sum(bot[1:]) == len(args) - 2)
    if kind in ("TransitiveObjectProperty", "SymmetricObjectProperty"):
        return bot[0] or top[0]
    if kind == "ReflexiveObjectProperty":
        return top[0]
    if kind.endswith(("ObjectProperty", "DataProperty")):
        return bot[0]
    if kind in ("ClassAssertion", "ObjectPropertyAssertion", "DataPropertyAssertion"):
        return top[0]
    if kind.startswith("Negative"):
        return bot[0]
    return kind == "HasKey" and bot[0]


def _says_nothing(tree: list[dict], known: set[str], empty: bool) -> bool:
    """Whether an axiom's tree says nothing if all names but the known ones are empty (or else hold all)."""
    sides: list[tuple[bool, bool]] = [(False, False)] * len(tree)
    for at in range(len(tree) - 1, 0, -1):  # parts come after their wholes
        n = tree[at]
        if n["leaf"]:
            name = n["head"]
            sides[at] = (name in BOTTOMS, name in TOPS) if name in BOTTOMS or name in TOPS or name in known else (empty, not empty)
        else:
            number = tree[n["kids"][0]]["head"] if n["kids"] else ""
            sides[at] = _expression(n["head"], [sides[k] for k in n["kids"]], int(number) if number.isdigit() else 1)
    return tree[0]["head"] not in ("SameIndividual", "DifferentIndividuals") and _axiom(tree[0]["head"], [sides[k] for k in tree[0]["kids"]])


def _speaking(trees: pa.Array, known: pa.Array, empty: bool) -> pa.Array:
    """Whether each axiom says something. Trees become Python values one at a time, as their nodes take many times more memory then."""
    return pa.array([not _says_nothing(t.as_py(), set(k.as_py() or ()), empty) for t, k in zip(trees, known, strict=True)], pa.bool_())


def _grown(axioms: DataFrame, seeds: DataFrame, empty: bool) -> DataFrame:
    """(axiom_id) of the axioms that say something once the names of the module are known, from the seeds on."""

    @F.arrow_udf("boolean")
    def speaks(trees: pa.Array, known: pa.Array) -> pa.Array:
        return _speaking(trees, known, empty)

    names = stored(axioms.select("axiom_id", F.explode("tree").alias("n")).filter("n.leaf").select("axiom_id", F.col("n.text").alias("name")).distinct(), "names")
    known = Rounds(seeds.select(F.col("iri").alias("name")).distinct(), "signature")
    inside, open_ = None, axioms
    while True:
        # an axiom is looked at again when one of its names has come to the signature
        have = names.join(known.all(), "name", "left_semi").groupBy("axiom_id").agg(F.collect_set("name").alias("known"))
        hit = open_.join(have, "axiom_id", "left").filter(speaks("tree", "known")).select("axiom_id")
        fresh = hit if inside is None else hit.join(inside.all(), "axiom_id", "left_anti")
        if inside is None:
            inside = Rounds(fresh, "module")
        else:
            inside.add(fresh)
        more = names.join(inside.last(), "axiom_id", "left_semi").select("name").distinct().join(known.all(), "name", "left_anti")
        if known.add(more).isEmpty():
            free(names, known.all())
            return inside.all()
        open_ = axioms.join(names.join(known.last(), "name", "left_semi").select("axiom_id").distinct(), "axiom_id", "left_semi")


def locality_module(axioms: DataFrame, seeds: DataFrame, kind: str = "bottom") -> DataFrame:
    """The axioms(axiom_id, axiom_type, sexpr, ...) that can matter to the names seeds(iri).

    bottom: with what is above the names; top: with what is below them; star: both in turn until neither drops an axiom, the
    smallest of the three. An axiom is outside if it says nothing when all names but the module's are empty (bottom) or hold
    all (top). Declarations and annotations of the module's names, and of the seeds, are in it too.
    """
    if kind not in KINDS:
        raise ValueError(f"{kind} is none of {KINDS}")
    rows = with_trees(axioms.filter(~F.col("axiom_type").isin(list(SILENT))).select("axiom_id", "sexpr")).filter("tree IS NOT NULL")
    rows = stored(rows.withColumn("tree", F.col("tree").cast(f"array<{NODE}>")), "trees")
    last, n = None, -1
    while True:
        for empty in {"bottom": (True,), "top": (False,), "star": (True, False)}[kind]:
            last = _grown(rows if last is None else rows.join(last, "axiom_id", "left_semi"), seeds, empty)
        size = last.count()
        if kind != "star" or size == n:
            break
        n = size
    inside = axioms.join(last, "axiom_id", "left_semi")
    used = rows.join(last, "axiom_id", "left_semi").select(F.explode("tree").alias("n")).filter("n.leaf").select(F.col("n.text").alias("name")).unionByName(seeds.select(F.col("iri").alias("name"))).distinct()
    silent = with_trees(axioms.filter(F.col("axiom_type").isin(list(SILENT)))).filter("tree IS NOT NULL")
    leaves = F.filter("tree", lambda x: x["leaf"])
    subject = F.when(F.col("axiom_type") == "AnnotationAssertion", F.get(leaves, F.lit(1))["text"]).otherwise(F.get(leaves, F.lit(0))["text"])
    noted = silent.withColumn("__n", subject).join(used, F.col("__n") == F.col("name"), "left_semi")
    return inside.unionByName(noted.select(axioms.columns))
