"""Axioms as trees: node tables, patterns compiled to column expressions, shapes."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A quoted literal with what follows it, a bracket, or a name.
TOKEN = r'"(?:[^"\\]|\\.)*"[^\s()]*|[()]|[^\s()]+'
NODE = "struct<parent: int, place: int, head: string, leaf: boolean, kids: array<int>, text: string>"
_NODE = pa.list_(pa.struct([("parent", pa.int32()), ("place", pa.int32()), ("head", pa.string()), ("leaf", pa.bool_()), ("kids", pa.list_(pa.int32())), ("text", pa.string())]))


def parsed(text: str) -> list | str:
    """A text form as nested lists."""
    stack: list[list] = [[]]
    for token in re.findall(TOKEN, text):
        if token == "(":
            stack.append([])
        elif token == ")":
            if len(stack) == 1:
                raise ValueError(f"a bracket closes nothing: {text}")
            done = stack.pop()
            stack[-1].append(done)
        else:
            stack[-1].append(token)
    if len(stack) != 1 or len(stack[0]) != 1:
        raise ValueError(f"not one whole form: {text}")
    return stack[0][0]


def _nodes(text: str | None) -> list[dict] | None:
    """The nodes of a text form in the order in which they begin; the root is first. Null for a null or broken text."""
    try:
        form = None if text is None else parsed(text)
    except ValueError:
        form = None
    if form is None:
        return None
    out: list[dict] = []
    waiting = [(form, -1, 0)]
    while waiting:
        here, parent, place = waiting.pop()
        at, leaf = len(out), isinstance(here, str)
        named = not leaf and here and isinstance(here[0], str)
        out.append({"parent": parent, "place": place, "head": here if leaf else here[0] if named else "", "leaf": leaf, "kids": [], "text": here if leaf else None})
        if parent >= 0:
            out[parent]["kids"].append(at)
        if not leaf:
            waiting += reversed([(kid, at, i) for i, kid in enumerate(here[1:] if named else here, 1)])
    for n in reversed(out):
        if not n["leaf"]:
            n["text"] = f"({' '.join([n['head']] * bool(n['head']) + [out[k]['text'] for k in n['kids']])})"
    return out


#: Texts whose nodes are Python values at once.
STEP = 200


def _trees(texts: pa.Array) -> pa.Array:
    """The nodes of each text, made a few texts at a time: a node takes many times more memory as a Python value than in Arrow."""
    made = [pa.array([_nodes(t) for t in texts.slice(i, STEP).to_pylist()], _NODE) for i in range(0, len(texts), STEP)]
    return pa.concat_arrays(made) if made else pa.array([], _NODE)


def with_trees(axioms: DataFrame) -> DataFrame:
    """axioms with a column tree of their text form sexpr: an array of nodes, each with its parent, its place among the parts
    (from 1), its head (a leaf's name), the places of its parts in the array, and its text with single spaces.

    A null text, or one that isn't one whole form, has no tree.
    """

    @F.arrow_udf(f"array<{NODE}>")
    def tree(texts: pa.Array) -> pa.Array:
        return _trees(texts)

    return axioms.withColumn("tree", tree("sexpr"))


def nodes(axioms: DataFrame) -> DataFrame:
    """A row for each node: the columns of axioms, node, parent, place, head, leaf, text, and args, the texts of its parts. A broken text has none."""
    rows = axioms if "tree" in axioms.columns else with_trees(axioms)
    args = F.transform("n.kids", lambda k: F.get("tree", k)["text"])
    kept = [c for c in rows.columns if c != "tree"]
    return rows.select(*kept, "tree", F.posexplode("tree").alias("node", "n")).select(*kept, "node", "n.parent", "n.place", "n.head", "n.leaf", "n.text", args.alias("args"))


class _Pattern:
    """Compiles a pattern to a condition and the columns of its variables."""

    def __init__(self, tree: Column, tests: Mapping[str, Callable]):
        self.tree, self.tests = tree, tests

    def node(self, at: Column) -> Column:
        return F.get(self.tree, at)

    def match(self, pattern, node: Column, bound: dict[str, Column]) -> Column:
        if isinstance(pattern, str):
            if not pattern.startswith("?"):
                return node["leaf"] & (node["head"] == pattern)
            return self._bind(pattern[1:], node["text"], bound)
        op, *parts = pattern
        if op == "?is":
            return self.match(parts[0], node, bound) & self.tests[parts[1]](node["text"])
        if op == "?and":
            return reduce(Column.__and__, [self.match(p, node, bound) for p in parts])
        if op == "?not":
            return ~F.coalesce(self.match(parts[0], node, dict(bound)), F.lit(False))
        if op == "?or":
            return self._either(parts, node, bound)
        return self._list(op, parts, node, bound)

    def _bind(self, name: str, text: Column, bound: dict[str, Column]) -> Column:
        if name in ("", "_"):
            return text.isNotNull()
        if name in bound:
            return bound[name] == text
        bound[name] = text
        return text.isNotNull()

    def _either(self, parts: list, node: Column, bound: dict[str, Column]) -> Column:
        ways = []
        for p in parts:
            own = dict(bound)
            ways.append((F.coalesce(self.match(p, node, own), F.lit(False)), own))
        for name in sorted({n for _, own in ways for n in own} - set(bound)):
            value = F.lit(None).cast("string")
            for hit, own in reversed(ways):
                value = F.when(hit, own.get(name, F.lit(None).cast("string"))).otherwise(value)
            bound[name] = value
        return reduce(Column.__or__, [hit for hit, _ in ways])

    def _list(self, op, parts: list, node: Column, bound: dict[str, Column]) -> Column:
        conditions = [p for p in parts if isinstance(p, list) and p[0] == "?if"]
        parts = [p for p in parts if p not in conditions]
        free = [i for i, p in enumerate(parts) if isinstance(p, str) and p.startswith("?*")]
        if len(free) > 1:
            raise ValueError("a form can have one run of any parts: two could share parts in many ways")
        size, n = F.size(node["kids"]), len(parts)
        hit = ~node["leaf"] & (self._bind(op[1:], node["head"], bound) if op.startswith("?") else node["head"] == op) & (size >= n - 1 if free else size == n)
        for i, p in enumerate(parts):
            if i in free:
                count = F.greatest(size - (n - 1), F.lit(0))
                run = F.transform(F.slice(node["kids"], F.lit(i + 1), count), lambda k: self.node(k)["text"])
                hit = hit & self._bind(p[2:], F.array_join(run, " "), bound)
            else:
                at = F.lit(i) if not free or i < free[0] else size - (n - i)
                hit = hit & self.match(p, self.node(F.get(node["kids"], at)), bound)
        for _, name in conditions:
            hit = hit & self.tests[name](bound)
        return hit


def matching(axioms: DataFrame, pattern: str, tests: Mapping[str, Callable] | None = None, anywhere: bool = False) -> DataFrame:
    """Axioms (rows with a text form sexpr) that a pattern of the same form matches, a column for each of its variables.

    ?x stands for any part, a name or a whole expression however deep; one that comes twice has to be the same; ?_ is any part; an
    operator can be a variable too; ?*rest stands for any run of parts, once in a form, at any place. (?or p q...), (?and p q...) and (?not p)
    combine patterns; (?is p test) asks a test of the part's text, (?if test), within a form, one of the columns bound so far, by names
    in `tests`. With `anywhere` each part of an axiom is tried: a row for each that matches, its text in the column part.

    The pattern becomes one expression over the axiom's tree: a scan without a shuffle.
    """
    rows = axioms if "tree" in axioms.columns else with_trees(axioms)
    kept, form = [c for c in rows.columns if c != "tree"], parsed(pattern)
    at = F.lit(0)
    if anywhere:
        rows, at = rows.withColumn("__at", F.explode(F.sequence(F.lit(0), F.size("tree") - 1))), F.col("__at")
    bound: dict[str, Column] = {}
    compiled = _Pattern(F.col("tree"), tests or {})
    root = F.get("tree", at)
    hit = compiled.match(form, root, bound)
    names = [F.col(f"`{c}`") for c in kept] + ([root["text"].alias("part")] if anywhere else [])
    return rows.filter(F.col("tree").isNotNull()).filter(F.coalesce(hit, F.lit(False))).select(*names, *[c.alias(n) for n, c in bound.items()])


def shape(text: str | Column) -> Column:
    """The text form with its names and literals replaced by _: all that doesn't begin a form, but for numbers, which count."""
    runs = F.regexp_replace(text, r"\s+", " ") if isinstance(text, str) else text
    return F.regexp_replace(runs, r'"(?:[^"\\]|\\.)*"[^\s()]*|(?<= )(?!\d+[ )])[^\s()"]+', "_")
