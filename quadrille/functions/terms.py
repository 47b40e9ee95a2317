"""RDF terms as columns: prefixes, kinds, the functions of SPARQL filters and SPARQL's order."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

IRI, BNODE, LITERAL = 0, 1, 2
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
TYPE, LABEL = f"{RDF}type", f"{RDFS}label"
SUBCLASS, SUBPROPERTY, DOMAIN, RANGE = f"{RDFS}subClassOf", f"{RDFS}subPropertyOf", f"{RDFS}domain", f"{RDFS}range"
NUMERIC = [f"{XSD}{n}" for n in ("integer", "decimal", "double", "float", "long", "int", "short", "byte", "nonNegativeInteger", "positiveInteger")]
#: Registered prefixes; the first that fits is used, so longer ones come first.
PREFIXES = {"rdf": RDF, "rdfs": RDFS, "owl": OWL, "xsd": XSD, "ex": "http://example.org/"}


@dataclass(frozen=True)
class Literal:
    """A literal of a pattern: its text, and a datatype (an IRI, which may be prefixed) or a language."""

    text: str
    datatype: str | None = None
    lang: str | None = None

    @property
    def tag(self) -> str:
        if self.lang:
            return f'"@{self.lang.lower()}'
        dt = expanded(self.datatype) if self.datatype else None
        return f'"^{dt}' if dt and dt != f"{XSD}string" else '"'


@dataclass(frozen=True)
class Iri:
    """A resource of a pattern, by a full or a prefixed name."""

    name: str
    tag = "r"

    @property
    def text(self) -> str:
        return expanded(self.name)


def lang_of_tag(tag: Column) -> Column:
    """The language of a tagged literal, an empty text for other literals, NULL for resources."""
    return F.when(tag.startswith('"@'), F.substring(tag, F.lit(3), F.length(tag))).when(tag.startswith('"'), F.lit(""))


def datatype_of_tag(tag: Column) -> Column:
    return F.when(tag.startswith('"^'), F.substring(tag, F.lit(3), F.length(tag))).when(tag.startswith('"@'), F.lit(f"{RDF}langString")).when(tag.startswith('"'), F.lit(f"{XSD}string"))


def lang_matches(lang: Column, range_: str) -> Column:
    """Whether a language is in a range: the same or a part of it; * fits any language."""
    low = range_.lower()
    return (lang != "") if low == "*" else (F.lower(lang) == low) | F.lower(lang).startswith(f"{low}-")


def expanded(name: str, prefixes: Mapping[str, str] = PREFIXES) -> str:
    """prefix:local as a full IRI; other names stay."""
    head, mark, tail = name.partition(":")
    return prefixes[head] + tail if mark and head in prefixes and not tail.startswith("//") else name


def abbreviated(iri: Column, prefixes: Mapping[str, str] = PREFIXES) -> Column:
    out = None
    for name, base in prefixes.items():
        rest = F.concat(F.lit(f"{name}:"), F.substring(iri, F.lit(len(base) + 1), F.length(iri)))
        out = F.when(iri.startswith(base), rest) if out is None else out.when(iri.startswith(base), rest)
    return iri if out is None else out.otherwise(iri)


def tail(iri: Column) -> Column:
    """What follows the last / or # of an IRI."""
    return F.regexp_extract(iri, r"([^/#]*)$", 1)


def is_iri(kind: Column) -> Column:
    return kind == IRI


def is_blank(kind: Column) -> Column:
    return kind == BNODE


def is_literal(kind: Column) -> Column:
    return kind == LITERAL


def is_numeric(kind: Column, datatype: Column) -> Column:
    return (kind == LITERAL) & F.coalesce(datatype.isin(NUMERIC), F.lit(False))


def number(lex: Column) -> Column:
    """The value of a numeric literal; NULL (an error, in a filter) for other texts."""
    return lex.try_cast("double")


def strafter(text: Column, mark: Column | str) -> Column:
    mark = F.lit(mark) if isinstance(mark, str) else mark
    at = F.instr(text, mark)
    return F.when(F.length(mark) == 0, text).when(at > 0, F.substring(text, at + F.length(mark), F.length(text))).otherwise(F.lit(""))


def regex(text: Column, pattern: str, flags: str = "") -> Column:
    """Whether the pattern is found anywhere; flags as in SPARQL (i, m, s, x)."""
    return text.rlike(f"(?{flags}){pattern}" if flags else pattern)


def same_term(a: Mapping[str, Column], b: Mapping[str, Column]) -> Column:
    """Equality of kind, text, datatype and language."""
    out = F.lit(True)
    for part in ("kind", "lex", "dt", "lang"):
        out = out & a[part].eqNullSafe(b[part])
    return out


def resolved(text: Column, base: str) -> Column:
    """An IRI from a text: relative ones are taken from the base."""
    return F.when(text.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), text).otherwise(F.concat(F.lit(base), text))


def order_keys(kind: Column, lex: Column, dt: Column) -> list[Column]:
    """SPARQL's order: unbound, blank nodes, IRIs, then literals, numbers by value."""
    rank = F.when(kind.isNull(), 0).when(kind == BNODE, 1).when(kind == IRI, 2).otherwise(3)
    return [rank, F.when(is_numeric(kind, dt), number(lex)), lex]


#: Functions that filters may name; an IRI may be registered for a function of one's own.
REGISTRY: dict[str, Callable[..., Column]] = {
    "bound": lambda x: x.isNotNull(), "str": lambda x: x.cast("string"), "concat": F.concat, "strafter": strafter, "coalesce": F.coalesce,
    "if": lambda c, a, b: F.when(c, a).when(~c, b), "regex": regex, "uri": resolved, "ucase": F.upper, "lcase": F.lower, "strlen": F.length,
    "abs": F.abs, "ceil": F.ceil, "floor": F.floor, "round": lambda x: F.floor(x + F.lit(0.5)), "contains": lambda a, b: a.contains(b), "strstarts": lambda a, b: a.startswith(b),
    "strends": lambda a, b: a.endswith(b), "lang": lang_of_tag, "datatype": datatype_of_tag, "langmatches": lang_matches, "sameterm": same_term,
    "strbefore": lambda t, m: F.when(F.instr(t, F.lit(m)) > 0, F.substring_index(t, m, 1)).otherwise(F.lit("")), "substr": lambda t, at, n=None: F.substring(t, at, F.length(t) if n is None else n), "replace": F.regexp_replace,
    "encode_for_uri": lambda x: F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), "isiri": is_iri, "isblank": is_blank, "isliteral": is_literal, "isnumeric": is_numeric,
}


def call(name: str, *args) -> Column:
    """The registered function of that name or IRI."""
    function = REGISTRY.get(name) or REGISTRY.get(name.lower())
    if function is None:
        raise ValueError(f"no function is registered as {name}")
    return function(*args)


#: Short names of terms, by which queries may call them: :name stands for the IRI.
NICKNAMES: dict[str, str] = {}


def nickname(name: str, iri: str) -> None:
    NICKNAMES[name] = expanded(iri)


def resolved_term(term: str) -> str:
    """A :nickname's IRI; one that isn't registered is an error. Other terms stay."""
    if not term.startswith(":") or len(term) < 2:
        return term
    if term[1:] not in NICKNAMES:
        raise ValueError(f"no term is called {term}")
    return NICKNAMES[term[1:]]
