"""Syntax tree of SPARQL queries and updates. All nodes are immutable and hashable."""

from __future__ import annotations

from dataclasses import dataclass, field

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
STRING, INTEGER, DECIMAL, DOUBLE, FLOAT, BOOLEAN, DATETIME = (XSD + n for n in ("string", "integer", "decimal", "double", "float", "boolean", "dateTime"))
LANG_STRING = RDF + "langString"


@dataclass(frozen=True)
class Iri:
    value: str


@dataclass(frozen=True)
class Lit:
    lex: str
    dt: str = STRING
    lang: str | None = None


@dataclass(frozen=True)
class BNode:
    """In templates and data; a blank node of a pattern is a ``Var`` whose name starts with ``_:``."""

    label: str


@dataclass(frozen=True)
class Var:
    name: str  # lower-case: names compare without case


Term = Iri | Lit | BNode | Var


# Property paths ----------------------------------------------------------------------------


@dataclass(frozen=True)
class PathSeq:
    items: tuple


@dataclass(frozen=True)
class PathAlt:
    items: tuple


@dataclass(frozen=True)
class PathInv:
    path: object


@dataclass(frozen=True)
class PathMod:
    path: object
    mod: str  # ? * +


@dataclass(frozen=True)
class PathNeg:
    forward: tuple
    inverse: tuple


@dataclass(frozen=True)
class Triple:
    s: object
    p: object
    o: object


@dataclass(frozen=True)
class Quad:
    s: object
    p: object
    o: object
    g: object = None


# Expressions -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Call:
    """Operator, built-in (upper case) or function IRI."""

    name: str
    args: tuple
    distinct: bool = False


@dataclass(frozen=True)
class Exists:
    group: object
    negated: bool


@dataclass(frozen=True)
class Agg:
    name: str
    arg: object  # None: *
    distinct: bool = False
    separator: str | None = None


# Group graph patterns ----------------------------------------------------------------------


@dataclass(frozen=True)
class Bgp:
    triples: tuple


@dataclass(frozen=True)
class Filter:
    expr: object


@dataclass(frozen=True)
class Bind:
    expr: object
    var: Var


@dataclass(frozen=True)
class Group:
    elements: tuple


@dataclass(frozen=True)
class Optional:
    group: Group


@dataclass(frozen=True)
class Union:
    groups: tuple


@dataclass(frozen=True)
class Minus:
    group: Group


@dataclass(frozen=True)
class Graph:
    name: object
    group: Group


@dataclass(frozen=True)
class Service:
    name: object
    group: Group
    silent: bool


@dataclass(frozen=True)
class Values:
    vars: tuple
    rows: tuple  # None is UNDEF


@dataclass(frozen=True)
class SubSelect:
    query: Query


@dataclass(frozen=True)
class Query:
    form: str  # SELECT ASK CONSTRUCT DESCRIBE
    projection: tuple | None = None  # of Var or (expr, Var); None: *
    distinct: bool = False
    reduced: bool = False
    template: tuple = ()  # of Quad
    where: Group = field(default_factory=lambda: Group(()))
    from_: tuple = ()
    from_named: tuple = ()
    group_by: tuple = ()  # of expr or (expr, Var)
    having: tuple = ()
    order_by: tuple = ()  # of (expr, descending)
    limit: int | None = None
    offset: int | None = None
    values: Values | None = None
    name: str | None = None


@dataclass(frozen=True)
class Update:
    """kind: INSERT DATA, DELETE DATA, DELETE WHERE, MODIFY."""

    kind: str
    delete: tuple = ()
    insert: tuple = ()
    where: Group = field(default_factory=lambda: Group(()))
    with_: object = None
    using: tuple = ()
    using_named: tuple = ()
    name: str | None = None


@dataclass(frozen=True)
class Manage:
    """LOAD, CLEAR, DROP, CREATE, ADD, MOVE and COPY; graphs are Iri, DEFAULT, NAMED or ALL."""

    kind: str
    source: object = None
    target: object = None
    silent: bool = False
    name: str | None = None


Operation = Query | Update | Manage


def variables(node: object, into: dict | None = None) -> list[str]:
    """Names of the variables in a tree, in order of appearance."""
    found = {} if into is None else into
    if isinstance(node, Var):
        found[node.name] = None
    elif isinstance(node, tuple | list):
        for x in node:
            variables(x, found)
    elif hasattr(node, "__dataclass_fields__"):
        for name in node.__dataclass_fields__:
            variables(getattr(node, name), found)
    return list(found)
