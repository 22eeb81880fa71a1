"""The builders of canon as column expressions, so that canonical bytes are made inside the JVM where axioms are read.

A query that needs no canonical bytes prunes them, so they cost nothing there. What goes into a node comes with its
length in front, so it is needed twice; bound() evaluates it once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S
from . import canon as C

NO_MEMBERS = C.members(())


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), f), F.lit(0))


def varint(n: Column) -> Column:
    """Of a number under 2 ** 28: its groups of seven bits, in hexadecimal, as many as it has."""
    group = lambda i: F.shiftright(n, 7 * i).bitwiseAND(F.lit(127))
    two = F.shiftleft(group(0), 8) + F.shiftright(n, 7) + F.lit(0x8000)
    four = F.shiftleft((F.shiftleft(group(0), 8) + group(1) + F.lit(0x8080)).cast("long"), 16) + F.shiftleft(group(2), 8) + F.shiftright(n, 21) + F.lit(0x8000)
    three = F.shiftleft((F.shiftleft(group(0), 8) + group(1) + F.lit(0x8080)).cast("long"), 8) + F.shiftright(n, 14)
    value = F.when(n < 1 << 7, n.cast("long") + 256).when(n < 1 << 14, two.cast("long") + (1 << 16)).when(n < 1 << 21, three + (1 << 24)).otherwise(four + (1 << 32))
    return F.unhex(F.substring(F.hex(value), 2, 8))  # the digit in front keeps leading zeros


def with_length(raw: Column) -> Column:
    return bound(raw, lambda v: F.concat(varint(F.octet_length(v)), v))


def sized(kind: int, raw: Column) -> Column:
    return F.concat(F.lit(bytes([kind])), with_length(raw))


def text(value: Column) -> Column:
    return sized(C.TEXT_KIND, F.encode(value, "UTF-8"))


def sub(node_: Column) -> Column:
    return sized(C.NODE_KIND, node_)


def integer(value: Column) -> Column:
    return F.concat(F.lit(bytes([C.INTEGER_KIND])), varint(value.cast("int")))


def members(nodes: Column) -> Column:
    """Of an array."""
    ordered = bound(F.array_sort(F.array_distinct(nodes)), lambda xs: F.concat(varint(F.size(xs)), F.aggregate(xs, F.lit(b""), lambda out, x: F.concat(out, with_length(x)))))
    return F.concat(F.lit(bytes([C.SET_KIND])), ordered)


def node(tag: int | Column, *fields: Column | bytes) -> Column:
    return F.concat(F.lit(C.varint(tag)) if isinstance(tag, int) else varint(tag), *(F.lit(f) if isinstance(f, bytes) else f for f in fields))


def iri(value: Column) -> Column:
    return node(S.IRI, text(value))


def entity(kind: str, value: Column) -> Column:
    return node(S.ENTITY, C.enum(kind), sub(iri(value)))


def named_class(value: Column) -> Column:
    return entity("class", value)


def prop(value: Column) -> Column:
    return entity("object_property", value)


def individual(value: Column) -> Column:
    return entity("named_individual", value)


def anonymous(scope: bytes, key: Column) -> Column:
    return node(S.ANON, C.sized(C.BYTES_KIND, scope), sized(C.BYTES_KIND, F.encode(key, "UTF-8")))


def literal(lexical: Column, datatype: Column, lang: Column | None = None) -> Column:
    tongue = C.NONE if lang is None else F.coalesce(text(lang), F.lit(C.NONE))
    return node(S.LITERAL, text(lexical), sub(entity("datatype", datatype)), tongue)


def annotation(property_: str, value: Column) -> Column:
    return node(S.ANNOTATION, C.sub(C.entity("annotation_property", property_)), sub(value), NO_MEMBERS)


def restriction(tag: Column, property_: Column, filler: Column, card: Column) -> Column:
    """``filler`` is the IRI of a named class, or null for one that is none; a null ``card`` is left out."""
    inner = F.coalesce(named_class(filler), F.lit(C.node(32, C.sub(C.named_class(S.OWL_THING)))))
    return node(tag, F.coalesce(integer(card), F.lit(b"")), sub(property_), sub(inner))


def axiom(kind: str, *nodes: Column, annotations: Column | None = None) -> Column:
    return node(S.AXIOM_TAGS[kind], *(sub(n) for n in nodes), NO_MEMBERS if annotations is None else members(annotations))
