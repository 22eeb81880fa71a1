"""Canonical bytes of structural nodes.

A node is its constructor number and its fields; a field is a kind byte and a payload, nested nodes and texts with
their length in front. Byte order of the whole decides encounter order, ties and identity. These builders are plain
functions of single values. column() applies one to Arrow batches, which keeps the plan small for nodes of many parts
(class expressions, of which there are as many as the schema has); canon_columns has those of large tables as column
expressions. A query that needs no canonical bytes prunes either.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S

NODE_KIND, TEXT_KIND, BYTES_KIND, INTEGER_KIND, ENUM_KIND, SET_KIND, SEQUENCE_KIND = range(1, 8)
NONE = b"\x00"


def varint(n: int) -> bytes:
    """Seven bits a byte, least first; the high bit on all but the last."""
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def sized(kind: int, raw: bytes) -> bytes:
    return bytes([kind]) + varint(len(raw)) + raw


def text(value: str) -> bytes:
    return sized(TEXT_KIND, value.encode())


def enum(value: str) -> bytes:
    return sized(ENUM_KIND, value.encode())


def sub(node_: bytes) -> bytes:
    return sized(NODE_KIND, node_)


def integer(value: int) -> bytes:
    return bytes([INTEGER_KIND]) + varint(int(value))


def members(nodes) -> bytes:
    """A set: distinct nodes in byte order."""
    ordered = sorted(set(nodes))
    return bytes([SET_KIND]) + varint(len(ordered)) + b"".join(varint(len(x)) + x for x in ordered)


def node(tag: int, *fields: bytes) -> bytes:
    return varint(tag) + b"".join(fields)


def iri(value: str) -> bytes:
    return node(S.IRI, text(value))


def entity(kind: str, value: str) -> bytes:
    return node(S.ENTITY, enum(kind), sub(iri(value)))


def named_class(value: str) -> bytes:
    return entity("class", value)


def prop(value: str, inverse: bool = False) -> bytes:
    own = entity("object_property", value)
    return node(S.INVERSE_OF, sub(own)) if inverse else own


def individual(value: str) -> bytes:
    return entity("named_individual", value)


def anonymous(scope: bytes, key: str) -> bytes:
    return node(S.ANON, sized(BYTES_KIND, scope), sized(BYTES_KIND, key.encode()))


def literal(lexical: str, datatype: str, lang: str | None = None) -> bytes:
    return node(S.LITERAL, text(lexical), sub(entity("datatype", datatype)), NONE if lang is None else text(lang))


def annotation(property_: str, value: bytes) -> bytes:
    return node(S.ANNOTATION, sub(entity("annotation_property", property_)), sub(value), members(()))


def restriction(tag: int, property_: bytes, filler: str | None, card: int | None = None) -> bytes:
    inner = named_class(filler) if filler is not None else node(32, sub(named_class(S.OWL_THING)))
    return node(tag, *([] if card is None else [integer(card)]), sub(property_), sub(inner))


def axiom(kind: str, *nodes: bytes, annotations=()) -> bytes:
    return node(S.AXIOM_TAGS[kind], *(sub(n) for n in nodes), members(annotations))


def column(f: Callable, *cols: Column) -> Column:
    """f of each row's values (null as None)."""

    def run(*series: pd.Series) -> pd.Series:
        rows = zip(*(s.astype(object).where(s.notna(), None) if not isinstance(s, pd.DataFrame) else s.itertuples(index=False) for s in series), strict=True)
        return pd.Series([f(*r) for r in rows], dtype=object)

    wrapped = {1: lambda a: run(a), 2: lambda a, b: run(a, b), 3: lambda a, b, c: run(a, b, c), 4: lambda a, b, c, d: run(a, b, c, d), 5: lambda a, b, c, d, e: run(a, b, c, d, e)}[len(cols)]
    wrapped.__annotations__ = {**dict.fromkeys(wrapped.__code__.co_varnames, pd.Series), "return": pd.Series}
    return F.pandas_udf(wrapped, "binary")(*cols)
