"""Hashes, renderings and records as column expressions; nothing here but java_hash() leaves the JVM."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S

MASK = 0xFFFFFFFF

# Seeds of structural hashes.
HASH_SEEDS = {"class": 2293, "object_property": 4153, "inverse": 4241, "annotation": 6311, "sub_property": 1823, "inverse_properties": 1229}
EXPRESSION_SEEDS = {S.AND: 3083, S.OR: 3581, S.SOME: 3517, S.ALL: 2833, S.MIN: 3259, S.MAX: 3187}
# What stands for expressions that have no seed, hashed as text.
UNSEEDED = {S.EXACT: "ObjectExactCardinality", S.HAS_VALUE: "ObjectHasValue", S.HAS_SELF: "ObjectHasSelf"}


def int32(x: Column) -> Column:
    """The signed 32-bit value of a long's low half."""
    return (x + F.lit(1 << 31)).bitwiseAND(F.lit(MASK)) - F.lit(1 << 31)


def unsigned(x: Column) -> Column:
    return x.bitwiseAND(F.lit(MASK))


def string_hash(text: Column) -> Column:
    """h = 31 h + u over UTF-16 units, unsigned; four units a step. Units of zero in front, which fill up the first
    step, leave the hash at zero."""

    def steps(raw: Column) -> Column:
        n = F.ceil(F.octet_length(raw) / 8).cast("int")
        at = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), n - 1))
        # Of bytes, unlike of a string, a part is found without going through all before it.
        word = lambda whole: F.transform(at, lambda i: F.conv(F.hex(F.substring(whole, i * 8 + 1, F.lit(8))), 16, -10).cast("long"))
        return F.get(F.transform(F.array(F.lpad(raw, n * 8, F.lit(b"\0"))), word), 0)

    unit = lambda w, place: F.shiftright(w, 48 - 16 * place).bitwiseAND(F.lit(0xFFFF)) * 31 ** (3 - place)
    add = lambda h, w: unsigned(h * 31**4 + unit(w, 0) + unit(w, 1) + unit(w, 2) + unit(w, 3))
    return F.get(F.transform(F.array(F.encode(text, "UTF-16BE")), lambda raw: F.aggregate(steps(raw), F.lit(0).cast("long"), add)), 0)


BLOCK = 1 << 16
POWERS = np.array([pow(31, BLOCK - 1 - i, 1 << 32) for i in range(BLOCK)], np.uint32)


def unit_hash(raw: bytes) -> int:
    """The signed hash of a text's UTF-8, a block of units at a time."""
    units = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-16-le"), "<u2")
    h = 0
    for i in range(0, len(units), BLOCK):
        part = units[i : i + BLOCK].astype(np.uint32)
        h = (h * pow(31, len(part), 1 << 32) + int(np.dot(part, POWERS[BLOCK - len(part) :]))) & MASK
    return (h + (1 << 31) & MASK) - (1 << 31)


def java_hash(text: Column) -> Column:
    """int32(string_hash()) of texts of any length, in Arrow batches."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else unit_hash(x) for x in texts.to_pylist()], pa.int64())

    return F.arrow_udf(run, "long")(text.cast("binary"))


def iri_hash(iri: Column) -> Column:
    """Namespace (through the last of # / :) and rest, hashed apart and added."""
    part = lambda i: F.regexp_extract(iri, r"(?s)^(.*[#/:])?(.*)$", i)
    return unsigned(string_hash(part(1)) + string_hash(part(2)))


def combined(seed: int, *parts: Column) -> Column:
    out = F.lit(seed).cast("long")
    for p in parts:
        out = unsigned(out * 31 + p)
    return out


def set_hash(hashes: Column) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, x: unsigned(a + x))


def property_hash(prop: Column, hashed: Column) -> Column:
    """``hashed`` is iri_hash() of the property's IRI."""
    named = combined(HASH_SEEDS["object_property"], hashed)
    chain = string_hash(F.lit("ObjectPropertyChain"))
    return F.when(F.coalesce(prop["chain"], F.lit(False)), chain).when(prop["inverse"], combined(HASH_SEEDS["inverse"], named)).otherwise(named)


def annotation_hashes(ann: Column) -> Column:
    property_ = lambda x: unsigned(iri_hash(x["prop"]))
    value = lambda x: F.when(x["iri"].isNotNull(), iri_hash(x["iri"])).otherwise(string_hash(F.coalesce(x["key"], x["lexical"], F.lit(""))))
    return F.transform(F.coalesce(ann, F.array().cast(S.ANNOTATIONS)), lambda x: combined(HASH_SEEDS["annotation"], property_(x), value(x)))


def role_axiom_hash(inverse: bool, first: Column, second: Column, annotations: Column) -> Column:
    """From the hashes of both properties and of the set of annotations."""
    if inverse:
        return combined(HASH_SEEDS["inverse_properties"], unsigned(first + second), annotations)
    return combined(HASH_SEEDS["sub_property"], first, second, annotations)


def by_tag(tag: Column, values: dict[int, Column]) -> Column:
    """The value of a constructor number; null for others."""
    out = F.lit(None).cast("long")
    for k, v in values.items():
        out = F.when(tag == k, v.cast("long")).otherwise(out)
    return out


def member_hash(e: Column) -> Column:
    """Of an operand, or of an expression without operands: a class, or a restriction by a named class. Null where the
    filler is no named class, since a row does not hold what that is."""
    seed = by_tag(e["tag"], {k: F.lit(v) for k, v in EXPRESSION_SEEDS.items() if k not in (S.AND, S.OR)})
    held = unsigned(seed * 31 + property_hash(e["prop"], iri_hash(e["prop"]["iri"])))
    held = F.when(e["tag"].isin(S.MIN, S.MAX), unsigned(held * 31 + unsigned(e["card"]))).otherwise(held)
    restriction = unsigned(held * 31 + F.when(e["filler_tag"] == S.ENTITY, combined(HASH_SEEDS["class"], iri_hash(e["filler_iri"]))))
    unseeded = by_tag(e["tag"], {k: string_hash(F.lit(v)) for k, v in UNSEEDED.items()})
    return F.when(e["tag"] == S.ENTITY, combined(HASH_SEEDS["class"], iri_hash(e["iri"]))).otherwise(F.coalesce(unseeded, restriction))


def expression_hash(e: Column) -> Column:
    """Of a class expression, unsigned. Operands are a set; null if one of them has none."""
    seed = by_tag(e["tag"], {k: F.lit(EXPRESSION_SEEDS[k]) for k in (S.AND, S.OR)})
    joined = unsigned(seed * 31 + set_hash(F.transform(F.array_distinct(e["operands"]), member_hash)))
    return F.when(e["tag"].isin(S.AND, S.OR), joined).otherwise(member_hash(e))


def spread(hash_: Column) -> Column:
    return hash_.bitwiseXOR(F.shiftright(hash_, 16))


def datatype_name(datatype: Column) -> Column:
    return F.when(F.startswith(datatype, F.lit(S.XSD)), F.concat(F.lit("xsd:"), F.substr(datatype, F.lit(len(S.XSD) + 1)))).otherwise(F.concat(F.lit("<"), datatype, F.lit(">")))


def literal_text(lexical: Column, datatype: Column) -> Column:
    """Strings as they are. Of others the quoted form loses every backslash, its first and its last character."""
    bare = F.replace(lexical, F.lit("\\"), F.lit(""))
    for raw, letter in (("\n", "n"), ("\r", "r"), ("\t", "t")):  # what is left of \n, \r, \t without the backslash
        bare = F.replace(bare, F.lit(raw), F.lit(letter))
    whole = F.concat(bare, F.lit('"^^'), F.replace(datatype_name(datatype), F.lit("\\"), F.lit("")))
    cut = F.substr(whole, F.lit(1), F.length(whole) - 1)
    return F.when(datatype.isin(S.XSD_STRING, S.PLAIN_LITERAL), lexical).otherwise(cut)


def blank_label(key: Column) -> Column:
    """A local key as text (hexadecimal, if it isn't UTF-8) behind one ``_:``."""
    label = F.when(F.is_valid_utf8(key.cast("string")), key.cast("string")).otherwise(F.lower(F.hex(key)))
    return F.when(F.startswith(label, F.lit("_:")), label).otherwise(F.concat(F.lit("_:"), label))


def json_string(x: Column) -> Column:
    """A JSON string with only what must be escaped, control characters in lower-case hexadecimal."""
    out = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    for raw, to in (('"', '\\"'), ("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(to))
    rare = out
    for code in range(0x20):
        if chr(code) not in "\b\f\n\r\t":
            rare = F.replace(rare, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), F.when(out.rlike(r"[\x00-\x1f]"), rare).otherwise(out), F.lit('"'))


def edge_json(source: Column, relation: Column, destination: Column) -> Column:
    return F.concat(F.lit('{"source":'), json_string(source), F.lit(',"relation":'), json_string(relation), F.lit(',"destination":'), json_string(destination), F.lit("}"))
