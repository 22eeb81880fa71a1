"""Inputs made by rule, of any size."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import canon as C
from .views import Ontology


def named_class(iri: Column) -> Column:
    return F.struct(
        F.lit(S.ENTITY).alias("tag"), iri.alias("iri"), F.lit(None).cast(S.PROP).alias("prop"), F.lit(None).cast("long").alias("card"),
        F.lit(None).cast("int").alias("filler_tag"), F.lit(None).cast("string").alias("filler_iri"), C.column(C.named_class, iri).alias("canon"),
    )


FIELDS = ("tag", "iri", "prop", "card", "filler_tag", "filler_iri", "canon")
PROP_FIELDS = ("iri", "inverse", "chain", "canon")


def with_operands(expr: Column, operands: Column | None = None) -> Column:
    return F.struct(*(expr[n].alias(n) for n in FIELDS), (F.lit(None) if operands is None else operands).cast(f"array<{S.OPERAND}>").alias("operands"))


def chosen(condition: Column, a: Column, b: Column, fields: tuple[str, ...] = FIELDS) -> Column:
    """a or b, field by field, those of the property too, so that fields which nothing reads go away. One without a
    property has the nulls of one."""
    of = lambda x, y: F.when(condition, x).otherwise(y)
    prop = F.struct(*(of(a["prop"][n], b["prop"][n]).alias(n) for n in PROP_FIELDS))
    return F.struct(*((prop if n == "prop" else of(a[n], b[n])).alias(n) for n in fields))


def object_property(iri: Column | str) -> Column:
    """``iri`` as a string is that of all rows, whose canonical bytes are made once."""
    raw = F.lit(C.prop(iri)) if isinstance(iri, str) else C.column(C.prop, iri)
    return F.struct((F.lit(iri) if isinstance(iri, str) else iri).alias("iri"), F.lit(False).alias("inverse"), F.lit(False).alias("chain"), raw.alias("canon"))


def restriction(tag: Column, prop: Column, filler: Column, card: Column) -> Column:
    """``filler`` is the IRI of a named class; null stands for a filler that is none."""
    raw = C.column(lambda t, p, f, c: C.restriction(int(t), C.prop(p), f, None if c is None else int(c)), tag, prop["iri"], filler, card)
    return F.struct(
        tag.cast("int").alias("tag"), F.lit(None).cast("string").alias("iri"), prop.alias("prop"), card.cast("long").alias("card"),
        F.when(filler.isNull(), 32).otherwise(S.ENTITY).alias("filler_tag"), filler.alias("filler_iri"), raw.alias("canon"),
    )


def axiom(df: DataFrame, kind: str, doc: str | Column, fields: dict[str, Column], canon: Column, anons: Column | None = None) -> DataFrame:
    doc = F.lit(doc) if isinstance(doc, str) else doc
    none = F.array().cast("array<binary>")
    return df.select(doc.alias("doc_id"), canon.alias("canon"), (none if anons is None else anons).alias("anons"), *(c.alias(n) for n, c in fields.items())).select(*(f.name for f in S.schema_of(kind)))


def subclass(df: DataFrame, doc, sub: Column, sup: Column) -> DataFrame:
    """``sub`` and ``sup`` are operands' structs."""
    raw = C.column(lambda a, b: C.axiom("SubClassOf", a, b), sub["canon"], sup["canon"])
    return axiom(df, "SubClassOf", doc, {"sub": with_operands(sub), "sup": with_operands(sup)}, raw)


def chain(spark: SparkSession, n: int) -> Ontology:
    """n axioms: class i is a subclass of class i + 1."""
    name = lambda i: F.concat(F.lit("urn:p4:class:"), F.lpad(i.cast("string"), 9, "0"))
    df = spark.range(n).select(named_class(name(F.col("id"))).alias("a"), named_class(name(F.col("id") + 1)).alias("b"))
    documents = spark.createDataFrame([("root", [], True)], S.DOCUMENTS)
    entities = spark.range(n + 1).select(F.lit("root").alias("doc_id"), F.lit("class").alias("kind"), name(F.col("id")).alias("iri"))
    return Ontology(spark, {"SubClassOf": subclass(df, "root", F.col("a"), F.col("b"))}, documents, entities, anonymous=())


def synthetic_edges(spark: SparkSession, n: int) -> DataFrame:
    """n edges over max(1, 4n div 5) classes and 17 relations."""
    classes = max(1, n * 4 // 5)
    name = lambda kind, i, width: F.concat(F.lit(f"urn:synthetic:{kind}:"), F.lpad(i.cast("string"), width, "0"))
    i = F.col("id")
    return spark.range(n).select(
        name("class", F.pmod(i, F.lit(classes)), 9).alias("source"),
        name("relation", F.pmod(i, F.lit(17)), 2).alias("relation"),
        name("class", F.pmod(i * 37, F.lit(classes)), 9).alias("destination"),
    )


# Random numbers

#: Fixed values of SplitMix64: what the state grows by, and the factors of its output.
GAMMA, FACTORS, SHIFTS = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB), (30, 27, 31)
HALF = 0xFFFFFFFF


class Word(NamedTuple):
    """An unsigned 64-bit number as two columns of 32 bits: longs do not wrap around in ANSI mode."""

    high: Column
    low: Column


def word(value: Column) -> Word:
    return Word(F.shiftrightunsigned(value, 32), value.bitwiseAND(F.lit(HALF)))


def plus(a: Word, b: Word) -> Word:
    low = a.low + b.low
    return Word((a.high + b.high + F.shiftright(low, 32)).bitwiseAND(F.lit(HALF)), low.bitwiseAND(F.lit(HALF)))


def times(a: Word, factor: int) -> Word:
    """The low 64 bits of a product, by products of 32 and 16 bits."""

    def product(x: Column, k: int) -> Word:  # x, k of 32 bits
        upper = x * F.lit(k >> 16)
        low = x * F.lit(k & 0xFFFF) + F.shiftleft(upper.bitwiseAND(F.lit(0xFFFF)), 16)
        return Word((F.shiftright(low, 32) + F.shiftright(upper, 16)).bitwiseAND(F.lit(HALF)), low.bitwiseAND(F.lit(HALF)))

    own = product(a.low, factor & HALF)
    high = own.high + product(a.high, factor & HALF).low + product(a.low, factor >> 32).low
    return Word(high.bitwiseAND(F.lit(HALF)), own.low)


def shifted_in(a: Word, by: int) -> Word:
    """a XOR a >> by, for a shift under 32."""
    low = F.shiftright(a.low, by) + F.shiftleft(a.high.bitwiseAND(F.lit((1 << by) - 1)), 32 - by)
    return Word(a.high.bitwiseXOR(F.shiftright(a.high, by)), a.low.bitwiseXOR(low))


def split_mix(seed: Column, count: Column) -> Word:
    """The number that SplitMix64 from ``seed`` gives at call ``count``, from 1 on. Every call's state is the seed and so
    many times GAMMA, so any row has its number without those before."""
    steps = times(word(count), GAMMA)
    z = plus(word(seed), steps)
    for shift, factor in zip(SHIFTS, FACTORS, strict=False):
        z = times(shifted_in(z, shift), factor)
    return shifted_in(z, SHIFTS[-1])


def hex64(a: Word) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(a.high), 8, "0"), F.lpad(F.hex(a.low), 8, "0")))


def index(a: Word, length: int) -> Column:
    """The number modulo ``length``, which has 31 bits at most."""
    return F.pmod(F.pmod(a.high, F.lit(length)) * F.lit((1 << 32) % length) + a.low, F.lit(length))


KINDS = ("named", "some", "all", "role", "inverse", "typed", "related")


def random_cases(spark: SparkSession, cases: int, axioms: int, seed: int = 0) -> DataFrame:
    """``case, kind, a, b, r`` of as many axioms for each case: a mixture of kinds over eight classes, four roles and four
    individuals. Each number comes from the case's seed and its place alone."""
    df = spark.range(cases * axioms).select(F.floor(F.col("id") / axioms).alias("case"), F.pmod("id", F.lit(axioms)).alias("place"))
    draw = lambda k, n: index(split_mix(F.col("case") + seed, F.col("place") * 4 + k), n)
    return df.select("case", F.element_at(F.array(*map(F.lit, KINDS)), (draw(1, len(KINDS)) + 1).cast("int")).alias("kind"), draw(2, 8).alias("a"), draw(3, 8).alias("b"), draw(4, 4).alias("r"))
