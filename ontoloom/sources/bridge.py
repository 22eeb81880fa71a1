"""An ontology made from star-schema tables, for measurements and for comparison with SQL.

Nations are classes below regions, parts carry restrictions, brands are equivalent to aggregates of types, nations
also number the roles; customers and suppliers are individuals, order lines relate orders to parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import canon as C
from ..functions import canon_columns as K
from .generators import axiom, chosen, named_class, object_property, restriction, subclass, with_operands
from .views import Ontology

UNSUPPORTED = "urn:tpch:ann#unsupported"
LABEL, COMMENT = S.RDFS + "label", S.RDFS + "comment"
PREF_LABEL, ALT_LABEL, TITLE = "http://www.w3.org/2004/02/skos/core#prefLabel", "http://www.w3.org/2004/02/skos/core#altLabel", "http://purl.org/dc/terms/title"
IMPORTS = {"root": ["geo", "catalog"], "geo": ["core"], "catalog": ["core"], "core": ["root"]}
SCOPE = bytes(range(32))


def urn(kind: str, key) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit(f"urn:tpch:{kind}#"), key.cast("string"))


class Bridge:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._tables: dict[str, DataFrame] = {}

    def read(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    def named_subclasses(self) -> DataFrame:
        n = self.read("nation").select(named_class(urn("nation", "n_nationkey")).alias("a"), named_class(urn("region", "n_regionkey")).alias("b"))
        return subclass(n, "geo", F.col("a"), F.col("b"))

    def restrictions(self) -> DataFrame:
        kind, k = F.col("p_partkey") % 6, F.col("p_partkey")
        tag = F.element_at(F.array(*(F.lit(t) for t in (S.SOME, S.ALL, S.MIN, S.MAX, S.EXACT, S.SOME))), kind.cast("int") + 1)
        filler = F.when(kind < 5, urn("type", "p_type"))
        expr = restriction(tag, object_property(urn("prop", k % 25)), filler, F.when(kind.between(2, 4), F.lit(1).cast("long")))
        part, above = named_class(urn("part", "p_partkey")), F.floor(k / 6) % 2 == 0
        return subclass(self.read("part"), "catalog", chosen(above, part, expr), chosen(above, expr, part))

    def equivalences(self) -> DataFrame:
        number = F.substring("p_brand", 7, 9).cast("int")
        base = self.read("part").select("p_brand", "p_type").distinct()
        types = base.select("p_brand", named_class(urn("type", "p_type")).alias("o"))
        brands = base.select("p_brand").distinct()
        prop, every, no = object_property(urn("prop", F.pmod(number, F.lit(25)))), F.lit("urn:tpch:type#ALL"), F.lit(None).cast("long")
        types = types.unionByName(brands.select("p_brand", restriction(F.lit(S.SOME), prop, every, no).alias("o")))
        types = types.unionByName(brands.select("p_brand", restriction(F.lit(S.EXACT), prop, every, F.lit(1).cast("long")).alias("o")))
        df = types.groupBy("p_brand").agg(F.collect_list("o").alias("operands")).withColumn("tag", F.when(number % 2 == 0, S.AND).otherwise(S.OR))
        raw = C.column(lambda t, xs: C.node(int(t), C.members(bytes(x) for x in xs)), F.col("tag"), F.transform("operands", lambda o: o["canon"]))
        none = F.lit(None)
        aggregate = F.struct(F.col("tag"), none.cast("string").alias("iri"), none.cast(S.PROP).alias("prop"), none.cast("long").alias("card"), none.cast("int").alias("filler_tag"), none.cast("string").alias("filler_iri"), raw.alias("canon"))
        parts = [self._equivalent(df, named_class(urn("brand", "p_brand")), aggregate, F.col("operands"))]
        n = self.read("nation")
        parts.append(self._equivalent(n, named_class(urn("nation", "n_nationkey")), named_class(urn("country", "n_name"))))
        some = restriction(F.lit(S.SOME), object_property(urn("prop", "n_nationkey")), urn("region", "n_regionkey"), no)
        parts.append(self._equivalent(n.where("n_nationkey % 2 = 0"), named_class(urn("nation", "n_nationkey")), some))
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    def _equivalent(self, df: DataFrame, a: Column, b: Column, operands: Column | None = None) -> DataFrame:
        raw = C.column(lambda x, y: C.node(S.AXIOM_TAGS["EquivalentClasses"], C.members((x, y)), C.members(())), a["canon"], b["canon"])
        return axiom(df, "EquivalentClasses", "catalog", {"exprs": F.array(with_operands(a), with_operands(b, operands))}, raw)

    def roles(self, kind: str) -> DataFrame:
        n, name = F.col("n_nationkey"), F.col("n_name")
        to = (n * 7 + 3) % 25 if kind == "SubObjectPropertyOf" else (n * 11 + 5) % 25
        note = F.when(F.col("noted"), F.array(F.struct(F.lit(COMMENT).alias("prop"), F.lit(None).cast("string").alias("iri"), F.lit(None).cast("string").alias("key"), name.alias("lexical")))).otherwise(F.array().cast(S.ANNOTATIONS))
        df = self.read("nation").withColumn("noted", F.lit(False))
        if kind == "SubObjectPropertyOf":  # annotated variants are axioms of their own
            df = df.unionByName(self.read("nation").where("n_nationkey % 5 = 0").withColumn("noted", F.lit(True)))
        a, b = urn("prop", n), urn("prop", to)
        raw = C.column(lambda x, y, noted, lexical: C.axiom(kind, C.prop(x), C.prop(y), annotations=[Bridge.note(lexical)] if noted else ()), a, b, F.col("noted"), name)
        return axiom(df, kind, "core", {"p1": object_property(a), "p2": object_property(b), "ann": note}, raw)

    @staticmethod
    def note(lexical: str) -> bytes:
        return C.annotation(COMMENT, C.literal(str(lexical), S.XSD_STRING))

    def domains(self) -> DataFrame:
        df = self.read("customer").select("c_mktsegment", "c_nationkey").distinct()
        return self._sided(df, "ObjectPropertyDomain", urn("nation", "c_nationkey"))

    def ranges(self) -> DataFrame:
        seg = self.read("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
        df = self.read("orders").select("o_custkey", "o_orderpriority").distinct().join(seg, "o_custkey").select("c_mktsegment", "o_orderpriority").distinct()
        return self._sided(df, "ObjectPropertyRange", urn("priority", "o_orderpriority"))

    def _sided(self, df: DataFrame, kind: str, cls: Column) -> DataFrame:
        p = urn("segment", "c_mktsegment")
        raw = K.axiom(kind, K.prop(p), K.named_class(cls))
        return axiom(df, kind, "core", {"p1": object_property(p), "sub": with_operands(named_class(cls))}, raw)

    def individual(self, iri: Column, anon: Column, key: Column) -> tuple[Column, Column]:
        """A struct of S.IND, and the array of what is anonymous in it."""
        raw = F.when(anon, K.anonymous(SCOPE, key))
        made = F.struct(F.when(~anon, iri).alias("iri"), raw.alias("anon"), F.when(anon, F.concat(F.lit("_:"), key)).alias("label"))
        return made, F.when(anon, F.array(raw)).otherwise(F.array().cast("array<binary>"))

    def named_individual(self, iri: Column) -> Column:
        return F.struct(iri.alias("iri"), F.lit(None).cast("binary").alias("anon"), F.lit(None).cast("string").alias("label"))

    def class_assertions(self) -> DataFrame:
        c = self.read("customer").select(urn("customer", "c_custkey").alias("iri"), F.concat(F.lit("c"), F.col("c_custkey")).alias("key"), (F.col("c_custkey") % 50 == 0).alias("anon"), F.col("c_nationkey").alias("n"))
        s = self.read("supplier").select(urn("supplier", "s_suppkey").alias("iri"), F.concat(F.lit("s"), F.col("s_suppkey")).alias("key"), F.lit(False).alias("anon"), F.col("s_nationkey").alias("n"))
        ind, anons = self.individual(F.col("iri"), F.col("anon"), F.col("key"))
        raw = K.axiom("ClassAssertion", K.named_class(urn("nation", "n")), F.when(F.col("anon"), K.anonymous(SCOPE, F.col("key"))).otherwise(K.individual(F.col("iri"))))
        return axiom(c.unionByName(s), "ClassAssertion", "core", {"sub": with_operands(named_class(urn("nation", "n"))), "i1": ind}, raw, anons)

    def object_assertions(self) -> DataFrame:
        df = self.read("lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
        anon, key, order, part, rel = F.col("l_orderkey") % 97 == 0, F.concat(F.lit("o"), F.col("l_orderkey")), urn("order", "l_orderkey"), urn("part", "l_partkey"), "urn:tpch:prop#hasPart"
        ind, anons = self.individual(order, anon, key)

        source = F.when(anon, K.anonymous(SCOPE, key)).otherwise(K.individual(order))
        note = K.annotation(COMMENT, K.literal(F.col("l_linenumber").cast("string"), F.lit(S.XSD_STRING)))
        raw = K.axiom("ObjectPropertyAssertion", K.prop(F.lit(rel)), source, K.individual(part), annotations=F.array(note))
        return axiom(df, "ObjectPropertyAssertion", "core", {"p1": object_property(rel), "i1": ind, "i2": self.named_individual(part)}, raw, anons)

    def annotations(self) -> DataFrame:
        none = F.lit(None).cast("string")

        def rows(df: DataFrame, doc: str, prop: str, subject: Column, lexical=None, datatype=None, lang=None, iri=None) -> DataFrame:
            return df.select(F.lit(doc).alias("doc"), F.lit(prop).alias("prop"), subject.alias("subject"), (none if lexical is None else lexical.cast("string")).alias("lexical"), F.lit(datatype).cast("string").alias("datatype"), (none if lang is None else lang).alias("lang"), (none if iri is None else iri).alias("iri"))

        nation, part = self.read("nation"), self.read("part").select("p_partkey", "p_name", "p_size", "p_brand")
        docs = self.read("documents").select((F.col("doc_id") % 25).alias("n"), "text", "lang").distinct()
        parts = [
            rows(nation, "root", LABEL, urn("nation", "n_nationkey"), F.col("n_name"), S.XSD_STRING),
            rows(nation, "root", UNSUPPORTED, urn("nation", "n_nationkey"), F.col("n_name"), S.XSD_STRING),
            rows(part, "root", PREF_LABEL, urn("part", "p_partkey"), F.col("p_name"), S.XSD_STRING),
            rows(part, "root", ALT_LABEL, urn("part", "p_partkey"), F.col("p_size"), S.XSD + "integer"),
            rows(part, "root", TITLE, urn("part", "p_partkey"), iri=urn("brand", "p_brand")),
            rows(docs, "root", COMMENT, urn("nation", "n"), F.col("text"), S.PLAIN_LITERAL, F.col("lang")),
            rows(self.read("supplier"), "root", LABEL, urn("supplier", "s_suppkey"), F.col("s_name"), S.XSD_STRING),
            rows(self.read("region"), "geo", LABEL, urn("region", "r_regionkey"), F.col("r_name"), S.XSD_STRING),
        ]
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p)

        value = F.when(F.col("iri").isNotNull(), K.iri(F.col("iri"))).otherwise(K.literal(F.col("lexical"), F.col("datatype"), F.col("lang")))
        raw = K.axiom("AnnotationAssertion", K.entity("annotation_property", F.col("prop")), K.iri(F.col("subject")), value)
        own = F.struct(F.when(F.col("iri").isNotNull(), "iri").otherwise("literal").alias("kind"), F.col("iri"), F.lit(None).cast("binary").alias("anon"), none.alias("label"), F.col("lexical"), F.col("datatype"), F.col("lang"))
        return axiom(df, "AnnotationAssertion", F.col("doc"), {"prop": F.col("prop"), "subject": F.col("subject"), "value": own}, raw)

    def others(self) -> DataFrame:
        """One axiom of every skipped kind for each nation, and as many silent roots as regions."""
        kinds = F.explode(F.array(*(F.lit(k) for k in S.SKIPPED))).alias("kind")
        a = self.read("nation").select(F.col("n_nationkey").alias("n"), kinds, F.lit(2).alias("root_kind"))
        b = self.read("region").select(F.col("r_regionkey").alias("n"), F.lit("Rule").alias("kind"), F.lit(3).alias("root_kind"))
        df = a.unionByName(b)
        raw = C.column(lambda i, k: C.node(110, C.sub(C.iri(i)), C.text(k)), urn("nation", "n"), F.col("kind"))
        return axiom(df, "Other", "core", {"kind": F.col("kind"), "root_kind": F.col("root_kind")}, raw)

    def documents(self) -> DataFrame:
        return self.spark.createDataFrame([(d, i, d == "root") for d, i in IMPORTS.items()], S.DOCUMENTS)

    def entities(self) -> DataFrame:
        """Classes are declared where they are used; one of them twice."""
        part = self.read("part").select("p_partkey", "p_type", "p_brand")
        parts = [
            self.read("nation").select(F.lit("geo").alias("doc_id"), urn("nation", "n_nationkey").alias("iri")),
            self.read("region").select(F.lit("geo").alias("doc_id"), urn("region", "r_regionkey").alias("iri")),
            self.read("nation").select(F.lit("catalog").alias("doc_id"), urn("country", "n_name").alias("iri")),
            self.read("nation").select(F.lit("core").alias("doc_id"), urn("nation", "n_nationkey").alias("iri")),
            part.select(F.lit("catalog").alias("doc_id"), urn("part", "p_partkey").alias("iri")),
            part.select(F.lit("catalog").alias("doc_id"), urn("type", "p_type").alias("iri")).distinct(),
            part.select(F.lit("catalog").alias("doc_id"), urn("brand", "p_brand").alias("iri")).distinct(),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.select("doc_id", F.lit("class").alias("kind"), "iri")

    def view(self) -> Ontology:
        return Ontology(self.spark, {
            "SubClassOf": lambda: self.named_subclasses().unionByName(self.restrictions()),
            "EquivalentClasses": self.equivalences,
            "SubObjectPropertyOf": lambda: self.roles("SubObjectPropertyOf"),
            "InverseObjectProperties": lambda: self.roles("InverseObjectProperties"),
            "ObjectPropertyDomain": self.domains,
            "ObjectPropertyRange": self.ranges,
            "ClassAssertion": self.class_assertions,
            "ObjectPropertyAssertion": self.object_assertions,
            "AnnotationAssertion": self.annotations,
            "Other": self.others,
        }, self.documents(), self.entities(), anonymous=("ClassAssertion", "ObjectPropertyAssertion"))


def star_view(spark: SparkSession, sf_dir: str) -> Ontology:
    return Bridge(spark, sf_dir).view()
