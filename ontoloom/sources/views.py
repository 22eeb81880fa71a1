"""Ontologies as bundles of DataFrames: scopes, imports closure, and the algebra of segments."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..errors import IncompatibleSource
from ..storage import durable


class Ontology:
    """One DataFrame for each kind of axiom (schema.KINDS), and the documents and entities.

    A kind that is not given is empty. Kinds are narrow and apart, so a query reads only the columns and rows of
    the kinds that it visits; from_table() gets them from one table by a partition filter."""

    def __init__(self, spark: SparkSession, axioms: Mapping[str, DataFrame | Callable[[], DataFrame]], documents: DataFrame, entities: DataFrame, anonymous: tuple[str, ...] | None = None):
        """A kind may be given as a function, which is called when the kind is first asked for. ``anonymous`` are the
        kinds whose axioms may name anonymous individuals, if that is known; others are not looked through for them."""
        self.spark, self._axioms, self.documents, self.entities, self._anonymous = spark, dict(axioms), documents, entities, anonymous
        self.source_kind = "frames"
        self.memo: dict = {}  # what is found once for a view
        for kind, df in self._axioms.items():
            if kind not in S.KINDS:
                raise IncompatibleSource(f"no such kind of axiom: {kind}", constructor=kind)
            if not callable(df):
                self._check(kind, df)

    @staticmethod
    def _check(kind: str, df: DataFrame) -> DataFrame:
        have = {f.name: f.dataType for f in df.schema}
        missing = {f.name for f in S.schema_of(kind)} - set(have)
        if missing:
            raise IncompatibleSource(f"{kind} lacks {', '.join(sorted(missing))}", constructor=kind)
        other = [f.name for f in S.schema_of(kind) if have[f.name].simpleString() != f.dataType.simpleString()]
        if other:
            raise IncompatibleSource(f"{kind} has other types of {', '.join(other)}", constructor=kind)
        return df

    @classmethod
    def from_table(cls, table: DataFrame, documents: DataFrame, entities: DataFrame) -> Ontology:
        """``table`` has all columns of schema.KINDS and ``axiom``, the kind, by which it should be partitioned."""
        kinds = {k: table.where(F.col("axiom") == k).select(*(f.name for f in S.schema_of(k))) for k in S.KINDS}
        out = cls(table.sparkSession, kinds, documents, entities)
        out.source_kind = "table"
        return out

    def axioms(self, kind: str, root: bool = False) -> DataFrame:
        if kind not in self._axioms:
            return self.spark.createDataFrame([], S.schema_of(kind))
        if callable(self._axioms[kind]):
            self._axioms[kind] = self._check(kind, self._axioms[kind]())
        df = self._axioms[kind].select(*(f.name for f in S.schema_of(kind)))
        # Inner joins with what is there once: a semi-join would be pushed below every part of a union, with its right side.
        # Roots are few; a join by shuffle would bring all that a root has to one task.
        return df.join(F.broadcast(self.documents.where("is_root").select("doc_id").distinct()), "doc_id").select(*df.columns) if root else df

    def kinds(self) -> list[str]:
        return [k for k in S.KINDS if k in self._axioms]

    def anonymous_kinds(self) -> list[str]:
        return [k for k in self.kinds() if self._anonymous is None or k in self._anonymous]

    def mapped(self, f) -> Ontology:
        return Ontology(self.spark, {k: f(k, self.axioms(k)) for k in self.kinds()}, self.documents, self.entities, self._anonymous)

    def closure(self, root: str | None = None) -> Ontology:
        """Only documents that the root reaches by imports; equal axioms of several documents count once."""
        missing = missing_imports(self.documents)
        if not missing.isEmpty():
            lost = [r["import_id"] for r in missing.limit(20).collect()]
            raise IncompatibleSource(f"imports that no document answers: {', '.join(lost)}")
        docs = self.documents
        if root is not None:
            reached = imports_closure(docs, root)
            docs = docs.join(reached, "doc_id", "left_semi").withColumn("is_root", F.col("doc_id") == root)
        kept = docs.select("doc_id")
        roots = docs.where("is_root").select("doc_id", F.lit(True).alias("_root"))

        def once(kind: str, df: DataFrame) -> DataFrame:
            df = df.join(kept, "doc_id", "left_semi").select(*df.columns)
            if kind == "AnnotationAssertion":  # the root's copy stays, the scope matters there
                first = df.join(F.broadcast(roots), "doc_id", "left").withColumn("_root", F.coalesce("_root", F.lit(False)))
                low = first.groupBy("canon").agg(F.min(F.struct((~F.col("_root")).alias("n"), "doc_id", *(c for c in df.columns if c not in ("doc_id", "canon")))).alias("m"))
                return low.select("m.doc_id", "canon", *(f"m.{c}" for c in df.columns if c not in ("doc_id", "canon")))
            return df.dropDuplicates(["canon"])

        return Ontology(self.spark, {k: once(k, self.axioms(k)) for k in self.kinds()}, docs, self.entities.join(kept, "doc_id", "left_semi").select("doc_id", "kind", "iri"), self._anonymous)


def class_signature(view: Ontology) -> DataFrame:
    return view.entities.where("kind = 'class'").select("iri").distinct()


def imports_closure(documents: DataFrame, root: str) -> DataFrame:
    """``doc_id`` of all documents reached from the root, itself included; cycles and diamonds count once. Rounds of
    equi-joins from the documents that the round before reached first, each kept durably, until one reaches nothing new:
    as many as the longest shortest way. (Recursive SQL ends only where a UNION drops what is known, which Spark's does
    not have.)"""
    spark = documents.sparkSession
    edges = documents.select(F.col("doc_id").alias("from"), F.explode("imports").alias("to")).distinct()
    front = known = spark.createDataFrame([(root,)], "doc_id string")
    while True:
        reached = front.join(edges, front["doc_id"] == edges["from"]).select(F.col("to").alias("doc_id")).distinct()
        front = durable(reached.join(known, "doc_id", "left_anti"))
        if front.isEmpty():
            return known
        known = durable(known.unionByName(front))


def missing_imports(documents: DataFrame) -> DataFrame:
    asked = documents.select("doc_id", F.explode("imports").alias("import_id"))
    return asked.join(documents.select(F.col("doc_id").alias("import_id")), "import_id", "left_anti").select("doc_id", "import_id").distinct()


def direct(axioms: DataFrame) -> DataFrame:
    return axioms


def overlay(base: DataFrame, delta: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """A base less the axioms at ``excluded(canon)``, and what the overlay adds."""
    kept = base if excluded is None else base.join(excluded.select("canon").distinct(), "canon", "left_anti").select(*base.columns)
    return kept.unionByName(delta)


def composite(members: list[tuple[DataFrame, str, DataFrame | None]], bridge: DataFrame | None = None) -> DataFrame:
    """Members with the part of each that counts (ALL, or INCLUDE or EXCLUDE by ``canon``), and at most one bridge.
    Equal axioms count once."""
    if len(members) < 2:
        raise IncompatibleSource("a composite has two members at least")
    parts = []
    for df, mode, postings in members:
        if mode not in ("ALL", "INCLUDE", "EXCLUDE"):
            raise IncompatibleSource(f"no such selection: {mode}")
        if mode != "ALL":
            df = df.join(postings.select("canon").distinct(), "canon", "left_semi" if mode == "INCLUDE" else "left_anti").select(*df.columns)
        parts.append(df)
    if bridge is not None:
        parts.append(bridge)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["canon"])


def remap_scopes(anonymous: DataFrame, remap: DataFrame) -> DataFrame:
    """``anonymous(scope, ...)`` with scopes replaced by those of ``remap(scope, new_scope)``, which keeps their order;
    without a change of order only. Neighbours in the old order are compared inside range partitions, and across these
    the least and the greatest of each."""
    kept = durable(remap.select("scope", "new_scope").repartitionByRange("scope").withColumn("part", F.spark_partition_id()))
    before = F.lag("new_scope").over(Window.partitionBy("part").orderBy("scope"))
    inside = kept.withColumn("before", before).where("new_scope <= before").select("part").limit(1)
    ends = kept.groupBy("part").agg(F.min("new_scope").alias("low"), F.max("new_scope").alias("high"))  # one row a partition
    reach = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    across = ends.withColumn("before", F.max("high").over(reach)).where("low <= before").select("part").limit(1)
    if not inside.unionByName(across).isEmpty():
        raise IncompatibleSource("the remap changes the order of scopes")
    return anonymous.join(remap, "scope", "left").withColumn("scope", F.coalesce("new_scope", "scope")).drop("new_scope")
