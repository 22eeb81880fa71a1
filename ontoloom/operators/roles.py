"""Role state: which sub-roles and which inverse a role expands to.

Each sub-role axiom, when it is visited, gives its upper role the list of its sub-role followed by the list that the
sub-role has at that time. So the axiom points to the one that last gave its sub-role a list, and the list of a role is
what one meets on the way from the last axiom that gave it one. The state is these pointers: one for each axiom, though
lists may have as many entries as the square of their number.

Nothing of this passes the driver but counts. Axioms are numbered over a range partitioning in the order in which the
hash table is visited; pointers are an as-of lookup by a window; lists grow by pointer doubling, so a list of n entries
takes log2 n rounds of equi-joins, each kept durably.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import annotation_hashes, iri_hash, property_hash, role_axiom_hash, set_hash, spread
from ..sources.views import Ontology
from ..storage import durable, numbered

#: Bytes of all expansions up to which they are sent to all tasks; beyond, they are joined by shuffle.
BROADCAST_BYTES = 16 << 20
#: What a role's edge becomes: number 0 is the edge itself, sub-roles follow, the inverse, with its ends swapped, is last.
EXPANSIONS = "relation string, emit int, role string, swapped boolean"
LAST_EMIT = (1 << 31) - 1
STATE = {"pointers": "number long, sub string, before long", "last": "relation string, number long", "inverses": "relation string, inverse string"}


def role_axioms(view: Ontology) -> DataFrame:
    """Both kinds with their structural hash; ``first`` and ``second`` are null for chains."""
    named = lambda p: F.when(~F.coalesce(p["chain"], F.lit(False)), p["iri"])
    parts = []
    for kind, inverse in (("SubObjectPropertyOf", False), ("InverseObjectProperties", True)):
        # Hashes of names are columns before they are combined, so that the plan holds each once.
        df = view.axioms(kind).select("canon", "p1", "p2", iri_hash(F.col("p1.iri")).alias("h1"), iri_hash(F.col("p2.iri")).alias("h2"), set_hash(annotation_hashes(F.col("ann"))).alias("notes"))
        hashed = role_axiom_hash(inverse, property_hash(F.col("p1"), F.col("h1")), property_hash(F.col("p2"), F.col("h2")), F.col("notes"))
        parts.append(df.select("canon", F.lit(inverse).alias("is_inverse"), named(F.col("p1")).alias("first"), named(F.col("p2")).alias("second"), hashed.alias("hash")))
    return parts[0].unionByName(parts[1])


def capacity(n: int) -> int:
    """Slots of a hash table of n entries: the least power of two, 16 at least, that they fill to three quarters."""
    return max(16, 1 << (-(-4 * n // 3) - 1).bit_length())


def visits(view: Ontology, first: int = 0) -> tuple[DataFrame, int]:
    """``visit, is_inverse, first, second`` in the order of the hash table (slot, spread hash, canonical bytes), and how
    many there are, on which slots depend."""
    axioms = role_axioms(view)
    n = axioms.count()  # without the hashes, which are not read here
    slot = F.col("spread").bitwiseAND(F.lit(capacity(n) - 1))
    hashed = axioms.select("is_inverse", "first", "second", "canon", spread(F.col("hash")).alias("spread")).withColumn("slot", slot)
    if not n:
        return hashed.select(F.lit(0).cast("long").alias("visit"), "is_inverse", "first", "second"), 0
    return numbered(hashed, ("slot", "spread", "canon"), "visit", first).select("visit", "is_inverse", "first", "second"), n


class RoleState:
    """What a series of role axioms leaves: pointers of sub-role axioms, the last axiom of each role, and inverses, as
    DataFrames that later calls add to."""

    def __init__(self, tables: dict[str, DataFrame] | None = None, visited: int = 0):
        self.tables = tables or {}
        self.visited = visited
        self._expansions: DataFrame | None = None

    def get(self, spark: SparkSession, name: str) -> DataFrame:
        return self.tables[name] if name in self.tables else spark.createDataFrame([], STATE[name])

    def visit(self, view: Ontology) -> int:
        """Takes a view's role axioms; returns how many had a chain and did nothing."""
        rows, n = visits(view, self.visited)
        return self.add(rows, n) if n else 0

    def add(self, rows: DataFrame, n: int) -> int:
        """Takes n ``rows`` as visits() gives them, numbered after all before."""
        spark = rows.sparkSession
        named = rows.where(F.col("first").isNotNull() & F.col("second").isNotNull())
        sub = named.where("NOT is_inverse")
        # What a role's list starts with at the time of an axiom: the last axiom before it that gave one. An axiom asks
        # before it gives.
        none = F.lit(None).cast("long")
        asks = sub.select(F.col("first").alias("relation"), "visit", F.lit(0).alias("turn"), none.alias("number"))
        gives = sub.select(F.col("second").alias("relation"), "visit", F.lit(1).alias("turn"), F.col("visit").alias("number"))
        known = self.get(spark, "last").select("relation", F.col("number").alias("visit"), F.lit(1).alias("turn"), "number")
        before = Window.partitionBy("relation").orderBy("visit", "turn").rowsBetween(Window.unboundedPreceding, -1)
        events = asks.unionByName(gives).unionByName(known).withColumn("before", F.last("number", ignorenulls=True).over(before))
        found = events.where("turn = 0").select(F.col("visit").alias("number"), F.col("relation").alias("sub"), "before")
        last = known.unionByName(gives).groupBy("relation").agg(F.max("number").alias("number"))
        both = lambda a, b, k: named.where("is_inverse").select(F.col(a).alias("relation"), F.col(b).alias("inverse"), (F.col("visit") * 2 + k).alias("at"))
        backs = self.get(spark, "inverses").withColumn("at", F.lit(-1).cast("long")).unionByName(both("first", "second", 0)).unionByName(both("second", "first", 1))
        inverses = backs.groupBy("relation").agg(F.max_by("inverse", "at").alias("inverse"))
        new = {"pointers": self.get(spark, "pointers").unionByName(found), "last": last, "inverses": inverses, "chains": rows.where(F.col("first").isNull() | F.col("second").isNull()).select("visit")}
        # One job for all: each row says of which table it is.
        chains = Observation()
        marked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("table", F.lit(k)) for k, df in new.items()))
        kept = durable(marked.observe(chains, F.count(F.when(F.col("table") == "chains", 1)).alias("n")))
        self.tables = {k: kept.where(F.col("table") == k).select(*new[k].columns) for k in STATE}
        self.visited += n
        self._expansions = None
        return chains.get["n"]

    def lists(self, spark: SparkSession) -> DataFrame:
        """``relation, pos, subrole`` of all lists. After k rounds all places below 2 ** k of each list are known: place
        p + 2 ** k is 2 ** k pointers on from place p."""
        pointers = self.get(spark, "pointers")
        # Places have a relation and pos, jumps have where they start; one join takes both as far again as jumps reach.
        none = lambda kind: F.lit(None).cast(kind)
        places = self.get(spark, "last").select("relation", F.lit(0).cast("long").alias("pos"), none("long").alias("start"), F.col("number").alias("node"))
        jumps = pointers.where("before IS NOT NULL").select(none("string").alias("relation"), none("long").alias("pos"), F.col("number").alias("start"), F.col("before").alias("node"))
        now, far = places.unionByName(jumps), 1
        while True:
            reach = now.where("start IS NOT NULL").select(F.col("start").alias("at"), F.col("node").alias("to"))
            then = now.join(reach, F.col("node") == F.col("at")).select("relation", (F.col("pos") + far).alias("pos"), "start", F.col("to").alias("node"))
            seen = Observation()
            now = durable(now.where("start IS NULL").unionByName(then).observe(seen, F.count("start").alias("jumps")))
            if not seen.get["jumps"]:
                return now.join(pointers, F.col("node") == F.col("number")).select("relation", F.col("pos").cast("int").alias("pos"), F.col("sub").alias("subrole"))
            far *= 2

    def inverses(self, spark: SparkSession) -> DataFrame:
        return self.get(spark, "inverses")

    def table(self, spark: SparkSession) -> DataFrame:
        """EXPANSIONS, made once for each state. A table of few bytes, which are counted, is sent to all tasks."""
        if self._expansions is None:
            if not self.tables:
                self._expansions = F.broadcast(spark.createDataFrame([], EXPANSIONS))
                return self._expansions
            emit = lambda e: F.lit(e).cast("int").alias("emit")
            below = self.lists(spark).select("relation", (F.col("pos") + 1).alias("emit"), F.col("subrole").alias("role"), F.lit(False).alias("swapped"))
            back = self.inverses(spark).select("relation", emit(LAST_EMIT), F.col("inverse").alias("role"), F.lit(True).alias("swapped"))
            own = self.get(spark, "last").select("relation").union(self.inverses(spark).select("relation")).distinct()
            own = own.select("relation", emit(0), F.col("relation").alias("role"), F.lit(False).alias("swapped"))
            made = durable(own.unionByName(below).unionByName(back))
            size = made.agg(F.sum(F.octet_length("relation") + F.octet_length("role") + 32)).first()[0] or 0
            self._expansions = F.broadcast(made) if size <= BROADCAST_BYTES else made
        return self._expansions

    def save(self, spark: SparkSession, path: str) -> None:
        for name in STATE:
            self.get(spark, name).write.mode("overwrite").parquet(f"{path}/{name}")
        spark.createDataFrame([(self.visited,)], "visited long").coalesce(1).write.mode("overwrite").parquet(f"{path}/visited")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RoleState:
        tables = {k: spark.read.schema(s).parquet(f"{path}/{k}") for k, s in STATE.items()}
        visited = spark.read.parquet(f"{path}/visited").first()[0]
        return cls(tables if visited else {}, visited)


def fold(view: Ontology, state: RoleState | None = None) -> tuple[RoleState, int]:
    """The state after a view's axioms, and how many had a chain. That of a view alone is found once for each view."""
    if state is None:
        if "roles" not in view.memo:
            alone = RoleState()
            view.memo["roles"] = alone, alone.visit(view)
        return view.memo["roles"]
    return state, state.visit(view)


def expand(base: DataFrame, roles: DataFrame) -> DataFrame:
    """``base(..., source, relation, destination)`` to the role's edge, one for each sub-role, and the inverse's
    with its ends swapped; ``emit`` numbers them. Roles without a list or an inverse keep their edge."""
    rest = [c for c in base.columns if c not in ("source", "relation", "destination", "emit")]
    s, d, back = F.col("source"), F.col("destination"), F.coalesce("swapped", F.lit(False))
    joined = base.drop("emit").join(roles, "relation", "left")
    return joined.select(
        *rest, F.coalesce("emit", F.lit(0)).alias("emit"), F.when(back, d).otherwise(s).alias("source"),
        F.coalesce("role", "relation").alias("relation"), F.when(back, s).otherwise(d).alias("destination"))
