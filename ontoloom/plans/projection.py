"""From a view and options to ordered edges: union of the rules, duplicate policy, order, counts, diagnostics."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..errors import ResourceLimit
from ..operators import roles as R
from ..operators import rules as P
from ..options import Options
from ..sources.views import Ontology
from ..storage import PLACE, durable, in_order

EDGE = ("source", "relation", "destination")


def categories(view: Ontology, options: Options, roles: DataFrame | None = None) -> Iterator[DataFrame]:
    """Edges with their encounter key by category, in the order of categories. Each is planned when it is asked for, and
    only then what it alone needs is looked for: the role box, numbers of anonymous individuals, assertions to refuse.
    Flags choose branches; branches that are off are not in the plan."""
    state = lambda: roles if roles is not None else R.fold(view)[0].table(view.spark)

    def blanks() -> DataFrame | None:
        if "blanks" not in view.memo:
            found = P.anonymous(view)
            view.memo["blanks"] = None if found is None else P.blank_ids(found)
        return view.memo["blanks"]

    yield P.named_subclasses(view, options.bidirectional_taxonomy) if options.only_taxonomy else P.subclass_edges(view, options, state())
    yield P.equivalent_edges(view, options, None if options.only_taxonomy else state())
    if options.include_literals:
        yield P.annotation_edges(view, blanks())
    yield P.class_assertion_edges(view)
    P.refuse_assertions(view)
    yield P.object_assertion_edges(view, blanks())
    yield P.domain_range_edges(view, state())


def raw_edges(view: Ontology, options: Options | None = None, roles: DataFrame | None = None) -> DataFrame:
    """All edges with their encounter key."""
    P.refuse_kinds(view)
    return reduce(DataFrame.unionByName, categories(view, options or Options(), roles))


def encountered(view: Ontology, options: Options, roles: DataFrame | None = None) -> Iterator[DataFrame]:
    """The edges of a projection in encounter order as one ordered DataFrame after the other: those of a category are
    there before what later ones need is read."""
    P.refuse_kinds(view)
    for part in categories(view, options, roles):
        yield arranged(part, P.KEY, options.include_literals).select(*EDGE)


def arranged(edges: DataFrame, keys: tuple[str, ...], texts: bool) -> DataFrame:
    """In the order of ``keys``; by bytes where there may be ``texts``, as those of one subject stand together."""
    return in_order(edges, keys) if texts else edges.orderBy(*keys)


def with_policy(edges: DataFrame, duplicates: str = "preserve", order: str = "canonical", texts: bool = False) -> DataFrame:
    """(source, relation, destination) in order. The first of equal edges stands for all under ``unique``, found by
    an aggregation that combines before the shuffle."""
    if order == "canonical":
        out = edges.select(*EDGE)
        return arranged(out.distinct() if duplicates == "unique" else out, EDGE, texts)
    return arranged(firsts(edges) if duplicates == "unique" else edges, P.KEY, texts).select(*EDGE)


def firsts(edges: DataFrame) -> DataFrame:
    """The first of equal edges by encounter."""
    return edges.groupBy(*EDGE).agg(F.min(F.struct(*P.KEY)).alias("key")).select(*EDGE, "key.*")


def projected(view: Ontology, options: Options | None = None, roles: DataFrame | None = None, max_edges: int | None = None) -> DataFrame:
    options = options or Options()
    found = raw_edges(view, options, roles)
    if max_edges is not None:
        found = limited(found, max_edges)
    return with_policy(found, options.duplicates, options.order, options.include_literals)


TOO_MANY = "more edges than max_edges"


def limited(edges: DataFrame, most: int) -> DataFrame:
    """``edges``, if there are ``most`` at most, else ResourceLimit. They are made once: a task that has more of its own
    fails the job, the job counts them as it keeps them durably, and what follows reads the kept ones."""
    seen = Observation()
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(PLACE))
    guarded = edges.withColumn("_place", place).where(F.when(F.col("_place") >= most, F.raise_error(F.lit(TOO_MANY)).cast("string")).isNull()).drop("_place")
    try:
        kept = durable(guarded.observe(seen, F.count(F.lit(1)).alias("n")))
    except PySparkException as e:
        if TOO_MANY in str(e):
            raise ResourceLimit(f"more than {most} edges", max_total_edges=most, seen=most + 1) from e
        raise
    if (n := seen.get["n"]) > most:
        raise ResourceLimit(f"more than {most} edges", max_total_edges=most, seen=n)
    return kept


def taxonomy(view: Ontology, bidirectional: bool = False, duplicates: str = "preserve", order: str = "canonical") -> DataFrame:
    """Asserted subclass axioms between named classes alone."""
    return with_policy(P.named_subclasses(view, bidirectional), duplicates, order)


def edge_counts(edges: DataFrame) -> DataFrame:
    """One row: edges, distinct, duplicates. Exact, by one shuffle of distinct edges with their counts."""
    per = edges.groupBy(*EDGE).agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("raw_edges"), F.count("*").alias("distinct_edges")).withColumn("duplicate_edges", F.col("raw_edges") - F.col("distinct_edges"))


def edge_counter(edges: DataFrame) -> DataFrame:
    return edges.groupBy(*EDGE).agg(F.count("*").alias("count"))


def bag_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Edges whose multiplicity differs, with both; one aggregation over the union of both bags."""
    both = left.select(*EDGE, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(*EDGE, F.lit(0).alias("l"), F.lit(1).alias("r")))
    return both.groupBy(*EDGE).agg(F.sum("l").alias("left_count"), F.sum("r").alias("right_count")).where("left_count <> right_count")


# Codes and messages of diagnostics.
IGNORED = ("MOWL_IGNORED_SHAPE", "constructor does not emit an edge in the pinned profile", "info")
SKIPPED = ("MOWL_SKIPPED_AXIOM", "axiom category is not visited by the pinned profile", "info")
RENDERED = ("MOWL_NON_STRING_LITERAL_RENDERING", "pinned mOWL rendering preserves malformed datatype syntax", "warning")


def faults(view: Ontology, options: Options) -> DataFrame:
    """``kind`` of diagnostic and ``constructor``: a row for each axiom or operand without effect, each axiom that is not
    visited, each literal that is rendered oddly. Every kind of axiom is gone through once."""
    ignored = [P.subclass_ignored(view, options), P.equivalent_ignored(view, options), P.class_assertion_ignored(view), P.domain_range_ignored(view)]
    chained = view.axioms("ObjectPropertyAssertion").where(F.col("p1.iri").isNull() | F.coalesce(F.col("p1.chain"), F.lit(False)))
    ignored.append(chained.select(F.lit("ObjectPropertyAssertion").alias("constructor")))
    parts = [p.select(F.lit("ignored").alias("kind"), "constructor") for p in ignored]
    parts.append(P.skipped(view).select(F.lit("skipped").alias("kind"), "constructor"))
    if options.include_literals:
        literal = F.col("fault") == "literal"
        parts.append(P.annotation_faults(view).select(F.col("fault").alias("kind"), F.when(literal, "Literal").otherwise("AnnotationAssertion").alias("constructor")))
    return reduce(DataFrame.unionByName, parts)


def ignored(view: Ontology, options: Options) -> DataFrame:
    return faults(view, options).where("kind = 'ignored'").select("constructor")


def diagnostics(view: Ontology, options: Options | None = None) -> DataFrame:
    """Grouped: code, message, severity, constructor, count."""
    found = faults(view, options or Options()).groupBy("kind", "constructor").agg(F.count("*").alias("count"))
    said = found.select(F.when(F.col("kind") == "ignored", said_as(IGNORED)).when(F.col("kind") == "skipped", said_as(SKIPPED)).otherwise(said_as(RENDERED)).alias("d"), "constructor", "count")
    return said.select("d.*", "constructor", "count")


def said_as(diagnostic: tuple[str, str, str]) -> Column:
    return F.struct(*(F.lit(x).alias(n) for n, x in zip(("code", "message", "severity"), diagnostic, strict=True)))


def warning_count(found: DataFrame) -> DataFrame:
    return found.agg(F.coalesce(F.sum(F.when(F.col("severity") == "warning", F.col("count"))), F.lit(0)).cast("long").alias("warnings"))
