"""Intermediate tables in the folder that driver and executors share, global orders, and the places of rows in them."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

PLACE = (1 << 33) - 1
#: Bytes of rows behind one draw, and bytes that a range of an order by bytes is to have.
DRAW_BYTES, RANGE_BYTES = 256 << 10, 32 << 20
#: Ranges at most, unless spark.sql.shuffle.partitions is more; beyond, they grow.
MOST_RANGES = 4096
#: A bound between ranges is cut to the first of these lengths that tells it from the draw before.
BOUND_LENGTHS = (64, 512, 4096)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where none is set, a session that is all on this machine gets a temporary
    one; on a cluster that is an error, since executors do not see each other's disks."""
    context = spark.sparkContext
    got = context._jsc.sc().getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", None) or (got.get() if got.isDefined() else None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir is not set: it names the folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="ontoloom-")
    if got.isEmpty():
        context.setCheckpointDir(found)
    return found


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there: its rows and partitions stay as they are when executors
    are lost. Spark deletes the files with the last reference where ``spark.cleaner.referenceTracking.cleanCheckpoints``
    is set."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def numbered(df: DataFrame, keys: tuple[str, ...], to: str, first: int = 0) -> DataFrame:
    """``df`` with the place of each row in the order of ``keys``, from ``first`` on: its place inside a range partition,
    behind all that the partitions before hold. The partitions are kept durably between counting them and numbering
    them; the driver sees one number for each."""
    row = F.monotonically_increasing_id()
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = durable(ordered.withColumns({"_part": F.spark_partition_id(), "_place": row.bitwiseAND(F.lit(PLACE))}))
    rows = []
    for part, n in sorted(tuple(r) for r in placed.groupBy("_part").count().collect()):
        rows.append((part, first))
        first += n
    starts = df.sparkSession.createDataFrame(rows, "_part int, _first long")
    return placed.join(F.broadcast(starts), "_part").withColumn(to, F.col("_first") + F.col("_place")).drop("_part", "_place", "_first")


def in_order(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``df`` in the order of ``keys``, in ranges of about as many bytes each. An ``orderBy`` deals by rows, so that long
    rows which stand together share few of its ranges. Rows are drawn by their bytes; what is little is ordered by
    ``orderBy``. Rows whose keys agree in their first 4096 characters share a range."""
    drawn = draws(df, keys)
    count = drawn.count()
    ranges = min(count * DRAW_BYTES // RANGE_BYTES, max(MOST_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return df.orderBy(*keys) if ranges < 2 else dealt(df, keys, bounds(drawn, keys, count, ranges)).sortWithinPartitions(*keys)


def cut(row: Column, df: DataFrame, keys: tuple[str, ...], length: int) -> Column:
    """A struct of the keys in ``row``, of long ones the beginning: it is the same or less in their order."""
    return F.struct(*(F.substring(row[k], 1, length).alias(k) if is_long(df, k) else row[k].alias(k) for k in keys))


def is_long(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (StringType, BinaryType))


def draws(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The keys, cut, of rows drawn by their bytes, one for each DRAW_BYTES; kept durably."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in df.columns if is_long(df, c)), F.lit(16 * len(df.columns)))
    times = F.floor(size / DRAW_BYTES + F.rand(len(keys))).cast("int")
    own = df.select(cut(F.struct(*keys), df, keys, BOUND_LENGTHS[-1]).alias("key"), times.alias("times")).where("times > 0")
    return durable(own.select(F.explode(F.array_repeat("key", F.col("times"))).alias("key")).select("key.*"))


def bounds(drawn: DataFrame, keys: tuple[str, ...], count: int, ranges: int) -> DataFrame:
    """One row, ``bounds``: the keys, in order, that ranges of about as many draws begin with."""
    step = count // ranges
    placed = numbered(drawn, keys, "_draw").select(F.col("_draw"), F.struct(*keys).alias("key"))
    # Each draw that begins a range, with the one before.
    pairs = placed.where((F.col("_draw") + 1) % step < 2).groupBy(F.floor((F.col("_draw") + 1) / step).alias("range")).agg(F.min("key").alias("before"), F.max("key").alias("key"), F.count("*").alias("n"))
    short = [cut(F.col("key"), drawn, keys, n) for n in BOUND_LENGTHS]
    bound = F.coalesce(*(F.when(s > F.col("before"), s) for s in short[:-1]), short[-1])
    return durable(pairs.where("n = 2").agg(F.sort_array(F.collect_set(bound)).alias("bounds")))


def dealt(df: DataFrame, keys: tuple[str, ...], begins: DataFrame) -> DataFrame:
    """``df`` with a partition for each range: binary search for how many bounds are not above a row, a column for each
    step, over a broadcast of one row."""
    n = begins.select(F.size("bounds")).first()[0]
    found = df.crossJoin(F.broadcast(begins.select(F.col("bounds").alias("_bounds")))).withColumns({"_key": F.struct(*keys), "_range": F.lit(0)})
    for step in (1 << i for i in reversed(range(n.bit_length()))):
        fits = F.get("_bounds", F.col("_range") + F.lit(step - 1)) <= F.col("_key")
        found = found.withColumn("_range", F.col("_range") + F.when(fits, step).otherwise(0))
    return found.select(*df.columns, "_range").repartitionById(n + 1, F.col("_range")).drop("_range")
