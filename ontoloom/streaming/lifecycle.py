"""Role state over a series of projections: each call folds its role axioms into the state that earlier calls left."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IncompatibleSource
from ..operators.roles import RoleState, fold
from ..options import Options
from ..plans.projection import projected
from ..sources.views import Ontology


def replay(views: Iterable[Ontology], options: Options | None = None) -> Iterator[DataFrame]:
    state = RoleState()
    for view in views:
        fold(view, state)
        yield projected(view, options, state.table(view.spark))


def replay_states(views: Iterable[tuple[int, Ontology]]) -> DataFrame:
    """``invocation, relation, pos, subrole, inverse`` after each call; pos is null where there is no sub-role."""
    state, out = RoleState(), None
    for number, view in views:
        fold(view, state)
        df = state.lists(view.spark).join(state.inverses(view.spark), "relation", "full").select(F.lit(number).alias("invocation"), "relation", "inverse", "pos", "subrole")
        out = df if out is None else out.unionByName(df)
    return out


def stored(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def stream_edges(stream: DataFrame, path: str, checkpoint: str, view_of, options: Options | None = None):
    """A streaming table of axioms whose batches are calls. Each batch's edges are written under its number, and beside
    them the role state of all batches up to it, from which the next one goes on. So a restarted query goes on where it
    was, and a batch that is run again starts from the state that it had before and replaces what it wrote. A batch
    whose predecessor's state is gone is an error. The state stays in tables; the driver holds none of it."""

    def state_path(number: int) -> str:
        return f"{path}/_role_state/batch={number}"

    def batch(rows: DataFrame, number: int) -> None:
        spark, view = rows.sparkSession, view_of(rows)
        if number and not stored(spark, f"{state_path(number - 1)}/visited/_SUCCESS"):
            raise IncompatibleSource(f"the role state of batch {number - 1} is gone", batch=number)
        state = fold(view, RoleState.load(spark, state_path(number - 1)) if number else RoleState())[0]
        projected(view, options, state.table(spark)).write.mode("overwrite").parquet(f"{path}/batch={number}")
        state.save(spark, state_path(number))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
