"""The role fold as a stateful stream: what each role last got is in the state store, by role, and nothing in the driver.

A batch of numbered role axioms (visits) becomes pointers as they are defined in operators.roles: what an axiom's sub-role
had before it. The state is one number and one inverse for each role, so it does not grow with the axioms of a role. A
restarted query goes on from its checkpoint; a batch that is run again finds the state as it was before. Visits of one
role have to come in order over batches: one that lies behind what its role has seen would change pointers that are out,
and is an error. Inside a batch any order will do; a role's rows of one batch are sorted in its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..errors import IncompatibleSource
from ..operators.roles import RoleState

CHANGES = "kind string, relation string, number long, before long, inverse string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: An axiom asks for what its sub-role has before it gives to its upper role.
ASKS, GIVES, BACK = 0, 1, 2


class RoleProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "number long")
        self.seen = handle.getValueState("seen", "visit long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        relation = key[0]
        own = pd.concat(list(rows)).sort_values(["visit", "turn"])
        first, end = int(own["visit"].iloc[0]), int(own["visit"].iloc[-1])
        if self.seen.exists() and first <= self.seen.get()[0]:
            raise IncompatibleSource(f"visit {first} of {relation} comes after visit {self.seen.get()[0]}", relation=relation)
        last = self.last.get()[0] if self.last.exists() else None
        out, gave, inverse = [], False, None
        for visit, turn, other in zip(own["visit"].tolist(), own["turn"].tolist(), own["other"].tolist(), strict=True):
            if turn == ASKS:
                out.append(("pointer", relation, visit, last, None))
            elif turn == GIVES:
                last, gave = visit, True
            else:
                inverse = ("inverse", relation, visit, None, other)
        if gave:
            out.append(("last", relation, last, None, None))
            self.last.update((last,))
        if inverse:
            out.append(inverse)
        self.seen.update((end,))
        frame = pd.DataFrame(out, columns=["kind", "relation", "number", "before", "inverse"])
        yield frame.astype({"number": "Int64", "before": "Int64"})

    def close(self) -> None:
        pass


def role_changes(visits: DataFrame) -> DataFrame:
    """CHANGES of a streaming table ``visit, is_inverse, first, second``; its session uses PROVIDER for its state."""
    event = lambda relation, turn, other: F.struct(relation.alias("relation"), F.lit(turn).alias("turn"), other.alias("other"))
    a, b, none = F.col("first"), F.col("second"), F.lit(None).cast("string")
    both = F.when(F.col("is_inverse"), F.array(event(a, BACK, b), event(b, BACK + 1, a))).otherwise(F.array(event(a, ASKS, none), event(b, GIVES, none)))
    events = visits.where(a.isNotNull() & b.isNotNull()).select("visit", F.explode(both).alias("e")).select("visit", "e.*")
    return events.groupBy("relation").transformWithStateInPandas(RoleProcessor(), CHANGES, "Append", "None")


def state_of(changes: DataFrame) -> RoleState:
    """The role state that a table of CHANGES amounts to."""
    of = lambda kind: changes.where(F.col("kind") == kind)
    tables = {
        "pointers": of("pointer").select("number", F.col("relation").alias("sub"), "before"),
        "last": of("last").groupBy("relation").agg(F.max("number").alias("number")),
        "inverses": of("inverse").groupBy("relation").agg(F.max_by("inverse", "number").alias("inverse")),
    }
    seen = changes.agg(F.max("number")).first()[0]
    return RoleState(tables if seen is not None else {}, 0 if seen is None else seen + 1)
