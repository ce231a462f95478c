"""Streams with state by key: the last row of each key, and an online cover of each group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.kernels import jaccard_matrix
from ..sources.buckets import BucketTable

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _with_state_store(spark: SparkSession) -> None:
    """State with several variables needs the RocksDB store; a session's own choice is left alone."""
    if not spark._jsparkSession.sessionState().conf().contains(PROVIDER):
        spark.conf.set(PROVIDER, ROCKS)


class LastRow(StatefulProcessor):
    """Keeps of each key the row of the greatest ``order``; a batch yields the keys' rows that changed.

    The state store is asked once a key, and told once if the row changed: each is a round trip to the JVM.
    """

    def __init__(self, schema: T.StructType, order: str):
        self.schema, self.order = schema, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.schema)
        self.at, self.row = self.schema.names.index(self.order), Row(*self.schema.names)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.last.get()  # None if there is none
        at, best = self.at, held
        for row in rows:
            if best is None or (row[at] is not None and (best[at] is None or row[at] > best[at])):
                best = row
        if best is not held and tuple(best) != held:
            self.last.update(tuple(best))
            yield self.row(*best)

    def close(self) -> None:
        pass


def last_rows(arriving: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A stream of the rows that become their key's last."""
    _with_state_store(arriving.sparkSession)
    return arriving.groupBy(*keys).transformWithState(LastRow(arriving.schema, order), arriving.schema, outputMode="Update", timeMode="None")


class OnlineCover(StatefulProcessor):
    """Keeps the representatives of a group: an item of a signature becomes one unless one of them is at least so similar."""

    def __init__(self, least_jaccard: float):
        self.least = least_jaccard

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.chosen = handle.getListState("chosen", "accession string, signature binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = [(a, bytes(s)) for a, s in self.chosen.get()] if self.chosen.exists() else []
        ids = [a for a, _ in held]
        stack = [np.frombuffer(s, "<u2") for _, s in held]
        for item in sorted(rows, key=lambda r: r.accession):
            own = np.frombuffer(bytes(item.signature), "<u2")
            j = jaccard_matrix(own[None, :], np.stack(stack))[0] if stack else np.zeros(0)
            if item.accession in ids:
                at, best = ids.index(item.accession), 1.0
            elif len(j) and j.max() >= self.least:
                at, best = int(j.argmax()), float(j.max())
            else:
                at, best = len(ids), 1.0
                ids.append(item.accession)
                stack.append(own)
                self.chosen.appendValue((item.accession, bytes(item.signature)))
            yield Row(grp=item.grp, accession=item.accession, representative=ids[at], jaccard=best, is_representative=ids[at] == item.accession)

    def close(self) -> None:
        pass


def online_cover(sketches: DataFrame, least_jaccard: float) -> DataFrame:
    """(grp, accession, representative, jaccard, is_representative) for a stream of ``sketches(grp, accession, signature)``.

    State is the representatives of each group, not its items; a batch's items are taken in order of accession.
    """
    _with_state_store(sketches.sparkSession)
    made = "grp string, accession string, representative string, jaccard double, is_representative boolean"
    return sketches.select("grp", "accession", "signature").groupBy("grp").transformWithState(OnlineCover(least_jaccard), made, outputMode="Update", timeMode="None")


def upserted(changes: DataFrame, table: BucketTable, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Brings a stream of changed rows into a table: a batch writes the buckets of its rows, and one that runs again changes nothing."""
    return changes.writeStream.outputMode("update").foreachBatch(lambda batch, _: table.upsert(batch, keys) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
