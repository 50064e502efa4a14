"""Streams with state and timers: hash chains and sequences checked against epochs, in order of event time.

Rows wait in their key's state until the watermark has passed them; a timer for the first of them wakes the key, and all that
is due by then is taken in order of time and id. So the result is that of a batch over the same rows, however the stream cuts them. Rows behind
the watermark are dropped by Spark, and drained() tells how many. State of a key is its last hash (or epoch and sequence)
and the rows that wait, which the watermark bounds.

Null keys, times and ids take no part. Repeated rows are rows of their own. An empty stream gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.streaming.events import chain_hash
from tessera.tables import shared_folder

WAITING = "us long, id long, what string, epoch long, seq long"


class InOrder(StatefulProcessor):
    """Rows of a key in order of time and id, once the watermark has passed them; what is made of each is up to take()."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.last = handle.getValueState("last", "hash string, epoch long, seq long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        plain = lambda x: None if pd.isna(x) else x if isinstance(x, str) else int(x)
        own = [tuple(map(plain, r)) for pdf in rows for r in pdf[["us", "id", "what", "epoch", "seq"]].itertuples(index=False, name=None)]
        if own:
            self.waiting.appendList(own)
            self.wake(own)
        return iter([])

    def wake(self, rows: list[tuple]) -> None:
        """A timer for the first of rows; timers go off when the watermark is later, so it is set a millisecond earlier."""
        self.handle.registerTimer(-(-min(r[0] for r in rows) // 1000) - 1)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = list(self.waiting.get())
        due = sorted((r for r in rows if r[0] <= now), key=lambda r: (r[0], r[1]))
        if not due:
            return
        later = [r for r in rows if r[0] > now]
        if later:
            self.waiting.put(later)
            self.wake(later)
        else:
            self.waiting.clear()
        state = tuple(self.last.get()) if self.last.exists() else ("", None, None)
        out = []
        for r in due:
            state, made = self.take(state, r)
            out.append((key[0], r[1], *made))
        self.last.update(state)
        yield pd.DataFrame(out, columns=["key", "id", *self.NAMES])

    def close(self) -> None:
        pass


class Chained(InOrder):
    """Links each row to the one before by hash."""

    NAMES = ("previous_hash", "event_hash")

    @staticmethod
    def take(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        own = chain_hash(state[0], row[1], row[2])
        return (own, None, None), (state[0], own)


class Sequenced(InOrder):
    """Accepts rows whose epoch is not behind and whose sequence goes up within it; others are told why not."""

    NAMES = ("accepted", "reason")

    @staticmethod
    def take(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        _, epoch, seq = state
        if epoch is not None and row[3] < epoch:
            return state, (False, "STALE_EPOCH")
        if epoch is not None and row[3] == epoch and row[4] <= seq:
            return state, (False, "STALE_SEQUENCE")
        return ("", row[3], row[4]), (True, None)


def in_order(stream: DataFrame, processor: InOrder, key: str, time: str, id_: str, what: str | None = None, epoch: str | None = None, seq: str | None = None, delay: str = "1 hour") -> DataFrame:
    """A stream of key, id and what the processor makes of each row of stream."""
    col = lambda c, kind: (F.col(c) if c else F.lit(None)).cast(kind)
    rows = stream.filter(F.col(key).isNotNull() & F.col(time).isNotNull() & F.col(id_).isNotNull()).withWatermark(time, delay)
    rows = rows.select(F.col(key).cast("long").alias("key"), F.col(time).alias("at"), F.unix_micros(time).alias("us"), col(id_, "long").alias("id"), col(what, "string").alias("what"), col(epoch, "long").alias("epoch"), col(seq, "long").alias("seq"))
    kinds = {"accepted": T.BooleanType()}
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("id", T.LongType()), *(T.StructField(n, kinds.get(n, T.StringType())) for n in processor.NAMES)])
    return rows.groupBy("key").transformWithStateInPandas(processor, schema, "Append", "EventTime")


def drained(stream: DataFrame, feeds: Iterable[Callable[[], None]] = ()) -> tuple[DataFrame, int]:
    """All that a stream gives for the rows there now, and how many rows its watermark dropped.

    feeds bring more rows: each is called when the stream has taken what was there, and the stream goes on from its checkpoint.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stateful-{uuid.uuid4().hex}"
    name, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, store)
    try:

        def put(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/rows/batch-{number}")

        def run() -> int:
            q = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination()
            return sum(s.numRowsDroppedByWatermark for p in q.recentProgress for s in p.stateOperators)

        dropped = run()
        for feed in feeds:
            feed()
            dropped += run()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/rows"), dropped
