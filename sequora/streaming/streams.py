"""Structured Streaming operators: windows, capped accumulation, journals."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import shared_folder


def scratch(spark: SparkSession) -> str:
    """A fresh folder under the shared checkpoint folder (see ``session.shared_folder``)."""
    return os.path.join(shared_folder(spark), f"stream-{uuid.uuid4().hex}")


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The Parquet files at ``path`` as a stream, with the columns of a batch read."""
    batch = spark.read.parquet(path)
    parent, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", files_per_trigger)
    if [f.rpartition("/")[2] for f in batch.inputFiles()] == [name]:  # a file: its folder, this name only
        return reader.option("pathGlobFilter", name).parquet(parent)
    return reader.parquet(path)


def tumbling(stream: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by window; a window is emitted once the watermark has passed it."""
    stream = stream.withColumn(time, F.col(time).cast("timestamp"))  # a watermark needs a zoned time
    return stream.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count(F.lit(1)).alias("n"))


def capped_reads(stream: DataFrame, key: str, time: str, item: str, most: int = 10) -> DataFrame:
    """(key, item, at): the first ``most`` items of each key in order of arrival.

    State per key is one counter, so it is bounded whatever a key receives. Within a
    micro-batch arrival is by time, then item.
    """

    def step(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        best: list[tuple] = []
        for part in parts:  # no more than the cap is kept of a batch either
            best = sorted(best + list(zip(part[time], part[item], strict=True)))[: max(most - seen, 0)]
        state.update((seen + len(best),))
        yield pd.DataFrame({key: [keys[0]] * len(best), item: [b[1] for b in best], "at": [b[0] for b in best]})

    schema = stream.schema
    out = f"{key} {schema[key].dataType.simpleString()}, {item} {schema[item].dataType.simpleString()}, at {schema[time].dataType.simpleString()}"
    return stream.select(key, time, item).groupBy(key).applyInPandasWithState(step, out, "seen int", "append", GroupStateTimeout.NoTimeout)


class _Completion(StatefulProcessor):
    """State of a file: the pieces seen (a key each), how many, and since when; a timer ends what stays open."""

    def __init__(self, key: str, piece: str, time: str, need: str, wait_ms: int):
        self.key, self.piece, self.time, self.need, self.wait_ms = key, piece, time, need, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "piece long", "at timestamp")
        self.count = handle.getValueState("count", "pieces long, reads long, needed long, first timestamp, last timestamp")
        self.ended = handle.getValueState("ended", "done boolean")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        if self.ended.exists():
            return
        pieces, reads, needed, first, last = self.count.get() if self.count.exists() else (0, 0, None, None, None)
        if last is not None and self._ms(last) + self.wait_ms <= timerValues.getCurrentWatermarkInMs():
            yield self._closed(key[0], pieces, reads, "expired", last)  # its timer is due in this batch too
            return
        done = None
        for part in rows:
            for piece, at, need in sorted(zip(part[self.piece].tolist(), [t.to_pydatetime() for t in part[self.time]], part[self.need].tolist(), strict=True), key=lambda r: (r[1], r[0])):
                reads, needed = reads + 1, int(need)
                first, last = min(first or at, at), max(last or at, at)
                if not self.seen.containsKey((int(piece),)):
                    self.seen.updateValue((int(piece),), (at,))
                    pieces += 1
                if pieces >= needed and done is None:
                    done = (pieces, reads, at)
        if done:
            yield self._closed(key[0], *done[:2], "complete", done[2])
            return
        self.count.update((pieces, reads, needed, first, last))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(self._ms(last) + self.wait_ms)

    @staticmethod
    def _ms(at) -> int:
        return int(pd.Timestamp(at).tz_localize("UTC").timestamp() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        if self.ended.exists() or not self.count.exists():
            return
        pieces, reads, _, _, last = self.count.get()
        yield self._closed(key[0], pieces, reads, "expired", last)

    def _closed(self, key, pieces: int, reads: int, outcome: str, at) -> pd.DataFrame:
        """The one row of a file; of its state only the mark that it has ended stays."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.seen.clear()
        self.count.clear()
        self.ended.update((True,))
        return pd.DataFrame({self.key: [key], "pieces": [pieces], "reads": [reads], "outcome": [outcome], "at": [pd.Timestamp(at)]})

    def close(self) -> None:
        pass


def completion(stream: DataFrame, key: str, piece: str, time: str, need: str, wait: str = "1 hour", late: str = "0 seconds") -> DataFrame:
    """(key, pieces, reads, outcome, at): one row a file, when ``need`` distinct pieces of it are there.

    A file that stays open ``wait`` after its last piece, by the watermark, is given up as
    ``expired``. State is a map of the pieces seen, a counter row and a timer; all are cleared at
    the end but for one flag, so later pieces of a closed file give no second row. Pieces of a
    micro-batch count in order of time. State and timers are checkpointed, so a restarted query
    goes on where it was. Needs the RocksDB state store, which this sets.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = stream.select(key, F.col(piece).cast("long").alias(piece), F.col(time).cast("timestamp").alias(time), F.col(need).cast("long").alias(need)).withWatermark(time, late)
    wait_ms = int(pd.Timedelta(wait).total_seconds() * 1000)
    schema = f"{key} {stream.schema[key].dataType.simpleString()}, pieces long, reads long, outcome string, at timestamp"
    return rows.groupBy(key).transformWithStateInPandas(_Completion(key, piece, time, need, wait_ms), schema, "Append", "EventTime")


def drain(result: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there into Parquet and read that."""
    spark = result.sparkSession
    path = scratch(spark)
    q = result.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{path}/log").option("path", f"{path}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{path}/out")


class Journal:
    """A log-structured key table: batches append, reads take the newest entry, compaction folds.

    Each generation is a written folder, so a reader never sees half a compaction.
    """

    def __init__(self, spark: SparkSession, keys: list[str], order: list[str], deleted: str):
        self.spark, self.keys, self.order, self.deleted = spark, keys, order, deleted
        self.base, self.parts = scratch(spark), []

    def append(self, batch: DataFrame, epoch: int) -> None:
        """Idempotent by epoch, as foreachBatch may repeat one."""
        path = f"{self.base}/e{epoch}"
        batch.write.mode("overwrite").parquet(path)
        if path not in self.parts:
            self.parts.append(path)

    def entries(self) -> DataFrame:
        return self.spark.read.parquet(*self.parts)

    def latest(self) -> DataFrame:
        rest = [c for c in self.entries().columns if c not in self.keys]
        newest = F.max_by(F.struct(*rest), F.struct(*self.order))
        rows = self.entries().groupBy(*self.keys).agg(newest.alias("r")).select(*self.keys, "r.*")
        return rows.where(~F.col(self.deleted))

    def compact(self) -> None:
        path = f"{self.base}/c{uuid.uuid4().hex}"
        self.latest().write.parquet(path)
        self.parts = [path]
