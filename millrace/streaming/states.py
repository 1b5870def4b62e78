"""State over streams: the last review of each candidate, and pushes whose log is written once for each batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.files import pushed
from .changes import shared_folder

#: What an action makes of a candidate.
STATUS = {"approve": "approved", "reject": "rejected", "correct": "corrected"}


@contextmanager
def state_store(spark: SparkSession):
    """The state store that transformWithState needs, for the queries that start inside; the session's own setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def review_states(items: DataFrame, key: str = "candidate_id", seq: str = "seq", action: str = "action") -> DataFrame:
    """Review items of a stream as changes of state: key, seq, status, a row for each candidate whose status a batch moves on.

    The item of the greatest seq counts. An item that comes late or again, with a seq that isn't above the state's, changes nothing;
    nor do unknown actions and items without key or seq. A candidate's state is one row.
    """
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    class LastReview(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.last = handle.getValueState("last", "seq long")

        def handleInputRows(self, k, rows, timers) -> Iterator[pd.DataFrame]:
            seen = self.last.get()[0] if self.last.exists() else None
            best = None
            for pdf in rows:
                at = pdf["seq"].idxmax()
                if best is None or pdf["seq"][at] > best[0]:
                    best = (int(pdf["seq"][at]), pdf["status"][at])
            if best is not None and (seen is None or best[0] > seen):
                self.last.update((best[0],))
                yield pd.DataFrame({"key": [k[0]], "seq": [best[0]], "status": [best[1]]})

        def close(self) -> None:
            pass

    status = F.coalesce(*[F.when(F.col(action) == a, s) for a, s in STATUS.items()])
    known = items.select(F.col(key).cast("long").alias("key"), F.col(seq).cast("long").alias("seq"), status.alias("status")).where("key is not null and seq is not null and status is not null")
    moved = known.groupBy("key").transformWithStateInPandas(LastReview(), "key long, seq long, status string", "Update", "None")
    return moved.select(F.col("key").alias(key), F.col("seq").alias(seq), "status")


def keep_batch(folder: str, work: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: what `work` makes of a batch, written under the batch's number; a batch that is replayed replaces its rows."""
    def keep(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{folder}/log/batch={number}")

    return keep


def drain(stream: DataFrame, work: Callable[[DataFrame], DataFrame] = lambda batch: batch, folder: str | None = None, mode: str = "append") -> DataFrame:
    """All that waits in a stream, batch by batch through `work` to a log, which is returned (with its column batch); run again in the same folder it goes on."""
    spark = stream.sparkSession
    folder = folder or f"{shared_folder(spark)}/drain-{uuid.uuid4()}"
    with state_store(spark):
        run = stream.writeStream.outputMode(mode).foreachBatch(keep_batch(folder, work)).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.parquet(f"{folder}/log")


def latest(log: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """The last state of each key in a log of changes."""
    fields = [c for c in log.columns if c not in (key, "batch")]
    return log.groupBy(key).agg(F.max_by(F.struct(*fields), seq).alias("_l")).select(key, "_l.*")


def push(stream: DataFrame, send: Callable[[Iterator[str]], Iterator[tuple[bool, str]]], key: str = "id", folder: str | None = None) -> DataFrame:
    """Sends the payloads (key, payload) of a stream and keeps the attempts: key, ok, response, batch; a batch sent again has one attempt in the log.

    What is marked as synced is what the log says succeeded (`upserts.marked_synced`), so that a failed row waits for the next run.
    """
    return drain(stream, lambda batch: pushed(batch, send, key), folder)
