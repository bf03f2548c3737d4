"""Continuous forms of batch operators.

The batch jobs stay the reference; these keep the same results up to date as files or
facts arrive.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import MAX_FILE_BYTES


def file_arrivals(spark, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Stream of new files with bytes; oversized ones arrive without content."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = (spark.readStream.format("binaryFile").schema(schema)
              .option("maxFilesPerTrigger", files_per_trigger).load(folder))
    return stream.withColumn("content", F.when(F.col("length") <= MAX_FILE_BYTES, F.col("content")))


def first_notes(notes: DataFrame, arrival: str = "arrived_at", delay: str = "1 day") -> DataFrame:
    """Drop repeats of a note id seen within the watermark; state is bounded by the delay."""
    return notes.withWatermark(arrival, delay).dropDuplicatesWithinWatermark(["note_id"])


def outbox_stream(pending: DataFrame, write, checkpoint: str, **trigger):
    """Deliver pending vector records batch by batch.

    A batch that is retried after a failure sends the same records again, so ``write``
    must upsert by note id; that makes delivery effectively once.
    """
    def deliver(batch: DataFrame, batch_id: int):
        write(batch.dropDuplicates(["note_id"]), batch_id)
    return (pending.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


class _LatestFact(StatefulProcessor):
    """Per key only the latest event time and the number of facts are kept."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._peak = handle.getValueState("peak", "at timestamp")

    def handleInputRows(self, key, rows, timer_values):
        peak = self._peak.get()[0] if self._peak.exists() else None
        frames = pd.concat(list(rows)).sort_values(["arrival", "fact_id"], kind="stable")
        actions = []
        for at in frames["event_time"]:
            later = peak is not None and at > pd.Timestamp(peak)
            actions.append("update" if later else "add")
            peak = at if peak is None or later else peak
        self._peak.update((pd.Timestamp(peak).to_pydatetime(),))
        yield pd.DataFrame({"fact_key": frames["fact_key"], "fact_id": frames["fact_id"], "action": actions})

    def close(self) -> None:
        pass


def guard_late_facts(facts: DataFrame) -> DataFrame:
    """``(fact_key, fact_id, action)`` for a stream of ``(fact_key, fact_id, arrival, event_time)``.

    A fact that is not later than everything seen for its key is added, never an update.
    Needs the RocksDB state store provider.
    """
    return facts.groupBy("fact_key").transformWithStateInPandas(
        _LatestFact(), outputStructType="fact_key string, fact_id long, action string", outputMode="Append", timeMode="None")
