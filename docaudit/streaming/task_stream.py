"""Tasks as a stream: each event moves its task's state, which survives restarts in the state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.audit import TRANSITIONS

OUTPUT = StructType([StructField("task_id", LongType()), StructField("status", StringType()), StructField("attempt_count", LongType()), StructField("last_sequence", LongType())])
_STATE = StructType([StructField("status", StringType()), StructField("attempt_count", LongType()), StructField("last_sequence", LongType())])


class Tasks(StatefulProcessor):
    """Takes (task_id, sequence, status) and gives the state after each batch; strict leaves out moves that are not allowed."""

    def __init__(self, strict: bool = False):
        self.strict = strict

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.task = handle.getValueState("task", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, attempts, last = self.task.get() if self.task.exists() else (None, 0, 0)
        for row in pd.concat(rows).sort_values("sequence").itertuples():
            if self.strict and row.status not in (TRANSITIONS[status] if status else ("created",)):
                continue
            attempts += row.status == "running" and status != "running"
            status, last = row.status, int(row.sequence)
        if status is not None:
            self.task.update((status, int(attempts), int(last)))
            yield pd.DataFrame({"task_id": [key[0]], "status": [status], "attempt_count": [int(attempts)], "last_sequence": [int(last)]})

    def close(self) -> None:
        pass


def task_states(steps: DataFrame, strict: bool = False) -> DataFrame:
    """The changes of task states of a stream of steps(task_id, sequence, status); the session needs the RocksDB state store."""
    return steps.groupBy("task_id").transformWithStateInPandas(Tasks(strict), OUTPUT, "Update", "None")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def states_of_table(steps: DataFrame) -> DataFrame:
    """Runs a stream over a table of steps to its end and returns each task's last state.

    Input, state and output lie in the folder of spark.checkpoint.dir; without one, a folder of this machine serves a local
    session alone, as executors elsewhere would not see it.
    """
    import tempfile
    import uuid

    spark = steps.sparkSession
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="docaudit-")
    folder = f"{base.rstrip('/')}/tasks-{uuid.uuid4().hex}"
    steps.write.parquet(f"{folder}/in")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        stream = spark.readStream.schema(steps.schema).parquet(f"{folder}/in")
        run = task_states(stream).writeStream.foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")).outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
    from pyspark.sql import functions as F

    changes = spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out")
    return changes.groupBy("task_id").agg(F.max_by(F.struct("status", "attempt_count", "last_sequence"), "last_sequence").alias("s")).select("task_id", "s.*")
