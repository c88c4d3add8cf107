"""Tasks and their hash-chained audit events: append, verify, current state, transitions, recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64
#: Which status may follow which.
TRANSITIONS = {"created": ("running", "cancelled"), "running": ("running", "succeeded", "failed", "interrupted", "cancelled"), "failed": ("running", "cancelled"), "interrupted": ("running", "cancelled"), "succeeded": (), "cancelled": ()}
FIELDS = ("actor_id", "created_at", "event_type", "payload_json", "previous_event_hash", "sequence", "stage", "task_id")


def canonical(columns: dict[str, Column]) -> Column:
    """JSON with sorted keys, no spaces, and nulls kept."""
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]), {"ignoreNullFields": "false"})


def _hash(event: Column, previous: Column) -> Column:
    fields = {k: event[k] for k in FIELDS if k != "previous_event_hash"} | {"previous_event_hash": previous}
    return F.sha2(canonical(fields), 256)


def chained(events: DataFrame) -> DataFrame:
    """events(task_id, sequence, event_type, stage, actor_id, created_at, payload_json) with previous_event_hash and event_hash.

    A chain is sequential within a task and independent between tasks: a task's events are folded in one array.
    """
    keys = [k for k in FIELDS if k != "previous_event_hash"]
    rows = events.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("sequence", *[k for k in keys if k != "sequence"]))).alias("events"))
    start = F.array().cast("array<string>")
    hashes = F.aggregate("events", start, lambda acc, e: F.concat(acc, F.array(_hash(e, F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(GENESIS))))))
    rows = rows.select(F.explode(F.arrays_zip(F.col("events"), hashes.alias("hashes"), F.concat(F.array(F.lit(GENESIS)), hashes).alias("previous"))).alias("z"))
    return rows.where(F.col("z.events").isNotNull()).select(*[F.col(f"z.events.{k}").alias(k) for k in keys], F.col("z.previous").alias("previous_event_hash"), F.col("z.hashes").alias("event_hash"))


def verified(chain: DataFrame) -> DataFrame:
    """Per task: events, and whether every hash, link and sequence number is right."""
    order = Window.partitionBy("task_id").orderBy("sequence")
    rows = chain.select("*", F.lag("event_hash", 1, GENESIS).over(order).alias("_link"), F.row_number().over(order).alias("_place"))
    fields = {k: F.col(k) for k in FIELDS}
    right = (F.sha2(canonical(fields), 256) == F.col("event_hash")) & (F.col("previous_event_hash") == F.col("_link")) & (F.col("sequence") == F.col("_place"))
    return rows.groupBy("task_id").agg(F.count("*").alias("events"), F.bool_and(F.coalesce(right, F.lit(False))).alias("valid"), F.min(F.when(~right, F.col("sequence"))).alias("first_bad"))


def status_of(event_type: Column) -> Column:
    """Stand-in for driver events: a status for each type of event."""
    return F.when(event_type == "signup", "created").when(event_type == "view", "running").when(event_type == "click", "running").when(event_type == "purchase", "succeeded").when(event_type == "error", "failed")


def transitions(steps: DataFrame) -> DataFrame:
    """steps(task_id, sequence, status) with the status before and whether the step is allowed."""
    order = Window.partitionBy("task_id").orderBy("sequence")
    allowed = {a: b for a, b in TRANSITIONS.items()}
    before = F.lag("status").over(order)
    ok = F.when(F.col("from_status").isNull(), F.col("status") == "created")
    for a, b in allowed.items():
        ok = ok.when(F.col("from_status") == a, F.col("status").isin(*b) if b else F.lit(False))
    return steps.withColumn("from_status", before).withColumn("allowed", F.coalesce(ok.otherwise(False), F.lit(False)))


def state(steps: DataFrame) -> DataFrame:
    """Per task: its status, how often it began to run, and its last sequence number."""
    moved = transitions(steps)
    starts = (F.col("status") == "running") & ~F.col("from_status").eqNullSafe(F.lit("running"))
    return moved.groupBy("task_id").agg(F.max_by("status", "sequence").alias("status"), F.count_if(starts).alias("attempt_count"), F.max("sequence").alias("last_sequence"))


def recovered(states: DataFrame) -> DataFrame:
    """Tasks that were running when a service ended, as interrupted."""
    return states.where("status = 'running'").select("task_id", F.lit("interrupted").alias("status"), "attempt_count", (F.col("last_sequence") + 1).alias("sequence"), F.lit("task_interrupted").alias("event_type"))


def created_once(requests: DataFrame) -> DataFrame:
    """requests(task_id, fingerprint, context): created the first time, existing if repeated alike, conflict if not."""
    grouped = requests.groupBy("task_id").agg(F.count("*").alias("requests"), F.count_distinct(F.struct(F.coalesce("fingerprint", F.lit("")), F.coalesce("context", F.lit("")))).alias("kinds"))
    return grouped.select("task_id", "requests", F.when(F.col("kinds") > 1, "conflict").when(F.col("requests") > 1, "existing").otherwise("created").alias("outcome"))


def visible(tasks: DataFrame, actor_id: str) -> DataFrame:
    """A task is seen by the actor that created it alone."""
    return tasks.where(F.col("actor_id") == actor_id)


def by_status(states: DataFrame, created: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """Tasks in one of the statuses, numbered by when they were created(task_id, created_at)."""
    order = Window.partitionBy("status").orderBy("created_at", "task_id")
    found = states.where(F.col("status").isin(*statuses)).join(created.groupBy("task_id").agg(F.min("created_at").alias("created_at")), "task_id")
    return found.withColumn("place", F.row_number().over(order))


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, which a table of tasks or events must not have."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
