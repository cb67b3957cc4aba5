"""Structured Streaming jobs.

Every sink writes one folder per micro-batch and overwrites it when the batch is
run again, so a restart from the checkpoint leaves no duplicates.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from .. import fixed_values as fv
from ..operators import redact, weights
from ..sources.events import split_events


def _start(stream: DataFrame, write, checkpoint: str, trigger: dict, mode: str = "append") -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def _batch_dir(path: str, batch_id: int) -> str:
    return f"{path}/batch_id={batch_id}"


def route_events(parsed: DataFrame, valid: str, rejected: str, checkpoint: str, *, trigger=None) -> StreamingQuery:
    """Valid events to one table, rejected ones with their reason to another."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        good, bad = split_events(batch)
        good.write.mode("overwrite").parquet(_batch_dir(valid, batch_id))
        bad.write.mode("overwrite").parquet(_batch_dir(rejected, batch_id))
        batch.unpersist()

    return _start(parsed, write, checkpoint, trigger or {"availableNow": True})


def fold_weights(
    events: DataFrame, rules: DataFrame, path: str, checkpoint: str, *, alpha=fv.LEARNING_RATE, trigger=None
) -> StreamingQuery:
    """Move rule weights by each micro-batch of events; one table version per batch.

    Within a batch events count in (ts, id) order, batches in the order of
    arrival; an event that comes late moves the weight when it comes. The events
    of a batch are folded like a batch table, so a hot rule spreads over all
    tasks; the state carried on is one row per rule. ``rules`` is read anew at every
    batch: a rule that was added meanwhile starts with its own weight. A rule that
    is in no table is kept as not ``known``, with the weight of its last event.
    """
    columns = ["rule_id", "current_weight", "known"]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        table = rules.select("rule_id", "current_weight", F.lit(True).alias("known"))
        start, strange = table, None
        if batch_id and _exists(spark, _batch_dir(path, batch_id - 1)):
            before = spark.read.parquet(_batch_dir(path, batch_id - 1))
            carried = before.where("known")
            start = carried.unionByName(table.join(carried, "rule_id", "left_anti"))
            strange = before.where("NOT known").join(table, "rule_id", "left_anti")
        out = weights.fold_weights(batch, start, alpha=alpha).select(*columns)
        new = weights.unknown_rule_weights(batch, start, alpha=alpha).select(
            "rule_id", F.col("weight").alias("current_weight"), F.lit(False).alias("known")
        )
        if strange is not None:
            new = new.unionByName(strange.join(new, "rule_id", "left_anti").select(*columns))
        out.unionByName(new).write.mode("overwrite").parquet(_batch_dir(path, batch_id))

    return _start(events, write, checkpoint, trigger or {"availableNow": True})


_STATE = "units bigint, known boolean, n bigint"
_STATE_ROWS = "rule_id string, current_weight double, known boolean, n_events bigint, idle boolean"


def weight_states(
    events: DataFrame, rules: DataFrame, *, alpha=fv.LEARNING_RATE, idle: str = "1 day", late: str = "10 minutes", forget: bool = False
) -> DataFrame:
    """A stream of weights with one keyed state per rule, for update mode: what every batch moved.

    A rule's state starts with its weight in ``rules``; one that is in no table restarts at the
    default with every batch's last event, and is not ``known``. Events of a batch count in
    (ts, id) order, batches in order of arrival. All events of a rule in a batch are folded by
    one task: for rules that take a large share of all events there is ``fold_weights``.
    A rule without events for ``idle``, by the time of all events less ``late``, is written out
    once more, marked ``idle``. With ``forget`` its state goes then; its next event starts
    from the table again, which must have taken the idle row by that time.
    """
    low, high, base = (int(round(float(w) * weights.UNIT)) for w in (fv.MIN_WEIGHT, fv.MAX_WEIGHT, fv.DEFAULT_WEIGHT))
    start = rules.select("rule_id", weights.to_units(F.col("current_weight")).alias("start"))
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    slim = timed.select("rule_id", "ts", "id", weights.delta_units(F.col("event_type"), alpha).alias("delta"))
    millis = int(pd.Timedelta(idle).total_seconds() * 1000)

    def fold(key, batches, state):
        if state.hasTimedOut:
            units, known, n = state.get
            if forget:
                state.remove()
            yield row(key, units, known, n, True)
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        first = rows["start"].dropna()
        units, known, n = state.get if state.exists else (int(first.iloc[0]) if len(first) else base, bool(len(first)), 0)
        if known:
            for delta in rows["delta"].tolist():
                units = min(high, max(low, units + delta))
        else:
            units = min(high, max(low, base + int(rows["delta"].iloc[-1])))
        state.update((units, known, n + len(rows)))
        newest = int(rows["ts"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + millis)
        yield row(key, units, known, n + len(rows), False)

    def row(key, units, known, n, is_idle):
        return pd.DataFrame({
            "rule_id": [key[0]], "current_weight": [units / weights.UNIT], "known": [known], "n_events": [n], "idle": [is_idle],
        })

    return slim.join(start, "rule_id", "left").groupBy("rule_id").applyInPandasWithState(
        fold, _STATE_ROWS, _STATE, "update", GroupStateTimeout.EventTimeTimeout
    )


def latest_states(spark: SparkSession, path: str) -> DataFrame:
    """Of every rule the last row that ``write_batches`` has of it."""
    rows = spark.read.parquet(path)
    last = F.max_by(F.struct("current_weight", "known", "n_events", "idle"), F.struct("batch_id", "idle"))
    return rows.groupBy("rule_id").agg(last.alias("_r")).select("rule_id", "_r.*")


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _latest(spark: SparkSession, path: str, before: int) -> DataFrame | None:
    """The newest version older than batch ``before``; for readers, the job itself knows its last batch."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    ids = [int(n.split("=")[1]) for n in names if n.startswith("batch_id=")]
    older = [i for i in ids if i < before]
    return spark.read.parquet(_batch_dir(path, max(older))) if older else None


def latest_weights(spark: SparkSession, path: str) -> DataFrame | None:
    return _latest(spark, path, 1 << 62)


def event_counts(events: DataFrame, width: str = "1 day", *, late: str = "10 minutes") -> DataFrame:
    """Events per window and type; repeated ids and rows later than ``late`` drop out.

    Write it in update mode and read it with ``latest_counts``: a window is then there
    from its first event on, also one that nothing closes any more.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))  # zone-less times are taken as session time
    return (
        timed.withWatermark("ts", late)
        .dropDuplicatesWithinWatermark(["id"])
        .groupBy(F.window("ts", width), "event_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("window_start"), "event_type", "n")
    )


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    """The last count that was written of every window and type."""
    rows = spark.read.parquet(path)
    return rows.groupBy("window_start", "event_type").agg(F.max_by("n", "batch_id").alias("n"))


def inspect_payloads(payloads: DataFrame, *, text_col="text") -> DataFrame:
    """The batch inspection, unchanged, on a stream."""
    return redact.inspect(payloads, text_col=text_col)


def write_batches(stream: DataFrame, path: str, checkpoint: str, *, partition: str | None = None, mode="append", trigger=None) -> StreamingQuery:
    """Append the rows of a stream, for instance sessions, to a table."""
    def write(batch: DataFrame, batch_id: int) -> None:
        out = batch.write.mode("overwrite")
        if partition:
            out = out.partitionBy(partition)
        out.parquet(_batch_dir(path, batch_id))

    return _start(stream, write, checkpoint, trigger or {"availableNow": True}, mode)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch_id")
