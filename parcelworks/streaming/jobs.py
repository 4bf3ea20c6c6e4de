"""Job event logs: batch operators and their Structured Streaming forms."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from parcelworks.functions.numbers import clamp, lenient_double
from parcelworks.operators.ordering import previous_value
from parcelworks.session import scratch_dir

TERMINAL = ("completed", "failed", "cancelled")
METRICS = ("epoch", "train_loss", "val_loss", "val_miou", "val_boundary_f1", "val_pixel_accuracy", "lr", "seconds")


# ---- shared column logic ------------------------------------------------------------

def log_metrics(events: DataFrame, line: str = "line") -> DataFrame:
    """Metric rows from log lines: JSON from the first brace on, only with an ``epoch``.

    Unreadable JSON is a plain message and gives no row; unreadable numbers are 0.
    """
    start = F.instr(line, "{")
    payload = F.from_json(F.when(start > 0, F.expr(f"substring({line}, instr({line}, '{{'))")), "map<string,string>")
    parsed = events.withColumn("_m", payload).filter(F.map_contains_key("_m", "epoch"))
    return parsed.select(*[c for c in events.columns if c != line], *(lenient_double(F.col("_m")[name]).alias(name) for name in METRICS))


def progress_of(current: Column, total: Column) -> Column:
    return clamp(current / F.greatest(total, F.lit(1.0)), 0.0, 1.0)


def latest_state(events: DataFrame) -> DataFrame:
    """Newest event per job with its progress; works on batches and streams alike.

    ``max_by`` on one struct keeps constant state per job and combines before the shuffle,
    so a job with very many events costs no more than others.
    """
    newest = events.groupBy("job_id").agg(F.max_by(F.struct("seq", "status", "current", "total", "event_time"), "seq").alias("_e"))
    progress = F.when(F.col("_e.status") == "completed", 1.0).otherwise(progress_of(F.col("_e.current"), F.col("_e.total")))
    return newest.select("job_id", F.col("_e.seq").alias("seq"), F.col("_e.status").alias("status"), progress.alias("progress"), F.col("_e.event_time").alias("event_time"))


def final_state(events: DataFrame) -> DataFrame:
    """Status per job when the first terminal event absorbs everything after it (batch form)."""
    ended = F.col("status").isin(*TERMINAL)
    folded = events.groupBy("job_id").agg(
        F.min_by(F.struct("seq", "status"), F.when(ended, F.col("seq"))).alias("_end"),
        F.max_by(F.struct("seq", "status"), F.when(~ended, F.col("seq"))).alias("_open"),
        F.min(F.when(ended, F.col("seq"))).alias("_first"),
    )
    pick = F.when(F.col("_first").isNotNull(), F.col("_end")).otherwise(F.col("_open"))
    return folded.select("job_id", pick["status"].alias("status"), pick["seq"].alias("seq"))


def log_tail(events: DataFrame, keep: int | None = None) -> DataFrame:
    """Messages per job after dropping repeats of the previous message; only the last ``keep`` of a job if that is given.

    The rank filter is a per-key limit, which Spark applies before the shuffle, so a
    job with very many events sends at most ``keep`` rows per input partition.
    """
    changed = previous_value(events.select("job_id", "seq", "line"), "job_id", "seq", "line", "prev").filter(~F.col("prev").eqNullSafe(F.col("line")))
    if keep is None:
        return changed.select("job_id", "seq", "line")
    back = F.row_number().over(W.partitionBy("job_id").orderBy(F.col("seq").desc()))
    return changed.withColumn("back", back).filter(F.col("back") <= keep).select("job_id", "seq", "line")


def active_job_guard(datasets: DataFrame, jobs: DataFrame) -> DataFrame:
    """Datasets that may be cleared: no job of theirs is still open."""
    open_jobs = jobs.filter(~F.col("status").isin(*TERMINAL)).select("dataset_id").distinct()
    return datasets.join(open_jobs, "dataset_id", "left_anti")


def job_history(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.col("created").desc(), "job_id")


# ---- streams ------------------------------------------------------------------------

def read_events(spark: SparkSession, folder: str, schema, per_batch: int = 4) -> DataFrame:
    """The ``events`` files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", per_batch)
    return reader.parquet(folder)


def run_available(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Process what is there, into a table in the shared folder, and read it back.

    Batches are written with their id under the batch's own path: a retried batch
    overwrites itself. In update mode the newest row per job is the result.
    """
    spark = stream.sparkSession
    base = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    run = stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    written = spark.read.schema(schema).parquet(f"{base}/out")
    if mode == "append":
        return written.drop("batch")
    newest = written.groupBy("job_id").agg(F.max_by(F.struct(*[c for c in stream.columns if c != "job_id"]), "batch").alias("_r"))
    return newest.select("job_id", "_r.*")


def stream_job_state_machine(events: DataFrame) -> DataFrame:
    """Job states with absorbing terminal states as plain aggregates: the state of every job stays. See ``stream_job_states`` for timers.

    ``min_by`` and ``max_by`` do not depend on arrival order: the first terminal event wins, else the last open one by
    ``seq``. The state of a job is the two events; no Python runs per job.
    """
    return final_state(events.select("job_id", "seq", "status"))


STATE = "seq long, status string, current double, total double, event_time timestamp, end_seq long, end_status string, open_seq long, open_status string"
STATES = "job_id long, seq long, status string, current double, total double, event_time timestamp, final_status string, final_seq long"


def _fold(state: tuple, pdf) -> tuple:
    """The state of a job after more of its events, which may come in any order."""
    seq, status, current, total, event_time, end_seq, end_status, open_seq, open_status = state
    newest = pdf.loc[pdf["seq"].idxmax()]
    if seq is None or newest["seq"] >= seq:
        seq, status, current, total, event_time = int(newest["seq"]), newest["status"], float(newest["current"]), float(newest["total"]), newest["event_time"].to_pydatetime()
    ended = pdf[pdf["status"].isin(TERMINAL)]
    if len(ended):
        first = ended.loc[ended["seq"].idxmin()]
        if end_seq is None or first["seq"] < end_seq:
            end_seq, end_status = int(first["seq"]), first["status"]
    running = pdf[~pdf["status"].isin(TERMINAL)]
    if len(running):
        last = running.loc[running["seq"].idxmax()]
        if open_seq is None or last["seq"] >= open_seq:
            open_seq, open_status = int(last["seq"]), last["status"]
    return seq, status, current, total, event_time, end_seq, end_status, open_seq, open_status


def stream_job_states(events: DataFrame, delay: str = "1 day", keep_closed_ms: int = 3_600_000) -> DataFrame:
    """Newest event and final status of every job that had events, in update mode; closed jobs leave the state store.

    ``events``: job_id, seq, status, current, total, event_time. The first terminal event by ``seq`` wins, else the last open one, whatever the
    order of arrival. A closed job stays for ``keep_closed_ms`` of event time, so that late events are still absorbed, and is then
    removed by its timer; what comes for a closed job behind the watermark is ignored. An open job is kept: its end is still to come.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    columns = [c.split()[0] for c in STATES.split(", ")]

    def run(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        mark = state.getCurrentWatermarkMs()
        known = state.getOption or (None,) * 9
        for pdf in pdfs:
            if known[0] is None or known[5] is not None:  # new or closed: what is older than the watermark came too late
                pdf = pdf[pdf["event_time"] >= pd.Timestamp(mark, unit="ms")]
            if len(pdf):
                known = _fold(known, pdf)
        if known[0] is None:
            return
        state.update(known)
        seq, status, current, total, event_time, end_seq, end_status, open_seq, open_status = known
        if end_seq is not None:
            last = int(pd.Timestamp(event_time).timestamp() * 1000)
            state.setTimeoutTimestamp(max(last, mark) + keep_closed_ms)
        final = (end_status, end_seq) if end_seq is not None else (open_status, open_seq)
        yield pd.DataFrame([(key[0], seq, status, current, total, event_time, *final)], columns=columns)

    timed = events.select(F.col("job_id").cast("long").alias("job_id"), F.col("seq").cast("long").alias("seq"), "status", F.col("current").cast("double").alias("current"), F.col("total").cast("double").alias("total"), "event_time")
    return timed.withWatermark("event_time", delay).groupBy("job_id").applyInPandasWithState(run, STATES, STATE, "update", GroupStateTimeout.EventTimeTimeout)
