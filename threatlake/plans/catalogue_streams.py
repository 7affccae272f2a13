"""The registered queries, part 4: streaming jobs drained over the whole events file."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatlake.config import DEFAULT
from threatlake.functions.scalars import ratio
from threatlake.operators import features
from threatlake.operators.features import ip_share
from threatlake.plans import training
from threatlake.plans.derived import Derived
from threatlake.plans.registry import query
from threatlake.session import materialise, shared_dir
from threatlake.sources import events_adapter, model_store
from threatlake.streaming import late, pipeline, sources


#: An hour after the first possible flow.
_MIDDLE = 1704067200000000 + 3_600_000_000


def drain(stream: DataFrame, keys: list[str] | None = None, complete: bool = False) -> DataFrame:
    """Run a stream until its input is used up; results go to a table in the shared folder.

    A micro-batch that is retried overwrites its own folder, so every row is kept once. With ``keys``
    the stream is one of updates: micro-batches write what they changed and the last row of a key counts.
    With ``complete`` each micro-batch writes the whole result over the one before, what is still open too.
    """
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    if keys:
        sources.changed_rows(stream, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
        return sources.read_changed(spark, f"{path}/rows", stream.schema, keys)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={0 if complete else batch_id}")

    job = stream.writeStream.foreachBatch(write).outputMode("complete" if complete else "append").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows").select(*stream.columns)


def _stream(d: Derived, compress: bool = True) -> DataFrame:
    """Flows with the events file read as a stream."""
    schema = d.spark.read.parquet(f"{d.dir}/events.parquet").schema
    # written as a pattern: the file source takes a single file only through one
    return events_adapter.from_events(d.spark.readStream.schema(schema).parquet(f"{d.dir}/events.parque[t]"), compress)


def _scored(d: Derived) -> DataFrame:
    shares = ip_share(d.flows, d.cfg).select("source_ip", "ip_share").distinct()
    return pipeline.score(_stream(d), shares)


@query
def g2_stream_scores(d: Derived):
    return drain(_scored(d).select("log_id", "source_ip", "combined", "risk_level", "stage"))


@query
def g2_stream_releases(d: Derived):
    """A stream that starts with one release of the models and goes on with the next: rows scored by each, and whether a batch scores them alike."""
    names, path = features.DETECT7, f"{shared_dir(d.spark)}/releases-{uuid.uuid4().hex}"
    rows = materialise(features.detect7(d.flows, d.cfg).select("log_id", "ts", F.col("is_attack").cast("int").alias("label"), *names), "features")
    middle = F.timestamp_micros(F.lit(_MIDDLE))
    for n, part in enumerate((rows.where(F.col("ts") < middle), rows.where(F.col("ts") >= middle))):
        training.save(training.train(rows, names, "log_id", seed=42 + n, trees=20, steps=4), f"{path}/models")
        part.write.mode("append").parquet(f"{path}/rows")
        stream = d.spark.readStream.schema(rows.schema).parquet(f"{path}/rows")
        training.score_stream(stream, f"{path}/models", f"{path}/scores", f"{path}/checkpoint", ["log_id"]).awaitTermination()
    found = d.spark.read.parquet(f"{path}/scores").select("log_id", "release", "combined_score")
    for version in (1, 2):
        again = training.score_release(rows, model_store.load_release(d.spark, f"{path}/models", version)).select("log_id", "release", F.col("combined_score").alias(f"again_{version}"))
        found = found.join(again, ["log_id", "release"], "left")
    alike = F.abs(F.coalesce("again_1", "again_2") - F.col("combined_score")) < 1e-9
    return found.groupBy("release").agg(F.count("*").alias("rows"), F.bool_and(alike).alias("alike"), F.min(F.col("combined_score").between(0, 1)).alias("in_range"))


@query
def g3_stream_decisions(d: Derived):
    return drain(pipeline.decide(_scored(d), d.cfg))


@query
def g4_stream_windows(d: Derived):
    return drain(pipeline.window_activity(_scored(d), cfg=d.cfg), ["window_start"])


@query
def g4_stream_quality(d: Derived):
    """Windows of true and false positives, misses and latency from four streams of three micro-batches each."""
    parts = (_replayed(d, d.validations.select("executed_at", "success"), "executed_at"), _replayed(d, d.feedback.select("created_at", "was_false_positive"), "created_at"),
             _replayed(d, d.shadow.select("timestamp", "would_have_taken_action"), "timestamp"), _replayed(d, d.actions.select("executed_at", "execution_time_ms"), "executed_at"))
    found = drain(pipeline.window_quality(pipeline.quality_events(*parts, cfg=d.cfg), d.cfg), ["window_start"])
    return found.select("window_start", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1_score", "false_positive_rate", "avg_latency_ms")])


def _replayed(d: Derived, df: DataFrame, ts: str) -> DataFrame:
    """A derived table as a stream of three micro-batches; ``ts`` is its event time."""
    made = df.withColumn("ts", F.col(ts)) if ts != "ts" else df
    return sources.replay_table(made, f"{shared_dir(d.spark)}/replay-{uuid.uuid4().hex}")


@query
def g5_stream_validation(d: Derived):
    """What followed each action for sixty seconds, of actions that the watermark has left behind."""
    actions = _replayed(d, d.actions.select("action_id", "target_ip", "executed_at"), "executed_at")
    scores = _replayed(d, d.scores.select("log_id", "source_ip", "ts", "combined"), "ts")
    parts = drain(pipeline.scores_after(actions, scores, cfg=d.cfg))
    whole = parts.groupBy("action_id").agg(F.count(F.lit(1)).alias("parts")).where("parts = 2").select("action_id")
    found = pipeline.combine_parts(parts.join(whole, "action_id"))
    return found.select("action_id", "n_after", F.round(ratio(F.col("units_after") / F.lit(1e12), "n_after"), 6).alias("mean_after"), F.round("max_after", 6).alias("max_after"))


@query
def g6_stream_approvals(d: Derived):
    queue = _replayed(d, d.approvals.join(d.threats.select("log_id", "created_at"), "log_id").select("log_id", "created_at", "expires_at"), "created_at")
    reviews = _replayed(d, d.reviews.select("log_id", "reviewed_at", "approved"), "reviewed_at")
    return drain(pipeline.approval_outcomes(queue, reviews, d.cfg))


@query
def g6_stream_rollback(d: Derived):
    actions = _replayed(d, d.actions.select("action_id", "target_ip", "action_type", "executed_at"), "executed_at")
    scores = _replayed(d, d.scores.select("log_id", "source_ip", "ts", "combined"), "ts")
    return drain(pipeline.auto_rollback(actions, scores, d.cfg)).withColumn("recent_mean", F.round("recent_mean", 6))


@query
def g7_activity_spans(d: Derived):
    """All spans, those too that are still open when the input ends."""
    stream = _stream(d, compress=False)
    pipeline.lists_in_state(stream)  # the state of all spans is held on disk
    return drain(pipeline.activity_spans(stream, cfg=d.cfg), complete=True)


@query
def g8_stream_first_blocks(d: Derived):
    actions = _scored(d).where("risk_level = 'CRITICAL'").select("ts", F.col("log_id").alias("action_id"), F.col("source_ip").alias("target_ip"), F.lit("BLOCK").alias("action_type"))
    return drain(pipeline.first_blocks(actions))


@query
def g10_sliding_activity(d: Derived):
    return drain(pipeline.window_activity(_scored(d), "5 minutes", "1 minute", d.cfg), ["window_start"])


def _split(d: Derived) -> tuple[str, DataFrame]:
    """Scores that arrive when their flow ends, in periods of twenty minutes, split by a watermark of five seconds."""
    rows = d.scores.select("log_id", "source_ip", "ts", "combined", "risk_level", F.timestamp_micros(F.unix_micros("ts") + F.round(F.col("duration_seconds") * 1_000_000).cast("bigint")).alias("ended"))
    path = f"{shared_dir(d.spark)}/split-{uuid.uuid4().hex}"
    stream = sources.replay_periods(rows, f"{path}/arrived", "ended", 20)
    late.split_late(stream, path, f"{path}/checkpoint", cfg=_LATE).awaitTermination()
    return path, stream


_LATE = replace(DEFAULT, watermark_seconds=5)


@query
def g11_late_rows(d: Derived):
    path, stream = _split(d)
    return late.late_rows(d.spark, path, stream.schema).select("log_id", "source_ip", "ts")


@query
def g11_reconciled_windows(d: Derived):
    """Windows of the rows in time, as a stream makes them, with the late rows added."""
    path, stream = _split(d)
    windows = drain(pipeline.window_activity(late.in_time(d.spark, path, stream.schema), cfg=_LATE), ["window_start"])
    return late.reconcile(windows, late.late_rows(d.spark, path, stream.schema))
