"""Structured Streaming forms: view requests against a static tree, and frame telemetry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from volmesh.operators.lod import scores


def scored_requests(requests: DataFrame, nodes: DataFrame, ranges: DataFrame, limits: DataFrame) -> DataFrame:
    """view_id, node_key, is_leaf, score for a stream of views; the tree's tables are static."""
    return scores(requests, nodes, ranges, limits)


def run_requests(requests: DataFrame, nodes: DataFrame, ranges: DataFrame, limits: DataFrame, out: str, checkpoint: str):
    """Answers each micro-batch of requests: of several for a view, the one of the highest seq counts."""

    def answer(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("view_id").agg(F.max_by(F.struct(*(c for c in batch.columns if c != "view_id")), "seq").alias("r")).select("view_id", "r.*")
        scores(latest, nodes, ranges, limits).withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    return requests.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def frame_stream(metrics: DataFrame, delay: str = "10 minutes", quiet_minutes: int = 60) -> DataFrame:
    """run_id, frame_num, metric, value from a stream of writes (ts, run_id, frame_num, metric, value, seq): one row for
    each, the write of the highest seq, once the watermark has been past its newest write for so long."""
    quiet = quiet_minutes * 60_000

    def last(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            _, value, _ = state.get
            state.remove()
            yield pd.DataFrame([(*key, value)], columns=["run_id", "frame_num", "metric", "value"])
            return
        seq, value, newest = state.get if state.exists else (None, None, 0)
        for rows in batches:
            top = rows.loc[rows["seq"].idxmax()]
            if seq is None or top["seq"] > seq:
                seq, value = int(top["seq"]), float(top["value"])
            newest = max(newest, int(rows["ts"].max().timestamp() * 1000))
        state.update((seq, value, newest))
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + quiet)

    keyed = metrics.withWatermark("ts", delay).groupBy("run_id", "frame_num", "metric")
    return keyed.applyInPandasWithState(last, "run_id long, frame_num long, metric string, value double", "seq long, value double, newest long", "append", GroupStateTimeout.EventTimeTimeout)
