"""Operators on unbounded tables: stateless steps, windowed summaries, drift per micro-batch."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.functions.columns import as_list, name, require
from quarry.operators.integrity import drift_check
from quarry.operators.stats import parse_agg

_COMBINABLE = {"mean": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "std": F.stddev_samp, "var": F.var_samp}


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", files_per_trigger: int = 1) -> DataFrame:
    return (spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger)
            .parquet(folder))


def windowed_groupby(stream: DataFrame, time: str, window: str, keys: str | Sequence[str] = (), agg: str | Sequence[tuple[str, str]] | None = None,
                     slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Group sizes or aggregates per event-time window; state older than ``late`` is dropped.

    Only aggregates that combine partial results are offered, so the state is one row per group.
    """
    by = as_list(keys)
    require(stream, time, *by)
    pairs = parse_agg(agg) if agg else []
    unknown = [f for _, f in pairs if f not in _COMBINABLE]
    if unknown:
        raise ValueError(f"not available on a stream: {', '.join(unknown)}")
    aggs = [_COMBINABLE[f](name(c)).alias(f"{c}_{f}") for c, f in pairs] or [F.count(F.lit(1)).alias("counts")]
    if isinstance(stream.schema[time].dataType, T.TimestampNTZType):  # watermarks need instants
        stream = stream.withColumn(time, name(time).cast("timestamp"))
    span = F.window(name(time), window, slide) if slide else F.window(name(time), window)
    grouped = stream.withWatermark(time, late).groupBy(span.alias("window"), *map(name, by)).agg(*aggs)
    return grouped.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                          *map(name, by), *[name(f"{c}_{f}") for c, f in pairs] or [F.col("counts")])


def write_stream(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Run until all present input is read and append the result as Parquet, exactly once."""
    out = transform(stream) if transform else stream
    return (out.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _per_batch(stream: DataFrame, path: str, checkpoint: str, made: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Write what ``made`` makes of every micro-batch to a folder of its own, so that a batch run again overwrites itself."""
    def write(batch: DataFrame, number: int) -> None:
        made(batch).write.mode("overwrite").parquet(f"{path}/batch_id={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_lookup(stream: DataFrame, path: str, checkpoint: str, load: Callable[[], DataFrame], step: Callable[[DataFrame, DataFrame], DataFrame]) -> StreamingQuery:
    """Run ``step`` on every micro-batch and the lookup table as it is at that time.

    ``load`` is called once a batch, so a table that was replaced meanwhile (``versions.read_current``) takes effect with the
    next batch; within one batch all rows see the same table. Results carry the number of their batch as ``batch_id``.
    """
    return _per_batch(stream, path, checkpoint, lambda batch: step(batch, load()))


def first_seen(stream: DataFrame, keys: str | Sequence[str], time: str, late: str = "1 hour") -> DataFrame:
    """The first row of every key; a key that has not been met for ``late`` is forgotten, with its state."""
    by = as_list(keys)
    require(stream, time, *by)
    if isinstance(stream.schema[time].dataType, T.TimestampNTZType):
        stream = stream.withColumn(time, name(time).cast("timestamp"))
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(by)


def bursts(stream: DataFrame, key: str, time: str, gap_seconds: float, late: str = "1 hour") -> DataFrame:
    """(key, started, ended, n) of runs of a key's rows no more than ``gap_seconds`` apart, each given once it is over.

    A keyed state holds the open runs as pairs of ends and a count; rows may come in any order within ``late``, and two runs
    that a late row brings together become one. A run ends when the watermark has passed its last row by the gap, and a key
    without open runs keeps no state.
    """
    require(stream, key, time)
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.select(name(key).alias("key"), name(time).cast("timestamp").alias("at")).filter("key IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)

    def merge(runs: list[list]) -> list[list]:
        merged: list[list] = []
        for start, end, n in sorted(runs):
            if merged and start - merged[-1][1] <= gap_seconds * 1000:
                merged[-1] = [merged[-1][0], max(merged[-1][1], end), merged[-1][2] + n]
            else:
                merged.append([start, end, n])
        return merged

    def step(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        runs = json.loads(state.get[0]) if state.exists else []
        for pdf in batches:
            millis = pdf["at"].astype("datetime64[ms]").astype("int64")
            runs += [[int(t), int(t), 1] for t in millis]
        runs = merge(runs)
        mark = state.getCurrentWatermarkMs()
        over = [r for r in runs if r[1] + gap_seconds * 1000 < mark]
        left = [r for r in runs if r[1] + gap_seconds * 1000 >= mark]
        if left:
            state.update((json.dumps(left),))
            state.setTimeoutTimestamp(int(max(mark + 1, left[0][1] + gap_seconds * 1000 + 1)))
        elif state.exists:
            state.remove()
        if over:
            yield pd.DataFrame({"key": [own[0]] * len(over), "started": pd.to_datetime([r[0] for r in over], unit="ms"), "ended": pd.to_datetime([r[1] for r in over], unit="ms"),
                                "n": [r[2] for r in over]})

    return rows.groupBy("key").applyInPandasWithState(step, f"key {kind}, started timestamp, ended timestamp, n long", "runs string", "append", GroupStateTimeout.EventTimeTimeout)


def drift_per_batch(stream: DataFrame, baseline: DataFrame, path: str, checkpoint: str, threshold: float = 0.05) -> StreamingQuery:
    """Compare every micro-batch with a baseline; one folder of verdicts per batch, so a replay overwrites its own."""
    return _per_batch(stream, path, checkpoint, lambda batch: drift_check(batch, baseline, threshold))
