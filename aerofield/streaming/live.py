"""Live flights: the row-local and small-state parts as Structured Streaming.

Micro-batches should be bounded by the source's ``maxFilesPerTrigger``; a flight's
rows of one batch are ordered in the task that holds its state.  Backfills use the
batch operators.
"""
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor

from aerofield.operators import maps
from aerofield.operators.stats import mae, rmse, spread
from aerofield.session import scratch
from aerofield.sources import ingest

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPOCH_MICROS = 1704067200000000


def event_time(tt: Column) -> Column:
    """Seconds since 2024 as a timestamp."""
    return F.timestamp_micros((tt * 1e6).cast("long") + EPOCH_MICROS)


def stream_text(spark: SparkSession, path: str, header: list[str], per_trigger: int = 64) -> DataFrame:
    """Flight text files as they arrive; header lines are skipped."""
    lines = spark.readStream.option("maxFilesPerTrigger", per_trigger).text(path).select(
        F.split(F.trim("value"), r"\s+").alias("v"))
    return ingest.parse_flight_text(lines.filter(F.col("v") != F.array(*[F.lit(h) for h in header])), header)


def live_ingest(rows: DataFrame, ranges: DataFrame | None = None, kind: str = "exclude",
                decimated: bool = False) -> DataFrame:
    out = ingest.decimate(rows) if decimated else rows
    return ingest.filter_ranges(out, ranges, kind) if ranges is not None else out


END_OF_TIME = "2262-01-01 00:00:00"


def closable(rows: DataFrame, label: str = "end") -> tuple[DataFrame, str]:
    """A stream with event time ``ts`` that can be ended: it also reads a folder, where
    ``run_available`` puts one row far in the future once the source is used up."""
    spark = rows.sparkSession
    path = scratch(spark, label)
    spark.createDataFrame([], rows.schema).write.parquet(path)
    return rows.unionByName(spark.readStream.schema(rows.schema).parquet(path)), path


def run_available(stream: DataFrame, label: str = "live", path: str | None = None, end: str | None = None,
                  told: dict | None = None) -> DataFrame:
    """Process what the source holds into a parquet table and return the table.  With
    the ``end`` of a closable stream, windows, sessions and rows that are still open then are
    closed too; without it they stay open for the next run.  ``told["late"]`` becomes the
    number of rows that came behind the watermark and were dropped (of the last 100
    micro-batches)."""
    spark = stream.sparkSession
    path = path or scratch(spark, label)
    late = 0

    def run() -> None:
        nonlocal late
        query = (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}-state")
                 .trigger(availableNow=True).start(path))
        query.awaitTermination()
        late += sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])

    run()
    if end:
        schema = spark.read.parquet(end).schema
        last = spark.range(1).select(*[
            (F.to_timestamp(F.lit(END_OF_TIME)) if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
        last.write.mode("append").parquet(end)
        run()
    if told is not None:
        told["late"] = late
    return spark.read.schema(stream.schema).parquet(path)


class Ordered(StatefulProcessor):
    """Rows of a key in the order of event time, whatever order they come in.

    Rows wait in the state until the watermark has passed them; an event-time timer then
    releases them, by (tt, rn).  What comes behind the watermark is dropped before it gets
    here, so nothing is released out of order.  The state holds the rows of the watermark's
    delay, those of a micro-batch packed in one entry (8 bytes a value), and what a subclass
    keeps in ``opened``, ``released`` and ``forget``.  A key
    without rows for ``idle_ms`` of event time is forgotten."""

    def __init__(self, fields: list[T.StructField], idle_ms: int | None):
        self.row = T.StructType([T.StructField("ms", T.LongType()), T.StructField("tt", T.DoubleType()), T.StructField("rn", T.LongType()), *fields])
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", T.StructType([T.StructField("rows", T.BinaryType())]))
        self.newest = handle.getValueState("newest", T.StructType([T.StructField("ms", T.LongType())]))
        self.opened(handle)

    def _kinds(self) -> list[tuple[str, type]]:
        return [(f.name, np.int64 if f.dataType == T.LongType() else np.float64) for f in self.row]

    def packed(self, pdf: pd.DataFrame) -> bytes:
        return b"".join(pdf[c].to_numpy(kind).tobytes() for c, kind in self._kinds())

    def unpacked(self, data: bytes) -> pd.DataFrame:
        n = len(data) // (8 * len(self.row))
        return pd.DataFrame({c: np.frombuffer(data, kind, n, 8 * n * i) for i, (c, kind) in enumerate(self._kinds())})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            if len(pdf):
                self.waiting.appendValue((self.packed(pdf),))
                self.handle.registerTimer(int(pdf["ms"].min()))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = pd.concat([self.unpacked(b""), *[self.unpacked(bytes(r[0])) for r in self.waiting.get()]], ignore_index=True)
        ready, rest = held[held["ms"] <= now], held[held["ms"] > now]
        if len(ready):
            self.newest.update((int(ready["ms"].max()),))
            if len(rest):
                self.waiting.put([(self.packed(rest),)])
            else:
                self.waiting.clear()
            yield self.released(key, ready.sort_values(["tt", "rn"], ignore_index=True))
        if len(rest):
            self.handle.registerTimer(int(rest["ms"].min()))
        elif self.idle_ms is not None and self.newest.exists():
            until = self.newest.get()[0] + self.idle_ms
            if until <= now:
                self.newest.clear()
                self.forget()
            else:
                self.handle.registerTimer(until)

    def close(self) -> None:
        pass


class StepAndVariance(Ordered):
    """Per flight: time since the previous sample, and the measurement variance
    from the previous ten residuals."""

    def __init__(self, first_step: float, start: float, low: float, high: float, depth: int, idle_ms: int | None):
        super().__init__([T.StructField(c, T.DoubleType()) for c in ("resid", "hph")], idle_ms)
        self.first_step, self.start, self.low, self.high, self.depth = first_step, start, low, high, depth

    def opened(self, handle) -> None:
        self.last = handle.getValueState("last", T.StructType([T.StructField("tt", T.DoubleType())]))
        self.ring = handle.getListState("ring", T.StructType([T.StructField("r", T.DoubleType())]))

    def released(self, key, pdf: pd.DataFrame) -> pd.DataFrame:
        last = self.last.get()[0] if self.last.exists() else None
        past = [x[0] for x in self.ring.get()]
        steps = pdf["tt"].diff()
        steps.iloc[0] = self.first_step if last is None else pdf["tt"].iloc[0] - last
        joined = pd.Series(past + pdf["resid"].tolist(), dtype=float)
        mean = (joined * joined).rolling(self.depth).mean().shift(1).iloc[len(past):].reset_index(drop=True)
        variance = (mean - pdf["hph"]).clip(self.low, self.high).fillna(self.start)
        self.last.update((float(pdf["tt"].iloc[-1]),))
        self.ring.put([(float(v),) for v in joined.iloc[-self.depth:]])
        return pd.DataFrame({"flight": key[0], "rn": pdf["rn"], "step": steps, "variance": variance})

    def forget(self) -> None:
        self.last.clear()
        self.ring.clear()


class RowWindows(Ordered):
    """Per line: the last ``width`` values at each row, the line's first one repeated in
    front, and every ``width`` rows a chunk."""

    def __init__(self, width: int, idle_ms: int | None):
        super().__init__([T.StructField("x", T.DoubleType())], idle_ms)
        self.width = width

    def opened(self, handle) -> None:
        self.tail = handle.getListState("tail", T.StructType([T.StructField("x", T.DoubleType())]))
        self.count = handle.getValueState("count", T.StructType([T.StructField("n", T.LongType())]))

    def released(self, key, pdf: pd.DataFrame) -> pd.DataFrame:
        n = self.count.get()[0] if self.count.exists() else 0
        past = [x[0] for x in self.tail.get()] or [pdf["x"].iloc[0]] * (self.width - 1)
        values = past + pdf["x"].tolist()
        windows = [values[i:i + self.width] for i in range(len(pdf))]
        self.count.update((n + len(pdf),))
        if self.width > 1:
            self.tail.put([(v,) for v in values[1 - self.width:]])
        return pd.DataFrame({"flight": key[0], "line": key[1], "rn": pdf["rn"], "pos": range(n, n + len(pdf)), "values": windows})

    def forget(self) -> None:
        self.tail.clear()
        self.count.clear()


def _waiting(stream: DataFrame, keys: list[str], columns: dict[str, Column], delay: str):
    """The stream's rows by key with their event time in whole milliseconds, rounded up."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    ms = F.ceil(F.unix_micros("ts") / 1000).alias("ms")
    rows = stream.withWatermark("ts", delay).where(F.col("ts") < F.to_timestamp(F.lit(END_OF_TIME)))  # the end mark moves the watermark only
    return rows.select(*keys, "ts", ms, F.col("tt").cast("double").alias("tt"), F.col("rn").cast("long").alias("rn"),
                       *[c.cast("double").alias(n) for n, c in columns.items()]).groupBy(*keys)


def steps_and_variance(stream: DataFrame, first_step: float = 0.1, start: float = 1.0, low: float = 0.0, high: float = 1e9,
                       depth: int = 10, delay: str = "10 minutes", idle_ms: int | None = None) -> DataFrame:
    """Stream of (flight, rn, step, variance) from (flight, rn, tt, ts, resid, hph), in the
    order of time within a flight; a row appears once the watermark has passed it.  Rows
    later than ``delay`` are dropped and counted as late (``run_available``)."""
    out = T.StructType([T.StructField("flight", T.StringType()), T.StructField("rn", T.LongType()),
                        T.StructField("step", T.DoubleType()), T.StructField("variance", T.DoubleType())])
    rows = _waiting(stream, ["flight"], {"resid": F.col("resid"), "hph": F.col("hph")}, delay)
    return rows.transformWithStateInPandas(StepAndVariance(first_step, start, low, high, depth, idle_ms), out, "Append", "EventTime")


def row_windows(stream: DataFrame, column: str, width: int, delay: str = "10 minutes", idle_ms: int | None = None) -> DataFrame:
    """Stream of (flight, line, rn, pos, values): for each row the last ``width`` values of
    its line in the order of time, across micro-batches.  The rows with ``pos % width =
    width - 1`` hold the line's chunks."""
    line = stream.schema["line"]
    out = T.StructType([T.StructField("flight", T.StringType()), T.StructField("line", line.dataType), T.StructField("rn", T.LongType()),
                        T.StructField("pos", T.LongType()), T.StructField("values", T.ArrayType(T.DoubleType()))])
    rows = _waiting(stream, ["flight", "line"], {"x": F.col(column)}, delay)
    return rows.transformWithStateInPandas(RowWindows(width, idle_ms), out, "Append", "EventTime")


def live_map_residual(points: DataFrame, cells: DataFrame, measured: str = "measured") -> DataFrame:
    """Map value and residual of arriving positions; the corner table is static."""
    return maps.lookup(points, cells).withColumn("residual", F.col(measured) - F.col("map_val"))


def windowed_errors(stream: DataFrame, error: str, length: str, slide: str | None = None,
                    delay: str = "10 minutes") -> DataFrame:
    """Error statistics per line in tumbling or sliding event-time windows; rows
    later than the watermark are dropped."""
    e = F.col(error)
    slot = F.window("ts", length, slide) if slide else F.window("ts", length)
    return (stream.withWatermark("ts", delay).groupBy(slot, "flight", "line")
            .agg(F.count(F.lit(1)).alias("n"), rmse(e).alias("rmse"), mae(e).alias("mae"), spread(e).alias("std")))


def windowed_chunks(stream: DataFrame, column: str, length: str, delay: str = "10 minutes") -> DataFrame:
    """Samples of each line gathered per time window, in time order.  A window
    holds a line's samples of ``length``, which the sampling rate bounds."""
    item = F.struct("tt", F.col(column).alias("_x"))
    got = (stream.withWatermark("ts", delay).groupBy(F.window("ts", length), "flight", "line")
           .agg(F.array_sort(F.collect_list(item)).alias("_r")))
    return got.select("window", "flight", "line", F.col("_r._x").alias(column))


def live_legs(stream: DataFrame, gap: str, delay: str = "10 minutes") -> DataFrame:
    """Legs of each line that end when no sample came for ``gap``."""
    return (stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "flight", "line")
            .agg(F.count(F.lit(1)).alias("n"), F.min("tt").alias("t_start"), F.max("tt").alias("t_end")))
