"""The live path on Structured Streaming: gate, de-duplication, gap detection, silence and backfill.

State is kept per series: the reference for "first" is the series, so that it spreads over the cluster.
Rows of a micro-batch are handled in the order of their open time, not of arrival. What a backfill gave is
remembered in a table beside the sink, so a live copy that comes later is dropped and counted.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.functions.intervals import DAY, INTERVAL_SECONDS, day_us

UPDATE = "symbol string, interval string, open_us long, close_us long, open double, high double, low double, close double, volume double, is_closed boolean"
#: A map, as keys differ by case alone.
KLINE_JSON = "struct<e:string,s:string,k:map<string,string>>"


@dataclass(frozen=True)
class StreamConfig:
    """``most`` intervals are backfilled at a time, no sooner than ``cooldown_us`` after the last backfill; ``capacity`` bars are remembered a series.

    With ``tell_duplicates`` a repeated bar is a row of kind ``duplicate`` instead of none.
    """

    confirmed_only: bool = True
    most: int = 1_440
    cooldown_us: int = 30_000_000
    capacity: int = 1_000
    tell_duplicates: bool = False

    def __post_init__(self) -> None:
        if self.most < 1 or self.capacity < 1 or self.cooldown_us < 0:
            raise ValueError("limits of a stream must be positive")


def parse_messages(df: DataFrame, column: str = "value") -> DataFrame:
    """Kline messages as rows; other messages and broken ones are dropped."""
    m = df.select(F.from_json(column, KLINE_JSON).alias("m")).filter("m.k is not null and coalesce(m.e, 'kline') = 'kline'")
    k = lambda f, t="string": F.try_element_at(F.col("m.k"), F.lit(f)).try_cast(t)
    return m.select(
        F.coalesce(k("s"), "m.s").alias("symbol"), k("i").alias("interval"), (k("t", "bigint") * 1000).alias("open_us"), (k("T", "bigint") * 1000).alias("close_us"),
        *[k(c[0], "double").alias(c) for c in ("open", "high", "low", "close", "volume")], k("x", "boolean").alias("is_closed"),
    ).filter("open_us is not null")


def gate(df: DataFrame, config: StreamConfig = StreamConfig()) -> DataFrame:
    """Closed bars only, unless all are wanted."""
    return df.filter("is_closed") if config.confirmed_only else df


def dedup_within(df: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One row per bar, remembered as long as the watermark allows."""
    t = df.withColumn("event_time", F.timestamp_micros("open_us")).withWatermark("event_time", delay)
    return t.dropDuplicatesWithinWatermark(["symbol", "interval", "open_us"]).drop("event_time")


class FifoDedup:
    """Remembers the last ``capacity`` bars inserted; a hit doesn't renew its place."""

    def __init__(self, capacity: int, held: list[int] | None = None) -> None:
        self.capacity, self.held = capacity, OrderedDict.fromkeys(held or [])

    def is_new(self, key: int) -> bool:
        if key in self.held:
            return False
        if len(self.held) >= self.capacity:
            self.held.popitem(last=False)
        self.held[key] = None
        return True

    def are_new(self, keys: np.ndarray) -> np.ndarray:
        """The same for each of many keys in turn; at once where nothing has to be forgotten."""
        distinct, first = np.unique(keys, return_index=True)
        if len(self.held) + len(distinct) > self.capacity:
            return np.fromiter(map(self.is_new, keys.tolist()), dtype=bool, count=len(keys))
        out = np.zeros(len(keys), dtype=bool)
        out[first[~np.isin(distinct, np.fromiter(self.held, dtype=np.int64, count=len(self.held)))]] = True
        self.held.update(dict.fromkeys(keys[out].tolist()))
        return out


RECONCILED = UPDATE + ", kind string, gap_start_us long, gap_end_us long"
STATE = "last_us long, filled_at_us long, from_us long, until_us long, seen array<long>"


def reconcile(df: DataFrame, config: StreamConfig = StreamConfig()) -> DataFrame:
    """Bars without duplicates, each gap told by a row of kind ``gap`` before the bar that shows it.

    The last confirmed time never goes back. Within the cooldown after a gap (by open time) another one is
    kept, and told with the first bar after the cooldown; gaps kept together are told as one. Prices that are
    NaN and bars without volume pass through.
    """

    names = [c.split()[0] for c in RECONCILED.split(", ")]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, filled, start, until, seen = state.get if state.exists else (None, None, None, None, [])
        step = INTERVAL_SECONDS.get(key[1], 0) * 1_000_000
        dedup = FifoDedup(config.capacity, list(seen))
        rows = pd.concat(list(parts), ignore_index=True).sort_values(["open_us", "close_us"], kind="stable", ignore_index=True)
        new = dedup.are_new(rows["open_us"].to_numpy(dtype=np.int64))
        again = rows[~new].assign(kind="duplicate")
        rows = rows[new].reset_index(drop=True)
        t = rows["open_us"].to_numpy(dtype=np.int64)
        before = np.maximum.accumulate(np.concatenate([t[:1] if last is None else [last], t]))[:-1]  # the last confirmed time before each
        jumps = np.flatnonzero(t - before > step) if step else np.zeros(0, dtype=np.int64)
        told, i, j = [], 0, 0  # (place of the bar that tells it, start, end)
        while i < len(t):
            if start is None:
                if j == len(jumps):
                    break
                i = int(jumps[j])
                start = int(before[i]) + step
            ready = i if filled is None else max(i, int(np.searchsorted(t, filled + config.cooldown_us)))
            upto = int(np.searchsorted(jumps, ready, side="right"))  # jumps until the bar that tells the gap
            if upto > j:
                until, j = int(t[jumps[upto - 1]]), upto
            if ready >= len(t):
                break
            told.append((ready, start, min(until, start + step * (config.most - 1))))
            filled, start, until, i = int(t[ready]), None, None, ready + 1
        if len(t):
            last = int(t[-1]) if last is None else max(last, int(t[-1]))
        state.update((last, filled, start, until, list(dedup.held)))
        gaps = pd.DataFrame({"symbol": key[0], "interval": key[1], "open_us": [int(t[k]) for k, *_ in told], "kind": "gap", "gap_start_us": [a for _, a, _ in told], "gap_end_us": [b for *_, b in told], "place": [2 * k for k, *_ in told]})
        parts_of = [gaps, rows.assign(kind="bar", place=2 * np.arange(len(rows)) + 1), *([again.assign(place=-1)] if config.tell_duplicates else [])]
        held = [x for x in parts_of if len(x)]
        if not held:
            yield pd.DataFrame(columns=names)
            return
        out = pd.concat(held, ignore_index=True).sort_values("place", kind="stable").reindex(columns=names)
        yield out.astype({c: "Int64" for c in ("open_us", "close_us", "gap_start_us", "gap_end_us")} | {"is_closed": "boolean"})

    return df.groupBy("symbol", "interval").applyInPandasWithState(run, RECONCILED, STATE, "append", GroupStateTimeout.NoTimeout)


SILENT = "symbol string, interval string, last_us long, start_us long, silent_at_us long"


def silence(silence_us: int, keep_us: int) -> StatefulProcessor:
    """A series' last bar and a timer: it goes off where no later bar has come for ``silence_us`` of event time.

    The last bar is forgotten ``keep_us`` after the silence was told, so series that have ended leave no state. The class
    is made here so that it travels with what it uses: Spark also makes it in a process that has no packages of the session.
    """

    class Silence(StatefulProcessor):
        def init(self, handle) -> None:  # noqa: ANN001
            self.handle = handle
            self.last = handle.getValueState("last", "last_us long, told boolean")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
            newest = max(int(r["open_us"].max()) for r in rows)
            held = self.last.get()
            if held is None or newest > held[0]:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.last.update((newest, False))
                self.handle.registerTimer((newest + silence_us) // 1000)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
            held = self.last.get()
            if held is None:
                return
            if held[1]:
                self.last.clear()
                return
            self.last.update((held[0], True))
            self.handle.registerTimer((held[0] + silence_us + keep_us) // 1000)
            step = INTERVAL_SECONDS.get(key[1], 0) * 1_000_000
            yield pd.DataFrame({"symbol": [key[0]], "interval": [key[1]], "last_us": [held[0]], "start_us": [held[0] + step], "silent_at_us": [held[0] + silence_us]})

        def close(self) -> None:
            pass

    return Silence()


def silences(df: DataFrame, silence_us: int, delay: str = "0 seconds", keep_us: int = 30 * DAY) -> DataFrame:
    """A row for each silence of a series, without a bar that shows it: the watermark of all series has passed its last bar by ``silence_us``.

    The row tells what to fetch (from ``start_us``) and when the series counted as silent. A series that speaks again can fall
    silent again. Needs the RocksDB state store, see :func:`needs_timers`.
    """
    t = df.withColumn("event_time", F.timestamp_micros("open_us")).withWatermark("event_time", delay)
    return t.groupBy("symbol", "interval").transformWithStateInPandas(silence(silence_us, keep_us), SILENT, "append", "eventTime")


def needs_timers(spark: SparkSession) -> None:
    """Sets the state store that timers need; before the stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def backfill(batch: DataFrame, history: DataFrame, step: int) -> DataFrame:
    """A micro-batch's bars and, for its gaps, the bars that ``history`` has: tagged, closed, their close time that of opening, ordered by the reader on ``open_us``.

    For ``foreachBatch``. Bars that came live win. Of the history only the time between the least and the greatest gap is read.
    """
    from barloom.operators.merge import priority_merge
    from barloom.plans.engine import restrict

    live = batch.filter("kind = 'bar'").drop("kind", "gap_start_us", "gap_end_us").withColumn("_data_source", F.lit("STREAMING"))
    gaps = batch.filter("kind = 'gap'").select("symbol", F.col("gap_start_us").alias("start_us"), F.col("gap_end_us").alias("end_us"))
    filled = restrict(_between(history, gaps), gaps).withColumn("_data_source", F.lit("REST")).withColumn("is_closed", F.lit(True)).withColumn("close_us", F.col("open_us"))
    return priority_merge([filled, live], keys=("symbol",))


def _between(history: DataFrame, gaps: DataFrame) -> DataFrame:
    """The history from the least start to the greatest end of a batch's gaps: constants, so that files and partitions are skipped."""
    ends = gaps.agg(F.min("start_us").alias("a"), F.max("end_us").alias("b")).first()
    return history.limit(0) if ends["a"] is None else history.filter((F.col("open_us") >= ends["a"]) & (F.col("open_us") < ends["b"]))


def to_table(history: DataFrame, step: int, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: backfills a batch and hands it to a sink with its number, so that the sink can be idempotent."""

    def run(batch: DataFrame, number: int) -> None:
        batch.persist()
        sink(backfill(batch, history, step), number)
        batch.unpersist()

    return run


FILLED = "symbol string, open_us long, batch long"


@dataclass(frozen=True)
class Backfiller:
    """A function for ``foreachBatch`` that backfills, and remembers what it filled: a live copy that comes in a later batch is no bar anymore.

    ``store`` is a folder that the driver and executors share, of this stream alone: ``filled`` has the bars that were filled and
    ``counters`` a row a series, both by batch. A batch that is run again after a failure replaces what it wrote and looks only at the
    batches before. The sink gets new bars and those filled.
    """

    history: DataFrame
    step: int
    sink: Callable[[DataFrame, int], None]
    store: str

    def filled(self, spark: SparkSession) -> DataFrame:
        from barloom.sources.cache import exists

        return spark.read.schema(FILLED).parquet(f"{self.store}/filled") if exists(spark, f"{self.store}/filled") else spark.createDataFrame([], FILLED)

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        ends = batch.filter("kind = 'bar'").agg(F.min("open_us").alias("a"), F.max("open_us").alias("b")).first()
        known = self.filled(spark).filter((F.col("batch") < number) & F.col("open_us").between(F.lit(ends["a"]), F.lit(ends["b"]))).select("symbol", "open_us").distinct().withColumn("known", F.lit(True))
        told = batch.join(known, ["symbol", "open_us"], "left")
        kind = F.when((F.col("kind") == "bar") & F.col("known"), "duplicate").otherwise(F.col("kind"))
        told = told.withColumn("kind", kind).select(*batch.columns).persist()
        out = backfill(told, self.history, self.step).persist()
        out.filter("_data_source = 'REST'").select("symbol", "open_us").write.mode("overwrite").parquet(f"{self.store}/filled/batch={number}")
        counters(told).coalesce(1).write.mode("overwrite").parquet(f"{self.store}/counters/batch={number}")
        self.sink(out, number)
        for df in (out, told, batch):
            df.unpersist()


def counters(batch: DataFrame) -> DataFrame:
    """Bars, repeated bars (where these are told), gaps and missing bars of a batch, per series."""
    us = F.element_at(F.create_map(*[F.lit(x) for k, v in INTERVAL_SECONDS.items() for x in (k, v * 1_000_000)]), F.col("interval"))
    lost = F.when(F.col("kind") == "gap", (F.col("gap_end_us") - F.col("gap_start_us")) / us).otherwise(0)
    return batch.groupBy("symbol", "interval").agg(F.count_if(F.col("kind") == "bar").alias("bars"), F.count_if(F.col("kind") == "duplicate").alias("duplicates"), F.count_if(F.col("kind") == "gap").alias("gaps"), F.sum(lost.cast("long")).alias("to_fill"))


def outcome(batch: DataFrame, history: DataFrame, step: int) -> DataFrame:
    """Per series of a batch: gaps asked for, those that the history filled whole, those that it didn't, and bars that it gave."""
    from barloom.plans.engine import restrict

    gaps = batch.filter("kind = 'gap'").select("symbol", F.col("gap_start_us").alias("start_us"), F.col("gap_end_us").alias("end_us"))
    inside = restrict(_between(history, gaps), gaps).select("symbol", "open_us").distinct().withColumn("day", day_us(F.col("open_us")))
    days = F.explode(F.sequence(day_us(F.col("start_us")), day_us(F.greatest("start_us", F.col("end_us") - 1)), F.lit(DAY)))
    held = inside.join(gaps.withColumn("day", days), ["symbol", "day"]).filter((F.col("open_us") >= F.col("start_us")) & (F.col("open_us") < F.col("end_us")))
    n = held.groupBy("symbol", "start_us", "end_us").agg(F.count("*").alias("n"))
    each = gaps.join(n, ["symbol", "start_us", "end_us"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    whole = F.col("n") * step >= F.col("end_us") - F.col("start_us")
    return each.groupBy("symbol").agg(F.count("*").alias("asked"), F.count_if(whole).alias("filled"), F.count_if(~whole).alias("failed"), F.sum("n").cast("long").alias("backfilled"))
