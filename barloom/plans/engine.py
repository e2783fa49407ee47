"""The main query: one regular, de-duplicated series per symbol from a cascade of sources, with provenance.

Sources are asked in turn for what is still missing. What is missing stays a DataFrame of ranges, so
nothing of the data's size passes the driver, and many symbols make one job.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.intervals import ensure_utc, interval_us, resolve_range
from barloom.functions.market import COINM, USDM, check_subscriptions
from barloom.operators import gaps, grid
from barloom.operators.merge import diagonal_union, keep_first, priority_merge
from barloom.operators.schema import SOURCE, with_source
from barloom.operators.validate import ValidationError
from barloom.sources.remote import Fetched
from barloom.sources.scratch import cut
from barloom.streaming import live
from barloom.streaming.live import StreamConfig


def in_range(df: DataFrame, column: str, start: Column, end: Column, closed: bool = False, strict: bool = False) -> DataFrame:
    """Rows from start until before end (``closed``: its end included): a bare comparison, so that it reaches the scan.

    ``strict`` raises where rows exist and none matches.
    """
    c = F.col(column)
    out = df.filter((c >= start) & (c <= end if closed else c < end))
    if strict and out.isEmpty() and not df.isEmpty():
        raise ValidationError("no row is in the range", column=column)
    return out


@dataclass(frozen=True)
class Loader:
    """A source: its name, and a function of (session, wanted ranges ``symbol, start_us, end_us``) to bars, or to bars and what was refused."""

    name: str
    load: Callable[[SparkSession, DataFrame], DataFrame | Fetched]


@dataclass(frozen=True)
class Config:
    """How the engine works: which sources, in which order; regular series or only what exists."""

    order: tuple[str, ...] = ()
    regular: bool = True
    fill: str | None = None
    with_source: bool = True
    thresholds: tuple[float, float] = gaps.PLAN
    loaders_off: frozenset[str] = field(default_factory=frozenset)


def restrict(df: DataFrame, ranges: DataFrame, keys: tuple[str, ...] = ("symbol",), at: str = "open_us") -> DataFrame:
    """Rows within the ranges ``start_us, end_us`` of their key, see :func:`barloom.operators.gaps.within`."""
    return gaps.within(df, ranges, keys, at, "start_us", "end_us")


class Engine:
    def __init__(self, spark: SparkSession, loaders: list[Loader], config: Config | None = None) -> None:
        ensure_utc(spark)
        self.spark, self.config = spark, config or Config()
        by_name = {loader.name: loader for loader in loaders if loader.name not in self.config.loaders_off}
        self.loaders = [by_name[n] for n in self.config.order if n in by_name] if self.config.order else list(by_name.values())
        #: Of the last call: by source, the ranges that it refused. The next source was asked for them.
        self.left: dict[str, DataFrame] = {}

    def get_data(self, ranges: DataFrame, interval: str, enforce_source: str | None = None) -> DataFrame:
        """Bars of the ranges ``symbol, from_us, to_us`` (half-open).

        Each source fills what the ones before lack: before, between and after their bars, by the
        thresholds of the plan. Where two have a bar, priority decides. With ``regular`` every bar of the
        range is a row; missing ones are null or filled. Without it, what the first source has of a symbol
        is enough for that symbol; the symbols that it lacks go on to the next sources.

        A source is asked only if something is missing: where the cache has all, no other one is opened. What a
        source refuses (:class:`barloom.sources.remote.Fetched`) is missing for the next one, and told in ``left``.
        What is merged so far is written to the shared folder after each source but the last, so a source is read once
        and the plan grows by one scan a source; what is missing is written and counted, a small table beside the bars.
        """
        step, c = interval_us(interval), self.config
        loaders = [x for x in self.loaders if enforce_source in (None, x.name)]
        if not loaders:
            raise ValidationError("no such source", source=enforce_source)
        ranges = cut(ranges.select("symbol", "from_us", "to_us"))  # what makes them runs once
        wanted = ranges.withColumnsRenamed({"from_us": "start_us", "to_us": "end_us"})
        merged: DataFrame | None = None
        self.left = {}
        for i, loader in enumerate(loaders):
            if i == 1 and not c.regular:
                ranges = cut(ranges.join(merged.select("symbol").distinct(), "symbol", "left_anti"))
            if i:
                wanted = gaps.missing_segments(merged, ranges, step, c.thresholds)
                if wanted.isEmpty():
                    break
            got = loader.load(self.spark, wanted)
            if isinstance(got, Fetched):
                self.left[loader.name], got = got.left, got.bars
            got = restrict(with_source(got, loader.name), wanted)
            merged = priority_merge([got] if merged is None else [merged, got])
            if i + 1 < len(loaders):
                merged = cut(merged)
        if c.regular:
            merged = grid.reindex(merged, ranges, step, c.fill)
        return merged if c.with_source else merged.drop(SOURCE)

    def fetch_market_data(self, symbols: list[str], interval: str, start_us: int | None = None, end_us: int | None = None, days: int | None = None, now_us: int | None = None, **options: object) -> tuple[DataFrame, float, int]:
        """Bars of symbols over a resolved range, how long they took, and how many there are."""
        now = int(time.time() * 1e6) if now_us is None else now_us
        r = resolve_range(start_us, end_us, days, now, interval_us(interval))
        began = time.time()
        ranges = self.spark.createDataFrame([(s, r.start_us, r.end_us) for s in symbols], "symbol string, from_us long, to_us long")
        df = cut(self.get_data(ranges, interval, **options))
        return df, time.time() - began, df.count()


    def get_funding(self, market: str, load: Callable[[SparkSession, DataFrame], DataFrame], start_us: int, end_us: int, cached: DataFrame | None = None, symbols: list[str] | None = None, interval: str = "8h") -> DataFrame:
        """Funding rates ``symbol, funding_us, funding_rate`` of a closed range: of the cache, and of the source what the cache lacks; futures only.

        ``load`` gets the ranges ``symbol, start_us, end_us`` that are missing and isn't called where nothing is. Without
        ``symbols`` those of the cache are meant, and without a cache the source decides: its ranges name no symbol.
        """
        if market not in (USDM, COINM):
            raise ValidationError("only futures have funding rates", market=market)
        held = None if cached is None else cut(in_range(cached, "funding_us", F.lit(start_us), F.lit(end_us), closed=True))
        span = [F.lit(start_us).alias("from_us"), F.lit(end_us + 1).alias("to_us")]
        of = held.select("symbol").distinct() if symbols is None and held is not None else self.spark.createDataFrame([(s,) for s in symbols or [None]], "symbol string")
        ranges = of.select("symbol", *span)
        wanted = ranges.withColumnsRenamed({"from_us": "start_us", "to_us": "end_us"}) if held is None else gaps.missing_segments(held, ranges, interval_us(interval), self.config.thresholds, time="funding_us")
        frames = [] if held is None else [with_source(held, "CACHE")]
        if not wanted.isEmpty():
            fresh = in_range(load(self.spark, wanted), "funding_us", F.lit(start_us), F.lit(end_us), closed=True)
            frames.append(with_source(fresh if held is None and symbols is None else restrict(fresh, wanted, at="funding_us"), "REST"))
        every = diagonal_union([f.withColumn("__first", F.lit(i)) for i, f in enumerate(frames)])
        return keep_first(every, ("symbol", "funding_us"), ["__first"]).drop("__first")

    def create_stream(self, market: str, symbols: list[str], path: str, config: StreamConfig | None = None, **options: object) -> DataFrame:
        """A stream of the symbols' bars, gated, without duplicates, with rows that tell of gaps; ``path`` has the messages."""
        names = check_subscriptions(market, symbols)
        raw = self.spark.readStream.format("barloom_updates").options(path=path, **{k: str(v) for k, v in options.items()}).load()
        c = config or StreamConfig()
        return live.reconcile(live.gate(raw.filter(F.col("symbol").isin(names)), c), c)

    def run_stream(self, stream: DataFrame, history: DataFrame, interval: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
        """Hands every micro-batch of a stream, backfilled from ``history``, to a sink, until what is there now has been read."""
        run = live.to_table(history, interval_us(interval), sink)
        stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


#: Loaders by name, for engines that are made from names.
LOADERS: dict[str, Loader] = {}


def register(loader: Loader, replace: bool = False) -> Loader:
    if loader.name in LOADERS and not replace:
        raise ValidationError("there is a loader of this name", name=loader.name)
    LOADERS[loader.name] = loader
    return loader


def create(spark: SparkSession, *names: str, config: Config | None = None) -> Engine:
    """An engine of registered loaders, in the order of their names."""
    missing = [n for n in names if n not in LOADERS]
    if missing:
        raise ValidationError("no such loader", missing=missing)
    return Engine(spark, [LOADERS[n] for n in names], config)


def discover() -> dict[str, object]:
    """What the library offers, for tools."""
    from barloom.functions import intervals, market

    return {"intervals": intervals.INTERVAL_SECONDS, "markets": {k: vars(v) for k, v in market.MARKETS.items()}, "operators": ["merge", "gaps", "grid", "bars", "validate", "stats", "universe"]}
