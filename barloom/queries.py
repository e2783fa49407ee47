"""The operators as queries over the test tables, and the same in SQL.

The tables hold no bars, so bars are made of ``events``: an event type is a symbol, its value a price. Where a series
must have holes, which is what the operators on gaps and grids are about, some hours of the day are silent, other ones
for each symbol and day; all events of the other hours count.
Three overlapping sources are those events whose number is no multiple of 3, no multiple of 5, and a
multiple of 7. Time leaves the engine as integer microseconds (``*_us``) or as time stamps without zone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import intervals as I
from barloom.functions import market as K
from barloom.functions import timestamps as TS
from barloom.operators import bars as B
from barloom.operators import gaps as G
from barloom.operators import grid as R
from barloom.operators import merge as M
from barloom.operators import schema as S
from barloom.operators import stats as A
from barloom.operators import universe as U
from barloom.operators import validate as V
from barloom.plans import engine as E
from barloom.sources import catalog as C

H, MIN5 = 3_600_000_000, 300_000_000
DAY = I.DAY
#: 2024-01-01 and 2024-01-31, the range of the events.
FROM_US, TO_US = 1_704_067_200_000_000, 1_706_659_200_000_000
PICK = {"VISION": "event_id % 3 <> 0", "CACHE": "event_id % 5 <> 0", "REST": "event_id % 7 = 0"}
BAR_COLUMNS = ("symbol", "open_us", "open", "high", "low", "close", "volume", "trades")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            I.ensure_utc(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def ticks(spark: SparkSession, d: str, where: str = "true") -> DataFrame:
    return read(spark, d, "events").filter(where).select(F.col("event_type").alias("symbol"), F.col("event_id").alias("id"), "ts", F.col("value").alias("price"))


def bars(spark: SparkSession, d: str, interval: str = "1h", where: str = "true") -> DataFrame:
    return B.from_ticks(ticks(spark, d, where), interval)


def sources(spark: SparkSession, d: str) -> list[DataFrame]:
    return [S.with_source(bars(spark, d, "1h", w), name) for name, w in PICK.items()]


def ranges(spark: SparkSession, d: str) -> DataFrame:
    """The whole range for each symbol."""
    return read(spark, d, "events").select(F.col("event_type").alias("symbol")).distinct().select("symbol", F.lit(FROM_US).alias("from_us"), F.lit(TO_US).alias("to_us"))


def rounded(df: DataFrame, *extra: str) -> DataFrame:
    return df.withColumn("volume", F.round("volume", 6)).select(*BAR_COLUMNS, *extra)


# SQL for the same ------------------------------------------------------------


def bars_sql(step: int = H, where: str = "true", select: str = "") -> str:
    return f"""select event_type as symbol, (epoch_us(ts) // {step}) * {step} as open_us, first(value order by ts, event_id) as open,
      max(value) as high, min(value) as low, last(value order by ts, event_id) as close, sum(value) as volume, count(*) as trades{select}
      from events where {where} group by 1, 2"""


SOURCES_SQL = "with s as (" + " union all ".join(f"select *, {i} as f, '{n}' as _data_source from ({bars_sql(H, w)})" for i, (n, w) in enumerate(PICK.items())) + ")"
MERGED_SQL = SOURCES_SQL + ", merged as (select * from s qualify row_number() over (partition by symbol, open_us order by case _data_source when 'REST' then 3 when 'CACHE' then 2 when 'VISION' then 1 else 0 end desc, f desc) = 1)"
RANGES_SQL = f"r as (select distinct event_type as symbol, {FROM_US} as from_us, {TO_US} as to_us from events)"
GRID_SQL = f"grid as (select symbol, unnest(range({FROM_US}, {TO_US}, {H})) as open_us from r)"
ROUNDED = "symbol, open_us, open, high, low, close, round(volume, 6) as volume, trades"


def steps_sql(within: int, across: int, source: str = "b") -> str:
    """Steps longer than the thresholds, from bars in ``b``."""
    return f"""g as (select symbol, open_us as start_us, nxt as end_us, nxt - open_us - {H} as duration_us, (nxt - open_us) // {H} - 1 as missing_points, open_us // {DAY} <> nxt // {DAY} as crosses_day
      from (select symbol, open_us, lead(open_us) over (partition by symbol order by open_us) as nxt from {source})
      where nxt - open_us > case when open_us // {DAY} = nxt // {DAY} then {within} else {across} end)"""


REPORT_SQL = steps_sql(int(H * 1.3), int(H * 2.5))
#: Outages: three of eleven hours, by symbol and day, one after the other or apart.
SPARSE = "(hour(ts) * 5 + day(ts) * 3 + length(event_type)) % 11 > 2"
#: Days that a catalogue has: all but one of four, by symbol.
HELD_DAYS = "(day(ts) + length(event_type)) % 4 <> 0"
COALESCE_SQL = f"""m as (select *, max(end_us) over (partition by symbol order by start_us, end_us rows between unbounded preceding and 1 preceding) as reach from x),
      n as (select *, sum(case when reach is null or start_us > reach + {2 * H} then 1 else 0 end) over (partition by symbol order by start_us, end_us rows unbounded preceding) as island from m)
      select symbol, min(start_us) as start_us, max(end_us) as end_us from n group by symbol, island"""


# bars and intervals -----------------------------------------------------------


def _bars_query(name: str, interval: str) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        b = rounded(bars(spark, d, interval))
        return b.select("symbol", I.ntz(F.col("open_us")).alias("open_time"), *BAR_COLUMNS[2:])

    f.__name__ = name
    query(f"select symbol, make_timestamp(open_us) as open_time, open, high, low, close, round(volume, 6) as volume, trades from ({bars_sql(I.interval_us(interval))})")(f)


for _name, _interval in (("bars_1h", "1h"), ("bars_5m", "5m"), ("bars_1d", "1d"), ("bars_3d", "3d"), ("bars_1w", "1w")):
    _bars_query(_name, _interval)


@query(f"""select symbol, (open_us // {4 * H}) * {4 * H} as open_us, first(open order by open_us) as open, max(high) as high, min(low) as low,
    last(close order by open_us) as close, round(sum(volume), 6) as volume, sum(trades)::bigint as trades from ({bars_sql()}) group by 1, 2""")
def bars_rollup_4h(spark, d):
    return rounded(B.roll_up(bars(spark, d), "4h"))


_STEPS = {k: v * 1_000_000 for k, v in I.INTERVAL_SECONDS.items()}


@query("select event_id, " + ", ".join(f"epoch_us(ts) - epoch_us(ts) % {v} as f_{k}" for k, v in _STEPS.items() if k != "1M") + f", epoch_us(ts) - epoch_us(ts) % {_STEPS['1M']} as f_month from events")
def interval_floor(spark, d):
    us = I.micros(F.col("ts"))
    return read(spark, d, "events").select("event_id", *[I.floor_us(us, v).alias("f_month" if k == "1M" else f"f_{k}") for k, v in _STEPS.items()])


@query(f"select event_id, case when epoch_us(ts) % {H} = 0 then epoch_us(ts) else epoch_us(ts) - epoch_us(ts) % {H} + {H} end as ceil_us, (epoch_us(ts) // {H}) * {H} + {H} - 1 as close_us from events")
def interval_ceil(spark, d):
    us = I.micros(F.col("ts"))
    return read(spark, d, "events").select("event_id", I.ceil_us(us, H).alias("ceil_us"), I.close_us(I.floor_us(us, H), H).alias("close_us"))


_ALIGN = f"(epoch_us(ts) // {H}) * {H}"


@query(f"select event_id, {_ALIGN} as start_us, greatest(((epoch_us(ts) + event_id * 1000000) // {H}) * {H}, {_ALIGN} + {H}) as end_us from events")
def align_bounds(spark, d):
    us = I.micros(F.col("ts"))
    s, e = I.align_us(us, us + F.col("event_id") * 1_000_000, H)
    return read(spark, d, "events").select("event_id", s.alias("start_us"), e.alias("end_us"))


@query(f"""select event_id, {TO_US - 10 * DAY} >= (epoch_us(ts) // {H}) * {H} + {H} as complete,
    case when epoch_us(ts) > {TO_US - 10 * DAY} then 0 else (least(epoch_us(ts) + {DAY}, {TO_US - 10 * DAY}) - epoch_us(ts)) // {H} + 1 end as records from events""")
def record_estimate(spark, d):
    us, now = I.micros(F.col("ts")), F.lit(TO_US - 10 * DAY)
    return read(spark, d, "events").select("event_id", I.is_complete(I.floor_us(us, H), H, now).alias("complete"), I.estimated_records(us, us + DAY, H, now).alias("records"))


@query(f"""with {RANGES_SQL} select symbol, (s - from_us) // {100 * H} as chunk, s as chunk_start_us, least(s + {100 * H}, to_us) as chunk_end_us
    from (select *, unnest(range(from_us, to_us, {100 * H})) as s from r)""")
def chunk_ranges(spark, d):
    r = ranges(spark, d).withColumnsRenamed({"from_us": "start_us", "to_us": "end_us"})
    return I.chunks(r, H, 100).select("symbol", F.col("chunk").cast("long").alias("chunk"), "chunk_start_us", "chunk_end_us")


@query(f"select distinct event_type as symbol, unnest(range({FROM_US}, {TO_US}, {DAY})) as day_us from events")
def day_enumeration(spark, d):
    return R.grid(ranges(spark, d), DAY, "day_us")


# scans, casts ------------------------------------------------------------------

_LO, _HI = "2024-01-10 00:00:00", "2024-01-12 00:00:00"


@query(f"select event_id, event_type, ts, value from events where ts >= timestamp '{_LO}' and ts < timestamp '{_HI}'")
def range_scan_halfopen(spark, d):
    return E.in_range(read(spark, d, "events"), "ts", F.lit(_LO).cast("timestamp_ntz"), F.lit(_HI).cast("timestamp_ntz")).select("event_id", "event_type", "ts", "value")


@query(f"select event_id, ts from events where ts between (select min(ts) from events) and timestamp '{_HI}'")
def range_scan_closed(spark, d):
    e = read(spark, d, "events")
    return E.in_range(e, "ts", F.lit("2024-01-01").cast("timestamp_ntz"), F.lit(_HI).cast("timestamp_ntz"), closed=True).select("event_id", "ts")


@query(SOURCES_SQL + f" select {ROUNDED}, _data_source from s where _data_source in ('VISION', 'REST')")
def source_filter(spark, d):
    return rounded(M.diagonal_union(sources(spark, d)).filter(F.col(S.SOURCE).isin("VISION", "REST")), S.SOURCE)


@query("select event_id, event_id % 9 as count, case when event_id % 11 = 0 then null else value end as quote_asset_volume, try_cast(case when event_id % 10 = 0 then 'x' else event_id::varchar end as double) as open from events")
def schema_alias_cast(spark, d):
    e = read(spark, d, "events").select("event_id", (F.col("event_id") % 9).alias("Trades"), F.when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("quote_volume"), F.when(F.col("event_id") % 10 == 0, "x").otherwise(F.col("event_id").cast("string")).alias("open"))
    return S.standardise(S.rename_aliases(e)).select("event_id", "count", "quote_asset_volume", "open")


@query("select event_id, coalesce(case when event_id % 3 = 0 then null else value end, value * 2) as quote_asset_volume from events")
def coalesce_fallback(spark, d):
    e = read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("quote_asset_volume"), (F.col("value") * 2).alias("quote_volume"))
    both = S.canonical(e.withColumnRenamed("event_id", "count"))
    return both.select(F.col("count").alias("event_id"), "quote_asset_volume")


@query("""select event_id, case when event_id % 3 = 0 then null when event_id % 2 = 0 then 'ms' else 'us' end as unit,
    case when event_id % 3 = 0 then -1 when event_id % 2 = 0 then (epoch_us(ts) // 1000) * 1000 else epoch_us(ts) end as us,
    (epoch_us(ts) // 1000) * 1000 as ms_us from events""")
def epoch_unit_detect(spark, d):
    us = I.micros(F.col("ts"))
    raw = F.when(F.col("event_id") % 3 == 0, F.lit(12345)).when(F.col("event_id") % 2 == 0, F.floor(us / 1000).cast("long")).otherwise(us)
    e = read(spark, d, "events").select("event_id", raw.alias("raw"), us.alias("full"))
    return e.select("event_id", TS.epoch_unit(F.col("raw")).alias("unit"), TS.epoch_us_or(F.col("raw"), F.lit(-1)).alias("us"), TS.to_millis(F.col("full")).alias("ms_us"))


@query("select event_id, sign(epoch_us(ts) // 1000 / 1000.0 - 1705000000.5)::int as cmp from events")
def compare_times(spark, d):
    ms = F.floor(I.micros(F.col("ts")) / 1000).cast("long")
    return read(spark, d, "events").select("event_id", TS.compare_times(ms, F.lit(1705000000.5)).alias("cmp"))


@query("""select event_id, event_type as symbol, (event_id * 2)::double as open, (event_id * 2 + 1)::double as high, epoch_us(ts) // 1000 * 1000 as open_us, 7::bigint as count from events where event_id % 5 <> 1""")
def rest_array_decode(spark, d):
    ms = F.floor(I.micros(F.col("ts")) / 1000).cast("long").cast("string")
    n = F.col("event_id")
    cell = lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    row = F.concat(F.lit("[["), F.when(n % 5 == 1, F.lit('"bad"')).otherwise(ms), F.lit(","), cell(n * 2), F.lit(","), cell(n * 2 + 1), F.lit(',"1","1","1",0,"1",7,"1","1","0"]]'))
    pages = read(spark, d, "events").select("event_id", F.col("event_type").alias("symbol"), row.alias("payload"))
    return S.decode_arrays(pages).select("event_id", "symbol", "open", "high", I.micros(F.col("open_time")).alias("open_us"), "count")


@query("""select event_id, event_type as symbol, event_id::double as open, epoch_us(ts) // 1000 * 1000 as open_us from events where event_id % 4 <> 2""")
def candle_array_decode(spark, d):
    ms = F.floor(I.micros(F.col("ts")) / 1000).cast("long").cast("string")
    n = F.col("event_id")
    row = F.concat(F.lit('[["'), ms, F.lit('","'), n.cast("string"), F.lit('","2",'), F.when(n % 4 == 2, F.lit("null")).otherwise(F.lit('"1"')), F.lit(',"1","1","0","0","1"]]'))
    pages = read(spark, d, "events").select("event_id", F.col("event_type").alias("symbol"), row.alias("payload"))
    return S.decode_candles(pages).select("event_id", "symbol", "open", I.micros(F.col("open_time")).alias("open_us"))


# merge -------------------------------------------------------------------------


@query(SOURCES_SQL + " select symbol, open_us, close, case when _data_source = 'VISION' then -1 else trades end as trades, _data_source from s")
def diagonal_union(spark, d):
    a, b, c = sources(spark, d)
    return M.diagonal_union([a.drop("trades"), b, c]).select("symbol", "open_us", "close", F.coalesce("trades", F.lit(-1)).alias("trades"), S.SOURCE)


@query(MERGED_SQL + f" select {ROUNDED}, _data_source from merged")
def priority_merge(spark, d):
    return rounded(M.priority_merge(sources(spark, d)), S.SOURCE)


@query(MERGED_SQL + f" select {ROUNDED}, _data_source from merged")
def priority_merge_maxby(spark, d):
    return rounded(M.priority_merge_by_max(sources(spark, d)), S.SOURCE)


@query(f"select event_type as symbol, (epoch_us(ts) // {H}) * {H} as open_us, event_id from events qualify row_number() over (partition by symbol, open_us order by ts, event_id) = 1")
def dedup_keep_first(spark, d):
    t = ticks(spark, d).withColumn("open_us", I.floor_us(I.micros(F.col("ts")), H))
    return M.keep_first(t, ("symbol", "open_us"), ["ts", "id"]).select("symbol", "open_us", F.col("id").alias("event_id"))


@query(f"""with b as ({bars_sql(H, SPARSE)}), e as ({bars_sql(H)}), {REPORT_SQL},
    n as (select symbol, start_us - {H // 2} as f, end_us + {H // 2} as t from g where start_us % {DAY} = 0 or end_us % {DAY} = 0),
    w as (select * from e where exists (select 1 from n where n.symbol = e.symbol and e.open_us between f and t)),
    u as (select *, 0 as k from b union all select *, 1 as k from w)
    select {ROUNDED} from u qualify row_number() over (partition by symbol, open_us order by k) = 1""")
def boundary_fill_bulk_wins(spark, d):
    bulk = bars(spark, d, "1h", SPARSE)
    return rounded(M.boundary_fill(bulk, bars(spark, d), G.detect(bulk, H), H))


# gaps --------------------------------------------------------------------------

_GAP_COLUMNS = "symbol, start_us, end_us, duration_us, missing_points, crosses_day"


@query(f"with b as ({bars_sql(H, SPARSE)}), {steps_sql(int(H * 1.1), int(H * 2.0))} select {_GAP_COLUMNS} from g")
def gap_detect(spark, d):
    return G.detect(bars(spark, d, "1h", SPARSE), H, G.STRICT)


@query(f"with b as ({bars_sql(H, SPARSE)}), {REPORT_SQL} select {_GAP_COLUMNS} from g")
def gap_detect_day_aware(spark, d):
    return G.detect(bars(spark, d, "1h", SPARSE), H)


@query(f"""with b as ({bars_sql(H, SPARSE)}), {REPORT_SQL} select symbol, count(*) as gaps, count(*) filter (crosses_day) as boundary_gaps, count(*) filter (not crosses_day) as other_gaps,
    max(duration_us) as max_duration_us, sum(missing_points)::bigint as missing_points from g group by symbol""")
def gap_stats(spark, d):
    return G.statistics(G.detect(bars(spark, d, "1h", SPARSE), H))


_SEGMENTS_SQL = f"""with b as ({bars_sql(H, SPARSE)}), {RANGES_SQL}, w as (select b.symbol, open_us from b join r using (symbol) where open_us >= from_us and open_us < to_us),
    sp as (select symbol, min(open_us) as lo, max(open_us) as hi from w group by symbol), {steps_sql(int(H * 1.3), int(H * 2.0), 'w')},
    x as (select symbol, from_us as start_us, coalesce(lo, to_us) as end_us from r left join sp using (symbol) where lo is null or lo > from_us
      union all select symbol, hi + {H}, to_us from r join sp using (symbol) where hi + {H} < to_us union all select symbol, start_us + {H}, end_us from g), """


@query(_SEGMENTS_SQL + COALESCE_SQL)
def missing_segments(spark, d):
    return G.missing_segments(bars(spark, d, "1h", SPARSE), ranges(spark, d), H)


@query(f"with x as (select event_type as symbol, epoch_us(ts) as start_us, epoch_us(ts) + (event_id % 50) * {MIN5 // 5} as end_us from events), {COALESCE_SQL}")
def coalesced_ranges(spark, d):
    us = I.micros(F.col("ts"))
    x = read(spark, d, "events").select(F.col("event_type").alias("symbol"), us.alias("start_us"), (us + (F.col("event_id") % 50) * (MIN5 // 5)).alias("end_us"))
    return G.coalesce_ranges(x, H)


@query(f"""with b as ({bars_sql(H, SPARSE)}), {RANGES_SQL}, {GRID_SQL}, m as (select * from grid anti join b using (symbol, open_us)),
    n as (select *, open_us - row_number() over (partition by symbol order by open_us) * {H} as i from m)
    select symbol, min(open_us) as start_us, max(open_us) + {H} as end_us, count(*) as missing from n group by symbol, i""")
def completeness_islands(spark, d):
    return G.missing_islands(bars(spark, d, "1h", SPARSE), ranges(spark, d), H)


@query(f"""with b as ({bars_sql(H, SPARSE)}), p as (select symbol, open_us, lag(open_us) over (partition by symbol order by open_us) as prev from b)
    select symbol, prev as after_us, prev + {H} as start_us, least(open_us, prev + {3 * H}) as end_us from p where open_us - prev > {H}""")
def stream_gap_batch(spark, d):
    return G.stream_gaps(bars(spark, d, "1h", SPARSE), H, 3)


@query(f"""with b as ({bars_sql(H, SPARSE)}) select symbol, open_us, diff_us from (select symbol, open_us, open_us - lag(open_us) over (partition by symbol order by open_us) as diff_us from b) where diff_us <> {H}""")
def discontinuities(spark, d):
    return G.discontinuities(bars(spark, d, "1h", SPARSE), H).select("symbol", "open_us", "diff_us")


@query(f"""with b as ({bars_sql(H, SPARSE)}), p as (select symbol, open_us, lead(open_us) over (partition by symbol order by open_us) - open_us as d from b),
    q as (select *, case when d > {int(H * 1.5)} then d // {H} - 1 else 0 end as lost from p)
    select symbol, (max(open_us) - min(open_us)) // {H} + 1 as expected, count(*) as actual, count(*) filter (d > {int(H * 1.5)}) as gaps, sum(lost)::bigint as missing, max(lost) as largest from q group by symbol""")
def integrity_report(spark, d):
    return G.integrity(bars(spark, d, "1h", SPARSE), H)


@query(f"with b as ({bars_sql(H, SPARSE)}), {REPORT_SQL} select {_GAP_COLUMNS} from g order by duration_us desc, symbol, start_us limit 5")
def topk_gaps(spark, d):
    return G.largest(G.detect(bars(spark, d, "1h", SPARSE), H), 5)


@query()
def missing_time(spark, d):
    return A.missing_time(G.missing_islands(bars(spark, d, "1h", SPARSE), ranges(spark, d), H), TO_US - FROM_US)


ORACLE_SQL["missing_time"] = ORACLE_SQL["completeness_islands"].join(("with islands as (", f") select symbol, sum(end_us - start_us) / 1000000.0 as missing_s, round(sum(end_us - start_us) / {TO_US - FROM_US}.0 * 100, 6) as missing_pct from islands group by symbol"))


# regular series ------------------------------------------------------------------

_FULL_SQL = f"with b as ({bars_sql(H, SPARSE)}), {RANGES_SQL}, {GRID_SQL}, f as (select symbol, open_us, open, close, volume, trades from grid left join b using (symbol, open_us))"


def _sparse(spark, d):
    return bars(spark, d, "1h", SPARSE).select("symbol", "open_us", "open", "close", "volume", "trades")


@query(_FULL_SQL + " select symbol, open_us, open, close, round(volume, 6) as volume, coalesce(trades, 0) as trades from f")
def reindex_grid(spark, d):
    return R.reindex(_sparse(spark, d), ranges(spark, d), H).select("symbol", "open_us", "open", "close", F.round("volume", 6).alias("volume"), F.coalesce("trades", F.lit(0)).alias("trades"))


@query(_FULL_SQL + " select symbol, open_us, last_value(close ignore nulls) over w as close, coalesce(last_value(trades ignore nulls) over w, 0) as trades from f window w as (partition by symbol order by open_us rows between unbounded preceding and current row)")
def reindex_ffill(spark, d):
    return R.reindex(_sparse(spark, d), ranges(spark, d), H, "forward").select("symbol", "open_us", "close", F.coalesce("trades", F.lit(0)).alias("trades"))


@query(_FULL_SQL + " select symbol, open_us, first_value(close ignore nulls) over w as close, coalesce(first_value(trades ignore nulls) over w, 0) as trades from f window w as (partition by symbol order by open_us rows between current row and unbounded following)")
def reindex_bfill(spark, d):
    return R.reindex(_sparse(spark, d), ranges(spark, d), H, "backward").select("symbol", "open_us", "close", F.coalesce("trades", F.lit(0)).alias("trades"))


@query(_FULL_SQL + """ select symbol, open_us, case when count(close) over w = 24 then round(avg(close) over w, 6) end as ma_24 from f window w as (partition by symbol order by open_us rows between 23 preceding and current row)""")
def moving_average_24(spark, d):
    full = R.reindex(_sparse(spark, d), ranges(spark, d), H)
    return R.moving_average(full, "close", 24, H, "ma").select("symbol", "open_us", F.round("ma", 6).alias("ma_24"))


MIN1, WEEK_ROWS = 60_000_000, 10_080


@query(f"""with b as ({bars_sql(MIN1)}), {RANGES_SQL}, f as (select symbol, open_us, last_value(round(close * 100)::bigint ignore nulls) over (partition by symbol order by open_us) as cents
      from (select symbol, unnest(range({FROM_US}, {TO_US}, {MIN1})) as open_us from r) left join b using (symbol, open_us))
    select symbol, open_us, case when count(cents) over w = {WEEK_ROWS} then (sum(cents) over w)::double / {WEEK_ROWS} end as ma_week from f window w as (partition by symbol order by open_us rows between {WEEK_ROWS - 1} preceding and current row)""")
def moving_average_week(spark, d):
    """The mean of a week of minutes, a frame longer than a bucket; of whole cents, whose sums are exact in any order."""
    cents = bars(spark, d, "1m").select("symbol", "open_us", F.round(F.col("close") * 100).cast("long").alias("cents"))
    full = R.reindex(cents, ranges(spark, d), MIN1, "forward")
    return R.moving_average(full, "cents", WEEK_ROWS, MIN1, "ma_week").select("symbol", "open_us", "ma_week")


@query(_FULL_SQL + """ select symbol, count(*) as rows, round((count(open) + count(close)) / 2.0 / count(*) * 100, 6) as pct_values, count(*) filter (open is null or close is null) as rows_with_null,
    round(count(*) filter (open is null or close is null)::double / count(*) * 100, 6) as pct_rows_with_null from f group by symbol""")
def completeness_pct(spark, d):
    return R.completeness(R.reindex(_sparse(spark, d), ranges(spark, d), H), ("open", "close"))


@query(_FULL_SQL + " select symbol, round((count(open) + count(close)) / 2.0, 6) as avg_values, (count(open) + count(close)) / 2.0 >= 500 * 90 / 100 as complete from f group by symbol")
def window_completeness(spark, d):
    return R.window_complete(R.reindex(_sparse(spark, d), ranges(spark, d), H), 500, ("open", "close"))


# validation ------------------------------------------------------------------------


@query(f"select event_type as symbol, count(*) as rows, count(*) - count(distinct epoch_us(ts) // {H}) as duplicates, 0::bigint as null_times, count(*) = count(distinct epoch_us(ts) // {H}) as is_unique from events group by 1")
def structure_check(spark, d):
    return V.structure(ticks(spark, d).withColumn("open_us", I.floor_us(I.micros(F.col("ts")), H)))


@query("select event_type as symbol, coalesce(bool_and(up), true) as is_monotonic from (select event_type, ts > lag(ts) over (partition by event_type order by event_id) as up from events) group by 1")
def monotonic_check(spark, d):
    return V.monotonic(ticks(spark, d).withColumn("open_us", I.micros(F.col("ts"))), "id")


@query(f"""select symbol, count(*) as rows, count(*) filter (high < greatest(open, close, low)) as bad_high, count(*) filter (low > least(open, close, high)) as bad_low,
    count(*) filter (volume < 0) as bad_volume, count(*) filter (open <= 0) as bad_open, count(*) filter (open is null or high is null or low is null or close is null) as missing_prices
    from (select symbol, open_us, open, case when open_us // {H} % 17 = 0 then low - 1 else high end as high, low, close, case when open_us // {H} % 13 = 0 then -1.0 else volume end as volume from ({bars_sql()})) group by symbol""")
def ohlc_invariants(spark, d):
    n = F.floor(F.col("open_us") / H)
    b = bars(spark, d).withColumn("high", F.when(n % 17 == 0, F.col("low") - 1).otherwise(F.col("high"))).withColumn("volume", F.when(n % 13 == 0, -1.0).otherwise(F.col("volume")))
    return V.ohlc_violations(b)


@query(f"""with b as ({bars_sql(H, SPARSE)}), {RANGES_SQL} select symbol, from_us, to_us, min(open_us) as first_us, max(open_us) as last_us, count(open_us) as rows,
    coalesce(min(open_us) <= from_us + 1000 and max(open_us) >= to_us - 1000, false) as covered from r left join b using (symbol) group by symbol, from_us, to_us""")
def coverage_check(spark, d):
    return V.coverage(bars(spark, d, "1h", SPARSE), ranges(spark, d))


@query(f"""with a as ({bars_sql()}), b as ({bars_sql(H, SPARSE)}), x as (select symbol, min(open_us) as f, max(open_us) as l, count(*) as n from a group by 1), y as (select symbol, min(open_us) as f, max(open_us) as l, count(*) as n from b group by 1)
    select symbol, coalesce(x.f = y.f and x.l = y.l and x.n = y.n, false) as equal from x full join y using (symbol)""")
def boundary_equality(spark, d):
    return V.boundaries_equal(bars(spark, d), bars(spark, d, "1h", SPARSE))


@query(f"""with a as ({bars_sql()}), b as ({bars_sql(H, SPARSE)}), s as (select symbol, min(open_us) as lo, max(open_us) as hi from b group by 1) select {ROUNDED} from a join s using (symbol) where open_us between lo and hi""")
def boundary_clamp(spark, d):
    return rounded(V.clamp(bars(spark, d), bars(spark, d, "1h", SPARSE)))


@query(f"select event_id, epoch_us(ts) % {DAY} < {H} or epoch_us(ts) % {DAY} > {DAY - H} as near_midnight from events")
def near_midnight(spark, d):
    return read(spark, d, "events").select("event_id", V.near_midnight(I.micros(F.col("ts")), H).alias("near_midnight"))


@query(f"select event_id, case when epoch_us(ts) > {TO_US - DAY} then false else epoch_us(ts) + {H // 5} <= {TO_US - DAY} end as available, (epoch_us(ts) // {DAY}) * {DAY} > {TO_US - DAY - 2 * DAY} as fresh from events")
def publication_check(spark, d):
    us, now = I.micros(F.col("ts")), F.lit(TO_US - DAY)
    return read(spark, d, "events").select("event_id", V.likely_available(us, now, H).alias("available"), V.is_fresh(I.day_us(us), now).alias("fresh"))


_FUNDING_SQL = f"select event_type as symbol, (epoch_us(ts) // {8 * H}) * {8 * H} as us, round(avg(value) / 1000, 6) as funding_rate from events group by 1, 2"


def _funding(spark, d):
    t = ticks(spark, d).withColumn("us", I.floor_us(I.micros(F.col("ts")), 8 * H))
    return t.groupBy("symbol", "us").agg(F.round(F.avg("price") / 1000, 6).alias("funding_rate")).select("symbol", I.ntz(F.col("us")).alias("funding_time"), "funding_rate", F.lit("8h").alias("interval"))


@query(f"select symbol, make_timestamp(us) as funding_time, funding_rate, '8h' as interval from ({_FUNDING_SQL})")
def funding_series(spark, d):
    return _funding(spark, d)


@query(f"select symbol, count(*) as rows, count(*) filter (abs(funding_rate) > 0.1) as beyond_band, count(us) = count(distinct us) as is_unique from ({_FUNDING_SQL}) group by symbol")
def funding_check(spark, d):
    return V.funding_check(_funding(spark, d))


# aggregates ------------------------------------------------------------------------


@query(MERGED_SQL + " select symbol, _data_source, count(*) as rows, round(count(*) / sum(count(*)) over (partition by symbol) * 100, 6) as pct from merged group by symbol, _data_source")
def source_counts(spark, d):
    return A.source_counts(M.priority_merge(sources(spark, d)), ("symbol",))


@query(MERGED_SQL + f" select (open_us // {DAY}) * {DAY} as day, count(*) filter (_data_source = 'CACHE') as \"CACHE\", count(*) filter (_data_source = 'REST') as \"REST\", count(*) filter (_data_source = 'VISION') as \"VISION\" from merged group by 1")
def source_by_day_pivot(spark, d):
    m = M.priority_merge(sources(spark, d)).withColumn("day", I.day_us(F.col("open_us")))
    return A.source_by_day(m, ("CACHE", "REST", "VISION"))


@query(f"select symbol, count(*) as bars, round(avg(close), 6) as mean_close, round(stddev_samp(close), 6) as std_close, round(sum(volume), 6) as sum_volume from ({bars_sql()}) group by symbol")
def feature_aggregates(spark, d):
    return A.features(bars(spark, d))


@query(f"""with b as ({bars_sql()}) select count(*) as bars, round(corr(x.close, y.close), 6) as corr, round(avg(abs((y.close - x.close) / nullif(x.close, 0) * 100)), 6) as avg_pct, round(max(abs((y.close - x.close) / nullif(x.close, 0) * 100)), 6) as max_pct
    from b x join b y on x.open_us = y.open_us and x.symbol = 'click' and y.symbol = 'view'""")
def spot_futures_correlation(spark, d):
    return A.correlation(bars(spark, d, "1h", "event_type = 'click'"), bars(spark, d, "1h", "event_type = 'view'"))


@query(f"select symbol, min(open_us) as earliest_us, max(open_us) as latest_us, count(*) as rows from ({bars_sql()}) group by symbol")
def latest_earliest(spark, d):
    return A.spans(bars(spark, d))


@query("""select 'u' || (user_id % 7) as endpoint, count(*) as calls, round(avg(case when event_type <> 'error' then 1.0 else 0.0 end) * 100, 6) as success_pct, round(avg(case when r <= 100 then value end), 6) as recent_latency
    from (select *, row_number() over (partition by user_id % 7 order by event_id desc) as r from events) group by 1""")
def call_metrics(spark, d):
    log = read(spark, d, "events").select(F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("endpoint"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency"), F.col("event_id").alias("id"))
    return A.call_metrics(log)


@query("select event_type, count(*) as rows from events group by 1 order by rows desc, event_type")
def failure_counts(spark, d):
    return A.group_counts(read(spark, d, "events"), "event_type")


@query(f"select event_type as symbol, count(*) - count(distinct epoch_us(ts) // {MIN5}) as duplicates from events group by 1")
def duplicate_count(spark, d):
    return A.duplicate_count(ticks(spark, d).withColumn("open_us", I.floor_us(I.micros(F.col("ts")), MIN5)), ("symbol",), "open_us")


# symbols and universe -----------------------------------------------------------------

#: A symbol for each customer: a base of its nation and a quote by its key.
_SYMBOL_SQL = "select c_custkey, upper(substr(n_name, 1, 4)) || case c_custkey % 6 when 0 then 'USDT' when 1 then 'USDC' when 2 then 'BTC' when 3 then 'USD_PERP' when 4 then 'USD_240329' else 'XYZ' end as symbol from customer join nation on c_nationkey = n_nationkey"


def _symbols(spark, d):
    quote = F.element_at(F.array(*[F.lit(x) for x in ("USDT", "USDC", "BTC", "USD_PERP", "USD_240329", "XYZ")]), (F.col("c_custkey") % 6 + 1).cast("int"))
    n = F.broadcast(read(spark, d, "nation").select("n_nationkey", "n_name"))  # 25 rows, fixed
    return read(spark, d, "customer").select("c_custkey", "c_nationkey").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat(F.upper(F.substring("n_name", 1, 4)), quote).alias("symbol"))


@query(f"""select c_custkey, symbol, case when symbol like '%\\_PERP' escape '\\' or regexp_matches(symbol, '[0-9]') then symbol else regexp_replace(symbol, 'USDT$', 'USD') || '_PERP' end as coin_symbol,
    regexp_extract(symbol, '^(.+?)(USDT|USDC|BUSD|BTC|ETH|BNB)$', 1) as base_asset,
    regexp_extract(regexp_replace(symbol, '_(PERP|[0-9]+)$', ''), '^(.*?)(USDT|USDC|BUSD|USD)?$', 1) as base_symbol,
    case when regexp_matches(symbol, '(USDT|USDC|USD|BTC|ETH)$') then regexp_replace(symbol, '^(.*)(USDT|USDC|USD|BTC|ETH)$', '\\1-\\2') else symbol || '-USDT' end as hyphenated,
    lower(symbol) || '@kline_1h' as stream from ({_SYMBOL_SQL})""")
def symbol_formats(spark, d):
    s = F.col("symbol")
    return _symbols(spark, d).select("c_custkey", "symbol", K.futures_symbol(s, K.COINM).alias("coin_symbol"), K.base_asset(s).alias("base_asset"), K.base_symbol(s).alias("base_symbol"), K.hyphenated(s).alias("hyphenated"), K.stream_name(s, F.lit("1h")).alias("stream"))


@query(f"""select c_custkey, case when m = 'cm' and not regexp_matches(symbol, '_(PERP|[0-9]{{6}})$') then 'no contract; use ' || symbol || '_PERP'
    when m <> 'cm' and symbol like '%\\_PERP' escape '\\' then 'a coin-margined contract; use ' || regexp_replace(symbol, 'USD_PERP$', 'USDT') end as problem,
    m = 'spot' or i <> '1s' as supported from (select *, case c_custkey % 3 when 0 then 'spot' when 1 then 'um' else 'cm' end as m, case c_custkey % 4 when 0 then '1s' else '1h' end as i from ({_SYMBOL_SQL}))""")
def symbol_rules(spark, d):
    m = F.element_at(F.array(F.lit("spot"), F.lit("um"), F.lit("cm")), (F.col("c_custkey") % 3 + 1).cast("int"))
    i = F.when(F.col("c_custkey") % 4 == 0, "1s").otherwise("1h")
    return _symbols(spark, d).select("c_custkey", K.symbol_problem(F.col("symbol"), m).alias("problem"), K.supports_interval(m, i).alias("supported"))


@query("select event_id, 'spot' as market, event_type as symbol, '1h' as interval, strftime(ts, '%Y-%m-%d') as day from events")
def path_round_trip(spark, d):
    path = K.data_path(F.lit("spot"), F.col("event_type"), F.lit("1h"), F.col("ts").cast("date"))
    return read(spark, d, "events").select("event_id", path.alias("path")).select("event_id", K.parse_path(F.col("path")).alias("p")).select("event_id", "p.*").withColumn("day", F.col("day").cast("string"))


@query("select event_id, sha256(event_type) as checksum from events")
def checksum_extract(spark, d):
    text = F.concat(F.upper(F.sha2(F.col("event_type"), 256)), F.lit("  file.zip\n"))
    return read(spark, d, "events").select("event_id", K.checksum_of(text).alias("checksum"))


_LISTED_SQL = "l as (select o_custkey, min(o_orderdate) as d0 from orders where o_orderkey % 3 = 0 group by 1)"


def _listed(spark, d, where):
    return read(spark, d, "orders").filter(where).groupBy(F.col("o_custkey").alias("symbol")).agg(F.min(I.micros(F.col("o_orderdate"))).alias("earliest_us"))


def _requests(spark, d):
    return read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("symbol"), I.micros(F.col("o_orderdate")).alias("at_us"))


@query(f"with {_LISTED_SQL} select o_orderkey, o.o_custkey as symbol, coalesce(o_orderdate >= d0, true) as available from orders o left join l using (o_custkey)")
def availability_check(spark, d):
    return U.availability(_requests(spark, d), _listed(spark, d, "o_orderkey % 3 = 0")).select("o_orderkey", "symbol", "available")


@query("""with a as (select o_custkey, min(o_orderdate) as d0 from orders where o_orderkey % 5 = 0 group by 1), b as (select o_custkey, min(o_orderdate) as d1 from orders where o_orderkey % 7 = 0 group by 1)
    select o_orderkey, case when d0 is not null then 'first' when d1 is not null then 'second' else 'none' end as market, coalesce(o_orderdate < coalesce(d0, d1), false) as warn from orders left join a using (o_custkey) left join b using (o_custkey)""")
def counterpart_warning(spark, d):
    return U.counterpart(_requests(spark, d), _listed(spark, d, "o_orderkey % 5 = 0"), _listed(spark, d, "o_orderkey % 7 = 0")).select("o_orderkey", "market", "warn")


def _bases(spark, d):
    return {
        "spot": read(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_nationkey").alias("base"), F.col("c_name").alias("symbol")),
        "um": read(spark, d, "supplier").select(F.col("s_nationkey").alias("base"), F.col("s_name").alias("symbol")),
        "cm": read(spark, d, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("base"), F.col("n_name").alias("symbol")),
    }


@query("select c_nationkey as base from customer where c_custkey % 2 = 0 intersect select s_nationkey from supplier intersect select n_nationkey from nation where n_regionkey < 3")
def common_bases(spark, d):
    return U.common(list(_bases(spark, d).values()))


@query("select c_nationkey as base, c_name as symbol from customer where c_custkey % 2 = 0 and c_nationkey in (select n_nationkey from nation where n_regionkey < 3)")
def semi_join_universe(spark, d):
    b = _bases(spark, d)
    return U.restrict(b["spot"], b["cm"])


@query("""select base, spot_symbol, um_symbol, cm_symbol from (select c_nationkey as base, min(c_name) as spot_symbol from customer where c_custkey % 2 = 0 group by 1)
    full join (select s_nationkey as base, min(s_name) as um_symbol from supplier group by 1) using (base) full join (select n_nationkey as base, min(n_name) as cm_symbol from nation where n_regionkey < 3 group by 1) using (base)""")
def consolidated_full_outer(spark, d):
    return U.consolidate(_bases(spark, d))


@query(f"select event_type as symbol, min((epoch_us(ts) // {DAY}) * {DAY}) as earliest, max((epoch_us(ts) // {DAY}) * {DAY}) as latest, case when max((epoch_us(ts) // {DAY}) * {DAY}) > {TO_US - 5 * DAY} then 'ACTIVE' else 'NO_RECENT_DATA' end as status from events where event_type <> 'error' or epoch_us(ts) < {TO_US - 9 * DAY} group by 1")
def listing_status(spark, d):
    days = ticks(spark, d).withColumn("day", I.day_us(I.micros(F.col("ts")))).filter((F.col("symbol") != "error") | (F.col("day") < TO_US - 9 * DAY))
    return U.listing_status(days, F.lit(TO_US - 5 * DAY))


@query("select event_type as symbol, string_agg(distinct case event_id % 4 when 0 then '1d' when 1 then '1h' when 2 then '1m' else '5m' end, ',' order by case event_id % 4 when 0 then '1d' when 1 then '1h' when 2 then '1m' else '5m' end) as intervals from events group by 1")
def interval_list_agg(spark, d):
    i = F.element_at(F.array(*[F.lit(x) for x in ("1d", "1h", "1m", "5m")]), (F.col("event_id") % 4 + 1).cast("int"))
    return U.interval_lists(read(spark, d, "events").select(F.col("event_type").alias("symbol"), i.alias("interval")))


@query("select event_id, case when event_id % 2 = 0 then true else false end as has_month from events")
def interval_list_parse(spark, d):
    text = F.when(F.col("event_id") % 2 == 0, F.lit('"1m, 1h,1mo"')).otherwise(F.lit('"1m,1h"'))
    return read(spark, d, "events").select("event_id", F.array_contains(K.interval_list(text), "1M").alias("has_month"))


# cache and catalogue ----------------------------------------------------------------------

_CATALOG_SQL = f"cat as (select event_type as symbol, (epoch_us(ts) // {DAY}) * {DAY} as day_us, count(*) as num_records, count(*) * 80 as file_size from events where {SPARSE} and {HELD_DAYS} group by 1, 2)"


def _catalog(spark, d):
    e = read(spark, d, "events").filter(f"{SPARSE} and {HELD_DAYS}")
    return e.groupBy(F.col("event_type").alias("symbol"), I.day_us(I.micros(F.col("ts"))).alias("day_us")).agg(F.count("*").alias("num_records"), (F.count("*") * 80).alias("file_size"))


@query(f"with {_CATALOG_SQL} select count(*) as entries, count(distinct symbol) as symbols, sum(num_records)::bigint as records, sum(file_size)::bigint as bytes, min(day_us) as first_day_us, max(day_us) as last_day_us from cat")
def cache_catalog_stats(spark, d):
    return C.statistics(_catalog(spark, d))


@query(f"with {_CATALOG_SQL}, {RANGES_SQL}, days as (select symbol, unnest(range({FROM_US}, {TO_US}, {DAY})) as day_us from r) select symbol, day_us from days anti join cat using (symbol, day_us)")
def cache_missing_days(spark, d):
    return C.missing_days(_catalog(spark, d), ranges(spark, d))


@query(f"with {_CATALOG_SQL}, {RANGES_SQL}, days as (select symbol, unnest(range({FROM_US}, {TO_US}, {DAY})) as day_us from r) select symbol, count(*) as days, count(num_records) as cached, round(count(num_records)::double / count(*) * 100, 6) as pct from days left join cat using (symbol, day_us) group by symbol")
def cache_coverage(spark, d):
    return C.coverage(_catalog(spark, d), ranges(spark, d))


@query(f"""select event_type as symbol, (epoch_us(ts) // {DAY}) * {DAY} as day_us, event_id as version, user_id as num_records from events qualify row_number() over (partition by event_type, epoch_us(ts) // {DAY} order by event_id desc) = 1""")
def catalog_latest_wins(spark, d):
    e = read(spark, d, "events").select(F.col("event_type").alias("symbol"), I.day_us(I.micros(F.col("ts"))).alias("day_us"), F.col("event_id").alias("version"), F.col("user_id").alias("num_records"))
    return C.upsert(e.filter("version % 2 = 0"), e.filter("version % 2 = 1"))


@query(f"""select event_type as symbol, (epoch_us(ts) // {DAY}) * {DAY} as day_us, count(*) as rows, count(distinct epoch_us(ts) // {MIN5}) as distinct_times, least(1.0, round(count(distinct epoch_us(ts) // {MIN5}) / 288.0, 6)) as share from events group by 1, 2""")
def daily_quality(spark, d):
    t = ticks(spark, d).withColumn("open_us", I.floor_us(I.micros(F.col("ts")), MIN5))
    return C.daily_quality(t, "5m")


# the cascade -------------------------------------------------------------------------------


@query(f"""with v as ({bars_sql(H, PICK['VISION'])}), c as ({bars_sql(H, SPARSE)}), {RANGES_SQL}, w as (select symbol, open_us from c), sp as (select symbol, min(open_us) as lo, max(open_us) as hi from w group by symbol),
    {steps_sql(int(H * 1.3), int(H * 2.0), 'w')}, x as (select symbol, from_us as start_us, coalesce(lo, to_us) as end_us from r left join sp using (symbol) where lo is null or lo > from_us
      union all select symbol, hi + {H}, to_us from r join sp using (symbol) where hi + {H} < to_us union all select symbol, start_us + {H}, end_us from g), seg as ({'with ' + COALESCE_SQL}),
    u as (select *, 'CACHE' as _data_source from c union all select *, 'VISION' from v where exists (select 1 from seg where seg.symbol = v.symbol and v.open_us >= start_us and v.open_us < end_us)
      and not exists (select 1 from c where c.symbol = v.symbol and c.open_us = v.open_us)), {GRID_SQL}
    select symbol, open_us, close, coalesce(_data_source, 'NONE') as _data_source from grid left join u using (symbol, open_us)""")
def get_data_cascade(spark, d):
    loaders = [E.Loader("CACHE", lambda spark, wanted: bars(spark, d, "1h", SPARSE)), E.Loader("VISION", lambda spark, wanted: bars(spark, d, "1h", PICK["VISION"]))]
    got = E.Engine(spark, loaders).get_data(ranges(spark, d), "1h")
    return got.select("symbol", "open_us", "close", F.coalesce(S.SOURCE, F.lit("NONE")).alias(S.SOURCE))


# streaming ---------------------------------------------------------------------------------


def _replayed(spark: SparkSession, d: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The result of a streaming plan over hourly bars that are replayed from files until all are read."""
    import uuid

    from barloom.sources.scratch import scratch_dir

    base = scratch_dir(spark)
    closed = F.pmod(F.floor(F.col("open_us") / H), F.lit(10)) != 0
    b = bars(spark, d, "1h", SPARSE).select("symbol", F.lit("1h").alias("interval"), "open_us", (F.col("open_us") + H - 1).alias("close_us"), "open", "high", "low", "close", F.round("volume", 6).alias("volume"), closed.alias("is_closed"))
    b.unionByName(b.filter(f"open_us % {2 * H} = 0")).repartition(3, "symbol").write.parquet(f"{base}/in")
    stream = spark.readStream.schema(b.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    name = f"replay_{uuid.uuid4().hex}"
    q = build(stream).writeStream.format("parquet").option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


_LIVE_SQL = f"lv as (select symbol, '1h' as interval, open_us, open_us + {H - 1} as close_us, open, high, low, close, round(volume, 6) as volume, true as is_closed from ({bars_sql(H, SPARSE)}) where open_us // {H} % 10 <> 0)"


@query(f"with {_LIVE_SQL} select * from lv union all select * from lv where open_us % {2 * H} = 0")
def stream_closed_gate(spark, d):
    from barloom.streaming import live

    return _replayed(spark, d, live.gate)


@query(f"""with {_LIVE_SQL}, p as (select *, lag(open_us) over (partition by symbol order by open_us) as prev from lv)
    select 'bar' as kind, symbol, open_us, close, -1 as gap_start_us, -1 as gap_end_us from lv union all select 'gap', symbol, open_us, -1.0, prev + {H}, least(open_us, prev + {1440 * H}) from p where open_us - prev > {H}""")
def stream_reconcile(spark, d):
    """Replayed bars without duplicates, and a row for each gap before the bar that shows it: what a batch over all bars gives."""
    from barloom.streaming import live

    got = _replayed(spark, d, lambda s: live.reconcile(live.gate(s)))
    none = lambda c, t: F.coalesce(c, F.lit(-1).cast(t)).alias(c)
    return got.select("kind", "symbol", "open_us", none("close", "double"), none("gap_start_us", "long"), none("gap_end_us", "long"))
