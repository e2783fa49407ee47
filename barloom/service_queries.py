"""Queries for the cache, the catalogue, sources, the live path and rules that are no operators on bars, and the same in SQL.

Files that sources read are written first, from the bars of ``events``, into the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import intervals as I
from barloom.functions import market as K
from barloom.functions import timestamps as TS
from barloom.operators import gaps as G
from barloom.operators import grid as R
from barloom.operators import merge as M
from barloom.operators import schema as S
from barloom.operators import universe as U
from barloom.operators import validate as V
from barloom.plans import engine as E
from barloom.queries import COALESCE_SQL, DAY, FROM_US, H, HELD_DAYS, PICK, RANGES_SQL, ROUNDED, SPARSE, TO_US, bars, bars_sql, query, ranges, read, rounded, ticks
from barloom.queries import _symbols, _SYMBOL_SQL
from barloom.sources import cache as Q
from barloom.sources import catalog as C
from barloom.sources import errors, remote, search
from barloom.sources.scratch import cut, scratch_dir
from barloom.streaming import live

D10, D20 = FROM_US + 9 * DAY, FROM_US + 19 * DAY


def _told(df: DataFrame, *columns: str) -> DataFrame:
    """-1 for nulls of whole numbers, so that the rows compare as whole numbers anywhere."""
    return df.withColumns({c: F.coalesce(c, F.lit(-1).cast("long")) for c in columns})


def _url(spark: SparkSession) -> str:
    return scratch_dir(spark)


# the cascade -------------------------------------------------------------------------------


def segments_sql(i: int, source: str, wanted: str = "r", within: int = int(H * 1.3), across: int = 2 * H) -> str:
    """CTEs that end in ``seg{i}``: what ``source`` lacks of the ranges ``wanted``."""
    return f"""w{i} as (select s.symbol, open_us from {source} s join {wanted} using (symbol) where open_us >= from_us and open_us < to_us),
      sp{i} as (select symbol, min(open_us) as lo, max(open_us) as hi from w{i} group by symbol),
      g{i} as (select symbol, open_us as start_us, nxt as end_us from (select symbol, open_us, lead(open_us) over (partition by symbol order by open_us) as nxt from w{i})
        where nxt - open_us > case when open_us // {DAY} = nxt // {DAY} then {within} else {across} end),
      x{i} as (select symbol, from_us as start_us, coalesce(lo, to_us) as end_us from {wanted} left join sp{i} using (symbol) where lo is null or lo > from_us
        union all select symbol, hi + {H}, to_us from {wanted} join sp{i} using (symbol) where hi + {H} < to_us union all select symbol, start_us + {H}, end_us from g{i}),
      seg{i} as ({'with ' + COALESCE_SQL.replace('from x)', f'from x{i})')})"""


def cascade_sql(sources: list[tuple[str, str]], regular: bool = True) -> str:
    """CTEs that end in ``u``: the merged bars of a cascade of sources (name, filter of events)."""
    rank = "case _data_source when 'REST' then 3 when 'CACHE' then 2 when 'VISION' then 1 else 0 end"
    parts = [RANGES_SQL, f"u0 as (select *, '{sources[0][0]}' as _data_source, 0 as f from ({bars_sql(H, sources[0][1])}))"]
    wanted = "r"
    if not regular:
        wanted = "todo"
        parts.append("todo as (select * from r where symbol not in (select symbol from u0))")
    for i, (name, where) in enumerate(sources[1:], 1):
        parts.append(segments_sql(i, f"u{i - 1}", wanted))
        parts.append(f"""u{i} as (select * from (select * from u{i - 1} union all select *, '{name}', {i} from ({bars_sql(H, where)}) b where exists (select 1 from seg{i} s where s.symbol = b.symbol and b.open_us >= start_us and b.open_us < end_us))
          qualify row_number() over (partition by symbol, open_us order by {rank} desc, f desc) = 1)""")
    return "with " + ",\n".join(parts) + f", u as (select * from u{len(sources) - 1})"


THREE = [("CACHE", SPARSE), ("VISION", PICK["VISION"]), ("REST", "event_id % 2 = 0")]
FEW = [("CACHE", f"{SPARSE} and event_type not in ('click', 'view')"), ("VISION", "event_id % 3 = 0 and event_type <> 'purchase'"), ("REST", "event_id % 5 <> 0")]


def _loaders(spark, d, sources):
    return [E.Loader(name, lambda s, wanted, where=where: bars(s, d, "1h", where)) for name, where in sources]


@query(cascade_sql(THREE) + f", grid as (select symbol, unnest(range({FROM_US}, {TO_US}, {H})) as open_us from r) select symbol, open_us, close, coalesce(_data_source, 'NONE') as _data_source from grid left join u using (symbol, open_us)")
def get_data_three_sources(spark, d):
    got = E.Engine(spark, _loaders(spark, d, THREE)).get_data(ranges(spark, d), "1h")
    return got.select("symbol", "open_us", "close", F.coalesce(S.SOURCE, F.lit("NONE")).alias(S.SOURCE))


@query(cascade_sql(FEW, regular=False) + " select symbol, open_us, close, _data_source from u")
def get_data_irregular(spark, d):
    return E.Engine(spark, _loaders(spark, d, FEW), E.Config(regular=False)).get_data(ranges(spark, d), "1h").select("symbol", "open_us", "close", S.SOURCE)


@query(f"select symbol, open_us, close from ({bars_sql(H, PICK['VISION'])})")
def get_data_enforced_source(spark, d):
    engine = E.Engine(spark, _loaders(spark, d, THREE), E.Config(regular=False, with_source=False))
    return engine.get_data(ranges(spark, d), "1h", enforce_source="VISION").select("symbol", "open_us", "close")


@query(f"""with b as ({bars_sql()}), s as (select unnest(['click', 'view']) as symbol) select s.symbol, o.open_us, b.close from s, (select unnest(range({D10}, {D10 + 3 * DAY}, {H})) as open_us) o left join b on b.symbol = s.symbol and b.open_us = o.open_us""")
def fetch_market_data(spark, d):
    df, _, n = E.Engine(spark, [E.Loader("REST", lambda s, w: bars(s, d))]).fetch_market_data(["click", "view"], "1h", D10, now_us=TO_US)
    if n != df.count():
        raise ValueError("the count isn't that of the rows")
    return df.select("symbol", "open_us", "close")


@query(f"with {RANGES_SQL}, b as ({bars_sql(H, SPARSE)}), {segments_sql(1, 'b', 'r', int(H * 1.1), 2 * H)} select symbol, start_us, end_us from seg1")
def missing_segments_strict(spark, d):
    return G.missing_segments(bars(spark, d, "1h", SPARSE), ranges(spark, d), H, G.STRICT)


# cache -------------------------------------------------------------------------------------


def _cached(spark, d, where: str = SPARSE) -> str:
    path = f"{_url(spark)}/cache"
    b = S.with_source(bars(spark, d, "1h", where), "REST").withColumns({"market": F.lit("spot"), "interval": F.lit("1h")})
    Q.write(b, path, merge=False)
    return path


_RANGE = {"market": "spot", "interval": "1h", "start_us": D10, "end_us": D20}
_CACHED_SQL = f"b as (select * from ({bars_sql(H, SPARSE)}) where open_us >= {D10} and open_us < {D20})"


@query(f"with {_CACHED_SQL} select symbol, open_us, close, 'CACHE' as _data_source from b where symbol in ('click', 'view')")
def cache_round_trip(spark, d):
    return Q.scan(spark, _cached(spark, d), **_RANGE, symbols=["click", "view"], columns=["close"])


@query(f"select {ROUNDED} from ({bars_sql(H, SPARSE)}) where open_us between {D10} and {D20}")
def cache_scan_closed(spark, d):
    return rounded(Q.scan(spark, _cached(spark, d), **_RANGE, closed=True))


_D_RANGES_SQL = f"rr as (select distinct event_type as symbol, {D10} as from_us, {D20} as to_us from events)"


@query(f"with b as ({bars_sql(H, SPARSE)}), {_D_RANGES_SQL}, {segments_sql(1, 'b', 'rr', int(H * 1.1), 2 * H)} select symbol, start_us, end_us from seg1")
def cache_scan_missing(spark, d):
    wanted = ranges(spark, d).withColumns({"from_us": F.lit(D10), "to_us": F.lit(D20)})
    return Q.scan_missing(spark, _cached(spark, d), wanted, H, **_RANGE)[1]


_BAD = f"(day_us // {DAY}) % 5 = 0"


@query(f"with {_CACHED_SQL} select symbol, open_us from (select *, (open_us // {DAY}) * {DAY} as day_us from b) where not ({_BAD})")
def cache_scan_valid(spark, d):
    cat = C.of_table(bars(spark, d, "1h", SPARSE))
    bad = C.invalidate(cat, cat.filter(F.floor(F.col("day_us") / DAY) % 5 == 0), "damaged")
    return Q.scan_valid(spark, _cached(spark, d), bad, **_RANGE).select("symbol", "open_us")


@query(f"with {_CACHED_SQL} select symbol, open_us from (select *, (open_us // {DAY}) * {DAY} as day_us from b) where (day_us // {DAY}) % 3 <> 0")
def cache_scan_catalogued(spark, d):
    cat = C.of_table(bars(spark, d, "1h", SPARSE)).filter(F.floor(F.col("day_us") / DAY) % 3 != 0)
    return Q.scan_catalogued(spark, _cached(spark, d), cat, **_RANGE).select("symbol", "open_us")


@query(f"""select symbol, open_us, close from (select *, 0 as f from ({bars_sql(H, SPARSE)}) union all select *, 1 from ({bars_sql(H, 'event_id % 3 = 0')}) where (open_us // {DAY}) % 2 = 0)
    qualify row_number() over (partition by symbol, open_us order by f desc) = 1""")
def cache_merge_days(spark, d):
    """A second write of half of the days is merged with what they hold."""
    path = _cached(spark, d)
    more = bars(spark, d, "1h", "event_id % 3 = 0").filter(F.floor(F.col("open_us") / DAY) % 2 == 0)
    Q.write(S.with_source(more, "REST").withColumns({"market": F.lit("spot"), "interval": F.lit("1h")}), path)
    return Q.scan(spark, path, "spot", "1h", FROM_US, TO_US).select("symbol", "open_us", "close")


@query(f"select symbol, count(*) as rows, 0::bigint as duplicates, 0::bigint as null_times, true as is_unique, true as equal from ({bars_sql(H, SPARSE)}) group by symbol")
def cache_report(spark, d):
    held = Q.scan(spark, _cached(spark, d), "spot", "1h", FROM_US, TO_US)
    return V.cache_report(held, bars(spark, d, "1h", SPARSE))


# catalogue ---------------------------------------------------------------------------------


@query(f"select symbol, (open_us // {DAY}) * {DAY} as day_us, count(*) as num_records, min(open_us) as first_us, max(open_us) as last_us from ({bars_sql(H, SPARSE)}) group by 1, 2")
def catalog_of_bars(spark, d):
    path = f"{_url(spark)}/catalog"
    for _ in range(2):  # entered twice, there once
        table = C.with_metadata(C.of_table(bars(spark, d, "1h", SPARSE)), path)
    return table.read().drop("version")


@query(f"""with e as (select event_type as symbol, (epoch_us(ts) // {DAY}) * {DAY} as day_us, event_id as version, user_id as num_records from events)
    select symbol, day_us, version, num_records from e qualify row_number() over (partition by symbol, day_us order by version desc) = 1""")
def catalog_upserts_on_disk(spark, d):
    """Entries in three parts, the latest ones first and some twice: the latest of each day stays, on disk and through versions."""
    table = C.kept(spark, f"{_url(spark)}/catalog")
    e = read(spark, d, "events").select(F.col("event_type").alias("symbol"), I.day_us(I.micros(F.col("ts"))).alias("day_us"), F.col("event_id").alias("version"), F.col("user_id").alias("num_records"), F.lit(0).cast("long").alias("first_us"), F.lit(0).cast("long").alias("last_us"))
    for days in (f"day_us >= {D20}", f"day_us < {D20} and day_us >= {D10 - 2 * DAY}", f"day_us < {D10}"):
        table.upsert(e.filter(days))
    table.forget(1)
    return table.read().select("symbol", "day_us", "version", "num_records")


_INGEST_SQL = f"b as (select *, (open_us // {DAY}) * {DAY} as day_us from ({bars_sql()})), days as (select symbol, day_us, count(*) as num_records, min(open_us) as first_us, max(open_us) as last_us from b group by 1, 2)"
_SPOILED = f"symbol = 'view' and day_us % {5 * DAY} = {2 * DAY}"


@query(f"""with {_INGEST_SQL} select 'entry' as kind, symbol, day_us, num_records, first_us, last_us from days where not ({_SPOILED})
    union all select 'checksum', symbol, day_us, -1, -1, -1 from days where {_SPOILED}
    union all select 'no data', symbol, day_us, -1, -1, -1 from (select symbol, unnest(range({FROM_US}, {TO_US}, {DAY})) as day_us from (select distinct symbol from b)) anti join days using (symbol, day_us)""")
def catalog_ingest(spark, d):
    """Daily files to the cache and the catalogue in two steps of other ranges; files with a wrong checksum and missing ones are told."""
    base = _url(spark)
    url = _zipped(spark, d, spoiled=_SPOILED)
    table, failed = C.kept(spark, f"{base}/catalog"), []
    fetch = lambda wanted: remote.fetch_days(wanted, url, "1h")
    write = lambda b: Q.write(S.with_source(b.withColumnRenamed("count", "trades").select("symbol", "interval", "open_us", "open", "high", "low", "close", "volume", "trades"), "VISION").withColumn("market", F.lit("spot")), f"{base}/cache")
    for n, to in enumerate((D20, TO_US)):
        wanted = ranges(spark, d).withColumn("to_us", F.lit(to))
        failed.append(C.ingest(table, wanted, fetch, write, n)[1])
    in_cache = Q.scan(spark, f"{base}/cache", "spot", "1h", FROM_US, TO_US)
    entries = table.read().select(F.lit("entry").alias("kind"), "symbol", "day_us", "num_records", "first_us", "last_us").join(C.of_table(in_cache), ["symbol", "day_us", "num_records", "first_us", "last_us"], "left_semi")
    none = F.lit(-1).cast("long")
    lost = failed[0].unionByName(failed[1]).distinct().select(F.col("reason").alias("kind"), "symbol", "day_us", none.alias("num_records"), none.alias("first_us"), none.alias("last_us"))
    return entries.unionByName(lost)


_DAYS_SQL = f"cat as (select event_type as symbol, (epoch_us(ts) // {DAY}) * {DAY} as day_us, count(*) as num_records from events where {HELD_DAYS} group by 1, 2)"


def _days(spark, d):
    return ticks(spark, d, HELD_DAYS).groupBy("symbol", I.day_us(I.micros(F.col("ts"))).alias("day_us")).agg(F.count("*").alias("num_records"))


@query(f"with {_DAYS_SQL} select symbol, '1h' as interval, strftime(make_timestamp(day_us), '%Y-%m-%d') as day, num_records, num_records * 80 as file_size, symbol || '/1h' as path from cat")
def catalog_from_json(spark, d):
    entry = F.struct("num_records", (F.col("num_records") * 80).alias("file_size"), F.concat("symbol", F.lit("/1h")).alias("path"))
    day = F.date_format(F.timestamp_micros("day_us"), "yyyy-MM-dd")
    nested = _days(spark, d).groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct(day, entry))).alias("m"))
    docs = nested.select(F.to_json(F.create_map("symbol", F.create_map(F.lit("1h"), "m"))).alias("json"))
    return C.flatten_metadata(docs).withColumn("day", F.col("day").cast("string"))


@query(f"with {_DAYS_SQL} select symbol, day_us, num_records, {_BAD} as is_invalid, case when {_BAD} then 'damaged' end as reason from cat")
def catalog_invalidate(spark, d):
    cat = _days(spark, d)
    return C.invalidate(cat, cat.filter(F.floor(F.col("day_us") / DAY) % 5 == 0), "damaged")


@query(f"with {_DAYS_SQL}, {RANGES_SQL}, days as (select symbol, unnest(range({FROM_US}, {TO_US}, {DAY})) as day_us from r) select symbol, day_us, num_records is not null as available from days left join cat using (symbol, day_us)")
def catalog_availability(spark, d):
    return C.availability(_days(spark, d), ranges(spark, d))


@query("select case event_id % 4 when 0 then 'um' when 1 then 'cm' when 2 then 'spot' else 'unknown' end as market, count(*) as entries, sum(user_id)::bigint as records from events group by 1")
def catalog_by_market(spark, d):
    m = F.element_at(F.array(*[F.lit(x) for x in ("um", "cm", "spot", "other")]), (F.col("event_id") % 4 + 1).cast("int"))
    return C.by_market(read(spark, d, "events").select(F.concat_ws("/", F.lit("root"), m, F.lit("x")).alias("path"), F.col("user_id").alias("num_records")))


@query(f"select '1h' as interval, count(*) as days, sum(n)::bigint as records from (select count(*) as n from ({bars_sql()}) group by symbol, open_us // {DAY}) union all select '4h', count(*), sum(n)::bigint from (select count(*) as n from ({bars_sql(4 * H)}) group by symbol, open_us // {DAY})")
def catalog_by_interval(spark, d):
    of = lambda i: C.of_table(bars(spark, d, i)).withColumn("interval", F.lit(i))
    return C.by_interval(of("1h").unionByName(of("4h")))


@query(f"with {_DAYS_SQL} select symbol, coalesce(max(case when day_us <= {D20} and day_us > {D20 - 2 * DAY} then day_us end), -1) as latest_us, max(case when day_us <= {D20} and day_us > {D20 - 2 * DAY} then day_us end) is null as terminated from cat where symbol <> 'click' or day_us < {D10} group by symbol")
def catalog_latest_within(spark, d):
    return _told(C.latest_within(_days(spark, d).filter((F.col("symbol") != "click") | (F.col("day_us") < D10)), D20, 2), "latest_us")


@query("select event_id, event_type as symbol from events where event_id % 3 <> 0 and event_type = 'click' and event_id % 2 = 0")
def catalog_failures(spark, d):
    e = read(spark, d, "events")
    actual = F.when(e.event_id % 3 == 0, F.lit("abc")).when(e.event_id % 3 == 1, F.lit("abd"))
    interval = F.when(e.event_id % 2 == 0, "1h").otherwise("1m")
    reg = e.select("event_id", e.event_type.alias("symbol"), interval.alias("interval"), F.lit("abc").alias("expected_checksum"), actual.alias("actual_checksum"))
    return C.failures(reg, "click", "1h").select("event_id", "symbol")


@query(f"with {_DAYS_SQL} select symbol, day_us, num_records from cat where num_records > 1 and (day_us // {DAY}) % 4 <> 0")
def catalog_sound_entries(spark, d):
    cat = _days(spark, d).withColumn("num_records", F.col("num_records") - 1).withColumn("day_us", F.when(F.floor(F.col("day_us") / DAY) % 4 != 0, F.col("day_us")))
    return C.sound_entries(cat).withColumn("num_records", F.col("num_records") + 1)


@query(f"with {_DAYS_SQL}, b as (select *, (open_us // {DAY}) * {DAY} as day_us from ({bars_sql()})), held as (select * from cat where not ({_BAD})) select symbol, day_us, count(*) as num_records, min(open_us) as first_us, max(open_us) as last_us from b anti join held using (symbol, day_us) group by 1, 2")
def catalog_incremental_build(spark, d):
    """Only days that the catalogue lacks are loaded, written and catalogued."""
    path = f"{_url(spark)}/built"
    load = lambda days: bars(spark, d).withColumn("day_us", I.day_us(F.col("open_us"))).join(days, ["symbol", "day_us"], "left_semi").drop("day_us")
    held = _days(spark, d).filter(F.floor(F.col("day_us") / DAY) % 5 != 0)
    new = C.build(held, ranges(spark, d), load, lambda b: b.write.parquet(path))
    return new.join(C.of_table(spark.read.parquet(path)).select("symbol", "day_us"), ["symbol", "day_us"])


@query("select event_type as symbol, count(distinct strftime(ts, '%Y-%m-%d')) as days, string_agg(distinct case event_id % 2 when 0 then '1h' else '1m' end, ',' order by case event_id % 2 when 0 then '1h' else '1m' end) as intervals from events group by 1")
def distinct_lists(spark, d):
    e = read(spark, d, "events").select(F.col("event_type").alias("symbol"), F.when(F.col("event_id") % 2 == 0, "1h").otherwise("1m").alias("interval"), F.col("ts").cast("date").alias("day"))
    return U.interval_lists(e).join(e.groupBy("symbol").agg(F.count_distinct("day").alias("days")), "symbol")


# files and sources ---------------------------------------------------------------------------


def _zipped(spark, d, where: str = "true", spoiled: str = "false") -> str:
    """Daily zipped files of hourly bars: milliseconds on even days, microseconds on odd ones, with a header and a bad row each. Checksums of spoiled ones (a condition on ``symbol, day_us``) are wrong."""
    url = f"{_url(spark)}/daily"
    b = bars(spark, d, "1h", where)
    t = F.when(F.floor(F.col("open_us") / DAY) % 2 == 0, F.floor(F.col("open_us") / 1000).cast("long")).otherwise(F.col("open_us")).cast("string")
    row = F.concat_ws(",", t, "open", "high", "low", "close", "volume", t, F.lit("1"), "trades", F.lit("1"), F.lit("1"), F.lit("0"))
    day = F.date_format(F.timestamp_micros("open_us"), "yyyy-MM-dd")
    lines = b.groupBy("symbol", day.alias("day")).agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("text"))  # a day of a symbol
    head = F.lit("open_time,open,high,low,close,volume,a,b,c,d,e,f\nbad,1,1,1,1,1,1,1,1,1,1,1\n")
    name = F.concat_ws("-", F.concat_ws("/", "symbol", F.lit("1h"), "symbol"), F.lit("1h"), F.concat("day", F.lit(".zip")))
    said = F.when(F.expr(spoiled), F.repeat(F.lit("0"), 64)).alias("said")
    lines = lines.withColumn("day_us", F.unix_micros(F.to_timestamp("day", "yyyy-MM-dd")))
    remote.write_files(lines.select(name.alias("name"), F.concat(head, "text").alias("content"), said), url, zipped=True)
    remote.register(spark)
    return url


def _bulk(spark, d, where: str = "true") -> DataFrame:
    return spark.read.format("barloom_bulk").options(path=_zipped(spark, d, where), interval="1h").load().where(f"open_us >= {FROM_US} and open_us < {TO_US}")


@query(f"select symbol, open_us, open, close, trades as count, true as checksum_ok from ({bars_sql()})")
def bulk_source(spark, d):
    return _bulk(spark, d).select("symbol", "open_us", "open", "close", "count", "checksum_ok")


@query(f"select symbol, open_us, close, trades as count from ({bars_sql()}) where symbol in ('click', 'view') and open_us > {D10} and open_us <= {D20} and trades >= 1 and close > 50")
def bulk_source_where(spark, d):
    """A plain ``where``: symbols and times choose the files, the price is compared by Spark."""
    df = spark.read.format("barloom_bulk").options(path=_zipped(spark, d), interval="1h").load()
    return df.where(f"symbol in ('click', 'view') and open_us > {D10} and open_us <= {D20} and close > 50").select("symbol", "open_us", "close", "count")


#: Other ranges for each symbol: a day for each letter of its name, then a pause, then a day more.
_OWN_SQL = f"own as (select distinct event_type as symbol, {D10} as start_us, {D10} + length(event_type) * {DAY} as end_us from events union select distinct event_type, {D20}, {D20 + DAY} from events)"


def _own_ranges(spark, d) -> DataFrame:
    s = ranges(spark, d).select("symbol")
    first = s.select("symbol", F.lit(D10).alias("start_us"), (F.lit(D10) + F.length("symbol") * DAY).alias("end_us"))
    return first.unionByName(s.select("symbol", F.lit(D20).alias("start_us"), F.lit(D20 + DAY).alias("end_us")))


@query(f"with {_OWN_SQL} select b.symbol, open_us, close, trades as count from ({bars_sql()}) b join own on b.symbol = own.symbol and open_us >= start_us and open_us < end_us")
def bulk_ranges_by_symbol(spark, d):
    return remote.fetch_days(_own_ranges(spark, d), _zipped(spark, d), "1h", task_bytes=1_000).select("symbol", "open_us", "close", "count")


@query(f"""with b as ({bars_sql(H, SPARSE)}), e as ({bars_sql(H)}), g as (select symbol, open_us as start_us, nxt as end_us from (select symbol, open_us, lead(open_us) over (partition by symbol order by open_us) as nxt from b)
      where nxt - open_us > case when open_us // {DAY} = nxt // {DAY} then {int(H * 1.3)} else {int(H * 2.5)} end),
    n as (select symbol, start_us - {H // 2} as f, end_us + {H // 2} as t from g where start_us % {DAY} = 0 or end_us % {DAY} = 0),
    w as (select * from e where exists (select 1 from n where n.symbol = e.symbol and e.open_us between f and t)),
    u as (select *, 0 as k from b union all select *, 1 as k from w) select symbol, open_us, close from u qualify row_number() over (partition by symbol, open_us order by k) = 1""")
def bulk_source_boundary_fill(spark, d):
    """Daily files, their gaps, and the bars that another source has where a gap touches midnight."""
    bulk = cut(_bulk(spark, d, SPARSE).select("symbol", "open_us", "close"))
    return M.boundary_fill(bulk, bars(spark, d).select("symbol", "open_us", "close"), G.detect(bulk, H), H)


@query("select event_type as symbol, 2 * count(distinct strftime(ts, '%Y-%m-%d')) as files, min(strftime(ts, '%Y-%m-%d')) as earliest_day from events group by 1")
def file_health(spark, d):
    h = C.health(C.of_files(spark, _zipped(spark, d)))
    return h.select(F.regexp_extract("folder", "([^/]+)/1h$", 1).alias("symbol"), "files", F.col("earliest_day").cast("string").alias("earliest_day"))


@query("select r_name, sha256(r_name) as actual, r_regionkey % 2 = 0 as matches from region")
def file_checksums(spark, d):
    url = f"{_url(spark)}/sums"
    regions = read(spark, d, "region")
    remote.write_files(regions.select(F.concat(F.lit("r"), "r_regionkey").alias("name"), F.col("r_name").alias("content")), url)
    said = F.when(F.col("r_regionkey") % 2 == 0, F.upper(F.sha2("r_name", 256))).otherwise(F.lit("0"))
    files = C.verified(spark, url, spark.createDataFrame([], "path string, checksum string")).select("path", "actual")
    got = files.withColumn("k", F.regexp_extract("path", "r([0-9]+)$", 1).cast("long"))
    expected = got.join(regions.select(F.col("r_regionkey").cast("long").alias("k"), said.alias("checksum")), "k").select("path", "checksum")
    both = C.verified(spark, url, expected).withColumn("k", F.regexp_extract("path", "r([0-9]+)$", 1).cast("long"))
    return both.join(regions.select(F.col("r_regionkey").cast("long").alias("k"), "r_name"), "k").select("r_name", "actual", "matches")


def _pages(spark, d, hyphen: bool = False, refused: str = "false", where: str = "true") -> str:
    """Answers of 12-element arrays a day, each with the first row of the next day again; or of 9-element arrays, newest first. Days that are refused (a condition on ``symbol, day``) answer with a limit."""
    url = f"{_url(spark)}/pages"
    b = bars(spark, d, "1h", where)
    ms = F.floor(F.col("open_us") / 1000).cast("long")
    values = [ms, *[F.col(c) for c in ("open", "high", "low", "close", "volume")], *[F.lit(1)] * (3 if hyphen else 6)]
    row = F.array(*[v.cast("string") for v in values])
    again = F.when(F.col("open_us") % DAY == 0, F.array(I.day_us(F.col("open_us")), I.day_us(F.col("open_us")) - DAY)).otherwise(F.array(I.day_us(F.col("open_us"))))
    rows = b.select("symbol", "open_us", row.alias("r"), F.explode(again).alias("day"))
    g = rows.groupBy("symbol", "day").agg(F.min("open_us").alias("lo"), F.max("open_us").alias("hi"), F.sort_array(F.collect_list(F.struct("open_us", "r")), asc=not hyphen).alias("a"))
    folder = F.concat_ws("/", "symbol", F.lit("1H" if hyphen else "1h"))
    name = F.concat(folder, F.lit("/"), "lo", F.lit("-"), "hi", F.lit(".json"))
    content = F.when(F.expr(refused), F.lit('{"status": 429, "retry_after": 5}')).otherwise(F.to_json(F.transform("a", lambda x: x["r"])))
    remote.write_files(g.select(name.alias("name"), content.alias("content")), url)
    remote.register(spark)
    return url


def _paged(spark, url, **options) -> DataFrame:
    return spark.read.format("barloom_paged").options(path=url, symbols="click,view", interval="1h", page_rows=100, **options).load().select("symbol", "open_us", "open", "close")


@query(f"select symbol, open_us, open, close from ({bars_sql()}) where symbol in ('click', 'view') and open_us >= {D10} and open_us < {D20}")
def paged_source(spark, d):
    return _paged(spark, _pages(spark, d), start_us=D10, end_us=D20)


@query(f"select symbol, open_us, open, close from ({bars_sql()}) where symbol in ('click', 'view') and (open_us >= {FROM_US} and open_us < {FROM_US + DAY} or open_us >= {D10} and open_us < {D20})")
def paged_source_ranges(spark, d):
    return _paged(spark, _pages(spark, d), ranges=f"{FROM_US}-{FROM_US + DAY},{D10}-{D20}")


@query(f"select symbol, open_us, close from ({bars_sql()}) where symbol = 'click' and open_us >= {D10} and open_us < {D20} and close > 50")
def paged_source_where(spark, d):
    df = spark.read.format("barloom_paged").options(path=_pages(spark, d), interval="1h", page_rows=100).load()
    return df.where(f"symbol = 'click' and open_us >= {D10} and open_us < {D20} and close > 50").select("symbol", "open_us", "close")


@query(f"with {_OWN_SQL} select b.symbol, open_us, close from ({bars_sql()}) b join own on b.symbol = own.symbol and open_us >= start_us and open_us < end_us")
def paged_ranges_by_symbol(spark, d):
    return remote.fetch_pages(_own_ranges(spark, d), _pages(spark, d), "1h", page_rows=30, task_bytes=1_000).bars.select("symbol", "open_us", "close")


#: The limit is met on the day of the second range and on the third day of the first one, by symbols of other lengths.
_REFUSED = f"symbol = 'click' and day = {D20} or symbol = 'view' and day = {D10 + 2 * DAY}"
#: Pages of 30 hours from each range's start: the one that meets the refused day ends its range.
_LEFT_SQL = f"lf as (select symbol, {D20} as start_us, {D20 + DAY} as end_us from own where symbol = 'click' and start_us = {D20} union select symbol, start_us + {30 * H}, end_us from own where symbol = 'view' and start_us = {D10})"


@query(f"""with {_OWN_SQL}, {_LEFT_SQL}, b as ({bars_sql()}) select 'bar' as kind, b.symbol, open_us as start_us, open_us + {H} as end_us from b join own on b.symbol = own.symbol and open_us >= own.start_us and open_us < own.end_us
      where not exists (select 1 from lf where lf.symbol = b.symbol and lf.end_us = own.end_us and open_us >= lf.start_us)
    union all select 'left', symbol, start_us, end_us from lf""")
def paged_partial(spark, d):
    """Pages until a limit is met, and the ranges that are left."""
    got = remote.fetch_pages(_own_ranges(spark, d), _pages(spark, d, refused=_REFUSED), "1h", page_rows=30, task_bytes=1_000)
    bars_ = got.bars.select(F.lit("bar").alias("kind"), "symbol", F.col("open_us").alias("start_us"), (F.col("open_us") + H).alias("end_us"))
    return bars_.unionByName(got.left.select(F.lit("left").alias("kind"), "symbol", "start_us", "end_us"))


@query(f"""with {RANGES_SQL}, b as ({bars_sql()}), grid as (select symbol, unnest(range({D10}, {D20}, {H})) as open_us from r)
    select grid.symbol, grid.open_us, b.close, case when b.close is null then 'NONE' when grid.symbol = 'click' and grid.open_us >= {D10 + 100 * H} then 'VISION' else 'REST' end as _data_source from grid left join b using (symbol, open_us)""")
def get_data_partial(spark, d):
    """A source that meets a limit on the fifth day of one symbol; the next source is asked for the rest."""
    url = _pages(spark, d, refused=f"symbol = 'click' and day = {D10 + 5 * DAY}")
    asked = [E.Loader("REST", lambda s, wanted: remote.fetch_pages(wanted, url, "1h", page_rows=100)), E.Loader("VISION", lambda s, wanted: bars(s, d))]
    whole = ranges(spark, d).withColumns({"from_us": F.lit(D10), "to_us": F.lit(D20)})
    return E.Engine(spark, asked).get_data(whole, "1h").select("symbol", "open_us", "close", F.coalesce(S.SOURCE, F.lit("NONE")).alias(S.SOURCE))


@query(f"""with b as ({bars_sql()}), {RANGES_SQL}, grid as (select symbol, unnest(range({D10}, {D20}, {H})) as open_us from r)
    select symbol, open_us, last_value(close ignore nulls) over (partition by symbol order by open_us) as close, 'CACHE' as _data_source from grid left join b using (symbol, open_us)""")
def get_data_cache_hit(spark, d):
    """A cache that has every bar of the range: no other source is opened."""

    def asked(s, wanted):  # noqa: ANN001, ANN202
        raise ValueError("a source was asked though nothing is missing")

    whole = ranges(spark, d).withColumns({"from_us": F.lit(D10), "to_us": F.lit(D20)})
    full = R.reindex(bars(spark, d).select("symbol", "open_us", "close"), whole, H, "forward")
    engine = E.Engine(spark, [E.Loader("CACHE", lambda s, wanted: full), E.Loader("REST", asked)])
    return engine.get_data(whole, "1h").select("symbol", "open_us", "close", S.SOURCE)


@query(f"select symbol, min(open_us) as first_us, true as few_pages from ({bars_sql()}) group by symbol")
def first_data_search(spark, d):
    """Where each symbol's data begins, from 400 days before: a few of the many pages are looked at."""
    early = ranges(spark, d).withColumn("from_us", F.col("from_us") - 400 * DAY)
    got = search.first_data(early, search.page_probe(_pages(spark, d), "1h"), "1h", page_rows=100)
    return got.select("symbol", "first_us", (F.col("pages_read") <= 2 * 8).alias("few_pages"))  # of 104 pages


@query(f"select symbol, min(open_us) as next_us from ({bars_sql()}) where open_us >= {D20} group by symbol")
def next_data_search(spark, d):
    """Where data goes on after a silence of ten days."""
    url = _pages(spark, d, where=f"ts < timestamp_micros({D10}) or ts >= timestamp_micros({D20})")
    gap = ranges(spark, d).withColumn("from_us", F.lit(D10))
    return search.first_data(gap, search.page_probe(url, "1h"), "1h", page_rows=50).select("symbol", F.col("first_us").alias("next_us"))


@query(f"select symbol, open_us, open, close from ({bars_sql()}) where symbol in ('click', 'view') and open_us >= {D10} and open_us < {D20}")
def paged_source_newest_first(spark, d):
    return _paged(spark, _pages(spark, d, hyphen=True), start_us=D10, end_us=D20, style="hyphen")


_RATES_SQL = f"select event_type as symbol, (epoch_us(ts) // {8 * H}) * {8 * H} as funding_us, round(avg(value) / 1000, 6) as funding_rate from events where event_type in ('click', 'view') group by 1, 2"


def _rates(spark, d) -> DataFrame:
    t = ticks(spark, d, "event_type in ('click', 'view')").withColumn("funding_us", I.floor_us(I.micros(F.col("ts")), 8 * H))
    return t.groupBy("symbol", "funding_us").agg(F.round(F.avg("price") / 1000, 6).alias("funding_rate"))


def _funding_files(spark, d) -> DataFrame:
    url = f"{_url(spark)}/funding"
    entry = F.struct(F.floor(F.col("funding_us") / 1000).cast("long").alias("fundingTime"), F.col("funding_rate").cast("string").alias("fundingRate"))
    g = _rates(spark, d).groupBy("symbol", I.day_us(F.col("funding_us")).alias("day")).agg(F.to_json(F.collect_list(entry)).alias("content"))
    remote.write_files(g.select(F.concat("symbol", F.lit("/"), "day", F.lit(".json")).alias("name"), "content"), url)
    remote.register(spark)
    return spark.read.format("barloom_funding").options(path=url, symbols="click,view", start_us=D10, end_us=D20).load()


@query(f"select symbol, funding_us, funding_rate from ({_RATES_SQL}) where funding_us between {D10} and {D20}")
def funding_source(spark, d):
    return _funding_files(spark, d)


@query(f"select symbol, funding_us, funding_rate, case when (funding_us // {DAY}) % 2 = 0 then 'CACHE' else 'REST' end as _data_source from ({_RATES_SQL}) where funding_us between {D10} and {D20}")
def funding_cached(spark, d):
    held = _rates(spark, d).filter(F.floor(F.col("funding_us") / DAY) % 2 == 0)
    return E.Engine(spark, []).get_funding(K.USDM, lambda s, wanted: _funding_files(s, d), D10, D20, held)


@query(f"select symbol, funding_us, funding_rate, 'CACHE' as _data_source from ({_RATES_SQL}) where funding_us >= {D10} and funding_us < {D20} and symbol = 'click'")
def funding_cache_hit(spark, d):
    """A cache that has the whole range: the source isn't asked."""

    def asked(s, wanted):  # noqa: ANN001, ANN202
        raise ValueError("the source was asked")

    full = R.reindex(_rates(spark, d).filter("symbol = 'click'").withColumn("told", F.lit(True)), spark.createDataFrame([("click", D10, D20)], "symbol string, from_us long, to_us long"), 8 * H, time="funding_us")
    got = E.Engine(spark, []).get_funding(K.USDM, asked, D10, D20 - 1, full)
    return got.filter("told").select("symbol", "funding_us", "funding_rate", S.SOURCE)


# the live path -------------------------------------------------------------------------------


@query("select event_type as symbol, '1m' as interval, epoch_us(ts) // 1000 * 1000 as open_us, value as close, event_id % 2 = 0 as is_closed from events where event_id % 5 <> 0 and event_id % 7 <> 0")
def update_messages(spark, d):
    """Kline messages among others and broken ones."""
    e = read(spark, d, "events")
    ms = F.floor(I.micros(F.col("ts")) / 1000).cast("long")
    k = F.to_json(F.struct(F.lit("kline").alias("e"), F.struct(ms.alias("t"), ms.alias("T"), F.col("event_type").alias("s"), F.lit("1m").alias("i"), *[F.col("value").cast("string").alias(x) for x in "ohlcv"], (F.col("event_id") % 2 == 0).alias("x")).alias("k")))
    text = F.when(F.col("event_id") % 5 == 0, F.lit('{"e":"trade","k":{"t":1}}')).when(F.col("event_id") % 7 == 0, F.lit("{broken")).otherwise(k)
    return live.parse_messages(e.select(text.alias("value"))).select("symbol", "interval", "open_us", "close", "is_closed")


_LIVE_SQL = f"lv as (select symbol, open_us, close from ({bars_sql(H, SPARSE)}) where open_us // {H} % 10 <> 0)"
_LIVE_GAPS_SQL = f"gp as (select symbol, prev + {H} as start_us, least(open_us, prev + {4 * H}) as end_us from (select symbol, open_us, lag(open_us) over (partition by symbol order by open_us) as prev from lv) where open_us - prev > {H})"


def _reconciled(spark, d) -> DataFrame:
    from barloom.queries import _replayed

    return cut(_replayed(spark, d, lambda s: live.reconcile(live.gate(s), live.StreamConfig(most=4, tell_duplicates=True))))


@query(f"""with {_LIVE_SQL}, {_LIVE_GAPS_SQL}, h as ({bars_sql()}), f as (select symbol, open_us, close, 'REST' as _data_source from h where exists (select 1 from gp where gp.symbol = h.symbol and open_us >= start_us and open_us < end_us))
    select * from f anti join lv using (symbol, open_us) union all select *, 'STREAMING' from lv""")
def stream_backfill(spark, d):
    return live.backfill(_reconciled(spark, d), bars(spark, d), H).select("symbol", "open_us", "close", S.SOURCE)


@query(f"with {_LIVE_SQL}, {_LIVE_GAPS_SQL} select symbol, '1h' as interval, (select count(*) from lv l where l.symbol = s.symbol) as bars, (select count(*) from lv l where l.symbol = s.symbol and open_us % {2 * H} = 0) as duplicates, (select count(*) from gp where gp.symbol = s.symbol) as gaps, coalesce((select sum((end_us - start_us) // {H}) from gp where gp.symbol = s.symbol), 0)::bigint as to_fill from (select distinct symbol from lv) s")
def stream_counters(spark, d):
    return live.counters(_reconciled(spark, d))


@query(f"""with {_LIVE_SQL}, {_LIVE_GAPS_SQL}, h as ({bars_sql()}), n as (select gp.symbol, start_us, end_us, count(h.open_us) as n from gp left join h on h.symbol = gp.symbol and h.open_us >= start_us and h.open_us < end_us group by 1, 2, 3)
    select symbol, count(*) as asked, count(*) filter (n * {H} >= end_us - start_us) as filled, count(*) filter (n * {H} < end_us - start_us) as failed, sum(n)::bigint as backfilled from n group by symbol""")
def stream_outcome(spark, d):
    return live.outcome(_reconciled(spark, d), bars(spark, d), H)


#: Bars of hours that aren't told live at first come late, after what was missing has been filled.
_LATE_SQL = f"lt as (select symbol, open_us, close from ({bars_sql(H, SPARSE)}) where open_us // {H} % 10 = 0)"


def _late_stream(spark, d, sink) -> str:  # noqa: ANN001
    """Runs a stream of live bars and, after them, late ones through a :class:`live.Backfiller`; gives the folder of what it remembers."""
    base = _url(spark)
    late = F.floor(F.col("open_us") / H) % 10 == 0
    b = bars(spark, d, "1h", SPARSE).select("symbol", F.lit("1h").alias("interval"), "open_us", (F.col("open_us") + H - 1).alias("close_us"), "open", "high", "low", "close", F.round("volume", 6).alias("volume"), F.lit(True).alias("is_closed"))
    for part in (b.filter(~late), b.filter(late)):
        part.repartition(2, "symbol").write.mode("append").parquet(f"{base}/in")
    history = cut(bars(spark, d).withColumn("volume", F.round("volume", 6)))
    stream = spark.readStream.schema(b.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    run = live.Backfiller(history, H, sink, f"{base}/kept")
    live.reconcile(live.gate(stream), live.StreamConfig(most=4)).writeStream.foreachBatch(run).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return f"{base}/kept"


_LATE_GAPS_SQL = _LIVE_GAPS_SQL + f", f as (select h.symbol, h.open_us, h.close from ({bars_sql()}) h where exists (select 1 from gp where gp.symbol = h.symbol and open_us >= start_us and open_us < end_us))"


#: Late bars after the last live one show gaps of their own.
_TAIL_SQL = f"""tl as (select lt.symbol, lt.open_us, coalesce(lag(lt.open_us) over (partition by lt.symbol order by lt.open_us), m) as prev from lt join (select symbol, max(open_us) as m from lv group by 1) using (symbol) where lt.open_us > m),
    f2 as (select h.symbol, h.open_us, h.close from ({bars_sql()}) h where exists (select 1 from tl where tl.symbol = h.symbol and tl.open_us - prev > {H} and h.open_us > prev and h.open_us < least(tl.open_us, prev + {4 * H})))"""


@query(f"""with {_LIVE_SQL}, {_LATE_SQL}, {_LATE_GAPS_SQL}, {_TAIL_SQL}
    select symbol, open_us, close, 'STREAMING' as _data_source from lv union all select symbol, open_us, close, 'REST' from f anti join lv using (symbol, open_us) union all select symbol, open_us, close, 'STREAMING' from lt anti join f using (symbol, open_us)
    union all select symbol, open_us, close, 'REST' from f2""")
def stream_backfill_once(spark, d):
    """Each bar comes out once: live, filled, or late where it hadn't been filled."""
    path = f"{_url(spark)}/out"
    _late_stream(spark, d, lambda df, n: df.select("symbol", "open_us", "close", S.SOURCE).write.mode("overwrite").parquet(f"{path}/batch={n}"))
    return spark.read.parquet(path).select("symbol", "open_us", "close", S.SOURCE)


@query(f"""with {_LIVE_SQL}, {_LATE_SQL}, {_LATE_GAPS_SQL}
    select symbol, count(*) as duplicates from lt semi join f using (symbol, open_us) group by symbol""")
def stream_late_copies(spark, d):
    """Late live copies of bars that had been filled: dropped and counted."""
    kept = _late_stream(spark, d, lambda df, n: df.count())
    return spark.read.parquet(f"{kept}/counters").groupBy("symbol").agg(F.sum("duplicates").alias("duplicates")).filter("duplicates > 0")


COOL = 6 * H


@query(f"""with recursive {_LIVE_SQL}, n as (select symbol, open_us, row_number() over (partition by symbol order by open_us) as rn from lv),
    st as (select symbol, rn, open_us as last, null::bigint as filled, null::bigint as s, null::bigint as u, null::bigint as gap_start_us, null::bigint as gap_end_us from n where rn = 1
      union all select symbol, rn, t, case when fire then t else filled end, case when not fire then s2 end, case when not fire then u2 end, case when fire then s2 end, case when fire then least(u2, s2 + {(4 - 1) * H}) end
      from (select *, s2 is not null and (filled is null or t - filled >= {COOL}) as fire from (select st.symbol, n.rn, n.open_us as t, filled, case when n.open_us - last > {H} then coalesce(s, last + {H}) else s end as s2, case when n.open_us - last > {H} then n.open_us else u end as u2
        from st join n on n.symbol = st.symbol and n.rn = st.rn + 1)))
    select symbol, last as open_us, gap_start_us, gap_end_us from st where gap_start_us is not null""")
def stream_cooldown(spark, d):
    """Gaps told no sooner than six hours after the one before; those between are kept and told as one."""
    from barloom.queries import _replayed

    got = _replayed(spark, d, lambda s: live.reconcile(live.gate(s), live.StreamConfig(most=4, cooldown_us=COOL)))
    return got.filter("kind = 'gap'").select("symbol", "open_us", "gap_start_us", "gap_end_us")


@query(f"""with b as (select * from ({bars_sql(H, SPARSE)}) where symbol in ('click', 'view')), p as (select symbol, open_us, lag(open_us) over (partition by symbol order by open_us) as prev from b), gp as (select symbol, prev + {H} as s, least(open_us, prev + {4 * H}) as e from p where open_us - prev > {H}),
    f as (select symbol, open_us, close from ({bars_sql()}) h where exists (select 1 from gp where gp.symbol = h.symbol and open_us >= s and open_us < e))
    select symbol, open_us, close, 'STREAMING' as _data_source from b union all select symbol, open_us, close, 'REST' from f anti join b using (symbol, open_us)""")
def stream_session(spark, d):
    """A session of two symbols among others: messages of files, gated, reconciled and backfilled, each batch handed to a sink."""
    base = _url(spark)
    b = bars(spark, d, "1h", SPARSE)
    ms = F.floor(F.col("open_us") / 1000).cast("long")
    k = F.struct(ms.alias("t"), (ms + 3_599_999).alias("T"), F.col("symbol").alias("s"), F.lit("1h").alias("i"), *[F.col(c).cast("string").alias(c[0]) for c in ("open", "high", "low", "close", "volume")], F.lit(True).alias("x"))
    lines = b.groupBy("symbol").agg(F.array_join(F.sort_array(F.collect_list(F.to_json(F.struct(F.lit("kline").alias("e"), k.alias("k"))))), "\n").alias("content"))  # a symbol of the test tables
    remote.write_files(lines.select(F.concat("symbol", F.lit(".jsonl")).alias("name"), "content"), f"{base}/messages")
    remote.register(spark)
    engine = E.Engine(spark, [])
    stream = engine.create_stream(K.SPOT, ["click", "view"], f"{base}/messages", live.StreamConfig(most=4, cooldown_us=0))
    engine.run_stream(stream, bars(spark, d), "1h", lambda df, n: df.select("symbol", "open_us", "close", S.SOURCE).write.mode("overwrite").parquet(f"{base}/out/batch={n}"), f"{base}/state")
    return spark.read.parquet(f"{base}/out").select("symbol", "open_us", "close", S.SOURCE)


SILENT = 4 * DAY
#: One symbol ends, one is silent for ten days; files are of three days each.
_HEARD = f"(event_type <> 'click' or ts < timestamp '2024-01-20') and (event_type <> 'view' or ts < timestamp '2024-01-10' or ts >= timestamp '2024-01-20')"


@query(f"""with b as ({bars_sql(H, _HEARD)}), n as (select symbol, open_us, coalesce(lead(open_us) over (partition by symbol order by open_us), (select max(open_us) from b)) as nxt from b)
    select symbol, '1h' as interval, open_us as last_us, open_us + {H} as start_us, open_us + {SILENT} as silent_at_us from n where nxt - open_us > {SILENT}""")
def stream_silences(spark, d):
    """Series that say nothing for four days, told by a timer when the other series have passed that time."""
    live.needs_timers(spark)
    base = _url(spark)
    b = bars(spark, d, "1h", _HEARD).select("symbol", F.lit("1h").alias("interval"), "open_us")
    for i in range((TO_US - FROM_US) // (3 * DAY)):  # in the order of time: a file is a micro-batch
        b.filter((F.col("open_us") >= FROM_US + 3 * i * DAY) & (F.col("open_us") < FROM_US + 3 * (i + 1) * DAY)).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(b.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    q = live.silences(stream, SILENT).writeStream.format("parquet").option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


# columns, times, symbols ----------------------------------------------------------------------


@query("select event_type as symbol, value as open, coalesce(case when event_id % 3 = 0 then null else value end, value * 2) as quote_asset_volume, event_id as count from events")
def canonical_projection(spark, d):
    v = F.col("value")
    e = read(spark, d, "events").select("event_id", F.col("event_id").alias("count"), F.when(F.col("event_id") % 3 != 0, v).alias("quote_asset_volume"), (v * 2).alias("quote_volume"), v.alias("open"), F.col("event_type").alias("symbol"), F.lit("x").alias(S.SOURCE))
    return S.canonical(e, keep_source=False)


@query("select event_id, case when event_id % 4 = 0 then 'REST' else 'CACHE' end as _data_source from events")
def source_tag_only_missing(spark, d):
    e = read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 != 0, F.lit("CACHE")).alias(S.SOURCE))
    return S.with_source(e, "REST", only_missing=True)


@query("select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, round(value / 7, 4) as value from events")
def displayed_frame(spark, d):
    return S.displayed(read(spark, d, "events").select("event_id", "ts", (F.col("value") / 7).alias("value")))


@query("select event_type as symbol, epoch_us(ts) as open_us, event_id from events qualify row_number() over (partition by event_type, ts order by event_id) = 1")
def time_column_recovered(spark, d):
    """The column of time is found by its kind and name, and each time kept once."""
    e = read(spark, d, "events").select("event_id", F.col("event_type").alias("symbol"), F.col("ts").alias("tradeTime"))
    return M.keep_first(e.withColumnRenamed(S.time_column(e), "at"), ("symbol", "at"), ["event_id"]).select("symbol", I.micros(F.col("at")).alias("open_us"), "event_id")


@query("select event_id, case event_id % 4 when 0 then epoch_us(ts) // 1000000 * 1000000 when 1 then epoch_us(date_trunc('day', ts)) when 2 then epoch_us(ts) // 1000000 * 1000000 else -1 end as us from events")
def parsed_times(spark, d):
    text = lambda f: F.date_format("ts", f)
    k = F.col("event_id") % 4
    t = F.when(k == 0, text("yyyy-MM-dd HH:mm:ss")).when(k == 1, text("yyyy-MM-dd")).when(k == 2, text("yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.lit("no time"))
    return _told(read(spark, d, "events").select("event_id", I.micros(TS.parse_time(t)).alias("us")), "us")


@query(f"select event_id, (epoch_us(ts) // {DAY}) * {DAY} as start_us, (epoch_us(ts) // {DAY}) * {DAY} + {2 * DAY - 1} as end_us from events")
def full_days(spark, d):
    us = I.micros(F.col("ts"))
    s, e = I.full_days(us, us + DAY)
    return read(spark, d, "events").select("event_id", s.alias("start_us"), e.alias("end_us"))


_NAMES = ("1s", "1m", "3m", "5m", "15m", "30m", "1h", "2h", "4h", "6h", "8h", "12h", "1d", "3d", "1w", "1M")
_SECONDS = (1, 60, 180, 300, 900, 1_800, 3_600, 7_200, 14_400, 21_600, 28_800, 43_200, 86_400, 259_200, 604_800, 2_592_000)
_LONG = {"s": "second", "m": "MINUTE", "h": "Hour", "d": "DAY", "w": "WEEK", "M": "MONTH"}
#: Short names, long ones and others, one for each event by its number.
_SAID = [*_NAMES, *(f"{_LONG[n[-1]]}_{n[:-1]}" for n in _NAMES), "2m", "HOUR_3", ""]


@query("with names as (select * from (values " + ", ".join(f"({i}, '{said}', " + (f"'{_NAMES[i % 16]}', {_SECONDS[i % 16]}000000, '{','.join(_NAMES[: i % 16])}', {86_400 // _SECONDS[i % 16]}" if i < 32 else "null, -1, 'none', 0") + ")" for i, said in enumerate(_SAID)) + f""") t(i, said, name, us, smaller, per_day))
    select event_id, said, name, us, smaller, per_day::bigint as per_day, case when event_id % 1100 between 1 and 1000 then (event_id % 1100) * case event_id % 7 when 0 then 1 when 1 then 60 when 2 then 3600 when 3 then 86400 when 4 then 604800 when 5 then 2592000 else 31536000 end * 1000000 else -1 end as free_us
    from events join names on event_id % {len(_SAID)} = i""")
def interval_rules(spark, d):
    """Names of intervals in a table: short, long and unknown ones, lengths, smaller ones, rows a day; and free intervals."""
    pick = lambda texts, n: F.element_at(F.array(*map(F.lit, texts)), (F.col("event_id") % n + 1).cast("int"))
    e = read(spark, d, "events").select("event_id", pick(_SAID, len(_SAID)).alias("said"), F.concat((F.col("event_id") % 1_100).cast("string"), pick("smhdwMy", 7)).alias("free"))
    name = I.parsed_interval(F.col("said"))
    e = e.select("event_id", "said", name.alias("name"), I.interval_us_of(name).alias("us"), F.coalesce(F.array_join(I.smaller_of(name), ","), F.lit("none")).alias("smaller"), I.rows_per_day_of(name).cast("long").alias("per_day"), I.free_us_of(F.col("free")).cast("long").alias("free_us"))
    return _told(e, "us", "free_us")


_S, _E = f"case when event_id % 3 <> 0 then epoch_us(ts) end", f"case when event_id % 4 <> 0 then epoch_us(ts) + (event_id % 9 - 2) * {DAY} end"


@query(f"""with q as (select event_id, {_S} as s, {_E} as e from events), v as (select event_id, coalesce(e, s + {3 * DAY}, {TO_US}) as en, s, e from q), u as (select event_id, coalesce(s, en - {3 * DAY}) as st, en from v)
    select event_id, case when st < en then st // {H} * {H} else -1 end as from_us, case when st < en then greatest(en // {H} * {H}, st // {H} * {H} + {H}) else -1 end as to_us from u""")
def range_resolver(spark, d):
    us = I.micros(F.col("ts"))
    q = read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, us).alias("start_us"), F.when(F.col("event_id") % 4 != 0, us + (F.col("event_id") % 9 - 2) * DAY).alias("end_us"))
    return _told(I.resolved(q, TO_US, H).select("event_id", "from_us", "to_us"), "from_us", "to_us")


@query(f"""with q as (select event_id, {_S} as s, {_E} as e from events), v as (select event_id, coalesce(e, s + {3 * DAY}, {TO_US}) as en, s, e from q), u as (select *, coalesce(s, en - {3 * DAY}) as st from v),
    w as (select *, strftime(make_timestamp(st // {H} * {H}), '%Y-%m-%d') as f, strftime(make_timestamp(greatest(en // {H} * {H}, st // {H} * {H} + {H})), '%Y-%m-%d') as t from u)
    select event_id, case when st >= en then null when s is not null and e is not null then 'from ' || f || ' to ' || t || ', as given' when e is not null then '3 days back from ' || t when s is not null then '3 days on from ' || f else '3 days back from now' end as said from w""")
def range_descriptions(spark, d):
    us = I.micros(F.col("ts"))
    q = read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, us).alias("start_us"), F.when(F.col("event_id") % 4 != 0, us + (F.col("event_id") % 9 - 2) * DAY).alias("end_us"))
    r = I.resolved(q, TO_US, H)
    return r.select("event_id", I.described(*[F.col(c) for c in ("start_us", "end_us", "from_us", "to_us")]).alias("said"))


_Q = "(USDT|USDC|USD|BTC|ETH)$"


@query(f"""select c_custkey, case when not regexp_matches(symbol, '{_Q}') then symbol || '-USDT' else regexp_replace(symbol, '{_Q}', '') || '-USD-SWAP' end as swap,
    case when length(symbol) >= 6 and regexp_matches(symbol, '(USDT|BUSD|USDC)$') then left(symbol, length(symbol) - 4) || '-' || right(symbol, 4) when length(symbol) >= 4 and regexp_matches(symbol, '(BTC|ETH|USD)$') then left(symbol, length(symbol) - 3) || '-' || right(symbol, 3)
      when length(symbol) > 4 then left(symbol, length(symbol) - 4) || '-' || right(symbol, 4) else symbol end as spot,
    case when symbol like '%USDT' then regexp_replace(symbol, 'USDT$', '-USD-SWAP') else symbol end as um, symbol as cm,
    case c_custkey % 4 when 0 then '1H' when 1 then '1m' when 2 then '1D' end as interval from ({_SYMBOL_SQL})""")
def symbol_formats_hyphen(spark, d):
    s, k = F.col("symbol"), F.col("c_custkey") % 4
    interval = K.hyphen_interval(F.when(k == 0, "1h").when(k == 1, "1m").when(k == 2, "1d").otherwise("8h"))
    return _symbols(spark, d).select("c_custkey", K.hyphenated(s, K.USDM).alias("swap"), *[K.format_symbol(s, m, "hyphen").alias(m) for m in (K.SPOT, K.USDM, K.COINM)], interval.alias("interval"))


_M = "case c_custkey % 5 when 0 then 'spot' when 1 then 'um' when 2 then 'cm' when 3 then 'options' end"


@query(f"""select c_custkey, {_M} as market, case c_custkey % 5 when 1 then 'https://x.example/fapi/v1/klines' when 2 then 'https://x.example/dapi/v1/klines' when 3 then 'https://x.example/eapi/v1/klines' else 'https://x.example/api/v3/klines' end as url,
    upper('spot/' || symbol || '/1h') as key, regexp_matches(symbol, '_') as dated, regexp_replace(c_name, '[^ -~]', '', 'g') as name from (select c_custkey, symbol, c_name from ({_SYMBOL_SQL}) join customer using (c_custkey))""")
def market_addresses(spark, d):
    raw = F.element_at(F.array(*[F.lit(x) for x in ("SPOT", "FUTURES_USDT", "Coin", "options", "what")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    c = _symbols(spark, d).join(read(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey").withColumn("market", K.market_of(raw))
    name = K.printable(F.concat("c_name", F.lit("é\x07")))
    return c.select("c_custkey", "market", K.endpoint(F.col("market"), "klines", "https://x.example").alias("url"), K.cache_key(F.lit("spot"), F.col("symbol"), F.lit("1h")).alias("key"), F.col("symbol").contains("_").alias("dated"), name.alias("name"))


@query("select c_custkey, c_custkey % 3 <> 0 as safe from customer")
def safe_symbols(spark, d):
    s = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("../"), "c_name")).otherwise(F.upper(F.regexp_replace("c_name", "[^A-Za-z0-9]", "_")))
    return read(spark, d, "customer").select("c_custkey", K.is_safe_symbol(s).alias("safe"))


@query(f"select c_custkey, symbol from ({_SYMBOL_SQL}) where regexp_matches(symbol, '(_PERP|_240329)$')")
def suffix_filter(spark, d):
    return U.with_suffix(_symbols(spark, d), ("_PERP", "_240329"))


# checks --------------------------------------------------------------------------------------


@query("select event_id, event_id % 3 = 0 as off from events")
def close_time_check(spark, d):
    us = I.floor_us(I.micros(F.col("ts")), H)
    close = us + H - 1000 + F.when(F.col("event_id") % 3 == 0, 200_000).otherwise(50_000)
    return read(spark, d, "events").select("event_id", V.close_time_off(us, close, H).alias("off"))


@query("""select event_type as symbol, count(*) as rows, (count(*) filter (event_id % 5 = 0) + count(*) filter (event_id % 7 = 0))::bigint as bad_values, 0::bigint as duplicates,
    count(*) filter (event_id % 5 = 0) + count(*) filter (event_id % 7 = 0) = 0 as sound from events group by 1""")
def kline_check(spark, d):
    e = read(spark, d, "events").select(F.col("event_type").alias("symbol"), F.col("event_id").alias("open_us"), F.col("event_id").alias("i"), F.col("value").alias("v"))
    text = F.when(F.col("i") % 5 == 0, "x").otherwise(F.col("v").cast("string"))
    return V.kline_problems(e.withColumns({"open": text, "high": F.when(F.col("i") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("v")), "low": F.col("v"), "close": F.col("v"), "volume": F.col("v")}))


@query(f"""with b as (select * from ({bars_sql(H, SPARSE)}) where symbol <> 'click' or open_us < {TO_US - 5 * DAY}), {RANGES_SQL}, s as (select symbol, min(open_us) as lo, max(open_us) as hi from b group by symbol),
    p as (select symbol, from_us, to_us, hi, round((greatest(lo - from_us, 0) + greatest(to_us - hi, 0)) / (to_us - from_us)::double * 100, 6) as pct from r left join s using (symbol))
    select symbol, from_us, to_us, coalesce(pct, 100.0) as missing_pct, coalesce({TO_US} - hi <= {6 * DAY}, false) and coalesce(pct, 100.0) > 10 as warn from p""")
def recent_coverage(spark, d):
    b = bars(spark, d, "1h", SPARSE).filter((F.col("symbol") != "click") | (F.col("open_us") < TO_US - 5 * DAY))
    return V.recent_coverage(b, ranges(spark, d), TO_US, recent_us=6 * DAY)


_NOW = TO_US - 5 * DAY
_REQUEST_SQL = f"select event_id, case when event_id % 11 = 0 then '' when event_id % 13 = 0 then null else event_type end as symbol, epoch_us(ts) as s, epoch_us(ts) + (event_id % 5 - 1) * {DAY} as e from events"


@query(f"""select event_id, case when coalesce(symbol, '') = '' then 'empty symbol' when s >= e then 'start isn''t before end' when e > {_NOW} then 'the end is in the future' end as strict,
    case when coalesce(symbol, '') = '' then 'empty symbol' when s >= e then 'start isn''t before end' when s > {_NOW} then 'the start is in the future' end as cut_off,
    case when coalesce(symbol, '') = '' then 'empty symbol' when s >= e then 'start isn''t before end' end as allowed from ({_REQUEST_SQL})""")
def request_rules(spark, d):
    """Requests of a table, with a future end as an error, cut, and let be."""
    us, n = I.micros(F.col("ts")), F.col("event_id")
    q = read(spark, d, "events").select("event_id", F.when(n % 11 == 0, "").when(n % 13 != 0, F.col("event_type")).alias("symbol"), us.alias("s"), (us + (n % 5 - 1) * DAY).alias("e"))
    return q.select("event_id", *[V.request_problem(F.col("symbol"), F.col("s"), F.col("e"), _NOW, how).alias(name) for name, how in (("strict", "error"), ("cut_off", "truncate"), ("allowed", "allow"))])


@query("""select event_id, case when st in (418, 429) then 'RateLimited' when st >= 400 then 'BadStatus' when code is not null and code <> 0 then 'BadAnswer' end as error,
    case when st >= 400 then 'network_error' when code is not null and code <> 0 then 'data_integrity_error' end as kind, case when st in (418, 429) then false when st >= 400 or code is not null and code <> 0 then true end as again
    from (select event_id, case event_id % 7 when 0 then 429 when 1 then 418 when 2 then 500 when 3 then 404 else 200 end as st, case event_id % 3 when 0 then -1121 when 1 then 0 end as code from events)""")
def answer_errors(spark, d):
    """What answers with a status and a code come to, what kind of error that is, and whether a read is tried again."""
    n = F.col("event_id")
    status = F.when(n % 7 == 0, 429).when(n % 7 == 1, 418).when(n % 7 == 2, 500).when(n % 7 == 3, 404).otherwise(200)
    got = errors.answered(status, F.when(n % 3 == 0, -1121).when(n % 3 == 1, 0))
    return read(spark, d, "events").select("event_id", got.alias("a")).select("event_id", "a.error", "a.kind", "a.again")


@query("""select m as market, count(distinct c_custkey) as streams, any_value(case m when 'spot' then '1s' else '1m' end) as minimum_interval, any_value(case m when 'cm' then 'BTCUSD_PERP' else 'BTCUSDT' end) as default_symbol,
    count(distinct c_custkey) > any_value(case m when 'cm' then 200 else 1024 end) as too_many from (select c_custkey, case when c_custkey % 10 = 0 then 'spot' when c_custkey % 10 < 4 then 'um' else 'cm' end as m from customer) group by m""")
def subscription_check(spark, d):
    """Streams a market against what one connection may carry, with the market's least interval and default symbol."""
    n = F.col("c_custkey") % 10
    c = read(spark, d, "customer").select("c_custkey", F.when(n == 0, K.SPOT).when(n < 4, K.USDM).otherwise(K.COINM).alias("market"))
    g = c.groupBy("market").agg(F.count_distinct("c_custkey").alias("streams")).withColumn("f", K.market_facts(F.col("market")))
    return g.select("market", "streams", "f.minimum_interval", "f.default_symbol", (F.col("streams") > F.col("f.max_streams")).alias("too_many"))


@query(f"select symbol, count(*) as files, sum(n * 60)::bigint as bytes, count(*) filter (n * 60 < 1024) as corrupt, 0::bigint as stale, count(*) as stale_later from (select event_type as symbol, count(*) as n from events group by 1, epoch_us(ts) // {DAY}) group by 1")
def file_soundness(spark, d):
    """Sizes and ages of files by folder: too small ones, and old ones now and forty days later."""
    url = f"{_url(spark)}/plain"
    e = read(spark, d, "events").groupBy(F.col("event_type").alias("symbol"), F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").cast("int").alias("n"))
    remote.write_files(e.select(F.concat_ws("/", "symbol", F.concat("day", F.lit(".txt"))).alias("name"), F.repeat(F.lit("x"), F.col("n") * 60).alias("content")), url)
    later = C.health(C.of_files(spark, url, now=F.current_timestamp() + F.expr("interval 40 days"))).select("folder", F.col("stale").alias("stale_later"))
    h = C.health(C.of_files(spark, url)).join(later, "folder")
    return h.select(F.regexp_extract("folder", "([^/]+)$", 1).alias("symbol"), "files", "bytes", "corrupt", "stale", "stale_later")


# sets and order ------------------------------------------------------------------------------


@query(f"select symbol, open_us from ({bars_sql(H, PICK['VISION'])}) intersect select symbol, open_us from ({bars_sql(H, PICK['REST'])})")
def common_times(spark, d):
    return U.common_times([bars(spark, d, "1h", PICK["VISION"]), bars(spark, d, "1h", PICK["REST"])])


@query("select base, string_agg(frame, ',' order by frame) as frames from (select distinct c_nationkey as base, 'spot' as frame from customer where c_custkey % 2 = 0 union select distinct s_nationkey, 'um' from supplier union select n_nationkey, 'cm' from nation where n_regionkey < 3) group by base")
def union_of_keys(spark, d):
    from barloom.queries import _bases

    return U.union_of_keys(_bases(spark, d))


@query(f"select symbol, open_us, close, _data_source from (select *, row_number() over (partition by _data_source order by open_us, symbol) as n from (select *, 'VISION' as _data_source from ({bars_sql(H, PICK['VISION'])}) union all select *, 'REST' from ({bars_sql(H, PICK['REST'])}))) where n <= 3")
def first_rows_per_source(spark, d):
    b = M.diagonal_union([S.with_source(bars(spark, d, "1h", PICK[n]), n) for n in ("VISION", "REST")])
    return U.first_rows(b, S.SOURCE, ["open_us", "symbol"], 3).select("symbol", "open_us", "close", S.SOURCE)


@query(f"select symbol, open_us, row_number() over (partition by symbol order by open_us) as place from ({bars_sql()})")
def ordered_export(spark, d):
    """Bars written in order and read back: a row's place in its file is its place in time."""
    path = f"{_url(spark)}/export"
    Q.export_csv(bars(spark, d).select("symbol", "open_us", "close"), path)
    back = spark.read.schema("symbol string, open_us long, close double").option("header", "true").csv(path)
    row = F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("id"))
    from pyspark.sql import Window as W

    return back.withColumn("row", row).withColumn("place", F.row_number().over(W.partitionBy("symbol").orderBy("row")).cast("long")).select("symbol", "open_us", "place")
