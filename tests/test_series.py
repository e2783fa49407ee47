import math

import pytest
from pyspark.sql import functions as F

from barloom.functions import intervals as I
from barloom.functions import market as K
from barloom.functions import timestamps as TS
from barloom.operators import gaps as G
from barloom.operators import grid as R
from barloom.operators import merge as M
from barloom.operators import schema as S
from barloom.operators import validate as V
from barloom.plans import engine as E

H = 3_600_000_000
T0 = 1_705_276_800_000_000  # 2024-01-15


def series(spark, times, symbol="A", source=None, base=100.0):
    rows = [(symbol, T0 + int(t * H), base + t, base + t, 1.0) for t in times]
    df = spark.createDataFrame(rows, "symbol string, open_us long, open double, close double, volume double")
    return S.with_source(df, source) if source else df


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).orderBy(*columns).collect()]


def test_floor_and_ceil_for_all_intervals(spark):
    t = T0 + 5 * H + 1_800_000_000 + 7
    for name in I.INTERVAL_SECONDS:
        k = I.interval_us(name)
        r = spark.range(1).select(I.floor_us(F.lit(t), k).alias("f"), I.ceil_us(F.lit(t), k).alias("c"), I.ceil_us(F.lit(t - t % k), k).alias("same")).first()
        assert (r.f, r.c, r.same) == (t - t % k, t - t % k + k, t - t % k)


def test_weeks_start_on_thursday(spark):
    r = spark.range(1).select(I.ntz(I.floor_us(F.lit(T0), I.interval_us("1w"))).alias("t")).first().t
    assert r.isoformat() == "2024-01-11T00:00:00"


def test_align_keeps_one_interval(spark):
    s, e = I.align_us(F.lit(T0 + 10), F.lit(T0 + 20), H)
    assert tuple(spark.range(1).select(s, e).first()) == (T0, T0 + H)


def test_names_of_intervals():
    assert I.parse_interval("HOUR_1") == "1h" and I.parse_interval("x", "1m") == "1m"
    with pytest.raises(I.IntervalError):
        I.parse_interval("7q")
    assert I.smaller_intervals("3m") == ["1s", "1m"]
    assert I.expected_rows_per_day("1h") == 24 and I.expected_rows_per_day("q") == 0


def test_resolve_range():
    now = T0 + 100 * I.DAY
    assert I.resolve_range(None, None, None, now, H) == I.TimeRange(now - 3 * I.DAY, now)
    assert I.resolve_range(T0 + 5, None, 1, now, H) == I.TimeRange(T0, T0 + I.DAY)
    assert I.resolve_range(None, T0, 2, now, H).start_us == T0 - 2 * I.DAY
    assert I.resolve_range(T0, None, None, now) == I.TimeRange(T0, T0 + 3 * I.DAY)
    assert I.resolve_range(now - I.DAY, None, 3, now) == I.TimeRange(now - I.DAY, now + 2 * I.DAY)
    assert I.resolve_range(T0 + 5, T0 + 9, None, now) == I.TimeRange(T0 + 5, T0 + 9)
    with pytest.raises(ValueError):
        I.resolve_range(T0, T0, None, now)
    assert "back" in I.describe_range(I.TimeRange(T0, now), False, False) and "2024-01-15" in I.describe_range(I.TimeRange(T0, now), True, False)


def test_free_intervals():
    assert I.free_interval_us("7m") == 420_000_000 and I.free_interval_us("1000d") == 1000 * I.DAY and I.free_interval_us("2y") == 730 * I.DAY
    for bad in ("", "m", "0m", "1001s", "5q", "1.5h", "-1h"):
        with pytest.raises(I.IntervalError):
            I.free_interval_us(bad)


def test_long_ranges_are_cut_whole(spark):
    r = spark.createDataFrame([("A", T0, T0 + 2_500 * H)], "symbol string, start_us long, end_us long")
    c = I.chunks(r, H, 1)
    assert c.count() == 2_500 and c.agg(F.max("chunk_end_us")).first()[0] == T0 + 2_500 * H


def test_empty_ranges_have_no_chunks(spark):
    r = spark.createDataFrame([("A", T0, T0), ("B", T0, T0 + 3 * H)], "symbol string, start_us long, end_us long")
    assert values(I.chunks(r, H, 2), "symbol", "chunk_start_us", "chunk_end_us") == [("B", T0, T0 + 2 * H), ("B", T0 + 2 * H, T0 + 3 * H)]


def test_epoch_units_are_told_by_row(spark):
    df = spark.createDataFrame([(1705276800000,), (1705276800000000,), (12,), (None,)], "e long")
    assert {r[0]: r[1] for r in df.select("e", TS.epoch_us(F.col("e"))).collect()} == {1705276800000: T0, 1705276800000000: T0, 12: None, None: None}


def test_aliases_never_overwrite(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3)], "quote_volume double, quote_asset_volume double, Trades int")
    out = S.rename_aliases(df)
    assert out.columns == ["quote_volume", "quote_asset_volume", "count"]


def test_nan_is_null_and_bad_numbers_too(spark):
    df = spark.createDataFrame([(float("nan"), "x"), (1.0, "2")], "open double, close string")
    assert [tuple(r) for r in S.standardise(df).orderBy("open").collect()] == [(None, None), (1.0, 2.0)]


def test_merge_by_priority_and_arrival(spark):
    v, c, r = series(spark, [0, 1, 2], source="VISION"), series(spark, [1, 2], source="CACHE", base=200.0), series(spark, [2], source="REST", base=300.0)
    want = [(T0, "VISION"), (T0 + H, "CACHE"), (T0 + 2 * H, "REST")]
    for f in (M.priority_merge, M.priority_merge_by_max):
        assert values(f([r, c, v]), "open_us", S.SOURCE) == want
        twice = f([series(spark, [0], base=1.0), series(spark, [0], base=2.0)])
        assert values(twice, "open", S.SOURCE) == [(2.0, "UNKNOWN")]
        assert values(f([series(spark, [0, 0])]), "open_us") == [(T0,)]


def test_single_bar_missing_at_midnight(spark):
    """A step of two intervals across midnight is no gap with 1.0 or more, but an island."""
    df = series(spark, [22, 23, 25, 26])
    assert G.detect(df, H).count() == 0
    assert G.detect(df, H, (0.3, 0.9)).count() == 1
    r = spark.createDataFrame([("A", T0 + 22 * H, T0 + 27 * H)], "symbol string, from_us long, to_us long")
    assert values(G.missing_islands(df, r, H), "start_us", "end_us", "missing") == [(T0 + 24 * H, T0 + 25 * H, 1)]
    assert values(G.detect(series(spark, [22, 23, 26]), H), "missing_points", "crosses_day") == [(2, True)]


def test_gaps_of_one_and_no_rows(spark):
    assert G.detect(series(spark, [0]), H).count() == 0
    assert G.detect(series(spark, []), H).count() == 0


def test_missing_segments(spark):
    r = spark.createDataFrame([("A", T0, T0 + 20 * H), ("B", T0, T0 + 2 * H)], "symbol string, from_us long, to_us long")
    got = values(G.missing_segments(series(spark, [3, 4, 5, 10]), r, H), "symbol", "start_us", "end_us")
    assert got == [("A", T0, T0 + 3 * H), ("A", T0 + 6 * H, T0 + 20 * H), ("B", T0, T0 + 2 * H)]
    full = G.missing_segments(series(spark, [0, 1], "B"), r.filter("symbol = 'B'"), H)
    assert full.count() == 0


def test_coalescing_follows_the_reach(spark):
    x = [(0, 10), (1, 2), (12, 13), (16, 17)]
    df = spark.createDataFrame([("A", T0 + a * H, T0 + b * H) for a, b in x], "symbol string, start_us long, end_us long")
    assert values(G.coalesce_ranges(df, H), "start_us", "end_us") == [(T0, T0 + 13 * H), (T0 + 16 * H, T0 + 17 * H)]


def test_grid_is_half_open_for_all_intervals(spark):
    for name in ("1m", "1h", "1d", "3d", "1w", "1M"):
        k = I.interval_us(name)
        r = spark.createDataFrame([("A", T0, T0 + 5 * k), ("B", T0, T0)], "symbol string, from_us long, to_us long")
        assert values(G.grid(r, k), "open_us") == [(T0 + i * k,) for i in range(5)]


def test_fills(spark):
    r = spark.createDataFrame([("A", T0, T0 + 4 * H)], "symbol string, from_us long, to_us long")
    df = series(spark, [1, 3])
    assert values(R.reindex(df, r, H, "forward"), "open_us", "open")[0][1] is None
    assert [v for _, v in values(R.reindex(df, r, H, "forward"), "open_us", "open")][1:] == [101.0, 101.0, 103.0]
    assert [v for _, v in values(R.reindex(df, r, H, "backward"), "open_us", "open")] == [101.0, 101.0, 103.0, 103.0]
    with pytest.raises(ValueError):
        R.reindex(df, r, H, "sideways")


def test_symbols(spark):
    df = spark.createDataFrame([("BTCUSDT",), ("BTCUSD_PERP",), ("BTCUSD_240329",), ("1INCHUSDT",), ("ETHUSD",), ("BTC-USD-SWAP",), ("DOGEXYZ",), ("BTCBUSD",), ("bad!",)], "s string")
    s = F.col("s")
    got = {r[0]: tuple(r[1:]) for r in df.select("s", K.futures_symbol(s, K.COINM), K.hyphenated(s), K.hyphenated(s, K.USDM), K.hyphenated(s, K.COINM), K.base_symbol(s), K.is_safe_symbol(s)).collect()}
    assert got["BTCUSDT"] == ("BTCUSD_PERP", "BTC-USDT", "BTC-USD-SWAP", "BTC-USD-SWAP", "BTC", True)
    assert got["ETHUSD"][:2] == ("ETHUSD_PERP", "ETH-USD") and got["1INCHUSDT"][0] == "1INCHUSDT"
    assert got["BTCUSD_240329"][0] == "BTCUSD_240329" and got["BTCUSD_PERP"][4] == "BTC" and got["bad!"][5] is False
    assert got["BTC-USD-SWAP"][1:4] == ("BTC-USD-SWAP",) * 3 and got["DOGEXYZ"][1:3] == ("DOGEXYZ-USDT",) * 2
    shown = {r[0]: tuple(r[1:]) for r in df.select("s", *[K.format_symbol(s, m, "hyphen") for m in (K.SPOT, K.USDM, K.COINM)]).collect()}
    assert shown["BTCUSDT"] == ("BTC-USDT", "BTC-USD-SWAP", "BTCUSDT") and shown["BTCBUSD"][0] == "BTC-BUSD"
    assert shown["ETHUSD"] == ("ETH-USD", "ETHUSD", "ETHUSD") and shown["DOGEXYZ"][0] == "DOG-EXYZ" and shown["BTC-USD-SWAP"] == ("BTC-USD-SWAP",) * 3


def test_hyphen_intervals(spark):
    df = spark.createDataFrame([(x,) for x in ("1m", "1h", "1d", "1w", "1M", "1s", "8h", "3d")], "i string")
    assert [r[0] for r in df.select(K.hyphen_interval(F.col("i"))).collect()] == ["1m", "1H", "1D", "1W", "1M", None, None, None]


def test_requests_are_checked():
    assert V.check_request("A", 1, 10, 5, "truncate") == (1, 5)
    for bad in (("", 1, 2, 3), ("A", 2, 1, 3), ("A", 1, 9, 5)):
        with pytest.raises(V.ValidationError):
            V.check_request(*bad)


def test_prices_of_nan_count_as_missing(spark):
    df = spark.createDataFrame([("A", 1.0, 2.0, 0.5, 1.5, 1.0), ("A", math.nan, 2.0, 0.5, 1.5, -1.0)], "symbol string, open double, high double, low double, close double, volume double")
    r = V.ohlc_violations(df).first()
    assert (r.missing_prices, r.bad_volume) == (1, 1)


def test_cascade(spark):
    r = spark.createDataFrame([("A", T0, T0 + 6 * H)], "symbol string, from_us long, to_us long")
    cache = E.Loader("CACHE", lambda s, w: series(spark, [0, 1]))
    rest = E.Loader("REST", lambda s, w: series(spark, range(10), base=500.0))
    got = values(E.Engine(spark, [cache, rest]).get_data(r, "1h"), "open_us", S.SOURCE)
    assert got == [(T0 + i * H, "CACHE" if i < 2 else "REST") for i in range(6)]
    only = E.Engine(spark, [cache, rest]).get_data(r, "1h", enforce_source="CACHE")
    assert only.filter("open is null").count() == 4
    short = E.Engine(spark, [cache, rest], E.Config(regular=False)).get_data(r, "1h")
    assert short.count() == 2
    with pytest.raises(V.ValidationError):
        E.Engine(spark, [cache]).get_data(r, "1h", enforce_source="X")
    df, seconds, n = E.Engine(spark, [cache]).fetch_market_data(["A"], "1h", T0, T0 + 3 * H, now_us=T0 + 9 * H)
    assert n == 3 and seconds >= 0


def test_irregular_cascade_decides_by_symbol(spark):
    """The first source has A only: A stays as it is, B and C come from the second, C's rest from the third."""
    r = spark.createDataFrame([(x, T0, T0 + 6 * H) for x in "ABCD"], "symbol string, from_us long, to_us long")
    cache = E.Loader("CACHE", lambda s, w: series(s, [0, 1]))
    bulk = E.Loader("VISION", lambda s, w: series(s, range(6), "B").union(series(s, range(3), "C")).union(series(s, range(6), "A")))
    rest = E.Loader("REST", lambda s, w: series(s, range(6), "C").union(series(s, range(6), "A")))
    got = E.Engine(spark, [cache, bulk, rest], E.Config(regular=False)).get_data(r, "1h").groupBy("symbol", S.SOURCE).count()
    assert values(got, "symbol", S.SOURCE, "count") == [("A", "CACHE", 2), ("B", "VISION", 6), ("C", "REST", 3), ("C", "VISION", 3)]


def test_each_source_is_scanned_once(spark, tmp_path):
    """The plan reads each source once, however many there are."""
    r = spark.createDataFrame([("A", T0, T0 + 20 * H)], "symbol string, from_us long, to_us long")
    reads = []
    loaders = []
    for i in range(4):
        series(spark, range(i, 20, 4)).write.parquet(f"{tmp_path}/s{i}")
        loaders.append(E.Loader(f"S{i}", lambda s, w, i=i: reads.append(i) or s.read.parquet(f"{tmp_path}/s{i}")))
    for n in range(1, 5):
        reads.clear()
        df = E.Engine(spark, loaders[:n], E.Config(thresholds=G.STRICT)).get_data(r, "1h")
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert reads == list(range(n)) and plan.count("parquet") <= 5
        assert df.filter("open is null").count() == 20 - 5 * n


def test_segments_of_several_ranges_and_empty_keys(spark):
    df = series(spark, [0, 1, 5]).union(series(spark, [2], "B"))
    w = spark.createDataFrame([(x, T0, T0 + 8 * H) for x in "ABC"], "symbol string, from_us long, to_us long")
    got = values(G.missing_segments(df, w, H), "symbol", "start_us", "end_us")
    at = lambda s, a, b: (s, T0 + a * H, T0 + b * H)
    assert got == [at("A", 2, 8), at("B", 0, 8), at("C", 0, 8)]


def test_strict_filter(spark):
    df = series(spark, [0, 1])
    with pytest.raises(V.ValidationError):
        E.in_range(df, "open_us", F.lit(0), F.lit(1), strict=True)
    assert E.in_range(df, "open_us", F.lit(T0), F.lit(T0 + H)).count() == 1
    assert E.in_range(df, "open_us", F.lit(T0), F.lit(T0 + H), closed=True).count() == 2


def test_two_level_windows_equal_plain_ones(spark):
    """Buckets of three steps, several series, times that repeat and go below zero."""
    import random

    from pyspark.sql import Window as W

    from barloom.operators import runs

    random.seed(1)
    rows = [(s, random.randint(-40, 60) * H, random.choice([None, 1.0, 2.0, 3.0])) for s in "AB" for _ in range(60)]
    df = spark.createDataFrame(sorted(set(rows), key=repr), "symbol string, t long, v double").dropDuplicates(["symbol", "t"])
    w = W.partitionBy("symbol").orderBy("t")
    k = ("symbol",)
    assert values(runs.with_next(df, H, k, "t", size=3), "symbol", "t", "__next") == values(df.withColumn("n", F.lead("t").over(w)), "symbol", "t", "n")
    assert values(runs.with_prev(df, H, k, "t", size=3), "symbol", "t", "__prev") == values(df.withColumn("n", F.lag("t").over(w)), "symbol", "t", "n")
    for how, f in (("max", F.max), ("sum", F.sum)):
        for inclusive in (True, False):
            plain = df.withColumn("n", f("v").over(w.rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)))
            assert values(runs.with_running(df, H, k, "t", ["t"], "n", F.col("v"), how, inclusive, size=3), "symbol", "t", "n") == values(plain, "symbol", "t", "n")
    for forward, f in ((True, F.last("v", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))), (False, F.first("v", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)))):
        assert values(runs.filled(df, H, k, "t", ["v"], forward, size=3), "symbol", "t", "v") == values(df.withColumn("n", f), "symbol", "t", "n")
    full = spark.range(-20, 30).select(F.lit("A").alias("symbol"), (F.col("id") * H).alias("t"), F.col("id").cast("double").alias("v"))
    got = runs.with_context(full, H, k, "t", 2, size=3).withColumn("n", F.sum("v").over(W.partitionBy("symbol", "__bucket").orderBy("t").rowsBetween(-2, 0))).filter("not __copy")
    assert values(got, "t", "n") == values(full.withColumn("n", F.sum("v").over(w.rowsBetween(-2, 0))), "t", "n")


def test_common_keys_as_sets_and_multisets(spark):
    from barloom.operators import universe as U

    a, b = (spark.createDataFrame([(x,) for x in s], "base string") for s in ("AABC", "AABBD"))
    assert values(U.common([a, b]), "base") == [("A",), ("B",)]
    assert values(U.common([a, b], multiset=True), "base") == [("A",), ("A",), ("B",)]


def test_means_of_any_frame(spark):
    """Frames of a bucket and more against plain windows, with holes of value."""
    import random

    from pyspark.sql import Window as W

    rng, step = random.Random(2), 60_000_000
    rows = [(s, T0 + i * step, None if rng.random() < 0.01 else float(rng.randint(-50, 50))) for s in "AB" for i in range(900)]
    df = spark.createDataFrame(rows, "symbol string, open_us long, v double")
    for n in (1, 7, 64, 100, 333, 900, 2_000):
        w = W.partitionBy("symbol").orderBy("open_us").rowsBetween(-(n - 1), 0)
        plain = df.withColumn("m", F.when(F.count("v").over(w) == n, F.sum("v").over(w) / n))
        for long in (1, 64):
            got = R.moving_average(df, "v", n, step, "m", long=long) if n >= long else None
            if got is not None:
                assert sorted(map(tuple, got.select("symbol", "open_us", "m").collect()), key=str) == sorted(map(tuple, plain.select("symbol", "open_us", "m").collect()), key=str)


def test_islands_need_no_grid(spark, monkeypatch):
    bars = [("A", T0 + h * H) for h in (2, 3, 3, 7)] + [("A", T0 + 4 * H + 1), ("A", T0 - H), ("A", T0 + 10 * H), ("B", T0)]
    df = spark.createDataFrame(bars, "symbol string, open_us long")
    ranges = spark.createDataFrame([("A", T0, T0 + 10 * H), ("B", T0, T0 + H), ("C", T0, T0 + 3 * H - 1), ("D", T0, T0)], "symbol string, from_us long, to_us long")
    want = [("A", 0, 2, 2), ("A", 4, 7, 3), ("A", 8, 10, 2), ("C", 0, 3, 3)]
    for few in (10_000, 0):
        monkeypatch.setattr(G, "FEW_RANGES", few)
        got = G.missing_islands(df, ranges, H)
        assert sorted((r.symbol, (r.start_us - T0) // H, (r.end_us - T0) // H, r.missing) for r in got.collect()) == want
    monkeypatch.undo()
    assert "Generate" not in G.missing_islands(df, ranges, H)._jdf.queryExecution().executedPlan().toString()


def test_ranges_coalesce_alike_few_or_many(spark):
    import random

    rng = random.Random(4)
    rows = [(s, a := T0 + rng.randint(0, 400) * H, a + rng.randint(0, 30) * H) for s in "AB" for _ in range(60)]
    df = spark.createDataFrame(rows, "symbol string, start_us long, end_us long")
    few, many = (sorted(map(tuple, G.coalesce_ranges(df, H, few=n).select("symbol", "start_us", "end_us").collect())) for n in (1_000, 0))
    assert few == many


def test_requests_of_a_table_as_one_by_one(spark):
    from barloom.operators import validate as V

    rows = [(s, a, b) for s in (None, "", "A") for a in (1, 5, 9) for b in (None, 1, 4, 9)]
    df = spark.createDataFrame(rows, "s string, a long, b long")
    for how in ("error", "truncate", "allow"):
        for r in df.withColumn("p", V.request_problem(F.col("s"), F.col("a"), F.col("b"), 5, how)).filter("b is not null").collect():
            try:
                V.check_request(r.s, r.a, r.b, 5, how)
                assert r.p is None
            except V.ValidationError as e:
                assert r.p == str(e)
