import hashlib
import json
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.sources import cache, catalog, remote
from barloom.streaming import live

H = 3_600_000_000
T0 = 1_705_276_800_000_000
DAY = 86_400_000_000


def bars(spark, hours, source="REST", base=1.0):
    rows = [("spot", "A", "1h", T0 + h * H, base, base, base, base, 1.0, 1, source) for h in hours]
    return spark.createDataFrame(rows, "market string, symbol string, interval string, open_us long, open double, high double, low double, close double, volume double, trades long, _data_source string")


def test_cache_round_trip_prunes_and_merges(spark, tmp_path):
    path = str(tmp_path / "cache")
    cache.write(bars(spark, range(30)), path)
    cache.write(bars(spark, [3, 31], base=2.0), path)  # a fragment never replaces its day
    df = cache.scan(spark, path, "spot", "1h", T0, T0 + 2 * DAY)
    assert df.count() == 31
    assert df.filter(f"open_us = {T0 + 3 * H}").first().open == 2.0
    one = cache.scan(spark, path, "spot", "1h", T0, T0 + 5 * H, symbols=["A"], columns=["close"])
    assert one.columns == ["symbol", "open_us", "close", "_data_source"] and one.count() == 5
    assert "PartitionFilters: [isnotnull(market" in one._jdf.queryExecution().executedPlan().toString()
    assert cache.scan(spark, path, "spot", "1h", T0, T0 + 5 * H, closed=True).count() == 6
    cat = catalog.of_table(df.withColumn("file_size", F.lit(1)))
    assert {r.num_records for r in cat.collect()} == {24, 7}
    bad = catalog.invalidate(cat, cat.filter(f"day_us = {T0}"), "damaged")
    assert cache.scan_valid(spark, path, bad, market="spot", interval="1h", start_us=T0, end_us=T0 + 2 * DAY).count() == 7


def test_nested_metadata(spark):
    doc = json.dumps({"A": {"1h": {"2024-01-15": {"num_records": 24, "file_size": 9, "path": "p"}}}})
    got = catalog.flatten_metadata(spark.createDataFrame([(doc,)], "json string")).collect()
    assert [(r.symbol, r.interval, str(r.day), r.num_records) for r in got] == [("A", "1h", "2024-01-15", 24)]


def day_file(root, day, rows, header=False, checksum=None):
    d = root / "A" / "1h"
    d.mkdir(parents=True, exist_ok=True)
    text = ("open_time,open,high,low,close,volume,x,x,x,x,x,x\n" if header else "") + "".join(",".join(map(str, r)) + "\n" for r in rows)
    p = d / f"A-1h-{day}.zip"
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("a.csv", text)
    said = hashlib.sha256(p.read_bytes()).hexdigest() if checksum is None else checksum
    (d / f"{p.name}.CHECKSUM").write_text(f"{said}  {p.name}\n")


def row(us, unit):
    t = us if unit == "us" else us // 1000
    return [t, 1, 2, 0.5, 1.5, 10, t, 1, 7, 1, 1, 0]


def test_bulk_files(spark, tmp_path):
    day_file(tmp_path, "2024-01-15", [row(T0 + h * H, "ms") for h in range(24)], header=True)
    day_file(tmp_path, "2024-01-16", [row(T0 + DAY + h * H, "us") for h in range(24)] + [["bad"] + [0] * 11], checksum="0" * 64)
    remote.register(spark)
    o = {"path": tmp_path.as_uri(), "symbols": "A,B", "interval": "1h", "start_us": T0 + 2 * H, "end_us": T0 + 3 * DAY}
    df = spark.read.format("barloom_bulk").options(**o).load()
    assert df.count() == 46 and df.select("open_us").distinct().count() == 46
    assert df.filter("not checksum_ok").count() == 24
    with pytest.raises(Exception, match="checksum"):
        spark.read.format("barloom_bulk").options(**o, strict="true").load().count()


def test_pages(spark, tmp_path):
    d = tmp_path / "A" / "1h"
    d.mkdir(parents=True)
    rows = [[(T0 + h * H) // 1000, "1", "2", "0.5", "x", "1"] for h in range(10)]
    (d / "1.json").write_text(json.dumps(rows[:6]))
    (d / "2.json").write_text(json.dumps(rows[5:] + [["bad", 1, 1, 1, 1, 1]]))
    remote.register(spark)
    df = spark.read.format("barloom_paged").options(path=tmp_path.as_uri(), symbols="A,Z", interval="1h", start_us=T0, end_us=T0 + 8 * H, page_rows=3).load()
    assert sorted(r.open_us for r in df.collect()) == [T0 + h * H for h in range(8)]
    assert df.filter("close is not null").count() == 0


def message(h, closed=True, symbol="A"):
    t = (T0 + h * H) // 1000
    return json.dumps({"e": "kline", "s": symbol, "k": {"t": t, "T": t + 3_599_999, "s": symbol, "i": "1h", "o": "1", "c": "1", "h": "NaN", "l": "1", "v": "0", "x": closed}})


def test_update_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join([message(0), message(1, False), '{"e": "trade"}', "broken"]))
    (tmp_path / "in" / "b.jsonl").write_text("\n".join([message(1), message(5), message(5), message(2)]))
    remote.register(spark)
    s = spark.readStream.format("barloom_updates").option("path", (tmp_path / "in").as_uri()).load()
    q = live.reconcile(live.gate(s), live.StreamConfig(most=2)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    out = spark.read.parquet(str(tmp_path / "out"))
    bars_ = sorted((r.open_us - T0) // H for r in out.filter("kind = 'bar'").collect())
    assert bars_ == [0, 1, 2, 5]
    gaps = [((r.gap_start_us - T0) // H, (r.gap_end_us - T0) // H) for r in out.filter("kind = 'gap'").collect()]
    assert gaps == [(3, 4)]
    history = spark.createDataFrame([("A", T0 + h * H, 9.0, 9.0, 9.0, 9.0, 9.0) for h in range(8)], "symbol string, open_us long, open double, high double, low double, close double, volume double")
    filled = live.backfill(out, history, H)
    assert sorted((r.open_us - T0) // H for r in filled.filter("_data_source = 'REST'").collect()) == [3]
    c = live.counters(out).first()
    assert (c.bars, c.gaps, c.to_fill) == (4, 1, 1)
    seen = []
    live.to_table(history, H, lambda df, n: seen.append((n, df.count())))(out, 7)
    assert seen == [(7, 5)]


def test_messages_as_columns(spark):
    df = spark.createDataFrame([(message(0),), ('{"e":"x"}',), ("no",)], "value string")
    assert [(r.symbol, r.open_us, r.volume) for r in live.parse_messages(df).collect()] == [("A", T0, 0.0)]


def test_fifo_dedup():
    d = live.FifoDedup(2)
    assert [d.is_new(x) for x in (1, 2, 1, 3, 1)] == [True, True, False, True, True]
    assert len(d.held) == 2
    with pytest.raises(ValueError):
        live.StreamConfig(capacity=0)


def test_checksums_of_files(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"x" * 2000)
    uri = (tmp_path / "f").as_uri().replace("file://", "file:")
    expected = spark.createDataFrame(pd.DataFrame({"path": [uri], "checksum": [hashlib.sha256(b"x" * 2000).hexdigest()]}))
    assert [r.matches for r in catalog.verified(spark, str(tmp_path), expected).collect()] == [True]
    (tmp_path / "A-1h-2024-01-15.x").write_bytes(b"x")
    files = catalog.of_files(spark, str(tmp_path))
    assert sorted((str(r.day), r.corrupt, r.stale) for r in files.collect()) == [("2024-01-15", True, False), ("None", False, False)]
    h = catalog.health(files).first()
    assert (h.files, h.bytes, h.corrupt, str(h.earliest_day)) == (2, 2001, 1, "2024-01-15")


def test_catalogue_work(spark):
    r = spark.createDataFrame([("A", T0, T0 + 3 * DAY)], "symbol string, from_us long, to_us long")
    cat = spark.createDataFrame([("A", T0, 24), ("A", T0 + DAY, 0)], "symbol string, day_us long, num_records long")
    assert [x.num_records for x in catalog.sound_entries(cat).collect()] == [24]
    written = []
    new = catalog.build(cat, r, lambda days: days.select("symbol", F.col("day_us").alias("open_us")), lambda b: written.append(b.count()))
    assert written == [1] and [x.day_us for x in new.collect()] == [T0 + 2 * DAY]
    assert catalog.build(cat, r, lambda days: days.select("symbol", F.col("day_us").alias("open_us")), lambda b: None, force=True).count() == 3
    late = catalog.latest_within(cat, T0 + 2 * DAY, 2).first()
    assert late.latest_us == T0 + DAY and catalog.latest_within(cat, T0 + 50 * DAY).first().terminated
    reg = spark.createDataFrame([("A", "1h", "x", "y"), ("B", "1h", "x", "x"), ("B", "1m", "x", None)], "symbol string, interval string, expected_checksum string, actual_checksum string")
    assert catalog.failures(reg).count() == 2 and catalog.failures(reg, "B", "1m").count() == 1


def second(h, symbol="A"):
    t = T0 // 1000 + h * 1000
    return json.dumps({"e": "kline", "s": symbol, "k": {"t": t, "T": t + 999, "s": symbol, "i": "1s", "o": "1", "c": "1", "h": "1", "l": "1", "v": "0", "x": True}})


def test_gaps_within_the_cooldown_are_told_after_it(spark, tmp_path):
    """Gaps at 2 s and at 6 and 11 s; the latter two lie in the cooldown of 30 s and are told as one by the bar at 33 s."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(map(second, [0, 2, 3, 6, 7, 11, 12])))
    remote.register(spark)
    s = spark.readStream.format("barloom_updates").option("path", (tmp_path / "in").as_uri()).load()
    q = live.reconcile(live.gate(s)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    (tmp_path / "in" / "b.jsonl").write_text("\n".join(map(second, [13, 33])))
    q.processAllAvailable()
    q.stop()
    gaps = spark.read.parquet(str(tmp_path / "out")).filter("kind = 'gap'").collect()
    assert sorted(((r.gap_start_us - T0) // 1_000_000, (r.gap_end_us - T0) // 1_000_000) for r in gaps) == [(1, 2), (4, 33)]


def test_files_come_in_batches_and_late_ones_too(tmp_path):
    import os

    reader = remote.UpdateReader({"path": tmp_path.as_uri(), "files_per_batch": "2"})
    for i, name in enumerate("dcb"):
        (tmp_path / f"{name}.jsonl").write_text(message(i))
        os.utime(tmp_path / f"{name}.jsonl", (1_000 + i, 1_000 + i))
    ends = [reader.initialOffset(), reader.latestOffset(), reader.latestOffset()]
    (tmp_path / "a.jsonl").write_text(message(9))  # late, with the smallest name
    ends.append(reader.latestOffset())
    ends.append(reader.latestOffset())
    read = [[p.path.rpartition("/")[2] for p in reader.partitions(a, b) if p.path] for a, b in zip(ends, ends[1:], strict=False)]
    assert read == [["d.jsonl", "c.jsonl"], ["b.jsonl"], ["a.jsonl"], []]


def test_stream_api(spark, tmp_path):
    from barloom.plans import engine as E

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join([message(0), message(3), message(1, symbol="B")]))
    remote.register(spark)
    engine = E.Engine(spark, [])
    s = engine.create_stream("spot", ["A", "A"], (tmp_path / "in").as_uri())
    history = spark.createDataFrame([("A", T0 + h * H, 9.0, 9.0, 9.0, 9.0, 9.0) for h in range(8)], "symbol string, open_us long, open double, high double, low double, close double, volume double")
    seen = []
    engine.run_stream(s, history, "1h", lambda df, n: seen.extend((r.symbol, (r.open_us - T0) // H, r._data_source) for r in df.collect()), str(tmp_path / "cp"))
    assert sorted(seen) == [("A", 0, "STREAMING"), ("A", 1, "REST"), ("A", 2, "REST"), ("A", 3, "STREAMING")]
    with pytest.raises(ValueError):
        engine.create_stream("cm", [str(i) for i in range(201)], "x")
    with pytest.raises(E.ValidationError):
        engine.get_funding("spot", lambda s, wanted: history, 0, 1)


def test_loaders_by_name(spark):
    from barloom.plans import engine as E

    loader = E.Loader("mine", lambda s, w: None)
    E.register(loader)
    assert E.create(spark, "mine").loaders == [loader]
    for bad in (lambda: E.register(loader), lambda: E.create(spark, "other")):
        with pytest.raises(E.ValidationError):
            bad()
    del E.LOADERS["mine"]


# filters, ranges and limits of sources --------------------------------------------------------


def answers(root, symbol, hours, name, body=None):
    d = root / symbol / "1h"
    d.mkdir(parents=True, exist_ok=True)
    rows = [[(T0 + h * H) // 1000, "1", "2", "0.5", str(h), "1"] for h in hours]
    (d / f"{name}.json").write_text(json.dumps(rows if body is None else body))


def test_filters_choose_the_files(spark, tmp_path):
    """Files outside the filters can't be read, so opening one would fail."""
    for day in range(15, 19):
        day_file(tmp_path, f"2024-01-{day}", [row(T0 + (day - 15) * DAY + h * H, "us") for h in range(24)])
    for name in ("A-1h-2024-01-15.zip", "A-1h-2024-01-18.zip"):
        (tmp_path / "A" / "1h" / name).write_bytes(b"no zip")
    (tmp_path / "B" / "1h").mkdir(parents=True)
    (tmp_path / "B" / "1h" / "B-1h-2024-01-16.zip").write_bytes(b"no zip")
    remote.register(spark)
    df = spark.read.format("barloom_bulk").options(path=tmp_path.as_uri(), interval="1h").load()
    got = df.where(f"symbol = 'A' and open_us >= {T0 + DAY} and open_us < {T0 + 3 * DAY} and high > 1 and count = 7")
    assert got.count() == 48 and got.select(F.sum("volume")).first()[0] == 480.0
    assert df.where(f"symbol in ('A', 'C') and open_us = {T0 + DAY + 5 * H}").count() == 1
    assert df.where(f"symbol = 'A' and symbol = 'B' and open_us >= {T0}").count() == 0
    with pytest.raises(Exception, match="not a zip"):
        df.where(f"symbol = 'A' and open_us < {T0 + DAY}").count()


def test_pushed_filters_leave_the_rest(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, StringStartsWith

    r = remote.PagedReader({"path": tmp_path.as_uri(), "interval": "1h", "page_rows": "10"})
    others = [StringStartsWith(("symbol",), "A"), EqualTo(("interval",), "1h"), In(("open_us",), (1, 2))]
    assert list(r.pushFilters([In(("symbol",), ("A", "B")), EqualTo(("symbol",), "A"), GreaterThan(("open_us",), T0), LessThanOrEqual(("open_us",), T0 + 30 * H), *others])) == others
    assert (r.only, r.start, r.end) == ({"A"}, T0 + 1, T0 + 30 * H + 1)
    answers(tmp_path, "A", range(24), f"{T0}-{T0 + 23 * H}")
    answers(tmp_path, "A", range(24, 48), f"{T0 + 24 * H}-{T0 + 47 * H}")
    answers(tmp_path, "B", range(24), f"{T0}-{T0 + 23 * H}")
    pages = r.partitions()
    assert {p.symbol for p in pages} == {"A"} and sum(b.num_rows for p in pages for b in r.read(p)) == 30
    free = remote.PagedReader({"path": tmp_path.as_uri(), "interval": "1h", "page_rows": "10"})
    assert sum(b.num_rows for p in free.partitions() for b in free.read(p)) == 72


@pytest.mark.parametrize("task_bytes", [1, 1 << 30])
def test_a_limit_on_the_third_page(spark, tmp_path, task_bytes):
    """Two pages and the remaining range, whether one task asks for all pages or each for one."""
    for i in range(5):
        lo, hi = T0 + 10 * i * H, T0 + (10 * i + 9) * H
        answers(tmp_path, "A", range(10 * i, 10 * i + 10), f"{lo}-{hi}", {"status": 429, "retry_after": 5} if i == 2 else None)
        answers(tmp_path, "B", range(10 * i, 10 * i + 10), f"{lo}-{hi}")
    wanted = spark.createDataFrame([("A", T0, T0 + 50 * H), ("B", T0, T0 + 15 * H), ("B", T0 + 40 * H, T0 + 45 * H), ("C", T0, T0 + H), ("A", T0, T0)], "symbol string, start_us long, end_us long")
    got = remote.fetch_pages(wanted, tmp_path.as_uri(), "1h", page_rows=10, task_bytes=task_bytes)
    found = sorted((r.symbol, (r.open_us - T0) // H, r.close) for r in got.bars.collect())
    assert found == [("A", h, float(h)) for h in range(20)] + [("B", h, float(h)) for h in (*range(15), *range(40, 45))]
    assert [(r.symbol, (r.start_us - T0) // H, (r.end_us - T0) // H) for r in got.left.collect()] == [("A", 20, 50)]
    answers(tmp_path, "A", [], f"{T0 + 20 * H}-{T0 + 29 * H}", {"code": -1121})
    with pytest.raises(Exception, match="error code"):
        remote.fetch_pages(wanted, tmp_path.as_uri(), "1h", page_rows=10).bars.count()


def test_what_is_refused_goes_to_the_next_source(spark, tmp_path):
    from barloom.plans import engine as E

    answers(tmp_path, "A", range(10), f"{T0}-{T0 + 9 * H}")
    answers(tmp_path, "A", [], f"{T0 + 10 * H}-{T0 + 19 * H}", {"status": 418})
    asked = []
    other = spark.createDataFrame([("A", T0 + h * H, -1.0) for h in range(20)], "symbol string, open_us long, close double")

    def second(s, wanted):
        asked.extend(((r.start_us - T0) // H, (r.end_us - T0) // H) for r in wanted.collect())
        return other

    engine = E.Engine(spark, [E.Loader("REST", lambda s, w: remote.fetch_pages(w, tmp_path.as_uri(), "1h", page_rows=10)), E.Loader("VISION", second), E.Loader("CACHE", lambda s, w: 1 / 0)])
    ranges = spark.createDataFrame([("A", T0, T0 + 20 * H)], "symbol string, from_us long, to_us long")
    got = engine.get_data(ranges, "1h").collect()
    assert sorted(((r.open_us - T0) // H, r._data_source) for r in got) == [(h, "REST" if h < 10 else "VISION") for h in range(20)]
    assert asked == [(10, 20)] and [((r.start_us - T0) // H) for r in engine.left["REST"].collect()] == [10]


def test_a_full_cache_asks_no_other_source(spark):
    from barloom.plans import engine as E

    full = spark.createDataFrame([("A", T0 + h * H, 1.0) for h in range(24)], "symbol string, open_us long, close double")
    calls = []
    loaders = [E.Loader("CACHE", lambda s, w: calls.append("CACHE") or full), E.Loader("REST", lambda s, w: calls.append("REST") or full)]
    ranges = spark.createDataFrame([("A", T0, T0 + 24 * H)], "symbol string, from_us long, to_us long")
    assert E.Engine(spark, loaders).get_data(ranges, "1h").filter("_data_source = 'CACHE'").count() == 24 and calls == ["CACHE"]
    ranges = ranges.withColumn("to_us", F.col("to_us") + H)
    assert E.Engine(spark, loaders).get_data(ranges, "1h").count() == 25 and calls == ["CACHE", "CACHE", "REST"]


def test_days_of_a_table_of_ranges(spark, tmp_path):
    for day in (15, 16):
        day_file(tmp_path, f"2024-01-{day}", [row(T0 + (day - 15) * DAY + h * H, "ms") for h in range(24)], header=True)
    wanted = spark.createDataFrame([("A", T0 + 20 * H, T0 + 30 * H), ("A", T0 + 40 * H, T0 + 80 * H), ("B", T0, T0 + DAY)], "symbol string, start_us long, end_us long")
    got = remote.fetch_days(wanted, tmp_path.as_uri(), "1h", task_bytes=500)
    assert sorted((r.open_us - T0) // H for r in got.collect()) == [*range(20, 30), *range(40, 48)]


def test_searches_look_at_few_pages(spark, tmp_path):
    from barloom.sources import search

    for symbol, first in (("A", 0), ("B", 733), ("C", 999)):
        answers(tmp_path, symbol, range(first, 1_000), f"{T0 + first * H}-{T0 + 999 * H}")
    ranges = spark.createDataFrame([(s, T0, T0 + 1_000 * H) for s in "ABCZ"] + [("A2", T0, T0)], "symbol string, from_us long, to_us long")
    got = {r.symbol: r for r in search.first_data(ranges, search.page_probe(tmp_path.as_uri(), "1h"), "1h", page_rows=2).collect()}
    assert {s: r.first_us and (r.first_us - T0) // H for s, r in got.items()} == {"A": 0, "B": 733, "C": 999, "Z": None}
    assert got["A"].pages_read == 1 and max(r.pages_read for r in got.values()) <= 20  # of 500


# the catalogue on disk ------------------------------------------------------------------------


def test_upserts_are_whole_or_not_there(spark, tmp_path, monkeypatch):
    from barloom.sources import versions

    table = catalog.kept(spark, str(tmp_path / "c"))
    assert table.read().count() == 0 and table.versions() == []
    entry = lambda day, n, v: ("A", T0 + day * DAY, n, 0, 0, v)
    of = lambda rows: spark.createDataFrame(rows, catalog.KEPT)
    assert table.upsert(of([entry(0, 1, 1), entry(40, 1, 1)])) == 1
    assert table.upsert(of([entry(0, 1, 1), entry(40, 1, 1)])) == 2 and table.read().count() == 2  # twice counts once
    assert table.upsert(of([entry(0, 5, 0), entry(1, 2, 1), (None, None, 3, 0, 0, 1)])) == 3  # an older version of a day doesn't win
    assert sorted((r.symbol or "", r.num_records) for r in table.read().collect()) == [("", 3), ("A", 1), ("A", 1), ("A", 2)]
    before, after = table.parts(2), table.parts(3)
    assert set(after) == {"2024-01", "2024-02", "none"} and after["2024-02"] == before["2024-02"]  # a part without rows stays as it is
    assert table.read(1).count() == 2

    def die(self, number, text):
        raise OSError("the writer died")

    with monkeypatch.context() as m:
        m.setattr(versions.Versioned, "_put", die)
        with pytest.raises(OSError):
            table.upsert(of([entry(0, 99, 9)]))
    assert table.versions() == [1, 2, 3] and table.read().filter("num_records = 99").count() == 0
    with monkeypatch.context() as m:
        m.setattr(versions.Versioned, "versions", lambda self: [1, 2])
        with pytest.raises(versions.Conflict):
            table.upsert(of([entry(2, 7, 1)]))
    assert table.forget(1) > 0 and table.versions() == [3] and table.read().count() == 4


def test_one_step_from_files_to_cache_and_catalogue(spark, tmp_path):
    day_file(tmp_path / "in", "2024-01-15", [row(T0 + h * H, "ms") for h in range(24)])
    day_file(tmp_path / "in", "2024-01-16", [row(T0 + DAY + h * H, "ms") for h in range(24)], checksum="0" * 64)
    table, ranges = catalog.kept(spark, str(tmp_path / "c")), spark.createDataFrame([("A", T0, T0 + 3 * DAY)], "symbol string, from_us long, to_us long")
    written = []
    step = lambda: catalog.ingest(table, ranges, lambda w: remote.fetch_days(w, (tmp_path / "in").as_uri(), "1h"), lambda b: written.append(b.count()), 1)
    new, failed = step()
    assert [(r.day_us, r.num_records) for r in new.collect()] == [(T0, 24)] and written == [24]
    assert sorted(((r.day_us - T0) // DAY, r.reason) for r in failed.collect()) == [(1, "checksum"), (2, "no data")]
    assert step()[0].count() == 0 and table.read().count() == 1


def test_digests_in_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "CHUNK", 1_000)
    data = {"a": b"y" * 1_000, "b": b"x" * 999, "c": bytes(range(256)) * 100}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    got = {r.path.rpartition("/")[2]: (r.bytes, r.actual) for r in catalog.digests(spark, str(tmp_path)).collect()}
    assert got == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in data.items()}


# the live path --------------------------------------------------------------------------------


def plain_reconcile(batches, step, most, cooldown, capacity):
    """The same, bar by bar."""
    dedup, last, filled, start, until, out = live.FifoDedup(capacity), None, None, None, None, []
    for batch in batches:
        for t in sorted(batch):
            if not dedup.is_new(t):
                out.append(("duplicate", t))
                continue
            if last is not None and t - last > step:
                start, until = last + step if start is None else start, t
            if start is not None and (filled is None or t - filled >= cooldown):
                out.append(("gap", t, start, min(until, start + step * (most - 1))))
                filled, start, until = t, None, None
            out.append(("bar", t))
            last = t if last is None else max(last, t)
    return out


class State:
    def __init__(self):
        self.held = None

    exists = property(lambda self: self.held is not None)
    get = property(lambda self: self.held)

    def update(self, held):
        self.held = held


@pytest.mark.parametrize("capacity", [1_000, 7])
def test_reconcile_equals_bar_by_bar(spark, monkeypatch, capacity):
    import numpy as np

    taken = {}
    config = live.StreamConfig(most=3, cooldown_us=4 * H, capacity=capacity, tell_duplicates=True)
    fake = type("Df", (), {"groupBy": lambda self, *a: self, "applyInPandasWithState": lambda self, f, *a: taken.setdefault("run", f)})()
    live.reconcile(fake, config)
    rng = np.random.default_rng(1)
    for _ in range(60):
        batches = [[int(T0 + h * H) for h in rng.integers(0, 40, rng.integers(1, 12))] for _ in range(rng.integers(1, 6))]
        state, got = State(), []
        for batch in batches:
            frame = pd.DataFrame({"symbol": "A", "interval": "1h", "open_us": batch, "close_us": [t + H - 1 for t in batch], "open": 1.0, "high": 1.0, "low": 1.0, "close": 1.0, "volume": 1.0, "is_closed": True})
            for out in taken["run"](("A", "1h"), iter([frame.iloc[:3], frame.iloc[3:]]), state):
                got += [(r.kind, r.open_us, *((r.gap_start_us, r.gap_end_us) if r.kind == "gap" else ())) for r in out.itertuples()]
        want = plain_reconcile(batches, H, 3, 4 * H, capacity)
        assert [x for x in got if x[0] != "duplicate"] == [x for x in want if x[0] != "duplicate"]
        assert sorted(x for x in got if x[0] == "duplicate") == sorted(x for x in want if x[0] == "duplicate")


def test_late_copies_of_filled_bars_are_dropped_and_counted(spark, tmp_path):
    (tmp_path / "in").mkdir()
    remote.register(spark)
    history = spark.createDataFrame([("A", T0 + h * H, 9.0, 9.0, 9.0, 9.0, 9.0) for h in (1, 2)], "symbol string, open_us long, open double, high double, low double, close double, volume double")
    seen = []
    run = live.Backfiller(history, H, lambda df, n: seen.append((n, sorted(((r.open_us - T0) // H, r._data_source) for r in df.collect()))), str(tmp_path / "kept"))
    s = spark.readStream.format("barloom_updates").option("path", (tmp_path / "in").as_uri()).load()
    q = live.reconcile(live.gate(s), live.StreamConfig(tell_duplicates=True)).writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "cp")).start()
    for name, hours in (("a", [0, 4]), ("b", [1, 3, 4, 5])):
        (tmp_path / "in" / f"{name}.jsonl").write_text("\n".join(map(message, hours)))
        q.processAllAvailable()
    q.stop()
    told = [rows for _, rows in seen if rows]
    assert told == [[(0, "STREAMING"), (1, "REST"), (2, "REST"), (4, "STREAMING")], [(3, "STREAMING"), (5, "STREAMING")]]
    counted = spark.read.parquet(str(tmp_path / "kept" / "counters")).agg(F.sum("bars"), F.sum("duplicates"), F.sum("gaps")).first()
    assert tuple(counted) == (4, 2, 1)  # the late copy of 1 and the repeated 4


def test_messages_as_arrow():
    good = json.loads(message(3))
    lines = [message(0), "broken", '{"e":"trade"}', "[1]", json.dumps(good | {"k": good["k"] | {"o": "x"}}), json.dumps(good | {"k": {k: v for k, v in good["k"].items() if k != "i"}}), message(1, False)]
    got = remote.updates(lines).to_pylist()
    assert [((r["open_us"] - T0) // H, r["is_closed"], r["close"]) for r in got] == [(0, True, 1.0), (1, False, 1.0)] and got[0]["high"] != got[0]["high"]
    assert remote.updates([]).num_rows == 0
