"""Sources outside the cache, as Python data sources: zipped daily files, paged answers, funding rates, streams of updates.

There is no network here: they read what a store that ``pyarrow.fs`` opens holds in the shape of the
providers' payloads. A partition is a group of days or a page, so a lost task reads few files again; tasks
read and hand over Arrow batches. Filters of symbol and time reach the readers, so a plain ``where`` opens
only files that can have its rows. What to read can also be a table of ranges, other ones for each symbol
(:func:`fetch_days`, :func:`fetch_pages`): then nothing is listed or enumerated on the driver.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import io
import json
import re
import sys
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import csv, fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from barloom.functions.intervals import DAY, INTERVAL_SECONDS, chunks, day_us
from barloom.operators.gaps import coalesce_ranges
from barloom.sources.errors import BadAnswer, RateLimited, SourceError, again, raise_for
from barloom.sources.scratch import cut

PRICES = "open double, high double, low double, close double, volume double"
BULK = f"symbol string, interval string, open_us long, {PRICES}, close_us long, quote_asset_volume double, count long, taker_buy_volume double, taker_buy_quote_volume double, day string, checksum_ok boolean"
PAGED = f"symbol string, interval string, open_us long, {PRICES}"
FUNDING = "symbol string, funding_us long, funding_rate double"
UPDATES = f"symbol string, interval string, open_us long, close_us long, {PRICES}, is_closed boolean"
#: Days' files that one task reads.
DAYS_TOGETHER = 32
#: No bound: before and after all times of the sources.
ALWAYS = (-(1 << 62), 1 << 62)
#: Expected bytes of a bar in a file, and of what one task reads.
BAR_BYTES, TASK_BYTES = 100, 32 << 20


def read_bytes(url: str) -> bytes | None:
    """A file's content, None if it isn't there; other failures are tried again."""
    store, path = fs.FileSystem.from_uri(url)

    def read() -> bytes | None:
        if store.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with store.open_input_stream(path) as f:
            return f.read()

    return again(read)


def names_in(url: str, suffix: str) -> list[str]:
    """Names of the files of a folder, none if it isn't there."""
    store, folder = fs.FileSystem.from_uri(url)
    if store.get_file_info(folder).type == fs.FileType.NotFound:
        return []
    return sorted(f.base_name for f in store.get_file_info(fs.FileSelector(folder)) if f.base_name.endswith(suffix))


def epoch_us(values: pd.Series) -> pd.Series:
    """Microseconds of 13 or 16 digits; null for others."""
    text = values.astype("string").str.strip()
    n = pd.to_numeric(text.where(text.str.fullmatch("[0-9]{13}|[0-9]{16}")), errors="coerce").astype("Int64")
    return n.where(text.str.len() != 13, n * 1000)


def batch(columns: dict[str, object], schema: str) -> pa.RecordBatch:
    """An Arrow batch with the columns of a schema in its order."""
    types = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    made = {n: pa.array(columns[n], types[t], from_pandas=True) if not isinstance(columns[n], (str, bool)) else None for n, t in fields}
    rows = len(next(v for v in made.values() if v is not None))
    return pa.RecordBatch.from_arrays([made[n] if made[n] is not None else pa.array([columns[n]] * rows, types[t]) for n, t in fields], [n for n, _ in fields])


def names_below(url: str) -> list[str]:
    """Names of the folders of a folder."""
    store, folder = fs.FileSystem.from_uri(url)
    if store.get_file_info(folder).type == fs.FileType.NotFound:
        return []
    return sorted(f.base_name for f in store.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.Directory)


class PrunedReader(DataSourceReader):
    """Reads ``path``, symbols (those of the option, else all folders) and a range of time; filters of both narrow what is read.

    Comparisons of the symbol with constants and of the time with bounds hold exactly for the rows that are read;
    all other filters stay with Spark.
    """

    time = "open_us"

    def __init__(self, options: dict) -> None:
        self.url = options["path"].rstrip("/")
        self.listed = options["symbols"].split(",") if "symbols" in options else None
        self.start, self.end = (int(options.get(k, v)) for k, v in zip(("start_us", "end_us"), ALWAYS, strict=True))
        self.only: set[str] | None = None

    def symbols(self) -> list[str]:
        names = names_below(self.url) if self.listed is None and self.only is None else self.listed if self.listed is not None else sorted(self.only)
        return [s for s in names if self.only is None or s in self.only]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            column = f.attribute if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) else None
            if column == ("symbol",) and isinstance(f, (EqualTo, In)):
                these = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = these if self.only is None else self.only & these
            elif column == (self.time,) and not isinstance(f, In):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.start = max(self.start, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.end = min(self.end, f.value + (not isinstance(f, LessThan)))
            else:
                yield f


@dataclass
class Days(InputPartition):
    """``days`` is None where there is no bound: the task lists what there is."""

    symbol: str
    days: tuple[str, ...] | None


def days_between(start: int, end: int) -> list[str]:
    return [dt.datetime.fromtimestamp(d // 1_000_000, dt.UTC).strftime("%Y-%m-%d") for d in range(start - start % DAY, end, DAY)]


BULK_NAMES = ("open_us", "open", "high", "low", "close", "volume", "close_us", "quote_asset_volume", "count", "taker_buy_volume", "taker_buy_quote_volume", "ignored")


def read_day(url: str, symbol: str, interval: str, day: str, start: int, end: int, strict: bool = False) -> pa.RecordBatch | None:
    """The rows of a day's file within a half-open range, None if there is no file; a header and bad rows are those without a readable time."""
    name = f"{url}/{symbol}/{interval}/{symbol}-{interval}-{day}.zip"
    data = read_bytes(name)
    if data is None:
        return None
    said = read_bytes(name + ".CHECKSUM")
    ok = said is None or hashlib.sha256(data).hexdigest() in said.decode(errors="replace").lower()
    if not ok and strict:
        raise SourceError("a file doesn't fit its checksum", path=name)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        text = z.read(z.namelist()[0])
    t = csv.read_csv(
        io.BytesIO(text), csv.ReadOptions(column_names=list(BULK_NAMES)), csv.ParseOptions(invalid_row_handler=lambda _: "skip"), csv.ConvertOptions(column_types=dict.fromkeys(BULK_NAMES, pa.string()), strings_can_be_null=True)
    ).to_pandas() if text.strip() else pd.DataFrame(columns=list(BULK_NAMES), dtype="string")
    t["open_us"], t["close_us"] = epoch_us(t["open_us"]), epoch_us(t["close_us"])
    t = t[t["open_us"].notna() & (t["open_us"] >= start) & (t["open_us"] < end)].copy()
    numbers = [n for n in BULK_NAMES[1:-1] if n not in ("close_us", "count")]
    t[numbers] = t[numbers].apply(pd.to_numeric, errors="coerce")
    t["count"] = pd.to_numeric(t["count"], errors="coerce").round().astype("Int64")
    return batch({"symbol": symbol, "interval": interval, "day": day, "checksum_ok": ok} | {n: t[n] for n in BULK_NAMES[:-1]}, BULK)


class BulkReader(PrunedReader):
    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.interval, self.strict = options["interval"], options.get("strict", "false") == "true"

    def partitions(self) -> list[Days]:
        if self.start >= self.end:
            return [Days("", ())]
        if self.start == ALWAYS[0] or self.end == ALWAYS[1]:
            return [Days(s, None) for s in self.symbols()] or [Days("", ())]
        days = days_between(self.start, self.end)
        return [Days(s, tuple(days[i : i + DAYS_TOGETHER])) for s in self.symbols() for i in range(0, len(days), DAYS_TOGETHER)] or [Days("", ())]

    def read(self, p: Days) -> Iterator[pa.RecordBatch]:
        days = p.days
        if days is None:
            found = (re.search(r"(\d{4}-\d{2}-\d{2})\.zip$", n) for n in names_in(f"{self.url}/{p.symbol}/{self.interval}", ".zip"))
            days = [m[1] for m in found if m and self.start < (at := day_start(m[1])) + DAY and at < self.end]
        for day in days:
            if (b := read_day(self.url, p.symbol, self.interval, day, self.start, self.end, self.strict)) is not None:
                yield b


def day_start(day: str) -> int:
    return int(dt.datetime.fromisoformat(day).replace(tzinfo=dt.UTC).timestamp()) * 1_000_000


class BulkSource(DataSource):
    """``path/SYMBOL/INTERVAL/SYMBOL-INTERVAL-DAY.zip`` with a CSV each, of milliseconds or microseconds, header or not; days of a file are those of its name."""

    @classmethod
    def name(cls) -> str:
        return "barloom_bulk"

    def schema(self) -> str:
        return BULK

    def reader(self, schema) -> BulkReader:  # noqa: ANN001
        return BulkReader(self.options)


@dataclass
class Page(InputPartition):
    symbol: str
    start_us: int
    end_us: int
    files: tuple[str, ...]


PAGE_NAMES = ("open_us", "open", "high", "low", "close", "volume")


class Answers:
    """A symbol's answers: JSON arrays of rows, or an object that tells of an error or a limit."""

    def __init__(self, url: str, interval: str, hyphen: bool) -> None:
        self.url, self.interval, self.hyphen = url.rstrip("/"), interval, hyphen
        self.listed: tuple[str, list] = ("", [])

    def folder(self, symbol: str) -> str:
        name = self.interval.upper() if self.hyphen and self.interval[-1] in "hdw" else self.interval
        return f"{self.url}/{symbol}/{name}"

    def files(self, symbol: str, start: int, end: int) -> list[str]:
        """Names of the files that may have rows of a range: those whose name says otherwise aren't opened."""
        if self.listed[0] != symbol:
            names = names_in(self.folder(symbol), ".json")
            self.listed = (symbol, [(n, *map(int, m.groups())) if (m := re.search(r"(\d+)-(\d+)\.json$", n)) else (n, None, None) for n in names])
        return [n for n, lo, hi in self.listed[1] if lo is None or (hi >= start and lo < end)]

    def answer(self, symbol: str, name: str) -> list[list]:
        try:
            got = json.loads(read_bytes(f"{self.folder(symbol)}/{name}") or b"[]")
        except json.JSONDecodeError as e:
            raise BadAnswer("an answer can't be read", symbol=symbol, file=name) from e
        if isinstance(got, dict):
            raise_for(int(got.get("status", 200)), got.get("retry_after"), got.get("code"))
            got = got.get("data", [])
        return got

    def page(self, symbol: str, start: int, end: int, names: list[str] | tuple[str, ...]) -> pa.RecordBatch:
        """The rows of a page; those outside it are another's, and of rows with one time the first counts."""
        rows = [r for n in names for r in self.answer(symbol, n)]
        t = pd.DataFrame([r[:6] for r in rows if len(r) >= 6], columns=list(PAGE_NAMES), dtype=object)
        t["open_us"] = epoch_us(t["open_us"])
        numbers = list(PAGE_NAMES[1:])
        t[numbers] = t[numbers].apply(pd.to_numeric, errors="coerce")
        t = t[t["open_us"].notna() & (t["open_us"] >= start) & (t["open_us"] < end)]
        if self.hyphen:
            t = t.dropna()
        t = t.drop_duplicates("open_us").sort_values("open_us")
        return batch({"symbol": symbol, "interval": self.interval} | {n: t[n] for n in PAGE_NAMES}, PAGED)


class PagedReader(PrunedReader):
    """Pages of ``page_rows`` bars of one range (``start_us, end_us``, or by filters) or several (``ranges``: ``from-to`` pairs, comma-joined), as many as it takes.

    With ``style=hyphen`` symbols and intervals are those of hyphenated venues: folders are named so, and rows
    are told newest first, of nine places.
    """

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.ranges = [tuple(map(int, r.split("-"))) for r in options["ranges"].split(",")] if "ranges" in options else [ALWAYS]
        self.size = int(options.get("page_rows", 1_000)) * INTERVAL_SECONDS[options["interval"]] * 1_000_000
        self.source = Answers(self.url, options["interval"], options.get("style") == "hyphen")

    def partitions(self) -> list[Page]:
        out = []
        for s in self.symbols():
            self.source.files(s, *ALWAYS)  # listed once a symbol
            ends = [(lo, hi) for _, lo, hi in self.source.listed[1]]
            known = [min((lo for lo, _ in ends), default=0), max((hi + 1 for _, hi in ends), default=0)] if all(lo is not None for lo, _ in ends) else None
            for start, end in self.ranges:
                start, end = max(start, self.start), min(end, self.end)
                if start == ALWAYS[0] or end == ALWAYS[1]:
                    if known is None:
                        raise SourceError("without bounds of time the names of files must tell theirs", symbol=s)
                    start, end = max(start, known[0]), min(end, known[1])
                for a in range(start, end, self.size):
                    b = min(a + self.size, end)
                    if held := tuple(self.source.files(s, a, b)):
                        out.append(Page(s, a, b, held))
        return out or [Page("", 0, 0, ())]

    def read(self, p: Page) -> Iterator[pa.RecordBatch]:
        yield self.source.page(p.symbol, p.start_us, p.end_us, p.files)


class PagedSource(DataSource):
    """Pages of arrays, one partition a page; rows on the edge of two answers count once."""

    @classmethod
    def name(cls) -> str:
        return "barloom_paged"

    def schema(self) -> str:
        return PAGED

    def reader(self, schema) -> PagedReader:  # noqa: ANN001
        return PagedReader(self.options)


class FundingReader(PrunedReader):
    """``path/SYMBOL/*.json`` with objects ``fundingTime, fundingRate``, in a closed range of time; a partition is a symbol and month of files."""

    time = "funding_us"

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.end = min(self.end + 1, ALWAYS[1])

    def partitions(self) -> list[Page]:
        out = []
        for s in self.symbols():
            names = names_in(f"{self.url}/{s}", ".json")
            out += [Page(s, self.start, self.end, tuple(names[i : i + DAYS_TOGETHER])) for i in range(0, len(names), DAYS_TOGETHER)]
        return out or [Page("", 0, 0, ())]

    def read(self, p: Page) -> Iterator[pa.RecordBatch]:
        rows = [r for name in p.files for r in json.loads(read_bytes(f"{self.url}/{p.symbol}/{name}") or b"[]")]
        t = pd.DataFrame([(r.get("fundingTime"), r.get("fundingRate")) for r in rows], columns=["funding_us", "funding_rate"], dtype=object)
        t["funding_us"], t["funding_rate"] = epoch_us(t["funding_us"]), pd.to_numeric(t["funding_rate"], errors="coerce")
        t = t[t["funding_us"].notna() & (t["funding_us"] >= p.start_us) & (t["funding_us"] < p.end_us)].drop_duplicates("funding_us").sort_values("funding_us")
        yield batch({"symbol": p.symbol, "funding_us": t["funding_us"], "funding_rate": t["funding_rate"]}, FUNDING)


class FundingSource(DataSource):
    """Funding rates of futures."""

    @classmethod
    def name(cls) -> str:
        return "barloom_funding"

    def schema(self) -> str:
        return FUNDING

    def reader(self, schema) -> FundingReader:  # noqa: ANN001
        return FundingReader(self.options)


@dataclass
class Lines(InputPartition):
    path: str


class UpdateReader(DataSourceStreamReader):
    """Files of messages, one JSON object a line, in the order of their times and names, ``files_per_batch`` at a time.

    The offset is the time and name of the last file read, so a file that arrives late is read though its name is smaller.
    """

    def __init__(self, options: dict) -> None:
        self.url = options["path"]
        self.per_batch = int(options.get("files_per_batch", 10))
        self.at = [0, ""]

    def _files(self) -> list[list]:
        store, folder = fs.FileSystem.from_uri(self.url)
        return sorted([f.mtime_ns, f.path] for f in store.get_file_info(fs.FileSelector(folder)) if f.path.endswith(".jsonl"))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": [0, ""]}

    def latestOffset(self) -> dict:  # noqa: N802
        new = [f for f in self._files() if f > self.at][: self.per_batch]
        self.at = new[-1] if new else self.at
        return {"at": self.at}

    def partitions(self, start: dict, end: dict) -> list[Lines]:
        self.at = max(self.at, end["at"])
        return [Lines(f[1]) for f in self._files() if start["at"] < f <= end["at"]] or [Lines("")]

    def read(self, p: Lines) -> Iterator[pa.RecordBatch]:
        if not p.path:
            return
        store, _ = fs.FileSystem.from_uri(self.url)
        with store.open_input_stream(p.path) as f:
            lines = f.read().decode().splitlines()
        for i in range(0, len(lines), LINES_TOGETHER):
            yield updates(lines[i : i + LINES_TOGETHER])


LINES_TOGETHER = 10_000


def updates(lines: list[str]) -> pa.RecordBatch:
    """The rows of kline messages; other messages give none, broken ones and those without a needed value neither."""
    found = []
    for line in lines:
        try:
            m = json.loads(line)
        except ValueError:
            continue
        if isinstance(m, dict) and m.get("e", "kline") == "kline" and isinstance(k := m.get("k"), dict):
            found.append((k.get("s") or m.get("s"), *map(k.get, ("i", "t", "T", "o", "h", "l", "c", "v", "x"))))
    t = pd.DataFrame(found, columns=[c.split()[0] for c in UPDATES.split(", ")][:1] + ["interval", "open_us", "close_us", "open", "high", "low", "close", "volume", "is_closed"], dtype=object)
    prices = ["open", "high", "low", "close", "volume"]
    numbers = t[["open_us", "close_us", *prices]].apply(pd.to_numeric, errors="coerce")
    told = t[prices].apply(lambda c: c.astype("string").str.strip().str.lower().isin(["nan", "+nan", "-nan"]))
    sound = numbers["open_us"].notna() & t["interval"].notna() & t["is_closed"].notna() & (numbers[prices].notna() | told).all(axis=1)
    t, numbers = t[sound], numbers[sound]
    ms = {c: (numbers[c].fillna(0).astype("int64") * 1000).to_numpy() for c in ("open_us", "close_us")}
    values = {c: pa.array(numbers[c].astype("float64").to_numpy(), pa.float64(), from_pandas=False) for c in prices}
    rest = {"symbol": t["symbol"].astype(str), "interval": t["interval"].astype(str), "is_closed": t["is_closed"].astype(bool)}
    return batch({k: pa.array(v) if not isinstance(v, pa.Array) else v for k, v in (rest | ms | values).items()}, UPDATES)


class UpdateSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "barloom_updates"

    def schema(self) -> str:
        return UPDATES

    def streamReader(self, schema) -> UpdateReader:  # noqa: ANN001, N802
        return UpdateReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the sources known to a session, with filters pushed to them. They travel with what they use: Spark also plans them in processes that have no packages of the session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    package = sys.modules[__name__.partition(".")[0]]
    cloudpickle.register_pickle_by_value(package)
    try:
        for source in (BulkSource, PagedSource, FundingSource, UpdateSource):
            spark.dataSource.register(source)
    finally:
        cloudpickle.unregister_pickle_by_value(package)


def _dealt(pieces: DataFrame, step: int, size: int) -> DataFrame:
    """Pieces ``symbol, start_us, end_us`` in the order of both, in as many tasks as the bytes that are expected of them ask for."""
    expected = pieces.agg(F.sum((F.col("end_us") - F.col("start_us")) / step * BAR_BYTES)).first()[0] or 0
    n = max(1, int(-(-expected // size)))
    return pieces.repartitionByRange(n, "symbol", "start_us").sortWithinPartitions("symbol", "start_us") if n > 1 else pieces.coalesce(1).sortWithinPartitions("symbol", "start_us")


def fetch_days(wanted: DataFrame, url: str, interval: str, strict: bool = False, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The bars of daily files within half-open ranges ``symbol, start_us, end_us``, other ones for each symbol; a file is opened once for each range that has time of its day."""
    step = INTERVAL_SECONDS[interval] * 1_000_000
    some = wanted.filter("end_us > start_us")
    day = F.explode(F.sequence(day_us(F.col("start_us")), day_us(F.col("end_us") - 1), F.lit(DAY)))
    days = some.withColumn("__day", day).select("symbol", F.greatest("start_us", "__day").alias("start_us"), F.least("end_us", F.col("__day") + DAY).alias("end_us"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for symbol, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (got := read_day(url.rstrip("/"), symbol, interval, days_between(start, start + 1)[0], start, end, strict)) is not None:
                    yield got

    return _dealt(days, step, task_bytes).mapInArrow(run, BULK)


@dataclass(frozen=True)
class Fetched:
    """What a source gave, and the ranges ``symbol, start_us, end_us`` that it refused: still wanted."""

    bars: DataFrame
    left: DataFrame


def fetch_pages(wanted: DataFrame, url: str, interval: str, page_rows: int = 1_000, style: str = "array", task_bytes: int = TASK_BYTES) -> Fetched:
    """The bars of half-open ranges ``symbol, start_us, end_us``, other ones for each symbol, fetched page by page in tasks, and what is left of the ranges.

    A page that meets a rate limit isn't tried again and ends its range: what comes before it is kept, the time
    from it on is left, whichever task asked for it. Other failures are errors, after they have been tried again.
    """
    step = INTERVAL_SECONDS[interval] * 1_000_000
    ranges = wanted.filter("end_us > start_us").select("symbol", "start_us", "end_us")
    whole = F.struct(F.col("start_us").alias("a"), F.col("end_us").alias("b"))
    pages = chunks(ranges.withColumn("__range", whole), step, page_rows).select("symbol", F.col("chunk_start_us").alias("start_us"), F.col("chunk_end_us").alias("end_us"), F.col("__range.a").alias("range_start"), F.col("__range.b").alias("range_end"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, ended = Answers(url, interval, style == "hyphen"), None
        for b in batches:
            for symbol, start, end, *of in zip(*(c.to_pylist() for c in b.columns), strict=True):
                refused = ended == (symbol, *of)
                try:
                    got = None if refused else source.page(symbol, start, end, source.files(symbol, start, end))
                except RateLimited:
                    refused, ended, got = True, (symbol, *of), None
                if refused:
                    got = batch({"symbol": symbol, "interval": interval, "open_us": [start]} | {n: [None] for n in PAGE_NAMES[1:]}, PAGED)
                for name, value, kind in (("range_start", of[0], pa.int64()), ("range_end", of[1], pa.int64()), ("refused", refused, pa.bool_())):
                    got = got.append_column(name, pa.array([value] * got.num_rows, kind))
                yield got

    found = cut(_dealt(pages, step, task_bytes).mapInArrow(run, f"{PAGED}, range_start long, range_end long, refused boolean"))
    key = ["symbol", "range_start", "range_end"]
    ends = cut(found.filter("refused").groupBy(*key).agg(F.min("open_us").alias("__from")))
    bars = found.filter("not refused")
    if not ends.isEmpty():
        bars = bars.join(ends, key, "left").filter("__from is null or open_us < __from")
    return Fetched(bars.select(*[c.split()[0] for c in PAGED.split(", ")]), coalesce_ranges(ends.select("symbol", F.col("__from").alias("start_us"), F.col("range_end").alias("end_us")), step))


def write_files(files: DataFrame, url: str, zipped: bool = False) -> int:
    """Writes a file for each row ``name, content`` below a folder, from the tasks; zipped ones with a checksum beside them (of ``said``, where there is such a column and it isn't null). Returns how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(url)
        for b in batches:
            for name, content, said in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data, path = content.encode(), f"{folder}/{name}"
                store.create_dir(path.rpartition("/")[0], recursive=True)
                if zipped:
                    held = io.BytesIO()
                    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                        z.writestr(f"{path.rpartition('/')[2].removesuffix('.zip')}.csv", data)
                    data = held.getvalue()
                    with store.open_output_stream(f"{path}.CHECKSUM") as f:
                        f.write(f"{said or hashlib.sha256(data).hexdigest()}  {name}\n".encode())
                with store.open_output_stream(path) as f:
                    f.write(data)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    said = F.col("said") if "said" in files.columns else F.lit(None).cast("string").alias("said")
    return files.select("name", "content", said).mapInArrow(run, "n long").groupBy().sum("n").first()[0] or 0
