"""Where data begins in a source that is read by pages: first data, and next data after a gap, for all symbols at once.

A page is looked at, its rows aren't kept. From the start of a range the pages at distance 1, 2, 4 ... are looked at until one
has data; between the last page without and the first one with data the middle page decides, again and again. So a
range of n pages takes some 2 log n pages instead of n. The open searches are a table, and each round looks at one page
of each: a job a round, whatever the number of symbols.

It is taken for granted that once data begins, the pages that are looked at have some, as far as the range goes: data that ends again
between two looks isn't found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.intervals import INTERVAL_SECONDS
from barloom.sources.remote import Answers
from barloom.sources.scratch import cut

Probe = Callable[[DataFrame], DataFrame]


def page_probe(url: str, interval: str, style: str = "array") -> Probe:
    """For pages ``symbol, start_us, end_us`` the ``symbol, start_us, first_us`` of those that have bars; looked at in tasks."""

    def look(pages: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            source = Answers(url, interval, style == "hyphen")
            for b in batches:
                found = []
                for symbol, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    page = source.page(symbol, start, end, source.files(symbol, start, end))
                    if page.num_rows:
                        found.append((symbol, start, page.column("open_us")[0].as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))], ["symbol", "start_us", "first_us"])

        return pages.select("symbol", "start_us", "end_us").repartition("symbol").mapInArrow(run, "symbol string, start_us long, first_us long")

    return look


def first_data(ranges: DataFrame, probe: Probe, interval: str, page_rows: int = 1_000) -> DataFrame:
    """``symbol, first_us, pages_read`` for each half-open range ``symbol, from_us, to_us`` (one a symbol): the first bar's time, null if no page that was looked at has one.

    From the beginning of time it tells where a symbol's data begins, from a gap's start where data goes on.
    """
    size = page_rows * INTERVAL_SECONDS[interval] * 1_000_000
    pages = F.ceil((F.col("to_us") - F.col("from_us")) / size)
    # lo: the last page that is known to be empty; hi: the first one that is known to have data
    state = cut(ranges.filter("to_us > from_us").select("symbol", "from_us", "to_us", pages.alias("pages"), F.lit(-1).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi"), F.lit(1).cast("long").alias("stride"), F.lit(None).cast("long").alias("first_us"), F.lit(0).cast("long").alias("pages_read")))
    going_on = F.when(F.col("hi").isNull(), F.col("lo") < F.col("pages") - 1).otherwise(F.col("hi") - F.col("lo") > 1)
    while not state.filter(going_on).isEmpty():
        middle = F.when(F.col("hi").isNull(), F.least(F.col("lo") + F.col("stride"), F.col("pages") - 1)).otherwise(F.floor((F.col("lo") + F.col("hi")) / 2))
        start = F.col("from_us") + F.col("page") * size
        at = state.withColumn("page", F.when(going_on, middle)).withColumn("start_us", start)
        looked = at.filter("page is not null").select("symbol", "start_us", F.least(F.col("start_us") + size, "to_us").alias("end_us"))
        seen = probe(looked).withColumnRenamed("first_us", "seen_us")
        open_ = F.col("page").isNotNull()
        found = open_ & F.col("seen_us").isNotNull()
        state = cut(
            at.join(seen, ["symbol", "start_us"], "left").select(
                "symbol", "from_us", "to_us", "pages", F.when(open_ & ~found, F.col("page")).otherwise(F.col("lo")).alias("lo"), F.when(found, F.col("page")).otherwise(F.col("hi")).alias("hi"),
                F.when(open_ & ~found & F.col("hi").isNull(), F.col("stride") * 2).otherwise(F.col("stride")).alias("stride"), F.when(found, F.col("seen_us")).otherwise(F.col("first_us")).alias("first_us"),
                (F.col("pages_read") + open_.cast("long")).alias("pages_read"),
            )
        )
    return state.select("symbol", "first_us", "pages_read")
