"""The kline schema, aliases of its columns, casts and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.intervals import micros

KEYS = ("symbol", "market", "interval")
SOURCE = "_data_source"
OHLCV = ("open", "high", "low", "close", "volume")

#: Names that sources give to the columns.
ALIASES = {
    "quote_volume": "quote_asset_volume", "quote_asset_vol": "quote_asset_volume", "trades": "count",
    "number_of_trades": "count", "trade_count": "count", "taker_base_volume": "taker_buy_volume",
    "taker_buy_base": "taker_buy_volume", "taker_buy_base_asset_volume": "taker_buy_volume",
    "taker_quote_volume": "taker_buy_quote_volume", "taker_buy_quote": "taker_buy_quote_volume",
    "taker_buy_quote_asset_volume": "taker_buy_quote_volume", "opentime": "open_time", "closetime": "close_time",
}

KLINE = T.StructType(
    [T.StructField(k, T.StringType()) for k in KEYS]
    + [T.StructField("open_time", T.TimestampType())]
    + [T.StructField(k, T.DoubleType()) for k in OHLCV]
    + [
        T.StructField("close_time", T.TimestampType()),
        T.StructField("quote_asset_volume", T.DoubleType()),
        T.StructField("count", T.LongType()),
        T.StructField("taker_buy_volume", T.DoubleType()),
        T.StructField("taker_buy_quote_volume", T.DoubleType()),
        T.StructField(SOURCE, T.StringType()),
    ]
)
FUNDING = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("funding_time", T.TimestampType()), T.StructField("funding_rate", T.DoubleType()), T.StructField("interval", T.StringType())])


def empty(spark: SparkSession, schema: T.StructType = KLINE) -> DataFrame:
    return spark.createDataFrame([], schema)


def rename_aliases(df: DataFrame, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """Columns under their canonical names, whatever the case; an alias is left alone if its target is there already."""
    there = set(df.columns)
    to: dict[str, str] = {}
    for c in df.columns:
        target = aliases.get(c.lower())
        if target and target not in there:
            to[c] = target
            there.add(target)
    return df.withColumnsRenamed(to)


def finite(c: Column) -> Column:
    """Null for NaN: NaN would poison sums and win maxima."""
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def standardise(df: DataFrame) -> DataFrame:
    """Known columns in their types (bad values become null), NaN as null; others as they are."""
    types = {f.name: f.dataType for f in KLINE.fields}
    out = []
    for c in df.columns:
        t = types.get(c)
        if t is None:
            out.append(F.col(c))
        elif isinstance(t, T.DoubleType):
            out.append(finite(F.col(c).try_cast(t)).alias(c))
        elif isinstance(t, T.TimestampType) and dict(df.dtypes)[c] in ("bigint", "int"):
            from barloom.functions.timestamps import epoch_us

            out.append(F.timestamp_micros(epoch_us(F.col(c))).alias(c))
        else:
            out.append(F.col(c).try_cast(t).alias(c))
    return df.select(*out)


def canonical(df: DataFrame, keep_source: bool = True) -> DataFrame:
    """Known columns in the schema's order; what is missing is left out, what is unknown dropped."""
    if "quote_volume" in df.columns and "quote_asset_volume" in df.columns:
        df = df.withColumn("quote_asset_volume", F.coalesce("quote_asset_volume", "quote_volume"))
    return df.select(*[f.name for f in KLINE.fields if f.name in df.columns and (keep_source or f.name != SOURCE)])


def with_source(df: DataFrame, source: str, only_missing: bool = False) -> DataFrame:
    """Tags rows with where they came from; with ``only_missing`` those that have no tag yet."""
    if only_missing and SOURCE in df.columns:
        return df.withColumn(SOURCE, F.coalesce(SOURCE, F.lit(source)))
    return df.withColumn(SOURCE, F.lit(source))


def time_column(df: DataFrame) -> str:
    """The column that holds the open time: by name, else the first time stamp whose name speaks of time."""
    if "open_time" in df.columns:
        return "open_time"
    for c, kind in df.dtypes:
        if kind.startswith("timestamp") and "time" in c.lower():
            return c
    raise ValueError("no column of time stamps")


def displayed(df: DataFrame) -> DataFrame:
    """For reading: time stamps as text, numbers with four decimals."""
    shown = {"double": lambda c: F.round(c, 4), "timestamp": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss"), "timestamp_ntz": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")}
    return df.select(*[shown.get(t, lambda c: c)(F.col(c)).alias(c) for c, t in df.dtypes])


def decode_arrays(payloads: DataFrame, json_col: str = "payload") -> DataFrame:
    """Pages of 12-element arrays with numbers as text, as rows; rows without a readable time are dropped."""
    rows = payloads.select(*[c for c in payloads.columns if c != json_col], F.explode(F.from_json(json_col, "array<array<string>>")).alias("r"))
    names = ["open_time", *OHLCV, "close_time", "quote_asset_volume", "count", "taker_buy_volume", "taker_buy_quote_volume"]
    out = rows.select(*[c for c in rows.columns if c != "r"], *[F.get(F.col("r"), i).alias(n) for i, n in enumerate(names)])
    out = out.withColumns({n: F.col(n).try_cast("bigint") for n in ("open_time", "close_time", "count")})
    return standardise(out).filter(F.col("open_time").isNotNull())


def decode_candles(payloads: DataFrame, json_col: str = "payload") -> DataFrame:
    """Pages of 9-element arrays, newest first: time and OHLCV; malformed candles are skipped."""
    rows = payloads.select(*[c for c in payloads.columns if c != json_col], F.explode(F.from_json(json_col, "array<array<string>>")).alias("r"))
    out = rows.select(*[c for c in rows.columns if c != "r"], F.get("r", F.lit(0)).try_cast("bigint").alias("open_time"), *[F.get(F.col("r"), i + 1).alias(n) for i, n in enumerate(OHLCV)])
    return standardise(out).dropna(subset=["open_time", *OHLCV])


def close_time_from_spacing(df: DataFrame, step: int) -> DataFrame:
    """A close time one millisecond before the next bar would open, where there is none."""
    made = F.timestamp_micros(micros(F.col("open_time")) + step - 1000)
    return df.withColumn("close_time", F.coalesce("close_time", made) if "close_time" in df.columns else made)
