"""Symbols, market rules, names and paths: column expressions and small look-up tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions.intervals import INTERVAL_SECONDS

#: Markets, what a symbol may be, quote currencies in the order in which they are tried.
SPOT, USDM, COINM, OPTIONS = "spot", "um", "cm", "options"
SYMBOL_PATTERN = r"^[A-Z0-9_-]{1,30}$"
QUOTES = ("USDT", "USDC", "BUSD", "BTC", "ETH", "BNB")
#: Fixed values of hyphenated venues: quotes in the order in which they are tried, and their intervals.
HYPHEN_QUOTES = ("USDT", "USDC", "USD", "BTC", "ETH")
HYPHEN_INTERVALS = ("1m", "3m", "5m", "15m", "30m", "1h", "2h", "4h", "6h", "12h", "1d", "1w", "1M")
PATH_CHECKSUM = r"([0-9a-fA-F]{64})"


@dataclass(frozen=True)
class Market:
    """What a market offers."""

    name: str
    intervals: tuple[str, ...]
    page_rows: int
    default_symbol: str
    funding: bool


#: Names that a market goes by, and where its endpoints are below the venue's root.
MARKET_NAMES = {"spot": SPOT, "um": USDM, "futures_usdt": USDM, "usdt": USDM, "cm": COINM, "futures_coin": COINM, "coin": COINM, "options": OPTIONS}
ENDPOINTS = {SPOT: ("api", "v3"), USDM: ("fapi", "v1"), COINM: ("dapi", "v1"), OPTIONS: ("eapi", "v1")}
#: Streams that one connection may carry.
MAX_STREAMS = {SPOT: 1_024, USDM: 1_024, COINM: 200}
_ALL = tuple(INTERVAL_SECONDS)
MARKETS = {
    SPOT: Market(SPOT, _ALL, 1_000, "BTCUSDT", False),
    USDM: Market(USDM, _ALL[1:], 1_500, "BTCUSDT", True),
    COINM: Market(COINM, _ALL[1:], 1_500, "BTCUSD_PERP", True),
}


def is_safe_symbol(symbol: Column) -> Column:
    return F.coalesce(symbol.rlike(SYMBOL_PATTERN), F.lit(False))


def futures_symbol(symbol: Column, market: str) -> Column:
    """Coin-margined symbols are quoted in USD and end in ``_PERP``; those with a digit (dated contracts) and others are as they are."""
    if market != COINM:
        return symbol
    perpetual = F.concat(F.regexp_replace(symbol, "USDT$", "USD"), F.lit("_PERP"))
    return F.when(symbol.endswith("_PERP") | symbol.rlike("[0-9]"), symbol).otherwise(perpetual)


def hyphenated(symbol: Column, market: str = SPOT) -> Column:
    """``BTCUSDT`` as ``BTC-USDT`` on spot and ``BTC-USD-SWAP`` on futures; with hyphens as it is, of an unknown quote with ``-USDT`` added."""
    pattern = f"^(.*)({'|'.join(HYPHEN_QUOTES)})$"
    base, quote = F.regexp_extract(symbol, pattern, 1), F.regexp_extract(symbol, pattern, 2)
    made = F.concat(base, F.lit("-"), quote) if market == SPOT else F.concat(base, F.lit("-USD-SWAP"))
    return F.when(symbol.contains("-"), symbol).when(quote == "", F.concat(symbol, F.lit("-USDT"))).otherwise(made)


def display_symbol(symbol: Column, market: str) -> Column:
    """The hyphenated form that requests name: spot symbols are cut before their last four (or three) letters, swaps are made of USDT pairs only."""
    cut = lambda n: F.concat(F.left(symbol, F.length(symbol) - n), F.lit("-"), F.right(symbol, F.lit(n)))
    n = F.length(symbol)
    if market == SPOT:
        four, three = symbol.rlike("(USDT|BUSD|USDC)$") & (n >= 6), symbol.rlike("(BTC|ETH|USD)$") & (n >= 4)
        made = F.when(four, cut(4)).when(three, cut(3)).when(n > 4, cut(4)).otherwise(symbol)
    elif market == USDM:
        made = F.when(symbol.endswith("USDT"), F.regexp_replace(symbol, "USDT$", "-USD-SWAP")).otherwise(symbol)
    else:
        made = symbol
    return F.when(symbol.contains("-"), symbol).otherwise(made)


def format_symbol(symbol: Column, market: str, style: str = "joined") -> Column:
    return display_symbol(symbol, market) if style == "hyphen" else futures_symbol(symbol, market)


def base_asset(symbol: Column) -> Column:
    """What stands before a known quote currency; empty if none does."""
    return F.regexp_extract(symbol, f"^(.+?)({'|'.join(QUOTES)})$", 1)


def base_symbol(symbol: Column) -> Column:
    """A futures or spot symbol without contract suffix and quote."""
    s = F.regexp_replace(F.regexp_replace(symbol, "_(PERP|[0-9]+)$", ""), "-.*$", "")
    return F.regexp_extract(s, "^(.*?)(USDT|USDC|BUSD|USD)?$", 1)


def hyphen_interval(interval: Column) -> Column:
    """Hours, days and weeks with a capital letter, as hyphenated venues write them; null for those that they lack."""
    return F.when(interval.isin(*HYPHEN_INTERVALS), F.when(interval.rlike("[hdw]$"), F.upper(interval)).otherwise(interval))


def stream_name(symbol: Column, interval: Column) -> Column:
    return F.concat(F.lower(symbol), F.lit("@kline_"), interval)


def cache_key(*parts: Column) -> Column:
    return F.concat_ws("/", *[F.upper(p) for p in parts])


def data_path(market: Column, symbol: Column, interval: Column, day: Column) -> Column:
    """Where a day's file is below the store's root."""
    d = F.date_format(day, "yyyy-MM-dd")
    return F.concat_ws("/", market, F.lit("daily/klines"), symbol, interval, F.concat_ws("-", symbol, interval, d))


def parse_path(path: Column) -> Column:
    """The struct ``market, symbol, interval, day`` of a path of :func:`data_path`."""
    p = r"([^/]+)/daily/klines/([^/]+)/([^/]+)/[^/]*-(\d{4}-\d{2}-\d{2})"
    part = lambda i: F.regexp_extract(path, p, i)
    return F.struct(part(1).alias("market"), part(2).alias("symbol"), part(3).alias("interval"), F.try_to_timestamp(part(4), F.lit("yyyy-MM-dd")).cast("date").alias("day"))


def supports_interval(market: Column, interval: Column) -> Column:
    """All markets have all intervals, seconds only on spot."""
    known = interval.isin(*INTERVAL_SECONDS)
    return F.when(market == SPOT, known).when(market.isin(USDM, COINM), known & (interval != "1s")).otherwise(F.lit(False))


def minimum_interval(market: str) -> str:
    return min(MARKETS[market].intervals, key=INTERVAL_SECONDS.__getitem__)


def symbol_problem(symbol: Column, market: Column) -> Column:
    """What is wrong with a symbol for a market, with what is likely meant; null if nothing is."""
    return (
        F.when(symbol.isNull() | (symbol == ""), "empty symbol")
        .when(symbol != F.upper(symbol), F.concat(F.lit("not in upper case; use "), F.upper(symbol)))
        .when(~symbol.rlike(SYMBOL_PATTERN), "characters that no symbol has")
        .when((market == COINM) & ~symbol.rlike("_(PERP|[0-9]{6})$"), F.concat(F.lit("no contract; use "), symbol, F.lit("_PERP")))
        .when((market != COINM) & symbol.endswith("_PERP"), F.concat(F.lit("a coin-margined contract; use "), F.regexp_replace(symbol, "USD_PERP$", "USDT")))
    )


def checksum_of(text: Column) -> Column:
    """The first 64 hexadecimal digits of a checksum file's text, in lower case; empty if there are none."""
    return F.lower(F.regexp_extract(text, PATH_CHECKSUM, 1))


def printable(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x20-\x7E]", "")


def interval_list(text: Column) -> Column:
    """A quoted, comma-separated list as an array of trimmed names; ``1mo`` is ``1M``."""
    return F.transform(F.filter(F.split(F.regexp_replace(text, '"', ""), ","), lambda x: F.trim(x) != ""), lambda x: F.when(F.trim(x) == "1mo", "1M").otherwise(F.trim(x)))


def market_of(name: Column) -> Column:
    """The market of a name in any case; null for others."""
    return F.create_map(*[F.lit(x) for pair in MARKET_NAMES.items() for x in pair])[F.lower(name)]


def endpoint(market: Column, name: str, root: str, version: str | None = None) -> Column:
    """The address of a market's endpoint; unknown markets go by the spot form."""
    made = F.lit(None).cast("string")
    for m, (folder, v) in ENDPOINTS.items():
        made = F.when(market == m, F.lit(f"{root}/{folder}/{version or v}/{name}")).otherwise(made)
    return F.coalesce(made, F.lit(f"{root}/api/{version or ENDPOINTS[SPOT][1]}/{name}"))


def check_subscriptions(market: str, symbols: list[str]) -> list[str]:
    """The symbols, each once, if a connection of the market may carry as many."""
    names = list(dict.fromkeys(symbols))
    if len(names) > MAX_STREAMS.get(market, 1_024):
        raise ValueError(f"{len(names)} streams are more than {MAX_STREAMS.get(market, 1_024)}")
    return names


def market_facts(market: Column) -> Column:
    """``minimum_interval, default_symbol, page_rows, max_streams`` of a market in a column; null for unknown ones."""
    made = F.lit(None).cast("struct<minimum_interval:string,default_symbol:string,page_rows:int,max_streams:int>")
    for name, m in MARKETS.items():
        facts = F.struct(F.lit(minimum_interval(name)).alias("minimum_interval"), F.lit(m.default_symbol).alias("default_symbol"), F.lit(m.page_rows).alias("page_rows"), F.lit(MAX_STREAMS[name]).alias("max_streams"))
        made = F.when(market == name, facts).otherwise(made)
    return made
