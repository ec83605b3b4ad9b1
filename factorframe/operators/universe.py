"""Universe building and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorframe.functions import ranks
from factorframe.functions.windows import c

# fixed values: exchange suffix of the source -> suffix of the price vendor
SUFFIXES = {"LN": "L", "FP": "PA", "GR": "DE", "NA": "AS", "JP": "T", "AU": "AX", "SP": "SI", "AV": "VI", "FH": "HE", "IJ": "JK"}
# fixed values: country code -> suffixes to try, in order
DIRECT_CODES = ("HK", "L", "TO", "DE", "PA", "MI", "AS", "SW", "VX", "KS", "KQ", "AX", "SS", "SZ", "ST", "OL", "VI")
CODE_SUFFIXES = {"UW": [""], "UN": [""], "US": [""], "GR": [".DE"], "FP": [".PA"], "NA": [".AS"], "JP": [".T"],
                 "AU": [".AX"], "SP": [".SI"], "LN": [".L"], "TT": [".TW", ".TWO"], "CN": [".TO", ".V"]}
# fixed values: the same for the vendor's own reader, and further suffixes it tries
VENDOR_SUFFIXES = {"US": "", "UW": "", "UN": "", "USA": "", "LN": ".L", "HK": ".HK", "JP": ".T", "JT": ".T", "KS": ".KS", "KQ": ".KQ", "SS": ".SS",
                   "SZ": ".SZ", "TT": ".TW", "AU": ".AX", "TO": ".TO", "V": ".V", "CN": ".TO", "SW": ".SW", "VX": ".VX", "GR": ".DE", "DE": ".DE",
                   "FP": ".PA", "PA": ".PA", "AS": ".AS", "NA": ".AS", "MI": ".MI", "BR": ".BR", "VI": ".VI", "OL": ".OL", "ST": ".ST"}
OTHER_SUFFIXES = {"TO": [".TO", ".V"], "CN": [".TO", ".V"], "V": [".TO", ".V"], "SW": [".SW", ".VX"], "VX": [".SW", ".VX"], "TT": [".TW", ".TWO"]}
# fixed values: delisting return by reason, and reason by code
DELISTING_RETURNS = {"merger": 0.0, "acquisition": 0.0, "bankruptcy": -0.30, "liquidation": -0.55, "exchange": -0.55,
                     "voluntary": -0.15, "performance": -0.30, "unknown": -0.30}
DEFAULT_DELISTING_RETURN = -0.30
DELISTING_CODES = {"200": "merger", "201": "merger", "202": "merger", "500": "exchange", "501": "exchange", "502": "exchange",
                   "400": "liquidation", "401": "liquidation", "100": "performance", "101": "performance"}


def _lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def normalize_ticker(x) -> Column:
    """Letters, digits, dot and hyphen, upper case; empty becomes null."""
    s = F.upper(F.regexp_replace(F.trim(c(x)), r"[^A-Za-z0-9.\-]", ""))
    return F.when(s != "", s)


def normalize_suffix(x) -> Column:
    """Exchange suffix after the last dot mapped to the vendor's."""
    s = F.regexp_replace(F.upper(F.trim(c(x))), r"[^A-Z0-9.\-]", "")
    base, suf = F.regexp_extract(s, r"^(.*)\.([^.]*)$", 1), F.regexp_extract(s, r"^(.*)\.([^.]*)$", 2)
    mainland = F.when(base.rlike(r"^6\d+$"), "SS").otherwise("SZ")
    mapped = F.when(suf.isin("C1", "C2"), mainland).otherwise(F.coalesce(_lookup(SUFFIXES, suf), suf))
    mapped = F.when((mapped == "SS") & base.rlike(r"^[A-Z\-]+$"), "ST").otherwise(mapped)
    padded = F.when((mapped == "HK") & base.rlike(r"^\d+$") & (F.length(base) < 4), F.lpad(base, 4, "0")).otherwise(base)
    return F.when(s == "", None).when(~F.contains(s, F.lit(".")), s).otherwise(F.concat(padded, F.lit("."), mapped))


def symbol_candidates(ticker, code) -> Column:
    """Distinct symbols to try, best first."""
    raw, code = F.upper(F.trim(c(ticker))), F.upper(F.trim(F.coalesce(c(code), F.lit(""))))
    table = F.create_map(*[x for k, v in CODE_SUFFIXES.items() for x in (F.lit(k), F.lit(v))])
    direct = F.array(F.concat(raw, F.lit("."), code))
    listed = F.transform(F.element_at(table, code), lambda s: F.concat(raw, s))
    first = F.when(code.isin(*DIRECT_CODES), direct).otherwise(F.coalesce(listed, F.array().cast("array<string>")))
    return F.when(raw != "", F.array_distinct(F.concat(first, F.array(raw))))


def provider_candidates(ticker, code, own: dict[str, str] | None = None) -> Column:
    """U3 as the price provider resolves: the code's suffix (``own`` ones win), its alternates, the bare ticker; none for a blank ticker."""
    raw, code = F.upper(F.trim(c(ticker))), F.upper(F.trim(F.coalesce(c(code), F.lit(""))))
    table = {k: list(dict.fromkeys([s, *OTHER_SUFFIXES.get(k, [])])) for k, s in (VENDOR_SUFFIXES | (own or {})).items()}
    suffixes = F.element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), code)
    listed = F.coalesce(F.transform(suffixes, lambda s: F.concat(raw, s)), F.array().cast("array<string>"))
    return F.when(raw != "", F.array_distinct(F.concat(listed, F.array(raw)))).otherwise(F.array().cast("array<string>"))


def resolved(candidates) -> Column:
    """The first candidate; Hong Kong numbers get four digits, a Japanese suffix is the vendor's."""
    first = F.get(candidates, F.lit(0))
    number = F.regexp_extract(first, r"^(\d+)\.HK$", 1)
    return F.when((number != "") & (F.length(number) < 4), F.concat(F.lpad(number, 4, "0"), F.lit(".HK"))).otherwise(F.regexp_replace(first, r"\.JP$", ".T"))


def at_least(df: DataFrame, col: str, minimum: float) -> DataFrame:
    """U4; text that is no number fails."""
    return df.where(c(col).try_cast("double") >= minimum)


def include(df: DataFrame, col: str, values) -> DataFrame:
    """U5."""
    return df.where(F.lower(F.trim(c(col))).isin([str(v).strip().lower() for v in values]))


def exclude(df: DataFrame, col: str, values) -> DataFrame:
    """U5."""
    return df.where(~F.coalesce(F.lower(F.trim(c(col))), F.lit("")).isin([str(v).strip().lower() for v in values]))


def top_per_box(df: DataFrame, box: str, n: int, by: str, ties: str = "row_id") -> DataFrame:
    """U6."""
    return ranks.top_n(df, [box], [F.desc_nulls_last(c(by).try_cast("double")), F.asc(ties)], n)


def box_gate(df: DataFrame, wanted: DataFrame, box: str, n: int, strict=False) -> DataFrame:
    """(box, n_rows, met) of every wanted box; ``strict`` raises when one is short."""
    counts = df.groupBy(box).agg(F.count(F.lit(1)).alias("n_rows"))
    out = wanted.select(box).distinct().join(counts, box, "left").fillna(0, ["n_rows"])
    met = c("n_rows") >= n
    if strict:
        met = F.when(met, True).otherwise(F.raise_error(F.concat(F.lit("box below minimum: "), c(box))).cast("boolean"))
    return out.withColumn("met", met)


def largest(df: DataFrame, n: int | None, ties: str = "row_id") -> DataFrame:
    """U8: top n by weight, else by market cap, else the first n."""
    if not n or n <= 0:
        return df
    for key in ("weight", "market_cap"):
        if key in df.columns:
            return ranks.top_n(df, [], [F.desc_nulls_last(c(key).try_cast("double")), F.asc(ties)], n)
    return ranks.top_n(df, [], [F.asc(ties)], n)


def first_of_each(df: DataFrame, key="symbol", order="row_id") -> DataFrame:
    """First occurrence of every symbol; min_by combines map-side, so repeated symbols do not pile up."""
    others = [x for x in df.columns if x != key]
    out = df.where(c(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*others), order).alias("_r"))
    return out.select(key, "_r.*")


def min_history(bars: DataFrame, n=252) -> DataFrame:
    """Symbols with enough rows."""
    return bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows")).where(c("n_rows") >= n)


def recent_volume(bars: DataFrame, rows=21) -> DataFrame:
    last = ranks.top_n(bars.select("symbol", "date", "volume"), ["symbol"], [F.desc("date")], rows)
    return last.groupBy("symbol").agg(F.avg("volume").alias("avg_volume"))


def min_volume(bars: DataFrame, minimum: float, rows=21) -> DataFrame:
    """U11."""
    return recent_volume(bars, rows).where(c("avg_volume") >= minimum)


def price_between(bars: DataFrame, low=0.0, high=float("inf")) -> DataFrame:
    """U12."""
    return bars.groupBy("symbol").agg(F.max_by("close", "date").alias("last_close")).where(
        (c("last_close") >= low) & (c("last_close") <= high))


def min_cap(symbols: DataFrame, caps: DataFrame, minimum: float) -> DataFrame:
    """U13."""
    return symbols.join(caps.select("symbol", "market_cap"), "symbol").where(c("market_cap") >= minimum)


def liquid(bars: DataFrame, caps: DataFrame | None = None, min_rows=252, min_avg_volume=0.0, min_price=0.0,
           max_price=float("inf"), min_market_cap=0.0, volume_rows=21) -> DataFrame:
    """The chain of U10-U13 as one aggregate per symbol and one filter."""
    recent = Window.partitionBy("symbol").orderBy(F.desc("date"))
    tagged = bars.select("symbol", "date", "close", "volume", F.row_number().over(recent).alias("_i"))
    out = tagged.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(F.when(c("_i") <= volume_rows, c("volume"))).alias("avg_volume"),
        F.max_by("close", "date").alias("last_close"))
    out = out.where((c("n_rows") >= min_rows) & (c("avg_volume") >= min_avg_volume)
                    & (c("last_close") >= min_price) & (c("last_close") <= max_price))
    return min_cap(out, caps, min_market_cap) if caps is not None else out


def with_history(bars: DataFrame, dates: DataFrame, n=252) -> DataFrame:
    """(symbol, as_of) with at least n rows up to the date."""
    from factorframe.operators.align import history_upto

    return history_upto(bars, dates).where(c("n_rows") >= n)


def active_at(symbols: DataFrame, delistings: DataFrame, as_of) -> DataFrame:
    """U16."""
    gone = delistings.where(c("dlstdt") <= F.lit(as_of).cast("date")).select("symbol").distinct()
    return symbols.join(gone, "symbol", "left_anti")


def delisting_reason(code) -> Column:
    """U18."""
    return F.coalesce(_lookup(DELISTING_CODES, F.substring(c(code), 1, 3)), F.lit("unknown"))


def delisting_return(reason, given=None) -> Column:
    """The stated return, else the rate of the reason."""
    rate = F.coalesce(_lookup(DELISTING_RETURNS, F.lower(c(reason))), F.lit(DEFAULT_DELISTING_RETURN))
    return F.coalesce(c(given), rate) if given is not None else rate


def with_delisting(delistings: DataFrame) -> DataFrame:
    """Events with reason and return."""
    out = delistings.withColumn("reason", delisting_reason("dlstcd"))
    return out.withColumn("delisting_return", delisting_return("reason"))


def adjust_returns(returns: DataFrame, events: DataFrame, value="r") -> DataFrame:
    """Compounds the delisting return into the period return of the symbol."""
    d = events.select("symbol", "delisting_return")
    out = returns.join(d, "symbol", "left")
    adjusted = F.when(c("delisting_return").isNull(), c(value)).otherwise(
        (1 + c(value)) * (1 + c("delisting_return")) - 1)
    return out.withColumn("adjusted", adjusted).drop("delisting_return")


def delisting_summary(events: DataFrame) -> DataFrame:
    """U19."""
    return events.groupBy("reason").agg(
        F.count(F.lit(1)).alias("n"), F.avg("delisting_return").alias("avg_return")).orderBy(F.desc("n"), "reason")


def overlap(a: DataFrame, b: DataFrame, key="symbol") -> DataFrame:
    """(symbol, status) with both, only_first or only_second."""
    x = a.select(key).distinct().withColumn("_a", F.lit(1))
    y = b.select(key).distinct().withColumn("_b", F.lit(1))
    status = F.when(c("_a").isNotNull() & c("_b").isNotNull(), "both").when(c("_a").isNotNull(), "only_first")
    return x.join(y, key, "full_outer").select(key, status.otherwise("only_second").alias("status"))


def between(df: DataFrame, start=None, end=None, order="date") -> DataFrame:
    """U21."""
    if start is not None:
        df = df.where(c(order) >= F.lit(start).cast("date"))
    return df.where(c(order) <= F.lit(end).cast("date")) if end is not None else df


def cross_section(df: DataFrame, day, order="date") -> DataFrame:
    """Rows of the date, or of the nearest date that exists (the earlier on a tie)."""
    gap = F.struct(F.abs(F.datediff(c(order), F.lit(day).cast("date"))), c(order))
    at = df.agg(F.min(gap).alias("_g")).select(c("_g")[order].alias(order))
    return df.join(F.broadcast(at), order, "left_semi")


def series_of(df: DataFrame, symbol: str) -> DataFrame:
    """U22."""
    return df.where(c("symbol") == symbol)


def signals_in(signals: DataFrame, universe: DataFrame) -> DataFrame:
    """U23."""
    return signals.join(universe.select("symbol").distinct(), "symbol", "left_semi")


def cap_from_shares(df: DataFrame, shares="shares", price="price", minimum=0.0, n: int | None = None, ties="row_id") -> DataFrame:
    """Shares in thousands times price, above a threshold, largest n."""
    out = df.withColumn("market_cap", c(shares) * 1000 * c(price)).where(c("market_cap") > minimum)
    return ranks.top_n(out, [], [F.desc("market_cap"), F.asc(ties)], n) if n else out


def available(universe: DataFrame, signals: DataFrame, bars: DataFrame, min_share=0.5) -> DataFrame:
    """(symbols, usable, share, enough) and see ``available_symbols`` for the list."""
    have = available_symbols(universe, signals, bars).withColumn("_h", F.lit(1))
    out = universe.select("symbol").distinct().join(have, "symbol", "left").agg(
        F.count(F.lit(1)).alias("symbols"), F.count("_h").alias("usable"))
    out = out.withColumn("share", c("usable") / F.nullif(c("symbols"), F.lit(0)))
    return out.withColumn("enough", c("share") >= min_share)


def available_symbols(universe: DataFrame, signals: DataFrame, bars: DataFrame) -> DataFrame:
    out = universe.select("symbol").distinct()
    for side in (signals, bars):
        out = out.join(side.select("symbol").distinct(), "symbol", "left_semi")
    return out
