"""Queries U1-U25 and J1-J15."""

from pyspark.sql import functions as F

from factorframe.functions import joins
from factorframe.functions.windows import change
from factorframe.operators import align, universe as u
from factorframe.plans.catalog import query
from factorframe.plans.q_technical import chg, lag, win

SUF = ["LN", "FP", "GR", "C1", "C2", "HK", "SS", "JP", "US", "T"]
RAWSQL = f"""(SELECT s_suppkey AS row_id, ' ' || lower(s_name) || '/' AS messy,
  (CASE s_suppkey % 3 WHEN 0 THEN CAST(s_suppkey AS VARCHAR) WHEN 1 THEN '6' || CAST(s_suppkey AS VARCHAR) ELSE 'ab-c' END)
  || CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE '.' || ({SUF!r})[CAST(s_suppkey % 10 AS INTEGER) + 1] END AS explicit,
  (['UW', 'HK', 'TT', 'CN', 'GR', 'XX', NULL])[CAST(s_nationkey % 7 AS INTEGER) + 1] AS code FROM supplier)"""


def _raw(p):
    k = F.col("s_suppkey")
    base = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.concat(F.lit("6"), k.cast("string"))).otherwise("ab-c")
    suf = F.element_at(F.array(*[F.lit(s) for s in SUF]), (k % 10 + 1).cast("int"))
    codes = F.array(*[F.lit(s) for s in ("UW", "HK", "TT", "CN", "GR", "XX")], F.lit(None).cast("string"))
    return p.table("supplier").select(
        k.alias("row_id"), F.concat(F.lit(" "), F.lower("s_name"), F.lit("/")).alias("messy"),
        F.concat(base, F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("."), suf))).alias("explicit"),
        F.element_at(codes, F.col("s_nationkey") % 7 + 1).alias("code"))


@query("u01_normalize_ticker", "", f"""SELECT row_id, nullif(upper(regexp_replace(trim(messy), '[^A-Za-z0-9.\\-]', '', 'g')), '') AS ticker FROM {RAWSQL}""")
def _(p):
    return _raw(p).select("row_id", u.normalize_ticker("messy").alias("ticker"))


@query("u02_normalize_suffix", "", f"""SELECT row_id, CASE WHEN position('.' IN s) = 0 THEN s ELSE
      (CASE WHEN m2 = 'HK' AND regexp_full_match(base, '\\d+') AND length(base) < 4 THEN lpad(base, 4, '0') ELSE base END) || '.' || m2 END AS symbol FROM
    (SELECT *, CASE WHEN m = 'SS' AND regexp_full_match(base, '[A-Z\\-]+') THEN 'ST' ELSE m END AS m2 FROM
     (SELECT *, CASE WHEN suf IN ('C1', 'C2') THEN CASE WHEN regexp_full_match(base, '6\\d+') THEN 'SS' ELSE 'SZ' END
        WHEN suf = 'LN' THEN 'L' WHEN suf = 'FP' THEN 'PA' WHEN suf = 'GR' THEN 'DE' WHEN suf = 'JP' THEN 'T' ELSE suf END AS m FROM
      (SELECT row_id, upper(explicit) AS s, split_part(upper(explicit), '.', 1) AS base, split_part(upper(explicit), '.', 2) AS suf FROM {RAWSQL})))""")
def _(p):
    return _raw(p).select("row_id", u.normalize_suffix("explicit").alias("symbol"))


@query("u03_symbol_candidates", "", f"""SELECT row_id, CASE code WHEN 'UW' THEN [t] WHEN 'HK' THEN [t || '.HK', t] WHEN 'TT' THEN [t || '.TW', t || '.TWO', t]
    WHEN 'CN' THEN [t || '.TO', t || '.V', t] WHEN 'GR' THEN [t || '.DE', t] ELSE [t] END AS candidates
    FROM (SELECT row_id, code, upper(explicit) AS t FROM {RAWSQL})""")
def _(p):
    return _raw(p).select("row_id", u.symbol_candidates("explicit", "code").alias("candidates"))


CODES = ["US", "LN", "HK", "JP", "JT", "KS", "KQ", "SS", "SZ", "TT", "AU", "TO", "V", "CN", "SW", "VX", "GR", "FP", "NA", "MI", "BR", "OL", "ST", "XX", ""]
_SUFFIX = "map {'LN': '.L', 'HK': '.HK', 'JP': '.T', 'JT': '.T', 'TT': '.TW', 'AU': '.AX', 'CN': '.TO', 'GR': '.DE', 'FP': '.PA', 'NA': '.AS', 'US': ''}"


@query("u03_provider_candidates", "universe", f"""SELECT row_id, CASE WHEN k IN ('TO', 'CN') THEN [t || '.TO', t || '.V', t] WHEN k = 'V' THEN [t || '.V', t || '.TO', t]
    WHEN k = 'TT' THEN [t || '.TW', t || '.TWO', t] WHEN k = 'SW' THEN [t || '.SW', t || '.VX', t] WHEN k = 'VX' THEN [t || '.VX', t || '.SW', t]
    WHEN k IN ('US', 'XX', '') THEN [t] ELSE [t || coalesce({_SUFFIX}[k], '.' || k), t] END AS candidates
    FROM (SELECT row_id, upper(ticker) AS t, ({CODES})[code % 25 + 1] AS k FROM universe)""")
def _(p):
    code = F.get(F.array(*map(F.lit, CODES)), (F.col("code") % 25).cast("int"))
    return p.universe.select("row_id", u.provider_candidates("ticker", F.lower(code)).alias("candidates"))


@query("u04_minimum_weight", "universe", "SELECT ticker, weight FROM universe WHERE weight >= 1000")
def _(p):
    return u.at_least(p.universe.select("ticker", F.col("weight").cast("string").alias("weight")), "weight", 1000).select(
        "ticker", F.col("weight").cast("double").alias("weight"))


@query("u05_include_exclude", "universe", "SELECT ticker, region, country FROM universe WHERE lower(region) IN ('asia', 'europe') AND lower(country) NOT IN ('nation_3', 'nation_12')")
def _(p):
    return u.exclude(u.include(p.universe, "region", [" Asia ", "EUROPE"]), "country", ["NATION_3", "nation_12"]).select("ticker", "region", "country")


@query("u06_top_per_box", "universe", """SELECT ticker, region, weight FROM (SELECT *, row_number() OVER (PARTITION BY region
    ORDER BY weight DESC NULLS LAST, row_id) AS i FROM universe) WHERE i <= 5""")
def _(p):
    return u.top_per_box(p.universe, "region", 5, "weight").select("ticker", "region", "weight")


@query("u07_box_gate", "universe", """SELECT r_name AS region, count(ticker) AS n_rows, count(ticker) >= 20 AS met FROM region
    LEFT JOIN universe ON r_name = region GROUP BY 1""")
def _(p):
    return u.box_gate(p.universe, p.table("region").select(F.col("r_name").alias("region")), "region", 20)


@query("u08_largest", "universe", "SELECT ticker, weight FROM universe ORDER BY weight DESC, row_id LIMIT 30")
def _(p):
    return u.largest(p.universe, 30).select("ticker", "weight")


@query("u09_first_of_each", "", "SELECT p_brand AS symbol, min(p_partkey) AS row_id, arg_min(p_name, p_partkey) AS p_name FROM part GROUP BY 1")
def _(p):
    t = p.table("part").select(F.col("p_brand").alias("symbol"), F.col("p_partkey").alias("row_id"), "p_name")
    return u.first_of_each(t)


@query("u10_minimum_history", "bars", "SELECT symbol, count(*) AS n_rows FROM bars GROUP BY 1 HAVING count(*) >= 1500")
def _(p):
    return u.min_history(p.bars, 1500)


LAST = "(SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS i FROM bars)"


@query("u11_minimum_volume", "bars", f"SELECT symbol, avg(volume) AS avg_volume FROM {LAST} WHERE i <= 21 GROUP BY 1 HAVING avg(volume) >= 25", "avg_volume:6")
def _(p):
    return u.min_volume(p.bars, 25)


@query("u12_price_between", "bars", "SELECT * FROM (SELECT symbol, arg_max(close, date) AS last_close FROM bars GROUP BY 1) WHERE last_close BETWEEN 1000 AND 10000", "last_close:3")
def _(p):
    return u.price_between(p.bars, 1000, 10000)


@query("u13_minimum_cap", "meta", "SELECT symbol, market_cap FROM meta WHERE market_cap >= 2000000", "market_cap:2")
def _(p):
    return u.min_cap(p.meta.select("symbol"), p.meta, 2000000)


@query("u14_liquid_chain", "bars meta", f"""SELECT symbol, n_rows, avg_volume, last_close, market_cap FROM
    (SELECT symbol, count(*) AS n_rows, avg(volume) FILTER (i <= 21) AS avg_volume, arg_max(close, date) AS last_close FROM {LAST} GROUP BY 1)
    JOIN meta USING (symbol) WHERE n_rows >= 252 AND avg_volume >= 20 AND last_close BETWEEN 500 AND 20000 AND market_cap >= 1500000""",
       "avg_volume:6 last_close:3 market_cap:2")
def _(p):
    return u.liquid(p.bars, p.meta, 252, 20, 500, 20000, 1500000)


ENDS = "(SELECT max(date) AS as_of FROM bars GROUP BY strftime(date, '%Y-%m'))"


def _month_ends(p):
    from factorframe.operators.transforms import rebalance_dates

    return rebalance_dates(p.bars, "monthly").select(F.col("rebalance_date").alias("as_of"))


@query("u15_history_at_rebalance", "bars", f"""SELECT symbol, as_of, max(date) AS last_date, count(*) AS n_rows FROM bars JOIN {ENDS} ON date <= as_of
    GROUP BY 1, 2 HAVING count(*) >= 252""")
def _(p):
    return u.with_history(p.bars, _month_ends(p))


@query("u16_active_at", "universe delistings", "SELECT ticker AS symbol FROM universe WHERE ticker NOT IN (SELECT symbol FROM delistings WHERE dlstdt <= DATE '1998-02-15')")
def _(p):
    return u.active_at(p.universe.select(F.col("ticker").alias("symbol")), p.delistings, "1998-02-15")


REASON = "CASE dlstcd WHEN '200' THEN 'merger' WHEN '400' THEN 'liquidation' WHEN '500' THEN 'exchange' WHEN '100' THEN 'performance' ELSE 'unknown' END"
DRET = "CASE dlstcd WHEN '200' THEN 0.0 WHEN '400' THEN -0.55 WHEN '500' THEN -0.55 ELSE -0.30 END"


@query("u17_adjusted_returns", "delistings", f"""SELECT s_suppkey AS row_id, s_name AS symbol, CASE WHEN symbol IS NULL THEN r ELSE (1 + r) * (1 + {DRET}) - 1 END AS adjusted
    FROM (SELECT *, s_acctbal / 1e5 AS r FROM supplier) LEFT JOIN delistings ON s_name = symbol""", "adjusted:8")
def _(p):
    r = p.table("supplier").select(F.col("s_suppkey").alias("row_id"), F.col("s_name").alias("symbol"), (F.col("s_acctbal") / 1e5).alias("r"))
    return u.adjust_returns(r, u.with_delisting(p.delistings)).select("row_id", "symbol", "adjusted")


@query("u18_delisting_reasons", "delistings", f"SELECT symbol, dlstdt, dlstcd, dlprc, {REASON} AS reason, CAST({DRET} AS DOUBLE) AS delisting_return FROM delistings")
def _(p):
    return u.with_delisting(p.delistings)


@query("u19_delisting_summary", "delistings", f"SELECT {REASON} AS reason, count(*) AS n, avg({DRET}) AS avg_return FROM delistings GROUP BY 1", "avg_return:6")
def _(p):
    return u.delisting_summary(u.with_delisting(p.delistings))


@query("u20_universe_overlap", "bars", """SELECT coalesce(a.symbol, b.symbol) AS symbol, CASE WHEN a.symbol IS NOT NULL AND b.symbol IS NOT NULL THEN 'both'
    WHEN a.symbol IS NOT NULL THEN 'only_first' ELSE 'only_second' END AS status FROM
    (SELECT DISTINCT symbol FROM bars WHERE close > 60000) a FULL JOIN (SELECT DISTINCT symbol FROM bars WHERE close < 25) b ON a.symbol = b.symbol""")
def _(p):
    return u.overlap(p.bars.where("close > 60000"), p.bars.where("close < 25"))


@query("u21_date_range", "bars", "SELECT symbol, date, volume FROM bars WHERE date BETWEEN DATE '1996-01-01' AND DATE '1997-06-30'")
def _(p):
    return u.between(p.bars, "1996-01-01", "1997-06-30").select("symbol", "date", "volume")


@query("u22_cross_section", "bars", """SELECT symbol, date, volume FROM bars WHERE date = (SELECT date FROM bars
    ORDER BY abs(date - DATE '2031-01-01'), date LIMIT 1) UNION ALL SELECT symbol, date, volume FROM bars WHERE date = DATE '1997-03-05'""")
def _(p):
    b = p.bars.select("symbol", "date", "volume")
    return u.cross_section(b, "2031-01-01").unionByName(u.cross_section(b, "1997-03-05")).select("symbol", "date", "volume")


@query("u22_time_series", "bars", "SELECT symbol, date, volume FROM bars WHERE symbol = 'Brand#7'")
def _(p):
    return u.series_of(p.bars, "Brand#7").select("symbol", "date", "volume")


@query("u23_signals_in_universe", "signals meta", "SELECT strategy, date, symbol, signal FROM signals WHERE symbol IN (SELECT symbol FROM meta WHERE pb_ratio > 2.5)", "signal:8")
def _(p):
    return u.signals_in(p.signals, p.meta.where("pb_ratio > 2.5")).select("strategy", "date", "symbol", "signal")


@query("u24_cap_from_shares", "", """SELECT p_partkey AS row_id, p_size * 1000 * p_retailprice AS market_cap FROM part WHERE p_size * 1000 * p_retailprice > 1e7
    ORDER BY market_cap DESC, row_id LIMIT 100""", "market_cap:2")
def _(p):
    t = p.table("part").select(F.col("p_partkey").alias("row_id"), F.col("p_size").alias("shares"), F.col("p_retailprice").alias("price"))
    return u.cap_from_shares(t, minimum=1e7, n=100).select("row_id", "market_cap")


@query("u25_availability", "signals bars", """SELECT *, usable / symbols AS share, usable / symbols >= 0.5 AS enough FROM
    (SELECT count(*) AS symbols, count(*) FILTER (symbol IN (SELECT symbol FROM signals) AND symbol IN (SELECT symbol FROM bars)) AS usable
     FROM (SELECT DISTINCT p_brand AS symbol FROM part UNION SELECT n_name FROM nation))""", "share:6")
def _(p):
    wanted = p.table("part").select(F.col("p_brand").alias("symbol")).union(p.table("nation").select("n_name"))
    return u.available(wanted, p.signals, p.bars)
