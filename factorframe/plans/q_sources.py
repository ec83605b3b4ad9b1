"""Queries S1-S15: tables derived from the given ones are written in the format at hand and read back."""

from pyspark.sql import functions as F

from factorframe.operators import portfolio, transforms
from factorframe.plans.catalog import query
from factorframe.sources import io
from factorframe.streaming.storage import work_path


def _csv(df, spark, name):
    path = work_path(spark, name)
    df.write.option("header", "true").csv(path)
    return path


@query("s01_read_bars", "bars", "SELECT symbol, date, close FROM bars WHERE date BETWEEN DATE '1996-06-01' AND DATE '1998-02-28'", "close:3")
def _(p):
    path = work_path(p.spark, "bars")
    io.write_bars(p.bars, path)
    return io.read_bars(p.spark, path, "1996-06-01", "1998-02-28").select("symbol", "date", "close")


@query("s02_merge_bars", "bars", "SELECT symbol, date, close * CASE WHEN volume > 50 THEN 2 ELSE 1 END AS close, volume FROM bars", "close:3")
def _(p):
    old = p.bars.select("symbol", "date", "close", "volume", F.lit(1).alias("load_ts"))
    new = p.bars.where("volume > 50").select("symbol", "date", (2 * F.col("close")).alias("close"), "volume", F.lit(2).alias("load_ts"))
    return io.merge_bars(old, new).drop("load_ts")


@query("s03_missing_ranges", "bars", """WITH w AS (SELECT symbol, DATE '1994-06-01' + CAST(100 * (bno % 9) AS INTEGER) AS start, DATE '2001-06-01' AS "end" FROM
      (SELECT DISTINCT symbol, CAST(split_part(symbol, '#', 2) AS INTEGER) AS bno FROM bars) UNION ALL SELECT n_name, DATE '1999-01-01', DATE '1999-12-31' FROM nation),
    h AS (SELECT symbol, min(date) AS a, max(date) AS b FROM bars GROUP BY 1)
    SELECT w.symbol, start, "end" FROM w LEFT JOIN h ON w.symbol = h.symbol WHERE a IS NULL
    UNION ALL SELECT w.symbol, start, least("end", a - 1) FROM w JOIN h ON w.symbol = h.symbol WHERE start < a
    UNION ALL SELECT w.symbol, greatest(start, b + 1), "end" FROM w JOIN h ON w.symbol = h.symbol WHERE "end" > b""")
def _(p):
    bno = F.substring_index("symbol", "#", -1).cast("int")
    d = lambda x: F.lit(x).cast("date")
    w = p.bars.select("symbol").distinct().select("symbol", F.date_add(d("1994-06-01"), 100 * (bno % 9)).alias("start"), d("2001-06-01").alias("end"))
    n = p.table("nation").select(F.col("n_name").alias("symbol"), d("1999-01-01").alias("start"), d("1999-12-31").alias("end"))
    return io.missing_ranges(p.bars, w.unionByName(n))


FC = ["MKT", "SMB", "HML", "RMW", "CMA", "RF"]


@query("s04_read_factors", "factors", "SELECT * FROM factors WHERE RMW <> 0", " ".join(f"{x}:8" for x in FC))
def _(p):
    return io.read_factors(p.spark, _csv(p.factors.withColumn("RMW", F.when(F.col("RMW") != 0, F.col("RMW"))), p.spark, "factors"))


@query("s05_parse_factor_text", "factors", "SELECT date, round(MKT * 100, 6) / 100 AS MKT, round(SMB * 100, 6) / 100 AS SMB FROM factors", "MKT:7 SMB:7")
def _(p):
    num = lambda x: F.format_number(F.col(x) * 100, 6)
    lines = p.factors.select(F.concat_ws("   ", F.date_format("date", "yyyyMMdd"), num("MKT"), num("SMB")).alias("value"))
    prose = p.table("region").select(F.concat(F.lit("This file covers "), "r_name").alias("value"))
    path = work_path(p.spark, "text")
    prose.unionByName(lines).write.text(path)
    return io.parse_factor_text(p.spark, path, ["MKT", "SMB"])


@query("s06_read_country_risk", "", """SELECT n_name AS country, n_nationkey / 1000 AS equity_risk_premium, CASE WHEN n_nationkey % 5 = 0 THEN 0 ELSE n_regionkey / 100 END AS default_spread,
    n_nationkey / 500 AS country_risk_premium, CAST(n_regionkey / 10 AS DOUBLE) AS corporate_tax_rate FROM nation""", "equity_risk_premium:6 default_spread:6 country_risk_premium:6 corporate_tax_rate:6")
def _(p):
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    raw = p.table("nation").select(
        F.col("n_name").alias("country"), F.concat((k / 10).cast("string"), F.lit("%")).alias("equity_risk_premium"),
        F.when(k % 5 == 0, "#N/A").otherwise((r / 100).cast("string")).alias("default_spread"),
        (k / 500).cast("string").alias("country_risk_premium"), (r * 10).cast("string").alias("corporate_tax_rate"))
    return io.read_country_risk(p.spark, _csv(raw, p.spark, "risk"))


@query("s07_read_benchmark", "", """SELECT date, v AS open, v AS high, v AS low, v AS close, CAST(0 AS DOUBLE) AS volume FROM (SELECT CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS v FROM orders GROUP BY 1)
    WHERE date >= DATE '1997-01-01'""", "open:1 high:1 low:1 close:1")
def _(p):
    b = p.table("orders").groupBy(F.to_date("o_orderdate").alias("Date")).agg(F.sum("o_totalprice").alias("Price"))
    return io.read_benchmark(p.spark, _csv(b, p.spark, "benchmark"), start="1997-01-01")


@query("s08_read_universe", "universe", """SELECT symbol, weight FROM (SELECT upper(regexp_replace(ticker, '[^A-Za-z0-9.\\-]', '', 'g')) || '.DE' AS symbol, weight, row_id FROM universe
    WHERE lower(region) IN ('asia', 'europe') AND weight >= 500) ORDER BY weight DESC LIMIT 20""", "weight:2")
def _(p):
    raw = p.universe.select("ticker", F.lit("GR").alias("country_code"), "region", "weight")
    out = io.read_universe(p.spark, _csv(raw, p.spark, "universe"), {"regions": ["asia", "Europe"], "min_weight": 500, "max_stocks": 20})
    return out.select("symbol", F.col("weight").cast("double").alias("weight"))


@query("s09_read_metadata", "meta", "SELECT upper(symbol) AS symbol, CASE WHEN market_cap > 2e6 THEN market_cap / 1e3 ELSE market_cap END AS market_cap, CASE WHEN sector <> 'Energy' THEN pb_ratio END AS pb_ratio FROM meta",
       "market_cap:3 pb_ratio:6")
def _(p):
    cap = F.when(F.col("market_cap") > 2e6, F.col("market_cap") * 1e6)
    raw = p.meta.select(F.concat(F.lit(" "), F.lower("symbol")).alias("Ticker"), F.coalesce(cap, F.col("market_cap")).alias("Market Cap"),
                        F.when(F.col("sector") == "Energy", -1.0).otherwise(F.col("pb_ratio")).alias("PB"))
    return io.read_metadata(p.spark, _csv(raw, p.spark, "metadata"))


@query("s10_clean_holdings", "", """SELECT upper(replace(p_name, ' ', '')) AS ticker, 'FUND' AS source_etf, 'UW' AS country_code, p_brand AS section, p_retailprice AS weight, CAST(p_size AS DOUBLE) AS shares, p_retailprice AS price
    FROM part""", "weight:2 price:2")
def _(p):
    t = p.table("part")
    text = F.format_number("p_retailprice", 2)
    row = t.select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("row_index"), F.col("p_name").alias("Name"),
                                               F.concat(F.upper(F.regexp_replace("p_name", " ", "")), F.lit(" UW Equity")).alias("Ticker"),
                                               text.alias("Weight"), F.col("p_size").cast("string").alias("Shares"), text.alias("Price"))
    none = F.lit(None).cast("string")
    head = t.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("p_brand").alias("file"), F.lit(-1).cast("long").alias("row_index"), F.concat("p_brand", F.lit(" ("), F.col("n").cast("string"), F.lit(" members)")).alias("Name"),
        none.alias("Ticker"), none.alias("Weight"), none.alias("Shares"), none.alias("Price"))
    return io.clean_holdings(row.unionByName(head), "FUND")


@query("s11_strategy_returns", "strat", "SELECT strategy, date, daily_return FROM strat", "daily_return:8")
def _(p):
    path = work_path(p.spark, "returns")
    p.strat.select("strategy", "date", "daily_return").write.partitionBy("strategy").option("header", "true").csv(path)
    names = [r["strategy"] for r in p.strat.select("strategy").distinct().collect()]  # a few, one directory each
    got = io.read_strategy_returns(p.spark, path, [f"strategy={n}" for n in names])
    return got.withColumn("strategy", F.regexp_replace("strategy", "^strategy=", ""))


@query("s12_extract_returns", "strat", "SELECT strategy, date, daily_return FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY date) AS i FROM strat) WHERE i > 1", "daily_return:7")
def _(p):
    eq = transforms.drawdown(p.strat).select("strategy", "date", F.col("cumulative_return").alias("portfolio_value"))
    return io.extract_returns(eq)


@query("s13_write_results", "strat", "SELECT strategy, date, daily_return FROM strat", "daily_return:8")
def _(p):
    path = work_path(p.spark, "results")
    io.write_results(p.strat, path)
    return p.spark.read.parquet(path).select("strategy", "date", "daily_return")


RECS = "(SELECT w.symbol, w.weight, coalesce(s.signal, 0) AS signal_strength FROM weights w LEFT JOIN signals s ON w.strategy = s.strategy AND w.date = s.date AND w.symbol = s.symbol WHERE w.weight > 0)"


@query("s14_write_predictions", "weights signals", f"SELECT count(*) AS positions, sum(weight) AS total_weight, max(weight) AS largest_weight, avg(signal_strength) AS mean_signal FROM {RECS}",
       "total_weight:4 largest_weight:6 mean_signal:6")
def _(p):
    recs = portfolio.recommendations(p.weights, p.signals, p.meta.select("symbol", F.col("sector").alias("box")))
    path = work_path(p.spark, "predictions")
    io.write_predictions(recs, path)
    back = p.spark.read.json(f"{path}/json").select("weight", "signal_strength")
    return io.prediction_summary(back)


@query("s15_stamp_source", "bars", "SELECT symbol, date, 'daily' AS data_source, 'fills' AS provider, true AS stamped FROM bars")
def _(p):
    return io.stamp_source(p.bars, "daily", "fills").select("symbol", "date", "data_source", "provider", F.col("fetched_at").isNotNull().alias("stamped"))
