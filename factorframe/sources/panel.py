"""Panels built from the driver's tables (definitions in FIXTURES.md).

Prices there jump by orders of magnitude, so compounded statistics use the
damped return ``0.01 * tanh(close / previous close - 1)``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorframe.functions.windows import change, ordered


def damped(x):
    return F.lit(0.01) * F.tanh(x)


class Panel:
    """Lazy tables of one data directory; nothing is read or computed until used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def fills(self) -> DataFrame:
        """One row per line item: symbol, date, px and the ordering columns."""
        part = self.table("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
        cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
                "l_returnflag", "l_shipdate", "l_discount"]
        return (
            self.table("lineitem").select(*cols).join(part, "l_partkey")
            .withColumn("date", F.to_date("l_shipdate"))
            .withColumn("px", F.col("l_extendedprice") / F.col("l_quantity"))
        )

    @cached_property
    def bars(self) -> DataFrame:
        """Order within a day: order key, line number, part key, packed into one decimal of full width.

        A fixed-width decimal keeps min_by / max_by in hash aggregation (a struct key would sort every
        raw row).  Line numbers under 10^6 and part keys under 10^18 fit; beyond that the ANSI overflow is an error.
        """
        line = (F.col("l_orderkey") * 1_000_000 + F.col("l_linenumber")).cast("decimal(19,0)")
        seq = line * F.lit(10**18).cast("decimal(19,0)") + F.col("l_partkey").cast("decimal(18,0)")
        return self.fills.withColumn("seq", seq).groupBy("symbol", "date").agg(
            F.min_by("px", "seq").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
            F.max_by("px", "seq").alias("close"), F.sum("l_quantity").alias("volume"),
        )

    @cached_property
    def dirty(self) -> DataFrame:
        """Bars with planted faults: negative or missing close, swapped or too narrow range, negative volume."""
        k = F.col("volume").cast("long") % 11
        pick = lambda *cases: F.coalesce(*[F.when(k == n, v) for n, v in cases[:-1]], cases[-1])
        h, l, cl, v = (F.col(x) for x in ("high", "low", "close", "volume"))
        return self.bars.select(
            "symbol", "date", "open",
            pick((5, l), (6, F.col("open") * 0.5), h).alias("high"), pick((5, h), l).alias("low"),
            F.when(k == 7, None).otherwise(pick((3, -cl), cl)).alias("close"), pick((8, -v), v).alias("volume"),
        )

    @cached_property
    def ret(self) -> DataFrame:
        return (
            self.bars.select("symbol", "date", "close", "volume", damped(change("close")).alias("r"))
            .where(F.col("r").isNotNull())
        )

    @cached_property
    def meta(self) -> DataFrame:
        bno = F.substring_index(F.col("symbol"), "#", -1).cast("int")
        return (
            self.table("part").groupBy(F.col("p_brand").alias("symbol"))
            .agg(F.sum(F.col("p_retailprice") * F.col("p_size")).alias("market_cap"),
                 (F.avg("p_size") / 10).alias("pb_ratio"))
            .withColumn("country", F.concat(F.lit("NATION_"), (bno - 1).cast("string")))
            .withColumn("region", F.when(bno % 3 == 0, "emerging").otherwise("developed"))
            .withColumn("sector", F.element_at(
                F.array(*[F.lit(s) for s in ("Technology", "Healthcare", "Energy", "Utilities")]), bno % 4 + 1))
        )

    @cached_property
    def boxes(self) -> DataFrame:
        from factorframe.operators import classify

        return classify.box_keys(classify.classify(self.meta))

    @cached_property
    def factors(self) -> DataFrame:
        """Five long-short averages per date from fixed splits of the symbols, and a constant risk-free rate."""
        bno = F.substring_index(F.col("symbol"), "#", -1).cast("int")
        r = self.ret.select("date", "r", bno.alias("k"))

        def spread(cond):
            return F.coalesce(F.avg(F.when(cond, F.col("r"))) - F.avg(F.when(~cond, F.col("r"))), F.lit(0.0))

        k = F.col("k")
        return r.groupBy("date").agg(
            F.avg("r").alias("MKT"), spread(k <= 12).alias("SMB"), spread(k % 2 == 0).alias("HML"),
            spread(k % 3 == 0).alias("RMW"), spread(k % 5 <= 1).alias("CMA"),
        ).withColumn("RF", F.lit(0.0001))

    @cached_property
    def signals(self) -> DataFrame:
        b = self.bars.select("symbol", "date", change("close", 5).alias("m"), change("close", 1).alias("d"))
        s = b.select("date", "symbol", F.explode(F.create_map(
            F.lit("momentum"), F.tanh("m"), F.lit("reversal"), -F.tanh("d"),
        )).alias("strategy", "signal"))
        return s.where(F.col("signal").isNotNull()).select("strategy", "date", "symbol", "signal")

    @cached_property
    def weights(self) -> DataFrame:
        from factorframe.operators import signals

        return signals.long_only(self.signals)

    @cached_property
    def strat(self) -> DataFrame:
        daily = self.table("orders").groupBy(
            F.col("o_orderpriority").alias("strategy"), F.to_date("o_orderdate").alias("date")
        ).agg(F.sum("o_totalprice").alias("v"))
        return (
            daily.select("strategy", "date", damped(change("v", keys="strategy")).alias("daily_return"))
            .where(F.col("daily_return").isNotNull())
        )

    @cached_property
    def benchmark(self) -> DataFrame:
        return self.strat.groupBy("date").agg(F.avg("daily_return").alias("bench_return"))

    @cached_property
    def preds(self) -> DataFrame:
        from factorframe.functions.joins import next_in_time

        e = self.table("events").select("event_id", "ts", "user_id", "event_type", "value")
        e = next_in_time(e, "user_id", ["ts", "event_id"], F.to_date("ts"), ["value", "ts"])
        return e.select(
            F.col("event_id").alias("prediction_id"), F.col("event_type").alias("model_id"), "ts",
            F.col("value").alias("prediction"), F.col("next_value").alias("actual"), F.col("next_ts").alias("actual_ts"),
        )

    @cached_property
    def universe(self) -> DataFrame:
        n = self.table("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("country"),
                                        F.col("n_regionkey").alias("r_regionkey"))
        r = self.table("region").select("r_regionkey", F.col("r_name").alias("region"))
        return (
            self.table("supplier").join(n, "s_nationkey").join(r, "r_regionkey")
            .select(F.col("s_suppkey").alias("row_id"), F.col("s_name").alias("ticker"),
                    F.col("s_acctbal").alias("weight"), "country", "region", F.col("s_nationkey").alias("code"))
        )

    @cached_property
    def delistings(self) -> DataFrame:
        codes = ["200", "400", "500", "100", "999"]
        s = self.table("supplier").where(F.col("s_acctbal") < 2000)
        k = F.col("s_suppkey")
        return s.select(
            F.col("s_name").alias("symbol"),
            F.date_add(F.lit("1998-01-01").cast("date"), (k % 1000).cast("int")).alias("dlstdt"),
            F.element_at(F.array(*[F.lit(c) for c in codes]), (F.col("s_nationkey") % 5 + 1)).alias("dlstcd"),
            F.col("s_acctbal").alias("dlprc"),
        )

    @cached_property
    def trades(self) -> DataFrame:
        """Net fill of a symbol and day: side, quantity, average price (one row per symbol and day)."""
        signed = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
        return (
            self.fills.groupBy("symbol", "date")
            .agg(F.sum(signed).alias("net"), (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price"),
                 F.sum("l_quantity").alias("day_volume"))
            .where("net <> 0")
            .select("symbol", "date", F.when(F.col("net") > 0, "BUY").otherwise("SELL").alias("side"),
                    F.abs("net").alias("quantity"), "price", "day_volume",
                    (F.abs("net") * F.col("price") * 0.001).alias("commission"))
        )


# The same tables as SQL, keyed by name: (needed tables, query).
SQL = {
    "fills": ("", """SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS px,
        l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_returnflag, l_discount
        FROM lineitem JOIN part ON l_partkey = p_partkey"""),
    "bars": ("fills", """SELECT symbol, date,
        first(px ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS open,
        max(px) AS high, min(px) AS low,
        last(px ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS close,
        sum(l_quantity) AS volume FROM fills GROUP BY symbol, date"""),
    "dirty": ("bars", """SELECT symbol, date, open, CASE k WHEN 5 THEN low WHEN 6 THEN open * 0.5 ELSE high END AS high,
        CASE k WHEN 5 THEN high ELSE low END AS low, CASE k WHEN 7 THEN NULL WHEN 3 THEN -close ELSE close END AS close,
        CASE k WHEN 8 THEN -volume ELSE volume END AS volume FROM (SELECT *, CAST(volume AS BIGINT) % 11 AS k FROM bars)"""),
    "ret": ("bars", """SELECT * FROM (SELECT symbol, date, close, volume,
        0.01 * tanh(close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1) AS r FROM bars)
        WHERE r IS NOT NULL"""),
    "meta": ("", """SELECT symbol, market_cap, pb_ratio, 'NATION_' || CAST(bno - 1 AS VARCHAR) AS country,
        CASE WHEN bno % 3 = 0 THEN 'emerging' ELSE 'developed' END AS region,
        CASE bno % 4 WHEN 0 THEN 'Technology' WHEN 1 THEN 'Healthcare' WHEN 2 THEN 'Energy' ELSE 'Utilities' END AS sector
        FROM (SELECT p_brand AS symbol, CAST(split_part(p_brand, '#', 2) AS INTEGER) AS bno,
              sum(p_retailprice * p_size) AS market_cap, avg(p_size) / 10 AS pb_ratio FROM part GROUP BY p_brand)"""),
    "boxes": ("meta", """SELECT m.symbol,
        CASE WHEN market_cap >= c80 THEN 'large' WHEN market_cap >= c20 THEN 'mid' ELSE 'small' END AS size,
        CASE WHEN pb_ratio >= p70 THEN 'growth' WHEN pb_ratio >= p30 THEN 'neutral' ELSE 'value' END AS style,
        region, sector FROM meta m, (SELECT quantile_cont(market_cap, 0.2) AS c20, quantile_cont(market_cap, 0.8) AS c80,
        quantile_cont(pb_ratio, 0.3) AS p30, quantile_cont(pb_ratio, 0.7) AS p70 FROM meta)"""),
    "factors": ("ret", """SELECT date, avg(r) AS MKT,
        coalesce(avg(r) FILTER (k <= 12) - avg(r) FILTER (k > 12), 0) AS SMB,
        coalesce(avg(r) FILTER (k % 2 = 0) - avg(r) FILTER (k % 2 <> 0), 0) AS HML,
        coalesce(avg(r) FILTER (k % 3 = 0) - avg(r) FILTER (k % 3 <> 0), 0) AS RMW,
        coalesce(avg(r) FILTER (k % 5 <= 1) - avg(r) FILTER (k % 5 > 1), 0) AS CMA, CAST(0.0001 AS DOUBLE) AS RF
        FROM (SELECT *, CAST(split_part(symbol, '#', 2) AS INTEGER) AS k FROM ret) GROUP BY date"""),
    "signals": ("bars", """SELECT * FROM (
        SELECT 'momentum' AS strategy, date, symbol, tanh(close / lag(close, 5) OVER (PARTITION BY symbol ORDER BY date) - 1) AS signal FROM bars
        UNION ALL
        SELECT 'reversal', date, symbol, -tanh(close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1) FROM bars)
        WHERE signal IS NOT NULL"""),
    "weights": ("signals", """SELECT strategy, date, symbol,
        CASE WHEN s > 0 THEN greatest(signal, 0) / s ELSE 0 END AS weight
        FROM (SELECT *, sum(greatest(signal, 0)) OVER (PARTITION BY strategy, date) AS s FROM signals)"""),
    "strat": ("", """SELECT * FROM (SELECT strategy, date,
        0.01 * tanh(v / lag(v) OVER (PARTITION BY strategy ORDER BY date) - 1) AS daily_return
        FROM (SELECT o_orderpriority AS strategy, CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS v
              FROM orders GROUP BY 1, 2)) WHERE daily_return IS NOT NULL"""),
    "benchmark_returns": ("strat", "SELECT date, avg(daily_return) AS bench_return FROM strat GROUP BY date"),
    "preds": ("", """SELECT event_id AS prediction_id, event_type AS model_id, ts, value AS prediction,
        lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS actual,
        lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS actual_ts FROM events"""),
    "universe": ("", """SELECT s_suppkey AS row_id, s_name AS ticker, s_acctbal AS weight, n_name AS country,
        r_name AS region, s_nationkey AS code FROM supplier JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey"""),
    "delistings": ("", """SELECT s_name AS symbol, DATE '1998-01-01' + CAST(s_suppkey % 1000 AS INTEGER) AS dlstdt,
        (['200', '400', '500', '100', '999'])[s_nationkey % 5 + 1] AS dlstcd, s_acctbal AS dlprc
        FROM supplier WHERE s_acctbal < 2000"""),
    "trades": ("fills", """SELECT symbol, date, CASE WHEN net > 0 THEN 'BUY' ELSE 'SELL' END AS side, abs(net) AS quantity,
        price, day_volume, abs(net) * price * 0.001 AS commission
        FROM (SELECT symbol, date, sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS net,
              sum(l_extendedprice) / sum(l_quantity) AS price, sum(l_quantity) AS day_volume FROM fills GROUP BY 1, 2)
        WHERE net <> 0"""),
}
