"""Queries J1-J15."""

from pyspark.sql import functions as F

from factorframe.functions import joins
from factorframe.functions.windows import change
from factorframe.operators import align, transforms
from factorframe.plans.catalog import query
from factorframe.plans.q_technical import chg, lag, win

# month-end factor rows: what is known at a later day must be carried forward
MF = "(SELECT f.* FROM factors f JOIN (SELECT max(date) AS d FROM factors GROUP BY strftime(date, '%Y-%m')) ON f.date = d)"
FC = ["MKT", "SMB"]


def _month_factors(p):
    ends = transforms.rebalance_dates(p.factors, "monthly").select(F.col("rebalance_date").alias("date"))
    return p.factors.join(ends, "date", "left_semi")


@query("j01_returns_with_factors", "ret factors", "SELECT symbol, r.date, r, MKT, SMB FROM ret r JOIN factors f ON r.date = f.date", "r:9 MKT:9 SMB:9")
def _(p):
    return p.ret.select("symbol", "date", "r").join(p.factors.select("date", *FC), "date")


@query("j02_outer_blocks", "bars ret", """SELECT coalesce(a.date, b.date) AS date, coalesce(a.symbol, b.symbol) AS symbol, a.x, b.r
    FROM (SELECT date, symbol, volume AS x FROM bars WHERE volume > 50) a FULL JOIN (SELECT date, symbol, r FROM ret WHERE r > 0) b
    ON a.date = b.date AND a.symbol = b.symbol""", "r:9")
def _(p):
    a = p.bars.where("volume > 50").select("date", "symbol", F.col("volume").alias("x"))
    b = p.ret.where("r > 0").select("date", "symbol", "r", F.lit(0.0).alias("x"))
    return align.outer_blocks([a, b])


@query("j03_asof", "signals", """SELECT b.strategy, b.symbol, b.date, s.date AS signal_date, s.signal FROM signals b ASOF LEFT JOIN
    (SELECT * FROM signals WHERE signal > 0.5) s ON b.strategy = s.strategy AND b.symbol = s.symbol AND b.date >= s.date""", "signal:8")
def _(p):  # the last strong signal before each day, of every strategy
    strong = p.signals.where("signal > 0.5")
    return joins.asof(p.signals.select("strategy", "symbol", "date"), strong, ["strategy", "symbol"], ["signal"], matched="signal_date")


POINTS = "(SELECT symbol, d AS date FROM (SELECT DISTINCT symbol FROM bars), (SELECT max(date) AS d FROM bars GROUP BY strftime(date, '%Y-%m')))"
BIG = "(SELECT symbol, date, close FROM bars WHERE volume > 80)"


def _points(p):
    ends = transforms.rebalance_dates(p.bars, "monthly").select(F.col("rebalance_date").alias("as_of"))
    return align.date_points(p.bars, ends)


@query("j04_asof_tolerance", "bars", f"""SELECT p.symbol, p.date,
    CASE WHEN p.date - b.date <= 30 THEN b.date WHEN a.date - p.date <= 14 THEN a.date ELSE l.date END AS matched_date,
    CASE WHEN p.date - b.date <= 30 THEN b.close WHEN a.date - p.date <= 14 THEN a.close ELSE l.close END AS close
    FROM {POINTS} p ASOF LEFT JOIN {BIG} b ON p.symbol = b.symbol AND p.date >= b.date
    ASOF LEFT JOIN {BIG} a ON p.symbol = a.symbol AND p.date <= a.date
    LEFT JOIN (SELECT symbol, max(date) AS date, arg_max(close, date) AS close FROM {BIG} GROUP BY 1) l ON p.symbol = l.symbol""", "close:3")
def _(p):
    big = p.bars.where("volume > 80").select("symbol", "date", "close")
    return joins.asof_within(_points(p), big, ["symbol"], ["close"])


@query("j05_nearest", "bars", f"""SELECT p.symbol, p.date, CASE WHEN b.date IS NULL OR a.date - p.date < p.date - b.date THEN a.date ELSE b.date END AS matched_date,
    CASE WHEN b.date IS NULL OR a.date - p.date < p.date - b.date THEN a.close ELSE b.close END AS close
    FROM {POINTS} p ASOF LEFT JOIN {BIG} b ON p.symbol = b.symbol AND p.date >= b.date
    ASOF LEFT JOIN {BIG} a ON p.symbol = a.symbol AND p.date <= a.date""", "close:3")
def _(p):
    big = p.bars.where("volume > 80").select("symbol", "date", "close")
    return joins.nearest(_points(p), big, ["symbol"], ["close"])


@query("j06_factor_windows", "ret factors", f"""SELECT symbol, date, CASE WHEN count(MKT) OVER {win(60)} >= 60 THEN avg(MKT) OVER {win(60)} END AS MKT_mean_60,
    CASE WHEN count(SMB) OVER {win(60)} >= 60 THEN avg(SMB) OVER {win(60)} END AS SMB_mean_60
    FROM (SELECT symbol, r.date, MKT, SMB FROM ret r JOIN factors f ON r.date = f.date)""", "MKT_mean_60:9 SMB_mean_60:9")
def _(p):
    return align.factor_windows(p.ret.select("symbol", "date"), p.factors.select("date", *FC), FC, 60)


@query("j07_history_upto", "bars", """SELECT symbol, as_of, max(date) AS last_date, count(*) AS n_rows FROM bars
    JOIN (SELECT max(date) AS as_of FROM bars GROUP BY year(date), quarter(date)) ON date <= as_of GROUP BY 1, 2""")
def _(p):
    ends = transforms.rebalance_dates(p.bars, "quarterly").select(F.col("rebalance_date").alias("as_of"))
    return align.history_upto(p.bars, ends).where(F.col("n_rows").isNotNull())


@query("j08_static_on_dates", "bars meta", "SELECT b.symbol, date, country, sector FROM bars b JOIN meta m ON b.symbol = m.symbol")
def _(p):
    return p.bars.select("symbol", "date").join(p.meta.select("symbol", "country", "sector"), "symbol")


@query("j09_known_symbols", "bars meta", "SELECT symbol, date, volume FROM bars WHERE symbol IN (SELECT symbol FROM meta WHERE sector = 'Energy')")
def _(p):
    return align.known_symbols(p.bars, p.meta.where("sector = 'Energy'")).select("symbol", "date", "volume")


@query("j10_missing_symbols", "bars universe", "SELECT DISTINCT ticker AS symbol FROM universe WHERE ticker NOT IN (SELECT symbol FROM bars)")
def _(p):
    return align.missing_symbols(p.universe.select(F.col("ticker").alias("symbol")), p.bars)


@query("j11_country_risk", "meta", """SELECT symbol, m.country, coalesce(premium, 0) AS premium, coalesce(spread, 0) AS spread FROM meta m
    LEFT JOIN (SELECT n_name AS country, n_regionkey / 100 AS premium, n_nationkey / 1000 AS spread FROM nation WHERE n_nationkey % 4 <> 0) r
    ON m.country = r.country""", "premium:6 spread:6")
def _(p):
    n = p.table("nation").where("n_nationkey % 4 <> 0")
    risk = n.select(F.col("n_name").alias("country"), (F.col("n_regionkey") / 100).alias("premium"), (F.col("n_nationkey") / 1000).alias("spread"))
    return align.country_risk(p.meta.select("symbol"), p.meta, risk, ["premium", "spread"])


for how, sql in {
    "inner": """SELECT strategy, date, daily_return FROM strat WHERE date IN (SELECT date FROM strat GROUP BY 1
        HAVING count(*) = (SELECT count(DISTINCT strategy) FROM strat))""",
    "outer": """SELECT s.strategy, d.date, coalesce(daily_return, 0) AS daily_return FROM (SELECT DISTINCT strategy FROM strat) s
        CROSS JOIN (SELECT DISTINCT date FROM strat) d LEFT JOIN strat x ON x.strategy = s.strategy AND x.date = d.date""",
    "left": """SELECT s.strategy, s.date, coalesce(daily_return, 0) AS daily_return FROM (SELECT strategy, date FROM (SELECT DISTINCT strategy FROM strat),
        (SELECT DISTINCT date FROM strat)) s ASOF LEFT JOIN strat x ON x.strategy = s.strategy AND s.date >= x.date""",
}.items():
    @query(f"j12_align_{how}", "strat", sql, "daily_return:8")
    def _(p, how=how):
        return align.aligned_series(p.strat, how).select("strategy", "date", "daily_return")


@query("j13_factors_filled_forward", "bars factors", f"""SELECT b.symbol, b.date, MKT, SMB FROM bars b ASOF LEFT JOIN {MF} f ON b.date >= f.date""", "MKT:9 SMB:9")
def _(p):
    return align.with_factors(p.bars.select("symbol", "date"), _month_factors(p), FC)


@query("j14_common_dates", "strat", """SELECT strategy, date, daily_return FROM strat WHERE date IN (SELECT date FROM strat GROUP BY 1
    HAVING count(DISTINCT strategy) = 5)""", "daily_return:8")
def _(p):
    return align.common_dates(p.strat, "strategy").select("strategy", "date", "daily_return")


@query("j15_pair_moments", "strat", """SELECT a.strategy AS s1, b.strategy AS s2, CAST(count(*) AS DOUBLE) AS n, sum(a.daily_return) AS sx,
    sum(b.daily_return) AS sy, sum(a.daily_return * b.daily_return) * 100 AS sxy FROM strat a JOIN strat b
    ON a.date = b.date AND a.strategy <= b.strategy GROUP BY 1, 2""", "sx:8 sy:8 sxy:8")
def _(p):
    from factorframe.functions.pairs import pair_moments

    m = pair_moments(p.strat, "daily_return", "strategy")
    return m.select("s1", "s2", "n", "sx", "sy", (F.col("sxy") * 100).alias("sxy"))
