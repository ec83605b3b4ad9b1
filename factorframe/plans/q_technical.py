"""Queries T1-T26 over the bars of the driver's tables."""

from factorframe.operators import technical as t
from factorframe.plans.catalog import query

KEYS = ["symbol", "date"]


def win(n, key="symbol"):
    return f"(PARTITION BY {key} ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(agg, x, n, key="symbol", mp=None):
    return f"CASE WHEN count({x}) OVER {win(n, key)} >= {mp or n} THEN {agg}({x}) OVER {win(n, key)} END"


def lag(x, k=1, key="symbol"):
    return f"lag({x}, {k}) OVER (PARTITION BY {key} ORDER BY date)"


def chg(x, k=1, key="symbol"):
    return f"({x} / nullif({lag(x, k, key)}, 0) - 1)"


def register(name, op, cols: dict, digits: int, base: str = "bars", tables="bars", kinds: dict | None = None):
    """``cols``: output -> SQL; ``base``: the frame it is evaluated on."""
    body = ", ".join(f"{e} AS {n}" for n, e in cols.items())
    skip = kinds or {}
    dg = " ".join(f"{n}:{skip.get(n, digits)}" for n in cols if skip.get(n, digits) is not None)
    query(name, tables, f"SELECT symbol, date, {body} FROM {base}", dg)(
        lambda p: op(p.bars).select(*KEYS, *cols)
    )


P = (21, 63, 126, 252)
RET = f"(SELECT *, {chg('close')} AS ret FROM bars)"
register("t01_momentum", t.momentum, {f"momentum_{p}d": chg("close", p) for p in P}, 6)
register("t02_log_return", t.log_returns, {f"log_return_{p}d": f"ln(close / {lag('close', p)})" for p in P}, 6)


def _expmom(p):
    # weighted mean of the listed closes, in SQL by list functions
    w = f"list_transform(range({p}), lambda i: exp(-1 + CAST(i AS DOUBLE) / {p - 1}))"
    return (f"CASE WHEN len(f{p}) = {p} THEN list_dot_product(f{p}, {w}) / list_sum({w}) / f{p}[1] - 1 END")


register("t03_exp_momentum", lambda b: t.exp_momentum(b, (21, 63)), {f"exp_momentum_{p}d": _expmom(p) for p in (21, 63)}, 6,
         base="(SELECT *, " + ", ".join(f"list(close) OVER {win(p)} AS f{p}" for p in (21, 63)) + " FROM bars)")
register("t04_risk_adjusted_momentum", t.risk_adjusted_momentum,
         {f"risk_adj_momentum_{p}d": f"{chg('close', p)} / nullif({full('stddev_samp', 'ret', p)}, 0)" for p in P}, 6, base=RET)


def _rank(x, n, mp):
    f = f"list({x}) FILTER ({x} IS NOT NULL) OVER {win(n)}"
    return (f"CASE WHEN {x} IS NOT NULL AND len({f}) >= {mp} THEN (len(list_filter({f}, lambda v: v < {x}))"
            f" + (len(list_filter({f}, lambda v: v = {x})) + 1) / 2.0) / len({f}) END")


register("t05_momentum_rank", lambda b: t.momentum_rank(b, (21, 63)),
         {f"momentum_rank_{p}d": _rank(f"m{p}", 252, 126) for p in (21, 63)}, 6,
         base="(SELECT *, " + ", ".join(f"{chg('close', p)} AS m{p}" for p in (21, 63)) + " FROM bars)")
VOL = f"(SELECT *, {full('stddev_samp', 'ret', 20)} AS v20, {full('stddev_samp', 'ret', 60)} AS v60 FROM {RET})"
register("t06_volatility", t.volatility, {"volatility_20d": "v20", "volatility_60d": "v60"}, 6, base=VOL)
register("t07_vol_of_vol", t.vol_of_vol, {f"vol_of_vol_{w}d": full("stddev_samp", f"v{w}", w) for w in (20, 60)}, 5, base=VOL)
HL = "(SELECT *, pow(ln(high / low), 2) AS r2, 0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2) AS gk FROM bars)"
register("t08_parkinson", t.parkinson,
         {f"parkinson_vol_{w}d": f"sqrt({full('sum', 'r2', w)} / (4 * ln(2)))" for w in (20, 60)}, 6, base=HL)
register("t09_garman_klass", t.garman_klass, {f"gk_vol_{w}d": full("avg", "g", w) for w in (20, 60)}, 6,
         base=f"(SELECT *, CASE WHEN gk >= 0 THEN sqrt(gk) END AS g FROM {HL})")
register("t10_volatility_rank", t.volatility_rank, {f"volatility_rank_{w}d": _rank(f"v{w}", 252, 126) for w in (20, 60)}, 6, base=VOL)
register("t11_long_parkinson", t.long_parkinson,
         {"parkinson_volatility": f"sqrt({full('sum', 'r2', 20)} / (4 * count(*) OVER (PARTITION BY symbol) * ln(2)))"}, 6, base=HL)
register("t12_long_garman_klass", t.long_garman_klass, {"garman_klass_volatility": "CASE WHEN s >= 0 THEN sqrt(s) END"}, 6,
         base=f"(SELECT *, {full('sum', 'gk', 20)} AS s FROM {HL})")
register("t13_range_volatility", t.range_volatility, {"range_volatility": "(high - low) / close"}, 6)
S = (10, 20, 50, 200)
register("t14_sma", t.sma, {f"sma_{p}": f"s{p}" for p in S}
         | {f"price_above_sma_{p}": f"CASE WHEN close > s{p} THEN 1 ELSE 0 END" for p in S}, 3,
         base="(SELECT *, " + ", ".join(f"{full('avg', 'close', p)} AS s{p}" for p in S) + " FROM bars)",
         kinds={f"price_above_sma_{p}": None for p in S})


def ewm(x, span):
    up = f"pow({span + 1}.0 / {span - 1}.0, rn)"
    w = "(PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)"
    return f"sum({x} * {up}) OVER {w} / sum({up}) OVER {w}"


NUM = "(SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS rn FROM bars)"
register("t15_ema", t.ema, {f"ema_{s}": ewm("close", s) for s in (12, 26)}, 3, base=NUM)
LINE = f"(SELECT *, {ewm('close', 12)} - {ewm('close', 26)} AS line FROM {NUM})"
register("t16_macd", t.macd, {"macd_line": "line", "macd_signal": "sig", "macd_histogram": "line - sig"}, 3,
         base=f"(SELECT *, {ewm('line', 9)} AS sig FROM {LINE})")
BB = f"(SELECT *, {full('avg', 'close', 20)} AS m, 2 * {full('stddev_samp', 'close', 20)} AS h FROM bars)"
register("t17_bollinger", t.bollinger, {"bb_upper": "m + h", "bb_middle": "m", "bb_lower": "m - h",
                                        "bb_position": "(close - (m - h)) / nullif(2 * h, 0)", "bb_width": "2 * h / m"}, 3,
         base=BB, kinds={"bb_position": 6, "bb_width": 6})
RSI = f"(SELECT *, coalesce(close - {lag('close')}, 0) AS d FROM bars)"
RSI = f"(SELECT *, {full('avg', 'greatest(d, 0)', 14)} AS g, {full('avg', 'greatest(-d, 0)', 14)} AS l FROM {RSI})"
register("t18_rsi", t.rsi, {"rsi_14": "CASE WHEN l > 0 THEN 100 - 100 / (1 + g / l) WHEN l = 0 AND g > 0 THEN 100 END"}, 6, base=RSI)
EXT = f"(SELECT *, {full('min', 'low', 14)} AS lo, {full('max', 'high', 14)} AS hi FROM bars)"
K = f"(SELECT *, 100 * (close - lo) / (hi - lo + 1e-8) AS k FROM {EXT})"
register("t19_stochastic", t.stochastic, {"stochastic_k": "k", "stochastic_d": full("avg", "k", 3)}, 6, base=K)
register("t20_williams_r", t.williams_r, {"williams_r": "-100 * (hi - close) / (hi - lo + 1e-8)"}, 6, base=EXT)
MF = f"(SELECT *, (high + low + close) / 3 AS tp FROM bars)"
MF = f"(SELECT *, tp * volume AS mf, tp - {lag('tp')} AS st FROM {MF})"
MF = (f"(SELECT *, CASE WHEN st > 0 THEN mf ELSE 0 END AS pos, CASE WHEN st < 0 THEN mf ELSE 0 END AS neg FROM {MF})")
MF = f"(SELECT *, {full('sum', 'pos', 14)} AS p, {full('sum', 'neg', 14)} AS n FROM {MF})"
register("t21_mfi", t.mfi, {"mfi": "CASE WHEN n > 0 THEN 100 - 100 / (1 + p / n) WHEN n = 0 AND p > 0 THEN 100 END"}, 6, base=MF)
AD = f"(SELECT *, {lag('close')} AS pc, high - {lag('high')} AS up, {lag('low')} - low AS dn FROM bars)"
AD = ("(SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr, "
      "CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS dp, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS dm "
      f"FROM {AD})")
AD = f"(SELECT *, {full('avg', 'tr', 14)} AS atr, {full('avg', 'dp', 14)} AS adp, {full('avg', 'dm', 14)} AS adm FROM {AD})"
AD = f"(SELECT *, 100 * adp / nullif(atr, 0) AS dip, 100 * adm / nullif(atr, 0) AS dim FROM {AD})"
AD = f"(SELECT *, 100 * abs(dip - dim) / nullif(dip + dim, 0) AS dx FROM {AD})"
register("t22_adx", t.adx, {"adx": full("avg", "dx", 14)}, 6, base=AD)
CC = "(SELECT *, (high + low + close) / 3 AS tp FROM bars)"
CC = f"(SELECT *, {full('avg', 'tp', 20)} AS m, list(tp) OVER {win(20)} AS f FROM {CC})"
register("t23_cci", t.cci, {"cci": "(tp - m) / nullif(0.015 * list_avg(list_transform(f, lambda x: abs(x - m))), 0)"}, 6, base=CC)
RUN = "OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)"
register("t24_volume_price_trend", t.volume_price_trend,
         {"volume_price_trend": f"CASE WHEN ret IS NOT NULL THEN sum(volume * ret) {RUN} END"}, 3, base=RET)
B = (f"(SELECT *, {lag('close')} AS pc, {full('avg', 'close', 20)} AS s20, {full('avg', 'close', 50)} AS s50, "
     f"{full('avg', 'close', 200)} AS s200, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS rn FROM {RET})")
B = ("(SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, "
     f"coalesce(sign(close - pc) * volume, 0) AS fl FROM {B})")
register("t25_basic_block", t.basic_block, {
    "sma_20": "s20", "sma_50": "s50", "sma_200": "s200", "ema_12": ewm("close", 12), "ema_26": ewm("close", 26),
    "price_to_sma20": "close / s20", "price_to_sma200": "close / s200", "true_range": "tr",
    "atr_14": full("avg", "tr", 14), "volume_sma_20": full("avg", "volume", 20),
    "vpt": f"CASE WHEN ret IS NOT NULL THEN sum(volume * ret) {RUN} END", "obv": f"sum(fl) {RUN}"}, 3, base=B,
    kinds={"price_to_sma20": 6, "price_to_sma200": 6})


@query("t26_technical_panel", "bars", f"""
    SELECT symbol, date, m21 AS momentum_21d, {_rank('m21', 252, 126)} AS momentum_rank_21d,
      {full('stddev_samp', 'v20', 20)} AS vol_of_vol_20d, {ewm('close', 12)} AS ema_12,
      CASE WHEN l > 0 THEN 100 - 100 / (1 + g / l) WHEN l = 0 AND g > 0 THEN 100 END AS rsi_14,
      CASE WHEN ret IS NOT NULL THEN sum(volume * ret) {RUN} END AS volume_price_trend
    FROM (SELECT *, {chg('close', 21)} AS m21, {full('stddev_samp', 'ret', 20)} AS v20,
          row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS rn,
          {full('avg', 'greatest(d, 0)', 14)} AS g, {full('avg', 'greatest(-d, 0)', 14)} AS l
          FROM (SELECT *, {chg('close')} AS ret, coalesce(close - {lag('close')}, 0) AS d FROM bars))""",
       "momentum_21d:6 momentum_rank_21d:6 vol_of_vol_20d:5 ema_12:3 rsi_14:6 volume_price_trend:3")
def _panel(p):
    return t.technical_panel(p.bars).select(*KEYS, "momentum_21d", "momentum_rank_21d", "vol_of_vol_20d", "ema_12",
                                            "rsi_14", "volume_price_trend")


@query("t26_drop_empty_columns", "bars", f"SELECT symbol, date, m1 FROM (SELECT symbol, date, {chg('close')} AS m1 FROM bars)", "m1:6")
def _(p):
    """A momentum over more rows than any symbol has is empty and goes; that over one row stays."""
    df = t.momentum(p.bars.select("symbol", "date", "close"), (1, 100_000)).drop("close")
    return t.drop_empty_columns(df).withColumnRenamed("momentum_1d", "m1")
