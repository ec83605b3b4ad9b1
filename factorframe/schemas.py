"""Fixed schemas of the long tables the operators work on."""

from pyspark.sql import types as T


def _schema(text: str) -> T.StructType:
    kinds = {"s": T.StringType(), "d": T.DateType(), "f": T.DoubleType(), "t": T.TimestampType(), "l": T.LongType(),
             "ms": T.MapType(T.StringType(), T.StringType()), "mf": T.MapType(T.StringType(), T.DoubleType())}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in text.split())])


BARS = _schema("symbol:s date:d open:f high:f low:f close:f volume:f adj_close:f")
FACTORS = _schema("date:d MKT:f SMB:f HML:f RMW:f CMA:f RF:f")
UNIVERSE = _schema(
    "ticker:s source_etf:s region:s country_code:s sector:s section:s market_cap:f market_cap_corrected:f weight:f "
    "source_sheet:s yfinance_ticker:s"
)
METADATA = _schema("symbol:s market_cap:f pb_ratio:f")
COUNTRY_RISK = _schema(
    "country:s prs_score:s equity_risk_premium:f default_spread:f country_risk_premium:f corporate_tax_rate:f crp_raw:f"
)
DELISTINGS = _schema("symbol:s dlstdt:d dlstcd:s dlprc:f")
BENCHMARK = _schema("date:d close:f")
STRATEGY_RETURNS = _schema("strategy:s date:d daily_return:f")
SIGNALS = _schema("strategy:s date:d symbol:s signal:f")
WEIGHTS = _schema("strategy:s date:d symbol:s weight:f")
TRADING_SIGNAL = _schema("symbol:s signal_type:s strength:f ts:t price:f confidence:f metadata:ms")
POSITION = _schema(
    "symbol:s quantity:f average_cost:f current_price:f market_value:f unrealized_pnl:f weight:f"
)
TRADE = _schema("trade_id:s symbol:s side:s quantity:f price:f ts:t commission:f")
PREDICTION = _schema(
    "ts:t model_id:s prediction_id:s features:mf prediction:f actual:f confidence:f metadata:ms"
)
SNAPSHOT = T.StructType(
    [T.StructField("date", T.DateType()), T.StructField("total_value", T.DoubleType()),
     T.StructField("cash", T.DoubleType()), T.StructField("positions", T.ArrayType(POSITION))]
)
EVENTS = T.StructType(
    [T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
     T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
     T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())]
)
