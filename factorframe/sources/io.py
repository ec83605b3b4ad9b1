"""Reading and writing the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorframe import schemas
from factorframe.functions.windows import c, lagged, ratio, running
from factorframe.operators.universe import between


def read_bars(spark: SparkSession, path: str, start=None, end=None, symbols: list[str] | None = None) -> DataFrame:
    """Bars of a store partitioned by year; the date range prunes partitions and row groups."""
    df = between(spark.read.parquet(path), start, end)
    if "year" in df.columns:
        if start is not None:
            df = df.where(c("year") >= F.year(F.lit(start).cast("date")))
        if end is not None:
            df = df.where(c("year") <= F.year(F.lit(end).cast("date")))
    return df.where(c("symbol").isin(symbols)) if symbols else df


def write_bars(bars: DataFrame, path: str, mode="overwrite") -> None:
    """Layout of a table that is written whole: one directory per year, sorted by symbol inside the files so that row groups can
    be skipped; a year is split by month and hash of symbol.  ``sources.store`` is the layout for batches."""
    out = bars.withColumn("year", F.year("date"))
    out.repartition("year", F.month("date"), F.pmod(F.xxhash64("symbol"), F.lit(16))).sortWithinPartitions("symbol", "date").write.mode(mode).partitionBy("year").parquet(path)


def merge_bars(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Union by name, the newest load of a symbol-date wins (needs load_ts)."""
    both = stored.unionByName(fresh, allowMissingColumns=True)
    rest = [x for x in both.columns if x not in ("symbol", "date")]
    # max_by combines map-side, so a symbol-date loaded very often does not pile up in one task
    return both.groupBy("symbol", "date").agg(F.max_by(F.struct(*rest), F.struct("load_ts", *[x for x in rest if x != "load_ts"])).alias("_r")).select("symbol", "date", "_r.*")


def missing_ranges(bars: DataFrame, wanted: DataFrame) -> DataFrame:
    """S3: wanted(symbol, start, end) -> date ranges before and after what is stored; all of it for unknown symbols."""
    have = bars.groupBy("symbol").agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    j = wanted.join(have, "symbol", "left")
    unknown = j.where("_a is null").select("symbol", "start", "end")
    before = j.where("start < _a").select("symbol", "start", F.least(c("end"), F.date_sub("_a", 1)).alias("end"))
    after = j.where("end > _b").select("symbol", F.greatest(c("start"), F.date_add("_b", 1)).alias("start"), "end")
    return unknown.unionByName(before).unionByName(after)


def read_factors(spark: SparkSession, path: str) -> DataFrame:
    """S4."""
    return spark.read.csv(path, header=True, schema=schemas.FACTORS).dropna()


def parse_factor_text(spark: SparkSession, path: str, names: list[str], date_format="yyyyMMdd") -> DataFrame:
    """Published factor text: prose, a header, rows of date and percent values, prose again.  Only data rows match."""
    digits = {"yyyyMMdd": 8, "yyyyMM": 6}[date_format]
    parts = F.split(F.trim(F.regexp_replace("value", r"[,\s]+", " ")), " ")
    rows = spark.read.text(path).where(c("value").rlike(rf"^\s*\d{{{digits}}}[,\s]")).select(parts.alias("p")).where(F.size("p") > len(names))
    return rows.select(F.to_date(c("p")[0], date_format).alias("date"), *[(c("p")[i + 1].try_cast("double") / 100).alias(x) for i, x in enumerate(names)])


def read_country_risk(spark: SparkSession, path: str) -> DataFrame:
    """Percent strings and values above 1 become fractions, missing premiums 0."""
    raw = spark.read.csv(path, header=True, nullValue="#N/A")
    cols = ["equity_risk_premium", "default_spread", "country_risk_premium", "corporate_tax_rate"]
    num = {x: F.when(c(x).contains("%"), F.regexp_replace(x, "%", "").try_cast("double") / 100).otherwise(c(x).try_cast("double")) for x in cols}
    df = raw.where(c("country").isNotNull()).select("country", *[e.alias(x) for x, e in num.items()])
    top = df.agg(*[F.max(x).alias(f"_{x}") for x in cols]).withColumn("_k", F.lit(0))
    df = df.withColumn("_k", F.lit(0)).join(F.broadcast(top), "_k")
    return df.select("country", *[F.coalesce(F.when(c(f"_{x}") > 1, c(x) / 100).otherwise(c(x)), F.lit(0.0)).alias(x) for x in cols])


def read_benchmark(spark: SparkSession, path: str, start=None, end=None) -> DataFrame:
    """First price column that is there; open, high and low default to it, volume to 0."""
    raw = spark.read.csv(path, header=True)
    have = {x.strip().lower(): x for x in raw.columns}
    pick = lambda names: next((have[n] for n in names if n in have), None)
    day, price = pick(["date", "datetime", "timestamp"]), pick(["close", "adj close", "adj_close", "price", "value"])
    if day is None or price is None:
        raise ValueError("benchmark needs a date and a price column")
    other = lambda n: F.coalesce(c(have[n]).try_cast("double"), c("close")) if n in have else c("close")
    df = raw.withColumn("date", F.to_date(c(f"`{day}`"))).withColumn("close", c(f"`{price}`").try_cast("double"))
    volume = c(have["volume"]).try_cast("double") if "volume" in have else F.lit(0.0)
    df = df.select("date", other("open").alias("open"), other("high").alias("high"), other("low").alias("low"), "close", volume.alias("volume"))
    return between(df.dropna(subset=["date", "close"]), start, end)


def read_universe(spark: SparkSession, path: str, filters: dict | None = None) -> DataFrame:
    """Universe file with the filters of U1-U9, ending in one row per final symbol.

    Raises if boxes are asked for and the file has none, if one of them has fewer than ``per_box_min_n`` rows (unless
    ``fail_fast`` is false), and if no symbol is left.
    """
    from factorframe.operators import universe as u

    f = filters or {}
    df = spark.read.csv(path, header=True)
    df = df.withColumn("row_id", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    first = lambda names: next((x for x in names if x in df.columns), None)
    cap, sector, region = first(["market_cap_corrected", "market_cap"]), first(["sector", "section"]), first(["region"])
    if f.get("min_market_cap") is not None and cap:
        df = u.at_least(df, cap, f["min_market_cap"])
    if f.get("min_weight") is not None and "weight" in df.columns:
        df = u.at_least(df, "weight", f["min_weight"])
    if f.get("include_sectors") and sector:
        df = u.include(df, sector, f["include_sectors"])
    if f.get("exclude_sectors") and sector:
        df = u.exclude(df, sector, f["exclude_sectors"])
    if f.get("regions") and region:
        df = u.include(df, region, f["regions"])
    if f.get("include_boxes"):
        if "source_sheet" not in df.columns:
            raise ValueError("include_boxes needs a column source_sheet")
        boxes = sorted({str(b).strip() for b in f["include_boxes"]})
        df = df.withColumn("source_sheet", F.trim("source_sheet")).where(c("source_sheet").isin(boxes))
        rank_by = cap or first(["weight"])
        if f.get("per_box_top_n") and rank_by:
            df = u.top_per_box(df, "source_sheet", f["per_box_top_n"], rank_by)
        if f.get("per_box_min_n") and f.get("fail_fast", True):
            wanted = spark.createDataFrame([(b,) for b in boxes], "source_sheet string")
            short = u.box_gate(df, wanted, "source_sheet", f["per_box_min_n"]).where("not met").collect()  # at most the boxes asked for
            if short:
                raise ValueError(f"boxes below {f['per_box_min_n']} rows: {sorted(r['source_sheet'] for r in short)}")
    code = c("country_code") if "country_code" in df.columns else F.lit(None).cast("string")
    own = u.normalize_suffix("yfinance_ticker") if "yfinance_ticker" in df.columns else F.lit(None).cast("string")
    df = u.largest(df, f.get("max_stocks")).withColumn("_t", u.normalize_ticker("ticker")).where("_t is not null")
    out = u.first_of_each(df.withColumn("symbol", F.coalesce(own, u.resolved(u.symbol_candidates("_t", code)))).drop("_t"))
    if out.isEmpty():
        raise ValueError("no symbol is left after the filters")
    return out


def read_metadata(spark: SparkSession, path: str, billions_above=1e12) -> DataFrame:
    """Symbol, market_cap (billions), pb_ratio from a file with any of the usual column names; only positive values count."""
    raw = spark.read.csv(path, header=True)
    have = {x.strip().lower(): x for x in raw.columns}
    pick = lambda *names: next((have[n] for n in names if n in have), None)
    key, cap, pb = pick("symbol", "ticker"), pick("market_cap", "marketcap", "market cap"), pick("pb_ratio", "pb", "price_to_book", "p_b")
    num = lambda x: c(f"`{x}`").try_cast("double") if x else F.lit(None).cast("double")
    df = raw.select(F.upper(F.trim(c(f"`{key}`"))).alias("symbol"), num(cap).alias("_c"), num(pb).alias("_p"))
    size = F.when(c("_c") > billions_above, c("_c") / 1e9).otherwise(c("_c"))
    return df.select("symbol", F.when(c("_c") > 0, size).alias("market_cap"), F.when(c("_p") > 0, c("_p")).alias("pb_ratio"))


def clean_holdings(rows: DataFrame, source: str, order="row_index", file="file") -> DataFrame:
    """Section header rows ("Energy (12 members)") are carried down to the rows of their file.

    rows(file, row_index, Name, Ticker, Weight, Shares, Price), all text; a file is one exported sheet.
    """
    no_ticker = F.coalesce(F.trim("Ticker"), F.lit("")) == ""
    head = no_ticker & F.lower(F.coalesce("Name", F.lit(""))).contains("members")
    title = F.trim(F.regexp_replace("Name", r"\s*\(.*$", ""))
    df = rows.withColumn("section", F.last(F.when(head, title), True).over(running(file, [order])))
    parts = F.split(F.trim("Ticker"), r"\s+")
    num = lambda x: F.regexp_replace(x, ",", "").try_cast("double").alias(x.lower())
    keep = ~head & ~no_ticker & (c("Name").isNotNull() | c("Weight").isNotNull())
    return df.where(keep).select(parts[0].alias("ticker"), F.lit(source).alias("source_etf"), F.get(parts, F.lit(1)).alias("country_code"),
                                 F.coalesce("section", F.lit("")).alias("section"), num("Weight"), num("Shares"), num("Price"))


def read_strategy_returns(spark: SparkSession, path: str, wanted: list[str] | None = None) -> DataFrame:
    """One file or directory per strategy (its name is the strategy); an absent one raises."""
    df = spark.read.option("recursiveFileLookup", "true").csv(path, header=True, schema="date date, daily_return double")
    name = F.regexp_extract(F.input_file_name(), r"/([^/]+?)(?:\.csv)?(?:/part-[^/]*)?$", 1)
    out = df.select(F.url_decode(name).alias("strategy"), "date", "daily_return")
    if wanted:
        found = {r["strategy"] for r in out.select("strategy").distinct().collect()}
        lost = sorted(set(wanted) - found)
        if lost:
            raise ValueError(f"strategies without returns: {lost}")
        out = out.where(c("strategy").isin(wanted))
    return out


def extract_returns(df: DataFrame, key="strategy", candidates: list[str] | None = None) -> DataFrame:
    """The returns column, else the change of portfolio_value, else of the first column that looks like prices."""
    if "returns" in df.columns:
        return df.select(key, "date", c("returns").alias("daily_return")).where("daily_return is not null")
    price = "portfolio_value" if "portfolio_value" in df.columns else None
    if price is None:
        names = candidates or [n for n, t in df.dtypes if t in ("double", "float", "int", "bigint")]
        stats = df.agg(*[F.struct(F.min(n).alias("lo"), F.max(n).alias("hi"), F.count(n).alias("k")).alias(n) for n in names]).first()
        price = next((n for n in names if stats[n]["lo"] is not None and stats[n]["lo"] > 0 and stats[n]["hi"] / stats[n]["lo"] < 10 and stats[n]["k"] > 10), None)
        if price is None:
            raise ValueError("no returns and no price-like column")
    out = df.select(key, "date", (ratio(price, lagged(price, 1, key)) - 1).alias("daily_return"))
    return out.where("daily_return is not null")


def write_results(df: DataFrame, path: str, by="strategy", fmt="parquet") -> None:
    """Result series, one directory per strategy."""
    df.write.mode("overwrite").partitionBy(by).format(fmt).option("header", "true").save(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """The predictions as CSV and JSON and a one-row summary."""
    df.write.mode("overwrite").option("header", "true").csv(f"{path}/csv")
    df.write.mode("overwrite").json(f"{path}/json")
    prediction_summary(df).write.mode("overwrite").json(f"{path}/summary")


def prediction_summary(df: DataFrame) -> DataFrame:
    """Positions, total weight, largest weight and mean signal of recommendations(symbol, weight, signal_strength)."""
    return df.agg(F.count(F.lit(1)).alias("positions"), F.sum("weight").alias("total_weight"), F.max("weight").alias("largest_weight"),
                  F.avg("signal_strength").alias("mean_signal"))


def stamp_source(df: DataFrame, source: str, provider: str) -> DataFrame:
    """S15."""
    return df.withColumns({"data_source": F.lit(source), "provider": F.lit(provider), "fetched_at": F.current_timestamp()})
