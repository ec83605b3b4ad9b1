"""Size, style, region and sector classes, boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorframe.functions import ranks
from factorframe.functions.windows import c, ratio
from factorframe.operators.transforms import _attach

# fixed values
SIZE_CUTS = (0.2, 0.8)
STYLE_CUTS = (0.3, 0.7)
MIN_PB_VALUES = 10


def size_class(meta: DataFrame, cap="market_cap") -> DataFrame:
    """C1."""
    cuts = ranks.quantiles(meta, [], cap, {"_c20": SIZE_CUTS[0], "_c80": SIZE_CUTS[1]})
    return _attach(meta, cuts, []).withColumn("size", _size(cap)).drop("_c20", "_c80")


def _size(cap) -> Column:
    return F.when(c(cap) >= c("_c80"), "large").when(c(cap) >= c("_c20"), "mid").otherwise("small")


def _style(pb, technical) -> Column:
    by_pb = F.when(c("_n") < MIN_PB_VALUES, "neutral").when(c(pb) >= c("_p70"), "growth")
    by_pb = by_pb.when(c(pb) >= c("_p30"), "neutral").otherwise("value")
    score = c(technical) if technical else F.lit(0.5)
    by_score = F.when(score < 0.35, "value").when(score > 0.65, "growth").otherwise("neutral")
    return F.when(c(pb).isNotNull(), by_pb).otherwise(by_score)


def style_class(meta: DataFrame, pb="pb_ratio", technical: str | None = None) -> DataFrame:
    """By price-to-book cuts; names without it by technical score; all neutral with fewer than 10 ratios."""
    cuts = ranks.quantiles(meta, [], pb, {"_p30": STYLE_CUTS[0], "_p70": STYLE_CUTS[1]})
    n = meta.agg(F.count(pb).alias("_n"))
    df = _attach(_attach(meta, cuts, []), n, [])
    return df.withColumn("style", _style(pb, technical)).drop("_p30", "_p70", "_n")


def classify(meta: DataFrame, technical: str | None = None) -> DataFrame:
    """C1 and C2 on metadata that already has region and sector; both cuts come from one pass."""
    long = meta.select(c("market_cap").alias("cap"), c("pb_ratio").alias("pb")).unpivot([], ["cap", "pb"], "feature", "value")
    q = ranks.quantiles(long, ["feature"], "value", {"q2": SIZE_CUTS[0], "q8": SIZE_CUTS[1], "q3": STYLE_CUTS[0], "q7": STYLE_CUTS[1]})
    pick = lambda f, x: F.max(F.when(c("feature") == f, c(x)))
    cuts = q.agg(pick("cap", "q2").alias("_c20"), pick("cap", "q8").alias("_c80"), pick("pb", "q3").alias("_p30"), pick("pb", "q7").alias("_p70"))
    n = meta.agg(F.count("pb_ratio").alias("_n"))
    df = _attach(_attach(meta, cuts, []), n, [])
    out = df.withColumn("size", _size("market_cap")).withColumn("style", _style("pb_ratio", technical))
    return out.drop("_c20", "_c80", "_p30", "_p70", "_n")


def box_keys(classes: DataFrame, dims=("size", "style", "region", "sector")) -> DataFrame:
    return classes.select("symbol", *dims)


def box_name(dims=("size", "style", "region", "sector")) -> Column:
    return F.concat_ws("_", *dims)


def technical_style_score(bars: DataFrame) -> DataFrame:
    """(symbol, technical_score); falling prices raise it, as in the source method; 0.5 under 20 returns."""
    from pyspark.sql import Window

    from factorframe.functions.windows import change, rolling_mean

    recent = Window.partitionBy("symbol").orderBy(F.desc("date"))
    df = bars.select("symbol", "date", "close", change("close").alias("_r"), rolling_mean("close", 200).alias("_sma"),
                     F.row_number().over(recent).alias("_i"))
    out = df.groupBy("symbol").agg(
        F.count("_r").alias("_n"), F.avg(F.when(c("_i") <= 21, c("_r"))).alias("_m"),
        (F.stddev_samp("_r") * 252**0.5).alias("_v"), F.max_by("close", "date").alias("_c"),
        F.max(F.when(c("_i") == 1, c("_sma"))).alias("_s"))

    def unit(x):
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))

    trend = unit(F.coalesce(ratio(c("_s") - c("_c"), "_s") + 0.5, F.lit(1.0)))
    score = (unit(-c("_m") * 50 + 0.5) + unit(c("_v") / 0.4) + trend) / 3
    return out.select("symbol", F.when(c("_n") < 20, 0.5).otherwise(score).alias("technical_score"))


def fundamental_style_score(pe, pb) -> Column:
    """C4: mean of the positive ones of two ramps (P/E 15-25, P/B 1.5-3.5); null if neither is positive."""
    ramp = lambda x, lo, hi: F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c(x) - lo) / (hi - lo))), F.lit(0.0))
    a, b = ramp(pe, 15.0, 25.0), ramp(pb, 1.5, 3.5)
    return F.when((a > 0) & (b > 0), (a + b) / 2).when(a > 0, a).when(b > 0, b)


# fixed values
DEVELOPED = ("United States", "Canada", "United Kingdom", "Germany", "France", "Italy", "Spain", "Netherlands", "Switzerland",
             "Sweden", "Norway", "Denmark", "Australia", "New Zealand", "Japan", "Singapore", "Hong Kong", "Taiwan",
             "South Korea", "Ireland", "Austria", "Belgium", "Finland", "Israel", "Luxembourg")
SECTOR_PATTERNS = {"Technology": "TECH|SOFT|COMP", "Healthcare": "PHARMA|BIO|HEALTH", "Financials": "BANK|FIN|INSUR",
                   "Energy": "ENERGY|OIL|GAS", "Consumer Discretionary": "RETAIL|CONSUMER"}


def region_class(country, developed=DEVELOPED) -> Column:
    """No country counts as developed."""
    x = F.trim(c(country))
    return F.when(x.isNull() | (x == "") | x.isin(*developed), "developed").otherwise("emerging")


def sector_class(df: DataFrame, mapping: DataFrame, listed: str | None = None) -> DataFrame:
    """Explicit map(symbol, sector), then the metadata column, then a pattern in the name."""
    pattern = F.coalesce(*[F.when(F.upper("symbol").rlike(rx), s) for s, rx in SECTOR_PATTERNS.items()])
    out = df.join(mapping.select("symbol", c("sector").alias("_mapped")), "symbol", "left")
    known = [c("_mapped")] + ([c(listed)] if listed else [])
    return out.withColumn("sector", F.coalesce(*known, pattern)).drop("_mapped")


def classification_score(cap, style, vol, volume) -> Column:
    """0.3 size + 0.4 style + 0.2 closeness of volatility to 25% + 0.1 volume, in [0, 1]."""
    size = F.least(F.lit(1.0), F.log10(c(cap) + 1) / 3)
    v = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(c(vol) - 0.25) / 0.25)), F.lit(0.5))
    liq = F.coalesce(F.least(F.lit(1.0), c(volume) / 1e6), F.lit(0.5))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.3 * size + 0.4 * c(style) + 0.2 * v + 0.1 * liq))


def box_members(scored: DataFrame, n: int | None = None, dims=("size", "style", "region", "sector")) -> DataFrame:
    """Members of every box in score order, the top n when asked (long form, one row per member)."""
    out = scored.withColumn("box", box_name(dims))
    order = [F.desc("score"), F.asc("symbol")]
    if n:
        return ranks.top_n(out, ["box"], order, n, "position")
    from pyspark.sql import Window

    return out.withColumn("position", F.row_number().over(Window.partitionBy("box").orderBy(*order)))


def box_summary(classes: DataFrame, dims=("size", "style", "region", "sector")) -> DataFrame:
    """Boxes and stocks in total and by size, style and region (one pass of grouping sets)."""
    boxes = classes.groupBy(*dims).agg(F.count(F.lit(1)).alias("stocks"))
    a, b, d = dims[:3]
    out = boxes.groupingSets([[c(a)], [c(b)], [c(d)], []], c(a), c(b), c(d)).agg(
        F.count(F.lit(1)).alias("boxes"), F.sum("stocks").alias("stocks"), F.grouping_id().alias("_g"))
    name = F.when(c("_g") == 3, a).when(c("_g") == 5, b).when(c("_g") == 6, d).otherwise("all")
    return out.select(name.alias("dimension"), F.coalesce(c(a), c(b), c(d), F.lit("all")).alias("value"), "boxes", "stocks")


def extreme_boxes(classes: DataFrame, n=5, dims=("size", "style", "region", "sector")) -> DataFrame:
    """The n largest and smallest boxes."""
    boxes = classes.groupBy(box_name(dims).alias("box")).agg(F.count(F.lit(1)).alias("stocks"))
    big = ranks.top_n(boxes, [], [F.desc("stocks"), F.asc("box")], n).withColumn("kind", F.lit("largest"))
    small = ranks.top_n(boxes, [], [F.asc("stocks"), F.asc("box")], n).withColumn("kind", F.lit("smallest"))
    return big.unionByName(small)


def merge_small_boxes(classes: DataFrame, min_stocks=2, max_boxes=30, dims=("size", "style", "region", "sector")) -> DataFrame:
    """(box, target): boxes under the minimum go to the most similar kept box (size 3, style 2, region 1).

    Kept boxes are the largest ones, up to max_boxes.  Each box lists its shared
    attributes with their worth; the similarity of two boxes is the sum over the
    attributes they have in common, so one equality join finds it.  A box without any keeps itself.
    """
    boxes = classes.groupBy(*dims).agg(F.count(F.lit(1)).alias("stocks")).withColumn("box", box_name(dims))
    kept = ranks.top_n(boxes.where(c("stocks") >= min_stocks), [], [F.desc("stocks"), F.asc("box")], max_boxes)
    worth = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), c(d).alias("value"), F.lit(w).alias("worth"))
                                for d, w in zip(dims[:3], (3, 2, 1))])).alias("t")
    targets = kept.select(c("box").alias("target"), worth).select("target", "t.dim", "t.value")
    attrs = boxes.select("box", worth).select("box", "t.*")
    like = attrs.join(targets, ["dim", "value"]).groupBy("box", "target").agg(F.sum("worth").alias("_like"))
    best = like.groupBy("box").agg(F.min_by("target", F.struct(-c("_like"), c("target"))).alias("_best"))
    own = kept.select("box", c("box").alias("_own"))
    out = boxes.select("box").join(own, "box", "left").join(best, "box", "left")
    return out.select("box", F.coalesce("_own", "_best", "box").alias("target"))


def box_coverage(universe: DataFrame, classes: DataFrame) -> DataFrame:
    """C11: symbols per box, plus one row for names without a class."""
    boxed = classes.select("symbol", box_name().alias("box"))
    out = universe.select("symbol").distinct().join(boxed, "symbol", "left")
    out = out.groupBy(F.coalesce("box", F.lit("unclassified")).alias("box")).agg(F.count(F.lit(1)).alias("symbols"))
    return ranks.with_group_stats(out, [], _t=F.sum("symbols")).select("box", "symbols", (c("symbols") / c("_t")).alias("share"))
