"""Trends, entry years, lead and lag."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _pairwise_median_slope(df: DataFrame) -> DataFrame:
    """Median of the slopes between all pairs of points of a topic (a topic has one point for each year)."""
    a, b = df.select("topic", F.col("year").alias("x"), F.col("delta").alias("u")), df.select("topic", F.col("year").alias("y"), F.col("delta").alias("v"))
    pairs = a.join(b, "topic").filter("x < y")
    return pairs.groupBy("topic").agg(F.median((F.col("v") - F.col("u")) / (F.col("y") - F.col("x"))).alias("slope_delta"))


def cross_year(df: DataFrame, either: bool = False) -> DataFrame:
    """The first year in which delta turns from negative to non-negative (or back, too, with either)."""
    p = df.withColumn("prev", F.lag("delta").over(Window.partitionBy("topic").orderBy("year")))
    up = (F.col("prev") < 0) & (F.col("delta") >= 0)
    down = (F.col("prev") > 0) & (F.col("delta") <= 0)
    return p.groupBy("topic").agg(F.min(F.when(up | down if either else up, F.col("year"))).alias("cross_year"))


def trend_summary(df: DataFrame, min_years: int = 6, eps: float = 1e-4, both: bool = False) -> DataFrame:
    """Robust slope, first and last delta, crossing year and label. catching_up needs a rising slope and a higher end;
    pulling_away a falling slope, and with both also a lower end; below min_years points: insufficient."""
    ends = df.groupBy("topic").agg(F.min_by("delta", "year").alias("delta_start"), F.max_by("delta", "year").alias("delta_end"), F.count("*").alias("n_years"))
    t = ends.join(_pairwise_median_slope(df), "topic", "left").join(cross_year(df), "topic")
    up = (F.col("slope_delta") > eps) & (F.col("delta_end") > F.col("delta_start") + eps)
    down = F.col("slope_delta") < -eps
    if both:
        down = down & (F.col("delta_end") < F.col("delta_start") - eps)
    label = F.when(F.col("n_years") < min_years, "insufficient").when(up, "catching_up").when(down, "pulling_away").otherwise("stable")
    return t.withColumn("trend_label", label)


def ols_trend(df: DataFrame, eps: float = 1e-4) -> DataFrame:
    t = df.groupBy("topic").agg(F.regr_slope("delta", "year").alias("slope"), F.regr_r2("delta", "year").alias("r2"), F.count("*").alias("n"))
    return t.withColumn("label", F.when(F.col("slope") > eps, "catching_up").when(F.col("slope") < -eps, "lagging").otherwise("flat"))


def entry_year(series: DataFrame, k: float = 1.0, sustain: int = 2, min_baseline: int = 3) -> DataFrame:
    """For each (topic, c2): the first year after the baseline (min(5, max(min_baseline, n // 3)) points) whose share exceeds mean +
    k sigma and is not below itself `sustain` points later (or at the end). Fewer than 5 points: insufficient."""
    unit = Window.partitionBy("topic", "c2")
    s = series.withColumns({"i": F.row_number().over(unit.orderBy("year")) - 1, "n": F.count("*").over(unit)})
    s = s.withColumn("b", F.least(F.lit(5), F.greatest(F.lit(min_baseline), F.floor(F.col("n") / 3))))
    base = F.when(F.col("i") < F.col("b"), F.col("share"))
    s = s.withColumns({"mu": F.avg(base).over(unit), "sd": F.stddev_pop(base).over(unit)})
    s = s.withColumn("sd", F.when(F.round("sd", 12) == 0, 1e-8).otherwise(F.col("sd")))
    ahead = F.coalesce(*[F.lead("share", j).over(unit.orderBy("year")) for j in range(sustain, 0, -1)], F.col("share"))
    hit = (F.col("i") >= F.col("b")) & (F.round(F.col("share") - F.col("mu") - k * F.col("sd"), 12) > 0) & (F.round(ahead - F.col("share"), 12) >= 0)
    s = s.withColumn("hit", hit)
    out = s.groupBy("topic", "c2").agg(F.max("n").alias("n"), F.min(F.when(F.col("hit"), F.col("year"))).alias("enter_year"))
    out = out.withColumn("enter_year", F.when(F.col("n") >= 5, F.col("enter_year")))
    return out.withColumn("flag", F.when(F.col("n") < 5, "insufficient").when(F.col("enter_year").isNull(), "not_entered").otherwise("entered"))


def lead_lag(entries: DataFrame) -> DataFrame:
    side = lambda c: entries.filter(F.col("c2") == c).select("topic", F.col("enter_year").alias(f"enter_{c}"), F.col("flag").alias(f"flag_{c}"))
    j = side("CN").join(side("US"), "topic", "full_outer").withColumn("lag", F.col("enter_CN") - F.col("enter_US"))
    return j.withColumn("lag_label", F.when(F.col("lag").isNull(), "unknown").when(F.col("lag") > 0, "CN_lags").when(F.col("lag") < 0, "CN_leads").otherwise("same"))


def cross_corr_lag(rolled: DataFrame, max_lag: int = 10, min_overlap: int = 4) -> DataFrame:
    """The lag (position of CN minus position of US) with the largest correlation; the least lag wins ties."""
    at = F.row_number().over(Window.partitionBy("topic").orderBy("year"))
    s = rolled.withColumn("i", at)
    a = s.select("topic", F.col("i").alias("p"), F.col("share_CN").alias("x"), F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag"))
    b = s.select("topic", F.col("i").alias("q"), F.col("share_US").alias("y"))
    j = a.withColumn("q", F.col("p") - F.col("lag")).join(b, ["topic", "q"])
    c = j.groupBy("topic", "lag").agg(F.covar_pop("x", "y").alias("cov"), F.count("*").alias("n"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    c = c.filter((F.col("n") >= min_overlap) & (F.col("sx") > 1e-12) & (F.col("sy") > 1e-12)).withColumn("corr", F.col("cov") / (F.col("sx") * F.col("sy")))
    w = Window.partitionBy("topic").orderBy(F.round("corr", 9).desc(), "lag")
    return c.withColumn("k", F.row_number().over(w)).filter("k = 1").select("topic", F.col("lag").alias("lag_ccf"), F.col("corr").alias("max_corr"))
