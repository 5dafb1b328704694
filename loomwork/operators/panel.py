"""Topic x group x time panels: shares, rolling shares, frontiers, trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.columns import clip, densify, ratio, rolling


def focal_counts(df: DataFrame, keys: list[str], a: str = "CN", b: str = "US", by: str = "c2") -> DataFrame:
    """Counts of the two focal groups by keys, both columns always there."""
    return df.groupBy(*keys).agg(*[F.sum(F.when(F.col(by) == x, 1).otherwise(0)).alias(f"count_{x}") for x in (a, b)])


def yearly_topic_share(df: DataFrame) -> DataFrame:
    """Share of each topic within a focal group's year; only (topic, year) pairs that either group has."""
    n = focal_counts(df, ["topic", "year"]).filter("count_CN + count_US > 0")
    w = Window.partitionBy("year")
    for c in ("CN", "US"):
        n = n.withColumn(f"share_{c}", F.coalesce(ratio(f"count_{c}", F.sum(f"count_{c}").over(w)), F.lit(0.0)))
    return n.withColumn("delta", F.col("share_CN") - F.col("share_US"))


def years(df: DataFrame, contiguous: bool) -> DataFrame:
    """The observed years, or every year from the first to the last."""
    if not contiguous:
        return df.select("year").distinct()
    return df.agg(F.min("year").alias("a"), F.max("year").alias("b")).select(F.explode(F.sequence("a", "b")).alias("year"))


def rolling_topic_share(df: DataFrame, window: int = 5, min_periods: int = 3, contiguous: bool = False) -> DataFrame:
    """Rolling sums of counts over the complete topic x year grid, renormalised within the year; the first
    min_periods - 1 positions of a topic are left out."""
    n = densify(focal_counts(df, ["topic", "year"]), [df.select("topic").distinct(), years(df, contiguous)], {"count_CN": 0, "count_US": 0})
    w = rolling(["topic"], "year", window)
    n = n.withColumns({f"roll_count_{c}": F.sum(f"count_{c}").over(w) for c in ("CN", "US")})
    n = n.withColumn("pos", F.row_number().over(Window.partitionBy("topic").orderBy("year"))).filter(F.col("pos") >= min_periods)
    y = Window.partitionBy("year")
    for c in ("CN", "US"):
        n = n.withColumn(f"share_{c}", F.coalesce(ratio(f"roll_count_{c}", F.sum(f"roll_count_{c}").over(y)), F.lit(0.0)))
    return n.select("topic", "year", "roll_count_CN", "roll_count_US", "share_CN", "share_US", (F.col("share_CN") - F.col("share_US")).alias("delta"))


def rolling_country_share(df: DataFrame, window: int = 5, min_periods: int = 3) -> DataFrame:
    """The same for every country, over contiguous years."""
    n = df.groupBy("topic", "country", "year").agg(F.count("*").alias("n"))
    n = densify(n, [df.select("topic").distinct(), df.select("country").distinct(), years(df, True)], {"n": 0})
    n = n.withColumn("roll_count", F.sum("n").over(rolling(["topic", "country"], "year", window)))
    n = n.withColumn("pos", F.row_number().over(Window.partitionBy("topic", "country").orderBy("year"))).filter(F.col("pos") >= min_periods)
    return n.withColumn("share", F.coalesce(ratio("roll_count", F.sum("roll_count").over(Window.partitionBy("country", "year"))), F.lit(0.0))).drop("pos")


def top_mean(share: Column, rank: Column, k: int) -> Column:
    """Mean of the k largest positive shares; 0 if none."""
    return F.coalesce(F.avg(F.when((rank <= k) & (share > 0), share)), F.lit(0.0))


def catchup_panel(df: DataFrame, k: int = 3) -> DataFrame:
    """Count, share within topic and year, competition rank, frontier (mean of the k largest positive shares), ratio and gap, over
    the complete topic x country x year grid."""
    n = df.groupBy("topic", "country", "year").agg(F.count("*").alias("count"))
    n = densify(n, [df.select("topic").distinct(), df.select("country").distinct(), years(df, True)], {"count": 0})
    w = Window.partitionBy("topic", "year")
    n = n.withColumn("share", F.coalesce(ratio("count", F.sum("count").over(w)), F.lit(0.0)))
    n = n.withColumns({"rank": F.rank().over(w.orderBy(F.desc("share"))), "place": F.row_number().over(w.orderBy(F.desc("share"), "country"))})
    top = F.avg(F.when((F.col("place") <= k) & (F.col("share") > 0), F.col("share"))).over(w)
    n = n.withColumn("frontier_value", F.coalesce(top, F.lit(0.0)))
    n = n.withColumn("ratio_to_frontier", F.coalesce(ratio("share", "frontier_value"), F.lit(0.0)))
    return n.withColumn("gap_to_frontier", F.col("frontier_value") - F.col("share")).drop("place")


def country_filter_report(df: DataFrame, q: float = 0.4, by: str = "nation") -> DataFrame:
    """Countries whose total reaches the interpolated quantile q of all totals."""
    n = df.dropna("any", subset=["topic", by, "year"]).groupBy(F.col(by).alias("country")).agg(F.count("*").alias("total_count"))
    t = n.agg(F.percentile("total_count", q).alias("threshold_value"))  # one row
    return n.crossJoin(F.broadcast(t)).withColumn("keep_flag", F.col("total_count") >= F.col("threshold_value"))


def trajectory_units(panel: DataFrame, window: int = 3, min_periods: int = 2, min_active: int = 10, min_peak: float = 0.2) -> DataFrame:
    """Smoothed ratios of the (country, topic) series that are active in min_active years and peak at min_peak; positions
    before min_periods are 0. Long form: one row for each year."""
    unit = Window.partitionBy("country", "topic")
    p = panel.withColumns({"active": F.sum((F.col("count") > 0).cast("int")).over(unit), "peak": F.max("share").over(unit)})
    p = p.filter((F.col("active") >= min_active) & (F.col("peak") >= min_peak))
    at = F.row_number().over(unit.orderBy("year"))
    mean = F.avg("ratio_to_frontier").over(rolling(["country", "topic"], "year", window))
    return p.select("country", "topic", "year", F.when(at >= min_periods, mean).otherwise(0.0).alias("value"))


def frontier_delta(shares: DataFrame, focal: str, k: int = 3) -> DataFrame:
    """Frontier of each (topic, year) with its first two countries, and the focal country's distance to it."""
    w = Window.partitionBy("topic", "year").orderBy(F.desc("share"), "country")
    s = shares.withColumn("place", F.row_number().over(w))
    named = lambda i, c: F.max(F.when((F.col("place") == i) & (F.col("share") > 0), F.col(c)))
    out = s.groupBy("topic", "year").agg(
        F.coalesce(F.max(F.when(F.col("country") == focal, F.col("share"))), F.lit(0.0)).alias("share_focal"),
        top_mean(F.col("share"), F.col("place"), k).alias("frontier_share"),
        named(1, "country").alias("frontier_country_1"), named(2, "country").alias("frontier_country_2"),
    )
    return out.withColumn("delta", F.col("share_focal") - F.col("frontier_share"))


def log_decomposition(panel: DataFrame, eps: float = 1e-6, limit: float = 5.0) -> DataFrame:
    """Mean yearly change of log share and log frontier of each (country, topic), smoothed over 3 rows (2 at least), and its quadrant
    (split at 0)."""
    unit = Window.partitionBy("country", "topic").orderBy("year")
    p = panel.withColumns({"ls": F.ln(F.greatest("share", F.lit(eps))), "lf": F.ln(F.greatest("frontier_value", F.lit(eps)))})
    p = p.withColumns({"ds": clip(F.col("ls") - F.lag("ls").over(unit), -limit, limit), "df": clip(F.col("lf") - F.lag("lf").over(unit), -limit, limit), "before": F.lag("ls").over(unit)}).filter("before is not null")
    w, at = rolling(["country", "topic"], "year", 3), F.row_number().over(unit)
    p = p.select("country", "topic", *[F.when(at >= 2, F.avg(c).over(w)).alias(c) for c in ("ds", "df")])
    out = p.groupBy("country", "topic").agg(F.avg("ds").alias("dlog_share"), F.avg("df").alias("dlog_frontier"))
    s, f = F.round("dlog_share", 6) >= 0, F.round("dlog_frontier", 6) >= 0
    label = F.when(s & f, "both_up").when(s, "share_up").when(f, "frontier_up").otherwise("both_down")
    return out.withColumn("quadrant", label)


def cumulative_gap(yearly: DataFrame) -> DataFrame:
    return yearly.withColumn("cum_delta", F.sum("delta").over(Window.partitionBy("topic").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)))


def latest_top(df: DataFrame, value: str, n: int = 10) -> DataFrame:
    """The n rows of the last year with the largest absolute value."""
    last = df.agg(F.max("year").alias("year"))
    return df.join(F.broadcast(last), "year").orderBy(F.abs(F.round(value, 9)).desc(), "topic").limit(n)


def topic_country_matrix(df: DataFrame) -> DataFrame:
    """Counts, row and column shares, dominance (2 share - 1), and the total over all countries."""
    n = df.groupBy("topic").agg(F.sum((F.col("c2") == "CN").cast("long")).alias("count_CN"), F.sum((F.col("c2") == "US").cast("long")).alias("count_US"), F.count("*").alias("count_all"))
    both = F.col("count_CN") + F.col("count_US")
    n = n.withColumns({"row_share_CN": ratio("count_CN", both), "row_share_US": ratio("count_US", both), "dominance": 2 * ratio("count_CN", both) - 1})
    every = Window.partitionBy(F.lit(1))  # one row for each topic
    return n.withColumns({f"col_share_{c}": ratio(f"count_{c}", F.sum(f"count_{c}").over(every)) for c in ("CN", "US")})


def topic_coverage(df: DataFrame) -> DataFrame:
    has = df.filter(F.col("c2").isin("CN", "US")).groupBy("topic").agg(F.max((F.col("c2") == "CN").cast("int")).alias("cn"), F.max((F.col("c2") == "US").cast("int")).alias("us"))
    return has.agg(F.sum("cn").alias("topics_CN"), F.sum("us").alias("topics_US"), F.count("*").alias("topics_union"), F.sum(F.when(F.col("us") == 0, 1).otherwise(0)).alias("only_CN"), F.sum(F.when(F.col("cn") == 0, 1).otherwise(0)).alias("only_US"))


def yearly_country_share(df: DataFrame) -> DataFrame:
    """Share of each topic within its country's year, over the pairs that occur."""
    n = df.groupBy("topic", "country", "year").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.coalesce(ratio("n", F.sum("n").over(Window.partitionBy("country", "year"))), F.lit(0.0)))


def frontier_max(shares: DataFrame) -> DataFrame:
    """(topic, year, frontier_value): the largest share of any country."""
    return shares.groupBy("topic", "year").agg(F.max("share").alias("frontier_value"))


def focal_against_frontier(panel: DataFrame, country: str, tolerance: float = 1e-9) -> DataFrame:
    """A country's delta to the frontier, and whether it is the panel's gap with the other sign, within tolerance."""
    p = panel.filter(F.col("country") == country).withColumn("delta", F.col("share") - F.col("frontier_value"))
    return p.select("topic", "year", "delta", (F.abs(F.col("delta") + F.col("gap_to_frontier")) <= tolerance).alias("consistent"))


def gap_levels(rolled: DataFrame, k: int = 3) -> DataFrame:
    """One record of a table (topic, year, delta): mean and largest absolute gap, the mean of the k topics with the largest mean absolute gap,
    and both for the latest year."""
    a = rolled.withColumn("a", F.abs("delta"))
    by_topic = a.groupBy("topic").agg(F.avg("a").alias("m")).orderBy(F.desc(F.round("m", 12)), "topic").limit(k).agg(F.avg("m").alias("top_mean"))
    last = a.join(a.agg(F.max("year").alias("year")), "year").agg(F.avg("a").alias("latest_mean"), F.max("a").alias("latest_max"))
    return a.agg(F.avg("a").alias("mean_gap"), F.max("a").alias("max_gap")).crossJoin(by_topic).crossJoin(last)  # one row each


def gap_suite(df: DataFrame, levels: list[str], window: int = 5, min_periods: int = 3) -> DataFrame:
    """(level, kind, topic, year, delta): annual, rolling and cumulative gaps for each level of a hierarchy of topics."""
    out = []
    for level in levels:
        at = df.select(F.col(level).alias("topic"), "year", "c2")
        annual = yearly_topic_share(at)
        for kind, t in (("annual", annual.select("topic", "year", "delta")), ("rolling", rolling_topic_share(at, window, min_periods).select("topic", "year", "delta")), ("cumulative", cumulative_gap(annual).select("topic", "year", F.col("cum_delta").alias("delta")))):
            out.append(t.select(F.lit(level).alias("level"), F.lit(kind).alias("kind"), "topic", "year", "delta"))
    whole = out[0]
    for t in out[1:]:
        whole = whole.unionByName(t)
    return whole
