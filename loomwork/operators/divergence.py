"""Distances between distributions, agreement of labelings, overlap at a lag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.columns import ratio, rolling


def js_columns(p: Column, q: Column, base: float | None = None) -> Column:
    """The sum aggregate whose root is the Jensen-Shannon distance of two distributions given row by row."""
    m = (p + q) / 2
    term = lambda x: F.when(x > 0, x * F.ln(x / m)).otherwise(0.0)
    total = F.sum(term(p) + term(q)) / 2
    if base:
        import math

        total = total / math.log(base)
    return total


def js_distance(counts: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    """Jensen-Shannon distance (natural log) and divergence of the normalised columns a and b; null if either is all 0."""
    w = Window.partitionBy(*(keys or [F.lit(1)]))
    n = counts.withColumns({"p": ratio(a, F.sum(a).over(w)), "q": ratio(b, F.sum(b).over(w))})
    agg = F.when((F.sum("p") > 0) & (F.sum("q") > 0), F.greatest(js_columns(F.col("p"), F.col("q")), F.lit(0.0))).alias("js_divergence")
    n = n.groupBy(*keys).agg(agg) if keys else n.agg(agg)
    return n.withColumn("js_distance", F.sqrt("js_divergence"))


def parent_structure(df: DataFrame, eps: float = 1e-12) -> DataFrame:
    """For each parent: base-2 JS distance, L1 and cosine distance of the focal groups' distributions over its topics, smoothed by
    eps, and the mean of the three largest absolute gaps."""
    n = df.groupBy("parent", "topic").agg(*[F.sum((F.col("c2") == c).cast("long")).alias(c) for c in ("CN", "US")])
    w = Window.partitionBy("parent")
    for c in ("CN", "US"):
        n = n.withColumn(c, F.coalesce(ratio(c, F.sum(c).over(w)), F.lit(0.0)) + eps)
        n = n.withColumn(c, F.col(c) / F.sum(c).over(w))
    n = n.withColumn("place", F.row_number().over(w.orderBy(F.round(F.abs(F.col("CN") - F.col("US")), 12).desc(), "topic")))
    gap = F.abs(F.col("CN") - F.col("US"))
    return n.groupBy("parent").agg(
        F.sqrt(F.greatest(js_columns(F.col("CN"), F.col("US"), 2.0), F.lit(0.0))).alias("js2"), F.sum(gap).alias("l1"),
        (1 - F.sum(F.col("CN") * F.col("US")) / F.sqrt(F.sum(F.col("CN") ** 2) * F.sum(F.col("US") ** 2))).alias("cosine_distance"),
        F.avg(F.when(F.col("place") <= 3, gap)).alias("top3_gap"),
    )


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(a), F.lit(-1)).alias("a"), F.coalesce(F.col(b), F.lit(-1)).alias("b")).agg(F.count("*").alias("n"))


def agreement(table: DataFrame) -> DataFrame:
    """NMI (arithmetic mean of the entropies) and adjusted Rand index of a contingency table (a, b, n)."""
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2
    total = table.agg(F.sum("n").alias("t"))
    rows = table.groupBy("a").agg(F.sum("n").alias("na"))
    cols = table.groupBy("b").agg(F.sum("n").alias("nb"))
    t = table.join(rows, "a").join(cols, "b").crossJoin(F.broadcast(total))
    mi = t.agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"), F.sum(pairs("n")).alias("sij"))
    side = lambda d, c, h, s: d.crossJoin(F.broadcast(total)).agg((-F.sum(F.col(c) / F.col("t") * F.ln(F.col(c) / F.col("t")))).alias(h), F.sum(pairs(c)).alias(s))
    one = mi.crossJoin(side(rows, "na", "ha", "si")).crossJoin(side(cols, "nb", "hb", "sj")).crossJoin(total)
    expected = F.col("si") * F.col("sj") / (F.col("t") * (F.col("t") - 1) / 2)
    return one.select(
        F.when(F.col("ha") + F.col("hb") > 0, F.col("mi") / ((F.col("ha") + F.col("hb")) / 2)).otherwise(1.0).alias("nmi"),
        F.when((F.col("si") + F.col("sj")) / 2 != expected, (F.col("sij") - expected) / ((F.col("si") + F.col("sj")) / 2 - expected)).otherwise(1.0).alias("ari"),
    )


def size_stats(df: DataFrame, label: str = "topic") -> DataFrame:
    """Number, least, median and largest size of the labels, largest share, coefficient of variation, entropy."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    n = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))
    return n.agg(
        F.count("*").alias("n_topics"), F.min("n").alias("min_size"), F.median("n").alias("median_size"), F.max("n").alias("max_size"), F.max("p").alias("max_share"),
        (F.stddev_pop("n") / (F.avg("n") + 1e-12)).alias("cv"), (-F.sum(F.col("p") * F.ln(F.col("p") + 1e-15))).alias("entropy"),
    )


def group_year_shares(df: DataFrame, min_docs: int = 5, window: int = 3) -> DataFrame:
    """Topic shares of each focal group and year with min_docs documents, averaged over the present rows of a window."""
    n = df.filter(F.col("c2").isin("CN", "US")).groupBy("c2", "year", "topic").agg(F.count("*").alias("n"))
    n = n.withColumn("total", F.sum("n").over(Window.partitionBy("c2", "year"))).filter(F.col("total") >= min_docs)
    return n.select("c2", "year", "topic", F.avg(F.col("n") / F.col("total")).over(rolling(["c2", "topic"], "year", window)).alias("share"))


def overlap_leadlag(shares: DataFrame, max_lag: int = 6, min_share: float = 0.01) -> DataFrame:
    """Weighted Jaccard, binary Jaccard and cosine between CN in a year and US lag years later, over the topics that reach min_share on
    either side. Long form: (metric, year, lag, value)."""
    cn = shares.filter("c2 = 'CN'").select("topic", "year", F.col("share").alias("s"), F.lit(0.0).alias("t"))
    lags = F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag")
    cn = cn.select("*", lags)
    us = shares.filter("c2 = 'US'").select("topic", F.col("year").alias("y"), F.col("share").alias("t"), lags).select("topic", (F.col("y") - F.col("lag")).alias("year"), F.lit(0.0).alias("s"), "t", "lag")
    both = cn.unionByName(us).groupBy("year", "lag", "topic").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    ok = both.withColumns({"has_s": F.max("s").over(Window.partitionBy("year", "lag")), "has_t": F.max("t").over(Window.partitionBy("year", "lag"))})
    ok = ok.filter((F.col("has_s") > 0) & (F.col("has_t") > 0) & (F.greatest("s", "t") >= min_share))
    hit = lambda c: F.col(c) >= min_share
    out = ok.groupBy("year", "lag").agg(
        ratio(F.sum(F.least("s", "t")), F.sum(F.greatest("s", "t"))).alias("weighted_jaccard"),
        ratio(F.sum((hit("s") & hit("t")).cast("int")), F.sum((hit("s") | hit("t")).cast("int"))).alias("binary_jaccard"),
        ratio(F.sum(F.col("s") * F.col("t")), F.sqrt(F.sum(F.col("s") ** 2) * F.sum(F.col("t") ** 2))).alias("cosine"),
    )
    return out.unpivot(["year", "lag"], ["weighted_jaccard", "binary_jaccard", "cosine"], "metric", "value")


def best_lag(curves: DataFrame) -> DataFrame:
    """The lag with the largest value of each metric and year; the smaller lag wins ties."""
    w = Window.partitionBy("metric", "year").orderBy(F.round("value", 9).desc(), "lag")
    return curves.filter("value is not null").withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")
