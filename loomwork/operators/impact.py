"""Impact: bucket-normalised citations, top shares, frontier sets, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def normalized_citations(df: DataFrame) -> DataFrame:
    """nc = (citation + 1) / (bucket mean + 1), with the bucket's mean, median and size."""
    rows = df.filter("topic is not null and year is not null and citation is not null")
    stats = rows.groupBy("topic", "year").agg(F.avg("citation").alias("expected_mean"), F.median("citation").alias("expected_median"), F.count("*").alias("bucket_size"))
    out = rows.join(stats, ["topic", "year"])
    return out.withColumn("nc", (F.col("citation") + 1) / (F.col("expected_mean") + 1))


def top_flag(df: DataFrame, q: float = 0.9, min_size: int = 20) -> DataFrame:
    """Whether a citation reaches its bucket's interpolated quantile q (ties count); false in buckets below min_size."""
    cut = df.groupBy("topic", "year").agg(F.percentile("citation", q).alias("q90"), F.count("*").alias("bucket_size"))
    cut = cut.withColumn("q90", F.when(F.col("bucket_size") >= min_size, F.col("q90")))
    return df.join(cut, ["topic", "year"]).withColumn("top10_flag", F.coalesce(F.col("citation") >= F.col("q90"), F.lit(False)))


def frontier_sets(flagged: DataFrame, recent: int = 5) -> DataFrame:
    """A: flagged up to the year before the last; B: flagged in the `recent` years that end there."""
    last = flagged.agg(F.max("year").alias("last"))
    f = flagged.crossJoin(F.broadcast(last))
    f = f.withColumns({"frontier_A": F.col("top10_flag") & (F.col("year") <= F.col("last") - 1), "frontier_B": F.col("top10_flag") & F.col("year").between(F.col("last") - recent, F.col("last") - 1)})
    kind = F.when(F.col("frontier_A") & F.col("frontier_B"), "A_and_B").when(F.col("frontier_A"), "A_only").when(F.col("frontier_B"), "B_only")
    return f.withColumn("frontier_type", kind).drop("last")


def impact_gap(flagged: DataFrame) -> DataFrame:
    """Mean nc and top share of the focal groups by topic and their US - CN gaps; top shares over eligible buckets only. Outer: a topic
    with either part is there."""
    mean = lambda v, c, ok=F.lit(True): F.avg(F.when((F.col("c2") == c) & ok, v))
    top, ok = F.col("top10_flag").cast("double"), F.col("q90").isNotNull()
    mncs = flagged.groupBy("topic").agg(mean(F.col("nc"), "CN").alias("mncs_CN"), mean(F.col("nc"), "US").alias("mncs_US"))
    pp = flagged.filter(ok).groupBy("topic").agg(mean(top, "CN").alias("pp10_CN"), mean(top, "US").alias("pp10_US"))
    out = mncs.join(pp, "topic", "full_outer")
    return out.withColumns({"mncs_gap": F.col("mncs_US") - F.col("mncs_CN"), "pp10_gap": F.col("pp10_US") - F.col("pp10_CN")})


def quality_quadrant(gap: DataFrame, matrix: DataFrame) -> DataFrame:
    """Quantity lead (dominance) against quality lead (mncs gap), and how frequent each quadrant is."""
    j = gap.join(matrix.select("topic", "dominance"), "topic")
    more, better = F.round("dominance", 6) >= 0, F.round("mncs_gap", 6) <= 0
    label = F.when(more & better, "more_better").when(more, "more_weaker").when(better, "fewer_better").otherwise("fewer_weaker")
    n = j.groupBy(label.alias("quadrant")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))
