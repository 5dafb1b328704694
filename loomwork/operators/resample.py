"""Resampling, matched negatives, a link model."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from loomwork.functions.storage import cut

#: Ranges of scores that running sums are made in.
RANGES = 64


def stratified_bootstrap(counts: DataFrame, strata: list[str], kinds: list[str], runs: int = 200, seed: int = 2026) -> DataFrame:
    """(run, strata, kinds, n) from counts (strata, kinds, n): in each run as many rows as a stratum has are drawn from it with
    replacement. What a draw of single rows gives for each kind is a multinomial draw, so no row is repeated. Seeded by stratum."""
    cols = strata + kinds

    def draw(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in kinds])
        n = rows.column("n").to_numpy()
        name = repr([rows.column(c)[0].as_py() for c in strata]).encode()
        got = np.random.default_rng([seed, zlib.crc32(name)]).multinomial(n.sum(), n / n.sum(), size=runs)
        out = {c: rows.column(c).take(pa.array(np.tile(np.arange(len(n)), runs))) for c in cols}
        return pa.table({"run": pa.array(np.repeat(np.arange(1, runs + 1), len(n)), pa.int32()), **out, "n": pa.array(got.ravel(), pa.int64())})

    schema = StructType([StructField("run", IntegerType()), *[counts.schema[c] for c in cols], StructField("n", LongType())])
    return counts.select(*cols, F.col("n").cast("long")).groupBy(*strata).applyInArrow(draw, schema)


def summarize_runs(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    q = lambda p: F.percentile(value, p)
    return runs.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), q(0.025).alias("q025"), q(0.5).alias("q50"), q(0.975).alias("q975"), F.count(value).alias("n"))


def stratified_sample(df: DataFrame, strata: list[str], key: str, per_group: int = 4) -> DataFrame:
    """per_group rows of each stratum, those with the least MD5 of the key."""
    w = Window.partitionBy(*strata).orderBy(F.md5(F.col(key).cast("string")), key)
    return df.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= per_group).drop("k")


def matched_negatives(pos: DataFrame, neg: DataFrame, strata: list[str], keys: list[str]) -> DataFrame:
    """As many rows of neg as pos has, or all if neg has fewer: first by stratum, as many as pos has there, then what lacks by the
    first of the strata, in proportion to pos and the largest first, then any. The order is that of the MD5 of the keys."""
    neg = neg.withColumn("md5", F.md5(F.concat_ws("-", *keys)))
    order = ["md5", *keys]
    same = lambda by: [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    counts = lambda df, by, name: df.groupBy(*by).agg(F.count("*").alias(name))
    join = lambda a, b, by: a.alias("a").join(b.alias("b"), same(by), "left").drop(*[F.col(f"b.{c}") for c in by])
    target = min(pos.count(), neg.count())
    total = max(1, pos.count())
    share = F.greatest(F.lit(1), F.round(F.col("quota") * target / total)).cast("long")

    def ranked(df, by):
        return df.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))

    first = ranked(join(neg, counts(pos, strata, "quota").withColumn("quota", share), strata), strata)
    first = first.withColumn("step", F.when(F.col("k") <= F.col("quota"), 1)).drop("k", "quota")
    lack = target - first.filter("step = 1").count()
    pair = strata[:1]
    free = counts(first.filter("step is null"), pair, "free")
    plan = join(counts(pos, pair, "quota"), free, pair).withColumn("want", F.least(share, F.coalesce("free", F.lit(0))))
    before = F.sum("want").over(Window.orderBy(F.desc("quota"), *pair).rowsBetween(Window.unboundedPreceding, -1))  # few pairs
    plan = plan.withColumn("want", F.greatest(F.lit(0), F.least("want", F.lit(lack) - F.coalesce(before, F.lit(0))))).select(*pair, "want")
    rest = ranked(join(first.filter("step is null"), plan, pair), pair)
    rest = rest.withColumn("step", F.when(F.col("k") <= F.col("want"), 2)).drop("k", "want")
    lack -= rest.filter("step = 2").count()
    any_ = rest.filter("step is null").orderBy(*order).limit(max(0, lack))
    out = first.filter("step = 1").unionByName(rest.filter("step = 2")).unionByName(any_).drop("step")
    if lack < 0:  # rounding asked for a few too many
        out = out.join(out.orderBy(*[F.desc(c) for c in ("md5", *keys)]).limit(-lack).select(*keys), keys, "left_anti")
    return out.drop("md5")


def link_model(edges: DataFrame, features: list[str], label: str = "y") -> DataFrame:
    """Class-balanced L2 logistic regression on z-scored features: (feature, coefficient, odds_ratio, auc, average_precision). What is read
    several times is written once. Running sums over the scores are made within ranges of them, so no task sees all."""
    edges = cut(edges.select(*features, label))
    stats = edges.agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features], F.avg(label).alias("p"), F.count("*").alias("n")).first()
    z = edges
    for c in features:
        z = z.withColumn(c, (F.col(c) - stats[f"m_{c}"]) / (stats[f"s_{c}"] or 1.0))
    p = stats["p"] or 0.0
    z = z.withColumn("weight", F.when(F.col(label) == 1, 0.5 / max(p, 1e-9)).otherwise(0.5 / max(1 - p, 1e-9))).withColumn(label, F.col(label).cast("double"))
    z = VectorAssembler(inputCols=features, outputCol="features").transform(z)
    m = LogisticRegression(labelCol=label, weightCol="weight", regParam=1.0 / max(1, stats["n"]), standardization=False).fit(z)
    s = m.transform(z).select(F.col(label).alias("y"), F.round(vector_to_array("probability")[1], 9).alias("s"))
    g = s.groupBy("s").agg(F.count("*").alias("n"), F.sum("y").alias("p"))  # ties count half; steps are by distinct score
    g = cut(g.repartitionByRange(RANGES, F.desc("s")).withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ranges = g.groupBy("range").agg(F.sum("n").alias("rn"), F.sum("p").alias("rp"))
    ranges = ranges.select("range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("rn", "rp")])
    desc = Window.partitionBy("range").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    g = g.join(F.broadcast(ranges), "range").withColumns({"cn": F.col("rn") + F.sum("n").over(desc), "cp": F.col("rp") + F.sum("p").over(desc)})
    total = g.agg(F.sum("p").alias("pos"), F.sum(F.col("n") - F.col("p")).alias("neg"))
    q = g.crossJoin(F.broadcast(total)).agg(
        (F.sum((F.col("n") - F.col("p")) * (F.col("cp") - F.col("p") / 2)) / F.max(F.col("pos") * F.col("neg"))).alias("auc"), F.sum(F.col("p") / F.col("pos") * F.col("cp") / F.col("cn")).alias("average_precision")
    )
    coef = edges.sparkSession.createDataFrame([(f, float(c)) for f, c in zip(features, m.coefficients, strict=True)], "feature string, coefficient double")
    return coef.crossJoin(q).withColumn("odds_ratio", F.exp("coefficient"))
