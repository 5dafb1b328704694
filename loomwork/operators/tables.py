"""Row and column operations on any table: numbering, checked joins, lookups, value counts, checks, repairs, codes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, group: Column, order: Sequence, name: str = "number") -> DataFrame:
    """df with consecutive numbers from 0, by group and by order within it. Groups are numbered each in a task of its own, and their offsets
    are a sum over one row for each group, so no task sees all rows; group has as many values as tasks are wanted."""
    g = df.withColumn("__group", group)
    sizes = g.groupBy("__group").agg(F.count("*").alias("__n"))
    offsets = sizes.select("__group", (F.sum("__n").over(Window.orderBy("__group")) - F.col("__n")).alias("__before"))
    ranked = g.withColumn("__rank", F.row_number().over(Window.partitionBy("__group").orderBy(*order)))
    return ranked.join(offsets, "__group").withColumn(name, (F.col("__before") + F.col("__rank") - 1).cast("long")).drop("__group", "__rank", "__before")


def with_paper_ids(df: DataFrame, key: str, groups: int = 64) -> DataFrame:
    """df with a paper_id "paper_{i}", where it has none: rows are numbered by (key modulo groups, key)."""
    if "paper_id" in df.columns:
        return df
    n = numbered(df, F.pmod(F.col(key), F.lit(groups)), [key], "__paper")
    return n.withColumn("paper_id", F.concat(F.lit("paper_"), F.col("__paper").cast("string"))).drop("__paper")


def clamped(df: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """The rows whose value is known, moved into low..high."""
    return df.filter(F.col(column).isNotNull()).withColumn(column, F.greatest(F.lit(low), F.least(F.lit(high), F.col(column))))


def infer_columns(columns: Sequence[str], candidates: dict[str, Sequence[str]]) -> dict[str, str | None]:
    """For each role the first of its candidate names that a table has, whatever the case; None for a role that has none."""
    have = {c.lower(): c for c in columns}
    return {role: next((have[n.lower()] for n in names if n.lower() in have), None) for role, names in candidates.items()}


def join_many_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join that may not multiply rows: raises if a key occurs more than once on the right, as the query runs."""
    once = Window.partitionBy(*keys)
    checked = right.withColumn("__n", F.count("*").over(once))
    checked = checked.withColumn("__ok", F.when(F.col("__n") > 1, F.raise_error(F.lit("keys are not unique on the right side")).cast("boolean")).otherwise(F.lit(True)))
    return left.join(checked.filter("__ok").drop("__n", "__ok"), keys, "left")


def lookup(df: DataFrame, column: str, mapping: dict, name: str, default=None) -> DataFrame:
    """df with name = mapping[column], or default. The mapping is a literal: it is small, a table goes through a join."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]) if mapping else None
    found = F.try_element_at(table, F.col(column)) if mapping else F.lit(None)
    return df.withColumn(name, F.coalesce(found, F.lit(default)) if default is not None else found)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share) of a column's known values."""
    n = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def top_values(df: DataFrame, group: str, column: str, k: int = 10) -> DataFrame:
    """The k most frequent values of a column in each group, ties by value."""
    n = df.filter(F.col(column).isNotNull()).groupBy(group, F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "value"))).filter(F.col("rank") <= k)


def data_checks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row for each numeric column: rows, share missing, mean, median, least, most."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns]))
    long = df.select(each.alias("c")).select("c.name", "c.x")
    return long.groupBy("name").agg(
        F.count("*").alias("n_rows"), F.avg(F.col("x").isNull().cast("int")).alias("missing_rate"), F.avg("x").alias("mean"), F.median("x").alias("median"), F.min("x").alias("least"), F.max("x").alias("most")
    )


def describe(df: DataFrame, column: str, by: list[str], shares: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """count, mean, sample std, min, quantiles and max of a column by group."""
    c = F.col(column)
    return df.groupBy(*by).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("low"), *[F.percentile(c, q).alias(f"q{round(100 * q)}") for q in shares], F.max(c).alias("high"))


def repaired(df: DataFrame, column: str, nan: float = 0.0, high: float = 50.0, low: float = 0.0) -> DataFrame:
    """df with `was_finite`, and NaN, infinity and minus infinity replaced."""
    c = F.col(column)
    odd = F.isnan(c) | (F.abs(c) == float("inf"))
    return df.withColumn("was_finite", ~odd).withColumn(column, F.when(F.isnan(c), nan).when(c == float("inf"), high).when(c == float("-inf"), low).otherwise(c))


def coded(df: DataFrame, column: str, name: str = "code") -> DataFrame:
    """df with the place of each value among the sorted distinct values, from 0. The values are numbered as a table of their own, a row each."""
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    codes = values.withColumn(name, (F.row_number().over(Window.orderBy(column)) - 1).cast("long"))
    return df.join(codes, column, "left")


def standardized(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with each column less its mean, over its population standard deviation; 0 for a constant column."""
    stats = df.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.crossJoin(F.broadcast(stats))  # one row
    out = out.withColumns({c: F.when(F.col(f"__s_{c}") > 0, (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")).otherwise(0.0) for c in columns})
    return out.select(*df.columns)


def pearson(df: DataFrame, key: str, series: str, value: str) -> DataFrame:
    """(a, b, r, n): the correlation of each pair of series over the keys that both have. series is a small axis."""
    a, b = (df.select(key, F.col(series).alias(s), F.col(value).alias(f"v{s}")) for s in ("a", "b"))
    j = a.join(b, key).filter("a < b")
    return j.groupBy("a", "b").agg(F.corr("va", "vb").alias("r"), F.count("*").alias("n"))


def unit(df: DataFrame, column: str) -> DataFrame:
    """df with the vector divided by its length; a zero vector stays."""
    size = F.sqrt(F.aggregate(column, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return df.withColumn(column, F.transform(column, lambda x: x.cast("double") / F.when(size > 0, size).otherwise(1.0)))


def json_object(c: Column, schema: str) -> Column:
    """The JSON object of a text: the text itself, or else what stands between its first { and last }."""
    whole = F.from_json(c, schema)
    first = F.from_json(F.regexp_extract(c, r"(?s)\{.*\}", 0), schema)
    return F.when(F.trim(c).startswith("{") & F.trim(c).endswith("}"), whole).otherwise(first)


def crosswalk(a: DataFrame, b: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(x, y, n, share of x's units): the units that both tables label, joined on the keys."""
    n = a.select(*keys, x).join(b.select(*keys, y), keys).groupBy(x, y).agg(F.count("*").alias("n"))
    return n.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy(x)))


def best_match(a: DataFrame, b: DataFrame, id_col: str, x: str, y: str, least: float = 0.3) -> DataFrame:
    """For each cluster of x the cluster of y with the largest Jaccard index of their documents; it exists if that is above least."""
    both = a.select(id_col, x).join(b.select(id_col, y), id_col).groupBy(x, y).agg(F.count("*").alias("n"))
    na, nb = a.groupBy(x).agg(F.count("*").alias("na")), b.groupBy(y).agg(F.count("*").alias("nb"))
    j = both.join(na, x).join(nb, y).withColumn("jaccard", F.col("n") / (F.col("na") + F.col("nb") - F.col("n")))
    best = j.withColumn("k", F.row_number().over(Window.partitionBy(x).orderBy(F.desc(F.round("jaccard", 9)), y))).filter("k = 1")
    return best.select(x, y, "jaccard", (F.col("jaccard") > least).alias("found"))


def pick_best(metrics: DataFrame, order: Sequence[tuple[str, bool]]) -> DataFrame:
    """The first row by several columns, each (name, ascending)."""
    return metrics.orderBy(*[F.col(c).asc() if up else F.col(c).desc() for c, up in order]).limit(1)


def rank_aggregate(metrics: DataFrame, scores: Sequence[tuple[str, bool]], penalty: Column | None = None) -> DataFrame:
    """metrics (a row for each configuration) with the sum of its average ranks by the scores, each (name, smaller is better), nulls last, and the
    penalty; and its place by that sum."""
    out, names = metrics, []
    for c, smaller in scores:
        order = F.col(c).asc_nulls_last() if smaller else F.col(c).desc_nulls_last()
        ties = F.count("*").over(Window.partitionBy(c))
        out = out.withColumn(f"rank_{c}", F.rank().over(Window.orderBy(order)) + (ties - 1) / 2)
        names.append(f"rank_{c}")
    total = reduce(lambda a, b: a + b, [F.col(n) for n in names])
    return out.withColumn("rank_sum", total + (penalty if penalty is not None else F.lit(0.0))).withColumn("place", F.rank().over(Window.orderBy("rank_sum")))


def topic_count_penalty(n: Column, low: int = 20, high: int = 120) -> Column:
    """0 for a topic count within low..high, else how far it is outside, as a share of the bound."""
    return F.when(n < low, (F.lit(low) - n) / F.lit(float(low))).when(n > high, (n - F.lit(high)) / F.lit(float(high))).otherwise(0.0)


def capped_sample(df: DataFrame, strata: list[str], cap: int, total: int, order: Sequence) -> DataFrame:
    """cap rows of each stratum at most, first by order; then topped up from the rest, or cut, to total rows, by the same order. The cut takes
    total rows of each task and then total of those, not a sort of all."""
    w = Window.partitionBy(*strata).orderBy(*order)
    ranked = df.withColumn("__late", (F.row_number().over(w) > cap).cast("int"))
    return ranked.orderBy("__late", *order).limit(total).drop("__late")
