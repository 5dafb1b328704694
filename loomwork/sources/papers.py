"""Paper tables: readers, cleaning, country labels, and the stand-in view over the star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labels of the two focal countries.
CN_LABELS = ("CN", "China", "PRC", "P.R. China", "Peoples R China", "People's Republic of China")
US_LABELS = ("US", "USA", "U.S.A.", "United States", "United States of America")
#: Tag names of the source table and what they become.
RENAMES = {"TI": "title", "AB": "abstract", "PY": "year", "TC": "citation", "UT": "paper_id"}


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet, CSV or JSON table by its suffix."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind == "csv":
        return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return spark.read.format({"json": "json", "orc": "orc"}.get(kind, "parquet")).load(path)


def first_readable(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """The first of several tables that exists, in order of precedence; Hadoop's file systems answer, not the driver's disk."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            return read_any(spark, path)
    return None


def first_present(df: DataFrame, names: list[str]) -> str | None:
    return next((n for n in names if n in df.columns), None)


def first_filled(df: DataFrame, names: list[str]) -> str | None:
    """The first of names that is a column with a non-null value; one job counts all of them."""
    here = [n for n in names if n in df.columns]
    if not here:
        return None
    counts = df.agg(*[F.count(F.col(n)).alias(n) for n in here]).first()
    return next((n for n in here if counts[n]), None)


def country_exact(c: Column) -> Column:
    """CN, US, or the label itself; Other for null."""
    return F.when(c.isin(*CN_LABELS), "CN").when(c.isin(*US_LABELS), "US").otherwise(F.coalesce(c, F.lit("Other")))


def country_three(c: Column) -> Column:
    """CN, US or OTHER by exact labels."""
    return F.when(c.isin(*CN_LABELS), "CN").when(c.isin(*US_LABELS), "US").otherwise("OTHER")


def country_folded(c: Column) -> Column:
    """CN, US or OTHER whatever the case, with a few more names."""
    low = F.lower(F.trim(c))
    cn = [x.lower() for x in CN_LABELS] + ["p.r. china", "mainland china"]
    us = [x.lower() for x in US_LABELS] + ["america"]
    return F.when(low.isin(*cn), "CN").when(low.isin(*us), "US").otherwise("OTHER")


def country_contains(c: Column) -> Column:
    """CN or US if the label holds the country's name anywhere."""
    low = F.lower(c)
    return F.when(low.contains("china"), "CN").when(low.contains("united states"), "US").otherwise("OTHER")


def clean_papers(raw: DataFrame, min_text: int = 20) -> DataFrame:
    """Rows with a title or an abstract, their joined text (min_text characters at least), numeric year, country code."""
    df = raw.withColumnsRenamed({k: v for k, v in RENAMES.items() if k in raw.columns and v not in raw.columns})
    for name in ("title", "abstract", "year", "country"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    df = df.dropna("all", subset=["title", "abstract"])
    strip = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    df = df.withColumn("text", F.concat(strip(F.col("title")), F.lit(". "), strip(F.col("abstract"))))
    df = df.filter(F.length("text") >= min_text).withColumn("year", F.col("year").cast("string").try_cast("double").cast("int"))
    return df.withColumn("country_code", country_exact(F.col("country")))


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in paper table: topic = brand, country = region, c2 = focal pair, year = quarter of shipping, citation = quantity."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = (
        t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return df.select(
        F.col("p_brand").alias("topic"), F.col("p_type").alias("parent"), F.col("r_name").alias("country"), F.col("n_name").alias("nation"),
        F.when(F.col("r_name") == "AFRICA", "CN").when(F.col("r_name") == "AMERICA", "US").otherwise("OTHER").alias("c2"),
        ((F.year("l_shipdate") - 1995) * 4 + F.quarter("l_shipdate") - 1).cast("int").alias("year"), F.col("l_quantity").alias("citation"),
    )


WORKS_SQL = """works AS (SELECT p_brand AS topic, p_type AS parent, r_name AS country, n_name AS nation,
 CASE r_name WHEN 'AFRICA' THEN 'CN' WHEN 'AMERICA' THEN 'US' ELSE 'OTHER' END AS c2,
 CAST((year(l_shipdate) - 1995) * 4 + quarter(l_shipdate) - 1 AS INTEGER) AS year, l_quantity AS citation
 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
 JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
