"""Connected components by alternating large and small stars, as DataFrames in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import stored


def _with_least(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) and m, the least of u and its partners. A plain aggregation joined back: a node with very many
    links is summed before the shuffle, and the join may split it."""
    return pairs.join(pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "u")


def _pairs(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """(u, v) for each row and each named pair of its columns, without reading rows once for each pair."""
    return rows.select(F.inline(F.array(*(F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs))))


def components(edges: DataFrame) -> DataFrame:
    """(id, class_id) of every node of edges (a, b): class_id is the least id that links reach. Loops are ignored."""
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = stored(edges, "edges")
    before = None
    while True:  # each half of a round is written, so a plan has one join, however many rounds there are
        both = _pairs(edges, ("u", "v"), ("v", "u"))
        large = stored(_with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large")
        edges = stored(_pairs(_with_least(large), ("v", "m"), ("u", "m")).filter("u <> v").distinct(), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return _pairs(edges, ("u", "v"), ("v", "v")).distinct().select(F.col("u").alias("id"), F.col("v").alias("class_id"))
