"""Edge lists: reference parsing, standardising, time filters, orientation, buckets, set comparison, retrieval curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed format: a DOI after the word DOI in one reference.
DOI = r"(?i)DOI\s*\[?\s*(10\.\d{4,9}/[-._;()/:A-Z0-9]+)"


def normalize_doi(c: Column) -> Column:
    s = F.lower(F.trim(c))
    for prefix in ("https://doi.org/", "http://doi.org/", "http://dx.doi.org/", "https://dx.doi.org/", "doi:"):
        s = F.replace(s, F.lit(prefix), F.lit(""))
    return F.trim(s)


def citation_edges(refs: DataFrame, dois: DataFrame) -> DataFrame:
    """(src, dst) from refs (src, cr), a `;`-separated list, and dois (dst, doi): the first DOI of each reference, trailing .,; off,
    joined to the DOI table; self references and repeats go."""
    r = refs.select("src", F.explode(F.split("cr", ";")).alias("ref"))
    r = r.select("src", F.lower(F.regexp_replace(F.regexp_extract("ref", DOI, 1), r"[.,;]+$", "")).alias("doi")).filter("doi <> ''")
    d = dois.select("dst", normalize_doi(F.col("doi")).alias("doi"))
    return r.join(d, "doi").filter(F.col("src").cast("string") != F.col("dst").cast("string")).select("src", "dst").distinct()


def standardize(edges: DataFrame, weight: float = 1.0) -> DataFrame:
    """String ids, no empty ids, no loops, weight filled, the heaviest of repeated pairs."""
    e = edges.select(F.trim(F.col("src").cast("string")).alias("src"), F.trim(F.col("dst").cast("string")).alias("dst"), F.coalesce(F.col("sim").cast("double"), F.lit(weight)).alias("sim"))
    e = e.filter((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst")))
    return e.groupBy("src", "dst").agg(F.max("sim").alias("sim"))


def undirected(edges: DataFrame) -> DataFrame:
    """One edge (i < j) for each pair, with the largest similarity."""
    return edges.groupBy(F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j")).agg(F.max("sim").alias("sim"))


def time_filter(edges: DataFrame, allow_same: bool = True, drop_unknown: bool = False, window: int | None = None) -> DataFrame:
    """Known years must go back in time (or stay), by window years at most; unknown ones stay unless drop_unknown."""
    known = F.col("year_src").isNotNull() & F.col("year_dst").isNotNull()
    gap = F.col("year_src") - F.col("year_dst")
    ok = gap >= (0 if allow_same else 1)
    if window is not None:
        ok = ok & (gap <= window)
    return edges.filter(F.when(known, ok).otherwise(F.lit(not drop_unknown)))


def orient(edges: DataFrame, nodes: DataFrame, allow_same: bool = True) -> DataFrame:
    """Directed edges from undirected (i, j, sim) by year: later to earlier; both ways for equal years (if allowed) and unknown ones."""
    n = nodes.select(F.col("id"), F.col("year"))
    e = edges.join(n.withColumnsRenamed({"id": "i", "year": "yi"}), "i").join(n.withColumnsRenamed({"id": "j", "year": "yj"}), "j")
    one = F.struct(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("yi").alias("year_src"), F.col("yj").alias("year_dst"))
    two = F.struct(F.col("j").alias("src"), F.col("i").alias("dst"), F.col("yj").alias("year_src"), F.col("yi").alias("year_dst"))
    unknown = F.col("yi").isNull() | F.col("yj").isNull()
    ways = F.when(unknown, F.array(one, two)).when(F.col("yi") > F.col("yj"), F.array(one)).when(F.col("yi") < F.col("yj"), F.array(two)).otherwise(F.array(one, two) if allow_same else F.array().cast("array<struct<src:bigint,dst:bigint,year_src:int,year_dst:int>>"))
    return e.select("sim", F.explode(ways).alias("e")).select("e.src", "e.dst", "sim", "e.year_src", "e.year_dst")


def annotate(edges: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Both endpoints' attributes, with the suffixes _src and _dst."""
    for side in ("src", "dst"):
        edges = edges.join(nodes.select(F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side, "left")
    return edges


def gap_bucket(gap: Column) -> Column:
    return F.when(gap.isNull(), "unknown").when(gap <= 0, "0").when(gap <= 2, "1-2").when(gap <= 5, "3-5").when(gap <= 10, "6-10").otherwise(">10")


def edge_buckets(edges: DataFrame) -> DataFrame:
    """Counts by edge type, country pair, year gap and same topic, with shares of the type and of the bucket."""
    b = edges.groupBy(
        "edge_type", F.concat_ws("->", "country_src", "country_dst").alias("country_pair"), gap_bucket(F.col("year_src") - F.col("year_dst")).alias("gap_bin"),
        ((F.col("topic_src") == F.col("topic_dst")) & (F.col("topic_src") != -1)).alias("same_topic"),
    ).agg(F.count("*").alias("n"))
    share = lambda *k: F.col("n") / F.sum("n").over(Window.partitionBy(*k))
    return b.withColumns({"share_in_type": share("edge_type"), "share_in_bucket": share("country_pair", "gap_bin", "same_topic")})


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sizes of both, only a, only b, and the Jaccard index of two edge sets (i, j)."""
    x, y = a.select("i", "j", F.lit(1).alias("a")).distinct(), b.select("i", "j", F.lit(1).alias("b")).distinct()
    n = x.join(y, ["i", "j"], "full_outer").agg(F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("both"), F.count(F.when(F.col("b").isNull(), 1)).alias("only_a"), F.count(F.when(F.col("a").isNull(), 1)).alias("only_b"))
    return n.withColumn("jaccard", F.col("both") / F.when(F.col("both") + F.col("only_a") + F.col("only_b") > 0, F.col("both") + F.col("only_a") + F.col("only_b")))


def edge_types(sim: DataFrame, truth: DataFrame) -> DataFrame:
    """(src, dst, edge_type): both, only_sim or only_cite."""
    x, y = sim.select("src", "dst", F.lit(1).alias("a")).distinct(), truth.select("src", "dst", F.lit(1).alias("b")).distinct()
    kind = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "both").when(F.col("b").isNull(), "only_sim").otherwise("only_cite")
    return x.join(y, ["src", "dst"], "full_outer").select("src", "dst", kind.alias("edge_type"))


def pr_curve(ranked: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
    """Precision, recall and hits of the first K ranked edges, for K in ks and all. Only max(ks) edges are ranked in one task."""
    hit = ranked.join(truth.select("i", "j").distinct().withColumn("hit", F.lit(1)), ["i", "j"], "left").fillna({"hit": 0})
    total = truth.select("i", "j").distinct().agg(F.count("*").alias("total_true"))
    top = hit.orderBy(F.desc("sim"), "i", "j").limit(max(ks)).withColumn("r", F.row_number().over(Window.orderBy(F.desc("sim"), "i", "j")))
    some = top.select(F.explode(F.array(*map(F.lit, ks))).alias("K"), "r", "hit").filter("r <= K").groupBy("K").agg(F.sum("hit").alias("hit_count"), F.count("*").alias("used")).filter("used = K").drop("used")
    whole = hit.agg(F.count("*").cast("int").alias("K"), F.sum("hit").alias("hit_count"))
    both = some.unionByName(whole).distinct().crossJoin(F.broadcast(total))
    return both.select("K", F.col("hit_count").cast("long"), (F.col("hit_count") / F.col("K")).alias("precision"), (F.col("hit_count") / F.greatest("total_true", F.lit(1))).alias("recall"), "total_true")


def node_recall_at_k(neighbors: DataFrame, truth: DataFrame, nodes: DataFrame, ks: list[int], window: int | None = None) -> DataFrame:
    """For each node and K the share of its truth edges among its first K neighbours that pass the time filter; null without truth."""
    years = nodes.select("id", "year")
    n = neighbors.join(years.withColumnsRenamed({"id": "src", "year": "year_src"}), "src").join(years.withColumnsRenamed({"id": "dst", "year": "year_dst"}), "dst")
    n = time_filter(n, window=window).withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("sim"), "dst")))
    n = n.join(truth.select("src", "dst").distinct().withColumn("hit", F.lit(1)), ["src", "dst"], "left")
    out = truth.select("src", "dst").distinct().groupBy("src").agg(F.count("*").alias("n_true"))
    hits = n.groupBy("src").agg(*[F.sum(F.when((F.col("r") <= k) & F.col("hit").isNotNull(), 1).otherwise(0)).alias(f"h{k}") for k in ks])
    both = years.select(F.col("id").alias("src")).join(out, "src", "left").join(hits, "src", "left")
    return both.select("src", "n_true", F.explode(F.array(*[F.struct(F.lit(k).alias("K"), F.coalesce(F.col(f"h{k}"), F.lit(0)).alias("hit_count")) for k in ks])).alias("x")).select("src", "x.K", F.col("x.hit_count").cast("long").alias("hit_count"), F.col("n_true"), (F.col("x.hit_count") / F.col("n_true")).alias("recall"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges (i, j, ...) with both ends among nodes (id)."""
    n = nodes.select("id").distinct()
    return edges.join(n.withColumnRenamed("id", "i"), "i", "left_semi").join(n.withColumnRenamed("id", "j"), "j", "left_semi")


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("i").alias("id")).unionByName(edges.select(F.col("j").alias("id"))).distinct()


def harmonized_nodes(a: DataFrame, b: DataFrame, known: DataFrame, mode: str = "intersection") -> DataFrame:
    """The nodes that both graphs have, or either (mode "union"), among the known ones."""
    x, y = nodes_of(a), nodes_of(b)
    return (x.intersect(y) if mode == "intersection" else x.unionByName(y).distinct()).join(known.select("id").distinct(), "id", "left_semi")


def edge_xor(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, in_a): the edges that exactly one of two graphs has."""
    x = a.select("i", "j").distinct().withColumn("in_a", F.lit(True))
    y = b.select("i", "j").distinct().withColumn("in_b", F.lit(True))
    j = x.join(y, ["i", "j"], "full").select("i", "j", F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"))
    return j.filter("in_a <> in_b").select("i", "j", "in_a")


def retrieval_summary(neighbors: DataFrame, nodes: DataFrame, by: list[str]) -> DataFrame:
    """For each group of sources: sources, distinct neighbours, mean and median similarity."""
    n = neighbors.join(nodes.select(F.col("id").alias("src"), *by), "src")
    return n.groupBy(*by).agg(F.countDistinct("src").alias("n_src"), F.countDistinct("dst").alias("n_dst"), F.avg("sim").alias("mean_sim"), F.median("sim").alias("median_sim"))


def direction_checks(oriented: DataFrame) -> DataFrame:
    """One record of directed edges (src, dst, year_src, year_dst): quantiles of the out-degree and of the year gap, and the share of gap 0."""
    gap = F.col("year_src") - F.col("year_dst")
    degree = oriented.groupBy("src").agg(F.count("*").alias("d"))
    d = degree.agg(F.count("*").alias("n_src"), *[F.percentile("d", q).alias(f"out_q{round(100 * q)}") for q in (0.5, 0.9)])
    return oriented.agg(F.count("*").alias("n_edges"), *[F.percentile(gap, q).alias(f"gap_q{round(100 * q)}") for q in (0.25, 0.5, 0.75)], F.avg((gap == 0).cast("int")).alias("same_year")).crossJoin(d)  # one row each


def below_out_degree(oriented: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """(id, out_degree) of the nodes with fewer than `least` outgoing edges, those without any too."""
    d = oriented.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    return nodes.select("id").join(d, "id", "left").fillna({"out_degree": 0}).filter(F.col("out_degree") < least)
