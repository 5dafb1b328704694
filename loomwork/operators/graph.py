"""Graph measures on undirected edges (i, j, sim) and nodes (id, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.columns import rolling
from loomwork.functions.storage import cut


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("i").alias("u"), F.col("j").alias("v"), "sim").unionByName(edges.select(F.col("j").alias("u"), F.col("i").alias("v"), "sim"))


def degree_strength(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    d = both_ways(edges).groupBy(F.col("u").alias("id")).agg(F.count("*").alias("degree"), F.sum("sim").alias("strength"))
    return nodes.select("id").join(d, "id", "left").fillna({"degree": 0, "strength": 0.0})


def degree_summary(degrees: DataFrame) -> DataFrame:
    return degrees.agg(F.count("*").alias("n_nodes"), F.sum((F.col("degree") == 0).cast("int")).alias("isolated"), F.avg("degree").alias("mean_degree"), *[F.percentile("degree", q).alias(f"q{int(100 * q)}") for q in (0.25, 0.5, 0.75, 0.9)])


def mixing(edges: DataFrame, nodes: DataFrame, attr: str) -> DataFrame:
    """Counts between attribute values, off-diagonal pairs in both orders, the diagonal once."""
    e = _named(edges, nodes, attr)
    pair = e.select("a", "b").unionByName(e.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    return pair.groupBy("a", "b").agg(F.count("*").alias("n"))


def _named(edges: DataFrame, nodes: DataFrame, attr: str) -> DataFrame:
    n = nodes.select("id", F.col(attr).cast("string").alias("x"))
    return edges.join(n.withColumnsRenamed({"id": "i", "x": "a"}), "i").join(n.withColumnsRenamed({"id": "j", "x": "b"}), "j")


def pair_counts(edges: DataFrame, nodes: DataFrame, attr: str) -> DataFrame:
    e = _named(edges, nodes, attr)
    return e.groupBy(F.concat(F.least("a", "b"), F.lit("-"), F.greatest("a", "b")).alias("pair")).agg(F.count("*").alias("n"))


def assortativity(edges: DataFrame, nodes: DataFrame, attr: str) -> DataFrame:
    """(trace - sum of squared marginals) / (1 - the same) of the symmetric mixing matrix."""
    e = _named(edges, nodes, attr)
    ends = e.select(F.col("a").alias("x")).unionByName(e.select(F.col("b").alias("x"))).groupBy("x").agg(F.count("*").alias("n"))
    total = e.agg(F.count("*").alias("m"), F.sum((F.col("a") == F.col("b")).cast("int")).alias("same"))
    ab = ends.crossJoin(F.broadcast(total)).agg(F.sum((F.col("n") / (2 * F.col("m"))) ** 2).alias("ab"))
    return total.crossJoin(ab).select((((F.col("same") / F.col("m")) - F.col("ab")) / F.when(F.col("ab") != 1, 1 - F.col("ab"))).alias("assortativity"))


def modularity(edges: DataFrame, nodes: DataFrame, community: str) -> DataFrame:
    """Unweighted modularity of a partition."""
    e = _named(edges, nodes, community)
    total = e.agg(F.count("*").alias("m"))
    inside = e.filter("a = b").groupBy(F.col("a").alias("c")).agg(F.count("*").alias("l"))
    deg = e.select(F.col("a").alias("c")).unionByName(e.select(F.col("b").alias("c"))).groupBy("c").agg(F.count("*").alias("d"))
    j = deg.join(inside, "c", "left").crossJoin(F.broadcast(total))
    return j.agg(F.sum(F.coalesce("l", F.lit(0)) / F.col("m") - (F.col("d") / (2 * F.col("m"))) ** 2).alias("modularity"), F.count("*").alias("n_communities"))


def bridge_ratio(edges: DataFrame, nodes: DataFrame, community: str) -> DataFrame:
    """For each node the larger of the shares of its edges that leave its community, as first and as second end."""
    e = _named(edges, nodes, community).withColumn("x", (F.col("a") != F.col("b")).cast("double"))
    one, two = e.groupBy(F.col("i").alias("id")).agg(F.avg("x").alias("p")), e.groupBy(F.col("j").alias("id")).agg(F.avg("x").alias("q"))
    j = nodes.select("id").join(one, "id", "left").join(two, "id", "left")
    return j.select("id", F.greatest(F.coalesce("p", F.lit(0.0)), F.coalesce("q", F.lit(0.0))).alias("bridging"))


def edge_year_series(edges: DataFrame, nodes: DataFrame, window: int = 5, min_periods: int = 2) -> DataFrame:
    """Edges by the earlier year of their ends: total, across countries, CN-US; ratios and their rolling means."""
    n = nodes.select("id", "year", "country")
    e = edges.join(n.withColumnsRenamed({"id": "i", "year": "yi", "country": "a"}), "i").join(n.withColumnsRenamed({"id": "j", "year": "yj", "country": "b"}), "j")
    e = e.groupBy(F.least("yi", "yj").alias("year")).agg(F.count("*").alias("total"), F.sum((F.col("a") != F.col("b")).cast("int")).alias("cross"), F.sum((F.concat(F.least("a", "b"), F.greatest("a", "b")) == "CNUS").cast("int")).alias("cn_us")).filter("year > 1900")
    e = e.withColumns({"cross_ratio": F.col("cross") / F.col("total"), "cn_us_ratio": F.col("cn_us") / F.col("total")})
    at = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("year"))  # one row for each year
    w = Window.partitionBy(F.lit(1)).orderBy("year").rowsBetween(-(window - 1), 0)
    return e.withColumns({f"{c}_roll": F.when(at >= min_periods, F.avg(c).over(w)) for c in ("cross_ratio", "cn_us_ratio")})


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component): the least id that edges reach. Labels take the least of their neighbours', then the label's label, so the
    rounds grow with the logarithm of the diameter."""
    e = cut(both_ways(edges).select("u", "v").distinct())
    label = cut(nodes.select("id", F.col("id").alias("c")))
    while True:
        near = e.join(label.withColumnsRenamed({"id": "v", "c": "d"}), "v").groupBy(F.col("u").alias("id")).agg(F.min("d").alias("d"))
        new = label.join(near, "id", "left").select("id", F.least("c", "d").alias("c"))
        hop = new.join(new.select(F.col("id").alias("c"), F.col("c").alias("cc")), "c").select("id", F.least("c", "cc").alias("c"), "c")
        hop = cut(hop.toDF("id", "c", "old").select("id", "c"))
        if hop.join(label.withColumnRenamed("c", "before"), "id").filter("c <> before").isEmpty():
            return hop.select("id", F.col("c").alias("component"))
        label = hop


def pagerank(edges: DataFrame, nodes: DataFrame, rounds: int = 10, alpha: float = 0.85) -> DataFrame:
    """PageRank over undirected edges, a fixed number of rounds; isolated nodes spread their rank evenly. A round reads the one before three
    times, so each is written."""
    e = both_ways(edges).select("u", "v")
    deg = e.groupBy("u").agg(F.count("*").alias("d"))
    e = cut(e.join(deg, "u"))
    n = nodes.count()
    ids = nodes.select("id").join(deg.withColumnRenamed("u", "id"), "id", "left")
    rank = cut(ids.withColumn("r", F.lit(1.0 / max(1, n))))
    for _ in range(rounds):
        loose = rank.agg(F.coalesce(F.sum(F.when(F.col("d").isNull(), F.col("r"))), F.lit(0.0)).alias("loose"))
        got = e.join(rank.select(F.col("id").alias("u"), "r"), "u").groupBy(F.col("v").alias("id")).agg(F.sum(F.col("r") / F.col("d")).alias("got"))
        new = rank.select("id", "d").join(got, "id", "left").crossJoin(F.broadcast(loose))
        rank = cut(new.select("id", "d", ((1 - alpha) / n + alpha * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n)).alias("r")))
    return rank.select("id", F.col("r").alias("pagerank"))


def kcore(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, coreness) by h-index rounds: a node's value becomes the largest h such that h neighbours have h or more, till nothing changes."""
    e = cut(both_ways(edges).select("u", "v").distinct())
    value = cut(e.groupBy(F.col("u").alias("id")).agg(F.count("*").alias("h")))
    while True:
        near = e.join(value.select(F.col("id").alias("v"), "h"), "v")
        near = near.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("h"))))
        new = cut(near.groupBy(F.col("u").alias("id")).agg(F.max(F.least("h", "r")).cast("long").alias("h")))
        if new.join(value.withColumnRenamed("h", "old"), "id").filter("h <> old").isEmpty():
            return nodes.select("id").join(new, "id", "left").select("id", F.coalesce("h", F.lit(0)).alias("coreness"))
        value = new


def core_share(coreness: DataFrame, nodes: DataFrame, q: float = 0.75, window: int = 5, min_periods: int = 2) -> DataFrame:
    """Share of each country among the core nodes (coreness at its quantile q or above) of each year, and its rolling mean."""
    cutoff = coreness.agg(F.percentile("coreness", q).alias("q"))
    c = coreness.join(nodes, "id").crossJoin(F.broadcast(cutoff)).filter("coreness >= q")
    n = c.groupBy("year").agg(F.count("*").alias("n"), *[F.sum((F.col("country") == x).cast("int")).alias(f"n_{x}") for x in ("CN", "US")])
    n = n.withColumns({f"share_{x}": F.col(f"n_{x}") / F.col("n") for x in ("CN", "US")})
    n = n.withColumn("g", F.lit(1))
    at = F.row_number().over(Window.partitionBy("g").orderBy("year"))
    return n.withColumns({f"share_{x}_roll": F.when(at >= min_periods, F.avg(f"share_{x}").over(rolling(["g"], "year", window))) for x in ("CN", "US")}).drop("g")


def label_propagation(edges: DataFrame, nodes: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, community): in each round every node takes the label with the largest summed similarity among its neighbours (the least label wins
    ties)."""
    e = cut(both_ways(edges))
    label = nodes.select("id", F.col("id").alias("c"))
    for _ in range(rounds):
        votes = e.join(label.select(F.col("id").alias("v"), "c"), "v").groupBy("u", "c").agg(F.round(F.sum("sim"), 6).alias("w"))
        best = votes.withColumn("k", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("w"), "c"))).filter("k = 1").select(F.col("u").alias("id"), F.col("c").alias("new"))
        label = cut(label.join(best, "id", "left").select("id", F.coalesce("new", "c").alias("c")))
    return label.select("id", F.col("c").alias("community"))


def window_metrics(edges: DataFrame, nodes: DataFrame, size: int = 5) -> DataFrame:
    """Nodes, edges and country shares of the graph among the nodes of the last `size` years, for each end year."""
    last = nodes.agg(F.max("year")).first()[0]
    w = nodes.select("id", "country", F.explode(F.expr(f"sequence(year, year + {size - 1})")).alias("t_end")).filter(F.col("t_end") <= (last if last is not None else 0))
    n = w.groupBy("t_end").agg(F.count("*").alias("n_nodes"), F.avg((F.col("country") == "CN").cast("double")).alias("share_CN"), F.avg((F.col("country") == "US").cast("double")).alias("share_US"))
    a, b = w.select(F.col("id").alias("i"), "t_end"), w.select(F.col("id").alias("j"), "t_end")
    m = edges.join(a, "i").join(b, ["j", "t_end"]).groupBy("t_end").agg(F.count("*").alias("n_edges"))
    return n.join(m, "t_end", "left").fillna({"n_edges": 0})


def compare_centrality(scores: DataFrame, a: str, b: str) -> DataFrame:
    """scores (id, a, b) with the competition rank by each and their difference. Ranks come from the counts of the distinct values, whose table is
    what one task sorts."""
    out = scores
    for c in (a, b):
        n = scores.groupBy(c).agg(F.count("*").alias("n"))
        ranks = n.select(c, (F.sum("n").over(Window.orderBy(F.col(c).desc())) - F.col("n") + 1).alias(f"rank_{c}"))
        out = out.join(ranks, c)
    return out.withColumn("shift", F.abs(F.col(f"rank_{a}") - F.col(f"rank_{b}")))


def select_subgraph(edges: DataFrame, scores: DataFrame, most: int, half: str, whole: str) -> DataFrame:
    """The edges among the `most` nodes with the largest whole + 0.5 x half, ties by id."""
    top = scores.select("id", F.round(F.col(whole) + 0.5 * F.col(half), 9).alias("s")).orderBy(F.desc("s"), "id").limit(most).select("id")
    return edges.join(top.withColumnRenamed("id", "i"), "i", "left_semi").join(top.withColumnRenamed("id", "j"), "j", "left_semi")


def collapsed(nodes: DataFrame, attr: str, most: int = 15, other: str = "other") -> DataFrame:
    """nodes whose attribute is one of the `most` frequent values (ties by value), or other."""
    top = nodes.filter(F.col(attr).isNotNull()).groupBy(F.col(attr).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(most).select("value", F.lit(1).alias("top"))
    named = nodes.withColumn("value", F.col(attr).cast("string")).join(F.broadcast(top), "value", "left")  # `most` rows
    return named.withColumn(attr, F.when(F.col("top").isNotNull(), F.col("value")).otherwise(F.lit(other))).drop("value", "top")


def group_share(nodes: DataFrame, member: str, groups: DataFrame, by: str) -> DataFrame:
    """For every one of groups (by) the shares of CN, US and OTHER among its nodes for which `member` holds; 0 where it has none."""
    some = nodes.filter(member)
    code = F.when(F.col("country").isin("CN", "US"), F.col("country")).otherwise("OTHER")
    s = some.groupBy(by).agg(F.count("*").alias("n"), *[F.avg((code == c).cast("int")).alias(f"share_{c}") for c in ("CN", "US", "OTHER")])
    return groups.select(by).distinct().join(s, by, "left").fillna(0)


def layer_composition(nodes: DataFrame, window: int) -> DataFrame:
    """(t_end, layer, label, n_CN, n_US, gap): for each year the nodes (id, year, country, label, layer) of the window of years that ends
    there, each focal group's share of its nodes of the layer, and the gap."""
    years = nodes.select(F.col("year").alias("t_end")).distinct()
    w = nodes.filter(F.col("country").isin("CN", "US")).join(F.broadcast(years), (F.col("year") <= F.col("t_end")) & (F.col("year") > F.col("t_end") - window))  # a row for each year
    n = w.groupBy("t_end", "layer", "label").agg(*[F.sum((F.col("country") == c).cast("int")).alias(f"n_{c}") for c in ("CN", "US")])
    all_ = Window.partitionBy("t_end", "layer")
    share = lambda c: F.coalesce(F.col(f"n_{c}") / F.nullif(F.sum(f"n_{c}").over(all_), F.lit(0)), F.lit(0.0))
    return n.withColumn("gap", share("CN") - share("US"))
