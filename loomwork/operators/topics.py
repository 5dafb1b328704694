"""Text statistics of topics and soft memberships."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.columns import ratio


def tokens(docs: DataFrame, topic: str, text: str = "text", stop: tuple = (), least: int = 2) -> DataFrame:
    """(topic, term): every run of a-z of the lower-cased text with `least` letters or more that is no stop word."""
    t = docs.select(F.col(topic).alias("topic"), F.explode(F.split(F.regexp_replace(F.lower(text), "[^a-z]+", " "), " ")).alias("term"))
    t = t.filter(F.length("term") >= least)
    return t.filter(~F.col("term").isin(*stop)) if stop else t


def bigrams(docs: DataFrame, topic: str, text: str = "text") -> DataFrame:
    words = F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z]+", " "), " "), lambda w: F.length(w) > 0)
    d = docs.select(F.col(topic).alias("topic"), words.alias("w")).filter(F.size("w") > 1)
    pairs = F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return d.select("topic", F.explode(pairs).alias("term"))


def ctfidf(terms: DataFrame) -> DataFrame:
    """tf (share of the topic's tokens) times ln(mean tokens of a topic / topics with the term + 1)."""
    n = terms.groupBy("topic", "term").agg(F.count("*").alias("n"))
    rows = n.groupBy("topic").agg(F.sum("n").alias("total"))
    mean = rows.agg(F.avg("total").alias("mean_total"))
    df = n.groupBy("term").agg(F.count("*").alias("df"))
    j = n.join(rows, "topic").join(df, "term").crossJoin(F.broadcast(mean))
    return j.select("topic", "term", "n", (F.col("n") / F.col("total") * F.ln(F.col("mean_total") / F.col("df") + 1)).alias("score"))


def top_words(scores: DataFrame, k: int = 10) -> DataFrame:
    w = Window.partitionBy("topic").orderBy(F.round("score", 9).desc(), "term")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def topic_names(top: DataFrame, n: int = 3) -> DataFrame:
    """The first n words joined by _, and the title that stands in for a written summary."""
    words = F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"])
    return top.groupBy("topic").agg(words.alias("w")).select("topic", F.array_join(F.slice("w", 1, n), "_").alias("name"), F.array_join(F.slice("w", 1, 3), " / ").alias("title"), F.md5(F.array_join("w", "|")).alias("cache_key"))


def keyword_jaccard(top: DataFrame) -> DataFrame:
    """Jaccard index of the word sets of each pair of topics (a small table: one set for each topic)."""
    sets = top.groupBy("topic").agg(F.collect_set("term").alias("w"))
    a, b = sets.toDF("topic_a", "wa"), sets.toDF("topic_b", "wb")
    j = a.join(b, F.col("topic_a") < F.col("topic_b"))
    return j.select("topic_a", "topic_b", (F.size(F.array_intersect("wa", "wb")) / F.size(F.array_union("wa", "wb"))).alias("jaccard"))


def memberships(vectors: DataFrame, centers: DataFrame, m: float = 2.0) -> DataFrame:
    """(id, topic, weight): fuzzy memberships 1 / sum over centres of (d_i / d_j) ** (2 / (m - 1)). centers is a small table."""
    sq = F.aggregate(F.zip_with("embedding", "centroid", lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
    d = vectors.crossJoin(F.broadcast(centers.withColumnRenamed("label", "topic"))).withColumn("w", F.pow(F.greatest(sq, F.lit(1e-12)), F.lit(-1.0 / (m - 1))))
    keep = [c for c in vectors.columns if c not in ("embedding", "label")]
    return d.select(*keep, "topic", (F.col("w") / F.sum("w").over(Window.partitionBy("id"))).alias("weight"))


def boundary(membership: DataFrame) -> DataFrame:
    """For each id: normalised entropy, gap of the two largest weights, effective number of topics."""
    r = membership.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy(F.round("weight", 12).desc(), "topic")))
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("weight")))
    return r.groupBy("id").agg((-F.sum(F.col("weight") * F.ln(F.col("weight"))) / F.ln(F.count("*"))).alias("entropy"), (pick(1) - pick(2)).alias("top_gap"), (1 / F.sum(F.col("weight") ** 2)).alias("effective_topics"))


def topic_boundary(membership: DataFrame) -> DataFrame:
    """Averages of the boundary measures weighted by membership."""
    j = membership.join(boundary(membership), "id")
    return j.groupBy("topic").agg(*[ratio(F.sum(F.col("weight") * F.col(c)), F.sum("weight")).alias(c) for c in ("entropy", "top_gap", "effective_topics")])


def fuzzy_share(membership: DataFrame) -> DataFrame:
    """Summed weights of the focal groups by topic and year, and their shares of the year."""
    n = membership.filter(F.col("country").isin("CN", "US")).groupBy("topic", "year").agg(*[F.sum(F.when(F.col("country") == c, F.col("weight")).otherwise(0.0)).alias(f"weight_{c}") for c in ("CN", "US")])
    y = Window.partitionBy("year")
    n = n.withColumns({f"share_{c}": F.coalesce(ratio(f"weight_{c}", F.sum(f"weight_{c}").over(y)), F.lit(0.0)) for c in ("CN", "US")})
    return n.withColumn("delta", F.col("share_CN") - F.col("share_US"))


def soft_composition(membership: DataFrame, parent: int) -> DataFrame:
    """For each focal group the mean membership in every topic weighted by membership in the parent topic, and their gap."""
    p = membership.filter(F.col("topic") == parent).select("id", F.col("weight").alias("u"))
    j = membership.filter(F.col("country").isin("CN", "US")).join(p, "id")
    part = lambda c: ratio(F.sum(F.when(F.col("country") == c, F.col("u") * F.col("weight"))), F.sum(F.when(F.col("country") == c, F.col("u")))).alias(f"comp_{c}")
    return j.groupBy("topic").agg(part("CN"), part("US")).withColumn("gap", F.col("comp_CN") - F.col("comp_US"))


def profiles(membership: DataFrame, least: float = 0.03, low: int = 4, high: int = 8, cover: float = 0.85) -> DataFrame:
    """Each document's topics by weight: at least `low`, then until `cover` of the weight or `high` topics, none below `least` beyond low."""
    w = Window.partitionBy("id").orderBy(F.round("weight", 12).desc(), "topic")
    r = membership.withColumns({"k": F.row_number().over(w), "before": F.coalesce(F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))})
    return r.filter((F.col("k") <= low) | (F.col("k") <= high) & (F.round("before", 9) < cover) & (F.col("weight") >= least)).select("id", "topic", "weight", "k")


def fuzzy_rolling(shares: DataFrame, window: int = 3, min_periods: int = 2) -> DataFrame:
    """Rolling sums of a topic's weights over its years, their shares of the year and the gap, and the gap summed up to the year."""
    w = Window.partitionBy("topic").orderBy("year").rowsBetween(-(window - 1), 0)
    r = shares.withColumns({**{f"roll_{c}": F.sum(f"weight_{c}").over(w) for c in ("CN", "US")}, "pos": F.row_number().over(Window.partitionBy("topic").orderBy("year"))}).filter(F.col("pos") >= min_periods)
    y = Window.partitionBy("year")
    r = r.withColumn("roll_delta", F.coalesce(ratio("roll_CN", F.sum("roll_CN").over(y)), F.lit(0.0)) - F.coalesce(ratio("roll_US", F.sum("roll_US").over(y)), F.lit(0.0)))
    return r.select("topic", "year", "roll_delta", F.sum("delta").over(Window.partitionBy("topic").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)).alias("cum_delta"))


def country_boundary_gap(membership: DataFrame) -> DataFrame:
    """For each topic the boundary measures averaged by membership within each focal group, and CN less US."""
    j = membership.filter(F.col("country").isin("CN", "US")).join(boundary(membership), "id")
    part = lambda c, g: ratio(F.sum(F.when(F.col("country") == g, F.col("weight") * F.col(c))), F.sum(F.when(F.col("country") == g, F.col("weight"))))
    return j.groupBy("topic").agg(*[(part(c, "CN") - part(c, "US")).alias(f"{c}_gap") for c in ("entropy", "top_gap", "effective_topics")])


def country_year_boundary(membership: DataFrame) -> DataFrame:
    """Means of the boundary measures by country and year."""
    who = membership.select("id", "country", "year").distinct()
    return boundary(membership).join(who, "id").groupBy("country", "year").agg(*[F.avg(c).alias(c) for c in ("entropy", "effective_topics", "top_gap")])


def composition_distance(composition: DataFrame) -> DataFrame:
    """One record: Jensen-Shannon divergence in bits, L1 and cosine distance of two columns comp_CN and comp_US that each sum to 1."""
    p, q = F.col("comp_CN"), F.col("comp_US")
    m = (p + q) / 2
    kl = lambda x: F.sum(F.when(x > 0, x * F.log2(x / m)).otherwise(0.0))
    return composition.agg(((kl(p) + kl(q)) / 2).alias("js"), F.sum(F.abs(p - q)).alias("l1"), (1 - F.sum(p * q) / F.sqrt(F.sum(p * p) * F.sum(q * q))).alias("cosine_distance"))


def fuzzy_cmeans(vectors: DataFrame, centers: DataFrame, rounds: int = 10) -> tuple[DataFrame, DataFrame]:
    """(memberships, centers) after `rounds` updates with m = 2: a center is the mean of all vectors by squared membership. centers is a
    small table (label, centroid); each round sends one partial sum for each task, center and dimension."""
    for _ in range(rounds):
        w = memberships(vectors, centers).select("id", "topic", (F.col("weight") ** 2).alias("u"))
        x = w.join(vectors.select("id", F.posexplode("embedding").alias("place", "x")), "id")
        sums = x.groupBy("topic", "place").agg((F.sum(F.col("u") * F.col("x").cast("double")) / F.sum("u")).alias("x"))
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda s: s["x"])
        centers = sums.groupBy(F.col("topic").alias("label")).agg(ordered.alias("centroid"))
    return memberships(vectors, centers), centers


def partition_coefficient(membership: DataFrame) -> DataFrame:
    """(fpc): the mean over documents of the sum of squared memberships."""
    return membership.groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("s")).agg(F.avg("s").alias("fpc"))


def ngrams(docs: DataFrame, topic: str, text: str = "text", stop: tuple = (), most: int = 20_000) -> DataFrame:
    """(topic, term, n) of the words and pairs of neighbouring words, without stop words, of the `most` terms that occur most often in
    all; ties by term. Pairs are of the words that are left."""
    kept = F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z]+", " "), " "), lambda w: (F.length(w) >= 2) & ~w.isin(*stop) if stop else F.length(w) >= 2)
    d = docs.select(F.col(topic).alias("topic"), kept.alias("w")).filter(F.size("w") > 0)
    pairs = F.when(F.size("w") > 1, F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    n = d.select("topic", F.explode(F.concat("w", pairs)).alias("term")).groupBy("topic", "term").agg(F.count("*").alias("n"))
    top = n.groupBy("term").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "term").limit(most)
    return n.join(top.select("term"), "term")


def weighted_terms(terms: DataFrame, membership: DataFrame) -> DataFrame:
    """(topic, term, weight): the sum over documents of membership times count, from terms (id, term, n)."""
    return terms.join(membership.select("id", "topic", F.col("weight").alias("u")), "id").groupBy("topic", "term").agg(F.sum(F.col("u") * F.col("n")).alias("weight"))
