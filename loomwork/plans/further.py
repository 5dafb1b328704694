"""Further queries over the driver's tables, registered beside those of registry.py, with the SQL that they equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions.columns import ratio
from loomwork.operators import edges, graph, knn, panel, tables, topics, trajectory, trend
from loomwork.plans.registry import EMB, K, MEM, NB, NODES, ORIENTED, PANEL, ROLLED, TRUTH, YEARLY, _membership, _truth, query, vectors
from loomwork.sources.papers import WORKS_SQL, works


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


# ---------------------------------------------------------------- rows and columns


@query("SELECT doc_id, 'paper_' || (row_number() OVER (ORDER BY doc_id % 64, doc_id) - 1) AS paper_id FROM documents")
def paper_ids(spark, d):
    return tables.with_paper_ids(_docs(spark, d).select("doc_id"), "doc_id")


@query("""SELECT least(2100, greatest(1900, year(o_orderdate) + (o_orderkey % 5 - 2) * 60)) AS year, count(*) AS n FROM orders GROUP BY 1""")
def years_clamped(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select((F.year("o_orderdate") + (F.col("o_orderkey") % 5 - 2) * 60).alias("year"))
    return tables.clamped(o, "year", 1900, 2100).groupBy("year").agg(F.count("*").alias("n"))


@query(f"""WITH {WORKS_SQL}, n AS (SELECT country AS value, count(*) AS n FROM works GROUP BY country) SELECT value, n, round(n / sum(n) OVER (), 6) AS share FROM n""")
def country_value_counts(spark, d):
    return tables.value_counts(works(spark, d), "country")


@query(f"""WITH {WORKS_SQL}, n AS (SELECT topic, nation AS value, count(*) AS n FROM works GROUP BY ALL)
SELECT topic, value, n, row_number() OVER (PARTITION BY topic ORDER BY n DESC, value) AS rank FROM n QUALIFY rank <= 10""")
def top_nations(spark, d):
    return tables.top_values(works(spark, d), "topic", "nation")


@query("""WITH x AS (SELECT 'n_chars' AS name, CAST(n_chars AS DOUBLE) AS x FROM documents UNION ALL SELECT 'third', CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS DOUBLE) END FROM documents)
SELECT name, count(*) AS n_rows, round(avg(CASE WHEN x IS NULL THEN 1 ELSE 0 END), 6) AS missing_rate, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(min(x), 6) AS least, round(max(x), 6) AS most FROM x GROUP BY name""")
def document_checks(spark, d):
    return tables.data_checks(_docs(spark, d).withColumn("third", F.when(F.col("doc_id") % 3 == 0, F.col("doc_id"))), ["n_chars", "third"])


@query("""WITH x AS (SELECT r_name AS region, c_acctbal AS x FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT region, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS low, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS q50, round(quantile_cont(x, 0.75), 6) AS q75, round(max(x), 6) AS high FROM x GROUP BY region""")
def balance_summary(spark, d):
    c, n, r = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("customer", "nation", "region"))
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return tables.describe(j.select(F.col("r_name").alias("region"), F.col("c_acctbal").cast("double").alias("x")), "x", ["region"])


@query("""SELECT vec_id AS id, CASE vec_id % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 50.0 WHEN 2 THEN 0.0 ELSE CAST(vec_id AS DOUBLE) END AS x, vec_id % 5 > 2 AS was_finite FROM embeddings""")
def finite_repair(spark, d):
    k = F.col("vec_id") % 5
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf")).otherwise(F.col("vec_id").cast("double")).alias("x"))
    return tables.repaired(e, "x").select("id", "x", "was_finite")


@query("""SELECT n_nationkey, n_name, rank() OVER (ORDER BY n_name) - 1 AS code FROM nation""")
def nation_codes(spark, d):
    return tables.coded(spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_name"), "n_name")


@query(f"""{PANEL} SELECT topic, country, year, round(coalesce((share - avg(share) OVER ()) / nullif(stddev_pop(share) OVER (), 0), 0), 6) AS share, round(coalesce((ratio_to_frontier - avg(ratio_to_frontier) OVER ()) / nullif(stddev_pop(ratio_to_frontier) OVER (), 0), 0), 6) AS ratio_to_frontier FROM panel""")
def panel_standardized(spark, d):
    return tables.standardized(panel.catchup_panel(works(spark, d)).select("topic", "country", "year", "share", "ratio_to_frontier"), ["share", "ratio_to_frontier"])


@query(f"""{ROLLED} SELECT a.topic AS a, b.topic AS b, round(corr(a.delta, b.delta), 6) AS r, count(*) AS n FROM rolled a JOIN rolled b ON a.year = b.year AND a.topic < b.topic GROUP BY ALL""")
def topic_correlations(spark, d):
    return tables.pearson(panel.rolling_topic_share(works(spark, d)), "year", "topic", "delta")


@query(f"""WITH {EMB}, s AS (SELECT id, CASE WHEN id % 10 = 0 THEN list_transform(e, lambda x: 0.0) ELSE e END AS e FROM emb), n AS (SELECT id, e, sqrt(list_dot_product(e, e)) AS size FROM s)
SELECT id, round(coalesce(e[1] / nullif(size, 0), 0) + 0.0, 6) + 0.0 AS first, round(coalesce(size / nullif(size, 0), 0), 6) AS size FROM n""")
def unit_vectors(spark, d):
    e = vectors(spark, d).withColumn("embedding", F.when(F.col("id") % 10 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.transform("embedding", lambda x: x * 3)))
    u = tables.unit(e, "embedding")
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    return u.select("id", (F.round(F.get("embedding", F.lit(0)), 6) + 0.0).alias("first"), size.alias("size"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE doc_id END AS id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE lang END AS name, md5(substr(text, 1, 200)) AS prefix_md5 FROM documents WHERE text IS NOT NULL""")
def json_answers(spark, d):
    t = _docs(spark, d).filter("text is not null")
    inner = F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("lang").alias("name")), {"ignoreNullFields": "false"})
    said = F.when(F.col("doc_id") % 4 == 3, F.lit("no object here")).when(F.col("doc_id") % 2 == 0, inner).otherwise(F.concat(F.lit("Sure:\n```json\n"), inner, F.lit("\n``` done")))
    return t.withColumn("o", tables.json_object(said, "id long, name string")).select("doc_id", "o.id", "o.name", F.md5(F.substring("text", 1, 200)).alias("prefix_md5"))


@query(f"""WITH {WORKS_SQL}, n AS (SELECT topic, count(*) AS n FROM works GROUP BY topic), t AS (SELECT p_brand AS topic, count(*) AS parts FROM part GROUP BY 1)
SELECT topic, n, parts, CAST(ceil(0.1 * n) AS BIGINT) AS tenth FROM n LEFT JOIN t USING (topic)""")
def topic_sizes_checked(spark, d):
    n = works(spark, d).groupBy("topic").agg(F.count("*").alias("n"))
    parts = spark.read.parquet(f"{d}/part.parquet").groupBy(F.col("p_brand").alias("topic")).agg(F.count("*").alias("parts"))
    return tables.join_many_to_one(n, parts, ["topic"]).withColumn("tenth", F.ceil(0.1 * F.col("n")).cast("long"))


@query(f"""WITH {WORKS_SQL} SELECT CASE country WHEN 'AFRICA' THEN 'AF' WHEN 'ASIA' THEN 'AS' WHEN 'EUROPE' THEN 'EU' ELSE '??' END AS code, count(*) AS n FROM works GROUP BY 1""")
def country_lookup(spark, d):
    return tables.lookup(works(spark, d), "country", {"AFRICA": "AF", "ASIA": "AS", "EUROPE": "EU"}, "code", "??").groupBy("code").agg(F.count("*").alias("n"))


@query(f"""{PANEL}, u AS (SELECT country, topic, CASE WHEN max(share) >= 0.3 THEN 'high' ELSE 'low' END AS peak, CASE WHEN min(rank) = 1 THEN 'led' ELSE 'followed' END AS place FROM panel GROUP BY ALL),
n AS (SELECT peak, place, count(*) AS n FROM u GROUP BY ALL) SELECT peak, place, n, round(n / sum(n) OVER (PARTITION BY peak), 6) AS fraction FROM n""")
def label_crosswalk(spark, d):
    p = panel.catchup_panel(works(spark, d)).groupBy("country", "topic").agg(F.max("share").alias("s"), F.min("rank").alias("r"))
    a, b = p.select("country", "topic", F.when(F.col("s") >= 0.3, "high").otherwise("low").alias("peak")), p.select("country", "topic", F.when(F.col("r") == 1, "led").otherwise("followed").alias("place"))
    return tables.crosswalk(a, b, ["country", "topic"], "peak", "place")


@query(f"""WITH {EMB}, c AS (SELECT label AS x, id % 7 AS y, count(*) AS n FROM emb GROUP BY ALL), a AS (SELECT label AS x, count(*) AS na FROM emb GROUP BY 1), b AS (SELECT id % 7 AS y, count(*) AS nb FROM emb GROUP BY 1),
j AS (SELECT x, y, n / (na + nb - n) AS jaccard FROM c JOIN a USING (x) JOIN b USING (y)), k AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY round(jaccard, 9) DESC, y) AS k FROM j)
SELECT x, y, round(jaccard, 6) AS jaccard, jaccard > 0.3 AS found FROM k WHERE k = 1""")
def best_match_clusters(spark, d):
    v = vectors(spark, d)
    return tables.best_match(v.select("id", F.col("label").alias("x")), v.select("id", (F.col("id") % 7).alias("y")), "id", "x", "y")


METRICS = f"""WITH {WORKS_SQL}, m AS (SELECT topic AS config, round(avg(citation), 0) AS db, round(stddev_pop(citation), 1) AS silhouette, count(*) AS k FROM works GROUP BY topic)"""


def _metrics(spark, d):
    c = F.col("citation").cast("double")
    return works(spark, d).groupBy(F.col("topic").alias("config")).agg(F.round(F.avg(c), 0).alias("db"), F.round(F.stddev_pop(c), 1).alias("silhouette"), F.count("*").alias("k"))


@query(f"{METRICS} SELECT config, db, silhouette, k FROM m ORDER BY db, silhouette DESC, k, config LIMIT 1")
def best_configuration(spark, d):
    return tables.pick_best(_metrics(spark, d), [("db", True), ("silhouette", False), ("k", True), ("config", True)])


@query(f"""{METRICS}, r AS (SELECT config, rank() OVER (ORDER BY db) + (count(*) OVER (PARTITION BY db) - 1) / 2 AS rank_db, rank() OVER (ORDER BY silhouette DESC) + (count(*) OVER (PARTITION BY silhouette) - 1) / 2 AS rank_silhouette,
 CASE WHEN k % 200 < 20 THEN (20 - k % 200) / 20.0 WHEN k % 200 > 120 THEN (k % 200 - 120) / 120.0 ELSE 0 END AS penalty FROM m)
SELECT config, round(rank_db, 6) AS rank_db, round(rank_silhouette, 6) AS rank_silhouette, round(rank_db + rank_silhouette + penalty, 6) AS rank_sum, rank() OVER (ORDER BY rank_db + rank_silhouette + penalty) AS place FROM r""")
def configurations_ranked(spark, d):
    ranked = tables.rank_aggregate(_metrics(spark, d), [("db", True), ("silhouette", False)], tables.topic_count_penalty(F.col("k") % 200))
    return ranked.select("config", "rank_db", "rank_silhouette", "rank_sum", "place")


@query("""WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) > 4 AS late FROM documents) SELECT doc_id FROM r ORDER BY late, doc_id LIMIT 60""")
def capped_sample(spark, d):
    return tables.capped_sample(_docs(spark, d), ["lang", "source"], 4, 60, ["doc_id"]).select("doc_id")


@query("SELECT count(*) AS n_raw, count(*) FILTER (length(text) >= 20) AS n_kept, min(length(text)) FILTER (length(text) >= 20) AS shortest FROM (SELECT trim(coalesce(p_name, '')) || '. ' || trim(coalesce(p_type, '')) AS text FROM part)")
def text_length_stats(spark, d):
    t = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.trim(F.coalesce("p_name", F.lit(""))), F.lit(". "), F.trim(F.coalesce("p_type", F.lit("")))).alias("text"))
    long = F.length("text") >= 20
    return t.agg(F.count("*").alias("n_raw"), F.count_if(long).alias("n_kept"), F.min(F.when(long, F.length("text"))).alias("shortest"))


# ---------------------------------------------------------------- panels


@query(f"""WITH {WORKS_SQL}, n AS (SELECT topic, country, CAST(year AS BIGINT) AS year, count(*) AS n FROM works GROUP BY ALL) SELECT topic, country, year, n, round(n / sum(n) OVER (PARTITION BY country, year), 6) AS share FROM n""")
def yearly_country_share(spark, d):
    return panel.yearly_country_share(works(spark, d))


@query(f"{PANEL} SELECT topic, year, round(max(share), 6) AS frontier_value FROM panel GROUP BY ALL")
def frontier_max(spark, d):
    return panel.frontier_max(panel.catchup_panel(works(spark, d)))


@query(f"{PANEL} SELECT topic, year, round(share - frontier_value, 6) + 0.0 AS delta, abs(share - frontier_value + gap_to_frontier) <= 1e-9 AS consistent FROM panel WHERE country = 'ASIA'")
def frontier_consistency(spark, d):
    return panel.focal_against_frontier(panel.catchup_panel(works(spark, d)), "ASIA")


@query(f"""{ROLLED}, t AS (SELECT topic, avg(abs(delta)) AS m FROM rolled GROUP BY topic ORDER BY round(m, 12) DESC, topic LIMIT 3), l AS (SELECT * FROM rolled WHERE year = (SELECT max(year) FROM rolled))
SELECT round(avg(abs(delta)), 6) AS mean_gap, round(max(abs(delta)), 6) AS max_gap, (SELECT round(avg(m), 6) FROM t) AS top_mean, (SELECT round(avg(abs(delta)), 6) FROM l) AS latest_mean, (SELECT round(max(abs(delta)), 6) FROM l) AS latest_max FROM rolled""")
def gap_levels(spark, d):
    return panel.gap_levels(panel.rolling_topic_share(works(spark, d)))


def _suite(level: str) -> str:
    def of(sql: str) -> str:
        return sql.replace("p_brand AS topic, p_type AS parent", f"{level} AS topic, p_type AS parent")

    name = {"p_brand": "topic", "p_type": "parent"}[level]
    y, r = of(YEARLY), of(ROLLED)
    return f"""SELECT '{name}' AS level, 'annual' AS kind, topic, year, round(delta, 6) + 0.0 AS delta FROM ({y} SELECT * FROM yearly)
UNION ALL SELECT '{name}', 'rolling', topic, year, round(delta, 6) + 0.0 FROM ({r} SELECT * FROM rolled)
UNION ALL SELECT '{name}', 'cumulative', topic, year, round(sum(delta) OVER (PARTITION BY topic ORDER BY year ROWS UNBOUNDED PRECEDING), 6) + 0.0 FROM ({y} SELECT * FROM yearly)"""


@query(f"{_suite('p_brand')} UNION ALL {_suite('p_type')}")
def gap_suite(spark, d):
    return panel.gap_suite(works(spark, d), ["topic", "parent"]).withColumn("delta", F.round("delta", 6) + 0.0)


@query(f"""{ROLLED}, p AS (SELECT topic, year, delta, lag(delta) OVER (PARTITION BY topic ORDER BY year) AS prev FROM rolled)
SELECT topic, min(year) FILTER (prev < 0 AND delta >= 0 OR prev > 0 AND delta <= 0) AS cross_year FROM p GROUP BY topic""")
def crossing_either(spark, d):
    return trend.cross_year(panel.rolling_topic_share(works(spark, d)), either=True)


# ---------------------------------------------------------------- edges and graphs


@query(f"""{NB}, b AS (SELECT id FROM emb WHERE label < 5) SELECT i, j, sim FROM ed WHERE i IN (FROM b) AND j IN (FROM b)""")
def induced_edges(spark, d):
    v = vectors(spark, d)
    return edges.induced(knn.knn_edges(v, K), v.filter("label < 5"))


@query(f"""{NB}, {TRUTH}, a AS (SELECT i AS id FROM ed WHERE n = 2 UNION SELECT j FROM ed WHERE n = 2), b AS (SELECT i AS id FROM truth UNION SELECT j FROM truth)
SELECT id FROM ((FROM a INTERSECT FROM b) SEMI JOIN (SELECT id FROM emb WHERE country <> 'US') k USING (id))""")
def harmonized_nodes(spark, d):
    v = vectors(spark, d)
    return edges.harmonized_nodes(knn.knn_edges(v, K, mutual=True), _truth(spark, d), v.filter("country <> 'US'"))


@query(f"""{NB}, {TRUTH} SELECT coalesce(e.i, t.i) AS i, coalesce(e.j, t.j) AS j, e.i IS NOT NULL AS in_a FROM ed e FULL JOIN truth t ON e.i = t.i AND e.j = t.j WHERE e.i IS NULL OR t.i IS NULL""")
def edge_xor(spark, d):
    return edges.edge_xor(knn.knn_edges(vectors(spark, d), K), _truth(spark, d))


@query(f"""{NB} SELECT country, year, count(DISTINCT src) AS n_src, count(DISTINCT dst) AS n_dst, round(avg(sim), 6) AS mean_sim, round(median(sim), 6) AS median_sim FROM nb JOIN emb ON id = src GROUP BY country, year""")
def retrieval_summary(spark, d):
    v = vectors(spark, d)
    return edges.retrieval_summary(knn.neighbors(v.withColumn("batch", F.lit(0)), K), v, ["country", "year"])


@query(f"""{ORIENTED}, g AS (SELECT src, year_src - year_dst AS gap FROM ori), od AS (SELECT count(*) AS d FROM g GROUP BY src)
SELECT count(*) AS n_edges, round(quantile_cont(gap, 0.25), 6) AS gap_q25, round(quantile_cont(gap, 0.5), 6) AS gap_q50, round(quantile_cont(gap, 0.75), 6) AS gap_q75, round(avg(CASE WHEN gap = 0 THEN 1 ELSE 0 END), 6) AS same_year,
 (SELECT count(*) FROM od) AS n_src, (SELECT round(quantile_cont(d, 0.5), 6) FROM od) AS out_q50, (SELECT round(quantile_cont(d, 0.9), 6) FROM od) AS out_q90 FROM g""")
def direction_checks(spark, d):
    v = vectors(spark, d)
    return edges.direction_checks(edges.orient(knn.knn_edges(v, K), v))


@query(f"""{ORIENTED} SELECT id, count(src) AS out_degree FROM emb LEFT JOIN ori ON src = id GROUP BY id HAVING count(src) < 3""")
def below_out_degree(spark, d):
    v = vectors(spark, d)
    return edges.below_out_degree(edges.orient(knn.knn_edges(v, K), v), v, 3)


@query(f"""{NB}, e AS (SELECT CAST(i AS VARCHAR) AS src, CAST(j AS VARCHAR) AS dst, sim FROM ed WHERE i % 3 <> 0) SELECT src, dst, max(coalesce(CASE WHEN CAST(src AS BIGINT) % 2 = 0 THEN NULL ELSE sim END, 1.0)) AS sim FROM e GROUP BY ALL""")
def standard_edges(spark, d):
    e = knn.knn_edges(vectors(spark, d), K)
    raw = e.select(F.when(F.col("i") % 3 != 0, F.concat(F.lit("  "), F.col("i").cast("string"))).otherwise(" ").alias("Source"), F.col("j").alias("target"), F.when(F.col("i") % 2 != 0, F.col("sim")).alias("Weight"))
    raw = raw.unionByName(raw).unionByName(raw.withColumn("target", F.trim("Source").try_cast("long")))  # repeats and loops
    c = tables.infer_columns(raw.columns, {"src": ["src", "source"], "dst": ["dst", "target"], "sim": ["sim", "weight"]})
    return edges.standardize(raw.withColumnsRenamed({v: k for k, v in c.items()}))


DEGREES = f"{NODES}, dg AS (SELECT id, count(u) AS degree, coalesce(sum(u.sim), 0) AS strength FROM emb LEFT JOIN u ON u.u = id GROUP BY id)"


def _degrees(spark, d):
    v = vectors(spark, d)
    return graph.degree_strength(knn.knn_edges(v, K), v)


@query(f"""{DEGREES}, r AS (SELECT id, degree, round(strength, 6) AS strength FROM dg), k AS (SELECT *, rank() OVER (ORDER BY degree DESC) AS rank_degree, rank() OVER (ORDER BY strength DESC) AS rank_strength FROM r)
SELECT *, abs(rank_degree - rank_strength) AS shift FROM k""")
def centrality_comparison(spark, d):
    return graph.compare_centrality(_degrees(spark, d).withColumn("strength", F.round("strength", 6)), "degree", "strength").select("id", "degree", "strength", "rank_degree", "rank_strength", "shift")


@query(f"""{DEGREES}, t AS (SELECT id FROM dg ORDER BY round(degree + 0.5 * strength, 9) DESC, id LIMIT 100) SELECT i, j, sim FROM ed WHERE i IN (FROM t) AND j IN (FROM t)""")
def scored_subgraph(spark, d):
    return graph.select_subgraph(knn.knn_edges(vectors(spark, d), K), _degrees(spark, d), 100, "strength", "degree")


@query(f"""WITH {EMB}, l AS (SELECT CAST(label AS VARCHAR) AS value, count(*) AS n FROM emb GROUP BY 1 ORDER BY n DESC, value LIMIT 5) SELECT id, CASE WHEN CAST(label AS VARCHAR) IN (SELECT value FROM l) THEN CAST(label AS VARCHAR) ELSE 'other' END AS label FROM emb""")
def collapsed_labels(spark, d):
    return graph.collapsed(vectors(spark, d), "label", 5).select("id", "label")


@query(f"""WITH {EMB} SELECT l.label, count(id) AS n, {', '.join(f"round(coalesce(avg(CASE WHEN country = '{c}' THEN 1.0 WHEN id IS NOT NULL THEN 0.0 END), 0), 6) AS share_{c}" for c in ('CN', 'US', 'OTHER'))}
FROM (SELECT DISTINCT label FROM emb) l LEFT JOIN (SELECT * FROM emb WHERE year = 2003 AND id % 40 < 20) e ON e.label = l.label GROUP BY l.label""")
def subset_country_share(spark, d):
    v = vectors(spark, d)
    return graph.group_share(v, "year = 2003 and id % 40 < 20", v, "label")


@query(f"""{DEGREES}, q AS (SELECT quantile_cont(degree, 0.75) AS q FROM dg), n AS (SELECT emb.*, CASE WHEN degree >= q THEN 'core' ELSE 'rest' END AS layer FROM emb JOIN dg USING (id), q),
w AS (SELECT t_end, layer, label, count(*) FILTER (country = 'CN') AS n_CN, count(*) FILTER (country = 'US') AS n_US FROM n JOIN (SELECT DISTINCT year AS t_end FROM emb) ON year <= t_end AND year > t_end - 3 WHERE country IN ('CN', 'US') GROUP BY ALL)
SELECT t_end, layer, label, n_CN, n_US, round(coalesce(n_CN / nullif(sum(n_CN) OVER x, 0), 0) - coalesce(n_US / nullif(sum(n_US) OVER x, 0), 0), 6) + 0.0 AS gap FROM w WINDOW x AS (PARTITION BY t_end, layer)""")
def layer_composition(spark, d):
    dg = _degrees(spark, d)
    q = dg.agg(F.percentile("degree", 0.75).alias("q"))
    n = vectors(spark, d).join(dg.crossJoin(q), "id").withColumn("layer", F.when(F.col("degree") >= F.col("q"), "core").otherwise("rest"))
    return graph.layer_composition(n, 3).withColumn("gap", F.round("gap", 6) + 0.0)


@query(f"""WITH {EMB} SELECT id, row_number() OVER (ORDER BY label, country, id) - 1 AS place FROM emb""")
def node_order(spark, d):
    return tables.numbered(vectors(spark, d), F.col("label"), ["country", "id"], "place").select("id", "place")


# ---------------------------------------------------------------- soft topics and text


@query(f"""{MEM}, n AS (SELECT topic, CAST(year AS BIGINT) AS year, coalesce(sum(weight) FILTER (country = 'CN'), 0) AS weight_CN, coalesce(sum(weight) FILTER (country = 'US'), 0) AS weight_US FROM mem WHERE country IN ('CN', 'US') GROUP BY ALL),
s AS (SELECT *, coalesce(weight_CN / nullif(sum(weight_CN) OVER y, 0), 0) - coalesce(weight_US / nullif(sum(weight_US) OVER y, 0), 0) AS delta FROM n WINDOW y AS (PARTITION BY year)),
r AS (SELECT topic, year, sum(weight_CN) OVER w AS c, sum(weight_US) OVER w AS u, row_number() OVER (PARTITION BY topic ORDER BY year) AS pos FROM s WINDOW w AS (PARTITION BY topic ORDER BY year ROWS 2 PRECEDING)),
k AS (SELECT topic, year, coalesce(c / nullif(sum(c) OVER y, 0), 0) - coalesce(u / nullif(sum(u) OVER y, 0), 0) AS roll_delta FROM r WHERE pos >= 2 WINDOW y AS (PARTITION BY year)), kept AS (SELECT topic, year, delta FROM s JOIN (SELECT topic, year FROM r WHERE pos >= 2) USING (topic, year))
SELECT topic, year, round(roll_delta, 6) + 0.0 AS roll_delta, round(sum(delta) OVER (PARTITION BY topic ORDER BY year ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS cum_delta FROM k JOIN kept USING (topic, year)""")
def fuzzy_rolling(spark, d):
    return topics.fuzzy_rolling(topics.fuzzy_share(_membership(spark, d))).select("topic", "year", *[(F.round(c, 6) + 0.0).alias(c) for c in ("roll_delta", "cum_delta")])


BOUNDARY = f"""{MEM}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(weight, 12) DESC, topic) AS k FROM mem),
b AS (SELECT id, country, CAST(year AS BIGINT) AS year, -sum(weight * ln(weight)) / ln(count(*)) AS entropy, max(weight) FILTER (k = 1) - max(weight) FILTER (k = 2) AS top_gap, 1 / sum(weight * weight) AS effective_topics FROM r GROUP BY ALL)"""


@query(f"""{BOUNDARY} SELECT mem.topic, {', '.join(f"round(sum(weight * {c}) FILTER (mem.country = 'CN') / sum(weight) FILTER (mem.country = 'CN') - sum(weight * {c}) FILTER (mem.country = 'US') / sum(weight) FILTER (mem.country = 'US'), 6) + 0.0 AS {c}_gap" for c in ('entropy', 'top_gap', 'effective_topics'))}
FROM mem JOIN b USING (id) GROUP BY mem.topic""")
def country_boundary_gap(spark, d):
    return topics.country_boundary_gap(_membership(spark, d)).select("topic", *[(F.round(c, 6) + 0.0).alias(c) for c in ("entropy_gap", "top_gap_gap", "effective_topics_gap")])


@query(f"{BOUNDARY} SELECT country, year, {', '.join(f'round(avg({c}), 6) AS {c}' for c in ('entropy', 'effective_topics', 'top_gap'))} FROM b GROUP BY country, year")
def country_year_boundary(spark, d):
    return topics.country_year_boundary(_membership(spark, d))


@query(f"""{MEM}, p AS (SELECT id, weight AS u FROM mem WHERE topic = 0), c AS (SELECT topic, sum(u * weight) FILTER (country = 'CN') / sum(u) FILTER (country = 'CN') AS a, sum(u * weight) FILTER (country = 'US') / sum(u) FILTER (country = 'US') AS b FROM mem JOIN p USING (id) GROUP BY topic)
SELECT round((sum(a * log2(a / ((a + b) / 2))) + sum(b * log2(b / ((a + b) / 2)))) / 2, 6) AS js, round(sum(abs(a - b)), 6) AS l1, round(1 - sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 6) AS cosine_distance FROM c""")
def soft_composition_gap(spark, d):
    return topics.composition_distance(topics.soft_composition(_membership(spark, d), 0))


@query(f"""{MEM}, x AS (SELECT m.topic, t.p, sum(m.weight * m.weight * e[t.p]) / sum(m.weight * m.weight) AS x FROM mem m JOIN emb ON emb.id = m.id, range(1, 65) t(p) GROUP BY ALL), c2 AS (SELECT topic, list(x ORDER BY p) AS c FROM x GROUP BY topic),
w2 AS (SELECT id, 1 / greatest(list_distance(e, c) ** 2, 1e-12) AS w FROM emb, c2), m2 AS (SELECT id, w / sum(w) OVER (PARTITION BY id) AS weight FROM w2) SELECT round(avg(s), 6) AS fpc FROM (SELECT sum(weight * weight) AS s FROM m2 GROUP BY id)""")
def fuzzy_cmeans_fpc(spark, d):
    v = vectors(spark, d)
    return topics.partition_coefficient(topics.fuzzy_cmeans(v, knn.centroids(v), 1)[0])


STOP = ("the", "and", "of", "to", "de", "la", "der", "die", "und")


@query(f"""WITH w AS (SELECT doc_id, lang AS topic, list_filter(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' '), lambda w: length(w) >= 2 AND w NOT IN {STOP}) AS w FROM documents WHERE text IS NOT NULL),
t AS (SELECT topic, unnest(w) AS term FROM w UNION ALL SELECT topic, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w), n AS (SELECT topic, term, count(*) AS n FROM t GROUP BY ALL),
top AS (SELECT term FROM n GROUP BY term ORDER BY sum(n) DESC, term LIMIT 500) SELECT topic, term, n FROM n SEMI JOIN top USING (term)""")
def frequent_ngrams(spark, d):
    return topics.ngrams(_docs(spark, d), "lang", stop=STOP, most=500)


@query(f"""{MEM}, t AS (SELECT doc_id AS id, term, count(*) AS n FROM (SELECT doc_id, unnest(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' ')) AS term FROM documents) WHERE length(term) >= 2 GROUP BY ALL)
SELECT topic, term, round(sum(weight * n), 6) AS weight FROM t JOIN mem USING (id) GROUP BY ALL HAVING sum(n) >= 200""")
def weighted_topic_terms(spark, d):
    t = topics.tokens(_docs(spark, d), "doc_id").groupBy(F.col("topic").alias("id"), "term").agg(F.count("*").alias("n"))
    m = _membership(spark, d)
    often = t.join(m.select("id").distinct(), "id", "left_semi").groupBy("term").agg(F.sum("n").alias("s")).filter("s >= 200")
    return topics.weighted_terms(t.join(often.select("term"), "term"), m)


@query(f"""{YEARLY}, u AS (SELECT round(avg(abs(delta)), 6) AS mean_gap, round(max(abs(delta)), 6) AS max_gap FROM yearly),
tc AS (SELECT topic, count(*) FILTER (c2 = 'CN') AS a, count(*) FILTER (c2 = 'US') AS b FROM works GROUP BY topic), p AS (SELECT a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM tc)
SELECT mean_gap, max_gap, (SELECT count(*) FILTER (a > 0) FROM tc) AS topics_CN, (SELECT count(*) FILTER (b > 0) FROM tc) AS topics_US, (SELECT round(sum(abs(p - q)), 6) FROM p) AS l1 FROM u""")
def gap_record(spark, d):
    w = works(spark, d)
    n = panel.focal_counts(w, ["topic"]).agg(F.count_if(F.col("count_CN") > 0).alias("topics_CN"), F.count_if(F.col("count_US") > 0).alias("topics_US"), F.sum("count_CN").alias("a"), F.sum("count_US").alias("b"))
    l1 = panel.focal_counts(w, ["topic"]).crossJoin(n.select("a", "b")).agg(F.sum(F.abs(ratio("count_CN", "a") - ratio("count_US", "b"))).alias("l1"))
    y = panel.yearly_topic_share(w).agg(F.avg(F.abs("delta")).alias("mean_gap"), F.max(F.abs("delta")).alias("max_gap"))
    return y.crossJoin(n.select("topics_CN", "topics_US")).crossJoin(l1)  # one row each


WCSS = " UNION ALL ".join(f"SELECT {k} AS k, (SELECT round(sum(list_distance(e, c) ** 2), 6) FROM (SELECT id % {k} AS g, id, e FROM emb) a JOIN (SELECT g, list(x ORDER BY p) AS c FROM (SELECT id % {k} AS g, p, avg(e[p]) AS x FROM emb, range(1, 65) t(p) GROUP BY ALL) GROUP BY g) b USING (g)) AS wcss" for k in (2, 4, 8))


@query(f"WITH {EMB} {WCSS}")
def wcss_sweep(spark, d):
    v, out = vectors(spark, d), None
    for k in (2, 4, 8):
        one = trajectory.wcss(v.withColumn("label", F.col("id") % k)).agg(F.sum("wcss").alias("wcss")).select(F.lit(k).alias("k"), "wcss")
        out = one if out is None else out.unionByName(one)
    return out
