"""The library's queries over the driver's tables, and the SQL that they equal.

Iterative operators and models (k-core, k-means, PCA, DTW, clustering, link model, bootstrap, label propagation, LOF) have no SQL
here; their tests hold them against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.functions.columns import r6
from loomwork.functions.storage import cut
from loomwork.operators import divergence, edges, graph, impact, knn, panel, resample, topics, trajectory, trend
from loomwork.sources.papers import WORKS_SQL, clean_papers, country_contains, country_exact, country_folded, country_three, works

K = 5
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name; its float columns are rounded to 6 digits."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[r6(c).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "decimal(38,0)") else F.col(c) for c, t in df.dtypes])

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return run

    return add


def _r(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in cols)  # + 0.0: no negative zero


# ---------------------------------------------------------------- panels

COUNTS = f"""WITH {WORKS_SQL},
n AS (SELECT topic, CAST(year AS BIGINT) AS year, count(*) FILTER (c2 = 'CN') AS count_CN, count(*) FILTER (c2 = 'US') AS count_US FROM works GROUP BY ALL)"""
YEARLY = f"""{COUNTS},
y AS (SELECT *, coalesce(count_CN / nullif(sum(count_CN) OVER w, 0), 0) AS share_CN, coalesce(count_US / nullif(sum(count_US) OVER w, 0), 0) AS share_US
 FROM n WHERE count_CN + count_US > 0 WINDOW w AS (PARTITION BY year)),
yearly AS (SELECT *, share_CN - share_US AS delta FROM y)"""
ROLLED = f"""{COUNTS},
g AS (SELECT topic, year, coalesce(count_CN, 0) AS count_CN, coalesce(count_US, 0) AS count_US
 FROM (SELECT DISTINCT topic FROM n) CROSS JOIN (SELECT DISTINCT year FROM n) LEFT JOIN n USING (topic, year)),
r AS (SELECT topic, year, sum(count_CN) OVER w AS roll_count_CN, sum(count_US) OVER w AS roll_count_US, row_number() OVER (PARTITION BY topic ORDER BY year) AS pos
 FROM g WINDOW w AS (PARTITION BY topic ORDER BY year ROWS 4 PRECEDING)),
s AS (SELECT topic, year, CAST(roll_count_CN AS BIGINT) AS roll_count_CN, CAST(roll_count_US AS BIGINT) AS roll_count_US,
 coalesce(roll_count_CN / nullif(sum(roll_count_CN) OVER (PARTITION BY year), 0), 0) AS share_CN,
 coalesce(roll_count_US / nullif(sum(roll_count_US) OVER (PARTITION BY year), 0), 0) AS share_US FROM r WHERE pos >= 3),
rolled AS (SELECT *, share_CN - share_US AS delta FROM s)"""
GRID = f"""WITH {WORKS_SQL},
c AS (SELECT topic, country, CAST(year AS BIGINT) AS year, count(*) AS n FROM works GROUP BY ALL),
years AS (SELECT unnest(range(min(year), max(year) + 1)) AS year FROM c),
g AS (SELECT topic, country, year, coalesce(n, 0) AS n FROM (SELECT DISTINCT topic FROM c) CROSS JOIN (SELECT DISTINCT country FROM c) CROSS JOIN years LEFT JOIN c USING (topic, country, year))"""
CSHARE = f"""{GRID},
r AS (SELECT *, CAST(sum(n) OVER (PARTITION BY topic, country ORDER BY year ROWS 4 PRECEDING) AS BIGINT) AS roll_count, row_number() OVER (PARTITION BY topic, country ORDER BY year) AS pos FROM g),
cs AS (SELECT topic, country, year, n, roll_count, coalesce(roll_count / nullif(sum(roll_count) OVER (PARTITION BY country, year), 0), 0) AS share FROM r WHERE pos >= 3)"""
PANEL = f"""{GRID},
p1 AS (SELECT topic, country, year, n AS count, coalesce(n / nullif(sum(n) OVER (PARTITION BY topic, year), 0), 0) AS share FROM g),
p2 AS (SELECT *, rank() OVER (PARTITION BY topic, year ORDER BY share DESC) AS rank, row_number() OVER (PARTITION BY topic, year ORDER BY share DESC, country) AS place FROM p1),
p3 AS (SELECT *, coalesce(avg(CASE WHEN place <= 3 AND share > 0 THEN share END) OVER (PARTITION BY topic, year), 0) AS frontier_value FROM p2),
panel AS (SELECT topic, country, year, count, share, rank, frontier_value, coalesce(share / nullif(frontier_value, 0), 0) AS ratio_to_frontier, frontier_value - share AS gap_to_frontier FROM p3)"""


@query(f"""WITH {WORKS_SQL}, n AS (SELECT topic, count(*) FILTER (c2 = 'CN') AS count_CN, count(*) FILTER (c2 = 'US') AS count_US, count(*) AS count_all FROM works GROUP BY topic)
SELECT topic, count_CN, count_US, count_all, round(count_CN / nullif(count_CN + count_US, 0), 6) AS row_share_CN, round(count_US / nullif(count_CN + count_US, 0), 6) AS row_share_US,
 round(2 * (count_CN / nullif(count_CN + count_US, 0)) - 1, 6) AS dominance, round(count_CN / nullif(sum(count_CN) OVER (), 0), 6) AS col_share_CN, round(count_US / nullif(sum(count_US) OVER (), 0), 6) AS col_share_US FROM n""")
def topic_country_matrix(spark, d):
    return panel.topic_country_matrix(works(spark, d))


@query(f"""WITH {WORKS_SQL}, h AS (SELECT topic, bool_or(c2 = 'CN') AS cn, bool_or(c2 = 'US') AS us FROM works WHERE c2 IN ('CN', 'US') GROUP BY topic)
SELECT count(*) FILTER (cn) AS topics_CN, count(*) FILTER (us) AS topics_US, count(*) AS topics_union, count(*) FILTER (NOT us) AS only_CN, count(*) FILTER (NOT cn) AS only_US FROM h""")
def topic_coverage(spark, d):
    return panel.topic_coverage(works(spark, d))


@query(f"{YEARLY} SELECT topic, year, count_CN, count_US, {_r('share_CN', 'share_US', 'delta')} FROM yearly")
def yearly_topic_share(spark, d):
    return panel.yearly_topic_share(works(spark, d))


@query(f"{ROLLED} SELECT topic, year, roll_count_CN, roll_count_US, {_r('share_CN', 'share_US', 'delta')} FROM rolled")
def rolling_topic_share(spark, d):
    return panel.rolling_topic_share(works(spark, d))


@query(f"{CSHARE} SELECT topic, country, year, n, roll_count, {_r('share')} FROM cs")
def rolling_country_share(spark, d):
    return panel.rolling_country_share(works(spark, d))


@query(f"{PANEL} SELECT topic, country, year, count, rank, {_r('share', 'frontier_value', 'ratio_to_frontier', 'gap_to_frontier')} FROM panel")
def catchup_panel(spark, d):
    return panel.catchup_panel(works(spark, d))


@query(f"""WITH {WORKS_SQL}, n AS (SELECT nation AS country, count(*) AS total_count FROM works GROUP BY nation), t AS (SELECT quantile_cont(total_count, 0.4) AS v FROM n)
SELECT country, total_count, round(v, 6) AS threshold_value, total_count >= v AS keep_flag FROM n, t""")
def country_filter_report(spark, d):
    return panel.country_filter_report(works(spark, d))


UNITS = f"""{PANEL},
a AS (SELECT *, count(*) FILTER (count > 0) OVER (PARTITION BY country, topic) AS active, max(share) OVER (PARTITION BY country, topic) AS peak FROM panel),
units AS (SELECT country, topic, year, CASE WHEN row_number() OVER (PARTITION BY country, topic ORDER BY year) >= 2
 THEN avg(ratio_to_frontier) OVER (PARTITION BY country, topic ORDER BY year ROWS 2 PRECEDING) ELSE 0 END AS value FROM a WHERE active >= 10 AND peak >= 0.2)"""


@query(f"{UNITS} SELECT country, topic, year, {_r('value')} FROM units")
def trajectory_units(spark, d):
    return panel.trajectory_units(panel.catchup_panel(works(spark, d)))


@query(f"""{CSHARE}, k AS (SELECT *, row_number() OVER (PARTITION BY topic, year ORDER BY share DESC, country) AS place FROM cs),
o AS (SELECT topic, year, coalesce(max(share) FILTER (country = 'ASIA'), 0) AS share_focal, coalesce(avg(share) FILTER (place <= 3 AND share > 0), 0) AS frontier_share,
 max(country) FILTER (place = 1 AND share > 0) AS frontier_country_1, max(country) FILTER (place = 2 AND share > 0) AS frontier_country_2 FROM k GROUP BY topic, year)
SELECT topic, year, {_r('share_focal', 'frontier_share')}, frontier_country_1, frontier_country_2, round(share_focal - frontier_share, 6) AS delta FROM o""")
def frontier_delta(spark, d):
    return panel.frontier_delta(panel.rolling_country_share(works(spark, d)), "ASIA")


@query(f"""{PANEL}, l AS (SELECT country, topic, year, ln(greatest(share, 1e-6)) AS ls, ln(greatest(frontier_value, 1e-6)) AS lf FROM panel),
dd AS (SELECT country, topic, year, greatest(-5, least(5, ls - lag(ls) OVER w)) AS ds, greatest(-5, least(5, lf - lag(lf) OVER w)) AS df, lag(ls) OVER w AS has FROM l WINDOW w AS (PARTITION BY country, topic ORDER BY year)),
e AS (SELECT country, topic, row_number() OVER (PARTITION BY country, topic ORDER BY year) AS pos, avg(ds) OVER w AS ds, avg(df) OVER w AS df FROM dd WHERE has IS NOT NULL WINDOW w AS (PARTITION BY country, topic ORDER BY year ROWS 2 PRECEDING)),
o AS (SELECT country, topic, round(avg(ds) FILTER (pos >= 2), 6) AS dlog_share, round(avg(df) FILTER (pos >= 2), 6) AS dlog_frontier FROM e GROUP BY country, topic)
SELECT *, CASE WHEN dlog_share >= 0 AND dlog_frontier >= 0 THEN 'both_up' WHEN dlog_share >= 0 THEN 'share_up' WHEN dlog_frontier >= 0 THEN 'frontier_up' ELSE 'both_down' END AS quadrant FROM o""")
def log_decomposition_quadrant(spark, d):
    return panel.log_decomposition(panel.catchup_panel(works(spark, d)))


@query(f"{YEARLY} SELECT topic, year, round(delta, 6) AS delta, round(sum(delta) OVER (PARTITION BY topic ORDER BY year ROWS UNBOUNDED PRECEDING), 6) AS cum_delta FROM yearly")
def cumulative_gap(spark, d):
    return panel.cumulative_gap(panel.yearly_topic_share(works(spark, d))).select("topic", "year", "delta", "cum_delta")


@query(f"{ROLLED} SELECT topic, year, round(delta, 6) AS delta FROM rolled WHERE year = (SELECT max(year) FROM rolled) ORDER BY abs(round(delta, 9)) DESC, topic LIMIT 10")
def latest_gap_top(spark, d):
    return panel.latest_top(panel.rolling_topic_share(works(spark, d)), "delta").select("topic", "year", "delta")


# ---------------------------------------------------------------- impact

NORMED = f"""WITH {WORKS_SQL}, b AS (SELECT topic, year, avg(citation) AS expected_mean, median(citation) AS expected_median, count(*) AS bucket_size, quantile_cont(citation, 0.9) AS qq FROM works GROUP BY topic, year),
f AS (SELECT works.*, expected_mean, expected_median, bucket_size, (citation + 1) / (expected_mean + 1) AS nc, CASE WHEN bucket_size >= 20 THEN qq END AS q90, coalesce(citation >= CASE WHEN bucket_size >= 20 THEN qq END, FALSE) AS top10_flag FROM works JOIN b USING (topic, year))"""


@query(f"{NORMED} SELECT topic, CAST(year AS BIGINT) AS year, c2, citation, {_r('nc', 'expected_mean', 'expected_median')}, bucket_size FROM f")
def normalized_citations(spark, d):
    return impact.normalized_citations(works(spark, d)).select("topic", "year", "c2", "citation", "nc", "expected_mean", "expected_median", "bucket_size")


@query(f"{NORMED} SELECT topic, CAST(year AS BIGINT) AS year, c2, citation, round(q90, 6) AS q90, top10_flag, bucket_size FROM f")
def top10_flag(spark, d):
    return impact.top_flag(works(spark, d)).select("topic", "year", "c2", "citation", "q90", "top10_flag", "bucket_size")


@query(f"""{NORMED}, m AS (SELECT max(year) AS last FROM f), x AS (SELECT topic, c2, top10_flag AND year <= last - 1 AS a, top10_flag AND year BETWEEN last - 5 AND last - 1 AS b FROM f, m)
SELECT topic, c2, CASE WHEN a AND b THEN 'A_and_B' WHEN a THEN 'A_only' WHEN b THEN 'B_only' END AS frontier_type, count(*) AS n FROM x GROUP BY ALL""")
def frontier_sets(spark, d):
    return impact.frontier_sets(impact.top_flag(works(spark, d))).groupBy("topic", "c2", "frontier_type").agg(F.count("*").alias("n"))


GAP = f"""{NORMED}, g1 AS (SELECT topic, avg(nc) FILTER (c2 = 'CN') AS mncs_CN, avg(nc) FILTER (c2 = 'US') AS mncs_US,
 avg(top10_flag::INT) FILTER (c2 = 'CN' AND q90 IS NOT NULL) AS pp10_CN, avg(top10_flag::INT) FILTER (c2 = 'US' AND q90 IS NOT NULL) AS pp10_US FROM f GROUP BY topic),
gap AS (SELECT *, mncs_US - mncs_CN AS mncs_gap, pp10_US - pp10_CN AS pp10_gap FROM g1)"""


def _flagged(spark, d) -> DataFrame:
    return impact.top_flag(impact.normalized_citations(works(spark, d)).drop("bucket_size"))


@query(f"{GAP} SELECT topic, {_r('mncs_CN', 'mncs_US', 'pp10_CN', 'pp10_US', 'mncs_gap', 'pp10_gap')} FROM gap")
def impact_gap(spark, d):
    return impact.impact_gap(_flagged(spark, d))


@query(f"""{GAP}, dm AS (SELECT topic, round(2 * (count(*) FILTER (c2 = 'CN') / nullif(count(*) FILTER (c2 IN ('CN', 'US')), 0)) - 1, 6) AS dom FROM works GROUP BY topic),
q AS (SELECT CASE WHEN dom >= 0 AND round(mncs_gap, 6) <= 0 THEN 'more_better' WHEN dom >= 0 THEN 'more_weaker' WHEN round(mncs_gap, 6) <= 0 THEN 'fewer_better' ELSE 'fewer_weaker' END AS quadrant FROM gap JOIN dm USING (topic))
SELECT quadrant, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM q GROUP BY quadrant""")
def quality_quadrant(spark, d):
    return impact.quality_quadrant(impact.impact_gap(_flagged(spark, d)), panel.topic_country_matrix(works(spark, d)))


# ---------------------------------------------------------------- divergence and agreement

JS = """p AS (SELECT a / nullif(sum(a) OVER (), 0) AS p, b / nullif(sum(b) OVER (), 0) AS q FROM c),
t AS (SELECT sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2 AS v FROM p)
SELECT round(greatest(v, 0), 6) AS js_divergence, round(sqrt(greatest(v, 0)), 6) AS js_distance FROM t"""


@query(f"WITH {WORKS_SQL}, c AS (SELECT topic, count(*) FILTER (c2 = 'CN') AS a, count(*) FILTER (c2 = 'US') AS b FROM works GROUP BY topic), {JS}")
def js_divergence(spark, d):
    return divergence.js_distance(panel.focal_counts(works(spark, d), ["topic"]), "count_CN", "count_US")


@query(f"{NORMED}, c AS (SELECT topic, count(*) FILTER (c2 = 'CN') AS a, count(*) FILTER (c2 = 'US') AS b FROM f WHERE top10_flag GROUP BY topic), {JS}")
def frontier_js(spark, d):
    return divergence.js_distance(panel.focal_counts(_flagged(spark, d).filter("top10_flag"), ["topic"]), "count_CN", "count_US")


@query(f"""WITH {WORKS_SQL}, n AS (SELECT parent, topic, count(*) FILTER (c2 = 'CN') AS a, count(*) FILTER (c2 = 'US') AS b FROM works GROUP BY parent, topic),
s AS (SELECT parent, topic, coalesce(a / nullif(sum(a) OVER w, 0), 0) + 1e-12 AS a, coalesce(b / nullif(sum(b) OVER w, 0), 0) + 1e-12 AS b FROM n WINDOW w AS (PARTITION BY parent)),
z AS (SELECT parent, topic, a / sum(a) OVER w AS p, b / sum(b) OVER w AS q FROM s WINDOW w AS (PARTITION BY parent)),
k AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY round(abs(p - q), 12) DESC, topic) AS place FROM z)
SELECT parent, round(sqrt(greatest(sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2 / ln(2), 0)), 6) AS js2, round(sum(abs(p - q)), 6) AS l1,
 round(1 - sum(p * q) / sqrt(sum(p * p) * sum(q * q)), 6) AS cosine_distance, round(avg(abs(p - q)) FILTER (place <= 3), 6) AS top3_gap FROM k GROUP BY parent""")
def parent_structure(spark, d):
    return divergence.parent_structure(works(spark, d))


EMB = """emb AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label, 2000 + vec_id % 12 AS year, CASE vec_id % 3 WHEN 0 THEN 'CN' WHEN 1 THEN 'US' ELSE 'OTHER' END AS country FROM embeddings)"""


def vectors(spark, d) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    country = F.when(F.col("vec_id") % 3 == 0, "CN").when(F.col("vec_id") % 3 == 1, "US").otherwise("OTHER")
    return e.select(F.col("vec_id").alias("id"), "embedding", "label", (2000 + F.col("vec_id") % 12).cast("int").alias("year"), country.alias("country"))


@query(f"""WITH {EMB}, c AS (SELECT label AS a, id % 7 AS b, count(*) AS n FROM emb GROUP BY ALL), t AS (SELECT sum(n) AS t FROM c),
ra AS (SELECT a, sum(n) AS na FROM c GROUP BY a), rb AS (SELECT b, sum(n) AS nb FROM c GROUP BY b),
m AS (SELECT sum(n / t * ln(n * t / (na * nb))) AS mi, sum(n * (n - 1) / 2) AS sij FROM c JOIN ra USING (a) JOIN rb USING (b), t),
ha AS (SELECT -sum(na / t * ln(na / t)) AS ha, sum(na * (na - 1) / 2) AS si FROM ra, t), hb AS (SELECT -sum(nb / t * ln(nb / t)) AS hb, sum(nb * (nb - 1) / 2) AS sj FROM rb, t)
SELECT round(mi / ((ha + hb) / 2), 6) AS nmi, round((sij - si * sj / (t * (t - 1) / 2)) / ((si + sj) / 2 - si * sj / (t * (t - 1) / 2)), 6) AS ari FROM m, ha, hb, t""")
def cluster_agreement(spark, d):
    return divergence.agreement(divergence.contingency(vectors(spark, d).withColumn("other", F.col("id") % 7), "label", "other"))


@query(f"""WITH {WORKS_SQL}, n AS (SELECT topic, count(*) AS n FROM works GROUP BY topic), p AS (SELECT n, n / sum(n) OVER () AS p FROM n)
SELECT count(*) AS n_topics, min(n) AS min_size, round(median(n), 6) AS median_size, max(n) AS max_size, round(max(p), 6) AS max_share, round(stddev_pop(n) / (avg(n) + 1e-12), 6) AS cv, round(-sum(p * ln(p + 1e-15)), 6) AS entropy FROM p""")
def size_stats_entropy(spark, d):
    return divergence.size_stats(works(spark, d))


OVERLAP = f"""WITH {WORKS_SQL}, n AS (SELECT c2, year, topic, count(*) AS n FROM works WHERE c2 IN ('CN', 'US') GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY c2, year) AS total FROM n),
s AS (SELECT c2, CAST(year AS BIGINT) AS year, topic, avg(n / total) OVER (PARTITION BY c2, topic ORDER BY year ROWS 2 PRECEDING) AS share FROM t WHERE total >= 5),
l AS (SELECT unnest(range(0, 7)) AS lag),
c AS (SELECT year, lag, topic, share AS s FROM s, l WHERE c2 = 'CN'), u AS (SELECT year - lag AS year, lag, topic, share AS t FROM s, l WHERE c2 = 'US'),
j AS (SELECT year, lag, topic, coalesce(s, 0) AS s, coalesce(t, 0) AS t FROM c FULL JOIN u USING (year, lag, topic)),
k AS (SELECT *, max(s) OVER w AS hs, max(t) OVER w AS ht FROM j WINDOW w AS (PARTITION BY year, lag)),
o AS (SELECT year, lag, sum(least(s, t)) / nullif(sum(greatest(s, t)), 0) AS weighted_jaccard, count(*) FILTER (s >= 0.01 AND t >= 0.01) / nullif(count(*) FILTER (s >= 0.01 OR t >= 0.01), 0) AS binary_jaccard,
 sum(s * t) / nullif(sqrt(sum(s * s) * sum(t * t)), 0) AS cosine FROM k WHERE hs > 0 AND ht > 0 AND greatest(s, t) >= 0.01 GROUP BY year, lag),
curves AS (SELECT year, lag, 'weighted_jaccard' AS metric, weighted_jaccard AS value FROM o UNION ALL SELECT year, lag, 'binary_jaccard', binary_jaccard FROM o UNION ALL SELECT year, lag, 'cosine', cosine FROM o)"""


@query(f"{OVERLAP} SELECT year, lag, metric, round(value, 6) AS value FROM curves")
def overlap_leadlag(spark, d):
    return divergence.overlap_leadlag(divergence.group_year_shares(works(spark, d)))


@query(f"{OVERLAP} SELECT year, lag, metric, round(value, 6) AS value FROM curves WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY metric, year ORDER BY round(value, 9) DESC, lag) = 1")
def best_lag(spark, d):
    return divergence.best_lag(divergence.overlap_leadlag(divergence.group_year_shares(works(spark, d))))


# ---------------------------------------------------------------- trends

TREND = f"""{ROLLED}, sl AS (SELECT a.topic, median((b.delta - a.delta) / (b.year - a.year)) AS slope_delta FROM rolled a JOIN rolled b ON a.topic = b.topic AND a.year < b.year GROUP BY a.topic),
cr AS (SELECT topic, min(year) FILTER (prev < 0 AND delta >= 0) AS cross_year FROM (SELECT *, lag(delta) OVER (PARTITION BY topic ORDER BY year) AS prev FROM rolled) GROUP BY topic),
en AS (SELECT topic, min_by(delta, year) AS delta_start, max_by(delta, year) AS delta_end, count(*) AS n_years FROM rolled GROUP BY topic),
tr AS (SELECT * FROM en LEFT JOIN sl USING (topic) JOIN cr USING (topic))"""


@query(f"""{TREND} SELECT topic, n_years, cross_year, {_r('slope_delta', 'delta_start', 'delta_end')}, CASE WHEN n_years < 6 THEN 'insufficient' WHEN slope_delta > 1e-4 AND delta_end > delta_start + 1e-4 THEN 'catching_up'
 WHEN slope_delta < -1e-4 THEN 'pulling_away' ELSE 'stable' END AS trend_label FROM tr""")
def trend_summary(spark, d):
    return trend.trend_summary(panel.rolling_topic_share(works(spark, d)))


@query(f"""{TREND} SELECT topic, CASE WHEN n_years < 6 THEN 'insufficient' WHEN slope_delta > 1e-4 AND delta_end > delta_start + 1e-4 THEN 'catching_up'
 WHEN slope_delta < -1e-4 AND delta_end < delta_start - 1e-4 THEN 'pulling_away' ELSE 'stable' END AS trend_label FROM tr""")
def gap_trends(spark, d):
    return trend.trend_summary(panel.rolling_topic_share(works(spark, d)), both=True).select("topic", "trend_label")


@query(f"""{ROLLED}, o AS (SELECT topic, regr_slope(delta, year) AS slope, regr_r2(delta, year) AS r2, count(*) AS n FROM rolled GROUP BY topic)
SELECT topic, {_r('slope', 'r2')}, n, CASE WHEN slope > 1e-4 THEN 'catching_up' WHEN slope < -1e-4 THEN 'lagging' ELSE 'flat' END AS label FROM o""")
def ols_trend(spark, d):
    return trend.ols_trend(panel.rolling_topic_share(works(spark, d)))


ENTRY = f"""{ROLLED}, ser AS (SELECT topic, year, 'CN' AS c2, share_CN AS share FROM rolled UNION ALL SELECT topic, year, 'US', share_US FROM rolled),
e1 AS (SELECT *, row_number() OVER (PARTITION BY topic, c2 ORDER BY year) - 1 AS i, count(*) OVER (PARTITION BY topic, c2) AS n FROM ser),
e2 AS (SELECT *, least(5, greatest(3, n // 3)) AS b FROM e1),
e3 AS (SELECT *, avg(CASE WHEN i < b THEN share END) OVER w AS mu, stddev_pop(CASE WHEN i < b THEN share END) OVER w AS sd, coalesce(lead(share, 2) OVER o, lead(share, 1) OVER o, share) AS ahead FROM e2
 WINDOW w AS (PARTITION BY topic, c2), o AS (PARTITION BY topic, c2 ORDER BY year)),
e4 AS (SELECT *, i >= b AND round(share - mu - CASE WHEN round(sd, 12) = 0 THEN 1e-8 ELSE sd END, 12) > 0 AND round(ahead - share, 12) >= 0 AS hit FROM e3),
e5 AS (SELECT topic, c2, max(n) AS n, min(year) FILTER (hit) AS y FROM e4 GROUP BY topic, c2),
ent AS (SELECT topic, c2, n, CASE WHEN n >= 5 THEN y END AS enter_year, CASE WHEN n < 5 THEN 'insufficient' WHEN y IS NULL THEN 'not_entered' ELSE 'entered' END AS flag FROM e5)"""


def _entries(spark, d) -> DataFrame:
    r = panel.rolling_topic_share(works(spark, d))
    return trend.entry_year(r.select("topic", "year", F.explode(F.create_map(F.lit("CN"), F.col("share_CN"), F.lit("US"), F.col("share_US"))).alias("c2", "share")))


@query(f"{ENTRY} SELECT * FROM ent")
def entry_year(spark, d):
    return _entries(spark, d)


@query(f"""{ENTRY} SELECT topic, a.enter_year AS enter_CN, a.flag AS flag_CN, b.enter_year AS enter_US, b.flag AS flag_US, a.enter_year - b.enter_year AS lag,
 CASE WHEN a.enter_year - b.enter_year IS NULL THEN 'unknown' WHEN a.enter_year > b.enter_year THEN 'CN_lags' WHEN a.enter_year < b.enter_year THEN 'CN_leads' ELSE 'same' END AS lag_label
 FROM (SELECT * FROM ent WHERE c2 = 'CN') a FULL JOIN (SELECT * FROM ent WHERE c2 = 'US') b USING (topic)""")
def lead_lag(spark, d):
    return trend.lead_lag(_entries(spark, d))


@query(f"""{ROLLED}, q AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY year) AS i FROM rolled), l AS (SELECT unnest(range(-10, 11)) AS lag),
j AS (SELECT a.topic, lag, corr(a.share_CN, b.share_US) AS corr, count(*) AS n, stddev_pop(a.share_CN) AS sx, stddev_pop(b.share_US) AS sy FROM q a, l, q b WHERE a.topic = b.topic AND b.i = a.i - lag GROUP BY a.topic, lag)
SELECT topic, lag AS lag_ccf, round(corr, 6) AS max_corr FROM j WHERE n >= 4 AND sx > 1e-12 AND sy > 1e-12 QUALIFY row_number() OVER (PARTITION BY topic ORDER BY round(corr, 9) DESC, lag) = 1""")
def cross_corr_lag(spark, d):
    return trend.cross_corr_lag(panel.rolling_topic_share(works(spark, d)))


# ---------------------------------------------------------------- references and edges

@query("SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey <> l_partkey")
def citation_edges(spark, d):
    """References made up from each order's parts, parsed back by their DOIs."""
    li, part = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("lineitem", "part"))
    ref = F.concat(F.lit("Author A, 1999, J TEST, V1, P1, DOI 10.5555/PART"), F.col("l_partkey").cast("string"), F.lit("."))
    refs = li.groupBy(F.col("l_orderkey").alias("src")).agg(F.array_join(F.array_sort(F.collect_list(ref)), "; ").alias("cr"))
    dois = part.select(F.col("p_partkey").alias("dst"), F.concat(F.lit("https://doi.org/10.5555/part"), F.col("p_partkey").cast("string")).alias("doi"))
    return edges.citation_edges(refs, dois)


NB = f"""WITH {EMB}, sim AS (SELECT a.id AS src, b.id AS dst, round(list_dot_product(a.e, b.e), 6) AS sim FROM emb a, emb b WHERE a.id <> b.id),
nb AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rank FROM sim QUALIFY rank <= {K}),
ed AS (SELECT least(src, dst) AS i, greatest(src, dst) AS j, max(sim) AS sim, count(*) AS n FROM nb GROUP BY ALL)"""
TRUTH = "truth AS (SELECT a.id AS i, b.id AS j FROM emb a JOIN emb b ON a.label = b.label AND a.id < b.id AND b.id - a.id <= 40)"
NODES = f"{NB}, u AS (SELECT i AS u, j AS v, sim FROM ed UNION ALL SELECT j, i, sim FROM ed)"


def _truth(spark, d) -> DataFrame:
    v = vectors(spark, d).select("id", "label", F.floor(F.col("id") / 40).alias("b"))
    a, b = v.select(F.col("id").alias("i"), "label", F.explode(F.array(F.col("b"), F.col("b") + 1)).alias("b")), v.withColumnRenamed("id", "j")
    return a.join(b, ["label", "b"]).filter("i < j and j - i <= 40").select("i", "j").distinct()


@query(f"{NB} SELECT i, j, sim FROM ed")
def knn_edges(spark, d):
    return knn.knn_edges(vectors(spark, d), K)


@query(f"{NB} SELECT i, j, sim FROM ed WHERE n = 2")
def knn_mutual(spark, d):
    return knn.knn_edges(vectors(spark, d), K, mutual=True)


@query(f"""WITH {EMB}, b AS (SELECT *, (row_number() OVER (PARTITION BY year ORDER BY id) - 1) // 16 AS batch FROM emb)
SELECT a.id AS src, b2.id AS dst, round(list_dot_product(a.e, b2.e), 6) AS sim, row_number() OVER (PARTITION BY a.id ORDER BY round(list_dot_product(a.e, b2.e), 6) DESC, b2.id) AS rank
FROM b a JOIN b b2 ON (b2.year < a.year OR b2.year = a.year AND b2.batch < a.batch) AND a.year - b2.year <= 5 QUALIFY rank <= {K}""")
def knn_time_aware(spark, d):
    return knn.neighbors(knn.batches(vectors(spark, d), 16), K, past=True, window=5)


ORIENTED = f"""{NB}, o AS (SELECT i, j, sim, a.year AS yi, b.year AS yj FROM ed JOIN emb a ON a.id = i JOIN emb b ON b.id = j),
ori AS (SELECT i AS src, j AS dst, sim, yi AS year_src, yj AS year_dst FROM o WHERE yi >= yj UNION ALL SELECT j, i, sim, yj, yi FROM o WHERE yj >= yi)"""


@query(f"{ORIENTED} SELECT * FROM ori")
def oriented_edges(spark, d):
    v = vectors(spark, d)
    return edges.orient(knn.knn_edges(v, K), v)


def _directed_truth(spark, d) -> DataFrame:
    v = vectors(spark, d)
    return edges.orient(_truth(spark, d).withColumn("sim", F.lit(1.0)), v, allow_same=False).select("src", "dst")


@query(f"""{ORIENTED}, {TRUTH}, dt AS (SELECT CASE WHEN a.year > b.year THEN i ELSE j END AS src, CASE WHEN a.year > b.year THEN j ELSE i END AS dst FROM truth JOIN emb a ON a.id = i JOIN emb b ON b.id = j WHERE a.year <> b.year),
ty AS (SELECT src, dst, CASE WHEN x.k = 1 AND y.k = 1 THEN 'both' WHEN y.k IS NULL THEN 'only_sim' ELSE 'only_cite' END AS edge_type FROM (SELECT DISTINCT src, dst, 1 AS k FROM ori) x FULL JOIN (SELECT DISTINCT src, dst, 1 AS k FROM dt) y USING (src, dst)),
bk AS (SELECT edge_type, a.country || '->' || b.country AS country_pair, CASE WHEN a.year - b.year <= 0 THEN '0' WHEN a.year - b.year <= 2 THEN '1-2' WHEN a.year - b.year <= 5 THEN '3-5' WHEN a.year - b.year <= 10 THEN '6-10' ELSE '>10' END AS gap_bin,
 a.label = b.label AND a.label <> -1 AS same_topic, count(*) AS n FROM ty JOIN emb a ON a.id = src JOIN emb b ON b.id = dst GROUP BY ALL)
SELECT *, round(n / sum(n) OVER (PARTITION BY edge_type), 6) AS share_in_type, round(n / sum(n) OVER (PARTITION BY country_pair, gap_bin, same_topic), 6) AS share_in_bucket FROM bk""")
def edge_buckets(spark, d):
    v = vectors(spark, d)
    types = edges.edge_types(edges.orient(knn.knn_edges(v, K), v), _directed_truth(spark, d))
    return edges.edge_buckets(edges.annotate(types, v.withColumnRenamed("label", "topic"), ["country", "year", "topic"]))


@query(f"""{NB}, {TRUTH}, x AS (SELECT count(*) AS "both" FROM ed JOIN truth USING (i, j)), y AS (SELECT (SELECT count(*) FROM ed) AS a, (SELECT count(*) FROM truth) AS b)
SELECT "both", a - "both" AS only_a, b - "both" AS only_b, round("both" / nullif(a + b - "both", 0), 6) AS jaccard FROM x, y""")
def edge_overlap(spark, d):
    return edges.overlap(knn.knn_edges(vectors(spark, d), K), _truth(spark, d))


KS = [10, 50, 100, 500]


@query(f"""{NB}, {TRUTH}, r AS (SELECT row_number() OVER (ORDER BY sim DESC, i, j) AS r, (i, j) IN (SELECT (i, j) FROM truth) AS hit FROM ed),
ks AS (SELECT unnest([10, 50, 100, 500]) AS K UNION SELECT count(*) FROM r), t AS (SELECT count(*) AS total_true FROM truth), m AS (SELECT count(*) AS n FROM r)
SELECT CAST(K AS BIGINT) AS K, count(*) FILTER (hit) AS hit_count, round(count(*) FILTER (hit) / K, 6) AS precision, round(count(*) FILTER (hit) / greatest(total_true, 1), 6) AS recall, total_true
FROM ks, r, t, m WHERE r <= K AND K <= n GROUP BY K, total_true""")
def pr_curve(spark, d):
    return edges.pr_curve(knn.knn_edges(vectors(spark, d), K), _truth(spark, d), KS)


@query(f"""{NB}, {TRUTH}, dt AS (SELECT CASE WHEN a.year > b.year THEN i ELSE j END AS src, CASE WHEN a.year > b.year THEN j ELSE i END AS dst FROM truth JOIN emb a ON a.id = i JOIN emb b ON b.id = j WHERE a.year <> b.year),
c AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS r FROM nb JOIN emb a ON a.id = src JOIN emb b ON b.id = dst WHERE a.year >= b.year),
h AS (SELECT c.*, dt.src IS NOT NULL AS hit FROM c LEFT JOIN dt USING (src, dst)), nt AS (SELECT src, count(*) AS n_true FROM dt GROUP BY src), ks AS (SELECT unnest([1, 3, 5]) AS K)
SELECT emb.id AS src, CAST(K AS BIGINT) AS K, count(*) FILTER (hit AND r <= K) AS hit_count, max(n_true) AS n_true, round(count(*) FILTER (hit AND r <= K) / max(n_true), 6) AS recall
FROM emb CROSS JOIN ks LEFT JOIN nt ON nt.src = emb.id LEFT JOIN h ON h.src = emb.id GROUP BY emb.id, K""")
def node_recall_at_k(spark, d):
    v = vectors(spark, d)
    return edges.node_recall_at_k(knn.neighbors(v, K).drop("rank"), _directed_truth(spark, d), v, [1, 3, 5])


# ---------------------------------------------------------------- graph

@query(f"{NODES} SELECT id, count(u) AS degree, round(coalesce(sum(sim), 0), 6) AS strength FROM emb LEFT JOIN u ON u.u = id GROUP BY id")
def degree_strength(spark, d):
    v = vectors(spark, d)
    return graph.degree_strength(knn.knn_edges(v, K), v)


@query(f"""{NODES}, dg AS (SELECT id, count(u) AS degree FROM emb LEFT JOIN u ON u.u = id GROUP BY id)
SELECT count(*) AS n_nodes, count(*) FILTER (degree = 0) AS isolated, round(avg(degree), 6) AS mean_degree, round(quantile_cont(degree, 0.25), 6) AS q25, round(quantile_cont(degree, 0.5), 6) AS q50, round(quantile_cont(degree, 0.75), 6) AS q75, round(quantile_cont(degree, 0.9), 6) AS q90 FROM dg""")
def degree_summary(spark, d):
    v = vectors(spark, d)
    return graph.degree_summary(graph.degree_strength(knn.knn_edges(v, K, mutual=False), v))


NAMED = f"{NB}, na AS (SELECT i, j, x.country AS a, y.country AS b, CAST(x.label AS VARCHAR) AS la, CAST(y.label AS VARCHAR) AS lb, x.year AS yi, y.year AS yj FROM ed JOIN emb x ON x.id = i JOIN emb y ON y.id = j)"


@query(f"{NAMED} SELECT a, b, count(*) AS n FROM (SELECT a, b FROM na UNION ALL SELECT b, a FROM na WHERE a <> b) GROUP BY a, b")
def mixing(spark, d):
    v = vectors(spark, d)
    return graph.mixing(knn.knn_edges(v, K), v, "country")


@query(f"{NAMED} SELECT least(a, b) || '-' || greatest(a, b) AS pair, count(*) AS n FROM na GROUP BY ALL")
def country_pairs(spark, d):
    v = vectors(spark, d)
    return graph.pair_counts(knn.knn_edges(v, K), v, "country")


@query(f"""{NAMED}, ends AS (SELECT a AS x FROM na UNION ALL SELECT b FROM na), m AS (SELECT count(*) AS m, count(*) FILTER (a = b) AS same FROM na), c AS (SELECT x, count(*) AS n FROM ends GROUP BY x),
s AS (SELECT sum((n / (2 * m)) ** 2) AS ab FROM c, m) SELECT round((same / m - ab) / (1 - ab), 6) AS assortativity FROM m, s""")
def assortativity(spark, d):
    v = vectors(spark, d)
    return graph.assortativity(knn.knn_edges(v, K), v, "country")


@query(f"""{NAMED}, m AS (SELECT count(*) AS m FROM na), i AS (SELECT la AS c, count(*) AS l FROM na WHERE la = lb GROUP BY la), dd AS (SELECT c, count(*) AS d FROM (SELECT la AS c FROM na UNION ALL SELECT lb FROM na) GROUP BY c)
SELECT round(sum(coalesce(l, 0) / m - (d / (2 * m)) ** 2), 6) AS modularity, count(*) AS n_communities FROM dd LEFT JOIN i USING (c), m""")
def modularity(spark, d):
    v = vectors(spark, d)
    return graph.modularity(knn.knn_edges(v, K), v, "label")


@query(f"""{NAMED}, p AS (SELECT i AS id, avg((la <> lb)::INT) AS p FROM na GROUP BY i), q AS (SELECT j AS id, avg((la <> lb)::INT) AS q FROM na GROUP BY j)
SELECT emb.id, round(greatest(coalesce(p, 0), coalesce(q, 0)), 6) AS bridging FROM emb LEFT JOIN p USING (id) LEFT JOIN q USING (id)""")
def bridge_ratio(spark, d):
    v = vectors(spark, d)
    return graph.bridge_ratio(knn.knn_edges(v, K), v, "label")


@query(f"""{NAMED}, y AS (SELECT least(yi, yj) AS year, count(*) AS total, count(*) FILTER (a <> b) AS "cross", count(*) FILTER (least(a, b) = 'CN' AND greatest(a, b) = 'US') AS cn_us FROM na GROUP BY ALL),
z AS (SELECT *, "cross" / total AS cross_ratio, cn_us / total AS cn_us_ratio, row_number() OVER (ORDER BY year) AS pos FROM y WHERE year > 1900)
SELECT year, total, "cross", cn_us, {_r('cross_ratio', 'cn_us_ratio')}, CASE WHEN pos >= 2 THEN round(avg(cross_ratio) OVER w, 6) END AS cross_ratio_roll, CASE WHEN pos >= 2 THEN round(avg(cn_us_ratio) OVER w, 6) END AS cn_us_ratio_roll
FROM z WINDOW w AS (ORDER BY year ROWS 4 PRECEDING)""")
def edge_year_series(spark, d):
    v = vectors(spark, d)
    return graph.edge_year_series(knn.knn_edges(v, K), v)


@query(f"""WITH RECURSIVE {EMB}, sim AS (SELECT a.id AS src, b.id AS dst, round(list_dot_product(a.e, b.e), 6) AS sim FROM emb a, emb b WHERE a.id <> b.id),
nb AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rank FROM sim QUALIFY rank <= 2), ed AS (SELECT DISTINCT least(src, dst) AS i, greatest(src, dst) AS j FROM nb),
u AS (SELECT i AS u, j AS v FROM ed UNION SELECT j, i FROM ed), reach AS (SELECT id AS a, id AS b FROM emb UNION SELECT reach.a, u.v FROM reach JOIN u ON u.u = reach.b)
SELECT a AS id, min(b) AS component FROM reach GROUP BY a""")
def components(spark, d):
    v = vectors(spark, d)
    return graph.components(knn.knn_edges(v, 2), v)


def _pagerank_sql(rounds: int = 10) -> str:
    parts = [f"{NODES}, d AS (SELECT u, count(*) AS d FROM u GROUP BY u), n AS (SELECT count(*) AS n FROM emb), r0 AS (SELECT id, 1.0::DOUBLE / n AS r FROM emb, n)"]
    for k in range(rounds):
        parts.append(
            f"l{k} AS (SELECT coalesce(sum(r) FILTER (d.u IS NULL), 0) AS l FROM r{k} LEFT JOIN d ON d.u = id), g{k} AS (SELECT u.v AS id, sum(r / d) AS g FROM u JOIN r{k} ON r{k}.id = u.u JOIN d ON d.u = u.u GROUP BY u.v), "
            f"r{k + 1} AS (SELECT emb.id, 0.15 / n + 0.85 * (coalesce(g, 0) + l / n) AS r FROM emb LEFT JOIN g{k} ON g{k}.id = emb.id, n, l{k})"
        )
    return ", ".join(parts) + f" SELECT id, round(r, 6) AS pagerank FROM r{rounds}"


@query(_pagerank_sql())
def pagerank_fixed_iter(spark, d):
    v = vectors(spark, d)
    return graph.pagerank(knn.knn_edges(v, K), v)


@query()
def kcore(spark, d):
    v = vectors(spark, d)
    return graph.kcore(knn.knn_edges(v, K), v)


@query()
def core_share(spark, d):
    v = vectors(spark, d)
    return graph.core_share(graph.kcore(knn.knn_edges(v, K), v), v)


@query()
def label_propagation(spark, d):
    v = vectors(spark, d)
    return graph.label_propagation(knn.knn_edges(v, K), v)


@query(f"""{NB}, w AS (SELECT id, country, unnest(range(year, year + 5)) AS t_end FROM emb), x AS (SELECT * FROM w WHERE t_end <= (SELECT max(year) FROM emb)),
n AS (SELECT t_end, count(*) AS n_nodes, avg((country = 'CN')::INT) AS share_CN, avg((country = 'US')::INT) AS share_US FROM x GROUP BY t_end),
m AS (SELECT a.t_end, count(*) AS n_edges FROM ed JOIN x a ON a.id = i JOIN x b ON b.id = j AND a.t_end = b.t_end GROUP BY a.t_end)
SELECT t_end, n_nodes, {_r('share_CN', 'share_US')}, coalesce(n_edges, 0) AS n_edges FROM n LEFT JOIN m USING (t_end)""")
def window_metrics(spark, d):
    v = vectors(spark, d)
    return graph.window_metrics(knn.knn_edges(v, K), v)


# ---------------------------------------------------------------- vectors and topics

CENT = f"WITH {EMB}, cl AS (SELECT label, p, avg(e[p]) AS x FROM emb, range(1, 65) t(p) GROUP BY label, p), cent AS (SELECT label, list(x ORDER BY p) AS c FROM cl GROUP BY label)"


@query(f"{CENT} SELECT id, CAST(label AS BIGINT) AS label, round(greatest(0, least(1, (list_cosine_similarity(e, c) + 1) / 2)), 6) AS confidence FROM emb JOIN cent USING (label)")
def topic_confidence(spark, d):
    return knn.topic_confidence(vectors(spark, d))


@query(f"""{CENT}, f AS (SELECT label, list_cosine_similarity(e, c) AS cs FROM emb JOIN cent USING (label)), g AS (SELECT label, greatest(0, least(1, (cs + 1) / 2)) AS k FROM f), q AS (SELECT quantile_cont(k, 0.25) AS q25 FROM g)
SELECT CAST(label AS BIGINT) AS label, round(avg(k), 6) AS mean_confidence, round(q25, 6) AS q25, round(avg(k), 9) < round(q25, 9) AS low FROM g, q GROUP BY label, q25""")
def confidence_check(spark, d):
    return knn.confidence_check(knn.topic_confidence(vectors(spark, d)))


@query(f"""{CENT}, p AS (SELECT a.label AS a, b.label AS b, round(list_cosine_similarity(a.c, b.c), 6) AS sim FROM cent a, cent b WHERE a.label <> b.label)
SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, sim, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rank, sim > 0.9 AS near FROM p QUALIFY rank <= 5""")
def topic_neighbors(spark, d):
    return knn.topic_neighbors(vectors(spark, d))


@query(f"""WITH {EMB}, fr AS (SELECT * FROM emb WHERE country = 'US' AND id % 2 = 0), cl AS (SELECT label, p, avg(e[p]) AS x FROM fr, range(1, 65) t(p) GROUP BY label, p), cent AS (SELECT label, list(x ORDER BY p) AS c FROM cl GROUP BY label),
b AS (SELECT label, count(*) AS n_frontier FROM fr GROUP BY label HAVING count(*) >= 5), j AS (SELECT label, country, n_frontier, 1 - list_cosine_similarity(e, c) AS d FROM emb JOIN cent USING (label) JOIN b USING (label))
SELECT CAST(label AS BIGINT) AS label, n_frontier, round(avg(d) FILTER (country = 'CN'), 6) AS dist_CN, round(avg(d) FILTER (country = 'US'), 6) AS dist_US, round(avg(d) FILTER (country = 'CN') - avg(d) FILTER (country = 'US'), 6) AS semantic_gap FROM j GROUP BY label, n_frontier""")
def semantic_gap(spark, d):
    return knn.semantic_gap(vectors(spark, d), F.col("id") % 2 == 0, min_papers=5)


@query(f"""{CENT}, r AS (SELECT label, id, round(list_cosine_similarity(e, c), 6) AS sim FROM emb JOIN cent USING (label))
SELECT CAST(label AS BIGINT) AS label, id, sim, row_number() OVER (PARTITION BY label ORDER BY sim DESC, id) AS rank FROM r QUALIFY rank <= 5""")
def representatives(spark, d):
    return knn.representatives(vectors(spark, d))


@query(f"""{CENT}, pw AS (SELECT a.id, a.label AS l, b.label AS l2, sum(list_distance(a.e, b.e)) AS s, count(*) AS n FROM emb a, emb b GROUP BY ALL),
a AS (SELECT id, CASE WHEN n > 1 THEN s / (n - 1) END AS a FROM pw WHERE l = l2), b AS (SELECT id, min(s / n) AS b FROM pw WHERE l <> l2 GROUP BY id),
si AS (SELECT avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM a JOIN b USING (id)),
sp AS (SELECT label, c, avg(list_distance(e, c)) AS s FROM emb JOIN cent USING (label) GROUP BY ALL),
db AS (SELECT avg(r) AS davies_bouldin FROM (SELECT max((x.s + y.s) / list_distance(x.c, y.c)) AS r FROM sp x, sp y WHERE x.label <> y.label GROUP BY x.label))
SELECT round(silhouette, 6) AS silhouette, round(davies_bouldin, 6) AS davies_bouldin FROM si, db""")
def silhouette_db(spark, d):
    return trajectory.silhouette_db(vectors(spark, d))


@query(f"{CENT} SELECT CAST(label AS BIGINT) AS label, round(sum(list_distance(e, c) ** 2), 6) AS wcss, count(*) AS n FROM emb JOIN cent USING (label) GROUP BY label")
def wcss(spark, d):
    return trajectory.wcss(vectors(spark, d))


MEM = f"""{CENT}, w AS (SELECT id, year, country, cent.label AS topic, 1 / greatest(list_distance(e, c) ** 2, 1e-12) AS w FROM emb, cent),
mem AS (SELECT id, year, country, CAST(topic AS BIGINT) AS topic, w / sum(w) OVER (PARTITION BY id) AS weight FROM w)"""


def _membership(spark, d) -> DataFrame:
    v = vectors(spark, d)
    return topics.memberships(v, knn.centroids(v))


@query(f"{MEM} SELECT id, CAST(year AS BIGINT) AS year, country, topic, round(weight, 6) AS weight FROM mem")
def fuzzy_membership(spark, d):
    return _membership(spark, d)


@query(f"""{MEM}, n AS (SELECT topic, CAST(year AS BIGINT) AS year, coalesce(sum(weight) FILTER (country = 'CN'), 0) AS weight_CN, coalesce(sum(weight) FILTER (country = 'US'), 0) AS weight_US FROM mem WHERE country IN ('CN', 'US') GROUP BY ALL),
s AS (SELECT *, coalesce(weight_CN / nullif(sum(weight_CN) OVER (PARTITION BY year), 0), 0) AS share_CN, coalesce(weight_US / nullif(sum(weight_US) OVER (PARTITION BY year), 0), 0) AS share_US FROM n)
SELECT topic, year, {_r('weight_CN', 'weight_US', 'share_CN', 'share_US')}, round(share_CN - share_US, 6) AS delta FROM s""")
def fuzzy_share(spark, d):
    return topics.fuzzy_share(_membership(spark, d))


@query(f"""{MEM}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(weight, 12) DESC, topic) AS k FROM mem),
b AS (SELECT id, -sum(weight * ln(weight)) / ln(count(*)) AS entropy, max(weight) FILTER (k = 1) - max(weight) FILTER (k = 2) AS top_gap, 1 / sum(weight * weight) AS effective_topics FROM r GROUP BY id)
SELECT topic, round(sum(weight * entropy) / sum(weight), 6) AS entropy, round(sum(weight * top_gap) / sum(weight), 6) AS top_gap, round(sum(weight * effective_topics) / sum(weight), 6) AS effective_topics FROM mem JOIN b USING (id) GROUP BY topic""")
def boundary_metrics(spark, d):
    return topics.topic_boundary(_membership(spark, d))


@query(f"""{MEM}, p AS (SELECT id, weight AS u FROM mem WHERE topic = 0), j AS (SELECT * FROM mem JOIN p USING (id) WHERE country IN ('CN', 'US')),
o AS (SELECT topic, sum(u * weight) FILTER (country = 'CN') / sum(u) FILTER (country = 'CN') AS comp_CN, sum(u * weight) FILTER (country = 'US') / sum(u) FILTER (country = 'US') AS comp_US FROM j GROUP BY topic)
SELECT topic, {_r('comp_CN', 'comp_US')}, round(comp_CN - comp_US, 6) AS gap FROM o""")
def soft_composition(spark, d):
    return topics.soft_composition(_membership(spark, d), 0)


@query(f"""{MEM}, r AS (SELECT id, topic, weight, row_number() OVER w AS k, coalesce(sum(weight) OVER (PARTITION BY id ORDER BY round(weight, 12) DESC, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM mem WINDOW w AS (PARTITION BY id ORDER BY round(weight, 12) DESC, topic))
SELECT id, topic, round(weight, 6) AS weight, k FROM r WHERE k <= 4 OR k <= 8 AND round(before, 9) < 0.85 AND weight >= 0.03""")
def topic_profiles(spark, d):
    return topics.profiles(_membership(spark, d))


TERMS = """WITH tk AS (SELECT topic, term FROM (SELECT lang AS topic, unnest(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' ')) AS term FROM documents) WHERE length(term) >= 2),
n AS (SELECT topic, term, count(*) AS n FROM tk GROUP BY ALL), r AS (SELECT topic, sum(n) AS total FROM n GROUP BY topic), m AS (SELECT avg(total) AS mt FROM r), df AS (SELECT term, count(*) AS df FROM n GROUP BY term),
sc AS (SELECT topic, term, n, n / total * ln(mt / df + 1) AS score FROM n JOIN r USING (topic) JOIN df USING (term), m),
top AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(score, 9) DESC, term) AS rank FROM sc QUALIFY rank <= 10)"""


def _top_words(spark, d) -> DataFrame:
    return topics.top_words(topics.ctfidf(topics.tokens(spark.read.parquet(f"{d}/documents.parquet"), "lang")))


@query(f"{TERMS} SELECT topic, term, n, round(score, 6) AS score, rank FROM top")
def ctfidf_top_words(spark, d):
    return _top_words(spark, d)


@query(f"""{TERMS}, l AS (SELECT topic, list(term ORDER BY rank) AS w FROM top GROUP BY topic)
SELECT topic, array_to_string(w[1:3], '_') AS name, array_to_string(w[1:3], ' / ') AS title, md5(array_to_string(w, '|')) AS cache_key FROM l""")
def topic_names(spark, d):
    return topics.topic_names(_top_words(spark, d))


@query(f"""{TERMS}, s AS (SELECT topic, list(DISTINCT term) AS w FROM top GROUP BY topic)
SELECT a.topic AS topic_a, b.topic AS topic_b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS jaccard FROM s a JOIN s b ON a.topic < b.topic""")
def keyword_jaccard(spark, d):
    return topics.keyword_jaccard(_top_words(spark, d))


# ---------------------------------------------------------------- clustering, anomalies, models

DIST = f"{NB}, kd AS (SELECT src AS id, avg(sqrt(greatest(2 - 2 * sim, 0))) AS mean_distance FROM nb GROUP BY src)"


@query(f"""{DIST}, m AS (SELECT median(mean_distance) AS med FROM kd), ma AS (SELECT median(abs(mean_distance - med)) AS mad FROM kd, m)
SELECT id, round(mean_distance, 6) AS mean_distance, round((mean_distance - med) / (1.4826 * mad + 1e-12), 6) AS robust_z, round((mean_distance - med) / (1.4826 * mad + 1e-12), 6) > 3 AS anomaly FROM kd, m, ma""")
def anomaly_robust_z(spark, d):
    return trajectory.robust_z(trajectory.knn_distance(knn.neighbors(vectors(spark, d), K)), "mean_distance")


@query()
def anomaly_lof(spark, d):
    return trajectory.lof(knn.neighbors(vectors(spark, d), K), K)


@query()
def kmeans_topics(spark, d):
    return trajectory.kmeans_topics(vectors(spark, d), 10)


@query()
def pca_2d(spark, d):
    p = trajectory.pca(vectors(spark, d))
    return p.select("id", F.col("coordinates")[0].alias("x"), F.col("coordinates")[1].alias("y"), "error")


def _units(spark, d) -> DataFrame:
    return panel.trajectory_units(panel.catchup_panel(works(spark, d)))


@query(f"""{UNITS}, z AS (SELECT country, topic, year, value, avg(value) OVER w AS mu, stddev_pop(value) OVER w AS sd FROM units WINDOW w AS (PARTITION BY country, topic))
SELECT country, topic, year, round(value, 6) AS value, round(CASE WHEN round(sd, 12) > 0 THEN (value - mu) / sd ELSE 0 END, 6) AS z FROM z""")
def trajectory_z(spark, d):
    return trajectory.z_normalize(_units(spark, d))


@query()
def dtw_distance(spark, d):
    return trajectory.pairwise(_units(spark, d), "dtw")


@query(f"""{UNITS}, s AS (SELECT country || '|' || topic AS u, year, value FROM units)
SELECT a.u AS a, b.u AS b, round(sqrt(sum((a.value - b.value) ** 2)), 6) AS distance FROM s a JOIN s b ON a.u < b.u AND a.year = b.year GROUP BY a.u, b.u""")
def euclidean_distance(spark, d):
    return trajectory.pairwise(_units(spark, d), "euclidean")


@query()
def agglomerative_k_sweep(spark, d):
    return trajectory.agglomerative_sweep(trajectory.pairwise(_units(spark, d), "dtw"), list(range(2, 9)))


def _links(spark, d) -> DataFrame:
    v = vectors(spark, d).withColumnRenamed("label", "topic")
    sim = edges.orient(knn.knn_edges(vectors(spark, d), K), vectors(spark, d))
    types = edges.edge_types(sim, _directed_truth(spark, d)).filter("edge_type <> 'only_cite'").join(sim.select("src", "dst", "sim"), ["src", "dst"])
    e = edges.annotate(types, v, ["country", "year", "topic"])
    return e.select(
        "src", "dst", (F.col("edge_type") == "both").cast("int").alias("y"), "sim", (F.col("year_src") - F.col("year_dst")).cast("double").alias("gap"), (F.col("topic_src") == F.col("topic_dst")).cast("double").alias("same_topic"),
        ((F.col("country_src") == "CN") & (F.col("country_dst") == "US")).cast("double").alias("cn_us"), ((F.col("country_src") == "US") & (F.col("country_dst") == "CN")).cast("double").alias("us_cn"),
        F.concat_ws("->", "country_src", "country_dst").alias("country_pair"), edges.gap_bucket(F.col("year_src") - F.col("year_dst")).alias("gap_bin"),
    )


@query()
def logit_edges(spark, d):
    e = _links(spark, d).withColumns({"sim_cn_us": F.col("sim") * F.col("cn_us"), "sim_us_cn": F.col("sim") * F.col("us_cn")})
    return resample.link_model(e, ["sim", "gap", "same_topic", "cn_us", "us_cn", "sim_cn_us", "sim_us_cn"])


@query()
def matched_negatives(spark, d):
    e = cut(_links(spark, d))
    return resample.matched_negatives(e.filter("y = 1"), e.filter("y = 0"), ["country_pair", "gap_bin"], ["src", "dst"]).drop("country_pair", "gap_bin")


@query(f"WITH {EMB} SELECT id, CAST(label AS BIGINT) AS label, CAST(year AS BIGINT) AS year FROM emb QUALIFY row_number() OVER (PARTITION BY label, year ORDER BY md5(CAST(id AS VARCHAR)), id) <= 2")
def stratified_sample(spark, d):
    return resample.stratified_sample(vectors(spark, d), ["label", "year"], "id", 2).select("id", "label", "year")


@query()
def bootstrap_ci(spark, d):
    """Bootstrapped share of each region in each topic, rows drawn within year and region."""
    runs = resample.stratified_bootstrap(works(spark, d).groupBy("year", "country", "topic").agg(F.count("*").alias("n")), ["year", "country"], ["topic"])
    s = runs.groupBy("run", "topic", "country").agg(F.sum("n").alias("n"))
    s = s.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("run", "topic")))
    return resample.summarize_runs(s, ["topic", "country"], "share")


# ---------------------------------------------------------------- cleaning

@query("""WITH t AS (SELECT doc_id AS paper_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') || '. ' AS text, source, CASE doc_id % 5 WHEN 0 THEN 'China' WHEN 1 THEN 'USA' WHEN 2 THEN 'p.r. china' WHEN 3 THEN 'Japan' END AS c FROM documents WHERE text IS NOT NULL)
SELECT paper_id, length(text) AS length, CAST(regexp_extract(source, '[0-9]+') AS BIGINT) + 2000 AS year, CASE WHEN c = 'China' THEN 'CN' WHEN c = 'USA' THEN 'US' ELSE coalesce(c, 'Other') END AS country_code,
 CASE WHEN c = 'China' THEN 'CN' WHEN c = 'USA' THEN 'US' ELSE 'OTHER' END AS three, CASE WHEN c IN ('China', 'p.r. china') THEN 'CN' WHEN c = 'USA' THEN 'US' ELSE 'OTHER' END AS folded,
 CASE WHEN c IN ('China', 'p.r. china') THEN 'CN' ELSE 'OTHER' END AS contained FROM t WHERE length(text) >= 20""")
def clean_papers_report(spark, d):
    """The cleaning rules and the four country labels over the documents as papers."""
    raw = spark.read.parquet(f"{d}/documents.parquet")
    country = F.element_at(F.array(F.lit("China"), F.lit("USA"), F.lit("p.r. china"), F.lit("Japan"), F.lit(None)), (F.col("doc_id") % 5 + 1).cast("int"))
    raw = raw.select(F.col("doc_id").alias("UT"), F.col("text").alias("TI"), F.lit(None).cast("string").alias("AB"), (F.regexp_extract("source", "[0-9]+", 0).cast("int") + 2000).cast("string").alias("PY"), country.alias("country"))
    c = clean_papers(raw)
    n = F.col("country")
    return c.select("paper_id", F.length("text").alias("length"), "year", "country_code", country_three(n).alias("three"), country_folded(n).alias("folded"), F.coalesce(country_contains(n), F.lit("OTHER")).alias("contained"))
