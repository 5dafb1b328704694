"""Small literal fixtures for the operators' edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.operators import divergence, edges, graph, knn, panel, resample, tables, trajectory, trend
from loomwork.plans import further, registry
from loomwork.sources import sinks
from loomwork.sources.papers import clean_papers, country_exact, first_filled

SF = "/root/testdata/sf0.001"


def test_clean_papers(spark):
    raw = spark.createDataFrame([("A long enough title", None, "1999", "China"), (None, None, "1", "US"), ("short", "x", "bad", None)], "TI string, AB string, PY string, country string")
    got = clean_papers(raw).collect()
    assert [(r["text"], r["year"], r["country_code"]) for r in got] == [("A long enough title. ", 1999, "CN")]
    assert first_filled(raw, ["nope", "AB", "TI"]) == "AB"
    assert spark.range(1).select(country_exact(F.lit(None).cast("string"))).first()[0] == "Other"


def test_rolling_share_grids(spark):
    df = spark.createDataFrame([("a", y, "CN") for y in (1, 2, 4, 5)] + [("b", y, "US") for y in (1, 5)], "topic string, year int, c2 string")
    assert panel.rolling_topic_share(df, 5, 3).select("year").distinct().count() == 2
    assert panel.rolling_topic_share(df, 5, 3, contiguous=True).select("year").distinct().count() == 3
    assert {r["share_CN"] for r in panel.rolling_topic_share(df).filter("topic = 'a'").collect()} == {1.0}


def test_js(spark):
    js = lambda rows: divergence.js_distance(spark.createDataFrame(rows, "a long, b long"), "a", "b").first()["js_distance"]
    assert js([(1, 1), (3, 3)]) == 0
    assert math.isclose(js([(1, 0), (0, 1)]), math.sqrt(math.log(2)))
    assert js([(1, 0), (2, 0)]) is None


def test_entry_year(spark):
    def entered(values):
        df = spark.createDataFrame([("t", "CN", i, float(v)) for i, v in enumerate(values)], "topic string, c2 string, year int, share double")
        return trend.entry_year(df).first()

    assert entered([0, 0, 0, 0, 1, 1, 1])["enter_year"] == 4
    assert entered([1, 1, 1, 1, 1, 1])["flag"] == "not_entered"
    assert entered([0, 0, 0, 5, 0, 0, 0])["enter_year"] is None
    assert entered([0, 1, 2, 3])["flag"] == "insufficient"


def test_cross_corr_lag(spark):
    wave = [0.0, 1.0, 3.0, 2.0, 5.0, 4.0, 7.0, 1.0, 0.0, 2.0, 6.0, 3.0]
    df = spark.createDataFrame([("t", i, wave[i - 2] if i > 1 else 0.5, wave[i]) for i in range(12)], "topic string, year int, share_CN double, share_US double")
    assert trend.cross_corr_lag(df).first()["lag_ccf"] == 2


def test_knn(spark):
    pts = [[1.0, 0.0], [0.99, 0.1], [0.98, 0.2], [-1.0, 0.0]]
    v = spark.createDataFrame([(i, p, 2000 + i // 2) for i, p in enumerate(pts)], "id long, embedding array<float>, year int")
    assert {(r["i"], r["j"]) for r in knn.knn_edges(v, 2, mutual=True).collect()} == {(0, 1), (0, 2), (1, 2)}
    past = {(r["src"], r["dst"]) for r in knn.neighbors(v.withColumn("batch", F.lit(0)), 5, past=True).collect()}
    assert past == {(2, 0), (2, 1), (3, 0), (3, 1)}


def test_graph(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0), (3, 4, 1.0), (6, 7, 1.0)], "i long, j long, sim double")
    n = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6, 7)], "id long")
    assert {r["id"]: r["component"] for r in graph.components(e, n).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 6}
    assert {r["id"]: r["coreness"] for r in graph.kcore(e, n).collect()} == {1: 2, 2: 2, 3: 2, 4: 1, 5: 0, 6: 1, 7: 1}
    assert math.isclose(sum(r["pagerank"] for r in graph.pagerank(e, n).collect()), 1.0, abs_tol=1e-9)


def test_citation_edges(spark):
    refs = spark.createDataFrame(
        [(1, "X, DOI 10.5555/B.; Y, doi [10.5555/c, DOI 10.5555/d]"), (2, "no reference"), (3, "Z, DOI 10.5555/C; Z, DOI 10.5555/C"), (9, "S, DOI 10.5555/S(1)3;2<1::A")], "src long, cr string"
    )
    dois = spark.createDataFrame([(2, "https://doi.org/10.5555/b"), (3, "10.5555/c"), (4, "10.5555/d"), (5, None)], "dst long, doi string")
    assert {tuple(r) for r in edges.citation_edges(refs, dois).collect()} == {(1, 2), (1, 3)}


def test_clusters(spark):
    v = spark.createDataFrame([(i, [float(i // 5 * 10 + i % 5 * 0.1), 0.0], i // 5) for i in range(10)], "id long, embedding array<float>, label int")
    assert trajectory.silhouette_db(v, block=4).first()["silhouette"] > 0.9
    d = np.abs(np.subtract.outer([0.0, 0.1, 5, 5.2, 9], [0.0, 0.1, 5, 5.2, 9]))
    assert trajectory.cut_tree(trajectory.linkage(d), 5, 3).tolist() == [0, 0, 1, 1, 2]
    assert trajectory.dtw(np.array([0.0, 1, 2]), np.array([0.0, 0, 1, 2])) == 0


def test_stratified_bootstrap(spark):
    """Each run keeps the strata's sizes, and a kind's count varies as a draw of single rows does, not of whole groups."""
    counts = spark.createDataFrame([(1, "x", "a", 4000), (1, "x", "b", 6000), (2, "x", "a", 10)], "year int, country string, topic string, n long")
    runs = resample.stratified_bootstrap(counts, ["year", "country"], ["topic"])
    got = [tuple(r) for r in runs.collect()]
    assert sorted(got) == sorted(tuple(r) for r in runs.collect()) and len({r[0] for r in got}) == 200
    assert {(r["run"], r["year"]): r["n"] for r in runs.groupBy("run", "year").agg(F.sum("n").alias("n")).collect()} == {(k, y): n for k in range(1, 201) for y, n in ((1, 10000), (2, 10))}
    a = np.array([r[4] for r in got if r[1] == 1 and r[3] == "a"])
    assert abs(a.mean() - 4000) < 20 and 40 < a.std() < 60  # sqrt(10000 * 0.4 * 0.6) = 49


def test_matched_negatives(spark):
    """Strata first, then the country pair, then any, until there are as many as positives."""
    cols = "src long, dst long, pair string, gap string"
    pos = spark.createDataFrame([(k, 0, "CN->US", "0") for k in range(6)] + [(k, 0, "US->CN", "1-2") for k in range(6, 10)], cols)
    neg = [(k, 1, "CN->US", "0") for k in range(2)] + [(k, 1, "CN->US", ">10") for k in range(2, 5)] + [(k, 1, "US->CN", "1-2") for k in range(5, 9)] + [(k, 1, "JP->KR", "0") for k in range(9, 30)]
    got = [tuple(r)[0] for r in resample.matched_negatives(pos, spark.createDataFrame(neg, cols), ["pair", "gap"], ["src", "dst"]).select("src").collect()]
    assert len(got) == len(set(got)) == 10 and set(range(9)) < set(got)
    few = spark.createDataFrame(neg[:3], cols)
    assert resample.matched_negatives(pos, few, ["pair", "gap"], ["src", "dst"]).count() == 3
    assert resample.matched_negatives(pos.limit(0), few, ["pair", "gap"], ["src", "dst"]).count() == 0


def test_ward():
    """Each merge joins the two clusters whose union adds least to the sum of squares; its height is the root of twice that."""
    x = np.random.default_rng(3).standard_normal((14, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    clusters = {i: [i] for i in range(14)}
    spread = lambda m: ((x[m] - x[m].mean(axis=0)) ** 2).sum()
    for step, (a, b, height, size) in enumerate(trajectory.linkage(d, "ward")):
        cost = {(p, q): spread(clusters[p] + clusters[q]) - spread(clusters[p]) - spread(clusters[q]) for p in clusters for q in clusters if p < q}
        assert math.isclose(cost[a, b], min(cost.values()), abs_tol=1e-9) and math.isclose(height, math.sqrt(2 * cost[a, b]), rel_tol=1e-6)
        clusters[14 + step] = clusters.pop(a) + clusters.pop(b)
        assert len(clusters[14 + step]) == size
    assert trajectory.linkage(d, "ward") != trajectory.linkage(d, "average")
    with pytest.raises(ValueError):
        trajectory.linkage(d, "wards")


def test_best_k(spark):
    rows = [(2, 0.5, 1.0), (3, 0.7, 1.0), (4, 0.7, 1.0), (5, 0.9, 2.0), (6, None, None)]
    assert trajectory.best_k(spark.createDataFrame(rows, "k int, silhouette double, davies_bouldin double")).first()["k"] == 3
    assert trajectory.best_k(spark.createDataFrame([r[:2] for r in rows], "k int, silhouette double")).first()["k"] == 5


def test_many_to_one(spark):
    left, right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, x string"), spark.createDataFrame([(1, 10), (3, 30)], "k int, y int")
    assert {(r["x"], r["y"]) for r in tables.join_many_to_one(left, right, ["k"]).collect()} == {("a", 10), ("b", 10), ("c", None)}
    with pytest.raises(Exception, match="not unique"):
        tables.join_many_to_one(left, right.unionByName(right), ["k"]).collect()


def test_tables(spark):
    df = spark.createDataFrame([(k, k % 3) for k in range(50)], "k int, g int")
    assert [r["k"] for r in tables.numbered(df, F.col("g"), ["k"]).orderBy("number").collect()] == sorted(range(50), key=lambda k: (k % 3, k))
    assert tables.infer_columns(["Source", "B"], {"src": ["src", "source"], "dst": ["dst"]}) == {"src": "Source", "dst": None}
    said = spark.createDataFrame([('{"a": 1}',), ('x {"a": 2} y',), ("none",), (None,), ("{bad}",)], "t string")
    assert [r[0] for r in said.select(tables.json_object(F.col("t"), "a int")["a"]).collect()] == [1, 2, None, None, None]
    assert [r["s"] for r in tables.standardized(spark.createDataFrame([(1.0,), (1.0,)], "s double"), ["s"]).collect()] == [0.0, 0.0]


def test_sinks(spark, tmp_path):
    top = f"file://{tmp_path}"
    df = spark.createDataFrame([(1, 'a "quoted", text', 0.0), (2, "line\nbreak", 2.5)], "id int, t string, v double")
    sinks.write_csv(df, f"{top}/c")
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(f"{top}/c")
    assert {(r["id"], r["t"]) for r in back.collect()} == {("1", 'a "quoted", text'), ("2", "line\nbreak")}
    sinks.write_sparse(df, f"{top}/s", "id", "t", "v")
    assert [tuple(r) for r in spark.read.parquet(f"{top}/s").collect()] == [(2, "line\nbreak", 2.5)]
    sinks.write_json(spark, {"a": np.int64(3), "b": float("nan"), "c": np.array([1.5]), "d": {"é": {1}}}, f"{top}/r.json")
    assert sinks.read_json(spark, f"{top}/r.json") == {"a": 3, "b": None, "c": [1.5], "d": {"é": [1]}}
    assert '"id":1' in sinks.json_rows(df).collect()[0]["json"]
    made = []
    build = lambda: made.append(1) or df
    with pytest.raises(FileNotFoundError):
        sinks.load_or_build(spark, f"{top}/p", build, "read")
    assert [sinks.load_or_build(spark, f"{top}/p", build, m).count() for m in ("auto", "auto", "read", "rebuild")] == [2] * 4 and len(made) == 2
    sinks.write_manifest(spark, top, "one", "none", {"p": f"{top}/p"}, k=3)
    assert sinks.read_manifest(spark, top, "one")["p"].count() == 2
    sinks.write_manifest(spark, top, "two", "none", {"q": f"{top}/missing"})
    with pytest.raises(FileNotFoundError):
        sinks.read_manifest(spark, top, "two")


def _counted(spark, v):
    """v, and an accumulator of the rows that are read of it."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return v.mapInArrow(count, v.schema), seen


def _brute(x, ids, k, ok):
    """The k of largest rounded inner product of each vector, ties by id."""
    out = set()
    for a in range(len(x)):
        near = sorted((-round(float(x[a] @ x[b]), 6) + 0.0, int(ids[b])) for b in range(len(x)) if ids[b] != ids[a] and ok(a, b))
        out |= {(int(ids[a]), b, rank + 1, -s + 0.0) for rank, (s, b) in enumerate(near[:k])}
    return out


@pytest.mark.parametrize("case", ["plain", "past", "ties", "sizes", "huge", "copies", "past copies"])
def test_neighbors_of_groups(spark, monkeypatch, case):
    """whatever the groups, the neighbours are those of all pairs, and each vector is sent once for each group."""
    monkeypatch.setattr(knn, "MOST", 130)
    rng = np.random.default_rng(7)
    n = 700
    x = rng.standard_normal((n, 6)).round(2)
    if case == "ties":
        x = rng.integers(-1, 2, (n, 6)).astype(float)
    elif case.endswith("copies"):
        x = np.where(rng.random((n, 1)) < 0.3, 0.0, x[rng.integers(0, 40, n)])
    elif case == "sizes":
        x *= 10.0 ** rng.integers(-3, 4, (n, 1))
    elif case == "huge":
        x = (x * 2.0**60).round()
    ids, years = rng.permutation(n) * 3, rng.integers(2000, 2006, n)
    x = x.astype(np.float32).astype(float)
    v = spark.createDataFrame([(int(i), e.tolist(), int(y), int(i) % 4) for i, e, y in zip(ids, x, years, strict=True)], "id long, embedding array<float>, year int, batch int")
    v, seen = _counted(spark, v)
    past = case.startswith("past")
    ok = (lambda a, b: (years[b] < years[a] or years[b] == years[a] and ids[b] % 4 < ids[a] % 4) and years[a] - years[b] <= 3) if past else lambda a, b: True
    got = {(r["src"], r["dst"], r["rank"], r["sim"] + 0.0) for r in knn.neighbors(v, 4, past=past, window=3 if past else None).collect()}
    want = _brute(x, ids, 4, ok)
    if case in ("sizes", "huge"):  # rounding to 6 digits says nothing of large values: sums in another order differ
        got, want = ({t[:3] for t in some} for some in (got, want))
        assert len(got) == len(want) and len(got - want) <= (0 if case == "huge" else 4)
    else:
        assert got == want
    assert seen.value <= 2 * n  # once to count them, once to deal them


def test_link_model_reads_edges_once(spark):
    """F1: the edges are computed once; running sums by ranges of scores give what single sums give."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((900, 2)).round(1)
    y = (x[:, 0] + rng.standard_normal(900) > 0.5).astype(int)
    e, seen = _counted(spark, spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y int"))
    got = {r["feature"]: r for r in resample.link_model(e, ["a", "b"]).collect()}
    assert seen.value == 900
    c = np.array([got["a"]["coefficient"], got["b"]["coefficient"]]) / x.std(axis=0)
    s = (x - x.mean(axis=0)) @ c
    s = s.round(9)
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    ap = sum((y[s == t].sum() / len(pos)) * y[s >= t].mean() for t in np.unique(s))
    assert math.isclose(got["a"]["auc"], auc, abs_tol=1e-9) and math.isclose(got["a"]["average_precision"], ap, abs_tol=1e-9)


#: Findings of round 3 and their queries.
SEARCHED_ONCE = ["pagerank_fixed_iter", "standard_edges", "kcore", "matched_negatives", "knn_mutual", "label_propagation", "edge_xor", "country_pairs", "oriented_edges", "harmonized_nodes", "knn_edges", "layer_composition", "assortativity", "mixing", "anomaly_robust_z", "direction_checks", "bridge_ratio", "core_share", "edge_buckets", "edge_overlap"]


@pytest.mark.parametrize("name", SEARCHED_ONCE)
def test_vectors_are_searched_once(spark, monkeypatch, name):
    """However often a query uses its edges, each embedding is read once, and sent once for each group."""
    seen, real = spark.sparkContext.accumulator(0), registry.vectors
    read = F.udf(lambda e: seen.add(1) or e, "array<float>")
    counted = lambda s, d: real(s, d).withColumn("embedding", read("embedding"))
    monkeypatch.setattr(registry, "vectors", counted)
    monkeypatch.setattr(further, "vectors", counted)
    assert registry.QUERIES[name](spark, SF).collect()
    assert seen.value == 500


def test_pagerank_computes_a_round_once(spark):
    """a round reads the ranks before it three times; the nodes are still read once."""
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0)], "i long, j long, sim double")
    seen = spark.sparkContext.accumulator(0)
    n = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "id long").select(F.udf(lambda i: seen.add(1) or i, "long")("id").alias("id"))
    got = {r["id"]: r["pagerank"] for r in graph.pagerank(e, n).collect()}
    assert seen.value == 4 and math.isclose(sum(got.values()), 1.0, abs_tol=1e-9) and got[1] > got[4]
