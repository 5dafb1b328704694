"""Clustering of trajectories and vectors, their quality, anomalies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.columns import dot


def _distance_sums(key, rows: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
    """For each row the sum of its distances to the rows of base, by their label."""
    if not len(rows) or not len(base):
        return pd.DataFrame({"id": [], "l": [], "l2": [], "s": [], "n": []})
    x, y = np.stack(rows["embedding"]).astype(np.float64), np.stack(base["embedding"]).astype(np.float64)
    labels, code = np.unique(base["l"].to_numpy(), return_inverse=True)
    one = np.zeros((len(y), len(labels)))
    one[np.arange(len(y)), code] = 1
    sums = []
    for at in range(0, len(x), 256):
        p = x[at : at + 256]
        d = np.sqrt(np.maximum((p * p).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * p @ y.T, 0))
        d[rows["id"].to_numpy()[at : at + 256, None] == base["id"].to_numpy()[None]] = 0
        sums.append(d @ one)
    k = len(labels)
    return pd.DataFrame({"id": np.repeat(rows["id"].to_numpy(), k), "l": np.repeat(rows["l"].to_numpy(), k), "l2": np.tile(labels, len(x)), "s": np.concatenate(sums).ravel(), "n": np.tile(one.sum(axis=0), len(x))})


def silhouette_db(vectors: DataFrame, label: str = "label", block: int = 4096) -> DataFrame:
    """Exact mean silhouette and Davies-Bouldin index, Euclidean. The silhouette needs every row's mean distance to every cluster:
    each pair of blocks of rows is one task's work and returns sums by cluster, never the pairs."""
    sq = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x)
    blocks = max(1, -(-vectors.count() // block))
    v = vectors.select("id", F.col(label).cast("long").alias("l"), "embedding", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("o"))
    rows, base = v.withColumnsRenamed({"own": "p", "o": "q"}), v.withColumnsRenamed({"own": "q", "o": "p"})
    means = rows.groupBy("p", "q").cogroup(base.groupBy("p", "q")).applyInPandas(_distance_sums, "id long, l long, l2 long, s double, n double").groupBy("id", "l", "l2").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    own = means.filter("l = l2").select("id", F.when(F.col("n") > 1, F.col("s") / (F.col("n") - 1)).alias("a"))
    other = means.filter("l <> l2").groupBy("id").agg(F.min(F.col("s") / F.col("n")).alias("b"))
    sil = own.join(other, "id").agg(F.avg(F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))).alias("silhouette"))
    from loomwork.operators.knn import centroids

    c = centroids(vectors, label)
    spread = vectors.join(c, label).withColumn("d", F.sqrt(sq("embedding", "centroid"))).groupBy(label).agg(F.avg("d").alias("s"))
    k = c.join(spread, label)
    pairs = k.toDF("l1", "c1", "s1").join(k.toDF("l2", "c2", "s2"), F.col("l1") != F.col("l2")).withColumn("r", (F.col("s1") + F.col("s2")) / F.sqrt(sq("c1", "c2")))
    db = pairs.groupBy("l1").agg(F.max("r").alias("r")).agg(F.avg("r").alias("davies_bouldin"))
    return sil.crossJoin(db)


def wcss(vectors: DataFrame, label: str = "label") -> DataFrame:
    from loomwork.operators.knn import centroids

    sq = F.aggregate(F.zip_with("embedding", "centroid", lambda x, y: (x.cast("double") - y) ** 2), F.lit(0.0), lambda s, x: s + x)
    return vectors.join(centroids(vectors, label), label).groupBy(label).agg(F.sum(sq).alias("wcss"), F.count("*").alias("n"))


def kmeans_topics(vectors: DataFrame, k: int, seed: int = 42) -> DataFrame:
    v = vectors.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    return KMeans(k=k, seed=seed, maxIter=20, predictionCol="cluster").fit(v).transform(v).select("id", "cluster")


def pca(vectors: DataFrame, k: int = 2) -> DataFrame:
    """(id, coordinates, error): scores on the first k components and the mean squared reconstruction error."""
    mean = vectors.select(F.posexplode("embedding").alias("p", "x")).groupBy("p").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("mean"))
    v = vectors.crossJoin(F.broadcast(mean)).withColumn("z", F.zip_with("embedding", "mean", lambda x, m: x.cast("double") - m))
    v = v.withColumn("features", array_to_vector("z"))
    out = PCA(k=k, inputCol="features", outputCol="scores").fit(v).transform(v).withColumn("coordinates", vector_to_array("scores"))
    return out.select("id", "coordinates", ((dot("z", "z") - dot("coordinates", "coordinates")) / F.size("z")).alias("error"))


def robust_z(df: DataFrame, value: str, threshold: float = 3.0) -> DataFrame:
    """(value - median) / (1.4826 MAD + 1e-12) and whether it exceeds the threshold."""
    med = df.agg(F.median(value).alias("med"))
    d = df.crossJoin(F.broadcast(med)).withColumn("dev", F.abs(F.col(value) - F.col("med")))
    mad = d.agg(F.median("dev").alias("mad"))
    z = (F.col(value) - F.col("med")) / (1.4826 * F.col("mad") + 1e-12)
    return d.crossJoin(F.broadcast(mad)).withColumn("robust_z", z).withColumn("anomaly", F.round("robust_z", 6) > threshold).drop("med", "dev", "mad")


def knn_distance(neighbors: DataFrame) -> DataFrame:
    """Mean Euclidean distance to the neighbours of unit vectors, from their inner products."""
    return neighbors.groupBy(F.col("src").alias("id")).agg(F.avg(F.sqrt(F.greatest(2 - 2 * F.col("sim"), F.lit(0.0)))).alias("mean_distance"))


def lof(neighbors: DataFrame, k: int) -> DataFrame:
    """Local outlier factor from (src, dst, sim, rank)."""
    d = neighbors.select("src", "dst", F.sqrt(F.greatest(2 - 2 * F.col("sim"), F.lit(0.0))).alias("d"), "rank")
    kd = d.groupBy(F.col("src").alias("dst")).agg(F.max("d").alias("kd"))
    lrd = d.join(kd, "dst").groupBy("src").agg((1 / (F.avg(F.greatest("d", "kd")) + 1e-12)).alias("lrd"))
    j = d.join(lrd.withColumnsRenamed({"src": "dst", "lrd": "other"}), "dst").groupBy("src").agg(F.avg("other").alias("other")).join(lrd, "src")
    return j.select(F.col("src").alias("id"), (F.col("other") / F.col("lrd")).alias("lof"))


def series(units: DataFrame) -> DataFrame:
    """(unit, values): each (country, topic)'s values by year."""
    v = F.transform(F.array_sort(F.collect_list(F.struct("year", "value"))), lambda s: s["value"])
    return units.groupBy(F.concat_ws("|", "country", "topic").alias("unit")).agg(v.alias("values"))


def z_normalize(units: DataFrame) -> DataFrame:
    """Values less their unit's mean over its population deviation; 0 for constant units."""
    w = Window.partitionBy("country", "topic")
    sd = F.stddev_pop("value").over(w)
    return units.withColumn("z", F.when(F.round(sd, 12) > 0, (F.col("value") - F.avg("value").over(w)) / sd).otherwise(0.0))


def dtw(a: np.ndarray, b: np.ndarray) -> float:
    """Dynamic time warping distance: the root of the least sum of squared differences along a path."""
    prev = np.full(len(b) + 1, np.inf)
    prev[0] = 0.0
    for x in a:
        cur = np.full(len(b) + 1, np.inf)
        cost = (x - b) ** 2
        for j in range(1, len(b) + 1):
            cur[j] = cost[j - 1] + min(prev[j], prev[j - 1], cur[j - 1])
        prev = cur
    return float(np.sqrt(prev[-1]))


def pairwise(units: DataFrame, mode: str = "dtw") -> DataFrame:
    """(a, b, distance) of each pair of units, a < b: dtw, euclidean, or shape (1 - Pearson)."""
    s = series(units)
    pairs = s.toDF("a", "x").join(s.toDF("b", "y"), F.col("a") < F.col("b"))

    def run(it):
        for pdf in it:
            out = []
            for x, y in zip(pdf["x"], pdf["y"], strict=True):
                p, q = np.asarray(x, float), np.asarray(y, float)
                if mode == "dtw":
                    out.append(dtw(p, q))
                elif mode == "shape":
                    out.append(1 - float(np.corrcoef(p, q)[0, 1]) if p.std() > 0 and q.std() > 0 else 1.0)
                else:
                    out.append(float(np.linalg.norm(p - q)))
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "distance": out})

    return pairs.mapInPandas(run, "a string, b string, distance double")


def linkage(d: np.ndarray, method: str = "average") -> list[tuple[int, int, float, int]]:
    """Agglomerative merges (left, right, height, size) of a distance matrix by the Lance-Williams rule; new nodes are n, n + 1, ..."""
    if method not in ("single", "complete", "average", "ward"):
        raise ValueError(f"unknown linkage {method!r}")
    n = len(d)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, name, out = np.ones(n), list(range(n)), []
    for step in range(n - 1):
        i, j = divmod(int(np.argmin(d)), n)
        i, j = min(i, j), max(i, j)
        h, ni, nj = d[i, j], size[i], size[j]
        if method == "ward":  # of distances, not their squares; right for Euclidean ones
            with np.errstate(invalid="ignore"):
                row = np.sqrt(((ni + size) * d[i] ** 2 + (nj + size) * d[j] ** 2 - size * h * h) / (ni + nj + size))
        else:
            row = {"single": np.minimum(d[i], d[j]), "complete": np.maximum(d[i], d[j]), "average": (ni * d[i] + nj * d[j]) / (ni + nj)}[method]
        row[~np.isfinite(d[i]) | ~np.isfinite(d[j])] = np.inf
        out.append((min(name[i], name[j]), max(name[i], name[j]), float(h), int(ni + nj)))
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i], name[i] = ni + nj, n + step
    return out


def cut_tree(merges: list[tuple[int, int, float, int]], n: int, k: int) -> np.ndarray:
    """Labels of the k clusters left after the first n - k merges, largest first."""
    owner = {i: [i] for i in range(n)}
    for step, (a, b, _, _) in enumerate(merges[: max(0, n - k)]):
        owner[n + step] = owner.pop(a) + owner.pop(b)
    labels = np.zeros(n, int)
    for c, members in enumerate(sorted(owner.values(), key=lambda m: (-len(m), min(m)))):
        labels[members] = c
    return labels


def agglomerative_sweep(distances: DataFrame, ks: list[int], method: str = "average", most: int = 5000) -> DataFrame:
    """(k, silhouette, largest, smallest, entropy) of the tree cut at each k. Clustering of one matrix is one task's work: over `most` units it
    fails loudly."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["a"]) | set(pdf["b"]))
        n = len(names)
        if n > most:
            raise ValueError(f"{n} units; at most {most} are clustered")
        at = {u: i for i, u in enumerate(names)}
        d = np.zeros((n, n))
        i, j = pdf["a"].map(at).to_numpy(), pdf["b"].map(at).to_numpy()
        d[i, j] = d[j, i] = pdf["distance"]
        merges, out = linkage(d, method), []
        for k in [k for k in ks if 2 <= k < n]:
            lab = cut_tree(merges, n, k)
            sizes = np.bincount(lab)
            sums = np.stack([d[:, lab == c].sum(axis=1) for c in range(k)], axis=1)
            own = sums[np.arange(n), lab] / np.maximum(sizes[lab] - 1, 1)
            mean = sums / sizes
            mean[np.arange(n), lab] = np.inf
            b = mean.min(axis=1)
            s = np.where(sizes[lab] == 1, 0.0, (b - own) / np.maximum(np.maximum(own, b), 1e-12))
            p = sizes / n
            out.append((k, float(s.mean()), int(sizes.max()), int(sizes.min()), float(-(p * np.log(p)).sum())))
        return pd.DataFrame(out, columns=["k", "silhouette", "largest", "smallest", "entropy"])

    return distances.withColumn("g", F.lit(1)).groupBy("g").applyInPandas(lambda p: run(p), "k long, silhouette double, largest long, smallest long, entropy double")


def best_k(sweep: DataFrame) -> DataFrame:
    """The row with the least Davies-Bouldin index where the sweep has one, then the largest silhouette, then the least k."""
    return sweep.orderBy(*[F.asc_nulls_last("davies_bouldin")] * ("davies_bouldin" in sweep.columns), F.desc_nulls_last("silhouette"), "k").limit(1)
