"""Exact nearest neighbours in groups, and measures on vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.columns import cosine, dot
from loomwork.functions.storage import cut

#: Vectors in a group, on average and at most; a task holds two groups, their neighbours so far and a tile of similarities.
LEAST, MOST = 4096, 65536
#: Groups that are made while they keep LEAST vectors, so that there is work for many tasks.
GROUPS = 8
#: Pairs that a task sets aside before it keeps the best of them.
PENDING = 1_000_000


class _Group:
    """The vectors of one group that differ (or their year or batch), in an order that has nothing to do with their ids, and the ids of each."""

    def __init__(self, rows: pa.Table):
        e = rows["embedding"].combine_chunks()
        x = e.flatten().to_numpy(zero_copy_only=False)
        if e.null_count or len(x) % len(e) or (np.diff(e.offsets.to_numpy()) != len(x) // len(e)).any():
            raise ValueError("vectors must be known and of one length")
        x = x.reshape(len(e), -1)
        whole = np.flatnonzero(np.isfinite(x).all(axis=1))  # others are nobody's neighbours
        x, ids = x[whole], rows["id"].to_numpy()[whole]
        when = np.stack([rows[c].to_numpy()[whole].astype(np.float64) for c in ("year", "batch")], axis=1)
        said = np.concatenate([x.view(np.uint8), when.view(np.uint8)], axis=1)
        _, first, kind = np.unique(said.view(f"V{said.shape[1]}").ravel(), return_index=True, return_inverse=True)
        some = np.random.default_rng(len(first)).permutation(len(first))
        self.x, (self.year, self.batch) = x[first[some]], when[first[some]].T
        self.norm = np.sqrt((self.x.astype(np.float64) ** 2).sum(axis=1))
        kind = np.argsort(some)[kind]
        self.ids = ids[np.lexsort((ids, kind))]
        self.count = np.bincount(kind, minlength=len(first))
        self.start = np.cumsum(self.count) - self.count
        self.least = self.ids[self.start]

    def __len__(self) -> int:
        return len(self.start)

    def members(self, at: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The least ids of each vector (all without most), and the place in `at` that each belongs to."""
        count = self.count[at] if most is None else np.minimum(self.count[at], most)
        place = np.repeat(np.arange(len(at)), count)
        return self.ids[self.start[at][place] + np.arange(len(place)) - (np.cumsum(count) - count)[place]], place


class _Best:
    """The k best of the vectors of `other` for each of own[at:end], ties by their least ids, and the least approximate similarity that may
    still be among them. The k best ids are all among theirs. With `same`, a row's own id counts among k, up to `same` times."""

    def __init__(self, own: _Group, at: int, end: int, other: _Group, k: int, same: int, dtype: type):
        error = (own.x.shape[1] + 8) * np.finfo(dtype).eps  # of an inner product, relative to the norms: twice its length times the unit roundoff
        self.own, self.at, self.other, self.k, self.same = own, at, other, k + same, same
        self.slack = 1e-6 + error * own.norm[at:end] * other.norm.max(initial=0.0)  # of the rounding to 6 digits, and of the arithmetic
        self.floor = np.finfo(dtype).min
        self.least = np.full(end - at, self.floor)
        self.found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.new, self.pending = [], 0

    def _raise(self, rows: np.ndarray, low: np.ndarray) -> None:
        self.least[rows] = np.maximum(self.least[rows], np.nextafter(low.astype(self.least.dtype), self.floor))

    def offer(self, sim: np.ndarray, own: int, other: int) -> None:
        """sim: similarities of own rows from `own` on (its first axis) to others from `other` on; it may be a transposed view."""
        n, m = sim.shape
        rows = slice(own, own + n)
        if (self.least[rows] == self.floor).any():  # the largest of some disjoint parts: as many are at least as similar
            parts = m // max(1, min(16, m // (4 * self.k)))
            if parts >= self.k:
                width = m // parts
                top = sim[:, : parts * width].reshape(n, width, parts).max(axis=1) if sim.flags.c_contiguous else sim.T[: parts * width].reshape(width, parts, n).max(axis=0).T
                low = np.partition(top, parts - self.k, axis=1)[:, parts - self.k]
                self._raise(np.arange(own, own + n), np.where(low > self.floor, low.astype(np.float64) - 2 * self.slack[rows], self.floor))
        if sim.flags.c_contiguous:
            r, c = np.divmod(_true(sim >= self.least[rows, None]), m)
        else:
            c, r = np.divmod(_true(sim.T >= self.least[None, rows]), n)
        self.new.append((r + own, c + other))
        self.pending += len(r)
        if self.pending > PENDING:
            self.settle()

    def settle(self) -> None:
        """Exact similarities of the pairs set aside, and the k best of each row with them."""
        r, c = (np.concatenate([x[i] for x in self.new]) if self.new else np.zeros(0, np.int64) for i in (0, 1))
        self.new, self.pending = [], 0
        sim = np.zeros(len(r))
        for i in range(0, len(r), 16384):
            p, q = (g.x[x[i : i + 16384]].astype(np.float64) for g, x in ((self.own, r + self.at), (self.other, c)))
            sim[i : i + 16384] = np.einsum("ij,ij->i", p, q)
        r, c, sim = (np.concatenate(x) for x in zip(self.found, (r, c, np.round(sim, 6)), strict=True))
        r, c, sim, place = _ranked(r, self.other.least[c], sim, c)
        last = place == self.k - 1
        self._raise(r[last], sim[last] - self.slack[r[last]])
        self.found = tuple(x[place < self.k] for x in (r, c, sim))

    def rows(self) -> pa.RecordBatch:
        self.settle()
        r, c, sim = self.found
        dst, at = self.other.members(c, self.k)
        r, dst, sim, place = _ranked(r[at], dst, sim[at], dst)
        r, dst, sim = (x[place < self.k] for x in (r, dst, sim))
        src, at = self.own.members(r + self.at)
        apart = src != dst[at] if self.same else np.ones(len(src), bool)
        src, at = src[apart], at[apart]
        src, dst, sim, place = _ranked(src, dst[at], sim[at], dst[at])
        return pa.RecordBatch.from_arrays([pa.array(x[place < self.k - self.same]) for x in (src, dst, sim)], names=["src", "dst", "sim"])


def _ranked(row: np.ndarray, tie: np.ndarray, sim: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, what, sim, place) by row, the largest similarity first; the place is that within the row, from 0."""
    order = np.lexsort((tie, -sim, row))
    row = row[order]
    return row, what[order], sim[order], np.arange(len(row)) - np.searchsorted(row, row)


def _true(mask: np.ndarray) -> np.ndarray:
    """Places of the true values, of which there are few."""
    m = mask.ravel()
    n = len(m) // 8 * 8
    some = (np.flatnonzero(m[:n].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([some[m[some]], n + np.flatnonzero(m[n:])])


def _before(a: _Group, i: slice, b: _Group, j: slice, window: int | None) -> np.ndarray:
    """Whether b's vectors may be neighbours of a's: of an earlier year, or of an earlier batch of the year."""
    y, x = a.year[i, None], b.year[None, j]
    ok = (x < y) | (x == y) & (b.batch[None, j] < a.batch[i, None])
    return ok if window is None else ok & (y - x <= window)


def _search(k: int, past: bool, window: int | None):
    """The neighbours of two groups in each other, or of one group in itself, from rows (id, embedding, year, batch, own, mate)."""

    def pair(a: _Group, b: _Group, same: int) -> Iterator[pa.RecordBatch]:
        dtype = np.float64 if max(a.norm.max(), b.norm.max()) > 1e15 else np.float32  # products must not overflow
        p, q = a.x.astype(dtype, copy=False), b.x.astype(dtype, copy=False)
        tall, broad = (max(rows, 4 * (k + same)) for rows in (512, 2048))
        tile = np.empty(min(tall, len(a)) * min(broad, len(b)), dtype)
        sides = [] if same else [_Best(b, 0, len(b), a, k, 0, dtype)]
        for t, at in enumerate(range(0, len(a), tall)):
            i = slice(at, min(at + tall, len(a)))
            best = _Best(a, i.start, i.stop, b, k, same, dtype)
            for u, c in enumerate(range(0, len(b), broad)):
                j = slice(c, min(c + broad, len(b)))
                there, back = (_before(a, i, b, j, window), None if same else _before(b, j, a, i, window).T) if past else (None, None)
                if past and not there.any() and (same or not back.any()):
                    continue
                n, m = len(p[i]), len(q[j])
                sim = np.matmul(p[i], q[j].T, out=tile[: n * m].reshape(n, m))
                best.offer(sim if there is None else np.where(there, sim, -np.inf), 0, c)
                if u & (u + 1) == 0:
                    best.settle()
                for side in sides:
                    side.offer((sim if back is None else np.where(back, sim, -np.inf)).T, c, at)
            if t & (t + 1) == 0:
                for side in sides:
                    side.settle()
            yield best.rows()
        for side in sides:
            yield side.rows()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        rows = pa.Table.from_batches(batches) if batches else None
        if not rows:
            return
        own = rows["own"].to_numpy()
        groups = [_Group(rows.filter(pa.array(own == g))) for g in np.unique(own)]
        if (own == rows["mate"].to_numpy()).all():
            groups, same = groups * 2, int(np.unique(groups[0].ids, return_counts=True)[1].max(initial=0))
        else:
            same = 0
        if len(groups) == 2 and all(map(len, groups)):
            yield from pair(*groups, same)

    return run


def neighbors(vectors: DataFrame, k: int, past: bool = False, window: int | None = None) -> DataFrame:
    """(src, dst, sim, rank): the k vectors of largest inner product (rounded to 6 digits; ties by id) for each of vectors (id, embedding
    [, year, batch]). With past, only those of an earlier year, or of an earlier batch of the year, count. Every pair of
    groups is one task's work, in tiles, and returns k rows for each vector at most, so no list of all pairs exists; a vector is sent once for
    each group. Single precision only tells which pairs can't be among the k; all others are computed in double. The result is written
    once (spark.checkpoint.dir), however often it is used. Equal vectors of a group are searched for once."""
    for c in ("year", "batch"):
        if not past or c not in vectors.columns:
            vectors = vectors.withColumn(c, F.lit(0))
    n = vectors.count()
    groups = max(1, -(-n // MOST), min(GROUPS, -(-n // LEAST)))
    v = vectors.select("id", "embedding", "year", "batch", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("own"))
    v = v.withColumn("mate", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    high, low = F.greatest("own", "mate"), F.least("own", "mate")
    dealt = v.repartitionById(groups * (groups + 1) // 2, (high * (high + 1) / 2 + low).cast("int"))
    found = dealt.mapInArrow(_search(k, past, window), "src long, dst long, sim double")
    w = Window.partitionBy("src").orderBy(F.desc("sim"), "dst")
    return cut(found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k))


def knn_edges(vectors: DataFrame, k: int, tau: float | None = None, mutual: bool = False) -> DataFrame:
    """Undirected edges (i, j, sim), i < j; with mutual only pairs that name each other; tau is the least similarity."""
    n = neighbors(vectors, k)
    if tau is not None:
        n = n.filter(F.col("sim") >= tau)
    e = n.groupBy(F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j")).agg(F.max("sim").alias("sim"), F.count("*").alias("n"))
    return (e.filter("n = 2") if mutual else e).select("i", "j", "sim")


def batches(vectors: DataFrame, size: int) -> DataFrame:
    """Numbers batches of size rows within each year by id: a row sees same-year rows of earlier batches only."""
    return vectors.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("year").orderBy("id")) - 1) / size).cast("int"))


def centroids(vectors: DataFrame, label: str = "label") -> DataFrame:
    """(label, centroid): mean vectors, in the order of the components."""
    long = vectors.select(label, F.posexplode("embedding").alias("p", "x")).groupBy(label, "p").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return long.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("centroid"))


def topic_confidence(vectors: DataFrame, label: str = "label") -> DataFrame:
    """(cosine to the own centroid + 1) / 2, clipped to 0..1; 1 for a label with one member."""
    j = vectors.join(centroids(vectors, label), label).withColumn("n", F.count("*").over(Window.partitionBy(label)))
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cosine("embedding", "centroid") + 1) / 2))
    return j.select("id", label, F.when(F.col("n") == 1, 1.0).otherwise(c).alias("confidence"))


def confidence_check(confidence: DataFrame, label: str = "label", q: float = 0.25) -> DataFrame:
    """Labels whose mean confidence lies below the global quantile."""
    cut = confidence.agg(F.percentile("confidence", q).alias("q25"))
    n = confidence.groupBy(label).agg(F.avg("confidence").alias("mean_confidence")).crossJoin(F.broadcast(cut))
    return n.withColumn("low", F.round("mean_confidence", 9) < F.round("q25", 9))


def topic_neighbors(vectors: DataFrame, k: int = 5, near: float = 0.9, label: str = "label") -> DataFrame:
    """Each label's k nearest other labels by the cosine of their centroids (one row for each label: a small table)."""
    c = centroids(vectors, label)
    a, b = c.withColumnsRenamed({label: "a", "centroid": "x"}), c.withColumnsRenamed({label: "b", "centroid": "y"})
    p = a.join(b, F.col("a") != F.col("b")).select("a", "b", F.round(cosine("x", "y"), 6).alias("sim"))
    return p.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))).filter(F.col("rank") <= k).withColumn("near", F.col("sim") > near)


def semantic_gap(vectors: DataFrame, frontier, min_papers: int = 20, label: str = "label") -> DataFrame:
    """Mean distance (1 - cosine) of the CN and US rows of a label to the unit centroid of its US frontier rows, for labels with min_papers of
    those."""
    f = vectors.filter((F.col("country") == "US") & frontier)
    big = f.groupBy(label).agg(F.count("*").alias("n_frontier")).filter(F.col("n_frontier") >= min_papers)
    j = vectors.join(centroids(f, label), label).join(big, label).withColumn("d", 1 - cosine("embedding", "centroid"))
    mean = lambda c: F.avg(F.when(F.col("country") == c, F.col("d"))).alias(f"dist_{c}")
    return j.groupBy(label).agg(F.max("n_frontier").alias("n_frontier"), mean("CN"), mean("US")).withColumn("semantic_gap", F.col("dist_CN") - F.col("dist_US"))


def representatives(vectors: DataFrame, k: int = 5, label: str = "label") -> DataFrame:
    """The k rows of each label nearest to its centroid."""
    j = vectors.join(centroids(vectors, label), label).withColumn("sim", F.round(cosine("embedding", "centroid"), 6))
    return j.withColumn("rank", F.row_number().over(Window.partitionBy(label).orderBy(F.desc("sim"), "id"))).filter(F.col("rank") <= k).select(label, "id", "sim", "rank")


def norm_check(vectors: DataFrame) -> DataFrame:
    return vectors.select("id", F.sqrt(dot("embedding", "embedding")).alias("norm"))
