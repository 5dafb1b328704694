"""Near-duplicate classes with ProbMinHash.

Each text is a set of five-word shingles. Links are defined on sets, so every shingle has weight 1: weights by count would
drive apart texts whose differing part repeats within one of them. A shingle of weight w sends arrivals of a Poisson
process of rate w, each to a random component, and a component keeps the shingle that comes first: two texts agree
in a component with the probability Jaccard of their weights. A text's arrivals end as soon as every component is
taken and no later one can win. Bands of components give buckets; pairs are verified on the exact shingle sets.

Texts with the same words are one node. In two rounds every node of a bucket is verified against a leader, the
node that shares most buckets with others, so a bucket of n near copies costs about n checks and not n squared.
What these links leave in several classes is settled exactly: of each bucket the nodes outside its largest class
meet all its nodes, in blocks of bounded size, and a block returns links between classes only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import arrow_map, gram_hashes, hash_words, mix, sized, stored, table, utf8, words_of
from loomwork.llm.components import components

SHINGLE, SIMILAR = 5, 0.8
#: At a similarity of 0.8 a pair shares no band with a chance of (1 - 0.8**5)**24, below 1 in 10,000.
BANDS, ROWS = 24, 5
#: Rounds of election over all buckets; nodes and shingles (on average) of a block in the exact settlement of the rest.
ROUNDS, BLOCK, GRAMS = 2, 500, 1_000_000
#: Ids whose texts are needed fall on 2**MARKS marks; a text whose id falls on none is not sent on.
MARKS = 24
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def weighted_shingles(raw: np.ndarray, ends: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: (text's index, hash, count), ordered by text and hash. Only whole k-word runs."""
    starts, stops, first = words_of(raw, ends)
    if len(starts) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = gram_hashes(hash_words(raw, starts, stops), k)
    doc = np.repeat(np.arange(len(ends) - 1), np.diff(first))
    inside = doc[: len(grams)] == doc[k - 1 :]
    doc, grams = doc[: len(grams)][inside], grams[inside]
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1]))) if len(doc) else np.zeros(0, np.int64)
    return doc[new], grams[new], np.diff(np.append(new, len(doc)))


def prob_min_hash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """An (n, m) array: for each of n texts and m components the element whose arrival there comes first.
    Texts without elements have zeros."""
    total = np.bincount(doc, weight, n)
    best, who = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    limit = np.where(total > 0, m * (np.log(m) + 4) / np.maximum(total, 1e-300), 0.0)
    pending = total > 0
    while pending.any():
        here = np.flatnonzero(pending[doc])
        d, e, rate, t, j = doc[here], element[here], weight[here], np.zeros(len(here)), 0
        while len(d):
            j += 1
            u = mix(e + np.uint64(j * int(_GOLD) % 2**64))
            t = t - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
            live = t < limit[d]
            d, e, rate, t, u = d[live], e[live], rate[live], t[live], u[live]
            at = d * m + (mix(u ^ _GOLD) % np.uint64(m)).astype(np.int64)
            np.minimum.at(best, at, t)
            won = t == best[at]
            who[at[won]] = e[won]
            if j <= 4 or j % 8 == 0:
                limit = np.minimum(limit, best.reshape(n, m).max(axis=1))
        pending &= ~np.isfinite(best.reshape(n, m)).all(axis=1)
        limit = np.where(pending, m * (np.log(m) + 4) / np.maximum(total, 1e-300) * 2.0 ** _grow(limit, total, m), limit)
    return who.reshape(n, m)


def _grow(limit: np.ndarray, total: np.ndarray, m: int) -> np.ndarray:
    """How many times the first limit was doubled so far, and once more."""
    first = m * (np.log(m) + 4) / np.maximum(total, 1e-300)
    return np.round(np.log2(np.maximum(limit, first) / first)) + 1


def _signatures(bands: int, rows: int):
    def run(batches):
        for batch in batches:
            for part in sized(pa.Table.from_batches([batch]), "text"):
                raw, ends = utf8(part.column("text"))
                doc, element, _ = weighted_shingles(raw, ends)
                n = len(part)
                who = prob_min_hash(doc, element, np.ones(len(doc)), n, bands * rows).reshape(n, bands, rows)
                keys = np.zeros((n, bands), np.uint64)
                for r in range(rows):
                    keys = mix(keys * _GOLD + who[:, :, r])
                keys = mix(keys + np.arange(bands, dtype=np.uint64)).view(np.int64)
                has = np.bincount(doc, minlength=n) > 0
                text = raw.tobytes()
                words = [b" ".join(text[a:b].split()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id").combine_chunks().cast(pa.int64()),
                        "digest": pa.array([xxhash.xxh3_128_digest(w) if w else None for w in words], pa.binary()),
                        "size": pa.array(np.bincount(doc, minlength=n), pa.int64()),
                        "keys": pa.array([k.tolist() if h else None for k, h in zip(keys, has, strict=True)], pa.list_(pa.int64())),
                    }
                )

    return run


def _places(ids: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return (mix(ids.cast(pa.int64()).to_numpy().view(np.uint64)) >> np.uint64(64 - MARKS)).astype(np.int64)


def _mark(batches):
    marked = np.zeros(1 << MARKS, bool)
    for batch in batches:
        marked[_places(batch.column("id"))] = True
    bits = np.packbits(marked).view(np.int64)
    here = np.flatnonzero(bits)
    yield pa.RecordBatch.from_pydict({"k": pa.array(here, pa.int64()), "bits": pa.array(bits[here], pa.int64())})


def marks(ids: DataFrame) -> np.ndarray:
    """The marks of ids (id), as packed bits: 2**MARKS of them whatever the number of ids."""
    rows = arrow_map(ids, _mark, "k long, bits long").groupBy("k").agg(F.bit_or("bits").alias("bits")).toArrow()  # 2**(MARKS - 6) rows at most
    out = np.zeros(1 << MARKS - 6, np.int64)
    out[rows.column("k").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint8)


def _sets(marks_shared):
    """Shingle sets of the rows whose id has a mark: all that are asked for, and few others."""

    def run(batches):
        marked = marks_shared.value
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows.filter(rows.column("doc_id").is_valid())
            at = _places(rows.column("doc_id"))
            rows = rows.filter(pa.array(marked[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1))
            for part in sized(rows, "text"):
                doc, grams, _ = weighted_shingles(*utf8(part.column("text")))
                cuts = np.searchsorted(doc, np.arange(len(part) + 1))
                yield pa.RecordBatch.from_pydict({"id": part.column("doc_id").combine_chunks().cast(pa.int64()), "grams": pa.array([grams[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})

    return run


def _compare(batches):
    for batch in batches:
        out = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = 0
            if min(len(p), len(q)) >= 0.5 * max(len(p), len(q)):  # else the similarity is below 0.5, and its bound is told
                i = np.minimum(np.searchsorted(p, q), len(p) - 1)
                both = int((p[i] == q).sum()) if len(p) else 0
                out.append(both / max(1, len(p) + len(q) - both))
            else:
                out.append(min(len(p), len(q)) / max(1, max(len(p), len(q))))
        yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b"), "sim": pa.array(out, pa.float64())})


class _Checker:
    """Similarities of pairs of nodes; the shingle sets lie in the shared folder."""

    def __init__(self, sets: DataFrame):
        self.sets = sets

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """(a, b, sim) of the distinct pairs (a, b). The side of a leader with very many members is joined last, where
        the join may split them."""
        left = pairs.select("a", "b").distinct().join(self.sets.select(F.col("id").alias("b"), F.col("grams").alias("y")), "b")
        both = left.join(self.sets.select(F.col("id").alias("a"), F.col("grams").alias("x")), "a")
        return stored(arrow_map(both.select("a", "b", "x", "y"), _compare, "a long, b long, sim double"), "checked")


def _settle(rows: pa.Table) -> pa.Table:
    """Links (a, b) between the classes of one block's nodes: those marked rest against all, by exact similarity. Shingles
    of one node only count in its size. A forest: fewer links than the block has classes."""
    rest = np.array(rows.column("rest").to_pylist(), bool)
    named = rows.column("c").to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in rows.column("grams").to_pylist()]
    size = np.array([len(x) for x in sets], np.int64)
    _, gram, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[gram]
    node = np.repeat(np.arange(len(sets)), size)[place >= 0]
    place = place[place >= 0]
    order = np.argsort(place, kind="stable")
    node, place = node[order], place[order]
    both, left = np.zeros((int(rest.sum()), len(sets)), np.float64), np.flatnonzero(rest)
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, 2048):
        i, j = np.searchsorted(place, [at, at + 2048])
        has = np.zeros((len(sets), 2048), np.float32)
        has[node[i:j], place[i:j] - at] = 1
        both += has[left] @ has.T
    linked = (both / np.maximum(size[left][:, None] + size[None, :] - both, 1) >= SIMILAR) & (named[left][:, None] != named[None, :])
    p, q = np.nonzero(linked)
    root, out = {}, []

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in np.unique(np.stack([named[left[p]], named[q]], 1), axis=0).tolist():
        if (x := find(a)) != (y := find(b)):
            root[x] = y
            out.append((a, b))
    return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})


def _elections(members: DataFrame, check: _Checker) -> list[DataFrame]:
    """ROUNDS rounds in each bucket of members (key, id, degree): checked (key, a, b, sim). Who fails the first leader
    elects another."""
    rounds, left = [], members
    for _ in range(ROUNDS):  # whatever is used twice is written, so that no plan holds those before it
        heads = left.groupBy("key").agg(F.max(F.struct("degree", "id")).alias("top"), F.count("*").alias("n")).filter("n > 1")
        asked = left.join(heads.select("key", F.col("top.id").alias("a")), "key").filter("id <> a").select("key", "a", F.col("id").alias("b"))
        asked = stored(asked, "asked")
        done = stored(asked.join(check(asked), ["a", "b"]).select("key", "a", "b", "sim"), "round")
        rounds.append(done)
        failed = done.filter(F.col("sim") < SIMILAR).select("key", F.col("b").alias("id"))
        left = stored(members.join(failed, ["key", "id"]), "left") if len(rounds) < ROUNDS else None
    return rounds


def _blocks(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Blocks (key, i, j, id, c, rest) in which all pairs of a bucket meet that are of different classes c. Buckets of
    one class have none; of buckets with the same nodes one is taken."""
    named = stored(members.join(classes, "id", "left").select("key", "id", "size", F.coalesce("class_id", "id").alias("c")), "named")
    parts = named.groupBy("key", "c").agg(F.count("*").alias("n"), F.sum("size").alias("s"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    buckets = parts.groupBy("key").agg(
        F.count("*").alias("classes"), F.max(F.struct("n", "c")).alias("main"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")
    ).filter("classes > 1 and n > 2")  # two nodes have met in the election
    once = buckets.groupBy("n", "s", "x", "y").agg(F.min_by(F.struct("key", F.col("main.c").alias("most"), (F.col("n") - F.col("main.n")).alias("rests")), "key").alias("k"))
    cut = lambda n: F.greatest(F.ceil(n / BLOCK), F.ceil(F.col("s") / GRAMS)).cast("int")
    plan = once.select("k.key", "k.most", cut(F.col("k.rests")).alias("r"), cut(F.col("n")).alias("m"))
    placed = stored(named.join(plan, "key"), "placed")
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = placed.filter("c <> most").select("key", mine("r").alias("i"), every("m").alias("j"), "id", "c", F.lit(True).alias("rest"))
    return placed.select("key", every("r").alias("i"), mine("m").alias("j"), "id", "c", F.lit(False).alias("rest")).unionByName(rest)


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id), one row for each row of docs: class_id is the least doc_id that a chain of links reaches.

    Two texts are linked if their words are the same or the sets of their five-word shingles have a Jaccard
    similarity of 0.8 or more. Texts of fewer than five words are linked to equal ones only. Texts without
    words (null, empty, white space) are alone. Rows of a null doc_id have a null class. Rows of one doc_id are one node.
    Other columns are left out.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marked = stored(arrow_map(rows, _signatures(BANDS, ROWS), "doc_id long, digest binary, size long, keys array<long>"), "signatures")
    nodes = marked.filter("doc_id is not null and digest is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "size", "keys")).alias("least"))
    nodes = stored(nodes.select("digest", F.col("least.doc_id").alias("id"), F.col("least.size").alias("size"), F.col("least.keys").alias("keys")), "nodes")
    keyed = nodes.filter("keys is not null").select("id", "size", F.explode(F.array_distinct("keys")).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = stored(keyed.join(shared, "key"), "members")
    members = stored(members.select("id", "size", "key").join(members.groupBy("id").agg(F.sum("n").alias("degree")), "id"), "degrees")

    # texts are found where they lie, by marks; sets of others whose ids share a mark are joined to nothing below
    needed = rows.sparkSession.sparkContext.broadcast(marks(members.select("id").distinct()))
    sets = stored(arrow_map(rows, _sets(needed), "id long, grams binary"), "sets")
    needed.destroy()
    check = _Checker(sets)
    links = _union([r.filter(F.col("sim") >= SIMILAR).select("a", "b") for r in _elections(members, check)])
    classes = stored(components(links), "classes")
    met = _blocks(members, classes).join(sets, "id").groupBy("key", "i", "j").applyInArrow(_settle, "a long, b long")
    joined = components(stored(met, "met")).select(F.col("id").alias("class_id"), F.col("class_id").alias("least"))  # met links classes
    of_node = nodes.select("digest", "id").join(classes, "id", "left").select("digest", F.coalesce("class_id", "id").alias("class_id"))
    of_node = of_node.join(joined, "class_id", "left").select("digest", F.coalesce("least", "class_id").alias("class_id"))
    return marked.select("doc_id", "digest").join(of_node, "digest", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def op10_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))
