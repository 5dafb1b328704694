"""Substring dedup with repeated-phrase automata.

0. Rows of equal text are dealt to one chunk of documents, where all but the first lose every window at once; a text with
   very many copies is salted over several chunks.
1. Each document's 13-word windows are grouped by their anchor, the least hash of the 6-word phrases in the
   window. Equal windows have equal anchors, and only about two words in nine start a new one.
2. Anchors that two documents share are the recurring ones; every chunk of documents hears which of its own are.
3. The stretches of text around recurring anchors are sent to the anchor's shard, each distinct stretch once for
   a chunk. The shard confirms the windows that recur, compiles them into an Aho-Corasick automaton over word
   codes and streams every stretch through it, which locates each occurrence with the least doc_id that has it.
   An anchor that very many chunks share is dealt by whole windows instead, so no shard gets all of its stretches.
4. The chunks apply the answers to their documents.

All exchanges are keyed by a hash of the chunk, the bucket or the shard, whose numbers follow the input's size.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import gram_hashes, hash_words, mix, parts_for, table, utf8, words_of

WINDOW, PHRASE = 13, 6
CHUNK_MB = 4
#: An anchor in more chunks than this is dealt by whole windows.
HOT_CHUNKS = 32
#: Copies of one text that go to one chunk; beyond COPIES x MANY_COPIES rows, rows / MANY_COPIES of them.
COPIES, MANY_COPIES = 1000, 1_000_000
#: Words that one automaton is built over at a time; a larger shard is cut between anchors.
AUTOMATON_WORDS = 300_000

ASK = "bucket int, chunk int, keys binary, many binary"
TELL = "chunk int, kind int, seg int, a binary, b binary"
SEGMENT = "shard int, key long, chunk int, seg int, low long, high long, words binary"
KEPT = "doc_id long, n_words long, n_removed long, kept string"


class _Chunk:
    """A chunk's words, windows and anchors."""

    def __init__(self, docs: pa.Table, window: int, phrase: int):
        self.raw, ends = utf8(docs.column("text"))
        self.starts, self.stops, self.first = words_of(self.raw, ends)
        ids = docs.column("doc_id")
        self.known = ~ids.is_null().to_numpy() if hasattr(ids, "is_null") else np.ones(len(ids), bool)
        self.ids = ids.fill_null(0).to_numpy()
        self.copy = self._copies(ends)
        n = len(self.starts)
        doc = np.repeat(np.arange(len(self.ids)), np.diff(self.first))
        if n < window:
            self.at = np.zeros(0, np.int64)
            self.key = self.whole = np.zeros(0, np.uint64)
            self.doc = np.zeros(0, np.int64)
            return
        h = hash_words(self.raw, self.starts, self.stops)
        least = gram_hashes(h, phrase)
        span, have = window - phrase + 1, 1
        while have < span:  # the least of span phrases, by doubling
            step = min(have, span - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        inside = (doc[: n - window + 1] == doc[window - 1 :]) & (self.known & ~self.copy)[doc[: n - window + 1]]
        self.at = np.flatnonzero(inside)
        self.key, self.doc = least[self.at], doc[self.at]
        self.whole = gram_hashes(h, window)[self.at]

    def _copies(self, ends: np.ndarray) -> np.ndarray:
        """The rows whose whole text a smaller doc_id of the chunk has: every window of theirs starts there too."""
        raw = self.raw.tobytes()
        texts = [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        least: dict[bytes, int] = {}
        for t, i, known in zip(texts, self.ids.tolist(), self.known.tolist(), strict=True):
            if known:
                least[t] = min(i, least.get(t, i))
        return np.array([k and least[t] < i for t, i, k in zip(texts, self.ids.tolist(), self.known.tolist(), strict=True)], bool)

    def segments(self, recurring: np.ndarray, hot: np.ndarray, window: int):
        """Stretches of windows whose anchor recurs: (key, first window, count of windows, document) each, and the
        sorted distinct (key, text) with each stretch's place among them."""
        here = _member(self.key, recurring)
        at, key, doc = self.at[here], self.key[here], self.doc[here]
        if not len(at):
            return [], [], np.zeros(0, np.int64), at, at, doc
        single = _member(key, hot)
        key = np.where(single, self.whole[here], key)
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | single[1:] | single[:-1]
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, len(at)))
        a, b = self.starts[at[begin]], self.stops[at[begin] + count + window - 2]
        raw = self.raw.tobytes()
        texts = [(k, b" ".join(raw[i:j].split())) for k, i, j in zip(key[begin].tolist(), a.tolist(), b.tolist(), strict=True)]
        names = sorted(set(texts))
        place = {t: i for i, t in enumerate(names)}
        return names, texts, np.fromiter((place[t] for t in texts), np.int64, len(texts)), at[begin], count, doc[begin]


def _member(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), bool)
    i = np.searchsorted(ordered, x)
    return ordered[np.minimum(i, len(ordered) - 1)] == x


def _numbers(column, dtype) -> np.ndarray:
    parts = [np.frombuffer(x, dtype) for x in column.to_pylist() if x]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def _ask(buckets: int, window: int, phrase: int):
    def run(docs: pa.Table) -> pa.Table:
        chunk = docs.column("chunk")[0].as_py()
        c = _Chunk(docs, window, phrase)
        order = np.argsort(c.key, kind="stable")
        key, ids = c.key[order], c.ids[c.doc[order]]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        many = (np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)) if len(first) else np.zeros(0, bool)
        key = key[first]
        bucket = (mix(key) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist() if len(bucket) else []  # only buckets that have keys
        rows = [(int(bucket[i]), key[order[i:j]].tobytes(), many[order[i:j]].tobytes()) for i, j in zip(cuts, [*cuts[1:], len(bucket)], strict=True)]
        return pa.table(
            {
                "bucket": pa.array([r[0] for r in rows], pa.int32()),
                "chunk": pa.array([chunk] * len(rows), pa.int32()),
                "keys": pa.array([r[1] for r in rows], pa.binary()),
                "many": pa.array([r[2] for r in rows], pa.binary()),
            }
        )

    return run


def _tell(rows: pa.Table) -> pa.Table:
    """Which keys of a bucket recur, told to each chunk that asked; b holds those that are hot."""
    chunks, blobs = rows.column("chunk").to_pylist(), [np.frombuffer(x, np.uint64) for x in rows.column("keys").to_pylist()]
    keys, many = np.concatenate(blobs), _numbers(rows.column("many"), bool)
    every, back, n = np.unique(keys, return_inverse=True, return_counts=True)
    often = n >= 2
    often[back[many]] = True
    hot = n > HOT_CHUNKS
    out, at = [], 0
    for chunk, blob in zip(chunks, blobs, strict=True):
        here = back[at : at + len(blob)]
        at += len(blob)
        if (r := blob[often[here]]).size:
            out.append((chunk, r.tobytes(), blob[hot[here]].tobytes()))
    return pa.table(
        {
            "chunk": pa.array([x[0] for x in out], pa.int32()),
            "kind": pa.array([0] * len(out), pa.int32()),
            "seg": pa.array([0] * len(out), pa.int32()),
            "a": pa.array([x[1] for x in out], pa.binary()),
            "b": pa.array([x[2] for x in out], pa.binary()),
        }
    )


def _told(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    rows = rows.filter(pa.compute.equal(rows.column("kind"), 0))
    return np.sort(_numbers(rows.column("a"), np.uint64)), np.sort(_numbers(rows.column("b"), np.uint64))


def _cut(shards: int, window: int, phrase: int):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        names, key, low, high = [], np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(docs) and len(told):
            c = _Chunk(docs, window, phrase)
            names, _, place, _, _, doc = c.segments(*_told(told), window)
            if names:
                ids = c.ids[doc]
                low, high = np.full(len(names), np.iinfo(np.int64).max), np.full(len(names), np.iinfo(np.int64).min)
                np.minimum.at(low, place, ids)
                np.maximum.at(high, place, ids)
                key = np.array([k for k, _ in names], np.uint64)
        chunk = docs.column("chunk")[0].as_py() if len(docs) else 0
        return pa.table(
            {
                "shard": pa.array((mix(key) % np.uint64(shards)).astype(np.int32)),
                "key": pa.array(key.view(np.int64)),
                "chunk": pa.array(np.full(len(names), chunk, np.int32)),
                "seg": pa.array(np.arange(len(names), dtype=np.int32)),
                "low": pa.array(low),
                "high": pa.array(high),
                "words": pa.array([w for _, w in names], pa.binary()),
            }
        )

    return run


def _letter(n: int) -> str:
    """The n-th code point that is neither 0 nor a surrogate."""
    return chr(n + 1 if n < 0xD000 else n + 0x1000)


def _locate(lows: list, highs: list, texts: list, window: int) -> list[tuple[bytes, bytes] | None]:
    """For each stretch the offsets of its windows that a document below its highest one has, and the least such
    document: the windows of the stretches that recur are compiled to an automaton, and every stretch runs through it."""
    codes: dict[bytes, str] = {}
    coded, seen = [], {}
    for low, high, text in zip(lows, highs, texts, strict=True):
        s = "".join([codes.get(w) or codes.setdefault(w, _letter(len(codes))) for w in text.split(b" ")])
        coded.append(s)
        for o in range(len(s) - window + 1):
            w = s[o : o + window]
            old = seen.get(w)
            seen[w] = (low, high) if old is None else (min(low, old[0]), max(high, old[1]))
    machine = ahocorasick.Automaton()
    for w, (low, high) in seen.items():
        if low < high:
            machine.add_word(w, low)
    del seen
    if not len(machine):
        return [None] * len(texts)
    machine.make_automaton()
    out: list[tuple[bytes, bytes] | None] = []
    for s, high in zip(coded, highs, strict=True):
        found = [(end - window + 1, low) for end, low in machine.iter(s) if low < high]
        out.append((np.array([f[0] for f in found], np.int32).tobytes(), np.array([f[1] for f in found], np.int64).tobytes()) if found else None)
    return out


def _shard(window: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("key")
        key = rows.column("key").to_numpy()
        size = np.array([len(x) for x in rows.column("words").to_pylist()]) // 5 + 1
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])).tolist() + [len(key)]
        out, at, total = [], 0, np.append(0, np.cumsum(size))
        for i, j in zip(starts[:-1], starts[1:], strict=True):
            if j < len(key) and total[j] - total[at] < AUTOMATON_WORDS:
                continue
            part = rows.slice(at, j - at)
            found = _locate(part.column("low").to_pylist(), part.column("high").to_pylist(), part.column("words").to_pylist(), window)
            out += [(c, s, *f) for c, s, f in zip(part.column("chunk").to_pylist(), part.column("seg").to_pylist(), found, strict=True) if f]
            at = j
        return pa.table(
            {
                "chunk": pa.array([x[0] for x in out], pa.int32()),
                "kind": pa.array([1] * len(out), pa.int32()),
                "seg": pa.array([x[1] for x in out], pa.int32()),
                "a": pa.array([x[2] for x in out], pa.binary()),
                "b": pa.array([x[3] for x in out], pa.binary()),
            }
        )

    return run


def _apply(window: int, phrase: int):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        c = _Chunk(docs, window, phrase)
        gone = np.zeros(len(c.starts) + 1, np.int64)
        answers = told.filter(pa.compute.equal(told.column("kind"), 1)) if len(told) else told
        if len(docs) and len(answers):
            names, _, place, begin, _, doc = c.segments(*_told(told), window)
            found = dict(zip(answers.column("seg").to_pylist(), zip(answers.column("a").to_pylist(), answers.column("b").to_pylist(), strict=True), strict=True))
            for p, i, d in zip(place.tolist(), begin.tolist(), c.ids[doc].tolist(), strict=True):
                if (f := found.get(p)) is not None:
                    hit = np.frombuffer(f[0], np.int32)[np.frombuffer(f[1], np.int64) < d] + i
                    gone[hit] += 1  # a stretch's offsets are distinct
                    gone[hit + window] -= 1
        raw, n = c.raw.tobytes(), np.diff(c.first)
        lost = (np.cumsum(gone[:-1]) > 0) | np.repeat(c.copy & (n >= window), n)
        ends = np.append(0, np.cumsum(lost))[c.first]
        kept = []
        for i, j, x in zip(c.first[:-1].tolist(), c.first[1:].tolist(), np.diff(ends).tolist(), strict=True):
            if i == j or x == j - i:
                kept.append("")
            elif x:
                stay = np.flatnonzero(~lost[i:j]) + i
                kept.append(b" ".join([raw[a:b] for a, b in zip(c.starts[stay].tolist(), c.stops[stay].tolist(), strict=True)]).decode())
            else:
                kept.append(b" ".join(raw[c.starts[i] : c.stops[j - 1]].split()).decode())
        return pa.table({"doc_id": docs.column("doc_id").cast(pa.int64()), "n_words": pa.array(n.astype(np.int64)), "n_removed": pa.array(np.diff(ends).astype(np.int64)), "kept": pa.array(kept, pa.string())})

    return run


def _dealt(rows: DataFrame, chunks: int) -> DataFrame:
    """rows with their chunk: that of their text, and for a text with more than `most` copies one of several. Fewer than
    MANY_COPIES texts can have so many, whatever the input, so their list is broadcast."""
    rows = rows.withColumn("h", F.xxhash64("text"))
    most = max(COPIES, rows.count() // MANY_COPIES)
    many = rows.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("h", F.ceil(F.col("n") / most).alias("salts"))
    salt = F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.col("salts"))).otherwise(0)
    return rows.join(F.broadcast(many), "h", "left").select("doc_id", "text", F.pmod(F.xxhash64("h", salt), F.lit(chunks)).cast("int").alias("chunk"))


def drop_repeated_passages(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept has the words, joined by one space, that no window covers whose
    words also start in a document of a smaller doc_id. Windows are judged on the input.

    A word is a run of bytes other than ASCII white space. Null and empty texts have no words. Rows of a null
    doc_id stay whole and make no other row lose anything. Rows with one doc_id count as one document, so
    they take nothing from each other. A very long text is one row of one chunk, in the memory of its words. Other columns
    of docs are left out.
    """
    chunks = parts_for(docs, CHUNK_MB, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = _dealt(rows, chunks)
    asked = rows.groupBy("chunk").applyInArrow(_ask(max(8, chunks // 4), window, phrase), ASK)
    told = asked.groupBy("bucket").applyInArrow(_tell, TELL)
    pieces = rows.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_cut(chunks, window, phrase), SEGMENT)
    located = pieces.groupBy("shard").applyInArrow(_shard(window), TELL)
    return rows.groupBy("chunk").cogroup(told.unionByName(located).groupBy("chunk")).applyInArrow(_apply(window, phrase), KEPT)


def op1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_passages(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


#: A window's words joined by single spaces stand for its sequence: words hold no white space.
OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT rid, doc_id, unnest(range(1, len(ws) - 11)) AS p, ws FROM d WHERE len(ws) >= 13),
k AS (SELECT rid, doc_id, p, array_to_string(ws[p:p + 12], ' ') AS s FROM w),
m AS (SELECT s, min(doc_id) AS low FROM k GROUP BY s),
h AS (SELECT DISTINCT rid, unnest(range(p, p + 13)) AS i FROM k JOIN m USING (s) WHERE m.low < k.doc_id),
a AS (SELECT rid, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM d),
r AS (SELECT a.rid, count(*) AS n_words, count(h.i) AS n_removed, string_agg(word, ' ' ORDER BY a.i) FILTER (h.i IS NULL) AS kept
      FROM a LEFT JOIN h ON a.rid = h.rid AND a.i = h.i GROUP BY a.rid)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (rid)
"""
