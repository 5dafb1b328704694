"""Document fingerprints from content-defined chunks.

A gear hash of the last 32 bytes decides where a chunk may end, with a strict mask up to the normal size and a loose
one beyond it (normalised chunking), so boundaries depend on the content around them and come back after an
edit. A fingerprint lists the distinct chunks' digests with their lengths; the likeness of one to another is the
share of its bytes whose chunks the other holds too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import arrow_map, mix, parts_for, table

#: Bytes of a chunk: least, normal, most. Bits that must be 0 before and after the normal size.
LEAST, NORMAL, MOST = 32, 64, 256
STRICT, LOOSE = np.uint32(0xFE000000), np.uint32(0xF8000000)
#: Hex digits of a chunk's digest, and of its length less 1.
DIGEST, SIZE = 10, 2
GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
#: MB of documents in a part of the order, at most, about.
BUCKET_MB = 256


def chunk_ends(raw: np.ndarray, ends: list[int]) -> list[list[int]]:
    """The ends of the chunks of each text in raw; ends are the texts' own (the first starts at 0)."""
    h = GEAR[raw]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    loose = np.flatnonzero((h & LOOSE) == 0)
    strict = ((h[loose] & STRICT) == 0).tolist()
    loose = (loose + 1).tolist()
    out, i, n, start = [], 0, len(loose), 0
    for end in ends:
        cuts, s = [], start
        while i < n and loose[i] <= end:
            c = loose[i]
            while c - s > MOST:
                s += MOST
                cuts.append(s)
            size = c - s
            if size >= LEAST and (size >= NORMAL or strict[i]):
                cuts.append(c)
                s = c
            i += 1
        while end - s > MOST:
            s += MOST
            cuts.append(s)
        if end > s:
            cuts.append(end)
        out.append(cuts)
        start = end
    return out


def fingerprints(texts: list[str]) -> list[str]:
    """Equal texts have equal fingerprints; an empty text's is empty."""
    parts = [t.encode() for t in texts]
    out: list[str] = []
    at = 0
    while at < len(parts):
        to, size = at + 1, len(parts[at])
        while to < len(parts) and size < 2_000_000:
            size += len(parts[to])
            to += 1
        joined = b"".join(parts[at:to])
        ends = np.cumsum([len(p) for p in parts[at:to]]).tolist()
        start = 0
        for cuts in chunk_ends(np.frombuffer(joined, np.uint8), ends):
            found = set()
            for c in cuts:
                found.add(f"{xxhash.xxh3_64_intdigest(joined[start:c]) >> 24:010x}{c - start - 1:02x}")
                start = c
            out.append("".join(sorted(found)))
        at = to
    return out


def likeness(a: str, b: str) -> float:
    """The share of a's bytes in chunks that b has too; 1 for two empty fingerprints, 0 if only one is empty."""
    if not a or not b:
        return float(a == b)
    step = DIGEST + SIZE
    other = {b[i : i + step] for i in range(0, len(b), step)}
    total = common = 0
    for i in range(0, len(a), step):
        chunk = a[i : i + step]
        size = int(chunk[DIGEST:], 16) + 1
        total += size
        common += size * (chunk in other)
    return common / total


def _heads(keys: DataFrame, parts: int) -> list[tuple]:
    """(doc_id, h) of the first row of each part, in order, of keys (doc_id, h) ranged over parts: one for each partition of an exchange,
    as many as Spark's own range exchange keeps."""
    ranged = keys.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "h")
    first = ranged.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "h")).alias("first"))
    return sorted({(r["first"]["known"], r["first"]["doc_id"] or 0, r["first"]["h"]) for r in first.collect()})


class _Ranges:
    """The part that a row (known, doc_id, h) belongs to: the last whose head is not after it."""

    def __init__(self, heads: list[tuple]):
        self.heads = heads
        self.nulls = np.array([h for known, _, h in heads if not known], np.int64)
        self.ids = np.array([i for known, i, _ in heads if known], np.int64)
        self.hashes = np.array([h for known, _, h in heads if known], np.int64)

    def __call__(self, known: np.ndarray, ids: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(part of each row, whether the row is its part's head)."""
        low, high = np.searchsorted(self.ids, ids, side="left"), np.searchsorted(self.ids, ids, side="right")
        place, head = high.copy(), np.zeros(len(ids), bool)
        for k in np.flatnonzero((low < high) & known).tolist():  # rows of an id that some part starts with: few, or one id's rows
            some = self.hashes[low[k] : high[k]]
            n = int(np.searchsorted(some, h[k], side="right"))
            place[k] = low[k] + n
            head[k] = n > 0 and some[n - 1] == h[k]
        place += len(self.nulls) - 1
        if (~known).any():
            n = np.searchsorted(self.nulls, h[~known], side="right")
            place[~known] = n - 1
            head[~known] = self.nulls[n - 1] == h[~known]
        return place, head


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, last, doc_id, h, text) in order within each bucket: rows are dealt by ranges of (doc_id, hash of the text), and a bucket ends
    with a copy of the next one's first document (last = 1), the last bucket with the first document of all. No global sort, and
    the text is shuffled once. Rows of a null doc_id come first; ties are ordered by the hash, so that one id, or null, with very many rows is
    dealt too. Buckets are the partitions of one exchange: the session's number, or more where BUCKET_MB asks for them."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("h"), "text")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts_for(docs, BUCKET_MB, text_col))
    heads = _heads(rows.select("doc_id", "h"), parts)
    shared = docs.sparkSession.sparkContext.broadcast(_Ranges(heads))
    first = heads[0] if heads else None

    def run(batches):
        ranges = shared.value
        for batch in batches:
            ids, h = batch.column(0), batch.column(1).to_numpy()
            known = ~np.asarray(ids.is_null())
            x = ids.fill_null(0).to_numpy(zero_copy_only=False)
            bucket, edge = ranges(known, x, h)
            start = (known == first[0]) & (x == first[1]) & (h == first[2])
            edge &= bucket > 0
            for rows_, b, tail in ((np.arange(len(x)), bucket, 0), (np.flatnonzero(edge), bucket[edge] - 1, 1), (np.flatnonzero(start), np.full(int(start.sum()), len(ranges.heads) - 1), 1)):
                if len(rows_):
                    take = pa.array(rows_)
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array(b.astype(np.int32)), "last": pa.array(np.full(len(rows_), tail, np.int32)), "doc_id": ids.take(take), "h": batch.column(1).take(take), "text": batch.column(2).take(take)})

    dealt = arrow_map(rows, run, "bucket int, last int, doc_id long, h long, text string")
    return dealt.repartitionById(max(1, len(heads)), "bucket").sortWithinPartitions("bucket", "last", F.col("doc_id").asc_nulls_first(), "h", "text")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of docs. The
    edited text has its last floor(n/2) code points replaced by the first as many of the next document's, or all it has.
    A single document is its own next one. Null text is empty. Rows that repeat a doc_id follow each other in the order of their texts' hashes; a
    very long text is one row, held with its successor. Other columns are left out."""
    import hashlib

    def run(batches):
        held = None  # the row before, whose next document isn't known yet: (bucket, doc_id, text, fingerprint)
        for batch in batches:
            out = []
            texts = batch.column(4).to_pylist()
            prints = fingerprints(texts)
            for bucket, last, doc_id, text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), texts, prints, strict=True):
                if held and held[0] == bucket:
                    half = len(held[2]) // 2
                    out.append((held[1], held[2], held[3], own, held[2][: len(held[2]) - half] + text[:half]))
                    held = None
                if not last:
                    held = (bucket, doc_id, text, own)
            edited = fingerprints([o[4] for o in out])
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([o[0] for o in out], pa.int64()),
                    "n_chars": pa.array([len(o[1]) for o in out], pa.int64()),
                    "edited_sha256": pa.array([hashlib.sha256(o[4].encode()).hexdigest() for o in out], pa.string()),
                    "fingerprint": pa.array([o[2] for o in out], pa.string()),
                    "edited_fingerprint": pa.array(edited, pa.string()),
                    "near_edited": pa.array([likeness(o[2], e) for o, e in zip(out, edited, strict=True)], pa.float64()),
                    "near_next": pa.array([likeness(o[2], o[3]) for o in out], pa.float64()),
                }
            )

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return arrow_map(with_next(docs, id_col, text_col), run, schema)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
