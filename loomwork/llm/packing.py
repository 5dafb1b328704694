"""Best-fit packing after the Martello-Toth dominance reduction.

Documents become token pieces; only the counts of the piece lengths (one number for each length up to the
capacity) reach the driver. There the reduction fixes sets of lengths that provably dominate every other set
with the same longest piece, best-fit-decreasing packs what is left, and both work on whole multiplicities,
so the plan's size depends on the capacity and not on the corpus. The plan is joined back by length and rank.
"""

from __future__ import annotations

import bisect
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.llm.common import arrow_map, one_thread, sized, stored, table

CAPACITY, END_ID = 1024, 2
#: Pieces of one length that are numbered in one task, on average.
NUMBERED = 200_000
#: Parts of text whose ids a Python worker keeps: beyond so many they become the older half, which is asked until the next are as many.
CACHED = 200_000
#: Places where a text may be cut: before a space that a letter, a digit or a visible ASCII character stands before. A space that follows
#: white space is no such place.
_CUT, _WHITE_BEFORE = re.compile(r"(?<=[\w!-~])(?= )"), re.compile(r" (?<=\s )")
_PLAIN = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff!-~\n]+")
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _Encoder:
    """ids that tokenizers gives for the tokenizer file, as little-endian bytes.

    A byte-level pattern's matches never hold a character that isn't white space and then a space, and its only look-ahead is for white
    space. So a text without an added token's text may be cut before every space that follows no white space; the parts are encoded
    alone, and ids of parts that come again are remembered. Parts of visible ASCII and Latin letters only, whose classes are the same in all
    versions of Unicode, go through tiktoken over the file's own vocabulary, which takes half the time; all others through tokenizers.
    Texts of files of another kind are encoded whole.
    """

    def __init__(self, path: str):
        one_thread()
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        tokens = spec.get("added_tokens") or []
        self.added = [t["content"] for t in tokens]
        self.between = next(((t["content"], t["id"]) for t in tokens if not (t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized"))), None)
        pre = spec.get("pre_tokenizer") or {}
        self.cut = bool(self.between) and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding")
        self.plain = _plain(spec, self.added) if self.cut else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _units(self, text: str) -> list[str] | None:
        """The text's parts, or None if it is encoded whole."""
        if not self.cut or any(a in text for a in self.added):
            return None
        if "\0" in text or _WHITE_BEFORE.search(text):
            return _CUT.split(text)
        return text.replace(" ", "\0 ").split("\0")

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [self._units(t) for t in texts]
        if len(self.known) > CACHED:
            self.known, self.older = {}, self.known
        known = self.known
        self._learn(set().union(*filter(None, split)).difference(known))
        ids = known.__getitem__
        return [self.whole(t) if units is None else b"".join(map(ids, units)) for t, units in zip(texts, split, strict=True)]

    def _learn(self, new: set[str]) -> None:
        known, older = self.known, self.older
        if older:
            again = new.intersection(older)
            known.update(zip(again, map(older.__getitem__, again), strict=True))
            new -= again
        if self.plain:
            common = [u for u in new if _PLAIN.fullmatch(u)]
            known.update((u, array("I", ids).tobytes()) for u, ids in zip(common, map(self.plain, common), strict=True))
            new.difference_update(common)
        units = list(new)
        # text on either side of an added token is encoded apart from the other, so one stands between the parts
        for i in range(0, len(units), 20_000):
            some = units[i : i + 20_000]
            ids = np.array(self.tokenizer.encode(self.between[0].join(some), add_special_tokens=False).ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self.between[1]), len(ids)).tolist()
            raw, at = ids.tobytes(), 0
            for p, end in zip(some, ends, strict=True):
                self.known[p] = raw[4 * at : 4 * end]
                at = end + 1


def _plain(spec: dict, added: list[str]):
    """tiktoken over the vocabulary of a byte-level BPE file, or None unless its ids are in the order of its merges."""
    import tiktoken

    if spec["model"].get("type") != "BPE" or any(spec["model"].get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(visible))}
    vocab = {k: v for k, v in spec["model"]["vocab"].items() if k not in added}
    merged = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
    if [vocab.get(m.replace(" ", "", 1)) for m in merged] != list(range(256, 256 + len(merged))) or len(vocab) != 256 + len(merged):
        return None
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={bytes(back[c] for c in k): v for k, v in vocab.items()}, special_tokens={})._core_bpe.encode_ordinary


_ENCODERS: dict[str, _Encoder] = {}


def _encoder(path: str) -> _Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = _Encoder(path)
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and end_id; those with more than
    capacity are cut into full pieces of which only the first may be shorter. Null text is empty: one piece of one id."""

    def run(batches):
        encode, end = _encoder(tokenizer), array("I", [end_id]).tobytes()
        for part in (p for b in batches for p in sized(pa.Table.from_batches([b]), "text", 1_000_000)):
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc_id, own in zip(part.column("doc_id").to_pylist(), encode([t or "" for t in part.column("text").to_pylist()]), strict=True):
                ids = memoryview(own + end)
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    to = at + (n % capacity or capacity) if k == 0 else at + capacity
                    piece = ids[4 * at : 4 * to]
                    for c, v in zip(out, (doc_id, k, at, to - at, zlib.crc32(piece), piece.cast("I").tolist() if keep_ids else None), strict=True):
                        out[c].append(v)
                    at, k = to, k + 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            cols = {c: pa.array(v, t) for (c, v), t in zip(out.items(), types, strict=True) if keep_ids or c != "ids"}
            yield pa.RecordBatch.from_pydict(cols)

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, PIECE + (", ids array<long>" if keep_ids else ""))


def reduce_and_pack(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(bins, [(length, how many in each bin), ...]), ...] holding every piece of counts.

    Reduction: for the longest length j left, with room r beside it, the set {j} dominates if nothing fits in r;
    {j, k} dominates if k fills r, if k is the longest that fits and no two others fit, or if no three fit and k is
    at least the best sum of two that fit. Such bins are fixed in their whole multiplicity, again and again till nothing
    changes. Best-fit-decreasing packs the rest.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    bins: list[tuple[int, list[tuple[int, int]]]] = []

    def take(j: int, k: int | None) -> None:
        n = left[j] if k is None else left[j] // 2 if j == k else min(left[j], left[k])
        bins.append((n, [(j, 1)] if k is None else [(j, 2)] if j == k else [(j, 1), (k, 1)]))
        for s in {j, k} - {None}:
            left[s] -= n * (2 if j == k else 1)
            if not left[s]:
                del left[s]

    changed = True
    while changed:
        changed = False
        for j in sorted(left, reverse=True):
            while j in left:
                r = capacity - j
                left[j] -= 1  # the others
                sizes = sorted(s for s, n in left.items() if n and s <= r)
                small = [s for s in sizes for _ in range(min(3, left[s]))][:3]
                left[j] += 1
                if not sizes:
                    take(j, None)
                elif sizes[-1] == r or len(small) < 2 or small[0] + small[1] > r:
                    take(j, sizes[-1])
                elif (len(small) < 3 or sum(small) > r) and sizes[-1] >= _best_pair(sizes, left, j, r):
                    take(j, sizes[-1])
                else:
                    break
                changed = True
    return bins + best_fit(left, capacity)


def _best_pair(sizes: list[int], left: dict[int, int], j: int, room: int) -> int:
    """The largest sum up to room of two of the pieces beside one of length j."""
    best, a, b = 0, 0, len(sizes) - 1
    while a <= b:
        if a == b and left[sizes[a]] - (sizes[a] == j) < 2:
            break
        s = sizes[a] + sizes[b]
        if s > room:
            b -= 1
        else:
            best = max(best, s)
            a += 1
    return best


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit-decreasing over multiplicities: a length goes to the open bins with the least room that holds it."""
    open_: dict[int, list] = {}
    rooms: list[int] = []

    def put(room: int, n: int, what: list) -> None:
        if n:
            if room not in open_:
                bisect.insort(rooms, room)
            open_.setdefault(room, []).append((n, what))

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            i = bisect.bisect_left(rooms, s)
            if i == len(rooms):
                q = capacity // s
                put(capacity - q * s, n // q, [(s, q)])
                put(capacity - n % q * s, int(n % q > 0), [(s, n % q)])
                break
            room = rooms[i]
            m, what = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[i]
            q = room // s
            full = min(m, n // q)
            put(room - q * s, full, [*what, (s, q)])
            n, m = n - full * q, m - full
            if n and m:
                put(room - n * s, 1, [*what, (s, n)])
                n, m = 0, m - 1
            put(room, m, what)
    return [x for room in open_.values() for x in room]


def slots(bins: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, how many in a bin, first bin, offset): where the pieces of a length go."""
    out, used, first = [], {}, 0
    for n, what in bins:
        offset = 0
        for s, q in what:
            rank = used.get(s, 0)
            out.append((s, rank, rank + n * q - 1, q, first, offset))
            used[s] = rank + n * q
            offset += s * q
        first += n
    return out


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (with doc_id, piece, length, ids_crc32) and their sequence_id and offset."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    if not counts:
        return pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    salts = sum(counts.values()) // NUMBERED + 1
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    groups = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    before = groups.select("length", "__salt", (F.sum("__n").over(Window.partitionBy("length").orderBy("__salt")) - F.col("__n")).alias("__before"))
    ranked = salted.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "__salt"]).withColumn("__rank", F.col("__rank") + F.col("__before"))
    plan = spark.createDataFrame(slots(reduce_and_pack(counts, capacity)), "__length long, __low long, __high long, __q long, __bin long, __at long")
    hit = (F.col("length") == F.col("__length")) & F.col("__rank").between(F.col("__low"), F.col("__high"))
    place = F.col("__rank") - F.col("__low")
    return (
        ranked.join(F.broadcast(plan), hit)  # bounded by the capacity
        .withColumns({"sequence_id": F.col("__bin") + F.floor(place / F.col("__q")), "offset": F.col("__at") + place % F.col("__q") * F.col("length")})
        .select(*pieces.columns, F.col("sequence_id").cast("long"), F.col("offset").cast("long"))
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row for each piece of docs, packed into as few sequences of capacity ids as the method finds.

    Null text is empty. Rows that repeat a doc_id are packed each for itself. Other columns are left out.
    """
    return pack_pieces(stored(token_pieces(docs, tokenizer, capacity, keep_ids=keep_ids), "pieces"), capacity)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
