"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into blocks of 24 words; a passage is two neighbouring blocks, so any 24 words in a row lie in one.
Document frequencies are counted over all blocks. A distributed randomised SVD of TF-IDF rows (every block of every
document, and every benchmark piece with extra weight) gives the latent space. Each passage of each document is projected, and
its cosine to every benchmark piece's latent reconstruction finds candidates. The space keeps less of a piece the more
pieces it serves, so an index of each item's rarest words finds beside them every text that holds enough of its words.
A longest common subsequence over words and a check of the item's answer (its last sentence) confirm. Everything about a document happens in
one task; what is broadcast is bounded by the feature count, the rank and PIECES pieces of benchmark items at a time.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import arrow_map, give_back, hash_words, mix, parts_for, sized, table, utf8, words_of

BLOCK = 24
BITS, RANK = 15, 128
#: Features in more than this share of the blocks say nothing.
COMMON = 0.1
#: In the fit the documents' blocks weigh as much as this many rows together, dealt evenly to 2**SHARES classes of their hash and there to
#: every block (so copies of one block weigh no more than its class), and a benchmark piece as much as EXTRA rows.
WEIGHT, SHARES, EXTRA = 8192, 16, 16.0
#: Tasks that sum the documents' rows at most and megabytes of files for each (each sends 2**BITS x RANK numbers on), and the slices of these sums.
TASKS, MB, SLICES = 128, 32, 64
#: Pieces of benchmark items that are searched at a time, about; each further so many cost one more pass over the documents.
PIECES = 16_384
COSINE = 0.16
#: Benchmark items of one index, passages times pieces whose cosines are held at once, pieces among them, and rare words that must be there.
GROUP, CELLS, WIDE, RARE = 5_000, 4_000_000, 8192, 3
#: A passage counts as one of so many middling features at least, so that a few words repeated are not near every item that has them.
LEAST = 6
#: Shares of an item's words in the common subsequence: enough alone, and enough if the answer is there too.
ALONE, WITH_ANSWER = 0.8, 0.6
#: An item of fewer words must occur whole, its words in a row; an answer has so many words at least.
SHORT, ANSWER = 8, 3

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 0x20


def _tokens(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, stops, first) of the words: runs of letters, digits and non-ASCII characters, lower case."""
    raw, ends = utf8(pc.utf8_lower(column.cast(pa.large_string())))
    raw = _PLAIN[raw]
    return raw, *words_of(raw, ends)


def _features(raw, starts, stops) -> tuple[np.ndarray, np.ndarray]:
    h = hash_words(raw, starts, stops)
    return h, (mix(h) >> np.uint64(64 - BITS)).astype(np.int64)


def _feature(hashes: list[int]) -> np.ndarray:
    return (mix(np.array(hashes, np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64)


def _blocks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first words of all blocks, and the first block of each text (n+1 numbers)."""
    n = np.diff(first)
    count = -(-n // BLOCK)
    at = np.append(0, np.cumsum(count))
    return np.repeat(first[:-1], count) + (np.arange(at[-1]) - np.repeat(at[:-1], count)) * BLOCK, at


def _distinct(f: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block, feature), each pair once, in order of the block."""
    block = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(f))))
    both = np.sort(block << BITS | f)
    both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    return both >> BITS, both & ((1 << BITS) - 1)


def _sums(values: np.ndarray, rows: np.ndarray, block: np.ndarray, n: int) -> np.ndarray:
    """For each of n blocks the sum of its rows of values; block ascends. Some blocks at a time, the largest first, so that what is
    added to stays in the processor's cache."""
    out = np.empty((n, values.shape[1]), np.float32)
    count = np.bincount(block, minlength=n)
    begin = np.cumsum(count) - count
    there = np.empty((min(n, 1024), values.shape[1]), np.float32)
    for i in range(0, n, 1024):
        order = np.argsort(-count[i : i + 1024], kind="stable")
        size, at = count[i : i + 1024][order], begin[i : i + 1024][order]
        some = np.zeros((len(size), values.shape[1]), np.float32)
        for j, m in enumerate(np.searchsorted(-size, -np.arange(size[0])).tolist()):
            some[:m] += np.take(values, rows[at[:m] + j], axis=0, out=there[:m], mode="clip")
        out[i + order] = some
    return out


def _share(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The class of each block by its words' hashes; equal blocks are of one class."""
    return (mix(np.add.reduceat(h, begin)) >> np.uint64(64 - SHARES)).astype(np.int64)


def _count(batches):
    counts, shares, n = np.zeros(1 << BITS, np.int64), np.zeros(1 << SHARES, np.int64), 0
    for batch in batches:
        for part in sized(pa.Table.from_batches([batch]), "text"):
            raw, starts, stops, first = _tokens(part.column("text"))
            if not len(starts):
                continue
            h, f = _features(raw, starts, stops)
            begin, _ = _blocks(first)
            counts += np.bincount(_distinct(f, begin)[1], minlength=1 << BITS)
            shares += np.bincount(_share(h, begin), minlength=1 << SHARES)
            n += len(begin)
    all_ = np.concatenate([counts, shares, [n]])
    here = np.flatnonzero(all_)
    yield pa.RecordBatch.from_pydict({"k": pa.array(here), "n": pa.array(all_[here])})


def _few(docs: DataFrame) -> DataFrame:
    """The texts in so many partitions as the input's size asks for, however many small ones it has."""
    return docs.select("text").coalesce(min(TASKS, parts_for(docs, MB, "text")))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Over the blocks of all docs (text): idf of each feature, 0 for those in more than COMMON of them, and the weight of a block of each class."""
    rows = arrow_map(_few(docs), _count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()  # 2**BITS + 2**SHARES + 1 rows at most
    counts = np.zeros((1 << BITS) + (1 << SHARES) + 1)
    counts[rows.column("k").to_numpy()] = rows.column("n").to_numpy()
    df, shares, n = counts[: 1 << BITS], counts[1 << BITS : -1], counts[-1]
    idf = np.log((n + 1) / (df + 1)) + 1e-6
    idf[df > max(COMMON * n, 1)] = 0
    there = np.count_nonzero(shares)
    weight = min(1, WEIGHT / max(there, 1)) / np.maximum(shares, 1)
    return idf.astype(np.float32), weight.astype(np.float32)


def _add_products(z: np.ndarray, q: np.ndarray, idf: np.ndarray, block: np.ndarray, f: np.ndarray, weight: np.ndarray) -> None:
    """To z is added A'Aq, less a factor of idf for z's rows, which q's have in them: A's rows are the blocks of (block, feature), each of length
    1 times the root of its weight."""
    here = idf[f] > 0
    block, f = block[here], f[here]
    if not len(f):
        return
    y = _sums(q, f, block, len(weight))
    y *= (weight / np.maximum(np.bincount(block, idf[f].astype(np.float64) ** 2, len(weight)), 1e-12)).astype(np.float32)[:, None]
    order = np.argsort(f.astype(np.uint16), kind="stable")
    f, rows = f[order], block[order]
    while True:  # sums of BLOCK rows of a feature, then of so many of these
        new = (np.arange(len(f)) - np.searchsorted(f, f)) % BLOCK == 0
        y = _sums(y, rows, np.cumsum(new) - 1, np.count_nonzero(new))
        f, rows = f[new], np.arange(len(y))
        if (f[1:] != f[:-1]).all():
            break
    z[f] += y


def _gram(idf_shared, weight_shared, q_shared):
    """A'Aq of the partition's blocks, in slices of features."""

    def run(batches):
        idf, weight, q = idf_shared.value, weight_shared.value, q_shared.value
        z = np.zeros_like(q)
        for batch in batches:
            for part in sized(pa.Table.from_batches([batch]), "text", 2_000_000):
                raw, starts, stops, first = _tokens(part.column("text"))
                if not len(starts):
                    continue
                h, f = _features(raw, starts, stops)
                begin, _ = _blocks(first)
                _add_products(z, q, idf, *_distinct(f, begin), weight[_share(h, begin)])
        z *= idf[:, None]
        for i, part in enumerate(np.array_split(z, SLICES)):
            yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "sums": pa.array([part.tobytes()], pa.binary())})

    return run


def _total(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) for x in rows.column("sums"))
    return pa.table({"slice": rows.column("slice").slice(0, 1), "sums": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def _turned(x: np.ndarray, turn: np.ndarray) -> None:
    """x becomes x @ turn, in place, some rows at a time."""
    for i in range(0, len(x), 2048):
        x[i : i + 2048] = x[i : i + 2048] @ turn


def _orthonormal(z: np.ndarray) -> None:
    """The columns of z become an orthonormal basis of what they span, in place; directions that it lacks are zero."""
    for _ in range(2):
        size, turn = np.linalg.eigh(sum(x.T @ x for x in (z[i : i + 2048].astype(np.float64) for i in range(0, len(z), 2048))))
        scale = np.where(size > 1e-12 * max(size[-1], 1e-300), 1 / np.sqrt(np.maximum(size, 1e-300)), 0)
        _turned(z, (turn * scale).astype(np.float32))


def _start() -> np.ndarray:
    return np.random.default_rng(7).standard_normal((1 << BITS, RANK), np.float32)


def products(docs: DataFrame, idf_shared, weight: np.ndarray) -> np.ndarray:
    """A'A times a random start (features x RANK) over every block of docs (text): one pass, and each task's sums are features x RANK in
    size whatever the number of blocks."""
    context = docs.sparkSession.sparkContext
    q = _start()
    q *= idf_shared.value[:, None]
    weights, shared = context.broadcast(weight), context.broadcast(q)
    z = np.zeros_like(q)
    del q
    rows = arrow_map(_few(docs), _gram(idf_shared, weights, shared), "slice int, sums binary")
    sums = rows.groupBy("slice").applyInArrow(_total, "slice int, sums binary").collect()
    slices = np.array_split(z, SLICES)
    for r in sums:
        slices[r["slice"]][:] = np.frombuffer(r["sums"], np.float32).reshape(slices[r["slice"]].shape)
    del sums
    shared.destroy()
    weights.destroy()
    give_back()
    return z


def latent_space(z: np.ndarray, pieces: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """The leading right singular vectors (features x RANK) of the documents' rows, whose products are z, and the pieces' (distinct features):
    the products' range, turned by the eigenvectors of A'A's Nystrom approximation in it."""
    z, more, q = z.copy(), np.zeros_like(z), _start()
    q *= idf[:, None]
    for i in range(0, len(pieces), 4096):
        some = pieces[i : i + 4096]
        _add_products(more, q, idf, np.repeat(np.arange(len(some)), [len(f) for f in some]), np.concatenate(some), np.full(len(some), EXTRA, np.float32))
    more *= idf[:, None]
    z += more
    del more, q
    inner = _inner(_start(), z)
    q = z.copy()
    _orthonormal(q)
    small = _inner(q, z)
    _, turn = np.linalg.eigh(small @ np.linalg.pinv((inner + inner.T) / 2, 1e-6, hermitian=True) @ small.T)
    _turned(q, np.ascontiguousarray(turn[:, ::-1], np.float32))
    del z
    give_back()
    return q


def _inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return sum(a[i : i + 2048].astype(np.float64).T @ b[i : i + 2048] for i in range(0, len(a), 2048))


def plain_words(text: str) -> list[str]:
    return bytes(_PLAIN[np.frombuffer(text.lower().encode(), np.uint8)]).decode().split(" ") if text else []


def common_subsequence(a: list, b: list) -> int:
    """The length of the longest common subsequence; one bit for each element of a."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        if (m := places.get(x)) is not None:
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


class Item:
    def __init__(self, item_id: int, text: str):
        self.item_id = item_id
        self.words = _hashes(text)
        parts = [p for p in re.split(r"(?<=[.!?])\s+|\n", text.strip()) if len(_hashes(p)) >= ANSWER]
        self.answer = _hashes(parts[-1]) if len(parts) > 1 else []

    def missing(self) -> int:
        """How many of its words a text that holds it can lack."""
        n = len(self.words)
        return 0 if n < SHORT else n - math.ceil((WITH_ANSWER if self.answer else ALONE) * n - 1e-9)

    def pieces(self) -> list[list[int]]:
        w = self.words
        if len(w) <= BLOCK:
            return [w]
        return [w[i : i + BLOCK] for i in range(0, len(w) - BLOCK, BLOCK)] + [w[-BLOCK:]]

    def judge(self, region: list[int]) -> tuple[float, bool, int]:
        """(share of the words in the common subsequence, the answer is there, where), over stretches of 1.5 times the item's length."""
        n = len(self.words)
        if n < SHORT:
            at = next((i for i in range(len(region) - n + 1) if region[i : i + n] == self.words), None)
            return (1.0, False, at) if at is not None else (0.0, False, 0)
        size, best, at = n + n // 2, 0, 0
        for i in range(0, max(1, len(region) - size + n // 4), max(1, n // 4)):
            if (k := common_subsequence(self.words, region[i : i + size])) > best:
                best, at = k, i
        a = self.answer
        here = region[at : at + size]
        there = bool(a) and any(here[i : i + len(a)] == a for i in range(len(here) - len(a) + 1))
        return best / n, there, at


class Index:
    """The rarest words of some items. A stretch that holds an item lacks missing() of its words at most, so of any missing() + k
    distinct words k are there, and the rarest tell most."""

    def __init__(self, idf: np.ndarray, items: list[Item], base: int):
        rare, self.need = [], np.ones(len(items), np.int64)
        self.sets = [frozenset(x.words) for x in items]
        self.left = [len(s) - x.missing() for s, x in zip(self.sets, items, strict=True)]
        self.tokens = [len(x.words) - x.missing() for x in items]
        for i, item in enumerate(items):
            words = np.unique(np.array(item.words, np.uint64))
            weight = idf[_feature(words.tolist())]
            left = self.left[i]
            if left <= 0:  # the same few words again and again: each of them tells, and near() counts how often they come
                rare += [(int(w), i) for w in words]
                continue
            k = min(RARE, left)
            order = np.argsort(-weight, kind="stable")
            if weight[order[item.missing() + k - 1]] == 0:  # common words tell little: all of them together
                k = left
            self.need[i] = k
            rare += [(int(w), i) for w in words[order[: item.missing() + k]]]
        self.size = np.array([len(x.words) + len(x.words) // 2 for x in items], np.int64)
        words = np.array([w for w, _ in rare], np.uint64)
        order = np.argsort(words, kind="stable")
        self.words, begin = np.unique(words[order], return_index=True)
        self.begin = np.append(begin, len(rare))
        self.lists = np.array([i for _, i in rare], np.int64)[order]
        self.base = base

    def near(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, first word, last word) of each stretch that has enough rare words of an item, and around them enough of all its words."""
        if not len(self.words) or not len(h):
            return []
        place = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        at = np.flatnonzero(self.words[place] == h)
        place = place[at]
        count = self.begin[place + 1] - self.begin[place]
        pos = np.repeat(at, count)
        item = self.lists[np.repeat(self.begin[place] - np.cumsum(count) + count, count) + np.arange(len(pos))]
        text = np.searchsorted(first, pos, side="right") - 1
        key = text * len(self.size) + item
        order = np.argsort(key, kind="stable")
        key, pos, item, text = key[order], pos[order], item[order], text[order]
        last = np.arange(len(pos)) + self.need[item] - 1
        ok = last < len(pos)
        last = np.where(ok, last, 0)
        ok &= (key[last] == key) & (pos[last] - pos < self.size[item])
        out = []
        for t, i, p, q in zip(text[ok].tolist(), item[ok].tolist(), pos[ok].tolist(), pos[last[ok]].tolist(), strict=True):
            size = int(self.size[i])
            here = h[max(int(first[t]), q - size + 1) : min(int(first[t + 1]), p + size)].tolist()
            own = self.sets[i]
            if len(own.intersection(here)) >= self.left[i] and sum(map(own.__contains__, here)) >= self.tokens[i]:
                out.append((t, self.base + i, p, q))
        return out


def _hashes(text: str) -> list[int]:
    raw, starts, stops, _ = _tokens(pa.array([text], pa.large_string()))
    return hash_words(raw, starts, stops).tolist()


class Searcher:
    """What a task needs: idf, the projection and the benchmark."""

    def __init__(self, idf: np.ndarray, v: np.ndarray, items: list[Item]):
        self.idf, self.items = idf, items
        size = np.linalg.norm(v, axis=1)
        pieces = [(i, p) for i, item in enumerate(items) for p in item.pieces()]
        asked = np.zeros(len(idf), bool)
        for _, p in pieces:
            asked[_feature(p)] = True
        # beside the benchmark's own features only those with much weight in the space count
        used = np.flatnonzero((idf > 0) & (size > 0) & (asked | (size >= 0.25 * size.max())))
        self.floor = float(LEAST * np.median(idf[asked & (idf > 0)] ** 2)) if (asked & (idf > 0)).any() else 1.0
        self.row = np.full(len(v), -1, np.int32)
        self.row[used] = np.arange(len(used))
        self.v = v[used] * idf[used, None]
        latent = np.zeros((len(pieces), v.shape[1]), np.float32)
        for k, (_, p) in enumerate(pieces):
            r = self.row[np.unique(_feature(p))]
            latent[k] = self.v[r[r >= 0]].sum(axis=0)
        norm = np.linalg.norm(latent, axis=1)
        self.indexes = [Index(idf, items[i : i + GROUP], i) for i in range(0, len(items), GROUP)]
        seen = norm >= 1e-6
        self.of = np.array([i for i, _ in pieces], np.int64)[seen]
        self.queries = np.ascontiguousarray((latent[seen] / norm[seen, None]).T)

    def candidates(self, f: np.ndarray, first: np.ndarray, asked: list[tuple[int, int, int]] = ()) -> list[tuple[int, int, int, float]]:
        """(text, item, first block in the text, cosine) of every passage and item whose cosine is COSINE or more, and of those asked."""
        begin, at = _blocks(first)
        if not len(begin):
            return []
        if not self.queries.shape[1]:
            return [(t, i, b, 0.0) for t, i, b in asked]
        block, f = _distinct(f, begin)
        energy = np.bincount(block, self.idf[f].astype(np.float64) ** 2, len(begin))
        row = self.row[f]
        here = np.flatnonzero(row >= 0)
        sums = _sums(self.v, row[here], block[here], len(begin))
        text = np.repeat(np.arange(len(at) - 1), np.diff(at))
        pair = np.zeros(len(begin), bool)
        pair[:-1] = text[1:] == text[:-1]
        sums[:-1] += np.where(pair[:-1, None], sums[1:], 0)
        energy[:-1] += np.where(pair[:-1], energy[1:], 0)
        energy = np.maximum(energy, self.floor)
        alone = np.append(True, ~pair[:-1])  # a text's only block; else its last block is in the pair before
        keep = np.flatnonzero(pair | alone)
        out = []
        for t, i, b in asked:
            k = min(at[t] + b, max(at[t], at[t + 1] - 2))  # a text's last block is in the pair before
            mine = self.queries[:, slice(*np.searchsorted(self.of, [i, i + 1]))]
            out.append((t, i, b, float((sums[k] @ mine).max(initial=0) / np.sqrt(energy[k]))))
        wide = min(WIDE, self.queries.shape[1])
        step = max(64, min(8192, CELLS // wide))
        for i in range(0, len(keep), step):
            k = keep[i : i + step]
            root = np.sqrt(energy[k])[:, None].astype(np.float32)
            for j in range(0, self.queries.shape[1], wide):
                cos = sums[k] @ self.queries[:, j : j + wide]
                cos /= root
                r, c = np.nonzero(cos >= COSINE)
                out += zip(text[k[r]].tolist(), self.of[j + c].tolist(), (k[r] - at[text[k[r]]]).tolist(), cos[r, c].tolist(), strict=True)
        return out

    def hits(self, column) -> list[tuple[int, int, float, float, bool, int]]:
        """(text, item_id, cosine, share, answer, first word) of each confirmed text and item, the best place each."""
        raw, starts, stops, first = _tokens(column)
        h, f = _features(raw, starts, stops)
        spans: dict[tuple[int, int], list] = {}
        asked = set()
        for t, i, p, q in (x for index in self.indexes for x in index.near(h, first)):
            more = len(self.items[i].words) // 2 + 1  # with the reach below, all stretches that these words lie in
            lo, hi = max(int(first[t]), p - more), min(int(first[t + 1]) - 1, q + more)
            asked.update((t, i, b) for b in range((lo - int(first[t])) // BLOCK, (hi - int(first[t])) // BLOCK + 1))
        for t, i, b, cos in self.candidates(f, first, sorted(asked)):
            spans.setdefault((t, i), []).append((b, cos))
        out = []
        for (t, i), found in spans.items():
            item, base, end = self.items[i], int(first[t]), int(first[t + 1])
            reach, best = len(item.words), None
            found.sort()
            k = 0
            while k < len(found):  # neighbouring passages are judged as one region
                a = z = found[k][0]
                cos = found[k][1]
                while k + 1 < len(found) and found[k + 1][0] <= z + 2:
                    k += 1
                    z, cos = found[k][0], max(cos, found[k][1])
                k += 1
                lo, hi = max(base, base + a * BLOCK - reach), min(end, base + (z + 2) * BLOCK + reach)
                share, there, at = item.judge(h[lo:hi].tolist())
                if (share >= ALONE or share >= WITH_ANSWER and there) and (best is None or share > best[3]):
                    best = (t, item.item_id, cos, share, there, lo + at - base)
            if best:
                out.append(best)
        return out


def searchers(docs: DataFrame, benchmark: DataFrame):
    """A Searcher for each block of benchmark's items (item_id, text) with about PIECES pieces, fitted on docs (text). Items without words are left out."""
    spark = docs.sparkSession
    idf, weight = document_frequencies(docs)
    shared = spark.sparkContext.broadcast(idf)
    sums = products(docs, shared, weight)
    n = benchmark.select(F.sum(F.size(F.split("text", r"\s+")) / BLOCK + 1)).first()[0] or 0
    blocks = max(1, math.ceil(n / PIECES))
    for k in range(blocks):
        some = benchmark.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else benchmark
        rows = some.select(F.col("item_id").cast("long"), "text").filter("item_id is not null and text is not null").distinct().collect()  # about PIECES x BLOCK words
        items = [i for i in (Item(r["item_id"], r["text"]) for r in sorted(rows)) if i.words]
        if not items:
            continue
        feats = [np.unique(_feature(p)) for i in items for p in i.pieces()]
        found = Searcher(idf, latent_space(sums, feats, idf), items)
        give_back()
        yield found


HIT = "doc_id long, item_id long, cosine double, lcs_share double, answer boolean, first_word long"


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share, answer, first_word): a row for each text of docs and item of benchmark that it holds,
    whole or paraphrased. Null and empty texts hold nothing; an empty benchmark gives no rows. Rows that repeat a doc_id are
    searched each for itself, and equal items are found each for itself. A very long text is searched whole, in the memory of its words; a
    very long item costs a subsequence over its whole length wherever its rare words are. Other columns are left out."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = spark.createDataFrame([], HIT)
    for searcher in searchers(rows, benchmark):
        shared = spark.sparkContext.broadcast(searcher)

        def run(batches, shared=shared):
            for batch in batches:
                for part in sized(pa.Table.from_batches([batch]), "text"):
                    found = shared.value.hits(part.column("text"))
                    ids = part.column("doc_id").to_pylist()
                    cols = list(zip(*[(ids[t], i, c, s, a, w) for t, i, c, s, a, w in found], strict=True)) or [[]] * 6
                    types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], HIT.replace(" long", "").replace(" double", "").replace(" boolean", "").split(", "))

        out = out.unionByName(arrow_map(rows, run, HIT))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whatever their names, whose text holds no item of benchmark; null and empty texts stay."""
    spark = docs.sparkSession
    schema, at = docs.schema, docs.columns.index(text_col)
    out = docs
    for searcher in searchers(docs.select(F.col(text_col).alias("text")), benchmark):
        shared = spark.sparkContext.broadcast(searcher)

        def run(batches, shared=shared):
            for batch in batches:
                whole = pa.Table.from_batches([batch])
                for part in sized(whole, whole.column_names[at]):
                    clean = np.ones(len(part), bool)
                    clean[[x[0] for x in shared.value.hits(part.column(at))]] = False
                    yield from part.filter(pa.array(clean)).to_batches()

        out = arrow_map(out, run, schema)
    return out


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
