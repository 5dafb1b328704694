"""Language identification by compression.

Each language has a zstandard raw-content dictionary of sampled text. A text is cut into blocks, every block is
compressed with each dictionary, and the language with the least total size wins. Narrow margins are rejected
in the column `sure`; lang_pred still names the best language.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import arrow_map, held_out, share_of, table

#: The bounded sample: so many rows for each language, those with the least hash of id and text, read whole; rows of more characters than
#: LONGEST are not drawn.
TEXTS, LONGEST = 160, 20_000
#: Bytes of a block, and zstandard's level.
BLOCK, LEVEL = 512, 3
#: Bytes saved for each byte of text: below DOUBT the thorough coder decides, below MARGIN a prediction is rejected.
DOUBT, MARGIN = 0.03, 0.01
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_PLAIN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def sample_texts(labelled: DataFrame, texts: int = TEXTS, longest: int = LONGEST) -> dict[str, bytes]:
    """labelled (doc_id, text, lang) -> a dictionary's content for each language: the sampled rows' whole texts, so its size is bounded
    by texts and longest. Which rows are drawn follows from a hash and each language's count, so nothing is ranked by language; equal rows count once.
    Rows of null doc_id, lang or text teach nothing."""
    rows = labelled.filter("doc_id is not null and lang is not null and text is not null").filter(F.length("text") <= longest)
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    drawn = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.4 * texts / n))]), F.col("lang"))
    some = rows.filter(share_of("doc_id", "text") <= drawn).select("lang", F.xxhash64("doc_id", "text").alias("h"), "text").distinct()
    found: dict[str, list] = {}
    for r in some.collect():  # 1.4 x texts for each language, about
        if _LETTER.search(r["text"]):
            found.setdefault(r["lang"], []).append((r["h"] & (1 << 64) - 1, r["text"]))
    return {lang: b"".join(plain(t) for _, t in sorted(v)[:texts]) for lang, v in sorted(found.items())}


class Classifier:
    """A fast coder for each language judges every text; where its margin is narrow a thorough one decides."""

    def __init__(self, content: dict[str, bytes]):
        import zstandard as z

        self.langs = sorted(content)
        log = max(17, (max(map(len, content.values()), default=1) + BLOCK).bit_length())  # the window holds the largest dictionary
        thorough = z.ZstdCompressionParameters(window_log=log, chain_log=log, hash_log=min(log, 20), search_log=3, min_match=3, target_length=8, strategy=z.STRATEGY_BTLAZY2, write_content_size=False)
        self.quick, self.slow, self.content = [], [], [content[g] for g in self.langs]
        for lang in self.langs:
            d = z.ZstdCompressionDict(content[lang], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.quick.append(z.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
            d = z.ZstdCompressionDict(content[lang], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=thorough)
            self.slow.append(z.ZstdCompressor(dict_data=d, compression_params=thorough))

    def _sizes(self, coders: list, raw: bytes) -> tuple[list[int], list[int], float]:
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        sizes = [sum([len(c.compress(b)) for b in blocks]) for c in coders]
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        return sizes, order, (sizes[order[1]] - sizes[order[0]]) / len(raw) if len(order) > 1 else 1.0

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, sure). A text that is null or has no letter: (und, 0, False)."""
        if not text or not self.langs or not _LETTER.search(text):
            return UNKNOWN, 0.0, False
        raw = plain(text)
        sizes, order, margin = self._sizes(self.quick, raw)
        if margin < DOUBT:
            sizes, order, margin = self._sizes(self.slow, raw)
        if margin == 0 and len(order) > 1:  # a tie: the dictionary with more of the text's words, then the first name
            words, least = set(raw.split()), sizes[order[0]]
            order = sorted((i for i in order if sizes[i] == least), key=lambda i: (-sum(b" %s " % w in self.content[i] for w in words), i))
        score = 1 / sum(math.exp(max(-60.0, (sizes[order[0]] - s) * 0.7)) for s in sizes)
        return self.langs[order[0]], score, margin >= MARGIN


def plain(text: str) -> bytes:
    """What is compressed: the whole text in lower case, ASCII characters other than letters as single spaces."""
    return b" ".join([b"", *text.lower().encode().translate(_PLAIN).split(), b""])


def identify(docs: DataFrame, content: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, sure) for each row of docs. lang_pred is und, with score 0, where the text is null or has
    no letter. Ties go to the dictionary that holds more of the text's words, then to the language that sorts first. Only the text is read, and whole: a very long one block by block. Rows are judged each for itself,
    repeated ones alike; other columns are left out."""

    def run(batches):
        classify = Classifier(content)
        for batch in batches:
            found = [classify(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    "lang_pred": pa.array([f[0] for f in found], pa.string()),
                    "score": pa.array([f[1] for f in found], pa.float64()),
                    "sure": pa.array([f[2] for f in found], pa.bool_()),
                }
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(rows, run, "doc_id long, lang_pred string, score double, sure boolean")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    content = sample_texts(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    return identify(docs, content).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "sure")
