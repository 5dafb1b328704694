"""Line dedup with levelled sorted runs of line hashes.

Batches are ranges of doc_id from the largest down. A run is a table (key, n_docs, max_doc) bucketed by the line key and sorted by it within
each bucket. A new batch's keys are merge-anti-joined to every standing run: the keys that none holds are novel, and their largest
document is final, since later batches have smaller ids; the other keys only add to the counts. Both become a run on level 0. As soon as a
level holds `fanout` runs they are compacted into one run of the next level, so n batches cost O(n log n), at most fanout - 1
runs stand on a level, and the runs' side of a join is not shuffled again. Everything is DataFrame operations.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import forget, free_name, parts_for, shared_path, stored, table

#: Fixed by the contract: the ASCII white space that a key is stripped of.
STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_KEY, MIN_DOCS = 40, 5
BATCHES, FANOUT = 4, 3
#: MB of documents whose keys share a bucket of a run, about, and Spark's own bound on buckets.
BUCKET_MB, MOST_BUCKETS = 32, 100_000


def lines_of(text: Column) -> Column:
    """The text's lines; null and empty text have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(STRIPPED)), UPPER, LOWER)


def keyed_lines(docs: DataFrame, min_key: int = MIN_KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, pos, key): each line whose key has min_key code points or more. key is the MD5 of the key
    text, mark the MD5 of the whole text, which tells rows of one doc_id apart."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter(F.length("text") >= min_key)
    rows = rows.select("doc_id", F.unhex(F.md5("text")).alias("mark"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    rows = rows.filter(F.length("line") >= min_key).select("doc_id", "mark", "pos", line_key(F.col("line")).alias("k"))
    return rows.filter(F.length("k") >= min_key).select("doc_id", "mark", "pos", F.unhex(F.md5("k")).alias("key"))


class LineRuns:
    """The runs of a corpus whose batches come in descending order of doc_id. A document has all its rows in one batch; null
    doc_ids count for nothing."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int = 8):
        self.spark, self.fanout, self.buckets = spark, fanout, buckets
        self.levels: list[list[tuple[str, str]]] = []

    def add(self, lines: DataFrame) -> None:
        """Adds a batch of keyed lines. The documents of a key are counted by two plain aggregations, so a key with a third of
        all lines is summed before the shuffle."""
        once = lines.filter(F.col("doc_id").isNotNull()).groupBy("key", "doc_id").agg(F.lit(1).alias("one"))
        batch = once.groupBy("key").agg(F.count("one").alias("n_docs"), F.max("doc_id").alias("max_doc"))
        runs = self.runs()
        if runs:
            batch = self._table(batch, "batch")
            fresh = self.novel(self._read(batch))
            known = self._read(batch).select("key", "n_docs").join(fresh.select("key"), "key", "left_anti").withColumn("max_doc", F.lit(None).cast("long"))
            run = self._table(fresh.unionByName(known), "run")
            self._drop(batch)
        else:
            run = self._table(batch, "run")
        self._place(run, 0)

    def novel(self, keys: DataFrame) -> DataFrame:
        """The rows whose key no run holds yet: a merge anti-join to each run."""
        for run in self.runs():
            keys = keys.join(run.select("key").hint("merge"), "key", "left_anti")
        return keys

    def runs(self) -> list[DataFrame]:
        return [self._read(run) for level in self.levels for run in level]

    def frequent(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """(key, max_doc) of the keys that min_docs documents or more hold, over all runs; written, and the runs go."""
        out = stored(self._merged([r for level in self.levels for r in level]).filter(F.col("n_docs") >= min_docs).select("key", "max_doc"), "frequent")
        for level in self.levels:
            for run in level:
                self._drop(run)
        self.levels = []
        return out

    def _merged(self, runs: list[tuple[str, str]]) -> DataFrame:
        """The runs' sums by key. Read as plain files: Spark 4.1 takes a union of bucketed tables for a bucketed one and would not bring
        a key's rows together."""
        both = self.spark.read.schema("key binary, n_docs long, max_doc long").parquet(*[path for _, path in runs])
        return both.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))

    def _table(self, rows: DataFrame, what: str) -> tuple[str, str]:
        """rows as a bucketed, sorted table in the shared folder."""
        name, path = f"loomwork_{uuid.uuid4().hex}", shared_path(self.spark, f"line-{what}")
        rows.repartition(self.buckets, "key").write.bucketBy(self.buckets, "key").sortBy("key").option("compression", "zstd").option("path", path).saveAsTable(name)
        return name, path

    def _read(self, run: tuple[str, str]) -> DataFrame:
        return self.spark.table(run[0])

    def _drop(self, run: tuple[str, str]) -> None:
        self.spark.sql(f"DROP TABLE {run[0]}")
        forget(self.spark, run[1])

    def _place(self, run: tuple[str, str], level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            merged = self._table(self._merged(full), "run")
            for r in full:
                self._drop(r)
            self._place(merged, level + 1)


def _bounds(lines: DataFrame, batches: int) -> list[int]:
    """Ascending ids that cut the documents into ranges of about the same number of lines; fewer where an id repeats."""
    shares = [i / batches for i in range(1, batches)]
    return sorted(set(lines.agg(F.percentile_approx("doc_id", shares, 1000).alias("at")).first()["at"] or []))


def _deduped(docs: DataFrame, min_key: int, min_docs: int, batches: int, id_col: str, text_col: str) -> DataFrame:
    """(row, n_lines, n_dropped, kept); row has all columns of docs, so that no name of theirs can clash."""
    spark = docs.sparkSession
    path = shared_path(spark, "lines")
    keyed_lines(docs, min_key, id_col, text_col).write.option("compression", "zstd").parquet(path)
    lines = spark.read.schema("doc_id long, mark binary, pos int, key binary").parquet(path).filter("doc_id is not null")
    runs = LineRuns(spark, buckets=min(MOST_BUCKETS, parts_for(docs, BUCKET_MB, text_col)))
    low = None
    for bound in [*reversed(_bounds(lines, batches)), None]:
        batch = lines if bound is None else lines.filter(F.col("doc_id") > bound)
        runs.add(batch if low is None else batch.filter(F.col("doc_id") <= low))
        low = bound
    dropped = (
        lines.join(runs.frequent(min_docs), "key")
        .filter(F.col("doc_id") < F.col("max_doc"))
        .groupBy("doc_id", "mark")
        .agg(F.collect_set("pos").alias("drop"))  # rows that repeat a document have the same places
    )
    named = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(text_col)).alias("mark"), F.col(text_col).alias("text"))
    out = named.join(dropped, ["doc_id", "mark"], "left").withColumn("lines", lines_of(F.col("text")))
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    kept = F.when(F.col("drop").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(places, lambda i: F.get(F.col("lines"), i)), "\n"))
    return out.select("row", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def dedup_lines(docs: DataFrame, min_key: int = MIN_KEY, min_docs: int = MIN_DOCS, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the columns n_lines, n_dropped and kept (the lines that stay, joined by \\n).

    A line whose key (stripped of ASCII white space, A-Z lowered) has min_key code points or more and occurs in
    min_docs documents or more stays only in the largest doc_id that holds it. Null and empty texts are one empty
    line. Rows of a null doc_id count as no document and lose nothing. Rows of one doc_id are one document; equal rows lose
    the same lines each. A very long text is one row throughout, with one array of its lines. All columns of docs pass through; one that
    is named n_lines, n_dropped or kept gets underscores after its name, whatever other names there are.
    """
    new = ["n_lines", "n_dropped", "kept"]
    names: list[str] = []
    for c in docs.columns:
        names.append(free_name(c, [*new, *names, *[x for x in docs.columns if x != c]]) if c.lower() in new else c)
    out = _deduped(docs, min_key, min_docs, batches, id_col, text_col)
    return out.select(*[F.col("row").getField(c).alias(n) for c, n in zip(docs.columns, names, strict=True)], *new)


def with_kept_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with the same columns and without the lines that repeat: the text is what is kept of it, and the column of its length, if docs has
    one, follows where lines were dropped. Null text stays null. Rows are judged as in dedup_lines."""

    def column(c: str) -> Column:
        own = F.col("row").getField(c)
        if c == text_col:
            return F.when(own.isNotNull(), F.col("kept"))
        return F.when(F.col("n_dropped") > 0, F.length("kept").cast(docs.schema[c].dataType)).otherwise(own) if c == length_col else own

    out = _deduped(docs, MIN_KEY, MIN_DOCS, BATCHES, id_col, text_col)
    return out.select(*[column(c).alias(c) for c in docs.columns])


def op8_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH l AS (SELECT rid, doc_id, pos, line, lower_key AS k FROM (
    SELECT rid, doc_id, pos, line,
           translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_key
    FROM (SELECT rid, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
          FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)))),
f AS (SELECT k, max(doc_id) AS max_doc FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT l.*, coalesce(f.max_doc IS NOT NULL AND doc_id < f.max_doc, FALSE) AS gone FROM l LEFT JOIN f ON l.k = f.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY rid, doc_id
"""
