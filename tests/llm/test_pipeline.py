"""Each stage of the pipeline against a plain-Python version of its decisions, on what the stage before kept."""

import collections
import math
import re
import zlib

import numpy as np

import __spark_entry__ as entry
import corpus_pipeline
from loomwork.llm import decontam, toxicity

SF = "/root/testdata/sf0.001"
M64 = 2**64 - 1


def mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def toxic_score(text, model):
    words = set(re.findall(r"\w+", (text or "").lower()))
    z = 0.0
    for w in words:
        code, features = [ord(c) for c in f"<{w}>"], set()
        for n in (3, 4, 5):
            for i in range(len(code) - n + 1):
                h = n
                for c in code[i : i + n]:
                    h = (h * 0x100000001B3 + c) & M64
                features.add(mix(h) >> 45)
        z += sum(float(model.weights[f]) for f in features)
    return 1 / (1 + math.exp(-(z / max(1, len(words)) ** 0.5 + model.bias)))


def without_lines(rows):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    seen = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                seen[key(x)].add(i)
    out = []
    for i, t in rows:
        gone = lambda x, i=i: len(seen.get(key(x), ())) >= 5 and i < max(seen[key(x)])
        out.append((i, None if t is None else "\n".join(x for x in t.split("\n") if not gone(x))))
    return out


def one_of_each(rows):
    sets = {i: {tuple(w[p : p + 5]) for p in range(len(w) - 4)} or {tuple(w)} for i, t in rows if (w := (t or "").encode().split())}
    least = {i: i for i, _ in rows}

    def top(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                least[y] = x
    return [(i, t) for i, t in rows if top(i) == i]


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def words(t):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())


def clean(rows, items):
    out = []
    for i, t in rows:
        w = words(t)
        count, bad = collections.Counter(w), False
        for item in items:
            x = words(item)
            answers = [words(p) for p in re.split(r"(?<=[.!?])\s+|\n", item.strip())]
            if not x or sum((count & collections.Counter(x)).values()) < 0.6 * len(x):
                continue
            for p in range(0, max(1, len(w) - len(x) + 1)):
                here = w[p : p + len(x) + len(x) // 2]
                share = subsequence(x, here) / len(x)
                answer = len(answers) > 1 and any(here[q : q + len(answers[-1])] == answers[-1] for q in range(len(here)))
                if share >= 0.8 or share >= 0.6 and answer:
                    bad = True
                    break
            if bad:
                break
        if not bad:
            out.append((i, t))
    return out


def pairs(df):
    return sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_stages(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = pairs(docs)
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {"toxicity": lambda r: [(i, t) for i, t in r if toxic_score(t, model) < 0.5], "line_dedup": without_lines, "near_dups": one_of_each, "decontam": lambda r: clean(r, items)}
    kept = [len(rows)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.toPandas(), docs.schema)
        rows = want[name](rows)
        assert pairs(docs) == sorted(rows), name
        assert all(r["n_chars"] == len(r["text"]) for r in docs.collect()), name
        kept.append(len(rows))
    assert kept[0] > kept[1] == kept[2] > kept[3] > kept[4] > 100
    packed = entry.queries()["pipeline"](spark, SF).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, total = [], 0
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        total += len(ids)
        pieces += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(tuple(r)[:5] for r in packed) == sorted(pieces)
    bins = collections.defaultdict(list)
    for r in packed:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= max(math.ceil(total / 1024), sum(length > 512 for *_, length, _ in pieces)) + 2


def test_decontam_fits_on_every_block(spark, monkeypatch, tmp_path):
    from test_operators import far_from_whole_fit, many_blocks

    texts, items = many_blocks()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    made, plain = [], decontam.searchers
    monkeypatch.setattr(decontam, "searchers", lambda *a: (made.append(s) or s for s in plain(*a)))
    corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert len(made) == 1 and far_from_whole_fit(made[0], texts, items) < 0.01


def test_odd_rows(spark):
    """Nulls, empty and repeated rows, a very long text, extra columns of inner names, and an empty table pass through every stage."""
    line = "the same long line of more than forty code points here"
    rows = [(None, "null id", "k"), (1, None, None), (2, "", "k"), (3, f"{line}\nown words one two three four", "k"), (3, f"{line}\nown words one two three four", "k"), (9, "word " * 200_000, "k")]
    rows += [(k, f"{line}\n{k} a text of its own number {k * 7} and {k * k}", "k") for k in range(10, 16)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string").withColumns({})
    for c in ("n_lines", "mark", "class_id", "score", "h", "bucket", "row", "n_chars", "key", "length"):
        df = df.selectExpr("*", f"length(coalesce(text, '')) as {c}")
    whole = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == whole.columns, name
        df = spark.createDataFrame(out.collect(), whole.schema)
    got = {r["doc_id"]: r for r in df.collect()}
    assert df.count() == len(rows) - 1 == len(got) and got[3]["text"] == "own words one two three four" and got[3]["n_chars"] == 28
    assert got[1]["text"] is None and got[2]["text"] == "" and got[None]["text"] == "null id" and got[9]["n_lines"] == 1_000_000 and got[15]["text"].startswith(line)
    packed = corpus_pipeline.pack(spark, df, SF)
    assert {r["doc_id"] for r in packed.collect()} == set(got)
    empty = whole.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
