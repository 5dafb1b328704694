"""Each operator against a brute-force version, with nulls, empty and repeated rows, clashing columns and empty tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomwork.llm import chat, decontam, fingerprints, language, line_runs, near_dups, packing, pages, passages, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, chunk string, key long, bucket int"  # extra columns that clash with inner names


def words_of(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    shared, line = words_of(r, 60), "  A Common LICENSE line of forty code points or more \t"
    out = [(None, shared), (100, None), (101, ""), (102, " \t\n"), (103, "one"), (104, "one"), (104, "one"), (105, " x y " * 20)]
    for i in range(12):
        out.append((i, f"{words_of(r, r.randint(0, 50))}\n{shared if i % 3 == 0 else ''}\u000b{words_of(r, 30)}\n{line if i < 7 else 'own'}\n{words_of(r, 5)}"))
    out += [(20, out[-1][1]), (21, out[-1][1]), (22, words_of(r, 3000) + " " + shared)]
    near = words_of(r, 200).split()
    for i in range(30, 36):
        w = list(near)
        w[i] = "changed"
        out.append((i, " ".join(w)))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7, 1) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def ascii_words(t):
    return (t or "").encode().split()


def test_passages(docs, none, rows):
    low = {}
    for i, t in rows:
        w = ascii_words(t)
        for p in range(len(w) - 12):
            k = tuple(w[p : p + 13])
            if i is not None:
                low[k] = min(i, low.get(k, i))
    want = []
    for i, t in rows:
        w = ascii_words(t)
        gone = {q for p in range(len(w) - 12) if i is not None and low[tuple(w[p : p + 13])] < i for q in range(p, p + 13)}
        want.append((i, len(w), len(gone), b" ".join(x for q, x in enumerate(w) if q not in gone).decode()))
    got = [tuple(r) for r in passages.drop_repeated_passages(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert passages.drop_repeated_passages(none).count() == 0


def test_hot_anchor(monkeypatch, spark):
    """Windows around an anchor that many chunks share are dealt one by one."""
    r = random.Random(1)
    phrase = words_of(r, 10)
    rows = [(i, f"{words_of(r, 8)} {phrase} {words_of(r, 8) if i % 4 else 'same end of it all here too'}") for i in range(60)]
    told = passages._tell
    import pyarrow as pa

    chunks = pa.table({"bucket": [0] * 40, "chunk": list(range(40)), "keys": [np.array([5, 9 + i], np.uint64).tobytes() for i in range(40)], "many": [b"\x00\x00"] * 40})
    out = told(chunks).to_pylist()
    assert len(out) == 40 and all(np.frombuffer(x["b"], np.uint64).tolist() == [5] for x in out)
    key, hot = np.sort(np.unique(passages._Chunk(pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]}), 13, 6).key)), None
    c = passages._Chunk(pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]}), 13, 6)
    hot = key
    names, texts, place, begin, count, doc = c.segments(key, hot, 13)
    assert set(count.tolist()) == {1} and len(begin) == len(c.at)
    found = passages._locate([0] * len(names), [59] * len(names), [w for _, w in names], 13)
    assert all(f is not None for f in found)


def test_line_runs(docs, none, rows):
    seen = collections.defaultdict(set)
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40 and i is not None:
                seen[key(x)].add(i)
    want = []
    for i, t in rows:
        x = (t or "").split("\n")
        stay = [y for y in x if not (len(seen.get(key(y), ())) >= 5 and i is not None and i < max(seen[key(y)]))]
        want.append((i, len(x), len(x) - len(stay), "\n".join(stay)))
    got = line_runs.dedup_lines(docs)
    assert set(docs.columns) <= set(got.columns)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "kept").collect()), key=str) == sorted(want, key=str)
    assert line_runs.dedup_lines(none).count() == 0


def test_line_runs_levels(spark):
    """Batches in descending order of ids: a key's largest document is that of its first batch, and counts add up over all levels."""
    runs = line_runs.LineRuns(spark, fanout=2, buckets=3)
    make = lambda n: spark.createDataFrame([(n, b"m", 0, bytes([k])) for k in range(3 + n % 2)], "doc_id long, mark binary, pos int, key binary")
    for n in range(9, 4, -1):
        assert {r["key"][0] for r in runs.novel(make(n)).collect()} == ({0, 1, 2, 3} if n == 9 else set())
        runs.add(make(n))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert "SortMergeJoin" in runs.novel(make(1))._jdf.queryExecution().toString() and "SelectedBucketsCount: 3 out of 3" in runs.novel(make(1))._jdf.queryExecution().toString()
    assert {(r["key"][0], r["max_doc"]) for r in runs.frequent(3).collect()} == {(k, 9) for k in range(4)}


def test_line_runs_names_and_repeats(spark):
    """Equal rows each lose the same lines, and input columns of the operator's own names pass through."""
    line = "a frequent line of more than forty code points, it is"
    rows = [(1, f"{line}\nx", 5, "k", "d"), (1, f"{line}\nx", 5, "k", "d"), *[(i, f"{line}\n{line}\ny", 6, "k2", None) for i in range(2, 8)], (9, line * 3000, 0, "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, kept string, `drop` string").withColumns({c: F.lit(c) for c in ("mark", "row", "lines", "kept_", "__doc", "max_doc")})
    got = line_runs.dedup_lines(df)
    assert set(got.columns) == {*df.columns, "n_lines_", "n_dropped", "kept__"}
    found = sorted(tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "kept", "n_lines_", "kept__", "kept_", "mark").collect())
    want = [(1, 2, 1, "x", 5, "k", "kept_", "mark")] * 2 + [(i, 3, 2, "y", 6, "k2", "kept_", "mark") for i in range(2, 7)] + [(7, 3, 0, f"{line}\n{line}\ny", 6, "k2", "kept_", "mark"), (9, 1, 0, line * 3000, 0, "", "kept_", "mark")]
    assert found == want
    same = line_runs.with_kept_lines(df.withColumn("n_chars", F.length("text")))
    assert same.columns == [*df.columns, "n_chars"] and {(r["doc_id"], r["text"], r["n_chars"], r["kept"]) for r in same.filter("doc_id < 3").collect()} == {(1, "x", 1, "k"), (2, "y", 1, "k2")}
    assert line_runs.with_kept_lines(df.limit(0)).count() == 0


def test_near_dups(docs, none, rows):
    sets = {}
    for i, t in rows:
        w = ascii_words(t)
        if i is not None and w:
            sets[i] = {tuple(w[p : p + 5]) for p in range(len(w) - 4)} or {tuple(w)}
    parent = {i: i for i, _ in rows}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    got = [tuple(r) for r in near_dups.near_classes(docs).collect()]
    assert sorted(got, key=str) == sorted(((i, top(i)) for i, _ in rows), key=str)
    assert near_dups.near_classes(none).count() == 0


def test_chain_of_near_copies(spark):
    """Classes that only members, not their leaders, link are joined."""
    r = random.Random(8)
    w = words_of(r, 120).split()
    rows = []
    for i in range(8):
        w = list(w)
        w[12 * i + 6] = f"new{i}"
        rows.append((i, " ".join(w)))
    got = near_dups.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x["class_id"] for x in got} == {0}


def test_near_dups_settled_in_blocks(spark, monkeypatch):
    """Without any shared leader, and with blocks of two nodes, the classes are those of brute force."""
    monkeypatch.setattr(near_dups, "BLOCK", 2)
    monkeypatch.setattr(near_dups, "ROUNDS", 1)
    r = random.Random(9)
    base = [words_of(r, 150).split() for _ in range(2)]
    rows = []
    for i in range(24):
        w = list(base[i % 2])
        for p in r.sample(range(0, 150, 6), 1 + i % 4):
            w[p] = f"n{i}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(w[p : p + 5]) for p in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    least = list(range(24))
    for _ in rows:
        for a in range(24):
            for b in range(24):
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
    got = near_dups.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(x) for x in got) == list(enumerate(least))


def test_near_copies_with_repeated_lines(spark):
    """One copy has further lines that occur 60 times each: the sets stay similar, the counts don't."""
    r = random.Random(8)
    rows, want = [], {}
    for k in range(40):
        base, line = words_of(r, 204), words_of(r, 30)
        rows += [(2 * k, base), (2 * k + 1, " ".join([base] + [line] * 60))]
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows[-2:]))
        assert len(a & b) / len(a | b) >= 0.8
        want |= {2 * k: 2 * k, 2 * k + 1: 2 * k}
    got = near_dups.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["class_id"] for x in got} == want


def test_texts_are_not_sent_on(spark):
    """Texts are cut into shingles where they lie: no plan of near_classes shuffles the text column."""
    r = random.Random(9)
    rows = [(k, words_of(r, 60)) for k in range(40)] + [(None, words_of(r, 60))]
    rows += [(100 + k, f"{t} more") for k, t in rows[:10]] + [(-(2**63), rows[3][1] + " end"), (2**63 - 1, rows[4][1] + " end")]
    seen, plain = [], near_dups.stored
    with pytest.MonkeyPatch.context() as m:
        m.setattr(near_dups, "stored", lambda df, name: seen.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df, name))
        got = {x["doc_id"]: x["class_id"] for x in near_dups.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert not [p for p in seen if "text#" in p and "Exchange hashpartitioning(doc_id" in p]
    least = -(2**63)
    assert got == {None: None, 3: least, 103: least, least: least, 4: 4, 104: 4, 2**63 - 1: 4} | {k: k for k in range(40) if k not in (3, 4)} | {100 + k: k for k in range(10) if k not in (3, 4)}


def test_prob_min_hash():
    """Components agree with the probability Jaccard of the weights."""
    e = np.arange(1, 31, dtype=np.uint64) * np.uint64(7919)
    wa, wb = np.ones(30), np.ones(30)
    wa[:10], wb[10:20] = 3.0, 2.0
    m = 4000
    sig = near_dups.prob_min_hash(np.repeat([0, 1], 30), np.concatenate([e, e]), np.concatenate([wa, wb]), 2, m)
    want = sum(1 / sum(max(x / a, y / b) for x, y in zip(wa, wb)) for a, b in zip(wa, wb))
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04


def test_language(spark, none):
    t = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet")
    from loomwork.llm.common import held_out

    content = language.sample_texts(t.filter(~held_out()).select("doc_id", "text", "lang"))
    found = language.identify(t, content).join(t.select("doc_id", "lang"), "doc_id").filter(held_out()).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (None, "the")], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(odd, content).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[None] in content
    assert language.identify(none, content).count() == 0
    assert language.sample_texts(spark.createDataFrame([], "doc_id long, text string, lang string")) == {}


def test_toxicity(spark, none):
    d = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/../sf0.01/labels.parquet")
    model = toxicity.train(d, labels)
    s = {r["doc_id"]: r for r in toxicity.score(d, model).collect()}
    held = [(s[r["doc_id"]]["predicted"], r["toxic"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([p == t for p, t in held]) > 0.85
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "x", "c")], "doc_id long, text string, score string")
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(odd, model).collect())
    assert toxicity.drop_toxic(odd, model).columns == odd.columns
    assert toxicity.score(none, model).count() == 0
    assert toxicity.fit([]).scores(["x"])[0] < 0.5


def test_fingerprints(docs, none, rows):
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want = []
    for k, (i, t) in enumerate(order):
        n = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()))
    got = fingerprints.fingerprint_edits(docs).collect()
    assert sorted((tuple(r[:3]) for r in got), key=str) == sorted(want, key=str)
    prints = collections.defaultdict(set)
    for r in got:
        prints[r["n_chars"], r["doc_id"] in (104,)].add(r["fingerprint"])
    assert len(prints[3, True]) == 1
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert fingerprints.likeness("", "") == 1 and fingerprints.likeness("", "a" * 12) == 0
    long = words_of(random.Random(2), 4000)
    a, b = fingerprints.fingerprints([long, "zz " + long])
    assert fingerprints.likeness(a, b) > 0.97
    assert fingerprints.fingerprint_edits(none).count() == 0


def test_chunks_by_brute_force():
    """Chunk ends, fingerprints and likeness byte by byte."""
    r = random.Random(17)
    texts = ["", "é", "x" * 3000, *["".join(r.choice("ab cdé\n") for _ in range(r.randint(0, 2500))) for _ in range(40)]]
    texts.append(texts[-1][:900] + "new" + texts[-1][900:])

    def ends(raw):
        out, start = [], 0
        for i in range(len(raw)):
            h = 0
            for b in raw[max(0, i - 31) : i + 1]:
                h = (h * 2 + int(fingerprints.GEAR[b])) % 2**32
            n = i + 1 - start
            if n >= 256 or n >= 64 and h < 2**27 or n >= 32 and h < 2**25:
                start = i + 1
                out.append(start)
        return out + [len(raw)] * (bool(raw) and (not out or out[-1] < len(raw)))

    prints = []
    for t in texts:
        raw = t.encode()
        cuts = ends(raw)
        assert fingerprints.chunk_ends(np.frombuffer(raw, np.uint8), [len(raw)]) == [cuts]
        chunks = [raw[a:b] for a, b in zip([0, *cuts], cuts)]
        prints.append({(xxhash.xxh3_64_intdigest(c) >> 24, len(c)) for c in chunks})
    got = fingerprints.fingerprints(texts)
    assert got == ["".join(sorted(f"{d:010x}{n - 1:02x}" for d, n in p)) for p in prints]
    for a, p in zip(got, prints):
        for b, q in zip(got, prints):
            want = float(p == q) if not p or not q else sum(n for _, n in p & q) / sum(n for _, n in p)
            assert math.isclose(fingerprints.likeness(a, b), want)


def test_fingerprints_of_one_id(spark, monkeypatch):
    """One id, or null, with most rows is dealt over many ranges; every row has its successor."""
    monkeypatch.setattr(fingerprints, "parts_for", lambda *a: 40)
    rows = [(7, f"text {k} " * (k % 9)) for k in range(300)] + [(None, f"null {k}") for k in range(100)] + [(k, "z" * k) for k in range(30) if k != 7]
    got = fingerprints.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string"))
    h = {r["text"]: r["h"] for r in spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "xxhash64(text) h").collect()}
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, h[x[1]]))
    want = []
    for (i, t), (_, n) in zip(order, [*order[1:], order[0]]):
        half = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()))
    assert sorted((tuple(r[:3]) for r in got.collect()), key=str) == sorted(want, key=str)


def test_chat(spark):
    rows = [(1, 2, "assistant", "b<turn>\\"), (1, 1, "user", "a</turn>"), (2, None, None, None), (None, 0, "assistant", "\\<text>x"), (2, 1, "assistant", ""), (2, 1, "assistant", "")]
    f = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    read = {r["conv_id"]: chat.read_turns(r["text"]) for r in f}
    assert read == {1: [("user", "a</turn>"), ("assistant", "b<turn>\\")], 2: [("", ""), ("assistant", ""), ("assistant", "")], None: [("assistant", "\\<text>x")]}
    assert {r["conv_id"]: [chat.unescape(r["text"][s["start"] : s["stop"]]) for s in r["generated"]] for r in f}[1] == ["b<turn>\\"]
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_pieces():
    t = chat.Template(chat.TEMPLATE)
    said = [{"role": "assistant", "text": "x" * 50} for _ in range(20)]
    parts = list(t.pieces({"messages": iter(said)}, most=200))
    assert len(parts) > 3 and "".join(p for p, _ in parts) == t.render({"messages": said})[0]
    assert all(p[a:b] == "x" * 50 for p, spans in parts for a, b in spans)


def test_template_language():
    r = lambda s, **c: chat.Template(s).render(c)[0]
    assert r("{% if a == 1 and not b %}x{% elif b %}y{% else %}z{% endif %}", a=1, b=0) == "x"
    assert r("{% set n = 'q' ~ 1 %}{{ n | upper }}{# no #}", a=1) == "Q1"
    assert r("{% for x in [1, 2] %}{{ x }},{% endfor %}{{ m.k[0] }}{{ m.nope }}", m={"k": ["v"]}) == "1,2,v"
    assert chat.Template("a{{ 'b' ~ 'c' }}{% if 1 == 1 %}d{% else %}{{ x }}{% endif %}").tree == [("text", "abcd")]
    assert r("{{ m.__class__ }}", m={}) == ""
    for bad in ("{% for x %}{% endfor %}", "{{ f(x) }}", "{% if a %}", "{{ a | nope }}", "{{ }}"):
        with pytest.raises(chat.TemplateError):
            chat.Template(bad)


def test_pages(spark):
    html = (
        "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav class=menu><ul><li><a href=/a>Home</a></li><li><a href=/b>About</a></li></ul></nav>"
        "<article><h1>Die &Uuml;berschrift</h1><p>Erster  Satz,\n mit&nbsp;Raum. Noch ein Satz hier.<p><b>Zweiter Absatz &amp; mehr Text, der l&auml;nger ist.<br><p>Dritter Absatz mit Worten.</article>"
        "<div class='comments'><h3>Comments</h3><div class=comment><p>Nice post, thanks.</p></div></div><footer>&copy; x.com</footer></body></html>"
    )
    df = spark.createDataFrame([(1, "u", html), (2, None, None), (3, "w", ""), (None, "z", "plain < text")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in pages.extract(df).collect()}
    assert got[1]["text"] == "Die Überschrift\nErster Satz, mit Raum. Noch ein Satz hier.\nZweiter Absatz & mehr Text, der länger ist.\nDritter Absatz mit Worten."
    assert got[2]["text"] == got[3]["text"] == "" and got[1]["n_chars"] == len(got[1]["text"])
    ok = total = 0
    for page, labels in pages.generated_pages(120, seed=77):
        b = pages.blocks(page)
        if len(b) == len(labels) and b:
            ok += int(((pages.label([pages.vectors(b)], pages.model())[0] >= 0.5) == np.array(labels)).sum())
            total += len(labels)
    assert ok / total > 0.96
    assert pages.extract(df.limit(0)).count() == 0


def test_page_blocks():
    f = lambda h: [b.text for b in pages.blocks(h)]
    assert f("<p>x <math><mi>E</mi>=mc</math> y</p><canvas>c</canvas>") == ["x E=mc y", "c"]
    assert f("<article><p>a</p><object data=x><p>b</p><p>c</p></article>") == ["a", "b", "c"]
    assert f('<p title="abc>one</p><p class="x">two') == ["two"] and f('<p title="abc>one</p> more <p>two') == ["one", "more", "two"]
    assert f("a < b <3 c &lt;p&gt; <") == ["a < b <3 c <p> <"] and f("&am<b></b>p; &amp;lt;") == ["&amp; &lt;"]
    assert f("<datalist><option>o</datalist><p>t") == ["t"] and f("<option>o<p>t") == ["t"]
    assert f("<select><option>a<option>b</select>z<svg><text>no</text></svg>yes") == ["z", "yes"] and f("<svg><text>no<p>yes") == ["yes"]
    assert f("<p>a<noscript><p>no</p></noscript>b<template><div>no</template>c") == ["a", "b", "c"]
    assert f("x<!-->y<!-- z --> w<p>q<!-- never") == ["xy w", "q"]
    assert f("<p>1<table><tr><td>2<td>3<tr><td>4</table>5<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["1", "2", "3", "4", "5", "a", "b", "c", "d"]
    many = " ".join(f"n{k}" for k in range(40))
    deep = pages.blocks("<div>" * 500 + f'<p class="{many}">x')[0].path
    depth = 0
    while deep.parent:
        depth, deep = depth + 1, deep.parent
    assert depth == 501 and f'class="{many}"' and len(pages._NAMED.findall(f' class="{many}"')[0][0].split()) == 40


def test_page_blocks_by_brute_force():
    """Well-formed trees: the blocks are the runs of text between block boundaries."""
    r = random.Random(12)
    for _ in range(300):
        html, want, run = [], [], []

        def end(want=want, run=run):
            if text := " ".join("".join(run).split()):
                want.append(text)
            run.clear()

        def put(depth):
            for _ in range(r.randint(1, 4)):
                kind = r.random()
                if kind < 0.5:
                    t = r.choice(("word ", "x", " y z", "&amp;", "<!-- c -->", "&lt;b&gt;"))
                    html.append(t)
                    run.append({"&amp;": "&", "<!-- c -->": "", "&lt;b&gt;": "<b>"}.get(t, t))
                elif depth < 6:
                    tag = r.choice(("div", "section", "b", "span", "em", "blockquote"))
                    html.append(f"<{tag}{r.choice(('', ' class=a', ' id=\"q>\"', ' title=x/y data-z'))}>")
                    if tag not in ("b", "span", "em"):
                        end()
                    put(depth + 1)
                    html.append(f"</{tag}>")
                    if tag not in ("b", "span", "em"):
                        end()

        put(0)
        end()
        assert [b.text for b in pages.blocks("".join(html))] == want, "".join(html)


def test_hostile_pages():
    """Time in proportion to the page, whatever stands in it."""
    import time

    for h in ("<a " * 300_000 + "'", "<dd><ul>" + "<div>" * 40_000 + "<dt></dt>" * 40_000, '<p t="x>' * 100_000 + "'", "<a b=\"><a b='>" * 60_000, "<" * 1_000_000, "<!--" * 250_000, "<a" + " " * 1_000_000, "<option>x" * 100_000):
        t = time.time()
        pages.blocks(h)
        assert time.time() - t < 5


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_subsequence():
    r = random.Random(3)
    for _ in range(50):
        a, b = [r.randint(0, 5) for _ in range(r.randint(0, 20))], [r.randint(0, 5) for _ in range(r.randint(0, 30))]
        assert decontam.common_subsequence(a, b) == lcs(a, b)


def test_decontam(spark, none):
    r = random.Random(5)
    items = [(k, words_of(r, r.randint(20, 55)) + ". " + words_of(r, 6) + ".") for k in range(30)] + [(98, None), (99, ""), (100, "tiny item")]
    rows, want = [(500, None), (501, ""), (None, words_of(r, 30))], set()
    for i in range(120):
        text = words_of(r, r.randint(5, 300))
        if i % 4 == 0:
            item = items[i % 30][1].split()
            if i % 8 == 0:  # a paraphrase: every tenth word replaced
                item = ["other" if k % 10 == 9 else w for k, w in enumerate(item)]
            text = f"{text} {' '.join(item).upper()} {words_of(r, 40)}"
            want.add((i, i % 30))
        rows.append((i, text))
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontam.contaminated(df, bench).collect()}
    assert len(want - got) <= 0.1 * len(want) and not got - want
    kept = decontam.drop_contaminated(df, bench)
    assert kept.columns == df.columns and kept.count() == len(rows) - len({i for i, _ in got})
    assert decontam.contaminated(none, bench).count() == 0 and decontam.contaminated(df, bench.limit(0)).count() == 0


def test_decontam_of_a_large_benchmark(spark):
    """The latent space keeps little of each of so many items; each whole one and each paraphrase is found all the same."""
    r = random.Random(6)
    items = [(k, words_of(r, r.randint(15, 59))) for k in range(2500)]
    rows = [(k, f"{words_of(r, 90)} {items[k * 12][1]} {words_of(r, 90)}") for k in range(200)]
    for k in range(200, 260):  # paraphrases: every eighth word replaced
        item = " ".join("other" if j % 8 == 7 else w for j, w in enumerate(items[k][1].split()))
        rows.append((k, f"{words_of(r, 90)} {item} {words_of(r, 90)}"))
    found = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(x["doc_id"], x["item_id"]) for x in found.collect()}
    assert got == {(k, k * 12) for k in range(200)} | {(k, k) for k in range(200, 260)}


def many_blocks():
    """(texts, items): more than 8192 texts of one block of 24 words, one of them very often, and three items."""
    r = np.random.default_rng(4)
    vocabulary = np.array([f"w{i}" for i in range(250)])
    share = 1 / np.arange(8, 258)
    texts = [" ".join(vocabulary[r.choice(250, 24, p=share / share.sum())]) for _ in range(14_000)]
    return texts + [texts[5]] * 600, [(k, " ".join(vocabulary[r.choice(250, 20)])) for k in range(3)]


def far_from_whole_fit(searcher, texts, items):
    """How far the searcher's space is from one fitted on all the texts by brute force, as a share of the largest product in it."""
    idf = searcher.idf
    of = [np.unique(decontam._feature(decontam._hashes(t))) for t in texts + [t for _, t in items]]
    used = np.unique(np.concatenate(of))
    used = used[idf[used] > 0]
    a = np.zeros((len(of), len(used)))
    for k, f in enumerate(of):
        a[k, np.searchsorted(used, f[idf[f] > 0])] = idf[f[idf[f] > 0]]
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    kind = [int(decontam.mix(np.array(decontam._hashes(t), np.uint64).sum(keepdims=True))[0] >> np.uint64(48)) for t in texts]
    count = collections.Counter(kind)
    weight = np.array([8192 / len(count) / count[k] for k in kind] + [16] * len(items))
    start = np.random.default_rng(7).standard_normal((1 << 15, 128), np.float32)[used]
    basis, _ = np.linalg.qr((a.T * weight) @ (a @ start))
    want = (idf[used, None] * basis) @ (idf[used, None] * basis).T
    both = used[searcher.row[used] >= 0]
    assert len(both) > 100
    v = searcher.v[searcher.row[both]]
    at = np.searchsorted(used, both)
    return np.abs(v @ v.T - want[np.ix_(at, at)]).max() / want.diagonal().max()


def test_latent_space_of_every_block(spark):
    """The fit holds all blocks, and copies of one block count no more than its class."""
    texts, items = many_blocks()
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    searcher = next(decontam.searchers(df, spark.createDataFrame(items, "item_id long, text string")))
    assert far_from_whole_fit(searcher, texts, items) < 0.01


def test_packing(spark, docs, rows, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    more = rows + [(300, "a  b   c\n\n d  e <|endoftext|> 'll x\t\ty " * 30), (301, " leading"), (302, "trailing  ")]
    got = packing.pack_documents(spark.createDataFrame([(i, x, "l", 1, 2) for i, x in more], DOCS), path).collect()
    want = []
    for i, x in more:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(none, path).count() == 0


def test_packing_ids():
    """Every id is that of tokenizers, around all white space of Unicode, contractions, marks and added tokens."""
    import public_tokenizers

    e = packing._Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert e.cut and e.plain
    white = "".join(chr(i) for i in range(0x110000) if chr(i).isspace()) + "\u180e\u200b\ufeff"
    r = random.Random(1)
    some = ["a", "Be", "'ll", "'s", "é", "1", "  ", " ", " ", "\n", ".", "!", "漢", "_", "²", "\u0301", "ª", "\0", "<|endoftext|>", "😀"]
    texts = ["".join(r.choice([*some, r.choice(white)]) for _ in range(r.randint(0, 12))) for _ in range(20_000)] + [" \xa0 \xa0\n", "word " * 5000]
    for i in range(0, len(texts), 500):
        assert e(texts[i : i + 500]) == [e.whole(t) for t in texts[i : i + 500]]


def test_reduction():
    r = random.Random(6)
    for _ in range(200):
        cap = r.choice((10, 30, 100))
        counts = collections.Counter(r.randint(1, cap) for _ in range(r.randint(0, 60)))
        bins = packing.reduce_and_pack(dict(counts), cap)
        used = collections.Counter()
        for n, what in bins:
            assert n > 0 and sum(s * q for s, q in what) <= cap
            for s, q in what:
                used[s] += n * q
        assert used == counts
        n = sum(n for n, _ in bins)
        assert n >= math.ceil(sum(s * k for s, k in counts.items()) / cap)
        assert n <= sum(n for n, _ in packing.best_fit(dict(counts), cap)) + 1
        assert len({(s, rank) for s, a, b, *_ in packing.slots(bins) for rank in range(a, b + 1)}) == sum(counts.values())


def test_word_pattern():
    assert re.split(rb"[\x20\x09-\x0d]+", b"a\x0bb\x1cc") == b"a\x0bb\x1cc".split()
