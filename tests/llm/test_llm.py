"""The dealt operators against brute force on small tables with nulls, empty and
long texts, repeated rows, ties, clashing columns, and on empty tables."""

import collections
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, component_id long"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def _lower(t):
    return t.translate({i: i + 32 for i in range(65, 91)})


def _words(rnd, n):
    return [rnd.choice("the of and anea erin thoner reti onst ble wher inat es".split()) + str(rnd.randrange(60)) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    out = []
    for i in range(40):
        w = _words(rnd, rnd.choice([3, 60, 90, 200]))
        out.append(" ".join(w[:30]) + ".\n" + " ".join(w[30:]))
    passage = " ".join(_words(rnd, 60))
    base = _words(rnd, 150)
    for i in range(12):                                       # near copies
        w = list(base)
        for j in rnd.sample(range(150), i % 5):
            w[j] = f"x{i}y{j}"
        out.append(" ".join(w))
    out += [out[0], out[0], passage, f"Début é {passage}\nfin", f"{passage} und", "", " \n ", "a" * 3000, "ab " * 4000, "word " * 30,
            "# * $ " * 60, "Released under the MIT License.", "Licensed under the Apache License, Version 2.0. mit license mit license",
            "SPDX-License-Identifier: BSD-3-Clause", "é" * 80 + "x", "é" * 79 + "y" + "é" * 60]
    docs = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 7 else None, len(t), 1, 2) for i, t in enumerate(out)]
    docs += [docs[5], (len(out), None, "en", "s0", 0, 1, 2), (None, out[1], "en", "s1", 1, 1, 2)]
    return docs


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _multi(df, cols):
    return collections.Counter(tuple(r[c] for c in cols) for r in df.collect())


def test_license_scan(docs, rows, empty):
    from aspectra.llm.license_scan import rules, scan
    phrases = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
    want = collections.Counter()
    for d, t, *_ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(t or ""))
        at = [(i, label) for p, label in phrases for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
        places = [i for i, _ in at]
        want[d, len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))] += 1
    got = scan(docs)
    assert _multi(got, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]) == want
    labels = {r["doc_id"]: (r["labels"], r["score"], r["n_detections"]) for r in got.where("labels <> ''").collect()}
    assert {x[0] for x in labels.values()} == {"mit", "apache,apache-2.0,mit", "bsd-3-clause"}
    assert max(x[1] for x in labels.values()) == 1.0
    assert len(rules()) > 200 and scan(empty).count() == 0


def test_license_overlaps(spark):
    from aspectra.llm.license_scan import scan
    df = spark.createDataFrame([(1, "gnu general public license version 3"), (2, "licensed under the gnu lesser general public license version 2.1")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in scan(df).collect()}
    assert got[1]["labels"] == "gpl,gpl-3.0" and got[1]["n_detections"] == 1      # the base phrase lies inside
    assert got[2]["labels"] == "gpl,lgpl-2.1" and got[2]["score"] == 0.9


def _near(rows, percent):
    sets, ids = [], []
    for d, t, *_ in rows:
        w = SPACE.findall(_lower(t or ""))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
        ids.append(d)
    part = list(range(len(rows)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = ids[i] is not None and ids[i] == ids[j]
            c = len(sets[i] & sets[j])
            if ids[i] is not None and ids[j] is not None and (same or c and 100 * c >= percent * len(sets[i] | sets[j])):
                part[find(i)] = find(j)
    out = collections.Counter()
    for i in range(len(rows)):
        comp = min((ids[j] for j in range(len(rows)) if find(j) == find(i) and ids[j] is not None), default=None)
        out[ids[i], len(sets[i]), comp if sets[i] else ids[i], comp == ids[i] or not sets[i]] += 1
    return out


@pytest.mark.parametrize("block", [512, 4])
def test_minhash_forest(docs, rows, empty, monkeypatch, block):
    from aspectra.llm import blocks
    from aspectra.llm.minhash_forest import near_duplicates
    monkeypatch.setattr(blocks, "BLOCK", block)              # 4: the forest cuts the group of near copies
    want = _near(rows, 85)
    got = _multi(near_duplicates(docs), ["doc_id", "n_shingles", "component_id", "kept"])
    null = [k for k in got if k[0] is None]
    assert len(null) == 1 and null[0][3]
    assert {k: v for k, v in got.items() if k[0] is not None} == {k: v for k, v in want.items() if k[0] is not None}
    assert near_duplicates(empty).count() == 0


def _removed(rows, width):
    owner = {}
    for d, t, *_ in rows:
        b = (t or "").encode()
        for i in range(len(b) - width + 1):
            if d is not None:
                owner[b[i:i + width]] = min(owner.get(b[i:i + width], d), d)
    for d, t, *_ in rows:
        b = (t or "").encode()
        gone = set()
        for i in range(len(b) - width + 1):
            if d is not None and owner[b[i:i + width]] < d:
                gone.update(range(i, i + width))
        kept = bytes(x for i, x in enumerate(b) if i not in gone)
        yield d, b, gone, kept


@pytest.mark.parametrize("many", [10_000, 1])
def test_suffix_dedup(docs, rows, empty, many):
    from aspectra.llm.suffix_dedup import repeated_passages
    want = collections.Counter((d, len(b), len(gone), sum(1 for i in gone if i - 1 not in gone), hashlib.sha256(kept).hexdigest())
                               for d, b, gone, kept in _removed(rows, 50))
    got = repeated_passages(docs, many=many)                 # 1: windows are grouped as rows
    assert _multi(got, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]) == want
    assert repeated_passages(empty).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup_cuts_equal_strings_once(spark, monkeypatch, seed):
    from aspectra.llm import suffix_dedup
    rnd = random.Random(seed)
    passages = [" ".join(_words(rnd, 60)) for _ in range(3)] + ["ab" * 400]
    texts = []
    for i in range(60):                                      # passages whole and in part, other words around them
        p = passages[i % 4]
        a, b = (0, len(p)) if i % 3 else sorted(rnd.sample(range(len(p)), 2))
        texts.append(f"{' '.join(_words(rnd, 20))} {p[a:b]} {' '.join(_words(rnd, rnd.choice([0, 20])))}")
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[8]), (70, texts[2]), (1, texts[2]), (None, texts[4]), (71, None), (72, passages[3] * 2)]
    sent = []

    def spy(cut, *args, real=suffix_dedup._sorted_shards):
        sent.append(cut.where("to is null").groupBy("anchor", "string").count().agg(F.max("count")).first()[0])
        sent.append(cut.where("to is not null").groupBy("id", "tag").count().agg(F.max("count")).first()[0])
        return real(cut, *args)

    monkeypatch.setattr(suffix_dedup, "_sorted_shards", spy)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 4000)  # many buckets, many flushes
    monkeypatch.setattr(suffix_dedup, "FLUSH_BYTES", 20_000)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    want = collections.Counter((d, len(b), len(gone), sum(1 for i in gone if i - 1 not in gone), hashlib.sha256(kept).hexdigest())
                               for d, b, gone, kept in _removed(rows, 50))
    assert _multi(suffix_dedup.repeated_passages(df), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]) == want
    # a string stands in many documents; one cuts it out, the others hold one run for each passage
    assert sent[0] <= 2 and sent[1] <= 4


def test_without_repeats_keeps_columns(docs, rows, empty):
    from aspectra.llm.suffix_dedup import without_repeats
    got = without_repeats(docs)
    assert got.schema.names == docs.schema.names
    want = collections.Counter((d, kept.decode("utf-8", "ignore") if gone else t) for (d, b, gone, kept), (_, t, *_) in
                               zip(_removed(rows, 50), rows, strict=True) if not gone or SPACE.search(kept.decode("utf-8", "ignore")))
    assert _multi(got, ["doc_id", "text"]) == want
    assert without_repeats(empty).count() == 0


def test_suffix_array():
    import numpy as np

    from aspectra.llm.suffix_array import earlier_windows, suffix_array
    rng = np.random.default_rng(1)
    for _ in range(200):
        s = np.append(rng.integers(1, rng.integers(2, 6), rng.integers(0, 70)), 0).tolist()
        want = sorted(range(len(s)), key=lambda i: s[i:])
        for k in (258, 5000):                                # whole buckets at once, one by one
            assert suffix_array(np.array(s), k).tolist() == want
    strings = [bytes(rng.integers(97, 99, 30).astype(np.uint8)) for _ in range(9)]
    owners = rng.integers(0, 4, 9)
    for i, got in enumerate(earlier_windows(strings, owners, 6)):
        x = strings[i]
        assert got.tolist() == [p for p in range(25) if any(owners[j] < owners[i] and x[p:p + 6] in y for j, y in enumerate(strings))]


def test_decontamination(spark, empty):
    from aspectra.llm.decontamination import decontaminate, leaks_by_document
    rnd = random.Random(2)
    items = [" ".join(_words(rnd, n)) for n in (30, 20, 8, 3)]
    bench = spark.createDataFrame([*enumerate(items), (9, None), (10, "")], "item_id long, text string")
    sub = items[0].split()
    sub[7], sub[19] = "zz", "yy"                             # two substitutions
    texts = [items[0], "before. " + " ".join(sub).upper() + " after", " ".join(_words(rnd, 300)), items[2] + " and more", items[3], None, "",
             f"{items[1]}! {items[0]}", " ".join(items[0].split()[:6])]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string, item_id long")
    got = {r["doc_id"]: r["item_ids"] for r in leaks_by_document(df, bench).collect()}
    assert got == {0: "0", 1: "0", 2: "", 3: "2", 4: "", 5: "", 6: "", 7: "0,1", 8: "", 9: "0"}
    left = decontaminate(df, bench)
    assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == [2, 4, 5, 6, 8]
    assert leaks_by_document(df, bench.limit(0)).where("contaminated").count() == 0
    assert leaks_by_document(empty, bench).count() == 0


def test_quality(docs, rows, empty):
    from aspectra.llm.quality import keep_quality, quality
    want = collections.Counter()
    for d, t, *_ in rows:
        t = t or ""
        w = SPACE.findall(t)
        tri = list(zip(w, w[1:], w[2:], strict=False))
        n = collections.Counter(tri)
        covered = {j for i, g in enumerate(tri) if n[g] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if SPACE.search(x)]
        want[d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered),
             len(w) < 50 or 100 * len(covered) > 50 * len(w)] += 1
    got = quality(docs, min_group=5).cache()
    assert _multi(got, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]) == want
    assert got.where("base_failed and kept").count() == 0 and got.where("kept").count() > 20
    kept = keep_quality(docs, min_group=5)
    assert kept.columns == docs.columns and kept.count() == got.where("kept").count()
    assert quality(empty).count() == 0 and keep_quality(empty).count() == 0


def test_quality_sketch(spark):
    from aspectra.llm.quality import bucket, edge
    df = spark.range(0, 70000).select("id", F.expr(bucket("id")).cast("long").alias("b")).select("id", "b", F.expr(edge("b")).alias("e"))
    assert df.where("e > id or (id - e) * 32 > id").count() == 0
    assert df.groupBy("b").agg(F.countDistinct("e").alias("n")).where("n > 1").count() == 0


def test_mixing(spark, docs, empty):
    from aspectra.llm.mixing import _tables, mix, rates
    got = mix(docs, {"s0": 3.0, "s1": 1.0}, epochs=6.0)
    assert got.columns == [*docs.columns, "copy", "shuffle_key"]
    assert {r["source"] for r in got.select("source").distinct().collect()} <= {"s0", "s1"}
    key = ["doc_id", "copy", "shuffle_key"]
    assert _multi(got, key) == _multi(mix(docs.repartition(3), {"s0": 3.0, "s1": 1.0}, epochs=6.0), key)
    # the inverse of the distribution function
    steps = _tables(spark.createDataFrame([("a", 2.5), ("b", 900.0)], "source string, rate double")).collect()
    for r in steps:
        f = 0.0
        for k, x in enumerate(r["steps"]):
            f += math.exp(k * math.log(r["rate"]) - r["rate"] - math.lgamma(k + 1)) if k else math.exp(-r["rate"])
            assert abs(f - x) < 1e-9
        assert r["steps"][-1] > 1 - 1e-9
    sizes = spark.createDataFrame([("a", 100.0), ("b", 300.0)], "source string, size double")
    rate = {r["source"]: r["rate"] for r in rates(sizes, {"a": 1.0, "b": 1.0}, 2.0).collect()}
    assert rate["a"] == pytest.approx(4.0) and rate["b"] == pytest.approx(4 / 3)
    big = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    n = {r["source"]: r["count"] for r in mix(big, {"a": 1.0, "b": 1.0}).groupBy("source").count().collect()}
    assert abs(n["a"] - 10000) < 500 and abs(n["b"] - 10000) < 500
    assert mix(empty).count() == 0


def test_url_templates(spark):
    from aspectra.llm.url_templates import filter_urls
    urls = ["https://x.example.com/en/12?a=1", "http://WWW.Example.com/en/7#t", "http://a.www.example.com/en/q", "https://b.net/fr/1", "https://b.net/en/2",
            "https://c.com", "https://c.com/x", None, "no scheme", "https://h.org/p/1/x"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in filter_urls(df).collect()}
    assert got[0] == ("x.example.com", "/en/12", "example.com/en/", "block") == got[10]
    assert got[1] == ("www.example.com", "/en/7", "www.example.com/en/", "allow") and got[2][3] == "allow"
    assert got[3] == ("b.net", "/fr/1", "net/fr/", "block") and got[4][2:] == (None, "allow")
    assert got[5] == ("c.com", "", None, "allow") and got[6][2] == "com/" and got[7] == got[8] == ("", "", None, "allow")
    assert filter_urls(df.limit(0)).count() == 0
    # labels: a bad branch of a host is rejected, its good sibling stays
    rows = [(i, f"https://h.org/{'spam' if i % 2 else 'news'}/{i}", i % 2 if i < 60 else None) for i in range(80)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad int")
    v = {r["page_id"]: r["verdict"] for r in filter_urls(df, rules=[], label_col="bad").collect()}
    assert all(v[i] == ("block" if i % 2 else "allow") for i in range(80))


def test_html_consensus(spark):
    from aspectra.llm.html_consensus import main_texts
    page = ("<html><head><title>t</title><script>var a='<p>x</p>';</script></head><body><nav><a href=/>menu</a></nav><div class='ad'>buy"
            "<article class='post-{0}'><h1>A &amp; b</h1><p>one<br>two <b>three<p>four &lt;\n five<!-- no --><aside>side</aside>"
            "<form><input value=1>send</form><div class='comments'><p>spam</div></article><footer>f</footer></body></html>")
    want = "A & b\none two three\nfour < five"
    rows = [(i, "http://h.org/1", page.format(i), "c") for i in range(4)] + [(9, None, None, "c"), (10, "http://h.org/2", "", "c"), (11, "http://k.org", "<p>only</p", "c"),
            (12, "http://h.org/3", "<div id=main><p>plain body text", "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, path string")
    got = {r["page_id"]: r["text"] for r in main_texts(df).collect()}
    assert [got[i] for i in range(4)] == [want] * 4 and got[9] == got[10] == "" and got[12] == "plain body text"
    assert main_texts(df.limit(0)).count() == 0


def test_token_tree():
    import base64

    import tiktoken

    from aspectra.llm.token_counts import SPLIT, VOCABULARY, TokenTree
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("t", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def count(s):
        return len(encode(s))

    rnd = random.Random(1)
    for n in (0, 1, 20, 900):
        text = " ".join(_words(rnd, n))
        tree = TokenTree(text, count)
        assert tree.total == count(text)
        for _ in range(25):
            a = rnd.randrange(len(text) + 1)
            b, by = min(len(text), a + rnd.choice([0, 1, 5, 600])), rnd.choice(["", " ", "\n\n ", "'s", "é x", "12 a  b"])
            tree.replace(a, b, by)
            text = text[:a] + by + text[b:]
            assert tree.text() == text and tree.total == count(text)
    long = " ".join(_words(rnd, 4000))
    tree = TokenTree(long, count)
    tree.replace(9000, 9003, "x")
    assert tree.encoded < 1500                               # only the region is encoded again


def test_token_counts(docs, rows, empty):
    from aspectra.llm.token_counts import redactions, token_counts
    text = "mail me@a.org or +1 (017) 555-7713, ip 97.51.17.173 token = \"04dbebab91ab85687d33eeaaf9ac\""
    assert [by for _, _, by in redactions(text)] == ["<email>", "<phone>", "<ip>", "<secret>"]
    got = token_counts(docs)
    assert got.count() == len(rows) and got.where("n_tokens < 0 or (n_edits = 0 and n_tokens <> n_tokens_edited)").count() == 0
    assert token_counts(empty).count() == 0


def _paragraphs(rows, percent, least):
    seen, order = {}, []
    for d, t, *_ in rows:
        if d is None:
            continue
        for p, line in enumerate((t or "").split("\n")):
            w = SPACE.findall(_lower(line))
            if len(w) >= least and (d, p) not in seen:
                seen[d, p] = frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))
                order.append((d, p))
    part = {x: x for x in order}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, x in enumerate(order):
        for y in order[:i]:
            if 100 * len(seen[x] & seen[y]) >= percent * len(seen[x] | seen[y]):
                a, b = find(x), find(y)
                part[max(a, b)] = min(a, b)
    gone = collections.defaultdict(list)
    for x in order:
        if find(x) != x:
            gone[x[0]].append(x[1])
    return {d: ",".join(map(str, gone[d])) for d, *_ in rows if d is not None}


def test_paragraph_dedup(docs, rows, empty):
    from aspectra.llm.paragraph_dedup import bands_for, paragraph_report, without_repeated_paragraphs
    got = {r["doc_id"]: r["removed"] for r in paragraph_report(docs).collect() if r["doc_id"] is not None}
    assert got == _paragraphs(rows, 80, 25)
    assert (1 - 0.8 ** 4) ** bands_for(0.8, 4, 1e-3) <= 1e-3
    left = without_repeated_paragraphs(docs)
    assert left.columns == docs.columns and left.count() == docs.count()
    assert paragraph_report(empty).count() == 0


@pytest.mark.parametrize("few", [200_000, 0])
def test_components(spark, monkeypatch, few):
    from aspectra.llm import common
    from aspectra.llm.common import components
    monkeypatch.setattr(common, "FEW_EDGES", few)            # 0: star rounds to the end
    rnd = random.Random(3)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(300)] + [(7, 7)]
    part = {}

    def find(x):
        part.setdefault(x, x)
        while part[x] != x:
            x = part[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        part[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long").repartition(8)
    got = {r["node"]: r["component"] for r in components(df).collect()}
    assert all(got.get(x, x) == find(x) for x in part)


def test_pipeline(spark, rows, tmp_path):
    """run() against brute force, stage by stage."""
    import corpus_pipeline
    from aspectra.llm.quality import quality
    from aspectra.llm.decontamination import leaks_by_document
    folder = str(tmp_path)
    docs = spark.createDataFrame([r[:5] for r in rows], ", ".join(SCHEMA.split(", ")[:5]))
    docs.write.parquet(f"{folder}/documents.parquet")
    bench = spark.createDataFrame([(1, " ".join((rows[3][1] or "").split()[5:40]))], "item_id long, text string")
    bench.write.parquet(f"{folder}/benchmark.parquet")
    kept = {r["doc_id"] for r in quality(docs).where("kept").collect()}
    left = [r for r in rows if r[0] in kept]
    comp = {d: c for d, _, c, _ in _near(left, 80)}
    left = list({r[0]: r for r in left if r[0] is None or comp[r[0]] == r[0]}.values())
    texts = [(d, k.decode("utf-8", "ignore") if gone else t) for (d, b, gone, k), (_, t, *_) in zip(_removed(left, 50), left, strict=True)
             if not gone or SPACE.search(k.decode("utf-8", "ignore"))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    bad = {r["doc_id"] for r in leaks_by_document(df, bench).where("contaminated").collect()}
    want = dict(x for x in texts if x[0] not in bad)
    got = corpus_pipeline.run(spark, folder).collect()
    assert got and {r["doc_id"] for r in got} <= set(want) and all(r["text"] == want[r["doc_id"]] for r in got)
    assert got[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars", "copy", "shuffle_key"}


def _positive(expression):
    """A text that the expression matches: each group's first choice."""
    t = re.sub(r"\[(.)[^\]]*\]", r"\1", expression)
    while (u := re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)\??", r"\1", t)) != t:
        t = u
    return t


def test_license_gates(spark):
    """The gated scan equals the one that tries every rule, on a text for each."""
    from aspectra.llm.license_scan import rules, scan
    full = {f"  {'  '.join(_positive(r[5]).split())}  ": r for r in rules()}
    assert all(re.search(r[5], t) and f" {r[3]} " in t and r[4] in t for t, r in full.items())
    # the shortest match, without optional words
    texts = sorted({" ".join(_positive(re.sub(r"\(\?:[^()]*\)\?", "", r[5])).split()) for r in rules()})
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r for r in scan(df).collect()}
    assert got == {r["doc_id"]: r for r in scan(df, gates=False).collect()}
    assert all(r["n_detections"] for r in got.values())
    cases = {"SPDX-License-Identifier: MPL-2.0": "mpl-2.0", "SPDX-License-Identifier: LGPL-2.1": "lgpl-2.1", "SPDX-License-Identifier: MIT": "mit",
             "licensed under MIT": "mit", "Creative Commons Attribution 4.0": "cc-by-4.0", "Zero-Clause BSD": "0bsd", "released under the GPL": "gpl",
             "Open Database License version 1.0": "odbl-1.0", "released under the PSF license": "python-2.0", "SPDX-License-Identifier: MIT-0": "mit-0",
             "Permission is hereby granted, free of charge, to any person ... to whom the Software is furnished to do so, subject to the following "
             "conditions: The above copyright notice": "mit"}
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in scan(df).collect()} == dict(enumerate(cases.values()))


def test_decontamination_masks():
    """A mask misses no pattern of substitutions that the comparison accepts."""
    from itertools import combinations

    from aspectra.llm.decontamination import EQUAL, MASKS, MIN_ITEM, WINDOW
    assert sorted(MASKS) == list(range(MIN_ITEM, WINDOW + 1))
    for n in range(MIN_ITEM, 21):                            # items of n words
        k = min(n, WINDOW)
        hits = [{i + o for i, c in enumerate(m) if c == "1"} for m in MASKS[k] for o in range(n - len(m) + 1)]
        for first in range(n - k + 1):                       # an accepted pattern has a window that is accepted
            for bad in combinations(range(first, first + k), k - math.ceil(EQUAL * k)):
                rest = set(range(first, first + k)) - set(bad)
                assert any(h <= rest for h in hits)


def test_decontamination_substitutions(spark):
    """Items of 5 to 20 words, with all patterns or many, against brute force."""
    from itertools import combinations

    from aspectra.llm.decontamination import leaks_by_document
    rnd = random.Random(4)
    items = {n: [f"w{n}x{i}" for i in range(n)] for n in range(5, 21)}
    docs, want = [], {}
    for n, words in items.items():
        k = min(n, 13)
        patterns = [p for r in range(k - math.ceil(0.75 * k) + 2) for p in combinations(range(n), r)]
        for bad in rnd.sample(patterns, min(len(patterns), 300)):
            d = len(docs)
            equal = [i not in bad for i in range(n)]
            want[d] = any(sum(equal[i:i + k]) >= 0.75 * k for i in range(n - k + 1))
            docs.append((d, "a b " + " ".join(w if e else f"z{d}" for w, e in zip(words, equal, strict=True)) + " c"))
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    got = leaks_by_document(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {r["doc_id"]: r["contaminated"] for r in got} == want


def test_html_keeps_whole_text(spark):
    from aspectra.llm.html_consensus import main_texts
    long = " ".join(_words(random.Random(1), 200))
    page = f"<body><div class=w><p>lead</p><div class=inner><p>{long}</p></div><p>end</p></div><div><a href=/>home</a></div><nav>n</nav></body>"
    plain = f"<body><div class=w><div class=inner><p>{long} 2</p></div></div><p>outside"
    rows = [(11, "http://k.org", "<p>only</p"), (12, "http://l.org", "<p><a href=/>all of it is a link</a></p>"),
            (13, "http://m.org/1", page), (14, "http://m.org/2", page), (15, "http://m.org/3", plain),
            (16, "http://m.org/4", "<body><div class=w><p>few</p></div><article><h1>t</h1><p>own text</p></article></body>")]
    got = {r["page_id"]: r["text"] for r in main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {11: "only", 12: "all of it is a link", 13: f"lead\n{long}\nend", 14: f"lead\n{long}\nend", 15: f"{long} 2\noutside", 16: "t\nown text"}


def test_pipeline_keeps_texts_under_one_id(spark):
    """Rows equal in all columns are one, others that share an id stay."""
    import corpus_pipeline
    rows = [(1, "one text about this", "en"), (1, "quite another one, not alike", "de"), (1, "one text about this", "en"), (2, "a third", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, df, "").collect())
    assert got == [(1, rows[0][1]), (1, rows[1][1]), (2, "a third")]


def test_url_rule_labels_decide(spark):
    """Labels of the rules alone block and allow pages that no rule decides; deep slugs are generalised."""
    from aspectra.llm.url_templates import filter_urls
    urls = [f"http://bad.net/{x}/{i}" for i in range(40) for x in ("es", "fr")] + ["http://bad.net/pt/1", "http://bad.net/pt/a/b", "http://bad.net/"]
    urls += [f"http://www.example.com/en/{i}" for i in range(40)] + ["http://few.net/es/1", "http://few.net/en/1", "http://free.org/en/1"]
    deep = [f"http://free.org/a/b/c/d/e/name{chr(97 + i % 26)}{chr(97 + i // 26)}/x" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(urls + deep)), "page_id long, url string")
    got = {r["page_id"]: r for r in filter_urls(df).collect()}
    assert len(got) == len(urls + deep)
    judged = {urls[i]: got[i]["verdict"] for i in range(len(urls)) if got[i]["rule"] is None and got[i]["purity"] is not None}
    assert judged == {"http://bad.net/pt/1": "block", "http://bad.net/pt/a/b": "block", "http://bad.net/": "block", "http://few.net/en/1": "allow"}
    assert got[len(urls) - 1]["purity"] is None and got[len(urls) - 1]["verdict"] == "allow"
    assert {got[i]["template"] for i in range(len(urls), len(got))} == {"a/b/c/d/e/*/x"}
