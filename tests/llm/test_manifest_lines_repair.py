"""Line dedup, the Merkle manifest and conversation repair against brute force, on
tables with nulls, empty and long texts, ties, repeated rows, clashing columns."""

import collections
import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
LOWER = {i: i + 32 for i in range(65, 91)}


def _sha(s):
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def _counter(df):
    return collections.Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def doc_rows():
    rnd = random.Random(3)
    common = ["Home | About", "  ÄRGER Über ", "\tx\x0b", "y" * 70000, "z"]
    out = []
    for i in range(60):
        lines = [f"line {rnd.randrange(400)}" for _ in range(rnd.randrange(1, 6))]
        for k, c in enumerate(common):
            if rnd.random() < (0.6, 0.4, 0.3, 0.17, 0.1)[k]:
                lines.insert(rnd.randrange(len(lines) + 1), rnd.choice([c, c.translate(LOWER), f" {c}\r"]))
        out.append((i, "\n".join(lines), "en" if i % 3 else None, None if i % 5 == 0 else f"s{i % 4}", i, 1, "a"))
    out += [out[3], out[3], (61, None, "en", "s1", None, 1, "b"), (62, "", "de", "s1", 0, 1, "c"), (63, "\n\n", "de", "s1", 2, 1, "d"),
            (64, "z\n" * 5000, "de", "one", 2, 1, "e"), (None, "home | about\nrest", "en", "s1", 3, 1, "f"),
            (65, "HOME | ABOUT", "é", "", 3, 1, "g"), (1, "other text under an id\nz", "en", "s1", 4, 1, "h")]
    return out


@pytest.fixture(scope="module")
def doc_frame(spark, doc_rows):
    # columns that clash with names used inside
    return spark.createDataFrame(doc_rows, "doc_id long, text string, lang string, source string, n_chars long, h1 long, row string").repartition(4).cache()


def _line_key(line):
    return line.strip(WHITE).translate(LOWER)


def _lines_expected(rows, min_docs):
    held = collections.Counter(k for r in rows for k in {_line_key(x) for x in (r[1] or "").split("\n")} if k)
    gone = {k for k, n in held.items() if n >= min_docs}
    assert gone
    kept = [[x for x in (r[1] or "").split("\n") if _line_key(x) not in gone] for r in rows]
    return collections.Counter((r[0], n := len((r[1] or "").split("\n")), n - len(k), _sha("\n".join(k))) for r, k in zip(rows, kept, strict=True))


def test_line_report(doc_frame, doc_rows):
    from aspectra.llm.line_dedup import line_report
    assert _counter(line_report(doc_frame)) == _lines_expected(doc_rows, 10)
    assert _counter(line_report(doc_frame, min_docs=3)) == _lines_expected(doc_rows, 3)
    assert line_report(doc_frame.limit(0)).count() == 0


@pytest.mark.parametrize("batches", [1, 2, 7])
def test_line_runs_levels(doc_frame, doc_rows, monkeypatch, batches):
    """Any number of batches and the path beyond the broadcast bound give the same rows."""
    from aspectra.llm import line_dedup
    monkeypatch.setattr(line_dedup, "HOT", 8)
    common, hot = line_dedup.common_lines(doc_frame, batches=batches)
    assert 0 < hot.distinct().count() < common.count() or batches > 1
    out = line_dedup.drop_lines(doc_frame, common, hot, max_rows=0)
    got = out.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256))
    assert _counter(got) == _lines_expected(doc_rows, 10)


def test_line_runs_merge(spark):
    """Runs move up by twos, settled lines aren't counted again, close() leaves nothing."""
    from aspectra.llm.line_dedup import LineRuns
    runs = LineRuns(spark, min_docs=4)
    for b in range(5):
        runs.add(spark.createDataFrame([(1, 1, 5), (2, b, 3), (3, 3, 1)], "h1 long, h2 long, docs long"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert sorted(map(tuple, runs.common().collect())) == [(1, 1), (3, 3)]
    assert sum(r.where("h1 = 1").count() for r in runs.runs()) == 1
    runs.close()
    assert not spark.sql("SHOW TABLES").where("tableName like 'line_run%'").count()


def test_without_common_lines(doc_frame):
    from aspectra.llm.line_dedup import without_common_lines
    out = without_common_lines(doc_frame)
    assert out.columns == doc_frame.columns
    rows = {r["doc_id"]: r for r in out.where("doc_id > 60").collect()}
    assert rows[61]["text"] is None and rows[62]["text"] == "" and rows[65]["text"] == "" and rows[65]["row"] == "g"


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _tree(leaves):
    """(root, siblings of every leaf as (left, right) per level)."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([_sha("".join(levels[-1][i:i + 3])) for i in range(0, len(levels[-1]), 3)])
    paths = []
    for i in range(len(leaves)):
        path = []
        for level in levels[:-1]:
            first = i // 3 * 3
            path.append(("".join(level[first:i]), "".join(level[i + 1:first + 3])))
            i //= 3
        paths.append(path)
    return levels[-1][0], paths


def _manifest_expected(rows):
    sources = collections.defaultdict(list)
    for r in rows:
        def leaf(text, r=r):
            return _sha("".join(map(_field, (r[0], r[3], r[2], r[4], text))))
        hit = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        sources[r[3]].append((r[0], leaf(r[1]), leaf(r[1].replace("\n", "")) if hit else leaf(r[1])))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        sources[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    subs = [_tree([x[1] for x in sources[s]]) for s in order]
    root, over = _tree([x[0] for x in subs])
    out = collections.Counter()
    for s, (sub, paths), top in zip(order, subs, over, strict=True):
        for (doc, leaf, other), path in zip(sources[s], paths, strict=True):
            node = other
            for a, b in path + top:
                node = _sha(a + node + b)
            out[doc, leaf, sub, root, _sha("".join(a + b for a, b in path + top)), node, node == root] += 1
    return out


@pytest.mark.parametrize("depth", [7, 2, 1])
def test_merkle(spark, doc_frame, doc_rows, monkeypatch, depth):
    """Deep trees by several rounds of exchange, with incomplete last subtrees."""
    from aspectra.llm import merkle
    monkeypatch.setattr(merkle, "DEPTH", depth)
    want = _manifest_expected(doc_rows)
    assert {k[-1] for k in want} == {True, False}
    assert _counter(merkle.tamper_report(doc_frame)) == want


@pytest.mark.parametrize("n", [1, 3, 4, 28, 83, 100])
def test_merkle_sizes(spark, monkeypatch, n):
    from aspectra.llm import merkle
    monkeypatch.setattr(merkle, "DEPTH", 1)
    rows = [(i, f"a\nb {i}", "en", "s", i) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert _counter(merkle.tamper_report(df)) == _manifest_expected(rows)


def test_merkle_empty(doc_frame):
    from aspectra.llm.merkle import tamper_report
    assert tamper_report(doc_frame.limit(0)).count() == 0


def _cheapest(symbols):
    """Edits by a search over (rows done, last role) in order of (cost, letters)."""
    heap, seen = [(0, "", 0, "")], set()
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    while heap:
        cost, word, i, last = heapq.heappop(heap)
        if (i, last) in seen:
            continue
        seen.add((i, last))
        if i == len(symbols) and last in ("", "a"):
            return word, cost
        heapq.heappush(heap, (cost + 5, word + "I", i, after[last]))
        if i < len(symbols):
            initial, fault = symbols[i]
            heapq.heappush(heap, (cost + 2, word + "D", i + 1, last))
            if fault != 2:
                heapq.heappush(heap, (cost + 1 + 5 * fault, word + "R", i + 1, after[last]))
                if initial == after[last] or (last, initial) == ("", "s"):
                    heapq.heappush(heap, (cost + 5 * fault, word + "K", i + 1, initial))


def _repair_expected(rows):
    talks = collections.defaultdict(list)
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        talks[c] += [(t, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for c, talk in talks.items():
        talk.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        seen, symbols, n = set(), [], collections.Counter()
        for _, role, text in talk:
            bare = text.strip(WHITE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            n[fault] += 1
            seen.add((role, text))
            symbols.append((role[:1], {"": 0, "truncated": 1}.get(fault, 2)))
        turns = [t for t, _, _ in talk if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(talk, talk[1:], strict=False))
        word, cost = _cheapest(symbols)
        stay, body, i = sum(x != "D" for x in word), [], 0
        for x in word:
            if x != "D":
                role = talk[i][1] if x == "K" else ("user", "assistant")[(len(body) - stay % 2) % 2]
                body.append(f"{role}:{'' if x == 'I' else talk[i][2]}")
            i += x != "I"
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal,
                  cost, word, _sha("\n".join(body)))
    return out


@pytest.fixture(scope="module")
def talk_rows():
    rnd = random.Random(8)
    roles = ["user", "assistant", "user", "assistant", "user", "assistant", "system", "tool", None, "u", ""]
    out = []
    for c in range(150):
        n = rnd.choice([1, 2, 3, 5, 8, 40])
        for t in range(n):
            role = roles[t % 2] if rnd.random() < 0.7 else rnd.choice(roles)
            text = rnd.choice(["Yes.", "No!", "cut", None, " \n", "é?", f"w{rnd.randrange(5)}.", f"text {t} of {c}.", "end. \r"])
            turn = t + rnd.choice([0, 0, 0, 0, 3 * n])
            out.append((c, turn if turn < n or rnd.random() < 0.9 else 3 * n + t, role, text))
    out += [(None, 1, "user", "a."), (None, 2, "assistant", "b."), (900, None, "user", "x."), (900, 5, "assistant", "y."), (901, 0, "user", "q" * 200000)]
    # one row a turn: rows of one turn are ordered by hash, which is tested apart
    return list({(c, t): (c, t, r, x) for c, t, r, x in out}.values())


@pytest.mark.parametrize("rows", [1 << 16, 3])
def test_conversation_repair(spark, talk_rows, monkeypatch, rows):
    """Whole conversations, and pieces of three rows over many ranges."""
    from aspectra.llm import conversation_repair as cr
    monkeypatch.setattr(cr, "PIECE_ROWS", rows)
    df = spark.createDataFrame(talk_rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit("other")).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["conv_id"]: tuple(r)[1:] for r in cr.repair_report(df).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == _repair_expected(talk_rows)


def test_conversation_ties_and_text(spark):
    """Equal rows of a turn are duplicates; the repaired text is given on request."""
    from aspectra.llm.conversation_repair import repair
    rows = [(1, 1, "user", "a?", 2), (1, 1, "user", "a?", 1), (1, 2, "assistant", "b.", 1), (2, 0, "user", "x.", 0), (3, 0, "user", "", 1)]
    got = {r["conv_id"]: r for r in repair(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, n int"), with_text=True).collect()}
    assert (got[1]["duplicate"], got[1]["audit"], got[1]["cost"], got[1]["repaired"]) == (2, "KDDK", 4, "user:a?\nassistant:b.")
    assert tuple(got[2])[1:8] == (0, 0, 0, 0, 0, 0, "") and got[2]["repaired"] == "" and got[2]["repaired_sha256"] == _sha("")
    assert (got[3]["audit"], got[3]["cost"], got[3]["blank"]) == ("D", 2, 1)


def test_conversation_empty(spark):
    from aspectra.llm.conversation_repair import repair_report
    assert repair_report(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_repair_of_long_runs():
    from aspectra.llm import repair_dp as dp
    rnd = random.Random(2)
    for _ in range(500):
        runs = [(rnd.choice([0, 1, 2, 2, 3, 4, 4, 5, 6, 7, 8]), rnd.choice([1, 1, 2, 3, 7, 20])) for _ in range(rnd.randrange(6))]
        symbols = bytes(s for s, n in runs for _ in range(n))
        assert dp.repair(symbols) == _cheapest([("sua-"[s // 2 % 4], 2 if s == 8 else s % 2) for s in symbols])
    word, cost = dp.repair(bytes([2]) * 3_000_001)
    assert (word, cost) == ("D" + "KR" * 1_500_000, 1_500_002)
