"""Safe places, texts without spaces, edits and their cost."""
import random
import re
import time

import pytest


@pytest.fixture(scope="module")
def count():
    import base64

    import tiktoken

    from aspectra.llm.token_counts import SPLIT, VOCABULARY
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("t", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda s: len(encode(s))


PIECES = ["a", "don", "'", "s", "'ll", "re", " ", "  ", "\n", "\t", "\x1f", " ", "　", "7", "²", "Ⅷ", "東京", "ですから", "。", "、", "!", "...", "é", "é", "й", "_", "🙂", "‍", "\x85"]


def test_counts_agree_on_any_mixture(count, monkeypatch):
    from aspectra.llm import token_counts
    from aspectra.llm.token_counts import TokenTree
    monkeypatch.setattr(token_counts, "LEAF", 3)
    rnd = random.Random(8)
    for _ in range(400):
        text = "".join(rnd.choices(PIECES, k=rnd.randrange(60)))
        tree = TokenTree(text, count)
        assert tree.text() == text and tree.total == count(text)
        for _ in range(6):
            a = rnd.randrange(len(text) + 1)
            b, by = min(len(text), a + rnd.randrange(5)), "".join(rnd.choices(PIECES, k=rnd.randrange(3)))
            tree.replace(a, b, by)
            text = text[:a] + by + text[b:]
            assert tree.text() == text and tree.total == count(text)


@pytest.mark.parametrize("unit", ["東京では今日も雨です。", "short line\n", "a,b;", "x1y22"])
def test_edits_stay_local_without_spaces(count, unit):
    from aspectra.llm.token_counts import TokenTree
    text = unit * 4000
    tree = TokenTree(text, count)
    for k in range(200, 0, -1):
        tree.replace(k * 17, k * 17 + 2, "<x>")
        text = text[:k * 17] + "<x>" + text[k * 17 + 2:]
    assert tree.total == count(text) and tree.encoded < 200 * 700


def test_redactions_equal_one_plain_search():
    from aspectra.llm.token_counts import REDACTIONS, redactions
    one = "|".join(f"(?P<g{i}>{p})" for i, (_, p) in enumerate(REDACTIONS))
    rnd = random.Random(4)
    parts = ["a@b.org", "x.y", "@", "+1 (017) 555-7713", "key=", "abcdefghijkl1", " ", "1.2.3.4", "1234567890123", "-", ".", "me", "\n", "é"]
    for _ in range(3000):
        text = "".join(rnd.choices(parts, k=rnd.randrange(12)))
        assert redactions(text) == [(m.start(), m.end(), REDACTIONS[int(m.lastgroup[1:])][0]) for m in re.finditer(one, text)]
    start = time.time()
    assert redactions("a" * 2_000_000) == [] and redactions("a@" * 200_000) == []
    assert time.time() - start < 20


def test_clashing_columns_and_nulls(spark):
    from aspectra.llm.token_counts import token_counts
    rows = [(1, "mail a@b.org now", 5, "x"), (1, "mail a@b.org now", 5, "x"), (None, None, None, None), (2, "", 1, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, n_edits string").repartition(2)
    got = sorted(((r["doc_id"] or 0), r["n_edits"], r["n_tokens"] > 0) for r in token_counts(df).collect())
    assert got == [(0, 0, False), (1, 1, True), (1, 1, True), (2, 0, False)]
