"""Token counts that follow edits.

Each text is cut into leaves at places that are token boundaries whatever
stands around them: after a letter, digit or mark, where the kind of character
changes (so also in text without spaces).  A tree over
the leaves holds the sums of characters and tokens.  An edit finds its leaves by
the character sums, takes in a neighbour where its edge is no such place any
more, encodes that region again and updates the sums above it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's texts are split before merging (its authors' fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF = 256                   # characters from which a leaf ends at the next safe place

#: What the registered query edits: personal data and secrets give way to marks.
REDACTIONS = [
    ("<email>", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("<secret>", r"\b(?:key|token|secret|password)\s*[:=]\s*\"?[A-Za-z0-9_/+-]{12,}\"?"),
    ("<ip>", r"\b\d{1,3}(?:\.\d{1,3}){3}\b"),
    ("<phone>", r"\+\d{1,3} ?\(?\d{2,4}\)? ?\d{3}[ -]?\d{4}"),
    ("<number>", r"\b\d{13,19}\b"),
]


_EMAIL = re.compile(REDACTIONS[0][1])
# an address begins where its run of characters begins, so a long run is read once
_ALL = re.compile("|".join((r"(?<![A-Za-z0-9._%+-])" if i == 0 else "") + f"(?P<g{i}>{p})" for i, (_, p) in enumerate(REDACTIONS)))


def redactions(text: str) -> list[tuple[int, int, str]]:
    """Edits (start, end, replacement), by start and without overlap."""
    out, at = [], 0
    while True:
        # right after an edit an address may begin inside a run
        if m := at and _EMAIL.match(text, at):
            out.append((m.start(), m.end(), REDACTIONS[0][0]))
        elif m := _ALL.search(text, at):
            out.append((m.start(), m.end(), REDACTIONS[int(m.lastgroup[1:])][0]))
        else:
            return out
        at = m.end()


def _kind(c: str) -> str:
    """Letter, number, space or other, as SPLIT tells them apart."""
    if c.isalpha():
        return "L"
    if c.isspace() and not "\x1c" <= c <= "\x1f":
        return "S"
    return "N" if unicodedata.category(c)[0] == "N" else "P"


def _safe(left: str, right: str) -> bool:
    """Whether a token ends between two strings, whatever else is around them: every
    token but white space is of one kind (after one space), or an apostrophe with letters."""
    if not left or not right:
        return False
    a, b = _kind(left[-1]), _kind(right[0])
    return a != b and a != "S" and not (left[-1] == "'" and b == "L")


def leaves(text: str) -> list[str]:
    """The text cut at the first safe place after every LEAF characters."""
    out, at = [], 0
    while at < len(text):
        cut = at + LEAF
        while cut < len(text) and not _safe(text[cut - 1], text[cut]):
            cut += 1
        out.append(text[at:cut])
        at = cut
    return out or [""]


class TokenTree:
    """Sums of characters and tokens over the leaves of one text."""

    def __init__(self, text: str, count: Callable[[str], int]):
        self.leaf, self.count, self.encoded = leaves(text), count, 0
        self.m = 1 << (len(self.leaf) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.m), [0] * (2 * self.m)
        for i, s in enumerate(self.leaf):
            self.chars[self.m + i], self.tokens[self.m + i] = len(s), count(s)
        for sums in (self.chars, self.tokens):
            for i in range(self.m - 1, 0, -1):
                sums[i] = sums[2 * i] + sums[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.leaf)

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds a character, and the character's place in it."""
        node = 1
        while node < self.m:
            node *= 2
            if at >= self.chars[node] and self.chars[node + 1]:
                at -= self.chars[node]
                node += 1
        return node - self.m, at

    def _set(self, i: int, s: str) -> None:
        chars, tokens = len(s), self.count(s) if s else 0
        self.leaf[i], self.encoded = s, self.encoded + chars
        dc, dt, node = chars - self.chars[self.m + i], tokens - self.tokens[self.m + i], self.m + i
        while node:
            self.chars[node] += dc
            self.tokens[node] += dt
            node //= 2

    def replace(self, start: int, end: int, by: str) -> None:
        """Replaces the characters [start, end)."""
        i, a = self._find(start)
        j, b = self._find(max(start, end - 1))
        b += end > start
        region, lo, hi = self.leaf[i][:a] + by + self.leaf[j][b:], i, j
        while lo > 0 and not (self.leaf[lo - 1] and _safe(self.leaf[lo - 1], region)):
            lo -= 1
            region = self.leaf[lo] + region
        while hi + 1 < len(self.leaf) and not (self.leaf[hi + 1] and _safe(region, self.leaf[hi + 1])):
            hi += 1
            region += self.leaf[hi]
        for k in range(lo + 1, hi + 1):
            if self.leaf[k]:
                self._set(k, "")
        self._set(lo, region)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: Callable[[str], list] = redactions,
                 vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_edits, n_tokens_edited,
    n_chars_again (characters encoded again for the edits).

    ``edits`` gives a text's edits as (start, end, replacement), sorted and
    without overlap.  A null or empty text has no tokens and no edits; a very long
    one is cut into leaves of about LEAF characters (longer only where one word or run of marks is).  Repeated
    rows give equal rows; other columns are ignored; an empty table gives an
    empty result.  The vocabulary is read on the driver and broadcast (a fixed
    file of about 1 MB)."""
    with open(vocabulary, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())
    split = SPLIT

    def run(batches):
        import base64

        import pyarrow as pa
        import tiktoken

        # one encoder per worker process, not per task
        made = getattr(tiktoken, "_kept_encoder", None)
        if made is None or made[0] != hash(held.value):
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, held.value.splitlines())}
            made = hash(held.value), tiktoken.Encoding("kept", pat_str=split, mergeable_ranks=ranks, special_tokens={})
            tiktoken._kept_encoder = made
        encode = made[1].encode_ordinary
        names = ["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_chars_again"]
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                text = text or ""
                tree = TokenTree(text, lambda s: len(encode(s)))
                before, found = tree.total, edits(text)
                for start, end, by in reversed(found):           # from the back: places before an edit stay
                    tree.replace(start, end, by)
                out.append((before, len(found), tree.total, tree.encoded))
            if out:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in zip(*out, strict=True))], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_edits long, n_tokens_edited long, n_chars_again long")
