"""Cheapest repair of a conversation by min-plus transitions over run lengths.

The states are what the kept roles spell so far: nothing, ``s``, ``..u``, ``..a``;
nothing and ``..a`` are accepted.  A row's symbol is its role's initial and its fault.
Its transition holds, for two states, the cost of the cheapest edits of that row
(insertions stand before it) and how their letters rank among the other ends; edits
that lead to different states never share a beginning, so costs and ranks of a product
follow from its factors.  Equal symbols in a row are one run: a run is advanced through
powers of two of its transition, which are cached, and its letters are unrolled from
the same powers."""

from __future__ import annotations

from functools import lru_cache

FAR = 1 << 60
INSERT = {0: 2, 1: 2, 2: 3, 3: 2}                    # the state after the next role
KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
END = ((0, ""), (10, "II"), (5, "I"), (0, ""))       # cheapest way to be accepted
COST = {"I": 5, "K": 0, "R": 1, "D": 2}
TRUNCATED = 5
MUST_GO = 8                                          # symbol of blank rows and duplicates
INITIALS = "sua"                                     # any other initial is number 3


def symbol(initial: str, fault: int) -> int:
    """fault: 0 none, 1 truncated, 2 blank or duplicate."""
    if fault == 2:
        return MUST_GO
    return 2 * (INITIALS.find(initial) if len(initial) == 1 and initial in INITIALS else 3) + fault


def _ranked(best: dict) -> tuple:
    """(cost, rank, how) as rows of four from (p, q) -> (cost, order, how)."""
    cost, rank, how = [], [], []
    for p in range(4):
        ends = sorted((q for q in range(4) if (p, q) in best), key=lambda q: best[p, q][1])
        cost.append(tuple(best[p, q][0] if q in ends else FAR for q in range(4)))
        rank.append(tuple(ends.index(q) if q in ends else 0 for q in range(4)))
        how.append(tuple(best[p, q][2] if q in ends else None for q in range(4)))
    return tuple(cost), tuple(rank), tuple(how)


@lru_cache(maxsize=None)
def _single(sym: int) -> tuple:
    best: dict = {}
    for p in range(4):
        at, letters = p, ""
        for _ in range(3):                           # two insertions reach every state
            ends = [(at, "D", 0)]
            if sym != MUST_GO:
                extra = TRUNCATED * (sym % 2)
                ends.append((INSERT[at], "R", extra))
                kept = KEEP.get((at, (INITIALS + "-")[sym // 2]))
                if kept is not None:
                    ends.append((kept, "K", extra))
            for q, letter, extra in ends:
                word = letters + letter
                found = (sum(COST[x] for x in word) + extra, word, word)
                best[p, q] = min(best.get((p, q), found), found)
            at, letters = INSERT[at], letters + "I"
    return _ranked(best)


def product(a: tuple, b: tuple) -> tuple:
    """The transition of two pieces in a row; how: the state between them."""
    best = {}
    for p in range(4):
        for r in range(4):
            ways = [(a[0][p][q] + b[0][q][r], a[1][p][q], q) for q in range(4) if a[0][p][q] < FAR and b[0][q][r] < FAR]
            if ways:
                cost, rank, q = min(ways)
                best[p, r] = (cost, (rank, b[1][q][r]), q)
    return _ranked(best)


@lru_cache(maxsize=None)
def power(sym: int, k: int) -> tuple:
    """The transition of 2 ** k rows of one symbol."""
    return _single(sym) if k == 0 else product(power(sym, k - 1), power(sym, k - 1))


@lru_cache(maxsize=4096)
def _short(sym: int, k: int, p: int, q: int) -> str:
    how = power(sym, k)[2][p][q]
    return how if k == 0 else _short(sym, k - 1, p, how) + _short(sym, k - 1, how, q)


def letters(sym: int, k: int, p: int, q: int) -> str:
    """The edits of 2 ** k rows of one symbol between two states; long ones aren't kept."""
    if k <= 10:
        return _short(sym, k, p, q)
    how = power(sym, k)[2][p][q]
    return letters(sym, k - 1, p, how) + letters(sym, k - 1, how, q)


def blocks(symbols: bytes) -> list[tuple[int, int]]:
    """Runs of equal symbols as (symbol, k) of 2 ** k rows each."""
    out, i, n = [], 0, len(symbols)
    while i < n:
        s, j = symbols[i], i + 1
        while j < n and symbols[j] == s:
            j += 1
        out += [(s, k) for k in range((j - i).bit_length()) if (j - i) >> k & 1]
        i = j
    return out


def before(element: tuple, after: tuple) -> tuple[tuple, tuple]:
    """From the cost to go after a piece: the cost before it, and the state each state
    leaves it in."""
    cost, chosen = [], []
    for p in range(4):
        ways = [(element[0][p][q] + after[q], element[1][p][q], q) for q in range(4) if element[0][p][q] < FAR and after[q] < FAR]
        c, _, q = min(ways, default=(FAR, 0, 0))
        cost.append(c)
        chosen.append(q)
    return tuple(cost), tuple(chosen)


@lru_cache(maxsize=1 << 16)
def _before(sym: int, k: int, after: tuple) -> tuple[tuple, tuple, int]:
    """``before`` for costs whose least is 0, with what was taken off the result."""
    cost, chosen = before(power(sym, k), after)
    low = min(cost)
    return tuple(min(FAR, c - low) if c < FAR else FAR for c in cost), chosen, low


def segment(symbols: bytes) -> tuple:
    """The transition of a piece of a conversation (costs and ranks)."""
    out = None
    for s, k in blocks(symbols):
        out = power(s, k) if out is None else product(out, power(s, k))
    return out


def unroll(symbols: bytes, after: tuple, state: int = 0) -> tuple[str, int, int]:
    """(letters, state behind, cost to go before) of a piece that starts in ``state`` and
    has the costs to go ``after``."""
    parts, choices, low = blocks(symbols), [], min(after)
    after = tuple(c - low if c < FAR else FAR for c in after)
    for s, k in reversed(parts):
        after, chosen, off = _before(s, k, after)
        low += off
        choices.append(chosen)
    cost, out = after[state] + low, []
    for (s, k), chosen in zip(parts, reversed(choices), strict=True):
        q = chosen[state]
        out.append(letters(s, k, state, q))
        state = q
    return "".join(out), state, cost


END_COST = tuple(c for c, _ in END)


def repair(symbols: bytes) -> tuple[str, int]:
    """(cheapest edits, cost) of a whole conversation."""
    word, state, cost = unroll(symbols, END_COST)
    return word + END[state][1], cost


ROLE = {2: "user", 3: "assistant"}


def rows_after(word: str, roles: list[str], texts: list[bytes], state: int = 0) -> list[bytes]:
    """The rows (role, ``:``, text) that edits starting in ``state`` leave."""
    out, i = [], 0
    for letter in word:
        if letter == "D":
            i += 1
            continue
        if letter == "K":
            state, role = KEEP[state, roles[i][:1]], roles[i]
        else:
            state = INSERT[state]
            role = ROLE[state]
        out.append(role.encode() + b":" + (b"" if letter == "I" else texts[i]))
        i += letter != "I"
    return out
