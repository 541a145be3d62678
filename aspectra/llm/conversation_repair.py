"""Repair of conversation structure: faults, cheapest edits, and an audit of them.

One sort by ranges of (conversation, turn, role, text) streams through each task, so
a conversation of any length is spread over the ranges.  A conversation that lies
inside a range, and below ``PIECE_BYTES``, is repaired as it passes.  The first and the
last of a range and longer ones are carried as pieces: rows seen in an earlier piece
are found by a join of hashes, each piece is summed up as one min-plus transition of
16 costs, the pieces of a conversation are chained over those alone, and then every
piece unrolls its own edits.  Only the digest and the audit need the order of a whole
conversation; they are updated piece by piece.

Defined cases: a null role or text is one space, a null id or turn too where they are
hashed; rows without conv_id are one conversation; turns ascend, nulls first, rows of
one turn by role, then by hash of the text and text; equal rows of a turn are
duplicates; a conversation without rows has zeros, no audit and the digest of nothing;
other columns are ignored, whatever their names; an empty table gives no rows.  The
audit is one string, so a conversation may have up to 2 ** 31 rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aspectra.llm import repair_dp as dp
from aspectra.session import cut_lineage

PIECE_BYTES = 8 << 20        # of text that a task holds of one conversation
PIECE_ROWS = 1 << 16
_SPACE = " \t\n\x0b\x0c\r"
_LEGAL = {"su", "ua", "au"}
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): rows with faults put in by the CRC-32 of
    ``conv_id:turn``; n is how often the row stands there (0: dropped)."""
    def or_space(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn"))) % 20
    rows = conversations.select("conv_id", "turn", or_space("role").alias("role"), or_space("text").alias("text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.when(F.col("_kind") == 0, 0).when(F.col("_kind") == 3, 2).otherwise(1).alias("n"))


def _sorted(rows: DataFrame) -> DataFrame:
    """Rows with their own fault (2 blank, 1 truncated), sorted by ranges."""
    bare = F.rtrim(F.col("text"), F.lit(_SPACE))
    fault = F.when(bare == "", 2).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), 0).otherwise(1)
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.col("text").cast("binary").alias("text"),
                       F.col("n").cast("int").alias("n"), fault.cast("int").alias("fault"), F.xxhash64("text").alias("h"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("h")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").drop("h")


class _Piece:
    """Consecutive rows of a conversation."""

    def __init__(self, conv, turns=(), roles=(), texts=(), faults=b""):
        self.conv, self.turns, self.roles, self.texts, self.faults, self.size = conv, list(turns), list(roles), list(texts), bytearray(faults), 0

    def add(self, turn, role, text, fault) -> None:
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.faults.append(fault)
        self.size += len(text)

    def judge(self, again=frozenset()) -> tuple[bytes, dict]:
        """(symbols, counts) with the hashes of rows that earlier pieces hold."""
        seen, symbols, n = set(again), bytearray(), {"blank": 0, "duplicate": 0, "truncated": 0}
        for role, text, fault in zip(self.roles, self.texts, self.faults, strict=True):
            if fault == 2:
                n["blank"] += 1
            else:
                key = _key(self.conv, role, text)
                if key in seen:
                    n["duplicate"] += 1
                    fault = 2
                else:
                    seen.add(key)
                    n["truncated"] += fault
            symbols.append(dp.symbol(role[:1], fault))
        first = [r[:1] for r in self.roles]
        turns = [t for t in self.turns if t is not None]
        n["illegal"] = sum(a + b not in _LEGAL for a, b in zip(first, first[1:], strict=False))
        n["distinct"] = len(set(turns))
        n |= {"low": min(turns, default=None), "high": max(turns, default=None), "first": first[0] if first else None, "last": first[-1] if first else None}
        return bytes(symbols), n


def _key(conv, role: str, text: bytes) -> bytes:
    from hashlib import blake2b
    head = f"{conv!r}\n{len(role)}\n{role}\n".encode()
    return blake2b(head + text, digest_size=16).digest()


def _gaps(low, high, distinct: int) -> int:
    return 0 if low is None else high - low + 1 - distinct


def _table(rows: list[dict], schema):
    """A record batch of dicts in the column order of an Arrow schema."""
    import pyarrow as pa
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _arrow(schema: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(T._parse_datatype_string(schema))


def _out(schema: str, of_rows):
    """A mapInArrow function from ``of_rows``, a generator of dicts over batches; a batch
    goes out whenever about 8 MB of bytes and lists are together."""
    target = _arrow(schema)

    def run(batches):
        rows, size = [], 0
        for row in of_rows(batches):
            rows.append(row)
            size += 200 + sum(len(v) if isinstance(v, (bytes, str)) else 0 for v in row.values()) + sum(map(len, row.get("texts") or ()))
            if size > 8 << 20:
                yield _table(rows, target)
                rows, size = [], 0
        if rows:
            yield _table(rows, target)
    return run


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, repaired binary"
_PIECE = "part long, seg long, turns array<long>, roles array<string>, texts array<binary>, faults binary"
_FACTS = "blank long, duplicate long, truncated long, illegal long, distinct long, low long, high long, first string, last string"


def _whole(piece: _Piece, with_text: bool) -> dict:
    from hashlib import sha256
    symbols, n = piece.judge()
    audit, cost = dp.repair(symbols)
    text = b"\n".join(dp.rows_after(audit, piece.roles, piece.texts))
    return {"conv_id": piece.conv, "gaps": _gaps(n["low"], n["high"], n["distinct"]), "cost": cost, "audit": audit,
            "repaired_sha256": sha256(text).hexdigest(), "repaired": text if with_text else None,
            **{c: n[c] for c in ("blank", "duplicate", "truncated", "illegal")}}


def _first_pass(with_text: bool, piece_bytes: int, piece_rows: int):
    """Results of the conversations inside the range, pieces of the others."""
    def run(batches):
        from pyspark import TaskContext
        part, piece, seg, whole = TaskContext.get().partitionId(), None, 0, False

        def carried():
            return {"conv_id": piece.conv, "part": part, "seg": seg, "turns": piece.turns, "roles": piece.roles,
                    "texts": piece.texts, "faults": bytes(piece.faults)}

        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "n", "fault")]
            for conv, turn, role, text, n, fault in zip(*columns, strict=True):
                if piece is None or conv != piece.conv:
                    if piece is not None:
                        yield _whole(piece, with_text) if whole else carried()
                        seg += 1
                    whole = piece is not None        # the first of a range may have begun before it
                    piece = _Piece(conv)
                for _ in range(n):
                    if piece.size > piece_bytes or len(piece.roles) >= piece_rows:
                        yield carried()
                        piece, seg, whole = _Piece(conv), seg + 1, False
                    piece.add(turn, role, text, fault)
        if piece is not None:
            yield carried()
    return run


def _keys(batches):
    """The hashes of a piece's rows, each once."""
    for b in batches:
        for r in b.to_pylist():
            keys = {_key(r["conv_id"], role, text) for role, text, fault in zip(r["roles"], r["texts"], r["faults"], strict=True) if fault != 2}
            for key in keys:
                yield {"part": r["part"], "seg": r["seg"], "key": key}


def _judged(batches):
    """Pieces with symbols, counts and their transition."""
    for b in batches:
        for r in b.to_pylist():
            piece = _Piece(r["conv_id"], r["turns"], r["roles"], r["texts"], r["faults"])
            symbols, n = piece.judge(r["again"] or ())
            costs, ranks, _ = dp.segment(symbols) if symbols else (None, None, None)
            yield {"conv_id": r["conv_id"], "part": r["part"], "seg": r["seg"], "roles": r["roles"], "texts": r["texts"], "symbols": symbols,
                   "costs": costs and sum(costs, ()), "ranks": ranks and sum(ranks, ()), **n}


def _chained(batches):
    """State before and costs to go after each piece of a conversation."""
    for b in batches:
        for r in b.to_pylist():
            after, found = dp.END_COST, []
            for p in reversed(r["pieces"]):
                chosen = (0, 1, 2, 3)
                behind = after
                if p["costs"]:
                    rows = [tuple(p[c][i:i + 4] for i in range(0, 16, 4)) for c in ("costs", "ranks")]
                    after, chosen = dp.before(rows, after)
                found.append((p, behind, chosen))
            state = 0
            for p, behind, chosen in reversed(found):
                yield {"part": p["part"], "seg": p["seg"], "state": state, "after": behind, "cost": after[0]}
                state = chosen[state]


def _unrolled(batches):
    """The letters and remaining rows of each piece."""
    for b in batches:
        for r in b.to_pylist():
            word, state, _ = dp.unroll(r["symbols"], tuple(r["after"]), r["state"])
            rows = dp.rows_after(word, r["roles"], r["texts"], r["state"])
            keep = ("conv_id", "part", "seg", "cost", "blank", "duplicate", "truncated", "illegal", "distinct", "low", "high", "first", "last")
            yield {c: r[c] for c in keep} | {"word": word, "state": state, "kept": len(rows), "body": b"\n".join(rows)}


def _joined(with_text: bool):
    """One result a conversation from its pieces in order."""
    def run(batches):
        from hashlib import sha256
        now = None

        def result():
            rest = dp.END[now["state"]][1]
            for row in dp.rows_after(rest, [], [], now["state"]):
                take(1, row)
            return {"conv_id": now["conv"], "gaps": _gaps(now["low"], now["high"], now["distinct"]), "cost": now["cost"],
                    "audit": "".join(now["words"]) + rest, "repaired_sha256": now["sha"].hexdigest(),
                    "repaired": b"\n".join(now["bodies"]) if with_text else None,
                    **{c: now[c] for c in ("blank", "duplicate", "truncated", "illegal")}}

        def take(kept, body):
            if kept:
                now["sha"].update((b"\n" if now["any"] else b"") + body)
                now["any"] = True
                if with_text:
                    now["bodies"].append(body)

        for b in batches:
            for r in b.to_pylist():
                if now is None or r["conv_id"] != now["conv"]:
                    if now is not None:
                        yield result()
                    now = {"conv": r["conv_id"], "low": None, "high": None, "distinct": 0, "words": [], "sha": sha256(), "any": False,
                           "bodies": [], "last": None, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
                for c in ("blank", "duplicate", "truncated", "illegal", "distinct"):
                    now[c] += r[c]
                if r["low"] is not None:
                    now["distinct"] -= now["high"] == r["low"]
                    now["low"] = r["low"] if now["low"] is None else now["low"]
                    now["high"] = r["high"]
                if r["first"] is not None:
                    now["illegal"] += now["last"] is not None and now["last"] + r["first"] not in _LEGAL
                    now["last"] = r["last"]
                now["words"].append(r["word"])
                now["state"], now["cost"] = r["state"], r["cost"]
                take(r["kept"], r["body"])
        if now is not None:
            yield result()
    return run


def _map(df: DataFrame, schema: str, of_rows) -> DataFrame:
    return df.mapInArrow(_out(schema, of_rows), schema)


def _chain(pieces: DataFrame, conv: str, with_text: bool) -> DataFrame:
    """Results of conversations that are carried as pieces."""
    at = ["part", "seg"]
    keys = cut_lineage(_map(pieces, "part long, seg long, key binary", _keys))
    first = keys.groupBy("key").agg(F.min(F.struct(*at)).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = keys.join(first, "key").where(F.struct(*at) > F.col("first")).groupBy(*at).agg(F.collect_list("key").alias("again"))
    judged = f"{conv}, part long, seg long, roles array<string>, texts array<binary>, symbols binary, costs array<long>, ranks array<long>, {_FACTS}"
    pieces = cut_lineage(_map(pieces.join(again, at, "left"), judged, _judged))
    by_conv = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*at, "costs", "ranks"))).alias("pieces"))
    ends = _map(by_conv, "part long, seg long, state int, after array<long>, cost long", _chained)
    unrolled = f"{conv}, part long, seg long, cost long, {_FACTS}, word string, state int, kept long, body binary"
    done = _map(pieces.drop("costs", "ranks").join(ends, at), unrolled, _unrolled)
    done = done.repartition("conv_id").sortWithinPartitions("conv_id", *at)
    return _map(done, f"{conv}, {_RESULT}", _joined(with_text))


def repair(rows: DataFrame, with_text: bool = False) -> DataFrame:
    """A row a conversation of (conv_id, turn, role, text, n): counts of faults, cost,
    audit and digest of the repaired conversation, and its text if asked for."""
    conv = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}"
    both = f"{conv}, {_RESULT}, {_PIECE}"
    # the pieces of a stage share the task's number, so it must not be planned twice
    first = cut_lineage(_map(_sorted(rows), both, _first_pass(with_text, PIECE_BYTES, PIECE_ROWS)))
    results = [f.strip().split()[0] for f in _RESULT.split(",")]
    whole = first.where("part is null").select("conv_id", *results)
    pieces = first.where("part is not null").select("conv_id", "part", "seg", "turns", "roles", "texts", "faults")
    out = whole.union(_chain(pieces, conv, with_text)).select("conv_id", *results)
    return out.withColumn("repaired", F.col("repaired").cast("string")) if with_text else out.drop("repaired")


def repair_report(conversations: DataFrame) -> DataFrame:
    """Faults, cost, audit and digest of every damaged conversation."""
    return repair(damage(conversations))
