"""Removal of long repeated passages with suffix arrays of shards.

1. Anchors: of each window of ``width`` bytes the smallest hash of its
   ``GRAM``-byte strings.  Equal windows have equal anchors, so only windows
   whose anchor occurs in two different texts can repeat.  A run of windows with
   one anchor is a string of about ``width + 16`` bytes.  Its 63-bit print and 32
   bits of its anchor are counted in buckets whose number follows the corpus; a
   task sends each string once.  A string that a smaller id also has is removed
   whole.
2. Of each other string whose anchor has several strings, the smallest id cuts
   it out, and the strings of an anchor go to one shard.
3. A shard gets a suffix array by induced sorting and permuted common prefixes:
   neighbours that share ``width`` bytes give the windows that also occur in a
   document with a smaller id.
4. The windows of a document are merged and their bytes removed.

Exact copies of whole texts are recognised by their digest and take no part in
1 to 3.  An anchor with very many different strings is not sorted in one shard:
its windows are grouped as rows (``_grouped_windows``).
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aspectra.llm.common import SLICE_BYTES, byte_prefix, give_back, mix64, release, text_slices, tidy
from aspectra.llm.suffix_array import earlier_windows
from aspectra.session import cut_lineage

WIDTH, GRAM = 50, 20
BUCKET_BYTES = 16 << 20      # text per bucket of anchors
FLUSH_BYTES = 48 << 20       # memory of the anchors that a task holds before it sends them
ANCHOR_BYTES = 96            # of one held string: its prints and what sorting and grouping them takes
SHARD_BYTES = 1 << 20
MANY = 10_000                # strings of one anchor beyond which they are grouped as rows

LONG = 512                   # bytes of a string beyond which its print is a digest
WHOLE = np.uint64(1)         # last bit of a print: the string is removed whole

_DOC = np.dtype([("id", "<i8"), ("text", "<u8")])


def _runs(joined: bytes, at: np.ndarray, width: int):
    """(anchor, print, start, end, text's number, hashes of all strings of GRAM bytes)
    of all runs of windows with one anchor in the joined texts, whose bounds are
    ``at``; a run lies within one text."""
    data = np.frombuffer(joined, np.uint8)
    n = len(data)
    if n < width:
        return (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3, np.zeros(0, np.uint64))
    prefix, inverse = byte_prefix(data)
    grams = low = mix64((prefix[GRAM:] - prefix[:-GRAM]) * inverse[:n - GRAM + 1])
    have, need = 1, width - GRAM + 1                 # minimum over `need` neighbours by doubling
    while have < need:
        step = min(have, need - have)
        low = np.minimum(low[:len(low) - step], low[step:])
        have += step
    valid = np.ones(len(low), bool)                  # windows that lie within one text
    new = np.ones(len(low), bool)
    new[1:] = low[1:] != low[:-1]
    for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        valid[max(x, y - width + 1):y] = False
        new[x:x + 1] = True
    start = np.flatnonzero(new & valid)
    stop = np.ones(len(low), bool)                   # last windows of runs
    stop[:-1] = new[1:] | ~valid[1:]
    end = np.flatnonzero(stop & valid) + width
    prints = mix64((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))
    for i in np.flatnonzero(end - start > LONG):
        prints[i] = int.from_bytes(blake2b(joined[start[i]:end[i]], digest_size=8).digest(), "little")
    return low[start], prints & ~WHOLE, start, end, np.searchsorted(at, start, "right") - 1, grams


def _gram_places(grams, anchor, start, end, width: int):
    """Place in the string of the anchor's string, -1 if its first and last window
    have different ones."""
    out = np.empty(len(start), np.int64)
    near = np.arange(width - GRAM + 1)
    for i in range(0, len(start), 4096):             # 31 hashes of each window at once
        a, x, y = anchor[i:i + 4096, None], start[i:i + 4096], end[i:i + 4096] - width
        first, last = ((grams[z[:, None] + near] == a).argmax(axis=1) + z for z in (x, y))
        out[i:i + 4096] = np.where(first == last, first - x, -1)
    return out


def _bounds(texts: list[bytes]) -> np.ndarray:
    return np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def _starts(*columns) -> np.ndarray:
    """Where a run of equal values begins (of sorted columns)."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _by_document(prints, doc, ids):
    """(id, prints as bytes) of the documents."""
    if not len(prints):
        return []
    order = np.argsort(doc, kind="stable")
    prints, doc = prints[order], doc[order]
    cut = _starts(doc)
    return [(int(ids[doc[i]]), prints[i:j].tobytes()) for i, j in zip(cut, np.append(cut[1:], len(doc)), strict=True)]


def _candidates(texts: DataFrame, buckets: int, width: int) -> DataFrame:
    """(id, print): the strings of a document that a smaller id also has (their prints
    have the bit WHOLE), and those that it has first and of whose anchor another
    document has another string."""
    def send(batches):
        import pyarrow as pa
        schema = pa.schema([("bucket", pa.int32()), ("id", pa.int64()), ("prints", pa.binary()), ("docs", pa.binary())])
        held, docs, size = [], [], 0

        def rows():
            table = np.array(docs, _DOC)
            order = np.lexsort((table["id"], table["text"]))
            order = order[_starts(table["text"][order])]     # of copies the smallest id, the one that stays
            order = order[np.argsort(table["id"][order], kind="stable")]
            rank = np.full(len(table), -1, np.int32)         # by id
            rank[order] = np.arange(len(order), dtype=np.int32)
            table = table[order]
            anchor, prints, doc = (np.concatenate([x[j] for x in held]) for j in (0, 1, 2))
            held.clear()
            doc = rank[doc]
            if len(order) < len(rank):
                one = np.flatnonzero(doc >= 0)
                anchor, prints, doc = anchor[one], prints[one], doc[one]
            order = np.argsort(prints)
            anchor, prints, doc = anchor[order], prints[order], doc[order]
            first = _starts(prints)
            low = np.minimum.reduceat(doc, first)            # the smallest id of a string
            later = np.flatnonzero(table["id"][doc] > np.repeat(table["id"][low], np.diff(np.append(first, len(doc)))))
            # known to repeat here: straight to the documents
            out = [(d % buckets, d, x, None) for d, x in _by_document(prints[later] | WHOLE, doc[later], table["id"])]
            anchor, prints, doc = anchor[first], prints[first], low
            del first, later
            to = (anchor % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((doc, to))
            anchor, prints, doc, to = (anchor[order] >> np.uint64(32)).astype(np.uint32), prints[order], doc[order], to[order]
            cut = _starts(to)
            for i, j in zip(cut, np.append(cut[1:], len(to)), strict=True):
                mine, number = np.unique(doc[i:j], return_inverse=True)
                kind = number.astype(np.uint16 if len(mine) <= 1 << 16 else np.uint32)
                out.append((int(to[i]), None, prints[i:j].tobytes() + anchor[i:j].tobytes() + kind.tobytes(), table[mine].tobytes()))
            for i in range(0, len(out), 500):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[i:i + 500], strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            ids, digest = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            for first, texts in text_slices(b, "text"):
                anchor, prints, _, _, owner, _ = _runs(b"".join(texts), _bounds(texts), width)
                held.append((anchor, prints, owner.astype(np.int32) + np.int32(len(docs))))
                docs += [(i, int.from_bytes(d[:8], "little")) for i, d in zip(ids[first:first + len(texts)], digest[first:first + len(texts)], strict=True)]
                size += len(prints) + len(texts)
                if size * ANCHOR_BYTES >= FLUSH_BYTES:
                    yield from rows()
                    held, docs, size = [], [], 0
        if size:
            yield from rows()

    def count(table):
        import pyarrow as pa
        hs, anchors, at, docs, n = [], [], [], [], 0
        ids, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for x, i, d in zip(table.column("prints").to_pylist(), table.column("id").to_pylist(), table.column("docs").to_pylist(), strict=True):
            if d is None:
                found.append(np.frombuffer(x, np.uint64))
                ids.append(np.full(len(found[-1]), i, np.int64))
                continue
            d = np.frombuffer(d, _DOC)
            m = len(x) // (14 if len(d) <= 1 << 16 else 16)
            hs.append(np.frombuffer(x[:8 * m], np.uint64))
            anchors.append(np.frombuffer(x[8 * m:12 * m], np.uint32))
            at.append(np.frombuffer(x[12 * m:], np.uint16 if len(d) <= 1 << 16 else np.uint32).astype(np.int32) + np.int32(n))
            docs.append(d)
            n += len(d)
        if hs:
            docs = np.concatenate(docs)
            # documents are numbered by id
            by = np.argsort(docs["id"], kind="stable")
            rank = np.empty(len(by), np.int32)
            rank[by] = np.arange(len(by), dtype=np.int32)
            docs = docs[by]
            h, anchor, doc = np.concatenate(hs), np.concatenate(anchors), rank[np.concatenate(at)]
            del hs, anchors, at, rank, by
            key = anchor.astype(np.uint64) << np.uint64(32) | h >> np.uint64(32)
            order = np.argsort(key)
            if (h[order][1:] != h[order][:-1])[key[order][1:] == key[order][:-1]].any():
                order = np.lexsort((h, anchor))              # strings that differ in the last bits only
            del key
            h, anchor, doc = h[order], anchor[order], doc[order]
            string = _starts(h, anchor)
            first = np.minimum.reduceat(doc, string)
            low = docs["id"][first]
            # strings of one anchor whose smallest ids differ are compared
            group = _starts(anchor[string])
            differ = np.minimum.reduceat(low, group) < np.maximum.reduceat(low, group)
            own = np.flatnonzero(np.repeat(differ, np.diff(np.append(group, len(string)))))
            found.append(h[string[own]])
            ids.append(low[own])
            # what other documents have later goes whole; copies of one text count once
            number = np.repeat(np.arange(len(string)), np.diff(np.append(string, len(h))))
            text = docs["text"][doc]
            later = np.flatnonzero((docs["id"][doc] > low[number]) & (text != docs["text"][first][number]))
            later = later[np.lexsort((doc[later], text[later], number[later]))]
            later = later[_starts(number[later], text[later])]
            found.append(h[later] | WHOLE)
            ids.append(docs["id"][doc[later]])
            del h, anchor, doc, later, number, text, order, first, low
        out = pa.table({"id": np.concatenate(ids), "print": np.concatenate(found).view(np.int64)})
        del ids, found
        give_back()
        return out

    return (texts.select("id", "digest", "text").mapInArrow(tidy(send), "bucket int, id long, prints binary, docs binary")
            .groupBy("bucket").applyInArrow(count, "id long, print long"))


def _packed(docs: DataFrame, id_col: str, text_col: str, keep=()) -> DataFrame:
    """(id, tag, text, kept columns): texts compressed for the shuffle; the tag is
    part of the text's digest and tells apart rows that share an id."""
    def run(batches):
        import hashlib

        import pyarrow as pa
        codec = pa.Codec("zstd", compression_level=3)
        for b in batches:
            texts = [t or b"" for t in b.column("text").to_pylist()]
            tags = [int.from_bytes(hashlib.md5(t).digest()[:8], "big", signed=True) for t in texts]
            cols = {n: b.column(n) for n in b.schema.names}
            cols |= {"tag": pa.array(tags, pa.int64()), "text": pa.array([len(t).to_bytes(8, "little") + codec.compress(t, asbytes=True) for t in texts], pa.binary())}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    df = docs.select(F.col(id_col).cast("long").alias("id"), F.lit(0).cast("long").alias("tag"), raw.alias("text"), *keep)
    return df.mapInArrow(tidy(run), df.schema)


def _unpacked(texts: list[bytes]):
    """Texts that ``_packed`` has compressed, one by one."""
    import pyarrow as pa
    codec = pa.Codec("zstd")
    for t in texts:
        n = int.from_bytes(t[:8], "little")
        yield codec.decompress(t[8:], n, asbytes=True) if n else b""


def _cut_out(rows: DataFrame, width: int) -> DataFrame:
    """(anchor, string, gram, id, tag, at, to): the strings that are to be compared;
    gram is the anchor's place in the string, -1 if it has several.  The
    strings that go whole are merged into runs that carry their end instead."""
    def run(batches):
        import pyarrow as pa
        schema = pa.schema([("anchor", pa.int64()), ("string", pa.binary()), ("gram", pa.int32()), ("id", pa.int64()), ("tag", pa.int64()), ("at", pa.int64()), ("to", pa.int64())])
        apart = np.uint64(0x9E3779B97F4A7C15)

        def slices(b):
            """(first row, texts) of at most SLICE_BYTES."""
            first, size, part = 0, 0, []
            for i, z in enumerate(b.column("text").to_pylist()):
                n = int.from_bytes(z[:8], "little")
                if part and size + n > SLICE_BYTES:
                    yield first, list(_unpacked(part))
                    first, size, part = i, 0, []
                part.append(z)
                size += n
            if part:
                yield first, list(_unpacked(part))

        for b in batches:
            ids, tags = (b.column(c).to_numpy() for c in ("id", "tag"))
            known, ends = b.column("prints").values.to_numpy().view(np.uint64), b.column("prints").offsets.to_numpy()
            for first, texts in slices(b):
                joined, at = b"".join(texts), _bounds(texts)
                anchor, prints, start, end, owner, grams = _runs(joined, at, width)
                # a document's number goes into the keys, so that each asks for its own prints
                mine = known[ends[first]:ends[first + len(texts)]]
                of = np.repeat(np.arange(len(texts)), np.diff(ends[first:first + len(texts) + 1])).astype(np.uint64)
                key, salt = mix64(prints + owner.astype(np.uint64) * apart), of * apart
                whole = np.isin(key, mix64((mine & ~WHOLE) + salt)[mine & WHOLE == WHOLE])
                own = np.flatnonzero(np.isin(key, mix64(mine + salt)[mine & WHOLE != WHOLE]) & ~whole)
                if len(own):
                    row, gram = owner[own], _gram_places(grams, anchor[own], start[own], end[own], width)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(anchor[own].view(np.int64)), pa.array([joined[x:y] for x, y in zip(start[own].tolist(), end[own].tolist(), strict=True)], pa.binary()),
                        pa.array(gram.astype(np.int32)), pa.array(ids[first + row]), pa.array(tags[first + row]), pa.array(start[own] - at[row]), pa.nulls(len(own), pa.int64())], schema=schema)
                x, y, row = start[whole], end[whole], owner[whole]
                if len(x):
                    new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (x[1:] > y[:-1]))))
                    y, x, row = y[np.append(new[1:], len(y)) - 1], x[new], row[new]
                    yield pa.RecordBatch.from_arrays([
                        *(pa.nulls(len(x), schema.field(c).type) for c in ("anchor", "string", "gram")),
                        pa.array(ids[first + row]), pa.array(tags[first + row]), pa.array(x - at[row]), pa.array(y - at[row])], schema=schema)

    return rows.mapInArrow(tidy(run), "anchor long, string binary, gram int, id long, tag long, at long, to long")


def _sorted_shards(rows: DataFrame, width: int, shard_bytes: int, many: int) -> DataFrame:
    """(id, tag, at, to): the runs of windows that a smaller id also has.  Rows with
    ``to`` are such runs already.  An anchor with more than ``many`` different
    strings passes on with its strings."""
    out = "id long, tag long, at long, to long, string binary"

    def run(batches):
        import pyarrow as pa
        schema = pa.schema([("id", pa.int64()), ("tag", pa.int64()), ("at", pa.int64()), ("to", pa.int64()), ("string", pa.binary())])

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        def sides(string, g):
            half = (width - GRAM) // 2
            return [e for e in (string[g - half:g + GRAM] if g >= half else b"", string[g:g + GRAM + half]) if len(e) == GRAM + half] if g >= 0 else []

        def solve(shard):
            """shard: for each anchor its strings, each with its places (id, tag, at)
            and the anchor's place."""
            found, strings, owners, places = [], [], [], []
            for by_string in shard:
                # a common window holds the anchor and half of the rest on one side of it
                ends, shared = {}, set()
                if len(by_string) > 1:
                    for string, (where, g) in by_string.items():
                        low = min(w[0] for w in where)
                        shared.update(e for e in sides(string, g) if ends.setdefault(e, low) != low)
                several = any(g < 0 for _, g in by_string.values())
                for string, (where, g) in by_string.items():
                    low = min(w[0] for w in where)
                    found += [(i, tag, at, at + len(string), None) for i, tag, at in where if i > low]
                    if len(by_string) > 1 and (several or any(e in shared for e in sides(string, g))):
                        strings.append(string)
                        owners.append(low)
                        places.append([w for w in where if w[0] == low])
            if strings:
                for w, own in zip(earlier_windows(strings, np.array(owners), width), places, strict=True):
                    if len(w):
                        new = np.flatnonzero(np.diff(w) > width)
                        for x, y in zip(w[np.append(0, new + 1)].tolist(), (w[np.append(new, len(w) - 1)] + width).tolist(), strict=True):
                            found += [(i, tag, at + x, at + y, None) for i, tag, at in own]
            return found

        shard, size, mine, anchor, grouped = [], 0, {}, None, False
        for b in batches:
            passed = []
            for a, string, g, i, tag, at, to in zip(*(b.column(c).to_pylist() for c in ("anchor", "string", "gram", "id", "tag", "at", "to")), strict=True):
                if to is not None:
                    passed.append((i, tag, at, to, None))
                    continue
                if a != anchor:
                    shard.append(mine)
                    if size > shard_bytes:
                        passed += solve(shard)
                        shard, size = [], 0
                    anchor, mine, grouped = a, {}, False
                if not grouped:
                    if string not in mine:
                        mine[string] = [], g
                        size += len(string)
                    mine[string][0].append((i, tag, at))
                    if len(mine) > many:
                        passed += [(*w, None, s) for s, (where, _) in mine.items() for w in where]
                        mine, grouped = {}, True
                else:
                    passed.append((i, tag, at, None, string))
            if passed:
                yield table(passed)
        if passed := solve([*shard, mine]):
            yield table(passed)

    key = F.coalesce("anchor", F.xxhash64("id", "at"))
    return rows.withColumn("key", key).repartition("key").sortWithinPartitions("anchor").drop("key").mapInArrow(tidy(run), out)


def _grouped_windows(rows: DataFrame, width: int) -> DataFrame:
    """The same for anchors with very many strings: every window is a row."""
    w = rows.select("id", "tag", "at", F.posexplode(F.expr(
        f"transform(sequence(1, length(string) - {width - 1}), i -> substring(string, i, {width}))")).alias("x", "window"))
    low = w.groupBy("window").agg(F.min("id").alias("low"))
    return w.join(low, "window").where("low < id").select("id", "tag", (F.col("at") + F.col("x")).alias("at"), (F.col("at") + F.col("x") + width).alias("to"))


def _spans(docs: DataFrame, id_col: str, text_col: str, width: int, shard_bytes: int = SHARD_BYTES, many: int = MANY) -> DataFrame:
    """(id, tag, copy, spans) of the documents that lose bytes."""
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    texts = (docs.where(F.col(id_col).isNotNull())
             .select(F.col(id_col).cast("long").alias("id"), F.unhex(F.md5(raw)).alias("digest"), raw.alias("text")))
    tag = F.conv(F.substring(F.hex("digest"), 1, 16), 16, -10).cast("long")
    prints = cut_lineage(texts.select("id", "digest", tag.alias("tag"), F.octet_length("text").cast("long").alias("n")))
    total = prints.agg(F.sum("n")).first()[0] or 0
    found = _candidates(texts, max(1, total // BUCKET_BYTES), width)
    known = cut_lineage(found.groupBy("id").agg(F.collect_list("print").alias("prints")))            # bounded by the document's size
    release(docs.sparkSession)
    first = prints.groupBy("digest").agg(F.min("id").alias("first"))
    own = prints.where(F.col("n") >= width).select("id", "tag", "digest").distinct().join(first, "digest").drop("digest")
    asks = own.where("id = first").join(known, "id").select("id", "tag", "prints")
    cut = _cut_out(_packed(docs.where(F.col(id_col).isNotNull()), id_col, text_col).join(asks, ["id", "tag"]), width)
    hits = cut_lineage(_sorted_shards(cut, width, shard_bytes, many))
    del cut, asks, known, found
    release(docs.sparkSession)
    runs = hits.where("to is not null").select("id", "tag", "at", "to")
    if not (left := hits.where("to is null")).isEmpty():
        runs = runs.union(_grouped_windows(left, width))
    spans = runs.groupBy("id", "tag").agg(F.collect_list(F.struct("at", "to")).alias("spans"))     # bounded by the document's size
    copies = own.where("id > first").select("id", "tag", F.lit(True).alias("copy"), F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    return spans.select("id", "tag", F.lit(False).alias("copy"), "spans").union(copies)


def _edited(docs: DataFrame, id_col: str, text_col: str, width: int, keep=(), returns_text: bool = False, **options) -> DataFrame:
    """(id, kept columns, n_bytes, n_removed, n_spans, kept_sha256, kept_text) of each row."""
    def run(batches):
        import hashlib

        import pyarrow as pa
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
        types = [pa.int64()] * 3 + [pa.string()] * 2
        for b in batches:
            out = []
            for t, copy, spans in zip(_unpacked(b.column("text").to_pylist()), *(b.column(c).to_pylist() for c in ("copy", "spans")), strict=True):
                if copy:
                    spans = [{"at": 0, "to": len(t)}]
                runs: list = []                      # maximal: touching ones are one
                for x, y in sorted((s["at"], s["to"]) for s in spans or []):
                    if runs and x <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], y)
                    else:
                        runs.append([x, y])
                kept = b"".join(t[x:y] for x, y in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(t)], strict=True))
                text = kept.decode("utf-8", "ignore") if returns_text else None
                out.append((len(t), len(t) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), text))
            cols = [b.column(c) for c in ("id", *kept_names)] + [pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True)] if out else None
            if cols:
                yield pa.RecordBatch.from_arrays(cols, names=["id", *kept_names, *names])

    packed = _packed(docs, id_col, text_col, keep)
    kept_names = packed.columns[3:]
    rows = packed.join(_spans(docs, id_col, text_col, width, **options), ["id", "tag"], "left")
    schema = T.StructType([packed.schema["id"], *(packed.schema[c] for c in kept_names)])
    for c, k in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string"), ("kept_text", "string")):
        schema = schema.add(c, k)
    return rows.mapInArrow(tidy(run), schema)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte of the UTF-8 text is removed if a string of ``width`` bytes that
    covers it also starts in a document with a smaller id; strings are judged on
    the input.  A null text counts as empty.  A row without id neither loses
    bytes nor makes others lose any; rows that share an id do not make each
    other lose any.  Other columns are ignored; an empty table gives none."""
    return (_edited(docs, id_col, text_col, width, **options)
            .select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, **options) -> DataFrame:
    """``docs`` with the repeated bytes removed from the text (and characters of
    which a part was removed).  Rows whose text has lost all its words go.  All
    other columns stay as they are, except ``n_chars``, which is counted anew
    where the text has changed."""
    others = [c for c in docs.columns if c != text_col]
    row = F.struct(F.col(text_col).isNull().alias("null"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).alias("row")
    rows = _edited(docs, id_col, text_col, width, [row], True, **options)
    changed = F.col("n_spans") > 0
    cols = []
    for c in docs.columns:
        if c == text_col:
            col = F.when(~F.col("row.null"), F.col("kept_text"))
        else:
            col = F.col(f"row.c{others.index(c)}")
            if c == "n_chars":
                col = F.when(changed, F.length("kept_text").cast(docs.schema[c].dataType)).otherwise(col)
        cols.append(col.alias(c))
    return rows.where(~changed | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]")).select(*cols)
