"""DuckDB SQL of the dealt operators' queries, where it is written."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

_METRICS = [  # name, value, slack, both sides
    ("symbols", "1000 * n_symbols // greatest(word_chars, 1)", 40, False),
    ("dup_lines", "1000 * n_dup_lines // greatest(n_lines, 1)", 450, False),
    ("repeats", "1000 * n_repeat_words // greatest(n_words, 1)", 300, False),
    ("word_length", "100 * word_chars // greatest(n_words, 1)", 150, True),
]


def _quartiles(name: str, by: str) -> str:
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {keys}metric"
    edge = "CASE WHEN {0} < 32 THEN {0} ELSE (32 + {0} % 32) << ({0} // 32 - 1) END"
    return (f"{name}_b AS (SELECT {keys}metric, bucket, sum(n) AS n FROM sketch GROUP BY {keys}metric, bucket), "
            f"{name}_c AS (SELECT *, sum(n) OVER ({part}) AS total, sum(n) OVER ({part} ORDER BY bucket) AS upto FROM {name}_b), "
            f"{name}_q AS (SELECT {keys}metric, max(total) AS n, min(bucket) FILTER (upto * 4 >= total) AS b1, "
            f"min(bucket) FILTER (upto * 4 >= 3 * total) AS b3 FROM {name}_c GROUP BY {keys}metric), "
            f"{name} AS (SELECT {keys}metric, n, {edge.format('b1')} AS q1, {edge.format('b3')} AS q3 FROM {name}_q)")


def _quality() -> str:
    word, e = "[^\\x20\\x09-\\x0D]", "(length(bin(v)) - 1)"
    values = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, CAST({v} AS BIGINT) AS v FROM stats WHERE n_words > 0" for m, v, _, _ in _METRICS)
    ends, ok = [], []
    for m, v, slack, both in _METRICS:
        low = f"max(q1 - 6 * (q3 - q1) - {slack}) FILTER (metric = '{m}')" if both else "-1"
        ends.append(f"{low} AS {m}_low, max(q3 + 6 * (q3 - q1) + {slack}) FILTER (metric = '{m}') AS {m}_high")
        ok.append(f"{v} BETWEEN {m}_low AND {m}_high")
    return (
        "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents), "
        f"w AS (SELECT *, regexp_extract_all(t, '{word}+') AS ws FROM d), "
        "tri AS (SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)), "
        "twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM tri) WHERE n > 1), "
        "rep AS (SELECT rid, sum(least(3, coalesce(nxt - i, 3))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM twice) GROUP BY rid), "
        f"lines AS (SELECT rid, count(*) AS n, count(DISTINCT l) AS k FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{word}') GROUP BY rid), "
        "stats AS (SELECT w.rid, doc_id, lang, source, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, "
        "length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_lines, "
        "coalesce(lines.n - lines.k, 0) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words "
        "FROM w LEFT JOIN rep ON w.rid = rep.rid LEFT JOIN lines ON w.rid = lines.rid), "
        f"vals AS ({values}), "
        f"sketch AS (SELECT lang, source, metric, CASE WHEN v < 32 THEN v ELSE 32 * ({e} - 4) + (v >> ({e} - 5)) % 32 END AS bucket, count(*) AS n FROM vals GROUP BY ALL), "
        + _quartiles("own", "lang, source") + ", " + _quartiles("bylang", "lang") + ", " + _quartiles("every", "") + ", "
        "grid AS (SELECT own.lang, own.source, own.metric, "
        + ", ".join(f"CASE WHEN own.n >= 100 THEN own.{q} WHEN bylang.n >= 100 THEN bylang.{q} ELSE every.{q} END AS {q}" for q in ("q1", "q3"))
        + " FROM own JOIN bylang ON own.lang = bylang.lang AND own.metric = bylang.metric JOIN every ON own.metric = every.metric), "
        f"ends AS (SELECT lang, source, {', '.join(ends)} FROM grid GROUP BY lang, source), "
        "judged AS (SELECT stats.*, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, "
        f"coalesce({' AND '.join(ok)}, false) AS fine FROM stats LEFT JOIN ends ON stats.lang = ends.lang AND stats.source = ends.source) "
        "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND fine) AS kept FROM judged")


ORACLE["op8_quality"] = _quality()

_U = "(CAST('0x' || substr(md5(concat_ws('|', {})), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0"

ORACLE["op1_mixing"] = (
    "WITH sizes AS (SELECT coalesce(source, '') AS s, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS size FROM documents GROUP BY 1), "
    "weights AS (SELECT s, size, pow(size, 0.7) AS weight FROM sizes), "
    "rates AS (SELECT s, (SELECT sum(size) FROM sizes) * weight / (SELECT sum(weight) FROM weights) / size AS rate FROM weights WHERE size > 0), "
    "terms AS (SELECT s, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p FROM (SELECT s, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 40) AS BIGINT) + 1)) AS k FROM rates)), "
    "steps AS (SELECT s, k, sum(p) OVER (PARTITION BY s ORDER BY k) AS f FROM terms), "
    f"docs AS (SELECT *, coalesce(source, '') AS s, {_U.format("'17', coalesce(source, ''), coalesce(CAST(doc_id AS VARCHAR), '')")} AS u FROM documents), "
    "drawn AS (SELECT docs.*, (SELECT count(*) FROM steps WHERE steps.s = docs.s AND f < u) AS n FROM docs), "
    "copies AS (SELECT *, unnest(range(1, n + 1)) AS copy FROM drawn) "
    f"SELECT doc_id, text, lang, source, n_chars, copy, {_U.format("'17', 'order', s, coalesce(CAST(doc_id AS VARCHAR), ''), CAST(copy AS VARCHAR)")} AS shuffle_key FROM copies")

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"


def _shingles(words: str) -> str:
    """Distinct 5-word shingles (the whole sequence if shorter) of (k, ws)."""
    return (f"sh AS (SELECT DISTINCT k, CASE WHEN len(ws) < 5 THEN list_aggregate(ws, 'string_agg', ' ') ELSE list_aggregate(ws[i:i + 4], 'string_agg', ' ') END AS s "
            f"FROM (SELECT k, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM {words} WHERE len(ws) > 0)), "
            "size AS (SELECT k, count(*) AS n FROM sh GROUP BY k)")


def _links(percent: int) -> str:
    return ("common AS (SELECT a.k AS x, b.k AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.k < b.k GROUP BY a.k, b.k), "
            f"links AS (SELECT x, y FROM common JOIN size m ON m.k = x JOIN size n ON n.k = y WHERE 100 * c >= {percent} * (m.n + n.n - c)), "
            "both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links), "
            "reach(x, y) AS (SELECT x, x FROM both_ways UNION SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON reach.y = both_ways.x), "
            "comp AS (SELECT x, min(y) AS root FROM reach GROUP BY x)")


ORACLE["op3_minhash_forest"] = (
    f"WITH RECURSIVE w AS (SELECT doc_id AS k, {_WORDS.format(_LOWER)} AS ws FROM documents), {_shingles('w')}, {_links(85)} "
    "SELECT w.k AS doc_id, coalesce(size.n, 0) AS n_shingles, coalesce(root, w.k) AS component_id, coalesce(root, w.k) = w.k AS kept "
    "FROM w LEFT JOIN size ON size.k = w.k LEFT JOIN comp ON comp.x = w.k")

ORACLE["op10_paragraph_dedup"] = (
    f"WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split({_LOWER}, chr(10))) AS line, generate_subscripts(string_split({_LOWER}, chr(10)), 1) - 1 AS place FROM documents), "
    f"p AS (SELECT doc_id, place, doc_id * 1000000 + place AS k, {_WORDS.format('line')} AS ws FROM l), w AS (SELECT * FROM p WHERE len(ws) >= 25), "
    f"{_shingles('w')}, {_links(80)}, "
    "judged AS (SELECT w.doc_id, w.place, len(ws) AS n, coalesce(root, w.k) <> w.k AS gone FROM w LEFT JOIN comp ON comp.x = w.k) "
    "SELECT d.doc_id, count(place) AS n_paragraphs, count(*) FILTER (gone) AS n_removed, CAST(coalesce(sum(n) FILTER (gone), 0) AS BIGINT) AS n_removed_words, "
    "coalesce(string_agg(CAST(place AS VARCHAR), ',' ORDER BY place) FILTER (gone), '') AS removed "
    "FROM documents d LEFT JOIN judged j ON j.doc_id = d.doc_id GROUP BY d.doc_id")

ORACLE["op11_line_dedup"] = (
    "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), "
    "l AS (SELECT rid, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d), "
    "k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), "
    "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l), "
    "common AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10) "
    "SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (common.key IS NOT NULL) AS n_dropped, "
    "sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (common.key IS NULL), '')) AS kept_sha256 "
    "FROM k LEFT JOIN common ON common.key = k.key GROUP BY rid")


def _merkle() -> str:
    """Nodes level by level, then every leaf's siblings, and the folded roots step by step."""
    def field(c):
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"

    def leaf(text):
        return "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    crc = ("xor(list_reduce(list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(k[i]) AS BIGINT)), lambda c, b: "
           "list_reduce(range(0, 8), lambda x, y: xor(x >> 1, (x & 1) * 3988292384), xor(c, b)), 4294967295), 4294967295)")
    up = ("SELECT {g}, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), CAST((n + 2) // 3 AS BIGINT) FROM {t} WHERE n > 1 GROUP BY {g}, level, n, i // 3")
    return (
        "WITH RECURSIVE d AS (SELECT *, CAST(doc_id AS VARCHAR) AS k, coalesce('s' || source, '') AS tree FROM documents), "
        f"x AS (SELECT tree, doc_id, {leaf('text')} AS leaf, CASE WHEN {crc} % 2 = 0 THEN {leaf('replace(text, chr(10), chr(0))')} ELSE {leaf('text')} END AS other FROM d), "
        "p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM x), "
        "low(tree, level, i, h, n) AS (SELECT tree, 0, i, leaf, n FROM p UNION ALL " + up.format(g="tree", t="low") + "), "
        "subs AS (SELECT tree, level AS height, h AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1), "
        "high(level, i, h, n) AS (SELECT 0, i, subroot, n FROM subs UNION ALL " + up.format(g="", t="high").replace("SELECT ,", "SELECT").replace("BY ,", "BY") + "), "
        # every leaf's ancestors: place within the level, over both trees
        "way AS (SELECT p.tree, p.i AS spot, l AS step, 'low' AS part, l AS level, p.i // CAST(pow(3, l) AS BIGINT) AS i FROM p JOIN subs USING (tree), range(0, 40) r(l) WHERE l < height "
        "UNION ALL SELECT p.tree, p.i, height + l, 'high', l, subs.i // CAST(pow(3, l) AS BIGINT) FROM p JOIN subs USING (tree), range(0, 40) r(l) WHERE l < (SELECT max(level) FROM high)), "
        "node AS (SELECT 'low' AS part, tree, level, i, h FROM low UNION ALL SELECT 'high', '', level, i, h FROM high), "
        "beside AS (SELECT w.tree, w.spot, w.step, coalesce(string_agg(o.h, '' ORDER BY o.i) FILTER (o.i < w.i), '') AS l, coalesce(string_agg(o.h, '' ORDER BY o.i) FILTER (o.i > w.i), '') AS r "
        "FROM way w JOIN node o ON o.part = w.part AND o.level = w.level AND o.i // 3 = w.i // 3 AND o.tree = CASE WHEN w.part = 'low' THEN w.tree ELSE '' END GROUP BY ALL), "
        "fold(tree, spot, step, h) AS (SELECT tree, i, CAST(0 AS BIGINT), other FROM p UNION ALL SELECT f.tree, f.spot, f.step + 1, sha256(b.l || f.h || b.r) FROM fold f JOIN beside b ON b.tree = f.tree AND b.spot = f.spot AND b.step = f.step), "
        "folded AS (SELECT tree, spot, arg_max(h, step) AS folded_root FROM fold GROUP BY tree, spot), "
        "proof AS (SELECT tree, spot, sha256(string_agg(l || r, '' ORDER BY step)) AS proof_sha256 FROM beside GROUP BY tree, spot) "
        "SELECT p.doc_id, p.leaf, subs.subroot, high.h AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = high.h AS verified "
        "FROM p JOIN subs USING (tree) JOIN high ON high.n = 1 JOIN folded ON folded.tree = p.tree AND folded.spot = p.i LEFT JOIN proof ON proof.tree = p.tree AND proof.spot = p.i"
    ).replace("chr(0)", "''")


ORACLE["op12_merkle_manifest"] = _merkle()


def _repair() -> str:
    """The cheapest edits row by row: for each state the least (cost, letters)."""
    key = "(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))"
    crc = (f"xor(list_reduce(list_transform(range(1, length({key}) + 1), lambda i: CAST(ascii({key}[i]) AS BIGINT)), lambda c, b: "
           "list_reduce(range(0, 8), lambda x, y: xor(x >> 1, (x & 1) * 3988292384), xor(c, b)), 4294967295), 4294967295)")
    white = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return (
        # insertions before a row, then its own edit: letters, cost, text put in, how the own role comes out
        "WITH RECURSIVE nxt(p, q, role) AS (VALUES (0, 2, 'user:'), (1, 2, 'user:'), (2, 3, 'assistant:'), (3, 2, 'user:')), "
        "keeps(p, mark, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)), "
        "ins(p, k, q, word, body) AS (SELECT p, 0, p, '', '' FROM nxt UNION ALL "
        "SELECT ins.p, k + 1, nxt.q, word || 'I', body || chr(10) || nxt.role FROM ins JOIN nxt ON nxt.p = ins.q WHERE k < 2), "
        "step AS (SELECT p, CAST(NULL AS VARCHAR) AS mark, q, word || 'D' AS word, 5 * k + 2 AS cost, body, CAST(NULL AS VARCHAR) AS role, 'D' AS kind FROM ins "
        "UNION ALL SELECT ins.p, NULL, nxt.q, word || 'R', 5 * k + 1, body || chr(10), nxt.role, 'R' FROM ins JOIN nxt ON nxt.p = ins.q "
        "UNION ALL SELECT ins.p, keeps.mark, keeps.q, word || 'K', 5 * k, body || chr(10), NULL, 'K' FROM ins JOIN keeps ON keeps.p = ins.q), "
        f"raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS kind FROM conversations), "
        "bad AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, "
        "unnest(range(0, CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM raw), "
        "ids AS (SELECT row_number() OVER () AS c, conv_id FROM (SELECT DISTINCT conv_id FROM conversations)), "
        "seq AS (SELECT c, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM bad JOIN ids ON ids.conv_id IS NOT DISTINCT FROM bad.conv_id), "
        f"bare AS (SELECT *, rtrim(text, {white}) AS b, row_number() OVER (PARTITION BY c, role, text ORDER BY i) AS nth, "
        "left(lag(role) OVER (PARTITION BY c ORDER BY i), 1) || left(role, 1) AS pair FROM seq), "
        "rows_ AS (SELECT *, CASE WHEN b = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(b, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM bare), "
        "facts AS (SELECT c, count(*) AS n, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'blank') AS blank, "
        "count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, "
        "count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY c), "
        "dp(c, i, state, best) AS (SELECT c, CAST(0 AS BIGINT), 0, {'cost': 0, 'word': '', 'body': ''} FROM ids UNION ALL "
        "SELECT dp.c, r.i, step.q, min({'cost': best.cost + step.cost + CASE WHEN fault = 'truncated' AND kind <> 'D' THEN 5 ELSE 0 END, 'word': best.word || step.word, "
        "'body': best.body || step.body || CASE kind WHEN 'D' THEN '' WHEN 'R' THEN step.role || text ELSE r.role || ':' || text END}) "
        "FROM dp JOIN rows_ r ON r.c = dp.c AND r.i = dp.i + 1 JOIN step ON step.p = dp.state "
        "AND (kind = 'D' OR fault NOT IN ('blank', 'duplicate') AND (kind = 'R' OR step.mark = left(r.role, 1))) GROUP BY dp.c, r.i, step.q), "
        "ends(state, cost, word, body) AS (VALUES (0, 0, '', ''), (1, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 5, 'I', chr(10) || 'assistant:'), (3, 0, '', '')), "
        "done AS (SELECT dp.c, min({'cost': best.cost + ends.cost, 'word': best.word || ends.word, 'body': best.body || ends.body}) AS best "
        "FROM dp JOIN ends ON ends.state = dp.state LEFT JOIN facts ON facts.c = dp.c WHERE dp.i = coalesce(n, 0) GROUP BY dp.c) "
        "SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, "
        "coalesce(illegal, 0) AS illegal, CAST(best.cost AS BIGINT) AS cost, best.word AS audit, sha256(substr(best.body, 2)) AS repaired_sha256 "
        "FROM ids JOIN done ON done.c = ids.c LEFT JOIN facts ON facts.c = ids.c")


ORACLE["op13_conversation_repair"] = _repair()
