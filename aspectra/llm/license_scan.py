"""Licence scan by ordered signature rules.

A rule is a regular expression over the words of a text, with a priority and
keywords, taken from its own words, that must occur before it is tried.  Overlapping
detections are resolved in two steps: a detection contained in another one is
dropped, then one that overlaps a direct neighbour of better priority.  All of
it is DataFrame functions inside one projection: no shuffle, no join.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# FIXED VALUES: phrases of the base labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# FIXED VALUES: label, names as words after lower-casing and dropping punctuation
# ("?" after a group makes it optional).
NAMES = [
    ("0bsd", ["0bsd", "zero clause bsd", "bsd zero clause"]),
    ("afl-3.0", ["academic free license(?: version| v)? 3 0"]),
    ("agpl-3.0", ["gnu affero general public license(?: version| v)?(?: 3| v3)(?: 0)?", "agpl 3 0", "agplv3"]),
    ("apache-1.1", ["apache(?: software)? license(?: version| v)? 1 1"]),
    ("apache-2.0", ["apache(?: software)? license(?: version| v)? 2 0", "apache 2 0", "apache2"]),
    ("artistic-2.0", ["artistic license(?: version| v)? 2 0", "artistic 2 0"]),
    ("bsd-2-clause", ["bsd 2 clause", "2 clause bsd", "simplified bsd", "freebsd"]),
    ("bsd-3-clause", ["bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd"]),
    ("bsd-4-clause", ["bsd 4 clause", "4 clause bsd", "original bsd"]),
    ("bsl-1.0", ["boost software license(?: version| v)? 1 0", "bsl 1 0"]),
    ("cc-by-3.0", ["cc by 3 0", "creative commons attribution 3 0"]),
    ("cc-by-4.0", ["cc by 4 0", "creative commons attribution 4 0"]),
    ("cc-by-nc-4.0", ["cc by nc 4 0", "creative commons attribution noncommercial 4 0"]),
    ("cc-by-nc-nd-4.0", ["cc by nc nd 4 0", "creative commons attribution noncommercial noderivatives 4 0"]),
    ("cc-by-nc-sa-4.0", ["cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0"]),
    ("cc-by-nd-4.0", ["cc by nd 4 0", "creative commons attribution noderivatives 4 0"]),
    ("cc-by-sa-3.0", ["cc by sa 3 0", "creative commons attribution sharealike 3 0"]),
    ("cc-by-sa-4.0", ["cc by sa 4 0", "creative commons attribution sharealike 4 0"]),
    ("cc0-1.0", ["cc0 1 0", "cc0"]),
    ("cddl-1.0", ["cddl 1 0", "common development and distribution license"]),
    ("cecill-2.1", ["cecill(?: free software license)?(?: v)? 2 1"]),
    ("ecl-2.0", ["educational community license(?: version| v)? 2 0"]),
    ("epl-1.0", ["eclipse public license(?: version| v)? 1 0", "epl 1 0"]),
    ("epl-2.0", ["eclipse public license(?: version| v)? 2 0", "epl 2 0"]),
    ("eupl-1.2", ["european union public license(?: version| v)? 1 2"]),
    ("gfdl-1.3", ["gnu free documentation license(?: version| v)? 1 3"]),
    ("gpl-2.0", ["gpl 2 0", "gplv2", "gpl(?: version| v)? 2", "gnu general public license(?: version| v)?(?: 2| v2)(?: 0)?"]),
    ("gpl-3.0", ["gpl 3 0", "gplv3", "gpl(?: version| v)? 3", "gnu general public license(?: version| v)?(?: 3| v3)(?: 0)?"]),
    ("isc", ["isc license", "isc"]),
    ("lgpl-2.1", ["gnu lesser general public license(?: version| v)? 2 1", "lgpl 2 1"]),
    ("lgpl-3.0", ["gnu lesser general public license(?: version| v)?(?: 3| v3)(?: 0)?", "lgpl 3 0"]),
    ("mit-0", ["mit no attribution", "mit 0"]),
    ("mpl-1.1", ["mozilla public license(?: version| v)? 1 1", "mpl 1 1"]),
    ("mpl-2.0", ["mozilla public license(?: version| v)? 2 0", "mpl 2 0"]),
    ("ms-pl", ["microsoft public license"]),
    ("ncsa", ["university of illinois ncsa open source license", "ncsa"]),
    ("odbl-1.0", ["open database license(?: version| v)? 1 0", "odbl 1 0"]),
    ("ofl-1.1", ["sil open font license(?: version| v)? 1 1"]),
    ("osl-3.0", ["open software license(?: version| v)? 3 0"]),
    ("postgresql", ["postgresql license"]),
    ("python-2.0", ["python software foundation license", "psf license"]),
    ("unlicense", ["the unlicense", "unlicense"]),
    ("upl-1.0", ["universal permissive license(?: version| v)? 1 0"]),
    ("wtfpl", ["wtfpl"]),
    ("zlib", ["zlib license", "zlib libpng"]),
    # without a version
    ("afl", ["academic free license"]),
    ("agpl", ["agpl", "gnu agpl", "gnu affero general public license"]),
    ("apache", ["apache", "apache software"]),
    ("artistic", ["artistic license"]),
    ("bsd", ["bsd"]),
    ("bsl", ["boost software license"]),
    ("cc-by", ["cc by", "creative commons attribution"]),
    ("cc-by-nc", ["cc by nc", "creative commons attribution noncommercial"]),
    ("cc-by-nc-nd", ["cc by nc nd", "creative commons attribution noncommercial noderivatives"]),
    ("cc-by-nc-sa", ["cc by nc sa", "creative commons attribution noncommercial sharealike"]),
    ("cc-by-nd", ["cc by nd", "creative commons attribution noderivatives"]),
    ("cc-by-sa", ["cc by sa", "creative commons attribution sharealike"]),
    ("cddl", ["cddl"]),
    ("cecill", ["cecill"]),
    ("epl", ["epl", "eclipse public license"]),
    ("eupl", ["eupl", "european union public license"]),
    ("gfdl", ["gfdl", "gnu free documentation license"]),
    ("gpl", ["gpl", "gnu gpl", "gnu general public license"]),
    ("lgpl", ["lgpl", "gnu lgpl", "gnu lesser general public license", "gnu library general public license"]),
    ("mit", ["mit", "expat"]),
    ("mpl", ["mpl", "mozilla public license"]),
    ("odbl", ["odbl", "open database license"]),
    ("ofl", ["ofl", "sil open font license"]),
    ("osl", ["open software license"]),
]

# FIXED VALUES: label and words of a licence body that no other body holds.
BODIES = [
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("isc", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("mit", "to whom the software is furnished to do so subject to the following conditions the above copyright notice"),
    ("mit-0", "to whom the software is furnished to do so the software is provided as is"),
    ("ncsa", "to whom the software is furnished to do so subject to the following conditions redistributions of source code"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software"),
]

# FIXED VALUES: how a name is stated: priority (1 is best), score, characters that
# every statement holds, words around the name.
STATED = [
    (1, 1.0, "spdx", "spdx license identifier {}(?: only| or later)?"),
    (2, 0.9, "under", "(?:licensed|released|distributed|available|published|dual licensed) under(?: the)?(?: terms of)?(?: the)? {}(?: or later| or any later version)?(?: license)?"),
    (3, 0.8, "subject", "subject to(?: the)?(?: terms of)?(?: the)? {}(?: license)?"),
    (4, 0.75, "licen", "licen[sc]e(?:s|d)?(?: is| are)? {}"),
    (5, 0.7, "licen", "{} licen[sc]e"),
]
BODY = (2, 0.95)
ALONE = (6, 0.6)             # a name of three or more words stands for itself
# FIXED VALUES: words of names that say little; a rule's keyword is another one if it has one.
PLAIN = frozenset("license public general software free open source common gnu new original version the of and to for with this is in or "
                  "permission by".split())
REACH = 256                  # detections before one that can reach into it: more than rules start within a match's length

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _expression(words: str) -> str:
    # in the scanned text each word has a space on both sides
    return f" {words.replace(' ', '  ')} "


def keyword(words: str) -> str:
    """A word that every match of the expression holds: the longest literal one
    outside groups, one that is not PLAIN first."""
    # a group of whole words goes, another one spoils the word it stands at
    bare = re.sub(r"\(\?:([^()]*)\)\??", lambda m: "" if all(x.startswith(" ") for x in m[1].split("|")) else "#", words)
    found = [w for w in bare.split(" ") if re.fullmatch("[a-z0-9]+", w)]
    return max(found, key=lambda w: (not w.isdigit(), w not in PLAIN, len(w)))


def rules() -> list[tuple[str, int, float, str, str, str]]:
    """(label, priority, score, a word and characters that every match holds,
    expression) of every rule: names times statements, names that stand alone,
    licence bodies, base phrases."""
    out = []
    for label, names in NAMES:
        for name in names:
            word = keyword(name)
            for prio, score, key, around in STATED:
                out.append((label, prio, score, word, key, _expression(around.format(f"(?:{name})"))))
            if name.count(" ") >= 2:
                out.append((label, *ALONE, word, word, _expression(name)))
    out += [(label, *BODY, keyword(words), keyword(words), _expression(words)) for label, words in BODIES]
    return out + [(label, 7, 0.5, keyword(phrase), "license", _expression(phrase)) for phrase, label in BASE]


def _rules_column(found) -> Column:
    """Rules grouped by their word, so a text without it skips them all; as one SQL
    expression, which Spark reads much faster than as many Columns."""
    groups: dict[str, list] = {}
    for label, prio, score, k1, k2, expression in found:
        groups.setdefault(k1, []).append(f"named_struct('label', '{label}', 'prio', {prio}, 'score', {score}D, 'k2', '{k2}', 're', '{expression}')")
    return F.expr("array(" + ", ".join(f"named_struct('k1', ' {k} ', 'rules', array({', '.join(v)}))" for k, v in groups.items()) + ")")


def _starts(expression: str) -> str:
    """SQL: the places (words from 0) where the expression matches _n."""
    marked = f"split(replace(regexp_replace(_n, {expression}, '\\u0001$0'), ' \\u0001 ', '  \\u0001'), '  ')"
    return f"filter(transform({marked}, (w, i) -> if(startswith(w, '\\u0001'), i - 1, -1)), i -> i >= 0)"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gates: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, n_detections.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z
    lower-cased.  All places of the base phrases count; ``labels`` also holds
    those of the detections that remain.  The score is the best remaining
    detection's, 0 without any.  A null or empty text has no words, '' as labels
    and null places.  Repeated rows and ties give equal rows; other columns are
    ignored; an empty table gives an empty result.  Without ``gates`` every rule is
    tried on every text, with equal results."""
    gate = [F.contains(F.lower("_t"), F.lit(k)) for k in sorted({r[4] for r in rules()})]
    words = F.filter(F.split("_t", _SEPARATOR), lambda w: w != "")
    df = (docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
          .select("doc_id", words.alias("_v"), (reduce(lambda x, y: x | y, gate) if gates else F.lit(True)).alias("_g"))
          .select("doc_id", F.size("_v").cast("long").alias("n_words"),
                  F.when(F.col("_g"), F.translate(F.concat(F.lit("  "), F.array_join("_v", "  "), F.lit("  ")), _UPPER, _LOWER)).alias("_n")))
    base = [F.expr(f"if(contains(_n, 'license'), {_starts(repr(_expression(p)))}, null)") for p, _ in BASE]
    df = df.withColumn("_b", F.array(*[F.coalesce(b, F.array().cast("array<int>")) for b in base]))
    keep = F.lit(not gates)
    tried = F.flatten(F.transform(F.filter(_rules_column(rules()), lambda g: keep | F.contains(F.col("_n"), g.k1)),
                                  lambda g: F.filter(g.rules, lambda r: keep | F.contains(F.col("_n"), r.k2))))
    df = df.withColumn("_r", F.when(F.col("_n").isNotNull(), tried))
    # (from, -to, ...) in words, so that a detection comes after those that contain it
    found = (f"flatten(transform(_r, r -> zip_with({_starts('r.re')}, regexp_extract_all(_n, r.re, 0), (i, m) -> "
             "named_struct('at', i, 'back', -i - size(split(trim(m), '  ')), 'prio', r.prio, 'label', r.label, 'score', r.score))))")
    df = df.withColumn("_f", F.expr(f"sort_array({found})"))
    df = df.withColumn("_f", F.expr(
        f"filter(_f, (d, i) -> not exists(slice(_f, greatest(1, i - {REACH - 1}), least(i, {REACH})), e -> e.back <= d.back))"))
    df = df.withColumn("_f", F.expr(
        "filter(_f, (d, i) -> not coalesce(-get(_f, i - 1).back > d.at and get(_f, i - 1).prio <= d.prio, false) "
        "and not coalesce(get(_f, i + 1).at < -d.back and get(_f, i + 1).prio < d.prio, false))"))
    names = F.array(*[F.lit(label) for _, label in BASE])
    base_labels = F.filter(F.transform(names, lambda x, i: F.when(F.size(F.get("_b", i)) > 0, x)), lambda x: x.isNotNull())
    labels = F.array_union(base_labels, F.coalesce(F.expr("transform(_f, d -> d.label)"), F.array().cast("array<string>")))
    places = F.flatten("_b")
    return df.select("doc_id", "n_words", F.size(places).cast("long").alias("n_base"),
                     F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
                     F.array_join(F.sort_array(base_labels), ",").alias("base_labels"),
                     F.array_join(F.sort_array(F.array_distinct(labels)), ",").alias("labels"),
                     F.coalesce(F.expr("array_max(transform(_f, d -> d.score))"), F.lit(0.0)).alias("score"),
                     F.coalesce(F.size("_f"), F.lit(0)).cast("long").alias("n_detections"))
