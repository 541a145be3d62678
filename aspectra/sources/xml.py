"""Annotated review XML readers.

Two layouts are read:
* opinion layout   ``sentence{text, ...Opinion@target@polarity}``, opinions at any depth
* aspect-term layout ``sentence{text, ...aspectTerms/aspectTerm@term@polarity}``, the
  terms of the first ``aspectTerms`` at any depth; files without any ``sentence``
  have the same inside ``review``

Files are cut at the end tags of the row element, so a file of any size is read by
many tasks, and every element is at hand as a string: its text and first block of
terms are parsed with a fixed schema, its opinions are found at whatever depth.
Files are UTF-8.  Comments inside an element are removed; an element inside a comment
is not read if the comment opens and ends around that element alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectra.functions import labels as L
from aspectra.functions.text import py_strip
from aspectra.session import MAX_BROADCAST_ROWS, scratch_path
from aspectra.sources.files import file_heads, file_key, routes

REVIEW_COLS = ["text", "aspect", "polarity", "lang"]
ENTRY = "array<struct<aspect:string,polarity:string>>"

_ATTRS = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_XML = {"ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE"}


#: Bytes up to which an element is read.  It bounds the memory for files that lack the
#: element, which would be one piece as a whole; such pieces are passed over.
MAX_ELEMENT = 64 << 20


def _pieces(spark: SparkSession, path, tag: str) -> DataFrame:
    """(file, value): the XML files cut at the end tags of an element."""
    rows = (spark.read.option("lineSep", f"</{tag}>").option("recursiveFileLookup", "true")
            .option("mapreduce.input.linerecordreader.line.maxlength", MAX_ELEMENT)
            .option("pathGlobFilter", "*.xml").text(path))
    return rows.select(file_key(F.col("_metadata.file_path")).alias("file"), "value")


def read_elements(spark: SparkSession, path, tag: str) -> DataFrame:
    """(file, element): every ``tag`` element of the XML files as a string."""
    rows = _pieces(spark, path, tag)
    # what stands before the end tag, from the last start tag on; a self-closed element holds nothing
    tail = F.substring_index("value", f"<{tag}", -1)
    start = F.when(F.contains("value", F.lit(f"<{tag}")) & F.substring(tail, 1, 1).rlike(r"[\s/>]"), F.concat(F.lit(f"<{tag}"), tail))
    start = F.coalesce(start, F.regexp_extract("value", rf"(?s)^.*(<{tag}(?=[\s/>]).*)$", 1))
    rows = rows.select("file", "value", start.alias("element"))
    ahead = F.expr("substring(value, 1, length(value) - length(element))")
    open_comment = F.length(F.substring_index(ahead, "<!--", -1)) < F.length(F.substring_index(ahead, "-->", -1))
    has_comment = F.contains("value", F.lit("<!--"))
    whole = F.concat("element", F.lit(f"</{tag}>"))
    bare = F.when(~has_comment, whole).when(~open_comment, F.regexp_replace(whole, r"(?s)<!--.*?-->", ""))
    bare = F.when(F.col("element") != "", bare)
    # a generator, not a filter, so the expressions aren't worked out again below it
    return rows.select("file", F.explode(F.array_compact(F.array(bare))).alias("element"))


def _opinions(element: Column) -> Column:
    """Targets and polarities of the Opinion elements at any depth, in order."""
    tags = F.regexp_extract_all(element, F.lit(rf"(<Opinion(?=[\s/>]){_ATTRS}>)"), 1)
    closed = F.transform(tags, lambda t: F.concat(F.regexp_replace(t, r"/?>$", ""), F.lit("/>")))
    doc = F.concat(F.lit("<o>"), F.array_join(closed, ""), F.lit("</o>"))
    doc = F.when(F.contains(element, F.lit("<Opinion")), doc)
    return F.from_xml(doc, "Opinion array<struct<_target:string,_polarity:string>>", _XML)["Opinion"]


def _terms(element: Column) -> Column:
    """Terms and polarities directly inside the first aspectTerms element."""
    block = F.regexp_extract(element, rf"(?s)(<aspectTerms(?=[\s/>])(?:[^>]*/>|{_ATTRS}>.*?</aspectTerms>))", 1)
    block = F.when(F.contains(element, F.lit("<aspectTerms")), F.nullif(block, F.lit("")))
    return F.from_xml(block, "aspectTerm array<struct<_term:string,_polarity:string>>", _XML)["aspectTerm"]


def read_sentences(spark: SparkSession, path, row_tag: str = "sentence") -> DataFrame:
    """(file, text, opinions, terms): one row per element with its raw text (null
    without one); surrounding spaces are kept, stripping follows Python's rules."""
    s = read_elements(spark, path, row_tag)
    # what follows the text is of no interest here
    head = F.concat(F.substring_index("element", "</text>", 1), F.lit(f"</text></{row_tag}>"))
    head = F.when(F.contains(F.col("element"), F.lit("</text>")), head).otherwise(F.col("element"))
    text = F.from_xml(head, "text array<string>", _XML)["text"]
    return s.select("file", F.get(text, F.lit(0)).alias("text"), _opinions(F.col("element")).alias("opinions"),
                    _terms(F.col("element")).alias("terms"))


def _with_text(s: DataFrame, entries: Column, lang: Column) -> DataFrame:
    """(file, _lang, text, _entries) of sentences with non-empty raw text; the text is
    then stripped (whitespace-only text survives as '')."""
    row = F.when(F.col("text") != "", F.struct(py_strip("text").alias("text"), entries.alias("_entries")))
    return s.select("file", lang.alias("_lang"), F.inline(F.array_compact(F.array(row))))


def _entry(aspect: Column, polarity: Column) -> Column:
    return F.struct(aspect.alias("aspect"), L.normalize_polarity(polarity).alias("polarity"))


def opinion_entries() -> Column:
    """Valid opinions of a sentence: unknown polarities are dropped, a missing target
    is 'general'."""
    found = F.transform("opinions", lambda o: _entry(L.normalize_target(o["_target"]), o["_polarity"]))
    return F.coalesce(F.filter(found, lambda e: e["polarity"].isNotNull()), F.array().cast(ENTRY))


def term_entries() -> Column:
    """Valid terms of a sentence: empty or missing terms and unknown polarities are
    dropped; terms are stripped."""
    named = F.filter("terms", lambda t: t["_term"] != "")
    found = F.transform(named, lambda t: _entry(py_strip(t["_term"]), t["_polarity"]))
    return F.coalesce(F.filter(found, lambda e: e["polarity"].isNotNull()), F.array().cast(ENTRY))


def _by_file(s: DataFrame, flags: DataFrame, how: str) -> DataFrame:
    """Joins a table of one row per file.  The file listing bounds its size, so it is
    broadcast without a job up to MAX_BROADCAST_ROWS files."""
    return s.join(F.broadcast(flags) if len(s.inputFiles()) <= MAX_BROADCAST_ROWS else flags, "file", how)


def _rows(s: DataFrame, entries: Column, lang: Column, fallback: bool, rest_only: bool = False) -> DataFrame:
    """(file, text, aspect, polarity, lang) of sentences; a file without any valid entry
    gives a ('general', 'neutral') row for each sentence instead."""
    s = _with_text(s, entries, lang)
    if fallback:
        # the second look only asks which files hold a valid entry: one row per file
        flags = s.where(F.size("_entries") > 0).select("file", F.lit(True).alias("_found")).distinct()
        s = _by_file(s, flags, "left")
        whole = F.array(F.struct(F.lit("general").alias("aspect"), F.lit("neutral").alias("polarity")))
        own = F.array().cast(ENTRY) if rest_only else F.col("_entries")
        s = s.withColumn("_entries", F.when(F.col("_found"), own).otherwise(whole))
    return s.select("file", "text", F.inline("_entries"), F.col("_lang").alias("lang"))


def _lang(lang) -> Column:
    return F.lit(lang) if isinstance(lang, str) else lang


def opinion_rows(s: DataFrame, lang) -> DataFrame:
    """Valid opinion rows (file, text, aspect, polarity, lang)."""
    return _rows(s, opinion_entries(), _lang(lang), fallback=False)


def term_rows(s: DataFrame, lang) -> DataFrame:
    """Valid aspect-term rows (file, text, aspect, polarity, lang)."""
    return _rows(s, term_entries(), _lang(lang), fallback=False)


def whole_text_fallback(s: DataFrame, entries: Column, lang) -> DataFrame:
    """('general', 'neutral') rows of the sentences of files without any valid entry."""
    return _rows(s, entries, _lang(lang), fallback=True, rest_only=True)


def read_opinion_xml(spark: SparkSession, path, lang: str = "fr", fallback: bool = True) -> DataFrame:
    return _rows(read_sentences(spark, path), opinion_entries(), F.lit(lang), fallback)


def read_sentences_or_reviews(spark: SparkSession, path) -> DataFrame:
    """The sentences of all files, and the ``review`` elements of files without any
    ``sentence``."""
    s = read_sentences(spark, path)
    with_sentences = _pieces(spark, path, "sentence").where(F.col("value").rlike(r"<sentence[\s/>]")).select("file").distinct()
    return s.unionByName(_by_file(read_sentences(spark, path, "review"), with_sentences, "left_anti"))


def read_aspect_term_xml(spark: SparkSession, path, lang: str = "en", fallback: bool = True) -> DataFrame:
    return _rows(read_sentences_or_reviews(spark, path), term_entries(), F.lit(lang), fallback)


def route_xml(spark: SparkSession, path) -> DataFrame:
    """All XML files below a folder, each by its own layout and language: a file whose
    first characters show opinions is read in the opinion layout as French, any other
    in the term layout, as French if its name says so.  The heads of the files are
    read by a data source of their own; the sentences are parsed once."""
    routing = routes(file_heads(spark, path)).where("format = 'xml'").select("file", "layout", F.col("lang").alias("_to"))
    parsed = scratch_path(spark, "sentences")
    read_sentences_or_reviews(spark, path).write.option("compression", "zstd").parquet(parsed)
    s = _by_file(spark.read.parquet(parsed), routing, "inner")
    entries = F.when(F.col("layout") == "opinion", opinion_entries()).otherwise(term_entries())
    return _rows(s, entries, F.col("_to"), fallback=True)
