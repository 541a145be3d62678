"""Text preprocessing pipelines (DataFrame -> DataFrame)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aspectra import dicts
from aspectra.functions import text as T
from aspectra.session import cut_lineage

# A lemma table up to this many entries is turned into a map literal and
# looked up inside the projection; a larger lexicon goes through a join.
MAX_LEMMA_MAP_ENTRIES = 20000


def _lemma_map_column(lemma_rows) -> Column:
    args = []
    for lang, token, lemma in lemma_rows:
        args += [F.lit(f"{lang}|{token}"), F.lit(lemma)]
    return F.create_map(*args) if args else F.create_map().cast("map<string,string>")


def lemma_lookup(df: DataFrame, lemmas: DataFrame, text: str = "text_processed",
                 lang: str = "lang", out: str | None = None,
                 id_col: str | None = None) -> DataFrame:
    """Replace each token by its lemma from a (lang, token, lemma) table;
    Russian text and tokens without an entry are kept.

    Size-checked strategy: a bounded lexicon (<= MAX_LEMMA_MAP_ENTRIES rows,
    counted first) becomes a map literal, so the lookup is a per-row
    ``transform`` with no shuffle.  A larger lexicon is joined to the exploded
    tokens (AQE picks broadcast or shuffle and splits skewed tokens) and the
    tokens are put back in order per row."""
    out = out or text
    # a token with several lemmas takes the smallest one, on either way
    lemmas = lemmas.groupBy("lang", "token").agg(F.min("lemma").alias("lemma"))
    n = lemmas.limit(MAX_LEMMA_MAP_ENTRIES + 1).count()
    if n <= MAX_LEMMA_MAP_ENTRIES:
        rows = [tuple(r) for r in lemmas.select("lang", "token", "lemma").collect()]
        m = _lemma_map_column(rows)
        toks = T.tokens(text)
        lem = F.transform(toks, lambda w: F.coalesce(
            F.element_at(m, F.concat(F.col(lang), F.lit("|"), w)), w))
        res = F.when(F.coalesce(F.col(lang) == "ru", F.lit(False)), F.col(text)) \
               .otherwise(F.array_join(lem, " "))
        return df.withColumn(out, res)

    made = id_col is None
    if made:                                 # row numbers, checkpointed so they stay the same
        id_col = "__row"
        df = cut_lineage(df.withColumn(id_col, F.monotonically_increasing_id()))
    toks = df.select(id_col, lang, F.posexplode(T.tokens(text)).alias("pos", "token"))
    lex = lemmas.select(F.col("lang").alias("__l"), F.col("token").alias("__t"), "lemma")
    joined = toks.join(lex, (toks[lang] == lex["__l"]) & (toks["token"] == lex["__t"]), "left")
    rebuilt = (joined.groupBy(id_col)
               .agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("lemma", "token").alias("w"))))
                    .alias("__ws")))
    rebuilt = rebuilt.select(id_col, F.array_join(F.transform("__ws", lambda s: s["w"]), " ").alias("__lem"))
    res = df.join(rebuilt, id_col, "left")
    res = res.withColumn(out, F.when(F.coalesce(F.col(lang) == "ru", F.lit(False)), F.col(text))
                         .otherwise(F.coalesce(F.col("__lem"), F.lit(""))))
    return res.drop("__lem", *([id_col] if made else []))


def preprocess_light(df: DataFrame, text: str = "text", lang: str = "lang",
                     out: str = "text_processed") -> DataFrame:
    """Normalisation only; rows whose processed text is empty are dropped."""
    from aspectra.operators.labeling import keep_nonempty
    return keep_nonempty(df.withColumn(out, T.normalize_text(text, lang)), out)


def preprocess_classic(df: DataFrame, text: str = "text", lang: str = "lang",
                       remove_stop: bool = True, lemmas: DataFrame | None = None,
                       custom_stopwords: list[str] | None = None,
                       out: str = "text_processed", id_col: str | None = None) -> DataFrame:
    """normalise -> stopwords -> lemmas -> collapse; empty rows dropped.
    Stopwords are removed before lemma lookup."""
    d = df.withColumn(out, T.normalize_text(text, lang))
    if remove_stop:
        d = d.withColumn(out, T.remove_stopwords(out, lang, dicts.STOPWORDS, custom_stopwords))
    if lemmas is not None:
        d = lemma_lookup(d, lemmas, text=out, lang=lang, id_col=id_col)
    from aspectra.operators.labeling import keep_nonempty
    return keep_nonempty(d.withColumn(out, T.collapse_whitespace(out)), out)


def texts_and_labels(df: DataFrame, id_col: str = "review_id", lang: str = "lang", text: str = "text_processed",
                     label: str = "polarity") -> DataFrame:
    """(id, lang, text, label): the training view of every language, kept distributed."""
    return df.select(F.col(id_col), F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(label).alias("label"))


def write_texts_by_lang(df: DataFrame, path: str, **columns) -> str:
    """The training view with one folder per language: a job that trains one
    language reads that folder only.  Null languages get Spark's default folder."""
    texts_and_labels(df, **columns).write.mode("overwrite").partitionBy("lang").parquet(path)
    return path


def texts_labels_by_lang(df: DataFrame, lang: str = "lang", label: str = "polarity") -> DataFrame:
    """Per-language view of (texts, labels): kept distributed, summarised by
    counts per (lang, label) instead of being collected."""
    return df.groupBy(lang, label).agg(F.count(F.lit(1)).alias("n"))
