"""Minority-class augmentation by seeded synonym replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aspectra import dicts
from aspectra.functions.hashing import hex_prefix_int, order_key
from aspectra.functions.text import tokens
from aspectra.operators.sampling import rank_in_strata


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def synonym_map(entries) -> Column:
    """(lang, word, alternatives) -> map<'lang|word', array<string>> literal."""
    args = []
    for lang, word, alts in entries:
        args += [F.lit(f"{lang}|{word}"), F.array(*[F.lit(a) for a in alts])]
    return F.create_map(*args) if args else F.create_map().cast("map<string,array<string>>")


def replace_synonyms(text, lang, row_id, synonyms=dicts.SYNONYMS,
                     prob: float = dicts.SYNONYM_PROB, seed: int = dicts.SEED) -> Column:
    """Per token: with probability ``prob`` replace it by one of its synonyms
    (a word without synonyms is kept).  Both draws are md5 of
    (seed, row, position), so the result is independent of partitioning."""
    m = synonym_map(synonyms)

    def per_token(w, i):
        alts = F.element_at(m, F.concat(_c(lang), F.lit("|"), w))
        return F.when((_draw(row_id, i, seed) < F.lit(prob)) & alts.isNotNull(), _pick(alts, row_id, i, seed)).otherwise(w)

    return F.array_join(F.transform(tokens(text), per_token), " ")


def _hashed(salt: str, row_id, i: Column, seed: int) -> Column:
    return hex_prefix_int(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), _c(row_id).cast("string"), i.cast("string"))))


def _draw(row_id, i: Column, seed: int) -> Column:
    """Uniform in [0, 1) of a row's token."""
    return _hashed("syn-u", row_id, i, seed) / F.lit(float(1 << 60))


def _pick(alts: Column, row_id, i: Column, seed: int) -> Column:
    return F.element_at(alts, (F.pmod(_hashed("syn-pick", row_id, i, seed), F.size(alts)) + 1).cast("int"))


def replace_synonyms_from(df: DataFrame, synonyms: DataFrame, id_col: str = "review_id", text: str = "text_processed", lang: str = "lang",
                          prob: float = dicts.SYNONYM_PROB, seed: int = dicts.SEED, out: str = "text_out") -> DataFrame:
    """``replace_synonyms`` with a table (lang, word, synonym) of any size.

    The same draws and the same result as with a literal of the sorted synonyms.
    Only the tokens that are drawn meet the table; the replacements come back as
    one sorted array per row.  The table is broadcast only below a checked number of words.
    Null words, null synonyms and a word given as its own synonym are passed over;
    a null text stays null; rows that share an id are told apart by their text."""
    from aspectra.session import broadcast_if_small
    alts = (synonyms.where("word is not null and synonym is not null and word <> synonym")
            .groupBy(F.col("lang").alias("__lang"), F.col("word").alias("__word")).agg(F.array_sort(F.collect_set("synonym")).alias("__alts")))
    rows = df.withColumn("__key", F.md5(F.concat_ws("|", *[F.coalesce(_c(c).cast("string"), F.lit("")) for c in (id_col, lang, text)])))
    drawn = F.filter(F.transform(tokens(text), lambda w, i: F.struct(i.alias("i"), w.alias("w"), (_draw(id_col, i, seed) < F.lit(prob)).alias("u"))), lambda x: x["u"])
    found = (rows.select("__key", F.col(id_col).alias("__id"), F.col(lang).alias("__lang"), F.explode(drawn).alias("t"))
             .select("__key", "__id", "__lang", "t.i", F.col("t.w").alias("__word"))
             .join(broadcast_if_small(alts), ["__lang", "__word"])
             .select("__key", "i", _pick(F.col("__alts"), "__id", F.col("i"), seed).alias("new")))
    new = found.groupBy("__key").agg(F.array_sort(F.collect_set(F.struct("i", "new"))).alias("__new"))      # bounded by the row's tokens

    def put(words):
        """The words between two replacements and the second one, piece by piece: a lookup
        of every word among all replacements would grow with the square of a text."""
        def piece(e, j):
            start = F.when(j == 0, F.lit(0)).otherwise(F.get("__new", j - 1)["i"] + 1)
            return F.concat(F.slice(words, start + 1, e["i"] - start), F.array(e["new"]))

        rest = F.slice(words, F.get("__new", F.size("__new") - 1)["i"] + 2, F.size(words))
        return F.array_join(F.concat(F.flatten(F.transform("__new", piece)), rest), " ")

    text_out = F.get(F.transform(F.array(tokens(text)), put), F.lit(0))
    return rows.join(new, "__key", "left").withColumn(out, F.when(F.col("__new").isNull(), F.array_join(tokens(text), " ")).otherwise(text_out)).drop("__key", "__new")


def augment_size(df: DataFrame, target_class: str = "neutral", label: str = "polarity") -> DataFrame:
    """One row: target size, others size, rows to generate (floor(others/2) - target, >= 0)."""
    t = F.count_if(F.col(label) == target_class)
    o = F.count_if(~F.coalesce(F.col(label) == target_class, F.lit(False)))
    return df.agg(t.alias("n_target"), o.alias("n_others")).withColumn(
        "n_generate", F.greatest(F.floor(F.col("n_others") / 2) - F.col("n_target"), F.lit(0)).cast("bigint"))


def augment_class(df: DataFrame, target_class: str = "neutral", label: str = "polarity",
                  id_col: str = "review_id", text: str = "text_processed", lang: str = "lang",
                  synonyms=dicts.SYNONYMS, prob: float = dicts.SYNONYM_PROB,
                  seed: int = dicts.SEED) -> DataFrame:
    """Generated target-class rows only (``aug_id`` 0..n-1), each a copy of a
    row drawn with replacement with synonym-replaced text in both ``text``
    and ``text_processed``.

    Target rows get a dense index by ``rank_in_strata`` (no global window);
    generated row i draws index md5(seed, i) mod n_target and is matched to
    it by an equi join.  Only the scalar size crosses to the driver."""
    spark = df.sparkSession
    sizes = augment_size(df, target_class, label).first()
    n_t, n_gen = int(sizes["n_target"]), int(sizes["n_generate"])
    cols = df.columns
    if n_t == 0 or n_gen == 0:
        return df.limit(0).withColumn("aug_id", F.lit(None).cast("bigint"))
    target = df.filter(F.col(label) == target_class)
    idx = rank_in_strata(target, [], order_key("augment-order", id_col, seed=seed), [id_col]) \
        .withColumn("__idx", F.col("__rank") - 1).drop("__rank", "__n_stratum")
    gen = spark.range(n_gen).withColumnRenamed("id", "aug_id")
    gen = gen.withColumn("__idx", F.pmod(hex_prefix_int(order_key("augment-pick", "aug_id", seed=seed)),
                                         F.lit(n_t)))
    g = gen.join(idx, "__idx")
    new_text = replace_synonyms(text, lang, "aug_id", synonyms, prob, seed)
    g = g.withColumn(text, new_text)
    if "text" in cols and text != "text":
        g = g.withColumn("text", F.col(text))
    return g.select(*cols, "aug_id")


def balanced_union(df: DataFrame, generated: DataFrame) -> DataFrame:
    """others + target class + generated rows (bag union)."""
    base = df.withColumn("aug_id", F.lit(None).cast("bigint"))
    return base.unionByName(generated)
