"""Registered queries of the dealt operators: thin callables that apply the
operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

QUERIES: dict = {}


def query(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op3_minhash_forest")
def op3(spark, sf_dir):
    from aspectra.llm.minhash_forest import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op8_quality")
def op8(spark, sf_dir):
    from aspectra.llm.quality import quality
    return quality(table(spark, sf_dir, "documents"))


@query("op2_license_scan")
def op2(spark, sf_dir):
    from aspectra.llm.license_scan import scan
    return scan(table(spark, sf_dir, "documents"))


@query("op1_mixing")
def op1(spark, sf_dir):
    from aspectra.llm.mixing import mix
    return mix(table(spark, sf_dir, "documents"))


@query("op5_decontamination")
def op5(spark, sf_dir):
    from aspectra.llm.decontamination import leaks_by_document
    return leaks_by_document(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_suffix_dedup")
def op4(spark, sf_dir):
    from aspectra.llm.suffix_dedup import repeated_passages
    return repeated_passages(table(spark, sf_dir, "documents"))


@query("op10_paragraph_dedup")
def op10(spark, sf_dir):
    from aspectra.llm.paragraph_dedup import paragraph_report
    return paragraph_report(table(spark, sf_dir, "documents"))


@query("op6_url_templates")
def op6(spark, sf_dir):
    from aspectra.llm.url_templates import filter_urls
    return filter_urls(table(spark, sf_dir, "pages"))


@query("op9_token_counts")
def op9(spark, sf_dir):
    from aspectra.llm.token_counts import token_counts
    return token_counts(table(spark, sf_dir, "documents"))


@query("op7_html_consensus")
def op7(spark, sf_dir):
    from aspectra.llm.html_consensus import main_texts
    return main_texts(table(spark, sf_dir, "pages"))


@query("op11_line_dedup")
def op11(spark, sf_dir):
    from aspectra.llm.line_dedup import line_report
    return line_report(table(spark, sf_dir, "documents"))


@query("op12_merkle_manifest")
def op12(spark, sf_dir):
    from aspectra.llm.merkle import tamper_report
    return tamper_report(table(spark, sf_dir, "documents"))


@query("op13_conversation_repair")
def op13(spark, sf_dir):
    from aspectra.llm.conversation_repair import repair_report
    return repair_report(table(spark, sf_dir, "conversations"))
