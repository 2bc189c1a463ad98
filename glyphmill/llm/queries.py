"""The registered queries of this folder: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import decontaminate, dedup, html, licenses, quality, secrets, sharding, tokenizers_, urls
from glyphmill.llm.scratch import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """A public vocabulary file's path; pass another path to the operators to use another file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"),
    )


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored ledger: every rule is evaluated once, whatever policies read it."""
    return Scratch(spark, "ledger").keep("ledger", quality.ledger(table(spark, sf_dir, "documents")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.apply_policy(_ledger(spark, sf_dir), quality.PRODUCTION)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality.fails(quality.BASE).alias("base_failed"), "kept", "failed_bits")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4's ledger under each policy: what every rule rejects, and what it alone rejects."""
    rows = _ledger(spark, sf_dir)
    each = [quality.ablations(rows, p).select(F.lit(p.version).alias("policy"), "rule", "n_failed", "n_only") for p in (quality.BASE, quality.PRODUCTION)]
    return each[0].union(each[1])


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), shards=24)


#: The list of op6 is a product of these: canonical URLs of a few sites, numbered below LISTED_NUMBERS.  It does not come from pages.
LISTED_SUBS, LISTED_SITES, LISTED_TOPS, LISTED_LANGS = ("", "www."), ("casino-win", "free-bets", "cheap-pills", "ads-track"), ("com", "net", "org"), ("en", "de", "fr", "es")
LISTED_NUMBERS = 1000


def listed_urls(spark: SparkSession) -> DataFrame:
    """The list of op6, of a fixed size (96,000)."""
    parts, n = [LISTED_SUBS, LISTED_SITES, LISTED_TOPS, LISTED_LANGS], F.floor(F.col("id") / LISTED_NUMBERS).cast("int")
    names = []
    for values in parts:
        names.append(F.get(F.array(*[F.lit(v) for v in values]), n % len(values)))
        n = F.floor(n / len(values)).cast("int")
    sub, site, top, lang = names
    rows = spark.range(LISTED_NUMBERS * math.prod(map(len, parts)))
    return rows.select(F.concat(sub, site, F.lit(".example."), top, F.lit("/"), lang, F.lit("/"), (F.col("id") % LISTED_NUMBERS).cast("string")).alias("canonical_url"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(table(spark, sf_dir, "pages"), listed_urls(spark))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizers_.sentencepiece_round_trip(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizers_.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_minhash_dedup, op2_secret_scan, op3_html_text, op4_quality_rules, quality_ablations, op5_sharding, op6_url_filter, op7_decontamination, op8_license_scan, op9_sentencepiece, op10_token_counts, pipeline)}
