"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veritrove.llm.jaccard_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"), n_words=5, threshold=0.75)



def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veritrove.llm.quality_rules import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents"))


def quality_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on hosts with a limit that some hosts of the tables exceed."""
    from pyspark.sql import functions as F

    from veritrove.llm.quality_rules import host_verdicts, quality_features

    d = quality_features(_table(spark, sf_dir, "documents").select("text", F.coalesce("source", F.lit("")).alias("host")))
    v = host_verdicts(d.select("host", "q.base_failed"), 0.12)
    return v.select("host", "n_docs", "n_failed", F.round("host_rate", 6).alias("host_rate"), "host_failed")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veritrove.llm.lm_scoring import score_texts

    return score_texts(_table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veritrove.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veritrove.llm.license_scan import license_scan

    return license_scan(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veritrove.llm.decontaminate import find_leaks

    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veritrove.llm.line_dedup import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veritrove.llm.warc import warc_round_trip

    return warc_round_trip(_table(spark, sf_dir, "pages"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from veritrove.llm.token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veritrove.llm.html_extract import extract

    return extract(_table(spark, sf_dir, "pages"))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veritrove.llm.phrase_mining import collocations

    return collocations(_table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veritrove.llm.conversation_repair import damage_and_repair

    return damage_and_repair(_table(spark, sf_dir, "conversations"))


def op13_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from veritrove.llm.piece_encoding import encode_pieces

    return encode_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard, op2_quality_rules, op3_lm_scoring, op4_best_fit_packing, op5_license_scan,
        op6_decontamination, op7_line_dedup, op8_warc, op9_token_counts, op10_html_extraction,
        op11_phrase_mining, op12_conversation_repair, op13_piece_encoding, quality_hosts,
    )
}
