"""The corpus operators as queries over whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citeloom.tables import load


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text, by the compiled transducer. No SQL: tested against the vocabulary's library."""
    import public_tokenizers

    from citeloom.llm.tokens import count_tokens

    return count_tokens(load(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that are kept elsewhere. No SQL: min-max bands; tested with planted pairs."""
    from citeloom.llm.lines import line_report

    return line_report(load(spark, sf_dir, "documents"))


def op5_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every text. No SQL: seating is sampled; its counts are tested by brute force."""
    from citeloom.llm.langmodel import score

    return score(load(spark, sf_dir, "documents"))


def op6_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back. No SQL (SHA-1 in base 32): an exact round trip is tested."""
    from citeloom.llm.warc import archive_report

    return archive_report(load(spark, sf_dir, "pages"))


def op7_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page. No SQL: tested on pages with known text."""
    from citeloom.llm.html import extract

    return extract(load(spark, sf_dir, "pages"))


def op8_factorisation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document. No SQL: tested by held-out accuracy."""
    from citeloom.llm.quality import quality_report

    return quality_report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside benchmark windows. SQL would join all windows: tested against brute force."""
    from citeloom.llm.contamination import report

    return report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op2_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text. No SQL: the random subsets have none; tested by brute force."""
    from citeloom.llm.fingerprint import fingerprints

    return fingerprints(load(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    from citeloom.llm.mixing import mixture_report

    return mixture_report(load(spark, sf_dir, "documents"))


def op10_minmax_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents. SQL would join all shingles: tested against brute force."""
    from citeloom.llm.near import near_duplicates

    return near_duplicates(load(spark, sf_dir, "documents"))


def op11_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes."""
    from citeloom.llm.sharding import shard_report

    return shard_report(load(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents drawn towards the benchmark's words, with the weights of all."""
    from citeloom.llm.resampling import resample

    return resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest repair of every damaged conversation. No SQL: a search over edits; tested by brute force."""
    from citeloom.llm.conversations import structure_report

    return structure_report(load(spark, sf_dir, "conversations"))


def _sql() -> dict[str, str]:
    from citeloom.llm.mixing import MIX_SQL
    from citeloom.llm.resampling import RESAMPLE_SQL
    from citeloom.llm.sharding import SHARD_SQL

    return {"op3_source_mixing": MIX_SQL, "op11_kd_tree_shards": SHARD_SQL, "op12_importance_resampling": RESAMPLE_SQL}


SQL: dict[str, str] = _sql()
QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_imatch_fingerprints,
        op3_source_mixing,
        op4_fuzzy_line_dedup,
        op5_pitman_yor_scores,
        op6_seekable_warc,
        op7_template_extraction,
        op8_factorisation_quality,
        op9_benchmark_decontamination,
        op10_minmax_near_duplicates,
        op11_kd_tree_shards,
        op12_importance_resampling,
        op13_structure_repair,
    )
}
