"""The registered query of each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facsimile.llm import alignment, html, lattice_lm, licenses, mixing, packing, periods, pii, quality, simhash, sketch, token_files, winnow
from facsimile.llm.registry import ORACLE, QUERIES, query, table

__all__ = ["ORACLE", "QUERIES"]


@query("op9_simhash_near_dedup")
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op10_quality_decision_list")
def op10_quality_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, base rule and learned verdict of every document."""
    judged, _ = quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    counts = [f"q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]
    return judged.select(F.col("id").alias("doc_id"), *counts, "kept", "rule")


@query("op3_arrow_token_files")
def op3_arrow_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written to Arrow files and read back."""
    shards = token_files.write(table(spark, sf_dir, "documents"))
    found = token_files.read_documents(spark, shards)
    return found.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op5_min_bin_slack_packing")
def op5_min_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence."""
    found = packing.pack(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op7_bottom_k_fingerprints")
def op7_bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottom-k sketch of every document and of its edited text."""
    found = sketch.edited(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        sketch.printed(F.col("sketch")).alias("fingerprint"),
        sketch.printed(F.col("edited_sketch")).alias("edited_fingerprint"),
        sketch.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        sketch.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        sketch.distinct_count(F.col("sketch")).alias("distinct_shingles"),
        sketch.containment(F.col("sketch"), F.col("edited_sketch")).alias("contained_in_edited"),
    )


@query("op2_license_scan")
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and labels of every document."""
    return licenses.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").drop("matches")


@query("op6_block_rule_extraction")
def op6_block_rule_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = html.extract(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query("op8_subword_lattice_lm")
def op8_subword_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and lattice log10 probability of every document."""
    return lattice_lm.score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op1_weighted_mixture")
def op1_weighted_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture: a row for each document and epoch."""
    found = mixing.mix(table(spark, sf_dir, "documents"), carry=False)
    return found.withColumnRenamed("id", "doc_id").withColumn("target", F.round("target", 3))


ORACLE["op1_weighted_mixture"] = mixing.mix_sql()


@query("op4_pii_boosted_candidates")
def op4_pii_boosted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data spans of every document."""
    found, _ = pii.detect(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("bigint")
    return found.select(
        F.col("id").alias("doc_id"),
        *[count(k).alias(f"n_{name}") for k, name in enumerate(pii.BASE_KINDS)],
        F.sha2(pii.printed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        pii.printed(F.col("spans")).alias("spans"),
    )


@query("op12_winnowing_decontamination")
def op12_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and benchmark items of every document that benchmark windows hit."""
    found = winnow.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        winnow.hit_words(F.col("spans")).alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


ORACLE["op12_winnowing_decontamination"] = winnow.CONTAMINATION_SQL


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, with repeats planted in a tenth of them."""
    found = periods.runs(periods.with_repeats(table(spark, sf_dir, "documents"))).withColumn("best", periods.strongest(F.col("runs")))
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("bigint").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(periods.listed(F.col("runs")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query("op11_tokenizer_alignment")
def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' ids of every document."""
    return alignment.summaries(alignment.align(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")
