"""Queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.llm import canonical, entities, mixing, packing, quality, terms

ACCESS_FIELDS = ["bicycle", "cycleway", "motor_vehicle"]
TERM_FIELDS = ["highway", "cycleway"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mapped_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference = _table(spark, sf_dir, "access_values")
    entries = canonical.free_entries(_table(spark, sf_dir, "edges"), "ord", ACCESS_FIELDS, reference)
    return canonical.map_to_canonical(entries, reference)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accepted value that each freely typed access entry means, 0 for none."""
    return _mapped_access(spark, sf_dir).select("ord", "field", "ref_id")


def p1_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed values that mean no accepted value, with their records."""
    return canonical.unmatched_report(_mapped_access(spark, sf_dir))


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.mark_terms(*terms.term_frequencies(terms.field_terms(_table(spark, sf_dir, "edges"), "ord", TERM_FIELDS)))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms too rare or too common to be useful."""
    return _terms(spark, sf_dir).where("mark is not null").select("field", "term", "mark")


def p2_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term with its occurrences, records and mark."""
    return _terms(spark, sf_dir).select("field", "term", "occurrences", "records", F.round("share", 6).alias("share"), "mark")


def _sections(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    targets = entities.recorded_lengths(_table(spark, sf_dir, "target_features"), _table(spark, sf_dir, "edges"))
    matches = _table(spark, sf_dir, "match_features")
    sides = [
        df.select(F.col("id").alias("key"), F.col("geometry").alias("g"), "name", F.col(kind).alias("kind"), "length")
        for df, kind in ((targets, "highway"), (matches, "road_class"))
    ]
    return sides


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and match records of the same stretch of the same street."""
    return entities.matched_sections(*_sections(spark, sf_dir)).select("target_id", "match_id")


def p4_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs with their cosines, exact measures and confidence."""
    return entities.matched_sections(*_sections(spark, sf_dir))


def p4_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the confidence without names compares with the names, which it hasn't seen."""
    return entities.calibration(entities.measured_pairs(*_sections(spark, sf_dir)))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and the container each went to."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill_report(p7_packed(spark, sf_dir))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture and how often each is used."""
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))
    return mixed.select("doc_id", "source", "tokens", "copies")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of tokens each source reached."""
    targets = _table(spark, sf_dir, "mix_targets")
    return mixing.share_report(mixing.mix_sources(_table(spark, sf_dir, "documents"), targets), targets)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text is a list, a table or junk."""
    return quality.score_texts(_table(spark, sf_dir, "documents")).where(F.col("far_out") > F.col("limit")).select("doc_id")


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics and scores of every document and what puts it in a tail."""
    scored = quality.score_texts(_table(spark, sf_dir, "documents"))
    rounded = [F.round(s, 6).alias(s) for s in quality.STATISTICS]
    scores = [F.round(f"z_{s}", 3).alias(f"z_{s}") for s in quality.STATISTICS]
    return scored.select("doc_id", "language", *rounded, *scores, F.round("far_out", 3).alias("far_out"), F.array_join("tails", ",").alias("tails"))


QUERIES = {"p1_found": p1_found, "p1_unmatched": p1_unmatched, "p2_found": p2_found, "p2_terms": p2_terms, "p4_found": p4_found, "p4_confidence": p4_confidence, "p4_calibration": p4_calibration, "p7_packed": p7_packed, "p7_fill": p7_fill, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p9_found": p9_found, "p9_statistics": p9_statistics}
SQL: dict[str, str] = {}
