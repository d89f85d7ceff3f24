"""The training-data queries, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratlas.llm import borda, clusters, encode, language, markup, mixing, residue, spans, stratified
from stratlas.operators.ordering import global_positions
from stratlas.session import read


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return language.found(spark, sf)


def p1_segments(spark: SparkSession, sf: str) -> DataFrame:
    return language.segment_table(language.languages(read(spark, sf, "repo"), read(spark, sf, "documents")))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.cliques(read(spark, sf, "world"))


def p2_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.cluster_report(read(spark, sf, "world"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return borda.higher_of(read(spark, sf, "rank_pair"), borda.borda_points(read(spark, sf, "repo_signals")))


def p3_ranking(spark: SparkSession, sf: str) -> DataFrame:
    points = borda.borda_points(read(spark, sf, "repo_signals"))
    return global_positions(points, "points", F.col("id")).select(F.col("id").alias("repo_id"), "points", "position")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue.found(spark, sf)


def p5_groups(spark: SparkSession, sf: str) -> DataFrame:
    return residue.residue_groups(residue.signatures(residue.texts_of(read(spark, sf, "repo"), read(spark, sf, "documents"))))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return markup.found(spark, sf)


def p6_clean(spark: SparkSession, sf: str) -> DataFrame:
    return markup.cleaned(read(spark, sf, "repo"), read(spark, sf, "documents"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = stratified.strata(read(spark, sf, "repo"), read(spark, sf, "world"))
    return stratified.plan_sample(rows, read(spark, sf, "stratum_target"))[0].where("gap > 0").select("stratum_key")


def _sample(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = stratified.strata(read(spark, sf, "repo"), read(spark, sf, "world"))
    table, weights = stratified.plan_sample(rows, read(spark, sf, "stratum_target"))
    return table, stratified.draw(rows, table, weights)


def p7_sample(spark: SparkSession, sf: str) -> DataFrame:
    return _sample(spark, sf)[1]


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    return stratified.sample_report(*_sample(spark, sf))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode.encode_ids(read(spark, sf, "documents"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    _, plan = mixing.planned(read(spark, sf, "documents"), read(spark, sf, "mix_target"))
    return plan.where("short").select("source")


def p9_report(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_report(*mixing.mix(read(spark, sf, "documents"), read(spark, sf, "mix_target")))


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    _, mixed = mixing.mix(read(spark, sf, "documents"), read(spark, sf, "mix_target"))
    return mixed.select("shard", "slot", "source", "repeat", "block_no", "ids")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return spans.span_pairs(*spans.shared_spans(read(spark, sf, "documents")))


def p10_shared(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    return spans.shared_report(docs, *spans.shared_spans(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries by name."""
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}
