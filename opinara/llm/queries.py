"""Queries over the test tables: name -> f(spark, folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm import p1_tokens, p2_overlap, p3_language, p4_pairs, p5_confusables, p6_sample, p7_groups, p8_packing, p9_mixing, p10_reading


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_tokens.token_budget(_table(spark, sf_dir, "dataset"))


def p1_document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_tokens.totals(*p1_tokens.document_tokens(_table(spark, sf_dir, "dataset"), "text", ["row_no"]), ["row_no"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_overlap.overlap_pairs(*p2_overlap.split_overlap(_table(spark, sf_dir, "dataset")))


def p2_overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "dataset")
    return p2_overlap.overlap_report(rows, *p2_overlap.split_overlap(rows))


def p2_overlap_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_overlap.overlap_classes(*p2_overlap.split_overlap(_table(spark, sf_dir, "dataset"))).withColumnRenamed("rid", "row_no")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_language.wrong_labels(p3_language.document_languages(_table(spark, sf_dir, "dataset")))


def p3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = p3_language.document_languages(_table(spark, sf_dir, "dataset"))
    return found.select("row_no", F.explode("segments").alias("s")).select("row_no", "s.*")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_pairs.first_defect(p4_pairs.defects(_table(spark, sf_dir, "thinking_sanity")))


def p4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_pairs.defects(_table(spark, sf_dir, "thinking_sanity"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for table, key in (("dataset", "row_no"), ("synthetic_v1", "id")):
        rows = _table(spark, sf_dir, table).select(F.lit(table).alias("rec_table"), F.col(key).cast("string").alias("rec_key"), "text")
        parts.append(p5_confusables.odd_rows(rows, "text", ["rec_table", "rec_key"]))
    return parts[0].unionByName(parts[1])


def p5_skeleton_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [_table(spark, sf_dir, t).select(F.lit(t).alias("rec_table"), F.col(k).cast("string").alias("rec_key"), "text") for t, k in (("dataset", "row_no"), ("synthetic_v1", "id"))]
    return p5_confusables.skeleton_groups(rows[0].unionByName(rows[1]), "text", ["rec_table", "rec_key"])


def _quotas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return p6_sample.quota_sample(_table(spark, sf_dir, "generation_plan"), _table(spark, sf_dir, "plan_quota"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quotas(spark, sf_dir)[1].where("short").select("quota_id")


def p6_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quotas(spark, sf_dir)[0]


def p6_quota_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quotas(spark, sf_dir)[1]


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = p7_groups.group_pairs(p7_groups.review_groups(_table(spark, sf_dir, "synthetic_v1")))
    plans = p7_groups.group_pairs(p7_groups.plan_groups(_table(spark, sf_dir, "generation_plan")))
    named = lambda df, table: df.select(F.lit(table).alias("rec_table"), "key_a", "key_b")
    return named(reviews, "synthetic_v1").unionByName(named(plans, "generation_plan"))


def p7_groups_of_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = p7_groups.review_groups(_table(spark, sf_dir, "synthetic_v1")).select(F.lit("synthetic_v1").alias("rec_table"), "*")
    plans = p7_groups.plan_groups(_table(spark, sf_dir, "generation_plan")).select(F.lit("generation_plan").alias("rec_table"), "*")
    return reviews.unionByName(plans)


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_packing.pack(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "container_spec"))


def p8_fill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_packing.fill_report(p8_packed(spark, sf_dir), _table(spark, sf_dir, "container_spec"))


def p9_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_mixing.mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_target"))[0]


def p9_mix_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_mixing.mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_target"))[1]


def p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_reading.reading_levels(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "reading_anchor"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_levels(spark, sf_dir).where("level = 'advanced'").select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (p1_token_budget, p1_document_tokens, p2_found, p2_overlap_report, p2_overlap_classes, p3_found, p3_segments, p4_found, p4_rules, p5_found, p5_skeleton_groups, p6_found, p6_sampled, p6_quota_report, p7_found, p7_groups_of_keys, p8_packed, p8_fill_report, p9_mixed, p9_mix_report, p10_found, p10_levels)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """Only the quotas can be said in SQL; the other operators are tested against brute force, exact round trips or held-out labels."""
    return {
        "p6_found": """
WITH u AS (SELECT DISTINCT plan_id, lower(trim(bucket)) b, lower(trim("language")) l, cardinality(target_gold) g FROM generation_plan WHERE plan_id IS NOT NULL),
t AS (SELECT count(DISTINCT plan_id) // 4 n FROM u), c AS (SELECT b, l, g, count(*) have FROM u WHERE b IS NOT NULL AND l IS NOT NULL AND g IS NOT NULL GROUP BY 1, 2, 3)
SELECT quota_id FROM plan_quota CROSS JOIN t LEFT JOIN c ON b = lower(trim(bucket)) AND l = lower(trim("language")) AND g = gold_labels
WHERE coalesce(have, 0) < min_rows OR coalesce(have, 0) < target_share * n - 1e-9""",
    }
