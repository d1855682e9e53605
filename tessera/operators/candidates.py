"""Shortlists and the adaptive choice of final candidates, as ranks over windows of one source entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.similarity import ratio, token_set_ratio

TOP_K, SHORTLIST = 64, 8
FLOOR, MARGIN, MIN_KEEP = 0.55, 0.20, (4, 12, 24)


def quotas(top_k: int) -> dict[str, int]:
    """Candidates that each route may put on the shortlist: proportions of 96, 64 and 32 at 64."""
    return {"evidence": top_k * 3 // 2, "exact_evidence": top_k, "name_evidence": top_k, "address_evidence": top_k, "structural_evidence": top_k // 2, "semantic_score": top_k}


def shortlist(raw: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """``raw`` with source and target fields, cut to SHORTLIST * top_k rows for a source entity.

    Each route takes its best first, two lexical routes theirs by token-set ratio, and what room is left goes to evidence. A source
    within the budget keeps all rows, so the ranks only matter beyond it.
    """
    by = Window.partitionBy("source1_id")
    ties = [F.desc("evidence"), F.desc("support_count"), F.desc("target_id")]
    rows = raw.withColumn("_n", F.count("*").over(by))
    crowded = rows.where(F.col("_n") > SHORTLIST * top_k)
    crowded = crowded.withColumn("_core", token_set_ratio("s_core", "t_core")).withColumn("_address", token_set_ratio("s_address", "t_address"))
    place = F.lit(10**9)
    for k, (route, quota) in enumerate([*quotas(top_k).items(), ("_core", top_k * 3 // 2), ("_address", top_k * 3 // 2)]):
        rank = F.row_number().over(by.orderBy(F.desc(route), *ties))
        place = F.least(place, F.when(rank <= quota, k * 10_000 + rank).otherwise(10**9))
    crowded = crowded.withColumn("_p", place).withColumn("_r", F.row_number().over(by.orderBy("_p", *ties))).where(F.col("_r") <= SHORTLIST * top_k)
    return rows.where(F.col("_n") <= SHORTLIST * top_k).drop("_n").unionByName(crowded.drop("_n", "_core", "_address", "_p", "_r"))


def similarity_parts(rows: DataFrame) -> DataFrame:
    """name_score and address_score: the better of edit ratio and token-set ratio."""
    return rows.withColumn("name_score", F.greatest(ratio("s_core", "t_core"), token_set_ratio("s_core", "t_core"))).withColumn(
        "address_score", F.greatest(ratio("s_address", "t_address"), token_set_ratio("s_address", "t_address"))
    )


def similarity(rows: DataFrame) -> DataFrame:
    """Adds ev_norm (evidence from least to most within a source entity; 1 if all are equal) and similarity, to 9 places."""
    by = Window.partitionBy("source1_id")
    low, high = F.min("evidence").over(by), F.max("evidence").over(by)
    rows = rows.withColumn("ev_norm", F.when(high > low, (F.col("evidence") - low) / (high - low)).otherwise(1.0))
    structural = F.when(F.col("structural_evidence") > 0, 1.0).otherwise(0.0)
    support = F.least(F.col("support_count"), F.lit(4)) / 4.0
    exact = F.when(F.col("exact_evidence") > 0, 1.0).otherwise(0.0)
    semantic = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("semantic_score")))
    total = 0.31 * F.col("name_score") + 0.31 * F.col("address_score") + 0.20 * semantic + 0.08 * F.col("ev_norm") + 0.05 * exact + 0.05 * F.greatest(structural, support)
    return rows.withColumn("similarity", F.round(total, 9))


def strong() -> Column:
    n, a = F.col("name_score"), F.col("address_score")
    return (F.col("exact_evidence") > 0) | (F.col("semantic_score") >= 0.90) | ((n >= 0.92) & (a >= 0.85)) | ((n >= 0.95) & (a >= 0.70)) | ((a >= 0.95) & (n >= 0.70))


def adaptive_select(rows: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """At most ``top_k`` candidates of a source entity, with their ``rank`` by similarity.

    Strong ones come first, then a few of each target source, then those within the score band, then as many as make up
    the least number, which is smaller the better the best candidate is. All windows share one partitioning."""
    by = Window.partitionBy("source1_id")
    quota = min(4, max(1, top_k // 8))
    order = [F.desc("similarity"), F.asc("target_id")]
    rows = rows.withColumn("_strong", F.coalesce(strong(), F.lit(False))).withColumn("_top", F.max("similarity").over(by)).withColumn("_n", F.count("*").over(by))
    rows = rows.withColumn("_source", F.substring("target_id", 1, 3))
    rows = rows.withColumn("_rp", F.row_number().over(Window.partitionBy("source1_id", "_strong", "_source").orderBy(*order)))
    least = F.when(F.col("_top") >= 0.90, MIN_KEEP[0]).when(F.col("_top") >= 0.80, min(MIN_KEEP[1], top_k)).otherwise(min(MIN_KEEP[2], top_k))
    phase = (
        F.when(F.col("_strong"), 0)
        .when((F.col("_source") == "S2-") & (F.col("_rp") <= quota), 1)
        .when((F.col("_source") == "S3-") & (F.col("_rp") <= quota), 2)
        .when(F.col("similarity") >= F.greatest(F.lit(FLOOR), F.round(F.col("_top") - MARGIN, 9)), 3)
        .otherwise(4)
    )
    rows = rows.withColumn("_phase", phase).withColumn("_r", F.row_number().over(by.orderBy("_phase", *order)))
    kept = rows.where((F.col("_n") <= top_k) | ((F.col("_phase") < 4) & (F.col("_r") <= top_k)) | (F.col("_r") <= F.least(least, F.lit(top_k))))
    return kept.withColumn("rank", F.row_number().over(by.orderBy(*order))).drop("_strong", "_top", "_n", "_source", "_rp", "_phase", "_r")


def rank_windows(rows: DataFrame) -> DataFrame:
    """name_rank, address_rank, reverse_rank (by target), mutual_best and rank_agreement, over all candidates."""
    by, to = Window.partitionBy("source1_id"), Window.partitionBy("target_id")
    rows = rows.withColumn("name_rank", F.row_number().over(by.orderBy(F.desc("name_score"), "target_id")))
    rows = rows.withColumn("address_rank", F.row_number().over(by.orderBy(F.desc("address_score"), "target_id")))
    rows = rows.withColumn("reverse_rank", F.row_number().over(to.orderBy(F.desc("similarity"), "source1_id")))
    return rows.withColumn("mutual_best", ((F.col("rank") == 1) & (F.col("reverse_rank") == 1)).cast("int")).withColumn("rank_agreement", 1.0 / (1.0 + F.abs(F.col("name_rank") - F.col("address_rank"))))


def with_fields(pairs: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Pairs with the fields of both entities, prefixed s_ and t_."""
    s = sources.select(F.col("entity_id").alias("source1_id"), *[F.col(c).alias(f"s_{c}") for c in sources.columns if c != "entity_id"])
    t = targets.select(F.col("entity_id").alias("target_id"), *[F.col(c).alias(f"t_{c}") for c in targets.columns if c not in ("entity_id", "split")])
    return pairs.join(s, "source1_id").join(t, "target_id")
