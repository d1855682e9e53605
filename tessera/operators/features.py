"""The 69 features of a candidate pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.normalize import postal_code
from tessera.functions.similarity import (
    acronym_match, first_number_match, legal_suffix, length_ratio, number_jaccard, partial_ratio, ratio, token_set_ratio, token_sort_ratio, trigram_cosine, word_containment, word_jaccard, word_overlap,
)

# The features' names in their order.
FEATURES = """
name_exact core_exact sorted_core_exact address_exact country_match country_missing country_both_missing country_conflict
name_ratio core_ratio address_ratio name_token_sort_ratio name_token_set_ratio address_token_sort_ratio address_token_set_ratio
name_partial_ratio core_partial_ratio name_token_containment address_token_containment acronym_match
address_number_jaccard first_number_match postal_match postal_conflict name_char_trigram_cosine address_char_trigram_cosine
name_token_jaccard name_token_overlap address_token_jaccard address_token_overlap name_length_ratio address_length_ratio
name_token_count_diff core_token_count_diff candidate_rank blocking_similarity target_source legal_suffix_agree legal_suffix_conflict
name_missing_left name_missing_right address_missing_left address_missing_right street_number_match street_number_conflict
street_ratio street_token_set_ratio city_ratio city_token_set_ratio city_exact postal_missing_either
name_rank_score address_rank_score name_address_rank_agreement reverse_similarity_rank_score mutual_best
source2_indicator source3_indicator opposite_source_bridge same_source_competition bridge_gap
learned_name_alias learned_name_explained learned_address_alias learned_address_explained
semantic_similarity semantic_rank_score semantic_lexical_alignment cross_encoder_score
""".split()


def flag(condition: Column) -> Column:
    return condition.cast("double")


def both(a: str, b: str) -> Column:
    return (F.col(a) != "") & (F.col(b) != "")


def source_bridge(rows: DataFrame) -> DataFrame:
    """Adds opposite_source_bridge, same_source_competition and bridge_gap.

    Each candidate is compared with the three best of the other target source and of its own (itself left out), by
    0.6 core + 0.4 address word similarity. The best four of each source are gathered per source entity: eight at most.
    """
    side = F.when(F.col("target_id").startswith("S3-"), "S3").otherwise("S2")
    rows = rows.withColumn("_side", side)
    order = Window.partitionBy("source1_id", "_side").orderBy(F.desc("similarity"), "target_id")
    ranked = rows.select("source1_id", "_side", "target_id", F.col("t_core").alias("c"), F.col("t_address").alias("a"), "similarity").withColumn("k", F.row_number().over(order)).where("k <= 4")
    best = ranked.groupBy("source1_id").agg(F.sort_array(F.collect_list(F.struct("k", "_side", "target_id", "c", "a"))).alias("_best"))
    rows = rows.join(best, "source1_id")

    def words(text: Column) -> Column:
        return F.array_distinct(F.filter(F.split(text, " "), lambda w: w != ""))

    def jaccard(x: Column, y: Column) -> Column:
        union = F.size(F.array_union(words(x), words(y)))
        return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(words(x), words(y))) / union)

    def closest(pool: Column) -> Column:
        scores = F.transform(F.slice(pool, 1, 3), lambda o: 0.6 * jaccard(F.col("t_core"), o["c"]) + 0.4 * jaccard(F.col("t_address"), o["a"]))
        return F.coalesce(F.array_max(scores), F.lit(0.0))

    opposite = F.filter("_best", lambda o: o["_side"] != F.col("_side"))
    same = F.filter("_best", lambda o: (o["_side"] == F.col("_side")) & (o["target_id"] != F.col("target_id")))
    rows = rows.withColumn("opposite_source_bridge", closest(opposite)).withColumn("same_source_competition", closest(same))
    return rows.withColumn("bridge_gap", F.col("opposite_source_bridge") - F.col("same_source_competition")).drop("_side", "_best")


def feature_table(rows: DataFrame) -> DataFrame:
    """Every column of ``rows`` and FEATURES.

    ``rows``: final candidates with fields of both entities (see ``with_fields``), scores and rank windows. Columns that a
    run has not (learned variation, cross encoder) count as 0. Edit ratios run in Arrow batches after all joins.
    """
    def optional(name: str) -> Column:
        return F.col(name).cast("double") if name in rows.columns else F.lit(0.0)

    if "opposite_source_bridge" not in rows.columns:
        rows = source_bridge(rows)
    s, t = "s_country", "t_country"
    zp, tp = postal_code("s_address"), postal_code("t_address")
    sx, tx = legal_suffix("s_name", "s_core"), legal_suffix("t_name", "t_core")
    count = lambda c: F.size(F.filter(F.split(F.col(c), " "), lambda w: w != ""))
    made = {
        "name_exact": flag(both("s_name", "t_name") & (F.col("s_name") == F.col("t_name"))),
        "core_exact": flag(both("s_core", "t_core") & (F.col("s_core") == F.col("t_core"))),
        "sorted_core_exact": flag(both("s_sorted_core", "t_sorted_core") & (F.col("s_sorted_core") == F.col("t_sorted_core"))),
        "address_exact": flag(both("s_address", "t_address") & (F.col("s_address") == F.col("t_address"))),
        "country_match": flag(both(s, t) & (F.col(s) == F.col(t))),
        "country_missing": flag(~both(s, t)),
        "country_both_missing": flag((F.col(s) == "") & (F.col(t) == "")),
        "country_conflict": flag(both(s, t) & (F.col(s) != F.col(t))),
        "name_ratio": ratio("s_name", "t_name"),
        "core_ratio": ratio("s_core", "t_core"),
        "address_ratio": ratio("s_address", "t_address"),
        "name_token_sort_ratio": token_sort_ratio("s_name", "t_name"),
        "name_token_set_ratio": token_set_ratio("s_name", "t_name"),
        "address_token_sort_ratio": token_sort_ratio("s_address", "t_address"),
        "address_token_set_ratio": token_set_ratio("s_address", "t_address"),
        "name_partial_ratio": partial_ratio("s_name", "t_name"),
        "core_partial_ratio": partial_ratio("s_core", "t_core"),
        "name_token_containment": word_containment("s_core", "t_core"),
        "address_token_containment": word_containment("s_address", "t_address"),
        "acronym_match": acronym_match("s_core", "t_core"),
        "address_number_jaccard": number_jaccard("s_numbers", "t_numbers"),
        "first_number_match": first_number_match("s_numbers", "t_numbers"),
        "postal_match": flag((zp != "") & (zp == tp)),
        "postal_conflict": flag((zp != "") & (tp != "") & (zp != tp)),
        "name_char_trigram_cosine": trigram_cosine("s_name", "t_name"),
        "address_char_trigram_cosine": trigram_cosine("s_address", "t_address"),
        "name_token_jaccard": word_jaccard("s_core", "t_core"),
        "name_token_overlap": word_overlap("s_core", "t_core"),
        "address_token_jaccard": word_jaccard("s_address", "t_address"),
        "address_token_overlap": word_overlap("s_address", "t_address"),
        "name_length_ratio": length_ratio("s_name", "t_name"),
        "address_length_ratio": length_ratio("s_address", "t_address"),
        "name_token_count_diff": F.abs(count("s_name") - count("t_name")).cast("double"),
        "core_token_count_diff": F.abs(count("s_core") - count("t_core")).cast("double"),
        "candidate_rank": F.col("rank").cast("double"),
        "blocking_similarity": F.col("similarity"),
        "target_source": F.when(F.col("target_id").startswith("S3-"), 3.0).otherwise(2.0),
        "legal_suffix_agree": flag((sx != "") & (sx == tx)),
        "legal_suffix_conflict": flag((sx != "") & (tx != "") & (sx != tx)),
        "name_missing_left": flag(F.col("s_name") == ""),
        "name_missing_right": flag(F.col("t_name") == ""),
        "address_missing_left": flag(F.col("s_address") == ""),
        "address_missing_right": flag(F.col("t_address") == ""),
        "street_number_match": flag(both("s_street_number", "t_street_number") & (F.col("s_street_number") == F.col("t_street_number"))),
        "street_number_conflict": flag(both("s_street_number", "t_street_number") & (F.col("s_street_number") != F.col("t_street_number"))),
        "street_ratio": ratio("s_street", "t_street"),
        "street_token_set_ratio": token_set_ratio("s_street", "t_street"),
        "city_ratio": ratio("s_city", "t_city"),
        "city_token_set_ratio": token_set_ratio("s_city", "t_city"),
        "city_exact": flag(both("s_city", "t_city") & (F.col("s_city") == F.col("t_city"))),
        "postal_missing_either": flag(~both("s_postal", "t_postal")),
        "name_rank_score": 1.0 / F.greatest(F.col("name_rank"), F.lit(1)),
        "address_rank_score": 1.0 / F.greatest(F.col("address_rank"), F.lit(1)),
        "name_address_rank_agreement": F.col("rank_agreement"),
        "reverse_similarity_rank_score": 1.0 / F.greatest(F.col("reverse_rank"), F.lit(1)),
        "mutual_best": F.col("mutual_best").cast("double"),
        "source2_indicator": flag(F.col("target_id").startswith("S2-")),
        "source3_indicator": flag(F.col("target_id").startswith("S3-")),
        "opposite_source_bridge": F.col("opposite_source_bridge"),
        "same_source_competition": F.col("same_source_competition"),
        "bridge_gap": F.col("bridge_gap"),
        **{c: optional(c) for c in ("learned_name_alias", "learned_name_explained", "learned_address_alias", "learned_address_explained", "cross_encoder_score")},
        "semantic_similarity": F.col("semantic_score").cast("double"),
        "semantic_rank_score": F.when(F.col("semantic_rank") > 0, 1.0 / (1.0 + F.col("semantic_rank"))).otherwise(0.0),
    }
    # Arrow columns apart from built-in ones
    names = list(made)
    made = rows.withColumns({c: made[c] for c in names if not c.endswith(("ratio", "cosine")) or c.endswith("length_ratio")}).withColumns({c: made[c] for c in names if c.endswith(("ratio", "cosine")) and not c.endswith("length_ratio")})
    return made.withColumn("semantic_lexical_alignment", F.col("semantic_similarity") * F.greatest("name_ratio", "address_ratio"))


def feature_summary(features: DataFrame) -> DataFrame:
    """Rows, and each feature's mean to 6 places, in long form."""
    means = features.agg(*[F.round(F.avg(c), 6).alias(c) for c in FEATURES])
    return means.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("mean")) for c in FEATURES])).alias("x")).select("x.*")
