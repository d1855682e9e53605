"""Registered queries of the linkage operators, and their DuckDB SQL.

The driver's tables hold no businesses, so entities come from documents: the first eight words are a name, the next twelve an
address, the language a country; doc_id mod 3 deals them to source 1 and to target sources 2 and 3. Equal texts are matches.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import normalize as N
from tessera.functions import similarity as S
from tessera.operators import blocking, candidates, decision, features, keys, metrics, models, semantic, splits, variation
from tessera.plans.keep import written
from tessera.sources import tables

LITERALS = [
    (1, "Acme Corporation", "12 Main Street Suite 400, Springfield, 62704"),
    (2, "Société Anonyme Paris", "Résidence, Boulevard des Lilas"),
    (3, "Acme Bakery LLC", "221B Baker Street; London"),
    (4, "acme private limited", "5 Bombay Avenue"),
    (5, "Müller & Söhne Gesellschaft mit beschränkter Haftung", "near Old Strasse 7 | Berlin 10115"),
    (6, "Straße Œuvre S.A.R.L.", "opposite Park Road, next to Mall, Madras"),
    (7, "", ""),
    (8, None, None),
    (9, "The House of the Rising Sun Inc Ltd", "Rue de la Paix 75002, Paris, Paris"),
]
HOT = 20  # rows a side may have of a key in these queries: the fixture is small
KEEP = 8  # candidates of an entity


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores where a small input has fewer; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def entities(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang"))
    words = F.split(F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}_]+", " ")), " ")
    rows = docs.select("doc_id", "lang", words.alias("t"))
    source = (F.col("doc_id") % 3 + 1).cast("int")
    return rows.select(
        F.concat(F.lit("S"), source, F.lit("-"), F.col("doc_id")).alias("entity_id"), source.alias("src"),
        F.array_join(F.slice("t", 1, 8), " ").alias("business_name"), F.array_join(F.slice("t", 9, 12), " ").alias("business_address"), F.col("lang").alias("country"),
    )


def linkable(spark: SparkSession, sf: str) -> DataFrame:
    """All entities in linkage form. Not kept: a query computes only the columns that it reads."""
    return N.derived(entities(spark, sf))


STAGES: dict[str, DataFrame] = {}  # what the query that is being built has written so far


def stage(name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that one query reads several times, written once for it."""
    if name not in STAGES:
        STAGES[name] = written(make(), name)
    return STAGES[name]


def sides(spark: SparkSession, sf: str, several: bool = False) -> tuple[DataFrame, DataFrame]:
    """Source and target entities; ``several``: written, for queries that read them again and again."""
    e = stage("entities", lambda: linkable(spark, sf)) if several else linkable(spark, sf)
    return e.where("entity_id like 'S1-%'"), e.where("entity_id not like 'S1-%'")


def truth(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"), "text")
    one, two = docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 <> 0").withColumnRenamed("doc_id", "other")
    pairs = one.join(two, ["h", "text"])
    return pairs.select(F.concat(F.lit("S1-"), "doc_id").alias("source1_id"), F.concat(F.lit("S"), F.col("other") % 3 + 1, F.lit("-"), "other").alias("target_id"))


def keyed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    s, t = sides(spark, sf, True)
    df = keys.token_frequency(s)
    ks = stage("source_keys", lambda: keys.key_rows(s, keys.rare_tokens(s, df, HOT), lsh=False).where("family <> 'phonetic'"))
    kt = keys.key_rows(t, keys.rare_tokens(t, df, HOT), lsh=False).where("family <> 'phonetic'")
    return ks, stage("target_keys", lambda: blocking.active_keys(kt, ks))


def pairs_of_keys(spark: SparkSession, sf: str) -> DataFrame:
    ks, kt = keyed(spark, sf)
    return blocking.pair_evidence(blocking.split_by_frequency(ks, HOT)[0], blocking.split_by_frequency(kt, HOT)[0])


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    return stage("evidence", lambda: pairs_of_keys(spark, sf))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates with word similarities as scores, which SQL can check."""
    s, t = sides(spark, sf, True)
    rows = candidates.with_fields(blocking.merge_routes(pairs_of_keys(spark, sf)), s, t)
    rows = rows.withColumn("name_score", F.round(S.word_jaccard("s_core", "t_core"), 9)).withColumn("address_score", F.round(S.word_jaccard("s_address", "t_address"), 9))
    return stage("scored", lambda: candidates.similarity(rows))


def selected(spark: SparkSession, sf: str) -> DataFrame:
    return candidates.adaptive_select(scored(spark, sf), KEEP)


def probable(spark: SparkSession, sf: str) -> DataFrame:
    """Selected candidates with similarity as probability, and labels."""
    rows = selected(spark, sf).withColumn("probability", F.round("similarity", 6))
    return rows.join(truth(spark, sf).withColumn("label", F.lit(1)), ["source1_id", "target_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def featured(spark: SparkSession, sf: str) -> DataFrame:
    rows = candidates.rank_windows(selected(spark, sf))
    rows = rows.join(truth(spark, sf).withColumn("label", F.lit(1)), ["source1_id", "target_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
    return features.feature_table(rows)


def literals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LITERALS, "id int, business_name string, business_address string")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(f)
    def build(spark: SparkSession, sf: str) -> DataFrame:
        STAGES.clear()
        return f(spark, sf)

    QUERIES[f.__name__] = build
    return build


@query
def normalize_names(spark, sf):
    return entities(spark, sf).select("entity_id", N.normalize_name("business_name").alias("name"))


@query
def normalize_addresses(spark, sf):
    return entities(spark, sf).select("entity_id", N.normalize_address("business_address").alias("address"))


@query
def normalize_literals(spark, sf):
    name = N.normalize_name("business_name")
    return literals(spark).select("id", name.alias("name"), N.core_name(name).alias("core"), N.normalize_address("business_address").alias("address"), F.array_join(N.address_numbers("business_address"), " ").alias("numbers"), N.postal_code("business_address").alias("postal"))


@query
def address_components(spark, sf):
    return literals(spark).select("id", N.address_components("business_address").alias("a")).select("id", "a.*")


@query
def preprocess_entities(spark, sf):
    return N.preprocess(entities(spark, sf)).drop("src", "business_name", "business_address")


@query
def core_sorted(spark, sf):
    e = linkable(spark, sf)
    return e.select("entity_id", "country", "core", "sorted_core", "numbers", "street", "postal")


@query
def acronyms(spark, sf):
    return linkable(spark, sf).select("entity_id", N.acronym("core").alias("acronym"))


@query
def entity_texts(spark, sf):
    return entities(spark, sf).select("entity_id", N.entity_text("business_name", "business_address", "country").alias("text"))


@query
def token_df(spark, sf):
    return keys.token_frequency(sides(spark, sf)[0])


@query
def rare_tokens(spark, sf):
    s, t = sides(spark, sf)
    return keys.rare_tokens(t, keys.token_frequency(s), HOT)


@query
def key_histogram(spark, sf):
    ks, _ = keyed(spark, sf)
    return ks.groupBy("family").agg(F.count("*").alias("n"), F.countDistinct("key").alias("distinct_keys"), F.sum("weight").alias("weight"))


@query
def minhash_bands(spark, sf):
    return sides(spark, sf)[0].select("entity_id", F.explode(keys.minhash_bands(F.col("core"))).alias("band"))


@query
def phonetic_keys(spark, sf):
    return sides(spark, sf)[0].select("entity_id", F.explode(N.tokens("core")).alias("token")).select("entity_id", "token", keys.phonetic(F.col("token")).alias("sound"))


@query
def frequency_split(spark, sf):
    ks, kt = keyed(spark, sf)
    out = None
    for side, k in (("source", ks), ("target", kt)):
        bounded, hot = blocking.split_by_frequency(k, HOT)
        part = bounded.agg(F.count("*").alias("bounded_rows"), F.countDistinct("family", "key").alias("bounded_keys")).crossJoin(F.broadcast(hot.agg(F.count("*").alias("hot_keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("hot_rows")))).withColumn("side", F.lit(side))
        out = part if out is None else out.unionByName(part)
    return out


@query
def blocking_evidence(spark, sf):
    return pairs_of_keys(spark, sf)


@query
def hot_key_rescue(spark, sf):
    s, t = sides(spark, sf, True)
    ks, kt = keyed(spark, sf)
    hot = blocking.split_by_frequency(ks, HOT)[1].unionByName(blocking.split_by_frequency(kt, HOT)[1])
    return blocking.rescue(ks, kt, hot, s, t)


@query
def multi_route_merge(spark, sf):
    one = evidence(spark, sf)
    two = one.where("support_count > 1").withColumn("evidence", F.lit(2.0)).withColumn("semantic_score", F.lit(0.5)).withColumn("semantic_rank", F.lit(3))
    return blocking.merge_routes(one, two)


@query
def low_candidates(spark, sf):
    return blocking.low_candidate_sources(sides(spark, sf, True)[0], evidence(spark, sf), 4).select("entity_id")


@query
def pair_scores(spark, sf):
    s, t = sides(spark, sf, True)
    r = candidates.with_fields(evidence(spark, sf).select("source1_id", "target_id"), s, t)
    return r.select(
        "source1_id", "target_id", F.round(S.word_jaccard("s_core", "t_core"), 6).alias("name_jaccard"), F.round(S.word_containment("s_core", "t_core"), 6).alias("name_containment"),
        S.word_overlap("s_address", "t_address").alias("address_overlap"), S.acronym_match("s_core", "t_core").alias("acronym_match"), F.round(S.number_jaccard("s_numbers", "t_numbers"), 6).alias("number_jaccard"),
        S.first_number_match("s_numbers", "t_numbers").alias("first_number_match"), F.round(S.length_ratio("s_name", "t_name"), 6).alias("name_length_ratio"), (F.col("s_country") == F.col("t_country")).alias("country_match"),
    )


@query
def trigram_cosine(spark, sf):
    s, t = sides(spark, sf, True)
    r = candidates.with_fields(evidence(spark, sf).select("source1_id", "target_id"), s, t)
    return r.select("source1_id", "target_id", F.round(S.trigram_cosine("s_name", "t_name"), 6).alias("cosine"))


@query
def fuzzy_ratios(spark, sf):
    s, t = sides(spark, sf, True)
    r = candidates.with_fields(evidence(spark, sf).select("source1_id", "target_id"), s, t)
    return r.select("source1_id", "target_id", S.ratio("s_core", "t_core").alias("ratio"), S.token_sort_ratio("s_core", "t_core").alias("sort_ratio"), S.token_set_ratio("s_core", "t_core").alias("set_ratio"), S.partial_ratio("s_core", "t_core").alias("partial_ratio"))


@query
def evidence_similarity(spark, sf):
    return scored(spark, sf).select("source1_id", "target_id", F.round("ev_norm", 6).alias("ev_norm"), F.round("similarity", 6).alias("similarity"))


@query
def adaptive_select(spark, sf):
    return selected(spark, sf).select("source1_id", "target_id", "rank")


@query
def rank_windows(spark, sf):
    return candidates.rank_windows(selected(spark, sf)).select("source1_id", "target_id", "rank", "name_rank", "address_rank", "reverse_rank", "mutual_best", F.round("rank_agreement", 6).alias("rank_agreement"))


@query
def source_bridge(spark, sf):
    r = features.source_bridge(selected(spark, sf))
    return r.select("source1_id", "target_id", *[F.round(c, 6).alias(c) for c in ("opposite_source_bridge", "same_source_competition", "bridge_gap")])


@query
def feature_means(spark, sf):
    return features.feature_summary(featured(spark, sf))


@query
def truth_pairs(spark, sf):
    return truth(spark, sf)


def matched(spark, sf):
    s, t = sides(spark, sf, True)
    return candidates.with_fields(truth(spark, sf), s, t)


@query
def variation_map(spark, sf):
    return variation.variation_map(matched(spark, sf)).withColumn("prob", F.round("prob", 9))


@query
def variation_scores(spark, sf):
    rows = selected(spark, sf)
    scored_rows = variation.variation_scores(rows, variation.variation_map(matched(spark, sf)))
    return scored_rows.select("source1_id", "target_id", *[F.round(f"learned_{f}_{k}", 6).alias(f"{f}_{k}") for f in ("name", "address") for k in ("alias", "explained")])


@query
def semantic_topk(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return semantic.semantic_topk(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec")), e.select(F.col("vec_id").alias("target_id"), F.col("embedding").alias("vec")), 10).select("query_id", "target_id", F.round("score", 5).alias("score"), "rank")


@query
def semantic_cells(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return semantic.cell_topk(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec")), e.select(F.col("vec_id").alias("target_id"), F.col("embedding").alias("vec")), 10)


@query
def retrieval_recall(spark, sf):
    return metrics.retrieval_recall(sides(spark, sf, True)[0], truth(spark, sf), evidence(spark, sf))


@query
def country_diagnostics(spark, sf):
    return metrics.country_diagnostics(sides(spark, sf, True)[0], truth(spark, sf), evidence(spark, sf))


@query
def candidate_stats(spark, sf):
    return metrics.candidate_distribution(sides(spark, sf, True)[0], evidence(spark, sf))


def predicted(spark, sf):
    return probable(spark, sf).where("probability >= 0.5")


@query
def macro_f05(spark, sf):
    return metrics.macro_f05(metrics.entity_counts(sides(spark, sf, True)[0], truth(spark, sf), predicted(spark, sf)), "country")


@query
def precision_recall(spark, sf):
    return metrics.precision_recall(metrics.entity_counts(sides(spark, sf, True)[0], truth(spark, sf), predicted(spark, sf)))


@query
def threshold_sweep(spark, sf):
    return metrics.threshold_sweep(probable(spark, sf), truth(spark, sf), sides(spark, sf, True)[0])


POLICY = decision.Policy(0.6, 0.45, 0.05, 0.04, 3, 0.3)


@query
def decision_policy(spark, sf):
    return decision.apply_policy(probable(spark, sf).select("source1_id", "target_id", "probability", "name_score", "address_score"), POLICY).select("source1_id", "target_id")


@query
def country_policies(spark, sf):
    rows = probable(spark, sf).select("source1_id", "target_id", "probability", "name_score", "address_score", F.col("s_country").alias("country"))
    by = {"en": decision.Policy.hysteresis(0.7), "fr": decision.Policy.hysteresis(0.5)}
    return decision.apply_policy(decision.policies_by_country(rows, by, decision.Policy.hysteresis(0.9))).select("source1_id", "target_id")


@query
def submission_rows(spark, sf):
    rows = probable(spark, sf)
    return tables.match_rows(sides(spark, sf, True)[0], rows.select("source1_id", "target_id", "rank"), rows.where("probability >= 0.5").select("source1_id", "target_id", "probability"))


@query
def threshold_rows(spark, sf):
    return tables.rows_by_threshold(sides(spark, sf, True)[0], probable(spark, sf), 0.5)


@query
def validator_findings(spark, sf):
    bad = spark.createDataFrame([("S1-0", "S2-1,S2-1,S1-0"), ("S1-3", "S9-1,S3-2"), ("S1-3", ""), ("S1-999999999", "S2-1"), ("S1-6", "S2-777777777,none")], "source1_id string, matched_entity_ids string")
    return tables.findings(bad, *sides(spark, sf))


@query
def country_top2(spark, sf):
    return splits.countries_by_size(sides(spark, sf)[0])


@query
def stratified_split(spark, sf):
    return splits.stratified_split(sides(spark, sf, True)[0], truth(spark, sf)).select("entity_id", "stratum", "valid")


@query
def bounded_sample(spark, sf):
    return splits.bounded_sample(probable(spark, sf), 600)[0].select("source1_id", "target_id", "label")


def _scores(spark, sf, kind):
    rows = stage("features", lambda: featured(spark, sf))
    model = models.fit(rows, models.ModelSpec(kind, kind, rounds=10, depth=3))
    return model.predict(rows).select("source1_id", "target_id", "label", F.round("probability", 6).alias("probability"))


@query
def gbt_scores(spark, sf):
    return _scores(spark, sf, "gbt")


@query
def logistic_scores(spark, sf):
    return _scores(spark, sf, "linear")


@query
def ensemble_scores(spark, sf):
    return _scores(spark, sf, "ensemble")


@query
def composite_texts(spark, sf):
    return entities(spark, sf).select("entity_id", N.composite_text("business_name", "business_address").alias("text"))


@query
def candidate_summary(spark, sf):
    rows = evidence(spark, sf)
    out = None
    for name, where in (("all", "true"), ("exact", "exact_evidence > 0"), ("structural", "structural_evidence > 0"), ("none", "evidence < 0")):
        one = metrics.candidate_summary(rows, where).withColumn("which", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query
def max_id_bytes(spark, sf):
    return tables.max_id_bytes(entities(spark, sf))


@query
def update_probabilities(spark, sf):
    rows = probable(spark, sf).select("source1_id", "target_id", "rank", "probability")
    new = rows.where("rank = 1").select("source1_id", "target_id", (1 - F.col("probability")).alias("probability"))
    return decision.update_probabilities(rows, new).select("source1_id", "target_id", F.round("probability", 6).alias("probability"))
