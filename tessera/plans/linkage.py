"""The linkage pipeline: candidates, features, models, thresholds, and its command line."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.normalize import derived
from tessera.operators import blocking, candidates, decision, features, keys, metrics, models, semantic, splits, variation
from tessera.plans.keep import written
from tessera.sources import tables


@dataclass
class Config:
    top_k: int = candidates.TOP_K
    token_limit: int = keys.TOKEN_DF_LIMIT
    key_limit: int = keys.KEY_LIMIT
    lsh: bool = True
    trigger: int = 24
    most_rows: int = 2_000_000
    seed: int = 42
    vectors: tuple[DataFrame, DataFrame] | None = field(default=None, repr=False)  # (entity_id, vec) of sources and of targets
    scratch: str | None = None  # where stages are written, under fixed names; else in the session's shared folder


@dataclass
class Store:
    """What one data set's stages give."""

    sources: DataFrame
    targets: DataFrame
    raw: DataFrame
    final: DataFrame
    truth: DataFrame | None = None


def kept(df: DataFrame, config: Config, name: str) -> DataFrame:
    return written(df, name, config.scratch)


def candidate_routes(sources: DataFrame, targets: DataFrame, config: Config, name: str = "train") -> DataFrame:
    """Raw candidates: blocking keys, rescue within hot keys, and vectors where lexical candidates are few."""
    frequency = keys.token_frequency(sources)
    source_keys = kept(keys.key_rows(sources, keys.rare_tokens(sources, frequency, config.token_limit), config.lsh), config, f"{name}_source_keys")
    target_keys = keys.key_rows(targets, keys.rare_tokens(targets, frequency, config.token_limit), config.lsh)
    target_keys = kept(blocking.active_keys(target_keys, source_keys), config, f"{name}_target_keys")
    bounded_s, hot_s = blocking.split_by_frequency(source_keys, config.key_limit)
    bounded_t, hot_t = blocking.split_by_frequency(target_keys, config.key_limit)
    hot = hot_s.select(*blocking.BY).unionByName(hot_t.select(*blocking.BY)).distinct()
    routes = [blocking.pair_evidence(bounded_s, bounded_t), blocking.rescue(source_keys, target_keys, hot, sources, targets)]
    raw = blocking.merge_routes(*routes)
    if config.vectors:
        few = blocking.low_candidate_sources(sources, raw, config.trigger)
        q = config.vectors[0].join(few.select("entity_id"), "entity_id").select(F.col("entity_id").alias("query_id"), "vec")
        found = semantic.semantic_topk(q, config.vectors[1].withColumnRenamed("entity_id", "target_id"), max(48, min(64, config.top_k)))
        raw = blocking.merge_routes(raw, semantic.semantic_route(found))
    return raw


def finalize(raw: DataFrame, sources: DataFrame, targets: DataFrame, config: Config) -> DataFrame:
    """Final candidates with fields, scores, ranks and reciprocal ranks."""
    rows = candidates.with_fields(raw, sources, targets)
    rows = candidates.similarity(candidates.similarity_parts(candidates.shortlist(rows, config.top_k)))
    return candidates.rank_windows(candidates.adaptive_select(rows, config.top_k))


def build_store(sources: DataFrame, targets: DataFrame, truth: DataFrame | None = None, config: Config | None = None, name: str = "train") -> Store:
    config = config or Config()
    s = kept(derived(tables.require_unique(sources)), config, f"{name}_sources")
    t = kept(derived(tables.unique_targets(targets)), config, f"{name}_targets")
    raw = kept(candidate_routes(s, t, config, name), config, f"{name}_raw")
    final = kept(finalize(raw, s, t, config), config, f"{name}_final")
    return Store(s, t, raw, final, truth)


def labelled(store: Store, config: Config, table: DataFrame | None = None, name: str = "train") -> DataFrame:
    """The feature table with label (0 without truth), bounded for training, learned variation added where ``table`` is given."""
    rows = store.final
    if store.truth is not None:
        rows = rows.join(store.truth.withColumn("label", F.lit(1)), ["source1_id", "target_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
    else:
        rows = rows.withColumn("label", F.lit(0))
    if table is not None:
        rows = variation.variation_scores(rows, table)
    return kept(features.feature_table(rows), config, f"{name}_features")


def variation_table(store: Store, where: str = "split <> 0") -> DataFrame:
    s = store.sources.where(where).select(F.col("entity_id").alias("source1_id"), F.col("core").alias("s_core"), F.col("address").alias("s_address"))
    t = store.targets.select(F.col("entity_id").alias("target_id"), F.col("core").alias("t_core"), F.col("address").alias("t_address"))
    return variation.variation_map(store.truth.join(s, "source1_id").join(t, "target_id"))


def evaluate(store: Store, scored: DataFrame, sources: DataFrame, threshold: float = 0.5) -> dict:
    truth = store.truth.join(sources.select(F.col("entity_id").alias("source1_id")), "source1_id", "left_semi")
    counts = metrics.entity_counts(sources, truth, scored.where(F.col("probability") >= threshold))
    f = metrics.macro_f05(counts).first()
    p = metrics.precision_recall(counts).first()
    return {"entities": f["entities"], "macro_f05": f["macro_f05"], "precision": p["precision"], "recall": p["recall"]}


def slices(store: Store, config: Config) -> dict[str, tuple[DataFrame, DataFrame]]:
    """(fit, valid) source entities: by id, and by country both ways where there are two."""
    s = store.sources
    out = {"ids": (s.where("split <> 0"), s.where("split = 0"))}
    top = [r["country"] for r in splits.countries_by_size(s).collect()]
    if len(top) == 2:
        out["country"] = splits.country_holdout(s, *top)
        out["reverse"] = splits.country_holdout(s, *top[::-1])
    return out


def fit_slice(rows: DataFrame, sources: DataFrame, spec: models.ModelSpec, config: Config) -> models.PairModel:
    mine = rows.join(sources.select(F.col("entity_id").alias("source1_id")), "source1_id", "left_semi")
    sample, _ = splits.bounded_sample(mine, config.most_rows)
    return models.fit(sample, spec, config.seed)


def validate(store: Store, config: Config) -> dict:
    """Baseline report: retrieval, candidates, and the base model at 0.5 on each slice."""
    rows = labelled(store, config, name="validate")
    report = {"retrieval": metrics.retrieval_recall(store.sources, store.truth, store.final).first().asDict(), "candidates": metrics.candidate_distribution(store.sources, store.final).first().asDict()}
    report["countries"] = [r.asDict() for r in metrics.country_diagnostics(store.sources, store.truth, store.final).orderBy("country").limit(1000).collect()]
    report["slices"] = {}
    for name, (fit, valid) in slices(store, config).items():
        model = fit_slice(rows, fit, models.ModelSpec(), config)
        mine = rows.join(valid.select(F.col("entity_id").alias("source1_id")), "source1_id", "left_semi")
        report["slices"][name] = evaluate(store, model.predict(mine), valid)
    return report


def tune(store: Store, config: Config, grid: list[models.ModelSpec] | None = None) -> dict:
    """Tries the grid on the id slice, the best three on all slices; gives the spec, its thresholds by country and all figures."""
    parts = slices(store, config)
    plain = labelled(store, config, name="tune")
    varied = labelled(store, config, variation_table(store), name="tune_variation")
    n, pos = plain.agg(F.count("*"), F.sum("label")).first()
    grid = grid or models.specs((n - (pos or 0)) / max(pos or 0, 1))

    def score(spec: models.ModelSpec, name: str) -> tuple[float, float]:
        fit, valid = parts[name]
        rows = varied if spec.variation else plain
        mine = rows.join(valid.select(F.col("entity_id").alias("source1_id")), "source1_id", "left_semi")
        truth = store.truth.join(valid.select(F.col("entity_id").alias("source1_id")), "source1_id", "left_semi")
        best = metrics.threshold_sweep(fit_slice(rows, fit, spec, config).predict(mine), truth, valid).first()
        return best["macro_f05"], best["threshold"]

    results = {s.name: {"ids": score(s, "ids")} for s in grid}
    for s in sorted(grid, key=lambda s: (-results[s.name]["ids"][0], s.name))[:3]:
        for name in parts:
            if name != "ids":
                results[s.name][name] = score(s, name)
    done = [s for s in grid if len(results[s.name]) == len(parts)]
    chosen = min(done, key=lambda s: (-sum(v[0] for v in results[s.name].values()) / len(parts), s.name))
    found = results[chosen.name]
    unseen = found.get("reverse", found["ids"])[1]
    thresholds = {}
    if "country" in found:
        top = [r["country"] for r in splits.countries_by_size(store.sources).collect()]
        thresholds = {top[0]: found["reverse"][1], top[1]: found["country"][1]}
    return {"spec": chosen.__dict__, "thresholds": thresholds, "unseen": unseen, "results": {k: {n: list(v) for n, v in r.items()} for k, r in results.items()}}


def predict(train: Store, test: Store, policy: dict, config: Config) -> DataFrame:
    """Match rows of the test entities (see ``match_rows``) by the tuned model and each country's policy."""
    spec = models.ModelSpec(**policy["spec"])
    table = variation_table(train, "true") if spec.variation else None
    rows, _ = splits.bounded_sample(labelled(train, config, table, "fit"), config.most_rows)
    model = models.fit(rows, spec, config.seed)
    scored = model.predict(labelled(test, config, table, "test"))
    by_country = {c: decision.Policy.hysteresis(t) for c, t in policy["thresholds"].items()}
    rows = decision.policies_by_country(scored.withColumn("country", F.col("s_country")), by_country, decision.Policy.hysteresis(policy["unseen"]))
    accepted = decision.apply_policy(rows)
    return tables.match_rows(test.sources, test.final.select("source1_id", "target_id", "rank"), accepted)


def sweep_top_k(store: Store, sizes: list[int], config: Config) -> list[dict]:
    """Retrieval recall and mean candidates for several caps."""
    out = []
    for k in sizes:
        c = Config(**{**config.__dict__, "top_k": k})
        final = finalize(store.raw, store.sources, store.targets, c)
        r = metrics.retrieval_recall(store.sources, store.truth, final).first().asDict()
        out.append({"top_k": k, **r})
    return out


def sweep_bands(store: Store, shapes: list[tuple[int, int]]) -> list[dict]:
    """Retrieval recall and candidates of MinHash keys of the core alone, for several (bands, rows)."""
    out = []
    for bands, rows in shapes:
        found = [e.select(F.col("entity_id").alias(i), F.explode(keys.minhash_bands(F.col("core"), bands, rows)).alias("band")) for e, i in ((store.sources, "source1_id"), (store.targets, "target_id"))]
        hot = [x.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > keys.KEY_LIMIT) for x in found]
        s, t = (x.join(h, "band", "left_anti") for x, h in zip(found, hot))
        pairs = s.join(t, "band").select("source1_id", "target_id").distinct()
        r = metrics.retrieval_recall(store.sources, store.truth, pairs).first().asDict()
        out.append({"bands": bands, "rows": rows, "pairs": metrics.candidate_summary(pairs).first()["pairs"], **r})
    return out


def load(spark: SparkSession, folder: str, split: str, config: Config) -> Store:
    for source in (1, 2, 3):
        tables.check_header(spark, tables.entity_path(folder, split, source), tables.ENTITY)
    truth = tables.read_truth(spark, tables.truth_path(folder)) if split == "train" else None
    return build_store(tables.read_entities(spark, tables.entity_path(folder, split, 1)), tables.read_targets(spark, folder, split), truth, config, split)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Link business records of several sources.")
    parser.add_argument("--mode", choices=("validate", "tune", "predict"), required=True)
    parser.add_argument("--train_dir", required=True, nargs="+", help="the first of these folders that has the files")
    parser.add_argument("--test_dir", nargs="+")
    parser.add_argument("--output_dir", required=True)
    parser.add_argument("--top_k", type=int, default=candidates.TOP_K)
    parser.add_argument("--seed", type=int, default=42)
    parser.add_argument("--scratch_dir")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    config = Config(top_k=args.top_k, seed=args.seed, scratch=args.scratch_dir)
    train = load(spark, tables.find_dataset(spark, args.train_dir, "train"), "train", config)
    if args.mode == "validate":
        tables.write_json(spark, f"{args.output_dir}/validation_report.json", validate(train, config))
    elif args.mode == "tune":
        tables.write_json(spark, f"{args.output_dir}/tuned_policy.json", tune(train, config))
    else:
        folder = tables.find_dataset(spark, args.test_dir or args.train_dir, "test")
        test = load(spark, folder, "test", config)
        rows = predict(train, test, tables.read_json(spark, f"{args.output_dir}/tuned_policy.json"), config)
        rows = kept(rows, config, "test_matches")
        bad = tables.findings(rows, test.sources, test.targets).limit(20).collect()
        if bad:
            raise tables.BadTable(f"{len(bad)} findings or more, first: {bad[0]}")
        order = tables.source_order(spark, tables.entity_path(folder, "test", 1))
        tables.write_submission(rows, order, f"{args.output_dir}/submission")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
