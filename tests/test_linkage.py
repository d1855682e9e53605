"""Linkage operators on small literal tables."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import normalize as N
from tessera.functions import similarity as S
from tessera.operators import blocking, candidates, decision, features, keys, metrics, models, semantic, splits
from tessera.plans import linkage
from tessera.sources import tables


def value(spark, expr, text):
    return spark.createDataFrame([(text,)], "c string").select(expr("c").alias("v")).first()["v"]


@pytest.mark.parametrize(
    "expr,text,want",
    [
        (N.normalize_name, "Acme Corporation", "acme corp"),
        (N.normalize_name, "Société Anonyme Paris", "sa paris"),
        (N.normalize_name, "acme private limited", "acme pvt limited"),
        (N.normalize_name, None, ""),
        (N.normalize_address, "Résidence, Boulevard des Lilas", "res bd des lilas"),
        (N.normalize_address, "5 Bombay Avenue", "5 mumbai av"),
        (N.normalize_address, "near opposite 12 Main Street", "12 main st"),
        (N.postal_code, "x 1234567 75002", "75002"),
        (lambda c: F.array_join(N.address_numbers(c), " "), "12 Main St Suite 400 221B x9", "12 400 221b"),
        (N.acronym, "bank of new york", "bny"),
        (N.acronym, "bank", ""),
        (lambda c: N.core_name(N.normalize_name(c)), "Acme Bakery LLC", "acme bakery"),
    ],
)
def test_normalisation(spark, expr, text, want):
    assert value(spark, expr, text) == want


def test_address_components(spark):
    got = value(spark, N.address_components, "12 Main Street Suite 400, Springfield 62704")
    assert tuple(got) == ("12 main st suite 400 springfield 62704", "12", "main st suite 400", "springfield", "62704")
    assert tuple(value(spark, N.address_components, None)) == ("", "", "", "", "")


def test_lcs_matches_dynamic_programming():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 9))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            before = row[:]
            for j, y in enumerate(b):
                row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
        assert S.lcs(a, b) == row[-1]
    assert S.indel("", "") == 1 and S.token_set("", "a") == 0 and S.token_set("a b", "b a c") == 1 and S.partial("abc", "xxabcx") == 1
    assert S.token_sort("b a", "a b") == 1


def test_minhash_matches_integers(spark):
    import zlib

    text = "acme bakery"
    padded = f"  {text}  "
    hashes = {zlib.crc32(padded[k : k + 3].encode()) for k in range(len(padded) - 2)}
    want = [min((h * a + b) % keys.PRIME for h in hashes) for a, b in zip(keys.FACTORS, keys.SHIFTS)]
    got = value(spark, lambda c: keys.minhash_bands(F.col(c)), text)
    assert got == [f"{k}:{want[2 * k]}:{want[2 * k + 1]}" for k in range(16)]


ROWS = "entity_id string, business_name string, business_address string, country string"


def records(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def test_keys_find_all_pairs(spark):
    s = N.derived(records(spark, [(f"S1-{k}", f"Acme{k} Bakery{k} LLC", f"{k} Main Street, Town{k % 3}", "us") for k in range(10)] + [("", "no id", "x", "us")])).persist()
    t = N.derived(records(spark, [(f"S2-{k}", f"ACME{k} Bakery{k}", f"{k} Main St Town{k % 3}", "us") for k in range(10)])).persist()
    truth = spark.createDataFrame([(f"S1-{k}", f"S2-{k}") for k in range(10)], "source1_id string, target_id string")
    raw = blocking.merge_routes(blocking.pair_evidence(keys.key_rows(s, lsh=False), keys.key_rows(t, lsh=False)))
    assert metrics.retrieval_recall(s, truth, raw).first()["pair_recall"] == 1.0
    assert s.count() == 10 and len(features.FEATURES) == 69


def test_frequency_split_and_rescue(spark):
    t = N.derived(records(spark, [(f"S2-{k}", f"shop {k}", "1 same road", "") for k in range(30)]))
    s = N.derived(records(spark, [("S1-1", "shop 7", "1 same road", "")]))
    ks, kt = keys.key_rows(s, lsh=False), keys.key_rows(t, lsh=False)
    bounded, hot = blocking.split_by_frequency(blocking.active_keys(kt, ks), 10)
    assert {(r.family, r.n) for r in hot.collect()} >= {("address", 30)}
    got = blocking.rescue(ks, kt, hot, s, t, top=3).orderBy(F.desc("evidence")).first()
    assert got.target_id == "S2-7" and got.exact_evidence > 0


def test_policy_margin_and_singletons(spark):
    rows = spark.createDataFrame([("a", "S2-1", 0.95, 0.0, 0.0), ("a", "S2-2", 0.82, 0.0, 0.0), ("b", "S3-1", 0.1, 0.0, 0.0)], "source1_id string, target_id string, probability double, name_score double, address_score double")
    got = decision.apply_policy(rows, decision.Policy(0.8, 0.75, 0.05, 0.05)).collect()
    assert [(r.source1_id, r.target_id) for r in got] == [("a", "S2-1")]
    assert decision.Policy.from_dict(decision.Policy.hysteresis(0.6).to_dict()) == decision.Policy.hysteresis(0.6)


def test_f05(spark):
    rows = spark.createDataFrame([(1, 1, 1, 1.0), (0, 0, 0, 1.0), (0, 1, 0, 0.0), (0, 0, 2, 0.0), (1, 2, 1, 0.5555556)], "tp int, p int, t int, want double")
    for r in rows.select(metrics.f05(F.col("tp"), F.col("p"), F.col("t")).alias("f"), "want").collect():
        assert abs(r.f - r.want) < 1e-6


def test_bounded_sample_and_holdout(spark):
    rows = spark.range(4000).select(F.concat(F.lit("S1-"), F.col("id") % 50).alias("source1_id"), F.concat(F.lit("S2-"), "id").alias("target_id"), (F.col("id") % 40 + 1).alias("rank"), F.lit(1.0).alias("exact_evidence"), F.lit(0.1).alias("similarity"), F.lit(0.0).alias("semantic_score"), (F.col("id") % 100 == 0).cast("int").alias("label"))
    got, mod = splits.bounded_sample(rows, 1000)
    assert got.count() <= 1000 and got.where("label = 1").count() == 40 and mod > 1
    with pytest.raises(ValueError):
        splits.country_holdout(spark.createDataFrame([("a", "us")], "entity_id string, country string"))


def test_topk_is_exact(spark):
    import numpy as np

    v = np.random.default_rng(1).normal(size=(60, 5))
    df = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(v)] + [(99, None)], "target_id long, vec array<double>").repartition(4)
    got = {(r.query_id, r.rank): r.target_id for r in semantic.semantic_topk(df.where("target_id % 10 = 0").withColumnRenamed("target_id", "query_id"), df, 3).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(0, 60, 10):
        assert [got[q, k] for k in (1, 2, 3)] == np.argsort(-(u @ u[q]))[:3].tolist()


def test_tables(spark, tmp_path):
    path = tmp_path / "x.tsv"
    path.write_text('﻿entity_id\tbusiness_name\tbusiness_address\tcountry\textra\nS1-1\t"a ""b""\tc"\t" two\nlines "\t\tz\n', encoding="utf-8")
    assert [tuple(r) for r in tables.read_entities(spark, str(path)).collect()] == [("S1-1", 'a "b"\tc', "two\nlines", "")]
    path.write_text("version https://git-lfs.github.com/spec/v1\noid x\n")
    with pytest.raises(tables.BadTable):
        tables.read_entities(spark, str(path))
    pairs = tables.truth_pairs(spark.createDataFrame([("S1-1", " S2-1 ,S2-1,,S3-2"), ("S1-2", None)], "source1_id string, matched_entity_ids string"))
    assert sorted(map(tuple, pairs.collect())) == [("S1-1", "S2-1"), ("S1-1", "S3-2")]


def test_shortlist_keeps_budget(spark):
    rows = spark.range(100).select(F.lit("S1-1").alias("source1_id"), F.concat(F.lit("S2-"), "id").alias("target_id"), (F.col("id") * 1.0).alias("evidence"), F.lit(1).alias("support_count"), *[F.lit(0.0).alias(c) for c in ("name_evidence", "address_evidence", "structural_evidence", "exact_evidence", "semantic_score")], F.lit("a b").alias("s_core"), F.concat(F.lit("a "), "id").alias("t_core"), F.lit("").alias("s_address"), F.lit("").alias("t_address"))
    got = candidates.shortlist(rows, 4)
    assert got.count() == 32 and got.agg(F.max("evidence")).first()[0] == 99.0


def test_other_forms_of_letters(spark):
    assert value(spark, N.base_text, "ﬁne ＡＢＣ x² ⅷ ①") == "fine abc x2 viii 1"
    assert spark.range(1).select(N.composite_text(F.lit(" a "), F.lit(None).cast("string")).alias("v")).first().v == "a"


def test_address_columns_agree_with_the_expression(spark):
    texts = ["12 Main Street Suite 400, Springfield, 62704", "221B Baker Street; London", "near Old Strasse 7 | Berlin 10115", "Rue de la Paix 75002, Paris, Paris", "a, b, a", ",", "", None, "62704 62704 5"]
    d = spark.createDataFrame([(t,) for t in texts], "c string")
    rows = N.with_components(d.withColumn("x", N.address_components("c")), "c", "o").collect()
    for r in rows:
        assert tuple(r.x) == (r.o_normalized, r.o_number, r.o_street, r.o_city, r.o_postal)


FILES = {
    "source1": [("S1-3", "Acme Bakery LLC", "12 Main Street", "US"), ("S1-1", "Blue Door Inc", "5 Oak Road", "US"), ("S1-2", "Nobody Knows Ltd", "1 Far Away", "FR")],
    "source2": [("S2-1", "acme bakery", "12 main st", "us"), ("S2-2", "blue door", "5 oak rd", "us"), ("S2-3", "other shop", "77 hill road", "fr")],
    "source3": [("S3-1", "blue doors inc", "5 oak road", "us")],
}
TRUE = {"S1-3": "S2-1", "S1-1": "S2-2,S3-1", "S1-2": ""}


def dataset(folder, split, truth=True, copies=1):
    folder.mkdir(parents=True, exist_ok=True)
    other = lambda i, k: i if not k else f"{i}{k}"
    for name, rows in FILES.items():
        lines = ["entity_id\tbusiness_name\tbusiness_address\tcountry"] + ["\t".join((other(r[0], k), f"{r[1]} {'abcdefghijklmnop'[k] * 4 if k else ''}".strip(), f"{r[2]} {k or ''}".strip(), r[3])) for k in range(copies) for r in rows]
        (folder / f"{split}_{name}.tsv").write_text("\n".join(lines) + "\n")
    if truth:
        lines = ["source1_entity_id\tmatched_entity_ids"] + [f"{other(i, k)}\t{','.join(other(x, k) for x in m.split(',') if x)}" for k in range(copies) for i, m in TRUE.items()]
        (folder / f"{split}_ground_truth.tsv").write_text("\n".join(lines) + "\n")


def test_submission_in_source_order(spark, tmp_path):
    dataset(tmp_path / "data", "train")
    folder = tables.find_dataset(spark, [str(tmp_path / "none"), str(tmp_path / "data")], "train")
    order = tables.source_order(spark, tables.entity_path(folder, "train", 1))
    sources, targets = tables.read_entities(spark, tables.entity_path(folder, "train", 1)), tables.read_targets(spark, folder, "train")
    pairs = spark.createDataFrame([(0, "S1-3", "S2-1", 1), (1, "S1-1", "S3-1", 2), (2, "S1-1", "S2-2", 1)], "pair long, source1_id string, target_id string, rank int")
    p = spark.createDataFrame([(0, 0.4), (1, 0.9), (2, 0.7)], "pair long, probability double")
    rows = tables.rows_from_pairs(sources, targets, pairs, p, 0.5)
    tables.write_submission(rows, order, str(tmp_path / "out"))
    read = lambda name: [x for f in sorted((tmp_path / "out" / name).glob("part-*.csv")) for x in f.read_text().splitlines() if not x.startswith("source1_entity_id")]
    assert read("candidates") == ["S1-3\tS2-1", "S1-1\tS2-2,S3-1", "S1-2\t"]
    assert read("matches") == ["S1-3\t", "S1-1\tS3-1,S2-2", "S1-2\t"]
    for bad in (p.limit(2), p.unionByName(p.limit(1))):
        with pytest.raises(tables.BadTable):
            tables.rows_from_pairs(sources, targets, pairs, bad, 0.5)
    with pytest.raises(tables.BadTable):
        tables.find_dataset(spark, [str(tmp_path / "none")], "train")


def test_trained_on_one_data_set_and_predicted_on_another(spark, tmp_path):
    dataset(tmp_path, "train", copies=6)
    dataset(tmp_path, "test", truth=False, copies=6)
    config = linkage.Config()
    train, test = (linkage.load(spark, str(tmp_path), split, config) for split in ("train", "test"))
    assert metrics.retrieval_recall(train.sources, train.truth, train.final).first()["pair_recall"] == 1.0
    policy = {"spec": models.ModelSpec("linear", "linear").__dict__, "thresholds": {}, "unseen": 0.5}
    found = linkage.kept(linkage.predict(train, test, policy, config), config, "matches")
    assert not tables.findings(found, test.sources, test.targets).count()
    assert {r[0] for r in found.select("source1_id").collect()} == {f"{i}{k or ''}" for i in TRUE for k in range(6)}


def test_contract_findings(spark):
    order = spark.createDataFrame([(0, "S1-1"), (1, "S1-2"), (2, "S1-3")], "position long, source1_id string")
    c = spark.createDataFrame([(0, "S1-1", "S2-1,S2-2"), (1, "S1-2", ""), (2, "S1-3", "S2-1")], "position long, source1_id string, candidate_entity_ids string")
    m = spark.createDataFrame([(0, "S1-1", "S2-2"), (1, "S1-2", ""), (2, "S1-3", "")], "position long, source1_id string, matched_entity_ids string")
    assert tables.contract_findings(c, m, order).count() == 0
    bad = spark.createDataFrame([(0, "S1-2", "S2-1"), (1, "S1-1", "S2-2,S2-2"), (2, "S1-9", "S9-1")], "position long, source1_id string, matched_entity_ids string")
    got = {tuple(r) for r in tables.contract_findings(c, bad, order).collect()}
    assert {("order", "S1-2"), ("missing", "S1-3"), ("extra", "S1-9"), ("twice", "S1-1"), ("prefix", "S1-9"), ("subset", "S1-2"), ("no_candidates", "S1-2")} <= got


def test_features_are_written_with_a_manifest(spark, tmp_path):
    rows = spark.createDataFrame([("S1-1", "S2-1", 1, 0.5), ("S1-1", "S2-2", 0, 0.25)], "source1_id string, target_id string, label int, f double")
    assert tables.write_features(rows, ("f",), str(tmp_path / "m")) == {"features": ["f"], "rows": 2, "positives": 1}
    back, manifest = tables.read_features(spark, str(tmp_path / "m"))
    assert manifest["rows"] == back.count() == 2 and dict(back.dtypes) == {"source1_id": "string", "target_id": "string", "label": "tinyint", "f": "float"}


def test_pair_helpers(spark):
    rows = spark.createDataFrame([("a", "x", 0.1), ("a", "y", 0.2), ("b", "x", 0.3)], "source1_id string, target_id string, probability double")
    new = spark.createDataFrame([("a", "y", 0.9)], "source1_id string, target_id string, probability double")
    assert {(r.source1_id, r.target_id): r.probability for r in decision.update_probabilities(rows, new).collect()} == {("a", "x"): 0.1, ("a", "y"): 0.9, ("b", "x"): 0.3}
    assert decision.update_probabilities(rows.drop("probability"), new).where("probability is null").count() == 2
    assert tuple(metrics.candidate_summary(rows, "probability > 0.15").first()) == (2, 2, 1.0) and tuple(metrics.candidate_summary(rows.limit(0)).first()) == (0, 0, 0.0)
    assert tables.max_id_bytes(spark.createDataFrame([("é",), ("a",)], "entity_id string")).first().bytes == 2


def test_threshold_sweep_is_exact(spark):
    rng = random.Random(5)
    scored = [(f"S1-{i}", f"S2-{i}{k}", rng.random() if k else 0.5 + 1e-9 * i, int(rng.random() < 0.4)) for i in range(30) for k in range(4)]
    d = spark.createDataFrame(scored, "source1_id string, target_id string, probability double, label int")
    truth = d.where("label = 1").select("source1_id", "target_id")

    def score(t):
        total = 0
        for i in {r[0] for r in scored}:
            mine = [r for r in scored if r[0] == i]
            n, pred = sum(r[3] for r in mine), [r for r in mine if r[2] >= t]
            tp = sum(r[3] for r in pred)
            total += (not pred) * 1.0 if not n else 0.0 if not tp else 1.25 * tp / len(pred) * tp / n / (0.25 * tp / len(pred) + tp / n)
        return round(total / 30, 9)

    best = max(((score(t), t) for t in [1.000001, *{r[2] for r in scored}]))
    got = metrics.threshold_sweep(d, truth).first()
    assert (got.macro_f05, got.threshold) == best


def test_cells_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    q, t = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec")), e.select(F.col("vec_id").alias("target_id"), F.col("embedding").alias("vec"))
    exact, near = ({(r.query_id, r.target_id) for r in f(q, t, 10).collect()} for f in (semantic.semantic_topk, semantic.cell_topk))
    assert len(exact & near) >= 0.9 * len(exact)


def test_rescue_scores_blocks_without_rows_of_pairs(spark, monkeypatch):
    rng = random.Random(6)
    texts = ["", "acme corp", "acme corps", "a", "zeta société", "x" * 70, "x" * 69 + "y"]
    entity = lambda i: (i, rng.choice(texts), rng.choice(texts))
    sources, targets = [entity(f"S1-{k}") for k in range(40)], [entity(f"S2-{k}") for k in range(60)]
    members = {("core", "k"): (sources, targets), ("token", "k"): (sources, targets), ("prefix", "p"): (sources[:9], targets[:50]), ("full", "none"): (sources[:2], []), ("number", "1"): (sources, targets + [entity("S3-1")])}
    rows = {side: [(e[0], f, k, 1.0) for (f, k), pair in members.items() for e in pair[side]] for side in (0, 1)}
    want = {}
    for (family, key), (s, t) in members.items():
        if len(t) > 60:
            continue
        for i, name, address in s:
            n, a = ({j: S.indel(x, y[c]) for j, *y in t} for c, x in enumerate((name, address)))
            n, a = ({j: round(100 * v) / 100 for j, v in d.items()} for d in (n, a))
            kept = set()
            for d, there in ((n, name), (a, address)):
                kept |= set(sorted(d, key=lambda j: (-d[j], j))[:7]) if there else set()
            scored = []
            for j, x, y in t:
                p, q = n[j] if name and x else 0.0, a[j] if address and y else 0.0
                scored.append((-(0.55 * p + 0.45 * q if name and address else p if name else q), j))
            for v, j in [x for x in sorted(scored) if x[1] in kept and -x[0] >= blocking.RESCUE_FLOOR][:7]:
                old = want.get((i, j), (0, 0, 0, 0, 0, 0))
                now = (1 - v, 0, -v if name else 0, -v if address else 0, -v if family in keys.STRUCTURAL else 0, -v if family in keys.EXACT else 0)
                want[i, j] = tuple(max(o, x) if k != 1 else o + 1 for k, (o, x) in enumerate(zip(old, now)))
    monkeypatch.setattr(blocking, "RESCUE_SOURCES", 16, raising=False)
    ks, kt = (spark.createDataFrame(rows[k], "entity_id string, family string, key string, weight double") for k in (0, 1))
    es, et = (spark.createDataFrame(x, "entity_id string, core string, address string") for x in (sources, targets + [("S3-1", "a", "a")]))
    got = blocking.rescue(ks, kt, ks, es, et, top=7, block=60)
    assert {(r[0], r[1]): tuple(r[2:]) for r in got.collect()} == want and len(want) > 100
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "CoGroups" in plan
