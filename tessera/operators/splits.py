"""Training and validation slices, and bounded training samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stratified_split(sources: DataFrame, truth: DataFrame, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds valid: about ``fraction`` of the entities with 0, 1, 2 and 3 or more matches each, in a seeded order; at least one
    and not all of a stratum that has several."""
    n = truth.groupBy("source1_id").agg(F.count("*").alias("k")).withColumnRenamed("source1_id", "entity_id")
    rows = sources.join(n, "entity_id", "left").withColumn("stratum", F.least(F.coalesce("k", F.lit(0)), F.lit(3))).drop("k")
    size = rows.groupBy("stratum").agg(F.count("*").alias("n"))
    want = F.when(F.col("n") > 1, F.greatest(F.lit(1), F.least(F.col("n") - 1, F.rint(F.col("n") * fraction)))).otherwise(1 if fraction >= 0.5 else 0)
    turn = F.md5(F.concat(F.lit(f"{seed}:"), "entity_id"))
    # a rank in each stratum: by hash bucket first, so that no stratum is ordered in one task
    rows = rows.withColumn("turn", turn).withColumn("bucket", F.substring("turn", 1, 3))
    buckets = rows.groupBy("stratum", "bucket").agg(F.count("*").alias("b"))
    before = F.sum("b").over(Window.partitionBy("stratum").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("b")
    rows = rows.join(buckets.select("stratum", "bucket", before.alias("before")), ["stratum", "bucket"]).join(size.select("stratum", want.alias("want")), "stratum")
    rank = F.col("before") + F.row_number().over(Window.partitionBy("stratum", "bucket").orderBy("turn", "entity_id"))
    return rows.withColumn("valid", rank <= F.col("want")).drop("turn", "bucket", "before", "want")


def countries_by_size(sources: DataFrame, top: int = 2) -> DataFrame:
    """The ``top`` countries with most source entities, and how many; ties by name."""
    return sources.where("country <> ''").groupBy("country").agg(F.count("*").alias("entities")).orderBy(F.desc("entities"), "country").limit(top)


def country_holdout(sources: DataFrame, train: str | None = None, valid: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Entities of one country to train on and of another to validate; by default the two largest."""
    ranked = [r["country"] for r in countries_by_size(sources, 4).collect()]
    if sources.where("country <> ''").select("country").distinct().limit(2).count() < 2:
        raise ValueError("a country holdout needs source entities of two countries or more")
    train = (train or "").strip().lower() or next(c for c in ranked if c != (valid or "").strip().lower())
    valid = (valid or "").strip().lower() or next(c for c in ranked if c != train)
    return sources.where(F.col("country") == train), sources.where(F.col("country") == valid)


def bounded_sample(rows: DataFrame, most: int = 2_000_000, first: int = 8, last: int = 512, doublings: int = 16) -> tuple[DataFrame, int]:
    """All rows if they are ``most`` or fewer; else all positives, and of the hard negatives one in ``mod``. With the mod
    (1: all rows, 0: positives alone reach the bound).

    Hard: first rank, exact evidence, similarity 0.82 or semantic score 0.85. The mod doubles until the rows fit; counts by residue
    of the largest mod decide that in one pass."""
    spread = F.col("rank") * 37 + F.length("source1_id") * 11 + F.length("target_id") * 13
    positive = F.col("label") == 1
    hard = (F.col("rank") == 1) | (F.col("exact_evidence") > 0) | (F.col("similarity") >= 0.82) | (F.col("semantic_score") >= 0.85)
    largest = last * 2**doublings
    kind = F.when(positive, "positive").when(hard, "hard").otherwise("easy")
    counts = {(r[0], r[1]): r[2] for r in rows.groupBy(kind.alias("k"), F.when(~positive & hard, spread % largest).alias("m")).agg(F.count("*")).collect()}
    positives = sum(n for (k, _), n in counts.items() if k == "positive")
    if sum(counts.values()) <= most:
        return rows, 1
    if positives >= most:
        return rows.where(positive), 0
    mod = first
    while positives + sum(n for (k, m), n in counts.items() if k == "hard" and m % mod == 0) > most and mod < largest:
        mod *= 2
    return rows.where(positive | (hard & (spread % mod == 0))), mod
