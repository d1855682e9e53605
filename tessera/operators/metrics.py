"""Macro F0.5, recall of retrieval, diagnostics by country and the exact threshold sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


PARTS = 4096  # of the range of probabilities in a threshold sweep


def f05(tp: Column, predicted: Column, truth: Column) -> Column:
    """F0.5 of one entity's set. No truth: 1 for an empty prediction, else 0."""
    p, r = tp / predicted, tp / truth
    return F.when(truth == 0, F.when(predicted == 0, 1.0).otherwise(0.0)).when((predicted == 0) | (tp == 0), 0.0).otherwise(1.25 * p * r / (0.25 * p + r))


def truth_counts(truth: DataFrame) -> DataFrame:
    return truth.groupBy("source1_id").agg(F.count("*").alias("truth"))


def entity_counts(sources: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row per source entity: source1_id, country, truth, predicted, tp."""
    hits = predicted.select("source1_id", "target_id").distinct().join(truth.withColumn("hit", F.lit(1)), ["source1_id", "target_id"], "left")
    mine = hits.groupBy("source1_id").agg(F.count("*").alias("predicted"), F.count("hit").alias("tp"))
    rows = sources.select(F.col("entity_id").alias("source1_id"), "country").join(truth_counts(truth), "source1_id", "left").join(mine, "source1_id", "left")
    return rows.select("source1_id", "country", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("truth", "predicted", "tp")])


def macro_f05(counts: DataFrame, *by: str) -> DataFrame:
    """entities and macro_f05, over all or by the named columns."""
    return counts.groupBy(*by).agg(F.count("*").alias("entities"), F.round(F.avg(f05(F.col("tp"), F.col("predicted"), F.col("truth"))), 9).alias("macro_f05"))


def precision_recall(counts: DataFrame) -> DataFrame:
    """Pair precision and recall; recall counts all truth pairs of the slice."""
    sums = counts.agg(*[F.sum(c).alias(c) for c in ("tp", "predicted", "truth")])
    return sums.select("tp", "predicted", "truth", *[F.round(F.when(F.col(d) > 0, F.col("tp") / F.col(d)).otherwise(0.0), 9).alias(n) for n, d in (("precision", "predicted"), ("recall", "truth"))])


def retrieval_recall(sources: DataFrame, truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """Over source entities with truth: pair recall, share whose targets are all candidates, share without any."""
    c = entity_counts(sources, truth, candidates).where("truth > 0")
    return c.agg(
        F.count("*").alias("entities"), F.sum("truth").alias("pairs"), F.round(F.sum("tp") / F.sum("truth"), 9).alias("pair_recall"),
        F.round(F.avg((F.col("tp") == F.col("truth")).cast("double")), 9).alias("complete_recall"), F.round(F.avg((F.col("tp") == 0).cast("double")), 9).alias("zero_hit_rate"),
    )


def country_diagnostics(sources: DataFrame, truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """Six figures for each country; an empty one is <missing>."""
    c = entity_counts(sources, truth, candidates).withColumn("country", F.coalesce(F.nullif(F.col("country"), F.lit("")), F.lit("<missing>")))
    some = F.col("truth") > 0
    return c.groupBy("country").agg(
        F.count("*").alias("entities"), F.sum("truth").alias("truth_pairs"), F.sum("tp").alias("hit_pairs"),
        F.round(F.sum("tp") / F.nullif(F.sum("truth"), F.lit(0)), 9).alias("pair_recall"),
        F.round(F.avg(F.when(some, (F.col("tp") == F.col("truth")).cast("double"))), 9).alias("complete_recall"),
        F.round(F.avg("predicted"), 9).alias("avg_candidates"),
    )


def candidate_distribution(sources: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates per source entity, none included: total, avg, max, and the values at n//2, 95% and 99% of the sorted counts.

    Counts are summed by value first, so the running total is over distinct counts only.
    """
    n = candidates.groupBy("source1_id").agg(F.count("*").alias("n"))
    each = sources.select(F.col("entity_id").alias("source1_id")).join(n, "source1_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    values = each.groupBy("n").agg(F.count("*").alias("k"))
    run = values.withColumn("upto", F.sum("k").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("k").over(Window.partitionBy()))

    def at(place: Column) -> Column:
        return F.min(F.when(F.col("upto") > place, F.col("n")))

    share = [(name, F.least(F.col("all") - 1, F.floor(F.col("all") * q))) for name, q in (("p95", 0.95), ("p99", 0.99))]
    return run.agg(
        F.max("all").alias("entities"), F.sum(F.col("n") * F.col("k")).alias("total"), F.round(F.sum(F.col("n") * F.col("k")) / F.sum("k"), 9).alias("avg"),
        at(F.floor(F.col("all") / 2)).alias("median"), F.max("n").alias("max"), *[at(p).alias(name) for name, p in share],
    )


def candidate_summary(candidates: DataFrame, predicate: str = "true") -> DataFrame:
    """pairs, entities and avg: candidates that fulfil an SQL predicate, and how many an entity that has any has of them."""
    n = candidates.where(predicate).groupBy("source1_id").agg(F.count("*").alias("n"))
    return n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.count("*").alias("entities"), F.round(F.coalesce(F.avg("n"), F.lit(0.0)), 9).alias("avg"))


def threshold_sweep(scored: DataFrame, truth: DataFrame, sources: DataFrame | None = None, top: int | None = 1) -> DataFrame:
    """threshold, macro_f05: the threshold over (source1_id, probability, label) that gives the best macro F0.5, the higher of
    equals; just above 1 is the empty prediction. ``sources`` sets the population, else it is the entities with candidates.

    Within an entity each distinct probability changes its score; the changes are summed by probability, and a running sum over
    distinct probabilities gives the objective at every threshold. The running sum is taken in parts of equal width of the probabilities,
    each of which starts with the sum of those above it, so no task sorts them all.
    """
    p = scored.select("source1_id", F.col("probability").cast("double").alias("p"), F.col("label").cast("int").alias("y"))
    steps = p.groupBy("source1_id", "p").agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    by = Window.partitionBy("source1_id").orderBy(F.desc("p"))
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.select("source1_id", "p", F.sum("n").over(upto).alias("pred"), F.sum("y").over(upto).alias("tp"))
    everyone = (sources.select(F.col("entity_id").alias("source1_id")) if sources is not None else scored.select("source1_id")).distinct()
    base = everyone.join(truth_counts(truth), "source1_id", "left").select("source1_id", F.coalesce("truth", F.lit(0)).alias("truth"))
    steps = steps.join(base, "source1_id").withColumn("s", f05(F.col("tp"), F.col("pred"), F.col("truth")))
    empty = F.when(F.col("truth") == 0, 1.0).otherwise(0.0)
    change = steps.withColumn("d", F.col("s") - F.coalesce(F.lag("s").over(by), empty)).groupBy("p").agg(F.sum("d").alias("d"))
    start = base.agg(F.lit(1.000001).alias("p"), F.sum(empty).alias("d"))
    population = base.agg(F.count("*").alias("k"))
    change = change.unionByName(start).withColumn("part", F.least(F.lit(PARTS), F.greatest(F.lit(0), F.floor(F.col("p") * PARTS))).cast("int"))
    parts = change.groupBy("part").agg(F.sum("d").alias("s"))
    above = parts.select("part", (F.sum("s").over(Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, 0)) - F.col("s")).alias("above"))
    curve = change.join(F.broadcast(above), "part").crossJoin(F.broadcast(population))  # PARTS + 1 rows, one row
    within = F.sum("d").over(Window.partitionBy("part").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0))
    curve = curve.withColumn("m", F.round((F.col("above") + within) / F.col("k"), 9))
    out = curve.select(F.col("p").alias("threshold"), F.col("m").alias("macro_f05"))
    return out.orderBy(F.desc("macro_f05"), F.desc("threshold")).limit(top) if top else out
