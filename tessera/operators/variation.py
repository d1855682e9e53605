"""Learned word variations: which target words stand for a source word in known matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.normalize import tokens

MOST_TARGETS, LEAST_SUPPORT = 12, 2
SIDES = {"name_forward": ("s_core", "t_core"), "name_reverse": ("t_core", "s_core"), "address_forward": ("s_address", "t_address"), "address_reverse": ("t_address", "s_address")}


def long_tokens(text: str) -> F.Column:
    return F.filter(tokens(text), lambda w: F.length(w) >= 3)


def variation_map(pairs: DataFrame) -> DataFrame:
    """side, token, target, prob from matched pairs (s_core, t_core, s_address, t_address).

    Pairs of words that meet in LEAST_SUPPORT matches or more; prob is a target's share of the token's such counts, of which the
    MOST_TARGETS largest stay, ties by target."""
    out = None
    for side, (a, b) in SIDES.items():
        both = pairs.select(F.explode(long_tokens(a)).alias("token"), F.col(b)).select("token", F.explode(long_tokens(b)).alias("target"))
        n = both.groupBy("token", "target").agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "*")
        out = n if out is None else out.unionByName(n)
    by = Window.partitionBy("side", "token")
    out = out.where(F.col("n") >= LEAST_SUPPORT).withColumn("all", F.sum("n").over(by))
    out = out.withColumn("r", F.row_number().over(by.orderBy(F.desc("n"), "target"))).where(F.col("r") <= MOST_TARGETS)
    return out.select("side", "token", "target", (F.col("n") / F.col("all")).alias("prob"))


def variation_scores(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Adds learned_{name,address}_{alias,explained} to candidate rows.

    In each direction the alias score is the mean, over the left words, of the best probability among the right words; explained is the
    share of left words that have one. Both directions are averaged. The table joins by word, so it may be of any size."""
    key = ["source1_id", "target_id"]
    scored = rows.select(*key)
    for field, column in (("name", "core"), ("address", "address")):
        parts = []
        for way, (a, b) in (("forward", ("s", "t")), ("reverse", ("t", "s"))):
            left, right = f"{a}_{column}", f"{b}_{column}"
            words = F.filter(F.split(F.col(left), " "), lambda w: F.length(w) >= 3)
            n = rows.select(*key, F.size(words).alias("n"), F.posexplode(words).alias("pos", "token"), long_tokens(right).alias("right"))
            side = table.where(F.col("side") == f"{field}_{way}").select("token", "target", "prob")
            hit = n.join(side, "token").where(F.array_contains("right", F.col("target")))
            best = hit.groupBy(*key, "pos", "n").agg(F.max("prob").alias("p"))
            parts.append(best.groupBy(*key).agg((F.sum("p") / F.max("n")).alias("alias"), (F.count("*") / F.max("n")).alias("explained")))
        sums = parts[0].unionByName(parts[1]).groupBy(*key).agg((F.sum("alias") / 2).alias(f"learned_{field}_alias"), (F.sum("explained") / 2).alias(f"learned_{field}_explained"))
        scored = scored.join(sums, key, "left")
    names = [f"learned_{f}_{k}" for f in ("name", "address") for k in ("alias", "explained")]
    return rows.drop(*names).join(scored, key).withColumns({n: F.coalesce(n, F.lit(0.0)) for n in names})
