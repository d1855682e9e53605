"""Candidate pairs from blocking keys: hot keys split off, evidence summed, hot blocks rescued, routes merged."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.similarity import Texts

from .keys import ADDRESS, EXACT, KEY_LIMIT, NAME, STRUCTURAL

RESCUE_TOP, RESCUE_BLOCK, RESCUE_FLOOR = 64, 5_000, 0.20
RESCUE_SOURCES = 1_000  # source entities of a block that a task gets; all its targets go with them
BY = ["family", "key"]


def active_keys(target_keys: DataFrame, source_keys: DataFrame) -> DataFrame:
    """Target keys that some source entity has too. Frequencies are taken after this."""
    return target_keys.join(source_keys.select(*BY).distinct(), BY, "left_semi")


def split_by_frequency(keys: DataFrame, limit: int = KEY_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Keys of at most ``limit`` rows, and the hot keys (family, key, n) beyond. Counts are combined before the shuffle,
    so a key's rows never meet in one task, as they would under a window."""
    hot = keys.groupBy(*BY).agg(F.count("*").alias("n")).where(F.col("n") > limit)
    return keys.join(hot, BY, "left_anti"), hot


def pair_evidence(source_keys: DataFrame, target_keys: DataFrame) -> DataFrame:
    """source1_id, target_id, evidence (sum of weight products), support_count and the best product of each evidence kind.

    Of a bounded key at most limit x limit pairs come out; partial sums are taken before the shuffle by pair."""
    s = source_keys.select(*BY, F.col("entity_id").alias("source1_id"), F.col("weight").alias("ws"))
    t = target_keys.select(*BY, F.col("entity_id").alias("target_id"), F.col("weight").alias("wt"))
    product = F.col("ws") * F.col("wt")

    def best(families: tuple[str, ...]) -> Column:
        return F.max(F.when(F.col("family").isin(*families), product).otherwise(0.0))

    return s.join(t, BY).groupBy("source1_id", "target_id").agg(
        F.sum(product).alias("evidence"), F.count("*").alias("support_count"),
        best(NAME).alias("name_evidence"), best(ADDRESS).alias("address_evidence"),
        best(STRUCTURAL).alias("structural_evidence"), best(EXACT).alias("exact_evidence"),
    )


def best_of_block(sources: pa.Table, targets: pa.Table, top: int) -> pa.Table:
    """source1_id, target_id, score, named, addressed: what ``rescue`` keeps of one block. Equal texts are scored once."""
    text = lambda table, c: [v or "" for v in table.column(c).to_pylist()]
    ids = targets.column("target_id").to_pylist()
    order = sorted(range(len(ids)), key=ids.__getitem__)
    ids = [ids[k] for k in order]
    sides = {}
    for c in ("name", "address"):
        values = text(targets, f"t_{c}")
        distinct = {v: k for k, v in enumerate(dict.fromkeys(values))}
        sides[c] = (Texts(list(distinct)), np.array([distinct[values[k]] for k in order]), np.array([values[k] != "" for k in order]), {})
    alike: dict[tuple[str, str], list] = {}
    for i, pair in zip(sources.column("source1_id").to_pylist(), zip(text(sources, "s_name"), text(sources, "s_address"))):
        alike.setdefault(pair, []).append(i)
    out: dict[str, list] = {"source1_id": [], "target_id": [], "score": [], "named": [], "addressed": []}
    for (name, address), members in alike.items():
        part, kept = {}, []
        for c, value in (("name", name), ("address", address)):
            texts, place, there, seen = sides[c]
            if value:
                if value not in seen:
                    seen[value] = texts.ratios(value)
                found = seen[value][place]
                kept.append(np.argsort(-found, kind="stable")[:top])
                part[c] = np.where(there, found, 0.0)
        if not kept:
            continue
        at = np.unique(np.concatenate(kept))
        score = 0.55 * part["name"][at] + 0.45 * part["address"][at] if len(part) == 2 else next(iter(part.values()))[at]
        at, score = at[score >= RESCUE_FLOOR], score[score >= RESCUE_FLOOR]
        first = np.argsort(-score, kind="stable")[:top]
        best, scores = [ids[k] for k in at[first]], score[first].tolist()
        for i in members:
            out["source1_id"] += [i] * len(best)
            out["target_id"] += best
            out["score"] += scores
            out["named"] += [name != ""] * len(best)
            out["addressed"] += [address != ""] * len(best)
    kinds = (sources.schema.field("source1_id").type, targets.schema.field("target_id").type, pa.float64(), pa.bool_(), pa.bool_())
    return pa.table({c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds)})


def rescue(source_keys: DataFrame, target_keys: DataFrame, hot: DataFrame, sources: DataFrame, targets: DataFrame, top: int = RESCUE_TOP, block: int = RESCUE_BLOCK) -> DataFrame:
    """Best pairs within hot keys: per source entity and key the ``top`` targets by name and by address, scored anew.

    ``hot``: distinct (family, key) of either side. Blocks of more than ``block`` targets give none, which is what bounds a
    source entity's comparisons; they are found by counts, and larger ones never reach the join. Keys of the same entities
    on both sides (by 128 bits) are one block, worked out once and counted as many times. A block's pairs are scored where
    its entities meet, RESCUE_SOURCES source entities at a time, and only the best leave it.
    """
    hot = hot.select(*BY).distinct()
    s = source_keys.join(hot, BY, "left_semi").select(*BY, F.col("entity_id").alias("source1_id")).distinct()
    t = target_keys.join(hot, BY, "left_semi").select(*BY, F.col("entity_id").alias("target_id")).distinct()

    def marks(rows: DataFrame, i: str) -> DataFrame:
        return rows.groupBy(*BY).agg(F.count("*").alias(f"{i}_n"), F.bit_xor(F.xxhash64(i)).alias(f"{i}_x"), F.bit_xor(F.xxhash64(F.lit(1), i)).alias(f"{i}_y"))

    same = marks(s, "source1_id").join(marks(t, "target_id").where(F.col("target_id_n") <= block), BY)
    same = same.groupBy(*[c for c in same.columns if c not in BY]).agg(
        F.min(F.struct(*BY)).alias("k"), F.count("*").alias("keys"), F.max(F.col("family").isin(*STRUCTURAL)).alias("structural"), F.max(F.col("family").isin(*EXACT)).alias("exact")
    )
    same = same.select("k.*", "keys", "structural", "exact", F.ceil(F.col("source1_id_n") / RESCUE_SOURCES).cast("int").alias("parts"))
    s = s.join(same, BY).withColumn("part", F.pmod(F.xxhash64("source1_id"), F.col("parts")).cast("int")).drop("parts")
    t = t.join(same.select(*BY, "parts"), BY).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    s = s.join(sources.select(F.col("entity_id").alias("source1_id"), F.col("core").alias("s_name"), F.col("address").alias("s_address")), "source1_id")
    t = t.join(targets.select(F.col("entity_id").alias("target_id"), F.col("core").alias("t_name"), F.col("address").alias("t_address")), "target_id")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = best_of_block(left, right, top) if left.num_rows and right.num_rows else best_of_block(left.slice(0, 0), right.slice(0, 0), top)
        for c in ("keys", "structural", "exact"):
            value = left.column(c)[0].as_py() if left.num_rows else None
            found = found.append_column(c, pa.array([value] * found.num_rows, left.schema.field(c).type))
        return found

    kinds = ", ".join(f"{i} {x.schema[i].dataType.simpleString()}" for x, i in ((s, "source1_id"), (t, "target_id")))
    by = [*BY, "part"]
    rows = s.groupBy(*by).cogroup(t.groupBy(*by)).applyInArrow(run, f"{kinds}, score double, named boolean, addressed boolean, keys long, structural boolean, exact boolean")

    def signal(when: Column) -> Column:
        return F.max(F.when(when, F.col("score")).otherwise(0.0))

    return rows.groupBy("source1_id", "target_id").agg(
        F.max(1 + F.col("score")).alias("evidence"), F.sum("keys").alias("support_count"),
        signal(F.col("named")).alias("name_evidence"), signal(F.col("addressed")).alias("address_evidence"),
        signal(F.col("structural")).alias("structural_evidence"), signal(F.col("exact")).alias("exact_evidence"),
    )


def merge_routes(*routes: DataFrame) -> DataFrame:
    """One row per pair over all routes: the larger evidence of each kind, supports summed, best semantic score and rank."""
    full = None
    for r in routes:
        for name, kind in (("semantic_score", "double"), ("semantic_rank", "int")):
            if name not in r.columns:
                r = r.withColumn(name, F.lit(0).cast(kind))
        for name in ("name_evidence", "address_evidence", "structural_evidence", "exact_evidence"):
            if name not in r.columns:
                r = r.withColumn(name, F.lit(0.0))
        full = r if full is None else full.unionByName(r)
    kinds = ["evidence", "name_evidence", "address_evidence", "structural_evidence", "exact_evidence", "semantic_score"]
    return full.groupBy("source1_id", "target_id").agg(
        *[F.max(k).alias(k) for k in kinds], F.sum("support_count").alias("support_count"),
        F.coalesce(F.min(F.when(F.col("semantic_rank") > 0, F.col("semantic_rank"))), F.lit(0)).alias("semantic_rank"),
    )


def low_candidate_sources(sources: DataFrame, raw: DataFrame, trigger: int = 24) -> DataFrame:
    """Source entities with fewer than ``trigger`` candidates so far."""
    n = raw.groupBy("source1_id").agg(F.count("*").alias("n"))
    return sources.join(n.withColumnRenamed("source1_id", "entity_id"), "entity_id", "left").where(F.coalesce("n", F.lit(0)) < trigger).drop("n")
