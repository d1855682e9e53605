"""Which candidates of an entity are matches."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    high: float = 0.5
    low: float = 0.5
    ambiguous_margin: float = 0.0
    second_match_delta: float = 0.0
    max_matches: int = 64
    min_absolute: float = 0.0

    @classmethod
    def hysteresis(cls, threshold: float, margin: float = 0.03, delta: float = 0.04, max_matches: int = 64, min_absolute: float = 0.0) -> Policy:
        high = min(1.0, max(0.0, threshold))
        return cls(high, min(high, max(0.0, high - max(0.0, margin))), max(0.0, margin), max(0.0, delta), max(1, max_matches), min(1.0, max(0.0, min_absolute)))

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, values: dict) -> Policy:
        return cls(**{k: values[k] for k in cls.__dataclass_fields__ if k in values})


def strong_pair(columns: list[str]) -> Column:
    """Evidence that stands without a probability; absent columns count as 0."""

    def c(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in columns else F.lit(0.0)

    n, a = c("name_score"), c("address_score")
    return (
        ((n >= 0.92) & (a >= 0.82)) | ((n >= 0.95) & (a >= 0.70)) | ((a >= 0.95) & (n >= 0.70)) | (c("mutual_best") > 0.5) | (c("opposite_source_bridge") >= 0.80)
        | (c("learned_name_alias") >= 0.80) | (c("learned_address_alias") >= 0.80) | (c("cross_encoder_score") >= 0.85) | (c("semantic_score") >= 0.90)
    )


def apply_policy(rows: DataFrame, policy: Policy | None = None) -> DataFrame:
    """The accepted rows. ``policy`` holds for all, or columns of Policy's names in ``rows`` hold for each.

    By probability, then target_id: rows below the low threshold end the list; below the high one a row needs a margin to
    the next or strong evidence; each one after the first accepted needs the high threshold and a delta, or strong evidence."""
    names = list(Policy.__dataclass_fields__)
    setting = {n: F.lit(getattr(policy, n)) if policy else F.col(n) for n in names}
    by = Window.partitionBy("source1_id").orderBy(F.desc("probability"), "target_id")
    p = F.col("probability")
    rows = rows.withColumn("_strong", F.coalesce(strong_pair(rows.columns), F.lit(False)))
    rows = rows.withColumn("_margin", p - F.coalesce(F.lead("probability").over(by), F.lit(0.0))).withColumn("_pos", F.row_number().over(by))
    rows = rows.where((p >= setting["low"]) & (p >= setting["min_absolute"]))
    rows = rows.withColumn("_one", (p >= setting["high"]) | (F.col("_margin") >= setting["ambiguous_margin"]) | F.col("_strong"))
    rows = rows.withColumn("_first", F.min(F.when(F.col("_one"), F.col("_pos"))).over(Window.partitionBy("source1_id")))
    rows = rows.where(F.col("_one") & ((F.col("_pos") == F.col("_first")) | (p >= setting["high"] + setting["second_match_delta"]) | F.col("_strong")))
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("source1_id").orderBy("_pos"))).where(F.col("_k") <= setting["max_matches"])
    return rows.drop("_strong", "_margin", "_pos", "_one", "_first", "_k", *([] if policy else names))


def policies_by_country(rows: DataFrame, policies: dict[str, Policy], unseen: Policy) -> DataFrame:
    """Adds each row's policy columns by its country; ``unseen`` holds where none is known."""
    spark, names = rows.sparkSession, list(Policy.__dataclass_fields__)
    schema = "country string, high double, low double, ambiguous_margin double, second_match_delta double, max_matches int, min_absolute double"
    table = spark.createDataFrame([(c, *(getattr(p, n) for n in names)) for c, p in policies.items()], schema)
    return rows.join(table, "country", "left").withColumns({n: F.coalesce(n, F.lit(getattr(unseen, n))) for n in names})


def update_probabilities(rows: DataFrame, scored: DataFrame) -> DataFrame:
    """``rows`` with the probabilities of ``scored`` (source1_id, target_id, probability); pairs it lacks keep theirs, null if they have none."""
    pair = ["source1_id", "target_id"]
    new = scored.select(*pair, F.col("probability").alias("new_probability"))
    old = F.col("probability") if "probability" in rows.columns else F.lit(None).cast("double")
    return rows.join(new, pair, "left").withColumn("probability", F.coalesce("new_probability", old)).drop("new_probability")
