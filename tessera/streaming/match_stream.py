"""New source entities, as they arrive, against a fixed set of targets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.normalize import derived
from tessera.operators import blocking, candidates, keys


def index_targets(targets: DataFrame, key_limit: int = keys.KEY_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Linkage form and bounded keys of the targets; write both once and every micro-batch joins them."""
    t = derived(targets)
    bounded, _ = blocking.split_by_frequency(keys.key_rows(t), key_limit)
    return t, bounded


def match_batch(sources: DataFrame, targets: DataFrame, target_keys: DataFrame, top_k: int = candidates.TOP_K) -> DataFrame:
    """Final candidates of one batch of source entities."""
    s = derived(sources.dropDuplicates(["entity_id"]))
    raw = blocking.merge_routes(blocking.pair_evidence(keys.key_rows(s), target_keys))
    rows = candidates.with_fields(raw, s, targets)
    rows = candidates.similarity(candidates.similarity_parts(candidates.shortlist(rows, top_k)))
    return candidates.adaptive_select(rows, top_k).select("source1_id", "target_id", "similarity", "name_score", "address_score", F.col("rank"))


def match_stream(sources: DataFrame, targets: DataFrame, target_keys: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, top_k: int = candidates.TOP_K) -> StreamingQuery:
    """Starts a query that gives each micro-batch's candidates to ``sink`` (rows, batch id); a batch may be given again after a failure."""
    return sources.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: sink(match_batch(batch, targets, target_keys, top_k), n)).start()
