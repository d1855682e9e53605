"""Vector retrieval: exact top-k by inner product, and a cell index beyond what that can do."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BYTES = 64 << 20  # of query vectors that a task holds: more are done block by block
FIT_ROWS = 100_000


PROBED = 65  # per cent of the cells that a query looks into


def _matrix(column: pa.Array) -> np.ndarray:
    v = np.array(column.to_pylist(), dtype=np.float64)
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True)) if len(v) else np.ones((0, 1))
    return v / np.maximum(norm, 1e-12)


def semantic_topk(queries: DataFrame, targets: DataFrame, k: int = 64) -> DataFrame:
    """query_id, target_id, score, rank: per query the k targets of largest cosine, ties by target_id. Null vectors are left out.

    Query vectors go to the tasks in blocks of bounded size; targets stay where they are. A task keeps its k best for
    each query, so the shuffle carries queries x tasks x k rows and never all pairs."""
    spark = queries.sparkSession
    queries = queries.where("vec is not null").select("query_id", "vec")
    targets = targets.where("vec is not null").select("target_id", "vec")
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, target_id {targets.schema['target_id'].dataType.simpleString()}, score double"
    out = None
    for ids, vectors in _blocks(queries):
        shared = spark.sparkContext.broadcast((ids, vectors))
        found = targets.mapInArrow(_best(shared, k), kinds)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], kinds)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "target_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def _blocks(queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    ids, rows, size = [], [], 0
    for i, v in queries.toLocalIterator():
        ids.append(i)
        rows.append(v)
        size += 8 * len(v)
        if size > QUERY_BYTES:
            yield ids, _matrix(pa.array(rows))
            ids, rows, size = [], [], 0
    if ids:
        yield ids, _matrix(pa.array(rows))


def _best(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        score, place, names = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), dtype=np.int64), []
        for batch in batches:
            if not batch.num_rows:
                continue
            base = len(names)
            names += batch.column("target_id").to_pylist()
            s = np.round(queries @ _matrix(batch.column("vec")).T, 9)
            score = np.concatenate([score, s], axis=1)
            place = np.concatenate([place, np.broadcast_to(np.arange(base, base + s.shape[1]), s.shape)], axis=1)
            if score.shape[1] > k:
                rank = np.argsort(np.argsort(np.array(names, dtype=object), kind="stable"), kind="stable")
                top = np.lexsort((rank[place], -score), axis=1)[:, :k]
                score, place = np.take_along_axis(score, top, 1), np.take_along_axis(place, top, 1)
        n = score.shape[1]
        yield pa.RecordBatch.from_pydict({"query_id": [i for i in ids for _ in range(n)], "target_id": [names[p] for p in place.ravel()], "score": score.ravel()})

    return run


def cell_topk(queries: DataFrame, targets: DataFrame, k: int = 64, cells: int = 0, probes: int = 0, seed: int = 7) -> DataFrame:
    """Approximate top-k: k-means cells fitted on at most FIT_ROWS targets; every target is in its cell, a query looks into its nearest ``probes``.

    cells: by default the square root of the number of targets, between 16 and 1024. probes: by default a share of the cells
    (PROBED), so that recall doesn't fall as cells get more; tests hold it at 0.9 or more."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    targets = targets.where("vec is not null")
    n = targets.count()
    cells = cells or min(1024, max(16, int(n**0.5)))
    unit = lambda df: df.withColumn("u", F.expr("transform(vec, x -> x / greatest(sqrt(aggregate(vec, 0D, (a, y) -> a + y * y)), 1e-12D))"))
    indexed = unit(targets).withColumn("features", array_to_vector("u"))
    probes = probes or max(1, -(-min(cells, max(1, n)) * PROBED // 100))
    model = KMeans(k=min(cells, max(1, n)), seed=seed, maxIter=10).fit(indexed.orderBy(F.xxhash64("target_id")).limit(FIT_ROWS))
    centres = np.array(model.clusterCenters())
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast(centres)  # 1024 at most

    @F.pandas_udf("array<int>")
    def nearest(u):
        v = np.stack([np.asarray(x) for x in u])
        d = (shared.value**2).sum(axis=1) - 2 * v @ shared.value.T
        import pandas as pd

        return pd.Series(list(np.argsort(d, axis=1)[:, :probes].astype(np.int32)))

    t = model.transform(indexed).select("target_id", F.col("u").alias("t"), F.col("prediction").alias("cell"))
    q = unit(queries.where("vec is not null")).select("query_id", F.col("u").alias("q"), F.explode(nearest("u")).alias("cell"))
    pairs = q.join(t, "cell").select("query_id", "target_id", F.expr("round(aggregate(zip_with(q, t, (a, b) -> a * b), 0D, (a, x) -> a + x), 9)").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "target_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def semantic_route(scores: DataFrame) -> DataFrame:
    """A top-k result as a candidate route: the score as evidence and as semantic score, with its rank."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    return scores.select(F.col("query_id").alias("source1_id"), "target_id", (1 + s).alias("evidence"), F.lit(1).cast("long").alias("support_count"), s.alias("semantic_score"), F.col("rank").alias("semantic_rank"))


def rerank(rows: DataFrame, scorer=None, top: int = 0) -> DataFrame:
    """Adds cross_encoder_score: ``scorer`` (a column function of two texts) for rows of semantic rank 1 to ``top``, else 0."""
    from tessera.functions.normalize import entity_text

    if scorer is None or top < 1:
        return rows.withColumn("cross_encoder_score", F.lit(0.0))
    texts = [entity_text(f"{p}_name", f"{p}_address", f"{p}_country") for p in ("s", "t")]
    return rows.withColumn("cross_encoder_score", F.when(F.col("semantic_rank").between(1, top), scorer(*texts)).otherwise(0.0))
