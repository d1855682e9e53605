"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import free_name, with_columns
from .textkit import LOWER, chunks, hash_spans, ngrams, raw, series, spans

BITS = 20
CHUNK = 1 << 19  # bytes of text whose n-grams a worker holds at a time
#: Labelled rows that training reads at most, those first by a hash of their ids: its one sequential task has this bound.
MOST_ROWS = 6_000
WORD_RUNS = (2, 3)  # words of a hashed n-gram beside single words
SHAPE_RUNS = (1, 2, 3)
EPOCHS, ALPHA, BETA, L1, L2, SCALE = 4, 0.3, 1.0, 0.02, 0.2, 4.0
THRESHOLD = 0.3

SHAPE = np.arange(256, dtype=np.uint8)  # A-Z as one class, other letters as one, digits as one, the rest as it is
SHAPE[65:91], SHAPE[97:123], SHAPE[128:], SHAPE[48:58] = 65, 97, 97, 48
SHAPE_VALUE = series(256, 9_000_011)
ECHO = series(8, 31_337)


def features(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot and row of each n-gram of a chunk, and the words of each row.

    The n-grams are words and runs of two and three words, runs of one to three word shapes (the classes of a word's characters, runs as one), and for
    three words in a row which of them are the same. A vocabulary is open, shapes and such echoes are few, so what they
    say carries over to words that training never saw.
    """
    rows = len(offsets) - 1
    starts, ends, row = spans(offsets, data)
    count = np.bincount(row, minlength=rows)
    word = hash_spans(LOWER[data], starts, ends)
    shape = SHAPE[data]
    keep = np.ones(len(shape), dtype=bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[starts] = True
    place = np.zeros(len(shape) + 1, dtype=np.int64)
    np.cumsum(keep, out=place[1:])
    form = hash_spans(shape[keep], place[starts], place[ends], SHAPE_VALUE)
    grams, owner = [word], [row]
    for n in WORD_RUNS:
        value, at = ngrams(word, row, n)
        grams.append(value)
        owner.append(row[at])
    for n in SHAPE_RUNS:
        value, at = ngrams(form, row, n)
        grams.append(value + np.uint64(n))
        owner.append(row[at])
    if len(word) > 2 and SHAPE_RUNS:  # which of three words in a row are the same
        same = (word[1:-1] == word[:-2]) * 1 + (word[2:] == word[1:-1]) * 2 + (word[2:] == word[:-2]) * 4
        at = np.flatnonzero((row[2:] == row[:-2]) & (same > 0))
        grams.append(ECHO[same[at]])
        owner.append(row[at])
    return (np.concatenate(grams) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(owner), count


def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse vectors of labelled rows: slots and values, a value being the n-gram's count over the words."""
    for batch in batches:
        offsets, data = raw(batch.column("text"))
        for lo, hi, off, part in chunks(offsets, data, CHUNK):
            slot, row, count = features(off, part)
            key, times = np.unique(row << BITS | slot, return_counts=True)
            owner = key >> BITS
            value = (SCALE * times / np.maximum(count[owner], 1)).astype(np.float32)
            cut = np.searchsorted(owner, np.arange(hi - lo + 1))
            slots = (key & ((1 << BITS) - 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("turn")[lo:hi], batch.column("label")[lo:hi], *(pa.array([x[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()) for x in (slots, value))],
                ["turn", "label", "slots", "counts"],
            )


def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FTRL-proximal over the rows in order of ``turn``, several times; gives the weights other than 0, the bias at slot -1.

    The rows' vectors stay in the Arrow buffers they came in.
    """
    rows = []
    for b in batches:
        (at, slots), (begin, counts) = raw(b.column("slots")), raw(b.column("counts"))
        rows += [(t, y, slots[at[k] : at[k + 1]], counts[begin[k] : begin[k + 1]]) for k, (t, y) in enumerate(zip(b.column("turn").to_pylist(), b.column("label").to_pylist()))]
    rows.sort(key=lambda r: (r[0], r[1], r[2].tobytes()[:64]))
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weight(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        w = (np.sign(zs) * L1 - zs) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zs) <= L1, 0.0, w)

    for _ in range(EPOCHS):
        for _turn, label, slots, counts in rows:
            at = np.append(slots.view(np.int32), size - 1).astype(np.int64)
            x = np.append(counts.view(np.float32), 1.0)
            w = weight(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = weight(np.arange(size))
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(np.where(at == size - 1, -1, at), pa.int64()), pa.array(w[at])], ["slot", "weight"])


def held_out(doc_id: F.Column | str) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Weights by slot and bias, from at most MOST_ROWS labelled rows that aren't held out; without any, all 0."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("label").alias("label"))
    known = known.withColumn("turn", F.xxhash64("doc_id")).orderBy("turn", "doc_id").limit(MOST_ROWS)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # MOST_ROWS ids.select("turn", "label", "text")
    sparse = rows.mapInArrow(vectors, "turn long, label int, slots binary, counts binary")
    found = sparse.orderBy("turn", "label", "slots").limit(MOST_ROWS).mapInArrow(train, "slot long, weight double").collect()
    weights, bias = np.zeros(1 << BITS, np.float32), 0.0
    for slot, weight in found:
        if slot < 0:
            bias = weight
        else:
            weights[slot] = weight
    return weights, bias


def scorer(weights: np.ndarray, bias: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    def score(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(offsets) - 1)
        for lo, hi, off, part in chunks(offsets, data, CHUNK):
            slot, row, count = features(off, part)
            out[lo:hi] = SCALE * np.bincount(row, weights[slot], minlength=hi - lo) / np.maximum(count, 1)
        return 1 / (1 + np.exp(-(out + bias)))

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, name: str = "score") -> DataFrame:
    """Every column of ``docs`` and ``name``: how likely label 1 is, from 0 to 1, by a sparse dot product with the whole text.

    Training takes one label for a doc_id (the larger of several), never those held out (see ``held_out``; a null
    doc_id isn't), nor labels other than 0 and 1. A null or empty text has the score of the bias; without labels all
    scores are 0.5. Repeated rows score alike. A column of ``docs`` named ``name`` is replaced. Empty in, empty out.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(with_columns(docs, doc_id="long", text="string"), labels))  # BITS fixes its size
    docs = docs.drop(name)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(*model.value)
        at = names.index("text")
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score(*raw(batch.column(at))), pa.float64())], [*names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def passing(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with their columns, one named score included. See ``quality_scores``."""
    name = free_name(docs, "score")
    return quality_scores(docs, labels, name).where(F.col(name) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
