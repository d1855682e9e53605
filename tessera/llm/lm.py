"""Language-model scoring: deleted interpolation of n-gram estimates by context-frequency buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialise, shards_for, with_columns
from .textkit import chunks, mix, raw, series, word_hashes

END = np.uint64(0x1D8E4E27C47D124F)  # the token after a text, and the context of its first word
STEPS = 4  # cells per factor of 2 in which the held-out estimates are counted
CELLS = 64 * STEPS  # per estimate; the last is for 0
BUCKETS = 40  # of contexts, by log2 of their frequency
ROUNDS = 60


def learning(doc_id: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(10)) != 0, F.lit(True))


def tokens(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows, each row followed by END, and the rows' offsets among them."""
    found, sizes = [], []
    for lo, hi, off, part in chunks(offsets, data):
        word, row = word_hashes(off, part)
        count = np.bincount(row, minlength=hi - lo) + 1
        out = np.full(int(count.sum()), END)
        out[np.arange(len(word)) + row] = word
        found.append(out)
        sizes.append(count)
    cut = np.zeros(len(offsets), dtype=np.int64)
    if sizes:
        np.cumsum(np.concatenate(sizes), out=cut[1:])
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64), cut


def pairs(token: np.ndarray) -> np.ndarray:
    """56-bit key of each token with the one before it; before a text's first there is an END in any case."""
    one, two = series(2, 55)
    before = np.concatenate([[END], token[:-1]]).astype(np.uint64)
    return mix(before * one + token * two) & np.uint64(0xFFFFFFFFFFFFFF00)


def pack(x: np.ndarray) -> bytes:
    """Planes of bytes: the high ones are nearly all 0 and compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unpack(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, len(data) // width).T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def slices(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's keys begin among sorted keys."""
    edges = [np.uint64((b << 64) // buckets) for b in range(buckets)]
    return np.append(np.searchsorted(keys, np.array(edges, dtype=np.uint64)), len(keys))


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and the place among them of each."""
    code, found = pd.factorize(x)
    order = np.argsort(found)
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return found[order], place[code]


def keyed(docs: pa.Table) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Offsets of the tokens of a shard's rows, and its keys with the key of each token: words, then pairs."""
    token, cut = tokens(*raw(docs.column("text")))
    return cut, [distinct(token), distinct(pairs(token))]


def deal(shards: int):
    """Rows of a batch that go to one shard travel as one compressed block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            order = np.argsort(batch.column("shard").to_numpy(), kind="stable")
            rows = pa.Table.from_batches([batch.take(pa.array(order))])
            shard = rows.column("shard").to_numpy()
            begins = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else []
            blobs = []
            for lo, hi in zip(begins, [*begins[1:], len(shard)]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, DEALT, options=options) as out:
                    out.write_table(rows.slice(lo, hi - lo).select(DEALT.names).cast(DEALT))
                blobs.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array([int(shard[k]) for k in begins], pa.int32()), pa.array(blobs, pa.binary())], ["shard", "block"])

    return run


DEALT = pa.schema([("doc_id", pa.int64()), ("train", pa.bool_()), ("text", pa.string())])


def undealt(table: pa.Table) -> pa.Table:
    """A shard's rows, in an order that doesn't depend on the shuffle's."""
    blocks = sorted(x.as_py() for x in table.column("block"))
    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in blocks])


#: A bucket's counts are asked for by shard: words, their training counts in the shard, pairs, theirs.
ASKED = "bucket int, shard int, words binary, n_words binary, pairs binary, n_pairs binary"
TOLD = "shard int, bucket int, n_words binary, n_pairs binary, train_tokens long, distinct_tokens long"


def ask(buckets: int):
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = undealt(pa.Table.from_batches(list(batches)))
        cut, keys = keyed(docs)
        train = np.repeat(docs.column("train").to_numpy(), np.diff(cut))
        columns = []
        for k, place in keys:
            count = np.bincount(place[train], minlength=len(k)).astype(np.int32)
            at = slices(k, buckets)
            columns.append([(pack_keys(k[a:b]), pack(count[a:b])) for a, b in zip(at, at[1:])])
        shard = key[0].as_py()
        for b in range(buckets):
            (w, nw), (p, np_) = columns[0][b], columns[1][b]
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int32()), "shard": pa.array([shard], pa.int32()), "words": [w], "n_words": [nw], "pairs": [p], "n_pairs": [np_]})

    return run


def tell(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the counts of a bucket's keys over all shards and tells each shard those of its own, in its order."""
    table = pa.Table.from_batches(list(batches))
    out = {"shard": table.column("shard").combine_chunks(), "bucket": table.column("bucket").combine_chunks()}
    for keys, counts in (("words", "n_words"), ("pairs", "n_pairs")):
        each = [unpack_keys(x.as_py()) for x in table.column(keys)]
        ends = np.cumsum([0, *map(len, each)])
        found, place = np.unique(np.concatenate(each), return_inverse=True)
        total = np.bincount(place, np.concatenate([unpack(x.as_py(), np.int32) for x in table.column(counts)]), minlength=len(found)).astype(np.int64)
        out[counts] = pa.array([pack(total[place[a:b]].astype(np.int64)) for a, b in zip(ends, ends[1:])], pa.binary())
        if keys == "words":
            n, v = int(total.sum()), int((total > 0).sum())
    rows = table.num_rows
    yield pa.RecordBatch.from_pydict(out | {"train_tokens": pa.array([n] * rows, pa.int64()), "distinct_tokens": pa.array([v] * rows, pa.int64())})


COUNTED = "doc_id long, train boolean, n_tokens long, words binary, pairs binary, train_tokens long, distinct_tokens long"


def counted(key: tuple, dealt: pa.Table, told: pa.Table) -> pa.Table:
    """For every token of a document how often training texts have it, and have it after the one before."""
    docs = undealt(dealt)
    cut, keys = keyed(docs)
    told = told.sort_by("bucket")
    columns = []
    for (_, place), name in zip(keys, ("n_words", "n_pairs")):
        total = np.concatenate([unpack(x.as_py(), np.int64) for x in told.column(name)])
        columns.append(total[place])
    blobs = [pa.array([pack(c[a:b]) for a, b in zip(cut, cut[1:])], pa.binary()) for c in columns]
    sums = [pa.array([sum(told.column(c).to_pylist())] * docs.num_rows, pa.int64()) for c in ("train_tokens", "distinct_tokens")]
    return pa.table([docs.column("doc_id"), docs.column("train"), pa.array(np.diff(cut), pa.int64()), *blobs, *sums], ["doc_id", "train", "n_tokens", "words", "pairs", "train_tokens", "distinct_tokens"])


def contexts(word: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Frequency of each token's context: that of the token before, for a first token of the text ends."""
    out = np.empty_like(word)
    out[1:] = word[:-1]
    out[cut[:-1]] = word[cut[1:] - 1]
    return out


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else by powers of 2."""
    return np.minimum(BUCKETS - 1, np.ceil(np.log2(np.maximum(context, 0) + 1.0))).astype(np.int64)


def joined(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cut = np.concatenate([[0], np.cumsum(batch.column("n_tokens").to_numpy())])
    word, pair = (np.concatenate([np.zeros(0, np.int64), *(unpack(x.as_py(), np.int64) for x in batch.column(c))]) for c in ("words", "pairs"))
    return word, pair, cut


def small(batches: Iterator[pa.RecordBatch], size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about ``size`` tokens."""
    for batch in batches:
        ends, lo = np.cumsum(batch.column("n_tokens").to_numpy()), 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def cell(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.minimum(CELLS - 2, np.floor(-np.log2(p) * STEPS)), CELLS - 1).astype(np.int64)


def held_out_counts(total: int):
    """How many training tokens fall in each cell of context bucket, pair estimate and word estimate, each token's own
    occurrence deleted from the counts before they are turned into estimates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            word, pair, cut = joined(batch)
            own = np.repeat(batch.column("train").to_numpy(zero_copy_only=False), np.diff(cut))
            context = contexts(word, cut)[own] - 1
            two = (pair[own] - 1) / np.maximum(context, 1)
            one = (word[own] - 1) / max(total - 1, 1)
            key, n = np.unique((bucket_of(context) * CELLS + cell(two)) * CELLS + cell(one), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["cell", "n"])

    return run


def learn(cells: np.ndarray, n: np.ndarray, distinct: int) -> np.ndarray:
    """Weights of pair, word and uniform estimates for each bucket, by expectation-maximisation."""
    middle = np.append(2.0 ** (-(np.arange(CELLS - 1) + 0.5) / STEPS), 0)
    bucket, two, one = cells // (CELLS * CELLS), middle[cells // CELLS % CELLS], middle[cells % CELLS]
    p = np.stack([two, one, np.full(len(cells), 1 / (distinct + 1))])
    weight = np.full((BUCKETS, 3), 1 / 3)
    for _ in range(ROUNDS):
        part = weight[bucket].T * p
        part *= n / part.sum(axis=0)
        got = np.stack([np.bincount(bucket, x, minlength=BUCKETS) for x in part], axis=1)
        weight = (got + 1e-3) / (got + 1e-3).sum(axis=1, keepdims=True)
    weight[0] = [0, weight[0, 1] / weight[0, 1:].sum(), weight[0, 2] / weight[0, 1:].sum()]  # an unseen context says nothing
    return weight


def lm_scores(docs: DataFrame) -> DataFrame:
    """log10 probability of each text under a bigram model that is learnt from the documents in ``learning``.

    A token's probability mixes three estimates: its share after the token before it, its share of all training tokens,
    and 1 / (distinct training tokens + 1). The weights depend on how frequent the context is, by powers of two, and come
    from expectation-maximisation over all training tokens, each with its own occurrence deleted from the counts.
    base_score is the unigram model with 0.1 added to the counts, n_known counts tokens seen in training texts, and
    train_tokens all tokens of those. Tokens are 64-bit hashes of lower-cased words, and an end after each text.

    Documents are dealt into shards of bounded size; a shard asks the buckets of a hashed key range for the counts of
    its own words and pairs, so that counts are summed once and travel as packed arrays, and nothing is broadcast.

    Null or empty text is an end alone. A null doc_id counts as training. Repeated rows count as often as they occur.
    Without training tokens all counts are 0. Empty in, empty out; other columns aren't looked at.
    """
    docs = with_columns(docs, doc_id="long", text="string")
    shards = shards_for(docs, "text", 8 << 20)
    dealt = docs.select("doc_id", "text", learning("doc_id").alias("train"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int").alias("shard"))
    dealt = dealt.mapInArrow(deal(shards), "shard int, block binary").repartition(shards, "shard")
    asked = dealt.groupBy("shard").applyInArrow(ask(shards), ASKED)
    told = asked.repartition(shards, "bucket").groupBy("bucket").applyInArrow(tell, TOLD)
    told = told.repartition(shards, "shard")
    with_counts = dealt.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(counted, COUNTED)
    table = materialise(with_counts, "counted")
    sizes = table.select("train_tokens", "distinct_tokens").first()
    total, distinct = (sizes[0], sizes[1]) if sizes else (0, 0)
    found = table.where("train").select("train", "n_tokens", "words", "pairs").mapInArrow(held_out_counts(total), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = np.array([tuple(r) for r in found], dtype=np.int64).reshape(-1, 2)
    weight = learn(cells[:, 0], cells[:, 1], distinct)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            word, pair, cut = joined(batch)
            context = contexts(word, cut)
            w = weight[bucket_of(context)]
            p = w[:, 0] * (pair / np.maximum(context, 1)) + w[:, 1] * (word / max(total, 1)) + w[:, 2] / (distinct + 1)
            base = np.log10((word + 0.1) / (total + 0.1 * (distinct + 1)))
            sums = [np.add.reduceat(x, cut[:-1]) for x in (word > 0, base, np.log10(p))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(~batch.column("train").to_numpy(zero_copy_only=False)), batch.column("n_tokens"), pa.array(sums[0].astype(np.int64)), pa.array(np.full(len(cut) - 1, total)), pa.array(sums[1]), pa.array(sums[2])],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return table.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

