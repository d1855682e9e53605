"""N-gram Jaccard join with count-vector R-trees."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .store import discard, free_name, materialise, with_columns
from .textkit import chunks, give_back, mix, raw, shingle_sets, word_hashes

GROUPS = 256  # of shingles; their counts are the coordinates of a document's point
FINE = 4  # shingles a group, at most, of a document's fine point
SKETCH_BITS = 20  # counters of the frequency sketch; its size is fixed
PART_BITS = 14
FAN = 32  # children of a tree's node
BLOCK = 2048  # points that a task's tree or query block holds
BLOCK_SHINGLES = 1 << 22  # that the sets of such a block have, unless one set has more
EDGES = 1 << 20  # pairs of points that a task holds at a time
ASKED = 64  # sets that are intersected with another at a time
SALT_ROWS = 256  # texts that are checked against one copy of a pivot's text
MARK_BITS, MARK_BUCKET = 23, 15  # of the map that says which documents' texts are needed; its size is fixed


class Ratio:
    """Sets link when den * intersection >= num * union."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den

    def least_overlap(self, total: np.ndarray) -> np.ndarray:
        """Smallest intersection of two linked sets whose sizes sum to ``total``."""
        return -(-self.num * total // (self.num + self.den))

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """So many shingles, first in any order for all, that linked sets share one of them."""
        return n + 1 - -(-self.num * n // self.den)


def sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for lo, hi, off, part in chunks(*raw(batch.column("text"))):
        word, row = word_hashes(off, part)
        yield lo, hi, *shingle_sets(word, row, hi - lo, words)
    give_back()


def signatures(value: np.ndarray, cut: np.ndarray) -> list[bytes]:
    """128 bits for each set."""
    both = []
    for v in (value, mix(value ^ np.uint64(0x5DEECE66D))):
        total = np.zeros(len(value) + 1, dtype=np.uint64)
        np.cumsum(v, out=total[1:])
        both.append(mix(total[cut[1:]] - total[cut[:-1]]))
    return [a + b for a, b in zip(*([x.tobytes() for x in v] for v in both))]


def sketch(docs: DataFrame, words: int) -> np.ndarray:
    """For each of 2^SKETCH_BITS counters the log2 of how far its documents exceed the mean, from all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for batch in batches:
            for _lo, _hi, value, _cut in sets(batch, words):
                total += np.bincount((value >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
        parts = [zlib.compress(x.tobytes(), 1) for x in total.reshape(-1, 1 << PART_BITS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["part", "counts"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << PART_BITS, dtype=np.int64)
        for batch in batches:
            for x in batch.column("counts"):
                total += np.frombuffer(zlib.decompress(x.as_py()), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["part", "counts"])

    types = "part int, counts binary"
    total = np.zeros((1 << SKETCH_BITS - PART_BITS, 1 << PART_BITS), dtype=np.int64)
    for part, counts in docs.select("text").mapInArrow(count, types).groupBy("part").applyInArrow(add, types).collect():
        total[part] = np.frombuffer(zlib.decompress(counts), dtype=np.int64)
    return np.log2(np.maximum(total.ravel() / max(1.0, total.mean()), 1)).astype(np.uint8)


def packed(point: np.ndarray) -> list[bytes]:
    """Half a byte a coordinate, or one or four where a count needs more."""
    most = point.max(axis=1, initial=0)
    narrow = point.astype(np.uint8)
    halves = narrow[:, ::2] | narrow[:, 1::2] << 4
    return [(halves[k] if most[k] < 16 else narrow[k] if most[k] < 256 else point[k].astype(np.uint32)).tobytes() for k in range(len(point))]


def fine_groups(n: int) -> int:
    """Of a set's fine point: a power of two, GROUPS at least, so that a fine point's sums are a coarser one."""
    return max(GROUPS, -(-n // FINE) and 1 << (-(-n // FINE) - 1).bit_length())


def fine_points(value: np.ndarray, cut: np.ndarray) -> list[bytes | None]:
    """None for sets whose point is fine enough."""
    out: list[bytes | None] = []
    for k, n in enumerate(np.diff(cut).tolist()):
        if (groups := fine_groups(n)) == GROUPS:
            out.append(None)
            continue
        group = mix(value[cut[k] : cut[k + 1]] ^ np.uint64(0xC0FFEE)) & np.uint64(groups - 1)
        out += packed(np.bincount(group.astype(np.int64), minlength=groups)[None])
    return out


def fine_point(held: bytes, n: int) -> np.ndarray:
    groups, data = fine_groups(n), np.frombuffer(held, np.uint8)
    if len(data) == groups // 2:
        data = np.stack([data & 15, data >> 4], axis=1).ravel()
    return data.view(np.uint32).astype(np.int32) if len(data) > groups else data.astype(np.int32)


def most_shared(a: np.ndarray, b: np.ndarray) -> int:
    """Shingles that two sets share at most, by their fine points."""
    a, b = (x.reshape(-1, min(len(a), len(b))).sum(axis=0) for x in (a, b))
    return int(np.minimum(a, b).sum())


def points(column: pa.Array) -> np.ndarray:
    offsets, data = raw(column)
    size, out = np.diff(offsets), np.zeros((len(offsets) - 1, GROUPS), np.int32)
    for width in np.unique(size):
        rows = np.flatnonzero(size == width)
        held = data[offsets[rows][:, None] + np.arange(width)]
        if width == GROUPS // 2:
            held = np.stack([held & 15, held >> 4], axis=2).reshape(len(rows), GROUPS)
        out[rows] = held.view(np.uint32) if width > GROUPS else held
    return out


def described(docs: DataFrame, words: int, ratio: Ratio) -> DataFrame:
    """Per document: size and signature of its set, its point, a fine one of large sets, and the prefix by which it is brought to others."""
    levels = docs.sparkSession.sparkContext.broadcast(sketch(docs, words))  # 1 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        for batch in batches:
            for lo, hi, value, cut in sets(batch, words):
                n = np.diff(cut)
                owner = np.repeat(np.arange(hi - lo), n)
                group = (mix(value ^ np.uint64(0xC0FFEE)) % np.uint64(GROUPS)).astype(np.int64)
                point = np.bincount(owner * GROUPS + group, minlength=(hi - lo) * GROUPS).reshape(-1, GROUPS)
                order = np.lexsort((value, level[(value >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], owner))
                first = (np.arange(len(value)) - cut[owner]) < ratio.prefix(n)[owner]
                chosen = value[order][first].astype(np.int64)
                ends = np.zeros(hi - lo + 1, dtype=np.int32)
                np.cumsum(np.bincount(owner[first], minlength=hi - lo), out=ends[1:])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[lo:hi], pa.array(n, pa.int64()), pa.array(signatures(value, cut), pa.binary()), pa.array(packed(point), pa.binary()), pa.array(fine_points(value, cut), pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(chosen))],
                    ["doc_id", "n", "sig", "point", "fine", "prefix"],
                )

    return docs.mapInArrow(run, "doc_id long, n long, sig binary, point binary, fine binary, prefix array<long>")


class CountTree:
    """R-tree over count vectors, packed level by level. A node knows its points' largest coordinates, sizes and components."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, comps: np.ndarray) -> None:
        spread = np.argsort(-points.std(axis=0))[:2] if len(points) else [0, 0]
        self.order = np.lexsort((points[:, spread[1]], points[:, spread[0]], sizes))
        self.levels = [(points[self.order], sizes[self.order], sizes[self.order], comps[self.order], comps[self.order])]
        while len(self.levels[-1][0]) > FAN:
            top, low, high, c_low, c_high = self.levels[-1]
            cut = np.arange(0, len(top), FAN)
            self.levels.append((np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.minimum.reduceat(c_low, cut), np.maximum.reduceat(c_high, cut)))

    def near(self, point: np.ndarray, size: int, comp: int, ratio: Ratio) -> np.ndarray:
        """Points of other components that may link: those that the sums of coordinate minima don't rule out."""
        at = np.arange(len(self.levels[-1][0]))
        for k in range(len(self.levels) - 1, -1, -1):
            top, low, high, c_low, c_high = self.levels[k]
            at = at[~((c_low[at] == comp) & (c_high[at] == comp)) & (ratio.den * high[at] >= ratio.num * size) & (ratio.den * size >= ratio.num * low[at])]
            if len(at):
                smallest = np.maximum(low[at], -(-ratio.num * size // ratio.den))
                at = at[np.minimum(top[at], point).sum(axis=1) >= ratio.least_overlap(smallest + size)]
            if not len(at):
                return at
            if k:
                at = (at[:, None] * FAN + np.arange(FAN)).ravel()
                at = at[at < len(self.levels[k - 1][0])]
        return self.order[at]


def merged(label: np.ndarray, left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """``label`` (a row each, the smallest row it is joined with) after edges more; the lists of edges are emptied."""
    a, b = (np.concatenate([np.zeros(0, np.int64), *v]).astype(np.int64) for v in (left, right))
    left.clear()
    right.clear()
    while True:
        now = label.copy()
        least = np.minimum(label[a], label[b])
        for at in (a, b, label[a], label[b]):
            np.minimum.at(now, at, least)
        now = now[now]
        if (now == label).all():
            return label
        label = now


def group_rows(label: np.ndarray, cid: np.ndarray, side: np.ndarray, comp: np.ndarray) -> pa.RecordBatch:
    """The rows whose label others have too. Groups of the same classes and sides have the same key."""
    rows = np.flatnonzero(np.bincount(label, minlength=len(label))[label] > 1) if len(label) else label
    key = np.zeros(len(label), dtype=np.uint64)
    np.add.at(key, label[rows], mix((cid[rows] * 4 + side[rows]).astype(np.uint64) ^ np.uint64(0xBEEF)))
    return pa.RecordBatch.from_arrays([pa.array(mix(key[label[rows]]).astype(np.int64)), pa.array(cid[rows], pa.int64()), pa.array(side[rows], pa.int32()), pa.array(comp[rows], pa.int64())], ["key", "cid", "side", "comp"])


def tree_groups(batches: Iterator[pa.RecordBatch], ratio: Ratio) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (pivot, x, y). Within such a block the points of side 1 query the tree of side 0; with x = y, those
    of the block query their own tree. Blocks of FAN points or fewer are trees of one node, and many are done at a time.
    Classes that the bounds don't keep apart, directly or through others, are a group: a row for each, not for each pair.
    Groups of the same classes have the same key. Side is 2 where x = y."""

    def solved(table: pa.Table, begins: np.ndarray) -> pa.RecordBatch:
        x, y, cid, side, comp, n = (table.column(c).to_numpy() for c in ("x", "y", "cid", "side", "comp", "n"))
        ends = np.append(begins[1:], len(cid))
        point = points(table.column("point")) if len(cid) else np.zeros((0, GROUPS), np.int32)
        block = np.repeat(np.arange(len(begins)), ends - begins)
        label = np.arange(len(cid))
        left, right = [], []
        few = (ends - begins <= FAN)[block]
        for d in range(1, FAN):
            i = np.flatnonzero(few[:-d] & (block[d:] == block[:-d])) if len(block) > d else np.zeros(0, np.int64)
            if not len(i):
                break
            j = i + d
            ok = (comp[i] != comp[j]) & ((x[i] == y[i]) | (side[i] != side[j])) & (ratio.den * n[i] >= ratio.num * n[j]) & (ratio.den * n[j] >= ratio.num * n[i])
            i, j = i[ok], j[ok]
            for k in range(0, len(i), 1 << 14):
                a, b = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
                good = np.minimum(point[a], point[b]).sum(axis=1) >= ratio.least_overlap(n[a] + n[b])
                left.append(a[good])
                right.append(b[good])
        label = merged(label, left, right)
        for lo, hi in zip(begins, ends):
            if hi - lo <= FAN:
                continue
            all_ = np.arange(lo, hi)
            stored, asks = (all_, all_) if x[lo] == y[lo] else (all_[side[lo:hi] == 0], all_[side[lo:hi] == 1])
            if not len(stored) or not len(asks):
                continue
            tree, held = CountTree(point[stored], n[stored], comp[stored]), 0
            for k in asks:
                found = stored[tree.near(point[k], int(n[k]), int(comp[k]), ratio)]
                left.append(np.full(len(found), k))
                right.append(found)
                held += len(found)
                if held > EDGES:
                    label, held = merged(label, left, right), 0
            label = merged(label, left, right)
        return group_rows(label, cid, np.where(x == y, 2, side), comp)

    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None and rest.num_rows else table
        if not table.num_rows:
            continue
        keys = np.stack([table.column(c).to_numpy() for c in ("pivot", "x", "y")], axis=1)
        begins = np.append(0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1)
        rest = table.slice(int(begins[-1]))
        yield solved(table.slice(0, int(begins[-1])), begins[:-1])
    if rest is not None and rest.num_rows:
        yield solved(rest, np.zeros(1, np.int64))


def fine_label(n: np.ndarray, side: np.ndarray, comp: np.ndarray, fine: list[np.ndarray], ratio: Ratio) -> np.ndarray:
    """For each class of a group the first of those that fine points don't keep apart from it, directly or through others."""
    point = np.stack([v.reshape(-1, GROUPS).sum(axis=0) for v in fine])
    tree, label = CountTree(point, n, comp), np.arange(len(n))
    for i in range(len(n)):
        near = tree.near(point[i], int(n[i]), int(comp[i]), ratio)
        for j in near[(near > i) & ((side[near] != side[i]) | (side[near] == 2))]:
            if label[j] != label[i] and most_shared(fine[i], fine[j]) >= ratio.least_overlap(n[i] + n[j]):
                label[label == max(label[i], label[j])] = min(label[i], label[j])
    return label


def refined(batches: Iterator[pa.RecordBatch], ratio: Ratio) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, with their classes' fine points. Gives the parts of each group that these leave together."""
    now, names, fine = None, [], []

    def parts() -> pa.RecordBatch:
        cid, side, comp, n = np.array(names, dtype=np.int64).reshape(-1, 4).T
        label = fine_label(n, side, comp, fine, ratio) if len(fine) else np.zeros(0, np.int64)
        names.clear()
        fine.clear()
        return group_rows(label, cid, side, comp)

    for batch in batches:
        for key, cid, side, comp, n, held in zip(*(batch.column(c).to_pylist() for c in ("key", "cid", "side", "comp", "n", "fine"))):
            if key != now:
                yield parts()
                now = key
            names.append((cid, side, comp, n))
            fine.append(fine_point(held, n))
    yield parts()


def group_links(cid: np.ndarray, side: np.ndarray, comp: np.ndarray, held: list[np.ndarray], ratio: Ratio) -> tuple[list[int], list[int]]:
    """Links by which the components of a group's classes join: pairs that link, none between classes joined before."""
    n = np.array([len(v) for v in held])
    point = np.stack([np.bincount((mix(v ^ np.uint64(0xC0FFEE)) % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS) for v in held]).astype(np.int32)
    tree, root = CountTree(point, n, comp), comp.copy()
    left, right = [], []
    for i in range(len(held)):
        near = tree.near(point[i], int(n[i]), int(comp[i]), ratio)
        near = near[(near > i) & ((side[near] != side[i]) | (side[near] == 2))]
        near = near[root[near] != root[i]]
        while len(near):
            some, near = near[:ASKED], near[ASKED:]
            values = np.concatenate([held[j] for j in some])
            at = np.minimum(np.searchsorted(held[i], values), n[i] - 1)
            same = np.add.reduceat((held[i][at] == values).astype(np.int64), np.cumsum(n[some]) - n[some])
            for j in some[ratio.den * same >= ratio.num * (n[i] + n[some] - same)]:
                if root[j] != root[i]:
                    left.append(int(cid[i]))
                    right.append(int(cid[j]))
                    root[root == root[j]] = root[i]
            near = near[root[near] != root[i]]
    return left, right


def settled(batches: Iterator[pa.RecordBatch], words: int, ratio: Ratio) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, with their texts. Gives each group's links, fewer than it has classes."""
    now, names, held = None, [], []

    def links() -> pa.RecordBatch:
        left, right = group_links(*np.array(names, dtype=np.int64).reshape(-1, 3).T, held, ratio) if len(held) > 1 else ([], [])
        names.clear()
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    for batch in batches:
        key, cid, side, comp, sig = (batch.column(c).to_pylist() for c in ("key", "cid", "side", "comp", "sig"))
        for lo, hi, value, cut in sets(batch, words):
            marks = signatures(value, cut)
            for k in range(lo, hi):
                if marks[k - lo] != sig[k]:  # another row of the same doc_id
                    continue
                if key[k] != now:
                    yield links()
                    now = key[k]
                names.append((cid[k], side[k], comp[k]))
                held.append(value[cut[k - lo] : cut[k - lo + 1]].copy())
    yield links()


def checked(batches: Iterator[pa.RecordBatch], words: int, ratio: Ratio) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, salt, b); the first of each a and salt has a's own text, b being null. Gives the linked pairs."""
    now, mine = None, None
    for batch in batches:
        left, right = [], []
        a, salt, b, sig = (batch.column(c).to_pylist() for c in ("a", "salt", "b", "sig"))
        for lo, hi, value, cut in sets(batch, words):
            marks = signatures(value, cut)
            for k in range(lo, hi):
                if marks[k - lo] != sig[k]:  # another row of the same doc_id
                    continue
                have = value[cut[k - lo] : cut[k - lo + 1]]
                if b[k] is None:
                    now, mine = (a[k], salt[k]), have.copy()
                elif (a[k], salt[k]) == now:
                    at = np.searchsorted(mine, have)
                    same = int((mine[np.minimum(at, len(mine) - 1)] == have).sum())
                    if ratio.den * same >= ratio.num * (len(mine) + len(have) - same):
                        left.append(a[k])
                        right.append(b[k])
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def marked(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """``docs`` with a column ``name``: false where ``ids`` surely doesn't have the doc_id, by a bit map of 1 MB of hashed ids."""
    number = F.pmod(F.xxhash64("doc_id"), F.lit(1 << MARK_BITS))
    bucket, place = F.shiftright(number, MARK_BUCKET), number.bitwiseAND((1 << MARK_BUCKET) - 1)
    marks = ids.select(bucket.alias("bucket"), place.alias("place")).groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits"))
    rows = docs.select(F.struct("*").alias("row"), bucket.alias("bucket"), place.cast("int").alias("place")).join(F.broadcast(marks), "bucket", "left")
    byte = F.conv(F.hex(F.substring("bits", F.shiftright("place", 3) + 1, F.lit(1))), 16, 10).cast("int")
    mark = F.call_function("shiftright", byte, F.col("place").bitwiseAND(7)).bitwiseAND(1) == 1
    return rows.select("row.*", F.coalesce(mark, F.lit(False)).alias(name))


def with_texts(named: DataFrame, docs: DataFrame) -> DataFrame:
    """``named`` with the texts of its doc_ids; most other texts stay out of the shuffle."""
    named = materialise(named, "named")
    return named.join(marked(docs.select("doc_id", "text"), named, "wanted").where("wanted").select("doc_id", "text"), "doc_id")


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id isn't among those of ``ids``. Most texts aren't shuffled."""
    ids, name = materialise(ids.select("doc_id").distinct(), "without"), free_name(docs, "asked")
    rows = marked(docs, ids, name)
    return rows.where(~F.col(name)).unionByName(rows.where(F.col(name)).join(ids, "doc_id", "left_anti")).select(*docs.columns)


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, ratio: Ratio) -> DataFrame:
    """Those of the pairs (a, b) of classes that link, by their whole sets. A text goes to each a it is paired with, and
    a's own text once for SALT_ROWS of them."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("s"))
    others = pairs.join(salts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("s")).cast("int").alias("salt"), "b", F.col("b").alias("cid"))
    own = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), F.col("a").alias("cid"))
    named = others.unionByName(own).join(classes.select("cid", "sig", "doc_id"), "cid")
    rows = with_texts(named, docs).select("a", "salt", "b", "sig", "text")
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return rows.mapInArrow(lambda batches: checked(batches, words, ratio), "a long, b long")


def joined(groups: DataFrame, classes: DataFrame, docs: DataFrame, words: int, ratio: Ratio) -> DataFrame:
    """Links (a, b) that join the components of each group's classes, by their whole sets. A text goes once to each group."""
    rows = with_texts(groups.join(classes.select("cid", "sig", "doc_id"), "cid"), docs).select("key", "cid", "side", "comp", "sig", "text")
    rows = rows.repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(lambda batches: settled(batches, words, ratio), "a long, b long")


def jaccard_join(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per document n_shingles, the size of its set of ``words``-word shingles, and component_id: the smallest doc_id
    that links lead to, two documents being linked when den * |intersection| >= num * |union|.

    Equal sets are one class and are compared once. Classes meet through shingles of their prefixes (rare ones first, by
    a sketch of all documents' counts). Each class is checked with the smallest class of each shingle it shares, its pivot, which
    settles groups of copies with as many checks as members. The rest are classes that share a pivot but no component so
    far: their counts of shingles by hash group are points of an R-tree, a query skips what lies in its own component
    and what the sum of coordinate minima rules out. Classes that this leaves together are a group; points of more
    coordinates, as many as large sets need, part it again, and the texts of what stays together go to one task, which checks pairs of different components by their whole sets and gives the links that join them, fewer than
    there are classes. Pivots with many classes or large sets go to several tasks in blocks, and of the largest component
    only the others' pairs with it are looked at.
    No link is lost: prefixes and minima are bounds, and nothing is capped.

    A text of fewer words has them all as its one shingle. Null, empty or blank text has none: n_shingles is 0, the
    component its own doc_id. A row without a doc_id is counted but not linked, and its component is null. Rows that
    repeat a doc_id are compared by text and share the smallest id they reach. Shingles are 64-bit hashes, equality of sets is 128 bits.
    Empty in, empty out; other columns aren't looked at.
    """
    ratio = Ratio(num, den)
    docs = with_columns(docs, doc_id="long", text="string")
    table = materialise(described(docs, words, ratio), "sets")
    full = table.where("n > 0 and doc_id is not null")
    classes = full.groupBy("sig").agg(F.min_by(F.struct("doc_id", "n", "point", "fine", "prefix"), "doc_id").alias("r"))
    classes = materialise(classes.select(F.monotonically_increasing_id().alias("cid"), "sig", "r.*"), "classes")
    whole, table = table, materialise(table.select("doc_id", "n", "sig"), "ids")
    discard(whole)
    entries = classes.select("cid", F.explode("prefix").alias("token")).repartition("token")  # one shuffle for both uses
    shared = entries.groupBy("token").agg(F.min("cid").alias("pivot"), F.max("cid").alias("last")).where("pivot < last").select("token", "pivot")
    members = materialise(entries.join(shared, "token").select("pivot", "cid").distinct(), "members")
    slim = classes.select("cid", "n", "point")
    stars = members.where("cid <> pivot")
    stars = stars.join(slim, "cid").join(slim.select(F.col("cid").alias("pivot"), F.col("n").alias("p_n"), F.col("point").alias("p_point")), "pivot")
    stars = stars.where(F.expr(f"{den} * n >= {num} * p_n and {den} * p_n >= {num} * n"))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = np.minimum(points(batch.column("point")), points(batch.column("p_point"))).sum(axis=1)
            total = batch.column("n").to_numpy() + batch.column("p_n").to_numpy()
            yield batch.select(["pivot", "cid"]).filter(pa.array(most >= ratio.least_overlap(total))).rename_columns(["a", "b"])

    def fine_bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a_n, a_fine, b_n, b_fine = (batch.column(c).to_pylist() for c in ("a_n", "a_fine", "b_n", "b_fine"))
            most = np.array([most_shared(fine_point(a, m), fine_point(b, n)) for a, m, b, n in zip(a_fine, a_n, b_fine, b_n)], dtype=np.int64)
            total = batch.column("a_n").to_numpy() + batch.column("b_n").to_numpy()
            yield batch.select(["a", "b"]).filter(pa.array(most >= ratio.least_overlap(total)))

    fine = classes.select("cid", "n", F.coalesce("fine", "point").alias("fine"))
    stars = materialise(stars.mapInArrow(bounded, "a long, b long"), "stars")
    stars = stars.join(fine.toDF("a", "a_n", "a_fine"), "a").join(fine.toDF("b", "b_n", "b_fine"), "b").mapInArrow(fine_bounded, "a long, b long")
    links = materialise(verified(materialise(stars, "pairs"), classes, docs, words, ratio), "links")
    first = materialise(components(links), "first")

    grouped = members.join(first.withColumnRenamed("node", "cid"), "cid", "left").select("pivot", "cid", F.coalesce("root", "cid").alias("comp"))
    counts = grouped.join(classes.select("cid", "n"), "cid").groupBy("pivot", "comp").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    tops = counts.groupBy("pivot").agg(F.max_by(F.struct("comp", "k", "n"), F.struct("k", "comp")).alias("t"), F.sum("k").alias("all_k"), F.sum("n").alias("all_n")).where("all_k > t.k")
    blocks = lambda k, n: F.ceil(F.greatest(k / BLOCK, n / BLOCK_SHINGLES)).cast("int")
    one = (F.col("all_k") <= BLOCK) & (F.col("all_n") <= BLOCK_SHINGLES)  # a block of all, without a top
    parts = tops.select("pivot", F.when(~one, F.col("t.comp")).alias("top"), blocks(F.col("t.k"), F.col("t.n")).alias("n_top"), F.when(one, 1).otherwise(blocks(F.col("all_k") - F.col("t.k"), F.col("all_n") - F.col("t.n"))).alias("n_rest"))
    dealt = grouped.join(parts, "pivot").join(slim, "cid").withColumn("h", F.xxhash64("cid"))
    # x: a block of the rest; y: 0.. blocks of the rest, -1.. blocks of the largest component
    top = dealt.where("comp = top").withColumn("y", -1 - F.pmod("h", "n_top")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("n_rest") - 1))).withColumn("side", F.lit(0))
    rest = dealt.where("top is null or comp <> top").withColumn("own", F.pmod("h", "n_rest").cast("int"))
    with_top = rest.where("top is not null").withColumn("y", F.explode(F.sequence(-F.col("n_top"), F.lit(-1)))).withColumn("x", F.col("own")).withColumn("side", F.lit(1))
    among = rest.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n_rest") - 1))).withColumn("x", F.least("own", "o")).withColumn("y", F.greatest("own", "o")).withColumn("side", (F.col("own") != F.col("x")).cast("int"))
    names = ["pivot", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "cid", "side", "comp", "n", "point"]
    queries = top.select(*names).unionByName(with_top.select(*names)).unionByName(among.select(*names))
    queries = queries.repartition("pivot", "x", "y").sortWithinPartitions("pivot", "x", "y")
    groups = queries.mapInArrow(lambda batches: tree_groups(batches, ratio), "key long, cid long, side int, comp long").distinct()
    groups = materialise(groups, "groups").join(fine, "cid").repartition("key").sortWithinPartitions("key")
    groups = groups.mapInArrow(lambda batches: refined(batches, ratio), "key long, cid long, side int, comp long").distinct()
    late = joined(materialise(groups, "parts"), classes, docs, words, ratio)
    roots = components(links.unionByName(late))
    named = classes.select("cid", "sig", "doc_id").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    ids = named.groupBy("root").agg(F.min("doc_id").alias("component"))
    reached = named.join(ids, "root").select("sig", "component")
    out = table.select("doc_id", F.col("n").alias("n_shingles"), "sig").join(reached, "sig", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))).alias("component_id"))
