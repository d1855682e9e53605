"""Benchmark decontamination: rare seeds that no passage is without, then Smith-Waterman alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import with_columns
from .textkit import LOWER, chunks, give_back, hash_spans, ngrams, pieces, raw, spans

LEAST_WORDS = 3  # an item of fewer words must be there whole, and is no passage that a document goes for
LEAST_SCORE = 0.5  # of the score that the whole item aligned with itself has
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK = 8 << 20  # bytes of benchmark text that tasks hold at a time; more is done block by block
CELLS = 1 << 19  # words of windows that are compared with an item at a time

#: Words are runs of ASCII letters and digits and of other bytes than ASCII: punctuation is no difference.
NO_WORD = np.ones(256, dtype=bool)
NO_WORD[48:58] = NO_WORD[65:91] = NO_WORD[97:123] = NO_WORD[128:] = False


def plain_words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, row = spans(offsets, data, NO_WORD)
    return hash_spans(LOWER[data], starts, ends), row


def folded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of texts in lower case, letters beyond ASCII too."""
    try:
        return raw(pc.utf8_lower(column))
    except pa.ArrowInvalid:  # bytes that aren't UTF-8
        texts = [None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.large_binary()).to_pylist()]
        return raw(pc.utf8_lower(pa.array(texts, pa.large_string())))


def grams(words: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hash and first word's index of every word, and of every two words that are neighbours."""
    yield words, np.arange(len(words))
    yield ngrams(words, row, 2)


class Items:
    """Items of one block: words, ids, and where each word and pair of neighbouring words stands."""

    def __init__(self, rows: list[tuple[int | None, str]]) -> None:
        self.ids = [r[0] for r in rows]
        self.words, row = plain_words(*folded(pa.array([r[1] or "" for r in rows], pa.large_string())))
        self.first = np.searchsorted(row, np.arange(len(rows) + 1))
        self.pairs, self.pair_at = ngrams(self.words, row, 2)
        self.keys = np.unique(np.concatenate([self.words, self.pairs]))

    def seeded(self, count: np.ndarray, least: float) -> Items:
        """Chooses for each item the seeds, rarest by ``count``, of which any passage that scores ``least`` holds one.

        Of an item of n words let a passage match m and have e edits: 2m - e reaches s, the score asked for, so m is
        s/2 at least. Each edit parts at most one pair of matches, so m - 1 - e >= s - 1 - m pairs of neighbours are left
        whole. For any number k: if m > k, any n - k words of the item have one that matches; if not, any n - s + k + 1
        pairs have one that is whole. Each item takes the k whose seeds are fewest in the documents.
        """
        size = np.diff(self.first)
        self.need = np.where(size < LEAST_WORDS, MATCH * size, np.ceil(least * MATCH * size - 1e-9)).astype(np.int64)
        self.fewest = np.maximum(1, -(-self.need // MATCH))
        self.vocabulary, self.word = np.unique(self.words, return_inverse=True)
        n_word, n_pair = count[np.searchsorted(self.keys, self.words)], count[np.searchsorted(self.keys, self.pairs)]
        cut, gram, item, place = np.searchsorted(self.pair_at, self.first), [], [], []
        for k, (lo, hi, p, q) in enumerate(zip(self.first, self.first[1:], cut, cut[1:])):
            n, s = int(hi - lo), int(self.need[k])
            if not n:
                continue
            words, pairs = np.argsort(n_word[lo:hi], kind="stable"), np.argsort(n_pair[p:q], kind="stable")
            few = int(self.fewest[k])
            split = np.arange(few, min(s - 2, n) + 1)
            some, both = np.append(n - few + 1, n - split), np.append(0, n - s + split + 1)
            hits_word, hits_pair = np.append(0, np.cumsum(n_word[lo:hi][words])), np.append(0, np.cumsum(n_pair[p:q][pairs]))
            best = int(np.argmin(hits_word[np.clip(some, 0, n)] + hits_pair[np.clip(both, 0, n - 1)]))
            words, pairs = words[: max(0, some[best])], pairs[: max(0, both[best])]
            gram += [self.words[lo:hi][words], self.pairs[p:q][pairs]]
            place += [words, pairs]
            item.append(np.full(len(words) + len(pairs), k))
        gram, item, place = (np.concatenate(x) if x else np.zeros(0, dtype=t) for x, t in ((gram, np.uint64), (item, np.int64), (place, np.int64)))
        order = np.argsort(gram, kind="stable")
        self.gram, self.item, self.place = gram[order], item[order], place[order]
        return self

    def slack(self, k: int) -> int:
        """Words that a passage of the score needed may have beside the item's own."""
        return max(8, MATCH * int(self.first[k + 1] - self.first[k]) - int(self.need[k]))


class Finder:
    """Sorted n-grams behind a bitmap that turns most of a text's away."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, self.bits = keys, np.zeros(1 << 22, dtype=bool)
        self.bits[(keys >> np.uint64(42)).astype(np.int64)] = True

    def hits(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the n-grams are keys, and the key of each."""
        at = np.flatnonzero(self.bits[(gram >> np.uint64(42)).astype(np.int64)])
        if not len(self.keys) or not len(at):
            return at[:0], at[:0]
        key = np.minimum(np.searchsorted(self.keys, gram[at]), len(self.keys) - 1)
        good = self.keys[key] == gram[at]
        return at[good], key[good]


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int]:
    """Best local alignment of item a in passage b: score, first and last+1 word of b in it, words that match.

    A cell holds score, start and matches in one number, so that one row is enough: of alignments of one score the one that starts
    latest, then that of most matches, and the first end that reaches the best score.
    """
    start_at = len(a).bit_length()
    score_at = start_at + (len(b) + 1).bit_length()
    kind = np.int64 if score_at + (MATCH * len(a)).bit_length() < 63 else object
    columns = np.arange(len(b) + 1).astype(kind)
    step, fresh = columns * (-GAP << score_at), columns * (1 << start_at)  # fresh: an alignment that begins with the next word
    before, top, end = fresh, 0, 0
    for x in a:
        best = np.maximum(fresh, before + (GAP << score_at))
        best[1:] = np.maximum(best[1:], before[:-1] + np.where(b == x, (MATCH << score_at) + 1, MISMATCH << score_at).astype(kind))
        before = np.maximum.accumulate(best + step) - step
        at = int(before.argmax())
        if int(before[at]) >> score_at > top >> score_at:
            top, end = int(before[at]), at
    return top >> score_at, (top >> start_at) & ((1 << (score_at - start_at)) - 1), end, top & ((1 << start_at) - 1)


def scores(item: np.ndarray, passages: np.ndarray) -> np.ndarray:
    """Best local alignment's score of an item in each of many passages, one a row, as smith_waterman's."""
    step = np.arange(passages.shape[1] + 1, dtype=np.int32) * -GAP
    before, top = np.zeros((len(passages), len(step)), dtype=np.int32), np.zeros(len(passages), dtype=np.int32)
    for x in item:
        best = np.maximum(0, before + GAP)
        best[:, 1:] = np.maximum(best[:, 1:], before[:, :-1] + np.where(passages == x, MATCH, MISMATCH))
        before = np.maximum.accumulate(best + step, axis=1) - step
        top = np.maximum(top, before.max(axis=1))
    return top


def windows(word: np.ndarray, row: np.ndarray, items: Items, finder: Finder, vocabulary: Finder) -> Iterator[tuple[int, int, int, int]]:
    """Item, row, first and last+1 word of windows around seeds in which the item reaches the score it needs."""
    owner, begin, where = [], [], []
    for gram, at in grams(word, row):
        hit, _ = finder.hits(gram)
        a, b = np.searchsorted(items.gram, gram[hit], "left"), np.searchsorted(items.gram, gram[hit], "right")
        place, n = at[hit], b - a
        seed = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
        owner.append(items.item[seed])
        begin.append(np.repeat(place, n) - items.place[seed])
        where.append(row[np.repeat(place, n)])
    owner, begin, where = np.concatenate(owner), np.concatenate(begin), np.concatenate(where)
    if not len(owner):
        return
    size = np.diff(items.first)[owner]
    begin = begin // size  # seeds whose item would begin nearby share a window
    order = np.lexsort((begin, where, owner))
    owner, begin, where = owner[order], begin[order], where[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (begin[1:] != begin[:-1]) | (where[1:] != where[:-1])
    owner, begin, where = owner[new], begin[new], where[new]
    known = np.full(len(word), len(items.vocabulary))
    at, key = vocabulary.hits(word)
    known[at] = key
    slots = np.full(len(items.vocabulary) + 1, -1, dtype=np.int32)
    cut = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(owner)]):
        k = int(owner[lo])
        n, slack = int(items.first[k + 1] - items.first[k]), items.slack(k)
        own, mine, times = np.unique(items.word[items.first[k] : items.first[k + 1]], return_inverse=True, return_counts=True)
        slots[own] = np.arange(len(own))
        width = 2 * n - 1 + 2 * slack
        for x in range(lo, hi, max(1, CELLS // width)):
            y = min(hi, x + max(1, CELLS // width))
            start = begin[x:y] * n - slack
            left, right = np.searchsorted(row, where[x:y], "left"), np.searchsorted(row, where[x:y], "right")
            place = start[:, None] + np.arange(width)
            inside = (place >= left[:, None]) & (place < right[:, None])
            slot = np.where(inside, slots[known[np.clip(place, 0, len(word) - 1)]], -1)
            present = np.zeros((y - x, len(own) + 1), dtype=bool)
            present[np.arange(y - x)[:, None], slot] = True
            good = np.flatnonzero(present[:, :-1] @ times >= items.fewest[k])  # words of the item that could match at all
            good = good[scores(mine, slot[good]) >= items.need[k]]
            for g in good.tolist():
                yield k, int(where[x + g]), max(int(left[g]), int(start[g])), min(int(right[g]), int(start[g]) + width)
        slots[own] = -1


def matches(offsets: np.ndarray, data: np.ndarray, items: Items, finder: Finder, vocabulary: Finder, least: float) -> Iterator[tuple[int, int, float, int, int, int]]:
    """Row, item, score, first and last+1 word, words that match: the best passage of each row for each item."""
    for lo, _hi, off, part in chunks(offsets, data):
        word, row = plain_words(off, part)
        found: dict[tuple[int, int], list[list[int]]] = {}
        for k, r, x, y in windows(word, row, items, finder, vocabulary):
            mine = found.setdefault((r, k), [])
            if mine and x <= mine[-1][1]:
                mine[-1][1] = max(y, mine[-1][1])
            else:
                mine.append([x, y])
        for (r, k), some in sorted(found.items()):
            mine = items.words[items.first[k] : items.first[k + 1]]
            left, slack = int(np.searchsorted(row, r)), items.slack(k)
            best = (0.0, 0, 0, 0)
            for x, y in some:
                for p in range(x, y, 4 * len(mine) + 64):  # a long window in pieces that overlap by an item and its slack
                    q = min(y, p + 6 * len(mine) + 64 + 2 * slack)
                    score, start, end, same = smith_waterman(mine, word[p:q])
                    best = max(best, (score / (MATCH * len(mine)), left - p - start, p + end - left, same))
                    if q == y:
                        break
            if best[0] >= least:
                yield lo + r, k, best[0], -best[1], best[2], best[3]


def blocks(benchmark: DataFrame, least_words: int = 1) -> Iterator[Items]:
    """The items, some BLOCK bytes at a time, without the words of those that have fewer than ``least_words``."""
    rows, size = [], 0
    for item, text in with_columns(benchmark, item_id="long", text="string").toLocalIterator():
        few = least_words > 1 and len(plain_words(*folded(pa.array([text or ""], pa.large_string())))[0]) < least_words
        rows.append((item, "" if few else text))
        size += len((text or "").encode())
        if size > BLOCK:
            yield Items(rows)
            rows, size = [], 0
    yield Items(rows)


def seeded(docs: DataFrame, items: Items, least: float) -> Items:
    """Counts how often each of the items' words and pairs of words stands in the documents, and chooses each item's seeds."""
    spark, keys = docs.sparkSession, items.keys
    shared = spark.sparkContext.broadcast(keys)  # of one block

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value)
        total = np.zeros(len(finder.keys), dtype=np.int64)
        for batch in batches:
            for piece in pieces(batch):
                for _lo, _hi, off, part in chunks(*folded(piece.column("text"))):
                    for gram, _ in grams(*plain_words(off, part)):
                        total += np.bincount(finder.hits(gram)[1].astype(np.int64), minlength=len(total))
            give_back()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["gram", "n"])

    total = np.zeros(len(keys), dtype=np.int64)
    for gram, n in docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n")).collect():
        total[gram] = n
    return items.seeded(total, least)


def found(batches: Iterator[pa.RecordBatch], items: Items, least: float) -> Iterator[pa.RecordBatch]:
    """Rows of ``contamination``."""
    finder, vocabulary = Finder(np.unique(items.gram)), Finder(items.vocabulary)
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
    for batch in batches:
        for piece in pieces(batch):
            ids = piece.column("doc_id")
            rows = [(ids[r].as_py(), items.ids[k], *rest) for r, k, *rest in matches(*folded(piece.column("text")), items, finder, vocabulary, least)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["doc_id", "item_id", "score", "first_word", "end_word", "n_same"])
        give_back()


def clean(batches: Iterator[pa.RecordBatch], column: int, items: Items, least: float) -> Iterator[pa.RecordBatch]:
    """The rows without a match, a piece of text at a time: neither lower-cased nor kept texts of a whole batch are there at once."""
    finder, vocabulary = Finder(np.unique(items.gram)), Finder(items.vocabulary)
    for batch in batches:
        for piece in pieces(batch, column):
            keep = np.ones(piece.num_rows, dtype=bool)
            keep[[m[0] for m in matches(*folded(piece.column(column)), items, finder, vocabulary, least)]] = False
            yield piece.filter(pa.array(keep))
        give_back()


def contamination(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """One row for each document and item whose passage is in it, edited perhaps: the best alignment and where it is.

    score: Smith-Waterman score over words, as a share of the item's with itself; passages under ``least`` aren't
    listed. first_word and end_word: its place among the document's words, n_same: words that match. Case and
    punctuation don't count. Seeds are an item's rarest words and pairs of words, so many that no passage of score
    ``least`` is without (see ``Items.seeded``). Tasks hold ``BLOCK`` bytes of items at a time, and their texts stay where
    they are. A null or empty text has no passage; an item of one or two words is found where they stand unchanged, a null item or one
    without words never. A null doc_id is given as such. Repeated
    documents and items give repeated rows. Empty tables give an empty result.
    """
    docs = with_columns(docs, doc_id="long", text="string")
    types = "doc_id long, item_id long, score double, first_word long, end_word long, n_same long"
    out = None
    for items in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(seeded(docs, items, least))

        rows = docs.mapInArrow(lambda b, shared=shared: found(b, shared.value, least), types)
        out = rows if out is None else out.unionByName(rows)
    return out


def uncontaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` that hold no item's passage (see ``contamination``), with their columns; nothing is shuffled.

    Items of one or two words are no passages: they would take clean documents along.
    """
    names, texts = docs.columns, docs.select(F.col("text").cast("string").alias("text"))
    for items in blocks(benchmark, LEAST_WORDS):
        shared = docs.sparkSession.sparkContext.broadcast(seeded(texts, items, least))
        docs = docs.mapInArrow(lambda b, shared=shared: clean(b, names.index("text"), shared.value, least), T.StructType(docs.schema.fields))
    return docs
