"""Edit-aware token counts: segment trees over the pre-tokens of each document."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Pre-tokens of the byte-level vocabularies. Fixed value: the public pattern that they were made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEAF = 32  # pre-tokens of a leaf when a tree is built
#: So many characters after its end can decide what a pre-token is; those that end this far before an edit stay.
AHEAD = 3
MOST_CACHED = 400_000  # pre-tokens whose counts a worker remembers


class Counter:
    """Tokens of a pre-token, by byte-pair encoding; remembers those it has seen."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        import regex
        import tiktoken

        self.find = regex.compile(pattern).finditer
        self.all = regex.compile(pattern).findall
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, int] = {}

    def __call__(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = len(self.encode(piece))
            if len(self.known) >= MOST_CACHED:
                self.known.clear()
            if len(piece) < 64:
                self.known[piece] = n
        return n


class SegmentTree:
    """Sums of characters, tokens and pre-tokens over leaves; node k has the children 2k and 2k+1."""

    def __init__(self, leaves: np.ndarray) -> None:
        self.size = 1 << max(0, (len(leaves) - 1).bit_length())
        self.sums = np.zeros((2 * self.size, 3), dtype=np.int64)
        self.sums[self.size : self.size + len(leaves)] = leaves
        at = self.size
        while at > 1:
            self.sums[at // 2 : at] = self.sums[at : 2 * at : 2] + self.sums[at + 1 : 2 * at : 2]
            at //= 2

    def leaf(self, char: int) -> tuple[int, int]:
        """The leaf that has a character (the last one for the end of the text), and the leaf's first character."""
        k, start = 1, 0
        while k < self.size:
            k *= 2
            if char >= start + self.sums[k, 0] and self.sums[k + 1, 0]:
                start += int(self.sums[k, 0])
                k += 1
        return k - self.size, start

    def set(self, leaf: int, values: tuple[int, int, int]) -> None:
        k = self.size + leaf
        change = np.array(values) - self.sums[k]
        while k:
            self.sums[k] += change
            k //= 2

    def leaves(self) -> np.ndarray:
        return self.sums[self.size :]


def build(text: str, count: Counter) -> np.ndarray:
    """Characters, tokens and pre-tokens of each leaf."""
    pieces = count.all(text)
    if not pieces:
        return np.zeros((1, 3), dtype=np.int64)
    each = np.array([(len(p), count(p), 1) for p in pieces], dtype=np.int64)
    return np.add.reduceat(each, np.arange(0, len(each), LEAF))


def edit(text: str, tree: SegmentTree, at: int, removed: int, inserted: str, count: Counter) -> tuple[str, int]:
    """The text after the edit, and how many pre-tokens were encoded anew; the tree then has the new text's counts.

    Encoding starts at the leaf that holds the last character which can't feel the edit and ends where a pre-token ends
    at an old leaf's end beyond it: from there on the old pre-tokens stand, as a pre-token depends on nothing before it.
    """
    at = min(max(at, 0), len(text))
    end = min(len(text), at + max(removed, 0))
    after = text[:at] + inserted + text[end:]
    shift = len(after) - len(text)
    first, start = tree.leaf(max(0, at - AHEAD - 1))
    last, begin = tree.leaf(end)
    stop = begin + int(tree.leaves()[last, 0])
    total, pieces, here = 0, 0, start
    for m in count.find(after, start):
        here = m.end()
        total += count(m[0])
        pieces += 1
        while stop + shift < here and last + 1 < tree.size and stop < len(text):
            last += 1
            stop += int(tree.leaves()[last, 0])
        if here == stop + shift and here >= at + len(inserted):
            break
    else:
        last = tree.size - 1
    for leaf in range(first + 1, last + 1):
        if tree.leaves()[leaf, 0]:
            tree.set(leaf, (0, 0, 0))
    tree.set(first, (here - start, total, pieces))
    return after, pieces


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


EDITS = "array<struct<at:int,removed:int,inserted:string>>"


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """Per document: doc_id, n_tokens, and its tree's leaves (``leaf_chars``, ``leaf_tokens``, ``leaf_pieces``), which
    ``edited_counts`` takes. With a column ``edits`` (array of at, removed, inserted, in code points) its rows go on too.

    The driver reads the vocabulary file. Null text is empty: 0 tokens and one empty leaf. Texts are read whole. A row
    gives a row, repeated ones too; a null doc_id stays. Empty in, empty out; other columns aren't looked at.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(vocabulary))  # a vocabulary's size is fixed
    edits = F.col("edits").cast(EDITS) if "edits" in docs.columns else F.lit(None).cast(EDITS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), edits.alias("edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(ranks.value, pattern)
        for batch in batches:
            trees = [build(t, count) for t in batch.column("text").to_pylist()]
            sides = [pa.array([t[:, k].tolist() for t in trees], pa.list_(pa.int64())) for k in range(3)]
            total = pa.array([int(t[:, 1].sum()) for t in trees], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, total, *sides], [*batch.schema.names, "n_tokens", "leaf_chars", "leaf_tokens", "leaf_pieces"])

    longs = "array<long>"
    return rows.mapInArrow(run, f"doc_id long, text string, edits {EDITS}, n_tokens long, leaf_chars {longs}, leaf_tokens {longs}, leaf_pieces {longs}")


def edited_counts(trees: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """The rows of ``token_counts`` after their edits, one after the other: text and leaves anew, n_tokens, n_before (the
    count before), n_pieces (all pre-tokens) and n_encoded (pre-tokens that the edits encoded anew).

    Only leaves that an edit touches, and the boundary that can feel it, are encoded; the sums on their paths change.
    An edit beyond the text is an insertion at its end; null numbers are 0, a null insertion is empty, null edits are none.
    """
    spark = trees.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(ranks.value, pattern)
        for batch in batches:
            rows: list[tuple] = []
            for row in batch.to_pylist():
                tree = SegmentTree(np.array([row["leaf_chars"], row["leaf_tokens"], row["leaf_pieces"]], dtype=np.int64).T)
                text, encoded = row["text"], 0
                for e in row["edits"] or ():
                    if e is not None:
                        text, n = edit(text, tree, e["at"] or 0, e["removed"] or 0, e["inserted"] or "", count)
                        encoded += n
                sums = tree.sums[1].tolist()
                rows.append((row["doc_id"], text, row["n_tokens"], sums[1], sums[2], encoded, *tree.leaves().T.tolist()))
            kinds = [pa.int64(), pa.string(), *[pa.int64()] * 4, *[pa.list_(pa.int64())] * 3]
            names = ["doc_id", "text", "n_before", "n_tokens", "n_pieces", "n_encoded", "leaf_chars", "leaf_tokens", "leaf_pieces"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 9, kinds)], names)

    return trees.mapInArrow(run, "doc_id long, text string, n_before long, n_tokens long, n_pieces long, n_encoded long, leaf_chars array<long>, leaf_tokens array<long>, leaf_pieces array<long>")
