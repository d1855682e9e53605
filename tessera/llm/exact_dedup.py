"""Exact duplicates by Patricia-trie owners."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import with_columns
from .textkit import raw

WHITE = b" \t\n\x0b\x0c\r"
RESIDENT = 32 << 20  # bytes of text that a task's trie holds before it hands subtrees on


class Node:
    __slots__ = ("kids", "label", "owner")

    def __init__(self, label: bytes, owner: list | None = None) -> None:
        self.label, self.kids, self.owner = label, {}, owner


class Trie:
    """Compressed radix trie of byte strings none of which is another's prefix.

    Every leaf stores its owner: [code points, doc_id, rows], the first two of the row that stays.
    """

    def __init__(self) -> None:
        self.root, self.held, self.total = Node(b""), {}, 0

    def add(self, key: bytes, points: int, doc: int | None, rows: int) -> None:
        node, at = self.root, 0
        while True:
            edge = node.kids.get(key[at])
            if edge is None:
                node.kids[key[at]] = Node(key[at:], [points, doc, rows])
                self.held[key[0]] = self.held.get(key[0], 0) + len(key)
                self.total += len(key)
                return
            label = edge.label
            if key.startswith(label, at):
                at += len(label)
                node = edge
                if edge.owner is not None:
                    break
                continue
            same = 0
            while label[same] == key[at + same]:
                same += 1
            fork = Node(label[:same])
            edge.label = label[same:]
            fork.kids[edge.label[0]] = edge
            node.kids[key[at]] = fork
        owner = node.owner
        if (-points, doc is None, doc or 0) < (-owner[0], owner[1] is None, owner[1] or 0):
            owner[0], owner[1] = points, doc
        owner[2] += rows

    def pop(self, first: int | None = None) -> Iterator[tuple[bytes, list]]:
        """Leaves of the subtree under a first byte, or of all, which leave the trie."""
        stack = [(b"", self.root.kids.pop(first))] if first is not None else [(b"", x) for x in self.root.kids.values()]
        self.total -= self.held.pop(first) if first is not None else self.total
        if first is None:
            self.root, self.held = Node(b""), {}
        while stack:
            before, node = stack.pop()
            key = before + node.label
            if node.owner is not None:
                yield key, node.owner
            stack += [(key, x) for x in node.kids.values()]

    def largest(self) -> int:
        return max(self.held, key=self.held.get)


OWNED = pa.schema([("sha", pa.binary()), ("n_bytes", pa.int64()), ("body", pa.binary()), ("points", pa.int64()), ("doc", pa.int64()), ("n_rows", pa.int64())])
PLACED = pa.schema([("doc_id", pa.int64()), ("sha", pa.binary()), ("points", pa.int64())])


def bodies(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes, int]]:
    """doc_id, text without white space in UTF-8, code points of the text as it was."""
    offsets, data = raw(batch.column("text"))
    view = memoryview(data)
    points = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()
    for k, doc in enumerate(batch.column("doc_id").to_pylist()):
        yield doc, bytes(view[offsets[k] : offsets[k + 1]]).translate(None, WHITE), points[k]


def leaves(found: Iterator[tuple[bytes, list]]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for key, (points, doc, n) in found:
        rows.append((key[:32], len(key) - 40, key[40:], points, doc, n))
        size += len(key)
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), OWNED.types)], schema=OWNED)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), OWNED.types)], schema=OWNED)


def local_owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each text of the partition; beyond RESIDENT the largest subtree goes on to the shuffle."""
    trie = Trie()
    for batch in batches:
        for doc, body, points in bodies(batch):
            sha = hashlib.sha256(body).digest()
            trie.add(sha + len(body).to_bytes(8, "big") + body, points, doc, 1)
            while trie.total > RESIDENT:
                yield from leaves(trie.pop(trie.largest()))
    yield from leaves(trie.pop())


def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(doc, hashlib.sha256(body).digest(), points) for doc, body, points in bodies(batch)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 3, PLACED.types)], schema=PLACED)


def merged_owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by hash and length, so a subtree is whole, and leaves, when its prefix ends."""
    trie, now = Trie(), None

    def whole() -> Iterator[tuple[bytes, list]]:
        found = list(trie.pop())
        if len(found) > 1:
            raise ValueError("two texts share length and SHA-256")
        return iter([(key[:40], owner) for key, owner in found])

    done: list[tuple[bytes, list]] = []
    for batch in batches:
        for sha, size, body, points, doc, n in zip(*(c.to_pylist() for c in batch.columns)):
            prefix = sha + size.to_bytes(8, "big")
            if prefix != now:
                done += whole()
                now = prefix
            trie.add(prefix + body, points, doc, n)
        yield from leaves(iter(done))
        done = []
    yield from leaves(whole())


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Texts equal without white space form a group; one row per document tells which row of its group stays.

    Tasks insert whole byte strings into radix tries under their hash and length, so that a partition sends each text
    on once however many copies it has; the shuffle by hash brings the rest together, and tries there hold one hash
    and length at a time. Null text counts as empty, and empty texts are equal. Of equal texts the row with the most
    code points stays, then the smallest doc_id; a null doc_id comes last. Rows that repeat a doc_id and a text all
    carry the same answer. An empty table gives an empty result; other columns are not looked at.
    """
    docs = with_columns(docs, doc_id="long", text="string")
    types = "sha binary, n_bytes long, body binary, points long, doc long, n_rows long"
    local = docs.mapInArrow(local_owners, types)
    owners = local.repartition("sha").sortWithinPartitions("sha", "n_bytes").mapInArrow(merged_owners, types)
    owners = owners.select("sha", F.col("doc").alias("keep_id"), F.col("n_rows").alias("group_size"), F.col("points").alias("most"))
    rows = docs.mapInArrow(placed, "doc_id long, sha binary, points long")
    return rows.join(owners, "sha").select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("most"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
