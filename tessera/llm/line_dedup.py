"""Line deduplication by pairwise alignment."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import free_name, materialise

LEAST_WORDS = 5  # words that an aligned block must have to be deleted
WORDS = r"[^\x20\x09-\x0D]+"


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence, of pairs sorted by their first, whose second rises."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, b) in enumerate(pairs):
        i = bisect_left(tails, b)
        back[k] = at[i - 1] if i else -1
        tails[i : i + 1] = [b]
        at[i : i + 1] = [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of equal lines.

    Between two anchors: equal lines at both ends align; then the lines that are unique on both sides and equal, in the
    longest order that both share, are anchors of their own. Where no line is unique, those of the same occurrence from
    the start (first with first, second with second) stand in for unique ones.
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        ca, cb = Counter(a[alo:ahi]), Counter(b[blo:bhi])
        where = {b[j]: j for j in range(blo, bhi) if cb[b[j]] == 1}
        anchors = rising([(i, where[a[i]]) for i in range(alo, ahi) if ca[a[i]] == 1 and a[i] in where])
        if not anchors:
            nth: dict[int, list[int]] = {}
            for j in range(blo, bhi):
                nth.setdefault(b[j], []).append(j)
            seen: Counter = Counter()
            pairs = []
            for i in range(alo, ahi):
                same = nth.get(a[i], ())
                if seen[a[i]] < len(same):
                    pairs.append((i, same[seen[a[i]]]))
                seen[a[i]] += 1
            out += rising(pairs)
            continue
        out += anchors
        for (i, j), (p, q) in zip([(alo - 1, blo - 1), *anchors], [*anchors, (ahi, bhi)]):
            todo.append((i + 1, p, j + 1, q))
    return sorted(out)


def runs(words: list[int], least: int) -> list[tuple[int, int]]:
    """First and last line of the shortest runs, from each line that has words on and back, that have ``least`` words.

    A block of neighbouring lines with so many words is covered, but for lines without words at its ends, by runs in it.
    """
    at = [k for k, n in enumerate(words) if n > 0]
    out, b, n = set(), 0, 0
    for a, k in enumerate(at):  # from line k on
        while b < len(at) and (n < least or b <= a):
            n += words[at[b]]
            b += 1
        if n < least:
            break
        out.add((k, at[b - 1]))
        n -= words[k]
    a = n = 0
    for b, k in enumerate(at):  # back from line k
        n += words[k]
        while a < b and n - words[at[a]] >= least:
            n -= words[at[a]]
            a += 1
        if n >= least:
            out.add((at[a], k))
    return sorted(out)


def doomed(mine: list[int], other: list[int], words: list[int], least: int) -> list[int]:
    """Lines of ``mine`` in blocks that align with ``other`` without a gap and have enough words, and in blocks that moved."""
    out, block, last = [], [], (-2, -2)
    for i, j in [*patience(mine, other), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(words[k] for k in block) >= least:
                out += block
            block = []
        block.append(i)
        last = (i, j)
    gone = set(out)
    if left := [(i, j) for i, j in runs(words, least) if not gone.issuperset(range(i, j + 1))]:
        size, held, lo = dict(zip(mine, words)), set(), 0
        for hi in [*(k for k, x in enumerate(other) if x not in size), len(other)]:
            held |= {tuple(other[lo + i : lo + j + 1]) for i, j in runs([size[x] for x in other[lo:hi]], least)}
            lo = hi + 1
        for i, j in left:
            if tuple(mine[i : j + 1]) in held:
                gone.update(range(i, j + 1))
    return sorted(gone)


def run_rows(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Each document's distinct runs, as hashes of their lines' other hashes."""
    for batch in batches:
        rows: list[tuple[int, int, int]] = []
        for doc, key, lines, words in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "others", "words"))):
            rows += [(doc, key, run) for run in {lines[i] if i == j else hash(tuple(lines[i : j + 1])) for i, j in runs(words, least)}]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * 3)], ["doc_id", "key", "run"])


def aligned(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys, lines = [], [], []
        for doc, key, mine, words, other in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "lines", "words", "earlier"))):
            if cut := doomed(mine, other, words, least):
                ids.append(doc)
                keys.append(key)
                lines.append(cut)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(lines, pa.list_(pa.int32()))], ["doc_id", "key", "cut"])


def text_key() -> Column:
    """A document is known by doc_id and this hash of its text, as rows may repeat a doc_id."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def repeated_lines(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, key (see ``text_key``), cut: the lines of each document, from 0, that an earlier document also has.

    Documents meet by rare lines they share. A line of fewer than ``least`` words is seldom rare, so it is taken together with its
    neighbours, the fewest that make a run of ``least`` words. A run's owner is the document of
    smallest doc_id that has it; a document is aligned with each earlier one that owns one of its runs, by hashes of the
    lines without white space at their ends. A block with so many words is made of runs, and each run's owner holds it
    whole: so no block is lost, whatever order blocks stand in. Pairs are as many as the runs that repeat, at most,
    however often one does, and no frequency is left out. Only line hashes travel, not texts: 64 bits by which documents meet and
    64 others by which lines are equal, so that a line goes by mistake only where both collide.
    """
    body = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n", -1)
    bare = F.transform(body, lambda x: F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""))
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), bare.alias("bare"), F.transform(body, lambda x: F.regexp_count(x, F.lit(WORDS))).alias("words"))
    table = rows.select("doc_id", "key", F.transform("bare", lambda x: F.xxhash64(x)).alias("lines"), F.transform("bare", lambda x: F.xxhash64(F.lit("other"), x)).alias("others"), "words")
    table = materialise(table.dropDuplicates(["doc_id", "key"]), "lines")
    each = table.select("doc_id", "key", "others", "words").mapInArrow(lambda b: run_rows(b, least), "doc_id long, key long, run long")
    owners = each.groupBy("run").agg(F.min(F.struct("doc_id", "key")).alias("owner"), F.max("doc_id").alias("last")).where("owner.doc_id < last").select("run", F.col("owner.doc_id").alias("first"), F.col("owner.key").alias("owner"))
    pairs = each.join(owners, "run").where("first < doc_id").select("doc_id", "key", "first", "owner").distinct()
    both = pairs.join(table.select("doc_id", "key", "lines", "words"), ["doc_id", "key"]).join(table.select(F.col("doc_id").alias("first"), F.col("key").alias("owner"), F.col("lines").alias("earlier")), ["first", "owner"])
    found = both.select("doc_id", "key", "lines", "words", "earlier").mapInArrow(lambda b: aligned(b, least), "doc_id long, key long, cut array<int>")
    return found.groupBy("doc_id", "key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("cut")))).alias("cut"))


def line_dedup(docs: DataFrame, least: int = LEAST_WORDS, name: str = "n_removed") -> DataFrame:
    """Every row of ``docs``, its text without the lines that an earlier document has too, and ``name``, how many.

    See ``repeated_lines``. Of documents that share lines the one of smallest doc_id keeps them. Deleted are whole
    blocks of lines, aligned one after the other in both documents, of ``least`` words or more in all; shorter ones are
    chance. Lines left stay as they are, joined by \\n; a text without such lines stays the same, null stays null. A
    null doc_id has no order: its row is neither changed nor compared. Rows that repeat a doc_id don't
    delete from one another. Two rows alike in doc_id and text change alike. A column called ``name`` is replaced, all others stay.
    Empty in, empty out.
    """
    docs = docs.drop(name)
    owner, key, cut, lines = (free_name(docs, x) for x in ("owner_id", "text_key", "cut_lines", "text_lines"))
    cuts = repeated_lines(docs.select("doc_id", "text"), least).select(F.col("doc_id").alias(owner), F.col("key").alias(key), F.col("cut").alias(cut))
    keyed = docs.withColumns({owner: F.col("doc_id").cast("long"), key: F.when(F.col("doc_id").isNotNull(), text_key())})
    joined = keyed.join(cuts, [owner, key], "left").withColumn(lines, F.split("text", "\n", -1))
    gone = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(cut))
    left = F.array_join(F.transform(gone, lambda k: F.get(lines, k)), "\n")
    text = F.when(F.col(cut).isNull(), F.col("text")).otherwise(left)
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], F.when(F.col(cut).isNull(), 0).otherwise(F.size(cut)).alias(name))
