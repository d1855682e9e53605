"""Mixing overlapping sources to target weights by min-cost flow."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise

WORDS = r"[^\x20\x09-\x0D]+"
MOST_PATTERNS = 200_000  # membership patterns that the driver solves; documents aren't collected


def targets(sizes: list[int], weights: list[int], most: int) -> list[float]:
    """Shares of the total by weight; a share stops at ``most`` times its size and the excess goes to the others by weight."""
    left, weight = sum(sizes), sum(weights)
    out = [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda k: (most * sizes[k] / weights[k], k))
    for place, k in enumerate(order):
        if most * sizes[k] * weight > left * weights[k]:
            for j in order[place:]:
                out[j] = left * weights[j] / weight
            break
        out[k] = float(most * sizes[k])
        left, weight = left - most * sizes[k], weight - weights[k]
    return out


def route(capacity: list[int], members: list[list[int]], quotas: list[int], most: int) -> list[list[int]]:
    """Words from each pattern to each of its sources: a flow of largest size and, of these, of least cost.

    A pattern's k-th repetition costs more than its (k-1)-th, for all patterns alike. So repetitions open one after
    the other, and each level is filled by augmenting paths that may reroute what earlier levels sent, but not take it
    back; a flow built thus is optimal, since what patterns can send forms a polymatroid.
    """
    sent = [[0] * len(m) for m in members]
    left = list(quotas)
    by_source: dict[int, list[tuple[int, int]]] = {}
    for p, m in enumerate(members):
        for j, s in enumerate(m):
            by_source.setdefault(s, []).append((p, j))
    for _ in range(most):
        for p, room in enumerate(capacity):
            while room > 0:
                came: dict[int, tuple[int, int]] = {}  # source: the pattern and slot that would send to it
                gave: dict[int, tuple[int, int]] = {}  # pattern: the source, and its slot, from which it would take back
                queue, end = deque([p]), -1
                while queue and end < 0:
                    q = queue.popleft()
                    for j, s in enumerate(members[q]):
                        if s in came:
                            continue
                        came[s] = (q, j)
                        if left[s] > 0:
                            end = s
                            break
                        for other, slot in by_source[s]:
                            if other != p and other not in gave and sent[other][slot] > 0:
                                gave[other] = (s, slot)
                                queue.append(other)
                if end < 0:
                    break
                path, s, amount = [], end, min(room, left[end])
                while True:
                    q, j = came[s]
                    path.append((q, j, 1))
                    if q == p:
                        break
                    s, slot = gave[q]
                    path.append((q, slot, -1))
                    amount = min(amount, sent[q][slot])
                for q, j, sign in path:
                    sent[q][j] += sign * amount
                left[end] -= amount
                room -= amount
    return sent


def mix_sources(
    docs: DataFrame, memberships: Column | None = None, cycle: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix", weights: dict[str | None, int] | None = None
) -> DataFrame:
    """How many words of each document a mix takes that gives each source its target share.

    ``memberships``: array of the sources that a document belongs to; by default the one in ``source``. Sizes are word
    counts. Sources in order of code points, null last, weigh ``cycle`` again and again unless ``weights`` says. Targets
    stop at ``most`` times a source's size, and the excess is shared anew. Documents are summed by pattern of
    membership; the driver routes the patterns' words to the sources (see ``route``), so that no text is repeated while
    others are unused. Each document then is taken as often as its pattern is whole, and the rest goes to documents in
    a seeded order of their ids, the last of them in part, so a source gets its target but for less than a word.

    Null text has size 0; a null source is one of its own; a document in no source counts as of the null source. Rows
    that repeat an id are documents of their own. An empty table gives an empty result. Columns beside doc_id, text and
    source aren't looked at. More than ``MOST_PATTERNS`` patterns raise ValueError.
    """
    own = F.coalesce(F.array_sort(F.array_distinct(memberships)), F.array(F.lit(None).cast("string"))) if memberships is not None else F.array(F.col("source").cast("string"))
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(F.size(own) > 0, own).otherwise(F.array(F.lit(None).cast("string"))).alias("pattern"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORDS)).cast("long").alias("size"),
    )
    sized = sized.withColumn("turn", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    sized = materialise(sized, "mix")
    found = sized.groupBy("pattern").agg(F.sum("size").alias("size")).limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    patterns = sorted(((list(r["pattern"]), r["size"]) for r in found), key=lambda r: [(s is None, (s or "").encode()) for s in r[0]])
    names = sorted({s for m, _ in patterns for s in m}, key=lambda s: (s is None, (s or "").encode()))
    place = {s: k for k, s in enumerate(names)}
    sizes = [0] * len(names)
    for m, n in patterns:
        for s in m:
            sizes[place[s]] += n
    weigh = [weights[s] if weights else cycle[k % len(cycle)] for k, s in enumerate(names)]
    goal = targets(sizes, weigh, most)
    flow = route([n for _, n in patterns], [[place[s] for s in m] for m, _ in patterns], [int(t) for t in goal], most)
    spark = docs.sparkSession
    rows = [
        (m, [sizes[place[s]] for s in m], [goal[place[s]] for s in m], *(divmod(sum(sent), n) if n else (0, 0)))
        for (m, n), sent in zip(patterns, flow, strict=True)
    ]
    plan = spark.createDataFrame(rows, "pattern array<string>, source_sizes array<long>, targets array<double>, whole long, rest long")
    bucket = F.substring("turn", 1, 4)
    by = Window.partitionBy("pattern").orderBy("bucket")
    cut = sized.groupBy("pattern", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
    cut = cut.withColumn("upto", F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    cut = cut.join(plan.select("pattern", "rest"), "pattern").where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("n") <= F.col("rest")))
    cut = cut.groupBy("pattern").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before")), "bucket").alias("cut"))
    plan = plan.join(cut, "pattern", "left")
    all_docs = sized.join(plan, "pattern")
    at_cut = F.coalesce(bucket == F.col("cut.bucket"), F.lit(False))
    sure = all_docs.where(~at_cut).withColumn("more", F.when(F.coalesce(bucket < F.col("cut.bucket"), F.lit(False)), F.col("size")).otherwise(F.lit(0)))
    turn = Window.partitionBy("pattern").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = all_docs.where(at_cut).withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("cut.before") - F.sum("size").over(turn) + F.col("size"))))
    return sure.unionByName(edge).select(
        "doc_id", "size", F.element_at("source_sizes", 1).alias("source_size"), F.element_at("targets", 1).alias("target"),
        (F.col("size") * F.col("whole") + F.col("more")).cast("long").alias("taken"), F.col("pattern").alias("sources"),
    )
