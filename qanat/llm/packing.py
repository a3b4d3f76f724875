"""Problem 8: documents laid into containers of fixed capacity."""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qanat.llm.runtime import cut, ranked
from qanat.llm.tokens import with_tokens


def plan(sizes: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (item sizes, number of containers) that hold every item of 1..capacity tokens, given the number of items of each size.

    Items above a third of the capacity meet at most two to a container: each, largest first, takes the largest
    partner that fits. Smaller items, largest first, go where the least space that is enough is left. All items of a
    size are handled at once, so the work depends on the capacity and not on the number of documents.
    """
    left = dict(sorted((s, c) for s, c in sizes.items() if c > 0))
    if left and not 0 < min(left) <= max(left) <= capacity:
        raise ValueError("items must fit their containers")
    large = [s for s in left if 3 * s > capacity]
    small = [s for s in left if 3 * s <= capacity]
    gaps: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(items: tuple[int, ...], count: int) -> None:
        gaps.setdefault(capacity - sum(items), []).append((items, count))

    while large:
        s = large[-1]
        c = left[s]
        k = bisect.bisect_right(large, capacity - s) - 1
        if k >= 0 and large[k] == s and c < 2:
            k -= 1
        if k < 0:
            put((s,), c)
            large.pop()
            continue
        p = large[k]
        m = c // 2 if p == s else min(c, left[p])
        put((s, p), m)
        left[s] -= m
        left[p] -= m
        large = [x for x in large if left[x] > 0] if not left[s] or not left[p] else large
    order = sorted(gaps)
    for s in reversed(small):
        c = left[s]
        while c:
            k = bisect.bisect_left(order, s)
            if k == len(order):
                each = capacity // s
                if c >= each:
                    items, m = (s,) * each, c // each
                else:
                    items, m, each = (s,) * c, 1, c
                gap = capacity - sum(items)
                if gap not in gaps:
                    bisect.insort(order, gap)
                put(items, m)
                c -= m * each
                continue
            gap = order[k]
            items, m = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(k)
            use = min(c, m)
            for x, n in ((items, m - use), ((*items, s), use)):
                if n:
                    g = capacity - sum(x)
                    if g not in gaps:
                        bisect.insort(order, g)
                    put(x, n)
            c -= use
    return [(list(items), m) for gap in sorted(gaps) for items, m in gaps[gap]]


def _places(patterns: list[tuple[list[int], int]]) -> tuple[np.ndarray, ...]:
    """For each size, runs of its items' places: (size, first place, number of containers, first container, used)."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for items, m in patterns:
        used = sum(items)
        for s in items:
            rows.append((s, taken.get(s, 0), m, base, used))
            taken[s] = taken.get(s, 0) + m
        base += m
    rows.sort()
    return tuple(np.array([r[k] for r in rows], np.int64) for k in range(5))


def pieces(sized: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, size): a document above the capacity is cut into full pieces and a rest, any other is one piece; empty ones none."""
    full = F.floor(F.col("tokens") / capacity)
    count = (full + F.when(F.col("tokens") % capacity > 0, 1).otherwise(0)).cast("int")
    cut_up = sized.where("tokens > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), count - 1)))
    return cut_up.select("doc_id", "piece", F.least(F.lit(capacity).cast("bigint"), F.col("tokens") - F.col("piece").cast("bigint") * capacity).alias("size"))


def containers(documents: DataFrame, limits: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(limit_id, container_id, doc_id, piece, tokens, used, fill): every piece of every document, and its container.

    ``piece`` counts a document's pieces from 0; only a document above the capacity has several, all but the
    last of which fill a container. ``used`` is the container's total, ``fill`` its share of the capacity. Documents
    of no tokens (null or empty text) take no space and have no container: one row with null container, used and fill. Rows with null
    doc_id are no documents, a doc_id given twice is one. Limits with a null or non-positive size give no rows.

    The driver sees the number of items of each size only, at most ``container_tokens`` numbers; the plan's
    runs are broadcast. A document finds its container by its place among those of its size.
    """
    spark = documents.sparkSession
    sized = cut(with_tokens(documents.where("doc_id IS NOT NULL").select("doc_id", "text"), "text", vocabulary).groupBy("doc_id").agg(F.max("tokens").alias("tokens")))
    schema = "limit_id int, container_id bigint, doc_id bigint, piece int, tokens bigint, used bigint, fill double"
    out = spark.createDataFrame([], schema)
    for limit in limits.where("limit_id IS NOT NULL AND container_tokens > 0").orderBy("limit_id").collect():  # one row per container kind
        capacity, limit_id = int(limit.container_tokens), limit.limit_id
        items = pieces(sized, capacity)
        counts = {r.size: r.n for r in items.groupBy("size").agg(F.count("*").alias("n")).collect()}
        held = spark.sparkContext.broadcast(_places(plan(counts, capacity)))

        def assign(batches, held=held, capacity=capacity, limit_id=limit_id):
            size, first, count, base, used = held.value
            key = size * (1 << 42) + first
            for b in batches:
                s, rank = b.column("size").to_numpy(), b.column("rank").to_numpy()
                at = np.searchsorted(key, s * (1 << 42) + rank, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(s), limit_id, np.int32)), pa.array(base[at] + rank - first[at]), b.column("doc_id"), b.column("piece"), b.column("size"), pa.array(used[at]), pa.array(used[at] / capacity)],
                    ["limit_id", "container_id", "doc_id", "piece", "tokens", "used", "fill"],
                )

        placed = ranked(items.withColumn("key", F.struct("doc_id", "piece")), ["size"], "key").drop("key").mapInArrow(assign, schema)
        empty = sized.where("tokens = 0").selectExpr(f"{limit_id} AS limit_id", "CAST(NULL AS bigint) AS container_id", "doc_id", "0 AS piece", "tokens", "CAST(NULL AS bigint) AS used", "CAST(NULL AS double) AS fill")
        out = out.union(placed).union(empty)
    return out
