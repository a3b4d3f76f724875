"""Problem 9: documents drawn so that each source has its target share of all tokens."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qanat.llm.runtime import cut, mix
from qanat.llm.tokens import tidy, with_tokens

#: Documents that one task rounds, and residuals that one task combines.
LEAF, FAN_IN = 20_000, 64


def _uniform(seed: str, ids: list[int]) -> np.ndarray:
    """A number from 0 to 1 for each id."""
    start = np.uint64(int.from_bytes(hashlib.blake2b(seed.encode(), digest_size=8).digest(), "big"))
    return (mix(mix(np.array(ids, np.int64).view(np.uint64)) ^ start) >> np.uint64(11)) / 2.0**53


def pivotal(items, seed: str):
    """Rounds (id, tokens, p) with 0 <= p < 1 to 0 or 1 while keeping the sum of tokens·p, but for one residual.

    The open item meets the next one; mass moves from one to the other, by a random choice that keeps both
    expectations, until one of them is 0 or 1. Returns ([(id, 0 or 1)], residual (id, tokens, p) or None).
    """
    done, held, items = [], None, list(items)
    for (x, size, p), chance in zip(items, _uniform(seed, [i[0] for i in items]).tolist()):
        if p <= 0 or p >= 1:
            done.append((x, int(p >= 1)))
            continue
        if held is None:
            held = (x, size, p)
            continue
        y, other, q = held
        up = min((1 - p) * size, q * other)  # mass that may move to x
        down = min(p * size, (1 - q) * other)
        if chance < down / (up + down):
            p, q = p + up / size, q - up / other
        else:
            p, q = p - down / size, q + down / other
        left = []
        for z, s, r in ((x, size, p), (y, other, q)):
            if r < 1e-12 or r > 1 - 1e-12:
                done.append((z, int(r > 0.5)))
            else:
                left.append((z, s, r))
        held = left[0] if left else None
    return done, held


def mixture(documents: DataFrame, targets: DataFrame, seed: str = "mix", vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(draw, shares).

    draw: (doc_id, source, tokens, copies) of every document, copies 0 for one that isn't drawn. shares: (source, target_share,
    max_repeats, available_tokens, drawn_tokens, share) of every target.

    Sources are compared in one spelling. The total is the largest at which every source that has tokens can hold its
    share (of the shares of such sources) within its repeats: so the mixture fits the targets, up to one document per
    source. A source's documents have equal expected copies; their fractions are rounded by pivotal sampling, leaves in
    hash order, residuals in a tree of FAN_IN. Targets without documents get nothing and report a share of 0; documents without
    a target, a source or tokens are drawn 0 times. A target given twice counts with its sum, and with its least repeats. Null shares and repeats count as 0.
    """
    spark = documents.sparkSession
    docs = documents.where("doc_id IS NOT NULL").select("doc_id", tidy(F.col("source"), "_").alias("source"), "text")
    docs = cut(with_tokens(docs, "text", vocabulary).groupBy("doc_id").agg(F.max("source").alias("source"), F.max("tokens").alias("tokens")))
    goal = targets.where("source IS NOT NULL").groupBy(tidy(F.col("source"), "_").alias("source")).agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.min(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats"))
    have = docs.groupBy("source").agg(F.sum("tokens").alias("available_tokens"), F.count("*").alias("n"))
    rates = []
    known = goal.join(have, "source", "left").na.fill(0, ["available_tokens", "n"]).collect()  # one row per target
    live = [r for r in known if r.available_tokens and r.target_share > 0 and r.max_repeats > 0]
    whole = sum(r.target_share for r in live)
    total = min((r.available_tokens * r.max_repeats * whole / r.target_share for r in live), default=0.0)
    for r in live:
        rates.append((r.source, min(float(r.max_repeats), total * r.target_share / whole / r.available_tokens), -(-int(r.n) // LEAF)))
    rate = F.broadcast(spark.createDataFrame(rates, "source string, rate double, leaves int"))  # one row per target
    near = F.abs(F.col("rate") - F.round("rate")) < 1e-9
    base = F.when(near, F.round("rate")).otherwise(F.floor("rate")).cast("int")
    fraction = F.when(near, F.lit(0.0)).otherwise(F.col("rate") - F.floor("rate"))
    drawn = docs.where("tokens > 0").join(rate, "source").select("doc_id", "source", "tokens", base.alias("base"), fraction.alias("p"), F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("leaves")).cast("bigint").alias("bucket"))
    schema = "source string, bucket bigint, doc_id bigint, tokens bigint, p double, decided int"

    def settle(table: pa.Table) -> pa.Table:
        source, bucket = table.column("source")[0].as_py(), table.column("bucket")[0].as_py()
        ids = table.column("doc_id").to_pylist()
        order = np.lexsort((ids, _uniform(seed, ids)))
        rows = list(zip(*(table.column(c).take(pa.array(order)).to_pylist() for c in ("doc_id", "tokens", "p"))))
        done, held = pivotal(rows, f"{seed}:{source}:{bucket}")
        sizes = {r[0]: r[1] for r in rows}
        out = [(x, sizes[x], float(v), v) for x, v in done] + ([(*held, None)] if held else [])
        return pa.table({"source": pa.array([source] * len(out), pa.string()), "bucket": pa.array([bucket] * len(out), pa.int64()), "doc_id": pa.array([o[0] for o in out], pa.int64()), "tokens": pa.array([o[1] for o in out], pa.int64()), "p": pa.array([o[2] for o in out], pa.float64()), "decided": pa.array([o[3] for o in out], pa.int32())})

    state = cut(drawn.groupBy("source", "bucket").applyInArrow(settle, schema))
    decided = state.where("decided IS NOT NULL").select("doc_id", "decided")
    leaves = max((r[2] for r in rates), default=0)
    while leaves > 1:
        leaves = -(-leaves // FAN_IN)
        open_ = state.where("decided IS NULL").withColumn("bucket", F.expr(f"bucket div {FAN_IN}"))
        state = cut(open_.groupBy("source", "bucket").applyInArrow(settle, schema))
        decided = decided.union(state.where("decided IS NOT NULL").select("doc_id", "decided"))
    last = state.where("decided IS NULL").select("doc_id", F.when(F.pmod(F.xxhash64("doc_id", F.lit(f"{seed}:last")), F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.col("p"), 1).otherwise(0).alias("decided"))
    extra = decided.union(last)
    draw = docs.join(rate.select("source", base.alias("base")), "source", "left").join(extra, "doc_id", "left")
    draw = draw.select("doc_id", "source", "tokens", F.when(F.col("tokens") > 0, F.coalesce("base", F.lit(0)) + F.coalesce("decided", F.lit(0))).otherwise(0).alias("copies"))
    got = draw.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("drawn_tokens"))
    counted = spark.createDataFrame([(r.source, r.target_share, r.max_repeats, int(r.available_tokens)) for r in known], "source string, target_share double, max_repeats int, available_tokens bigint")
    shares = counted.join(got, "source", "left").na.fill(0, ["drawn_tokens"])
    everything = got.agg(F.sum("drawn_tokens").alias("all_tokens"))
    shares = shares.crossJoin(F.broadcast(everything)).select("source", "target_share", "max_repeats", "available_tokens", "drawn_tokens", F.when(F.col("all_tokens") > 0, F.col("drawn_tokens") / F.col("all_tokens")).otherwise(0.0).alias("share"))  # one row joined to one per target
    return draw, shares
