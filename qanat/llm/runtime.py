"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qanat.functions.session import cut, stored_bytes  # noqa: F401

#: Bits of a membership filter: sixteen a member within these limits (16 MB at most, whatever the corpus), and parts in which it travels.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27
FILTER_PARTS = 64


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which each input bit moves every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _filter_places(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return h % np.uint64(bits), (h >> np.uint64(32)) % np.uint64(bits)


def membership_filter(ids: DataFrame):
    """Broadcast Bloom filter of the one bigint column of ``ids``, which is counted and read, so it should be a stored table.

    It has MOST_BITS at any corpus size; an overfull filter lets more rows through to the exact join that
    follows it, and never fewer. Its parts are merged on the executors.
    """
    spark = ids.sparkSession
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * ids.count()).bit_length()))
    per = bits // 8 // FILTER_PARTS

    def build(batches):
        packed = np.zeros(bits // 8, np.uint8)
        for b in batches:
            for p in _filter_places(b.column(0).drop_null().to_numpy(zero_copy_only=False), bits):
                np.bitwise_or.at(packed, (p >> np.uint64(3)).astype(np.int64), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))
        parts = [i for i in range(FILTER_PARTS) if packed[i * per : (i + 1) * per].any()]
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([packed[i * per : (i + 1) * per].tobytes() for i in parts], pa.binary())], ["part", "bits"])

    def merge(table: pa.Table) -> pa.Table:
        own = np.zeros(per, np.uint8)
        for x in table.column("bits").to_pylist():
            own |= np.frombuffer(x, np.uint8)
        return pa.table({"part": table.column("part")[:1], "bits": pa.array([own.tobytes()], pa.binary())})

    kind = "part int, bits binary"
    packed = np.zeros(bits // 8, np.uint8)
    for row in ids.mapInArrow(build, kind).groupBy("part").applyInArrow(merge, kind).collect():
        packed[row.part * per : (row.part + 1) * per] = np.frombuffer(row.bits, np.uint8)
    return spark.sparkContext.broadcast(packed)


def maybe_in(packed: np.ndarray, ids: np.ndarray) -> np.ndarray:
    a, b = (((packed[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1).astype(bool) for p in _filter_places(ids, 8 * len(packed)))
    return a & b


def spoken(rows: DataFrame) -> DataFrame:
    """(row_id, turn, role, content): user and assistant messages with content; a redelivered record comes as often as it was delivered."""
    return (
        rows.select("row_id", F.posexplode("messages").alias("turn", "m"))
        .where(F.col("row_id").isNotNull() & F.col("m.role").isin("user", "assistant") & F.col("m.content").isNotNull())
        .select("row_id", F.col("turn").cast("bigint").alias("turn"), F.col("m.role").alias("role"), F.col("m.content").alias("content"))
    )


def record_text(with_objective: bool):
    """One string of a row: its learning objective if wanted, then the user and assistant contents in order, a line each."""
    said = F.transform(F.filter("messages", lambda m: m["role"].isin("user", "assistant") & m["content"].isNotNull()), lambda m: m["content"])
    said = F.coalesce(said, F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(F.coalesce(F.col("learning_objective"), F.lit(""))), said) if with_objective else said, "\n")


def ranked(df: DataFrame, keys: list[str], by: str, name: str = "rank", per_task: int = 100_000) -> DataFrame:
    """``df`` with the place (from 0) of each row among those of equal ``keys``, ordered by a hash of ``by``, then ``by``.

    Each key is cut into ranges of the hash, so that no task ranks a whole hot key: ranges are counted, and a row's place
    is that in its range after the earlier ranges. Values of ``by`` must be distinct within a key.
    """
    parts = max(1, -(-df.count() // per_task))
    hashed = df.withColumn("_h", F.xxhash64(by)).withColumn("_part", F.floor((F.shiftrightunsigned("_h", 1) / F.lit(2.0**63)) * parts).cast("int"))
    sizes = hashed.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most ``parts`` rows a key
    starts = sizes.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy(*keys, "_part").orderBy("_h", by)
    placed = hashed.withColumn("_own", F.row_number().over(own) - 1).join(starts, [*keys, "_part"])
    return placed.withColumn(name, (F.col("_own") + F.col("_start")).cast("bigint")).drop("_h", "_part", "_own", "_start")
