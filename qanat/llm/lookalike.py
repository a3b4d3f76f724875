"""Problem 4: texts that look alike but are made of other characters."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qanat.llm.runtime import cut, spoken
from qanat.llm.textcore import duck_map, form_sql


def consistent_messages(rows: DataFrame) -> DataFrame:
    """(row_id, turn, role, form, changed): the consistent form of each user and assistant content.

    The form comes from DuckDB inside Arrow partitions (``form_sql``). Null rows, messages and contents give no
    row; an empty content has the empty form. A redelivered record gives the same rows again: telling them apart would move every text.
    """

    def run(batches):
        for b in batches:
            form, changed = duck_map(b.column("content"), form_sql(), f"{form_sql()} <> c")
            yield pa.RecordBatch.from_arrays([b.column("row_id"), b.column("turn"), b.column("role"), form, changed.cast(pa.bool_())], ["row_id", "turn", "role", "form", "changed"])

    return spoken(rows).mapInArrow(run, "row_id bigint, turn bigint, role string, form string, changed boolean")


def alike_pairs(rows: DataFrame) -> DataFrame:
    """(row_id_a, turn_a, row_id_b, turn_b), smaller row_id first: messages of two records that look the same and aren't the same string.

    Equal strings are no pair. Every content is normalised once; only digests leave that pass. A look's spellings are paired first and
    its messages follow their spelling, so messages that say the same thing in one spelling never meet each other, however many they are.
    """

    def run(batches):
        for b in batches:
            look, own = duck_map(b.column("content"), f"md5({form_sql()})", "md5(c)")
            yield pa.RecordBatch.from_arrays([b.column("row_id"), b.column("turn"), look, own], ["row_id", "turn", "look", "own"])

    said = spoken(rows).drop("role").mapInArrow(run, "row_id bigint, turn bigint, look string, own string")
    said = cut(said.select("row_id", "turn", F.unhex("look").alias("look"), F.unhex("own").alias("own")))
    spellings = said.groupBy("look", "own").agg(F.min("row_id").alias("x"), F.max("row_id").alias("y"))
    several = spellings.groupBy("look").agg(F.min("own").alias("p"), F.max("own").alias("q")).where("p <> q").select("look")
    spellings = cut(spellings.join(several, "look", "left_semi"))
    said = said.distinct().join(spellings.select("look", "own"), ["look", "own"], "left_semi")
    one = spellings.select("look", F.col("own").alias("own_a"), F.col("x").alias("x_a"))
    other = spellings.select("look", F.col("own").alias("own_b"), F.col("y").alias("y_b"))
    met = one.join(other, "look").where("own_a <> own_b AND x_a < y_b").select("look", "own_a", "own_b")  # different spellings of one look
    a = said.select("look", F.col("row_id").alias("row_id_a"), F.col("turn").alias("turn_a"), F.col("own").alias("own_a"))
    b = said.select("look", F.col("row_id").alias("row_id_b"), F.col("turn").alias("turn_b"), F.col("own").alias("own_b"))
    pairs = met.join(a, ["look", "own_a"]).join(b, ["look", "own_b"]).where("row_id_a < row_id_b")
    return pairs.select("row_id_a", "turn_a", "row_id_b", "turn_b")
