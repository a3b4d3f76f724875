"""Projections of release rows: tiers, limitations, keys, packets and flat turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tiers that a status stands for.
TIERS = {
    "accepted_expedited_silver": "reviewed_accepted_expedited",
    "accepted_unanimous_review": "reviewed_accepted_dual",
    "accepted_grounded_v3": "reviewed_accepted_grounded_v3",
    "candidate_unreviewed": "unreviewed_structural_preflight",
}


def tier(frozen: Column, silver: Column, review: Column, status: Column) -> Column:
    """The frozen tier as it is, else a silver or review tier that isn't empty, else what the status stands for, else the status, else unknown."""
    known = F.create_map(*[F.lit(x) for pair in TIERS.items() for x in pair])
    filled = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(frozen, filled(silver), filled(review), F.try_element_at(known, status), filled(status), F.lit("unknown"))


def limitations(frozen: Column, several: Column, single: Column) -> Column:
    """The frozen limitation, else the list of them, else a single one that isn't empty, else none."""
    return F.coalesce(F.when(frozen.isNotNull(), F.array(frozen)), several, F.when(single != "", F.array(single)), F.array().cast("array<string>"))


def source_family_key(role: Column, family: Column, group: Column) -> Column:
    """What ties grounded rows together: the family key, else the group; null for other rows and blank values."""
    return F.when(role == "grounded", F.coalesce(F.nullif(family, F.lit("")), F.nullif(group, F.lit(""))))


def ledger(rows: DataFrame, key: str) -> DataFrame:
    """One ledger line per row, as stored rows have no frozen tier, review tier or single limitation."""
    none = F.lit(None).cast("string")
    return rows.select(
        key, "conversation_sha256", "corpus_role", "expression_class", "split", "status",
        tier(none, F.col("quality.silver_tier"), none, F.col("status")).alias("tier"),
        limitations(none, F.col("quality.limitations"), none).alias("limitations"),
        F.lit(True).alias("trainable_in_this_experimental_silver_release"), F.lit(False).alias("publication_grade"),
    )


def with_split(rows: DataFrame, split: Column, group: Column) -> DataFrame:
    """``rows`` with a split and the hash of their group; no group gives no hash."""
    return rows.withColumn("split", split).withColumn("split_group_sha256", F.sha2(F.nullif(group, F.lit("")), 256))


def fixed_metadata(rows: DataFrame, exchanges: Column) -> DataFrame:
    """``rows`` with language and register filled in and the number of messages that so many exchanges make."""
    return rows.withColumn("language", F.coalesce("language", F.lit("en"))).withColumn("register", F.coalesce("register", F.lit("institutional_light"))).withColumn("message_count", (1 + 2 * exchanges).cast("bigint"))


def packets(rows: DataFrame, key: str) -> DataFrame:
    """(key, packet): what a writer gets. Grounded rows bring their source and limitations, revised ones what they were before."""
    shared = [F.col("learning_objective").alias("objective"), F.col("scenario_family").alias("family")]
    grounded = F.struct(F.lit("grounded").alias("kind"), *shared, F.coalesce("provenance.source_group_id", F.lit("")).alias("source"), F.size(F.coalesce("quality.limitations", F.array().cast("array<string>"))).alias("limits"))
    revised = F.struct(F.lit("revised").alias("kind"), *shared, F.col("conversation_sha256").alias("source"), F.lit(0).alias("limits"))
    return rows.select(key, F.when(F.col("corpus_role") == "grounded", grounded).otherwise(revised).alias("packet"))


def nested(turns: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per conversation with its turns as an array, in order."""
    rest = [c for c in turns.columns if c not in keys and c != order]
    return turns.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, *rest))).alias("turns"))  # the turns of one conversation


def flat(conversations: DataFrame, keys: list[str]) -> DataFrame:
    """One row per turn again."""
    return conversations.select(*keys, F.explode("turns").alias("t")).select(*keys, "t.*")
