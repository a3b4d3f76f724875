"""Record contracts as data: each rule is (code, column that is true where it is broken)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qanat.functions.hashing import conversation_hash
from qanat.functions.text import stripped_lines

# Closed sets and limits of the record contract.
SPLITS = ["train", "validation"]
LANGUAGES = ["en", "en-AE", "ar", "ar-AE"]
REGISTERS = ["institutional_light", "family_rich"]
GRADE_BANDS = ["primary_1_5", "middle_6_8", "secondary_9_12", "adult"]
TEXT_LIMITS = {"subject": (2, 80), "learning_objective": (10, 500), "scenario_family": (3, 100)}
TAG = r"^[a-z0-9][a-z0-9_-]{1,49}$"
SHA256 = r"^[a-f0-9]{64}$"
MESSAGES, TAGS, PRESSURES, CONTENT = (3, 41), 30, (1, 20), 20_000


def broken(c: Column) -> Column:
    return F.coalesce(c, F.lit(True))


def roles_out_of_order(messages: Column) -> Column:
    """Message 0 is the system's, then user and assistant take turns."""
    expected = lambda i: F.when(i == 0, "system").when(i % 2 == 1, "user").otherwise("assistant")
    return F.exists(F.transform(messages, lambda m, i: ~F.coalesce(m["role"] == expected(i), F.lit(False))), lambda x: x)


def rules(normalize=stripped_lines) -> list[tuple[str, Column]]:
    """Row-level rules; an earlier code's failure keeps its later elif twin silent. ``normalize``: the form of contents that the hash is of."""
    m = F.col("messages")
    shape = broken(~F.size(m).between(*MESSAGES))
    users = F.size(F.filter(m, lambda x: x["role"] == "user"))
    pressure = F.col("pressure_pattern")
    bad_pressure = broken(~F.size(pressure).between(*PRESSURES) | F.exists(pressure, lambda x: ~x.between(0, 5)))
    bad_tags = F.col("tags").isNotNull() & ((F.size("tags") > TAGS) | F.exists("tags", lambda x: ~F.coalesce(x.rlike(TAG), F.lit(False))))
    bad_content = broken(F.exists(m, lambda x: F.coalesce(F.length(F.trim(x["content"])) == 0, F.lit(True)) | (F.length(x["content"]) > CONTENT)))
    well = ~shape & ~bad_content  # only then a hash is asked for
    bad_hash = broken(~F.col("conversation_sha256").rlike(SHA256))
    out = [
        ("invalid_split", broken(~F.col("split").isin(SPLITS))),
        ("invalid_language", broken(~F.col("language").isin(LANGUAGES))),
        ("invalid_register", broken(~F.col("register").isin(REGISTERS))),
        ("invalid_grade_band", broken(~F.col("grade_band").isin(GRADE_BANDS))),
        *[(f"invalid_text_field:{c}", broken((F.length(F.trim(c)) < low) | (F.length(c) > high))) for c, (low, high) in TEXT_LIMITS.items()],
        ("invalid_tags", bad_tags),
        ("duplicate_tags", ~bad_tags & F.coalesce(F.size(F.array_distinct("tags")) < F.size("tags"), F.lit(False))),
        ("invalid_messages", shape),
        ("invalid_role_sequence", ~shape & broken(roles_out_of_order(m))),
        ("invalid_message_content", ~shape & bad_content),
        ("conversation_not_closed", ~shape & broken(F.try_element_at(m, F.lit(-1))["role"] != "assistant")),
        ("invalid_conversation_hash", well & bad_hash),
        ("conversation_hash_mismatch", well & ~bad_hash & broken(F.col("conversation_sha256") != conversation_hash(m, normalize))),
        ("invalid_pressure_pattern", bad_pressure),
        ("pressure_turn_mismatch", ~bad_pressure & broken(F.size(pressure) != users)),
    ]
    return out


def issues(rows: DataFrame, key: str = "row_id", checks: list[tuple[str, Column]] | None = None) -> DataFrame:
    """(key, code): every broken rule of every row, in one projection."""
    found = F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in checks or rules()]))
    return rows.select(key, F.explode(found).alias("code"))


def profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, rows): how often each value of each column occurs; nulls are not counted."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    return long.where("value IS NOT NULL").groupBy("field", "value").agg(F.count("*").alias("rows"))


def release_rules(system: str) -> list[tuple[str, Column]]:
    """Rules of rows that go into a release: at least three messages, the exact system message, contents that aren't blank, turns in order, the tutor last, and the hash of the contents as they are."""
    m = F.col("messages")
    return [
        ("too_few_messages", broken(F.size(m) < 3)),
        ("wrong_system_message", broken((F.try_element_at(m, F.lit(1))["role"] != "system") | (F.try_element_at(m, F.lit(1))["content"] != system))),
        ("malformed_message", broken(roles_out_of_order(m) | F.exists(m, lambda x: F.coalesce(F.trim(x["content"]) == "", F.lit(True))))),
        ("tutor_not_last", broken(F.try_element_at(m, F.lit(-1))["role"] != "assistant")),
        ("conversation_hash_mismatch", broken(F.col("conversation_sha256") != conversation_hash(m))),
    ]


def presplit_rules(role: str) -> list[tuple[str, Column]]:
    """Rules of rows before a split: their corpus role is ``role`` and they have no split yet."""
    return [("wrong_corpus_role", broken(F.col("corpus_role") != role)), ("pre_split", F.col("split").isNotNull() | F.col("split_group_sha256").isNotNull())]


def quota_differences(rows: DataFrame, column: str, quotas: dict[str, int]) -> DataFrame:
    """(value, expected, found): values of ``column`` whose number of rows isn't its quota; a value without one should have none. Null counts as "None"."""
    have = rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("None")).alias("value")).agg(F.count("*").alias("found"))
    want = rows.sparkSession.createDataFrame(sorted(quotas.items()) or [("", 0)], "value string, expected bigint")
    return want.join(have, "value", "full").na.fill(0, ["expected", "found"]).where("expected <> found").select("value", "expected", "found")
