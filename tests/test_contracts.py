from pyspark.sql import functions as F

from qanat.operators import audit, contracts

SCHEMA = "row_id bigint, split string, language string, register string, grade_band string, subject string, learning_objective string, scenario_family string, tags array<string>, messages array<struct<role:string,content:string>>, conversation_sha256 string, pressure_pattern array<int>"


def row(spark, **change):
    from qanat.functions.hashing import conversation_hash
    from qanat.functions.text import stripped_lines

    base = {"row_id": 1, "split": "train", "language": "en", "register": "family_rich", "grade_band": "adult", "subject": "maths", "learning_objective": "Explain a long division", "scenario_family": "panic", "tags": ["ok-tag"], "messages": [("system", "s"), ("user", "u"), ("assistant", "a")], "conversation_sha256": None, "pressure_pattern": [1]} | change
    df = spark.createDataFrame([tuple(base[c.split()[0]] for c in SCHEMA.split(", "))], SCHEMA)
    return df if "conversation_sha256" in change else df.withColumn("conversation_sha256", conversation_hash(F.col("messages"), stripped_lines))


def codes(df):
    return sorted(r.code for r in contracts.issues(df).collect())


def test_good_row(spark):
    assert codes(row(spark)) == []


def test_each_rule(spark):
    assert codes(row(spark, split="dev", language="EN")) == ["invalid_language", "invalid_split"]
    assert codes(row(spark, tags=["BAD"])) == ["invalid_tags"]
    assert codes(row(spark, tags=["aa", "aa"])) == ["duplicate_tags"]
    assert codes(row(spark, subject=None, grade_band=None)) == ["invalid_grade_band", "invalid_text_field:subject"]
    assert codes(row(spark, messages=[("system", "s"), ("assistant", "a"), ("user", " ")])) == ["conversation_not_closed", "invalid_message_content", "invalid_role_sequence"]
    assert codes(row(spark, messages=[("system", "s")])) == ["invalid_messages", "pressure_turn_mismatch"]
    assert codes(row(spark, conversation_sha256="0" * 64)) == ["conversation_hash_mismatch"]
    assert codes(row(spark, conversation_sha256="xyz")) == ["invalid_conversation_hash"]
    assert codes(row(spark, pressure_pattern=[6])) == ["invalid_pressure_pattern"]
    assert codes(row(spark, pressure_pattern=[1, 2])) == ["pressure_turn_mismatch"]


def test_partition_audit(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert {(r.status, r["keys"]) for r in audit.partition_audit(a, b, "k").collect()} == {("both", 1), ("missing", 1), ("extra", 1)}


def test_prefix_sums_equal_one_window(spark):
    df = spark.range(500).select(F.sha2(F.col("id").cast("string"), 256).alias("h"), (F.col("id") % 7).alias("x"))
    got = [(r.h, r.s) for r in audit.prefix_sums(df, "h", "x", "s").orderBy("h").collect()]
    total, want = 0, []
    for r in df.orderBy("h").collect():
        want.append((r.h, total))
        total += r.x
    assert got == want


def test_group_split_keeps_groups(spark):
    df = spark.range(300).select((F.col("id") % 40).cast("string").alias("g"))
    got = audit.group_split(df, F.col("g"), 0.2, "s").collect()
    assert len(got) == 40 and 0.15 < sum(r.rows for r in got if r.split == "validation") / 300 < 0.3


def test_latest(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, None)], "k int, t int, v string")
    assert {(r.k, r.v) for r in audit.latest(df, ["k"], ["t"], ["v"]).collect()} == {(1, "b"), (2, None)}
