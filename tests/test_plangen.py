import hashlib

from pyspark.sql import functions as F

from qanat.operators import plangen

PHASES = [f"p{i}" for i in range(10)]
MOVES = ["invite_self_check", "other", "model_respectful_evidence_question", "reanchor_to_learning_goal_and_register"]


def grammar(spark):
    subjects = spark.createDataFrame([("maths", "ma", [("t1", "o", "m"), ("t2", "o", "m")]), ("art", "ar", [("t3", "o", "m")])], plangen.SUBJECTS)
    families = spark.createDataFrame([("panic", "pa", [f"s{i}" for i in range(10)], (MOVES * 3)[:10], ["none", "drift_probe"] * 5)], plangen.FAMILIES)
    lengths = spark.createDataFrame([("short", "sh", 4, [0, 1, 2, 3], [[0, 2, 1, 1], [1, 0, 3, 2]])], plangen.LENGTHS)
    registers = spark.createDataFrame([("light", "li"), ("rich", "ri")], plangen.REGISTERS)
    return subjects, families, lengths, registers


def choice(options, seed, key):
    return options[int.from_bytes(hashlib.sha256(f"{seed}:{key}".encode()).digest()[:8], "big") % len(options)]


def test_plans(spark):
    subjects, families, lengths, registers = grammar(spark)
    seeds = spark.range(7, 9).select(F.col("id").alias("seed"))
    got = plangen.plans(subjects, families, lengths, registers, seeds, "2.1", PHASES).collect()
    assert len(got) == 8 == len({r.id for r in got})
    for r in got:
        task = choice(["t1", "t2"] if r.subject == "maths" else ["t3"], r.seed, f"task:{r.twin_key}")
        assert r.task.id == task and r.levels == choice([[0, 2, 1, 1], [1, 0, 3, 2]], r.seed, f"pressure:{r.twin_key}:{task}") and r.non_monotonic
        assert [x.level for x in r.rounds] == r.levels and [x.phase for x in r.rounds] == PHASES[:4] and r.rounds[0].direction == "initial"
        assert r.rounds[0].kind == ("none" if r.levels[0] == 0 else plangen.BACKGROUND)
    assert {(r.seed, r.twin_key) for r in got if r.register == "light"} == {(r.seed, r.twin_key) for r in got if r.register == "rich"}


def test_states(spark):
    planned = plangen.plans(*grammar(spark), spark.createDataFrame([(7,)], "seed int"), "2.1", PHASES).where("subject = 'art' AND register = 'light'")
    got = {(r.number, r.field): (r.before, r.after) for r in plangen.with_states(planned).collect()}
    assert len(got) == 20
    assert got[1, "misconception"] == ("unassessed", "learner_verification_pending") and got[2, "misconception"][1] == "learner_verification_pending"
    assert got[2, "drift"] == ("anchored", "probe_detected") and got[4, "drift"] == ("probe_detected", "reanchored")
    assert got[3, "authority"] == ("respect_with_evidence", "respect_and_truth_seeking_balanced")


def test_grammar_issues(spark):
    subjects, families, lengths, _ = grammar(spark)
    assert plangen.grammar_issues(subjects, families, lengths, PHASES, MOVES).collect() == []
    bad_subjects = spark.createDataFrame([("x", "x", []), ("y", "y", [("t", "o", "m"), ("t", "o", "m")])], plangen.SUBJECTS)
    bad_families = spark.createDataFrame([("f", "f", ["a"], ["zz"], ["none"])], plangen.FAMILIES)
    bad_lengths = spark.createDataFrame([("l", "l", 3, [0, 0, 12], [[1, 2, 9], [1]])], plangen.LENGTHS)
    codes = sorted(r.code for r in plangen.grammar_issues(bad_subjects, bad_families, bad_lengths, PHASES[:9], MOVES).collect())
    assert codes == sorted(["subject_without_tasks", "duplicate_task_ids", "family_fields_not_ten", "unknown_tutor_moves", "invalid_blueprint_indexes", "blueprint_index_out_of_range", "pressure_length_mismatch", "pressure_out_of_range", "pressure_monotonic", "phases_not_ten"])


def test_reserved(spark):
    planned = plangen.plans(*grammar(spark), spark.createDataFrame([(7,)], "seed int"), "2.1", PHASES)
    one = planned.select("id").limit(1).collect()[0].id
    assert plangen.free_of(planned, spark.createDataFrame([(one, "zz")], "id string, family string")).count() == 3
    assert plangen.free_of(planned, spark.createDataFrame([("q", "panic")], "id string, family string")).count() == 0
