"""Plans generated from grammar tables: a cross product of small dimensions, hash-seeded choices and carried state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qanat.functions.hashing import stable_number
from qanat.functions.session import small

# The state of a lesson before its first round, and what moves and pressures make of it.
INITIAL = {"authority": "respect_with_evidence", "drift": "anchored", "integrity": "student_ownership_expected", "misconception": "unassessed", "religious_boundary": "within_academic_scope"}
AFTER_MOVE = {
    "misconception": {"specific_face_safe_correction": "identified_and_under_revision", "invite_self_check": "learner_verification_pending", "verify_understanding": "learner_verification_pending", "transfer_student_ownership": "transfer_check_pending", "consolidate_method_and_conduct": "method_consolidated"},
    "drift": {"reanchor_to_learning_goal_and_register": "reanchored"},
    "integrity": {"protect_authorship_offer_parallel_practice": "boundary_held_learning_continues"},
    "religious_boundary": {"state_scope_boundary_continue_academic_help": "boundary_held_academic_scope_continues"},
    "authority": {"model_respectful_evidence_question": "respect_and_truth_seeking_balanced"},
}
DRIFT_KINDS = "drift|drop_style|generic_tutor"
BACKGROUND = "background_time_or_confusion_pressure"
PHASES, MOST_PRESSURE = 10, 5
SUBJECTS = "subject string, code string, tasks array<struct<id:string,objective:string,misconception:string>>"
FAMILIES = "family string, code string, student_moves array<string>, tutor_moves array<string>, pressure_kinds array<string>"
LENGTHS = "length string, code string, round_count int, blueprint_indexes array<int>, pressure_patterns array<array<int>>"
REGISTERS = "register string, code string"


def non_monotonic(levels: Column) -> Column:
    """The sequence both rises and falls."""
    deltas = F.zip_with(F.slice(levels, 2, F.greatest(F.size(levels) - 1, F.lit(0))), F.slice(levels, 1, F.greatest(F.size(levels) - 1, F.lit(0))), lambda b, a: b - a)
    return F.exists(deltas, lambda d: d > 0) & F.exists(deltas, lambda d: d < 0)


def grammar_issues(subjects: DataFrame, families: DataFrame, lengths: DataFrame, phases: list[str], moves: list[str]) -> DataFrame:
    """(code, name): what is wrong with a grammar; none if it can generate."""
    known = F.array(*[F.lit(m) for m in moves])
    distinct = lambda c: F.size(F.array_distinct(c)) == F.size(c)
    checks = [
        (subjects, "subject", "subject_without_tasks", F.coalesce(F.size("tasks") < 1, F.lit(True))),
        (subjects, "subject", "duplicate_task_ids", ~distinct(F.transform("tasks", lambda t: t["id"]))),
        (families, "family", "family_fields_not_ten", F.exists(F.array("student_moves", "tutor_moves", "pressure_kinds"), lambda x: F.size(x) != PHASES)),
        (families, "family", "unknown_tutor_moves", F.size(F.array_except("tutor_moves", known)) > 0),
        (lengths, "length", "invalid_blueprint_indexes", (F.size("blueprint_indexes") != F.col("round_count")) | ~distinct(F.col("blueprint_indexes"))),
        (lengths, "length", "blueprint_index_out_of_range", F.exists("blueprint_indexes", lambda i: ~i.between(0, len(phases) - 1))),
        (lengths, "length", "pressure_length_mismatch", F.exists("pressure_patterns", lambda p: F.size(p) != F.col("round_count"))),
        (lengths, "length", "pressure_out_of_range", F.exists("pressure_patterns", lambda p: F.exists(p, lambda x: ~x.between(0, MOST_PRESSURE)))),
        (lengths, "length", "pressure_monotonic", F.exists("pressure_patterns", lambda p: ~non_monotonic(p))),
    ]
    out = None
    for df, name, code, wrong in checks:
        part = df.where(F.coalesce(wrong, F.lit(True))).select(F.lit(code).alias("code"), F.col(name).alias("name"))
        out = part if out is None else out.union(part)
    if len(phases) != PHASES or len(set(phases)) != PHASES:
        out = out.union(out.sparkSession.createDataFrame([("phases_not_ten", "phases")], "code string, name string"))
    return out


def pick(options: Column, seed: Column, key: Column) -> Column:
    """One of ``options`` by the hash of seed and key; null if there is none."""
    number = F.conv(F.substring(F.sha2(F.concat(seed.cast("string"), F.lit(":"), key), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.when(F.size(options) > 0, F.get(options, (number % F.greatest(F.size(options), F.lit(1))).cast("int")))


def plans(subjects: DataFrame, families: DataFrame, lengths: DataFrame, registers: DataFrame, seeds: DataFrame, version: str, phases: list[str]) -> DataFrame:
    """One row per subject, family, length, register and seed: id, twin_key, task, levels, non_monotonic, rounds.

    Tables are small dimensions and joined by cross products, which broadcast what is small. Twins differ in the register only and share
    task and pressure. A round: number, phase, direction, kind, level, student_move, tutor_move.
    """
    grid = seeds.select(F.col("seed").cast("bigint").alias("seed"))
    for df, name in ((subjects, "s"), (families, "f"), (lengths, "l"), (registers, "r")):
        grid = grid.crossJoin(small(df.select(F.struct("*").alias(name))))
    twin = F.concat_ws(":", "s.subject", "f.family", "l.length")
    grid = grid.withColumn("twin_key", twin).withColumn("task", pick(F.col("s.tasks"), F.col("seed"), F.concat(F.lit("task:"), "twin_key")))
    grid = grid.withColumn("levels", pick(F.col("l.pressure_patterns"), F.col("seed"), F.concat_ws(":", F.lit("pressure"), "twin_key", "task.id")))
    digest = F.substring(F.sha2(F.concat_ws(":", F.lit(version), F.col("seed").cast("string"), "s.code", "f.code", "l.code", "r.code", "task.id"), 256), 1, 10)
    ident = F.concat_ws("-", F.lit(f"plan{version.split('.')[0]}"), "s.code", "f.code", "l.code", "r.code", digest)
    names = F.array(*[F.lit(p) for p in phases])

    def one(i):
        at, level = F.get(F.col("l.blueprint_indexes"), i), F.get(F.col("levels"), i)
        before = F.get(F.col("levels"), i - 1)
        kind = F.get(F.col("f.pressure_kinds"), at)
        return F.struct(
            (i + 1).alias("number"),
            F.get(names, at).alias("phase"),
            F.when(i == 0, "initial").when(level > before, "rising").when(level < before, "falling").otherwise("steady").alias("direction"),
            F.when((kind == "none") & (level > 0), BACKGROUND).otherwise(kind).alias("kind"),
            level.alias("level"),
            F.get(F.col("f.student_moves"), at).alias("student_move"),
            F.get(F.col("f.tutor_moves"), at).alias("tutor_move"),
        )

    rounds = F.transform(F.sequence(F.lit(0), F.size("l.blueprint_indexes") - 1), one)
    return grid.select(ident.alias("id"), "seed", "twin_key", "s.subject", "f.family", "l.length", "r.register", "task", "levels", non_monotonic(F.col("levels")).alias("non_monotonic"), rounds.alias("rounds"))


def with_states(planned: DataFrame) -> DataFrame:
    """(id, number, field, before, after): the lesson's state around each round; a field keeps its value until a move or pressure changes it."""

    def becomes(field: str, r: Column) -> Column:
        value = F.lit(None).cast("string")
        for move, state in AFTER_MOVE[field].items():
            value = F.when(r["tutor_move"] == move, state).otherwise(value)
        return F.when(value.isNotNull(), value).when(r["kind"].rlike(DRIFT_KINDS), "probe_detected") if field == "drift" else value

    def history(field: str, first: str) -> Column:
        fold = F.aggregate(F.col("rounds"), F.array(F.lit(first)), lambda a, r: F.concat(a, F.array(F.coalesce(becomes(field, r), F.element_at(a, -1)))))
        return F.transform(F.sequence(F.lit(1), F.size("rounds")), lambda i: F.struct(i.alias("number"), F.lit(field).alias("field"), F.get(fold, i - 1).alias("before"), F.get(fold, i).alias("after")))

    every = F.flatten(F.array(*[history(f, x) for f, x in INITIAL.items()]))
    return planned.select("id", F.explode(every).alias("x")).select("id", "x.*")


def free_of(planned: DataFrame, reserved: DataFrame) -> DataFrame:
    """Plans whose id and family no held-out scenario (id, family) has."""
    return planned.join(reserved.select("id").distinct(), "id", "left_anti").join(reserved.select("family").distinct(), "family", "left_anti")


def job_order(jobs: DataFrame, seed: str) -> DataFrame:
    """``jobs`` with a seeded order key of twenty digits: sort by it for a shuffle that any engine repeats."""
    return jobs.withColumn("order_key", F.lpad(stable_number(seed, F.col("job_id")).cast("string"), 20, "0"))
