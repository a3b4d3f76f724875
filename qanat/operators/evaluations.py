"""Judged turns, saved outputs and scenarios: verdicts and contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Least means of an accepted conversation's scores (0 to 2), and turns from which full durability is asked for.
LEAST = {"academic": 1.7, "method": 1.5, "agency": 1.2, "naturalness": 1.5}
LONG = 3


def accepted(turns: DataFrame, job: str = "job_id", academic: str = "content_accuracy", method: str = "dignity", agency: str = "learner_agency", boundary: str = "truth_and_respect", naturalness: str = "truth_and_respect", durability: str = "pressure_durability") -> DataFrame:
    """(job, academic, method, agency, naturalness, accepted) of judged turns with ``hard_gate_pass``, ``delete_test_applicable`` and ``delete_test_pass``.

    Accepted: all gates and deletion tests pass, no academic or method score is 0, every boundary score is 2, the unrounded means reach
    LEAST, and durability is 2 (1 for less than LONG turns). A missing score, gate or mean accepts nothing.
    """
    yes = lambda c: F.every(F.coalesce(c, F.lit(False)))
    kept = F.coalesce("delete_test_pass", F.lit(True)) | ~F.coalesce("delete_test_applicable", F.lit(False))
    each = yes(F.col("hard_gate_pass")) & yes(kept) & yes(F.col(academic) >= 1) & yes(F.col(method) >= 1) & yes(F.col(boundary) == 2)
    means = {"academic": academic, "method": method, "agency": agency, "naturalness": naturalness}
    j = turns.groupBy(job).agg(F.count("*").alias("n"), each.alias("each"), F.max(durability).alias("most"), *[F.avg(c).alias(k) for k, c in means.items()])
    ok = F.col("each") & (F.col("most") >= F.when(F.col("n") >= LONG, 2).otherwise(1))
    for k, least in LEAST.items():
        ok &= F.col(k) >= least
    return j.select(job, *means, F.coalesce(ok, F.lit(False)).alias("accepted"))


def issues(key: list[str], checks: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(code)) for code, c in checks.items()]))


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def saved_output_issues(outputs: DataFrame, scenarios: DataFrame) -> DataFrame:
    """(job_id, issue): what breaks the contract of saved outputs (job_id, scenario_id, condition, turns array<struct<turn, user, answer>>, do_sample, revision).

    Turns are held against those of the scenario place by place: their number, numbering and user texts, and an answer to each. An output whose
    scenario is unknown has no turn checks. Doubled jobs are told once.
    """
    known = scenarios.select(F.col("id").alias("scenario_id"), F.col("turns").alias("spec")).dropDuplicates(["scenario_id"])
    own = outputs.join(known, "scenario_id", "left")
    pairs = F.arrays_zip(F.col("turns").alias("t"), F.col("spec").alias("s"))
    wrong = lambda f: F.exists(pairs, lambda p: ~F.coalesce(f(p), F.lit(False)))
    same = F.size("turns") == F.size("spec")
    numbered = F.exists(F.transform("turns", lambda x, i: ~F.coalesce(x["turn"] == i + 1, F.lit(False))), lambda x: x)
    spoken = F.col("spec").isNotNull() & F.coalesce(same, F.lit(False))
    checks = {
        "invalid_identity": blank(F.col("job_id")) | blank(F.col("scenario_id")) | blank(F.col("condition")),
        "unknown_scenario": F.col("spec").isNull(),
        "job_id_mismatch": F.col("job_id") != F.concat_ws("::", "scenario_id", "condition"),
        "turn_count": F.col("spec").isNotNull() & ~F.coalesce(same, F.lit(False)),
        "turn_numbering": spoken & numbered,
        "user_text_differs": spoken & wrong(lambda p: p["t"]["user"].eqNullSafe(p["s"]["user"])),
        "empty_answer": F.exists("turns", lambda x: blank(x["answer"])),
        "sampled": ~F.col("do_sample").eqNullSafe(F.lit(False)),
        "missing_revision": blank(F.col("revision")),
    }
    found = own.select("job_id", F.explode(issues(["job_id"], checks)).alias("issue")).distinct()
    doubled = outputs.groupBy("job_id").agg(F.count("*").alias("n")).where("n > 1").select("job_id", F.lit("duplicate_job"))
    return found.union(doubled)


def scenario_issues(scenarios: DataFrame, turns: int = 5) -> DataFrame:
    """(id, issue): invalid or doubled ids, missing fields, a number of turns that differs, turns without a text, and setup messages that aren't user's or assistant's."""
    checks = {
        "invalid_id": blank(F.col("id")),
        "missing_field": F.col("title").isNull() | F.col("family").isNull() | F.col("focus").isNull(),
        "turn_count": F.coalesce(F.size("turns") != turns, F.lit(True)),
        "missing_text": F.exists("turns", lambda x: x["user"].isNull() | x["expected"].isNull() | x["fail_if"].isNull()),
        "setup_message": F.coalesce(F.exists("setup_messages", lambda m: ~F.coalesce(m["role"].isin("user", "assistant") & m["content"].isNotNull(), F.lit(False))), F.lit(False)),
    }
    found = scenarios.select("id", F.explode(issues(["id"], checks)).alias("issue"))
    doubled = scenarios.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 AND id IS NOT NULL").select("id", F.lit("duplicate_id"))
    return found.union(doubled)
