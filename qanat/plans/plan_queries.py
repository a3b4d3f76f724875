"""Queries of deterministic plans, pressure sequences and conversation shapes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from qanat.functions.hashing import digest_choice, stable_choice, stable_id
from qanat.functions.text import ascii_words
from qanat.operators import plangen
from qanat.plans.contract_queries import SAID
from qanat.plans.registry import query

NUMBER = "CAST(('0x' || sha256('{0}:' || {1})[1:16]) AS UBIGINT)"


@query(f"""SELECT subject, family, register, 'plan_' || sha256(subject || '|' || family || '|' || register)[1:10] AS plan_id, CAST({NUMBER.format('plan', "subject || '|' || family || '|' || register")} % 10 AS INTEGER) AS opening
  FROM (SELECT DISTINCT subject FROM documents WHERE subject IS NOT NULL), (SELECT DISTINCT family FROM scenarios), (VALUES ('institutional_light'), ('family_rich')) r(register)""")
def plan_grid(t):
    """Small dimension tables only: subjects x families x registers."""
    subjects = t.documents.where("subject IS NOT NULL").select("subject").distinct()
    families = t.scenarios.select("family").distinct()
    registers = F.explode(F.array(F.lit("institutional_light"), F.lit("family_rich")))
    grid = subjects.crossJoin(F.broadcast(families)).withColumn("register", registers)
    key = F.concat_ws("|", "subject", "family", "register")
    return grid.select("subject", "family", "register", stable_id("plan_", key).alias("plan_id"), stable_choice("plan", key, 10).alias("opening"))


@query(f"SELECT p_partkey, CAST({NUMBER.format('choice', 'p_partkey')} % 7 AS INTEGER) AS choice, CAST(('0x' || sha256(CAST(p_partkey AS VARCHAR))[5:6]) AS INTEGER) % 5 AS digest FROM part")
def stable_choices(t):
    return t.part.select("p_partkey", stable_choice("choice", F.col("p_partkey"), 7).alias("choice"), digest_choice(F.col("p_partkey"), 2, 5).alias("digest"))


LEVELS = "own AS (SELECT DISTINCT row_id, pressure_pattern AS p FROM release_rows), levels AS (SELECT row_id, p, CAST(i - 1 AS INTEGER) AS step, p[i] AS level, CASE WHEN i > 1 THEN p[i - 1] END AS before FROM (SELECT row_id, p, unnest(range(1, len(p) + 1)) AS i FROM own))"


@query(f"WITH {LEVELS} SELECT row_id, step, level, CASE WHEN before IS NULL THEN 'initial' WHEN level > before THEN 'rising' WHEN level < before THEN 'falling' ELSE 'steady' END AS direction FROM levels")
def pressure_direction(t):
    """The step before stands in the same array, so no window and no shuffle but that of redelivered rows."""
    p = F.col("pressure_pattern")
    steps = F.transform(p, lambda x, i: F.struct(i.alias("step"), x.alias("level"), F.when(i > 0, F.get(p, i - 1)).alias("before")))
    long = t.release_rows.select("row_id", "pressure_pattern").distinct().select("row_id", F.explode(steps).alias("s")).select("row_id", "s.*")
    direction = F.when(F.col("before").isNull(), "initial").when(F.col("level") > F.col("before"), "rising").when(F.col("level") < F.col("before"), "falling").otherwise("steady")
    return long.select("row_id", "step", "level", direction.alias("direction"))


@query(f"WITH {LEVELS} SELECT row_id FROM levels GROUP BY row_id HAVING max(level - before) > 0 AND min(level - before) < 0")
def non_monotonic_sequences(t):
    p = F.col("pressure_pattern")
    deltas = F.zip_with(F.slice(p, 2, F.size(p)), p, lambda a, b: a - b)
    return t.release_rows.select("row_id", F.filter(deltas, lambda d: d.isNotNull()).alias("d")).where("exists(d, x -> x > 0) AND exists(d, x -> x < 0)").select("row_id").distinct()


@query(f"WITH {LEVELS} SELECT row_id, step, max(level) OVER w AS highest, last_value(CASE WHEN level >= 3 THEN step END IGNORE NULLS) OVER w AS last_high FROM levels WINDOW w AS (PARTITION BY row_id ORDER BY step ROWS UNBOUNDED PRECEDING)")
def state_carry_forward(t):
    own = t.release_rows.select("row_id", "pressure_pattern").distinct().select("row_id", F.posexplode("pressure_pattern").alias("step", "level"))
    w = Window.partitionBy("row_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # the steps of one record
    return own.select("row_id", "step", F.max("level").over(w).alias("highest"), F.last(F.when(F.col("level") >= 3, F.col("step")), True).over(w).alias("last_high"))


@query(f"WITH {SAID} SELECT row_id, turn, CAST(row_number() OVER (PARTITION BY row_id ORDER BY turn) AS INTEGER) AS assistant_turn FROM said WHERE role = 'assistant'")
def assistant_turn_number(t):
    kept = F.filter(F.transform("messages", lambda m, i: F.struct(i.alias("turn"), m["role"].alias("role"))), lambda x: x["role"] == "assistant")
    return t.release_rows.select("row_id", F.posexplode(kept).alias("n", "x")).select("row_id", "x.turn", (F.col("n") + 1).alias("assistant_turn")).distinct()


@query("SELECT DISTINCT row_id, array_to_string(list_transform(list_filter(messages, lambda m: m.role <> 'system'), lambda m: upper(m.role) || ': ' || m.content), chr(10) || chr(10)) AS transcript FROM release_rows")
def render_transcript(t):
    said = F.filter("messages", lambda m: m["role"] != "system")
    return t.release_rows.select("row_id", F.array_join(F.transform(said, lambda m: F.concat(F.upper(m["role"]), F.lit(": "), m["content"])), "\n\n").alias("transcript")).dropDuplicates(["row_id"])


ASCII = "regexp_extract_all(lower({0}), '[a-z0-9]+(?:[-_][a-z0-9]+)*')"


@query(f"""WITH {SAID}, prior AS (
  SELECT row_id, turn, content, flatten(list({ASCII.format("content")}) OVER (PARTITION BY row_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS seen, lead({ASCII.format("content")}) OVER (PARTITION BY row_id ORDER BY turn) AS after, role FROM said WHERE role <> 'system'),
  novel AS (SELECT row_id, turn, list_distinct(list_filter({ASCII.format("content")}, lambda x: length(x) >= 3 AND NOT list_contains(coalesce(seen, []), x))) AS n, coalesce(after, []) AS after FROM prior WHERE role = 'assistant')
  SELECT row_id, turn, len(n) AS novel, len(list_filter(n, lambda x: list_contains(after, x))) AS taken_up FROM novel""")
def novel_token_uptake(t):
    """Words of an assistant message that nobody used before, and how many of them the learner's next message takes up. Works within each record's array."""
    said = F.transform(F.filter("messages", lambda m: m["role"] != "system"), lambda m: F.struct(m["role"].alias("role"), ascii_words(m["content"]).alias("w")))
    turns = t.release_rows.select("row_id", F.filter(F.transform("messages", lambda m, i: F.when(m["role"] != "system", i)), lambda x: x.isNotNull()).alias("turns"), said.alias("s")).dropDuplicates(["row_id"])
    step = F.transform(
        F.col("s"),
        lambda x, i: F.struct(
            F.get("turns", i).alias("turn"),
            x["role"].alias("role"),
            F.filter(F.array_except(x["w"], F.flatten(F.transform(F.slice("s", F.lit(1), i), lambda y: y["w"]))), lambda z: F.length(z) >= 3).alias("novel"),
            F.coalesce(F.get("s", i + 1)["w"], F.array().cast("array<string>")).alias("after"),
        ),
    )
    long = turns.select("row_id", F.explode(step).alias("x")).where("x.role = 'assistant'")
    return long.select("row_id", "x.turn", F.size("x.novel").cast("bigint").alias("novel"), F.size(F.array_intersect("x.novel", "x.after")).cast("bigint").alias("taken_up"))


@query("SELECT source_group_id, arg_min(doc_id, sha256(doc_id || ':' || n_chars)) AS doc_id, min(sha256(doc_id || ':' || n_chars)) AS digest FROM documents WHERE source_group_id IS NOT NULL GROUP BY 1")
def pick_min_hash_variant(t):
    digest = F.sha2(F.concat("doc_id", F.lit(":"), "n_chars"), 256)
    return t.documents.where("source_group_id IS NOT NULL").groupBy("source_group_id").agg(F.min_by("doc_id", digest).alias("doc_id"), F.min(digest).alias("digest"))


@query(f"""SELECT id || '::' || condition AS job_id, lpad(CAST({NUMBER.format('jobs', "(id || '::' || condition)")} AS VARCHAR), 20, '0') AS order_key FROM scenarios, (SELECT DISTINCT condition FROM turn_results WHERE condition IS NOT NULL)""")
def job_order(t):
    """Scenarios x conditions, both small, in a seeded order."""
    conditions = t.turn_results.where("condition IS NOT NULL").select("condition").distinct()
    jobs = conditions.crossJoin(F.broadcast(t.scenarios.select("id"))).select(F.concat_ws("::", "id", "condition").alias("job_id"))
    return plangen.job_order(jobs, "jobs")


PHASES = [f"phase {k}" for k in range(10)]
MOVES = ["invite_self_check", "other", "model_respectful_evidence_question", "reanchor_to_learning_goal_and_register"]


def generated(t):
    """Plans of all subjects and held-out families in one length, two registers and two seeds; the tables are small dimensions."""
    subject = t.documents.where("subject IS NOT NULL").select("subject").distinct()
    tasks = F.array(*[F.struct(F.concat("subject", F.lit(f"-{k}")).alias("id"), F.lit("o").alias("objective"), F.lit("m").alias("misconception")) for k in (1, 2, 3)])
    lit = lambda xs: F.array(*[F.lit(x) for x in xs])
    code = lambda c: F.substring(F.sha2(c, 256), 1, 4)
    families = t.scenarios.where("family IS NOT NULL").select("family").distinct()
    families = families.select("family", code("family").alias("code"), lit([f"s{k}" for k in range(10)]).alias("student_moves"), lit((MOVES * 3)[:10]).alias("tutor_moves"), lit(["none", "drift_probe"] * 5).alias("pressure_kinds"))
    lengths = t._spark.createDataFrame([("short", "sh", 4, [0, 1, 2, 3], [[0, 2, 1, 1], [1, 0, 3, 2]])], plangen.LENGTHS)
    registers = t._spark.createDataFrame([("institutional_light", "li"), ("family_rich", "ri")], plangen.REGISTERS)
    return plangen.plans(subject.select("subject", code("subject").alias("code"), tasks.alias("tasks")), families, lengths, registers, t._spark.range(7, 9).toDF("seed"), "2.1", PHASES)


GRID = f"""grid AS (SELECT s.subject || ':' || f.family || ':short' AS twin_key, seed, register, s.subject FROM (SELECT DISTINCT subject FROM documents WHERE subject IS NOT NULL) s, (SELECT DISTINCT family FROM scenarios WHERE family IS NOT NULL) f,
    (VALUES ('institutional_light'), ('family_rich')) r(register), (VALUES (7), (8)) v(seed)),
  tasked AS (SELECT *, [subject || '-1', subject || '-2', subject || '-3'][CAST(CAST(('0x' || sha256(seed || ':task:' || twin_key)[1:16]) AS UBIGINT) % 3 + 1 AS INTEGER)] AS task_id FROM grid)"""


@query(f"""WITH {GRID} SELECT twin_key, CAST(seed AS BIGINT) AS seed, register, task_id, ['0,2,1,1', '1,0,3,2'][CAST(CAST(('0x' || sha256(seed || ':pressure:' || twin_key || ':' || task_id)[1:16]) AS UBIGINT) % 2 + 1 AS INTEGER)] AS levels, true AS non_monotonic FROM tasked""")
def generated_plans(t):
    return generated(t).select("twin_key", "seed", "register", F.col("task.id").alias("task_id"), F.array_join("levels", ",").alias("levels"), "non_monotonic")


@query(f"""WITH {GRID} SELECT v.number, v.field, v.before, v.after, n AS plans FROM (SELECT count(*) AS n FROM tasked), (VALUES
    (1, 'drift', 'anchored', 'anchored'), (2, 'drift', 'anchored', 'probe_detected'), (3, 'drift', 'probe_detected', 'probe_detected'), (4, 'drift', 'probe_detected', 'reanchored'),
    (1, 'misconception', 'unassessed', 'learner_verification_pending'), (2, 'misconception', 'learner_verification_pending', 'learner_verification_pending'),
    (3, 'misconception', 'learner_verification_pending', 'learner_verification_pending'), (4, 'misconception', 'learner_verification_pending', 'learner_verification_pending'),
    (1, 'authority', 'respect_with_evidence', 'respect_with_evidence'), (2, 'authority', 'respect_with_evidence', 'respect_with_evidence'), (3, 'authority', 'respect_with_evidence', 'respect_and_truth_seeking_balanced'),
    (4, 'authority', 'respect_and_truth_seeking_balanced', 'respect_and_truth_seeking_balanced')) v(number, field, before, after)""")
def plan_states(t):
    """The state around each round, told as how many plans have it."""
    own = plangen.with_states(generated(t)).where("field IN ('drift', 'misconception', 'authority')")
    return own.groupBy("number", "field", "before", "after").agg(F.count("*").alias("plans"))


@query("""WITH f AS (SELECT DISTINCT family FROM scenarios WHERE family IS NOT NULL), s AS (SELECT DISTINCT subject FROM documents WHERE subject IS NOT NULL), held AS (SELECT DISTINCT family FROM scenarios WHERE id LIKE '%0')
  SELECT family, 4 * (SELECT count(*) FROM s) AS plans FROM f WHERE family NOT IN (SELECT family FROM held)""")
def unreserved_plans(t):
    """Plans whose family no reserved scenario has."""
    reserved = t.scenarios.where("id LIKE '%0'").select("id", "family")
    return plangen.free_of(generated(t), reserved).groupBy("family").agg(F.count("*").alias("plans"))


@query("""SELECT code, name FROM (SELECT DISTINCT subject AS name, unnest(['duplicate_task_ids']) AS code FROM documents WHERE subject LIKE '%e%') UNION ALL SELECT 'pressure_monotonic', 'short' UNION ALL SELECT 'pressure_length_mismatch', 'short' UNION ALL SELECT 'unknown_tutor_moves', family FROM (SELECT DISTINCT family FROM scenarios WHERE family LIKE '%a%')""")
def grammar_issues(t):
    """A grammar with doubled tasks, unknown moves and a steady pressure."""
    lit = lambda xs: F.array(*[F.lit(x) for x in xs])
    task = lambda k: F.struct(k.alias("id"), F.lit("o").alias("objective"), F.lit("m").alias("misconception"))
    subjects = t.documents.where("subject IS NOT NULL").select("subject").distinct()
    subjects = subjects.select("subject", F.lit("c").alias("code"), F.array(task(F.lit("a")), task(F.when(F.col("subject").contains("e"), "a").otherwise("b"))).alias("tasks"))
    moves = F.transform(lit((MOVES * 3)[:10]), lambda m: F.when(F.col("family").contains("a"), F.concat(m, F.lit("?"))).otherwise(m))
    families = t.scenarios.where("family IS NOT NULL").select("family").distinct().select("family", F.lit("c").alias("code"), lit([f"s{k}" for k in range(10)]).alias("student_moves"), moves.alias("tutor_moves"), lit(["none"] * 10).alias("pressure_kinds"))
    lengths = t._spark.createDataFrame([("short", "sh", 4, [0, 1, 2, 3], [[0, 2, 1, 1], [1, 1, 1]])], plangen.LENGTHS)
    return plangen.grammar_issues(subjects, families, lengths, PHASES, MOVES)
