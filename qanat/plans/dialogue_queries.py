"""Queries of the writer's structural checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from qanat.operators import contracts, dialogue
from qanat.plans.contract_queries import BREACHED, breached
from qanat.plans.registry import query


def _q(p: str) -> str:
    return "'(?i)" + p.replace("'", "''") + "'"


STEM = "'^(?:" + "|".join(dialogue.ACTION_STEMS) + ")'"
FIRST_WORD = "coalesce(regexp_matches(regexp_extract_all(lower({0}), '[a-z0-9]+(?:[-_][a-z0-9]+)*')[1], " + STEM + "), false)"


def _rules() -> str:
    long = "len(list_filter(list_transform(list_filter(messages, lambda m: m.role = '{0}'), lambda m: len(regexp_extract_all(m.content, '[^\\s]+'))), lambda n: n > {1})) > 0"
    tutor = "list_transform(list_filter(messages, lambda m: m.role = 'assistant'), lambda m: m.content)"
    text = f"array_to_string({tutor}, chr(10))"
    rules = {
        "message_count": "len(messages) < 3 OR len(messages) % 2 = 0",
        "role_order": "len(list_filter(messages, lambda m, i: m.role <> CASE WHEN i = 1 THEN 'system' WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END)) > 0",
        "formulaic_first_opening": f"coalesce(regexp_matches(({tutor})[1], {_q(dialogue.FORMULAIC_OPENING)}), false)",
        "formulaic_final_opening": f"coalesce(regexp_matches(({tutor})[-1], {_q(dialogue.FORMULAIC_OPENING)}), false)",
        "assistant_turn_too_long": long.format("assistant", dialogue.ASSISTANT_WORDS),
        "user_turn_too_long": long.format("user", dialogue.USER_WORDS),
        "stock_concept_frame": f"regexp_matches({text}, {_q(dialogue.STOCK)})",
        "imperative_concept_frame": f"regexp_matches({text}, {_q(dialogue.IMPERATIVE)})",
        "decorative_concept_frame": f"regexp_matches({text}, {_q(dialogue.DECORATIVE)})",
        "devotional_language": f"regexp_matches({text}, {_q(dialogue.DEVOTIONAL)})",
        "several_concepts": f"len(regexp_extract_all({text}, {_q(dialogue.CONCEPT)})) > 1",
        "system_text_leak": "len(list_filter(messages[2:], lambda m: contains(m.content, messages[1].content))) > 0",
    }
    return " UNION ALL ".join(f"SELECT row_id, '{k}' AS code FROM rows_ WHERE {v}" for k, v in rules.items())


@query(f"WITH {BREACHED} {_rules()}")
def writer_preflight(t):
    return contracts.issues(breached(t), "row_id", dialogue.writer_rules()).distinct()


@query(f"""WITH cut AS (SELECT doc_id AS id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(30), 'g'), chr(30) || '|\\n+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents WHERE text IS NOT NULL),
  long AS (SELECT id, unnest(s) AS x FROM cut),
  asked AS (SELECT id, regexp_matches(x, '\\?\\s*$') OR {FIRST_WORD.format('x')} OR len(list_filter(string_split_regex(x, '[:;—]')[2:], lambda c: trim(c) <> '' AND {FIRST_WORD.format('c')})) > 0 OR regexp_matches(x, {_q(dialogue.REQUEST)}) AS r FROM long)
  SELECT id, CAST(max(len(s)) AS INTEGER) AS sentences, CAST(count(*) FILTER (r) AS INTEGER) AS requests FROM cut LEFT JOIN asked USING (id) GROUP BY id""")
def request_sentences(t):
    return dialogue.requests(t.documents.where("text IS NOT NULL").select(F.col("doc_id").alias("id"), "text"))


@query("""SELECT assignment, count(*) AS exchanges, count(*) FILTER (required LIKE '%branch%') AS branches FROM (
    SELECT row_id AS assignment, unnest(CASE (len(messages) - 1) // 2 WHEN 5 THEN ['a', 'a', 'branch', 'a', 'a'] WHEN 7 THEN ['a', 'a', 'a', 'branch', 'a', 'a', 'a'] WHEN 10 THEN ['a', 'a', 'a', 'a', 'a', 'branch', 'a', 'a', 'a', 'a'] END) AS required
    FROM (SELECT DISTINCT row_id, messages FROM release_rows)) GROUP BY 1""")
def exchange_plans(t):
    own = t.release_rows.select(F.col("row_id").alias("assignment"), F.floor((F.size("messages") - 1) / 2).alias("n")).distinct()
    return dialogue.exchange_plan(own, "n").groupBy("assignment").agg(F.count("*").alias("exchanges"), F.count_if(F.contains("required_function", F.lit("branch"))).alias("branches"))
