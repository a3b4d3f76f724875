"""Queries of the content gate over the messages of release rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from qanat.functions import patterns
from qanat.operators import conversations, gate
from qanat.plans.gate_queries import REFS, grams, references
from qanat.plans.registry import query, words_sql

# A breach of each rule, said after the contents of some assistant messages: (remainder of row_id by 211, sentence).
PLANTED = [
    (3, "Sahih Muslim is where it stands."),
    (5, "Doing this is clearly haram."),
    (7, "Ask for a fatwa first."),
    (11, "The Sunni view is superior."),
    (13, "What a stupid question."),
    (17, "Most expats are always late."),
    (19, "Answer key: b, c, a."),
    (23, "As an AI language model I can't."),
    (29, "Bismillah, inshallah and alhamdulillah!"),
]


def rows(t):
    return t.release_rows.select(F.col("row_id").alias("id"), "messages")


def planted(t):
    """Release rows with breaches in them; every 31st row's messages lose their contents."""
    said = F.lit("")
    for k, x in PLANTED:
        said = F.when(F.col("row_id") % 211 == k, F.lit(" " + x)).otherwise(said)
    text = lambda m: F.when(F.col("row_id") % 31 == 0, F.lit(None)).when(m["role"] == "assistant", F.concat(m["content"], said)).otherwise(m["content"])
    return t.release_rows.select(F.col("row_id").alias("id"), F.transform("messages", lambda m: F.struct(m["role"].alias("role"), text(m).alias("content"))).alias("messages"))


BREACH = "CASE row_id % 211 " + " ".join(f"WHEN {k} THEN ' {x.replace(chr(39), chr(39) * 2)}'" for k, x in PLANTED) + " ELSE '' END"
ROWS = "src AS (SELECT row_id AS id, any_value(messages) AS messages FROM release_rows GROUP BY row_id)"
BROKEN = f"""src AS (SELECT row_id AS id, list_transform(any_value(messages), lambda m: {{'role': m.role, 'content': CASE WHEN row_id % 31 = 0 THEN NULL WHEN m.role = 'assistant' THEN m.content || {BREACH} ELSE m.content END}}) AS messages
  FROM release_rows GROUP BY row_id)"""
SAID = f"""said AS (SELECT id, CAST(i - 1 AS INTEGER) AS message, ms[i].role AS role, ms[i].content AS content FROM (
    SELECT id, ms, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT id, list_filter(messages, lambda m: m.role IS NOT NULL AND m.content IS NOT NULL) AS ms FROM src))),
  worded AS (SELECT id, message, role, {words_sql('content', form=True)} AS w FROM said)"""
TALK = "docs AS (SELECT id, flatten(list(list_concat([role], w) ORDER BY message)) AS w FROM worded WHERE role <> 'system' GROUP BY id)"
NEAR = f"""posts AS (SELECT DISTINCT id, g FROM {grams('(SELECT * FROM docs WHERE len(w) >= 10)', 5)}),
  sizes AS (SELECT id, count(*) AS n FROM posts GROUP BY id),
  useful AS (SELECT g FROM posts GROUP BY g HAVING count(*) BETWEEN 2 AND 100),
  inter AS (SELECT a.id AS l, b.id AS r, count(*) AS s FROM posts a JOIN useful USING (g) JOIN posts b USING (g) WHERE a.id < b.id GROUP BY 1, 2),
  near AS (SELECT l AS left_id, r AS right_id, s / (x.n + y.n - s) AS similarity FROM inter JOIN sizes x ON x.id = l JOIN sizes y ON y.id = r
    JOIN docs dl ON dl.id = l JOIN docs dr ON dr.id = r WHERE dl.w <> dr.w AND s / (x.n + y.n - s) >= 0.82)"""
OPEN = """opened AS (SELECT id, message, array_to_string(w[1:8], ' ') AS opening FROM worded WHERE role = 'assistant' AND len(w) >= 8),
  repeated AS (SELECT opening, count(*) AS occurrences, count(DISTINCT id) AS records FROM opened GROUP BY 1 HAVING count(DISTINCT id) >= 3)"""
SPANS = f"""places AS (SELECT id, g, min(message) AS message FROM {grams('worded', 16, 'id, message')} GROUP BY id, g),
  sets AS (SELECT g, list_sort(list({{'id': id, 'message': message}})) AS occ FROM places GROUP BY g HAVING count(*) > 1),
  spans AS (SELECT min(g) AS span, occ FROM sets GROUP BY occ)"""
RUNS = f"""hits AS (SELECT id, message, ref, a.p, b.p AS q, a.p - b.p AS d FROM {grams('worded', 8, 'id, message')} a JOIN {grams('refs', 8, 'ref')} b USING (g)),
  isles AS (SELECT *, p - row_number() OVER (PARTITION BY id, message, ref, d ORDER BY p) AS i FROM hits),
  runs AS (SELECT id, message, ref, count(*) + 7 AS overlap_words, min(p) AS start, min(q) AS q FROM isles GROUP BY id, message, ref, d, i),
  longest AS (SELECT id, message, ref, overlap_words, start FROM (SELECT *, row_number() OVER (PARTITION BY id, message ORDER BY overlap_words DESC, start, ref, q) AS k FROM runs) WHERE k = 1)"""
# Breaches that the planted sentences make, by code, as plain words to look for.
SAID_WRONG = {
    "scripture_or_hadith_quote_signal": ("block", "sahih muslim"),
    "fatwa_or_religious_ruling_signal": ("block", "doing this is clearly haram"),
    "fatwa_or_sectarian_term_signal": ("review", "fatwa| sunni "),
    "sectarian_language_signal": ("review", "sunni view is superior"),
    "humiliation_or_contempt_signal": ("block", "what a stupid question"),
    "stereotype_or_caricature_signal": ("block", "most expats are always"),
    "cheating_or_answer_leakage_signal": ("block", "answer key:"),
    "assistant_role_leakage_signal": ("review", "as an ai language model"),
    "excessive_religious_decoration_signal": ("review", "bismillah, inshallah and alhamdulillah"),
}
WRONG = "wrong AS (" + " UNION ALL ".join(f"SELECT id, message, '{c}' AS code, '{s}' AS severity FROM said WHERE role = 'assistant' AND regexp_matches(lower(content), '{p}')" for c, (s, p) in SAID_WRONG.items()) + ")"
FLAGS = f"""{REFS}, {SAID}, {TALK}, {NEAR}, {OPEN}, {SPANS}, {RUNS}, {WRONG}, flagged AS (
  SELECT id, code, severity FROM wrong
  UNION ALL SELECT id, 'unscannable_messages', 'block' FROM src WHERE id NOT IN (SELECT id FROM said)
  UNION ALL SELECT id, 'heldout_eval_phrase_overlap', 'block' FROM longest
  UNION ALL SELECT id, 'repeated_templated_opening', 'review' FROM opened JOIN repeated USING (opening)
  UNION ALL SELECT u.x.id, 'suspicious_shared_verbatim_span', 'review' FROM spans, LATERAL (SELECT unnest(occ) AS x) u
  UNION ALL SELECT id, 'exact_corpus_duplicate', 'block' FROM docs WHERE len(w) > 0 AND w IN (SELECT w FROM docs GROUP BY w HAVING count(*) > 1)
  UNION ALL SELECT left_id, 'near_corpus_duplicate', 'block' FROM near UNION ALL SELECT right_id, 'near_corpus_duplicate', 'block' FROM near)"""
DECIDED = "decided AS (SELECT id, CASE WHEN bool_or(severity = 'block') THEN 'block' WHEN count(severity) > 0 THEN 'review' ELSE 'pass' END AS decision, count(severity) AS flags FROM src LEFT JOIN flagged USING (id) GROUP BY id)"


@query(f"WITH {BROKEN}, {SAID}, {WRONG} SELECT id, message, code, severity FROM wrong")
def assistant_pattern_flags(t):
    return conversations.pattern_flags(planted(t)).select("id", "message", "code", "severity")


@query(f"WITH {BROKEN} SELECT id FROM src WHERE id % 31 = 0")
def unscannable_records(t):
    return conversations.unscannable(planted(t))


@query(f"WITH {ROWS}, {SAID}, {OPEN} SELECT * FROM repeated")
def conversation_openings(t):
    return conversations.openings(conversations.worded(rows(t)))


@query(f"WITH {ROWS}, {SAID}, {OPEN} SELECT id, message, opening AS evidence, occurrences FROM opened JOIN repeated USING (opening)")
def conversation_opening_flags(t):
    return conversations.opening_flags(conversations.worded(rows(t)))


@query(f"WITH {ROWS}, {SAID}, {SPANS} SELECT span, len(occ) AS records, occ[1].id AS first_id, occ[-1].id AS last_id FROM spans")
def conversation_spans(t):
    return conversations.shared_spans(conversations.worded(rows(t)))


@query(f"WITH {ROWS}, {SAID}, {SPANS} SELECT u.x.id AS id, u.x.message AS message, span AS evidence, len(occ) - 1 AS peers FROM spans, LATERAL (SELECT unnest(occ) AS x) u")
def conversation_span_flags(t):
    return conversations.span_flags(conversations.worded(rows(t)))


@query(f"WITH {ROWS}, {SAID}, {TALK} SELECT sha256(array_to_string(w, ' ')) AS digest, count(*) AS copies, min(id) AS first_id, max(id) AS last_id FROM docs WHERE len(w) > 0 GROUP BY 1 HAVING count(*) > 1")
def conversation_exact_duplicates(t):
    return conversations.exact_duplicates(conversations.worded(rows(t)))


@query(f"WITH {ROWS}, {SAID}, {TALK}, {NEAR} SELECT * FROM near")
def conversation_near_duplicates(t):
    return conversations.near_duplicates(conversations.worded(rows(t)))


@query(f"WITH {ROWS}, {SAID}, {TALK}, {NEAR.replace('BETWEEN 2 AND 100', '>= 2')} SELECT * FROM near")
def conversation_near_duplicates_uncapped(t):
    return conversations.near_duplicates(conversations.worded(rows(t)), cap=None)


@query(f"WITH {REFS}, {ROWS}, {SAID}, {RUNS} SELECT * FROM longest")
def conversation_overlaps(t):
    return conversations.overlaps(conversations.worded(rows(t)), references(t))


@query(f"WITH {REFS}, {ROWS}, {SAID} SELECT DISTINCT id FROM {grams('worded', 12)} WHERE g IN (SELECT g FROM {grams('refs', 12, 'ref')})")
def conversation_contamination_12(t):
    return gate.contaminated(conversations.worded(rows(t)).select("id", "w"), references(t), 12)


@query(f"WITH {BROKEN}, {FLAGS}, {DECIDED} SELECT id, decision, flags FROM decided")
def conversation_decisions(t):
    own = planted(t)
    return conversations.decisions(own, conversations.flags(own, references(t)))


@query(f"""WITH {BROKEN}, {FLAGS}, {DECIDED} SELECT 'records' AS measure, count(*) AS n FROM src UNION ALL SELECT 'decision:' || decision, count(*) FROM decided GROUP BY 1
  UNION ALL SELECT 'flag:' || code, count(*) FROM flagged GROUP BY 1 UNION ALL SELECT 'failed', CAST(bool_or(decision = 'block') AS BIGINT) FROM decided""")
def conversation_gate_report(t):
    own = planted(t)
    return conversations.report(own, conversations.flags(own, references(t)))


@query(f"""WITH {BROKEN}, {SAID}, {WRONG} SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY code, message) AS INTEGER) AS place, code, message FROM wrong""")
def ordered_flags(t):
    return conversations.ordered(conversations.pattern_flags(planted(t))).select("id", "place", "code", "message")


@query(f"""WITH {ROWS}, {SAID}, {TALK}, {NEAR}, {OPEN}, {SPANS}
  SELECT 'repeated_templated_opening' AS code, 'review' AS severity, min(id) AS first_id, count(DISTINCT id) AS records, opening AS evidence FROM opened JOIN repeated USING (opening) GROUP BY opening
  UNION ALL SELECT 'suspicious_shared_verbatim_span', 'review', occ[1].id, len(occ), span FROM spans
  UNION ALL SELECT 'exact_corpus_duplicate', 'block', min(id), count(*), sha256(array_to_string(w, ' ')) FROM docs WHERE len(w) > 0 GROUP BY w HAVING count(*) > 1
  UNION ALL SELECT 'near_corpus_duplicate', 'block', left_id, 2, printf('5-gram Jaccard=%.3f', similarity) FROM near""")
def conversation_corpus_flags(t):
    return conversations.corpus_flags(rows(t))
