"""Queries of the record contracts, splits and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from qanat.functions.hashing import conversation_hash
from qanat.functions.text import stripped_lines
from qanat.operators import audit, contracts
from qanat.plans.registry import query

ROWS = "rows_ AS (SELECT DISTINCT ON (row_id) * FROM release_rows ORDER BY row_id)"
SAID = f"{ROWS}, said AS (SELECT row_id, CAST(i - 1 AS INTEGER) AS turn, messages[i].role AS role, messages[i].content AS content FROM (SELECT row_id, messages, unnest(range(1, len(messages) + 1)) AS i FROM rows_))"
HASH = "sha256(CAST(to_json(list_transform(messages, lambda m: {{'content': {0}, 'role': m.role}})) AS VARCHAR))"
RAW, LINES = HASH.format("m.content"), HASH.format(r"regexp_replace(regexp_replace(regexp_replace(nfc_normalize(m.content), '\r\n?', chr(10), 'g'), '(?m)[\s\p{Z}\x{85}]+$', '', 'g'), '^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$', '', 'g')")
# Release rows with breaches: messages that are too long or blank, one left out in the middle, and the last one gone.
SAYING = "CASE WHEN row_id % 43 = 3 AND i = 2 THEN rpad(m.content, 20001, 'x') WHEN row_id % 43 = 4 AND i = 2 THEN rpad(m.content, 20000, 'x') WHEN row_id % 47 = 4 AND i = 3 THEN '  ' ELSE m.content END"
BREACHED = f"""spoilt AS (SELECT DISTINCT ON (row_id) * REPLACE (list_transform(messages, lambda m, i: {{'role': m.role, 'content': {SAYING}}}) AS messages) FROM release_rows ORDER BY row_id),
  rows_ AS (SELECT * REPLACE (CASE WHEN row_id % 37 = 1 THEN messages[:len(messages) - 1] WHEN row_id % 41 = 2 THEN list_concat(messages[:1], messages[3:]) ELSE messages END AS messages) FROM spoilt)"""
SPOILT = f"{BREACHED}, said AS (SELECT row_id, CAST(i - 1 AS INTEGER) AS turn, messages[i].role AS role, messages[i].content AS content FROM (SELECT row_id, messages, unnest(range(1, len(messages) + 1)) AS i FROM rows_))"


def once(t, *columns):
    """The wanted columns of each record once; only these are shuffled."""
    return t.release_rows.select("row_id", *columns).dropDuplicates(["row_id"])


def breached(t):
    """The rows of BREACHED, a redelivered one as often as it came."""
    said = lambda m, i: F.when((F.col("row_id") % 43 == 3) & (i == 1), F.rpad(m["content"], 20001, "x")).when((F.col("row_id") % 43 == 4) & (i == 1), F.rpad(m["content"], 20000, "x")).when((F.col("row_id") % 47 == 4) & (i == 2), F.lit("  ")).otherwise(m["content"])
    m = F.transform("messages", lambda m, i: F.struct(m["role"].alias("role"), said(m, i).alias("content")))
    rows = t.release_rows.withColumn("messages", m)
    fewer = F.when(F.col("row_id") % 37 == 1, F.expr("slice(messages, 1, size(messages) - 1)")).when(F.col("row_id") % 41 == 2, F.expr("concat(slice(messages, 1, 1), slice(messages, 3, 1000000))"))
    return rows.withColumn("messages", F.coalesce(fewer, "messages"))


@query(f"WITH {SPOILT} SELECT row_id, turn, role FROM said WHERE role IS DISTINCT FROM CASE WHEN turn = 0 THEN 'system' WHEN turn % 2 = 1 THEN 'user' ELSE 'assistant' END")
def role_sequence_violations(t):
    said = breached(t).select("row_id", F.posexplode("messages").alias("turn", "m")).select("row_id", "turn", "m.role").distinct()
    expected = F.when(F.col("turn") == 0, "system").when(F.col("turn") % 2 == 1, "user").otherwise("assistant")
    return said.where(~F.col("role").eqNullSafe(expected))


@query(f"WITH {BREACHED} SELECT row_id FROM rows_ WHERE messages[-1].role <> 'assistant'")
def conversation_not_closed(t):
    return breached(t).where("try_element_at(messages, -1).role <> 'assistant'").select("row_id").distinct()


@query(f"WITH {SPOILT} SELECT row_id, turn, length(content) AS chars FROM said WHERE trim(content) = '' OR length(content) > 20000")
def message_length_violations(t):
    said = breached(t).select("row_id", F.posexplode("messages").alias("turn", "m")).where("trim(m.content) = '' OR length(m.content) > 20000")
    return said.select("row_id", "turn", F.length("m.content").alias("chars")).distinct()


@query(f"WITH {BREACHED} SELECT row_id, len(pressure_pattern) AS levels, len(list_filter(messages, lambda m: m.role = 'user')) AS user_turns FROM rows_ WHERE len(pressure_pattern) <> len(list_filter(messages, lambda m: m.role = 'user'))")
def turn_count_violations(t):
    users = F.size(F.filter("messages", lambda m: m["role"] == "user"))
    return breached(t).select("row_id", F.size("pressure_pattern").alias("levels"), users.alias("user_turns")).where("levels <> user_turns").distinct()


def _sql_rules() -> str:
    def enum(c, values):
        return f"{c} IS NULL OR {c} NOT IN ({', '.join(repr(v) for v in values)})"

    shape = "(messages IS NULL OR len(messages) NOT BETWEEN 3 AND 41)"
    pressure = "(pressure_pattern IS NULL OR len(pressure_pattern) NOT BETWEEN 1 AND 20 OR len(list_filter(pressure_pattern, lambda x: x NOT BETWEEN 0 AND 5)) > 0)"
    tags = f"(tags IS NOT NULL AND (len(tags) > 30 OR len(list_filter(tags, lambda x: NOT coalesce(regexp_full_match(x, '[a-z0-9][a-z0-9_-]{{1,49}}'), false))) > 0))"
    well = f"(NOT {shape} AND row_id NOT IN (SELECT row_id FROM said WHERE coalesce(trim(content), '') = '' OR length(content) > 20000))"
    good = "coalesce(regexp_full_match(conversation_sha256, '[a-f0-9]{64}'), false)"
    rules = {
        "invalid_split": enum("split", ["train", "validation"]),
        "invalid_language": enum("language", ["en", "en-AE", "ar", "ar-AE"]),
        "invalid_register": enum("register", ["institutional_light", "family_rich"]),
        "invalid_grade_band": enum("grade_band", ["primary_1_5", "middle_6_8", "secondary_9_12", "adult"]),
        **{f"invalid_text_field:{c}": f"{c} IS NULL OR length(trim({c})) < {low} OR length({c}) > {high}" for c, low, high in (("subject", 2, 80), ("learning_objective", 10, 500), ("scenario_family", 3, 100))},
        "invalid_tags": tags,
        "duplicate_tags": f"NOT {tags} AND coalesce(len(list_distinct(tags)) < len(tags), false)",
        "invalid_messages": shape,
        "invalid_role_sequence": f"NOT {shape} AND row_id IN (SELECT row_id FROM said WHERE role IS DISTINCT FROM CASE WHEN turn = 0 THEN 'system' WHEN turn % 2 = 1 THEN 'user' ELSE 'assistant' END)",
        "invalid_message_content": f"NOT {shape} AND row_id IN (SELECT row_id FROM said WHERE coalesce(trim(content), '') = '' OR length(content) > 20000)",
        "conversation_not_closed": f"NOT {shape} AND messages[-1].role IS DISTINCT FROM 'assistant'",
        "invalid_conversation_hash": f"{well} AND NOT {good}",
        "conversation_hash_mismatch": f"{well} AND {good} AND conversation_sha256 <> {LINES}",
        "invalid_pressure_pattern": pressure,
        "pressure_turn_mismatch": f"NOT {pressure} AND len(pressure_pattern) <> len(list_filter(messages, lambda m: m.role = 'user'))",
    }
    return " UNION ALL ".join(f"SELECT row_id, '{k}' AS code FROM rows_ WHERE {v}" for k, v in rules.items())


@query(f"WITH {SPOILT} {_sql_rules()}")
def contract_issues(t):
    return contracts.issues(breached(t)).distinct()


@query(f"""WITH {SPOILT}, found AS ({_sql_rules()}) SELECT (SELECT count(*) FROM rows_) AS records, (SELECT count(DISTINCT row_id) FROM found) AS broken_records, count(*) AS issues, count(DISTINCT code) AS codes FROM found""")
def contract_report(t):
    found = contracts.issues(breached(t)).distinct()
    total = t.release_rows.agg(F.countDistinct("row_id").alias("records"))
    return total.crossJoin(F.broadcast(found.agg(F.countDistinct("row_id").alias("broken_records"), F.count("*").alias("issues"), F.countDistinct("code").alias("codes"))))  # one row each


@query(f"WITH {ROWS} SELECT row_id, {RAW} AS raw, {HASH.format('trim(m.content)')} AS trimmed, {LINES} AS lines, {LINES} = conversation_sha256 AS matches FROM rows_")
def conversation_hashes(t):
    """The three variants: contents as they are, without blanks around them, and in NFC with even line ends."""
    m = F.col("messages")
    own = t.release_rows.select("row_id", "conversation_sha256", conversation_hash(m).alias("raw"), conversation_hash(m, F.trim).alias("trimmed"), conversation_hash(m, stripped_lines).alias("lines")).dropDuplicates(["row_id"])
    return own.select("row_id", "raw", "trimmed", "lines", (F.col("lines") == F.col("conversation_sha256")).alias("matches"))


PROFILE = ["split", "language", "register", "corpus_role", "subject", "scenario_family", "grade_band"]


@query(f"WITH {ROWS}, long AS (" + " UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS value FROM rows_" for c in PROFILE) + ") SELECT field, value, count(*) AS rows FROM long WHERE value IS NOT NULL GROUP BY field, value")
def categorical_profile(t):
    return contracts.profile(once(t, *PROFILE), PROFILE)


@query(f"WITH {ROWS}, c AS (SELECT * FROM rows_ QUALIFY count(*) OVER (PARTITION BY conversation_sha256) > 1) SELECT conversation_sha256, count(*) AS records, min(row_id) AS first_row_id, count(DISTINCT split) AS splits FROM c GROUP BY 1")
def duplicate_conversations(t):
    own = once(t, "conversation_sha256", "split")
    return own.where("conversation_sha256 IS NOT NULL").groupBy("conversation_sha256").agg(F.count("*").alias("records"), F.min("row_id").alias("first_row_id"), F.countDistinct("split").alias("splits")).where("records > 1")


@query("""WITH u AS (SELECT DISTINCT compiler_assignment_id AS k FROM release_rows WHERE compiler_assignment_id IS NOT NULL), p AS (SELECT DISTINCT compiler_assignment_id AS k FROM limitation_ledger WHERE compiler_assignment_id IS NOT NULL)
  SELECT CASE WHEN u.k IS NULL THEN 'extra' WHEN p.k IS NULL THEN 'missing' ELSE 'both' END AS status, count(*) AS keys FROM u FULL JOIN p ON u.k = p.k GROUP BY 1""")
def partition_audit(t):
    key = "compiler_assignment_id"
    return audit.partition_audit(t.release_rows.where(f"{key} IS NOT NULL"), t.limitation_ledger.where(f"{key} IS NOT NULL"), key)


@query(f"""WITH {ROWS}, long AS (
  SELECT split, 'source_group' AS key, provenance.source_group_id AS value FROM rows_ UNION ALL SELECT split, 'source_family', provenance.source_family_key FROM rows_ UNION ALL SELECT split, 'conversation', conversation_sha256 FROM rows_),
  v AS (SELECT key, value, min(split) <> max(split) AS parted FROM long WHERE split IS NOT NULL AND value IS NOT NULL GROUP BY key, value)
  SELECT key, count(*) FILTER (parted) AS shared FROM v GROUP BY key""")
def split_isolation(t):
    keys = {"source_group": F.col("provenance.source_group_id"), "source_family": F.col("provenance.source_family_key"), "conversation": F.col("conversation_sha256")}
    return audit.split_overlaps(t.release_rows, keys)


@query("""WITH g AS (SELECT coalesce(source_group_id, 'doc:' || doc_id) AS "group", count(*) AS rows FROM documents GROUP BY 1),
  o AS (SELECT *, coalesce(sum(rows) OVER (ORDER BY sha256('split-1' || "group") ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(rows) OVER () AS total FROM g)
  SELECT "group", rows, CASE WHEN before < total * 0.1 THEN 'validation' ELSE 'train' END AS split FROM o""")
def group_split(t):
    return audit.group_split(t.documents, F.coalesce("source_group_id", F.concat(F.lit("doc:"), "doc_id")), 0.1, "split-1")


@query("SELECT coalesce(split, 'None') AS split, coalesce(tier, 'None') AS tier, grouping(coalesce(split, 'None')) AS all_splits, grouping(coalesce(tier, 'None')) AS all_tiers, count(*) AS lines FROM limitation_ledger GROUP BY CUBE (coalesce(split, 'None'), coalesce(tier, 'None'))")
def split_tier_cube(t):
    own = t.limitation_ledger.select(F.coalesce("split", F.lit("None")).alias("split"), F.coalesce("tier", F.lit("None")).alias("tier"))
    cube = own.cube("split", "tier").agg(F.grouping("split").cast("bigint").alias("all_splits"), F.grouping("tier").cast("bigint").alias("all_tiers"), F.count("*").alias("lines"))
    return cube.select("split", "tier", "all_splits", "all_tiers", "lines")


@query(f"WITH {ROWS} SELECT split, count(*) AS records, count(*) FILTER (corpus_role = 'grounded') AS grounded, count(*) FILTER (corpus_role = 'grounded') * 5 = count(*) AS exact_fifth FROM rows_ GROUP BY split")
def ratio_check(t):
    own = once(t, "split", "corpus_role")
    return own.groupBy("split").agg(F.count("*").alias("records"), F.count_if(F.col("corpus_role") == "grounded").alias("grounded")).withColumn("exact_fifth", F.col("grounded") * 5 == F.col("records"))


@query(f"""WITH {ROWS}, led AS (SELECT DISTINCT * FROM limitation_ledger WHERE compiler_assignment_id IS NOT NULL), twice AS (SELECT compiler_assignment_id FROM limitation_ledger WHERE compiler_assignment_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
  j AS (SELECT r.conversation_sha256 AS h, l.conversation_sha256 AS lh, r.split AS s, l.split AS ls, r.status AS st, l.status AS lst, r.quality.limitations AS lim, l.limitations AS llim, r.compiler_assignment_id AS k, l.compiler_assignment_id AS lk
        FROM (SELECT * FROM rows_ WHERE compiler_assignment_id IS NOT NULL) r FULL JOIN led l USING (compiler_assignment_id))
  SELECT 'ledger_line_missing' AS code, count(*) FILTER (lk IS NULL) AS n_bad FROM j UNION ALL SELECT 'ledger_line_unknown', count(*) FILTER (k IS NULL) FROM j UNION ALL SELECT 'ledger_line_doubled', count(*) FROM twice
  UNION ALL SELECT 'ledger_hash_mismatch', count(*) FILTER (k IS NOT NULL AND lk IS NOT NULL AND h IS DISTINCT FROM lh) FROM j
  UNION ALL SELECT 'ledger_split_mismatch', count(*) FILTER (k IS NOT NULL AND lk IS NOT NULL AND s IS DISTINCT FROM ls) FROM j
  UNION ALL SELECT 'ledger_status_mismatch', count(*) FILTER (k IS NOT NULL AND lk IS NOT NULL AND st IS DISTINCT FROM lst) FROM j""")
def audit_checks(t):
    key = "compiler_assignment_id"
    own = once(t, key, "conversation_sha256", "split", "status").where(f"{key} IS NOT NULL").select(key, F.col("conversation_sha256").alias("h"), F.col("split").alias("s"), F.col("status").alias("st"), F.lit(1).alias("k"))
    ledger = t.limitation_ledger.where(f"{key} IS NOT NULL")
    lines = ledger.distinct().select(key, F.col("conversation_sha256").alias("lh"), F.col("split").alias("ls"), F.col("status").alias("lst"), F.lit(1).alias("lk"))
    both = (F.col("k") == 1) & (F.col("lk") == 1)
    checks = {
        "ledger_line_missing": F.col("lk").isNull(),
        "ledger_line_unknown": F.col("k").isNull(),
        "ledger_hash_mismatch": both & ~F.col("h").eqNullSafe(F.col("lh")),
        "ledger_split_mismatch": both & ~F.col("s").eqNullSafe(F.col("ls")),
        "ledger_status_mismatch": both & ~F.col("st").eqNullSafe(F.col("lst")),
    }
    wide = own.join(lines, key, "full").agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("code"), F.col(n).alias("n_bad")) for n in checks])).alias("x")).select("x.*")
    twice = ledger.groupBy(key).agg(F.count("*").alias("c")).agg(F.count_if(F.col("c") > 1).alias("n_bad"))
    return long.union(twice.select(F.lit("ledger_line_doubled"), "n_bad"))


@query("SELECT compiler_assignment_id, split, coalesce(trainable_in_this_experimental_silver_release, false) AS trainable, array_to_string(list_sort(coalesce(limitations, [])), '; ') AS limitations FROM (SELECT DISTINCT * FROM limitation_ledger) WHERE compiler_assignment_id IS NOT NULL AND len(coalesce(limitations, [])) > 0")
def limitation_lines(t):
    own = t.limitation_ledger.distinct().where("compiler_assignment_id IS NOT NULL AND size(coalesce(limitations, array())) > 0")
    return own.select("compiler_assignment_id", "split", F.coalesce("trainable_in_this_experimental_silver_release", F.lit(False)).alias("trainable"), F.array_join(F.sort_array("limitations"), "; ").alias("limitations"))


@query(f"WITH {ROWS} SELECT row_id, len(list_intersect(list_distinct(tags), [replace(scenario_family, '_', '-'), subject])) AS expected_tags, len(list_filter(list_distinct(tags), lambda x: x NOT IN (replace(scenario_family, '_', '-'), subject))) AS other_tags FROM rows_ WHERE tags IS NOT NULL AND scenario_family IS NOT NULL AND subject IS NOT NULL")
def array_set_ops(t):
    own = t.release_rows.where("tags IS NOT NULL AND scenario_family IS NOT NULL AND subject IS NOT NULL").select("row_id", "tags", F.array(F.replace("scenario_family", F.lit("_"), F.lit("-")), "subject").alias("e")).dropDuplicates(["row_id"])
    return own.select("row_id", F.size(F.array_intersect("tags", "e")).cast("bigint").alias("expected_tags"), F.size(F.array_except("tags", "e")).cast("bigint").alias("other_tags"))


@query("SELECT compiler_assignment_id FROM release_rows r WHERE compiler_assignment_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM writer_log w WHERE w.row_id = r.row_id AND w.event_type = 'candidate') GROUP BY 1")
def pending_work(t):
    done = t.writer_log.where("event_type = 'candidate' AND row_id IS NOT NULL").select("row_id")
    return t.release_rows.where("compiler_assignment_id IS NOT NULL").join(done, "row_id", "left_anti").select("compiler_assignment_id").distinct()


@query(f"""WITH {BREACHED}, own AS (SELECT *, CASE WHEN row_id % 61 = 7 THEN 'You are a tutor.' ELSE messages[1].content END AS s FROM rows_), first AS (SELECT arg_min(s, {{'n': -n, 's': s}}) AS usual FROM (SELECT s, count(*) AS n FROM own GROUP BY s))
  SELECT row_id, 'too_few_messages' AS code FROM own WHERE len(messages) < 3 UNION ALL SELECT row_id, 'wrong_system_message' FROM own, first WHERE s <> usual
  UNION ALL SELECT row_id, 'malformed_message' FROM own WHERE len(list_filter(messages, lambda m, i: m.role <> (CASE WHEN i = 1 THEN 'system' WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END) OR coalesce(trim(m.content), '') = '')) > 0
  UNION ALL SELECT row_id, 'tutor_not_last' FROM own WHERE messages[-1].role <> 'assistant'
  UNION ALL SELECT row_id, 'conversation_hash_mismatch' FROM own WHERE row_id % 61 = 7 OR {RAW} <> conversation_sha256""")
def release_message_issues(t):
    """Rows with breaches held against the most common system message."""
    m = F.transform("messages", lambda m, i: F.struct(m["role"].alias("role"), F.when((F.col("row_id") % 61 == 7) & (i == 0), "You are a tutor.").otherwise(m["content"]).alias("content")))
    own = breached(t).withColumn("messages", m)
    system = own.select("row_id", F.try_element_at("messages", F.lit(1))["content"].alias("s")).dropDuplicates(["row_id"]).groupBy("s").agg(F.count("*").alias("n"))
    usual = system.agg(F.min_by("s", F.struct(-F.col("n"), "s"))).collect()[0][0] or ""  # one value
    return contracts.issues(own, "row_id", contracts.release_rules(usual)).distinct()


@query(f"WITH {ROWS} SELECT row_id, 'wrong_corpus_role' AS code FROM rows_ WHERE corpus_role IS DISTINCT FROM 'grounded' UNION ALL SELECT row_id, 'pre_split' FROM rows_ WHERE split IS NOT NULL OR split_group_sha256 IS NOT NULL")
def presplit_issues(t):
    return contracts.issues(t.release_rows, "row_id", contracts.presplit_rules("grounded")).distinct()


@query(f"""WITH {ROWS}, q AS (SELECT * FROM (VALUES ('explicit_sparse', 1), ('shared_implicit', 2), ('unheard_of', 5)) v(value, expected)), h AS (SELECT coalesce(expression_class, 'None') AS value, count(*) AS found FROM rows_ GROUP BY 1)
  SELECT coalesce(q.value, h.value) AS value, CAST(coalesce(expected, 0) AS BIGINT) AS expected, coalesce(found, 0) AS found FROM q FULL JOIN h ON q.value = h.value WHERE coalesce(expected, 0) <> coalesce(found, 0)""")
def quota_differences(t):
    return contracts.quota_differences(once(t, "expression_class"), "expression_class", {"explicit_sparse": 1, "shared_implicit": 2, "unheard_of": 5})
