"""Queries of record contracts in JSON, projections, exact splits, set audits, saved outputs and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from qanat.operators import audit, dialogue, evaluations, gate, projections, records
from qanat.plans.contract_queries import ROWS, once
from qanat.plans.conversation_queries import REFS
from qanat.plans.conversation_queries import ROWS as SRC
from qanat.plans.conversation_queries import SAID as WORDS
from qanat.plans.gate_queries import grams, references
from qanat.plans.registry import query

# ------------------------------------------------------------------ JSON records

REQUIRED, ALLOWED = ["id", "messages", "schema_version", "split"], ["id", "messages", "notes", "schema_version", "split"]


def json_lines(t):
    """(line, raw): release rows as JSON, some of them broken, by remainders of row_id."""
    r = F.col("row_id")
    said = F.to_json(F.col("messages"))
    said = F.when(r % 41 == 7, F.regexp_replace(said, r"^\[\{", '[{"name":"x",')).when(r % 43 == 8, F.regexp_replace(said, r"^\[", "[7,")).otherwise(said)
    raw = F.concat(
        F.lit('{"schema_version":"'), F.when(r % 17 == 3, "0.9").otherwise("1.0.0"), F.lit('","id":"'),
        F.when(r % 13 == 4, F.lit("bad id")).otherwise(F.concat(F.lit("rec_"), F.when(r % 53 == 9, r - 1).otherwise(r))), F.lit('",'),
        F.when(r % 23 == 1, "").otherwise('"split":"train",'), F.when(r % 19 == 2, '"extra":1,').otherwise('"notes":null,'), F.lit('"messages":'), said, F.lit("}"),
    )
    raw = F.when(r % 29 == 0, "[1]").when(r % 31 == 5, "{").otherwise(raw)
    return t.release_rows.select(r.alias("line"), raw.alias("raw")).dropDuplicates(["line"])


def reserved(t):
    ids = t.release_rows.where("row_id % 37 = 6").select(F.concat(F.lit("rec_"), "row_id").alias("id"))
    return ids, references(t).select(F.sha2(records.stripped_lines(F.col("text")), 256).alias("sha256"))


NORM = r"regexp_replace(regexp_replace(regexp_replace(nfc_normalize({0}), '\r\n?', chr(10), 'g'), '(?m)[\s\p{{Z}}\x{{85}}]+$', '', 'g'), '^[\s\p{{Z}}\x{{85}}]+|[\s\p{{Z}}\x{{85}}]+$', '', 'g')"
JSON_ISSUES = f"""own AS (SELECT row_id AS line, any_value(messages) AS messages, row_id % 31 = 5 AND row_id % 29 <> 0 AS broken, row_id % 29 = 0 AS listed,
    CASE WHEN row_id % 13 = 4 THEN 'bad id' ELSE 'rec_' || (CASE WHEN row_id % 53 = 9 THEN row_id - 1 ELSE row_id END) END AS id FROM release_rows GROUP BY row_id),
  obj AS (SELECT *, line % 41 = 7 AS named, line % 43 = 8 AND line % 41 <> 7 AS seven, CASE WHEN line % 41 <> 7 AND line % 43 <> 8 THEN sha256(CAST(to_json(list_transform(messages, lambda m: {{'content': {NORM.format('m.content')}, 'role': m.role}})) AS VARCHAR)) END AS hash
    FROM own WHERE NOT broken AND NOT listed),
  issues AS (
    SELECT line, NULL AS record_id, 'invalid_json' AS code, NULL AS detail FROM own WHERE broken UNION ALL SELECT line, NULL, 'record_not_object', NULL FROM own WHERE listed
    UNION ALL SELECT line, id, 'missing_fields', 'split' FROM obj WHERE line % 23 = 1 UNION ALL SELECT line, id, 'unknown_fields', 'extra' FROM obj WHERE line % 19 = 2
    UNION ALL SELECT line, id, 'schema_version', NULL FROM obj WHERE line % 17 = 3 UNION ALL SELECT line, id, 'invalid_id', NULL FROM obj WHERE id = 'bad id'
    UNION ALL SELECT line, id, 'invalid_messages', NULL FROM obj WHERE len(messages) + CASE WHEN seven THEN 1 ELSE 0 END NOT BETWEEN 3 AND 41
    UNION ALL SELECT line, id, 'invalid_message', NULL FROM obj WHERE seven AND len(messages) + 1 BETWEEN 3 AND 41
    UNION ALL SELECT line, id, 'invalid_message_fields', NULL FROM obj WHERE named AND len(messages) BETWEEN 3 AND 41
    UNION ALL SELECT line, id, 'duplicate_id', CAST(first AS VARCHAR) FROM (SELECT line, id, min(line) OVER (PARTITION BY id) AS first FROM obj) WHERE line > first
    UNION ALL SELECT line, id, 'duplicate_conversation', CAST(first AS VARCHAR) FROM (SELECT line, id, min(line) OVER (PARTITION BY hash) AS first FROM obj WHERE hash IS NOT NULL) WHERE line > first
    UNION ALL SELECT line, id, 'heldout_id_match', NULL FROM obj WHERE id IN (SELECT 'rec_' || row_id FROM release_rows WHERE row_id % 37 = 6))"""


@query(f"WITH {JSON_ISSUES} SELECT * FROM issues")
def json_record_issues(t):
    ids, hashes = reserved(t)
    return records.issues(json_lines(t), REQUIRED, ALLOWED, "1.0.0", "rec_[0-9]+", ids, hashes)


@query(f"""WITH {JSON_ISSUES} SELECT (SELECT count(*) FROM own) AS input_lines, (SELECT count(*) FROM own WHERE NOT broken) AS parsed_rows, (SELECT count(*) FROM own) - count(DISTINCT line) AS valid_rows,
  count(DISTINCT line) AS invalid_rows, count(*) AS errors, count(*) FILTER (code LIKE 'heldout_%') AS heldout_matches FROM issues""")
def json_dataset_report(t):
    ids, hashes = reserved(t)
    own = json_lines(t)
    return records.report(own, records.issues(own, REQUIRED, ALLOWED, "1.0.0", "rec_[0-9]+", ids, hashes))


# ------------------------------------------------------------------ projections

TIER = "coalesce(nullif(quality.silver_tier, ''), CASE status WHEN 'accepted_expedited_silver' THEN 'reviewed_accepted_expedited' WHEN 'accepted_unanimous_review' THEN 'reviewed_accepted_dual' WHEN 'accepted_grounded_v3' THEN 'reviewed_accepted_grounded_v3' WHEN 'candidate_unreviewed' THEN 'unreviewed_structural_preflight' END, nullif(status, ''), 'unknown')"
LEDGER = f"compiler_assignment_id, conversation_sha256, corpus_role, expression_class, split, status, {TIER} AS tier, coalesce(quality.limitations, []) AS limitations, true AS trainable_in_this_experimental_silver_release, false AS publication_grade"


@query(f"WITH {ROWS} SELECT {LEDGER.replace('coalesce(quality.limitations, []) AS limitations', 'array_to_string(coalesce(quality.limitations, []), chr(59)) AS limitations')} FROM rows_ WHERE compiler_assignment_id IS NOT NULL")
def ledger_projection(t):
    own = projections.ledger(t.release_rows.dropDuplicates(["row_id"]).where("compiler_assignment_id IS NOT NULL"), "compiler_assignment_id")
    return own.withColumn("limitations", F.array_join("limitations", ";"))


@query(f"""WITH {ROWS}, x AS (SELECT row_id, CASE WHEN corpus_role = 'grounded' THEN coalesce(nullif(provenance.source_family_key, ''), nullif(provenance.source_group_id, '')) END AS k FROM rows_)
  SELECT row_id, k AS source_family_key, sha256(k) AS split_group_sha256 FROM x""")
def source_family_keys(t):
    key = projections.source_family_key(F.col("corpus_role"), F.col("provenance.source_family_key"), F.col("provenance.source_group_id"))
    own = once(t, "corpus_role", "provenance").select("row_id", key.alias("source_family_key"))
    return projections.with_split(own, F.lit("train"), F.col("source_family_key")).select("row_id", "source_family_key", "split_group_sha256")


@query(f"""WITH {ROWS} SELECT row_id, coalesce(language, 'en') AS language, coalesce(register, 'institutional_light') AS register, 1 + 2 * ((len(messages) - 1) // 2) AS message_count,
  CASE WHEN corpus_role = 'grounded' THEN 'grounded' ELSE 'revised' END AS kind, CASE WHEN corpus_role = 'grounded' THEN coalesce(provenance.source_group_id, '') ELSE conversation_sha256 END AS source,
  CASE WHEN corpus_role = 'grounded' THEN len(coalesce(quality.limitations, [])) ELSE 0 END AS limits FROM rows_""")
def writer_packets(t):
    own = projections.fixed_metadata(once(t, "language", "register", "corpus_role", "conversation_sha256", "learning_objective", "scenario_family", "provenance", "quality", F.size("messages").alias("size")), F.floor((F.col("size") - 1) / 2))
    return own.select("row_id", "language", "register", "message_count").join(projections.packets(own, "row_id"), "row_id").select("row_id", "language", "register", "message_count", "packet.kind", "packet.source", F.col("packet.limits").cast("bigint").alias("limits"))


@query("SELECT job_id, scenario_id, condition, turn, score_total, strict_pass FROM (SELECT DISTINCT * FROM turn_results)")
def flat_turns(t):
    """Turns gathered into conversations and laid flat again."""
    keys = ["job_id", "scenario_id", "condition"]
    return projections.flat(projections.nested(t.turn_results.distinct().select(*keys, "turn", "score_total", "strict_pass"), keys, "turn"), keys)


# ------------------------------------------------------------------ splits and audits


@query()
def exact_group_split(t):
    """A tenth of the release rows to the row, in whole source groups."""
    own = once(t, F.nullif(F.trim("provenance.source_group_id"), F.lit("")).alias("g"))
    return audit.exact_split(own, F.col("g"), own.where("g IS NOT NULL").count() // 10, "split-2")


@query(f"""WITH {ROWS}, own AS (SELECT row_id, split, trim(provenance.source_group_id) AS g FROM rows_ WHERE trim(provenance.source_group_id) <> ''), v AS (SELECT count(*) // 10 AS target FROM own)
  SELECT target AS validation_rows, (SELECT count(*) FROM own) - target AS train_rows, 0 AS parted_groups FROM v""")
def exact_group_split_report(t):
    """The split reaches its target exactly and parts no group."""
    s = exact_group_split(t)
    rows = lambda x: F.sum(F.when(F.col("split") == x, F.col("rows")).otherwise(0))
    return s.agg(rows("validation").alias("validation_rows"), rows("train").alias("train_rows"), (F.count("*") - F.countDistinct("group")).alias("parted_groups"))


BLESSED = "(SELECT messages[1].content AS s FROM rows_ GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query(f"""WITH {ROWS}, {SRC}, {WORDS}, {REFS}, led AS (SELECT DISTINCT * FROM limitation_ledger), own AS (SELECT {LEDGER} FROM rows_),
  twelve AS (SELECT DISTINCT id FROM {grams('worded', 12)} WHERE g IN (SELECT g FROM {grams('refs', 12, 'ref')})),
  sizes AS (SELECT id, sum(len(w)) AS n FROM worded GROUP BY id),
  last AS (SELECT row_id, count(DISTINCT sha256(CAST(to_json({{'a': messages, 'b': split, 'c': status, 'd': quality, 'e': provenance, 'f': tags}}) AS VARCHAR))) AS n FROM release_rows GROUP BY row_id)
  SELECT 'ledger_not_exact_union' AS code, (SELECT count(*) FROM (SELECT * FROM own EXCEPT SELECT * FROM led)) + (SELECT count(*) FROM (SELECT * FROM led EXCEPT SELECT * FROM own)) AS n_bad
  UNION ALL SELECT 'ledger_duplicate_ids', count(*) - count(DISTINCT compiler_assignment_id) FROM limitation_ledger WHERE compiler_assignment_id IS NOT NULL
  UNION ALL SELECT 'accepted_dropped_overlap', count(*) FROM (SELECT DISTINCT compiler_assignment_id AS k FROM rows_ WHERE status LIKE 'accepted%' INTERSECT SELECT DISTINCT compiler_assignment_id FROM rows_ WHERE status NOT LIKE 'accepted%')
  UNION ALL SELECT 'wrong_system_message', count(*) FROM rows_ WHERE row_id % 59 = 3 OR messages[1].content <> {BLESSED}
  UNION ALL SELECT 'forced_excluded_version_present', count(*) FROM rows_ WHERE row_id % 97 = 5
  UNION ALL SELECT 'release_membership_or_content', count(*) FROM last WHERE n > 1
  UNION ALL SELECT 'split_row_partition', count(*) FROM rows_ WHERE split IS NULL OR split NOT IN ('train', 'validation', 'test')
  UNION ALL SELECT 'train_validation_lineage_overlap', count(*) FROM (SELECT provenance.source_group_id AS g FROM rows_ WHERE provenance.source_group_id <> '' AND split IN ('train', 'validation') GROUP BY 1 HAVING count(DISTINCT split) > 1)
  UNION ALL SELECT 'split_group_hash', count(*) FROM rows_ WHERE split_group_sha256 IS DISTINCT FROM sha256(nullif(provenance.source_group_id, ''))
  UNION ALL SELECT 'cross_artifact_split_inconsistency', count(*) FROM (SELECT k FROM (SELECT compiler_assignment_id AS k, split FROM rows_ UNION ALL SELECT compiler_assignment_id, split FROM led) WHERE k IS NOT NULL AND split IS NOT NULL GROUP BY k HAVING count(DISTINCT split) > 1)
  UNION ALL SELECT 'ratio', count(*) FROM (SELECT split FROM rows_ WHERE split IS NOT NULL GROUP BY split HAVING count(*) FILTER (corpus_role = 'grounded') * 5 <> count(*))
  UNION ALL SELECT 'frozen_eval_leakage', count(*) FROM twelve
  UNION ALL SELECT 'length_limit_exceeded', count(*) FROM sizes WHERE n > 2048""")
def bundle_audit(t):
    """Each check as a row: its code and how many it finds."""
    columns = ["compiler_assignment_id", "conversation_sha256", "corpus_role", "expression_class", "split", "status", "provenance", "quality", "split_group_sha256", "messages"]
    own = once(t, *columns)
    group = F.nullif("provenance.source_group_id", F.lit(""))
    ledger = t.limitation_ledger.distinct()
    drift = audit.bag_difference(projections.ledger(own, "compiler_assignment_id").distinct(), ledger)
    system = F.try_element_at("messages", F.lit(1))["content"]
    usual = once(t, "messages").groupBy(system.alias("s")).agg(F.count("*").alias("c")).agg(F.min_by("s", F.struct(-F.col("c"), "s")).alias("usual"))
    marked = own.select("row_id", F.when(F.col("row_id") % 59 == 3, F.concat(F.lit("x"), system)).otherwise(system).alias("s")).crossJoin(F.broadcast(usual))  # one row
    excluded = t.release_rows.where("row_id % 97 = 5").select("compiler_assignment_id", "conversation_sha256").distinct()
    versions = t.release_rows.select("row_id", audit.row_hash(["messages", "split", "status", "quality", "provenance", "tags"]).alias("h")).groupBy("row_id").agg(F.countDistinct("h").alias("n"))
    both = own.select("compiler_assignment_id", "split").union(ledger.select("compiler_assignment_id", "split")).where("compiler_assignment_id IS NOT NULL AND split IS NOT NULL")
    words = conversation_lengths(t)
    accepted = own.where("compiler_assignment_id IS NOT NULL").groupBy("compiler_assignment_id").agg(F.countDistinct(F.col("status").startswith("accepted")).alias("n"))
    n = lambda df, c: df.agg(F.count_if(F.coalesce(c, F.lit(False))).alias("n_bad"))
    checks = {
        "ledger_not_exact_union": drift.select((F.col("only_a") + F.col("only_b")).alias("n_bad")),
        "ledger_duplicate_ids": t.limitation_ledger.where("compiler_assignment_id IS NOT NULL").agg((F.count("*") - F.countDistinct("compiler_assignment_id")).alias("n_bad")),
        "accepted_dropped_overlap": n(accepted, F.col("n") > 1),
        "wrong_system_message": n(marked, F.col("s") != F.col("usual")),
        "forced_excluded_version_present": n(own.join(excluded, ["compiler_assignment_id", "conversation_sha256"], "left_semi"), F.lit(True)),
        "release_membership_or_content": n(versions, F.col("n") > 1),
        "split_row_partition": n(own, ~F.coalesce(F.col("split").isin("train", "validation", "test"), F.lit(False))),
        "train_validation_lineage_overlap": n(own.where("split IN ('train', 'validation')").where(group.isNotNull()).groupBy(group.alias("g")).agg(F.countDistinct("split").alias("n")), F.col("n") > 1),
        "split_group_hash": n(own, ~F.col("split_group_sha256").eqNullSafe(F.sha2(group, 256))),
        "cross_artifact_split_inconsistency": n(both.groupBy("compiler_assignment_id").agg(F.countDistinct("split").alias("n")), F.col("n") > 1),
        "ratio": n(own.where("split IS NOT NULL").groupBy("split").agg(F.count_if(F.col("corpus_role") == "grounded").alias("g"), F.count("*").alias("c")), F.col("g") * 5 != F.col("c")),
        "frozen_eval_leakage": n(gate.contaminated(message_words(t).select("id", "w"), references(t), 12), F.lit(True)),
        "length_limit_exceeded": n(words, F.col("words") > 2048),
    }
    out = None
    for code, df in checks.items():
        df = df.select(F.lit(code).alias("code"), "n_bad")
        out = df if out is None else out.union(df)
    return out


def message_words(t):
    from qanat.operators import conversations

    return conversations.worded(t.release_rows.select(F.col("row_id").alias("id"), "messages"))


def conversation_lengths(t):
    return message_words(t).groupBy("id").agg(F.sum(F.size("w")).alias("words"))


@query(f"""WITH {SRC}, {WORDS}, own AS (SELECT DISTINCT ON (row_id) row_id AS id, split, register FROM release_rows ORDER BY row_id), sized AS (SELECT id, coalesce(split, 'None') AS split, coalesce(register, 'None') AS register, sum(len(w)) AS n FROM worded JOIN own USING (id) GROUP BY ALL)
  SELECT split, register, count(*) AS records, sum(n)::BIGINT AS words, max(n)::BIGINT AS longest, quantile_cont(n, 0.95) AS p95, count(*) FILTER (n > 512) AS over_512, sum(greatest(0, n - 512))::BIGINT AS cut_at_512, count(*) FILTER (n > 1024) AS over_1024, sum(greatest(0, n - 1024))::BIGINT AS cut_at_1024
  FROM sized GROUP BY GROUPING SETS ((), (split), (register))""")
def conversation_length_report(t):
    own = once(t, F.coalesce("split", F.lit("None")).alias("split"), F.coalesce("register", F.lit("None")).alias("register"))
    sized = conversation_lengths(t).join(own, F.col("id") == F.col("row_id")).withColumnRenamed("words", "n")
    over = [x for k in (512, 1024) for x in (F.count_if(F.col("n") > k).alias(f"over_{k}"), F.sum(F.greatest(F.lit(0), F.col("n") - k)).alias(f"cut_at_{k}"))]
    c = [F.col("split"), F.col("register")]
    return sized.groupingSets([[], [c[0]], [c[1]]], *c).agg(F.count("*").alias("records"), F.sum("n").alias("words"), F.max("n").alias("longest"), F.percentile("n", 0.95).alias("p95"), *over)


@query(f"WITH {ROWS} SELECT field, count(v) AS values, count(DISTINCT v) AS distinct_values, count(v) = count(DISTINCT v) AS unique FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS v FROM rows_" for c in ("compiler_assignment_id", "conversation_sha256", "split_group_sha256")) + ") GROUP BY field")
def uniqueness_report(t):
    names = ["compiler_assignment_id", "conversation_sha256", "split_group_sha256"]
    return audit.uniqueness(once(t, *names), names)


@query(f"""WITH {ROWS} SELECT compiler_assignment_id, corpus_role FROM rows_ WHERE corpus_role = 'grounded' AND compiler_assignment_id IS NOT NULL
  UNION ALL SELECT compiler_assignment_id, corpus_role FROM rows_ WHERE corpus_role = 'revised' AND compiler_assignment_id IS NOT NULL""")
def union_of_roles(t):
    own = once(t, "compiler_assignment_id", "corpus_role").where("compiler_assignment_id IS NOT NULL").drop("row_id")
    return own.where("corpus_role = 'grounded'").unionByName(own.where("corpus_role = 'revised'"))


@query(f"""WITH {ROWS}, led AS (SELECT compiler_assignment_id AS k, min(conversation_sha256) AS h FROM limitation_ledger WHERE compiler_assignment_id IS NOT NULL GROUP BY 1)
  SELECT row_id, CASE WHEN k IS NULL THEN 'unknown' WHEN h = conversation_sha256 THEN 'pinned' ELSE 'changed' END AS pin FROM rows_ LEFT JOIN led ON k = compiler_assignment_id""")
def pinned_lookup(t):
    """Rows looked up in a ledger by id, with the ledger's hash as a pin."""
    led = t.limitation_ledger.where("compiler_assignment_id IS NOT NULL").groupBy("compiler_assignment_id").agg(F.min("conversation_sha256").alias("h"), F.lit(1).alias("known"))
    own = once(t, "compiler_assignment_id", "conversation_sha256").join(led, "compiler_assignment_id", "left")
    return own.select("row_id", F.when(F.col("known").isNull(), "unknown").when(F.col("h") == F.col("conversation_sha256"), "pinned").otherwise("changed").alias("pin"))


# ------------------------------------------------------------------ saved outputs and scenarios

PART = "(CAST(('0x' || substr(sha256({0}), 1, 4)) AS INTEGER) % 20)"
OUTPUTS = f"""base AS (SELECT s.id AS scenario_id, c.condition, s.id || '::' || c.condition AS job_id, turns AS spec, {PART.format("s.id || '::' || c.condition")} AS k FROM scenarios s, (SELECT DISTINCT condition FROM turn_results WHERE condition IS NOT NULL) c)"""


def outputs(t):
    """Saved outputs of all scenarios under all conditions, some of them broken, by a digit of the hash of their job."""
    conditions = t.turn_results.where("condition IS NOT NULL").select("condition").distinct()
    base = t.scenarios.select(F.col("id").alias("scenario_id"), "turns").crossJoin(F.broadcast(conditions))  # small dimensions
    base = base.withColumn("job_id", F.concat_ws("::", "scenario_id", "condition"))
    k = F.conv(F.substring(F.sha2("job_id", 256), 1, 4), 16, 10).cast("int") % 20
    said = F.transform("turns", lambda x, i: F.struct((i + F.when((F.col("k") == 1) & (i == 1), 2).otherwise(1)).cast("int").alias("turn"), F.when((F.col("k") == 2) & (i == 0), F.concat(x["user"], F.lit("!"))).otherwise(x["user"]).alias("user"), F.when((F.col("k") == 3) & (i == 2), " ").otherwise("an answer").alias("answer")))
    own = base.withColumn("k", k).withColumn("turns", said).withColumn("turns", F.when(F.col("k") == 4, F.expr("slice(turns, 1, size(turns) - 1)")).otherwise(F.col("turns")))
    own = own.withColumn("scenario_id", F.when(F.col("k") == 5, F.concat(F.lit("no_"), "scenario_id")).otherwise(F.col("scenario_id")))
    own = own.withColumn("do_sample", F.col("k") == 6).withColumn("revision", F.when(F.col("k") == 7, F.lit(None)).otherwise(F.lit("r1"))).withColumn("condition", F.when(F.col("k") == 8, F.lit("")).otherwise(F.col("condition")))
    return own.union(own.where("k = 9")).drop("k")


@query(f"""WITH {OUTPUTS} SELECT job_id, 'turn_numbering' AS issue FROM base WHERE k = 1 UNION ALL SELECT job_id, 'user_text_differs' FROM base WHERE k = 2 AND spec[1].user IS NOT NULL UNION ALL SELECT job_id, 'empty_answer' FROM base WHERE k = 3
  UNION ALL SELECT job_id, 'turn_count' FROM base WHERE k = 4 UNION ALL SELECT job_id, unnest(['unknown_scenario', 'job_id_mismatch']) FROM base WHERE k = 5 UNION ALL SELECT job_id, 'sampled' FROM base WHERE k = 6
  UNION ALL SELECT job_id, 'missing_revision' FROM base WHERE k = 7 UNION ALL SELECT job_id, unnest(['invalid_identity', 'job_id_mismatch']) FROM base WHERE k = 8 UNION ALL SELECT job_id, 'duplicate_job' FROM base WHERE k = 9""")
def saved_output_issues(t):
    return evaluations.saved_output_issues(outputs(t), t.scenarios)


@query("""WITH s AS (SELECT * FROM scenarios UNION ALL SELECT * FROM scenarios WHERE title = (SELECT min(title) FROM scenarios))
  SELECT id, 'missing_field' AS issue FROM s WHERE title IS NULL OR family IS NULL OR focus IS NULL UNION ALL SELECT id, 'turn_count' FROM s WHERE len(turns) <> 5
  UNION ALL SELECT id, 'missing_text' FROM s WHERE len(list_filter(turns, lambda x: x.user IS NULL OR x.expected IS NULL OR x.fail_if IS NULL)) > 0
  UNION ALL SELECT id, 'setup_message' FROM s WHERE len(list_filter(setup_messages, lambda m: NOT coalesce(m.role IN ('user', 'assistant') AND m.content IS NOT NULL, false))) > 0
  UNION ALL SELECT id, 'duplicate_id' FROM s GROUP BY id HAVING count(*) > 1""")
def scenario_issues(t):
    """Scenarios, one of them given twice."""
    first = t.scenarios.agg(F.min("title").alias("m"))
    return evaluations.scenario_issues(t.scenarios.union(t.scenarios.join(F.broadcast(first), F.col("title") == F.col("m")).drop("m")))  # one row


@query("""WITH t AS (SELECT DISTINCT * FROM turn_results) SELECT condition, coalesce(round_even(avg(score_total), 4), 0.0) AS mean_total, CASE WHEN count(*) > 0 THEN round_even(100.0::DOUBLE * count(*) FILTER (strict_pass) / count(*), 2) ELSE 0.0 END AS strict_rate FROM t GROUP BY condition""")
def eval_rounded(t):
    """Means to four and percentages to two places, ties to even; 0 for nothing."""
    return t.turn_results.distinct().groupBy("condition").agg(F.coalesce(F.bround(F.avg("score_total"), 4), F.lit(0.0)).alias("mean_total"), F.coalesce(F.bround(F.lit(100.0) * F.count_if("strict_pass") / F.count("*"), 2), F.lit(0.0)).alias("strict_rate"))


# ------------------------------------------------------------------ dialogues

SCRIPT = {
    1: (None, ["Check the zephyr ledger. Humility is to check the zephyr ledger.", "I checked the zephyr ledger.", "Your zephyr ledger holds."], "several_requests"),
    2: (None, ["We have seen it. Humility is to check the zephyr ledger.", "I checked the zephyr ledger.", "Your zephyr ledger holds."], None),
    3: (None, ["Humility is to check the zephyr ledger. We have seen it.", "I checked the zephyr ledger.", "Your zephyr ledger holds."], "concept_not_last"),
    4: (None, ["Humility is kind. Humility is to check the zephyr ledger.", "I checked the zephyr ledger.", "Your zephyr ledger holds."], "concept_sentences"),
    5: (None, ["We have seen it. Humility stays quiet.", "I checked the zephyr ledger.", "Your zephyr ledger holds."], "no_request"),
    6: ("The zephyr ledger is here.", ["We have seen it. Humility is to check the zephyr ledger.", "I checked the zephyr ledger.", "Your zephyr ledger holds."], "nothing_novel"),
    7: (None, ["We have seen it. Humility is to check the zephyr ledger.", "Why the zephyr one?", "Your zephyr ledger holds."], "not_performed"),
    8: (None, ["We have seen it. Humility is to check the zephyr ledger.", "I checked the zephyr ledger.", "Fine, go on."], "not_taken_up"),
    9: (None, ["We have seen it. Humility is to check the zephyr ledger."], "branch_not_carried_on"),
}


@query("SELECT DISTINCT row_id, CASE row_id % 10 " + " ".join(f"WHEN {k} THEN {repr(i) if i else 'NULL'}" for k, (_, _, i) in SCRIPT.items()) + " ELSE 'concept_turns' END AS issue, row_id % 10 = 2 AS carried FROM release_rows WHERE row_id % 10 > 0 OR NOT regexp_matches(lower(array_to_string(list_transform(messages, lambda m: m.content), ' ')), 'niyyah|amanah|ihsan|humility')")
def branch_preflight(t):
    """Release rows, nine in ten of which have scripted messages."""

    def script(first, said):
        start = [("system", "s"), ("user", "Where do we begin?"), ("assistant", first or "We begin here."), ("user", "And now?")]
        return F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in start + [(("assistant", "user")[i % 2], c) for i, c in enumerate(said)]])

    messages = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    for k, (first, said, _) in SCRIPT.items():
        messages = F.when(F.col("row_id") % 10 == k, script(first, said)).otherwise(messages)
    own = t.release_rows.where("row_id % 10 > 0 OR NOT lower(array_join(transform(messages, m -> m.content), ' ')) RLIKE 'niyyah|amanah|ihsan|humility'").select("row_id", messages.alias("m"))
    found = own.select("row_id", dialogue.branch_preflight(F.col("m")).alias("x"))
    return found.select("row_id", "x.issue", F.coalesce(F.array_contains("x.tutor_overlap", "zephyr") & F.col("x.issue").isNull(), F.lit(False)).alias("carried")).distinct()


HISTORY = "list_transform(messages[2:], lambda m: {'role': m.role, 'content': CASE WHEN row_id % 7 = 1 THEN rpad(m.content, 4001, 'y') WHEN row_id % 7 = 2 THEN ' ' ELSE m.content END})"


@query(f"""WITH {ROWS}, h AS (SELECT row_id, CASE WHEN row_id % 7 = 3 THEN {HISTORY}[:1] WHEN row_id % 7 = 4 THEN list_concat({HISTORY}, {HISTORY}, {HISTORY}, {HISTORY}, {HISTORY}, {HISTORY}, {HISTORY}, {HISTORY}) ELSE {HISTORY} END AS h FROM rows_)
  SELECT row_id, CASE WHEN len(h) > 40 THEN 'too_long' WHEN row_id % 7 = 2 AND len(h) > 0 THEN 'malformed' WHEN row_id % 7 = 3 THEN 'incomplete' WHEN len(list_filter(h, lambda m: length(m.content) > 4000)) > 0 THEN 'message_too_long' END AS issue FROM h""")
def chat_history_issues(t):
    """Histories of release rows, some of them too long, blank or open."""
    r = F.col("row_id")
    said = F.transform(F.expr("slice(messages, 2, 1000000)"), lambda m: F.struct(m["role"].alias("role"), F.when(r % 7 == 1, F.rpad(m["content"], 4001, "y")).when(r % 7 == 2, F.lit(" ")).otherwise(m["content"]).alias("content")))
    own = once(t, "messages").select("row_id", said.alias("h"))
    own = own.select("row_id", F.when(r % 7 == 3, F.slice("h", 1, 1)).when(r % 7 == 4, F.flatten(F.array_repeat("h", 8))).otherwise(F.col("h")).alias("h"))
    return own.select("row_id", dialogue.history_issue(F.col("h")).alias("issue"))


DIMS, GATE_NAMES = ["content_accuracy", "dignity"], ["gate_privacy_safe", "gate_no_humiliation"]


@query("""SELECT job_id || '/' || turn AS id, CASE WHEN turn = 4 THEN 'invalid_json' WHEN content_accuracy IS NULL OR dignity IS NULL OR turn = 5 THEN 'invalid_score' WHEN gate_privacy_safe IS NULL OR gate_no_humiliation IS NULL OR turn = 3 THEN 'invalid_gate' END AS issue,
  CASE WHEN turn NOT IN (3, 4, 5) AND content_accuracy IS NOT NULL AND dignity IS NOT NULL AND gate_privacy_safe IS NOT NULL AND gate_no_humiliation IS NOT NULL THEN content_accuracy + dignity END AS score_total
  FROM (SELECT DISTINCT * FROM turn_results)""")
def judgment_answers(t):
    """Judges' answers made of turn results: fenced, broken, with a boolean for a score or a text for a gate."""
    s = F.struct(F.when(F.col("turn") == 5, F.lit("true")).otherwise(F.col("content_accuracy").cast("string")).alias("a"), F.col("dignity").cast("string").alias("d"))
    num = lambda c: F.coalesce(c, F.lit("null"))
    gate_ = lambda c: F.when(F.col("turn") == 3, F.lit('"no"')).otherwise(F.coalesce(F.col(c).cast("string"), F.lit("null")))
    body = F.concat(F.lit('{"scores":{"content_accuracy":'), num(s["a"]), F.lit(',"dignity":'), num(s["d"]), F.lit('},"hard_gates":{"gate_privacy_safe":'), gate_("gate_privacy_safe"), F.lit(',"gate_no_humiliation":'), gate_("gate_no_humiliation"), F.lit('},"delete_respect_sentence":{"applicable":false,"explanation_unchanged_after_deletion":false,"candidate_sentence":""}}'))
    answer = F.when(F.col("turn") == 4, F.concat(F.lit("x"), F.substring(body, 2, 30))).when(F.col("turn") == 2, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    own = t.turn_results.distinct().select(F.concat("job_id", F.lit("/"), "turn").alias("id"), answer.alias("answer"))
    return dialogue.judgments(own, DIMS, GATE_NAMES).select("id", "issue", "score_total")


# ------------------------------------------------------------------ orders, choices and hashes


@query("SELECT row_id, CAST(CAST(('0x' || sha256(CAST(row_id AS VARCHAR))[1:8]) AS BIGINT) % 2 AS INTEGER) AS parity FROM (SELECT DISTINCT row_id FROM release_rows)")
def digest_parity(t):
    """Parity of the first eight digits of a hash."""
    return t.release_rows.select("row_id").distinct().select("row_id", (F.conv(F.substring(F.sha2(F.col("row_id").cast("string"), 256), 1, 8), 16, 10).cast("bigint") % 2).cast("int").alias("parity"))


@query(f"WITH {ROWS}, e AS (SELECT sha256(CAST(to_json({{'conversation_sha256': conversation_sha256, 'row_id': row_id}}) AS VARCHAR)) AS h FROM rows_), f AS (SELECT h[1:4] AS p, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS h FROM e GROUP BY 1), g AS (SELECT p[1:2] AS p, sum(n) AS n, sha256(string_agg(h, '' ORDER BY p)) AS h FROM f GROUP BY 1) SELECT sum(n)::BIGINT AS entries, sha256(string_agg(h, '' ORDER BY p)) AS sha256 FROM g")
def table_fingerprint(t):
    return audit.fingerprint(once(t, "conversation_sha256"), ["row_id", "conversation_sha256"])


@query("SELECT row_number() OVER (ORDER BY input_index, work_id, event_id) AS place, work_id FROM (SELECT DISTINCT ON (event_id) * FROM writer_log ORDER BY event_id, received_at) ORDER BY place LIMIT 100")
def ledger_order(t):
    """The first hundred events of the ledger by input and work id: a top-k report."""
    once_ = audit.latest(t.writer_log.withColumn("early", -F.unix_micros("received_at")), ["event_id"], ["early"], ["input_index", "work_id"])
    top = once_.orderBy(F.asc_nulls_last("input_index"), F.asc_nulls_last("work_id"), "event_id").limit(100)
    return top.select(F.row_number().over(Window.orderBy(F.asc_nulls_last("input_index"), F.asc_nulls_last("work_id"), "event_id")).alias("place"), "work_id")  # a hundred rows


@query("""WITH done AS (SELECT work_id, arg_max(event_type, {'a': event_at, 'b': event_id}) AS last FROM writer_log WHERE work_id IS NOT NULL GROUP BY 1),
  want AS (SELECT DISTINCT row_id, 'work_' || lpad(CAST(row_id AS VARCHAR), 9, '0') AS work_id FROM release_rows WHERE corpus_role = 'grounded')
  SELECT row_id, work_id, last IS NOT NULL AS retried FROM want LEFT JOIN done USING (work_id) WHERE last IS NULL OR last = 'rejected' ORDER BY row_id LIMIT 50""")
def worklist(t):
    """The first fifty grounded records whose work isn't done or was rejected: a prefix in a fixed order is the feature."""
    done = audit.latest(t.writer_log.where("work_id IS NOT NULL"), ["work_id"], ["event_at", "event_id"], ["event_type"])
    want = t.release_rows.where("corpus_role = 'grounded'").select("row_id", F.concat(F.lit("work_"), F.lpad(F.col("row_id").cast("string"), 9, "0")).alias("work_id")).distinct()
    open_ = want.join(done, "work_id", "left").where("event_type IS NULL OR event_type = 'rejected'")
    return open_.select("row_id", "work_id", F.col("event_type").isNotNull().alias("retried")).orderBy("row_id").limit(50)


@query("""SELECT rejection, count(DISTINCT work_id) AS works FROM writer_log WHERE rejection IS NOT NULL AND rejection NOT IN ('missing_check') AND work_id IN (SELECT work_id FROM writer_log GROUP BY 1 HAVING count(*) > 1) GROUP BY 1""")
def feedback_by_reason(t):
    """Reasons of works that have several events, but for one code that says nothing of the work."""
    several = t.writer_log.groupBy("work_id").agg(F.count("*").alias("n")).where("n > 1").select("work_id")
    own = t.writer_log.where("rejection IS NOT NULL AND rejection NOT IN ('missing_check')").join(several, "work_id", "left_semi")
    return own.groupBy("rejection").agg(F.countDistinct("work_id").alias("works"))


@query("""WITH usual AS (SELECT arg_min(writer_contract_version, {'n': -n, 'v': writer_contract_version}) AS v FROM (SELECT writer_contract_version, count(*) AS n FROM writer_log WHERE writer_contract_version IS NOT NULL GROUP BY 1)),
  last AS (SELECT work_id, arg_max(writer_contract_version, {'a': event_at, 'b': event_id}) AS v FROM writer_log WHERE work_id IS NOT NULL AND writer_contract_version IS NOT NULL GROUP BY 1)
  SELECT work_id, 'writer_contract_version' AS field FROM last WHERE v <> (SELECT v FROM usual)""")
def checkpoint_collisions(t):
    """Works whose last event was written under another contract than most."""
    from qanat.streaming import ledger

    usual = t.writer_log.where("writer_contract_version IS NOT NULL").groupBy("writer_contract_version").agg(F.count("*").alias("n")).agg(F.min_by("writer_contract_version", F.struct(-F.col("n"), "writer_contract_version")).alias("writer_contract_version"))
    last = audit.latest(t.writer_log.where("work_id IS NOT NULL AND writer_contract_version IS NOT NULL"), ["work_id"], ["event_at", "event_id"], ["writer_contract_version"])
    return ledger.collisions(last, usual, ["writer_contract_version"])


@query("""SELECT work_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY (event_type = 'candidate') DESC, event_at DESC, event_id DESC) AS k FROM writer_log WHERE work_id IS NOT NULL) WHERE k = 1""")
def ledger_state(t):
    """Where each work stands: a success stays, whatever came later."""
    own = t.writer_log.where("work_id IS NOT NULL").withColumn("won", F.coalesce(F.col("event_type") == "candidate", F.lit(False)))
    return audit.latest(own, ["work_id"], ["won", "event_at", "event_id"], ["event_id", "event_type"])


@query(f"""WITH src AS (SELECT DISTINCT subject FROM release_rows WHERE subject IS NOT NULL) SELECT subject, CAST(seed AS BIGINT) AS seed, lpad(CAST(CAST(('0x' || sha256('v' || seed || ':' || subject)[1:16]) AS UBIGINT) AS VARCHAR), 20, '0') AS number FROM src, range(3, 7) r(seed)""")
def variant_grid(t):
    """Subjects under four consecutive seeds, each with its number."""
    own = t.release_rows.where("subject IS NOT NULL").select("subject").distinct().crossJoin(F.broadcast(t._spark.range(3, 7).toDF("seed")))  # four rows
    number = F.conv(F.substring(F.sha2(F.concat(F.lit("v"), "seed", F.lit(":"), "subject"), 256), 1, 16), 16, 10)
    return own.select("subject", "seed", F.lpad(number, 20, "0").alias("number"))


@query(f"WITH {ROWS} SELECT row_id, map_from_entries(list_transform(tags[:9], lambda x, i: (x, i % 4 > 0))) IS NOT NULL AND len(tags) >= 1 AS all_true, len(list_distinct(tags[:9])) AS keys FROM rows_ WHERE tags IS NOT NULL AND len(list_distinct(tags)) = len(tags) AND len(tags) BETWEEN 1 AND 3")
def quality_maps(t):
    """Maps of checks by tag: their key sets, and whether all of them hold."""
    own = once(t, "tags").where("tags IS NOT NULL AND size(array_distinct(tags)) = size(tags) AND size(tags) BETWEEN 1 AND 3")
    m = F.map_from_arrays("tags", F.transform("tags", lambda x, i: (i + 1) % 4 > 0))
    return own.select("row_id", F.forall(F.map_values(m), lambda v: v).alias("all_true"), F.size(F.map_keys(m)).cast("bigint").alias("keys"))


@query("SELECT condition, scenario_id, turns, row_number() OVER (ORDER BY condition NULLS FIRST, scenario_id) AS place FROM (SELECT condition, scenario_id, count(*) AS turns FROM (SELECT DISTINCT * FROM turn_results) GROUP BY ALL) ORDER BY place LIMIT 200")
def results_order(t):
    """The first two hundred results by condition and scenario: a report of fixed length."""
    order = [F.asc_nulls_first("condition"), F.asc_nulls_first("scenario_id")]
    top = t.turn_results.distinct().groupBy("condition", "scenario_id").agg(F.count("*").alias("turns")).orderBy(*order).limit(200)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # two hundred rows
