"""Structural checks of written dialogues, chat histories and judgments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qanat.functions.text import ascii_words, fenced_json, sentences, space_words
from qanat.operators.contracts import roles_out_of_order

# Phrases that the writer rules know.
CONCEPT = r"\b(?:niyyah|amanah|ihsan|(?:intellectual\s+)?humility)\b"
STOCK = r"\b(?:part of (?:the )?amanah|amanah\s+(?:here\s+)?means|(?:intellectual\s+)?humility\s+(?:here\s+)?means|(?:amanah|ihsan|niyyah|(?:intellectual\s+)?humility)\s+is\s+not)\b"
DEVOTIONAL = r"\b(?:allah|in\s*sha(?:a)?\s*allah|masha(?:a)?llah|subhanallah|qur(?:a|’|')?an|hadith|sunnah|dua|bismillah|alhamdulillah)\b"
FORMULAIC_OPENING = r"^\s*(?:yes\b|correct\b|exactly\b|that is\b|great job\b|good job\b)"
IMPERATIVE = r"\b(?:use|show|demonstrate|apply|practice)\s+(?:niyyah|amanah|ihsan|(?:intellectual\s+)?humility)\b|\b(?:niyyah|amanah|ihsan|(?:intellectual\s+)?humility)\s+by\b"
DECORATIVE = r"(?:^|[.!?]\s+)(?:niyyah|amanah|ihsan|(?:intellectual\s+)?humility)\s*:|\b(?:niyyah|amanah|ihsan|(?:intellectual\s+)?humility)\s+(?:appears?|enters?|is\s+(?:shown|demonstrated|reflected|practised|practiced))\b"
ACTION_STEMS = [
    "audit", "calculat", "check", "classif", "compar", "correct", "draw", "examin", "explain", "identif",
    "justify", "label", "mark", "place", "rank", "record", "recomput", "revis", "rewrite", "run",
    "show", "sketch", "solv", "sort", "state", "summar", "test", "trace", "verif", "write",
]
REQUEST = r"\b(?:please|can you|could you|your task is to|I want you to|now\s+(?:audit|calculate|check|compare|correct|identify|mark|record|revise|run|state|test|trace|verify|write))\b"
CONCEPT_ACTION = r"\b(?:check|compare|verify|revise|correct|recalculate|cite|label|mark|distinguish|trace|explain|state|write|show|record|acknowledge|test|attribute|separate)\w*\b"
CONCEPT_ASKS = r"\b(?:calls for|leaves one|adds one|take the form of|is to)\b"
PERFORMANCE = r"\bI\s+(?:audited|calculated|checked|classified|compared|corrected|drew|examined|explained|identified|justified|labeled|labelled|marked|placed|ranked|recorded|recomputed|revised|rewrote|ran|showed|sketched|solved|sorted|stated|summarized|tested|traced|verified|wrote|found|got)\b|\b(?:output|value|total|claim|case|boundary|criterion|ledger|source|evidence|trace)\b[^.!?]{0,100}\b(?:is|are|prints?|gives?|shows?|supports?|fails?|passes?|changes?|equals?)\b"
UPTAKE = r"\b(?:your|that|this|the result|the check|the audit|the comparison|the calculation|the trace|the evidence|the revision|the case|the criterion)\b"
STOPWORDS = [
    "about", "after", "again", "against", "also", "because", "before", "being", "between", "both",
    "could", "does", "each", "from", "have", "here", "into", "just", "more", "must",
    "only", "other", "report", "should", "than", "that", "their", "them", "then", "there",
    "these", "they", "this", "those", "through", "under", "using", "what", "when", "where",
    "which", "while", "with", "would", "your", "amanah", "ihsan", "niyyah", "humility", "intellectual",
    "answer", "result", "step", "work",
]
ASSISTANT_WORDS, USER_WORDS = 260, 160
HISTORY_MESSAGES, HISTORY_CHARS = 40, 4000
CONCEPTS = {"humility": "intellectual humility", "intellectual humility": "intellectual humility", "amanah": "amanah", "ihsan": "ihsan", "niyyah": "niyyah"}
# What each exchange of a dialogue is for, by their number.
EXCHANGES = {
    5: [
        "localize the learner's attempt and give the first bounded check",
        "use that result to teach the governing anchor or rule",
        "run one new evidence, pressure, or explicit-concept branch",
        "apply the rule to a genuinely changed transfer",
        "use the learner's final work to consolidate without an unanswered task",
    ],
    7: [
        "localize the learner's attempt and give the first bounded check",
        "use that result to teach the governing anchor or rule",
        "guide one partial application without completing the learner's work",
        "run one new evidence or explicit-concept branch",
        "realize the assigned pressure profile or a non-pressure variation",
        "apply the rule to a genuinely changed transfer",
        "use the learner's final work to consolidate without an unanswered task",
    ],
    10: [
        "localize the learner's attempt and give the first bounded check",
        "use that result to teach the governing anchor or rule",
        "guide one partial application without completing the learner's work",
        "contrast the misconception with a verified case",
        "deepen the evidence or representation",
        "run one new explicit-concept branch or a non-pressure variation",
        "realize the assigned pressure profile or a second academic variation",
        "apply the rule to a genuinely changed transfer",
        "complete one independent check that does not repeat prior work",
        "use the learner's final work to consolidate without an unanswered task",
    ],
}


def starts_with_action(text: Column) -> Column:
    """The first word begins with one of the action stems."""
    return F.coalesce(F.try_element_at(ascii_words(text), F.lit(1)).rlike("^(?:" + "|".join(ACTION_STEMS) + ")"), F.lit(False))


def is_request(sentence: Column) -> Column:
    """A question, an action first or after : ; —, or a phrase that asks."""
    clauses = F.filter(F.slice(F.split(sentence, "[:;—]"), 2, 1000), lambda c: F.trim(c) != "")
    return sentence.rlike(r"\?\s*$") | starts_with_action(sentence) | F.exists(clauses, starts_with_action) | sentence.rlike(f"(?i){REQUEST}")


def branch_words(text: Column) -> Column:
    """Distinct words that say what is worked on: no stop words, no short words, no actions."""
    kept = F.filter(ascii_words(text), lambda w: (F.length(w) >= 3) & ~w.rlike("^(?:" + "|".join(ACTION_STEMS) + ")"))
    return F.array_except(F.array_distinct(kept), F.array(*[F.lit(w) for w in STOPWORDS]))


def concept(text: Column) -> Column:
    """One name for a concept; null for any other text."""
    key = F.trim(F.translate(F.lower(text), "_", " "))
    return F.element_at(F.create_map(*[F.lit(x) for pair in CONCEPTS.items() for x in pair]), key)


def exchange_plan(rows: DataFrame, count: str) -> DataFrame:
    """``rows`` with one line per exchange (exchange, required_function); a count without a plan gives none."""
    plans = F.create_map(*[x for n, p in EXCHANGES.items() for x in (F.lit(n), F.array(*[F.lit(f) for f in p]))])
    return rows.select("*", F.posexplode(F.element_at(plans, F.col(count).cast("int"))).alias("exchange", "required_function")).withColumn("exchange", F.col("exchange") + 1)


def writer_rules() -> list[tuple[str, Column]]:
    """Rules over messages in the form of ``contracts.rules``."""
    m = F.col("messages")
    said = lambda role: F.transform(F.filter(m, lambda x: x["role"] == role), lambda x: F.coalesce(x["content"], F.lit("")))
    tutor = said("assistant")
    text = F.array_join(tutor, "\n")
    # as it is asked of the array: an empty one breaks nothing
    end = lambda at: F.coalesce(F.try_element_at(tutor, F.lit(at)).rlike(f"(?i){FORMULAIC_OPENING}"), F.lit(False))
    return [
        ("message_count", F.coalesce((F.size(m) < 3) | (F.size(m) % 2 == 0), F.lit(True))),
        ("role_order", F.coalesce(roles_out_of_order(m), F.lit(True))),
        ("formulaic_first_opening", end(1)),
        ("formulaic_final_opening", end(-1)),
        ("assistant_turn_too_long", F.exists(tutor, lambda x: space_words(x) > ASSISTANT_WORDS)),
        ("user_turn_too_long", F.exists(said("user"), lambda x: space_words(x) > USER_WORDS)),
        ("stock_concept_frame", text.rlike(f"(?i){STOCK}")),
        ("imperative_concept_frame", text.rlike(f"(?i){IMPERATIVE}")),
        ("decorative_concept_frame", text.rlike(f"(?i){DECORATIVE}")),
        ("devotional_language", text.rlike(f"(?i){DEVOTIONAL}")),
        ("several_concepts", F.regexp_count(text, F.lit(f"(?i){CONCEPT}")) > 1),
        ("system_text_leak", F.exists(F.slice(m, 2, 1_000_000), lambda x: F.contains(x["content"], m[0]["content"]))),
    ]


def history_issue(history: Column) -> Column:
    """Why a chat history can't be continued; null if it can. An empty or null one can."""
    turns = F.transform(history, lambda m, i: (m["role"] == F.when(i % 2 == 0, "user").otherwise("assistant")) & (F.trim(m["content"]) != ""))
    return (
        F.when(F.size(history) > HISTORY_MESSAGES, "too_long")
        .when(F.exists(turns, lambda ok: ~F.coalesce(ok, F.lit(False))), "malformed")
        .when((F.size(history) > 0) & (F.try_element_at(history, F.lit(-1))["role"] != "assistant"), "incomplete")
        .when(F.exists(history, lambda m: F.length(m["content"]) > HISTORY_CHARS), "message_too_long")
    )


def judgments(answers: DataFrame, dimensions: list[str], gates: list[str]) -> DataFrame:
    """(id, issue, score_total, hard_gate_pass, delete_test_pass, strict_pass) of judges' JSON answers (id, answer).

    Scores must be whole numbers 0-2 and gates booleans; a boolean is no number. An answer with an issue has null measures.
    """
    v = F.try_parse_json(fenced_json(F.col("answer")))
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    score = {d: F.try_variant_get(v, f"$.scores.{d}", "int") for d in dimensions}
    bad_score = [F.coalesce(~kind(f"$.scores.{d}").isin("BIGINT", "TINYINT", "SMALLINT", "INT") | ~score[d].between(0, 2), F.lit(True)) for d in dimensions]
    bad_gate = [F.coalesce(kind(f"$.hard_gates.{g}") != "BOOLEAN", F.lit(True)) for g in gates]
    test = "$.delete_respect_sentence"
    flags = [F.coalesce(kind(f"{test}.{x}") != "BOOLEAN", F.lit(True)) for x in ("applicable", "explanation_unchanged_after_deletion")]
    applicable, unchanged = (F.try_variant_get(v, f"{test}.{x}", "boolean") for x in ("applicable", "explanation_unchanged_after_deletion"))
    candidate = F.try_variant_get(v, f"{test}.candidate_sentence", "string")
    anyof = lambda xs: F.exists(F.array(*xs), lambda x: x)
    issue = F.when(v.isNull(), "invalid_json").when(anyof(bad_score), "invalid_score").when(anyof(bad_gate), "invalid_gate").when(anyof(flags), "invalid_diagnostic").when(applicable & (F.coalesce(candidate, F.lit("")) == ""), "missing_candidate")
    total = sum(score.values(), F.lit(0))
    gate_pass = ~anyof([F.try_variant_get(v, f"$.hard_gates.{g}", "boolean") for g in gates])
    delete_pass = ~(applicable & unchanged)
    wide = answers.select("id", issue.alias("issue"), total.alias("t"), gate_pass.alias("g"), delete_pass.alias("d"))
    ok = F.col("issue").isNull()
    return wide.select("id", "issue", F.when(ok, F.col("t")).alias("score_total"), F.when(ok, F.col("g")).alias("hard_gate_pass"), F.when(ok, F.col("d")).alias("delete_test_pass"), F.when(ok, (F.col("t") == 2 * len(dimensions)) & F.col("g") & F.col("d")).alias("strict_pass"))


def requests(texts: DataFrame) -> DataFrame:
    """(id, sentences, requests) of (id, text)."""
    s = sentences(F.col("text"))
    return texts.select("id", F.size(s).alias("sentences"), F.size(F.filter(s, is_request)).alias("requests"))


def branch_preflight(messages: Column) -> Column:
    """(issue, concept_message, novel, learner_overlap, tutor_overlap): why a conversation carries no branch that hangs on its one concept, else a null issue.

    One assistant message names a concept, in one sentence, its last, which is the message's only request and brings words that no earlier assistant
    message has; the learner does it next and repeats one of them, and the following assistant message takes up what the learner said.
    Rules are tried in this order; the first that fails is the issue.
    """
    bears = lambda x: F.coalesce(x.rlike(f"(?i){CONCEPT}"), F.lit(False))
    at = F.filter(F.transform(messages, lambda m, i: F.when((m["role"] == "assistant") & bears(m["content"]), i)), lambda i: i.isNotNull())
    c = F.try_element_at(at, F.lit(1))
    text = lambda i: F.coalesce(F.get(messages, i)["content"], F.lit(""))
    role = lambda i: F.get(messages, i)["role"]
    said = sentences(text(c))
    bearing = F.filter(said, bears)
    last = F.coalesce(F.try_element_at(said, F.lit(-1)), F.lit(""))
    asks = is_request(last) | (last.rlike(f"(?i){CONCEPT_ACTION}") & last.rlike(f"(?i){CONCEPT_ASKS}"))
    others = F.size(F.filter(F.slice(said, F.lit(1), F.greatest(F.size(said) - 1, F.lit(0))), is_request))
    prior = F.array_join(F.transform(F.filter(F.slice(messages, F.lit(1), F.coalesce(c, F.lit(0))), lambda m: m["role"] == "assistant"), lambda m: m["content"]), " ")
    novel = F.array_except(branch_words(last), branch_words(prior))
    learner, tutor = branch_words(text(c + 1)), branch_words(text(c + 2))
    repeated, taken = F.array_intersect(novel, learner), F.array_intersect(learner, tutor)
    issue = (
        F.when(F.size(at) != 1, "concept_turns")
        .when(c + 2 >= F.size(messages), "branch_not_carried_on")
        .when(F.size(bearing) != 1, "concept_sentences")
        .when(~bears(last), "concept_not_last")
        .when(~asks, "no_request")
        .when(others > 0, "several_requests")
        .when(F.size(novel) == 0, "nothing_novel")
        .when((role(c + 1) != "user") | (role(c + 2) != "assistant"), "role_order")
        .when(~text(c + 1).rlike(f"(?i){PERFORMANCE}") | (F.size(repeated) == 0), "not_performed")
        .when(~text(c + 2).rlike(f"(?i){UPTAKE}") | (F.size(taken) == 0), "not_taken_up")
    )
    some = lambda x: F.when(F.size(at) == 1, F.array_sort(x))
    return F.struct(issue.alias("issue"), F.when(F.size(at) == 1, c).alias("concept_message"), some(novel).alias("novel"), some(repeated).alias("learner_overlap"), some(taken).alias("tutor_overlap"))
