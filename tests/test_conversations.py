import re

import pytest
from pyspark.sql import functions as F

from qanat.functions import patterns
from qanat.operators import conversations, gate, projections

SCHEMA = "id int, messages array<struct<role:string,content:string>>"
# One text that each pattern knows and one that it doesn't.
EXAMPLES = {
    "scripture_or_hadith_quote_signal": ("the prophet said so", "the professor said so"),
    "fatwa_or_religious_ruling_signal": ("It is definitely haram", "it is definitely hard"),
    "fatwa_or_sectarian_term_signal": ("ask about Sufi poets", "ask about surf boards"),
    "sectarian_language_signal": ("the shia are superior", "the shia mosque"),
    "humiliation_or_contempt_signal": ("your friend is a moron", "your friend is a monitor"),
    "stereotype_or_caricature_signal": ("Arabs are naturally loud", "Arabs are people"),
    "cheating_or_answer_leakage_signal": ("copy and paste this as your answer", "copy the question first"),
    "assistant_role_leakage_signal": ("my system prompt says no", "my system says no"),
}


@pytest.mark.parametrize("code", sorted(EXAMPLES))
def test_patterns(spark, code):
    yes, no = EXAMPLES[code]
    df = spark.createDataFrame([(1, [("assistant", yes), ("user", yes)]), (2, [("assistant", no)])], SCHEMA)
    got = [(r.id, r.message, r.severity) for r in conversations.pattern_flags(df).where(F.col("code") == code).collect()]
    assert got == [(1, 0, conversations.SEVERITY[code])]
    assert set(EXAMPLES) == {c for c, *_ in patterns.ASSISTANT}


def test_only_what_was_found_travels(spark):
    """The gate's report flags messages where they are read; their texts aren't shuffled."""
    df = spark.createDataFrame([(1, [("assistant", "my system prompt says no")])] * 2, SCHEMA)
    found = conversations.pattern_flags(df)
    assert not re.search(r"hashpartitioning\([^)]*content", found._jdf.queryExecution().executedPlan().toString())
    assert [r.evidence for r in found.collect()] == ["my system prompt says"]


def test_looking_first_loses_no_match(spark):
    """Each pattern alone, on its examples in other cases and with letters that any case takes for s, k and i, finds what the whole bank finds."""
    said = [x for yes, _ in EXAMPLES.values() for x in (yes, yes.upper(), yes.replace("s", "\u017f"), yes.replace("k", "\u212a"), yes.replace("i", "\u0131"), yes.replace("i", "\u0130"))]
    said += ["It is a sin", "it is a\nſin.", "Surah 2:1", "shi’a", "hand in the following as your own answer", "here's the full test", "ANSWER  KEY :", "<a_register>", "as an AI language model", "peace be upon him", "forbidden in islam"]
    df = spark.createDataFrame([(x,) for x in said], "x string")
    alone = F.array_compact(F.array(*[F.when(F.col("x").rlike(f"(?iu){p}"), F.lit(n)) for n, _, _, p in patterns.assistant_bank()]))
    rows = df.select("x", alone.alias("want"), patterns.flags(F.col("x"))["code"].alias("got")).collect()
    assert all(r.want == r.got for r in rows) and sum(map(bool, (r.want for r in rows))) > 40
    words = "Bismillah, Alhamdulillah and AMEEN"
    assert [x.evidence for x in df.limit(1).select(F.explode(patterns.flags(F.lit(words), decorations=3)).alias("f")).select("f.*").collect()] == ["Bismillah, Alhamdulillah, AMEEN"]


def test_the_register_tag_is_a_parameter(spark):
    df = spark.createDataFrame([(1, [("assistant", "<a_register> and <b_tag>")])], SCHEMA)
    assert conversations.pattern_flags(df).count() == 1
    assert conversations.pattern_flags(df, patterns.assistant_bank("b_tag")).collect()[0].evidence == "<b_tag>"


def test_gate_by_hand(spark):
    same = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    held = "held out words that nobody may see in training today"
    df = spark.createDataFrame(
        [
            (1, [("system", "s"), ("user", "q a"), ("assistant", same)]),
            (2, [("system", "s"), ("user", "Q, Ａ!"), ("assistant", same.upper())]),
            (3, [("user", same + " x"), ("assistant", "one two three four five six seven eight done")]),
            (4, [("user", "fine " + held + " indeed")]),
            (5, None),
            (6, [("user", None), (None, "x"), None]),
            (7, []),
            (1, [("system", "s"), ("user", "q a"), ("assistant", same)]),
        ],
        SCHEMA,
    )
    refs = spark.createDataFrame([("r", held), ("n", None), ("e", "")], "ref string, text string")
    found = conversations.flags(df, refs)
    got = {}
    for r in found.collect():
        got.setdefault(r.id, []).append((r.code, r.message))
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 7] and got[5] == got[6] == got[7] == [("unscannable_messages", None)]
    assert got[4] == [("heldout_eval_phrase_overlap", 0)]
    both = [("exact_corpus_duplicate", None), ("repeated_templated_opening", 2), ("suspicious_shared_verbatim_span", 2)]
    assert sorted(got[1], key=str) == sorted(got[2], key=str) == sorted(both, key=str)
    assert sorted(got[3]) == [("repeated_templated_opening", 1), ("suspicious_shared_verbatim_span", 0)]
    assert {r.id: r.decision for r in conversations.decisions(df, found).collect()} == {1: "block", 2: "block", 3: "review", 4: "block", 5: "block", 6: "block", 7: "block"}
    for fail_on, failed in (("never", 0), ("block", 1), ("review", 1)):
        measures = {r.measure: r.n for r in conversations.report(df, found, fail_on).collect()}
        assert measures["failed"] == failed and measures["records"] == 7 and measures["decision:block"] == 6
    only = df.where("id = 3")
    assert {r.measure: r.n for r in conversations.report(only, conversations.flags(only, refs)).collect()} == {"records": 1, "decision:pass": 1, "failed": 0}
    none = df.where("false")
    assert {r.measure: r.n for r in conversations.report(none, conversations.flags(none, refs)).collect()} == {"records": 0, "failed": 0}
    for bad in ({"eval_overlap_words": 2}, {"opening_repeat_min": 1}, {"near_duplicate_threshold": 0}):
        with pytest.raises(ValueError):
            conversations.flags(df, refs, **bad)


def test_cap_is_a_choice(spark):
    """Eleven long texts that share most words: with a cap of ten ids nothing is shared, without one all pairs are near."""
    base = [f"w{k}" for k in range(200)]
    df = spark.createDataFrame([(i, " ".join(base + [f"x{i}"])) for i in range(11)], "id int, text string")
    assert gate.near_duplicates(df, cap=10).count() == 0
    got = gate.near_duplicates(df, cap=None).collect()
    assert len(got) == 55 and all(abs(r.similarity - 196 / 198) < 1e-9 for r in got)


def test_projections(spark):
    df = spark.createDataFrame([(None, "", "r", "s"), ("f", "a", "r", "s"), (None, None, None, "accepted_grounded_v3"), (None, "", "", ""), ("", "a", "b", None)], "f string, silver string, review string, status string")
    assert [r[0] for r in df.select(projections.tier(*map(F.col, df.columns))).collect()] == ["r", "f", "reviewed_accepted_grounded_v3", "unknown", ""]
    df = spark.createDataFrame([("x", ["y"], "z"), (None, ["y"], "z"), (None, None, "z"), (None, None, ""), (None, [], "z")], "a string, b array<string>, c string")
    assert [r[0] for r in df.select(projections.limitations(*map(F.col, df.columns))).collect()] == [["x"], ["y"], ["z"], [], []]
