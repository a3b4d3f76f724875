import json

from pyspark.sql import functions as F

from qanat.operators import contracts, dialogue
from qanat.sources import heldout
from tests.test_text import one


def test_requests(spark):
    for text, want in (("Why?", True), ("Check it.", True), ("Next: compare both.", True), ("Could you go on.", True), ("It is fine.", False), ("", False), ("!!!", False)):
        assert one(spark, text, dialogue.is_request) is want, text


def test_branch_words_and_concepts(spark):
    assert sorted(one(spark, "Check the pulley-angle, the pulley and an ox", dialogue.branch_words)) == ["and", "pulley", "pulley-angle", "the"]
    assert one(spark, " Intellectual_Humility ", dialogue.concept) == "intellectual humility"
    assert one(spark, "other", dialogue.concept) is None


def test_writer_rules(spark):
    schema = "row_id int, messages array<struct<role:string,content:string>>"
    rows = [
        (1, [("system", "TOKEN"), ("user", "hello"), ("assistant", "Let us check.")]),
        (2, [("system", "TOKEN"), ("user", "w " * 161), ("assistant", " Yes, use amanah: w " + "w " * 260), ("user", "TOKEN"), ("assistant", "Amanah means humility.")]),
        (3, []),
        (4, None),
    ]
    got = {}
    for r in contracts.issues(spark.createDataFrame(rows, schema), "row_id", dialogue.writer_rules()).collect():
        got.setdefault(r.row_id, set()).add(r.code)
    assert got.pop(3) == {"message_count"} and got.pop(4) == {"message_count", "role_order"}  # the length of a dialogue is 1 + 2k
    assert got == {2: {"formulaic_first_opening", "assistant_turn_too_long", "user_turn_too_long", "stock_concept_frame", "imperative_concept_frame", "several_concepts", "system_text_leak"}}


def test_history(spark):
    schema = "h array<struct<role:string,content:string>>"
    cases = [(None, None), ([], None), ([("user", "a"), ("assistant", "b")], None), ([("user", "a")], "incomplete"), ([("assistant", "a")], "malformed"), ([("user", " "), ("assistant", "b")], "malformed"), ([("user", "a"), ("assistant", "b")] * 21, "too_long"), ([("user", "a" * 4001), ("assistant", "b")], "message_too_long")]
    df = spark.createDataFrame([(h,) for h, _ in cases], schema)
    assert [r.i for r in df.select(dialogue.history_issue(F.col("h")).alias("i")).collect()] == [w for _, w in cases]


def test_judgments(spark):
    def answer(score=2, gate=False, applicable=False, unchanged=False, candidate=None):
        return json.dumps({"scores": {"a": score, "b": 2}, "hard_gates": {"g": gate}, "delete_respect_sentence": {"applicable": applicable, "explanation_unchanged_after_deletion": unchanged, "candidate_sentence": candidate}})

    cases = [answer(), answer(gate=True), answer(score=3), answer(score=True), answer(gate=1), answer(applicable=True), answer(applicable=True, unchanged=True, candidate="x"), "no json", f"```json\n{answer(score=1)}\n```"]
    df = spark.createDataFrame(list(enumerate(cases)), "id int, answer string")
    got = {r.id: r for r in dialogue.judgments(df, ["a", "b"], ["g"]).collect()}
    assert [got[i].issue for i in range(9)] == [None, None, "invalid_score", "invalid_score", "invalid_gate", "missing_candidate", None, "invalid_json", None]
    assert [got[i].strict_pass for i in range(9)] == [True, False, None, None, None, None, False, None, False]
    assert got[8].score_total == 3


def test_exchange_plan(spark):
    df = spark.createDataFrame([(1, 5), (2, 6)], "id int, n int")
    got = dialogue.exchange_plan(df, "n").collect()
    assert [(r.id, r.exchange) for r in got] == [(1, i) for i in range(1, 6)]


def test_heldout_manifest(spark, tmp_path):
    import hashlib

    (tmp_path / "a.json").write_text(json.dumps([{"id": "x", "turns": [{"user": "Hello \r\n there "}, {"user": 3}]}, {"id": 7}, "no"]))
    (tmp_path / "bad.json").write_text("{")
    digest = lambda n: hashlib.sha256((tmp_path / n).read_bytes()).hexdigest()
    source = {"namespace": "n", "text_paths": ["turns[].user"]}
    manifest = {"ids": ["raw"], "content_hashes": ["f" * 64, "zz"], "sources": [source | {"repo_relative_path": "a.json", "file_sha256": digest("a.json"), "include_raw_string_ids": True}, source | {"repo_relative_path": "bad.json", "file_sha256": digest("bad.json")}, source | {"repo_relative_path": "gone.json"}, source | {"repo_relative_path": "a.json", "file_sha256": "0"}, {"namespace": "", "repo_relative_path": "a.json"}]}
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    ids, hashes, issues = heldout.load(spark, str(tmp_path / "m.json"), str(tmp_path))
    assert {r.id for r in ids.collect()} == {"raw", "n:x", "x", "n:7"}
    assert {r.sha256 for r in hashes.collect()} == {"f" * 64, hashlib.sha256(b"Hello\n there").hexdigest()}
    assert sorted(r.code for r in issues.collect()) == ["heldout_manifest_invalid_hash", "heldout_manifest_invalid_source", "heldout_source_hash_mismatch", "heldout_source_invalid_json", "heldout_source_missing"]


def test_allowlist(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a\n\n# note\nb\n")
    assert sorted(r.path for r in heldout.allowlist(spark, str(tmp_path / "a.txt")).collect()) == ["a", "b"]


def test_manifest_sources_that_exist(spark, tmp_path):
    from qanat.sources import heldout

    (tmp_path / "a.json").write_text("[]")
    sources = [{"namespace": "n", "repo_relative_path": p, "file_sha256": "x"} for p in ("a.json", "b.json", " ")]
    (tmp_path / "m.json").write_text(json.dumps({"ids": [], "content_hashes": [], "sources": sources}))
    assert heldout.references(spark, str(tmp_path / "m.json"), str(tmp_path)) == [f"{tmp_path}/a.json"]
