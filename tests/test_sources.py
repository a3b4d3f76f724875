import json
import zipfile

import pytest

from pyspark.sql import functions as F

from qanat.sources import jsonl, sinks
from qanat.streaming import ledger


def test_tolerant_and_newest(spark, tmp_path):
    a, b = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    a.write_text('{"id": 1, "v": "x"}\n\nnot json\n{"id": 2, "v": "y"}\n')
    b.write_text('{"id": 2, "v": "z"}\n')
    records, errors = jsonl.tolerant(spark, str(a), "id int, v string")
    assert [(r.line, r.record and r.record.id) for r in records.orderBy("line").collect()] == [(1, 1), (3, None), (4, 2)]
    assert [(r.line, r.code) for r in errors.collect()] == [(3, "invalid_json")]
    a.write_text('{"id": 1, "v": "x"}\n{"id": 2, "v": "y"}\n')
    assert {(r.id, r.v) for r in jsonl.newest(spark, [str(a), str(b)], "id int, v string", "id").collect()} == {(1, "x"), (2, "z")}


def test_leaves(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"a": ["one two three four five", "short"], "b": {"c": "uno dos tres cuatro cinco seis"}, "n": 1}))
    got = {(r.pointer, r.text.split()[0]) for r in jsonl.leaves(spark, str(tmp_path / "s.json")).collect()}
    assert got == {("/a/0", "one"), ("/b/c", "uno")}


def test_write_and_manifest(spark, tmp_path):
    out = str(tmp_path / "out")
    jsonl.write(spark.createDataFrame([(1, None, "é")], "b int, a string, c string").coalesce(1), out)
    files = sinks.manifest(spark, out).where("path LIKE '%.txt'").collect()
    assert len(files) == 1 and open(files[0].path.removeprefix("file:")).read() == '{"a":null,"b":1,"c":"é"}\n'
    assert sinks.over_limit(sinks.manifest(spark, out), per_file=3).count() >= 1


def test_zip_members_and_links(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("../secret.txt", "a")
        z.writestr("ok/a.txt", "bc")
    assert {(r.member, r.bytes, r.unsafe) for r in sinks.zip_members(spark, str(tmp_path / "x.zip")).collect()} == {("../secret.txt", 1, True), ("ok/a.txt", 2, False)}
    texts = spark.createDataFrame([(1, "[a](b%20c.md#x) [w](https://a.b) [h](#h)")], "id int, text string")
    assert [r.target for r in sinks.links(texts).collect()] == ["b c.md"]


def test_resume_appends_once(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    df = spark.range(5)
    df.write.parquet(src)
    for _ in range(2):
        ledger.resume(spark, src, df.schema, out, state)
    spark.range(5, 8).write.mode("append").parquet(src)
    ledger.resume(spark, src, df.schema, out, state)
    assert spark.read.parquet(out).count() == 8


def test_windows(spark):
    ev = spark.createDataFrame([(1, "2026-01-01 00:00:00", 1.0), (1, "2026-01-01 00:20:00", 2.0), (1, "2026-01-01 02:00:00", 3.0)], "user_id int, t string, value double").withColumn("ts", F.to_timestamp("t"))
    assert sorted(r.events for r in ledger.tumbling(ev, "ts", "1 hour", ["user_id"]).collect()) == [1, 2]
    assert sorted(r.events for r in ledger.sessions(ev, "user_id", "ts", "30 minutes").collect()) == [1, 2]


def test_lines_of_a_file_in_many_splits(spark, tmp_path):
    """Numbers are those of the file, whatever its splits."""
    path = tmp_path / "many.txt"
    path.write_text("".join(f"line {k}{' ' * (k % 50)}\r\n" if k % 7 else "\n" for k in range(1, 3001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2000)
    try:
        own = jsonl.lines(spark, str(path))
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 10
        got = {r.line: r.raw for r in own.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {k: f"line {k}{' ' * (k % 50)}" if k % 7 else "" for k in range(1, 3001)}


def test_keys_status_and_counts(spark, tmp_path):
    a, b = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    a.write_text('{"id": "1", "status": "success", "v": "x"}\n')
    b.write_text('{"id": "1", "status": "failed", "v": "y"}\n{"id": "2", "status": "success", "v": "z"}\n')
    schema = "id string, status string, v string"
    assert {(r.id, r.v) for r in jsonl.newest(spark, [str(a), str(b)], schema, "id", "success").collect()} == {("1", "x"), ("2", "z")}
    with pytest.raises(ValueError):
        jsonl.pair(spark, str(a), str(b), schema, "id")
    with pytest.raises(ValueError):
        jsonl.checked(jsonl.strict(spark, str(b), schema), "id", 3)
    assert jsonl.checked(jsonl.strict(spark, str(b), schema), "id", 2).count() == 2
    a.write_text('{"source_id": "s", "compiler_assignment_id": "c"}\n{"source_id": "", "compiler_assignment_id": "d"}\n')
    assert {r.key for r in jsonl.status_ledger(spark, str(a), "source_id string, compiler_assignment_id string").collect()} == {"s", "d"}


def test_reports_and_guards(spark, tmp_path):
    out = str(tmp_path / "report.json")
    sinks.report(spark.createDataFrame([(2, "é")], "b int, a string"), out)
    assert open(out, encoding="utf-8").read() == '[\n  {\n    "a": "é",\n    "b": 2\n  }\n]\n'
    with pytest.raises(Exception):
        sinks.report(spark.range(1), out)
    sinks.csv(spark.range(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    jsonl.append(spark.range(1), str(tmp_path / "log"))
    jsonl.append(spark.range(1), str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).count() == 2
    manifest, state = str(tmp_path / "m.json"), tmp_path / "state"
    ledger.guard(spark, manifest, str(state), {"model": "a"})
    ledger.guard(spark, manifest, str(state), {"model": "a"})
    with pytest.raises(ValueError):
        ledger.guard(spark, manifest, str(state), {"model": "b"})
    state.mkdir()
    (state / "x").write_text("1")
    with pytest.raises(ValueError):
        ledger.guard(spark, str(tmp_path / "other.json"), str(state), {"model": "a"})


def test_owned_names(spark):
    from qanat.functions import patterns

    paths = ["data/internal.jsonl", "outputs/judge.json", "a/scraped/c.txt", "zshots/s.png", "adapter_model.safetensors", ".env", "notes/Plan.md", ".env.example", "model/README.md"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] is not None for r in df.select(patterns.restricted_reason(F.col("p"), ("plan.md",))).collect()] == [True] * 7 + [False] * 2


def test_records_of_a_file(spark, tmp_path):
    from qanat.operators import records

    good = '{"schema_version": "1", "id": "a1", "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}, {"role": "assistant", "content": "%s"}]}'
    lines = [good % "x", "", "{", "[]", good % "x", (good % "y").replace("a1", "A"), (good % "z").replace('"schema_version": "1"', '"more": 1'), (good % "q").replace('{"role": "user", "content": "u"}', "5")]
    (tmp_path / "r.jsonl").write_text("\n".join(lines) + "\n")
    required = ["schema_version", "id", "messages"]
    found, report = records.of_file(spark, str(tmp_path / "r.jsonl"), required, required, "1", "[a-z][0-9]", reserved_ids=spark.createDataFrame([("a1",)], "id string"))
    got = {(r.line, r.code, r.detail) for r in found.collect()}
    assert got == {
        (1, "heldout_id_match", None), (3, "invalid_json", None), (4, "record_not_object", None), (5, "duplicate_id", "1"), (5, "duplicate_conversation", "1"), (5, "heldout_id_match", None),
        (6, "invalid_id", None), (7, "missing_fields", "schema_version"), (7, "unknown_fields", "more"), (7, "schema_version", None), (7, "duplicate_id", "1"), (7, "heldout_id_match", None),
        (8, "invalid_message", None), (8, "duplicate_id", "1"), (8, "heldout_id_match", None), (8, "invalid_role_sequence", None),
    }
    r = report.collect()[0]
    assert (r.input_lines, r.parsed_rows, r.valid_rows, r.invalid_rows, r.heldout_matches) == (7, 6, 0, 7, 4)
