import hashlib
import json
import random
from types import SimpleNamespace

from pyspark.sql import functions as F

from qanat.operators import gate
from qanat.plans import gate_queries
from qanat.sources import heldout


def texts(spark, *values):
    return spark.createDataFrame([(i, x) for i, x in enumerate(values)], "id bigint, text string")


def words(a, b):
    return " ".join(f"w{i}" for i in range(a, b))


def test_exact_duplicates_ignore_marks(spark):
    got = gate.exact_duplicates(texts(spark, "A, b!", "a b", "c", None, "", "")).collect()
    assert [(r.copies, r.first_id, r.last_id) for r in got] == [(2, 0, 1)]


def test_openings_need_three_records(spark):
    same = words(0, 8)
    assert gate.openings(texts(spark, same + " x", same + " y")).collect() == []
    assert [(r.occurrences, r.records) for r in gate.openings(texts(spark, same + " x", same + " y", same)).collect()] == [(3, 3)]


def test_near_duplicates_at_the_threshold(spark):
    # 100 and 100 shingles, 90 shared: 90 / 110 = 0.818; one more word in common is 0.835
    base = words(0, 104)
    below, above = words(0, 94) + " " + words(200, 210), words(0, 95) + " " + words(200, 209)
    assert gate.near_duplicates(texts(spark, base, below)).collect() == []
    got = gate.near_duplicates(texts(spark, base, above)).collect()
    assert [(r.left_id, r.right_id) for r in got] == [(0, 1)] and abs(got[0].similarity - 91 / 109) < 1e-12


def test_near_duplicates_cap_counts_in_sizes_only(spark):
    shared = words(0, 30)
    many = texts(spark, *[f"{shared} {words(1000 * i + 100, 1000 * i + 101)}" for i in range(101)])
    assert gate.near_duplicates(many).collect() == []


def test_near_duplicates_send_few_of_the_ngrams(spark):
    said = random.Random(1)
    many = [" ".join(f"w{said.randrange(5000)}" for _ in range(404)) for _ in range(4000)]
    own = gate.stored(gate.worded(texts(spark, *many, many[0] + " more")))
    sent = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    before = sent()
    assert [(r.left_id, r.right_id) for r in gate.near_duplicates(own, cap=None).collect()] == [(0, 4000)]
    assert sent() - before < 8 * 400 * len(many)  # less than a hash for each


def test_near_duplicates_equal_brute_force(spark):
    said = random.Random(2)
    kinds = [[f"w{said.randrange(300)}" for _ in range(60)] for _ in range(4)]
    many = []
    for i in range(80):
        w = list(kinds[i % 4])
        for _ in range(said.randrange(4)):
            w[said.randrange(60)] = f"x{said.randrange(40)}"
        many.append(w[: 60 - said.randrange(8)])
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in many]
    for threshold, cap in ((0.82, None), (0.6, None), (0.6, 18), (1.0, None)):
        useful = [{g for g in s if cap is None or sum(g in x for x in sets) <= cap} for s in sets]
        want = set()
        for i in range(80):
            for j in range(i + 1, 80):
                both = len(useful[i] & useful[j])
                if many[i] != many[j] and both / (len(sets[i]) + len(sets[j]) - both) >= threshold:
                    want.add((i, j))
        got = gate.near_duplicates(texts(spark, *map(" ".join, many)), threshold, cap=cap).collect()
        assert len(got) == len(want) and {(r.left_id, r.right_id) for r in got} == want


def test_shared_spans_one_per_set(spark):
    run = words(0, 20)
    got = gate.shared_spans(texts(spark, run + " a", "b " + run, "c d")).collect()
    assert [(r.span, r.records, r.first_id, r.last_id) for r in got] == [(min(words(i, i + 16) for i in range(5)), 2, 0, 1)]


def test_longest_overlap_extends_and_breaks_ties(spark):
    refs = spark.createDataFrame([("r1", words(0, 30)), ("r2", words(0, 12))], "ref string, text string")
    got = gate.longest_overlaps(texts(spark, f"x {words(0, 11)} y", words(40, 60), f"{words(20, 28)} z {words(0, 8)}"), refs).orderBy("id").collect()
    assert [(r.id, r.ref, r.overlap_words, r.start) for r in got] == [(0, "r1", 11, 1), (2, "r1", 8, 0)]


def test_decisions(spark):
    own = texts(spark, "a", "b", "c")
    flags = spark.createDataFrame([(0, "x", "review"), (0, "y", "block"), (1, "x", "review")], "id bigint, code string, severity string")
    assert [(r.decision, r.flags) for r in gate.decisions(own, flags).orderBy("id").collect()] == [("block", 2), ("review", 1), ("pass", 0)]


def test_empty_table(spark):
    none = texts(spark, "a").where("false")
    assert gate.exact_duplicates(none).count() == gate.near_duplicates(none).count() == gate.shared_spans(none).count() == 0


def test_heldout_hashes_take_the_composed_form(spark, tmp_path):
    apart, composed = "cafe\u0301 \ufb01n", "caf\u00e9 \ufb01n"
    turns = "id string, turns array<struct<user:string,expected:string>>"
    t = SimpleNamespace(
        scenarios=spark.createDataFrame([("s", [(composed, None)])], turns),
        release_rows=spark.createDataFrame([(1, [("user", apart)]), (2, [("user", "caf\u00e9 fin")])], "row_id bigint, messages array<struct<role:string,content:string>>"),
    )
    assert [(r.id, r.turn) for r in gate_queries.heldout_exact_match(t).collect()] == [("1", 0)]
    raw = json.dumps([{"id": "x", "text": apart}]).encode()
    (tmp_path / "a.json").write_bytes(raw)
    source = {"namespace": "n", "repo_relative_path": "a.json", "file_sha256": hashlib.sha256(raw).hexdigest(), "text_paths": ["text"]}
    (tmp_path / "m.json").write_text(json.dumps({"ids": [], "content_hashes": [], "sources": [source]}))
    hashes = heldout.load(spark, str(tmp_path / "m.json"), str(tmp_path))[1].collect()
    assert [r.sha256 for r in hashes] == [hashlib.sha256(composed.encode()).hexdigest()]


def test_few_ngrams_meet_references(spark):
    """n-grams of a text that no reference has aren't exploded."""
    df = spark.createDataFrame([(1, [f"a{k}" for k in range(200)]), (2, [f"b{k}" for k in range(200)])], "id int, w array<string>")
    refs = spark.createDataFrame([("r", "so a7 a8 a9 a10 it"), ("n", None)], "ref string, text string")
    grams = refs.select(F.explode(gate.ngram_hashes(gate.tokens(F.col("text")), 3)).alias("g"))
    assert {r.id: [x.p for x in r.x] for r in gate.referred(df, grams, 3).collect()} == {1: [7, 8], 2: []}
    assert [r.id for r in gate.contaminated(df, refs, 3).collect()] == [1]
    assert [tuple(r) for r in gate.longest_overlaps(df, refs, 3).collect()] == [(1, "r", 4, 7)]
