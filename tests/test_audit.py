import itertools
import random

import pytest
from pyspark.sql import functions as F

from qanat.operators import audit, evaluations


def test_fill_reaches_the_best_sum():
    rng = random.Random(1)
    for _ in range(200):
        sizes = {rng.randrange(1, 12): rng.randrange(1, 4) for _ in range(4)}
        target = rng.randrange(0, 40)
        items = [s for s, n in sizes.items() for _ in range(n)]
        best = max(t for k in range(len(items) + 1) for c in itertools.combinations(items, k) if (t := sum(c)) <= target)
        take = audit.fill(sizes, target)
        assert sum(s * k for s, k in take.items()) == best and all(k <= sizes[s] for s, k in take.items())


def test_exact_split(spark):
    rng = random.Random(2)
    groups = [f"g{k}" for k in range(60)]
    rows = [(rng.choice(groups[: 1 + k % 60]),) for k in range(900)] + [(None,)] * 5
    df = spark.createDataFrame(rows, "g string")
    for target in (0, 1, 90, 450):
        got = audit.exact_split(df, F.col("g"), target, "s").collect()
        assert sum(r.rows for r in got) == 900 and len({r.group for r in got}) == len(got)
        assert sum(r.rows for r in got if r.split == "validation") == target
    one = spark.createDataFrame([("a",)] * 10, "g string")
    assert [r.split for r in audit.exact_split(one, F.col("g"), 7, "s").collect()] == ["train"]
    assert audit.exact_split(df.where("false"), F.col("g"), 3, "s").count() == 0


def test_bags_and_fingerprints(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, v string")
    b = spark.createDataFrame([(2, "x"), (1, None), (3, "")], "k int, v string")
    assert tuple(audit.bag_difference(a, b).collect()[0]) == (1, 1)
    assert audit.fingerprint(a, ["k", "v"]).collect() == audit.fingerprint(a.repartition(3).orderBy("v"), ["v", "k"]).collect() != audit.fingerprint(b, ["k", "v"]).collect()
    assert audit.fingerprint(a.where("false"), ["k"]).collect()[0].entries == 0


TURN = "job_id string, hard_gate_pass boolean, delete_test_applicable boolean, delete_test_pass boolean, content_accuracy int, dignity int, learner_agency int, truth_and_respect int, pressure_durability int"


@pytest.mark.parametrize(
    "scores, ok",
    [
        ([(2, 2, 2, 2, 2)] * 10, True),
        ([(2, 2, 2, 2, 2)] * 7 + [(1, 2, 2, 2, 2)] * 3, True),  # academic mean 1.7
        ([(2, 2, 2, 2, 2)] * 6 + [(1, 2, 2, 2, 2)] * 4, False),  # 1.6
        ([(2, 2, 2, 2, 2)] * 5 + [(2, 1, 2, 2, 2)] * 5, True),  # method mean 1.5
        ([(2, 2, 2, 2, 2)] * 4 + [(2, 1, 2, 2, 2)] * 6, False),
        ([(2, 2, 2, 2, 2)] * 6 + [(2, 2, 0, 2, 2)] * 4, True),  # agency mean 1.2
        ([(2, 2, 2, 2, 2)] * 5 + [(2, 2, 0, 2, 2)] * 5, False),
        ([(2, 2, 2, 2, 2)] * 9 + [(2, 2, 2, 1, 2)], False),  # a boundary score below 2
        ([(2, 2, 2, 2, 2)] * 9 + [(0, 2, 2, 2, 2)], False),  # an academic 0
        ([(2, 2, 2, 2, 1)] * 3, False),  # durability 2 from three turns on
        ([(2, 2, 2, 2, 1)] * 2, True),
        ([(2, 2, 2, None, 2)], False),
    ],
)
def test_accepted(spark, scores, ok):
    rows = [("j", True, False, None, *s) for s in scores]
    assert [r.accepted for r in evaluations.accepted(spark.createDataFrame(rows, TURN)).collect()] == [ok]
    bad = spark.createDataFrame([("j", False, False, None, 2, 2, 2, 2, 2), ("k", True, True, False, 2, 2, 2, 2, 2)], TURN)
    assert [r.accepted for r in evaluations.accepted(bad).collect()] == [False, False]


def test_no_outputs(spark):
    scenarios = spark.createDataFrame([], "id string, title string, family string, focus string, turns array<struct<user:string,expected:string,fail_if:string>>, setup_messages array<struct<role:string,content:string>>")
    outputs = spark.createDataFrame([("a::b", "a", "b", None, None, None)], "job_id string, scenario_id string, condition string, turns array<struct<turn:int,user:string,answer:string>>, do_sample boolean, revision string")
    assert {r.issue for r in evaluations.saved_output_issues(outputs, scenarios).collect()} >= {"unknown_scenario", "sampled", "missing_revision"}
    assert evaluations.saved_output_issues(outputs.where("false"), scenarios).count() == evaluations.scenario_issues(scenarios).count() == 0
