import numpy as np
from pyspark.sql import functions as F

from qanat.llm import graph, runtime


def test_filter_holds_every_member(spark):
    ids = runtime.cut(spark.range(0, 90_000, 3).repartition(5))
    packed = runtime.membership_filter(ids).value
    inside = runtime.maybe_in(packed, np.arange(0, 90_000, 3))
    outside = runtime.maybe_in(packed, np.arange(1, 90_000, 3))
    assert inside.all() and outside.mean() < 0.1
    none = runtime.membership_filter(ids.where("false")).value
    assert not runtime.maybe_in(none, np.arange(100)).any() and len(runtime.maybe_in(none, np.zeros(0, np.int64))) == 0


def test_ranks_are_a_permutation(spark):
    df = spark.range(1000).withColumn("k", F.when(F.col("id") < 900, "hot").otherwise("cold"))
    got = runtime.ranked(df, ["k"], "id", per_task=60).collect()
    again = {r.id: r["rank"] for r in runtime.ranked(df.repartition(7), ["k"], "id", per_task=60).collect()}
    for k in ("hot", "cold"):
        own = sorted(r["rank"] for r in got if r.k == k)
        assert own == list(range(len(own)))
    assert {r.id: r["rank"] for r in got} == again


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 60)]
    df = spark.createDataFrame([*chain, *star, (200, 201), (201, 200), (7, 7), (None, 3)], "u int, v int")
    got = {r.node: r.component for r in graph.components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}, 200: 200, 201: 200}
    assert graph.components(df.where("false")).count() == 0
