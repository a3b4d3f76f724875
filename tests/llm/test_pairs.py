import random

import numpy as np
import pytest

from qanat.llm import crossdup, lookalike, neardup, overlap
from qanat.llm.crossdup import banded_distance
from qanat.llm.overlap import least_common
from tests.llm import common


def corpus(seed=1):
    rng = random.Random(seed)
    bag = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(bag) for _ in range(n))
    specs = []
    for i in range(12):
        specs.append({"row_id": i, "said": [text(rng.choice([30, 80, 200])) for _ in range(3)]})
    for i in range(12, 60):
        base = specs[rng.randrange(12)]
        ws = "\n".join(base["said"]).split("\n")
        flat = " ".join(ws).split()
        kind = i % 4
        if kind == 0:  # words replaced all over
            for _ in range(rng.randrange(1, max(2, len(flat) // 18))):
                flat[rng.randrange(len(flat))] = rng.choice(bag)
        elif kind == 1:  # halves in the other order
            flat = flat[len(flat) // 2 :] + flat[: len(flat) // 2]
        elif kind == 2:  # words put in
            for _ in range(rng.randrange(1, max(2, len(flat) // 20))):
                flat.insert(rng.randrange(len(flat)), rng.choice(bag))
        else:  # a piece of it
            flat = flat[: int(len(flat) * rng.uniform(0.5, 1))]
        specs.append({"row_id": i, "said": [" ".join(flat[:20]), " ".join(flat[20:])], "split": rng.choice(["train", "validation", "test", None])})
    specs += [
        {"row_id": 70, "said": []},
        {"row_id": 71, "said": [None, ""]},
        {"row_id": 72, "messages": None},
        {"row_id": 73, "said": ["one two"]},
        {"row_id": 74, "said": ["one two"], "split": "test"},
        {"row_id": 75, "said": ["a b c d e"]},
        {"row_id": 76, "said": ["A, b C. d", "e"], "split": "test"},
        {"row_id": 77, "messages": [("system", "x"), None, (None, "y"), ("user", "a b c d e")], "objective": None, "provenance": None},
        {"row_id": None, "said": ["a b c d e"]},
        dict(specs[3]),
    ]
    return specs


@pytest.fixture(scope="module")
def specs():
    return corpus()


def test_near_pairs_equal_brute_force(spark, specs):
    got = neardup.near_pairs(common.rows(spark, specs)).collect()
    pairs = {(r.row_id_a, r.row_id_b) for r in got}
    assert len(pairs) == len(got) and pairs == common.near(specs, 0.6, True)


def test_hot_blocks_give_the_same_pairs(spark, specs, monkeypatch):
    monkeypatch.setattr(overlap, "HOT_BLOCK", 400)
    df = common.rows(spark, specs).repartition(5)
    split = {s["row_id"]: s.get("split", "train") for s in specs}
    assert {(r.row_id_a, r.row_id_b) for r in neardup.near_pairs(df).collect()} == common.near(specs, 0.6, True)
    monkeypatch.setattr(overlap, "HOT", 3)
    assert {(r.row_id_a, r.row_id_b) for r in neardup.near_pairs(df).collect()} == common.near(specs, 0.6, True)


def test_near_groups(spark, specs):
    got = {r.row_id: r for r in neardup.near_groups(common.rows(spark, specs), 0.8).collect()}
    assert set(got) == {s["row_id"] for s in specs} - {None}
    pairs = common.near(specs, 0.8, True)
    root = {i: i for i in got}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in sorted(pairs):
        a, b = sorted((find(a), find(b)))
        root[b] = a
    texts = {}
    for s in specs:
        if s["row_id"] is not None:
            texts.setdefault(tuple(common.words("\n".join([s.get("objective", "explain it") or "", *common.spoken(s)]))), set()).add(s["row_id"])
    for ids in texts.values():
        for i in ids:
            assert got[i].text_class == min(ids)
            root[find(i)] = root[find(min(ids))] = min(find(i), find(min(ids)))
    assert {i: r.group_id for i, r in got.items()} == {i: find(i) for i in got}


def test_groups_are_those_of_the_pairs(spark, specs):
    got = {r.row_id: r for r in neardup.near_groups(common.rows(spark, specs)).collect()}
    pairs = common.near(specs, 0.6, True)
    assert pairs - common.near(specs, 0.8, True)
    group = {i: i for i in got}
    for _ in got:
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    near = {i: set() for i in got}
    for a, b in pairs:
        near[a].add(got[b].text_class)
        near[b].add(got[a].text_class)
    shingled = {i for pair in pairs for i in pair}
    assert {i: got[i].group_id for i in shingled} == {i: group[i] for i in shingled}
    assert {i: r.links for i, r in got.items()} == {i: len(x - {got[i].text_class}) for i, x in near.items()}


def test_cross_pairs_equal_brute_force(spark, specs):
    got = crossdup.cross_pairs(common.rows(spark, specs)).collect()
    split = {s["row_id"]: s.get("split", "train") for s in specs}
    want = {(a, b) for a, b in common.near(specs, 0.8, False) if split[a] and split[b] and (split[a] == "train") != (split[b] == "train")}
    assert {(r.row_id_a, r.row_id_b) for r in got} == want and len(got) == len(want)
    counts = crossdup.cross_counts(common.rows(spark, specs)).collect()
    assert sum(r.pairs for r in counts) == len(want)


def test_hot_copies_and_common_phrases(spark):
    rng = random.Random(5)
    base = " ".join(f"b{i}" for i in range(60))
    specs = [{"row_id": i, "said": [base]} for i in range(40)] + [{"row_id": 100 + i, "said": ["in the last ten minutes of the class today " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(50))]} for i in range(60)]
    got = neardup.near_pairs(common.rows(spark, specs)).count()
    assert got == 40 * 39 // 2


def test_no_rows(spark, specs):
    none = common.rows(spark, specs).where("false")
    for f in (neardup.near_pairs, neardup.near_groups, crossdup.cross_pairs, crossdup.cross_counts, lookalike.alike_pairs, lookalike.consistent_messages):
        assert f(none).count() == 0


def test_long_texts_over_a_tiny_vocabulary(spark):
    rng = random.Random(9)
    key = lambda n, letters: " ".join(rng.choice(letters) for _ in range(n))
    specs = [{"row_id": i, "said": [key(1500, "abcd")], "split": ("train", "test")[i % 2]} for i in range(4)]
    specs += [{"row_id": 10 + i, "said": [key(3500, "efgh")], "split": ("train", "test")[i % 2]} for i in range(2)]
    specs += [{"row_id": 20 + i, "said": [key(1500, [f"w{k}" for k in range(900)])]} for i in range(2)]
    df = common.rows(spark, specs)
    want = common.near(specs, 0.6, True)
    assert (10, 11) in want and len(want) > 1
    assert {(r.row_id_a, r.row_id_b) for r in neardup.near_pairs(df).collect()} == want
    assert {(r.row_id_a, r.row_id_b) for r in crossdup.cross_pairs(df).collect()} == {(10, 11)}


def test_bound_is_at_least_one():
    n = np.array([5, 41, 600, 5000])
    assert (least_common(n, n, 0.6) >= 1).all() and (least_common(n, n, 0.8) >= 1).all()


def test_banded_distance_equals_full_table():
    rng = random.Random(3)
    for _ in range(60):
        x = [rng.randrange(6) for _ in range(rng.randrange(0, 25))]
        y = list(x)
        for _ in range(rng.randrange(0, 6)):
            k = rng.randrange(3)
            at = rng.randrange(len(y) + 1)
            if k == 0:
                y.insert(at, rng.randrange(6))
            elif y and k == 1:
                y.pop(at % len(y))
            elif y:
                y[at % len(y)] = rng.randrange(6)
        d = [list(range(len(y) + 1))] + [[i] + [0] * len(y) for i in range(1, len(x) + 1)]
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (x[i - 1] != y[j - 1]))
        want = d[-1][-1]
        for band in (2, 30):
            assert banded_distance(np.array(x), np.array(y), band) == (want if want <= band else None)


def test_alike_pairs(spark):
    specs = [
        {"row_id": 1, "said": ["fine day", "same"]},
        {"row_id": 2, "said": ["ﬁne day", "same"]},
        {"row_id": 3, "said": ["x", "fine day"]},
        {"row_id": 3, "said": ["x", "fine day"]},
        {"row_id": 4, "said": ["Fine day", None, ""]},
        {"row_id": 5, "said": ["​", "q"]},
        {"row_id": 6, "messages": None},
        {"row_id": None, "said": ["ﬁne day"]},
    ]
    got = sorted(tuple(r) for r in lookalike.alike_pairs(common.rows(spark, specs)).collect())
    assert got == [(1, 1, 2, 1), (2, 1, 3, 2), (4, 3, 5, 1)]
    forms = lookalike.consistent_messages(common.rows(spark, specs)).collect()
    assert {(r.row_id, r.turn, r.form, r.changed) for r in forms} >= {(2, 1, "fine day", True), (1, 1, "fine day", False), (4, 3, "", False)}


def test_sketches_deny_no_pair_at_the_threshold():
    """Of 4,000 pairs at or just above the threshold none is lost; of 4,000 pairs that share a tenth few of the long ones are left."""
    rng = np.random.default_rng(3)
    for size in (60, 150, 300, 700, 2000):
        for share, kept in ((0.6, 1.0), (0.1, None)):
            both = int(2 * size * share / (1 + share)) + 1
            s, own = [], []
            for i in range(400):
                common = rng.integers(0, 2**64, both, dtype=np.uint64)
                for k in range(2):
                    s.append(np.sort(np.concatenate([common, rng.integers(0, 2**64, size - both, dtype=np.uint64)])))
                    own.append(np.full(size, 2 * i + k))
            n = np.full(800, size)
            x = overlap.sketches(np.concatenate(s), np.concatenate(own), n)
            ok = overlap.alike(x[::2], n[::2], x[1::2], n[1::2], 0.6)
            assert ok.all() if kept else size in (60, 150) or ok.mean() < 0.02
            maps = overlap.bitmaps(np.concatenate(s), np.concatenate(own), n)
            most = np.array([overlap.most_common(maps[2 * i], size, maps[2 * i + 1], size) for i in range(400)])
            assert (most >= both).all() and (kept or (most < 0.75 * size).mean() > 0.9)


def test_a_family_of_near_texts(spark, monkeypatch):
    """Every two of 150 different texts are near; their hot segments meet in cells, and groups cost no row for each pair."""
    monkeypatch.setattr(overlap, "HOT", 20)
    monkeypatch.setattr(neardup, "HELD", 50)
    base = [f"b{i}" for i in range(300)]
    specs = [{"row_id": i, "said": [" ".join(base[:k] + [f"x{i}"] + base[k:])]} for i in range(150) for k in [2 * i]]
    df = common.rows(spark, specs)
    assert neardup.near_pairs(df).count() == 150 * 149 // 2
    got = neardup.near_groups(df).collect()
    assert {r.group_id for r in got} == {0} and {r.links for r in got} == {149}


def test_many_messages_of_one_look(spark):
    """2,000 equal messages and one of another spelling are 2,000 pairs."""
    specs = [{"row_id": i, "said": ["well done"]} for i in range(2000)] + [{"row_id": 5000, "said": ["wеll done"]}, {"row_id": 5000, "said": ["wеll done"]}]
    got = lookalike.alike_pairs(common.rows(spark, specs)).collect()
    assert {tuple(r) for r in got} == {(i, 1, 5000, 1) for i in range(2000)} and len(got) == 2000
