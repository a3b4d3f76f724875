import base64
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from qanat.llm import mixing, packing, splits, tokens
from tests.llm import common


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P
    import tiktoken

    with open(tokens.default_vocabulary(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text(st.sampled_from(list("'strevmld aZ9\n\t .é한م￿　")), max_size=30)), max_size=5))
def test_counts_equal_the_tokenizer(reference, texts):
    assert tokens.counter(tokens.default_vocabulary()).count(texts).tolist() == [len(reference.encode_ordinary(x)) for x in texts]


def test_token_totals(spark, reference):
    specs = [
        {"row_id": 1, "said": ["hello there", None], "language": "EN_ae", "family": "a-b", "source": "X-y"},
        {"row_id": 1, "said": ["hello there", None], "language": "EN_ae", "family": "a-b", "source": "X-y"},
        {"row_id": 2, "said": [""], "language": "en-AE", "family": "A_B", "source": "x_y"},
        {"row_id": 3, "messages": None, "language": None, "family": " ", "provenance": None},
        {"row_id": None, "said": ["z"]},
    ]
    got = {(r.source_family, r.language, r.scenario_family): (r.records, r.tokens) for r in tokens.token_totals(common.rows(spark, specs)).collect()}
    n = len(reference.encode_ordinary("same"))
    want = 2 * n + len(reference.encode_ordinary("hello there"))
    assert got["(all)", "(all)", "(all)"] == (3, want)
    assert got["x_y", "en-ae", "a_b"] == (2, want)
    assert got["(missing)", "(missing)", "(missing)"] == (1, 0)
    assert tokens.token_totals(common.rows(spark, specs).where("false")).where("records > 0").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), max_size=25))
def test_plan_holds_every_item(sizes):
    patterns = packing.plan(sizes, 40)
    used = Counter()
    for items, m in patterns:
        assert m > 0 and sum(items) <= 40
        for s in items:
            used[s] += m
    assert used == Counter(sizes)
    total = sum(s * c for s, c in sizes.items())
    best = max(-(-total // 40), sum(c for s, c in sizes.items() if s > 20))
    assert sum(m for _, m in patterns) <= 1.5 * best + 1


def test_containers(spark):
    rng = random.Random(1)
    docs = [(i, " word" * rng.choice([1, 3, 8, 20, 33, 70])) for i in range(120)] + [(200, None), (201, ""), (None, "x"), (7, " word")]
    docs = spark.createDataFrame([(*d, 5, 5) for d in docs], "doc_id bigint, text string, size int, rank int")
    limits = spark.createDataFrame([(1, 32), (2, 64), (3, 0), (None, 5)], "limit_id int, container_tokens int")
    got = packing.containers(docs, limits).collect()
    sizes = {r.doc_id: 0 for r in got}
    for limit, capacity in ((1, 32), (2, 64)):
        own = [r for r in got if r.limit_id == limit]
        fill, pieces = defaultdict(int), defaultdict(list)
        for r in own:
            if r.container_id is not None:
                fill[r.container_id] += r.tokens
                pieces[r.doc_id].append(r)
        assert all(v <= capacity for v in fill.values()) and all(r.used == fill[r.container_id] for r in own if r.container_id is not None)
        for ps in pieces.values():
            assert sorted(p.piece for p in ps) == list(range(len(ps))) and (len(ps) == 1 or sum(p.tokens for p in ps) > capacity)
        assert len(fill) <= 1.15 * sum(fill.values()) / capacity + 1 and sorted(fill) == list(range(len(fill)))
        assert {r.doc_id for r in own if r.container_id is None} == {200, 201}
        totals = {d: sum(p.tokens for p in ps) for d, ps in pieces.items()}
        assert sizes.keys() >= totals.keys() and totals[7] >= 1
    assert {r.limit_id for r in got} == {1, 2}
    assert packing.containers(docs.where("false"), limits).count() == 0


def test_pivotal_keeps_mass():
    rng = random.Random(3)
    items = [(i, rng.randrange(1, 50), rng.random()) for i in range(500)]
    done, held = mixing.pivotal(items, "s")
    sizes = {i: s for i, s, _ in items}
    mass = sum(sizes[i] * v for i, v in done) + (held[1] * held[2] if held else 0)
    assert abs(mass - sum(s * p for _, s, p in items)) < 1e-6 and len(done) + bool(held) == 500


def test_mixture(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 50)
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    rng = random.Random(4)
    docs = [(i, rng.choice(["A-a", "a_A", "b", "c", None]), " word" * rng.randrange(1, 40)) for i in range(800)] + [(900, "b", None), (901, "zz", ""), (None, "b", "x"), (3, "b", "dup")]
    docs = spark.createDataFrame([(*d, 1, 1) for d in docs], "doc_id bigint, source string, text string, base int, p int")
    targets = spark.createDataFrame([("a_a", 0.5, 2), ("b", 0.3, 3), ("c", 0.1, 2), ("gone", 0.1, 5), (None, 1.0, 1)], "source string, target_share double, max_repeats int")
    draw, shares = mixing.mixture(docs, targets)
    draw, shares = draw.collect(), {r.source: r for r in shares.collect()}
    assert len(draw) == len({r.doc_id for r in draw}) == 802
    caps = {"a_a": 2, "b": 3, "c": 2}
    assert all(0 <= r.copies <= caps.get(r.source, 0) for r in draw)
    total = sum(r.tokens * r.copies for r in draw)
    for s, share in (("a_a", 5 / 9), ("b", 3 / 9), ("c", 1 / 9)):
        assert abs(shares[s].share - share) < 0.02 and shares[s].drawn_tokens == sum(r.tokens * r.copies for r in draw if r.source == s)
    assert shares["gone"].share == 0 and total > 0 and set(shares) == {"a_a", "b", "c", "gone"}
    none, none_shares = mixing.mixture(docs.where("false"), targets)
    assert none.count() == 0 and {r.share for r in none_shares.collect()} == {0.0}


def group_specs():
    rng = random.Random(6)
    specs = [{"row_id": i, "group": rng.choice([f"g-{rng.randrange(40)}", f"G_{rng.randrange(40)}", f" g {rng.randrange(40)} ", "big-1", "BIG_1", None, "", "  "]), "key": rng.choice([None] * 9 + ["f1", "f2", " "]), "split": rng.choice(["train"] * 8 + ["validation", "test", None])} for i in range(400)]
    return specs + [dict(specs[5]), {"row_id": None, "group": "big-1"}, {"row_id": 999, "provenance": None, "split": "test"}]


def brute_sets(specs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for s in specs:
        if s["row_id"] is None:
            continue
        find(s["row_id"])
        g, k = s.get("group"), s.get("key")
        if g and g.strip():
            root[find(s["row_id"])] = find("g" + g.strip().lower().replace("_", "-").replace(" ", "-"))
        if k and k.strip():
            root[find(s["row_id"])] = find("f" + k)
    sets = defaultdict(set)
    for s in specs:
        if s["row_id"] is not None:
            sets[find(s["row_id"])].add(s["row_id"])
    return list(sets.values())


def test_parted_and_split_rows(spark):
    specs = group_specs()
    df = common.rows(spark, specs)
    split = {s["row_id"]: s.get("split", "train") for s in specs}
    want = {(min(ids), i) for ids in brute_sets(specs) if len({split[i] for i in ids} - {None}) > 1 for i in ids}
    assert {tuple(r) for r in splits.parted(df).collect()} == want and want
    goal = spark.createDataFrame([("train", 0.6), ("validation", 0.25), ("test", 0.15), (None, 1.0)], "split string, target_share double")
    got = {r.row_id: r for r in splits.split_rows(df, goal).collect()}
    assert set(got) == set(split) - {None}
    for ids in brute_sets(specs):
        assert len({got[i].split for i in ids}) == 1 and {got[i].group_row_id for i in ids} == {min(ids)}
    assert splits.parted(df.where("false")).count() == splits.split_rows(df.where("false"), goal).count() == 0


def test_allocation_meets_quotas():
    bundles = [(1, "train", 700), (1, None, 100), (5, "test", 20), (40, "train", 2), (3, "validation", 30)]
    out = splits.allocate(bundles, {"train": 0.85, "validation": 0.1, "test": 0.05})
    rows = sum(s * c for s, _, c in bundles)
    got = Counter()
    back = Counter()
    for size, profile, split, k in out:
        got[split] += size * k
        back[size, profile] += k
    assert back == Counter({(s, p): c for s, p, c in bundles})
    for split, share in (("train", 0.85), ("validation", 0.1), ("test", 0.05)):
        assert abs(got[split] - share * rows) <= 2


def test_minority_labels_count_as_moves():
    """A profile's rows cost what part of them would leave their split; quotas are met and test sets stay."""
    out = splits.allocate([(10, "train", 10), (10, "test", 4)], {"train": 0.6, "test": 0.4}, {("train", "train"): 0.9, ("train", "test"): 0.1, ("test", "train"): 0.4, ("test", "test"): 0.6})
    given = {}
    for size, _, s, k in out:
        given[s] = given.get(s, 0) + size * k
    assert given == {"train": 80, "test": 60} and sum(k for _, p, s, k in out if p == "test" and s == "test") == 4


def test_shares_are_reported(spark):
    rows = [{"row_id": i, "said": [], "group": f"g{i % 40}", "split": "train"} for i in range(200)]
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split string, target_share double")
    got = {r.split: r for r in splits.split_shares(common.rows(spark, rows), targets).collect()}
    assert {s: r.records for s, r in got.items()} == {"train": 160, "validation": 20, "test": 20}
    assert {s: r.moved for s, r in got.items()} == {"train": 0, "validation": 20, "test": 20}
