import random

import numpy as np

from qanat.llm import leaks, spans
from tests.llm import common


def brute_spans(specs, n):
    seen = {}
    for s in specs:
        if s["row_id"] is None:
            continue
        for t, c in enumerate(s.get("said", []), 1):
            w = [x for x in (c or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
            for i in range(len(w) - n + 1):
                seen.setdefault(tuple(w[i : i + n]), set()).add((s["row_id"], t, i))
    return {x for v in seen.values() if len({r for r, _, _ in v}) > 1 for x in v}


def test_shared_windows_equal_brute_force(spark):
    rng = random.Random(2)
    text = lambda n: [f"w{rng.randrange(50)}" for _ in range(n)]
    quote, other = text(55), text(45)
    specs = [
        {"row_id": 1, "said": [" ".join(text(10) + quote + text(5)), "é " + "\t".join(other)]},
        {"row_id": 2, "said": ["\n".join(quote), " ".join(other[:39])]},
        {"row_id": 3, "said": [" ".join(quote[:45]).upper(), " ".join(text(7) + other + text(9))]},
        {"row_id": 4, "said": [" ".join(quote[3:43]) + " x", None, ""]},
        {"row_id": 5, "said": [" ".join(["ab"] * 90)]},
        {"row_id": 6, "said": [" ".join(["ab"] * 41)]},
        {"row_id": 6, "said": [" ".join(["ab"] * 41)]},
        {"row_id": 7, "said": [" ".join(text(300))]},
        {"row_id": 8, "messages": None},
        {"row_id": None, "said": [" ".join(quote)]},
    ] + [{"row_id": 100 + i, "said": [" ".join(quote)]} for i in range(30)]
    df = common.rows(spark, specs)
    want = brute_spans(specs, 40)
    assert {(r.row_id, r.turn, r.start) for r in spans.shared_windows(df).collect()} == want
    got = {(r.row_id, r.turn): r.tokens for r in spans.shared_messages(df).collect()}
    cover = {}
    for r, t, i in want:
        cover.setdefault((r, t), set()).update(range(i, i + 40))
    assert got == {k: len(v) for k, v in cover.items()}
    shares = {r.row_id: r for r in spans.shared_shares(df).collect()}
    assert set(shares) == {s["row_id"] for s in specs} - {None}
    assert shares[100].share == 1.0 and shares[7].shared_tokens == 0 and shares[8].share is None
    assert spans.shared_messages(df.where("false")).count() == 0


def test_automata_grow_with_the_text(spark, monkeypatch):
    """Ten times the messages and phrases make about ten times the automata and copied phrases, and the same windows."""
    monkeypatch.setattr(spans, "SHARD", 20)
    monkeypatch.setattr(spans, "STREAM", 4_000)
    made = []
    whole = spans.sharded
    monkeypatch.setattr(spans, "sharded", lambda p, m: made.append(whole(p, m)) or made[-1])
    sizes = []
    for n in (40, 400):
        rng = random.Random(n)
        passage = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
        specs = []
        for i in range(n):
            p = passage()
            specs += [{"row_id": 10 * i + k, "said": [f"{passage()} {p}"]} for k in range(3)]
        got = {(r.row_id, r.turn, r.start) for r in spans.shared_windows(common.rows(spark, specs)).collect()}
        assert got == {(s["row_id"], 1, 60 + k) for s in specs for k in range(21)}
        spread, routed = made[-1]
        sizes.append((spread.select("shard", "salt").distinct().count(), spread.count(), routed.count()))
    assert all(x >= 2 for x in sizes[0]) and all(5 * a < b < 15 * a for a, b in zip(*sizes))


SUITE = "id string, title string, turns array<struct<user:string,expected:string,fail_if:string>>"


def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    text = lambda n: [f"v{rng.randrange(40)}" for _ in range(n)]
    a, b, c = text(30), text(12), text(11)
    suite = [("s1", "t", [(" ".join(a), " ".join(b), "f"), (None, "", None)]), ("s2", "t", [(" ".join(a[:12]), " ".join(c), None)]), ("s3", "t", None)]
    specs = [
        {"row_id": 1, "said": [" ".join(text(9) + a[5:18] + text(4)), "ﬁ " + " ".join(b).upper()]},
        {"row_id": 1, "said": [" ".join(text(9) + a[5:18] + text(4)), "ﬁ " + " ".join(b).upper()]},
        {"row_id": 2, "said": [" ".join(a[:6]), " ".join(a[6:12])]},
        {"row_id": 3, "said": [" ".join(a[:12])], "split": "test"},
        {"row_id": 4, "said": [" ".join(a[:12]), " ".join(c)], "split": "train"},
        {"row_id": 5, "said": [None, "", " ".join(text(500))]},
        {"row_id": None, "said": [" ".join(a)]},
    ]
    held = {}
    for key, _, turns in suite:
        for t, (u, e, _) in enumerate(turns or [], 1):
            for f, x in (("user", u), ("expected", e)):
                for g in common.grams(common.words(x), 12):
                    held.setdefault(g, set()).add((key, t, f))
    want = {(s["row_id"], t, *k) for s in specs if s["row_id"] and s.get("split", "train") == "train" for t, x in enumerate(s["said"], 1) for g in common.grams(common.words(x), 12) for k in held.get(g, ())}
    df, sc = common.rows(spark, specs), spark.createDataFrame(suite, SUITE)
    got = leaks.leaks(df, sc).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and want
    assert leaks.leaks(df.where("false"), sc).count() == leaks.leaks(df, sc.where("false")).count() == 0


def test_simhash_is_a_majority():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**64, 40, dtype=np.uint64)
    for n in (1, 2, 7, 12):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(int)
        want = [(bits[i : i + n].sum(axis=0) >= (n + 1) // 2) for i in range(len(h) - n + 1)]
        got = np.unpackbits(leaks.simhash(h, n).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
        assert (got == np.array(want)).all()


def test_index_finds_all_within_radius():
    rng = np.random.default_rng(2)
    suite = leaks.Suite([("k", 1, "user")], [" ".join(f"q{i}" for i in range(60))], 12)
    near = np.concatenate([suite.print ^ (np.uint64(1) << np.uint64(i)) ^ (np.uint64(1) << np.uint64(j)) for i, j in rng.integers(0, 64, (20, 2))])
    prints = np.concatenate([near, rng.integers(0, 2**64, 500, dtype=np.uint64)])
    x, y = suite.near(prints)
    d = np.bitwise_count(prints[:, None] ^ suite.print[None])
    assert set(zip(x.tolist(), y.tolist())) == set(zip(*(v.tolist() for v in np.nonzero(d <= leaks.RADIUS))))


def test_edited_copies_of_whole_texts(spark):
    """Recall of texts with one or two words changed whose best window keeps a similarity of 0.8, against brute force."""
    rng = random.Random(7)
    bag = [f"v{i}" for i in range(2000)]
    suite, specs = [], []
    for i in range(90):
        text = [rng.choice(bag) for _ in range(rng.randrange(20, 90))]
        suite.append((f"s{i}", "t", [(" ".join(text), None, None)]))
        for _ in range(1 + i % 2):
            text[rng.randrange(len(text))] = "changed"
        specs.append({"row_id": i, "said": [" ".join(rng.choice(bag) for _ in range(15)) + " " + " ".join(text) + " and so on"]})
    specs += [{"row_id": 1000 + i, "said": [" ".join(rng.choice(bag) for _ in range(80))]} for i in range(30)]
    df, sc = common.rows(spark, specs), spark.createDataFrame(suite, SUITE)
    got = {(r.row_id, r.scenario_id) for r in leaks.leaks(df, sc, least=0.8).collect()}
    want = set()
    for part in leaks._suites(sc, 12, 0.8):
        for held in part:
            for s in specs:
                h = leaks.words([s["said"][0]])[0]
                pairs = leaks.window_hashes(h, 2)
                for k in range(len(held.at)):
                    if any(held.similarity(pairs[i : i + held.n - 1], k) >= 0.8 for i in range(max(0, len(h) - held.n + 1)) if len(np.intersect1d(pairs[i : i + held.n - 1], leaks.window_hashes(held.h[held.at[k] : held.at[k] + held.n], 2))) > held.n // 2):
                        want.add((s["row_id"], held.keys[held.of[k]][0]))
    assert len(want) > 60 and got <= want
    assert len(got) >= 0.9 * len(want), (len(got), len(want))
