"""Problem 1: splits that never part related records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qanat.llm.graph import components
from qanat.llm.runtime import cut, ranked


def tied(rows: DataFrame) -> DataFrame:
    """(row_id, split, set_id): each record once, with the set it is tied into.

    Rows are tied by the same source group (letter case, surrounding blanks and separators aside) or the same
    source_family_key, also through further rows. Null and blank values tie nothing; a record tied to none is a set
    of its own. Sets are found on the distinct pairs of keys, not on rows, so a hot group is one node. Rows with
    null row_id are no records; a redelivered record counts once.
    """
    group = F.translate(F.lower(F.regexp_replace("provenance.source_group_id", r"^[\s\x{a0}]+|[\s\x{a0}]+$", "")), "_ ", "--")
    family = F.col("provenance.source_family_key")
    keyed = rows.where("row_id IS NOT NULL").select(
        "row_id",
        "split",
        F.when(F.length(group) > 0, F.concat(F.lit("g:"), group)).alias("g"),
        F.when(F.length(F.trim(family)) > 0, F.concat(F.lit("f:"), family)).alias("f"),
    )
    keyed = cut(keyed.groupBy("row_id").agg(F.max("split").alias("split"), F.max("g").alias("g"), F.max("f").alias("f")))
    both = components(keyed.where("g IS NOT NULL AND f IS NOT NULL").select(F.col("g").alias("u"), F.col("f").alias("v")).distinct())
    keyed = keyed.withColumn("node", F.coalesce("g", "f", F.concat(F.lit("r:"), F.col("row_id"))))
    named = keyed.join(both, "node", "left").select("row_id", "split", F.coalesce("component", "node").alias("set_id"))
    return cut(named)


def parted(rows: DataFrame) -> DataFrame:
    """(group_row_id, row_id): every record of a tied set whose non-null splits are more than one; group_row_id is the set's smallest row_id."""
    own = tied(rows)
    sets = own.groupBy("set_id").agg(F.min("row_id").alias("group_row_id"), F.min("split").alias("x"), F.max("split").alias("y")).where("x <> y")
    return own.join(sets, "set_id").select("group_row_id", "row_id")


def allocate(bundles: list[tuple[int, str | None, int]], targets: dict[str, float], stay: dict[tuple[str | None, str], float] | None = None) -> list[tuple[int, str | None, str, int]]:
    """(size, profile, split, sets): how many sets of each bundle (size, profile, number of sets) go to each split.

    Rows flow from profiles to splits at the least cost: a row of a profile costs the part of the profile's rows that would leave their own split
    (1 less ``stay``, which is 1 for the profile's own split where it isn't given), a row above a split's quota costs 3. The flow is then rounded to whole sets, largest first: as many as the profile's quota of a
    split holds, the rest each to the split that is short of most rows.
    """
    names = list(targets)
    rows = sum(size * count for size, _, count in bundles)
    share = sum(targets.values()) or 1.0
    quota = {s: rows * targets[s] / share for s in names}
    supply: dict[str | None, float] = {}
    for size, profile, count in bundles:
        profile = profile if profile in targets else None
        supply[profile] = supply.get(profile, 0) + size * count

    # successive shortest paths: profile -> split -> ... -> split with room; a step back takes rows of another profile along
    flow = {(p, s): 0.0 for p in supply for s in names}
    room = dict(quota)
    stay = stay or {}
    cost = lambda p, s: 0.0 if p is None else 1.0 - stay.get((p, s), float(p == s))
    for p in sorted(supply, key=lambda x: (x is None, str(x))):
        left = supply[p]
        while left > 1e-9:
            best = {s: (cost(p, s), [(p, s)]) for s in names}
            for _ in names:
                for a in names:
                    for b in names:
                        for q in supply:
                            if a != b and flow[q, a] > 1e-9 and best[a][0] + cost(q, b) - cost(q, a) < best[b][0] - 1e-12:
                                best[b] = (best[a][0] + cost(q, b) - cost(q, a), [*best[a][1], (q, a, b)])
            ends = [(c + (0 if room[s] > 1e-9 else 3), s, path) for s, (c, path) in best.items()]
            c, s, path = min(ends, key=lambda x: (x[0], -room[x[1]], x[1]))
            amount = min([left, *([room[s]] if room[s] > 1e-9 else []), *(flow[x[0], x[1]] for x in path[1:])])
            flow[path[0]] += amount
            for q, a, b in path[1:]:
                flow[q, a] -= amount
                flow[q, b] += amount
            room[s] -= amount
            left -= amount
    short = dict(quota)
    out = []
    for size, profile, count in sorted(bundles, key=lambda b: (-b[0], str(b[1]))):
        p = profile if profile in targets else None
        given = {s: 0 for s in names}
        for s in sorted(names, key=lambda s: (-flow[p, s], s)):
            k = min(count, int(max(0.0, min(flow[p, s], short[s]) + 1e-9) // size))
            given[s] += k
            count -= k
            flow[p, s] -= k * size
            short[s] -= k * size
        while count:
            s = max(names, key=lambda s: (short[s], s))
            other = sorted(short.values())[-2] if len(names) > 1 else 0.0
            k = min(count, max(1, int((short[s] - max(0.0, other)) // size)))
            given[s] += k
            count -= k
            flow[p, s] -= k * size
            short[s] -= k * size
        out += [(size, profile, s, k) for s, k in given.items() if k]
    return out


def split_rows(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(row_id, group_row_id, split, previous_split, moved): every record's split, whole sets together.

    Sets are bundled by size and by the split most of their rows had (none if null). The driver sees bundles only:
    their sizes differ, so n rows have at most about sqrt(8 n) of them per profile. Members take their
    bundle's splits in the order of a hash. Targets with null or negative shares count as 0.
    """
    spark = rows.sparkSession
    own = tied(rows)
    goal = {r.split: max(0.0, r.target_share or 0.0) for r in targets.where("split IS NOT NULL").orderBy("split").collect()}  # one row per split
    if not goal:
        raise ValueError("split_targets is empty")
    votes = own.groupBy("set_id", "split").agg(F.count("*").alias("n"), F.min("row_id").alias("least"))
    most = F.max_by("split", F.struct(F.when(F.col("split").isNotNull(), F.col("n")).otherwise(-1), "split"))
    sets = cut(votes.groupBy("set_id").agg(F.sum("n").alias("size"), F.min("least").alias("group_row_id"), most.alias("profile")))
    bundles = [(r["size"], r.profile, r.n) for r in sets.groupBy("size", "profile").agg(F.count("*").alias("n")).collect()]
    runs, base = [], {}
    kept = votes.join(sets.select("set_id", "profile"), "set_id").where("split IS NOT NULL").groupBy("profile", "split").agg(F.sum("n").alias("n")).collect()  # a row for each two splits
    labelled: dict[str, int] = {}
    for r in kept:
        labelled[r.profile] = labelled.get(r.profile, 0) + r.n
    stay = {(r.profile, s): 0.0 for r in kept for s in goal} | {(r.profile, r.split): r.n / labelled[r.profile] for r in kept}
    for size, profile, split, k in allocate(bundles, goal, stay):
        at = base.get((size, profile), 0)
        runs.append((size, profile or "", split, at, at + k))
        base[size, profile] = at + k
    plan = spark.createDataFrame(runs, "size bigint, label string, given string, low bigint, high bigint")
    placed = ranked(sets.withColumn("label", F.coalesce("profile", F.lit(""))), ["size", "label"], "group_row_id")
    given = placed.join(plan, ["size", "label"]).where("rank >= low AND rank < high").select("set_id", "group_row_id", "given")
    out = own.join(given, "set_id")
    return out.select("row_id", "group_row_id", F.col("given").alias("split"), F.col("split").alias("previous_split"), (F.col("split").isNotNull() & (F.col("split") != F.col("given"))).alias("moved"))


def split_shares(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(split, target_share, records, share, moved): what each split of ``split_rows`` reached, and how many of its records came from another one."""
    given = split_rows(rows, targets).groupBy("split").agg(F.count("*").alias("records"), F.count_if("moved").alias("moved"))
    out = targets.where("split IS NOT NULL").select("split", "target_share").join(given, "split", "left").na.fill(0, ["records", "moved"])
    total = given.agg(F.sum("records").alias("total"))
    return out.crossJoin(F.broadcast(total)).select("split", "target_share", "records", F.when(F.col("total") > 0, F.col("records") / F.col("total")).otherwise(0.0).alias("share"), "moved")  # one row joined to one per split
