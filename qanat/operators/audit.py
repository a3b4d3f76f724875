"""Set algebra between tables, group-safe splits and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qanat.functions.session import cut


def partition_audit(universe: DataFrame, part: DataFrame, key: str) -> DataFrame:
    """(status, keys): keys in both, only in the universe (missing) or only in the part (extra), in one pass."""
    tagged = universe.select(key, F.lit(1).alias("u"), F.lit(0).alias("p")).union(part.select(key, F.lit(0), F.lit(1)))
    where = tagged.groupBy(key).agg(F.max("u").alias("u"), F.max("p").alias("p"))
    status = F.when((F.col("u") == 1) & (F.col("p") == 1), "both").when(F.col("u") == 1, "missing").otherwise("extra")
    return where.groupBy(status.alias("status")).agg(F.count("*").alias("keys"))


def split_overlaps(rows: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """(key, shared): for each kind of key the number of its values that occur in more than one split."""
    long = rows.where("split IS NOT NULL").select("split", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), c.cast("string").alias("value")) for k, c in keys.items()])).alias("x")).select("split", "x.*")
    values = long.where("value IS NOT NULL").groupBy("key", "value").agg((F.min("split") != F.max("split")).alias("parted"))
    return values.groupBy("key").agg(F.count_if("parted").alias("shared"))


def prefix_sums(rows: DataFrame, order: str, amount: str, name: str, width: int = 2) -> DataFrame:
    """``rows`` with the sum of ``amount`` over all rows before them in the order of a hex digest column.

    The digests' first ``width`` digits cut the order into ranges; range totals are few, so only they share a task.
    """
    parted = rows.withColumn("_p", F.substring(order, 1, width))
    totals = parted.groupBy("_p").agg(F.sum(amount).alias("_t"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # at most 16 ** width rows
    starts = totals.select("_p", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_s"))
    own = Window.partitionBy("_p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return parted.withColumn("_o", F.coalesce(F.sum(amount).over(own), F.lit(0))).join(F.broadcast(starts), "_p").withColumn(name, F.col("_s") + F.col("_o")).drop("_p", "_s", "_o")


def group_split(rows: DataFrame, group: Column, share: float, seed: str) -> DataFrame:
    """(group, rows, split): whole groups in the order of a seeded hash go to validation until it has ``share`` of all rows, the others to train."""
    groups = rows.groupBy(group.alias("group")).agg(F.count("*").alias("rows")).withColumn("h", F.sha2(F.concat(F.lit(seed), "group"), 256))
    total = groups.agg(F.sum("rows").alias("total"))
    before = prefix_sums(groups, "h", "rows", "before")
    return before.crossJoin(F.broadcast(total)).select("group", "rows", F.when(F.col("before") < F.col("total") * share, "validation").otherwise("train").alias("split"))  # one row


def latest(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The last row of each key by ``order``; an aggregate, so a hot key is reduced before it is shuffled."""
    top = F.max_by(F.struct(*columns), F.struct(*order)).alias("x")
    return rows.groupBy(*keys).agg(top).select(*keys, "x.*")


def exact_split(rows: DataFrame, group: Column, target: int, seed: str) -> DataFrame:
    """(group, rows, split): whole groups go to validation until it has ``target`` rows exactly, or the most that fits below if no choice gives that.

    Groups go in the order of a seeded hash as long as they fit; the rest is filled by a subset sum over the sizes of the
    others. Only sizes and their numbers reach the driver: at most about sqrt(2 x rows) of them. Rows without a group are left out.
    """
    groups = rows.where(group.isNotNull()).groupBy(group.cast("string").alias("group")).agg(F.count("*").alias("rows")).withColumn("h", F.sha2(F.concat(F.lit(seed), F.lit(":"), "group"), 256))
    groups = cut(prefix_sums(groups, "h", "rows", "before"))
    have = groups.where(F.col("before") + F.col("rows") <= target).agg(F.sum("rows")).collect()[0][0] or 0
    left = target - have
    open_ = groups.where((F.col("before") + F.col("rows") > target) & (F.col("rows") <= left))
    take = fill({r.rows: r.n for r in open_.groupBy("rows").agg(F.count("*").alias("n")).collect()}, left)
    chosen = groups.sparkSession.createDataFrame(sorted(take.items()) or [(-1, 0)], "rows bigint, k bigint")
    most = max(take.values(), default=0)
    ranked = open_.withColumn("r", F.row_number().over(Window.partitionBy("rows").orderBy("h"))).where(F.col("r") <= most)  # the limit goes below the shuffle
    extra = ranked.join(F.broadcast(chosen), "rows").where("r <= k").select("group", F.lit(True).alias("extra"))  # sizes only
    picked = groups.join(extra, "group", "left")
    return picked.select("group", "rows", F.when((F.col("before") + F.col("rows") <= target) | F.col("extra"), "validation").otherwise("train").alias("split"))


def fill(sizes: dict[int, int], target: int) -> dict[int, int]:
    """How many of each size give the largest sum up to ``target``: a subset sum on the bits of a number, each size in powers of two."""
    parts: list[tuple[int, int]] = []
    for size in sorted(sizes, reverse=True):
        left, k = min(sizes[size], target // size), 1
        while left > 0:
            parts.append((size, min(k, left)))
            left -= k
            k *= 2
    mask, reach = (1 << (target + 1)) - 1, [1]
    for size, k in parts:
        reach.append((reach[-1] | reach[-1] << size * k) & mask)
    total, take = reach[-1].bit_length() - 1, {}
    for (size, k), before in zip(reversed(parts), reversed(reach[:-1])):
        if not before >> total & 1:
            take[size] = take.get(size, 0) + k
            total -= size * k
    return take


def row_hash(columns: list[str]) -> Column:
    """A hash of a whole row in canonical JSON; nulls count."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def bag_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(only_a, only_b): rows that one of two tables of equal columns has more often, by the hash of the whole row."""
    h = row_hash(a.columns).alias("h")
    tagged = a.select(h, F.lit(1).alias("s")).union(b.select(h, F.lit(-1)))
    return tagged.groupBy("h").agg(F.sum("s").alias("s")).agg(F.coalesce(F.sum(F.greatest("s", F.lit(0))), F.lit(0)).alias("only_a"), F.coalesce(F.sum(F.greatest(-F.col("s"), F.lit(0))), F.lit(0)).alias("only_b"))


def uniqueness(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, values, distinct_values, unique) of each column; nulls aren't counted."""
    wide = rows.agg(*[F.count(c).alias(f"{c}_n") for c in columns], *[F.countDistinct(c).alias(f"{c}_d") for c in columns])
    each = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"{c}_n").alias("values"), F.col(f"{c}_d").alias("distinct_values")) for c in columns])
    return wide.select(F.explode(each).alias("x")).select("x.*").withColumn("unique", F.col("values") == F.col("distinct_values"))


def fingerprint(entries: DataFrame, columns: list[str]) -> DataFrame:
    """(entries, sha256): one hash of all rows in whatever order: hashes by the first digits of the rows' own, then a hash of those."""
    own = entries.select(row_hash(columns).alias("h"))
    fine = own.groupBy(F.substring("h", 1, 4).alias("p")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"))  # a 65,536th of the rows
    coarse = fine.groupBy(F.substring("p", 1, 2).alias("p")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), ""), 256).alias("h"))  # at most 256 each
    return coarse.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("entries"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), ""), 256).alias("sha256"))
