"""The content gate: duplicates, templates, shared spans, contamination and decisions over (id, text).

Tables as long as the corpus, or as its n-grams, are merged and never broadcast: the planner takes them for as small as the files they come from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qanat.functions.session import lookup, measured, spread, stored, with_lookup
from qanat.functions.text import let, ngram_hashes, ngrams, tokens


def worded(texts: DataFrame) -> DataFrame:
    """(id, w): the words of each text; a table that has them already stays as it is. References have theirs by the same rule."""
    return texts if "w" in texts.columns else spread(texts.select("id", "text")).select("id", tokens(F.col("text")).alias("w"))


def marked(texts: DataFrame) -> DataFrame:
    """(id, w, t): the words of each text, and the hash by which texts of equal words are one."""
    return worded(texts).select("id", "w", F.xxhash64(F.array_join("w", " ")).alias("t"))


def exact_duplicates(texts: DataFrame) -> DataFrame:
    """(text_sha256, copies, first_id, last_id): texts of equal words that at least two ids have. Texts without words are left out."""
    hashed = worded(texts).where(F.size("w") > 0).select("id", F.sha2(F.array_join("w", " "), 256).alias("text_sha256"))
    return hashed.groupBy("text_sha256").agg(F.count("*").alias("copies"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("copies > 1")


#: Of the texts, one in so many tells which n-grams are frequent, and in so many slots (2 to the power) their ranks are kept.
RANKED, RANK_SLOTS = 8, 18
#: Bits (2 to the power) of the filter of n-grams whose holders are counted: sixteen a member within these limits.
FEWEST_BITS, MOST_BITS = 16, 26


def near_duplicates(texts: DataFrame, threshold: float = 0.82, n: int = 5, least_words: int = 10, cap: int | None = 100) -> DataFrame:
    """(left_id, right_id, similarity) with left_id < right_id, exact copies left out.

    Similarity is that of the reference gate: n-grams that more than ``cap`` ids hold don't count as shared but
    stay in the sizes. The cap is part of that measure; without one (None) the similarity is the exact Jaccard index over all n-grams.
    Partners share at least threshold * size of a text's n-grams, so in any order of the n-grams they have one in common among each one's first
    size - threshold * size + 1. Only those travel, and what two texts have in common among them bounds what they have in common at all. The order is that of their hashes, after ranks of the frequent ones, so that hot n-grams come last; which are
    frequent, some texts tell, and that decides on no pair. Candidates are compared by all their n-grams, and a cap lowers the similarity of those that reach the threshold without one.
    """
    words = texts if "t" in texts.columns else stored(marked(texts))
    words = words.where(F.size("w") >= least_words)
    ids = words.select("id", "t").distinct()
    grams = let(ngram_hashes(F.col("w"), n), F.array_distinct)
    often = words.where(F.pmod("t", F.lit(RANKED)) == 0).select(F.explode(grams).alias("g")).groupBy("g").agg(F.count("*").alias("c")).where("c >= 4")
    ranks = often.select(F.shiftrightunsigned("g", 64 - RANK_SLOTS).alias("slot"), F.least(F.lit(127), F.floor(4 * F.log2("c"))).alias("value")).groupBy("slot").agg(F.max("value").alias("value"))
    keyed = lambda table: F.transform("g", lambda g: F.shiftleft(F.coalesce(F.get(table, F.shiftrightunsigned(g, 64 - RANK_SLOTS).cast("int")), F.lit(0)).cast("bigint"), 56).bitwiseOR(F.shiftrightunsigned(g, 8)))
    sets = with_lookup(words.select("t", grams.alias("g")), lookup(ranks, 1 << RANK_SLOTS, "tinyint"))
    sets = sets.select("t", F.size("g").alias("n"), F.sort_array(let(F.col("table"), keyed)).alias("k"))
    some = F.expr(f"slice(k, 1, n - cast(ceil({threshold}D * n - 1e-9D) as int) + 1)")
    posts = sets.select("t", "n", F.posexplode(some).alias("p", "k")).select("k", "t", F.shiftleft(F.col("n").cast("bigint"), 32).bitwiseOR(F.col("p").cast("bigint")).alias("np"))
    alone = Window.partitionBy("k")
    posts = stored(posts.withColumn("same", F.min("t").over(alone) == F.max("t").over(alone)).where("NOT same").drop("same").distinct())
    a, b = posts.toDF("k", "lt", "l"), posts.toDF("k", "rt", "r")
    size = F.expr(f"least(l >> 32, r >> 32) >= {threshold}D * greatest(l >> 32, r >> 32) - 1e-9D")  # smaller texts can't reach the threshold
    met = a.join(b.hint("merge"), "k").where((F.col("lt") < F.col("rt")) & size).select("lt", "rt", "l", "r").repartition("lt", "rt")  # most pairs meet once or twice: a row is less than its aggregate
    met = met.groupBy("lt", "rt").agg(F.max("l").alias("l"), F.max("r").alias("r"), F.count("*").alias("c"))
    met = met.select("lt", "rt", "c", *[F.expr(e).cast("int").alias(c) for c, e in (("ln", "l >> 32"), ("lp", "l & 4294967295"), ("rn", "r >> 32"), ("rp", "r & 4294967295"))])
    after = F.expr(f"least(ln - lp - 1, rn - rp - 1, greatest(ceil({threshold}D * ln - 1e-9D), ceil({threshold}D * rn - 1e-9D)) - 1)")  # n-grams behind the last common one, or behind all that travelled
    pairs = stored(met.where(F.col("c") + after >= F.expr(f"{threshold}D / (1 + {threshold}D) * (ln + rn) - 1e-9D")).select("lt", "rt", "ln", "rn"))
    asked = pairs.select(F.explode(F.array("lt", "rt")).alias("t")).distinct()
    holders = ids.groupBy("t").agg(F.min("id").alias("id")).join(asked.hint("merge"), "t", "left_semi")
    arrays = stored(words.join(measured(holders), ["id", "t"], "left_semi").select("t", grams.alias("g")))
    both = pairs.join(arrays.toDF("lt", "x").hint("merge"), "lt").join(arrays.toDF("rt", "y").hint("merge"), "rt").withColumn("shared", F.array_intersect("x", "y"))
    similarity = (F.col("s") / (F.col("ln") + F.col("rn") - F.col("s"))).alias("similarity")
    reached = lambda df: df.select("*", similarity).where(F.col("similarity") >= threshold)
    found = reached(both.select("lt", "rt", "ln", "rn", "shared", F.size("shared").alias("s")))
    if cap:
        found = stored(found.drop("similarity"))
        found = reached(found.join(_over(words, grams, found, cap), ["lt", "rt"], "left").select("lt", "rt", "ln", "rn", (F.col("s") - F.coalesce("over", F.lit(0))).alias("s")))
    named = found.select("lt", "rt", "similarity").join(ids.toDF("a", "lt").hint("merge"), "lt").join(ids.toDF("b", "rt").hint("merge"), "rt").where("a <> b")
    return named.select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"), "similarity").distinct()


def bitmap(grams: DataFrame, members: int):
    """A lookup of bits that the hashes ``grams`` (g) set, sixteen a member within limits, and the test (table, g) that each of them passes."""
    bits = min(MOST_BITS, max(FEWEST_BITS, (16 * members).bit_length()))
    word = lambda g: F.shiftrightunsigned(g, 64 - bits + 6).cast("int")
    bit = lambda g: F.shiftrightunsigned(g, 64 - bits).bitwiseAND(F.lit(63)).cast("int")
    slots = grams.select(word(F.col("g")).alias("slot"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(F.col("g"))).alias("b")).groupBy("slot").agg(F.bit_or("b").alias("value"))
    passes = lambda table, g: F.call_function("shiftrightunsigned", F.get(table, word(g)), bit(g)).bitwiseAND(F.lit(1)) == 1
    return lookup(slots, 1 << bits - 6, "bigint"), passes


def whole(array: str):
    """All of an array, to be exploded. What makes the array is projected before, so that a lookup in it is in no row; of a mere column the optimizer would make the array once more to see if it is empty."""
    return F.slice(F.col(array), 1, 1 << 30)


def _over(words: DataFrame, grams, found: DataFrame, cap: int) -> DataFrame:
    """(lt, rt, over): how many of the n-grams that a pair shares more than ``cap`` ids hold. Holders are counted of n-grams that pass a filter of the shared ones."""
    shared = found.select("lt", "rt", F.explode("shared").alias("g"))
    table, passes = bitmap(shared, found.agg(F.sum("s")).collect()[0][0] or 0)
    held = lambda table: F.filter("g", lambda g: passes(table, g))
    posts = with_lookup(words.select(grams.alias("g")), table).select(let(F.col("table"), held).alias("g")).select(F.explode(whole("g")).alias("g"))
    hot = posts.groupBy("g").agg(F.count("*").alias("c")).where(F.col("c") > cap).select("g")
    return stored(shared.join(measured(hot), "g", "left_semi").groupBy("lt", "rt").agg(F.count("*").alias("over"))).hint("merge")


def openings(texts: DataFrame, n: int = 8, least: int = 3) -> DataFrame:
    """(opening, occurrences, records): first n words that at least ``least`` ids begin with."""
    first = worded(texts).where(F.size("w") >= n).select("id", F.array_join(F.slice("w", 1, n), " ").alias("opening"))
    return first.groupBy("opening").agg(F.count("*").alias("occurrences"), F.countDistinct("id").alias("records")).where(F.col("records") >= least)


def shared_spans(texts: DataFrame, n: int = 16) -> DataFrame:
    """(span, records, first_id, last_id): one n-word span, the smallest, for each set of at least two ids that share spans.

    Sets of ids are told apart by their count, ends and the sum of their hashes, so that no set is gathered. Spans travel
    as hashes; the words of those that are shared are fetched from the first id that has them.
    """
    texts = stored(worded(texts))
    posts = texts.select("id", F.explode(let(ngram_hashes(F.col("w"), n), F.array_distinct)).alias("g")).repartition("g")  # most spans stand once: a row is less than its aggregate
    sets = posts.groupBy("g").agg(F.count("*").alias("records"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("s")).where("records > 1")
    spelled = spell(texts, sets, n, "first_id")
    return spelled.groupBy("records", "first_id", "last_id", "s").agg(F.min("span").alias("span")).select("span", "records", "first_id", "last_id")


def spell(texts: DataFrame, spans: DataFrame, n: int, holder: str) -> DataFrame:
    """``spans`` (g, the id in column ``holder``, ...) with the words of each as ``span``, taken from that id's words (id, w)."""
    wanted = spans.groupBy(F.col(holder).alias("id")).agg(F.collect_set("g").alias("gs"))  # at most the n-grams of one text
    at = F.filter(F.transform(ngram_hashes(F.col("w"), n), lambda g, i: F.struct(g.alias("g"), i.alias("i"))), lambda x: F.array_contains("gs", x["g"]))
    lines = texts.where(F.size("w") >= n).select("id", F.array_join("w", " ").alias("line"))  # a string travels in a third of its words' bytes
    found = lines.join(wanted.hint("merge"), "id").select("id", "gs", F.split("line", " ").alias("w")).select(F.col("id").alias(holder), "w", F.explode(at).alias("_at"))
    found = found.select(holder, F.col("_at.g").alias("g"), F.array_join(F.slice("w", F.col("_at.i") + 1, n), " ").alias("span")).groupBy(holder, "g").agg(F.min("span").alias("span"))
    return spans.join(found.hint("merge"), [holder, "g"])


def referred(words: DataFrame, grams: DataFrame, n: int) -> DataFrame:
    """(id, x array<struct<p, g>>): of the n-grams of each text those that pass a filter of the hashes ``grams`` (g), so that few are exploded. The join with these decides."""
    table, passes = bitmap(grams, grams.count())
    held = lambda table: F.array_compact(F.transform(ngram_hashes(F.col("w"), n), lambda g, i: F.when(passes(table, g), F.struct(i.alias("p"), g.alias("g")))))
    return with_lookup(words.select("id", "w"), table).select("id", let(F.col("table"), held).alias("x"))


def longest_overlaps(texts: DataFrame, references: DataFrame, n: int = 8) -> DataFrame:
    """(id, ref, overlap_words, start): each text's longest run of words that stands in a reference (ref, text), n or more.

    n-grams of both sides meet; hits of one pair on one diagonal that follow each other are a run. Ties go to
    the earliest start, then to the smallest ref and place in it.
    """
    b = measured(references.select("ref", F.posexplode(ngram_hashes(tokens(F.col("text")), n)).alias("q", "g")))
    a = referred(worded(texts), b, n).select("id", F.explode(whole("x")).alias("x")).select("id", "x.p", "x.g")
    hits = a.join(b, "g").select("id", "ref", "p", "q", (F.col("p") - F.col("q")).alias("d"))
    run = hits.withColumn("island", F.col("p") - F.row_number().over(Window.partitionBy("id", "ref", "d").orderBy("p")))
    runs = run.groupBy("id", "ref", "d", "island").agg((F.count("*") + n - 1).alias("overlap_words"), F.min("p").alias("start"), F.min("q").alias("q"))
    return runs.groupBy("id").agg(F.min(F.struct(-F.col("overlap_words"), "start", "ref", "q")).alias("m")).select("id", F.col("m.ref").alias("ref"), (-F.col("m.col1")).alias("overlap_words"), F.col("m.start").alias("start"))


def contaminated(texts: DataFrame, references: DataFrame, n: int = 12) -> DataFrame:
    """(id): texts that share n consecutive words with a reference."""
    b = measured(references.select(F.explode(ngram_hashes(tokens(F.col("text")), n)).alias("g")).distinct())
    a = referred(worded(texts), b, n).select("id", F.explode(whole("x")).alias("x")).select("id", "x.g")
    return a.join(b, "g", "left_semi").select("id").distinct()


def text_flags(texts: DataFrame, references: DataFrame) -> DataFrame:
    """(id, code, severity): what the corpus passes of the gate find, each code once per id."""
    texts = stored(marked(texts))  # all passes read the words, which are made once
    hashed = texts.where(F.size("w") > 0).select("id", "t")
    copies = hashed.join(hashed.groupBy("t").agg(F.count("*").alias("c")).where("c > 1").select("t").hint("merge"), "t", "left_semi")
    near = near_duplicates(texts)
    first = texts.where(F.size("w") >= 8).select("id", F.xxhash64(F.array_join(F.slice("w", 1, 8), " ")).alias("o"))
    opened = first.groupBy("o").agg(F.countDistinct("id").alias("records")).where("records >= 3")
    spans = texts.select("id", F.explode(let(ngram_hashes(F.col("w"), 16), F.array_distinct)).alias("g"))
    parts = [
        (copies, "exact_corpus_duplicate", "block"),
        (near.select(F.explode(F.array("left_id", "right_id")).alias("id")), "near_corpus_duplicate", "block"),
        (first.join(opened.select("o").hint("merge"), "o", "left_semi"), "repeated_templated_opening", "review"),
        (spans.withColumn("c", F.count("*").over(Window.partitionBy("g"))).where("c > 1"), "suspicious_shared_verbatim_span", "review"),
        (contaminated(texts, references, 8), "heldout_eval_phrase_overlap", "block"),
    ]
    out = None
    for df, code, severity in parts:
        df = df.select("id").distinct().select("id", F.lit(code).alias("code"), F.lit(severity).alias("severity"))
        out = df if out is None else out.union(df)
    return out


def decisions(texts: DataFrame, flags: DataFrame) -> DataFrame:
    """(id, decision, flags): block if any flag blocks, review if there is any, else pass."""
    worst = flags.groupBy("id").agg(F.max((F.col("severity") == "block").cast("int")).alias("w"), F.count("*").alias("flags"))
    return texts.select("id").join(worst.hint("merge"), "id", "left").select("id", F.when(F.col("w") == 1, "block").when(F.col("w") == 0, "review").otherwise("pass").alias("decision"), F.coalesce("flags", F.lit(0)).alias("flags"))
