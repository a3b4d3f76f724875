"""The content gate over records of messages: flags of messages and of the corpus, decisions and the report.

A record is (id, messages array<struct<role, content>>); a record that comes again counts once. Peers of a flag are counted, not
listed: a shared passage may stand in a third of all records.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qanat.functions import patterns
from qanat.functions.session import cut, spread, stored
from qanat.functions.text import let, ngram_hashes, tokens
from qanat.operators import gate

# Kinds of flags and what they mean for a record.
SEVERITY = {
    "unscannable_messages": "block",
    "heldout_eval_phrase_overlap": "block",
    "excessive_religious_decoration_signal": "review",
    "repeated_templated_opening": "review",
    "suspicious_shared_verbatim_span": "review",
    "exact_corpus_duplicate": "block",
    "near_corpus_duplicate": "block",
    **{code: severity for code, severity, _, _ in patterns.ASSISTANT},
}
RANK = {"never": 3, "block": 2, "review": 1}


def well_formed(rows: DataFrame) -> DataFrame:
    """(id, message, role, content): messages with a role and a content, numbered from 0 among themselves."""
    return rows.select("id", F.posexplode(F.filter("messages", lambda m: m["role"].isNotNull() & m["content"].isNotNull())).alias("message", "m")).select("id", "message", "m.role", "m.content")


def worded(rows: DataFrame) -> DataFrame:
    """(id, message, role, w): the words of each well-formed message, once a record. A record's messages are in one partition."""
    spark = rows.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    once = rows.select("id", "messages").repartition(parts, "id").groupBy("id").agg(F.any_value("messages", True).alias("messages"))
    return well_formed(once).select("id", "message", "role", tokens(F.col("content")).alias("w"))


def records(words: DataFrame) -> DataFrame:
    """(id, ms): a record's messages (message, role, w) in order. A table that has them already stays as it is."""
    return words if "ms" in words.columns else words.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("message", "role", "w"))).alias("ms"))  # the messages of one record


def messages(words: DataFrame) -> DataFrame:
    """(id, message, role, w), of messages or of records."""
    return words.select("id", F.explode("ms").alias("m")).select("id", "m.message", "m.role", "m.w") if "ms" in words.columns else words


def unscannable(rows: DataFrame) -> DataFrame:
    """(id): records without any well-formed message; null messages are none."""
    any_ = F.exists("messages", lambda m: m["role"].isNotNull() & m["content"].isNotNull())
    return rows.where(~F.coalesce(any_, F.lit(False))).select("id").distinct()


def pattern_flags(rows: DataFrame, bank=None) -> DataFrame:
    """(id, message, code, severity, category, evidence): the first match of each pattern in each assistant message, and messages with three decorations or more."""
    said = well_formed(spread(rows.select("id", "messages"))).where("role = 'assistant'")
    found = said.select("id", "message", F.xxhash64("content").alias("c"), F.explode(patterns.flags(F.col("content"), bank, 3)).alias("f"))
    return found.select("id", "message", "c", "f.code", "f.severity", "f.category", "f.evidence").distinct().drop("c")  # a message that comes again counts once; only what was found travels


def overlaps(words: DataFrame, references: DataFrame, n: int = 8) -> DataFrame:
    """(id, message, ref, overlap_words, start): the longest run of words of each message that stands in a reference."""
    found = gate.longest_overlaps(messages(words).select(F.struct("id", "message").alias("id"), "w"), references, n)
    return found.select("id.id", "id.message", "ref", "overlap_words", "start")


def openings(words: DataFrame, n: int = 8, least: int = 3) -> DataFrame:
    """(opening, occurrences, records): first words of assistant messages that at least ``least`` records begin with."""
    first = messages(words).where("role = 'assistant'").where(F.size("w") >= n).select("id", F.array_join(F.slice("w", 1, n), " ").alias("opening"))
    return first.groupBy("opening").agg(F.count("*").alias("occurrences"), F.countDistinct("id").alias("records")).where(F.col("records") >= least)


def opening_flags(words: DataFrame, n: int = 8, least: int = 3) -> DataFrame:
    """(id, message, evidence, occurrences): every occurrence of a repeated opening."""
    first = messages(words).where("role = 'assistant'").where(F.size("w") >= n).select("id", "message", F.array_join(F.slice("w", 1, n), " ").alias("opening"))
    return first.join(openings(words, n, least).hint("merge"), "opening").select("id", "message", F.col("opening").alias("evidence"), "occurrences")


def span_sets(words: DataFrame, n: int = 16) -> tuple[DataFrame, DataFrame]:
    """(places, sets): where each n-word span first stands in a record, and one span for each set of places of at least two records.

    places (id, message, g), of spans that several records have, and sets (g, span, records, places, first_id, last_id). Sets are told apart by their
    count, ends and the sum of their hashes; the span that stands for a set is the least. Spans travel once, as hashes, and words are fetched for shared ones only.
    """
    posts = messages(words).where(F.size("w") >= n).select("id", "message", F.explode(let(ngram_hashes(F.col("w"), n), F.array_distinct)).alias("g"))
    alone = Window.partitionBy("g")
    several = posts.withColumn("same", F.min("id").over(alone) == F.max("id").over(alone)).where("NOT same")
    places = stored(several.groupBy("id", "g").agg(F.min("message").alias("message")).select("id", "message", "g"))  # a span counts where it first stands
    at = F.struct("id", "message")
    sets = places.groupBy("g").agg(F.count("*").alias("records"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.min(at).alias("x"), F.sum(F.xxhash64("id", "message").cast("decimal(20,0)")).alias("s"))
    spelled = gate.spell(messages(words).select(F.struct("id", "message").alias("id"), "w"), sets, n, "x")
    least = spelled.groupBy("records", "first_id", "last_id", "x", "s").agg(F.min(F.struct("span", "g")).alias("m"))
    return places, least.select("m.g", "m.span", "records", "first_id", "last_id")


def shared_spans(words: DataFrame, n: int = 16) -> DataFrame:
    """(span, records, first_id, last_id): corpus flags."""
    return span_sets(words, n)[1].select("span", "records", "first_id", "last_id")


def span_flags(words: DataFrame, n: int = 16) -> DataFrame:
    """(id, message, evidence, peers): each place of each reported span, with the number of other records that have it."""
    places, sets = span_sets(words, n)
    return places.join(sets.hint("merge"), "g").select("id", "message", F.col("span").alias("evidence"), (F.col("records") - 1).alias("peers"))


def conversation_words(words: DataFrame) -> DataFrame:
    """(id, w): role and words of all messages but the system's, in order. A record without any has no words."""
    own = records(words).select("id", F.filter("ms", lambda m: m["role"] != "system").alias("ms")).where(F.size("ms") > 0)
    return own.select("id", F.flatten(F.transform("ms", lambda m: F.concat(tokens(m["role"]), m["w"]))).alias("w"))


def exact_duplicates(words: DataFrame) -> DataFrame:
    """(digest, copies, first_id, last_id)."""
    return gate.exact_duplicates(conversation_words(words)).withColumnRenamed("text_sha256", "digest")


def near_duplicates(words: DataFrame, threshold: float = 0.82, cap: int | None = 100) -> DataFrame:
    """(left_id, right_id, similarity)."""
    return gate.near_duplicates(conversation_words(words), threshold, cap=cap)


def flags(rows: DataFrame, references: DataFrame, eval_overlap_words: int = 8, verbatim_span_words: int = 16, opening_words: int = 8, opening_repeat_min: int = 3, near_duplicate_threshold: float = 0.82) -> DataFrame:
    """(id, code, severity, message, evidence): all flags of all records; one of a whole record has no message."""
    if min(eval_overlap_words, verbatim_span_words, opening_words) < 3 or opening_repeat_min < 2 or not 0 < near_duplicate_threshold <= 1:
        raise ValueError("words from 3, repeats from 2, a threshold above 0 and at most 1")
    none = F.lit(None).cast("int")
    words = stored(records(worded(rows)))

    def kept(code: str, df: DataFrame) -> DataFrame:
        """One kind after the other: all at once are a plan of many stages in the driver, and their shuffles stay on disk until the last ends."""
        return stored(df.select("id", F.lit(code).alias("code"), F.lit(SEVERITY[code]).alias("severity"), "message", "evidence"))

    parts = [
        kept("suspicious_shared_verbatim_span", span_flags(words, verbatim_span_words)),  # it shuffles most, so it runs while little else is stored
        kept("heldout_eval_phrase_overlap", overlaps(words, references, eval_overlap_words).select("id", "message", F.col("ref").alias("evidence"))),
        kept("repeated_templated_opening", opening_flags(words, opening_words, opening_repeat_min)),
    ]
    whole = stored(gate.marked(conversation_words(words)))
    digest = whole.where(F.size("w") > 0).select("id", F.sha2(F.array_join("w", " "), 256).alias("text_sha256"))
    copies = digest.join(gate.exact_duplicates(whole).select("text_sha256").hint("merge"), "text_sha256", "left_semi").select("id", F.col("text_sha256").alias("evidence"))
    near = gate.near_duplicates(whole, near_duplicate_threshold).select("left_id", "right_id", F.concat(F.lit("5-gram Jaccard="), F.format_string("%.3f", "similarity")).alias("evidence"))
    parts += [
        kept("exact_corpus_duplicate", copies.withColumn("message", none)),
        kept("near_corpus_duplicate", near.select(F.explode(F.array("left_id", "right_id")).alias("id"), none.alias("message"), "evidence")),
        kept("unscannable_messages", unscannable(rows).select("id", none.alias("message"), F.lit("").alias("evidence"))),
    ]
    return reduce(DataFrame.union, parts, stored(pattern_flags(rows).select("id", "code", "severity", "message", "evidence")))


def decisions(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(id, decision, flags), one row a record."""
    return gate.decisions(rows.select("id").distinct(), found)


def ordered(found: DataFrame) -> DataFrame:
    """``found`` with each flag's place in its record: by code, message (flags of the whole record first) and evidence."""
    return found.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("code", F.asc_nulls_first("message"), "evidence")))


def report(rows: DataFrame, found: DataFrame, fail_on: str = "block") -> DataFrame:
    """(measure, n): records scanned, decisions, flags by code, and ``failed``, which is 1 if a decision is as bad as ``fail_on`` or worse."""
    if fail_on not in RANK:
        raise ValueError(f"fail_on is one of {sorted(RANK)}")
    found = stored(found)
    by = cut(decisions(rows, found).groupBy("decision").agg(F.count("*").alias("n")))
    bad = [d for d in ("review", "block") if RANK[d] >= RANK[fail_on]]
    return (
        by.agg(F.lit("records").alias("measure"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select("measure", "n")
        .union(by.select(F.concat(F.lit("decision:"), "decision"), "n"))
        .union(found.groupBy(F.concat(F.lit("flag:"), "code")).agg(F.count("*")))
        .union(by.agg(F.coalesce(F.max(F.col("decision").isin(bad or [""]).cast("bigint")), F.lit(0)).alias("n")).select(F.lit("failed"), "n"))
    )


def corpus_flags(rows: DataFrame, verbatim_span_words: int = 16, opening_words: int = 8, opening_repeat_min: int = 3, near_duplicate_threshold: float = 0.82) -> DataFrame:
    """(code, severity, first_id, records, evidence): what several records have in common, sorted by code, first record and evidence."""
    words = stored(records(worded(rows)))
    whole = stored(gate.marked(conversation_words(words)))
    opened = opening_flags(words, opening_words, opening_repeat_min).groupBy("evidence").agg(F.min("id").alias("first_id"), F.countDistinct("id").alias("records"))
    near = gate.near_duplicates(whole, near_duplicate_threshold)
    parts = {
        "repeated_templated_opening": opened.select("first_id", "records", "evidence"),
        "suspicious_shared_verbatim_span": shared_spans(words, verbatim_span_words).select("first_id", "records", F.col("span").alias("evidence")),
        "exact_corpus_duplicate": gate.exact_duplicates(whole).select("first_id", F.col("copies").alias("records"), F.col("text_sha256").alias("evidence")),
        "near_corpus_duplicate": near.select(F.col("left_id").alias("first_id"), F.lit(2).cast("bigint").alias("records"), F.concat(F.lit("5-gram Jaccard="), F.format_string("%.3f", "similarity")).alias("evidence")),
    }
    found = [df.select(F.lit(code).alias("code"), F.lit(SEVERITY[code]).alias("severity"), "first_id", "records", "evidence") for code, df in parts.items()]
    return reduce(DataFrame.union, found).orderBy("code", "first_id", "evidence")
