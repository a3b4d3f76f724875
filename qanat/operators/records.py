"""The contract of JSON records, line by line, and the report of a data set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qanat.functions.hashing import conversation_hash
from qanat.functions.session import cut
from qanat.functions.text import stripped_lines
from qanat.sources import jsonl

MAP = "map<string,string>"


def is_object(text: Column) -> Column:
    return F.coalesce(F.ltrim(text).startswith("{") & F.from_json(text, MAP).isNotNull(), F.lit(False))


def parsed(lines: DataFrame) -> DataFrame:
    """(line, raw, ok, object, fields, messages, said) of (line, raw), blank lines left out: the record's fields as text and its messages, each as text and typed."""
    own = lines.where(F.trim("raw") != "").select("line", "raw", F.try_parse_json("raw").isNotNull().alias("ok"))
    own = own.withColumn("object", F.col("ok") & is_object(F.col("raw"))).withColumn("fields", F.when(F.col("object"), F.from_json("raw", MAP)))
    own = own.withColumn("messages", F.from_json(F.col("fields")["messages"], "array<string>"))
    return own.withColumn("said", F.transform("messages", lambda m: F.from_json(m, "role string, content string")))


def issues(lines: DataFrame, required: list[str], allowed: list[str], version: str, id_pattern: str, reserved_ids: DataFrame | None = None, reserved_hashes: DataFrame | None = None, longest: int = 41) -> DataFrame:
    """(line, record_id, code, detail): what breaks the contract of each line of (line, raw).

    A line that isn't JSON, or no object, has that issue only. Fields are compared as sets; an id is checked against its pattern, and only a well-formed one
    against ``reserved_ids`` (id). Messages must be objects with role and content alone; role order advances from the expected role and passes over
    what is no object. Contents and whole conversations are held against ``reserved_hashes`` (sha256) in NFC with even line ends.
    Ids and conversations that an earlier line has are told with that line.
    """
    own = parsed(lines)
    f = F.col("fields")
    lit = lambda xs: F.array(*[F.lit(x) for x in sorted(xs)])
    missing, unknown = F.array_except(lit(required), F.map_keys(f)), F.array_sort(F.array_except(F.map_keys(f), lit(allowed)))
    issue = lambda code, detail=None: F.struct(F.lit(code).alias("code"), (F.lit(None).cast("string") if detail is None else detail.cast("string")).alias("detail"))
    maybe = lambda c, *x: F.when(F.coalesce(c, F.lit(True)), issue(*x))
    objects = F.transform("messages", lambda m: F.when(is_object(m), F.array_sort(F.map_keys(F.from_json(m, MAP)))))
    good = F.coalesce(f["id"].rlike(f"^(?:{id_pattern})$"), F.lit(False))
    sized = F.coalesce(F.size("messages").between(3, longest), F.lit(False))
    places = F.transform("messages", lambda m, i: F.struct(i.alias("i"), is_object(m).alias("o")))
    # an object's expected role depends on how many objects stand before it
    turn = lambda i: F.size(F.filter(F.slice(places, F.lit(1), i), lambda x: x["o"]))
    want = lambda k: F.when(k == 0, "system").when(k % 2 == 1, "user").otherwise("assistant")
    order = F.exists(places, lambda x: x["o"] & ~F.coalesce(F.get("said", x["i"])["role"] == want(turn(x["i"])), F.lit(False)))
    checks = F.array_compact(
        F.array(
            maybe(~F.col("ok"), "invalid_json"),
            maybe(F.col("ok") & ~F.col("object"), "record_not_object"),
            F.when(F.col("object") & (F.size(missing) > 0), issue("missing_fields", F.array_join(missing, ", "))),
            F.when(F.col("object") & (F.size(unknown) > 0), issue("unknown_fields", F.array_join(unknown, ", "))),
            F.when(F.col("object") & ~f["schema_version"].eqNullSafe(F.lit(version)), issue("schema_version")),
            F.when(F.col("object") & ~good, issue("invalid_id")),
            F.when(F.col("object") & ~sized, issue("invalid_messages")),
            F.when(F.col("object") & sized & F.exists(objects, lambda k: k.isNull()), issue("invalid_message")),
            F.when(F.col("object") & sized & F.exists(objects, lambda k: k.isNotNull() & (k != F.array(F.lit("content"), F.lit("role")))), issue("invalid_message_fields")),
            F.when(F.col("object") & sized & order, issue("invalid_role_sequence")),
        )
    )
    well = F.col("object") & sized & ~F.exists(objects, lambda k: ~F.coalesce(k == F.array(F.lit("content"), F.lit("role")), F.lit(False)))
    wide = cut(own.select("line", F.when(F.col("object"), f["id"]).alias("record_id"), good.alias("good"), "said", checks.alias("checks"), F.when(well, conversation_hash(F.col("said"), stripped_lines)).alias("hash")))
    out = wide.select("line", "record_id", F.explode("checks").alias("x")).select("line", "record_id", "x.code", "x.detail")
    for key, code in (("record_id", "duplicate_id"), ("hash", "duplicate_conversation")):
        # the first line of a key is an aggregate, so a hot key is reduced before it is shuffled
        first = wide.where(f"{key} IS NOT NULL").groupBy(F.col(key).alias("key")).agg(F.min("line").alias("first"), F.count("*").alias("n")).where("n > 1")
        again = wide.join(first, F.col(key) == F.col("key")).where("line > first")
        out = out.union(again.select("line", "record_id", F.lit(code), F.col("first").cast("string")))
    if reserved_ids is not None:
        taken = wide.where("good").join(reserved_ids.select(F.col("id").alias("record_id")).distinct(), "record_id", "left_semi")
        out = out.union(taken.select("line", "record_id", F.lit("heldout_id_match"), F.lit(None).cast("string")))
    if reserved_hashes is not None:
        held = reserved_hashes.select("sha256").distinct()
        said = wide.select("line", "record_id", F.explode("said").alias("m")).select("line", "record_id", F.sha2(stripped_lines(F.col("m.content")), 256).alias("sha256"))
        none = F.lit(None).cast("string")
        out = out.union(said.join(held, "sha256", "left_semi").select("line", "record_id", F.lit("heldout_content_match"), none).distinct())
        out = out.union(wide.join(held, F.col("hash") == F.col("sha256"), "left_semi").select("line", "record_id", F.lit("heldout_conversation_match"), none))
    return out


def report(lines: DataFrame, found: DataFrame) -> DataFrame:
    """(input_lines, parsed_rows, valid_rows, invalid_rows, errors, heldout_matches), one row. A line with any issue is invalid."""
    own = lines.where(F.trim("raw") != "").agg(F.count("*").alias("input_lines"), F.count_if(F.try_parse_json("raw").isNotNull()).alias("parsed_rows"))
    bad = found.agg(F.countDistinct("line").alias("invalid_rows"), F.count("*").alias("errors"), F.count_if(F.col("code").startswith("heldout_")).alias("heldout_matches"))
    both = own.crossJoin(F.broadcast(bad))  # one row each
    return both.select("input_lines", "parsed_rows", F.greatest(F.lit(0), F.col("input_lines") - F.col("invalid_rows")).alias("valid_rows"), "invalid_rows", "errors", "heldout_matches")


def of_file(spark: SparkSession, path: str, required: list[str], allowed: list[str], version: str, id_pattern: str, **more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(issues, report) of a JSON lines file, with the numbers of its lines."""
    own = jsonl.lines(spark, path).select("line", "raw")
    found = cut(issues(own, required, allowed, version, id_pattern, **more))
    return found, report(own, found)
