"""JSON lines read with their line numbers, tolerant or strict, and written whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, raw): the physical lines of each file from 1, blank ones too.

    Files are read in splits like any other text. A line's number is its place in its split after the lines of the file's earlier splits: these are
    counted in a first pass, which keeps no text, and come as one row a split.
    """
    at = ["file", "split"]
    read = spark.read.option("lineSep", "\n").text(path)
    own = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("seq"), "value")
    counts = own.groupBy(*at).agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # the splits of one file
    starts = counts.select(*at, "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return own.join(starts, at).select("file", (F.col("seq") - F.col("first") + F.col("before") + 1).alias("line"), F.regexp_replace("value", "\r$", "").alias("raw"))


def tolerant(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, errors): (file, line, record) with a null record for a bad line, and (file, line, code) of bad lines. Blank lines are skipped."""
    own = lines(spark, path).where(F.trim("raw") != "")
    parsed = own.withColumn("ok", F.try_parse_json("raw").isNotNull())
    records = parsed.select("file", "line", F.when(F.col("ok"), F.from_json("raw", schema)).alias("record"))
    return records, parsed.where("NOT ok").select("file", "line", F.lit("invalid_json").alias("code"))


def strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed records; the first bad line fails the job."""
    own = lines(spark, path).where(F.trim("raw") != "")
    return own.select(F.from_json("raw", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def with_status(spark: SparkSession, path: str, schema: str, status: str = "success") -> DataFrame:
    return strict(spark, path, schema).where(F.col("status") == status)


def newest(spark: SparkSession, paths: list[str], schema: str, key: str, status: str | None = None) -> DataFrame:
    """Records of several files, a later file's and line's in place of an earlier one's with the same key; with ``status``, only records that have it replace others or count at all."""
    from qanat.operators.audit import latest

    parts = [lines(spark, p).where(F.trim("raw") != "").select(F.lit(i).alias("f"), "line", F.from_json("raw", schema, {"mode": "FAILFAST"}).alias("r")) for i, p in enumerate(paths)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if status is not None:
        out = out.where(F.col("r.status") == status)
    return latest(out.withColumn("k", F.col(f"r.{key}")), ["k"], ["f", "line"], ["r"]).select("r.*")


def checked(rows: DataFrame, key: Column | str, count: int | None = None) -> DataFrame:
    """``rows`` if no two have the same key and, with ``count``, if there are so many; else the job fails. Null keys fail too."""
    key = F.col(key) if isinstance(key, str) else key
    twice = rows.groupBy(key.alias("k")).agg(F.count("*").alias("n")).where("n > 1 OR k IS NULL").limit(1).collect()  # one example
    if twice:
        raise ValueError(f"key given twice or missing: {twice[0].k}")
    if count is not None and (have := rows.count()) != count:
        raise ValueError(f"{have} rows where {count} are due")
    return rows


def pair(spark: SparkSession, first: str, second: str, schema: str, key: str, count: int | None = None) -> DataFrame:
    """The records of two files together, each key once, and so many of them."""
    return checked(strict(spark, first, schema).unionByName(strict(spark, second, schema)), key, count)


def status_ledger(spark: SparkSession, path: str, schema: str, keys: tuple[str, str] = ("source_id", "compiler_assignment_id")) -> DataFrame:
    """Ledger lines with their ``key``: the first of ``keys`` that a line has; each key once."""
    own = strict(spark, path, schema)
    return checked(own.withColumn("key", F.coalesce(*[F.nullif(k, F.lit("")) for k in keys])), "key")


def leaves(spark: SparkSession, path: str, least_words: int = 5) -> DataFrame:
    """(source, pointer, text): the strings of JSON files of any shape, with their place, if they have enough words; keys in order."""
    from pyspark.sql.functions import udtf

    from qanat.functions.text import tokens

    @udtf(returnType="pointer: string, text: string")
    class Walk:
        def eval(self, raw: str):
            import json

            todo = [("", json.loads(raw))]
            while todo:
                at, x = todo.pop()
                if isinstance(x, str):
                    yield at or "/", x
                elif isinstance(x, list):
                    todo += [(f"{at}/{i}", y) for i, y in reversed(list(enumerate(x)))]
                elif isinstance(x, dict):
                    todo += [(f"{at}/{k}", x[k]) for k in sorted(x, reverse=True)]

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), "value")
    walked = files.lateralJoin(Walk(F.col("value").outer()))
    return walked.select("source", "pointer", "text").where(F.size(tokens(F.col("text"))) >= least_words)


def write(df: DataFrame, path: str, keep_existing: bool = True) -> None:
    """One JSON object a line with sorted keys; refuses an existing path unless told to replace it."""
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists" if keep_existing else "overwrite").text(path)


def append(df: DataFrame, path: str) -> None:
    """JSON lines with sorted keys beside those that are there; a failed job adds nothing."""
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)
