"""Where results go, and the manifest that tells what went there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a report at most.
REPORT = 10_000


def csv(df: DataFrame, path: str) -> None:
    """CSV with a header; no rows write nothing; an existing path is refused."""
    if df.isEmpty():
        return
    df.write.mode("errorifexists").option("header", True).csv(path)


def routed(df: DataFrame, path: str, by: list[str], mode: str = "errorifexists") -> None:
    """One folder per value of ``by``: accepted and rejected, or corpus role and split, in one pass."""
    df.write.mode(mode).partitionBy(*by).parquet(path)


def report(df: DataFrame, path: str) -> None:
    """A report of a few rows as one canonical JSON document: keys sorted, two blanks of indent, other scripts as they are; refuses an existing path."""
    import json

    spark = df.sparkSession
    rows = [json.loads(r) for r in df.toJSON().take(REPORT + 1)]
    if len(rows) > REPORT:
        raise ValueError(f"a report has at most {REPORT} rows; write larger results as JSON lines")
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, False)
    out.write(bytearray((json.dumps(rows, sort_keys=True, indent=2, ensure_ascii=False) + "\n").encode()))
    out.close()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file below ``path``, hashed where it is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def over_limit(manifest: DataFrame, per_file: int = 20 << 20, in_all: int = 50 << 20) -> DataFrame:
    """(path, bytes, reason): files that are too large, and the sum if it is."""
    large = manifest.where(F.col("bytes") > per_file).select("path", "bytes", F.lit("file too large").alias("reason"))
    total = manifest.agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") > in_all).select(F.lit("(all)").alias("path"), "bytes", F.lit("release too large").alias("reason"))
    return large.union(total)


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, bytes, unsafe): members of ZIP files, read on the executors; unsafe if a member would leave its folder."""

    def run(batches):
        import io
        import zipfile

        import pyarrow as pa

        for b in batches:
            out = []
            for p, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                for m in zipfile.ZipFile(io.BytesIO(content)).infolist():
                    out.append((p, m.filename, m.file_size, m.filename.startswith("/") or ".." in m.filename.replace("\\", "/").split("/")))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.bool_()))], ["archive", "member", "bytes", "unsafe"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, member string, bytes bigint, unsafe boolean")


def links(texts: DataFrame) -> DataFrame:
    """(id, target): local targets of Markdown links in (id, text), without anchors."""
    found = texts.select("id", F.explode(F.regexp_extract_all("text", F.lit(r"\[[^\]]*\]\(([^)\s]+)\)"), F.lit(1))).alias("target"))
    local = found.where(~F.col("target").rlike("^(?:[a-z][a-z0-9+.-]*:|#)"))
    return local.select("id", F.url_decode(F.regexp_replace("target", "[#?].*$", "")).alias("target"))
