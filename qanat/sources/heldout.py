"""Held-out manifests: pinned files, their ids and the hashes of their texts."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qanat.functions.text import stripped_lines

MANIFEST = "ids array<string>, content_hashes array<string>, sources array<struct<namespace:string, repo_relative_path:string, file_sha256:string, id_field:string, include_raw_string_ids:boolean, text_paths:array<string>>>"


def extract(value, path: str) -> list:
    """Values at a path such as ``turns[].user`` in parsed JSON; places that are missing give nothing."""
    found = [value]
    for part in path.split("."):
        name, several = part.removesuffix("[]"), part.endswith("[]")
        found = [x[name] for x in found if isinstance(x, dict) and name in x]
        if several:
            found = [y for x in found if isinstance(x, list) for y in x]
    return found


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that exist, on whatever file system they name."""
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    at = {p: jvm.org.apache.hadoop.fs.Path(p) for p in paths}
    return [p for p in paths if at[p].getFileSystem(conf).exists(at[p])]


def references(spark: SparkSession, manifest: str, root: str) -> list[str]:
    """The source files that a manifest names and that exist."""
    m = spark.read.option("multiLine", True).schema(MANIFEST).json(manifest)
    named = m.select(F.explode("sources.repo_relative_path").alias("p")).where("trim(p) <> ''").distinct().collect()  # the sources of one manifest
    return existing(spark, sorted(f"{root.rstrip('/')}/{r.p}" for r in named))


def load(spark: SparkSession, manifest: str, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ids, hashes, issues): (id), (sha256) and (code, detail).

    Ids and hashes of the manifest itself, and of every source whose file has the pinned hash: ``namespace:id``, raw ids if
    asked for, and the hash of each text at its paths, in NFC and with line ends and white space made even. Files are read on the executors, one each.
    """
    m = spark.read.option("multiLine", True).schema(MANIFEST).json(manifest)
    good = F.col("h").rlike("^[a-f0-9]{64}$")
    own = m.select(F.explode("content_hashes").alias("h"))
    sources = m.select(F.explode("sources").alias("s")).select("s.*")

    def read(batches):
        import json

        import pyarrow as pa

        for b in batches:
            out = []
            for s in b.to_pylist():
                path, space = (s["repo_relative_path"] or "").strip(), (s["namespace"] or "").strip()
                if not path or not space:
                    out.append(("issue", "heldout_manifest_invalid_source", path))
                    continue
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        raw = f.read()
                except OSError:
                    out.append(("issue", "heldout_source_missing", path))
                    continue
                if hashlib.sha256(raw).hexdigest() != s["file_sha256"]:
                    out.append(("issue", "heldout_source_hash_mismatch", path))
                    continue
                try:
                    rows = json.loads(raw)
                except ValueError:
                    out.append(("issue", "heldout_source_invalid_json", path))
                    continue
                for row in rows if isinstance(rows, list) else [rows]:
                    if isinstance(row, dict):
                        x = row.get(s["id_field"] or "id")
                        if x is not None:
                            out.append(("id", f"{space}:{x}", None))
                            if s["include_raw_string_ids"] and isinstance(x, str):
                                out.append(("id", x, None))
                        out += [("text", t, None) for p in s["text_paths"] or [] for t in extract(row, p) if isinstance(t, str)]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.string()) for k in range(3)], ["kind", "value", "detail"])

    found = sources.mapInArrow(read, "kind string, value string, detail string")
    ids = m.select(F.explode("ids").alias("id")).union(found.where("kind = 'id'").select("value")).distinct()
    texts = found.where("kind = 'text'").select(stripped_lines(F.col("value")).alias("t")).where("t <> ''").select(F.sha2("t", 256).alias("sha256"))
    hashes = own.where(good).select(F.col("h").alias("sha256")).union(texts).distinct()
    issues = found.where("kind = 'issue'").select(F.col("value").alias("code"), "detail").union(own.where(~F.coalesce(good, F.lit(False))).select(F.lit("heldout_manifest_invalid_hash"), F.col("h")))
    return ids, hashes, issues


def allowlist(spark: SparkSession, path: str) -> DataFrame:
    """(path): lines of an allowlist without blanks and comments; a line given twice fails."""
    lines = spark.read.text(path).select(F.trim("value").alias("path")).where("path <> '' AND NOT startswith(path, '#')")
    return lines.groupBy("path").agg(F.count("*").alias("n")).select(F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("given twice: "), "path"))).otherwise(F.col("path")).alias("path"))
