"""Where queries and the SQL that checks them are kept together."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WORDS_SQL = r"regexp_extract_all(replace(replace(replace(lower({0}), 'ß', 'ss'), 'ς', 'σ'), '’', ''''), '[\p{{L}}\p{{N}}]+(?:[''’\-][\p{{L}}\p{{N}}]+)*')"


@functools.cache
def _forms() -> tuple[str, str, list[tuple[str, str]]]:
    forms = {c: unicodedata.normalize("NFKC", c) for c in map(chr, [*range(0xA0, 0x3400), *range(0xFB00, 0xFFF0)]) if unicodedata.decomposition(c).startswith("<")}
    one = {c: to for c, to in forms.items() if len(to) == 1}
    quoted = lambda x: x.replace("'", "''")
    return quoted("".join(one)), quoted("".join(one.values())), [(c, to) for c, to in forms.items() if 0xFB00 <= ord(c) <= 0xFB06 or ord(c) >= 0xFEF5 and len(to) > 1]


def nfkc_sql(column: str) -> str:
    """Compatibility form in DuckDB, which only composes: single characters and the usual ligatures are replaced before."""
    froms, tos, several = _forms()
    out = f"translate({column}, '{froms}', '{tos}')"
    for c, to in several:
        out = f"replace({out}, '{c}', '{to}')"
    return f"nfc_normalize({out})"


def words_sql(column: str, form: bool = False) -> str:
    """The word rule in DuckDB, for text in NFKC or, with ``form``, for any."""
    if form:
        column = f"CASE WHEN regexp_full_match({column}, '[\\x00-\\x7f]*') THEN {column} ELSE {nfkc_sql(column)} END"
    return WORDS_SQL.format(column)


class Tables:
    """Tables of one folder, read on demand: ``t.documents``."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")


def query(sql: str | None = None):
    """Registers f(tables) under its name, with DuckDB SQL of the same result where there is any."""

    def keep(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep
