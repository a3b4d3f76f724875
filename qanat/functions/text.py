"""Text functions as Spark columns; none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+(?:['’\-][\p{L}\p{N}]+)*"
# White space as Python's str.strip knows it.
BLANK = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"


ICU = "com.ibm.icu."


def _composed(text: Column, compatible: bool) -> Column:
    """ICU ships with the engine, so this stays in the JVM; ASCII text passes unchanged."""
    return F.when(text.rlike(r"[^\x00-\x7f]"), F.reflect(F.lit(ICU + "text.Normalizer"), F.lit("compose"), text, F.lit(compatible))).otherwise(text)


def nfkc(text: Column) -> Column:
    """Compatibility form."""
    return _composed(text, True)


def nfc(text: Column) -> Column:
    """Composed form."""
    return _composed(text, False)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: the optimizer may move a filter below a projection and would else repeat it per element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def folded(text: Column) -> Column:
    """NFKC, full case folding, and ’ as '."""
    form = nfkc(text)
    return F.replace(F.when(form.rlike(r"[^\x00-\x7f]"), F.reflect(F.lit(ICU + "lang.UCharacter"), F.lit("foldCase"), form, F.lit(True))).otherwise(F.lower(form)), F.lit("’"), F.lit("'"))


def tokens(text: Column) -> Column:
    """Words; null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(folded(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def normalized(text: Column) -> Column:
    """The words joined by one space."""
    return F.array_join(tokens(text), " ")


def ngrams(words: Column, n: int) -> Column:
    """Every n consecutive words, joined by a space; empty if there are fewer."""
    none = F.array().cast("array<string>")
    return let(words, lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(none))


def ngram_hashes(words: Column, n: int) -> Column:
    """64-bit hashes of every n consecutive words: a sixth of the shuffle of the words themselves. Each word is hashed once, and a run by the hashes of two runs that cover it, so an n-gram takes log n steps."""
    none = F.array().cast("array<bigint>")
    paired = lambda runs, step: let(runs, lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step))))
    runs, size = F.transform(words, lambda x: F.xxhash64(x)), 1
    while size < n:
        step = min(size, n - size)
        runs, size = paired(runs, step), size + step
    return let(runs, lambda h: F.when(F.size(h) >= n, F.slice(h, 1, F.size(h) - (n - 1))).otherwise(none))


def stripped_lines(text: Column) -> Column:
    """CRLF and CR as LF, NFC, no white space at line ends, none around the whole; case and marks stay."""
    lf = F.regexp_replace(nfc(text), r"\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(lf, rf"(?m){BLANK}+$", ""), rf"^{BLANK}+|{BLANK}+$", "")


def excerpt(text: Column, limit: int = 220) -> Column:
    compact = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), "^ | $", "")
    return F.when(F.length(compact) <= limit, compact).otherwise(F.concat(F.substring(compact, 1, limit - 1), F.lit("…")))


def sentences(text: Column) -> Column:
    """Pieces after . ! ? and white space, or at line feeds; blank ones are dropped."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def ascii_words(text: Column) -> Column:
    """Words of a-z and 0-9 that - and _ may join."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:[-_][a-z0-9]+)*"), F.lit(0))


def space_words(text: Column) -> Column:
    """Number of runs between white space."""
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))


def fenced_json(text: Column) -> Column:
    """The JSON object in a model's answer: what a ``` fence holds, else from the first { to the last }."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[^\n]*\n", ""), r"\n?```\s*$", "")
    return F.coalesce(F.when(F.try_parse_json(inner).isNotNull(), inner), F.nullif(F.regexp_extract(inner, r"(?s)(\{.*\})", 1), F.lit("")))


def valid_url(text: Column) -> Column:
    """An http or https address with a host."""
    return F.coalesce(text.rlike(r"^https?://[^/?#\s]+"), F.lit(False))


def iso_time(text: Column) -> Column:
    """A date and time with a T between, as far as the engine can read it."""
    return F.coalesce(text.contains("T") & F.try_to_timestamp(text).isNotNull(), F.lit(False))
