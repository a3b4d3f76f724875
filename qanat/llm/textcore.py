"""One consistent form of text, and words and hashes of whole batches, without a Python step per word."""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np
import pyarrow as pa

from qanat.llm.runtime import mix

# Letters of other scripts that look like Latin ones, and marks that look like ASCII ones.
LOOKALIKES = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Ү": "Y", "Х": "X", "Ԁ": "d", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ӏ": "l", "Ӏ": "I", "ѡ": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "ο": "o", "ν": "v", "ρ": "p", "ϲ": "c", "ϳ": "j",
    "Օ": "O", "Տ": "S", "օ": "o", "հ": "h", "ո": "n", "ս": "u", "ɡ": "g", "ɑ": "a", "ꓳ": "O",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T", "Ⲭ": "X",
    "‐": "-", "‑": "-", "ʼ": "’", "ꞌ": "'", "∶": ":", "∕": "/", "⁄": "/", "∗": "*", "․": ".", "‚": ",", "∣": "|", "ǀ": "|", "܁": ".",
    "۰": "٠", "۱": "١", "۲": "٢", "۳": "٣", "۷": "٧", "۸": "٨", "۹": "٩",
}
#: Characters without any ink, or only a direction.
INVISIBLE = [0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0x206A, 0x2070), 0x115F, 0x1160, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), 0xFEFF, *range(0xFFF9, 0xFFFC)]
#: Kinds of Unicode decompositions whose form differs from the normal one in type face, width, joining or breaking only. Raised,
#: lowered, circled and squared forms and fractions look otherwise and stay apart.
KINDS = ("<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>", "<wide>", "<narrow>", "<small>")
#: Other forms that look like what they stand for: signs, spaces, ellipses, Roman numerals, numbers in brackets and ligatures.
COMPATIBLE = [(0xB5, 0xB5), (0x2000, 0x200A), (0x2024, 0x2026), (0x205F, 0x205F), (0x2126, 0x2126), (0x212A, 0x212B), (0x2160, 0x217F), (0x2474, 0x249B), (0xFB00, 0xFB06)]
#: Arabic letters spelled with another code point that has the same joined shape.
ARABIC_JOINING = "[ئبتثجحخسشصضطظعغفقكلمنهيـآأؤإابةتدذرزوىکگچپہھےٹڈڑں]"


@functools.cache
def _tables() -> tuple[dict[str, str], dict[str, str]]:
    """Characters that become one other character, and characters that become several."""
    one: dict[str, str] = {}
    many: dict[str, str] = {}
    listed = [c for low, high in COMPATIBLE for c in map(chr, range(low, high + 1))]
    for c in [*listed, *(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.decomposition(c).startswith(KINDS))]:
        if ord(c) not in INVISIBLE and (to := unicodedata.normalize("NFKC", c)) != c:
            (one if len(to) == 1 else many)[c] = LOOKALIKES.get(to, to)
    one |= LOOKALIKES
    for c in map(chr, [*range(0x370, 0x530), *range(0x1F00, 0x2000)]):  # letters with accents follow their letter
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and parts[0] in LOOKALIKES and len(to := unicodedata.normalize("NFC", LOOKALIKES[parts[0]] + parts[1:])) == 1:
            one[c] = to
    return one, many


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _class(chars) -> str:
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in sorted(chars)) + "]"


@functools.cache
def form_sql(column: str = "c") -> str:
    """The consistent form as one DuckDB expression; most texts leave it at its first test."""
    one, many = _tables()
    gone = "".join(map(chr, INVISIBLE))
    spread = f"array_to_string(list_transform(regexp_extract_all({column}, '(?s).'), lambda x: coalesce(getvariable('several')[x], x)), '')"
    steps = f"CASE WHEN regexp_matches({column}, {_quoted(_class(many))}) THEN {spread} ELSE {column} END"
    rare = {c: to for c, to in one.items() if unicodedata.decomposition(c).startswith("<font>")}  # texts seldom have these, so most are spared a long table
    usual = {c: to for c, to in one.items() if c not in rare}
    steps = f"translate({steps}, {_quoted(''.join(usual) + gone)}, {_quoted(''.join(usual.values()))})"
    steps = f"CASE WHEN regexp_matches({column}, {_quoted(_class(rare))}) THEN translate({steps}, {_quoted(''.join(rare))}, {_quoted(''.join(rare.values()))}) ELSE {steps} END"
    steps = f"nfc_normalize({steps})"
    # a yeh or kaf of another code point: as the Arabic one where it joins onwards, else as the dotless one
    steps = f"regexp_replace(regexp_replace({steps}, {_quoted('\\x{6cc}(' + ARABIC_JOINING + ')')}, 'ي\\1', 'g'), {_quoted('\\x{6cc}')}, 'ى', 'g')"
    steps = f"regexp_replace({steps}, {_quoted('\\x{6a9}(' + ARABIC_JOINING + ')')}, 'ك\\1', 'g')"
    steps = f"regexp_replace({steps}, {_quoted('\\r\\n?|[\\x{85}\\x{2028}\\x{2029}]')}, chr(10), 'g')"
    touched = "[" + _class({*one, *many})[1:-1] + _class(gone)[1:-1] + "\\p{M}\\r\\x{85}\\x{2028}\\x{2029}\\x{6cc}\\x{6a9}]"
    return f"CASE WHEN regexp_matches({column}, {_quoted(touched)}) THEN {steps} ELSE {column} END"


@functools.cache
def duck():
    """This worker's DuckDB, on one thread: Spark already runs a worker for each core."""
    import duckdb

    con = duckdb.connect(config={"threads": "1"})
    con.execute("SET memory_limit='400MB'")
    many = _tables()[1]
    con.execute(f"SET VARIABLE several = MAP {{{', '.join(f'{_quoted(c)}: {_quoted(to)}' for c, to in many.items())}}}")  # the forms that become several characters
    return con


def duck_map(text: pa.Array, *expressions: str) -> list[pa.Array]:
    """Values of DuckDB ``expressions`` over column c, in the order of ``text``."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if len(text) == 0:
        return [pa.array([], pa.string()) for _ in expressions]
    con = duck()
    con.register("qanat_batch", pa.table({"i": pa.array(range(len(text)), pa.int64()), "c": text.cast(pa.string())}))
    names = [f"e{k}" for k in range(len(expressions))]
    out = con.sql("SELECT i, " + ", ".join(f"{e} AS {n}" for e, n in zip(expressions, names)) + " FROM qanat_batch").to_arrow_table()
    con.unregister("qanat_batch")
    order = out.column("i").to_numpy()
    if len(order) > 1 and not (order[1:] > order[:-1]).all():
        out = out.sort_by("i")
    return [out.column(n).combine_chunks() for n in names]


def consistent_form(text: pa.Array) -> pa.Array:
    """Null stays null and "" stays "". Texts that look alike get equal forms; see ``form_sql``."""
    return duck_map(text, form_sql())[0]


# ------------------------------------------------------------------ words

BORDER = "￿"  # a code point of no character: stands between the texts of a batch
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


@functools.cache
def _kinds() -> np.ndarray:
    """1: a letter or digit; 2: a mark that may stand inside a word; 0: any other."""
    kinds = np.fromiter((chr(c).isalnum() for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    kinds[[0x27, 0x2D, 0x2019]] = 2
    return kinds


class _Powers:
    """Powers of BASE and of its inverse, as far as they were needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", BASE), ("down", BASE_INVERSE)):
                x = np.ones(size, np.uint64)
                x[1:] = base
                np.cumprod(x, out=x)
                setattr(self, name, x)
        return self.up, self.down


POWERS = _Powers()


def range_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each range, from one running sum."""
    up, down = POWERS.to(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every word of texts that have the consistent form.

    Words: NFKC, case folded, ’ as ', then runs of letters and digits that single ' or - may join.
    """
    ready = []
    for x in texts:
        x = x or ""
        if not x.isascii():
            if not unicodedata.is_normalized("NFKC", x):
                x = unicodedata.normalize("NFKC", x)
            if BORDER in x:
                x = x.replace(BORDER, " ")
        ready.append(x)
    whole = (BORDER.join(ready) + BORDER).casefold()
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    points[points == 0x2019] = 0x27
    kinds = _kinds()[points]
    inside = kinds == 1
    joins = np.zeros(len(points), bool)
    joins[1:-1] = (kinds[1:-1] == 2) & inside[:-2] & inside[2:]
    inside |= joins
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))  # the last point is a border, so every word ends
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text = np.searchsorted(np.flatnonzero(points == 0xFFFF), start).astype(np.int32)
    return range_hashes(points, start, end), text


def chunks(sizes, limit: int = 1_500_000):
    """Ranges (from, to) of consecutive items of at most ``limit`` in all; a longer item is one range."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if total + n > limit and i > begin:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


SHINGLE = 5
_WEIGHTS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every n consecutive values of ``h``."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    if n <= 8:
        x = np.zeros(m, np.uint64)
        for k in range(n):
            x += h[k : k + m] * _WEIGHTS[k]
        return mix(x)
    up, down = POWERS.to(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[:m])


def shingles(h: np.ndarray, text: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of each n consecutive words of one text, repeats included."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    own = text[: len(h) - n + 1] == text[n - 1 :]
    return window_hashes(h, n)[own], text[: len(own)][own]


def set_of(word_hashes: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingles of one text's words."""
    return np.unique(window_hashes(word_hashes, n))


def rolling_least(g: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        g = np.minimum(g[: max(0, len(g) - step)], g[step:])
        have += step
    return g


def least_runs(h: np.ndarray, of: np.ndarray, run: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of each run of ``run`` words that has the least hash in some ``width`` words of one text; equal widths have equal ones."""
    if len(h) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g, spread = window_hashes(h, run), width - run + 1
    low = rolling_least(g, spread)
    low = np.where(of[: len(low)] == of[width - 1 :], low, np.uint64(0))
    edge = np.zeros(spread - 1, np.uint64)
    most = ~rolling_least(~np.concatenate([edge, low, edge]), spread)  # of a run: the largest least hash of the widths it is in
    at = np.flatnonzero((g == most[: len(g)]) & (g != 0))
    return at, g[at]
