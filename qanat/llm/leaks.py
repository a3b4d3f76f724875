"""Problem 7: held-out texts that stand, wholly or partly, in training messages."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qanat.llm.runtime import spoken
from qanat.llm.textcore import chunks, consistent_form, window_hashes, words

#: Words of a part of the suite (about 60 bytes of tables a word), and parts that one pass over the corpus searches.
PART, PASS = 500_000, 4
#: Hamming radius for equal windows; fingerprints are cut into one part more, of which two within it share one.
RADIUS = 2
#: Words of the windows in which whole texts are searched; a text has those of the largest that fits it.
WIDTHS = (12, 16, 20, 24, 30, 36, 44, 52, 64, 80, 96, 128)


def _add(x: list[np.ndarray], y: list[np.ndarray]) -> list[np.ndarray]:
    """Sum of two numbers per bit, each a list of binary digits (lowest first) packed 64 to a word."""
    out, carry = [], None
    for k in range(max(len(x), len(y))):
        digits = [d for d in (x[k] if k < len(x) else None, y[k] if k < len(y) else None, carry) if d is not None]
        if len(digits) == 1:
            out.append(digits[0])
            carry = None
        elif len(digits) == 2:
            out.append(digits[0] ^ digits[1])
            carry = digits[0] & digits[1]
        else:
            half = digits[0] ^ digits[1]
            out.append(half ^ digits[2])
            carry = (digits[0] & digits[1]) | (half & digits[2])
    return out if carry is None else [*out, carry]


def simhash(h: np.ndarray, n: int) -> np.ndarray:
    """The fingerprint of every n consecutive words: bit k is set if it is set in at least half of the words' hashes."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total, done = None, 0
    planes, width = [h], 1
    while True:
        if n & width:
            part = [p[done : done + m] for p in planes]
            total = part if total is None else _add(total, part)
            done += width
        width *= 2
        if width > n:
            break
        planes = _add([p[: len(p) - width // 2] for p in planes], [p[width // 2 :] for p in planes])
    least = (n + 1) // 2
    above, equal = np.zeros(m, np.uint64), np.full(m, ~np.uint64(0))
    for k in reversed(range(max(len(total), least.bit_length()))):
        digit = total[k] if k < len(total) else np.zeros(m, np.uint64)
        if least >> k & 1:
            equal &= digit
        else:
            above |= equal & digit
            equal &= ~digit
    return above | equal


def block_bits(k: int, radius: int = RADIUS) -> tuple[int, int]:
    """(first bit, number of bits) of part k of a fingerprint."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return cuts[k], cuts[k + 1] - cuts[k]


def radius_for(n: int, least: float) -> int:
    """Bits that may differ: two windows of n words at weighted word-pair similarity ``least`` differ in about m of their words,
    and each bit of their fingerprints with probability arccos(1 - m / n) / pi; one and a half deviations are added, so nine in ten are within it."""
    changed = max(1.0, (n - 1) * (1 - least) / (2 * (1 + least)))
    p = math.acos(1 - min(1.0, changed / n)) / math.pi
    return min(31, math.ceil(64 * p + 1.5 * math.sqrt(64 * p * (1 - p))))


class Suite:
    """Windows of n words of held-out texts, indexed by the parts of their fingerprints. ``ends``: only the first and last window of each text."""

    def __init__(self, keys: list[tuple], texts: list[str | None], n: int, radius: int = RADIUS, ends: bool = False):
        self.n, self.keys, self.radius = n, keys, radius
        self.h, of = words(consistent_form(pa.array(texts, pa.string())).to_pylist())
        own = of[: max(0, len(self.h) - n + 1)] == of[n - 1 :]
        if ends:
            inner = np.ones(len(own), bool)
            inner[np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(own)])] = False
            inner[np.flatnonzero(np.append(of[n:] != of[: max(0, len(of) - n)], True)[: len(own)])] = False
            own &= ~inner
        self.at = np.flatnonzero(own)
        self.print, self.exact, self.of = simhash(self.h, n)[own], window_hashes(self.h, n)[own], of[self.at] if len(self.at) else np.zeros(0, np.int32)
        seen, count = np.unique(window_hashes(self.h, 2), return_counts=True)
        self.pair, self.weight = seen, np.log(1 + len(self.h) / count)
        self.index = []
        for k in range(radius + 1):
            low, bits = block_bits(k, radius)
            part = (self.print >> np.uint64(low)) & np.uint64((1 << bits) - 1)
            order = np.argsort(part, kind="stable")
            there = np.zeros(1 << min(20, bits), bool)  # most windows of a corpus stop at this table
            there[part & np.uint64(len(there) - 1)] = True
            self.index.append((low, bits, part[order], order, there))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item window) of all fingerprints within the radius."""
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for low, bits, parts, order, there in self.index:
            part = (prints >> np.uint64(low)) & np.uint64((1 << bits) - 1)
            at = np.flatnonzero(there[part & np.uint64(len(there) - 1)])
            i, j = np.searchsorted(parts, part[at], "left"), np.searchsorted(parts, part[at], "right")
            c = j - i
            x = np.repeat(at, c)
            y = order[np.repeat(i - (np.cumsum(c) - c), c) + np.arange(c.sum())]
            ok = np.bitwise_count(prints[x] ^ self.print[y]) <= self.radius
            a.append(x[ok])
            b.append(y[ok])
        key = np.unique(np.concatenate(a) * len(self.print) + np.concatenate(b)) if len(self.print) else np.zeros(0, np.int64)
        return (key // len(self.print), key % len(self.print)) if len(self.print) else (key, key)

    def similarity(self, pairs: np.ndarray, item: int) -> float:
        """Weight of the word pairs in both windows divided by that of those in either; a pair the suite lacks weighs as its rarest."""
        x, y = np.unique(pairs), np.unique(window_hashes(self.h[self.at[item] : self.at[item] + self.n], 2))

        def weigh(p):
            at = np.minimum(np.searchsorted(self.pair, p), len(self.pair) - 1)
            return float(np.where(self.pair[at] == p, self.weight[at], self.weight.max()).sum())

        return weigh(np.intersect1d(x, y)) / weigh(np.union1d(x, y))

    def hits(self, h: np.ndarray, of: np.ndarray, least: float) -> set[tuple[int, int]]:
        """(text number, item) of a batch's words."""
        n = self.n
        if len(h) < n or not len(self.print):
            return set()
        own = of[: len(h) - n + 1] == of[n - 1 :]
        at = np.flatnonzero(own)
        x, item = self.near(simhash(h, n)[own])
        start = at[x]
        if least >= 1:
            ok = window_hashes(h, n)[start] == self.exact[item]
        else:
            pairs = window_hashes(h, 2)
            ok = np.array([self.similarity(pairs[s : s + n - 1], k) >= least - 1e-12 for s, k in zip(start, item)], bool)
        return set(zip(of[start[ok]].tolist(), self.of[item[ok]].tolist()))


def suite_texts(scenarios: DataFrame) -> DataFrame:
    """(scenario_id, turn, field, text), turns from 1; null texts give no row."""
    turns = scenarios.select(F.col("id").alias("scenario_id"), F.posexplode("turns").alias("p", "t"))
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"t.{f}").alias("text")) for f in ("user", "expected")])
    return turns.select("scenario_id", (F.col("p") + 1).cast("bigint").alias("turn"), F.explode(fields).alias("f")).select("scenario_id", "turn", "f.field", "f.text").where("text IS NOT NULL AND scenario_id IS NOT NULL")


def _suites(scenarios: DataFrame, n: int, least: float):
    """The parts of the suite, in lists of at most PASS."""
    group, keys, texts, size = [], [], [], 0

    def made():
        if least >= 1:
            return [Suite(keys, texts, n)]
        sizes = np.bincount(words(consistent_form(pa.array(texts, pa.string())).to_pylist())[1], minlength=len(texts))
        fits = np.searchsorted([w for w in WIDTHS if w >= n], sizes, "right")
        out = []
        for k, w in enumerate([w for w in WIDTHS if w >= n], 1):
            which = np.flatnonzero(fits == k).tolist()
            if which:
                out.append(Suite([keys[i] for i in which], [texts[i] for i in which], w, radius_for(w, least), True))
        return out

    for r in suite_texts(scenarios).orderBy("scenario_id", "turn", "field").toLocalIterator():
        keys.append((r.scenario_id, r.turn, r.field))
        texts.append(r.text)
        size += len(r.text.split())
        if size >= PART:
            group.append(made())
            keys, texts, size = [], [], 0
            if len(group) == PASS:
                yield [s for part in group for s in part]
                group = []
    group.append(made())
    yield [s for part in group for s in part]


def leaks(rows: DataFrame, scenarios: DataFrame, n: int = 12, least: float = 1.0, split: str | None = "train") -> DataFrame:
    """(row_id, message, scenario_id, turn, field): messages of ``split`` rows that hold a held-out text, or ``n`` consecutive words of one.

    With ``least`` 1 every n-word window of a text is an item: windows of suite and corpus get a SimHash, a multi-index over its parts finds
    all pairs of windows within the Hamming radius, and equality word for word confirms them, so nothing is lost.
    With a smaller ``least`` the items are whole texts (their first and last window of the largest of WIDTHS that fits), the radius follows
    from width and ``least`` (``radius_for``), and a weighted word-pair similarity of at least ``least`` confirms: edited copies are found too, nine in
    ten or more of them (a fingerprint may by chance lie beyond the radius; the tests measure it).
    One row per message and text. Texts or messages under n words hold no window; empty tables give no rows; redelivered rows count once.
    The corpus is read once for each PASS times PART words of the suite.
    """
    spark = rows.sparkSession
    said = spoken(rows.where(F.col("split") == split) if split else rows)
    found = None
    for suites in _suites(scenarios, n, least):
        held = spark.sparkContext.broadcast(suites)

        def run(batches, held=held):
            for b in batches:
                content = b.column("content")
                for i, j in chunks(pc.utf8_length(content).to_numpy(zero_copy_only=False) if len(content) else []):
                    h, of = words(consistent_form(content.slice(i, j - i)).to_pylist())
                    hits = sorted({(m + i, suite.keys[k]) for suite in held.value for m, k in suite.hits(h, of, least)})
                    which = pa.array([m for m, _ in hits], pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column("row_id").take(which), b.column("turn").take(which), *(pa.array([k[c] for _, k in hits], kind) for c, kind in enumerate((pa.string(), pa.int64(), pa.string())))], ["row_id", "message", "scenario_id", "turn", "field"])

        part = said.drop("role").mapInArrow(run, "row_id bigint, message bigint, scenario_id string, turn bigint, field string")
        found = part if found is None else found.union(part)
    return found.distinct()
