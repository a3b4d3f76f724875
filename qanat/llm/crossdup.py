"""Problem 3: records of evaluation splits that stand, exactly or almost, in the training split."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qanat.llm.overlap import at_least, batches, distinct, tangled, text_ids, texts, with_words
from qanat.llm.runtime import cut, maybe_in, membership_filter
from qanat.llm.textcore import SHINGLE, least_runs, mix, rolling_least, set_of, shingles, window_hashes

#: Words of a segment, and of the run in it with the least hash, by which it is found.
RUNS = {8: 5, 12: 8, 16: 10}
#: Shingles from which on every text has the longest segments.
MOST = 1 << 12


def distinct_rows(key: np.ndarray, small: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, small, text), sorted by text."""
    order = np.lexsort((key, small, text))
    key, small, text = key[order], small[order], text[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (small[1:] != small[:-1]) | (text[1:] != text[:-1])
    return key[first], small[first], text[first]


def banded_distance(x: np.ndarray, y: np.ndarray, most: int) -> int | None:
    """Edit distance of two word sequences if it is at most ``most``, else None.

    Dynamic programming over the diagonals within ``most`` of the main one: for each number of edits the furthest
    row that each diagonal reaches.
    """
    n, m = len(x), len(y)
    if abs(n - m) > most:
        return None

    def slide(i: int, d: int) -> int:
        j, left = i + d, min(n - i, m - i - d)
        size = 16
        while left > 0:
            k = min(size, left)
            differ = np.flatnonzero(x[i : i + k] != y[j : j + k])
            if len(differ):
                return i + int(differ[0])
            i, j, left, size = i + k, j + k, left - k, size * 4
        return i

    reach = {0: slide(0, 0)}
    for e in range(most + 1):
        if reach.get(m - n, -1) >= n:
            return e
        new = {}
        for d in range(-e - 1, e + 2):
            best = -1
            if d in reach:
                best = reach[d] + 1  # a word replaced
            if d + 1 in reach:
                best = max(best, reach[d + 1] + 1)  # a word of x dropped
            if d - 1 in reach:
                best = max(best, reach[d - 1])  # a word of y added
            best = min(best, n, m - d)
            if best >= 0 and best + d >= 0:
                new[d] = slide(best, d)
        reach = new
    return None


def most_edits(n: np.ndarray, t: float) -> np.ndarray:
    """Segments of an evaluation text of n shingles that a training text at share t can lack.

    An edit, or an edge of a moved or replaced passage, leaves at least four of each text's shingles without a partner, and the two leave
    n (1 - t) / t in all without one at most; half as many edits again are allowed for, and a cut at either end of the text.
    """
    return np.floor(1.5 * n * (1 - t) / (8 * t)).astype(np.int64) + 2


def segment_words(n: np.ndarray, t: float) -> np.ndarray:
    """Words of a segment: the largest length that still cuts n + 4 words into one segment more than edits can touch; 0 if there is none."""
    out = np.zeros(len(n), np.int64)
    for width in RUNS:
        out = np.where((n + SHINGLE - 1) // width > most_edits(n, t), width, out)
    return out


def training_widths(t: float) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """By number of shingles up to MOST: may a partner be cut into shingles, and into segments of each width."""
    n = np.arange(MOST + 1)
    own = segment_words(n, t)
    low, high = np.ceil(n * t - 1e-9).astype(np.int64), np.minimum(MOST, np.floor(n / t + 1e-9).astype(np.int64))
    any_ = lambda hit: (c := np.append(0, np.cumsum(hit)))[high + 1] - c[np.minimum(low, high + 1)] > 0
    return any_(own == 0), {width: any_(own == width) for width in RUNS}


def key_of(g: np.ndarray, width: int) -> np.ndarray:
    """Runs of segments of different widths never meet."""
    return mix(g ^ np.uint64(width * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)).view(np.int64)


def evaluation_keys(h: np.ndarray, of: np.ndarray, s: np.ndarray, own: np.ndarray, n: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, text number, is a shingle) of a batch of evaluation texts: the least run of each of their even segments.

    Texts too short for segments are cut into their shingles, and so are tangled ones (see ``overlap``), besides.
    """
    count, width = len(n), segment_words(n, t)
    start = np.searchsorted(of, np.arange(count + 1))
    keys, texts_ = [], []
    for w, run in RUNS.items():
        which = np.flatnonzero(width == w)
        pieces = (start[which + 1] - start[which]) // w
        if not pieces.sum():
            continue
        text = np.repeat(which, pieces)
        at = start[text] + w * (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        keys.append(key_of(rolling_least(window_hashes(h, run), w - run + 1)[at], w))
        texts_.append(text)
    whole = ((width == 0) | tangled(h, of, n))[own]
    small = [np.zeros(sum(map(len, keys)), bool), np.ones(int(whole.sum()), bool)]
    return np.concatenate([*keys, key_of(s[whole], SHINGLE)]), np.concatenate([*texts_, own[whole]]).astype(np.int64), np.concatenate(small)


def training_keys(h: np.ndarray, of: np.ndarray, s: np.ndarray, own: np.ndarray, n: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """(key, text number): the least runs of all substrings of a training text that an evaluation text of fitting size may have as a segment."""
    shingled, widths = training_widths(t)
    size = np.minimum(n, MOST)
    keys, texts_ = [], []
    for w, run in RUNS.items():
        need = widths[w][size][of]
        at, g = least_runs(h[need], of[need], run, w)
        keys.append(key_of(g, w))
        texts_.append(of[need][at])
    whole = (shingled[size] | tangled(h, of, n))[own]
    return np.concatenate([*keys, key_of(s[whole], SHINGLE)]), np.concatenate([*texts_, own[whole]]).astype(np.int64)


def lists(keys: np.ndarray, own: np.ndarray, count: int, kind=None) -> pa.Array:
    """Values by text number, which must ascend."""
    offsets = pa.array(np.searchsorted(own, np.arange(count + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(keys, kind))


HEAD = "row_id bigint, split string, source_family string, text_id bigint, n bigint"


def cross_candidates(rows: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(records, pairs): records (row_id, split, source_family, text_id, n), and pairs (a, b) of an evaluation and a training text, a < b.

    A text with S segments of which edits touch k at most shares c = S - k with its partner. Segments that no training text has are
    touched; with m left, the partner has one of the m - c + 1 that the fewest training texts have. c / 2 more are taken and so many
    more asked for. A segment's place is not bounded: a passage may have moved.
    """
    held, train = rows.where("split IN ('validation', 'test')"), rows.where("split = 'train'")

    def cut_up(source):
        for b in source:
            for part, h, of in batches(b):
                count = part.num_rows
                s, own = distinct(*shingles(h, of))
                n = np.bincount(own, minlength=count)
                key, text, small = evaluation_keys(h, of, s, own, n, threshold)
                key, small, text = distinct_rows(key, small, text)
                fields = [lists(key, text, count), lists(small, text, count)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row_id", "split", "source_family")), pa.array(text_ids(h, of, count)), pa.array(n), *fields], ["row_id", "split", "source_family", "text_id", "n", "keys", "small"])

    names = ["row_id", "split", "source_family", "text_id", "n"]
    cut_texts = cut(texts(held, False, "split", "source_family").mapInArrow(cut_up, f"{HEAD}, keys array<bigint>, small array<boolean>"))
    segments = cut_texts.select("text_id", "n", F.explode(F.arrays_zip("keys", "small")).alias("k")).select(F.col("text_id").alias("e"), F.col("n").alias("n_e"), F.col("k.keys").alias("key"), F.col("k.small").alias("small")).distinct()
    segments = cut(segments)
    packed = membership_filter(segments.select("key"))

    def match(source):
        for b in source:
            for part, h, of in batches(b):
                count = part.num_rows
                s, own = distinct(*shingles(h, of))
                n = np.bincount(own, minlength=count)
                key, text = training_keys(h, of, s, own, n, threshold)
                there = maybe_in(packed.value, key)
                key, text = distinct(key[there], text[there])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row_id", "split", "source_family")), pa.array(text_ids(h, of, count)), pa.array(n), lists(key, text, count)], [*names, "keys"])

    matched = cut(texts(train, False, "split", "source_family").mapInArrow(match, f"{HEAD}, keys array<bigint>"))
    places = matched.select(F.explode("keys").alias("key"), F.col("text_id").alias("x"), F.col("n").alias("n_x")).distinct()
    own = Window.partitionBy("e", "small")  # the segments of one text
    edits = F.when(F.col("small"), F.col("n_e") - F.ceil(F.col("n_e") * F.lit(threshold) - F.lit(1e-9))).otherwise(F.floor(F.lit(1.5 * (1 - threshold) / (8 * threshold)) * F.col("n_e")) + 2)
    counted = segments.join(segments.groupBy("e", "small").agg(F.count("*").alias("s")), ["e", "small"]).withColumn("c", F.greatest(F.lit(1), F.col("s") - edits))
    known = counted.join(places.groupBy("key").agg(F.count("*").alias("df")), "key")
    known = known.withColumn("m", F.count("*").over(own)).withColumn("r", F.row_number().over(own.orderBy("df", "key"))).withColumn("more", F.floor(F.col("c") / 2))
    chosen = known.where("r <= m - c + 1 + more AND m >= c").select("key", "e", "n_e", "small", F.greatest(F.lit(1), F.expr("c - m + least(m, m - c + 1 + more)")).alias("need"))
    fits = F.expr(f"e <> x AND least(n_e, n_x) >= {threshold} * greatest(n_e, n_x) - 1e-9")
    met = chosen.join(places, "key").where(fits).groupBy("e", "x", "small").agg(F.count("*").alias("common"), F.max("need").alias("need")).where("common >= need")
    records = cut(cut_texts.select(names).union(matched.select(names)).dropDuplicates(["row_id"]))
    return records, cut(met.select(F.least("e", "x").alias("a"), F.greatest("e", "x").alias("b")).distinct())


def decide(x: np.ndarray, y: np.ndarray, threshold: float, band: int) -> tuple[float | None, int | None] | None:
    """(share, edits) of two word sequences whose share is at least ``threshold``, else None.

    Banded dynamic programming comes first: an edit breaks at most five shingles of either text, so few enough of them prove the
    share without measuring it (share None). Only pairs that need more edits than the band or the proof allows, such as those with
    a moved passage, are measured on their shingles.
    """
    p, q = set_of(x), set_of(y)
    low, high = min(len(p), len(q)), max(len(p), len(q))
    most = min(band, int((low - threshold * high) / (5 * (1 + threshold)) + 1e-9)) if low else -1  # edits that still prove the share
    edits = banded_distance(x, y, most) if most >= 0 else None
    if edits is not None:
        return None, edits
    both = len(np.intersect1d(p, q, assume_unique=True))
    return (both / (len(p) + len(q) - both), None) if at_least(both, len(p) + len(q) - both, threshold) else None


def cross_texts(rows: DataFrame, threshold: float = 0.8, band: int = 24) -> tuple[DataFrame, DataFrame]:
    """(records, pairs): records (row_id, split, source_family, text_id, n) and pairs (a, b, share, edits) of different texts.

    Evaluation texts are cut into more segments than the edits that the threshold allows can touch, training substrings are matched
    with them (``cross_candidates``), and banded dynamic programming over words verifies (``decide``): ``edits`` is the edit
    distance where it proves the share, and ``share`` the measured one where the exact share had to decide. Copies on either side are one text.
    """
    rows = rows.select("row_id", "split", "messages", F.col("provenance.source_family").alias("source_family"))
    records, likely = cross_candidates(rows, threshold)

    def verify(source):
        for b in source:
            out = []
            for p, q, x, y in zip(*(b.column(c).to_pylist() for c in ("a", "b", "words_a", "words_b"))):
                found = decide(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), threshold, band)
                if found:
                    out.append((p, q, *found))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int32()))], ["a", "b", "share", "edits"])

    rows = rows.where("split IN ('train', 'validation', 'test')")
    return records, with_words(likely, rows, records, False).mapInArrow(verify, "a bigint, b bigint, share double, edits int")


def cross_pairs(rows: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(row_id_a, row_id_b, eval_row_id, train_row_id, split, source_family, share, edits), smaller row_id first.

    Every pair of one training and one validation or test record whose shared share is at least ``threshold``;
    ``split`` and ``source_family`` are the evaluation record's; ``share`` and ``edits`` as in ``cross_texts``. Rows without a split are on neither side. Records
    without shingles (under five words) have no share.
    """
    records, pairs = cross_texts(rows, threshold)
    has = records.where("n > 0")
    train = has.where("split = 'train'").select(F.col("row_id").alias("train_row_id"), F.col("text_id").alias("x"))
    held = has.where("split <> 'train'").select(F.col("row_id").alias("eval_row_id"), F.col("text_id").alias("y"), "split", "source_family")
    pairs = cut(pairs)
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "share", "edits").union(pairs.select("b", "a", "share", "edits"))
    near = both.join(held, "y").join(train, "x")
    same = held.join(train, F.col("x") == F.col("y")).withColumn("share", F.lit(1.0)).withColumn("edits", F.lit(0))
    names = ["eval_row_id", "train_row_id", "split", "source_family", "share", "edits"]
    return near.select(names).union(same.select(names)).select(F.least("eval_row_id", "train_row_id").alias("row_id_a"), F.greatest("eval_row_id", "train_row_id").alias("row_id_b"), *names)


def cross_counts(rows: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(split, source_family, pairs, eval_records, train_records) of ``cross_pairs``; a missing source stays null."""
    return cross_pairs(rows, threshold).groupBy("split", "source_family").agg(F.count("*").alias("pairs"), F.countDistinct("eval_row_id").alias("eval_records"), F.countDistinct("train_row_id").alias("train_records"))
