"""Problem 10: the language of every document and of every line."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qanat.llm.textcore import BORDER, chunks, range_hashes, window_hashes
from qanat.llm.tokens import SPACES

#: Slots of a filter and hash functions; 2**18 bytes hold the n-grams of the samples at any corpus size.
SLOTS, HASHES = 1 << 18, 2
#: Lengths of character n-grams, with the ends of the word as characters, and the weight of each; 0 is the whole word.
GRAMS = {2: 0.5, 3: 1.0, 4: 2.0, 5: 2.5, 0: 6.0}
#: Labelled lines that are fitted, at most, by language.
SAMPLES = 5_000
#: A word is clear if its best language leads the next by this part of all its evidence.
CLEAR = 0.25
WORD_END = 0x1F


def _places(h: np.ndarray) -> list[np.ndarray]:
    return [((h >> np.uint64(20 * k)) % np.uint64(SLOTS)).astype(np.int64) for k in range(HASHES)]


def word_table(texts: list[str | None]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """(all texts in lower case, starts, ends, text numbers) of the runs between white space that have a letter."""
    whole = BORDER.join((x or "").replace(BORDER, " ") for x in texts) + BORDER
    lower = whole.lower() if whole.isascii() else "".join(c if len(c) == 1 else c[0] for c in map(str.lower, whole)) if "İ" in whole else whole.lower()
    points = np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _kinds()[points]
    inside = kinds > 0
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    letters = np.concatenate([[0], np.cumsum(kinds == 2)])
    has = letters[end] > letters[start]
    start, end = start[has], end[has]
    return lower, start, end, np.searchsorted(np.flatnonzero(points == 0xFFFF), start)


_KINDS: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    """0: white space or a border; 1: any other mark; 2: a letter."""
    if not _KINDS:
        import sys

        kinds = np.fromiter((1 + chr(c).isalpha() for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
        kinds[SPACES] = 0
        kinds[[*range(0x1C, 0x20), 0xFFFF]] = 0
        _KINDS.append(kinds)
    return _KINDS[0]


class Filters:
    """One word per slot and hash, a byte for up to eight languages: bit k says that language k has an n-gram there, so one look-up answers for all languages."""

    def __init__(self, samples: list[tuple[str, str]]):
        self.languages = sorted({lang for lang, _ in samples})
        if len(self.languages) > 64:
            raise ValueError("a word holds 64 languages")
        self.kind = np.min_scalar_type((1 << max(1, len(self.languages))) - 1)  # a byte for eight languages
        self.slots = {n: np.zeros((HASHES, SLOTS), self.kind) for n in GRAMS}
        for k, lang in enumerate(self.languages):
            lower, start, end, _ = word_table([x for own, x in samples if own == lang])
            for n, (h, _) in self.grams(self._unique(lower, start, end)).items():
                for row, at in zip(self.slots[n], _places(h)):
                    row[at] |= self.kind.type(1 << k)
        bits = np.arange(len(self.languages), dtype=self.kind)
        #: By length and language: the part of unknown n-grams that the filter takes for known ones.
        self.false = {n: np.prod([((row[:, None] >> bits) & 1).mean(axis=0) for row in rows], axis=0) for n, rows in self.slots.items()}

    @staticmethod
    def _unique(lower: str, start: np.ndarray, end: np.ndarray) -> list[str]:
        return list({lower[i:j] for i, j in zip(start, end)})

    @staticmethod
    def grams(words: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By length: (hash, word number) of every n-gram of words with their marks taken off."""
        joined = "".join(f"\x1f{_bare(w)}\x1f{BORDER}" for w in words)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        border = np.flatnonzero(points == 0xFFFF)
        of = np.searchsorted(border, np.arange(len(points)))
        out = {}
        for n in GRAMS:
            if n:
                h = window_hashes(points.astype(np.uint64), n)
                own = of[: len(h)]
                ok = np.arange(len(h)) + n <= border[own] if len(h) else np.zeros(0, bool)
                out[n] = h[ok], own[ok]
            else:
                start = np.concatenate([[0], border[:-1] + 1]) if len(border) else border
                out[n] = range_hashes(points, start, border), np.arange(len(border))
        return out

    def evidence(self, words: list[str]) -> np.ndarray:
        """By word and language: the weight of the n-grams that the language has, less what false positives alone would give."""
        out = np.zeros((len(words), len(self.languages)))
        bits = np.arange(len(self.languages), dtype=self.kind)
        for n, (h, own) in self.grams(words).items():
            mask = np.full(len(h), np.iinfo(self.kind).max, self.kind)
            for row, at in zip(self.slots[n], _places(h)):
                mask &= row[at]
            total = np.bincount(own, minlength=len(words))[:, None]
            known = np.stack([np.bincount(own, (mask >> b) & 1, minlength=len(words)) for b in bits], axis=1) if len(h) else np.zeros(out.shape)
            out += GRAMS[n] * np.maximum(0, (known - total * self.false[n]) / (1 - self.false[n])) / (np.maximum(1, total) if n else 1)
        return out


def _bare(word: str) -> str:
    """The word from its first to its last letter; quotation marks and digits at its ends say nothing."""
    i, j = 0, len(word)
    while i < j and not (word[i].isalpha() or "ऀ" <= word[i] <= "ॿ"):
        i += 1
    while j > i and not (word[j - 1].isalpha() or "ऀ" <= word[j - 1] <= "ॿ"):
        j -= 1
    return word[i:j]


class Judge:
    """Decides words, lines and documents with the filters; equal words are weighed once per worker."""

    def __init__(self, filters: Filters):
        self.filters = filters
        self.place: dict[int, int] = {}
        self.rows = np.zeros((0, len(filters.languages)))

    def weigh(self, lower: str, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Evidence of each word, as parts of 1; words that no language knows have none."""
        points = np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32)
        keys, first, inverse = np.unique(range_hashes(points, start, end), return_index=True, return_inverse=True)
        if len(self.place) > 1_000_000:  # memory, not results: words are weighed again
            self.place, self.rows = {}, self.rows[:0]
        new = [k for k, key in enumerate(keys.tolist()) if key not in self.place]
        if new:
            got = self.filters.evidence([lower[start[first[k]] : end[first[k]]] for k in new])
            total = got.sum(axis=1, keepdims=True)
            for i, k in enumerate(new):
                self.place[int(keys[k])] = len(self.rows) + i
            self.rows = np.concatenate([self.rows, np.divide(got, total, out=np.zeros_like(got), where=total > 0)])
        return self.rows[[self.place[k] for k in keys.tolist()]][inverse] if len(keys) else self.rows[:0]

    def lines(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words, language or -1, confidence) of each line; see ``voted``."""
        return self.voted(texts)[:3]

    def voted(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(words, language or -1, confidence, words of every language) of each line.

        Clear words vote first. A word that several languages share goes, among the languages that have at least half of its best
        evidence, to the one that leads around it: in the words within three places, then in the line. The line has the language of most of its
        words; its confidence is that language's part of the words that have one.
        """
        lower, start, end, of = word_table(texts)
        e = self.weigh(lower, start, end)
        count = np.bincount(of, minlength=len(texts))
        k = e.shape[1]
        if not len(e):
            return count, np.full(len(texts), -1), np.zeros(len(texts)), np.zeros((len(texts), k))
        best = e.argmax(axis=1)
        top = np.sort(e, axis=1)
        clear = (top[:, -1] - top[:, -2] >= CLEAR) if k > 1 else top[:, -1] > 0
        votes = np.zeros((len(texts), k))
        np.add.at(votes, (of[clear], best[clear]), 1)
        line = votes[of] / np.maximum(1, votes.sum(axis=1))[of][:, None]
        hot = np.zeros_like(e)
        hot[np.flatnonzero(clear), best[clear]] = 1
        around = np.zeros_like(e)
        for step in range(1, 4):
            if len(e) > step:
                same = (of[step:] == of[:-step])[:, None]
                around[step:] += hot[:-step] * same / step
                around[:-step] += hot[step:] * same / step
        open_ = np.where(e >= top[:, -1:] / 2, e, 0) * (0.05 + around + 0.5 * line) + 1e-3 * e
        choice = np.where(clear, best, open_.argmax(axis=1))
        some = top[:, -1] > 0
        votes = np.zeros((len(texts), k))
        np.add.at(votes, (of[some], choice[some]), 1)
        total = votes.sum(axis=1)
        soft = np.zeros((len(texts), k))
        np.add.at(soft, of, e)
        lang = (votes + 1e-6 * soft).argmax(axis=1)
        return count, np.where(total > 0, lang, -1), np.divide(votes[np.arange(len(texts)), lang], total, out=np.zeros(len(texts)), where=total > 0), votes


def fit(samples: DataFrame, most: int = SAMPLES) -> Filters:
    """Filters of labelled clean lines (lang, text), at most ``most`` of each language, the first by hash."""
    from pyspark.sql import Window

    lang = label(F.col("lang"))
    own = samples.where("text IS NOT NULL").select(lang.alias("lang"), "text").where("lang IS NOT NULL")
    w = Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text")
    rows = own.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("lang", "text").orderBy("lang", "text").collect()
    if not rows:
        raise ValueError("no labelled samples")
    return Filters([(r.lang, r.text) for r in rows])


def label(column):
    """The language of a code without region and case; null, blank and und are no label."""
    x = F.lower(F.regexp_extract(F.trim(column), r"^([A-Za-z]+)", 1))
    return F.when((F.length(x) > 0) & (x != "und"), x)


def line_languages(documents: DataFrame, samples: DataFrame) -> DataFrame:
    """(doc_id, line_no, label, words, language, confidence): every non-empty piece between line feeds, counted from 0.

    ``label`` is the document's own, ``words`` the runs between white space with at least one letter. A line none
    of whose words any language knows has a null language and confidence 0. Null and empty texts have no
    lines; a doc_id given twice gives its lines twice.
    """
    return _lines(documents, samples, False)[0]


def _lines(documents: DataFrame, samples: DataFrame, with_votes: bool) -> tuple[DataFrame, list[str]]:
    """(lines, languages): ``line_languages``, if wanted with votes: how many of a line's words each of the languages has."""
    held = documents.sparkSession.sparkContext.broadcast(fit(samples))  # bounded: SLOTS bytes a hash and length

    head = ["doc_id", "line_no", "label", "words", "language", "confidence", *["votes"] * with_votes]

    def run(batches):
        judge = Judge(held.value)
        names = pa.array([*held.value.languages, None], pa.string())
        for b in batches:
            lines = pc.split_pattern(b.column("text"), "\n")
            flat, parent = lines.flatten(), pc.list_parent_indices(lines)
            keep = pc.not_equal(flat, "")
            flat, parent = flat.filter(keep), parent.filter(keep).to_numpy()
            number = np.arange(len(parent)) - np.searchsorted(parent, parent)
            for i, j in chunks(pc.utf8_length(flat).to_numpy(zero_copy_only=False) if len(flat) else []):
                words, lang, sure, votes = judge.voted(flat.slice(i, j - i).to_pylist())
                own = pa.array(parent[i:j])
                out = [b.column("doc_id").take(own), pa.array(number[i:j].astype(np.int64)), b.column("label").take(own), pa.array(words.astype(np.int64)), names.take(pa.array(np.where(lang < 0, len(names) - 1, lang))), pa.array(sure)]
                if with_votes:
                    out.append(pa.ListArray.from_arrays(pa.array(np.arange(len(votes) + 1) * votes.shape[1], pa.int32()), pa.array(votes.astype(np.int64).ravel())))
                yield pa.RecordBatch.from_arrays(out, head)

    docs = documents.where("text IS NOT NULL").select("doc_id", label(F.col("lang")).alias("label"), "text")
    return docs.mapInArrow(run, "doc_id bigint, line_no bigint, label string, words bigint, language string, confidence double" + ", votes array<bigint>" * with_votes), held.value.languages


def wrong_lines(documents: DataFrame, samples: DataFrame, least_words: int = 5) -> DataFrame:
    """(doc_id, line_no, language): lines of at least ``least_words`` words whose language isn't the document's label, or whose document has none."""
    lines = line_languages(documents, samples).where(F.col("words") >= least_words).where("language IS NOT NULL AND (label IS NULL OR label <> language)")
    return lines.select("doc_id", "line_no", "language")


def document_languages(documents: DataFrame, samples: DataFrame) -> DataFrame:
    """(doc_id, label, language, confidence, languages): one row per document.

    ``language`` is that of most words, whichever lines they stand in, ``confidence`` its part of the words that have one,
    ``languages`` the number of languages that lead a line. Of languages with equally many words, the one that leads lines
    of more words is taken. Documents without words have a null language and confidence 0.
    """
    lines, names = _lines(documents, samples, True)
    own = lines.where("language IS NOT NULL").groupBy("doc_id").agg(
        *[F.sum(F.col("votes")[k]).alias(f"w{k}") for k in range(len(names))],
        *[F.sum(F.when(F.col("language") == x, F.col("words")).otherwise(0)).alias(f"led{k}") for k, x in enumerate(names)],
    )
    first = F.array_max(F.array(*[F.struct(F.col(f"w{k}").alias("w"), F.col(f"led{k}").alias("led"), F.lit(x).alias("language")) for k, x in enumerate(names)]))
    total, led = sum(F.col(f"w{k}") for k in range(len(names))), sum((F.col(f"led{k}") > 0).cast("bigint") for k in range(len(names)))
    best = own.select("doc_id", first.alias("m"), total.alias("all"), led.alias("languages")).select("doc_id", "m.language", (F.col("m.w") / F.col("all")).alias("confidence"), "languages")
    docs = documents.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(label(F.col("lang"))).alias("label"))
    return docs.join(best, "doc_id", "left").select("doc_id", "label", "language", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("languages", F.lit(0)).alias("languages"))
